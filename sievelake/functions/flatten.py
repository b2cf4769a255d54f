"""Python sources as rows: table functions that turn a text into its calls or its function spans.

The tree is walked once, operands before the call that uses them.  Each call row carries what
the rules ask for: where it stands, the dotted name of its callee, shapes of its arguments, and
the trace of the variable that its first argument names.  Nothing raises: a text that does not
parse gives one row that only has ``error``.

Scope facts that decide results: a ``def`` starts with its plain positional parameters and
nothing else, an ``async def`` and a class body share the scope they stand in, only ``name = value``
makes a trace, both arms of a branch count in the order they are written.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql.functions import udtf

CALLS_SCHEMA = (
    "ord int, line_start int, line_end int, function_name string, class_name string, fq string, fq_resolved string, "
    "func_type string, attr string, base string, base_attr string, n_args int, a0_type string, a0_dynamic boolean, "
    "a0_name string, a1_const string, "
    "kwargs array<struct<name:string,type:string,value:string,elts:array<string>,attr:string>>, "
    "trace struct<is_constant:boolean,is_sanitized:boolean,deps:array<string>,path:array<string>>, "
    "line string, around string, error string"
)
SPANS_SCHEMA = "ord int, line_start int, line_end int"
#: Calls whose result counts as cleaned, by their last name in lower case (fixed values).
CLEANERS = ("sanitize", "escape", "quote")


@dataclass
class Trace:
    constant: bool = False
    clean: bool = False
    deps: frozenset = frozenset()

    def row(self, name: str) -> tuple:
        deps = sorted(self.deps)
        return self.constant, self.clean, deps, [name, *deps]


@dataclass(frozen=True)
class Place:
    """Where a node stands; ``traces`` is the scope's own, shared by all that stand in it."""

    traces: dict = field(compare=False)
    function: str | None = None
    owner: str | None = None


def dotted(node: ast.expr) -> str:
    """``a.b.c`` of a name or attribute chain; another kind of base says nothing."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


def is_dynamic(node: ast.expr | None) -> bool:
    """A string put together in place: f-string, ``+`` or ``%``, ``.format()``."""
    match node:
        case ast.JoinedStr() | ast.BinOp(op=ast.Add() | ast.Mod()) | ast.Call(func=ast.Attribute(attr="format")):
            return True
    return False


def names_in(node: ast.AST, but: ast.AST | None = None) -> list[str]:
    return [x.id for x in ast.walk(node) if isinstance(x, ast.Name) and x is not but]


def trace_of(value: ast.expr, known: dict[str, Trace]) -> Trace:
    """What an assigned value is known to be."""
    match value:
        case ast.Constant():
            return Trace(constant=True)
        case ast.Name(id=name):
            old = known.get(name, Trace())
            return Trace(old.constant, old.clean, old.deps | {name})
        case ast.BinOp():
            names = names_in(value)
            clean = any(known[n].clean for n in names if n in known)
        case ast.Call(func=f):
            names = names_in(value, but=f)
            last = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""
            clean = last.lower() in CLEANERS
        case _:
            return Trace()
    return Trace(clean=clean, deps=frozenset(names).union(*(known[n].deps for n in names if n in known)))


def calls_of(tree: ast.AST) -> Iterator[tuple[ast.Call, Place, dict[str, str]]]:
    """Every call after its operands, with its place and the import names known there."""
    aliases: dict[str, str] = {}

    def visit(node: ast.AST, at: Place) -> Iterator:
        match node:
            case ast.Import(names=names):
                aliases.update({n.asname or n.name: n.name for n in names})
            case ast.ImportFrom(module=module, names=names):
                aliases.update({n.asname or n.name: f"{module}.{n.name}" if module else n.name for n in names})
            case ast.Assign(targets=targets, value=value):
                yield from visit(value, at)
                new = trace_of(value, at.traces)
                at.traces.update({t.id: new for t in targets if isinstance(t, ast.Name)})
                for t in targets:
                    yield from visit(t, at)
                return
            case ast.FunctionDef(name=name, args=args):
                at = Place({a.arg: Trace() for a in args.args}, name, at.owner)
            case ast.ClassDef(name=name):
                at = Place(at.traces, at.function, name)
        for child in ast.iter_child_nodes(node):
            yield from visit(child, at)
        if isinstance(node, ast.Call):
            yield node, at, aliases

    yield from visit(tree, Place({}))


def keyword_row(k: ast.keyword) -> tuple:
    value = k.value
    return (
        k.arg,
        type(value).__name__,
        repr(value.value) if isinstance(value, ast.Constant) else None,
        [str(e.value) for e in value.elts if isinstance(e, ast.Constant)] if isinstance(value, ast.List) else None,
        value.attr if isinstance(value, ast.Attribute) else None,
    )


def call_row(i: int, call: ast.Call, at: Place, aliases: dict[str, str], lines: list[str]) -> tuple:
    func, args = call.func, call.args
    base = func.value if isinstance(func, ast.Attribute) else None
    first = args[0] if args else None
    name = first.id if isinstance(first, ast.Name) else None
    fq = dotted(func)
    head, dot, tail = fq.partition(".")
    start = call.lineno
    return (
        i, start, call.end_lineno or start, at.function, at.owner,
        fq, aliases.get(head, head) + dot + tail,
        type(func).__name__,
        func.attr if isinstance(func, ast.Attribute) else None,
        base.id if isinstance(base, ast.Name) else None,
        base.attr if isinstance(base, ast.Attribute) else None,
        len(args),
        type(first).__name__ if first is not None else None,
        is_dynamic(first),
        name,
        repr(args[1].value) if len(args) > 1 and isinstance(args[1], ast.Constant) else None,
        [keyword_row(k) for k in call.keywords],
        at.traces[name].row(name) if name in at.traces else None,
        lines[start - 1] if start <= len(lines) else "",
        "\n".join(lines[max(0, start - 3) : start + 2]),
        None,
    )


@udtf(returnType=CALLS_SCHEMA)
class PythonCalls:
    """``python_calls(content)``: a row per call, or one with ``error``."""

    def eval(self, content: str):
        try:
            tree, lines = ast.parse(content), content.splitlines()
            rows = [call_row(i, *found, lines) for i, found in enumerate(calls_of(tree))]
        except (SyntaxError, ValueError, RecursionError, MemoryError, TypeError) as e:
            rows = [(None,) * 20 + (f"{type(e).__name__}: {e}",)]
        yield from rows


@udtf(returnType=SPANS_SCHEMA)
class FunctionSpans:
    """``function_spans(content)``: functions breadth first; one row of nulls if there is none, no row if it does not parse."""

    def eval(self, content: str):
        try:
            found = [n for n in ast.walk(ast.parse(content)) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
        except (SyntaxError, ValueError, RecursionError, MemoryError, TypeError):
            return
        if not found:
            yield None, None, None
        for i, n in enumerate(found):
            yield i, n.lineno, n.end_lineno or n.lineno + 20


def register(spark) -> None:
    """Make both table functions usable in SQL."""
    spark.udtf.register("python_calls", PythonCalls)
    spark.udtf.register("function_spans", FunctionSpans)
