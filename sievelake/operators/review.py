"""Review units: what a model is shown of a file, and in which order files go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions import scalars as S
from sievelake.functions.flatten import FunctionSpans

#: A path that holds one of these anywhere is not reviewed.
SKIPPED = (".venv", ".git", "__pycache__")


def reviewable(files: DataFrame) -> DataFrame:
    """Python files outside of skipped folders, by risk, ties by path."""
    folder = F.regexp_replace("abs_path", "/[^/]*$", "")
    keep = F.col("name").endswith(".py")
    for s in SKIPPED:
        keep = keep & ~folder.contains(s)
    return files.where(keep).withColumn("risk", S.risk_score(F.col("content"))).orderBy(F.desc("risk"), "path")


def chunk_bounds(n_lines: Column, size: int = 100) -> Column:
    """(start, end) of chunks of ``size`` lines; none for no lines."""
    return F.when(n_lines > 0, F.transform(F.sequence(F.lit(1), n_lines, F.lit(size)), lambda s: F.struct(s.alias("start"), F.least(s + size - 1, n_lines).alias("end")))).otherwise(
        F.array().cast("array<struct<start:int,end:int>>")
    )


def review_units(files: DataFrame, low: int = 20, high: int = 100) -> DataFrame:
    """(path, risk, unit_ord, start_line, end_line, context_type, code): functions breadth first, chunks of
    lines for a file without any, nothing for one that does not parse."""
    spans = files.lateralJoin(FunctionSpans(F.col("content").outer()))
    spans = spans.select("path", "risk", "ord", "line_start", "line_end", F.explode(F.array(S.split_lines(F.col("content")))).alias("lines"))
    n = F.size("lines")
    unit = F.when(F.col("ord").isNotNull(), F.array(S.unit_span(F.col("line_start"), F.col("line_end"), n, low, high))).otherwise(chunk_bounds(n, high))
    units = spans.select("path", "risk", "ord", "lines", F.posexplode(unit).alias("k", "u"))
    return units.select(
        "path", "risk",
        F.coalesce("ord", "k").alias("unit_ord"),
        F.col("u.start").alias("start_line"),
        F.col("u.end").alias("end_line"),
        F.when(F.col("ord").isNotNull(), "function").otherwise("chunk").alias("context_type"),
        F.array_join(F.slice("lines", F.col("u.start"), F.greatest(F.col("u.end") - F.col("u.start") + 1, F.lit(0))), "\n").alias("code"),
    )


def discovery_prompt(units: DataFrame) -> Column:
    return F.concat(
        F.lit("Find security weaknesses in this code.\n\nFile: "), units.path, F.lit("\nLines: "), units.start_line.cast("string"), F.lit("-"),
        units.end_line.cast("string"), F.lit("\nContext: "), units.context_type, F.lit("\n\nCode:\n"), units.code,
    )


def _listed(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.array_join(values, ", ")).otherwise("None")


def verify_prompt() -> Column:
    """What a model is told about a finding row."""
    shown = F.when(F.coalesce(F.col("context.surrounding_code"), F.lit("")) != "", F.col("context.surrounding_code")).otherwise(F.col("context.snippet"))
    function = F.when(F.coalesce(F.col("context.function_name"), F.lit("")) != "", F.col("context.function_name")).otherwise("Global")
    return F.concat(
        F.lit("Rule: "), F.col("identity.rule_id"), F.lit(" ("), F.col("identity.title"), F.lit(")\nSeverity: "), F.col("classification.severity"),
        F.lit("\n\nFile: "), F.col("location.file"), F.lit("\nLine: "), F.col("location.line_start").cast("string"), F.lit("\nFunction: "), function,
        F.lit("\n\nCode:\n"), shown, F.lit("\n\nSources: "), _listed(F.col("data_flow.sources")), F.lit("\nSinks: "), _listed(F.col("data_flow.sinks")),
        F.lit("\nSanitizers: "), _listed(F.col("data_flow.sanitizers")), F.lit("\n"),
    )
