"""Scalar functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Severities by rank (fixed values).
SEVERITY_RANK = {"INFO": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}

#: Directory names that are never scanned (fixed values).
IGNORED = (".git", "node_modules", "venv", ".venv", "__pycache__", "dist", "build", "coverage", "target", ".idea", ".vscode")

#: File patterns by language (fixed values): exact names are tried for all languages first, then suffixes.
ANALYZERS = {
    "python": (".py",),
    "config": (".json", ".txt", ".env", ".yml", ".yaml", "Dockerfile", "package.json", "requirements.txt"),
}

#: Points for words that make a file worth looking at first (fixed values).
RISK_POINTS = {
    "request": 2, "app.route": 5, "fastapi": 3, "execute": 4, "commit": 3, "session.query": 4, "subprocess": 10,
    "os.system": 10, "eval": 10, "exec(": 10, "open(": 2, "requests.": 5, "urllib": 5, "http": 3, "sql": 5,
}

#: Rule families by what the lower-cased "rule category" text contains, first hit wins (fixed values).
FAMILIES = (
    ("sqli", ("sql",)),
    ("path_traversal", ("path", "traversal", "zipslip", "archive")),
    ("ssrf", ("ssrf", "request")),
    ("xss", ("xss", "cross-site")),
    ("cmd_injection", ("cmd", "command", "eval", "exec")),
    ("deserialization", ("deserialization", "pickle")),
)

#: Characters at which Python ends a line, ``\r\n`` counting as one (fixed values).
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
#: White space as Python strips it (fixed values).
BLANK = "[\t-\r\x1c- \x85\xa0  -     　]+"


def severity_rank(severity: Column) -> Column:
    """Rank 0 to 4; an unknown name ranks 0."""
    rank = F.create_map(*[F.lit(x) for pair in SEVERITY_RANK.items() for x in pair])
    return F.coalesce(F.try_element_at(rank, severity), F.lit(0))


def threshold_rank(name: str) -> int:
    """Rank of a fail threshold; an unknown name is LOW."""
    return SEVERITY_RANK.get(name.upper(), 1)


def effective_confidence(confidence: Column, adjustment: Column, likely: Column) -> Column:
    """Confidence after an assessment; without one (``likely`` null) it is unchanged."""
    moved = confidence + adjustment
    return F.when(likely.isNull(), confidence).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(likely, moved).otherwise(F.least(moved, F.lit(0.2))))))


def rule_family(rule_id: Column, category: Column) -> Column:
    text = F.lower(F.concat_ws(" ", rule_id, category))
    out = F.lit("other")
    for family, marks in reversed(FAMILIES):
        hit = F.lit(False)
        for mark in marks:
            hit = hit | text.contains(mark)
        out = F.when(hit, family).otherwise(out)
    return out


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def fingerprint(category: Column, file: Column, line: Column, family: Column) -> Column:
    """Reproducible identity of a finding over runs."""
    return F.sha2(F.concat_ws(":", category, basename(file), line.cast("string"), family), 256)


def category_fingerprint(category: Column, file: Column, line: Column) -> Column:
    """The same with a family that follows from the category alone."""
    return fingerprint(category, file, line, F.when(F.lower(category).contains("injection"), "cmd_injection").otherwise(category))


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("CRITICAL", "HIGH"), "error").when(severity == "MEDIUM", "warning").otherwise("note")


def percent(share: Column) -> Column:
    """Whole per cent, halves to even."""
    return F.format_string("%.0f%%", F.bround(share * 100, 0))


def split_lines(text: Column) -> Column:
    """Lines as Python's splitlines gives them: no empty piece behind the last end."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_ENDS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}|{BLANK}$", "")


def get_line(lines: Column, n: Column) -> Column:
    """1-based line, empty outside."""
    return F.when(n >= 1, F.coalesce(F.try_element_at(lines, F.greatest(n, F.lit(1))), F.lit(""))).otherwise("")


def around(lines: Column, n: Column, reach: int = 2) -> Column:
    """Lines n - reach to n + reach, as far as there are any."""
    first = F.greatest(n - reach, F.lit(1))
    return F.array_join(F.slice(lines, first, n + reach - first + 1), "\n")


def risk_score(text: Column, points: dict[str, int] | None = None) -> Column:
    """Sum of the points of the words present; how often does not matter."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.when(low.contains(w), p).otherwise(0) for w, p in (points or RISK_POINTS).items()), F.lit(0))


def language(name: Column, suffix: Column | None = None, analyzers: dict[str, Sequence[str]] | None = None) -> Column:
    """Language of a file name; null for a name that no analyzer takes."""
    analyzers = analyzers or ANALYZERS
    # A suffix is what follows the last dot; a name that only begins or ends with a dot has none.
    suffix = suffix if suffix is not None else F.lower(F.regexp_extract(name, r"[^.].*?(\.[^.]+)$", 1))
    pairs = [(name == p, lang) for lang, ps in analyzers.items() for p in ps] + [(suffix == p, lang) for lang, ps in analyzers.items() for p in ps]
    out = F.lit(None).cast("string")
    for hit, lang in reversed(pairs):
        out = F.when(hit, lang).otherwise(out)
    return out


def is_ignored(abs_path: Column, ignored: Sequence[str] = ()) -> Column:
    """Any component of the path is an ignored name; an empty list means the default."""
    return F.arrays_overlap(F.split(abs_path, "/"), F.array(*[F.lit(x) for x in (ignored or IGNORED)]))


def is_fixture(abs_path: Column) -> Column:
    return abs_path.contains("tests/") | abs_path.contains("examples/")


def relative_path(abs_path: Column, root: Column) -> Column:
    """Below the root the rest of the path, for the root itself (or outside of it) the name."""
    return F.when(F.startswith(abs_path, F.concat(root, F.lit("/"))), F.substring(abs_path, F.length(root) + 2, F.length(abs_path))).otherwise(basename(abs_path))


def below(path: Column, root: str | None = None) -> Column:
    """A path as it stands below the root, ``.`` and ``..`` resolved; null if it leads out.  Without a root an absolute path
    stays absolute."""
    full = path if root is None else F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))

    def step(done: Column, part: Column) -> Column:
        back = F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))  # null: out of everything
        return F.when(part.isin("", "."), done).when(part == "..", back).otherwise(F.array_append(done, part))

    parts = F.aggregate(F.split(full, "/"), F.array().cast("array<string>"), step)
    out = F.array_join(parts, "/")
    if root is None:
        return F.when(F.startswith(path, F.lit("/")), F.concat(F.lit("/"), out)).otherwise(out)
    top = "/".join(x for x in root.split("/") if x)
    return F.when(out == top, "").when(F.startswith(out, F.lit(top + "/" if top else "")), F.substring(out, len(top) + 2 if top else 1, 1 << 20))


def unit_span(start: Column, end: Column, n_lines: Column, low: int = 20, high: int = 100) -> Column:
    """Function span padded to ``low`` lines within the file and cut ``high`` lines behind its start."""
    pad = F.floor((F.lit(low) - (end - start)) / 2)
    short = (end - start) < low
    s = F.when(short, F.greatest(F.lit(1), start - pad)).otherwise(start)
    e = F.when(short, F.least(n_lines, end + pad)).otherwise(end)
    return F.struct(s.cast("int").alias("start"), F.when(e - s > high, s + high).otherwise(e).cast("int").alias("end"))


def duration_seconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / 1e6


def origins(text: Column) -> Column:
    """A comma list, trimmed, without empty entries."""
    return F.filter(F.transform(F.split(text, ","), lambda x: strip(x)), lambda x: x != "")


def url_quote(text: Column) -> Column:
    """Per-cent encoding that leaves letters, digits, ``_.-~`` and ``/`` alone."""
    out = F.url_encode(text)
    for form, plain in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        out = F.replace(out, F.lit(form), F.lit(plain))
    return out


def error_status(kind: Column, remote: bool = False) -> Column:
    """HTTP status for a kind of failure."""
    codes = {"invalid_url": 400, "too_large": 413, "not_found": 404, "rate_limited": 403, "upstream": 502}
    out = F.lit(500)
    for name, code in codes.items():
        out = F.when(kind == name, code).otherwise(out)
    return F.when(kind == "unknown_provider", 500 if remote else 400).otherwise(out)


#: Names that bring data in, use it dangerously (with weight) or clean it, by category (fixed values).
TAINT = {
    "source": {
        "web": ("request.args.get", "request.form.get", "request.get_json", "request.values.get", "flask.request"),
        "cli": ("sys.argv", "argparse", "optparse"),
        "env": ("os.environ", "os.getenv"),
        "file": ("open", "read", "readlines"),
    },
    "sink": {
        "sql": {"execute": 0.8, "executemany": 0.8},
        "command": {"os.system": 0.8, "os.popen": 0.8, "subprocess.run": 0.7, "subprocess.Popen": 0.7, "subprocess.call": 0.7, "subprocess.check_call": 0.7, "subprocess.check_output": 0.7},
        "path_traversal": {"open": 0.7, "os.path.join": 0.6},
        "xss": {"render_template_string": 0.9, "flask.render_template_string": 0.9, "django.http.HttpResponse": 0.7},
        "ssrf": {"requests.get": 0.8, "requests.post": 0.8, "requests.request": 0.8, "urllib.request.urlopen": 0.8},
        "deserialization": {"pickle.loads": 0.9, "pickle.load": 0.9, "yaml.load": 0.8},
    },
    "sanitizer": {
        "sql": ("escape_string", "re.escape", "quote"),
        "command": ("shlex.quote",),
        "path_traversal": ("os.path.abspath", "os.path.basename", "werkzeug.utils.secure_filename"),
        "xss": ("escape", "html.escape", "flask.escape"),
        "ssrf": ("urllib.parse.urlparse",),
    },
}

#: Call names by what they reach (fixed values).
SINK_CALLS = {
    "subprocess": ("subprocess.run", "subprocess.Popen", "subprocess.call", "subprocess.check_call", "os.system", "os.popen", "os.execv"),
    "filesystem": ("open", "os.open", "os.remove", "os.rename", "shutil.rmtree"),
    "networking": ("requests.get", "requests.post", "urllib.request.urlopen", "httpx.get", "httpx.post", "aiohttp.ClientSession.get"),
    "rendering": ("render_template_string", "jinja2.Template"),
}


def taint_table(spark: SparkSession) -> DataFrame:
    """(kind, category, name, weight, ord): the taint dictionary."""
    rows, i = [], 0
    for kind, categories in TAINT.items():
        for category, names in categories.items():
            for name in names:
                rows.append((kind, category, name, float(names[name]) if isinstance(names, dict) else None, i))
                i += 1
    return spark.createDataFrame(rows, "kind string, category string, name string, weight double, ord int")


def taint_names(spark: SparkSession, kind: str, category: str | None = None) -> DataFrame:
    """(name, weight) of a kind, all categories or one; of equal names the last category's weight stands."""
    table = taint_table(spark).where(F.col("kind") == kind)
    table = table if category is None else table.where(F.col("category") == category)
    return table.groupBy("name").agg(F.max_by("weight", "ord").alias("weight"))


def is_sanitizer(name: Column, category: str | None = None) -> Column:
    """A listed cleaner; the bare name ``sanitize`` is not trusted."""
    groups = TAINT["sanitizer"]
    names = {n for c, ns in groups.items() if category in (None, c) for n in ns}
    return (name != "sanitize") & name.isin(*sorted(names))


def is_sink(fq: Column, fq_resolved: Column, category: str | None = None) -> Column:
    names = sorted({n for c, ns in SINK_CALLS.items() if category in (None, c) for n in ns})
    return fq.isin(*names) | fq_resolved.isin(*names)
