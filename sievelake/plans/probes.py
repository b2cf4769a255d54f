"""Queries that run the rules, the taint tracking and whole scans over sources made from the generated tables.

Every event becomes a statement of a Python file, every part a config file.  What a statement must lead to
is known from how it was made, so the SQL says it without a parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelake.operators import findings
from sievelake.operators.assess import written
from sievelake.operators.rules import fire
from sievelake.plans import scan
from sievelake.plans.shapes import query, table
from sievelake.sources import files

_H, _M, _L, _C = "HIGH", "MEDIUM", "LOW", "CRITICAL"
#: (statement, findings as (rule, severity, confidence)); {v} is a name of the event's own.
STATEMENTS = (
    ("z.extractall({v})", [("python.archive_traversal", _H, 0.8)]),
    ("os.system({v})", [("python.command.injection", _H, 0.7)]),
    ("subprocess.run({v}, shell=True)", [("python.command.injection", _H, 0.85)]),
    ("CORS(app, origins=['*', {v}, '*'])", [("python.cors_wildcard", _H, 0.8)] * 2),
    ("app.run(debug=True, port={v})", [("python.debug_mode", _H, 0.8)]),
    ("eval({v})", [("python.eval_exec", _H, 0.8)]),
    ("os.chmod({v}, 0o777)", [("python.file_permissions", _H, 0.8)]),
    ("hashlib.md5({v})", [("python.crypto.insecure_hash", _M, 0.9), ("python.password_storage", _H, 0.8)]),
    ("n = random.random() + {v}", [("python.crypto.insecure_random", _L, 0.5)]),
    ("decode({v}, verify_signature=False, algorithms=['none'])", [("python.jwt_insecure", _H, 0.8)] * 2),
    ("open('a' + {v})", [("python.path.traversal", _H, 0.6)]),
    ("c.execute('q' + {v})", [("python.sql.injection", _H, 0.75)]),
    ("c.execute({v})", [("python.sql.injection", _H, 0.45)]),
    ("requests.get({v})", [("python.ssrf", _H, 0.8)]),
    ("render_template_string({v})", [("python.ssti", _H, 0.8)]),
    ("tempfile.mktemp({v})", [("python.temp_files", _H, 0.8)]),
    ("s.get('http://a', verify=False, t={v})", [("python.tls_verify", _H, 0.8)]),
    ("pickle.loads({v})", [("python.deserialization.unsafe", _C, 0.85)]),
    ("flask.redirect({v})", [("python.unsafe_redirect", _H, 0.8)]),
    ("DES3.new({v})", [("python.crypto.weak_cipher", _H, 0.95)]),
    ("Markup({v})", [("python.xss", _H, 0.8)]),
    ("fromstring({v})", [("python.xxe", _H, 0.8)]),
    ("print({v})", []),
    ("print('{v}')  # nosec", []),
    ("hashlib.sha256({v})", []),
)
_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_STATEMENT_SQL = "[" + ", ".join(_quoted(s) for s, _ in STATEMENTS) + f"][event_id % {len(STATEMENTS)} + 1]"
_FIRED_SQL = "(VALUES " + ", ".join(f"({k}, {_quoted(r)}, '{s}', {c})" for k, (_, found) in enumerate(STATEMENTS) for r, s, c in found) + ") AS f(k, rule_id, severity, confidence)"


def as_files(rows: DataFrame, path: Column, order: list[str], lines: Column, head: str = "") -> DataFrame:
    """Files of the rows that share a ``path``: their ``lines`` (arrays) in an order, below a ``head``."""
    rows = rows.select(path.alias("path"), F.struct(*order, lines.alias("lines")).alias("row")).groupBy("path").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    text = F.concat(F.lit(head), F.array_join(F.flatten(F.transform("rows", lambda r: r.lines)), "\n"), F.lit("\n"))
    out = rows.select("path", F.concat(F.lit("/project/"), "path").alias("abs_path"), F.substring_index("path", "/", -1).alias("name"), text.alias("content"), F.lit(None).cast("string").alias("error"))
    return files.classify(out)


def _event_files(spark: SparkSession, sf_dir: str, folder: Column, per_file: int, line: Column) -> DataFrame:
    """A user's events in order, ``per_file`` lines to a file."""
    by_user = Window.partitionBy("user_id").orderBy("event_id")
    events = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(by_user) - 1)
    path = F.concat(folder, F.lit("u"), "user_id", F.lit("_"), F.floor(F.col("n") / per_file).cast("string"), F.lit(".py"))
    return as_files(events, path, ["n"], F.array(line))


@query(f"""
WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, {_STATEMENT_SQL} AS line FROM events),
s AS (SELECT *, n // 200 AS part, replace(line, '{{v}}', 'v' || event_id) AS text FROM e),
w AS (SELECT *, bool_or(contains(text, '# nosec')) OVER (PARTITION BY user_id, part ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS silent FROM s)
SELECT 'src/u' || user_id || '_' || part || '.py' AS file, (n % 200 + 1)::INT AS line, rule_id, severity, confidence::DOUBLE AS confidence, sha256(text) AS snippet_sha256
FROM w JOIN {_FIRED_SQL} ON f.k = event_id % {len(STATEMENTS)} WHERE NOT silent""")
def rules_fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All call rules over files whose lines are events, with suppression."""
    line = F.replace(F.element_at(F.array(*[F.lit(s) for s, _ in STATEMENTS]), (F.col("event_id") % len(STATEMENTS) + 1).cast("int")), F.lit("{v}"), F.concat(F.lit("v"), "event_id"))
    found = findings.findings(_event_files(spark, sf_dir, F.lit("src/"), 200, line))
    return found.select(
        F.col("location.file").alias("file"), F.col("location.line_start").alias("line"), F.col("identity.rule_id").alias("rule_id"), F.col("classification.severity").alias("severity"),
        F.round("classification.confidence", 6).alias("confidence"), F.sha2("context.snippet", 256).alias("snippet_sha256"),
    )


@query("""
SELECT path AS file, line::INT AS line, rule_id, severity, confidence::DOUBLE AS confidence FROM (
  SELECT 'p' || p_partkey || '/Dockerfile' AS path, 1 AS line, 'config.docker_root' AS rule_id, 'MEDIUM' AS severity, 0.8 AS confidence FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 3 > 0
  UNION ALL SELECT '.github/p' || p_partkey || '.yml', 2, 'ci.gh_actions_untrusted_data', 'HIGH', 0.85 FROM part WHERE p_partkey % 4 = 1 AND p_partkey % 3 = 1
  UNION ALL SELECT 'p' || p_partkey || '/package.json', 1, 'config.package_json', 'LOW', 0.8 FROM part WHERE p_partkey % 4 = 2 AND p_partkey % 3 < 2
  UNION ALL SELECT 'p' || p_partkey || '/requirements.txt', unnest([1, 5]), 'dep.unpinned', 'MEDIUM', 0.9 FROM part WHERE p_partkey % 4 = 3)""")
def config_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules for config files and requirements over a file for each part."""
    k, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    third = lambda a, b, c: F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise(c)
    text = lambda *x: F.array(*map(F.lit, x))
    kinds = (
        (F.concat(F.lit("p"), key, F.lit("/Dockerfile")), third(text("FROM x", "USER app"), text("FROM x", "RUN y"), text("FROM x", "# USER"))),
        (F.concat(F.lit(".github/p"), key, F.lit(".yml")), third(text("on: push", "- run: echo ok"), text("on: push", "- run: echo ${{ github.event.comment.body }}"), text("x: ${{ github.event.comment.body }}"))),
        (F.concat(F.lit("p"), key, F.lit("/package.json")), third(text('{"a": "*"}'), text('{"a": ">1"}'), text('{"a": "1.0"}'))),
        (F.concat(F.lit("p"), key, F.lit("/requirements.txt")), text("pkg", "# c", "", "b==1", "-r x.txt")),
    )
    path, lines = F.lit(None), F.lit(None)
    for i, (p, x) in enumerate(kinds):
        path, lines = F.when(k % 4 == i, p).otherwise(path), F.when(k % 4 == i, x).otherwise(lines)
    found = findings.findings(as_files(table(spark, sf_dir, "part"), path, ["p_partkey"], lines))
    return found.select(
        F.col("location.file").alias("file"), F.col("location.line_start").alias("line"), F.col("identity.rule_id").alias("rule_id"),
        F.col("classification.severity").alias("severity"), F.round("classification.confidence", 6).alias("confidence"),
    )


@query("""
WITH RECURSIVE a AS (SELECT event_id - event_id % 50 AS scope, event_id AS ord, event_id % 6 AS form, (event_id * 5 + event_id // 7) % 11 AS target, (event_id * 3 + event_id // 5) % 11 AS name FROM events),
e AS (SELECT x.scope, x.ord, x.form, x.name, max(y.ord) AS prev
      FROM a x LEFT JOIN a y ON x.scope = y.scope AND y.target = x.name AND y.ord < x.ord AND x.form NOT IN (2, 5) GROUP BY ALL),
c AS (SELECT scope, ord, form, name, prev FROM e UNION ALL SELECT c.scope, c.ord, e.form, e.name, e.prev FROM c JOIN e ON c.scope = e.scope AND c.prev = e.ord),
t AS (SELECT ord, coalesce(array_to_string(list_sort(list(DISTINCT name) FILTER (WHERE form NOT IN (2, 5))), ','), '') AS deps,
             bool_or(form = 2) AND NOT bool_or(form IN (3, 4)) AS is_constant, bool_or(form = 4) AS is_sanitized FROM c GROUP BY ord)
SELECT *, CASE WHEN is_constant THEN 0.15 WHEN is_sanitized THEN 0.25 ELSE 0.85 END::DOUBLE AS confidence FROM t""")
def taint_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a queried variable depends on through copies, sums and cleaners, and how sure the finding is; fifty events are
    a function's assignments, each followed by a use."""
    k = F.col("event_id")
    target, name = (F.concat(F.lit("v"), ((k * a + F.floor(k / b)) % 11).cast("string")) for a, b in ((5, 7), (3, 5)))
    form = lambda *parts: F.concat(F.lit("    "), target, F.lit(" = "), *[F.lit(p) if isinstance(p, str) else p for p in parts])
    made = F.when(k % 6 == 2, form("'k'")).when(k % 6 == 3, form(name, " + 'x'")).when(k % 6 == 4, form("escape(", name, ")")).when(k % 6 == 5, form("[", name, "]")).otherwise(form(name))
    used = F.concat(F.lit("    c.execute("), target, F.lit(", "), k.cast("string"), F.lit(")"))
    path = F.concat(F.lit("src/f"), (k - k % 50).cast("string"), F.lit(".py"))
    sources = as_files(table(spark, sf_dir, "events"), path, ["event_id"], F.array(made, used), "def f(c):\n")
    hits = fire(findings.calls(sources).where("fq = 'c.execute'")).where("rule_id = 'python.sql.injection'")
    deps = F.array_join(F.transform(F.array_sort(F.transform("trace.deps", lambda d: F.substring(d, 2, 9).cast("int"))), lambda d: d.cast("string")), ",")
    return hits.select(F.col("a1_const").cast("long").alias("ord"), deps.alias("deps"), F.col("trace.is_constant"), F.col("trace.is_sanitized"), F.round("confidence", 6).alias("confidence"))


@query("""
SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS prior FROM events""")
def asof_last_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event the user's last click before it: a use of a variable that every click assigns anew."""
    k = F.col("event_id").cast("string")
    used = F.concat(F.lit("c.execute(x, "), k, F.lit(")"))
    lines = F.when(F.col("event_type") == "click", F.array(used, F.concat(F.lit("x = e"), k))).otherwise(F.array(used))
    sources = as_files(table(spark, sf_dir, "events"), F.concat(F.lit("src/u"), "user_id", F.lit(".py")), ["ts", "event_id"], lines)
    calls = findings.calls(sources).where("fq = 'c.execute'")
    return calls.select(F.col("a1_const").cast("long").alias("event_id"), F.coalesce(F.substring(F.get("trace.deps", F.lit(0)), 2, 20).cast("long"), F.lit(-1)).alias("prior"))


@query("""
WITH e AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 50 AS part FROM events),
s AS (SELECT CASE event_type WHEN 'purchase' THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM e WHERE event_type IN ('error', 'purchase', 'click')),
d AS (SELECT DISTINCT user_id, part, 'HIGH' AS severity FROM e WHERE user_id % 3 = 0)
SELECT mode, severity, count(*) AS n FROM (
  SELECT 'static' AS mode, severity FROM s UNION ALL SELECT 'hybrid', severity FROM s UNION ALL SELECT 'hybrid', severity FROM d) GROUP BY ALL""")
def mode_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan of the same files reports without a model and, in hybrid mode, with the one that has fixed answers."""
    said = F.when(F.col("event_type") == "error", "os.system(x)").when(F.col("event_type") == "purchase", "pickle.loads(x)").when(F.col("event_type") == "click", "requests.get(x)").otherwise("pass")
    folder = F.when(F.col("user_id") % 3 == 0, "vulnerable/").otherwise("other/")
    tree = written(_event_files(spark, sf_dir, folder, 50, said))
    out = None
    for mode in ("static", "hybrid"):
        session = scan.scan_files(spark, tree, "/project", ai=mode != "static", mode=mode)
        each = session.findings.select(F.lit(mode).alias("mode"), F.col("classification.severity").alias("severity"))
        out = each if out is None else out.unionByName(each)
    return out.groupBy("mode", "severity").agg(F.count(F.lit(1)).alias("n"))
