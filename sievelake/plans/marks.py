"""Queries that run the column functions of calls, paths and reports over the generated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.functions import scalars as S
from sievelake.operators import assess, rollup
from sievelake.plans.shapes import _SEVERITY, _SEVERITY_SQL, query, table

_CALLS = ("subprocess.run", "open", "requests.get", "jinja2.Template", "os.execv", "print", "shlex.quote", "html.escape", "sanitize", "quote", "sys.argv", "request.form.get", "pickle.loads")
_text = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_CALL_SQL = f"{list(_CALLS)!r}"


@query(f"""
WITH c AS (SELECT event_id, {_CALL_SQL}[event_id % 13 + 1] AS fq, {_CALL_SQL}[event_id // 13 % 13 + 1] AS resolved FROM events)
SELECT event_id, fq IN {_text(n for ns in S.SINK_CALLS.values() for n in ns)} OR resolved IN {_text(n for ns in S.SINK_CALLS.values() for n in ns)} AS any_sink,
       fq IN {_text(S.SINK_CALLS["networking"])} OR resolved IN {_text(S.SINK_CALLS["networking"])} AS net_sink,
       fq IN {_text(n for ns in S.TAINT["sanitizer"].values() for n in ns)} AND fq <> 'sanitize' AS cleans, fq IN {_text(S.TAINT["sanitizer"]["command"])} AS cleans_command FROM c""")
def call_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which calls reach something dangerous, by name as written or as resolved, and which clean."""
    k = F.col("event_id")
    names = F.array(*map(F.lit, _CALLS))
    fq, resolved = (F.element_at(names, (n % 13 + 1).cast("int")) for n in (k, F.floor(k / 13)))
    return table(spark, sf_dir, "events").select(
        "event_id", S.is_sink(fq, resolved).alias("any_sink"), S.is_sink(fq, resolved, "networking").alias("net_sink"), S.is_sanitizer(fq).alias("cleans"), S.is_sanitizer(fq, "command").alias("cleans_command")
    )


_TAINT_SQL = ", ".join(
    f"('{kind}', '{category}', '{name}', {names[name] if isinstance(names, dict) else 'NULL'}, {i})"
    for i, (kind, category, names, name) in enumerate((k, c, ns, n) for k, cs in S.TAINT.items() for c, ns in cs.items() for n in ns)
)


@query(f"""
WITH t(kind, category, name, weight, ord) AS (VALUES {_TAINT_SQL}), e AS (SELECT {_CALL_SQL}[event_id % 13 + 1] AS name, count(*) AS n FROM events GROUP BY 1),
s AS (SELECT kind, name, weight FROM t QUALIFY row_number() OVER (PARTITION BY kind, name ORDER BY ord DESC) = 1)
SELECT kind, name, weight::DOUBLE AS weight, coalesce(n, 0)::BIGINT AS n_events FROM s LEFT JOIN e USING (name)""")
def taint_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name of the taint dictionary with its weight, and the events that call it."""
    called = F.element_at(F.array(*map(F.lit, _CALLS)), (F.col("event_id") % 13 + 1).cast("int"))
    events = table(spark, sf_dir, "events").groupBy(called.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    out = None
    for kind in S.TAINT:
        names = S.taint_names(spark, kind).select(F.lit(kind).alias("kind"), "name", "weight")
        out = names if out is None else out.unionByName(names)
    return out.join(events, "name", "left").select("kind", "name", "weight", F.coalesce("n", F.lit(0)).alias("n_events"))


_KINDS = ("invalid_url", "too_large", "not_found", "rate_limited", "upstream", "unknown_provider", "other")


@query(f"""
WITH e AS (SELECT event_id, event_id % 7 AS k, {_SEVERITY_SQL} AS severity, (event_id % 201) / 200.0 AS share, to_json([event_id]) AS j FROM events)
SELECT event_id, CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END AS level,
       round_even(share * 100, 0)::INT || '%' AS shown, [400, 413, 404, 403, 502, 400, 500][k + 1]::INT AS status, [400, 413, 404, 403, 502, 500, 500][k + 1]::INT AS status_remote,
       sha256(CASE WHEN k % 2 = 0 THEN 'SQL Injection' ELSE 'Secrets' END || ':f' || k || '.py:' || event_id || ':' || CASE WHEN k % 2 = 0 THEN 'cmd_injection' ELSE 'Secrets' END) AS fingerprint,
       CASE k WHEN 0 THEN '' WHEN 1 THEN '*' ELSE 'http://u' || event_id || '|http://b' END AS allowed FROM e""")
def report_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reports and services show of a finding or a failure."""
    k = F.col("event_id")
    names = F.create_map(*[F.lit(x) for kv in _SEVERITY.items() for x in kv])
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (k % 7 + 1).cast("int"))
    category = F.when(k % 7 % 2 == 0, "SQL Injection").otherwise("Secrets")
    file = F.concat(F.lit("/srv/f"), (k % 7).cast("string"), F.lit(".py"))
    listed = F.when(k % 7 == 0, " , ").when(k % 7 == 1, " *").otherwise(F.concat(F.lit("http://u"), k.cast("string"), F.lit(" ,, http://b\t")))
    return table(spark, sf_dir, "events").select(
        "event_id", S.sarif_level(F.try_element_at(names, "event_type")).alias("level"), S.percent((k % 201) / 200).alias("shown"),
        S.error_status(kind).cast("int").alias("status"), S.error_status(kind, remote=True).cast("int").alias("status_remote"),
        S.category_fingerprint(category, file, k).alias("fingerprint"), F.array_join(S.origins(listed), "|").alias("allowed"),
    )


@query("""
WITH p AS (SELECT page_id, page_id % 6 AS k, 'a' || page_id AS a FROM pages)
SELECT page_id, CASE k WHEN 0 THEN 'src/' || a WHEN 1 THEN a WHEN 2 THEN NULL WHEN 3 THEN 'x/' || a WHEN 4 THEN NULL ELSE '' END AS resolved,
       CASE k WHEN 3 THEN 'x/' || a WHEN 5 THEN 'app' WHEN 4 THEN 'app2' ELSE a END AS relative, CASE k WHEN 2 THEN 'a%20b/%C3%A9%2B%2A' || page_id ELSE 'p' || page_id || '/~_.-' END AS quoted FROM p""")
def path_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that a model names, as they stand below the project."""
    k = F.col("page_id") % 6
    a = F.concat(F.lit("a"), F.col("page_id").cast("string"))
    said = F.when(k == 0, F.concat(F.lit("./src//"), a)).when(k == 1, F.concat(F.lit("x/../"), a)).when(k == 2, F.concat(F.lit("../"), a))
    said = said.when(k == 3, F.concat(F.lit("/srv/app/x/"), a)).when(k == 4, F.lit("/srv/app2")).otherwise(F.lit("/srv/app"))
    quoted = F.when(k == 2, F.concat(F.lit("a b/é+*"), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("/~_.-")))
    return table(spark, sf_dir, "pages").select(
        "page_id", S.below(said, "/srv/app").alias("resolved"), S.relative_path(said, F.lit("/srv/app")).alias("relative"), S.url_quote(quoted).alias("quoted")
    )


@query("""
WITH f AS (SELECT event_id % 2 = 0 AS s, event_id % 3 = 0 AS d, event_id % 5 = 0 AS v, event_type AS rule_id, user_id AS file FROM events)
SELECT count(*) AS findings, count(*) FILTER (WHERE s) AS static_findings, count(*) FILTER (WHERE NOT s AND d) AS ai_findings, count(*) FILTER (WHERE v) AS verified_findings,
       count(*) FILTER (WHERE s AND d) AS correlated_findings, count(DISTINCT rule_id) AS rules_hit, count(DISTINCT file) AS flagged_files FROM f""")
def session_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of a session over events as findings of several sources."""
    k = F.col("event_id")
    named = F.array(F.when(k % 2 == 0, "static-rule"), F.when(k % 3 == 0, "ai-discovery"), F.when(k % 5 == 0, "ai-verified"))
    rows = table(spark, sf_dir, "events").select(
        F.array_compact(F.array_append(named, F.lit("other"))).alias("analysis_source"), F.struct(F.col("event_type").alias("rule_id")).alias("identity"), F.struct(F.col("user_id").cast("string").alias("file")).alias("location")
    )
    return rollup.counters(rows)


@query("""
WITH c AS (SELECT event_id, least(value / 500, 1) AS c, event_id % 4 AS l, CASE event_id % 3 WHEN 0 THEN 0.1 WHEN 1 THEN -0.5 ELSE 0.7 END AS adj FROM events),
m AS (SELECT event_id, CASE WHEN l > 1 THEN c WHEN l = 0 THEN greatest(0, least(1, c + adj)) ELSE greatest(0, least(0.2, c + adj)) END AS eff FROM c)
SELECT event_id FROM m WHERE eff >= 0.4 AND eff <= 0.95""")
def verify_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings worth a second opinion."""
    k = F.col("event_id")
    said = F.struct(
        F.when(k % 4 == 0, True).when(k % 4 == 1, False).alias("is_likely_vulnerable"), F.when(k % 3 == 0, 0.1).when(k % 3 == 1, -0.5).otherwise(0.7).alias("confidence_adjustment")
    )
    rows = table(spark, sf_dir, "events").select("event_id", F.struct(F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence")).alias("classification"), said.alias("ai_assessment"))
    return rows.where(assess.in_band()).select("event_id")
