"""Queries that run the operators over the generated tables, at any scale, each with its SQL.

The tables hold no source code, so keywords, tokens and scales are parameters here; the operators are
the ones that scans use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelake.functions import scalars as S
from sievelake.operators import correlate, evaluate, findings, review, rollup
from sievelake.sources import acquire


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, line_no, line, around): lines of documents with their neighbours, without a shuffle."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(F.array(S.split_lines(F.col("text")))).alias("lines"))
    return docs.select("doc_id", "lang", F.inline(F.transform("lines", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"), S.around(F.col("lines"), i + 1).alias("around")))))


_SPLIT = r"""
l AS (SELECT doc_id, lang, CASE WHEN text = '' THEN [] WHEN p[-1] = '' THEN p[:-2] ELSE p END AS ls
      FROM (SELECT doc_id, lang, text, string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]') AS p FROM documents)),
n AS (SELECT doc_id, lang, unnest(range(1, len(ls) + 1)) AS line_no, ls FROM l),
e AS (SELECT doc_id, lang, line_no, ls[line_no] AS line,
             array_to_string(ls[greatest(line_no - 2, 1):line_no + 2], chr(10)) AS around FROM n)
"""

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("WITH " + _SPLIT + "SELECT doc_id, line_no::INT AS line_no, sha256(line) AS line_sha256 FROM e")
def lines_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_lines(spark, sf_dir).select("doc_id", "line_no", F.sha2("line", 256).alias("line_sha256"))


@query("WITH " + _SPLIT + "SELECT doc_id, line_no::INT AS line_no, length(around)::INT AS chars, sha256(around) AS around_sha256 FROM e")
def surrounding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_lines(spark, sf_dir).select("doc_id", "line_no", F.length("around").alias("chars"), F.sha2("around", 256).alias("around_sha256"))


@query(
    "WITH " + _SPLIT + """
SELECT lang, count(*) AS n_hits, count(DISTINCT doc_id) AS n_docs, (count(*) FILTER (WHERE contains(lower(line || around), 'license')))::BIGINT AS n_suppressed
FROM e WHERE contains(lower(line), 'the ') OR contains(lower(line), 'license') GROUP BY lang"""
)
def suppress_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a keyword, and how many of them a token within two lines silences."""
    low = F.lower("line")
    hits = _doc_lines(spark, sf_dir).where(low.contains("the ") | low.contains("license"))
    quiet = findings.suppressed(F.col("line"), F.col("around"), ("license",))
    return hits.groupBy("lang").agg(F.count(F.lit(1)).alias("n_hits"), F.count_distinct("doc_id").alias("n_docs"), F.count_if(quiet).alias("n_suppressed"))


_POINTS = {"the ": 2, "license": 5, "token": 10, "script": 4, "@": 3, "http": 3}


@query("SELECT doc_id, score::INT AS score, (rank() OVER (ORDER BY score DESC, doc_id))::INT AS place FROM (SELECT doc_id, " + " + ".join(f"(CASE WHEN contains(lower(text), '{w}') THEN {p} ELSE 0 END)" for w, p in _POINTS.items()) + " AS score FROM documents) ORDER BY score DESC, doc_id LIMIT 100")
def risk_score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred documents to look at first."""
    scored = table(spark, sf_dir, "documents").select("doc_id", S.risk_score(F.col("text"), _POINTS).cast("int").alias("score"))
    top = scored.orderBy(F.desc("score"), "doc_id").limit(100)
    return top.withColumn("place", F.rank().over(Window.orderBy(F.desc("score"), "doc_id")))


@query("SELECT page_id, " + " + ".join(f"(CASE WHEN contains(lower(coalesce(html, '')), '{w}') THEN {p} ELSE 0 END)" for w, p in S.RISK_POINTS.items()) + " AS score FROM pages")
def risk_score_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.risk_score(F.col("html")).cast("int").alias("score"))


@query(
    "WITH " + _SPLIT + """
SELECT doc_id, ((line_no - 1) // 20)::INT AS unit_ord, min(line_no)::INT AS start_line, max(line_no)::INT AS end_line, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS code_sha256
FROM e GROUP BY ALL"""
)
def chunk_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 20 lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(S.split_lines(F.col("text")))).alias("lines"))
    units = docs.select("doc_id", "lines", F.posexplode(review.chunk_bounds(F.size("lines"), 20)).alias("unit_ord", "u"))
    code = F.array_join(F.slice("lines", F.col("u.start"), F.col("u.end") - F.col("u.start") + 1), "\n")
    return units.select("doc_id", "unit_ord", F.col("u.start").alias("start_line"), F.col("u.end").alias("end_line"), F.sha2(code, 256).alias("code_sha256"))


@query("""
WITH s AS (SELECT event_id, (1 + event_id % 150)::INT AS s, (1 + event_id % 150 + event_id % 131)::INT AS e, 300 AS n FROM events),
p AS (SELECT event_id, CASE WHEN e - s < 20 THEN greatest(1, s - (20 - (e - s)) // 2) ELSE s END AS a, CASE WHEN e - s < 20 THEN least(n, e + (20 - (e - s)) // 2) ELSE e END AS b FROM s)
SELECT event_id, a::INT AS start_line, (CASE WHEN b - a > 100 THEN a + 100 ELSE b END)::INT AS end_line FROM p""")
def unit_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (1 + F.col("event_id") % 150).cast("int")
    span = S.unit_span(start, (start + F.col("event_id") % 131).cast("int"), F.lit(300))
    return table(spark, sf_dir, "events").select("event_id", span.alias("u")).select("event_id", F.col("u.start").alias("start_line"), F.col("u.end").alias("end_line"))


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host,
                  list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages),
v AS (SELECT page_id, parts, CASE WHEN lower(scheme) <> 'https' THEN 'scheme is not https' WHEN NOT ends_with(lower(host), '.com') THEN 'host is not allowed' WHEN len(parts) < 2 THEN 'no owner and repository'
             WHEN length(parts[1]) > 100 OR length(regexp_replace(parts[2], '\.git$', '')) NOT BETWEEN 1 AND 100 THEN 'name is too long or empty'
             WHEN coalesce(parts[3] IN ('issues', 'pull', 'releases', 'actions', 'wiki'), false) THEN 'not a repository page' END AS error FROM p)
SELECT page_id, CASE WHEN error IS NULL THEN parts[1] END AS owner, CASE WHEN error IS NULL THEN regexp_replace(parts[2], '\.git$', '') END AS repo, error FROM v""")
def url_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages; every host that ends in .com is allowed here, told from the address itself."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.lower(F.try_parse_url("url", F.lit("AUTHORITY"))).alias("host"))
    # The allow list is github.com in a scan; a host on the list stands in for it here.
    swapped = F.when(F.col("host").endswith(".com"), F.regexp_replace("url", "(?<=://)[^/?#]*", "github.com")).otherwise(F.col("url"))
    return pages.select("page_id", acquire.validate_url(swapped).alias("r")).select("page_id", "r.owner", "r.repo", "r.error")


@query(r"""
WITH p AS (SELECT page_id, '/srv/' || CASE page_id % 7 WHEN 0 THEN 'tests/' WHEN 1 THEN 'build/' WHEN 2 THEN 'node_modules/x/' WHEN 3 THEN '.github/' WHEN 4 THEN 'examples/' ELSE 'src/' END
  || CASE page_id % 9 WHEN 0 THEN 'Dockerfile' WHEN 1 THEN '.env' WHEN 2 THEN '__init__.py' WHEN 3 THEN 'A.PY' WHEN 4 THEN 'w.yml' WHEN 5 THEN 'x.tar.gz' WHEN 6 THEN 'package.json' WHEN 7 THEN 'notes.md' ELSE 'requirements.txt' END AS abs_path FROM pages)
SELECT page_id, CASE WHEN ends_with(lower(abs_path), '.py') THEN 'python' WHEN page_id % 9 IN (0, 1, 4, 6, 8) THEN 'config' END AS lang, page_id % 7 IN (1, 2) AS ignored, page_id % 7 IN (0, 4) AS is_fixture FROM p""")
def path_lang_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.element_at(F.array(*map(F.lit, ("tests/", "build/", "node_modules/x/", ".github/", "examples/", "src/", "src/"))), (F.col("page_id") % 7 + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, ("Dockerfile", ".env", "__init__.py", "A.PY", "w.yml", "x.tar.gz", "package.json", "notes.md", "requirements.txt"))), (F.col("page_id") % 9 + 1).cast("int"))
    paths = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/srv/"), folder, name).alias("p"))
    return paths.select("page_id", S.language(S.basename(F.col("p"))).alias("lang"), S.is_ignored(F.col("p")).alias("ignored"), S.is_fixture(F.col("p")).alias("is_fixture"))


_SEVERITY = {"error": "CRITICAL", "purchase": "HIGH", "click": "MEDIUM", "signup": "MEDIUM", "view": "LOW"}
_SEVERITY_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SEVERITY.items()) + " END"


def _event_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in _SEVERITY.items() for x in kv])
    return table(spark, sf_dir, "events").withColumn("severity", F.try_element_at(names, "event_type"))


_LEVELS = "(VALUES ('INFO', 0), ('LOW', 1), ('MEDIUM', 2), ('HIGH', 3), ('CRITICAL', 4)) AS v(severity, rank)"


@query(f"SELECT v.severity, v.rank::INT AS rank, coalesce(n, 0)::BIGINT AS n FROM {_LEVELS} LEFT JOIN (SELECT {_SEVERITY_SQL} AS severity, count(*) AS n FROM events GROUP BY 1) e ON e.severity = v.severity")
def findings_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.severity_histogram(_event_severity(spark, sf_dir).select("severity"))


@query(f"SELECT v.severity, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / (SELECT count(*) FROM events), 12) AS share FROM {_LEVELS} LEFT JOIN (SELECT {_SEVERITY_SQL} AS severity, count(*) AS n FROM events GROUP BY 1) e ON e.severity = v.severity")
def severity_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.severity_share(_event_severity(spark, sf_dir).select("severity")).withColumn("share", F.round("share", 12))


@query(f"""
WITH e AS (SELECT user_id, {_SEVERITY_SQL} AS severity FROM events), r AS (SELECT user_id, rank FROM e JOIN {_LEVELS} USING (severity))
SELECT user_id, bool_or(rank >= 4) AS critical, bool_or(rank >= 3) AS high, bool_or(rank >= 1) AS unknown_name FROM r GROUP BY user_id""")
def fail_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("severity")
    gates = [rollup.fails(s, name).alias(alias) for name, alias in (("CRITICAL", "critical"), ("high", "high"), ("whatever", "unknown_name"))]
    return _event_severity(spark, sf_dir).groupBy("user_id").agg(*gates)


@query("""
WITH e AS (SELECT event_id, 'r' || json_extract_string(props, '$.k') AS rule_id, event_type AS title FROM events)
SELECT rule_id, arg_min(title, event_id) AS title, min(event_id) AS first_id FROM e GROUP BY rule_id""")
def first_seen_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("r"), F.get_json_object("props", "$.k")).alias("rule_id"), F.col("event_type").alias("title"), "event_id")
    return rollup.first_seen(rows, "rule_id", [F.col("event_id")]).select("rule_id", "title", F.col("event_id").alias("first_id"))


@query("""
WITH c AS (SELECT event_id, least(value / 500, 1) AS c, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS likely, CASE event_id % 3 WHEN 0 THEN 0.1 WHEN 1 THEN -0.5 ELSE 0.7 END AS adj FROM events),
m AS (SELECT *, CASE WHEN likely IS NULL THEN c ELSE greatest(0, least(1, CASE WHEN likely THEN c + adj ELSE least(c + adj, 0.2) END)) END AS eff FROM c)
SELECT event_id, round(eff, 9) AS effective, eff BETWEEN 0.4 AND 0.95 AS in_band FROM m""")
def effective_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    likely = F.when(k % 4 == 0, True).when(k % 4 == 1, False)
    adjustment = F.when(k % 3 == 0, 0.1).when(k % 3 == 1, -0.5).otherwise(0.7)
    out = table(spark, sf_dir, "events").select("event_id", S.effective_confidence(F.least(F.col("value") / 500, F.lit(1.0)), adjustment, likely).alias("e"))
    return out.select("event_id", F.round("e", 9).alias("effective"), F.col("e").between(0.4, 0.95).alias("in_band"))


@query("""
WITH p AS (SELECT user_id AS file, event_id, event_id % 1000 AS line, event_id % 2 AS found FROM events),
m AS (SELECT a.event_id AS ai_id, min(s.event_id) AS static_id FROM p a JOIN p s ON a.file = s.file AND a.found = 1 AND s.found = 0 AND abs(a.line - s.line) <= 5 GROUP BY 1)
SELECT p.event_id AS ai_id, coalesce(static_id, -1) AS static_id FROM p LEFT JOIN m ON p.event_id = m.ai_id WHERE found = 1""")
def correlate_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each discovered row with the first static row of its file within five lines."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("id"), (F.col("event_id") % 1000).alias("line"), (F.col("event_id") % 2).alias("found"))
    near = correlate.nearest(rows.where("found = 0"), rows.where("found = 1"), ["file"])
    return near.select(F.col("id").alias("ai_id"), F.coalesce("static_id", F.lit(-1)).alias("static_id"))


@query(None)
def correlate_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole rule, with discovered rows that absorb each other."""
    events = table(spark, sf_dir, "events")
    places = events.select(
        F.col("user_id").cast("string").alias("file"), F.col("event_type").alias("family"), F.col("event_id").cast("string").alias("id"),
        (F.col("event_id") % 997).cast("int").alias("line"), (F.col("event_id") % 2).cast("int").alias("found"), F.col("event_id").alias("ord"),
    )
    return correlate.greedy(places, ["file", "family"]).select(F.col("id").cast("long").alias("event_id"), "keep", "marked")


_FAMILY_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(x, '{m}')" for m in marks) + f" THEN '{f}'" for f, marks in S.FAMILIES) + " ELSE 'other' END"
_RULE_TEXT = ("sql", "archive", "request", "xss", "eval", "pickle", "injection")


@query(f"""
WITH p AS (SELECT p_partkey, p_type AS category, 'rule.' || {list(_RULE_TEXT)!r}[p_partkey % 7 + 1] AS rule_id FROM part), f AS (SELECT *, lower(rule_id || ' ' || category) AS x FROM p)
SELECT p_partkey, {_FAMILY_SQL} AS family, sha256(category || ':' || 'm' || p_partkey % 10 || '.py:' || p_partkey || ':' || {_FAMILY_SQL}) AS fingerprint FROM f""")
def rule_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of rules and fingerprints of findings."""
    k = F.col("p_partkey")
    rule = F.concat(F.lit("rule."), F.element_at(F.array(*map(F.lit, _RULE_TEXT)), (k % 7 + 1).cast("int")))
    family = S.rule_family(rule, F.col("p_type"))
    file = F.concat(F.lit("/srv/app/m"), (k % 10).cast("string"), F.lit(".py"))
    return table(spark, sf_dir, "part").select("p_partkey", family.alias("family"), S.fingerprint(F.col("p_type"), file, k, family).alias("fingerprint"))


@query("""
WITH m AS (SELECT o_custkey AS archive, o_orderkey AS ord, CASE WHEN o_orderkey % 997 = 0 THEN '/etc/x' WHEN o_orderkey % 991 = 0 THEN 'a/../b' ELSE 'src/f' || o_orderkey END AS filename,
                  (o_totalprice * 10)::BIGINT AS size, CASE WHEN o_orderkey % 499 = 0 THEN 2717843456 ELSE 0 END AS attr FROM orders),
r AS (SELECT *, row_number() OVER w AS n, sum(size) OVER w AS total FROM m WINDOW w AS (PARTITION BY archive ORDER BY ord ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, CASE WHEN starts_with(filename, '/') OR starts_with(filename, chr(92)) THEN 'absolute path' WHEN contains(filename, '..') THEN 'path traversal' WHEN n > 12 THEN 'too many files'
                     WHEN size > 4000000 THEN 'file too large' WHEN total > 20000000 THEN 'archive too large' WHEN (attr >> 16) & 40960 = 40960 THEN 'symlink' END AS error FROM r)
SELECT archive, count(*) AS n_members, arg_min(error, ord) FILTER (WHERE error IS NOT NULL) AS error, arg_min(filename, ord) FILTER (WHERE error IS NOT NULL) AS filename FROM e GROUP BY archive""")
def archive_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as members of their customer's archive, under small limits."""
    k = F.col("o_orderkey")
    name = F.when(k % 997 == 0, "/etc/x").when(k % 991 == 0, "a/../b").otherwise(F.concat(F.lit("src/f"), k.cast("string")))
    members = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("archive"), k.alias("ord"), name.alias("filename"), F.round(F.col("o_totalprice") * 10).cast("long").alias("size"),
        F.when(k % 499 == 0, F.lit(0o120000 << 16).cast("long")).otherwise(0).alias("attr"),
    )
    return acquire.first_violations(members, acquire.Limits(files=12, file_bytes=4_000_000, total_bytes=20_000_000))


@query(
    "WITH " + _SPLIT + """, c AS (SELECT event_id, event_id % (SELECT count(*) * 2 FROM documents) AS doc_id, event_id % 9 - 1 AS s, event_id % 9 - 1 + event_id % 5 - 1 AS t FROM events),
g AS (SELECT event_id, ls, s, t, coalesce(s >= 1 AND s <= t AND t <= len(ls), false) AS grounded FROM c LEFT JOIN l USING (doc_id))
SELECT event_id, grounded, CASE WHEN grounded THEN sha256(array_to_string(ls[s:t], chr(10))) END AS evidence_sha256 FROM g"""
)
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate spans against the real lines of documents, spelled in a roundabout way; half of the candidates name none."""
    from sievelake.operators.assess import ground

    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    k = F.col("event_id")
    candidates = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("/srv/app/./x/../"), (k % (2 * n)).cast("string")).alias("file"), (k % 9 - 1).cast("int").alias("line_start"), (k % 9 - 1 + k % 5 - 1).cast("int").alias("line_end")
    )
    files = docs.select(F.col("doc_id").cast("string").alias("path"), S.split_lines(F.col("text")).alias("lines"))
    return ground(candidates, files, "/srv/app").select("event_id", "grounded", F.sha2("evidence", 256).alias("evidence_sha256"))


_FLAG = "(length(text) - length(replace(replace(text, '*', ''), '#', ''))) * 100 > length(text)"


@query(f"""
WITH j AS (SELECT lang, quality = 0 AS v, {_FLAG} AS f FROM labels JOIN documents USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (WHERE v AND f) AS tp, count(*) FILTER (WHERE NOT v AND f) AS fp, count(*) FILTER (WHERE v AND NOT f) AS fn, count(*) FILTER (WHERE NOT v AND NOT f) AS tn FROM j GROUP BY lang),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM c)
SELECT lang, tp, fp, fn, tn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM p""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol-share test for bad documents against the labels, per language."""
    size = F.length("text")
    flag = (size - F.length(F.translate("text", "*#", ""))) * 100 > size
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", flag.alias("f"))
    joined = table(spark, sf_dir, "labels").join(docs, "doc_id")
    scored = evaluate.with_scores(joined.groupBy("lang").agg(*evaluate.confusion(F.col("quality") == 0, F.col("f"))))
    return scored.select("lang", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""
WITH f AS (SELECT event_id, event_type || ' ' || user_id AS title, {_SEVERITY_SQL} AS severity, least(value / 500, 1) AS c FROM events WHERE event_id % 3 > 0)
SELECT event_id, round(c, 9) AS confidence FROM f WHERE severity = 'MEDIUM' AND contains(lower(title), 'click 1')""")
def ui_filter_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of one severity and source that match a search, most confident first."""
    k = F.col("event_id")
    rows = _event_severity(spark, sf_dir).select(
        F.struct(F.lit("r").alias("rule_id"), F.concat_ws(" ", "event_type", "user_id").alias("title")).alias("identity"),
        F.struct(F.lit("f").alias("file")).alias("location"),
        F.struct("severity", F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence")).alias("classification"),
        F.when(k % 3 == 0, F.array(F.lit("static-rule"))).otherwise(F.array(F.lit("static-rule"), F.lit("ai-discovery"))).alias("analysis_source"),
        k.alias("_ord"),
    )
    shown = rollup.view(rows, "MEDIUM", "ai-discovery", "CLICK 1")
    return shown.select(F.col("_ord").alias("event_id"), F.round("classification.confidence", 9).alias("confidence"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, 'token = "[0-9a-f]{40}"')) AS secrets, count(*) FILTER (WHERE regexp_matches(line, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z]+')) AS emails,
       count(*) FILTER (WHERE regexp_matches(line, '\([0-9]{3}\) [0-9]{3}-[0-9]{4}')) AS phones FROM l GROUP BY doc_id HAVING secrets + emails + phones > 0""")
def secret_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with secrets or personal data (an extension)."""
    lines = F.split("text", "\n", -1)
    count = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern))).cast("long")
    marks = {"secrets": 'token = "[0-9a-f]{40}"', "emails": r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z]+", "phones": r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}"}
    any_mark = F.col("text").rlike("|".join(marks.values()))
    return table(spark, sf_dir, "documents").where(any_mark).select("doc_id", *[count(p).alias(n) for n, p in marks.items()])


@query("SELECT date_trunc('hour', ts) AS hour, " + _SEVERITY_SQL + " AS severity, count(*) AS n FROM events GROUP BY ALL")
def severity_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the streaming roll-up (an extension)."""
    from sievelake.streaming.severity import hourly

    return hourly(_event_severity(spark, sf_dir)).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "severity", "n")
