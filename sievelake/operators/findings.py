"""From files to findings.

``files`` has (path, name, lang, content, is_fixture).  Python files become call rows and those findings;
config files are tested line by line inside their row.  The lines around a finding travel with
it, so nothing is shuffled or joined back to file contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions import scalars as S
from sievelake.functions.flatten import PythonCalls

from .rules import CALL_RULES, RULES, Rule, category, fire

#: Comments that silence a finding; a caller adds those of other tools.
SUPPRESS = ("# nosec", "# sievelake:ignore")
EVENT_TEXT = r"\$\{\{\s*github\.event\.(pull_request\.title|pull_request\.body|comment\.body)\s*\}\}"

FINDING_SCHEMA = (
    "identity STRUCT<id:STRING,rule_id:STRING,title:STRING,fingerprint:STRING>,"
    "location STRUCT<file:STRING,line_start:INT,line_end:INT>,"
    "classification STRUCT<category:STRING,severity:STRING,confidence:DOUBLE>,"
    "context STRUCT<function_name:STRING,class_name:STRING,snippet:STRING,surrounding_code:STRING,is_test_fixture:BOOLEAN>,"
    "data_flow STRUCT<sources:ARRAY<STRING>,sinks:ARRAY<STRING>,sanitizers:ARRAY<STRING>,propagation_path:ARRAY<STRING>>,"
    "remediation STRUCT<explanation:STRING,recommended_fix:STRING>,"
    "ai_assessment STRUCT<is_likely_vulnerable:BOOLEAN,confidence_adjustment:DOUBLE,explanation:STRING,false_positive_reason:STRING>,"
    "analysis_source ARRAY<STRING>,_ord BIGINT"
)


def _none() -> Column:
    return F.array().cast("array<string>")


def no_flow() -> Column:
    return F.struct(_none().alias("sources"), _none().alias("sinks"), _none().alias("sanitizers"), _none().alias("propagation_path"))


def no_assessment() -> Column:
    return F.lit(None).cast("struct<is_likely_vulnerable:boolean,confidence_adjustment:double,explanation:string,false_positive_reason:string>")


def _by_rule(rule_id: Column, what, rules: tuple[Rule, ...] = ()) -> Column:
    """A fixed text of each rule, without a join."""
    known = RULES | {r.id: r for r in rules}
    return F.try_element_at(F.create_map(*[F.lit(x) for r in known.values() for x in (r.id, what(r))]), rule_id)


def finding_columns(rule_id: Column, file: Column, start: Column, end: Column, confidence: Column, context: Column, flow: Column, order: Column, rules: tuple[Rule, ...] = ()) -> list[Column]:
    """The columns of a finding row; texts come from its rule."""
    text = lambda what: _by_rule(rule_id, what, rules)
    return [
        F.struct(F.concat_ws("-", rule_id, start.cast("string")).alias("id"), rule_id.alias("rule_id"), text(lambda r: r.title).alias("title"), F.lit(None).cast("string").alias("fingerprint")).alias("identity"),
        F.struct(file.alias("file"), start.cast("int").alias("line_start"), end.cast("int").alias("line_end")).alias("location"),
        F.struct(text(lambda r: category(r.id)).alias("category"), text(lambda r: r.severity).alias("severity"), confidence.cast("double").alias("confidence")).alias("classification"),
        context.alias("context"),
        flow.alias("data_flow"),
        F.struct(text(lambda r: r.explanation).alias("explanation"), text(lambda r: r.fix).alias("recommended_fix")).alias("remediation"),
        no_assessment().alias("ai_assessment"),
        F.array(F.lit("static-rule")).alias("analysis_source"),
        order.cast("bigint").alias("_ord"),
    ]


def context_of(function: Column, owner: Column, snippet: Column, around: Column, fixture: Column) -> Column:
    return F.struct(function.alias("function_name"), owner.alias("class_name"), snippet.alias("snippet"), around.alias("surrounding_code"), fixture.alias("is_test_fixture"))


def calls(files: DataFrame) -> DataFrame:
    """Call rows of the Python files: path, is_fixture and the columns of the table function; files that do not
    parse give a row with ``error``."""
    python = files.where("lang = 'python'").select("path", "is_fixture", "content")
    return python.lateralJoin(PythonCalls(F.col("content").outer())).drop("content")


def suppressed(snippet: Column, around: Column, tokens: tuple[str, ...] = SUPPRESS) -> Column:
    """A comment on the line or up to two lines away says so."""
    text = F.lower(F.concat(F.coalesce(snippet, F.lit("")), F.coalesce(around, F.lit(""))))
    out = F.lit(False)
    for t in tokens:
        out = out | text.contains(t)
    return out


def call_findings(call_rows: DataFrame, strict: bool = True, tokens: tuple[str, ...] = SUPPRESS, rules: tuple[Rule, ...] = CALL_RULES) -> DataFrame:
    hits = fire(call_rows.where("error is null"), rules, strict).withColumn("snippet", S.strip(F.col("line")))
    hits = hits.where(~suppressed(F.col("snippet"), F.col("around"), tokens))
    sql = F.col("rule_id") == "python.sql.injection"
    named = sql & ~F.col("a0_dynamic") & F.col("trace").isNotNull()
    pick = lambda hit, value: F.when(hit, value).otherwise(_none())
    flow = F.struct(
        F.when(sql & F.col("a0_dynamic"), F.array(F.lit("inline_formatting"))).when(named & F.col("trace.is_constant"), F.array(F.lit("constant"))).when(named, F.col("trace.deps")).otherwise(_none()).alias("sources"),
        pick(sql, F.array(F.lit("execute"))).alias("sinks"),
        pick(named & ~F.col("trace.is_constant") & F.col("trace.is_sanitized"), F.array(F.lit("sanitized"))).alias("sanitizers"),
        pick(named, F.col("trace.path")).alias("propagation_path"),
    )
    context = context_of(F.col("function_name"), F.col("class_name"), F.col("snippet"), F.col("around"), F.col("is_fixture"))
    # Calls in their order, and at most 1024 findings a call.
    order = F.shiftleft(F.col("ord").cast("bigint"), 10) + F.col("rule_ord")
    return hits.select(*finding_columns(F.col("rule_id"), F.col("path"), F.col("line_start"), F.col("line_end"), F.col("confidence"), context, flow, order, rules))


def file_lines(files: DataFrame) -> DataFrame:
    """(path, name, is_fixture, line_no, line, around): lines counted from 1 with two lines on either side."""
    lines = files.select("path", "name", "is_fixture", F.explode(F.array(S.split_lines(F.col("content")))).alias("lines"))
    each = F.transform("lines", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"), S.around(F.col("lines"), i + 1).alias("around")))
    return lines.select("path", "name", "is_fixture", F.inline(each))


def config_findings(files: DataFrame) -> DataFrame:
    """Findings of config files and requirements; suppression comments do not apply to them."""
    config = files.where("lang = 'config'")
    name = F.col("name")
    # Only files that a line rule reads are cut into lines.
    yaml, package, wants = F.col("path").rlike(r"\.ya?ml$"), F.col("path").endswith("package.json"), name == "requirements.txt"
    lines = file_lines(config.where(yaml | package | wants))
    bare = S.strip(F.col("line"))
    rule = (
        F.when(yaml & F.col("line").contains("run:") & F.col("line").rlike(EVENT_TEXT), "ci.gh_actions_untrusted_data")
        .when(package & (F.col("line").contains('": "*"') | F.col("line").contains('": ">')), "config.package_json")
        .when(wants & (bare != "") & ~bare.startswith("#") & ~bare.rlike("[=<>~!]"), "dep.unpinned")
    )
    none = F.lit(None).cast("string")
    dep = F.col("rule_id") == "dep.unpinned"
    context = context_of(none, none, bare, F.when(~dep, F.col("around")), F.when(dep, False).otherwise(F.col("is_fixture")))
    hits = lines.withColumn("rule_id", rule).where("rule_id is not null")
    # A finding of a requirement stands behind those of its file's lines, as its check runs last.
    by_line = hits.select(*finding_columns(F.col("rule_id"), F.col("path"), F.col("line_no"), F.col("line_no"), _by_rule(F.col("rule_id"), lambda r: r.confidence), context, no_flow(), F.shiftleft(F.col("line_no").cast("bigint"), 10)))
    docker = config.where(F.col("path").endswith("Dockerfile")).select("path", "is_fixture", F.explode(F.array(S.split_lines(F.col("content")))).alias("lines"))
    docker = docker.where(~F.exists("lines", lambda x: F.startswith(S.strip(x), F.lit("USER "))))
    one = F.lit(1)
    context = context_of(none, none, S.strip(S.get_line(F.col("lines"), one)), S.around(F.col("lines"), one), F.col("is_fixture"))
    root = docker.select(*finding_columns(F.lit("config.docker_root"), F.col("path"), one, one, F.lit(0.8), context, no_flow(), F.lit(0)))
    return by_line.unionByName(root)


def findings(files: DataFrame, strict: bool = True, tokens: tuple[str, ...] = SUPPRESS, rules: tuple[Rule, ...] = CALL_RULES, config: DataFrame | None = None) -> DataFrame:
    """All findings of ``files``; report order is (location.file, _ord).  With ``config``, its files are the config
    files and those of ``files`` Python, so that neither is read for the other.  ``rules`` may hold more call rules than ours:
    a rule is its wording and a function from call columns to confidences."""
    return call_findings(calls(files), strict, tokens, rules).unionByName(config_findings(files if config is None else config))
