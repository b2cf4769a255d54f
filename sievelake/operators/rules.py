"""The rule library: every Python rule is a predicate over the ``calls`` relation.

A rule gives, for a call row, the confidences of the findings it makes there (usually none or one), so all
rules are one projection and one explode: ``calls`` is read once and never joined with the rules.

By default rules match as the published ones do, gaps included; with ``strict=False`` names are
resolved through imports and dotted forms of a few calls match as well.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Hits = Callable[["Call"], Column]


class Call:
    """Columns of a call row under the names that predicates use."""

    def __init__(self, strict: bool = True) -> None:
        self.strict = strict
        self.fq = F.col("fq") if strict else F.coalesce("fq_resolved", "fq")
        self.attr, self.base, self.base_attr = F.col("attr"), F.col("base"), F.col("base_attr")
        self.is_name, self.is_attr = F.col("func_type") == "Name", F.col("func_type") == "Attribute"
        self.a0 = F.col("a0_type")
        self.open_arg = self.a0.isNotNull() & (self.a0 != "Constant")

    @staticmethod
    def named(name: str):
        return lambda k: k["name"] == name

    def flag(self, name: str, value: str) -> Column:
        """A keyword with this literal."""
        return F.exists("kwargs", lambda k: (k["name"] == name) & F.coalesce(k.value == value, F.lit(False)))

    def is_called(self, *names: str) -> Column:
        hit = self.fq.isin(*names)
        return hit if self.strict else hit | F.substring_index(self.fq, ".", -1).isin(*names)


def once(hit: Column, confidence: float) -> Column:
    return F.when(hit, F.array(F.lit(confidence)))


def per_keyword(confidence: float, count: Callable[[Column], Column]) -> Column:
    """As many findings as ``count`` gives for each keyword, keywords in order."""
    n = F.aggregate("kwargs", F.lit(0), lambda a, k: a + F.coalesce(count(k), F.lit(0)))
    return F.when(n > 0, F.array_repeat(F.lit(confidence), n))


def _count(items: Column, hit: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(F.coalesce(items, F.array().cast("array<string>")), hit))


def _command(c: Call) -> Column:
    shell = c.fq.startswith("subprocess.") & c.flag("shell", "True") & c.a0.isNotNull() & ~c.a0.isin("Constant", "List", "Tuple")
    return F.when(c.fq.isin("os.system", "os.popen") & c.open_arg, F.array(F.lit(0.7))).when(shell, F.array(F.lit(0.85)))


def _cors(c: Call) -> Column:
    def count(k: Column) -> Column:
        stars = F.when(k.type == "List", _count(k.elts, lambda x: x == "*")).when(k.value == "'*'", 1)
        return F.when(k["name"].isin("allow_origins", "origins"), stars)

    return F.when(c.is_called("CORS", "add_middleware"), per_keyword(0.8, count))


def _jwt(c: Call) -> Column:
    def count(k: Column) -> Column:
        return F.when((k["name"] == "verify_signature") & (k.value == "False"), 1).when(
            (k["name"] == "algorithms") & (k.type == "List"), _count(k.elts, lambda x: F.lower(x) == "none")
        )

    return F.when(c.is_called("decode"), per_keyword(0.8, count))


def _tls(c: Call) -> Column:
    n = F.aggregate("kwargs", F.lit(0), lambda a, k: a + F.coalesce(((k["name"] == "verify") & (k.value == "False")).cast("int"), F.lit(0)))
    n = n + F.coalesce((c.attr == "_create_unverified_context").cast("int"), F.lit(0))
    return F.when(n > 0, F.array_repeat(F.lit(0.8), n))


def _sql(c: Call) -> Column:
    trace = F.col("trace")
    base = F.lit(0.65)
    shift = (
        F.when(F.col("a0_dynamic"), base + 0.1)
        .when((c.a0 == "Name") & trace.isNull(), base - 0.2)
        .when((c.a0 == "Name") & trace.is_constant, base - 0.5)
        .when((c.a0 == "Name") & trace.is_sanitized, base - 0.4)
        .when(c.a0 == "Name", base + 0.2)
    )
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), shift))  # both pass over nulls, so what has no shift is told apart
    return F.when(c.is_attr & (c.attr == "execute") & shift.isNotNull(), F.array(value))


def _deserialize(c: Call) -> Column:
    safe = F.exists("kwargs", lambda k: (k["name"] == "Loader") & (k.type == "Attribute") & (k.attr == "SafeLoader"))
    if not c.strict:
        safe = safe | F.exists("kwargs", lambda k: (k["name"] == "Loader") & (k.type == "Name"))
    return once((c.base.isin("pickle", "cPickle", "marshal") & c.attr.isin("load", "loads")) | ((c.base == "yaml") & (c.attr == "load") & ~safe), 0.85)


def _hash(c: Call) -> Column:
    hit = (c.base == "hashlib") & c.attr.isin("md5", "sha1")
    return once(hit if c.strict else hit | c.fq.isin("hashlib.md5", "hashlib.sha1"), 0.9)


@dataclass(frozen=True)
class Rule:
    """Identity and wording of a rule; ``hits`` gives the confidences of its findings at a call (None: not a call rule)."""

    id: str
    title: str
    severity: str
    confidence: float
    explanation: str
    fix: str
    language: str = "python"
    hits: Hits | None = None


def _weak_cipher(c: Call) -> Column:
    weak = ("DES", "ARC4", "ARC2", "Blowfish", "DES3")
    return once((c.attr == "new") & (c.base.isin(*weak) | c.base_attr.isin(*weak)), 0.95)


#: In the order in which findings of one call are reported.
CALL_RULES = (
    Rule("python.archive_traversal", "Archive unpacked without checking member paths", "HIGH", 0.8, "Members of an archive can name paths outside the target folder.", "Check each member's resolved path before extracting it.", hits=lambda c: once(c.is_attr & (c.attr == "extractall"), 0.8)),
    Rule("python.command.injection", "Command line built from data", "HIGH", 0.7, "A shell runs text that is not a literal.", "Pass a list of arguments and leave the shell out.", hits=_command),
    Rule("python.cors_wildcard", "Any origin allowed", "HIGH", 0.8, "Cross-origin requests are accepted from everywhere.", "List the origins that need access.", hits=_cors),
    Rule("python.debug_mode", "Debug mode switched on", "HIGH", 0.8, "A debugging server shows internals and may run code.", "Take the flag from the environment and default to off.", hits=lambda c: once(c.attr.endswith("run") & c.flag("debug", "True"), 0.8)),
    Rule("python.eval_exec", "Code made from data", "HIGH", 0.8, "Text that is not a literal is run as code.", "Parse the data instead, or look names up in a table.", hits=lambda c: once(c.is_name & c.fq.isin("eval", "exec", "compile", "__import__") & c.open_arg, 0.8)),
    Rule("python.file_permissions", "File open to everyone", "HIGH", 0.8, "Mode 777 lets every user write the file.", "Grant the least mode that works.", hits=lambda c: once(c.fq.endswith("chmod") & (F.col("n_args") >= 2) & F.col("a1_const").isin("511", "511.0"), 0.8)),
    Rule("python.crypto.insecure_hash", "Broken hash function", "MEDIUM", 0.9, "MD5 and SHA-1 no longer resist collisions.", "Use SHA-256 or better.", hits=_hash),
    Rule("python.crypto.insecure_random", "Predictable random numbers", "LOW", 0.5, "The random module can be predicted from its output.", "Use the secrets module where secrecy matters.", hits=lambda c: once(c.base == "random", 0.5)),
    Rule("python.jwt_insecure", "Token accepted without verification", "HIGH", 0.8, "The signature of a token is not checked.", "Verify signatures and name the algorithms allowed.", hits=_jwt),
    Rule("python.password_storage", "Password hashed by a fast function", "HIGH", 0.8, "Fast hashes can be searched by brute force.", "Use a password hash such as scrypt or argon2.", hits=lambda c: once(c.fq.endswith("md5") | c.fq.endswith("sha1"), 0.8)),
    Rule("python.path.traversal", "File path built from data", "HIGH", 0.6, "A path put together from data can leave its folder.", "Resolve the path and check that it stays inside.", hits=lambda c: once(c.is_name & (c.fq == "open") & F.col("a0_dynamic"), 0.6)),
    Rule("python.sql.injection", "Query text built from data", "HIGH", 0.65, "A statement that is put together from values can be changed by them.", "Use placeholders and pass the values apart.", hits=_sql),
    Rule("python.ssrf", "Request to an address from data", "HIGH", 0.8, "Whoever chooses the address can reach inner services.", "Allow known hosts only.", hits=lambda c: once(c.fq.isin("requests.get", "requests.post", "httpx.get", "httpx.post", "urlopen", "urllib.request.urlopen") & c.open_arg, 0.8)),
    Rule("python.ssti", "Template text from data", "HIGH", 0.8, "Template syntax inside the data is evaluated.", "Keep templates fixed and pass data as variables.", hits=lambda c: once(c.fq.isin("render_template_string", "Template") & c.open_arg, 0.8)),
    Rule("python.temp_files", "Temporary name that can be taken", "HIGH", 0.8, "Between naming and opening another process can create the file.", "Use functions that open the file as they name it.", hits=lambda c: once(c.fq.endswith("mktemp"), 0.8)),
    Rule("python.tls_verify", "Certificates not checked", "HIGH", 0.8, "Anyone between the two ends can pose as the server.", "Leave verification on and add the issuer if need be.", hits=_tls),
    Rule("python.deserialization.unsafe", "Objects loaded from untrusted bytes", "CRITICAL", 0.85, "Loading such data can run code.", "Use a data-only format or a safe loader.", hits=_deserialize),
    Rule("python.unsafe_redirect", "Redirect to an address from data", "HIGH", 0.8, "Users can be sent to a foreign site.", "Redirect to known paths only.", hits=lambda c: once((c.fq.endswith("redirect") | c.fq.endswith("HttpResponseRedirect")) & c.open_arg, 0.8)),
    Rule("python.crypto.weak_cipher", "Weak cipher", "HIGH", 0.95, "The cipher's keys or blocks are too short today.", "Use AES in an authenticated mode.", hits=_weak_cipher),
    Rule("python.xss", "Markup marked as safe from data", "HIGH", 0.8, "Data marked as safe is not escaped.", "Let the template engine escape it.", hits=lambda c: once(c.fq.isin("markupsafe.Markup", "Markup") & c.open_arg, 0.8)),
    Rule("python.xxe", "XML parsed with entities on", "HIGH", 0.8, "External entities can read files and reach hosts.", "Use a parser that refuses them.", hits=lambda c: once(c.is_called("parse", "parseString", "fromstring"), 0.8)),
)

FILE_RULES = (
    Rule("config.docker_root", "Container runs as root", "MEDIUM", 0.8, "No USER line, so processes run as root.", "Add a USER line with an unprivileged user.", "config"),
    Rule("ci.gh_actions_untrusted_data", "Event text inside a run step", "HIGH", 0.85, "Text of a pull request or comment becomes part of a command.", "Pass it through an environment variable.", "config"),
    Rule("config.package_json", "Open version range", "LOW", 0.8, "Any later version will be installed.", "Give a bounded range.", "config"),
    Rule("dep.unpinned", "Requirement without version", "MEDIUM", 0.9, "Builds change with each release of the dependency.", "Pin a version or a range.", "config"),
)
RULES = {r.id: r for r in (*CALL_RULES, *FILE_RULES)}


def category(rule_id: str) -> str:
    return "dependencies" if rule_id == "dep.unpinned" else rule_id.split(".")[1]


def rules_table(spark: SparkSession) -> DataFrame:
    """(rule_id, title, category, severity, confidence, explanation, fix, language): a row per rule."""
    rows = [(r.id, r.title, category(r.id), r.severity, r.confidence, r.explanation, r.fix, r.language) for r in RULES.values()]
    return spark.createDataFrame(rows, "rule_id string, title string, category string, severity string, confidence double, explanation string, fix string, language string")


def fire(calls: DataFrame, rules: tuple[Rule, ...] = CALL_RULES, strict: bool = True) -> DataFrame:
    """``calls`` with a row per finding: rule_id, confidence and its place ``rule_ord`` among the call's findings."""
    call = Call(strict)
    def hits(rule: Rule) -> Column:
        found = F.coalesce(rule.hits(call), F.array().cast("array<double>"))
        return F.transform(found, lambda x: F.struct(F.lit(rule.id).alias("rule_id"), x.alias("confidence")))

    each = [hits(rule) for rule in rules]
    return calls.select("*", F.posexplode(F.flatten(F.array(*each))).alias("rule_ord", "_hit")).select("*", "_hit.rule_id", "_hit.confidence").drop("_hit")
