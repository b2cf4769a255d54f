"""Rules, taint, suppression and config findings on small sources of our own."""

import pytest
from pyspark.sql import functions as F

from sievelake.functions import scalars as S
from sievelake.operators import findings
from sievelake.operators.rules import CALL_RULES, RULES
from sievelake.sources.files import inline_files

#: (source line, rule ids it gives); {} stands where each case is put.
CASES = [
    ("z.extractall(d)", ["python.archive_traversal"]),
    ("extractall(d)", []),
    ("os.system(x)", ["python.command.injection"]),
    ("os.system('ls')", []),
    ("subprocess.run(x, shell=True)", ["python.command.injection"]),
    ("subprocess.run(x, shell='True')", []),
    ("subprocess.run(['a'], shell=True)", []),
    ("sp.run(x, shell=True)", []),
    ("CORS(app, origins=['*', 'a', '*'])", ["python.cors_wildcard"] * 2),
    ("CORS(app, origins='*')", ["python.cors_wildcard"]),
    ("app.add_middleware(M, allow_origins=['*'])", []),
    ("app.run(debug=True)", ["python.debug_mode"]),
    ("app.run(debug=1)", []),
    ("run(debug=True)", []),
    ("eval(x)", ["python.eval_exec"]),
    ("eval('1')", []),
    ("b.eval(x)", []),
    ("os.chmod(p, 0o777)", ["python.file_permissions"]),
    ("os.chmod(p, 0o755)", []),
    ("hashlib.md5(x)", ["python.crypto.insecure_hash", "python.password_storage"]),
    ("hashlib.new('md5')", []),
    ("random.random()", ["python.crypto.insecure_random"]),
    ("decode(t, verify_signature=False, algorithms=['none', 'HS256'])", ["python.jwt_insecure"] * 2),
    ("jwt.decode(t, verify_signature=False)", []),
    ("f().decode(algorithms=['NONE'])", ["python.jwt_insecure"]),
    ("open('a' + x)", ["python.path.traversal"]),
    ("open(x)", []),
    ("c.execute(f'{x}')", ["python.sql.injection"]),
    ("c.execute('select 1')", []),
    ("requests.get(u)", ["python.ssrf"]),
    ("requests.get('http://a')", []),
    ("render_template_string(x)", ["python.ssti"]),
    ("tempfile.mktemp()", ["python.temp_files"]),
    ("s.get('http://a', verify=False)", ["python.tls_verify"]),
    ("ssl._create_unverified_context(verify=False)", ["python.tls_verify"] * 2),
    ("pickle.loads(x)", ["python.deserialization.unsafe"]),
    ("yaml.load(x)", ["python.deserialization.unsafe"]),
    ("yaml.load(x, Loader=yaml.SafeLoader)", []),
    ("yaml.load(x, Loader=SafeLoader)", ["python.deserialization.unsafe"]),
    ("flask.redirect(x)", ["python.unsafe_redirect"]),
    ("Crypto.Cipher.DES.new(k)", ["python.crypto.weak_cipher"]),
    ("DES3.new(k)", ["python.crypto.weak_cipher"]),
    ("Markup(x)", ["python.xss"]),
    ("fromstring(x)", ["python.xxe"]),
    ("ET.fromstring(x)", []),
    ("print(**kw)", []),
]


def found(spark, files, **how):
    rows = findings.findings(inline_files(spark, files), **how).orderBy("location.file", "_ord", "identity.id")
    return [(r.location.file, r.location.line_start, r.identity.rule_id, round(r.classification.confidence, 6)) for r in rows.collect()]


def test_every_rule(spark):
    got = {}
    for file, _, rule, _ in found(spark, {f"c{i:03}.py": src + "\n" for i, (src, _) in enumerate(CASES)}):
        got.setdefault(file, []).append(rule)
    assert {s: got.get(f"c{i:03}.py", []) for i, (s, _) in enumerate(CASES)} == dict(CASES)
    assert {r for rules in got.values() for r in rules} == {r.id for r in CALL_RULES}
    assert len(RULES) == 25


def test_loose_rules(spark):
    files = {"a.py": "import subprocess as sp\nsp.run(x, shell=True)\njwt.decode(t, verify_signature=False)\nET.fromstring(x)\n"}
    assert found(spark, files) == []
    assert [r[2] for r in found(spark, files, strict=False)] == ["python.command.injection", "python.jwt_insecure", "python.xxe"]


def test_own_rule(spark):
    from sievelake.operators.rules import Rule, once

    mine = Rule("python.own.print", "Print left in", "INFO", 0.3, "Prints in a library.", "Use logging.", hits=lambda c: once(c.fq == "print", 0.3))
    row = findings.findings(inline_files(spark, {"a.py": "print(1)\n"}), rules=(*CALL_RULES, mine)).first()
    assert (row.identity.title, row.classification.category, row.classification.severity, row.remediation.recommended_fix) == ("Print left in", "own", "INFO", "Use logging.")


TAINT = """
def inline(c, x):
    c.execute('a' % x)
def dirty(c, x):
    q = 'a' + x
    c.execute(q)
def fixed(c):
    q = 'a'
    c.execute(q)
def cleaned(c, x):
    y = escape(x)
    q = 'a' + y
    c.execute(q)
def hops(c, x):
    a = x
    b = a
    d = b
    c.execute(d)
def unknown(c):
    c.execute(elsewhere)
def param(c, x):
    c.execute(x)
async def shares(c):
    c.execute(top)
top = f'{1}'
def after(c):
    def inner():
        c.execute(q)
    q = 'a'
    q = c.execute(q)
class K:
    def m(self, c):
        c.execute(self.q + 'x')
"""


def test_taint(spark):
    rows = findings.findings(inline_files(spark, {"t.py": TAINT})).orderBy("_ord").collect()
    got = [(r.context.function_name, round(r.classification.confidence, 6), r.data_flow.sources, r.data_flow.sanitizers, r.data_flow.propagation_path) for r in rows]
    assert got == [
        ("inline", 0.75, ["inline_formatting"], [], []),
        ("dirty", 0.85, ["x"], [], ["q", "x"]),
        ("fixed", 0.15, ["constant"], [], ["q"]),
        ("cleaned", 0.25, ["x", "y"], ["sanitized"], ["q", "x", "y"]),
        ("hops", 0.85, ["a", "b", "x"], [], ["d", "a", "b", "x"]),
        ("unknown", 0.45, [], [], []),
        ("param", 0.85, [], [], ["x"]),
        (None, 0.45, [], [], []),
        ("inner", 0.45, [], [], []),
        ("after", 0.15, ["constant"], [], ["q"]),
        ("m", 0.75, ["inline_formatting"], [], []),
    ]
    assert rows[-1].context.class_name == "K" and all(r.data_flow.sinks == ["execute"] for r in rows)


@pytest.mark.parametrize("offset,kept", [(-3, True), (-2, False), (0, False), (2, False), (3, True)])
def test_suppression_window(spark, offset, kept):
    lines = ["pass"] * 9
    lines[4] = "eval(x)"
    lines[4 + offset] += "  # NOSEC"
    assert bool(found(spark, {"a.py": "\n".join(lines)})) is kept


def test_config(spark):
    files = {
        "Dockerfile": "FROM a\nRUN b # nosec\n",
        "b/Dockerfile": "FROM a\n  USER app\n",
        ".github/w.yml": "run: echo ${{ github.event.comment.body }} # nosec\n  run: |\n  ${{ github.event.comment.body }}\nrun: ${{github.event.pull_request.title}} ${{ github.event.pull_request.body }}",
        "package.json": '{"a": "*",\n"b": ">1",\n"c": "1"}',
        "requirements.txt": "pkg\n\npkg==1\n# c\n -r x.txt \nq~=2",
        "x/requirements.txt": "",
        "dev-requirements.txt": "pkg\n",
        "bad.py": "def (",
    }
    assert found(spark, files) == [
        (".github/w.yml", 1, "ci.gh_actions_untrusted_data", 0.85),
        (".github/w.yml", 4, "ci.gh_actions_untrusted_data", 0.85),
        ("Dockerfile", 1, "config.docker_root", 0.8),
        ("package.json", 1, "config.package_json", 0.8),
        ("package.json", 2, "config.package_json", 0.8),
        ("requirements.txt", 1, "dep.unpinned", 0.9),
        ("requirements.txt", 5, "dep.unpinned", 0.9),
    ]


def test_sql_table_functions(spark):
    from sievelake.functions import flatten

    flatten.register(spark)
    rows = spark.sql("SELECT fq, function_name FROM python_calls('def f():\n  a.b(c())\n')").collect()
    assert [tuple(r) for r in rows] == [("c", "f"), ("a.b", "f")]
    assert spark.sql("SELECT * FROM python_calls('def (')").first().error.startswith("SyntaxError")
    assert spark.sql("SELECT line_start, line_end FROM function_spans('def f():\n  def g(): pass\n')").collect() == [(1, 2), (2, 2)]


def test_split_lines_like_python(spark):
    texts = ["", "a", "a\n", "a\r\nb\rc", "\n\n", "a\x0bb\x0cc\x1cd\x85e f", "x\n\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(S.split_lines(F.col("t"))).collect()] == [t.splitlines() for t in texts]
    blanks = [" \t\x1f a b　\n", "", "\n"]
    df = spark.createDataFrame([(t,) for t in blanks], "t string")
    assert [r[0] for r in df.select(S.strip(F.col("t"))).collect()] == [t.strip() for t in blanks]


def test_scalars(spark):
    one = spark.range(1)
    get = lambda *c: tuple(one.select(*c).first())
    conf = lambda c, a, v: S.effective_confidence(F.lit(c), F.lit(a), F.lit(v))
    got = get(conf(0.6, -0.5, False), conf(0.9, 0.3, True), conf(0.9, 0.3, False), S.effective_confidence(F.lit(0.7), F.lit(None).cast("double"), F.lit(None).cast("boolean")))
    assert [round(x, 6) for x in got] == [0.1, 1.0, 0.2, 0.7]
    assert get(S.percent(F.lit(0.005)), S.percent(F.lit(0.015)), S.percent(F.lit(0.85))) == ("0%", "2%", "85%")
    family = lambda r, c: S.rule_family(F.lit(r), F.lit(c))
    assert get(family("python.sql.injection", "sql"), family("python.archive_traversal", "x"), family("python.eval_exec", "e"), family("ai-injection", "Injection")) == ("sqli", "path_traversal", "cmd_injection", "other")
    assert get(S.risk_score(F.lit(" ".join(S.RISK_POINTS))), S.risk_score(F.lit("eval eval")), S.risk_score(F.lit(None).cast("string"))) == (81, 10, 0)
    assert get(S.url_quote(F.lit("a b/ü")), S.origins(F.lit(" a, ,b ")), S.error_status(F.lit("too_large")), S.error_status(F.lit("unknown_provider"), True)) == ("a%20b/%C3%BC", ["a", "b"], 413, 500)
    span = lambda a, b, n: S.unit_span(F.lit(a), F.lit(b), F.lit(n))
    assert [tuple(x) for x in get(span(1, 3, 40), span(30, 34, 36), span(5, 300, 400), span(10, 29, 100))] == [(1, 12), (22, 36), (5, 105), (10, 29)]
    assert get(S.relative_path(F.lit("/p/a/b.py"), F.lit("/p")), S.relative_path(F.lit("/p/b.py"), F.lit("/p/b.py"))) == ("a/b.py", "b.py")
    names = {r.name: r.weight for r in S.taint_names(spark, "sink").collect()}
    assert names["execute"] == 0.8 and S.taint_names(spark, "source", "cli").count() == 3
    assert get(S.is_sanitizer(F.lit("sanitize")), S.is_sanitizer(F.lit("escape")), S.is_sink(F.lit("sp.run"), F.lit("subprocess.run"))) == (False, True, True)
