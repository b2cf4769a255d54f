"""Discovery, verification, correlation, evaluation, acquisition, reports and the command line."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sievelake.__main__ import main
from sievelake.operators import assess, correlate, evaluate, findings, review, rollup
from sievelake.plans.scan import scan, scan_files, scan_repository
from sievelake.sources import acquire, sinks
from sievelake.sources.files import inline_files, read_tree


@pytest.fixture
def tree(tmp_path):
    for name, text in {
        "main.py": "import os\ndef go(x):\n    os.system('ls ' + x)\n", "script.js": "eval(x)", "readme.md": "x", "venv/ignored.py": "eval(x)",
        "pkg/__init__.py": "", ".env": "A=1", ".github/w.yml": "run: a", "pkg/build/b.py": "eval(x)", "latin.py": None,
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"# \xff\neval(x)\n") if text is None else path.write_text(text)
    return tmp_path


def test_tree(spark, tree):
    rows = {r.path: r for r in read_tree(spark, str(tree)).collect()}
    assert sorted(rows) == [".env", ".github/w.yml", "latin.py", "main.py", "pkg/__init__.py"]
    assert rows["latin.py"].error and rows["latin.py"].content is None and rows[".env"].lang == "config"
    assert [r.path for r in read_tree(spark, str(tree / "main.py")).collect()] == ["main.py"]
    assert read_tree(spark, str(tree / "venv")).count() == 0
    with pytest.raises(FileNotFoundError):
        read_tree(spark, str(tree / "nothing"))


def test_command_line(spark, tree, tmp_path_factory, capsys):
    out = str(tmp_path_factory.mktemp("out") / "r.json")
    assert main(["scan", str(tree), "--format", "json", "--output", out], spark) == 1
    report = json.load(open(out))
    (f,) = report["findings"]
    assert f["context"]["function_name"] == "go" and f["context"]["snippet"] == "os.system('ls ' + x)" and f["analysis_source"] == ["static-rule"]
    assert report["project"]["file_count"] == 5 and sinks.read_report(spark, out).count() == 1
    assert main(["scan", str(tree), "--fail-on", "CRITICAL"], spark) == 0
    assert "os.system" in capsys.readouterr().out
    assert main(["scan", str(tree), "--format", "sarif"], spark) == 2
    assert main(["scan", str(tree / "no")], spark) == 2
    assert main(["scan", str(tree), "--ai", "--ai-provider", "x"], spark) == 2
    assert main(["scan", str(tree / "venv")], spark) == 0
    assert main(["scan", str(tree), "--format", "json", "--output", out, "--ai"], spark) == 1
    (f,) = json.load(open(out))["findings"]
    assert f["analysis_source"] == ["static-rule", "ai-verified"] and f["ai_assessment"]["is_likely_vulnerable"]


class Doubtful(assess.Provider):
    def generate(self, prompt, system=None):
        return {"is_likely_vulnerable": False, "confidence_adjustment": -0.5, "false_positive_reason": "fine"} if "eval" in prompt else {}


def test_verify_band(spark):
    files = inline_files(spark, {"a.py": "random.random()\nx\ny\nz\neval(q)\n"})
    low = findings.findings(files).withColumn("classification", F.when(F.col("identity.rule_id").contains("random"), F.col("classification").withField("confidence", F.lit(0.99))).otherwise(F.col("classification")))
    got = {r.identity.rule_id: r for r in assess.verify(low, Doubtful()).withColumn("e", sinks.effective()).collect()}
    assert got["python.eval_exec"].e <= 0.2 and got["python.eval_exec"].analysis_source == ["static-rule", "ai-verified"]
    assert got["python.crypto.insecure_random"].ai_assessment is None and got["python.crypto.insecure_random"].e == 0.99
    band = spark.createDataFrame([(0.4,), (0.95,), (0.39,), (0.96,)], "c double").select(F.struct(F.col("c").alias("confidence")).alias("classification"), findings.no_assessment().alias("ai_assessment"))
    assert [r[0] for r in band.select(assess.in_band()).collect()] == [True, True, False, False]


class Inventive(assess.Provider):
    def generate(self, prompt, system=None):
        return {}

    def generate_structured(self, prompt, schema, system=None):
        if "File: b.py" in prompt:
            raise OSError("gone")
        v = lambda f, s, e, c=0.9: {"title": f"{f}{s}", "category": "SQL", "file": f, "line_start": s, "line_end": e, "confidence": c}
        return {"vulnerabilities": [v("a.py", 1, 2), v("../a.py", 1, 1), v("a.py", 0, 1), v("a.py", 2, 9), v("./a.py", 2, 2), v("a.py", 1, 1, 7.0), v("a.py", 1, 1)]}


def test_discovery_grounding(spark):
    session = scan_files(spark, inline_files(spark, {"a.py": "x\ny\n", "b.py": "z\n"}), ai=True, mode="discover", provider=Inventive())
    rows = session.findings.orderBy("_ord").collect()
    assert [(r.location.line_start, r.context.snippet, r.identity.rule_id, r.classification.severity) for r in rows] == [(1, "x\ny", "ai-sql", "MEDIUM"), (2, "y", "ai-sql", "MEDIUM")]
    c = session.counters
    assert (c["ai_candidate_findings"], c["ai_rejected_findings"], c["provider_errors"], c["ai_findings_count"]) == (6, 3, 2, 2)


def test_review_units(spark):
    big = "\n".join(f"x{i}" for i in range(101))
    long = "def f():\n" + "    x\n" * 150
    files = inline_files(spark, {"big.py": big, "hundred.py": big.rsplit("\n", 1)[0], "empty.py": "", "bad.py": "def (", "fun.py": "a\n" * 30 + "def f():\n  def g(): pass\n" + "b\n" * 30, "long.py": long, "eval.py": "eval(exec(open(x)))"})
    ordered = review.reviewable(files)
    assert ordered.first().path == "eval.py"
    units = [(r.path, r.start_line, r.end_line, r.context_type) for r in review.review_units(ordered).orderBy("path", "unit_ord").collect()]
    assert units == [("big.py", 1, 100, "chunk"), ("big.py", 101, 101, "chunk"), ("eval.py", 1, 1, "chunk"), ("fun.py", 22, 41, "function"), ("fun.py", 22, 42, "function"), ("hundred.py", 1, 100, "chunk"), ("long.py", 1, 101, "function")]


def greedy_by_hand(rows, reach=5):
    stand, marked = [(r, line) for r, line, found, _ in rows if not found], set()
    for r, line, found, _ in rows:
        if found:
            hit = next((s for s, at in stand if abs(at - line) <= reach), None)
            marked.add(hit) if hit is not None else stand.append((r, line))
    return {s for s, _ in stand}, marked


def test_greedy_correlation(spark):
    import random

    rng = random.Random(4)
    rows = [(f"f{rng.randint(0, 2)}", f"r{i}", rng.randint(1, 60), rng.randint(0, 1), i) for i in range(300)]
    df = spark.createDataFrame(rows, "file string, id string, line int, found int, ord int")
    got = {r.id: (r.keep, r.marked) for r in correlate.greedy(df, ["file"]).collect()}
    for file in ("f0", "f1", "f2"):
        mine = [r[1:] for r in rows if r[0] == file]
        stand, marked = greedy_by_hand(mine)
        assert {r[0] for r in mine if got[r[0]][0]} == stand and {r[0] for r in mine if got[r[0]][1]} == marked
    edge = correlate.absorb([("s", 10, 0), ("a", 15, 1), ("b", 16, 1), ("c", 20, 1), ("d", None, 1)], 5)
    assert edge == [("s", True, True), ("a", False, False), ("b", True, True), ("c", False, False), ("d", True, False)]


def test_paths_below_the_root(spark):
    from sievelake.functions import scalars as S

    cases = [("a/b.py", "a/b.py"), ("./a//b.py", "a/b.py"), ("a/../b.py", "b.py"), ("/srv/app/a.py", "a.py"), ("/srv/x/../app/a.py", "a.py"), ("../app/a.py", "a.py"), ("../a.py", None), ("/srv/apple/a.py", None), ("/a.py", None), ("../../../a.py", None), ("/srv/app", ""), (None, None)]
    df = spark.createDataFrame(cases, "path string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", S.below(F.col("path"), "/srv/app")).collect())
    assert [r[0] for r in df.select(S.below(F.col("path"))).collect()][:4] == ["a/b.py", "a/b.py", "b.py", "/srv/app/a.py"]


def test_hybrid_merges(spark):
    class Same(assess.Provider):
        def generate(self, prompt, system=None):
            return {}

        def generate_structured(self, prompt, schema, system=None):
            v = lambda line, c: {"title": c, "category": c, "file": "a.py", "line_start": line, "line_end": line}
            return {"vulnerabilities": [v(1, "SQL injection"), v(7, "SQL injection"), v(2, "SSRF")]}

    text = "c.execute(q)\n" + "x\n" * 9
    session = scan_files(spark, inline_files(spark, {"a.py": text}), ai=True, provider=Same())
    got = sorted((r.location.line_start, r.identity.rule_id, r.analysis_source) for r in session.findings.collect())
    assert got == [(1, "python.sql.injection", ["static-rule", "ai-discovery"]), (2, "ai-ssrf", ["ai-discovery"]), (7, "ai-sql injection", ["ai-discovery"])]
    assert all(r.identity.fingerprint for r in session.findings.collect()) and session.counters["correlated_findings"] == 1


def test_hybrid_asks_about_written_findings(spark, monkeypatch):
    """The prompts of the verification are not planned over the correlation: that plan filled a driver's memory."""
    plans, ask = [], assess.ask
    monkeypatch.setattr(assess, "ask", lambda prompts, *how: plans.append(prompts._jdf.queryExecution().analyzed().toString()) or ask(prompts, *how))
    session = scan_files(spark, inline_files(spark, {"vulnerable/a.py": "import os\nos.system(x)\n"}), "/project", ai=True, mode="hybrid")
    assert len(plans) == 2 and "Join" not in plans[1] and "Union" not in plans[1]
    assert session.findings.count() == 2


def test_evaluation(spark):
    paths = ["a/vulnerable/x.py", "a/variant/y.py", "b/safe/x.py", "b/false_positive/y.yml", "b/safe/x.txt", "c/x.py"]
    labelled = evaluate.expected(spark.createDataFrame([(p,) for p in paths], "path string"))
    hits = spark.createDataFrame([("a/vulnerable/x.py",), ("b/safe/x.py",), ("b/safe/x.py",), ("c/x.py",)], "path string")
    row = evaluate.evaluate(labelled, hits, "STATIC")
    assert tuple(row.first()) == ("STATIC", 1, 1, 1, 1, 0.5, 0.5, 0.5)
    assert "| STATIC | 1 | 1 | 1 | 1 | 0.50 | 0.50 | 0.50 |" in evaluate.summary_markdown(row)
    assert tuple(evaluate.evaluate(labelled, hits.limit(0), "NONE").first())[5:] == (0.0, 0.0, 0.0)


def test_urls(spark):
    urls = {
        "https://github.com/o/r": ("o", "r"), "https://www.github.com/o/r.git": ("o", "r"), "https://GitHub.com/o/r/tree/main": ("o", "r"), "https://github.com//o//r/": ("o", "r"),
        "http://github.com/o/r": None, "https://gitlab.com/o/r": None, "https://github.com/o": None, "https://github.com/o/r/issues": None, "https://u@github.com/o/r": None,
        "https://github.com:443/o/r": None, "not a url": None, "https://github.com/o/.git": None, f"https://github.com/{'o' * 101}/r": None, "": None,
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", acquire.validate_url(F.col("u")).alias("r"))
    for u, r in df.collect():
        assert ((r.owner, r.repo) if r.error is None else None) == urls[u], u


def test_archive_limits(spark):
    limits = acquire.Limits(files=3, file_bytes=10, total_bytes=20)
    lists = {
        "ok": [("a", 10, 0), ("b", 10, 0)], "up": [("a", 1, 0), ("../x", 1, 0)], "root": [("/etc/x", 1, 0)], "back": [("\\x", 1, 0)], "many": [(str(i), 1, 0) for i in range(4)],
        "big": [("a", 11, 0)], "sum": [("a", 10, 0), ("b", 10, 0), ("c", 1, 0)], "link": [("a", 1, 0o120777 << 16)],
    }
    rows = [(k, i, *m) for k, ms in lists.items() for i, m in enumerate(ms)]
    got = acquire.first_violations(spark.createDataFrame(rows, "archive string, ord int, filename string, size long, attr long"), limits)
    assert {r.archive: r.error for r in got.collect()} == {"ok": None, "up": "path traversal", "root": "absolute path", "back": "absolute path", "many": "too many files", "big": "file too large", "sum": "archive too large", "link": "symlink"}


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


class Reply(io.BytesIO):
    pass


def test_repository(spark, tmp_path):
    asked = []

    def opener(request, timeout):
        asked.append(request.full_url)
        return Reply(archive({"r-HEAD/main.py": "eval(x)\n"}))

    session = scan_repository(spark, "https://github.com/o/r", folder=str(tmp_path), opener=opener)
    assert session.ref == "HEAD" and asked[0].endswith("/o/r/zip/HEAD") and session.summary()["project"]["source_type"] == "github"
    assert session.findings.first().identity.rule_id == "python.eval_exec"
    with pytest.raises(acquire.AcquisitionError) as e:
        scan_repository(spark, "http://github.com/o/r")
    assert e.value.kind == "invalid_url"
    with pytest.raises(acquire.AcquisitionError) as e:
        acquire.download_archive("o", "r", "x", str(tmp_path / "z"), acquire.Limits(archive_bytes=10), opener)
    assert e.value.kind == "too_large"
    bad = tmp_path / "bad.zip"
    bad.write_bytes(archive({"../x": "1"}))
    with pytest.raises(acquire.AcquisitionError):
        acquire.safe_extract(spark, str(bad), str(tmp_path / "out"))
    assert acquire.default_branch("o", "r", lambda request, timeout: Reply(b"{}")) == "main"


def test_reports(spark, tmp_path):
    files = inline_files(spark, {"vulnerable/a.py": "eval('<b>' + x)\nrandom.random()\n", "b.py": "eval(y)\n"})
    session = scan_files(spark, files, ai=True)
    for kind, write in sinks.WRITERS.items():
        write(session, str(tmp_path / kind))
    sarif = json.load(open(tmp_path / "sarif"))
    run = sarif["runs"][0]
    assert sarif["version"] == "2.1.0" and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["python.eval_exec", "python.crypto.insecure_random"]
    first = run["results"][0]
    assert first["level"] == "error" and first["message"]["text"].startswith("[90% confidence] ") and "AI Analysis: " in first["message"]["text"]
    assert first["locations"][0]["physicalLocation"]["region"]["startLine"] == 1
    page = (tmp_path / "html").read_text()
    assert "&lt;b&gt;" in page and "<b>' + x" not in page and "INFO" not in page
    assert any("[HIGH]" in line for line in sinks.text_report(session))
    sinks.write_tables(session, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/findings")).count() == 3


def test_views_and_gates(spark):
    session = scan_files(spark, inline_files(spark, {"a.py": "eval(x)\nrandom.random()\npickle.loads(x)\n"}))
    f = session.findings
    assert [r.identity.rule_id for r in rollup.view(f).collect()] == ["python.deserialization.unsafe", "python.eval_exec", "python.crypto.insecure_random"]
    assert rollup.view(f, search="EVAL_").count() == 1 and rollup.view(f, severity="LOW").count() == 1 and rollup.view(f, source="ai-").count() == 0
    hist = {r.severity: r.n for r in rollup.severity_histogram(f.select("classification.severity")).collect()}
    assert hist == {"CRITICAL": 1, "HIGH": 1, "MEDIUM": 0, "LOW": 1, "INFO": 0}
    assert session.fails("CRITICAL") and not f.where("classification.severity = 'LOW'").agg(rollup.fails(F.col("classification.severity"), "HIGH")).first()[0]
    none = f.limit(0)
    assert not none.agg(rollup.fails(F.col("classification.severity"), "INFO")).first()[0]
    assert {r.share for r in rollup.severity_share(none.select("classification.severity")).collect()} == {0.0}
    assert scan(spark, __file__).project()["file_count"] == 1


def test_stream(spark, tmp_path):
    from sievelake.streaming.severity import bursts, first_reports, hourly

    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 7) AS ts, id % 2 AS user_id, 'LOW' AS severity, cast(id % 3 AS string) AS fingerprint FROM range(20)")
    rows.write.parquet(str(tmp_path / "in"))
    for i, (make, mode) in enumerate(((lambda s: hourly(s, "1 hour"), "complete"), (first_reports, "append"), (bursts, "append"))):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.outputMode(mode).format("memory").queryName(f"q{i}").option("checkpointLocation", str(tmp_path / f"c{i}")).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("q0").agg(F.sum("n")).first()[0] == 20 and spark.table("q1").count() == 3


def test_labelled_tree(spark, tmp_path):
    """Our own files of the labelled kinds; the published matrix of each mode comes out."""
    from sievelake.plans.evaluation import evaluate_tree, write_evaluation

    step = "jobs:\n  b:\n    steps:\n      - {}\n"
    texts = {
        "cmd/vulnerable/a.py": "import os\ndef f(x):\n    os.system('cat ' + x)\n", "cmd/variant/a.py": "import subprocess\nsubprocess.Popen(cmd, shell=True)\n",
        "cmd/safe/a.py": "import subprocess\nsubprocess.run(['ls', x])\n", "cmd/false_positive/a.py": "import os\nos.system('ls')\n",
        "ssrf/vulnerable/a.py": "import requests\nrequests.get(url)\n", "ssrf/variant/a.py": "import httpx\nhttpx.post(url, data=d)\n",
        "ssrf/safe/a.py": "import requests\nif url in ALLOWED:\n    requests.get(url)\n", "ssrf/false_positive/a.py": "import requests\nURL = 'https://a'\nrequests.get(URL)\n",
        "ci/vulnerable/a.yml": step.format("run: echo ${{ github.event.comment.body }}"), "ci/variant/a.yml": step.format("run: |\n          echo ${{ github.event.comment.body }}"),
        "ci/safe/a.yml": step.format("run: echo $BODY"), "ci/false_positive/a.yml": step.format("name: ${{ github.event.comment.body }}"), "other/a.py": "eval(x)\n",
    }
    for name, text in texts.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    results = evaluate_tree(spark, str(tmp_path / "tree"))
    got = {r["mode"]: tuple(r)[1:5] for r in results.collect()}
    assert got == {"STATIC": (5, 2, 1, 4), "AI_DISCOVERY": (4, 0, 2, 6), "HYBRID": (5, 2, 1, 4)}
    write_evaluation(results, str(tmp_path))
    scores = json.loads((tmp_path / "results.json").read_text())["STATIC"]
    assert [round(scores[k], 6) for k in ("precision", "recall", "f1")] == [0.714286, 0.833333, 0.769231]
