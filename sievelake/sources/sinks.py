"""Reports: JSON, SARIF 2.1.0, HTML and text.

Rows come to the driver a partition at a time and are written as they come, in report order, so a report
may be larger than the driver's memory.  ``write_tables`` is the way for results that stay data.
"""

from __future__ import annotations

import html
import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from sievelake import __version__
from sievelake.functions import scalars as S
from sievelake.operators import rollup

SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("location.file", "_ord", "identity.id")


def effective():
    a = F.col("ai_assessment")
    return S.effective_confidence(F.col("classification.confidence"), a.confidence_adjustment, a.is_likely_vulnerable)


def _stream(df: DataFrame) -> Iterator[Row]:
    return df.toLocalIterator(prefetchPartitions=True)


def write_json(session, path: str) -> None:
    """The whole session as one JSON document."""
    head = session.summary()
    with Path(path).open("w", encoding="utf-8") as out:
        out.write(json.dumps(head, indent=2, default=str)[:-2] + ',\n  "findings": [')
        rows = ordered(session.findings).select(F.to_json(F.struct(*[c for c in session.findings.columns if c != "_ord"]), {"ignoreNullFields": "false"}).alias("j"))
        for i, row in enumerate(_stream(rows)):
            out.write(("," if i else "") + "\n    " + row.j)
        out.write("\n  ]\n}\n")


def sarif_rules(findings: DataFrame) -> DataFrame:
    """A row per rule in the order in which the rules are first met."""
    rows = findings.select(
        F.col("identity.rule_id").alias("id"), F.col("identity.title").alias("name"), F.col("remediation.explanation").alias("explanation"),
        F.col("remediation.recommended_fix").alias("fix"), F.col("classification.category").alias("category"), F.col("classification.severity").alias("severity"),
        F.col("location.file").alias("file"), "_ord",
    )
    return rollup.first_seen(rows, "id", [F.col("file"), F.col("_ord")]).orderBy("first_ord").select(
        "id", "name",
        F.struct(F.col("name").alias("text")).alias("shortDescription"),
        F.struct(F.col("explanation").alias("text")).alias("fullDescription"),
        F.struct(F.col("fix").alias("text")).alias("help"),
        F.struct("category", "severity").alias("properties"),
    )


def sarif_results(findings: DataFrame) -> DataFrame:
    """A row per finding in report order."""
    a = F.col("ai_assessment")
    note = F.when(a.isNull(), "").when(a.is_likely_vulnerable, F.concat(F.lit("\n\nAI Analysis: "), a.explanation)).otherwise(F.concat(F.lit("\n\nAI Note (Likely False Positive): "), F.coalesce(a.false_positive_reason, F.lit("None"))))
    text = F.concat(F.lit("["), S.percent(effective()), F.lit(" confidence] "), F.col("identity.title"), F.lit(": "), F.col("remediation.explanation"), note)
    region = F.struct(F.col("location.line_start").alias("startLine"), F.col("location.line_end").alias("endLine"), F.struct(F.col("context.snippet").alias("text")).alias("snippet"))
    place = F.struct(F.struct(F.struct(F.col("location.file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return ordered(findings).select(F.col("identity.rule_id").alias("ruleId"), S.sarif_level(F.col("classification.severity")).alias("level"), F.struct(text.alias("text")).alias("message"), F.array(place).alias("locations"))


def write_sarif(session, path: str) -> None:
    rules = [json.loads(r.j) for r in sarif_rules(session.findings).select(F.to_json(F.struct("*")).alias("j")).collect()]  # a row per rule
    driver = {"name": "sievelake", "informationUri": "https://spark.apache.org/", "version": __version__, "rules": rules}
    with Path(path).open("w", encoding="utf-8") as out:
        head = {"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [{"tool": {"driver": driver}}]}
        out.write(json.dumps(head, indent=2)[: -len("\n    }\n  ]\n}")] + ',\n      "results": [')
        for i, row in enumerate(_stream(sarif_results(session.findings).select(F.to_json(F.struct("*")).alias("j")))):
            out.write(("," if i else "") + "\n        " + row.j)
        out.write("\n      ]\n    }\n  ]\n}\n")


def write_html(session, path: str) -> None:
    """A page with a summary, a badge per severity but INFO, and a row and details per finding; all text is escaped."""
    head, e = session.summary(), lambda x: html.escape(str(x if x is not None else ""))
    severities = session.findings.select(F.col("classification.severity").alias("severity"))
    counts = {r.severity: r.n for r in rollup.severity_histogram(severities).collect()}  # five rows
    with Path(path).open("w", encoding="utf-8") as out:
        out.write("<!doctype html><html><head><meta charset='utf-8'><title>Security report</title><style>body{font:14px sans-serif;margin:2em}td,th{padding:4px 8px;border-bottom:1px solid #ccc;text-align:left}pre{background:#f4f4f4;padding:8px}</style></head><body>")
        out.write(f"<h1>Security report</h1><p>{e(head['project']['path'])}: {head['project']['file_count']} files, {sum(counts.values())} findings, {head['duration_seconds']:.2f} s</p><p>")
        out.writelines(f"<b>{s}</b> {counts[s]} " for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW"))
        out.write("</p><table><tr><th>Severity</th><th>Rule</th><th>Place</th><th>Confidence</th><th>Source</th></tr>")
        for r in _stream(ordered(session.findings).withColumn("percent", S.percent(effective()))):
            out.write(f"<tr><td>{e(r.classification.severity)}</td><td>{e(r.identity.title)} ({e(r.identity.rule_id)})</td><td>{e(r.location.file)}:{r.location.line_start}</td><td>{e(r.percent)}</td><td>{e(', '.join(r.analysis_source))}</td></tr>")
            ai = f"<p>Model: {e(r.ai_assessment.explanation if r.ai_assessment.is_likely_vulnerable else r.ai_assessment.false_positive_reason)}</p>" if r.ai_assessment else ""
            out.write(f"<tr><td colspan=5><pre>{e(r.context.surrounding_code or r.context.snippet)}</pre><p>{e(r.remediation.explanation)}</p><p>{e(r.remediation.recommended_fix)}</p>{ai}</td></tr>")
        out.write("</table></body></html>\n")


def text_report(session) -> Iterator[str]:
    head = session.summary()
    yield f"Repository          {head['project']['path']}"
    yield f"Files analyzed      {head['project']['file_count']}"
    yield f"Languages detected  {', '.join(head['project']['languages']) or 'None'}"
    yield f"Duration            {head['duration_seconds']:.2f}s"
    for r in _stream(ordered(session.findings).withColumn("percent", S.percent(effective()))):
        yield f"\n[{r.classification.severity}] {r.identity.title}"
        yield f"  File: {r.location.file}:{r.location.line_start}"
        yield f"  Code: {r.context.snippet}"
        yield f"  Conf: {r.percent} | Rule: {r.identity.rule_id}"
        yield f"  Why : {r.remediation.explanation}"
        if a := r.ai_assessment:
            yield f"  {'[AI analysis]' if a.is_likely_vulnerable else '[AI note, likely false positive]'}: {a.explanation if a.is_likely_vulnerable else a.false_positive_reason}"
        yield f"  Fix : {r.remediation.recommended_fix}"


def write_tables(session, folder: str) -> None:
    """Files (without their contents) and findings as Parquet."""
    session.findings.write.mode("overwrite").parquet(f"{folder}/findings")
    session.files.drop("content").write.mode("overwrite").parquet(f"{folder}/files")


def read_report(spark, path: str) -> DataFrame:
    """The findings of a JSON report."""
    return spark.read.json(path, multiLine=True).select(F.explode("findings").alias("f")).select("f.*")


WRITERS = {"json": write_json, "sarif": write_sarif, "html": write_html}
