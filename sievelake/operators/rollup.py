"""Roll-ups over findings, gates and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions import scalars as S


def severity_histogram(severities: DataFrame) -> DataFrame:
    """(severity, rank, n) with a row for each of the five levels, from a column ``severity``."""
    levels = severities.sparkSession.createDataFrame([(k, v) for k, v in S.SEVERITY_RANK.items()], "severity string, rank int")
    counts = severities.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return levels.join(counts, "severity", "left").select("severity", "rank", F.coalesce("n", F.lit(0)).alias("n"))


def severity_share(severities: DataFrame) -> DataFrame:
    """(severity, n, share); the share is 0 where there are no rows."""
    hist = severity_histogram(severities)
    total = hist.agg(F.sum("n").alias("total"))
    return hist.crossJoin(total).select("severity", "n", F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0).alias("share"))


def fails(severity: Column, threshold: str) -> Column:
    """Aggregate: is there a row at or above the threshold?  False for no rows."""
    return F.coalesce(F.bool_or(S.severity_rank(severity) >= S.threshold_rank(threshold)), F.lit(False))


def counters(findings: DataFrame) -> DataFrame:
    """One row of the counts that a session reports."""
    source = F.col("analysis_source")
    return findings.agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(F.array_contains(source, "static-rule")).alias("static_findings"),
        F.count_if(source[0] == "ai-discovery").alias("ai_findings"),
        F.count_if(F.array_contains(source, "ai-verified")).alias("verified_findings"),
        F.count_if(F.array_contains(source, "static-rule") & F.array_contains(source, "ai-discovery")).alias("correlated_findings"),
        F.count_distinct("identity.rule_id").alias("rules_hit"),
        F.count_distinct("location.file").alias("flagged_files"),
    )


def project_summary(files: DataFrame) -> DataFrame:
    """One row: how many files, which languages, which paths."""
    return files.agg(F.count(F.lit(1)).alias("file_count"), F.sort_array(F.collect_set("lang")).alias("languages"), F.sort_array(F.collect_list("path")).alias("scanned_files"))


def first_seen(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in an order, with ``first_ord`` to sort by."""
    place = F.struct(*order)
    rest = F.struct(*[F.col(c) for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.min_by(rest, place).alias("_row"), F.min(place).alias("first_ord")).select(key, "_row.*", "first_ord")


def view(findings: DataFrame, severity: str = "ALL", source: str = "ALL", search: str = "") -> DataFrame:
    """Findings as a user filters them, most confident first."""
    out = findings
    if severity != "ALL":
        out = out.where(F.col("classification.severity") == severity)
    if source != "ALL":
        out = out.where(F.exists("analysis_source", lambda x: x.contains(source)))
    if search:
        hit = F.lit(False)
        for c in ("identity.title", "identity.rule_id", "location.file"):
            hit = hit | F.lower(c).contains(search.lower())
        out = out.where(hit)
    return out.orderBy(F.desc("classification.confidence"), "location.file", "_ord")


def flow_view(findings: DataFrame) -> DataFrame:
    """Sources and sinks of findings that have any."""
    flow = F.col("data_flow")
    return findings.where((F.size(flow.sources) > 0) | (F.size(flow.sinks) > 0)).select("identity.rule_id", "location.file", "location.line_start", flow.sources.alias("sources"), flow.sinks.alias("sinks"))
