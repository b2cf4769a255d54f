"""Detection quality against labels that stand in paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUFFIXES = (".py", ".js", ".json", ".yml", ".yaml")


def expected(paths: DataFrame) -> DataFrame:
    """(path, vulnerable) of the labelled files among ``paths`` (path)."""
    p = F.col("path")
    label = F.when(p.contains("vulnerable/") | p.contains("variant/"), True).when(p.contains("safe/") | p.contains("false_positive/"), False)
    suffix = F.lit(False)
    for s in SUFFIXES:
        suffix = suffix | p.endswith(s)
    return paths.where(suffix).select("path", label.alias("vulnerable")).where("vulnerable is not null")


def confusion(vulnerable: Column, flagged: Column) -> list[Column]:
    """Aggregates tp, fp, fn, tn."""
    pairs = {"tp": (True, True), "fp": (False, True), "fn": (True, False), "tn": (False, False)}
    return [F.count_if((vulnerable == v) & (flagged == f)).alias(k) for k, (v, f) in pairs.items()]


def ratio(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(0.0)


def with_scores(table: DataFrame) -> DataFrame:
    """A table of tp, fp, fn with precision, recall and f1, 0 where a denominator is 0."""
    out = table.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def evaluate(labelled: DataFrame, flagged: DataFrame, mode: str) -> DataFrame:
    """(mode, tp, fp, fn, tn, precision, recall, f1): ``labelled`` (path, vulnerable) against files that have findings."""
    hits = flagged.select("path").distinct().withColumn("hit", F.lit(True))
    joined = labelled.join(hits, "path", "left")
    return with_scores(joined.agg(*confusion(F.col("vulnerable"), F.coalesce("hit", F.lit(False))))).select(F.lit(mode).alias("mode"), "tp", "fp", "fn", "tn", "precision", "recall", "f1")


def summary_markdown(results: DataFrame) -> str:
    """The table of modes as text; a row per mode comes to the driver."""
    lines = ["# Detection quality", "", "| Mode | TP | FP | FN | TN | Precision | Recall | F1 |", "|---|---|---|---|---|---|---|---|"]
    for r in results.orderBy("mode").collect():
        lines.append(f"| {r['mode']} | {r['tp']} | {r['fp']} | {r['fn']} | {r['tn']} | {r['precision']:.2f} | {r['recall']:.2f} | {r['f1']:.2f} |")
    return "\n".join(lines) + "\n"
