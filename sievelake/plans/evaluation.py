"""Detection quality of each mode over a labelled tree."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from sievelake.operators import evaluate
from sievelake.operators.assess import Provider, written
from sievelake.plans.scan import scan
from sievelake.sources.files import SourceTree

#: Name of a mode and how it scans.
MODES = {"STATIC": {}, "AI_DISCOVERY": {"ai": True, "mode": "discover"}, "HYBRID": {"ai": True, "mode": "hybrid"}}


def evaluate_tree(spark: SparkSession, root: str, provider: str | Provider = "mock") -> DataFrame:
    """(mode, tp, fp, fn, tn, precision, recall, f1), a row per mode, against the labels in the paths below ``root``."""
    spark.dataSource.register(SourceTree)
    paths = spark.read.format("source_tree").option("allFiles", "true").load(root).select("path")
    labelled = written(evaluate.expected(paths))
    rows = []
    for mode, how in MODES.items():
        session = scan(spark, root, **how, **({"provider": provider} if how else {}))
        rows.append(evaluate.evaluate(labelled, session.findings.selectExpr("location.file as path"), mode))
    return written(reduce(DataFrame.unionByName, rows))


def write_evaluation(results: DataFrame, folder: str) -> None:
    """``summary.md`` and ``results.json``."""
    Path(folder, "summary.md").write_text(evaluate.summary_markdown(results))
    table = {r["mode"]: {k: r[k] for k in ("tp", "fp", "fn", "tn", "precision", "recall", "f1")} for r in results.collect()}  # a row per mode
    Path(folder, "results.json").write_text(json.dumps(table, indent=2))
