"""Correlation of static findings with those that a model discovered.

Two findings belong together if file and rule family are equal and their first lines are at most
``reach`` apart.  In list order, a discovered finding is absorbed by the first finding that it
belongs to (static ones first, then discovered ones that stayed); without one it stays.  What
one (file, family) group does says nothing about another, so groups are worked on apart, and
only groups that hold discovered findings are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions import scalars as S

MARK = "ai-discovery"


def family(df: DataFrame) -> Column:
    return S.rule_family(df["identity.rule_id"], df["classification.category"])


def normal_path(path: Column, root: str | None) -> Column:
    """The path below the project, so that all spellings meet; one that leads out stays as it is."""
    return F.coalesce(S.below(path, root), path)


class Standing:
    """Findings of one group that stand, by line, in list order."""

    def __init__(self, reach: int) -> None:
        self.reach, self.first, self.n = reach, {}, 0

    def add(self, line: int | None) -> int:
        place, self.n = self.n, self.n + 1
        if line is not None:
            self.first.setdefault(line, place)
        return place

    def hit(self, line: int | None) -> int | None:
        """The first that stands at most ``reach`` lines away."""
        if line is None:
            return None
        return min((p for x in range(line - self.reach, line + self.reach + 1) if (p := self.first.get(x)) is not None), default=None)


def absorb(rows: list[tuple], reach: int) -> list[tuple]:
    """(id, keep, marked) for the findings (id, line, found) of one group, which come static ones first, in list order."""
    standing, fate, owner = Standing(reach), [], []
    for name, line, found in rows:
        hit = standing.hit(line) if found else None
        if hit is None:
            standing.add(line)
            owner.append(len(fate))
        else:
            fate[owner[hit]][2] = True
        fate.append([name, hit is None, False])
    return [tuple(x) for x in fate]


def _absorb_runs(n_keys: int, reach: int):
    """Fates of rows (keys, found, ord, id, line) that come sorted by all but the line."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        ids, keep, marked = zip(*absorb(rows, reach), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(keep), pa.array(marked)], names=["id", "keep", "marked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, found, name, line in zip(zip(*columns[:n_keys], strict=True), columns[n_keys], columns[-2], columns[-1], strict=True):
                if key != last and rows:
                    yield batch_of(rows)
                    rows = []
                last = key
                rows.append((name, line, found))
        if rows:
            yield batch_of(rows)

    return run


def greedy(places: DataFrame, keys: list[str], reach: int = 5) -> DataFrame:
    """(id, keep, marked) of ``places`` (keys, id, line, found, ord), each group of keys by itself.  Groups without
    discovered rows are left out: nothing changes in them."""
    groups = places.where("found = 1").select(*keys).distinct()
    ours = places.join(groups, keys, "left_semi").select(*keys, "found", "ord", "id", "line")
    order = [*keys, "found", "ord", "id"]
    return ours.repartition(*keys).sortWithinPartitions(*order).mapInArrow(_absorb_runs(len(keys), reach), "id string, keep boolean, marked boolean")


def nearest(static: DataFrame, found: DataFrame, keys: list[str], reach: int = 5) -> DataFrame:
    """``found`` (keys, id, line) with ``static_id``, the least id of ``static`` under the same keys at most ``reach`` lines
    away: a band join over buckets of lines."""
    width = reach + 1
    at = static.select(*keys, F.col("id").alias("static_id"), F.col("line").alias("_at"), F.floor(F.col("line") / width).alias("_bucket"))
    near = found.select(*keys, "id", "line", F.explode(F.sequence(F.floor((F.col("line") - reach) / width), F.floor((F.col("line") + reach) / width))).alias("_bucket"))
    hits = near.join(at, [*keys, "_bucket"]).where(F.abs(F.col("line") - F.col("_at")) <= reach).groupBy(*keys, "id").agg(F.min("static_id").alias("static_id"))
    return found.join(hits, [*keys, "id"], "left")


def fingerprinted(df: DataFrame) -> DataFrame:
    """Fill in the fingerprint where there is none."""
    mark = S.fingerprint(F.col("classification.category"), F.col("location.file"), F.col("location.line_start"), family(df))
    return df.withColumn("identity", F.col("identity").withField("fingerprint", F.coalesce("identity.fingerprint", mark)))


def correlate(static: DataFrame, discovered: DataFrame, reach: int = 5, root: str | None = None) -> DataFrame:
    """Static findings, with ``ai-discovery`` among the sources of those that absorbed one, and the discovered
    ones that stayed.  ``root`` makes paths below it relative for the comparison."""
    both = fingerprinted(static).withColumn("found", F.lit(0)).unionByName(fingerprinted(discovered).withColumn("found", F.lit(1)))
    both = both.withColumn("id", F.sha2(F.concat_ws("\x1f", "found", "identity.id", "location.file", "location.line_start", F.col("_ord").cast("string")), 256))
    places = both.select(
        normal_path(F.col("location.file"), root).alias("file"), family(both).alias("family"), "id",
        F.col("location.line_start").alias("line"), "found", F.struct("location.file", "_ord").alias("ord"),
    )
    # The order of a group is that of (file, _ord); within a group the file is one.
    fate = greedy(places.withColumn("ord", F.col("ord._ord")), ["file", "family"], reach)
    out = both.join(fate, "id", "left").where(F.coalesce("keep", F.lit(True)))
    marked = F.coalesce("marked", F.lit(False)) & ~F.array_contains("analysis_source", MARK)
    return out.withColumn("analysis_source", F.when(marked, F.array_append("analysis_source", MARK)).otherwise(F.col("analysis_source"))).drop("id", "found", "keep", "marked")
