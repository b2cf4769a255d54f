"""Line dedup by content-defined line chunks, in DataFrame functions only.

A text is split at ``\\n``.  Each line has a hash; a rolling hash over the last three line
hashes ends a chunk wherever it is 0 modulo ``divisor``, so boundaries move with the content
when lines are inserted or taken away.  A chunk of two or more lines, two of them not blank,
is a duplicate if the same lines stand as a chunk earlier in the corpus (smaller doc_id, then
earlier in the document); duplicates are removed, the first one stays.

Chunks meet by the hash of their lines: only hashes seen twice go on, and their texts are
compared byte for byte.  The text of a document is shuffled once, to meet its removed spans.

Defined cases: null text has no lines and stays null; an empty text is one blank line; null
doc_id sorts first; rows with the same doc_id are told apart by their text (fully repeated
rows count as one place, so none loses a line to the other); long texts are handled whole; an
empty table gives no rows; extra columns pass through, unless named like a new column, which
then replaces them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bundle, drop, let, sha256_text, stage, unbundle


def line_chunks(docs: DataFrame, divisor: int = 4) -> DataFrame:
    """(doc_id, text_key, first_line, n_lines, solid_lines, body): the multi-line chunks of every text."""
    df = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_key"), F.split("text", "\n", -1).alias("lines"))
    df = let(df, h=F.transform("lines", lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 7), 16, 10).cast("long")))
    n = F.size("lines")
    df = let(
        df,
        cuts=F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: (i == n - 1)
            | ((F.coalesce(F.get("h", i - 2), F.lit(0)) * 961 + F.coalesce(F.get("h", i - 1), F.lit(0)) * 31 + F.get("h", i)) % divisor == 0),
        ),
    )
    start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("cuts", k - 1) + 1)
    part = lambda c, k: F.slice("lines", start(k) + 1, c - start(k) + 1)
    chunk = lambda c, k: F.struct(
        start(k).alias("first_line"),
        (c - start(k) + 1).alias("n_lines"),
        F.size(F.filter(part(c, k), lambda x: F.trim(x) != "")).alias("solid_lines"),
        F.array_join(part(c, k), "\n").alias("body"),
    )
    # Built inside the row and exploded without it, so a text is copied once, not once a chunk.
    return df.select("doc_id", "text_key", F.inline(F.transform("cuts", chunk))).where("n_lines > 1")


def duplicate_chunks(docs: DataFrame, divisor: int = 4) -> DataFrame:
    """(doc_id, text_key, first_line, n_lines) of every chunk to remove."""
    chunks = line_chunks(docs, divisor).where("solid_lines > 1").select("doc_id", "text_key", "first_line", "n_lines", "body")
    place = F.struct("doc_id", "text_key", "first_line")
    chunks = chunks.withColumn("hash", F.xxhash64("body"))
    # Counted before the shuffle, so a chunk that a third of all documents hold is a row per task.
    seen = chunks.groupBy("hash").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo < hi")
    repeated = stage(seen.select("hash"), "line-hashes")
    again = stage(chunks.join(repeated, "hash", "left_semi"), "line-chunks")
    drop(repeated)
    first = again.groupBy("body").agg(F.min(place).alias("kept"), F.max(place).alias("last")).where("kept < last").select("body", "kept")
    first = stage(first, "line-firsts")
    return again.join(first, "body").where(place > F.col("kept")).select("doc_id", "text_key", "first_line", "n_lines")


def dedup_lines(docs: DataFrame, divisor: int = 4) -> DataFrame:
    """``docs`` with ``text`` without duplicate chunks, ``n_lines`` before and ``n_removed_lines``."""
    drop = duplicate_chunks(docs, divisor).groupBy("doc_id", "text_key").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("first_line", F.col("first_line") + F.col("n_lines") - 1)))).alias("_gone"))
    drop = drop.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), "_gone")
    keep, new = ("doc_id", "text"), ("n_lines", "n_removed_lines")
    rest = bundle(docs, keep, new)
    df = rest.join(drop, rest.doc_id.eqNullSafe(drop._d) & (F.xxhash64(rest.text) == drop._k), "left")
    df = let(df, _lines=F.split("text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n"))
    counts = {"n_lines": "_lines", "n_removed_lines": "_gone"}
    df = df.select(
        "doc_id", text.alias("text"), "_rest",
        *[F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long").alias(name) for name, c in counts.items()],
    )
    return df.select(*unbundle(docs, keep, new), *new)


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_lines", "n_removed_lines", F.length("text").cast("long").alias("kept_chars"), sha256_text(F.col("text")).alias("kept_sha256"))


ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
p AS (
  SELECT doc_id, text, i, ls[i] AS line, ('0x' || substr(md5(ls[i]), 1, 7))::BIGINT AS h
  FROM (SELECT doc_id, text, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)),
c AS (
  SELECT *, CASE WHEN (coalesce(lag(h, 2) OVER w, 0) * 961 + coalesce(lag(h) OVER w, 0) * 31 + h) % 4 = 0 THEN 1 ELSE 0 END AS cut
  FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (
  SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM c),
b AS (
  SELECT doc_id, k, min(i) AS i, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body,
         count(*) FILTER (WHERE trim(line, ' ') <> '') AS solid
  FROM g GROUP BY doc_id, k),
d AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS r FROM b WHERE n > 1 AND solid > 1),
o AS (
  SELECT g.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE r > 1) AS n_removed_lines,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE r IS NULL OR r = 1), '') AS t
  FROM g LEFT JOIN d ON g.doc_id = d.doc_id AND g.k = d.k GROUP BY g.doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines,
       length(t)::BIGINT AS kept_chars, sha256(t) AS kept_sha256
FROM documents LEFT JOIN o ON documents.doc_id = o.doc_id
"""
