"""LM scoring: stupid-backoff scores of every document under counts of the whole corpus.

The count tables of n-grams are partitioned by hash and joined to the documents' n-grams, an order
at a time.  Documents stand in blocks of about ``block_bytes``, a row each.  A block asks once for each
n-gram it holds: its distinct n-grams with their counts, a sorted run per hash bucket, go to the
bucket's task, which adds up the counts of all blocks and answers each block with the totals in
the order asked.  Answers are joined to their blocks and the scores summed per document.  A frequent
n-gram thus costs one entry a block, however many rows hold it, and entries of a block and bucket are
one row: never more rows than the block has different n-grams.

``relational_scores`` is the same by joins of exploded n-grams alone.

A document is scored by what the others say: its own counts are taken off the totals.  With
c the counts of the others and N all words,

    S(w | context) = c(context w) / c(context)    if c(context w) > 0, else alpha * S(w | shorter context),
    S(w)           = max(c(w), 1) / N.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; contexts don't reach over documents.

Defined cases: a null, empty or blank text has 0 words and score 0; null doc_id and repeated rows
are scored as documents of their own (so a repeated row is evidence for the other); an empty
table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held, stage, words_of
from .shingles import ngrams, word_hashes

BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: An Arrow batch, which stands in the JVM and in the worker beside it, ends with the row that takes it beyond so many bytes
#: (Spark's own limit is 64 MB); a row group of blocks, which is read as a whole, holds so many.
BATCH_BYTES, GROUP_BLOCKS = 4 << 20, 4
_U = np.uint64


def pack(values: np.ndarray, delta: bool = False) -> bytes:
    """Byte planes of unsigned numbers, of their differences if sorted: equal bytes stand together for the shuffle's compression."""
    if delta and len(values):
        values = np.r_[values[:1], values[1:] - values[:-1]]
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unpack(raw: bytes, kind, delta: bool = False) -> np.ndarray:
    size = np.dtype(kind).itemsize
    values = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if delta else values


def grams(words: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each word the hash of the n-gram that ends there; 0 where the document has too few words before it."""
    out = np.zeros(len(words), _U)
    if len(words) >= order:
        out[order - 1 :] = np.maximum(ngrams(words, order, order), _U(1))
    for k in range(order - 1):
        at = offsets[:-1] + k
        out[at[at < offsets[1:]]] = 0
    return out


def distinct(words: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams, index of each word's n-gram (-1: none), and counts."""
    keys, index, n = np.unique(grams(words, offsets, order), return_inverse=True, return_counts=True)
    if len(keys) and keys[0] == 0:
        keys, index, n = keys[1:], index - 1, n[1:]
    return keys, index.astype(np.int64), n


def _block(block_bytes: int):
    """(block, n_bytes, doc_ids, texts): the rows of a task in blocks, as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def row() -> pa.RecordBatch:
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([size]), one(pa.concat_arrays(ids)), one(pa.concat_arrays(texts))], names=["block", "n_bytes", "doc_ids", "texts"])

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                rows = batch.slice(i, 64)
                ids.append(rows.column(0))
                texts.append(rows.column(1))
                size += sum(len(x) for x in texts[-1].cast(pa.binary()).to_pylist() if x)
                if size >= block_bytes:
                    yield row()
                    block, ids, texts, size = block + 1, [], [], 0
        if ids:
            yield row()

    return run


def _ask(order: int, bits: int):
    """Requests (bucket, block, keys, counts) of rows (block, texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, _, n = distinct(*word_hashes(texts.values, lower=True), order)
                bucket = (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.zeros(0, np.int64)
                rows = [(int(bucket[a]), block, pack(keys[a:b], True), pack(n[a:b].astype(np.uint32))) for a, b in zip(first, [*first[1:], len(keys)], strict=True)]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "block", "keys", "counts"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals (block, bucket, totals, occurrences) for requests that come sorted by bucket."""

    def totals(rows: list) -> pa.RecordBatch:
        parts = [unpack(r[2], _U, True) for r in rows]
        counts = np.concatenate([unpack(r[3], np.uint32) for r in rows])
        _, index = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(index, weights=counts).astype(np.uint64)[index]
        ends = np.cumsum([len(p) for p in parts])
        said = [pack(x) for x in np.split(total, ends[:-1])]
        # How often n-grams of this bucket occur, said once.
        occurs = [int(counts.sum()), *[0] * (len(rows) - 1)]
        columns = [pa.array([r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array(said, pa.binary()), pa.array(occurs, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["block", "bucket", "totals", "occurrences"])

    rows: list = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and r[0] != rows[0][0]:
                yield totals(rows)
                rows = []
            rows.append(r)
    if rows:
        yield totals(rows)


def scores(texts: pa.Array, said: dict[int, list[bytes]], order: int, alpha: float, n_all: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, backed-off words, log score) of each text; ``said`` has the totals of each order's n-grams, in order."""
    words, offsets = word_hashes(texts, lower=True)
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(texts)), n)
    position = np.arange(len(words)) - np.repeat(offsets[:-1], n)
    score, backed, context = np.zeros(len(words)), np.zeros(len(words), bool), np.zeros(len(words), np.int64)
    for k in range(1, order + 1):
        keys, index, _ = distinct(words, offsets, k)
        total = np.concatenate([unpack(x, np.uint64) for x in said[k]]) if said.get(k) else np.zeros(0, np.uint64)
        # The document's own counts, by (document, n-gram).
        _, pair, own = np.unique(doc * (len(keys) + 1) + index, return_inverse=True, return_counts=True)
        has = index >= 0
        c = np.zeros(len(words), np.int64)
        c[has] = total[index[has]].astype(np.int64) - own[pair[has]]
        if k == 1:
            score = np.log(np.maximum(c, 1) / n_all)
        else:
            long = position >= k - 1
            seen = long & (c > 0)
            score = np.where(seen, np.log(np.maximum(c, 1) / np.maximum(context, 1)), np.where(long, score + math.log(alpha), score))
            backed = np.where(long, ~seen, backed)
        context = np.r_[0, c[:-1]].astype(np.int64) if len(c) else c
    return n, np.bincount(doc, backed, len(texts)).astype(np.int64), np.bincount(doc, score, len(texts))


def _score(order: int, alpha: float, n_all: int):
    """(doc_id, n_words, n_backoff, log_score) of rows (block, side, gram_order, bucket, totals, doc_ids, texts) that
    come sorted: a block, then its answers by order and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, said = None, None, {}

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, *map(pa.array, scores(texts, said, order, alpha, n_all))], names=["doc_id", "n_words", "n_backoff", "log_score"])

        for batch in batches:
            for r, (side, k, totals) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("side", "gram_order", "totals")), strict=True)):
                if side:
                    said.setdefault(k, []).append(totals)
                    continue
                if ids is not None:
                    yield result()
                # Copies, so that the batch can go.
                ids, texts = (pa.concat_arrays([batch.column(c)[r].values, batch.column(c)[r].values[:0]]) for c in ("doc_ids", "texts"))
                said = {}
        if ids is not None:
            yield result()

    return run


def _scored(docs: DataFrame, order: int, alpha: float, block_bytes: int, bucket_bytes: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    blocks = stage(docs.mapInArrow(_block(block_bytes), "block long, n_bytes long, doc_ids array<long>, texts array<string>"), "text-blocks", **{"parquet.block.row.count.limit": GROUP_BLOCKS})
    size = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    bits = max(0, (-(-size // bucket_bytes) - 1).bit_length())
    answers = []
    for k in range(1, order + 1):  # one after the other: the shuffle files of an order go before the next
        asked = blocks.select("block", "texts").mapInArrow(_ask(k, bits), "bucket long, block long, keys binary, counts binary")
        dealt = asked.repartition("bucket").sortWithinPartitions("bucket")
        answers.append(stage(dealt.mapInArrow(_answer, "block long, bucket long, totals binary, occurrences long"), f"totals-{k}"))
    n_all = answers[0].agg(F.coalesce(F.sum("occurrences"), F.lit(1))).first()[0]
    null = lambda kind: F.lit(None).cast(kind)
    both = blocks.select("block", F.lit(0).alias("side"), F.lit(0).alias("gram_order"), F.lit(0).cast("long").alias("bucket"), null("binary").alias("totals"), "doc_ids", "texts")
    for k, df in enumerate(answers, 1):
        both = both.unionByName(df.select("block", F.lit(1).alias("side"), F.lit(k).alias("gram_order"), "bucket", "totals", null("array<long>").alias("doc_ids"), null("array<string>").alias("texts")))
    both = both.repartition("block").sortWithinPartitions("block", "side", "gram_order", "bucket")
    # Written here, as the limit of a batch holds for what runs meanwhile.
    return stage(both.mapInArrow(_score(order, alpha, max(1, n_all)), "doc_id long, n_words long, n_backoff long, log_score double"), "scores")


def lm_scores(docs: DataFrame, order: int = 3, alpha: float = 0.4, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_words, n_backoff, log_score, mean_log_score): natural logarithms; ``n_backoff``
    counts the words whose full context was not enough."""
    with held(docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES):
        scored = _scored(docs, order, alpha, block_bytes, bucket_bytes)
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(0.0))


def relational_scores(docs: DataFrame, order: int = 3, alpha: float = 0.4) -> DataFrame:
    """What ``lm_scores`` gives, by exploded n-grams: count tables, a join for each order, a sum per document."""
    docs = stage(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), words_of(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).alias("words")), "rows")
    places = docs.select("row", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1)))).alias("i"), "words").where("i <= size(words)")
    counted = None
    for k in range(1, order + 1):
        key = F.concat_ws(" ", *[F.get("words", F.col("i") - j) for j in range(k, 0, -1)])
        each = places.where(F.col("i") >= k).select("row", "i", key.alias("gram"))
        own = each.groupBy("gram", "row").agg(F.count(F.lit(1)).alias("own"))
        total = own.groupBy("gram").agg(F.sum("own").alias("total"))
        others = own.join(total, "gram").select("gram", "row", (F.col("total") - F.col("own")).alias("c"))
        each = each.join(others, ["gram", "row"]).select("row", "i", F.lit(k).alias("k"), "c")
        each = stage(each, f"counts-{k}")
        counted = each if counted is None else counted.unionByName(each)
    wide = counted.groupBy("row", "i").agg(*[F.max(F.when(F.col("k") == k, F.col("c"))).alias(f"c{k}") for k in range(1, order + 1)])
    n_all = max(1, wide.count())
    before = Window.partitionBy("row").orderBy("i")
    score, backed = F.log(F.greatest("c1", F.lit(1)) / F.lit(n_all)), F.lit(False)
    for k in range(2, order + 1):
        c, context = F.col(f"c{k}"), F.lag(f"c{k - 1}").over(before)
        score = F.when(c > 0, F.log(c / F.greatest(context, F.lit(1)))).when(c == 0, score + math.log(alpha)).otherwise(score)
        backed = F.when(c.isNotNull(), c == 0).otherwise(backed)
    summed = wide.select("row", score.alias("s"), backed.alias("b")).groupBy("row").agg(F.count(F.lit(1)).alias("n_words"), F.count_if("b").alias("n_backoff"), F.sum("s").alias("log_score"))
    out = docs.select("row", "doc_id").join(summed, "row", "left").select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_words", "n_backoff", "log_score")])
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(0.0))


def digest(scores: DataFrame) -> DataFrame:
    """Scores to six decimals."""
    return scores.select("doc_id", "n_words", "n_backoff", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


#: For three words and alpha 0.4.
ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
t AS (
  SELECT doc_id, i, ws[i] AS w1, CASE WHEN i > 1 THEN ws[i - 1] || ' ' || ws[i] END AS w2, CASE WHEN i > 2 THEN ws[i - 2] || ' ' || ws[i - 1] || ' ' || ws[i] END AS w3
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
g AS (
  SELECT doc_id, i, 1 AS k, w1 AS gram FROM t
  UNION ALL SELECT doc_id, i, 2, w2 FROM t WHERE i > 1
  UNION ALL SELECT doc_id, i, 3, w3 FROM t WHERE i > 2),
o AS (SELECT doc_id, k, gram, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT k, gram, sum(n) AS n FROM o GROUP BY ALL),
u AS (SELECT o.doc_id, o.k, o.gram, c.n - o.n AS n FROM o JOIN c ON o.k = c.k AND o.gram = c.gram),
p AS (SELECT g.doc_id, g.i, max(u.n) FILTER (WHERE g.k = 1) AS n1, max(u.n) FILTER (WHERE g.k = 2) AS n2, max(u.n) FILTER (WHERE g.k = 3) AS n3
      FROM g JOIN u ON u.doc_id = g.doc_id AND u.k = g.k AND u.gram = g.gram GROUP BY g.doc_id, g.i),
l AS (SELECT *, lag(n1) OVER (PARTITION BY doc_id ORDER BY i) AS before1, lag(n2) OVER (PARTITION BY doc_id ORDER BY i) AS before2 FROM p),
s AS (
  SELECT doc_id, CASE WHEN n3 IS NOT NULL THEN n3 = 0 WHEN n2 IS NOT NULL THEN n2 = 0 ELSE false END AS backed,
         CASE WHEN n3 > 0 THEN ln(n3 / greatest(before2, 1))
              WHEN n2 > 0 THEN ln(n2 / greatest(before1, 1)) + CASE WHEN n3 = 0 THEN ln(0.4) ELSE 0 END
              ELSE ln(greatest(n1, 1) / (SELECT count(*) FROM t)) + CASE WHEN n2 = 0 THEN ln(0.4) ELSE 0 END + CASE WHEN n3 = 0 THEN ln(0.4) ELSE 0 END END AS score
  FROM l),
d AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE backed) AS n_backoff, sum(score) AS score FROM s GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_backoff, 0) AS n_backoff, round(coalesce(score, 0), 6) AS log_score, round(coalesce(score / n_words, 0), 6) AS mean_log_score
FROM w LEFT JOIN d ON d.doc_id = w.doc_id
"""
