"""Best-fit packing with large-item matching.

Documents become token pieces of at most ``capacity``.  How pieces share sequences depends on
their lengths alone, so the plan is made from the histogram of lengths (``capacity`` numbers,
however many documents there are): pieces above a third of the capacity stand at most twice
in a sequence and are matched greedily, each with the largest that fits; shorter ones go,
longest first, into the tightest gap, and open a sequence only when no gap is left.  The plan
says which ranks among the pieces of a length go where; ranks come from a range partitioning
by (length, doc_id, piece), so a length that a third of all pieces have is dealt to many tasks.
To the driver go a row per length and partition boundary.

Defined cases: null text is empty and has only its end token; a longer document is cut so that
its first piece takes the remainder; ties in length are broken by (doc_id, piece), repeated
rows get places of their own; the string of an added token in a text is that token, as in the
tokenizers library with add_special_tokens=False; a null doc_id sorts first; an empty table gives no rows; extra
columns of documents are not returned, those of pieces pass through ``pack``.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoding, id_lists, small_batches
from .common import drop, stage


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def to_planes(ids: np.ndarray) -> bytes:
    """Ids as bytes: the lowest byte of each, then the next of each, and so on; the high ones compress to nothing."""
    return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Tokens:
    """Ids of texts under a byte-level vocabulary as its tokenizer gives them: by the rank file of the same vocabulary, but
    for texts that hold the string of an added token, which go through the tokenizer itself."""

    def __init__(self, tokenizer: str, ranks: str) -> None:
        with open(tokenizer, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f)["added_tokens"]]
        self.tokenizer, self.path, self.ranks = None, tokenizer, encoding(ranks, public_tokenizers.PATTERN)

    def __call__(self, text: str) -> list[int]:
        if any(x in text for x in self.added):
            if self.tokenizer is None:
                from tokenizers import Tokenizer

                self.tokenizer = Tokenizer.from_file(self.path)
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(text)


@lru_cache(maxsize=2)
def tokens(tokenizer: str, ranks: str) -> Tokens:
    return Tokens(tokenizer, ranks)


def token_pieces(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids): every document's ids and end token, cut; ``ids`` as ``to_planes`` writes
    them, which ``unpack_ids`` turns into numbers.  ``ranks`` is the rank file of the vocabulary in ``tokenizer``."""
    tokenizer, ranks = tokenizer or public_tokenizers.path("byte_bpe_50k.json"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens(tokenizer, ranks)
        for batch in small_batches(batches):
            rows, parts = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end_id], np.int32)
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc, piece, start, length))
                    parts.append(to_planes(ids[start : start + length]))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def unpack_ids(packed: DataFrame, keep_ids: bool = True) -> DataFrame:
    """``packed`` with ``ids_crc32`` of the ids that stand in it, and with these as numbers unless only the sum is asked."""
    names = [c for c in packed.columns if c != "ids_crc32"]
    kept = [c for c in names if c != "ids"]
    schema = T.StructType([*(packed.schema[c] for c in kept), T.StructField("ids_crc32", T.LongType()), *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ids = [from_planes(x) for x in batch.column("ids").to_pylist()]
            sums = pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), sums, *[id_lists(ids)] * keep_ids], names=[*kept, "ids_crc32", *["ids"] * keep_ids])

    return packed.select(*names).mapInArrow(run, schema)


def plan(counts: np.ndarray, capacity: int) -> tuple[int, dict[int, np.ndarray]]:
    """Sequences used, and for each length rows (first rank, first sequence, offset, pieces a sequence), ranks ascending."""
    left = counts.astype(np.int64).copy()
    used: dict[int, int] = defaultdict(int)
    slots: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    n_seq = 0

    def put(length: int, n: int, base: int, offset: int, each: int) -> None:
        slots[length].append((used[length], base, offset, each))
        used[length] += n
        left[length] -= n

    for length in range(capacity, capacity // 3, -1):
        while left[length]:
            free = np.flatnonzero(left[capacity // 3 + 1 : min(length, capacity - length) + 1])
            mate = int(free[-1]) + capacity // 3 + 1 if len(free) else 0
            if mate == length and left[length] < 2:
                mate = int(free[-2]) + capacity // 3 + 1 if len(free) > 1 else 0
            n = int(left[length]) if not mate else int(left[length]) // 2 if mate == length else int(min(left[length], left[mate]))
            put(length, n, n_seq, 0, 1)
            if mate:
                put(mate, n, n_seq, length, 1)
            gaps[capacity - length - mate].append((n_seq, n))
            n_seq += n
    for length in range(capacity // 3, 0, -1):
        while left[length]:
            n = int(left[length])
            gap = min((g for g, x in gaps.items() if g >= length and x), default=0)
            if not gap:
                gap, take = capacity, -(-n // (capacity // length))
                base, n_bins, n_seq = n_seq, take, n_seq + take
            else:
                base, n_bins = gaps[gap].pop()
            each = gap // length
            full = min(n_bins, n // each)
            if full:
                put(length, full * each, base, capacity - gap, each)
                gaps[gap - each * length].append((base, full))
            rest = int(left[length])
            if full < n_bins and rest:  # fewer than fill a sequence
                put(length, rest, base + full, capacity - gap, rest)
                gaps[gap - rest * length].append((base + full, 1))
                full += 1
            if full < n_bins:
                gaps[gap].append((base + full, n_bins - full))
    return n_seq, {k: np.array(v, np.int64) for k, v in slots.items()}


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (doc_id, piece, length from 1 to ``capacity``, ...) with ``sequence_id`` and ``offset``."""
    pieces = stage(pieces.drop("sequence_id", "offset", "_part", "_rank"), "pieces")
    names = pieces.columns
    schema = T.StructType([*pieces.schema.fields, T.StructField("_part", T.LongType()), T.StructField("_rank", T.LongType())])

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, length, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            if not len(lengths):
                continue
            first = np.flatnonzero(np.r_[True, lengths[1:] != lengths[:-1]])
            run = np.repeat(first, np.diff(np.r_[first, len(lengths)]))
            rank = np.arange(len(lengths)) - run
            if lengths[0] == length:
                rank[run == 0] += seen
            length, seen = lengths[-1], int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(rank), part, np.int64)), pa.array(rank.astype(np.int64))], names=[*names, "_part", "_rank"])

    order = ["length", "doc_id", "piece"]
    dealt = stage(pieces.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(ranks, schema), "ranked-pieces")
    drop(pieces)
    hist = dealt.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n")).orderBy("length", "_part").collect()
    counts, before = np.zeros(capacity + 1, np.int64), {}
    for length, part, n in hist:
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece has length {length}; 1 to {capacity} can be packed")
        before[length, part] = int(counts[length])
        counts[length] += n
    _, slots = plan(counts, capacity)
    shared = pieces.sparkSession.sparkContext.broadcast((before, slots))
    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, slots = shared.value
        for batch in batches:
            length, part, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_part", "_rank"))
            seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.lexsort((part, length))
            breaks = np.flatnonzero((np.diff(length[order]) != 0) | (np.diff(part[order]) != 0)) + 1
            for rows in np.split(order, breaks):
                if len(rows):
                    n = int(length[rows[0]])
                    r = rank[rows] + before[n, int(part[rows[0]])]
                    first, base, at, each = slots[n][np.searchsorted(slots[n][:, 0], r, "right") - 1].T
                    seq[rows] = base + (r - first) // each
                    offset[rows] = at + (r - first) % each * n
            columns = [batch.column(c) for c in names] + [pa.array(seq), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return dealt.mapInArrow(place, out)
