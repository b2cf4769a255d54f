"""Byte-level BPE encoding and decoding of whole documents.

A text of more than ``chunk_chars`` characters is cut into chunks that overlap; every chunk is
pre-tokenised by itself, as if a pre-token began at its first character.  Where two neighbours
agree on a pre-token boundary inside their overlap they agree from there on (a match depends only
on where it begins and on what follows), so the text can be cut at that boundary; the pieces are
encoded and their ids concatenated.  Neighbours that never agree (say, one run of letters) are one piece.
Boundaries too near to a chunk's end to see what follows are not trusted, and no cut is made
behind white space.  Decoding concatenates the bytes of the ids.

The chunks of a text up to ``spread_chars`` characters stay in the task that reads it; those of a
longer one are dealt to tasks, pre-tokenised there, stitched, and the pieces dealt again to be encoded.

Defined cases: null text is empty and has no ids; texts are encoded whole, special tokens are
never recognised; repeated rows each give a row, in any order; a null doc_id is kept; an empty
table gives no rows; columns other than doc_id and text are not returned.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that a chunk's match may need to see behind its end: a contraction's letters.
MARGIN = 4


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_table(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        pairs = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f)]
    table = [b""] * (max(pairs)[0] + 1)
    for rank, token in pairs:
        table[rank] = token
    return table


def id_lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of few rows, so that what a batch grows to stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def overlapping(text: str, chunk_chars: int, overlap: int) -> list[tuple[int, bool, str]]:
    """(start, whether it reaches the end, characters) of the chunks of a text."""
    size = chunk_chars + overlap
    starts = range(0, max(1, len(text) - overlap), chunk_chars)
    return [(s, s + size >= len(text), text[s : s + size]) for s in starts]


def pieces_of(text: str, pattern: str, chunk_chars: int, overlap: int) -> list[str]:
    """Parts of the text that can be encoded by themselves, by overlapping chunks."""
    if len(text) <= chunk_chars:
        return [text]
    return stitch([(s, part, edges(part, s, last, pattern, overlap)) for s, last, part in overlapping(text, chunk_chars, overlap)], pattern)


def _encode(path: str, pattern: str, chunk_chars: int, overlap: int):
    """The last column, texts, replaced by their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in small_batches(batches):
            ids = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                parts = [enc.encode_ordinary(x) for x in pieces_of(text or "", pattern, chunk_chars, overlap)]
                ids.append(np.array(parts[0] if len(parts) == 1 else [i for x in parts for i in x], np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], id_lists(ids)], names=[*batch.schema.names[:-1], "ids"])

    return run


def _chunks(chunk_chars: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            for doc, key, copies, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start, last, part = zip(*overlapping(text, chunk_chars, overlap), strict=True)
                same = lambda x, t: pa.array([x] * len(start), t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [same(doc, pa.int64()), same(key, pa.string()), same(copies, pa.int64()), pa.array(start, pa.int64()), pa.array(last, pa.bool_()), pa.array(part, pa.string())],
                    names=["doc_id", "key", "copies", "start", "is_last", "part"],
                )

    return run


def _bounds(pattern: str, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            found = [edges(t, s, last, pattern, overlap) for t, s, last in zip(rows["part"], rows["start"], rows["is_last"], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names, "bounds"])

    return run


@lru_cache(maxsize=4)
def _compiled(pattern: str):
    import regex

    return regex.compile(pattern)


def boundaries(text: str, start: int, last: bool, pattern: str) -> list[int]:
    """Trusted pre-token boundaries of a chunk that begins at ``start``, as places in the document."""
    end = len(text) if last else len(text) - MARGIN
    return [start, *(start + e for m in _compiled(pattern).finditer(text) if (e := m.end()) <= end)]


def edges(text: str, start: int, last: bool, pattern: str, overlap: int) -> list[int]:
    """The boundaries inside the overlaps with both neighbours."""
    return [p for p in boundaries(text, start, last, pattern) if p < start + overlap or p >= start + len(text) - overlap]


def stitch(chunks: list[tuple[int, str, list[int]]], pattern: str) -> list[str]:
    """Pieces of the text whose (start, part, bounds) are given in order; every cut is a true pre-token boundary."""
    text = "".join(part[: nxt - start] for (start, part, _), nxt in zip(chunks, [*(c[0] for c in chunks[1:]), 1 << 62], strict=True))
    cuts, own = [0], set(chunks[0][2])
    # From the last boundary that is known to be true, ``known``, the text is scanned again only when twice as much is at hand.
    known, scanned = max(own), len(chunks[0][1])
    for k, (start, part, bounds) in enumerate(chunks[1:], 1):
        # Not behind white space: how a run of it is split depends on what follows the cut.
        agreed = [p for p in bounds if p in own and p > cuts[-1] and not text[p - 1].isspace()]
        reach = start + len(part)
        if agreed:
            cuts.append(min(agreed))
            own, known, scanned = set(bounds), max(bounds), len(part)
        elif reach - known >= 2 * scanned and k < len(chunks) - 1:
            own, scanned = set(boundaries(text[known:reach], known, False, pattern)), reach - known
            known = max(own)
        else:
            own = set()
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def _pieces(pattern: str):
    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("start")
        pieces = stitch([(int(s), t, [int(x) for x in b]) for s, t, b in zip(pdf.start, pdf.part, pdf.bounds, strict=True)], pattern)
        row = pdf.iloc[0]
        return pd.DataFrame({"doc_id": pd.array([row.doc_id] * len(pieces), "Int64"), "key": row.key, "copies": row.copies, "piece": range(len(pieces)), "part": pieces})

    return run


def encode(
    docs: DataFrame,
    path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    chunk_chars: int = 1 << 12,
    overlap: int = 1 << 8,
    spread_chars: int = 1 << 16,
) -> DataFrame:
    """(doc_id, ids array<int>) of every document, by the ranks in ``path``."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    encoded = _encode(path, pattern, chunk_chars, overlap)
    near = docs.where(F.length("text") <= spread_chars).mapInArrow(encoded, "doc_id long, ids array<int>")
    # Few documents are longer; a row of its own for each different one, so that repeated rows don't mix.
    long = docs.where(F.length("text") > spread_chars).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    keyed = long.select("doc_id", F.concat_ws(":", F.xxhash64("text"), F.xxhash64(F.reverse("text"))).alias("key"), "copies", "text")
    chunks = keyed.mapInArrow(_chunks(spread_chars, overlap), "doc_id long, key string, copies long, start long, is_last boolean, part string")
    chunks = chunks.repartition("doc_id", "key", "start")
    bounds = chunks.mapInArrow(_bounds(pattern, overlap), "doc_id long, key string, copies long, start long, is_last boolean, part string, bounds array<long>")
    pieces = bounds.groupBy("doc_id", "key").applyInPandas(_pieces(pattern), "doc_id long, key string, copies long, piece long, part string")
    pieces = pieces.repartition("doc_id", "key", "piece").mapInArrow(encoded, "doc_id long, key string, copies long, piece long, ids array<int>")
    joined = pieces.groupBy("doc_id", "key", "copies").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("piece", "ids"))), lambda x: x.ids)).alias("ids"))
    joined = joined.select("doc_id", "ids", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("col")
    return near.unionByName(joined)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``tokens`` (doc_id, ids) with ``decoded``, the bytes of the ids; null ids decode to nothing."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(path)
        for batch in small_batches(batches):
            lists = batch.column("ids")
            raw = [b"".join([table[i] for i in ids.values.to_pylist()]) if ids.is_valid else b"" for ids in lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(raw, pa.binary())], names=["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digest(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
