"""Substring dedup by relative Lempel-Ziv parsing over words.

A document is parsed against reference blocks: documents with a smaller doc_id.  An index of windows
of ``window`` words tells which block to parse against, and the parse works on words:

1. Documents with the same words as one with a smaller doc_id (128 bits of a cryptographic hash over
   the words) are duplicates as a whole; only the first of a class is indexed and parsed.
2. Each window has an anchor, its lowest-hashed 5-gram.  Equal windows have equal anchors, so windows
   matter only where the anchor occurs in two documents.  Windows in a row that share an anchor's
   place are one row.
3. The index has, for each window that occurs in two documents, the smallest doc_id: its block.
4. A stretch of a document is a run of windows indexed under the same block.  Every different stretch
   is parsed once against its block: from the first word on, the longest match in the block that
   has ``window`` words is a factor; the next factor is sought from the first window that crosses the
   end of the last one, which is the check at factor boundaries.  Matches are compared word by word.
5. Factors become duplicate spans, and their words are removed.

Stretches of one block are dealt to as many tasks as their bytes need (``TASK_BYTES``), and the
block's text goes to each of them once.  Hashes only propose: no word goes without a factor, and
a factor is equal words.  A window is missed only if both its 64-bit hashes collide.

Defined cases: null or empty text and fewer words than a window: nothing is removed; a null
doc_id is no smaller than another, its row is neither index nor cut; rows of one doc_id do not
cut each other, whether they repeat a text or hold several (all are blocks for larger ids); an
empty table gives no rows; white space of texts that lose nothing is kept by ``dedup_substrings``
(null stays null); extra columns pass through there, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bundle, drop, stage, unbundle
from .shingles import digest128, inside, ngrams, raw_texts, runs, word_hashes

GRAM = 5
#: Bytes of stretches that one task holds against a block.
TASK_BYTES = 1 << 20
_U = np.uint64


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _lists(parts: list[np.ndarray], kind=np.int64) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.zeros(0, kind)
    flat = flat.view(np.int64) if flat.dtype == _U else flat.astype(kind)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat))


def anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, place) of each window of a sequence of word hashes: the least of its n-grams, whose low bits give way to
    its place in the window."""
    gram = min(GRAM, window)
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    bits = _U((window - gram).bit_length())
    grams = ngrams(words, gram, 3) >> bits << bits
    best = grams[:n].copy()
    for j in range(1, window - gram + 1):
        np.minimum(best, grams[j : j + n] + _U(j), out=best)
    anchor = best >> bits << bits
    return anchor, (best - anchor).astype(np.int64) + np.arange(n)


def _anchored(column: pa.Array, window: int) -> tuple[np.ndarray, ...]:
    """Of all windows of a batch of texts: (text, place in it, anchor, place of the anchor among all words, hash)."""
    words, at = word_hashes(column)
    anchor, origin = anchors(words, window)
    ok = np.flatnonzero(inside(at, window)[: len(anchor)])
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[ok]
    return text, ok - at[text], anchor[ok], origin[ok], ngrams(words, window, 5)[ok]


def _profiles(window: int):
    """(doc_id, h, n_words, k1, k2, anchors) of rows (doc_id, h, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                rows = batch.slice(i, 512)
                split = [x.split() for x in raw_texts(rows.column(2))]
                keys = [digest128(b" ".join(x)) for x in split]
                text, _, anchor, origin, _ = _anchored(rows.column(2), window)
                first = np.r_[True, np.diff(origin) != 0][: len(origin)]
                text, anchor = text[first], anchor[first]
                order = np.lexsort((anchor, text))
                text, anchor = text[order], anchor[order]
                first = np.r_[True, (np.diff(text) != 0) | (anchor[1:] != anchor[:-1])][: len(text)]
                offsets = np.r_[0, np.cumsum(np.bincount(text[first], minlength=rows.num_rows))]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:2], pa.array([len(x) for x in split], pa.int64()), *(pa.array(k, pa.int64()) for k in zip(*keys, strict=True)),
                     pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), _signed(anchor[first]))],
                    names=["doc_id", "h", "n_words", "k1", "k2", "anchors"],
                )

    return run


def _windows(window: int):
    """Windows whose anchor is among the repeated ones, those in a row with one anchor together: (doc_id, h, place,
    anchor, hashes) of rows (doc_id, h, text, anchors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                text, place, anchor, origin, hashes = _anchored(rows.column(2), window)
                at, held = np.searchsorted(text, np.arange(rows.num_rows + 1)), np.zeros(len(text), bool)
                for r in range(rows.num_rows):
                    held[at[r] : at[r + 1]] = np.isin(anchor[at[r] : at[r + 1]], rows.column(3)[r].values.to_numpy(zero_copy_only=False).view(_U))
                held = np.flatnonzero(held)
                if not len(held):
                    continue
                # Of another text, anchor's place or not next to the one before: a new row.
                first = np.flatnonzero(np.r_[True, (np.diff(held) != 1) | (np.diff(origin[held]) != 0) | (np.diff(text[held]) != 0)])
                who, lead = pa.array(text[held[first]]), held[first]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(held)].astype(np.int32)), _signed(hashes[held]))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(who), rows.column(1).take(who), pa.array(place[lead].astype(np.int32)), _signed(anchor[lead]), lists],
                    names=["doc_id", "h", "place", "anchor", "hashes"],
                )

    return run


def stretches(places: np.ndarray, blocks: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(first word, words, block) of runs of indexed windows under one block; places are sorted and distinct."""
    if not len(places):
        return []
    first = np.flatnonzero(np.r_[True, (np.diff(places) != 1) | (np.diff(blocks) != 0)])
    sizes = np.diff(np.r_[first, len(places)]) + window - 1
    return list(zip(places[first].tolist(), sizes.tolist(), blocks[first].tolist(), strict=True))


def _stretches(window: int):
    """(doc_id, h, place, ref, s1, s2, part) of rows (doc_id, h, text, hits)."""
    names = ["doc_id", "h", "place", "ref", "s1", "s2", "part"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                rows = batch.slice(i, 128)
                out = []
                for doc, h, text, hits in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), raw_texts(rows.column(2)), rows.column(3), strict=True):
                    places, refs = (hits.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                    places, at = np.unique(places, return_index=True)
                    words = text.split()
                    for place, size, ref in stretches(places, refs[at], window):
                        part = b" ".join(words[place : place + size])
                        out.append((doc, h, place, ref, *digest128(part), part.decode()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


class Block:
    """A reference block: words of one text, to be matched against."""

    def __init__(self, text: bytes, hashes: np.ndarray, window: int) -> None:
        self.words, self.hashes, self.window = text.split(), hashes, window
        grams = ngrams(hashes, window, 5)
        self.order = np.argsort(grams, kind="stable")
        self.grams = grams[self.order]

    def longest(self, words: list[bytes], hashes: np.ndarray, gram: np.uint64, at: int) -> int:
        """Words of the longest match of ``words`` from ``at`` on that stands in the block; 0 if it has less than a window."""
        best = 0
        lo, hi = (int(np.searchsorted(self.grams, gram, side)) for side in ("left", "right"))
        for place in self.order[lo:hi].tolist():
            n = min(len(hashes) - at, len(self.hashes) - place)
            if n <= best:
                continue
            differ = np.flatnonzero(hashes[at : at + n] != self.hashes[place : place + n])
            n = int(differ[0]) if len(differ) else n
            # Hashes propose, words decide.
            if n > best and n >= self.window and words[at : at + n] == self.words[place : place + n]:
                best = n
        return best


def factors(words: list[bytes], hashes: np.ndarray, blocks: list[Block], window: int) -> list[tuple[int, int]]:
    """Greedy parse of a stretch: (first word, words) of each factor; neighbours overlap by the windows across their boundary."""
    grams, out, at = ngrams(hashes, window, 5), [], 0
    while at < len(grams):
        size = max((b.longest(words, hashes, grams[at], at) for b in blocks), default=0)
        if size:
            out.append((at, size))
        # The first window that is not inside this factor.
        at += max(1, size - window + 1)
    return out


def _parse(window: int):
    """(ref, s1, s2, starts, sizes) of rows (ref, salt, side, s1, s2, part) that come sorted, blocks first."""
    names = ["ref", "s1", "s2", "starts", "sizes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[Block] = []
        for new, rows in runs(batches, 2):
            if new:
                blocks = []
            words, at = word_hashes(rows.column(5))
            found = []
            for r, (side, text) in enumerate(zip(rows.column(2).to_pylist(), raw_texts(rows.column(5)), strict=True)):
                hashes = words[at[r] : at[r + 1]]
                if side == 0:
                    blocks.append(Block(text, hashes, window))
                else:
                    found.append((r, np.array(factors(text.split(), hashes, blocks, window), np.int64).reshape(-1, 2)))
            if found:
                mine = rows.take(pa.array([r for r, _ in found]))
                yield pa.RecordBatch.from_arrays([mine.column(0), mine.column(3), mine.column(4), _lists([f[:, 0] for _, f in found]), _lists([f[:, 1] for _, f in found])], names=names)

    return run


def keep_mask(n_words: int, spans: np.ndarray) -> np.ndarray:
    """Which words no factor covers; factors may overlap."""
    turn = np.zeros(n_words + 1, np.int64)
    np.add.at(turn, spans[:, 0], 1)
    np.add.at(turn, spans[:, 0] + spans[:, 1], -1)
    return np.cumsum(turn[:-1]) == 0


def with_key(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text): ``h`` tells the texts of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")


def duplicate_spans(docs: DataFrame, window: int = 13) -> tuple[DataFrame, DataFrame]:
    """(copies, spans): doc_id, h of documents that are copies as a whole; doc_id, h, starts, sizes of the factors of
    the others that have any."""
    docs = with_key(docs)
    profiles = stage(docs.mapInArrow(_profiles(window), "doc_id long, h long, n_words long, k1 long, k2 long, anchors array<long>"), "profiles")
    whole = profiles.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    first = stage(whole.groupBy("k1", "k2", "n_words").agg(F.min("doc_id").alias("first_id")), "word-classes")
    named = whole.select("doc_id", "h", "k1", "k2", "n_words").join(first, ["k1", "k2", "n_words"])
    named = stage(named.select("doc_id", "h", (F.col("doc_id") > F.col("first_id")).alias("is_copy")).distinct(), "copies")
    firsts = named.where("not is_copy").select("doc_id", "h")
    held = whole.join(firsts, ["doc_id", "h"], "left_semi").select("doc_id", "h", F.explode("anchors").alias("anchor"))
    twice = held.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    twice = stage(twice, "repeated-anchors")
    marked = held.join(twice, "anchor", "left_semi").groupBy("doc_id", "h").agg(F.collect_set("anchor").alias("anchors"))
    marked = stage(marked, "marked-documents")
    drop(profiles, first, twice)
    found = docs.join(marked, ["doc_id", "h"]).select("doc_id", "h", "text", "anchors")
    windows = stage(found.mapInArrow(_windows(window), "doc_id long, h long, place int, anchor long, hashes array<long>"), "windows")
    each = windows.select("anchor", F.posexplode("hashes").alias("k", "hash"), "doc_id", "h", "place")
    index = each.groupBy("anchor", "hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    index = stage(index.select("anchor", "hash", "lo"), "window-index")
    hits = each.join(index, ["anchor", "hash"]).where("doc_id > lo").groupBy("doc_id", "h")
    hits = stage(hits.agg(F.collect_set(F.struct((F.col("place") + F.col("k")).alias("place"), F.col("lo").alias("ref"))).alias("hits")), "hits")
    drop(marked, windows, index)
    # A repeated row gives its stretches again; both lead to the same spans.
    parts = docs.join(hits, ["doc_id", "h"]).select("doc_id", "h", "text", "hits")
    parts = stage(parts.mapInArrow(_stretches(window), "doc_id long, h long, place int, ref long, s1 long, s2 long, part string"), "stretches")
    drop(hits)
    asked = stage(parts.groupBy("ref", "s1", "s2").agg(F.first("part").alias("part")), "different-stretches")
    loads = asked.groupBy("ref").agg(F.ceil(F.sum(F.octet_length("part")) / TASK_BYTES).cast("int").alias("tasks"))
    loads = stage(loads, "block-loads")
    blocks = docs.join(loads, docs.doc_id == loads.ref).groupBy("ref", "tasks", "h").agg(F.first("text").alias("text"))
    blocks = blocks.select("ref", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("salt"), "h", "text")
    blocks = blocks.select("ref", "salt", F.lit(0).alias("side"), F.col("h").alias("s1"), F.lit(0).cast("long").alias("s2"), F.col("text").alias("part"))
    asked_of = asked.join(loads, "ref").select("ref", F.pmod("s1", "tasks").cast("int").alias("salt"), F.lit(1).alias("side"), "s1", "s2", "part")
    dealt = blocks.unionByName(asked_of).repartition("ref", "salt").sortWithinPartitions("ref", "salt", "side", "s1")
    parsed = stage(dealt.mapInArrow(_parse(window), "ref long, s1 long, s2 long, starts array<long>, sizes array<long>"), "factors")
    drop(asked, loads)
    spans = parts.select("doc_id", "h", "place", "ref", "s1", "s2").distinct().join(parsed, ["ref", "s1", "s2"])
    spans = spans.select("doc_id", "h", F.explode(F.zip_with("starts", "sizes", lambda x, n: F.struct((x + F.col("place")).alias("start"), n.alias("size")))).alias("f"))
    spans = spans.groupBy("doc_id", "h").agg(F.collect_list("f").alias("f"))
    spans = stage(spans.select("doc_id", "h", F.col("f.start").alias("starts"), F.col("f.size").alias("sizes")), "spans")
    drop(parts, parsed)
    return named.where("is_copy").select("doc_id", "h"), spans


def dedup_substrings(docs: DataFrame, window: int = 13) -> DataFrame:
    """``docs`` with ``text`` without the words of duplicate spans (the rest joined by one space), ``n_words``
    before and ``n_removed``; texts that lose nothing stay as they are."""
    keep, new = ("doc_id", "text"), ("n_words", "n_removed")
    rest = bundle(docs, keep, new)
    copies, spans = duplicate_spans(rest, window)
    none = F.lit(None).cast("array<long>")
    cuts = copies.select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h"), none.alias("_starts"), none.alias("_sizes")).unionByName(
        spans.select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h"), F.col("starts").alias("_starts"), F.col("sizes").alias("_sizes"))
    )
    on = (rest.doc_id.cast("long") == F.col("_doc")) & (F.xxhash64(rest.text) == F.col("_h"))
    names = rest.columns
    joined = rest.join(cuts, on, "left").select(*names, F.col("_doc").isNotNull().alias("_cut"), "_starts", "_sizes")
    at = names.index("text")
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in rest.schema.fields), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                texts, n_words, removed = rows.column(at).to_pylist(), [], []
                for r, (raw, cut, starts, sizes) in enumerate(zip(raw_texts(rows.column(at)), rows.column(len(names)).to_pylist(), rows.column(len(names) + 1), rows.column(len(names) + 2), strict=True)):
                    own = raw.split()
                    n_words.append(len(own))
                    removed.append(0)
                    if cut:
                        spans = np.stack([x.values.to_numpy(zero_copy_only=False) for x in (starts, sizes)], axis=1) if starts.is_valid else np.array([[0, len(own)]])
                        kept = keep_mask(len(own), spans)
                        texts[r] = b" ".join([x for x, k in zip(own, kept, strict=True) if k]).decode()
                        removed[r] = len(own) - int(kept.sum())
                columns = [*rows.columns[: len(names)], pa.array(n_words, pa.int64()), pa.array(removed, pa.int64())]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_words", "n_removed"])

    return joined.mapInArrow(run, schema).select(*unbundle(docs, keep, new), *new)


def digest(result: DataFrame) -> DataFrame:
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return result.select("doc_id", "n_words", "n_removed", F.sha2(words.cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS gram FROM p),
f AS (SELECT gram, min(doc_id) AS first_id FROM g GROUP BY gram),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM g JOIN f USING (gram) WHERE doc_id > first_id),
k AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
o AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS n_kept FROM k ANTI JOIN c USING (doc_id, k) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN o ON w.doc_id = o.doc_id
"""
