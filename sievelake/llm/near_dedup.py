"""MinHash near-dedup with odd sketches.

1. One pass over the texts makes, per document, its set's size and fingerprint (128 bits of a
   cryptographic hash over the set's 64-bit hashes), 160 MinHash samples as 32 band keys of 5, and an
   odd sketch: one MinHash sample from each of 1024 hash ranges, every sample turning one of 2048
   bits.  Documents with the same set are one class, represented by a text of its smallest id.
2. Representatives that share a band key are candidates.  Every member of a bucket is paired
   with the bucket's smallest (a link per member, not a pair per pair); the population count of
   the XOR of two sketches estimates how many samples differ, and pairs well below the
   threshold go.  The rest are confirmed on their full sets: by hashes first, then by the words themselves.
   A hub's text goes once to each task that holds pairs of it.
3. Links make components.  Where a bucket's members are in one component by now, nothing more can
   be learnt from it.  In the others, sketches are compared in blocks inside a task; members with
   a partner of another component whose sketch admits it get their texts, and pairs of
   different components, the most similar first, are confirmed on their full sets; a link spares all
   pairs that it makes superfluous.  No bucket is emitted as pairs, and none is capped: a large one is more blocks.

What may be lost is stated, not capped: a pair of similarity 0.8 shares no band with probability
(1 - 0.8**5)**32 = 3e-6, and the sketch limit is ``sigmas`` (5) standard deviations, measured ones, below the
threshold.  ``sigmas=math.inf`` confirms every candidate pair on its full sets.

Defined cases: null or empty text and text without words has an empty set and is linked with nothing;
rows with one doc_id are one node, linked by whatever any of its texts is linked with (repeated rows are
kept or dropped together); a row with null doc_id is linked with nothing, has a null component and is kept;
ties in similarity link if the threshold is met exactly; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stage
from .components import components
from .shingles import digest128, inside, mix, ngrams, raw_texts, runs, shingle_set, word_hashes

BANDS, ROWS = 32, 5
RANGES, BITS = 1024, 2048
_U = np.uint64
_FACTORS = mix(np.arange(BANDS * ROWS, dtype=_U), 11) | _U(1)
#: Members, and shingles of all members, that a block of a bucket holds at most; pairs of one hub that one task confirms.
BLOCK, BLOCK_SHINGLES, HUB_PAIRS = 1024, 1 << 20, 1024


def minhash(values: np.ndarray) -> np.ndarray:
    """The samples of a set of hashes, taken in runs so that a long set needs no more memory."""
    low = np.full(len(_FACTORS), ~_U(0))
    for i in range(0, len(values), 4096):
        np.minimum(low, np.multiply.outer(_FACTORS, values[i : i + 4096]).min(axis=1), out=low)
    return low


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=_U)
    for j in range(ROWS):
        keys = mix(keys ^ samples.reshape(BANDS, ROWS)[:, j], 20 + j)
    return keys


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """Parity of the samples (the least hash of each range that has one) on each of the bits."""
    low = np.full(RANGES, ~_U(0))
    place = (values & _U(RANGES - 1)).astype(np.int64)
    np.minimum.at(low, place, mix(values, 31))
    filled = np.flatnonzero(low != ~_U(0))
    bits = mix(low[filled] ^ (filled.astype(_U) << _U(40)), 32) % _U(BITS)
    return np.packbits((np.bincount(bits.astype(np.int64), minlength=BITS) & 1).astype(np.uint8))


def sketch_limit(a, b, t: float, sigmas: float = 5.0):
    """The most differing bits, ``sigmas`` standard deviations included, of the sketches of two sets of a and b shingles
    whose similarity is t.  For numbers or arrays."""
    if math.isinf(sigmas):
        return np.full(np.shape(a), BITS)
    filled = lambda n: RANGES * (1 - np.exp(n * np.log1p(-1 / RANGES)))
    union = (a + b) / (1 + t)
    ranges = filled(union)
    differ = np.maximum(filled(a) + filled(b) - 2 * t * ranges, 0)
    # Ranges of one element say exactly what they hold; those of more are a sample.
    spread = np.minimum(4 * t * (1 - t) * ranges, 1.2 * ((a + b) * (1 - t) / (1 + t) * union / RANGES + 1))
    reach = differ + sigmas * np.sqrt(spread + 2 * differ * differ / BITS)
    return np.ceil(BITS / 2 * (1 - np.exp(-2 * reach / BITS)))


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, h, n_shingles, f1, f2, bands, sketch) of each row of ``docs`` (doc_id, h, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                rows = batch.slice(i, 512)
                words, at = word_hashes(rows.column(2), lower=True)
                grams, whole = ngrams(words, shingle, shingle), inside(at, shingle)
                n, f1, f2, bands, sketches = [], [], [], [], []
                for a, b in zip(at[:-1], at[1:], strict=True):
                    values = np.unique(grams[a : b - shingle + 1]) if b - a >= shingle and whole[a] else shingle_set(words[a:b], shingle)
                    k1, k2 = digest128(values.tobytes())
                    n.append(len(values))
                    f1.append(k1)
                    f2.append(k2)
                    bands.append(band_keys(minhash(values)) if len(values) else np.zeros(0, _U))
                    sketches.append(odd_sketch(values).tobytes())
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, bands)]), pa.int32()), pa.array(np.concatenate(bands).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:2], *(pa.array(x, pa.int64()) for x in (n, f1, f2)), lists, pa.array(sketches, pa.binary())],
                    names=["doc_id", "h", "n_shingles", "f1", "f2", "bands", "sketch"],
                )

    return docs.mapInArrow(run, "doc_id long, h long, n_shingles long, f1 long, f2 long, bands array<long>, sketch binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct values."""
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


class FullSet:
    """A text's shingles, as hashes and, when asked, as words."""

    def __init__(self, text: bytes, hashes: np.ndarray, shingle: int) -> None:
        self.text, self.shingle, self.words = text, shingle, None
        self.values = shingle_set(hashes, shingle)

    def in_words(self) -> set:
        if self.words is None:
            w = self.text.lower().split()  # of bytes: A-Z only, and the six characters of white space
            n = min(self.shingle, len(w))
            self.words = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        return self.words

    def links(self, other: FullSet, percent: int) -> bool:
        if not similar(self.values, other.values, percent):
            return False
        a, b = self.in_words(), other.in_words()
        return 100 * len(a & b) >= percent * len(a | b)


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, uf, v, vf) whose full sets are similar enough; ``texts`` (rep, f, text)."""
    loads = stage(pairs.groupBy("u", "uf").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).cast("int").alias("tasks")), "hub-loads")
    hubs = texts.join(loads, (texts.rep == loads.u) & (texts.f == loads.uf)).select("u", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("salt"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("v"), "text")
    others = pairs.join(loads, ["u", "uf"]).select("u", F.pmod(F.xxhash64("v", "vf"), "tasks").cast("int").alias("salt"), F.lit(1).alias("side"), "v", "vf")
    others = others.join(texts, (others.v == texts.rep) & (others.vf == texts.f)).select("u", "salt", "side", "v", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: list[FullSet] = []
        for new, rows in runs(batches, 2):
            if new:
                mine = []
            words, at = word_hashes(rows.column(4), True)
            keep = []
            for r, (side, text) in enumerate(zip(rows.column(2).to_pylist(), raw_texts(rows.column(4)), strict=True)):
                full = FullSet(text, words[at[r] : at[r + 1]], shingle)
                if side == 0:
                    mine.append(full)
                keep.append(side == 1 and any(m.links(full, percent) for m in mine))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(3)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    both = hubs.unionByName(others).repartition("u", "salt").sortWithinPartitions("u", "salt", "side")
    return both.mapInArrow(run, "u long, v long")


def screen(pairs: DataFrame, percent: int, sigmas: float) -> DataFrame:
    """Those of ``pairs`` (u, uf, v, vf, n, m, x, y: texts, set sizes, sketches) that the sketches admit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(i).to_numpy().astype(float) for i in (4, 5))
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), _U).reshape(len(n), -1) for i in (6, 7))
                differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                ok = (differ <= sketch_limit(n, m, percent / 100, sigmas)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
                yield batch.select(["u", "uf", "v", "vf"]).filter(pa.array(ok))

    return pairs.select("u", "uf", "v", "vf", "n", "m", "x", "y").mapInArrow(run, "u long, uf long, v long, vf long")


def _admitted(side: np.ndarray, comp: np.ndarray, n: np.ndarray, bits: np.ndarray, one: bool, percent: int, sigmas: float) -> tuple[np.ndarray, ...]:
    """(bits that differ, x, y) of the pairs of rows of different components that the sketches admit; of one block, or of two."""
    t = percent / 100
    left = np.arange(len(side)) if one else np.flatnonzero(side == 0)
    right = left if one else np.flatnonzero(side == 1)
    found, most = [np.zeros((3, 0), np.int64)], int(sketch_limit(int(n.max()), int(n.max()), t, sigmas))  # it grows with the sizes
    for i in range(0, len(left), 128):
        part = left[i : i + 128]
        far = (comp[part][:, None] != comp[right][None, :]) & (100 * np.minimum(n[part][:, None], n[right][None, :]) >= percent * np.maximum(n[part][:, None], n[right][None, :]))
        if one:
            far &= part[:, None] < right[None, :]
        z = np.zeros(far.shape, np.uint16)
        for w in range(bits.shape[1]):
            z += np.bitwise_count(bits[part, w][:, None] ^ bits[right, w][None, :])
        x, y = np.nonzero(far & (z <= most))
        z, x, y = z[x, y].astype(np.int64), part[x], right[y]
        ok = z <= sketch_limit(n[x], n[y], t, sigmas)
        found.append(np.stack([z[ok], x[ok], y[ok]]))
    return tuple(np.concatenate(found, axis=1))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Rows (band, i, j, ...), which come sorted, of one block or of two to be held against each other."""
    rows: list = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and r[:3] != rows[0][:3]:
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


def _pairs_of(rows: list, percent: int, sigmas: float) -> tuple[np.ndarray, ...]:
    side, comp, n = (np.array([r[k] for r in rows], np.int64) for k in (3, 6, 7))
    bits = np.frombuffer(b"".join(r[8] for r in rows), _U).reshape(len(rows), -1)
    return comp, n, *_admitted(side, comp, n, bits, rows[0][1] == rows[0][2], percent, sigmas)


def _with_partner(percent: int, sigmas: float):
    """Of rows (band, i, j, side, rep, f, comp, n, sketch) those that a sketch admits a pair for."""
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            *_, x, y = _pairs_of(rows, percent, sigmas)
            if len(x):
                out = [rows[k] for k in np.unique(np.r_[x, y])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["band", "i", "j", "side", "rep", "f", "comp", "n", "sketch"])

    return run


def _links_in_blocks(shingle: int, percent: int, sigmas: float):
    """Links (u, v) between components, from rows (band, i, j, side, rep, f, comp, n, sketch, text)."""

    def links(rows: list) -> list[tuple[int, int]]:
        comp, n, z, x, y = _pairs_of(rows, percent, sigmas)
        parent: dict[int, int] = {}
        sets: dict[int, FullSet] = {}

        def root(c: int) -> int:
            while (p := parent.get(c, c)) != c:
                parent[c] = c = parent.get(p, p)
            return c

        def full(k: int) -> FullSet:
            if k not in sets:
                sets[k] = FullSet(rows[k][9].encode(), word_hashes(pa.array([rows[k][9]], pa.string()), True)[0], shingle)
            return sets[k]

        out = []
        for k in np.argsort(z * 4096 // (n[x] + n[y] + 1), kind="stable"):
            a, b = root(int(comp[x[k]])), root(int(comp[y[k]]))
            if a != b and full(int(x[k])).links(full(int(y[k])), percent):
                parent[a] = b
                out.append((rows[x[k]][4], rows[y[k]][4]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            if out := links(rows):
                u, v = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, sigmas: float = 5.0) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")
    sig = stage(signatures(docs, shingle), "signatures")
    real = sig.where("n_shingles > 0 and doc_id is not null")
    classes = stage(real.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep")), "set-classes")
    chosen = classes.select(F.col("rep").alias("doc_id"), "f1", "f2")
    reps = real.join(chosen, ["doc_id", "f1", "f2"], "left_semi").dropDuplicates(["doc_id", "f1", "f2"])
    # A class is told by its smallest id and, as an id may have several texts, half of its fingerprint.
    reps = stage(reps.select(F.col("doc_id").alias("rep"), F.col("f1").alias("f"), "h", F.col("n_shingles").alias("n"), "bands", "sketch"), "representatives")
    buckets = reps.select("rep", "f", "n", F.explode("bands").alias("band"))
    hubs = stage(buckets.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("most")).where("hub < most").select("band", "hub"), "buckets")
    members = stage(buckets.join(hubs, "band"), "bucket-members")
    drop(hubs)
    pairs = members.where("rep <> hub").select(F.col("hub").alias("u"), F.col("rep").alias("v"), F.col("f").alias("vf")).distinct()
    # Of a hub with several texts one stands for it here; the blocks below compare all of them.
    left = reps.join(reps.groupBy("rep").agg(F.min("f").alias("f")), ["rep", "f"], "left_semi")
    left = left.select(F.col("rep").alias("u"), F.col("f").alias("uf"), "n", F.col("sketch").alias("x"))
    right = reps.select(F.col("rep").alias("v"), F.col("f").alias("vf"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    pairs = stage(screen(pairs.join(left, "u").join(right, ["v", "vf"]), percent, sigmas), "hub-pairs")
    # Texts of all that are in a bucket with others, once: what later confirmations join is this part only.
    wanted = reps.join(members.select("rep", "f").distinct(), ["rep", "f"], "left_semi").select(F.col("rep").alias("doc_id"), "h", "f")
    texts = docs.join(wanted, ["doc_id", "h"]).groupBy("doc_id", "h", "f").agg(F.first("text").alias("text"))
    texts = stage(texts.select(F.col("doc_id").alias("rep"), "f", "text"), "candidate-texts")
    links = stage(confirm(pairs, texts, shingle, percent).distinct(), "links")
    roots = components(links)
    named = members.join(roots.select(F.col("node").alias("rep"), F.col("root")), "rep", "left").select("band", "rep", "f", "n", F.coalesce("root", "rep").alias("comp"))
    named = stage(named, "named-members")
    drop(members, pairs)
    mixed = named.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles")).where("lo < hi")
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    mixed = stage(mixed.select("band", blocks.alias("blocks")), "mixed-buckets")
    if not mixed.isEmpty():
        rows = named.join(mixed, "band").withColumn("b", F.pmod(F.xxhash64("rep", "f"), F.col("blocks")).cast("int"))
        # Block b meets the blocks before it from the right and the others from the left.
        meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
            F.least(F.col("b"), o).alias("i"), F.greatest(F.col("b"), o).alias("j"), (F.col("b") > o).cast("int").alias("side")))
        rows = rows.join(reps.select("rep", "f", "sketch"), ["rep", "f"]).select("band", F.inline(meet), "rep", "f", "comp", "n", "sketch")
        place = ["band", "i", "j"]
        dealt = lambda df: df.repartition(*place).sortWithinPartitions(*place)
        light = rows.select(*place, "side", "rep", "f", "comp", "n", "sketch")
        light = stage(dealt(light).mapInArrow(_with_partner(percent, sigmas), light.schema), "admitted-members")
        full = light.join(texts, ["rep", "f"]).select(*light.columns, "text")
        more = stage(dealt(full).mapInArrow(_links_in_blocks(shingle, percent, sigmas), "u long, v long").distinct(), "block-links")
        drop(light)
        if not more.isEmpty():
            drop(roots)
            roots = components(links.unionByName(more))
        drop(more)
    drop(reps, texts, links, named, mixed)
    named = sig.select("doc_id", "n_shingles", "f1", "f2").join(classes, ["f1", "f2", "n_shingles"], "left")
    named = named.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("root", "rep"))
    out = named.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


#: For the query's 4 words and 80 per cent.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
      HAVING 100 * count(*) >= 80 * ((SELECT n FROM n WHERE n.doc_id = a.doc_id) + (SELECT n FROM n WHERE n.doc_id = b.doc_id) - count(*))),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT u AS node, v AS reached FROM e UNION SELECT r.node, e.v FROM r JOIN e ON r.reached = e.u),
c AS (SELECT node, min(least(node, reached)) AS root FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, w.doc_id) AS component_id, coalesce(root, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id
"""
