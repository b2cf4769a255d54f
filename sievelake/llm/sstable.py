"""Token ids in sorted-string-table shards.

Documents are range-partitioned and sorted by doc_id; each partition becomes one file:

    data blocks    entries (shared, unshared, value size as varints; key suffix; value), where
                   ``shared`` bytes of the key are those of the key before it in the block
    block index    per block: last key, offset and size
    Bloom filter   one byte of hash count, then the bits, over all keys
    footer         offsets and sizes of index and filter, entries, ids, magic (fixed size)

A key is the doc_id as 8 big-endian bytes with the sign bit turned, so bytes sort as numbers; a
null doc_id has the empty key and sorts first.  A value is a byte of width (2 or 4) and the
little-endian ids.  A lookup asks the filter, searches the index by halves, and reads one block.

Every attempt of a task writes a file of its own, under a name no other has; the manifest, written
when all are done, says which count, so a task can run again at any time and nothing is renamed.
Files go to the folder given, by default one below ``spark.checkpoint.dir``, through the
filesystem of its URI.  There are as many as the texts need at ``shard_bytes`` each.

Defined cases: null text is empty and has only its end token; the string of an added token in a
text is that token, as in the tokenizers library with add_special_tokens=False; rows with one doc_id stay
neighbours, sorted by a hash of their text, and a lookup returns the first; an empty table
writes shards without entries and reads back no rows; columns other than doc_id and text are
not stored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import id_lists
from .common import new_path, stage

MAGIC = b"SLSSTB01"
FOOTER = struct.Struct("<QQQQQQ8s")
BLOCK_BYTES, BITS_PER_KEY, HASHES = 1 << 15, 10, 7
#: Bytes of text for one file.
SHARD_BYTES = 1 << 25
#: Words that a worker remembers in each of two generations: a bound on memory that no result depends on.
MEMO_WORDS = 3 << 18


def encode_key(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def decode_key(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def probes(hashed: np.ndarray, n_bits: int, hashes: int = HASHES) -> np.ndarray:
    """Places of the bits, a row for each hashed key."""
    a, b = hashed & np.uint64(0xFFFFFFFF), hashed >> np.uint64(32) | np.uint64(1)
    return (a[:, None] + np.arange(hashes, dtype=np.uint64) * b[:, None]) % np.uint64(n_bits)


class Writer:
    """Writes entries that come in key order."""

    def __init__(self, sink) -> None:
        self.sink, self.at = sink, 0
        self.block, self.last, self.index = bytearray(), b"", []
        self.hashed = array("Q")
        self.n_ids = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if len(self.block) >= BLOCK_BYTES:
            self._flush()
        width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
        value = bytes([width]) + ids.astype(f"<u{width}").tobytes()
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.hashed.append(xxhash.xxh64_intdigest(key))
        self.n_ids += len(ids)

    def _flush(self) -> None:
        if self.block:
            self.index.append((self.last, self.at, len(self.block)))
            self._write(bytes(self.block))
            self.block = bytearray()

    def _write(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def close(self) -> None:
        self._flush()
        index_at = self.at
        self._write(b"".join(varint(len(k)) + k + varint(o) + varint(n) for k, o, n in self.index))
        bloom_at = self.at
        n_bits = max(64, len(self.hashed) * BITS_PER_KEY)
        bits, hashed = np.zeros(n_bits, bool), np.frombuffer(self.hashed, np.uint64)
        for i in range(0, len(hashed), 1 << 16):
            bits[probes(hashed[i : i + (1 << 16)], n_bits).ravel()] = True
        self._write(bytes([HASHES]) + struct.pack("<Q", n_bits) + np.packbits(bits, bitorder="little").tobytes())
        self._write(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, self.at - bloom_at, len(self.hashed), self.n_ids, MAGIC))


class Reader:
    """One shard: lookups by binary search, or all entries in order."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        self.index_at, n_index, bloom_at, n_bloom, self.n_entries, self.n_ids, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        self.bloom, raw, at, self.index = self._at(bloom_at, n_bloom), self._at(self.index_at, n_index), 0, []
        while at < len(raw):
            n, at = read_varint(raw, at)
            key, at = raw[at : at + n], at + n
            offset, at = read_varint(raw, at)
            length, at = read_varint(raw, at)
            self.index.append((key, offset, length))

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def may_hold(self, key: bytes) -> bool:
        n_bits, bits = struct.unpack_from("<Q", self.bloom, 1)[0], memoryview(self.bloom)[9:]
        at = probes(np.array([xxhash.xxh64_intdigest(key)], np.uint64), n_bits, self.bloom[0])[0].tolist()
        return all(bits[p >> 3] >> (p & 7) & 1 for p in at)

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, length = self.index[i]
        raw, at, key = self._at(offset, length), 0, b""
        while at < length:
            shared, at = read_varint(raw, at)
            n, at = read_varint(raw, at)
            size, at = read_varint(raw, at)
            key, at = key[:shared] + raw[at : at + n], at + n
            yield key, np.frombuffer(raw, f"<u{raw[at]}", (size - 1) // raw[at], at + 1).astype("<u4")
            at += size

    def entries(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        import bisect

        key = encode_key(doc_id)
        if not self.may_hold(key):
            return None
        i = bisect.bisect_left(self.index, key, key=lambda x: x[0])
        return next((ids for k, ids in self.block(i) if k == key), None) if i < len(self.index) else None


#: Splits a word of the plain kind as the tokenizer's own pre-tokeniser does, lower-cased.
PIECES = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"
#: Words of these characters need no normal form and no tokenizer: neither control nor space characters are among them.
PLAIN = r"[!-~\u00a1-\u017f]+"


def byte_symbols() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of texts under a lower-casing tokenizer whose pre-tokens never cross white space, so that each word is encoded once.

    Words used of late are kept: the older generation goes when the younger is full.  Plain words are
    merged by a rank table made from the tokenizer's vocabulary, in which byte 1 stands for the end of
    a word; other words, and all if the ids don't follow the merges, go through the tokenizer, and so do
    whole texts that hold the string of an added token."""

    def __init__(self, path: str) -> None:
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, self.added = whole["model"], [t["content"] for t in whole["added_tokens"]]
        vocab, end, symbols = model["vocab"], model["end_of_word_suffix"], byte_symbols()
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        raw = lambda t: bytes(symbols[c] for c in t.removesuffix(end)) + (b"\x01" if t.endswith(end) else b"")
        ranks = {raw(t): i for t, i in vocab.items() if all(c in symbols for c in t.removesuffix(end))}
        ordered = all(vocab.get(m) == 512 + i for i, m in enumerate(merges)) and all(len(t) <= 2 for t, i in ranks.items() if i < 512)
        self.plain = regex.compile(PLAIN) if ordered and bytes([2]) in ranks else None
        self.pieces = regex.compile(PIECES)
        self.gap = ranks.get(b"\x02")
        self.merger = tiktoken.Encoding("words", pat_str=r"[^\x01\x02]+\x01|\x02", mergeable_ranks=ranks, special_tokens={}) if self.plain else None

    def _learn(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 50_000):
            part = [w.decode() for w in words[i : i + 50_000]]
            plain = [bool(self.plain and self.plain.fullmatch(w)) for w in part]
            for kind, encode in ((True, self._merge), (False, self._tokenize)):
                if mine := [w for w, p in zip(part, plain, strict=True) if p is kind]:
                    self.young.update(zip(map(str.encode, mine), encode(mine), strict=True))

    def _merge(self, words: list[str]) -> Iterator[bytes]:
        """Plain words as one text, a gap byte behind each."""
        ids = np.array(self.merger.encode_ordinary(self.pieces.sub("\\1\x01", "\n".join(words).lower()).replace("\n", "\x02") + "\x02"), "<u4")
        ends = np.flatnonzero(ids == self.gap)
        starts = np.r_[0, ends[:-1] + 1]
        raw = ids.tobytes()
        return map(raw.__getitem__, map(slice, (starts * 4).tolist(), (ends * 4).tolist()))

    def _tokenize(self, words: list[str]) -> Iterator[bytes]:
        """Words as one text, the ids dealt out by where they begin."""
        got = self.tokenizer.encode("\n".join(words), add_special_tokens=False)
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])[:-1]
        first = np.fromiter((o[0] for o in got.offsets), np.int64, len(got.ids))
        cuts = np.searchsorted(first, starts)
        raw, cuts = np.array(got.ids, "<u4").tobytes(), [*(cuts * 4).tolist(), 4 * len(first)]
        return map(raw.__getitem__, map(slice, cuts[:-1], cuts[1:]))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        # ASCII letters and white space only; others stay for the tokenizer, which lower-cases as well.
        added = {i: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4") for i, t in enumerate(texts) if any(x in t for x in self.added)}
        split = [[] if i in added else t.encode().lower().split() for i, t in enumerate(texts)]
        if len(self.young) > MEMO_WORDS:
            self.young, self.old = {}, self.young
        missing = set().union(*split).difference(self.young)
        known = missing.intersection(self.old)
        self.young.update((w, self.old[w]) for w in known)
        self._learn(list(missing - known))
        ids = self.young.__getitem__
        return [added[i] if i in added else np.frombuffer(b"".join(map(ids, words)), "<u4") for i, words in enumerate(split)]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_words(texts: list[str], path: str) -> list[np.ndarray]:
    return word_encoder(path)(texts)


def by_bytes(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch (doc_id, text) with about ``size`` characters each."""
    import pyarrow.compute as pc

    group = np.cumsum(pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False)) // size
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
    for a, b in zip(starts, [*starts[1:], len(group)], strict=True):
        yield batch.slice(a, b - a)


def write_shards(
    spark: SparkSession,
    docs: DataFrame,
    encode: Callable[[list[str]], list[np.ndarray]] | None = None,
    end_id: int = 2,
    folder: str | None = None,
    n_shards: int | None = None,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Encode and write ``docs``; the manifest (shard, file, n_docs, n_ids), a row per file."""
    path = public_tokenizers.path("word_bpe_49k.json")
    encode = encode or (lambda texts: encode_words(texts, path))
    folder = folder or new_path(spark, "shards")
    if not n_shards:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        n_shards = max(1, -(-size // shard_bytes))
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    docs = docs.repartitionByRange(n_shards, "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        shard = context.partitionId()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{base}/shard-{shard:06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.sst"
        with store.open_output_stream(name) as sink:
            writer = Writer(sink)
            for batch in batches:
                for rows in by_bytes(batch, 4 << 20):
                    for doc, ids in zip(rows.column(0).to_pylist(), encode(rows.column(1).to_pylist()), strict=True):
                        writer.add(encode_key(doc), np.append(ids, np.uint32(end_id)))
            writer.close()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "n_docs": [len(writer.hashed)], "n_ids": [writer.n_ids]})

    return stage(docs.mapInArrow(run, "shard long, file string, n_docs long, n_ids long"), "manifest")


def read_shards(spark: SparkSession, manifest: DataFrame, folder_uri: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) read from the files; ``start`` counts the ids of all entries before."""
    at, rows = 0, []
    for shard, file, n_ids in manifest.where("n_docs > 0").select("shard", "file", "n_ids").orderBy("shard").collect():  # a row per file
        rows.append((shard, file, at))
        at += n_ids
    uri = folder_uri or spark.conf.get("spark.checkpoint.dir")
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("at").to_pylist(), strict=True):
                with store.open_input_file(file) as source:
                    reader = Reader(source)
                    for i in range(len(reader.index)):
                        out, parts = [], []
                        for key, ids in reader.block(i):
                            out.append((decode_key(key), start, len(ids), zlib.crc32(ids.tobytes())))
                            parts.append(ids)
                            start += len(ids)
                        columns = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)]
                        yield pa.RecordBatch.from_arrays(columns + [id_lists(parts)] * with_ids, names=names)

    files = spark.createDataFrame(rows, "shard long, file string, at long").repartition(max(1, len(rows)), "shard")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
