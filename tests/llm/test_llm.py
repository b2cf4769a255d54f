"""The training-data operators against brute force, and their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from sievelake.llm import ann, bpe, chat, components, line_dedup, lm_score, near_dedup, packing, quality, shingles, sstable, substring_dedup
from sievelake.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
sha = lambda b: hashlib.sha256(b).hexdigest()


def rng_text(rng, n, words=("the", "of", "and", "to", "in", "cat", "dog", "Éte", "x1", "sun,", "end.")):
    return "".join(rng.choice(words) + rng.choice((" ", " ", " ", "\n", "  ")) for _ in range(n))


def thue_morse(n, flip):
    """Words that a polynomial modulo a power of two can't tell apart."""
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


def corpus():
    """Copies, near copies, shared passages, short and empty texts, nulls, repeated rows."""
    rng = random.Random(3)
    fresh = lambda n: " ".join(f"{rng.choice('abcdefghijk')}{rng.randint(0, 400)}" for _ in range(n))
    passage, base = fresh(30), fresh(120).split()
    texts = [fresh(rng.randint(1, 80)) for _ in range(40)] + [" ".join(base)] * 3
    for k in range(25):
        w = base[:]
        for _ in range(k % 9):
            w[rng.randrange(len(w))] = f"new{k}"
        texts.append(" ".join(w))
    texts += [f"{fresh(20)} {passage} {fresh(k)}" for k in range(8)] + ["", "   ", None, "one", "One", "a b c", "A b  c", passage, passage.upper()]
    texts += ["\n".join(["same line here", "second line", "third", "tail"] * 3 + [fresh(3)]) for _ in range(4)]
    rng.shuffle(texts)
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]


ROWS = corpus()
#: Strings of added tokens, whole, in a text, cut and in capitals.
SPECIAL = ["<|endoftext|>", "a <|endoftext|> b", "A<|startoftext|>B <|endoftext|><|endoftext|>", "<|endof text|>", "<|ENDOFTEXT|> x"]


@pytest.fixture(scope="session")
def docs(spark):
    """With a repeated row and columns that clash with ours."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.repartition(3).withColumns({c: F.lit("mine") for c in ("n_words", "kept", "ids", "extra", "_gone", "_lines", "_rest", "_words", "_cuts", "_doc", "hash", "body")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1 -----------------------------------------------------------------------------------------------


def lines_by_hand(rows, divisor=4):
    h = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:7], 16)
    seen, out = set(), {}
    for i, t in rows:
        if t is None:
            out[i] = (0, 0, None)
            continue
        lines = t.split("\n")
        hs, start, keep = [0, 0, *map(h, lines)], 0, []
        for k in range(len(lines)):
            if k == len(lines) - 1 or (hs[k] * 961 + hs[k + 1] * 31 + hs[k + 2]) % divisor == 0:
                chunk = lines[start : k + 1]
                if len(chunk) > 1 and sum(x.strip(" ") != "" for x in chunk) > 1:
                    if tuple(chunk) in seen:
                        chunk = []
                    else:
                        seen.add(tuple(chunk))
                keep += chunk
                start = k + 1
        out[i] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def test_line_dedup(docs, empty):
    got = {r.doc_id: (r.n_lines, r.n_removed_lines, r.text) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == lines_by_hand([(i, t) for i, t, *_ in ROWS])
    assert sum(x[1] for x in got.values()) > 20 and line_dedup.dedup_lines(docs).columns[:5] == docs.columns[:5]
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_same_id(spark):
    text = "a b\nc d\ne f\ng h\n" * 2
    df = spark.createDataFrame([(1, text), (1, text), (1, text + "x"), (None, text)], "doc_id long, text string")
    rows = line_dedup.dedup_lines(df).collect()
    assert len(rows) == 4 and len({r.n_removed_lines for r in rows if r.doc_id == 1 and r.text == rows[0].text}) <= 1


# 2 -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [(1 << 12, 1 << 8, 1 << 16), (40, 12, 200), (7, 5, 60)])
def test_bpe_round_trip(docs, empty, size):
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {r.doc_id: (list(r.ids), bytes(r.decoded)) for r in bpe.decode(bpe.encode(docs, chunk_chars=size[0], overlap=size[1], spread_chars=size[2])).collect()}
    assert got == {i: (enc.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in ROWS}
    assert bpe.digest(bpe.decode(bpe.encode(empty))).count() == 0


def test_bpe_repeated_long_rows(spark):
    df = spark.createDataFrame([(1, "ab " * 100), (1, "ab " * 100), (1, "cd " * 100), (None, "e" * 300)], "doc_id long, text string")
    got = bpe.decode(bpe.encode(df, chunk_chars=20, overlap=10, spread_chars=50)).collect()
    assert sorted(bytes(r.decoded).decode() for r in got) == sorted(["ab " * 100] * 2 + ["cd " * 100, "e" * 300])


def test_bpe_method_is_used():
    """By the defaults over two fifths of the characters come through overlapping chunks, in several pieces; a run of
    letters without a boundary takes no more than a few scans of it."""
    import time

    import duckdb

    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{DATA.replace('0.001', '0.01')}/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    several = [t for t in texts if len(bpe.pieces_of(t, public_tokenizers.PATTERN, 1 << 12, 1 << 8)) > 1]
    assert sum(map(len, several)) > 0.4 * sum(map(len, texts))
    began = time.process_time()
    for text in ("x" * 5_000_000, "ab " * 1_700_000, " " * 5_000_000):
        assert "".join(bpe.pieces_of(text, public_tokenizers.PATTERN, 1 << 12, 1 << 8)) == text
    assert time.process_time() - began < 60


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é1'st\n\t  .!½日", max_size=120), st.integers(5, 30), st.integers(5, 20))
def test_stitching(text, size, overlap):
    pattern = public_tokenizers.PATTERN
    import regex

    pieces = bpe.pieces_of(text, pattern, size, overlap)
    assert "".join(pieces) == text
    tokens = lambda t: [m.group() for m in regex.finditer(pattern, t)]
    assert [x for p in pieces for x in tokens(p)] == tokens(text)


# 3 -----------------------------------------------------------------------------------------------


def components_by_hand(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("k", [4, 5])
def test_near_dedup(docs, empty, k):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, k).collect()}
    want = components_by_hand([(i, t) for i, t, *_ in ROWS], k, 80)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_needs_blocks(spark, monkeypatch):
    """A hub that is linked with nobody, members that link among themselves, over several blocks."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):
        w = words[:]
        for _ in range(1 + i % 6):
            w[rng.randrange(60)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (5, rows[5][1])], "doc_id long, text string")
    got = near_dedup.near_duplicates(df, 4).collect()
    want = components_by_hand(rows, 4, 80)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] and sum(r.doc_id == 5 for r in got) == 2
    assert 1 < len({c for _, c in want.values()}) < 80


def test_near_dedup_several_texts_of_an_id(spark, monkeypatch):
    """Every text of an id counts: 1 has two, each with a near copy; and a hub's pairs over many tasks."""
    monkeypatch.setattr(near_dedup, "HUB_PAIRS", 1)
    rng = random.Random(2)
    a, b = ([f"{c}{rng.randrange(10**6)}" for _ in range(60)] for c in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "x"])), (3, " ".join([*b, "y"])), (4, "z " + " ".join(b)), (9, "other words"), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for sigmas in (5.0, math.inf):
        got = [(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, 4, sigmas=sigmas).collect()]
        assert sorted(got) == [(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (4, 1, False), (9, 9, True)]


def test_near_dedup_words_not_hashes(spark):
    rows = [(i, f"{thue_morse(2048, i)} " + " ".join(f"w{k}" for k in range(3))) for i in (0, 1)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (1, 1)]
    same = np.arange(10, dtype=np.uint64)
    one, two = (near_dedup.FullSet(t, same, 2) for t in (b"a b c d e f g h i j", b"a b c d X f Y h i j"))
    assert one.links(one, 80) and not one.links(two, 80)


def test_sketch_limit():
    rng = np.random.default_rng(2)
    for n in (30, 150, 400, 1500):
        for _ in range(200):
            r = rng.integers(0, 2**64, round(n * 1.25), dtype=np.uint64)
            i = math.ceil(0.8 * len(r))
            k = rng.integers(0, len(r) - i + 1)
            a, b = np.r_[r[:i], r[i : i + k]], np.r_[r[:i], r[i + k :]]
            assert np.bitwise_count(near_dedup.odd_sketch(a) ^ near_dedup.odd_sketch(b)).sum() <= near_dedup.sketch_limit(len(a), len(b), 0.8)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 360)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_word_hashes():
    texts = ["", None, " a b\tc ", "x" * 10, "é É\x1cq", "a b", "A B"]
    arr = pa.array(["skip", *texts])[1:]
    h, at = shingles.word_hashes(arr)
    words = [WORD.findall(t or "") for t in texts]
    assert [int(n) for n in np.diff(at)] == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len({int(x) for x in h}) == len(set(flat)) and all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))
    low, _ = shingles.word_hashes(arr, lower=True)
    assert list(low[-2:]) == list(h[-4:-2])


# 4 -----------------------------------------------------------------------------------------------


def check_packed(rows, capacity):
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values(), default=0) <= capacity
    return len(at)


def first_fit(lengths, capacity):
    """Sequences that first-fit decreasing uses."""
    left = []
    for x in sorted(lengths, reverse=True):
        k = next((k for k, room in enumerate(left) if room >= x), None)
        if k is None:
            left.append(capacity - x)
        else:
            left[k] -= x
    return len(left)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, rows = {}, [*ROWS, *((10_000 + i, x, "en", "s", 0) for i, x in enumerate(SPECIAL))]
    docs = docs.unionByName(docs.sparkSession.createDataFrame(rows[len(ROWS) :], SCHEMA), allowMissingColumns=True)
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 128 or 128
        for k, s in enumerate([0, *range(first, len(ids), 128)]):
            part = ids[s : first if k == 0 else s + 128]
            want[i, k] = (s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part)
    rows = packing.unpack_ids(packing.pack(packing.token_pieces(docs, capacity=128), 128)).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32, list(r.ids)) for r in rows} == want
    assert check_packed(rows, 128) <= first_fit([r.length for r in rows], 128)
    assert packing.pack(packing.token_pieces(empty)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80))
def test_plan(lengths):
    capacity, counts = 30, np.bincount(lengths, minlength=31)
    n, slots = packing.plan(counts, capacity)
    bins = {}
    for length, rows in slots.items():
        for k in range(counts[length]):
            first, base, at, each = rows[np.searchsorted(rows[:, 0], k, "right") - 1]
            bins.setdefault(int(base + (k - first) // each), []).append((int(at + (k - first) % each * length), length))
    assert sum(map(len, bins.values())) == len(lengths) and len(bins) == n
    for items in bins.values():
        items.sort()
        assert [a for a, _ in items] == list(np.cumsum([0, *(x for _, x in items)])[:-1]) and items[-1][0] + items[-1][1] <= capacity
        assert sum(3 * x > capacity for _, x in items) <= 2
    assert n <= first_fit(lengths, capacity) + 1


def test_pack_hot_length(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 3 > 0, 700).otherwise(F.col("id") % 2048 + 1).cast("long").alias("length"))
    rows = packing.pack(df.unionByName(df.where("doc_id < 9"))).collect()
    assert len(rows) == 5009
    check_packed(rows, 2048)
    with pytest.raises(ValueError):
        packing.pack(df.withColumn("length", F.lit(5000).cast("long")))


# 5 -----------------------------------------------------------------------------------------------


def substrings_by_hand(rows, window=13):
    words = {i: WORD.findall(t or "") for i, t in rows}
    first, out = {}, {}
    for i in sorted(words):
        for j in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][j : j + window]), i)
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone).encode()))
    return out


def test_substring_dedup(docs, empty):
    result = substring_dedup.dedup_substrings(docs)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digest(result).collect()}
    assert got == substrings_by_hand([(i, t) for i, t, *_ in ROWS])
    texts = {r.doc_id: r.text for r in result.where("n_removed = 0").collect()}
    assert all(texts[i] == t for i, t, *_ in ROWS if i in texts)
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_substring_same_id(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(1, a), (1, a), (1, b), (2, a + " " + b[:60]), (None, a), (3, b)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.dedup_substrings(df).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (1, 0), (2, 40 + len(b[:60].split()) - (not b[60].isspace())), (3, 40)]


def test_substring_words_not_hashes(spark):
    x, y = thue_morse(2048, 0), thue_morse(2048, 1)
    rest = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{x} {rest}"), (2, f"{y} {rest}"), (3, f"{y} {rest} end")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digest(substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == substrings_by_hand(rows)
    # Equal hashes, other words: no match.
    words = [w.encode() for w in "a b c d e f g h".split()]
    hashes = np.arange(8, dtype=np.uint64)
    block = substring_dedup.Block(b"a b c X e f g h", hashes, 3)
    grams = shingles.ngrams(hashes, 3, 5)
    assert [block.longest(words, hashes, grams[k], k) for k in range(6)] == [0, 0, 0, 0, 4, 3]


def test_substring_factors(spark):
    """A factor stands in one block as a whole: two blocks give two factors, that meet."""
    w = [f"u{i}" for i in range(14)]
    rows = [(1, " ".join(w[:13])), (2, " ".join(w[1:])), (3, " ".join(w)), (4, "x " + " ".join(w[:13]) + " y " + " ".join(w[1:]) + " z"), (None, " ".join(w)), (3, " ".join(w))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, spans = substring_dedup.duplicate_spans(df)
    got = {r.doc_id: sorted(zip(r.starts, r.sizes, strict=True)) for r in spans.collect()}
    assert got == {3: [(0, 13), (1, 13)], 4: [(1, 13), (15, 13)]}
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.dedup_substrings(df).collect()) == [(0, 0), (1, 0), (2, 0), (3, 14), (3, 14), (4, 26)]


def test_substring_against_hand(spark, monkeypatch):
    """Few different words, so that windows repeat within and across documents; blocks dealt to many tasks."""
    monkeypatch.setattr(substring_dedup, "TASK_BYTES", 200)
    rng = random.Random(4)
    rows = [(i, rng_text(rng, rng.randint(0, 90), ("a", "b"))) for i in range(60)] + [(100, "a " * 400), (101, "a " * 300 + "b")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digest(substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), 5)).collect()}
    assert got == substrings_by_hand(rows, 5)


# 6 -----------------------------------------------------------------------------------------------


def base_by_hand(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
    n, cover = Counter(grams), set()
    for j, g in enumerate(grams):
        if n[g] > 1:
            cover.update((j, j + 1, j + 2))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w))


def test_quality_base(spark, docs, empty):
    rng = random.Random(5)
    more = [(1000 + i, rng_text(rng, n), "en", "s", 0) for i, n in enumerate((0, 1, 2, 3, 5, 40, 60, 400, 3000))] + [(2000, "a b c a b c d #x|<>\n\n x \n x \n", "xx", "s", 0), (None, "a b", None, "s", 0)]
    rows = ROWS + more
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(docs.select(*SCHEMA.replace(" long", "").replace(" string", "").split(", ")).unionByName(spark.createDataFrame(more, SCHEMA))).collect()}
    assert got == {i: base_by_hand(t) for i, t, *_ in rows}
    clash = quality.quality(docs)
    assert clash.columns.count("kept") == 1 and clash.count() == len(ROWS) and quality.quality(empty).count() == 0


def test_quality_verdict(spark):
    rows = QUERIES["op6_quality_rules"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and not any(bad)


def test_quality_common_words(spark):
    """32 words, counted whatever their case."""
    words = [f"w{i}" for i in range(32)]
    text = " ".join(w.upper() if i % 2 else w for i, w in enumerate(words * 3))
    df = spark.createDataFrame([(i, text, "en") for i in range(20)], "doc_id long, text string, lang string")
    assert sorted(quality.common_words(df).first().common) == sorted(words)
    df = df.unionByName(spark.createDataFrame([(20, text.lower(), "en"), (21, text.upper(), "en")], df.schema))
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    assert got[20].word_divergence == got[21].word_divergence == got[0].word_divergence is not None


def test_quality_few_common_words(spark):
    """Texts of any length with hardly any common word diverge; good ones with few hits do not."""
    rows = QUERIES["op6_quality_rules"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id", "left").where("not base_failed").collect()
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].word_divergence > 0.65 and not by_id[i].kept for i in (809, 6582, 9757))
    good = [r.word_divergence <= 0.65 for r in rows if r.quality == 1 and r.word_divergence is not None]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.998 * len(good) and sum(bad) <= 0.01 * len(bad)


def test_quality_classes(spark):
    """Only letters beyond ASCII count as such: no quotes, dashes or emoji."""
    texts = ["\u201cHello\u201d \u2014 \u2018world\u2019 \u2026 it\u2019s fine", "\u043f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440", "\u00c9t\u00e9 AB 12 #x \U0001f600", "", None, "\u65e5\u672c 5\u00a0%"]
    df = quality.base_counts(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string"))
    got = {r.doc_id: [int(x) for x in r.n] for r in df.select("_rest.doc_id", quality.class_counts(F.col("text"), F.col("_marks"), F.col("word_chars")).alias("n")).collect()}
    kind = lambda c: 0 if "A" <= c <= "Z" else 1 if "a" <= c <= "z" else 2 if c.isalpha() else 3 if c.isnumeric() else 4 if c in "#*$%&|<>" else 6 if c in " \t\n" else 5
    assert got == {i: [sum(kind(c) == k for c in t or "") for k in range(7)] for i, t in enumerate(texts)}


def test_quality_repeated_rows(spark):
    """Repeated rows are judged each for itself and alike; a comma inside a common word does no harm."""
    text = "a,b " * 30 + " ".join(f"w{i % 40}" for i in range(60))
    df = spark.createDataFrame([(i % 7, text, "en") for i in range(30)], "doc_id long, text string, lang string")
    rows = quality.quality(df).collect()
    assert len(rows) == 30 and len({(r.n_words, r.word_divergence, r.kept) for r in rows}) == 1 and rows[0].word_divergence < 0.01


def test_js_distance(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    row = spark.range(1).select(quality.js_distance(a(0.5, 0.5), a(0.5, 0.5)), quality.js_distance(a(1.0, 0.0), a(0.0, 1.0)), quality.js_distance(a(0.2, 0.8), a(0.6, 0.4))).first()
    p, q = np.array([0.2, 0.8]), np.array([0.6, 0.4])
    m = (p + q) / 2
    assert row[0] == 0 and row[1] == 1 and abs(row[2] - math.sqrt(((p * np.log2(p / m)).sum() + (q * np.log2(q / m)).sum()) / 2)) < 1e-12


# 7 -----------------------------------------------------------------------------------------------


def nearest(x, ids, q, k=20):
    s = (x * x[list(ids).index(q)]).sum(axis=1)
    s[ids == q] = -np.inf
    order = np.lexsort((ids, -s))[: min(k, (ids != q).sum())]
    return [(int(ids[i]), float(s[i])) for i in order]


def test_ann(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((24, 16))
    x = (centres[rng.integers(0, 24, 3000)] + 0.4 * rng.standard_normal((3000, 16))).astype(np.float32)
    x[2000:2600] = x[20]  # one vector that a fifth of all rows share
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(9000, None, 0), (9020, [0.0] * 16, 0), (9040, [float("nan")] + [1.0] * 15, 0), (9060, [1.0, None] + [1.0] * 14, 0), (9080, [1.0] * 3, 0), (9100, [], 0), (9120, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").repartition(3)
    vectors = df.select("vec_id", F.col("embedding").alias("v")).where(ann.valid(F.col("v")))
    router = ann.fit(vectors, sample=2000, per_part=300)
    assert router.parts == 8 and router.visits < 8
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, router=router, block=256).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids, x = np.arange(3000), x.astype(np.float64)
    assert sorted(got) == list(range(0, 3000, 20))
    hits = sum(len({i for i, _ in nearest(x, ids, q)} & {i for i, _ in got[q]}) for q in got)
    assert hits >= 0.9 * 20 * len(got)
    assert got[2020] == nearest(x, ids, 2020)  # ties go to the smaller id
    assert all(s == float((x[q] * x[i]).sum()) for q in list(got)[:20] for i, s in got[q])
    few = ann.search(df.where("vec_id < 5"), F.col("vec_id") == 0).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r["rank"])] == [i for i, _ in nearest(x[:5], np.arange(5), 0)]
    assert ann.search(df.where("vec_id >= 9000"), F.lit(True)).where("vec_id <> 9080").count() == 0


def test_ann_repeated_query(spark):
    x = np.random.default_rng(8).standard_normal((60, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + rows[:1] * 3, "vec_id long, embedding array<float>").repartition(3)
    got = ann.search(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [i for i, _ in nearest(x.astype(np.float64), np.arange(60), 0)]


def test_ann_recall_with_parts(spark):
    """Production parameters on a table that has several parts."""
    rows = spark.read.parquet("/root/testdata/check_s/embeddings.parquet")
    v = rows.select("vec_id", F.col("embedding").alias("v")).where(F.col("vec_id").isNotNull() & ann.valid(F.col("v")))
    router = ann.fit(v, k=20)
    assert 1 < router.visits < router.parts
    got = {}
    for r in ann.search(rows, F.col("vec_id") % 20 == 0, router=router).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    p = v.toPandas()
    ids, x = p.vec_id.to_numpy(), np.array(p.v.tolist(), np.float64)
    asked = [int(i) for i in ids if i % 20 == 0][:100]
    assert sum(len({i for i, _ in nearest(x, ids, q)} & got[q]) for q in asked) >= 0.9 * 20 * len(asked)


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_ann_recall_on_table(spark, sf):
    """The registered query, whose table has several parts at every size."""
    rows = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    v = rows.select("vec_id", F.col("embedding").alias("v")).where(F.col("vec_id").isNotNull() & ann.valid(F.col("v")))
    assert ann.fit(v, k=20).parts >= 4
    got = {}
    for r in QUERIES["op7_learned_partitions"](spark, f"/root/testdata/sf{sf}").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    data = v.orderBy("vec_id").toPandas()
    x, ids = np.stack(data.v).astype(float), data.vec_id.to_numpy()
    assert sorted(got) == [i for i in ids if i % 20 == 0]
    assert sum(len({i for i, _ in nearest(x, ids, q)} & got[q]) for q in got) >= 0.9 * 20 * len(got)


def test_ann_refills(spark):
    """Parts visited hold one candidate: the rest comes from the others.  Clashing columns and an empty table."""
    x = np.eye(8, dtype=np.float32)[np.arange(80) % 8] + 0.01 * np.random.default_rng(1).standard_normal((80, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("v", "part", "block", "side", "bound", "rank", "score", "query_id")})
    w1, w2 = np.eye(8), np.eye(8) * 10
    router = ann.Router(8, 8, 1, (w1, np.zeros(8), w2, np.zeros(8)), np.zeros(0, np.int64), np.zeros((0, 8)))
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, router=router).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i, _ in nearest(x.astype(np.float64), np.arange(80), q)] for q in range(0, 80, 20)}
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


def test_partition_balance():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1200, 8))
    part = ann.partition_graph(ann.neighbour_graph(x, 8), 8)
    assert np.bincount(part, minlength=8).max() <= math.ceil(1200 / 8 * 1.1)


# 8 -----------------------------------------------------------------------------------------------


def test_chat(spark):
    said = "a|b\\s <|end|> \\p </s>[INST]"
    rows = [(1, 0, "system", "s"), (1, 1, "user", said), (1, 2, "assistant", said), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "assistant", "ü😀"), (2, 0, "user", "only"), (3, 1, "assistant", "z"), (3, 0, "assistant", "y"), (3, 2, "user", "tail"), (None, 0, "|x>", "q"), (None, 0, "assistant", "q"), (None, 0, "assistant", "q"), (4, 0, None, "r"), (4, 0, None, "r")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit(1))
    examples = chat.format_chat(df)
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    conv = {}
    for c, t, role, text in rows:
        if c is not None:
            conv.setdefault(c, []).append((t, role or "", text or ""))
    alone = [(r.n_turns, r.turns_sha256, r.loss_chars, r.n_examples) for r in chat.read_back(examples).where("conv_id is null").collect()]
    assert sorted(alone) == sorted([(1, sha(b"|x>\nq\n"), 0, 1)] + [(1, sha(b"assistant\nq\n"), 1, 1)] * 2)
    for c, turns in conv.items():
        turns.sort()
        trained = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()), len(trained), sha(trained.encode()))
    one = examples.where("conv_id = 1").orderBy("example").collect()
    assert [(e.target_turn, e.n_turns) for e in one] == [(2, 3), (4, 5), (5, 6)] and all(b.text.startswith(a.text) for a, b in zip(one, one[1:], strict=False))
    assert one[2].text[one[2].loss_start : one[2].loss_end] == "ü😀"
    assert [r.loss_start for r in examples.where("conv_id = 2").collect()] == [None]
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\|sp<>end ", max_size=30))
def test_escape(text):
    out = text.replace("\\", "\\s").replace("|", "\\p")
    assert "|" not in out and out.replace("\\p", "|").replace("\\s", "\\") == text


# 9 -----------------------------------------------------------------------------------------------


def test_lm_scores_batches_are_small(spark, tmp_path, monkeypatch):
    """A batch holds a few MB, however much a task reads; it stands in the JVM and in the worker."""
    log = str(tmp_path / "sizes")

    def watched(make):
        def made(*how):
            run = make(*how)

            def seen(batches):
                for batch in batches:
                    with open(log, "a") as out:
                        out.write(f"{batch.nbytes}\n")
                    yield batch

            return lambda batches: run(seen(batches))

        return made

    for name in ("_block", "_ask", "_score"):
        monkeypatch.setattr(lm_score, name, watched(getattr(lm_score, name)))
    df = spark.range(0, 24, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), F.lit(200_000)).alias("text"))
    got = lm_score.lm_scores(df, block_bytes=1 << 20).collect()
    assert len(got) == 24 and all(r.n_words == 200_000 and r.n_backoff == 0 for r in got)
    with open(log) as lines:
        assert max(map(int, lines)) < 8 << 20



@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores(docs, empty, order):
    words = {i: WORD.findall(lower(t or "")) for i, t, *_ in ROWS}
    grams = lambda w, k: [tuple(w[j - k + 1 : j + 1]) for j in range(k - 1, len(w))]
    total = [Counter(g for w in words.values() for g in grams(w, k)) for k in range(1, order + 1)]
    n = sum(total[0].values())
    got = {r.doc_id: r for r in lm_score.lm_scores(docs, order, block_bytes=3000, bucket_bytes=500).collect()}
    for i, w in words.items():
        own = [Counter(grams(w, k)) for k in range(1, order + 1)]
        c = lambda g: total[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: B023, E731
        score, backed = 0.0, 0
        for j in range(len(w)):
            alpha, top = 0.0, min(order, j + 1)
            for k in range(top, 0, -1):
                g = tuple(w[j - k + 1 : j + 1])
                if k == 1:
                    score += alpha + math.log(max(c(g), 1) / n)
                elif c(g) > 0:
                    score += alpha + math.log(c(g) / max(c(g[:-1]), 1))
                    break
                else:
                    alpha += math.log(0.4)
                    backed += k == top
        assert (got[i].n_words, got[i].n_backoff) == (len(w), backed) and abs(got[i].log_score - score) < 1e-6 * max(1, abs(score))
    assert lm_score.lm_scores(empty).count() == 0
    if order == 3:
        for r in lm_score.relational_scores(docs, order).collect():
            assert (r.n_words, r.n_backoff) == (got[r.doc_id].n_words, got[r.doc_id].n_backoff) and abs(r.log_score - got[r.doc_id].log_score) < 1e-6 * max(1, abs(r.log_score))
        assert lm_score.relational_scores(empty).count() == 0


def test_lm_repeated_rows(spark):
    """Repeated rows are evidence for each other, whatever their id; they come in blocks of their own size."""
    rows = [(7, "a b c d")] * 40 + [(None, "a b c d"), (None, None), (8, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("block", "n_words", "texts")})
    got = lm_score.lm_scores(df, block_bytes=20).collect()
    assert len(got) == 43 and len({round(r.log_score, 9) for r in got if r.n_words == 4}) == 1
    assert all(r.n_backoff == (2 if r.doc_id == 8 else 0) for r in got) and abs(next(r.log_score for r in got if r.n_words == 4) - math.log(40 / 167)) < 1e-9


@given(st.lists(st.integers(0, 2**64 - 1)))
def test_pack_numbers(values):
    a = np.array(sorted(values), np.uint64)
    assert list(lm_score.unpack(lm_score.pack(a, True), np.uint64, True)) == list(a)


# 10 ----------------------------------------------------------------------------------------------


def test_shards(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [*ROWS, *((10_000 + i, x, "en", "s", 0) for i, x in enumerate(SPECIAL))]
    docs = docs.unionByName(spark.createDataFrame(rows[len(ROWS) :], SCHEMA), allowMissingColumns=True)
    manifest = sstable.write_shards(spark, docs, folder=f"file://{tmp_path}/s", shard_bytes=5000)
    assert 3 <= manifest.count() <= 12
    got = sstable.read_shards(spark, manifest, f"file://{tmp_path}").orderBy("start").collect()
    at, want = 0, {}
    for r, (i, text, *_) in zip(got, rows, strict=True):
        want[i] = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, list(r.ids)) == (i, at, len(want[i]), zlib.crc32(np.array(want[i], "<u4").tobytes()), want[i])
        at += len(want[i])
    files = [pa.OSFile(r.file) for r in manifest.where("n_docs > 0").collect()]
    readers = [sstable.Reader(f) for f in files]
    for i, *_ in ROWS:
        assert [list(x) for r in readers if (x := r.get(i)) is not None] == [want[i]]
    assert all(r.get(10**9) is None for r in readers)
    none = sstable.write_shards(spark, empty, folder=f"file://{tmp_path}/e", n_shards=2)
    assert sstable.read_shards(spark, none, f"file://{tmp_path}").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.lists(st.integers(0, 2**32 - 1), max_size=9), max_size=30))
def test_shard_file(entries):
    import io

    out = io.BytesIO()
    sstable.BLOCK_BYTES, was = 40, sstable.BLOCK_BYTES
    try:
        w = sstable.Writer(out)
        order = sorted(entries, key=lambda k: (k is not None, k or 0))
        for k in order:
            w.add(sstable.encode_key(k), np.array(entries[k], np.uint32))
        w.close()
    finally:
        sstable.BLOCK_BYTES = was
    r = sstable.Reader(pa.BufferReader(out.getvalue()))
    assert [(sstable.decode_key(k), list(v)) for k, v in r.entries()] == [(k, entries[k]) for k in order]
    assert all(list(r.get(k)) == entries[k] for k in order) and r.n_entries == len(entries)


def test_word_encoder_equals_tokenizer():
    enc = sstable.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert enc.plain is not None
    rng = random.Random(9)
    texts = [*SPECIAL, "", " ", "İSTANBUL ΣΑΣ ß ﬁ", "\x1c a\x1cb \x01 \x02x", "don't I'LL <|endoftext|> </w>", "😀👍🏽 日本", "a\x85b\xa0c", "z ́a"]
    texts += ["".join(rng.choice("aéÉ \n\t'sSß1２İ😀|<>.-ñThe") for _ in range(rng.randint(0, 40))) for _ in range(800)]
    assert [list(x) for x in enc(texts)] == [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]


# Queries -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_sql(spark, name):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLE_SQL[name]).df()
    order = sorted(got.columns)
    normal = lambda df: df[order].astype(str).sort_values(order).reset_index(drop=True)
    pd.testing.assert_frame_equal(normal(got), normal(want))


@pytest.mark.parametrize("name", QUERIES)
def test_registered(spark, name):
    import __spark_entry__

    assert name in __spark_entry__.queries() and QUERIES[name](spark, DATA).count() > 0


def test_shards_repeated_rows(spark, tmp_path):
    """Repeated rows and ids all stay, as neighbours; starts go on behind them."""
    rows = [(5, "a b c"), (5, "a b c"), (5, "other"), (None, "x"), (None, None), (-3, "neg")]
    manifest = sstable.write_shards(spark, spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)), folder=f"file://{tmp_path}/r", n_shards=2)
    got = sstable.read_shards(spark, manifest, f"file://{tmp_path}").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -3, 5, 5, 5]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(6)]


def test_pipeline_odd_rows(spark):
    """Nulls, repeated rows, clashing columns; and no rows at all."""
    import corpus_pipeline as p

    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    rows = [(1, text), (1, text), (2, text + " x"), (3, None), (None, text), (4, ""), (5, " ".join(f"v{i}" for i in range(70)))]
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], SCHEMA)
    for df, want in ((docs, [None, 1, 1, 5]), (docs.limit(0), [])):
        df = df.withColumns({c: F.lit("mine") for c in ("kept", "n_words", "ids", "_rest", "h", "component_id")})
        for _, step in p.STAGES[:-1]:
            df = step(spark, df, DATA).withColumns({c: F.lit("mine") for c in ("kept", "ids", "_rest")})
        assert sorted((r.doc_id for r in df.collect()), key=lambda i: (i is not None, i)) == want
        packed = p.STAGES[-1][1](spark, df, DATA).collect()
        assert len(packed) == len(want) and {r.sequence_id for r in packed} == ({0} if want else set())


def test_pipeline(spark):
    """run() against brute force stage by stage, and the packed ids against its own texts."""
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("extra", F.lit(1))
    kept = {}
    for name, step in p.STAGES[:-1]:
        docs = step(spark, docs, DATA).cache()
        assert docs.columns == list(p.COLUMNS)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert all(not base_by_hand(text[i])[-1] for i in kept["quality_rules"])
    by_hand = lines_by_hand(sorted(kept["quality_rules"].items()))
    assert kept["line_dedup"] == {i: x[2] for i, x in by_hand.items()}
    comps = components_by_hand(sorted(kept["line_dedup"].items()), 5, 80)
    assert set(kept["near_dedup"]) == {i for i, (_, c) in comps.items() if c == i}
    subs = substrings_by_hand(sorted(kept["near_dedup"].items()))
    assert {i: sha(" ".join(WORD.findall(t)).encode()) for i, t in kept["substring_dedup"].items()} == {i: x[2] for i, x in subs.items()}
    rows = p.run(spark, DATA).collect()
    check_packed(rows, 2048)
    from tokenizers import Tokenizer

    enc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        ids.setdefault(r.doc_id, []).extend(r.ids)
    assert ids == {i: [*enc.encode(t, add_special_tokens=False).ids, 0] for i, t in kept["substring_dedup"].items()}
