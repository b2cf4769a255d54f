"""Quality rules by distribution divergence, in DataFrame functions only.

Every document gets base counts (words, symbols, repeated lines, repeated 3-word windows).
One that passes the base rule is compared with the reference of its language: the
Jensen-Shannon distance between character-class histograms and between common-word
histograms.  References are means over all documents of a language that have ``min_words``
words (each counts alike, whatever its length), the common words are the ``n_common`` most
frequent of all texts, lower-cased.  A document is rejected if a distance is above its limit;
short texts (``min_words``) and languages with few documents (``min_docs``) are not judged by it.

Common words that a text of its length should have and has not are a bin of their own, which the
reference lacks: a text without any has a distance near 1.  ``SMOOTHING`` hits dealt as in the
reference keep the noise of a short text's few hits small.

No text is shuffled: the per-document part is one pass over arrays inside the row; the
references (a row per language) are broadcast by Spark only if their written size is under
its threshold, and a shuffle join otherwise.

Defined cases: null or empty text has 0 words and fails the base rule; null language has no
reference; repeated rows are judged each for itself; an empty table gives no rows; extra
columns pass through, and new columns replace those of their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bundle, let, stage, unbundle, words_of

SMOOTHING = 2.0
SYMBOLS = "#*$%&|<>"
#: Letters A-Z, letters a-z, letters beyond ASCII, numbers, symbols, any other character, white space between words.
CLASSES = ("upper", "lower", "beyond", "digit", "symbol", "mark", "space")
KEEP = ("lang", "text")
NEW = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_divergence", "word_divergence", "kept")


def class_counts(text: Column, marks: Column, word_chars: Column) -> Column:
    """Characters by class.  Plain projections only: they share subexpressions, generators do not."""
    text = F.coalesce(text, F.lit(""))
    upper = F.length(F.regexp_replace(text, r"[^A-Z]+", ""))
    beyond = F.length(F.regexp_replace(text, r"[\x00-\x7F\P{L}]+", ""))
    space = F.length(text) - word_chars
    digit = F.length(marks) - F.length(F.regexp_replace(marks, r"\p{N}+", ""))
    symbol = F.length(marks) - F.length(F.translate(marks, SYMBOLS, ""))
    lower = F.length(text) - F.length(marks) - space - upper - beyond
    return F.array(*[x.cast("double") for x in (upper, lower, beyond, digit, symbol, F.length(marks) - digit - symbol, space)])


def summed(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)


def shares(counts: Column, total: Column | None = None) -> Column:
    total = summed(counts) if total is None else total
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits, 0 to 1."""
    part = lambda a, b: F.when(a > 0, a * F.log2(a * 2 / (a + b))).otherwise(0.0)
    total = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def with_missing(counts: Column, ref: Column, expected: Column, hits: Column) -> Column:
    """``counts`` smoothed toward ``ref``, and behind them how many of the ``expected`` hits are missing."""
    smoothed = F.zip_with(counts, ref, lambda x, r: x + SMOOTHING * r)
    return F.concat(smoothed, F.array(F.greatest(expected - hits, F.lit(0.0))))


def common_words(docs: DataFrame, n_common: int = 32) -> DataFrame:
    """(lang, common): the most frequent words of all texts of a language, lower-cased."""
    base = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    words = base.select("lang", F.explode(words_of(F.lower("text"))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    # The most frequent of each of 64 hash classes first: no task sorts a language's whole vocabulary.
    top = lambda df, keys: df.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "word"))).where(F.col("r") <= n_common)
    words = top(words.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(64))), ["lang", "part"])
    common = top(words.drop("part", "r"), ["lang"]).groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "word"))), lambda x: x.word).alias("common"))
    return stage(common, "common-words")


def references(measured: DataFrame, common: DataFrame, min_words: int, n_common: int, min_docs: int) -> DataFrame:
    """(_ref_lang, _ref_rate, _ref_classes, _ref_words): the mean histograms of each language and its mean share of
    common words, from measured documents."""
    hist = let(measured.where(F.col("n_words") >= min_words).select("lang", "n_words", "_n", "_w"), _total=summed(F.col("_w")))
    hist = let(hist, _c=shares(F.col("_n")), _s=shares(F.col("_w"), F.col("_total")))
    mean = [F.avg(F.get("_c", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))] + [F.avg(F.get("_s", F.lit(i))).alias(f"w{i}") for i in range(n_common)]
    ref = hist.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.col("_total") / F.col("n_words")).alias("rate"), *mean).where(F.col("n_docs") >= min_docs).join(common, "lang")
    ref = ref.select(
        F.col("lang").alias("_ref_lang"),
        F.col("rate").alias("_ref_rate"),
        F.array(*[F.coalesce(f"c{i}", F.lit(0.0)) for i in range(len(CLASSES))]).alias("_ref_classes"),
        F.slice(F.array(*[F.coalesce(f"w{i}", F.lit(0.0)) for i in range(n_common)]), 1, F.size("common")).alias("_ref_words"),
    )
    return stage(ref, "language-references")


def with_common_counts(df: DataFrame, text: Column, common: str, name: str, n_common: int) -> DataFrame:
    """Add ``name``: how often each word of the array column ``common`` (``n_common`` at most) occurs in ``text``, lower-cased."""
    listed = F.array_join(common, ",")
    df = df.withColumns({"_list": listed, "_longest": F.array_max(F.transform(common, F.octet_length)), "_comma": F.exists(common, lambda w: F.contains(w, F.lit(",")))})
    df = let(df, _low=F.filter(words_of(F.lower(text)), lambda w: F.octet_length(w) <= F.col("_longest")))
    # Each word becomes one character that tells its place.  A list with a comma inside a word can't be searched as one text.
    signs = "".join(chr(48 + i) for i in range(n_common + 1))
    place = lambda w: F.when(F.col("_comma"), F.array_position(common, w).cast("int")).otherwise(F.find_in_set(w, F.col("_list")))
    df = let(df, _places=F.array_join(F.transform("_low", lambda w: F.substring(F.lit(signs), place(w) + 1, F.lit(1))), ""))
    counts = [(F.length("_places") - F.length(F.replace("_places", F.lit(c), F.lit("")))).cast("double") for c in signs[1:]]
    return df.withColumn(name, F.when(F.col("_places").isNotNull(), F.slice(F.array(*counts), 1, F.size(common)))).drop("_list", "_longest", "_comma", "_low", "_places")


def base_counts(docs: DataFrame) -> DataFrame:
    """lang, text, ``_rest`` (all other columns), ``_words``, ``_marks`` and the base columns."""
    df = let(bundle(docs, KEEP, NEW), _words=words_of(F.col("text")))
    n = F.size("_words")
    df = let(df, _grams=F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(F.array().cast("array<bigint>")))
    # Windows found twice or more: hashes that are their neighbour in sorted order.
    g = F.size("_grams")
    df = let(df, _order=F.sort_array("_grams"))
    df = let(df, _again=F.array_distinct(F.filter(F.zip_with("_order", F.slice("_order", 2, F.greatest(g, F.lit(1))), lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())))
    # Their places: looked up where they are few, else from the windows sorted with their places.
    df = let(df, _order=F.when(F.size("_again") > 24, F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda a, b: F.get("_order", a).h == F.get("_order", b).h
    sorted_places = F.transform(F.filter(F.sequence(F.lit(0), g - 1), lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False))), lambda k: F.get("_order", k).i)
    few_places = F.filter(F.transform("_grams", lambda h, i: F.when(F.array_contains("_again", h), i)), lambda i: i.isNotNull())
    df = let(df, _twice=F.when(F.size("_again") == 0, F.array().cast("array<int>")).when(F.col("_order").isNull(), few_places).otherwise(F.sort_array(sorted_places)))
    # Each such window covers its three words, or as many as there are before the next one starts.
    covered = F.aggregate(F.transform("_twice", lambda x, k: F.least(F.coalesce(F.get("_twice", k + 1) - x, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x)
    # Neither letters nor white space: little is left for the counts of symbols and other classes to scan.
    df = let(df, _marks=F.regexp_replace(F.coalesce("text", F.lit("")), r"[\p{L}\s]+", ""))
    df = let(df, _lines=F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return df.select(
        "lang", "text", "_rest", "_words", "_marks",
        n.cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
        (F.length("_marks") - F.length(F.translate("_marks", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))


def quality(
    docs: DataFrame,
    class_limit: float = 0.35,
    word_limit: float = 0.65,
    min_words: int = 50,
    n_common: int = 32,
    min_docs: int = 20,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` (``text`` only with ``keep_text``) with the base columns, ``class_divergence``,
    ``word_divergence`` (null where not judged) and ``kept``."""
    common = common_words(docs, n_common)
    df = base_counts(docs)
    measures = [c for c in df.columns if c in NEW]
    df = df.withColumn("_n", class_counts(F.col("text"), F.col("_marks"), F.col("word_chars")))
    named = common.select(F.col("lang").alias("_lang"), F.col("common").alias("_common"))
    df = df.join(named, df.lang == named._lang, "left")
    df = with_common_counts(df, F.col("text"), "_common", "_w", n_common)
    # Written once: the references are means over these measures, and the verdict needs both.
    measured = stage(df.select("lang", *["text"] * keep_text, "_rest", *measures, "_n", "_w"), "measured-documents")
    ref = references(measured, common, min_words, n_common, min_docs)
    df = measured.join(ref, measured.lang == ref._ref_lang, "left")
    df = let(df, _hits=summed(F.col("_w")))
    judged = F.col("_ref_lang").isNotNull() & (F.col("n_words") >= min_words)
    df = let(df, _ref_words=shares(F.col("_ref_words")))
    df = let(df, _w=with_missing(F.col("_w"), F.col("_ref_words"), F.col("_ref_rate") * F.col("n_words"), F.col("_hits")), _ref_words=F.concat("_ref_words", F.array(F.lit(0.0))))
    df = let(df, _hits=summed(F.col("_w")))
    df = let(df, _c=shares(F.col("_n")), _s=shares(F.col("_w"), F.col("_hits")))
    df = let(
        df,
        class_divergence=F.when(judged, js_distance(F.col("_c"), F.col("_ref_classes"))),
        word_divergence=F.when(judged, js_distance(F.col("_s"), F.col("_ref_words"))),
    )
    bad = (F.coalesce("class_divergence", F.lit(0.0)) > class_limit) | (F.coalesce("word_divergence", F.lit(0.0)) > word_limit)
    rest = unbundle(docs, KEEP, NEW if keep_text else (*NEW, "text"))
    return df.select(*rest, *measures, "class_divergence", "word_divergence", (~F.col("base_failed") & ~bad).alias("kept"))


def digest(result: DataFrame) -> DataFrame:
    """``result`` with distances to six decimals."""
    return result.withColumns({c: F.round(c, 6) for c in ("class_divergence", "word_divergence")})


#: For the defaults.  Each class is counted by a pattern of its own.
ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM h WHERE n > 1) GROUP BY doc_id),
l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.*, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS lower,
         length(regexp_replace(regexp_replace(text, '[\x00-\x7F]', '', 'g'), '[^\p{L}]', '', 'g')) AS beyond,
         length(regexp_replace(text, '[^\p{N}]', '', 'g')) AS digit, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) AS space
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (
  SELECT *, list_transform(ws, lambda x: lower(x)) AS lws,
         [upper, lower, beyond, digit, n_symbols, length(text) - upper - lower - beyond - digit - n_symbols - space, space]::DOUBLE[] AS nc FROM m),
t AS (
  SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS p
  FROM (SELECT lang, unnest(lws) AS word FROM c WHERE lang IS NOT NULL) GROUP BY lang, word),
o AS (SELECT lang, list(word ORDER BY p) AS common FROM t WHERE p <= 32 GROUP BY lang),
v AS (
  SELECT c.*, common, list_transform(common, lambda x: len(list_filter(lws, lambda y: y = x))::DOUBLE) AS nw
  FROM c LEFT JOIN o ON o.lang = c.lang),
s AS (
  SELECT *, list_transform(nc, lambda x: CASE WHEN list_sum(nc) > 0 THEN x / list_sum(nc) ELSE 0 END) AS pc,
         list_transform(nw, lambda x: CASE WHEN list_sum(nw) > 0 THEN x / list_sum(nw) ELSE 0 END) AS pw FROM v),
f AS (
  SELECT lang, list(x ORDER BY i) AS rc
  FROM (SELECT lang, i, avg(x) AS x FROM (SELECT lang, unnest(pc) AS x, unnest(range(1, len(pc) + 1)) AS i FROM s WHERE n_words >= 50) GROUP BY lang, i) GROUP BY lang),
q AS (
  SELECT lang, list(x ORDER BY i) AS rw
  FROM (SELECT lang, i, avg(x) AS x FROM (SELECT lang, unnest(pw) AS x, unnest(range(1, len(pw) + 1)) AS i FROM s WHERE n_words >= 50) GROUP BY lang, i) GROUP BY lang),
e AS (SELECT lang, avg(list_sum(nw) / n_words) AS rate FROM s WHERE n_words >= 50 AND common IS NOT NULL GROUP BY lang HAVING count(*) >= 20),
-- Two smoothing hits, dealt as in the reference; the hits that are missing are the last bin.
y AS (
  SELECT s.*, rc, list_transform(rw, lambda x: CASE WHEN list_sum(rw) > 0 THEN x / list_sum(rw) ELSE 0 END) AS rn, rate, n_words >= 50 AND e.lang IS NOT NULL AS judged
  FROM s LEFT JOIN f ON f.lang = s.lang LEFT JOIN q ON q.lang = s.lang LEFT JOIN e ON e.lang = s.lang),
x AS (
  SELECT *, list_append(list_transform(list_zip(nw, rn), lambda x: x[1] + 2 * x[2]), greatest(rate * n_words - list_sum(nw), 0)) AS kw,
         list_append(rn, 0.0) AS rm FROM y),
z AS (
  SELECT *, CASE WHEN judged THEN list_zip(pc, rc) END AS zc,
         CASE WHEN judged THEN list_zip(list_transform(kw, lambda x: CASE WHEN list_sum(kw) > 0 THEN x / list_sum(kw) ELSE 0 END), rm) END AS zw FROM x),
d AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         sqrt(greatest(list_sum(list_transform(zc, lambda x: CASE WHEN x[1] > 0 THEN x[1] * log2(2 * x[1] / (x[1] + x[2])) ELSE 0 END
                                                             + CASE WHEN x[2] > 0 THEN x[2] * log2(2 * x[2] / (x[1] + x[2])) ELSE 0 END)) / 2, 0)) AS dc,
         sqrt(greatest(list_sum(list_transform(zw, lambda x: CASE WHEN x[1] > 0 THEN x[1] * log2(2 * x[1] / (x[1] + x[2])) ELSE 0 END
                                                             + CASE WHEN x[2] > 0 THEN x[2] * log2(2 * x[2] / (x[1] + x[2])) ELSE 0 END)) / 2, 0)) AS dw FROM z)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       CASE WHEN zc IS NULL THEN NULL ELSE round(dc, 6) END AS class_divergence, CASE WHEN zw IS NULL THEN NULL ELSE round(dw, 6) END AS word_divergence,
       NOT base_failed AND (zc IS NULL OR dc <= 0.35) AND (zw IS NULL OR dw <= 0.65) AS kept
FROM d
"""
