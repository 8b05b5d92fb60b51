"""Phrase collocations by top-order marginalisation.

Only the longest windows are counted: every word with the words that follow it in its piece, padded with nulls. ROLLUP over
the window's columns sums them over ever shorter prefixes, and a prefix of k words is a phrase of k words, so no length has
an n-gram explosion of its own.

Windows of five words hardly repeat. So the sums are taken in two orders: ROLLUP over windows of two gives the words of a
language, the count of every word and of every pair; windows of the full length are then cut where two neighbours are no
pair of at least the asked count, which leaves every phrase of that count whole. The pairs go to the workers as a bitmap of
fixed size (hashes without a bit are no frequent pair; a wrongly set bit costs a window, ROLLUP's counts decide).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.llm.common import stage, texts

BREAKS, SPACES = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PAIR_BITS = 1 << 25
_FOLD = str.maketrans(UPPER, LOWER)


def pieces(text: Column) -> Column:
    """Word lists of the pieces of a text (null: none); pieces without a word are empty lists."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS)
    return F.transform(parts, lambda p: F.filter(F.split(p, SPACES), lambda w: w != ""))


def _windows(docs: DataFrame, order: int) -> DataFrame:
    """A row per word: ``lang`` and the word with its followers in the piece, ``w1`` .. null behind the piece's end."""
    words = docs.select("lang", F.explode(pieces(F.col("text"))).alias("w"))
    leads = [F.col("w")] + [F.slice("w", F.lit(k + 1), F.greatest(F.size("w") - k, F.lit(0))) for k in range(1, order)]
    return words.select("lang", F.inline(F.arrays_zip(*[c.alias(f"w{k + 1}") for k, c in enumerate(leads)])))


def _rolled(windows: DataFrame, order: int, count: Column, least: int, total: bool) -> DataFrame:
    """(lang, words, phrase, f) of all prefixes of ``least`` windows or more; with ``total`` also the words of each lang."""
    names = [f"w{k}" for k in range(1, order + 1)]
    sums = windows.rollup("lang", *names).agg(F.sum(count).alias("f"), F.grouping_id().alias("__g"))
    given = order - F.bit_count("__g").cast("int")
    filled = sum(F.col(n).isNotNull().cast("int") for n in names)
    # A prefix that ends in padding is the count of pieces that end there, not of a phrase.
    enough = (filled == given) & (F.col("f") >= least) & (given > 0)
    return sums.where(F.col("lang").isNotNull() & (enough | (given == 0) if total else enough)).select("lang", given.alias("words"), F.concat_ws(" ", *names).alias("phrase"), "f")


def _place(lang: Column, left: Column, right: Column) -> Column:
    """Bit of a pair, from the hashes of its parts."""
    mixed = F.shiftleft(F.xxhash64(left), 1).bitwiseXOR(F.xxhash64(right)).bitwiseXOR(F.shiftleft(F.xxhash64(lang), 2))
    return mixed.bitwiseAND(F.lit(PAIR_BITS - 1).cast("long"))


def _pair_bitmap(pairs: DataFrame) -> bytes:
    """Bits of the pairs: ``PAIR_BITS`` / 8 bytes, whatever the number of pairs."""
    words = F.split("phrase", " ")
    place = _place(F.col("lang"), words[0], words[1]) + 1
    rows = pairs.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
    size = 32768 // 8
    out = bytearray(PAIR_BITS // 8)
    for r in rows.collect():
        out[(r.b - 1) * size : r.b * size] = r.m
    return bytes(out)


class _Hashes(dict):
    """Hash of a word, kept for the words a task sees often; 0 for what separates pieces."""

    def __missing__(self, word: str) -> int:
        value = 0 if word[0] in ".,;:!?\n\x0b\x0c\r" else xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42) or 1
        if len(self) >= 200_000:
            self.clear()
        self[word] = value
        return value


def _cut_windows(order: int, bitmap, part_chars: int = 1 << 20):
    """Batches of (lang, text) -> windows (lang, w1 ..) at the words whose follower makes a pair with them; a window ends
    where two neighbours are no pair."""
    tokens = re.compile(r"[^\x20\x09.,;:!?\x0A-\x0D]+|[.,;:!?\x0A-\x0D]+")
    names = ["lang", *[f"w{k}" for k in range(1, order + 1)]]

    def windows(words: list[str], langs: list[str], ends: list[int], bits, hashes: _Hashes) -> pa.RecordBatch:
        """Windows of some texts; text t is ``words[ends[t - 1] : ends[t]]``."""
        h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        spans = np.diff(ends, prepend=0)
        seeds = np.repeat(np.array([hashes_of(lang) for lang in langs], np.uint64) << np.uint64(2), spans)
        place = ((h[:-1] << np.uint64(1)) ^ h[1:] ^ seeds[:-1]) & np.uint64(PAIR_BITS - 1)
        linked = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool) & (h[:-1] != 0) & (h[1:] != 0)
        linked[np.array(ends[:-1], np.int64) - 1] = False
        at = np.flatnonzero(linked)
        column, open_ = pa.array(words, pa.string()), np.ones(len(at), bool)
        text = np.repeat(np.arange(len(langs)), spans)
        out = [pa.array(langs, pa.string()).take(pa.array(text[at])), column.take(pa.array(at))]
        padded = np.concatenate([linked, np.zeros(order, bool)])
        for k in range(1, order):
            open_ = open_ & padded[at + k - 1]
            out.append(column.take(pa.array(at + k, mask=~open_)))
        return pa.RecordBatch.from_arrays(out, names)

    def hashes_of(lang: str) -> int:
        return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 42)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hashes = np.frombuffer(bitmap.value, np.uint8), _Hashes()
        words, langs, ends, chars = [], [], [], 0
        for batch in batches:
            for row, lang in enumerate(batch.column(0).to_pylist()):
                text = texts(batch.column(1).slice(row, 1))[0]
                found = tokens.findall(text.translate(_FOLD))
                if not found:
                    continue
                words += found
                langs.append(lang)
                ends.append(len(words))
                chars += len(text)
                if chars >= part_chars:
                    yield windows(words, langs, ends, bits, hashes)
                    words, langs, ends, chars = [], [], [], 0
        if langs:
            yield windows(words, langs, ends, bits, hashes)

    return cut, ", ".join(f"{n} string" for n in names)


def phrase_counts(docs: DataFrame, longest: int, least: int) -> DataFrame:
    """Staged (lang, words, phrase, f): phrases of one to ``longest`` words that occur ``least`` times or more in their lang,
    and with 0 words the word occurrences of the lang."""
    spark = docs.sparkSession
    told = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    short = stage(_rolled(_windows(told, 2), 2, F.lit(1), least, True), "phrase-pairs")
    if longest <= 2:
        return short.where(F.col("words") <= longest)
    bitmap = spark.sparkContext.broadcast(_pair_bitmap(short.where("words = 2")))
    cut, columns = _cut_windows(longest, bitmap)
    long = _rolled(told.mapInArrow(cut, columns), longest, F.lit(1), least, False)
    return stage(short.where("words < 2").unionByName(long.where("words > 1")), "phrases")


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000, share: int = 100) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words per lang by their score: lang, rank, phrase, a, l, r, n, score.

    Words are folded in A-Z only and split at blanks and tabs, pieces at ``[.,;:!?]`` and line ends. A phrase counts
    ``a`` >= ``least`` times; its lowest-scoring cut has parts of ``l`` and ``r`` occurrences and score
    floor(1000 a n / (l r)), of equal cuts the first. A phrase goes if a longer counted phrase that holds its words in a row
    has at least ``share`` percent of its count. Ties of score: larger a, then the phrase in UTF-8 order. Products are
    decimals of 38 digits, quotients are exact.

    Null text has no words, null lang is ``und``; repeated documents count as often as they stand there; a very long text is
    one row of the first pass. An empty table gives no row. Further columns are not looked at.
    """
    counts = phrase_counts(docs, longest, least)
    total = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    known = counts.where("words > 0").select("lang", "phrase", "f")
    phrases = counts.where("words > 1").select("lang", "words", F.col("phrase").alias("whole"), F.split("phrase", " ").alias("w"), F.col("f").alias("a"))
    part = lambda start, length: F.concat_ws(" ", F.slice("w", start, length))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "whole", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(total, "lang")
    exact = F.expr("bigint(1000 * (cast(a AS decimal(17,0)) * cast(n AS decimal(17,0))) div (cast(l AS decimal(19,0)) * cast(r AS decimal(18,0))))")
    scored = cuts.groupBy("lang", "whole", "a", "n").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("m"))
    inner = phrases.where("words > 2").withColumn("k", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("k") + 1)))
    longer = inner.groupBy("lang", part(F.col("at"), F.col("k")).alias("whole")).agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "whole"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("m.score"), F.desc("a"), "whole")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), F.col("whole").alias("phrase"), "a", "m.l", "m.r", "n", "m.score")


SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
grams AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM starts, (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE m > 1),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.a, n, k.k, x.f AS l, y.f AS r, (1000 * k.a::HUGEINT * n // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1 : k.k], ' ')
      JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1 : k.m], ' ') JOIN total ON total.lang = k.lang),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT *, unnest(range(2, m)) AS size FROM c),
j AS (SELECT *, unnest(range(1, m - size + 2)) AS start FROM i),
longer AS (SELECT lang, array_to_string(w[start : start + size - 1], ' ') AS phrase, max(a) AS longer FROM j GROUP BY 1, 2),
kept AS (SELECT low.* FROM low LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""
