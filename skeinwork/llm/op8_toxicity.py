"""Toxicity: obfuscated words are restored by a noisy-channel decoder, then the restored text is scored."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable
from math import exp, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.common import by_text, fresh, held, stage, texts
from skeinwork.llm.encode import TwoGenerations

# Symbols of the character model: 0 is a word boundary (anything that is not a letter), OTHER any letter beyond the list.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöùúûüýÿßœ"
BASE, OTHER = 64, 63
_CODE = {c: k + 1 for k, c in enumerate(LETTERS)}
_TOP = 0x250
_CLASS = np.array([_CODE.get(chr(c), OTHER if chr(c).isalpha() else 0) for c in range(_TOP)] + [OTHER], np.int64)

# Letters that a digit or mark may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l"}
SEPARATORS = " \t.-_*/"
# Log probabilities of the channel: a letter written as leet, a letter written twice, or once more after that, a separator
# inside a word; a separator or mark that stands between words; a separator between groups of letters that is dropped; a mark
# that is punctuation: an exclamation mark at the end of a word, another one there, one in front.
SUBSTITUTED, DOUBLED, REPEATED, SPACED, BETWEEN, MARK, JOINED, EXCLAIMED, BEHIND, BEFORE = -1.0, -3.5, -0.3, -0.5, -2.5, -8.0, -2.0, 0.0, -2.0, -8.0
DOUBLED_SPACED = -6.0

_LOWERED = np.array([ord(chr(c).lower()[0]) for c in range(_TOP)] + [_TOP], np.uint32)
_DOUBLES = np.array([chr(c).isalpha() for c in range(_TOP)] + [True])
_PIVOT = np.array([chr(c) in LEET for c in range(_TOP)] + [False])
_SEP = np.array([chr(c) in SEPARATORS or chr(c).isspace() for c in range(_TOP)] + [False])
_EDGES = ".,;:?*%&#()[]{}\"'-=<>~^/\\"
_MARKS = "!$+|"
_SPACED_RUN = re.compile(r"(?<![^\s.*/_-])(?:[^\s.*/_-][ \t.\-_*/]{1,3}){2,}[^\s.*/_-](?![^\s.*/_-])")
_INNER = np.array([chr(c) in SEPARATORS and not chr(c).isspace() for c in range(_TOP)] + [False])
# What is not seen between two letters, and what is a number although it has marks.
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_NUMBER = re.compile(r"[-+$€£#|]*\d[\d.,:/|+-]*[%$€£+!]?")
_BLANK = np.array([chr(c).isspace() for c in range(_TOP)] + [False])
_WIDE_BLANKS = np.array([c for c in range(_TOP, 0x3001) if chr(c).isspace()], np.uint32)
_WORDS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
FORM_TEXTS, CHANCE, SIGNATURES = 5, 0.01, 10
CACHED_CHARS, CACHED_SPANS = 64, 100_000


def _codes(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), _TOP)


# Character model -----------------------------------------------------------------------------------------------------


def trigram_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``code`` (a trigram of symbols) and ``n`` over all texts, lower-cased. A task sends at most one row per trigram."""

    def run(batches):
        total, codes, held_codes = np.zeros(BASE**3, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    s = np.concatenate(([0, 0], _CLASS[_codes(text.lower())], [0]))
                    codes.append(s[:-2] * BASE * BASE + s[1:-1] * BASE + s[2:])
                    held_codes += len(s)
                    if held_codes > 4 * BASE**3:
                        total += np.bincount(np.concatenate(codes), minlength=BASE**3)
                        codes, held_codes = [], 0
        if codes:
            total += np.bincount(np.concatenate(codes), minlength=BASE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["code", "n"])

    counts = df.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "code int, n long")
    return counts.groupBy("code").agg(F.sum("n").alias("n"))


def language_model(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities of a symbol behind two others, as 64^3 numbers: trigrams, backed off to bigrams and single symbols."""
    n = np.zeros(BASE**3)
    for row in trigram_counts(df, text_col).collect():  # at most 64^3 rows
        n[row.code] = row.n
    n = n.reshape(BASE, BASE, BASE)
    one = (n.sum(axis=(0, 1)) + 0.5) / (n.sum() + 0.5 * BASE)
    two = (n.sum(axis=0) + 20 * one) / (n.sum(axis=(0, 2))[:, None] + 20)
    three = (n + 20 * two[None]) / (n.sum(axis=2)[:, :, None] + 20)
    return np.log(three).astype(np.float32).ravel()


# Decoder -------------------------------------------------------------------------------------------------------------


def lattice(span: str) -> list[list[tuple[int | None, str, float]]]:
    """Choices at every character: (symbol, letter, log probability); symbol None writes nothing."""
    out, last, run = [], "", 0
    spaced, lowered = _SPACED_RUN.fullmatch(span) is not None, span.lower()
    begin, end = len(lowered) - len(lowered.lstrip(_MARKS)), len(lowered.rstrip(_MARKS))
    for k, c in enumerate(lowered):
        if c in SEPARATORS and (spaced or (not c.isspace() and 0 < k < len(lowered) - 1)):
            again = k > 0 and lowered[k - 1] in SEPARATORS  # of several separators one may stand between words
            out.append([(None, "", 0.0 if again else SPACED if spaced else JOINED), (0, " ", BETWEEN if spaced else 0.0)])
            continue
        run = run + 1 if c == last else 1
        if c.isalpha():
            choices = [(_CODE.get(c, OTHER), c, 0.0)]
        elif c in LEET:
            choices = [(_CODE[x], x, SUBSTITUTED) for x in LEET[c]] + [(0, " ", MARK)]
            if (k < begin or k >= end) and run == 1:
                choices.append((None, "", BEFORE if k < begin else EXCLAIMED if c == "!" else BEHIND))
        else:
            choices = [(0, " ", 0.0)]
        if run > 1 and (c.isalpha() or c in LEET):
            choices.append((None, "", (DOUBLED_SPACED if spaced else DOUBLED) if run == 2 else REPEATED))
        last = c
        out.append(choices)
    return out


def decode(span: str, model: list[float]) -> str:
    """Most probable text behind ``span``: Viterbi over its lattice; a state is the last two symbols written."""
    states: dict = {(0, 0): (0.0, None)}
    for choices in lattice(span):
        after: dict = {}
        for (a, b), (score, back) in states.items():
            for symbol, letter, cost in choices:
                if symbol is None:
                    key, now, path = (a, b), score + cost, back
                else:
                    key, now, path = (b, symbol), score + cost + model[(a * BASE + b) * BASE + symbol], (back, letter)
                if key not in after or now > after[key][0]:
                    after[key] = (now, path)
        states = after
    _, path = max(((s + model[(a * BASE + b) * BASE], p) for (a, b), (s, p) in states.items()), key=lambda x: x[0])
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


def _in_marks(core: str) -> bool:
    """Digits and marks that are no number, amount or time."""
    kinds = {c for c in core if c in LEET}
    return len(kinds) > 1 and not all(map(str.isdigit, kinds)) and not _NUMBER.fullmatch(core)


def suspicious_spans(text: str) -> list[tuple[int, int]]:
    """Spans with more than one path through the lattice: letters spaced out one by one; words with a leet character, a
    doubled letter, or a separator between letters or marks. A word without letters has to be written in marks (``@$$``)."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.minimum(raw, _TOP)
    if not len(c):
        return []
    lowered, spans = np.where(c < _TOP, _LOWERED[c], raw), []
    sep = np.concatenate(([True], _SEP[c], [True]))
    # Three letters in a row that stand alone.
    gaps = np.diff(np.flatnonzero(sep[:-2] & ~sep[1:-1] & sep[2:])) <= 4
    if (gaps[1:] & gaps[:-1]).any():
        spans += [m.span() for m in _SPACED_RUN.finditer(text)]
    at = [np.flatnonzero((lowered[1:] == lowered[:-1]) & _DOUBLES[c[1:]]), np.flatnonzero(_PIVOT[c])]
    if len(c) > 2:
        at.append(np.flatnonzero(_INNER[c[1:-1]] & ~sep[1:-3] & ~sep[3:-1] | _INNER[c[1:-1]] & _INNER[c[2:]] & ~sep[1:-3]) + 1)
    blank = _BLANK[c]
    if raw.max() >= _TOP:
        blank |= np.isin(raw, _WIDE_BLANKS)
    # The words around these places, each once.
    places = np.concatenate(at)
    places, blanks = places[~blank[places]], np.flatnonzero(blank)
    ends = np.concatenate((blanks, [len(c)]))
    for number in np.unique(np.searchsorted(blanks, places)).tolist():
        start, end = int(ends[number - 1]) + 1 if number else 0, int(ends[number])
        word = text[start:end]
        core = word.strip(_EDGES)
        if core and (any(map(str.isalpha, core)) or _in_marks(core)):
            begin = start + word.find(core)
            spans.append((begin, begin + len(core)))
    spans.sort()
    kept: list[tuple[int, int]] = []
    for s, e in spans:
        if kept and s < kept[-1][1]:
            kept[-1] = (kept[-1][0], max(e, kept[-1][1]))
        else:
            kept.append((s, e))
    return kept


def restore(text: str, model: list[float], known: Callable[[str], str] | None = None, plain: set[str] | None = None) -> str:
    """``text`` with its suspicious spans decoded; ``known`` decodes short spans, with a cache; ``plain`` receives those of
    letters alone as they are written, since a doubled letter may be right ("worthless")."""
    parts, at = [], 0
    for start, end in suspicious_spans(text):
        span = text[start:end]
        if plain is not None and span.isalpha():
            plain.add(span.lower())
        parts += [text[at:start], known(span) if known and len(span) <= CACHED_CHARS else decode(span, model)]
        at = end
    return "".join([*parts, text[at:]]) if at else text


# Classifier ----------------------------------------------------------------------------------------------------------


class Scorer:
    """Weights of features, the prior and the character model; sums the best weight of each distinct word."""

    def __init__(self, model: np.ndarray, weights: dict[str, float], prior: float):
        self.model, self.prior = model, prior
        self.words = {f: w for f, w in weights.items() if not f.endswith("*")}
        self.starts = {k: {f[:-1]: w for f, w in weights.items() if f.endswith("*") and len(f) == k + 1} for k in PREFIXES}
        self._list: list[float] | None = None
        self._known: TwoGenerations | None = None

    def log_probs(self) -> list[float]:
        if self._list is None:
            self._list = self.model.tolist()
        return self._list

    def known(self, span: str) -> str:
        """Decoded span; words repeat, so a worker keeps those it has seen last."""
        if self._known is None:
            self._known = TwoGenerations(lambda s: decode(s.decode("utf-8", "surrogatepass"), self.log_probs()), CACHED_SPANS)
        return self._known[span.encode("utf-8", "surrogatepass")]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_list": None, "_known": None}

    def words_of(self, text: str) -> set[str]:
        plain: set[str] = set()
        text = text if text.isascii() else _UNSEEN.sub("", text)
        return set(_WORDS.findall(restore(text, self.log_probs(), self.known, plain).lower())) | plain

    def score(self, text: str) -> float:
        words, found = self.words_of(text), {}
        for w in words & self.words.keys():
            found[w] = self.words[w]
        for k, starts in self.starts.items():
            if starts and not starts.keys().isdisjoint({w[:k] for w in words}):
                for w in words:
                    weight = starts.get(w[:k], 0.0) if len(w) >= k else 0.0
                    if weight > found.get(w, 0.0):
                        found[w] = weight
        evidence = self.prior + sum(found.values())
        return 1 / (1 + exp(-max(-30.0, min(30.0, evidence))))


def _local(shared) -> Scorer:
    """The broadcast scorer, once per worker."""
    name, scorer = shared.value
    return held(name, lambda: scorer)


def _share(spark: SparkSession, scorer: Scorer):
    return spark.sparkContext.broadcast((f"scorer-{uuid.uuid4().hex}", scorer))


def _word_rows(df: DataFrame, shared) -> DataFrame:
    """``word`` with the numbers ``a`` and ``b`` of toxic and clean texts that have it, over rows (``text``, ``y``)."""

    def run(batches):
        scorer, found = _local(shared), (Counter(), Counter())

        def rows():
            words = list(found[0].keys() | found[1].keys())
            out = [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in (found[1], found[0]))]
            return pa.RecordBatch.from_arrays(out, ["word", "a", "b"])

        for batch in batches:
            for text, y in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                found[y].update(scorer.words_of(text))
            if len(found[0]) + len(found[1]) > 300_000:
                yield rows()
                found = (Counter(), Counter())
        yield rows()

    return df.select("text", "y").mapInArrow(run, "word string, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _signatures(text: str) -> list[int]:
    """Min-hashes of the word triples, which near copies mostly share."""
    words = text.lower().split()
    hashed = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))], np.uint64)
    return [int((hashed * np.uint64(2 * k + 1) * np.uint64(0x9E3779B97F4A7C15)).min().view(np.int64)) for k in range(SIGNATURES)]


def _without_copies(rows: DataFrame) -> DataFrame:
    """Ids of rows (``id``, ``text``), one of each group that shares a signature."""
    signed = rows.select("id", by_text(lambda: _signatures, "array<bigint>", pa.list_(pa.int64()))(F.col("text")).alias("s"))
    left = stage(signed, "signatures")
    for k in range(SIGNATURES):
        left = left.groupBy(F.col("s")[k]).agg(F.min_by(F.struct("id", "s"), F.xxhash64("id")).alias("r")).select("r.*")
    return left.select("id")


def held_out(id_: Column) -> Column:
    return (F.crc32(id_.cast("string").cast("binary")) % 4) == 2


def _judged(counts: DataFrame, n1: int, n0: int, z: float, least: float) -> DataFrame:
    """``word`` and ``weight`` of the rows (``word``, ``a`` of ``n1``, ``b`` of ``n0``) that chance does not explain."""
    a, b = F.col("a"), F.col("b")
    odds = lambda n, all_: F.log((n + 0.5) / (F.lit(all_) - n + 0.5))
    weight = odds(a, n1) - odds(b, n0) - z * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    share = n1 / (n1 + n0)
    part = lambda n, p: F.when(n > 0, n * F.log(n / ((a + b) * p))).otherwise(0.0)
    gain = part(a, share) + part(b, 1 - share)
    gate = log(max(1, counts.count()) / CHANCE)
    return counts.where(gain >= gate).select("word", weight.alias("weight")).where(F.col("weight") >= least)


def fit(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_rows: int = 20_000, clean_rows: int = 80_000,
    z: float = 1.0, least: float = 2.0,
) -> Scorer:
    """A scorer: character model over all texts, weights from labelled rows that are not held out.

    At most ``toxic_rows`` and ``clean_rows`` labelled rows (those with the least hash of their id) are used, so the list of
    ids is bounded and broadcast. A weight is the lower bound, ``z`` standard errors below the estimate, of the log odds ratio
    between toxic and clean texts; of near copies among the toxic texts one counts. It must be ``least`` or more, and the word's log likelihood gain so large that among all
    words ``CHANCE`` are expected to reach it without a reason. Beginnings of words are judged the same way over their forms,
    each form by ``FORM_TEXTS`` texts at most, so one word does not speak for its beginning ("worth" for "worthless"). Without
    labelled rows of both kinds all texts get the prior.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    model = language_model(rows)
    shared = _share(spark, Scorer(model, {}, 0.0))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~F.coalesce(held_out(F.col("id")), F.lit(False)))
    known = known.groupBy("id").agg(F.max("y").alias("y"))

    def sample(y: int, size: int) -> DataFrame:
        return known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(size)

    toxic = stage(sample(1, toxic_rows), "toxic")
    single = _without_copies(rows.join(F.broadcast(toxic), "id"))
    ids = stage(toxic.join(single, "id", "left_semi").select("id", "y").union(sample(0, clean_rows)), "sample")
    words = stage(_word_rows(rows.join(F.broadcast(ids), "id"), shared), "words")
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    used = {r.y: r.n for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = used.get(1, 0), used.get(0, 0)
    weights = {}
    if n1 and n0:
        judged = _judged(words, n1, n0, z, least)
        weights = {r.word: r.weight for r in judged.collect()}
        capped = words.select("word", F.least("a", F.lit(FORM_TEXTS)).alias("a"), F.least("b", F.lit(FORM_TEXTS)).alias("b"))
        pairs = capped.agg(F.sum("a"), F.sum("b")).first()
        for k in PREFIXES:
            starts = capped.where(F.length("word") >= k).groupBy(F.substring("word", 1, k).alias("word")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("forms"))
            weights |= {f"{r.word}*": r.weight for r in _judged(starts.where("forms > 2"), pairs[0], pairs[1], z, least).collect()}
    return Scorer(model, weights, log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5)) if counts else -2.0)


def score(column: Column, scorer: Scorer, spark) -> Column:
    """Probability that a text is toxic; null is the empty text, which gets the prior."""
    shared = _share(spark, scorer)
    return by_text(lambda: _local(shared).score, "double", pa.float64())(column)


def score_all(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row of ``df``; repeated rows come back each.

    A null id is not held out and never learned from; a null, empty or blank text has the prior as its score. Scores read the
    text alone. Other columns are not read. An empty table gives no rows.
    """
    scorer = fit(df, labels, id_col, text_col)
    id_ = F.col(f"`{id_col}`")
    rows = df.select(id_.alias("doc_id"), score(F.col(f"`{text_col}`").cast("string"), scorer, df.sparkSession).alias("score"))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``df`` that score below ``threshold``, with all their columns."""
    name = fresh(df.columns, "toxicity")
    scored = df.withColumn(name, score(F.col(f"`{text_col}`").cast("string"), fit(df, labels, id_col, text_col), df.sparkSession))
    return scored.where(F.col(name) < threshold).drop(name)
