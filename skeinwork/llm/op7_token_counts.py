"""Token counts of whole texts by lengths of pre-tokens: a broadcast table of frequent ones, worker caches for the rest."""

from __future__ import annotations

import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import by_text, held, stage, texts
from skeinwork.llm.encode import TwoGenerations, single_spaced

MARK = "▁"
RARE = 16


class PieceCounter:
    """Token counts by the sentencepiece library.

    The model writes a space as MARK and puts one in front of a text, and no piece has MARK behind another character; so no
    token crosses a single space between words. Line breaks are no part of any longer piece either. A text whose words are
    separated by single white-space characters is the sum of its pre-tokens (" word", or "\\nword" without MARK); every
    other text is counted whole. The assumption about pieces is checked when the model is loaded.
    """

    def __init__(self, path: str, frequent: dict[str, int] | None = None, cache_words: int = 250_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.additive = not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces) and self.whole("a b\na") == self.whole("a") + self.whole("b") + self.whole("\na") - 1
        self.frequent = frequent or {}
        self.misses = TwoGenerations(self._length, cache_words)

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, num_threads=1))

    def _length(self, pre_token: str) -> int:
        # In front of a line break the library's own MARK is a token of its own, which the text does not have there.
        return self.whole(pre_token) - (pre_token[:1] == "\n")

    def count(self, text: str) -> int:
        if not text:
            return 0
        parts = pre_tokens(text) if self.additive else None
        if parts is None:
            return self.whole(text)
        frequent, misses, total = self.frequent, self.misses, 0
        for p in parts:
            n = frequent.get(p)
            total += misses[p] if n is None else n
        return total


def pre_tokens(text: str) -> list[str] | None:
    """Words; those behind a line break begin with it. None for a text that has to be counted whole."""
    return text.replace("\n", " \n").split(" ") if single_spaced(text) and MARK not in text else None


def frequent_pre_tokens(df: DataFrame, text_col: str = "text", size: int = 65_536) -> DataFrame:
    """The ``size`` most frequent pre-tokens of all texts (``word``, ``n``), ties by name.

    Pre-tokens are not shuffled: a task counts all its texts, keeps the heaviest whenever its counter is full (which loses
    only words too rare to matter; the table is a cache and no count depends on it) and sends ``size`` rows at most.
    """

    def run(batches):
        found: Counter = Counter()
        for batch in batches:
            for text in texts(batch.column(0)):
                found.update(pre_tokens(text) or ())
                if len(found) > 8 * size:
                    found = Counter(dict(found.most_common(2 * size)))
        top = found.most_common(size)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    rows = df.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    found = stage(rows.groupBy("word").agg(F.sum("n").alias("n")), "frequent")
    # At most RARE x size words have this share or more of all, and only they are ordered: without that every partition would
    # send the driver size rows.
    total = found.agg(F.sum("n")).first()[0] or 0
    return found.where(F.col("n") * RARE * size >= total).orderBy(F.desc("n"), "word").limit(size)


def _counter(name: str, path: str, shared) -> PieceCounter:
    def make():
        words, lengths = shared.value
        return PieceCounter(path, dict(zip(words.to_pylist(), lengths.to_pylist(), strict=True)))

    return held(name, make)


def count_tokens(df: DataFrame, model: str, text_col: str = "text", table_size: int = 65_536) -> Column:
    """Column of token counts for the rows of ``df``.

    The first tier is made here: the frequent pre-tokens of all of ``df`` with their lengths, two arrays of at most
    ``table_size`` entries, which every worker gets by broadcast and turns into a hash table. Words that are not in it are
    encoded where they occur and kept in a bounded cache of the worker.
    """
    words = [r.word for r in frequent_pre_tokens(df, text_col, table_size).collect()]
    lengths = PieceCounter(model, cache_words=1)
    table = pa.array(words, pa.string()), pa.array([lengths._length(w) for w in words], pa.int32())
    shared = df.sparkSession.sparkContext.broadcast(table)
    name = f"counter-{uuid.uuid4().hex}"
    return by_text(lambda: _counter(name, model, shared).count, "bigint", pa.int64())(F.col(f"`{text_col}`").cast("string"))


def counts(df: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", table_size: int = 65_536) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens) of every row.

    A null text is the empty text: no bytes, no tokens. Texts are counted whole, without special tokens. Repeated rows and
    null ids come back each; an empty table gives no rows; other columns are not read. Nothing but the frequent words'
    counts is shuffled.
    """
    text = F.col(f"`{text_col}`").cast("string")
    out = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), count_tokens(df, model, text_col, table_size).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
