"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import by_text, fresh, held

# Runs of ASCII letters, digits and characters beyond ASCII; A-Z count as a-z.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FOUND = pa.list_(pa.struct([("item", pa.int32()), ("shared", pa.int64())]))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """Hashed anew for every text: a cache of words takes longer, and memory."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every run of ``size`` word hashes."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _MULTIPLIER + hashes[k : k + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


class Signature:
    """One-permutation MinHash: ``bins`` parts of the hash range, of each the least hash."""

    def __init__(self, upper: int):
        self.window = 2 * upper - 1  # a run of up to ``upper`` shingles lies in a window that starts at a multiple of upper
        self.step = upper
        self.bins = max(256, 1 << (4 * upper - 1).bit_length())
        self.shift = np.uint64(64 - (self.bins.bit_length() - 1))

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        ordered = np.unique(hashes)
        _, first = np.unique(ordered >> self.shift, return_index=True)
        return ordered[first]

    def is_minimum(self, hashes: np.ndarray, at: int, start: int) -> bool:
        """Whether the hash at ``at`` is its bin's least one in the window from ``start``."""
        window = hashes[max(0, start) : start + self.window]
        return not np.any((window >> self.shift == hashes[at] >> self.shift) & (window < hashes[at]))


class Index:
    """Items in partitions by their number of distinct shingles: (2^(c-1), 2^c]. Each partition has a table from the minima
    of its items' signatures to the items."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, threshold: float):
        self.shingle, self.threshold = shingle, threshold
        self.partitions: dict[int, tuple[Signature, dict[int, list[int]]]] = {}
        self.shingles: dict[int, dict[int, tuple]] = {}
        for item, text in items:
            words = words_of(text)
            hashes = self.hashes(words)
            own = {h: tuple(words[k : k + shingle]) for k, h in enumerate(hashes.tolist())}
            if not own:
                continue
            self.shingles[item] = own
            upper = 1 << (len(own) - 1).bit_length()
            if upper not in self.partitions:
                self.partitions[upper] = (Signature(upper), defaultdict(list))
            signature, table = self.partitions[upper]
            for m in signature.minima(np.array(list(own), np.uint64)).tolist():
                table[m].append(item)
        every = np.unique(np.array([m for _, t in self.partitions.values() for m in t], np.uint64))
        self.size = max(1 << 16, 1 << (16 * len(every)).bit_length())
        self.mask = np.uint64(self.size - 1)
        self.known = np.zeros(self.size, bool)
        self.known[(every & self.mask).astype(np.int64)] = True

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(words) < self.shingle:
            return np.zeros(0, np.uint64)
        return _shingle_hashes(_word_hashes(words), self.shingle)

    def candidates(self, hashes: np.ndarray) -> set[int]:
        """Items one of whose signature's minima is a minimum of a window of the document, too.

        A window without a hash that is some item's minimum cannot meet an item, so only the others' signatures are looked at.
        """
        found: set[int] = set()
        for at in np.flatnonzero(self.known[(hashes & self.mask).astype(np.int64)]).tolist():
            h = int(hashes[at])
            for signature, table in self.partitions.values():
                items = table.get(h)
                if not items or found.issuperset(items):
                    continue
                last = at // signature.step * signature.step
                starts = range(last, max(-1, at - signature.window), -signature.step)
                if any(signature.is_minimum(hashes, at, s) for s in starts):
                    found.update(items)
        return found

    def search(self, text: str) -> list[dict]:
        """Items contained in the text: of an item's distinct shingles ``threshold`` or more occur in it, word by word."""
        words = words_of(text)
        hashes = self.hashes(words)
        if not len(hashes):
            return []
        out = []
        for item in sorted(self.candidates(hashes)):
            own = self.shingles[item]
            at = np.flatnonzero(np.isin(hashes, np.array(list(own), np.uint64))).tolist()
            shared = {int(hashes[k]) for k in at if tuple(words[k : k + self.shingle]) == own[int(hashes[k])]}
            if len(shared) >= self.threshold * len(own) - 1e-9:
                out.append({"item": item, "shared": len(shared)})
        return out


def _index(name: str, shared) -> Index:
    return held(name, lambda: Index(*shared.value))


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = 1 << 24) -> list[list[tuple[int, int, str]]]:
    """Distinct items in blocks of some ``block_bytes`` of text, as (number in its block, id, text).

    Every block is broadcast and searched for in a pass over the documents of its own, so a benchmark of any size is searched
    whole while a worker holds one block.
    """
    rows = items.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    part = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    found = ([(r.id, r.text) for r in part.where(F.col("block") == b).orderBy("id", "text").collect()] for b in range(blocks))
    return [[(k, i, t) for k, (i, t) in enumerate(block)] for block in found if block]


def contained(column: Column, block: list[tuple[int, int, str]], spark, shingle: int, threshold: float) -> Column:
    """Numbers of the block's items that a text contains, with the number of shingles shared."""
    shared = spark.sparkContext.broadcast(([(k, t) for k, _, t in block], shingle, threshold))
    name = f"index-{uuid.uuid4().hex}"
    return by_text(lambda: _index(name, shared).search, "array<struct<item:int,shared:bigint>>", _FOUND)(column)


def find_contained(docs: DataFrame, items: DataFrame, shingle: int = 5, threshold: float = 0.8, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``item_id``, ``n_shared``, ``n_shingles``, ``containment`` of every document and item it contains.

    Containment is the share of an item's distinct ``shingle``-word shingles that the whole document has. Documents are
    searched in overlapping windows of twice an item's size, whose resemblance to a contained item does not fall with the
    document's length; verification is on the whole document. Null texts and texts or items of fewer than ``shingle`` words
    have no shingles and are in no result. A repeated document row comes back as often, a repeated item row once; items that
    share an id but not a text come back each. Other columns are not read.
    """
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    for block in item_blocks(items, item_col, text_col):
        index = Index([(k, t) for k, _, t in block], shingle, threshold)
        names = spark.createDataFrame([(k, i, len(index.shingles.get(k, ()))) for k, i, _ in block], "item int, item_id long, n_shingles long")
        hits = rows.select("doc_id", contained(F.col("text"), block, spark, shingle, threshold).alias("f")).select("doc_id", F.inline("f"))
        part = hits.join(F.broadcast(names), "item").select("doc_id", "item_id", F.col("shared").alias("n_shared"), "n_shingles", (F.col("shared") / F.col("n_shingles")).alias("containment"))
        out = part if out is None else out.unionAll(part)
    empty = "doc_id long, item_id long, n_shared long, n_shingles long, containment double"
    return spark.createDataFrame([], empty) if out is None else out


def drop_contaminated(docs: DataFrame, items: DataFrame, shingle: int = 5, threshold: float = 0.8, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns. Nothing is shuffled."""
    name, spark = fresh(docs.columns, "contained"), docs.sparkSession
    for block in item_blocks(items, text_col="text"):
        column = contained(F.col(f"`{text_col}`").cast("string"), block, spark, shingle, threshold)
        docs = docs.withColumn(name, F.size(column)).where(F.col(name) == 0).drop(name)
    return docs


SQL = """
WITH item_words AS (
    SELECT DISTINCT item_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL),
item_shingles AS (
    SELECT DISTINCT item_id, text, array_to_string(w[k:k + 4], ' ') AS s FROM item_words, unnest(range(1, len(w) - 3)) AS t(k)),
sizes AS (SELECT item_id, text, count(*) AS n_shingles FROM item_shingles GROUP BY ALL),
doc_words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
doc_shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM doc_words, unnest(range(1, len(w) - 3)) AS t(k)),
shared AS (
    SELECT d.doc_id, i.item_id, i.text, count(*) AS n_shared FROM doc_shingles d JOIN item_shingles i USING (s) GROUP BY ALL)
SELECT doc_id, shared.item_id, n_shared, n_shingles, n_shared / n_shingles::DOUBLE AS containment
FROM shared JOIN sizes USING (item_id, text) WHERE n_shared >= 0.8 * n_shingles - 1e-9
"""
