"""Sum-of-squares online packing of documents into fixed windows of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import texts
from skeinwork.llm.encode import encoder

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class SumOfSquares:
    """Levels of partially filled windows; ``place`` minimises the sum of squared counts over the levels 1 to size - 1."""

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)  # counts[h]: open windows filled up to h
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]
        self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """Window and level at which a piece of 1 to size - 1 tokens starts; of equal choices the fullest window."""
        size, n = self.size, self.counts
        # Moving a window from h to h + length changes the sum by (1 - 2 n[h]) + (1 + 2 n[h + length]); ends cost nothing.
        change = 1 - 2 * n[: size - length + 1]
        change[0] = 0
        change[: size - length] += 1 + 2 * n[length:size]
        change[1:][n[1 : size - length + 1] == 0] = np.iinfo(np.int64).max
        level = size - length - int(np.argmin(change[::-1]))
        if level:
            window = self.windows[level].pop()
            n[level] -= 1
        else:
            window, self.made = self.made, self.made + 1
        if level + length < size:
            self.windows[level + length].append(window)
            n[level + length] += 1
        return window, level

    def new(self) -> int:
        self.made += 1
        return self.made - 1


def pack_ids(documents: Iterator[tuple[int, bytes]], size: int, base: int) -> Iterator[tuple]:
    """Pieces of one partition as tuples of ``SCHEMA``; ids are 4 bytes each.

    A document's full windows are sequences of their own; the rest is one piece for the sum-of-squares packer. A window
    leaves memory as soon as it is full. When the documents end, the pieces of open windows are dealt anew in order of level,
    cut wherever a window is full; what is left at last (less than a window) is cut into sequences whose lengths are powers
    of two. Open windows hold their pieces: 4 bytes x size x number of open windows, which the packer keeps small.
    """
    packer, open_ = SumOfSquares(size), {}
    for doc, ids in documents:
        total = len(ids) // 4
        start = 0
        while total - start >= size:
            yield doc, start, size, total, base + packer.new(), 0, ids[4 * start : 4 * (start + size)]
            start += size
        if start == total:
            continue
        window, level = packer.place(total - start)
        held = open_.setdefault(window, [])
        held.append((doc, start, total - start, total, base + window, level, ids[4 * start :]))
        if level + total - start == size:
            yield from open_.pop(window)
    levels = {w: h for h, ws in enumerate(packer.windows) for w in ws}
    rest = [p for w in sorted(open_, key=lambda w: (-levels[w], w)) for p in open_[w]]
    left = sum(p[2] for p in rest)
    room = offset = window = 0
    for doc, start, length, total, _, _, ids in rest:
        done = 0
        while done < length:
            if not room:
                room, offset, window = min(size, 1 << (left.bit_length() - 1)), 0, packer.new()
            take = min(room, length - done)
            yield doc, start + done, take, total, base + window, offset, ids[4 * done : 4 * (done + take)]
            room, offset, left, done = room - take, offset + take, left - take, done + take


def pack(df: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of all documents, packed into sequences of at most ``size`` (a power of two) tokens.

    One row per piece: ``doc_id``, ``start`` and ``length`` in the document, ``doc_tokens``, ``sequence_id``, ``offset`` in the
    sequence, ``ids`` (little-endian unsigned 32-bit ids). A document's ids end with ``end_id``; null and empty texts are that
    id alone. Every input partition is packed by itself, without a shuffle; sequence ids carry the partition's number, so a
    recomputed partition gives the same rows. Repeated rows and null ids are packed as documents of their own. An empty table
    gives no rows. Other columns are not read.
    """
    if size < 2 or size & (size - 1):
        raise ValueError("size must be a power of two")
    end = np.array([end_id], "<u4").tobytes()
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [*[pa.int64()] * 6, pa.binary()]

    def run(batches):
        enc, base = encoder(tokenizer), TaskContext.get().partitionId() << 36

        def documents():
            for batch in batches:
                ids, column = batch.column(0).to_pylist(), batch.column(1)
                step = max(1, int((1 << 25) / max(1, column.nbytes / max(1, len(column)))))
                for k in range(0, len(ids), step):
                    for doc, text in zip(ids[k : k + step], texts(column.slice(k, step)), strict=True):
                        yield doc, enc.encode(text) + end

        rows, held = [], 0
        for row in pack_ids(documents(), size, base):
            rows.append(row)
            held += len(row[-1])
            if held > 1 << 23:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """Checksums in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
