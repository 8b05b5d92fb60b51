"""Shard placement by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.common import fresh

SLOTS = 65_537


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """Number of the shard that owns each slot.

    A shard's name gives an offset and a step; offset, offset + step, ... modulo the prime ``slots`` visits every slot once,
    in the shard's order of preference. Shards take turns, in order of their names, and each claims the first slot of its
    order that is free. Shards differ by one slot at most, and a change of the list moves few slots besides those of the
    shards that came or went.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if not _prime(slots) or slots < len(shards):
        raise ValueError("slots must be a prime that is not below the number of shards")
    digests = {s: hashlib.md5(s.encode()).hexdigest() for s in shards}
    turns = sorted(range(len(shards)), key=lambda k: shards[k])
    place = [int(digests[s][:15], 16) % slots for s in shards]
    step = [int(digests[s][15:30], 16) % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    left = slots
    while left:
        for k in turns[: min(left, len(turns))]:
            at = place[k]
            while owner[at] >= 0:
                at = (at + step[k]) % slots
            owner[at], place[k], left = k, (at + step[k]) % slots, left - 1
    return np.array(owner, np.int32)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key of any type; all null keys have one slot."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def lookup(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """``slot`` and ``shard`` as a table of ``slots`` rows."""
    owner = fill_table(shards, slots)
    return spark.createDataFrame([(slot, shards[k]) for slot, k in enumerate(owner.tolist())], "slot int, shard string")


def place(df: DataFrame, key_col: str, shards: Sequence[str], slots: int = SLOTS, shard_col: str = "shard") -> DataFrame:
    """``df`` with the shard of every row's key.

    Rows stay where they are: the lookup table has ``slots`` rows whatever the data, so it is broadcast, and a row's shard is
    one hash lookup. Equal keys share a shard; null is a key. Use a key that is close to unique: a third of all rows under
    one key is a third of all rows in one shard. A column of the result's name is replaced; nothing else of ``df`` changes.
    """
    slot = fresh(df.columns, "slot")
    table = lookup(df.sparkSession, shards, slots).select(F.col("slot").alias(slot), F.col("shard").alias(f"{slot}_shard"))
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() != shard_col.lower()]
    rows = df.withColumn(slot, slot_of(F.col(f"`{key_col}`"), slots))
    return rows.join(F.broadcast(table), slot).select(*rest, F.col(f"{slot}_shard").alias(shard_col))
