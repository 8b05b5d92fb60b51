"""The first of every group of equal rows, with hot groups split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seats(df: DataFrame) -> int:
    """Seats a group is dealt to: as many as the session has shuffle partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def first_of_copies(rows: DataFrame, key: list[str], seat: str, order: Column) -> DataFrame:
    """(``key``, ``seat``, ``first``) of the groups of two rows or more; ``first`` is the least ``order`` of the group.

    A group is the rows of equal ``key``; ``seat`` is a column that spreads the rows of one group, and a join on key and
    seat gives every row its group's first without bringing a hot group together: rows are summed per seat, seats per
    group, and the first goes back to the seats. Groups of one row are left out. An empty table gives an empty table.
    """
    held = rows.groupBy(*key, seat).agg(F.min(order).alias("__least"), F.count(F.lit(1)).alias("__rows"))
    groups = held.groupBy(*key).agg(F.min("__least").alias("first"), F.sum("__rows").alias("__rows")).where("__rows > 1").drop("__rows")
    return held.select(*key, seat).join(groups, key)
