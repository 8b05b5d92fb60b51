"""Ordered scans (lag, as-of, running sums) that split a hot key.

A plain ``Window.partitionBy(key).orderBy(ts)`` puts all rows of one key into one task. Here every key is cut
into slices of consecutive rows (usually time slices). Rows are windowed inside (key, slice); one summary row
per (key, slice) is scanned over the slices of a key, and what it carries is joined back. The largest unit of
work is then one slice, or the slice count of one key, never the rows of one key.

A null key is a key, and ``slice_`` has to be a non-decreasing function of the order columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = "__slice"
DEFAULT_SLICE_NS = 60 * 1_000_000_000


def time_slice(ts: str | Column, width_ns: int = DEFAULT_SLICE_NS) -> Column:
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(col / F.lit(width_ns))


def balanced_slices(df: DataFrame, keys: list[str], at: str, width: int | None = None, rows: int = 1_000_000, name: str = "__fine") -> DataFrame:
    """Add ``name``, a slice for the scans that holds about ``rows`` rows of its key at most, however they lie in time.

    A key is cut by ``width`` of ``at`` (not at all without one). Slices of more rows are cut again, at 63 approximate
    quantiles of their own: a burst of a second becomes many slices, and a quiet key stays one. Counts and quantiles are
    aggregations with partial sums; the cuts are a row per full slice. Rows of one and the same ``at`` stay together.
    """
    coarse = F.floor(F.col(at) / F.lit(width)) if width else F.lit(0)
    marked = df.withColumn("__coarse", coarse.cast("long"))
    full = marked.groupBy(*keys, "__coarse").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows).drop("__n")
    heavy = join_same(marked.select(*keys, "__coarse", at), full, [*keys, "__coarse"])
    cuts = heavy.groupBy(*keys, "__coarse").agg(F.percentile_approx(at, [k / 64 for k in range(1, 64)], 10_000).alias("__cuts"))
    cut = join_same(marked, cuts, [*keys, "__coarse"], "left")
    behind = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(at))), F.lit(0))
    fine = F.col("__coarse") * 64 + F.when(F.col("__cuts").isNull(), 0).otherwise(behind)
    return cut.select(*df.columns, fine.alias(name))


def sliced(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt by key and slice, once for the windows inside slices and the summaries of slices.

    Both are planned on this exchange. Summaries take whole rows (``whole``), so that they need the same columns of it and
    Spark runs it and what is below it once.
    """
    return df.repartition(*keys, SLICE)


def whole(df: DataFrame, first: str) -> Column:
    """A struct of ``first`` and all columns."""
    return F.struct(F.col(first).alias("__first"), *[F.col(c).alias(f"__c{k}") for k, c in enumerate(df.columns)])


def _rows_window(keys, order):
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def _slice_window(keys):
    return Window.partitionBy(*keys).orderBy(SLICE)


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null."""
    there = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(there, same, how).drop(*[f"__r_{k}" for k in keys])


def carry_last(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], slice_: Column,
               where: Column | None = None) -> DataFrame:
    """Add, per row, the values of the latest earlier row of the key that satisfies ``where``."""
    packed = F.struct(*[v.alias(n) for n, v in values.items()])
    if where is not None:
        packed = F.when(where, packed)
    rows = sliced(df.withColumn(SLICE, slice_).withColumn("__v", packed), keys)
    before = _rows_window(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("__local", F.last("__v", ignorenulls=True).over(before))
    # One summary row per slice; a slice without a qualifying row has a null tail and passes the carry on.
    tails = rows.groupBy(*keys, SLICE).agg(F.max_by(whole(rows, "__v"), F.when(F.col("__v").isNotNull(), F.struct(*order))).alias("__t"))
    tails = tails.select(*keys, SLICE, F.col("__t.__first").alias("__tail"))
    carried = (tails.withColumn("__carry", F.last("__tail", ignorenulls=True)
                                .over(_slice_window(keys).rowsBetween(Window.unboundedPreceding, -1)))
               .select(*keys, SLICE, "__carry"))
    out = join_same(local, carried, [*keys, SLICE], "left").withColumn("__hit", F.coalesce("__local", "__carry"))
    keep = [F.col(c) for c in df.columns]
    return out.select(*keep, *[F.col(f"__hit.{n}").alias(n) for n in values])


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, slice_: Column) -> DataFrame:
    """Add the running sum of ``value`` including the current row."""
    rows = sliced(df.withColumn(SLICE, slice_).withColumn("__v", value), keys)
    upto = _rows_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("__local", F.sum("__v").over(upto))
    # The running sum at a slice's last row is the slice's sum.
    ends = local.groupBy(*keys, SLICE).agg(F.max_by(whole(local, "__local"), F.struct(*order)).alias("__t"))
    bases = (ends.select(*keys, SLICE, F.col("__t.__first").alias("__n"))
             .withColumn("__base", F.sum("__n").over(_slice_window(keys).rowsBetween(Window.unboundedPreceding, -1)))
             .select(*keys, SLICE, "__base"))
    out = join_same(local, bases, [*keys, SLICE], "left")
    return out.select(*df.columns, (F.coalesce("__base", F.lit(0)) + F.col("__local")).alias(name))


def carry_next(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], slice_: Column) -> DataFrame:
    """Add, per row, the values of the following row of the key (null at the end)."""
    packed = F.struct(*[v.alias(n) for n, v in values.items()])
    rows = sliced(df.withColumn(SLICE, slice_).withColumn("__v", packed), keys)
    local = rows.withColumn("__local", F.lead("__v").over(_rows_window(keys, order)))
    heads = (rows.groupBy(*keys, SLICE).agg(F.min_by(whole(rows, "__v"), F.struct(*order)).alias("__t"))
             .select(*keys, SLICE, F.col("__t.__first").alias("__head")).withColumn("__carry", F.lead("__head").over(_slice_window(keys)))
             .select(*keys, SLICE, "__carry"))
    out = join_same(local, heads, [*keys, SLICE], "left").withColumn("__hit", F.coalesce("__local", "__carry"))
    return out.select(*df.columns, *[F.col(f"__hit.{n}").alias(n) for n in values])


def plain_columns(df: DataFrame, names: list[str], mark: str) -> dict[str, Column]:
    """Columns that are equal where ``names`` are the same, null or not: a text or number that is not null, and a number that says
    which are null. Rows that are dealt by them for a window stay where they are for a join; other types are put in a struct."""
    out = {}
    for i, k in enumerate(names):
        kind = df.schema[k].dataType
        none = F.lit("") if isinstance(kind, T.StringType) else F.lit(0).cast(kind) if isinstance(kind, T.NumericType) else None
        out[f"__{mark}{i}"] = F.struct(k) if none is None else F.coalesce(k, none)
    out[f"__{mark}none"] = reduce(lambda a, b: a + b, [F.col(k).isNull().cast("long") * (1 << i) for i, k in enumerate(names)])
    return out


def from_plain(get: Callable[[str], Column], names: list[str], mark: str, boxed: list[str] = ()) -> dict[str, Column]:
    """What ``plain_columns`` were made of; ``boxed`` are those in structs."""
    out = {}
    for i, k in enumerate(names):
        there = get(f"__{mark}{i}")
        out[k] = there[k] if k in boxed else F.when(get(f"__{mark}none").bitwiseAND(F.lit(1 << i).cast("long")) == 0, there)
    return out


def boxed(df: DataFrame, names: list[str]) -> list[str]:
    return [k for k in names if not isinstance(df.schema[k].dataType, T.StringType | T.NumericType)]


def _hashable(df: DataFrame, struct: str) -> list[Column]:
    """Fields of a struct that can be hashed."""
    return [F.col(f"{struct}.{f.name}") for f in df.schema[struct].dataType.fields if "map<" not in f.dataType.simpleString()]


def asof_join(probes: DataFrame, table: DataFrame, keys: list[str], at: str, table_at: str, values: list[str], slice_width: int,
              forward: bool = False, inclusive: bool = True, ties: list[str] = (), slice_rows: int | None = None, hot_rows: int = 1_000_000) -> DataFrame:
    """Add to each probe row the values of the nearest table row of its key before (or after) it.

    Both sides are merged in order and scanned, so nothing is paired up. A key of up to ``hot_rows`` rows is scanned whole: rows
    move once. One of more rows is hot and cut into slices of ``slice_width``, and with ``slice_rows`` also by count
    (``balanced_slices``); its slices are summarized, scanned and joined back. There are at most rows / ``hot_rows`` hot keys, so
    their list is broadcast.
    ``inclusive`` takes a table row at the very same position too; of equal positions the last by ``ties`` is taken.
    """
    sign = -1 if forward else 1
    row_first = 0 if inclusive else 2
    tie_cols = [F.col(t).alias(f"__tie{i}") for i, t in enumerate(ties)]
    rows = table.select(*keys, (F.col(table_at) * sign).alias("__at"), F.lit(row_first).alias("__side"), *tie_cols,
                        F.struct(*values).alias("__t"))
    rest = [c for c in probes.columns if c not in keys]
    asked = probes.select(*keys, (F.col(at) * sign).alias("__at"), F.lit(1).alias("__side"), F.struct(*rest).alias("__p"))
    merged = asked.unionByName(rows, allowMissingColumns=True)
    order = ["__at", "__side", *[f"__tie{i}" for i in range(len(ties))]]
    slice_ = F.floor(F.col("__at") / F.lit(slice_width))
    if slice_rows:
        merged, slice_ = balanced_slices(merged, keys, "__at", slice_width, slice_rows), F.col("__fine")
        hot_rows = min(hot_rows, slice_rows)
    types = {k: probes.schema[k].dataType for k in keys}
    plain, in_struct = plain_columns(merged, keys, "k"), boxed(merged, keys)
    merged = merged.withColumns(plain).drop(*keys)
    key = list(plain)
    # Counts and summaries read every column: what is below them is then the same as below the scan, and its exchanges run once.
    read = F.max(F.xxhash64(*key, *order, *_hashable(merged, "__p"), *_hashable(merged, "__t")))
    hot = merged.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), read.alias("__read"))
    hot = F.broadcast(hot.where((F.col("__n") > hot_rows) & F.col("__read").isNotNull()).select(*key))
    # Rows of other keys have no slice, and so do the first ones of a hot key that have no position.
    dealt = merged.join(hot.withColumn("__hot", F.lit(True)), key, "left").withColumn(SLICE, F.when(F.col("__hot"), slice_)).drop("__hot").repartition(*key, SLICE)
    local = dealt.withColumn("__local", F.last("__t", ignorenulls=True).over(_rows_window(key, order).rowsBetween(Window.unboundedPreceding, -1)))
    tails = merged.join(hot, key).withColumn(SLICE, slice_).groupBy(*key, SLICE).agg(
        F.max_by("__t", F.when(F.col("__t").isNotNull(), F.struct(*order))).alias("__tail"), read.alias("__read")).where("__read IS NOT NULL")
    before = F.last("__tail", ignorenulls=True).over(_slice_window(key).rowsBetween(Window.unboundedPreceding, -1))
    carried = tails.select(*key, SLICE, before.alias("__carry"))
    hit = local.where("__side = 1").join(carried, [*key, SLICE], "left").withColumn("__hit", F.coalesce("__local", "__carry"))
    own = {**{c: F.col(f"__p.{c}") for c in rest}, **{k: v.cast(types[k]) for k, v in from_plain(F.col, keys, "k", in_struct).items()}}
    return hit.select(*[own[c].alias(c) for c in probes.columns], *[F.col(f"__hit.{v}").alias(v) for v in values])
