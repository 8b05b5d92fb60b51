"""Metric time series: growth, rates, quantiles, set operations on label sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.operators import scan


def deltas(samples: DataFrame, keys: list[str], ts: str = "ts", value: str | list[str] = "value", slice_: Column | None = None) -> DataFrame:
    """Growth from the sample before: a counter that went down started again from 0; the first sample grows 0.

    One value gives column ``delta``; a list gives ``delta_<value>`` for each, in one pass. Without ``slice_`` long series are
    cut by their number of samples, for which the samples are counted first.
    """
    values = [value] if isinstance(value, str) else list(value)
    cut = samples if slice_ is not None else scan.balanced_slices(samples, keys, ts)
    seen = scan.carry_last(cut, keys, [ts], {f"__prev_{v}": F.col(v) for v in values}, slice_ if slice_ is not None else F.col("__fine"))

    def grown(v):
        prev, now = F.col(f"__prev_{v}"), F.col(v)
        return F.when(prev.isNull(), F.lit(0)).when(now < prev, now).otherwise(now - prev).cast("long")

    names = {v: "delta" if isinstance(value, str) else f"delta_{v}" for v in values}
    return seen.withColumns({names[v]: grown(v) for v in values}).drop("__fine", *[f"__prev_{v}" for v in values])


def increase(samples: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", step: Column | None = None,
             slice_: Column | None = None) -> DataFrame:
    """Growth per series over the whole range, or per ``step``. Plain sum of growth, no extrapolation to range ends."""
    d = deltas(samples, keys, ts, value, slice_)
    group = list(keys) if step is None else [*keys, step.alias("step")]
    return d.groupBy(*group).agg(F.sum("delta").cast("long").alias("increase"))


def rate(samples: DataFrame, keys: list[str], seconds: int, **kw) -> DataFrame:
    return increase(samples, keys, **kw).withColumn("rate", F.col("increase").cast("double") / float(seconds)).drop("increase")


def avg_over_time(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return samples.groupBy(*keys).agg((F.sum(value).cast("double") / F.count(value).cast("double")).alias("avg"))


def latest(samples: DataFrame, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Last value of each series; something that is no number reads as 0."""
    return samples.groupBy(*keys).agg(F.coalesce(F.max_by(value, ts), F.lit(0)).alias("value"))


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Quantile from cumulative buckets (le, cumulative, total) by linear interpolation.

    A rank above the last bound gives that bound. A group has one row per bound, so the window is small.
    """
    w = Window.partitionBy(*keys).orderBy("le")
    b = buckets.withColumns({"__lo": F.coalesce(F.lag("le").over(w), F.lit(0)), "__before": F.coalesce(F.lag("cumulative").over(w), F.lit(0)),
                             "__rank": F.lit(q) * F.col("total").cast("double")})
    inside = F.col("cumulative").cast("double") >= F.col("__rank")
    n = (F.col("cumulative") - F.col("__before")).cast("double")
    value = F.col("__lo").cast("double") + (F.col("le") - F.col("__lo")).cast("double") * ((F.col("__rank") - F.col("__before").cast("double")) / n)
    return b.groupBy(*keys).agg(
        F.coalesce(F.min_by(F.when(n > 0, value).otherwise(F.col("le").cast("double")), F.when(inside, F.col("le"))),
                   F.max("le").cast("double")).alias("quantile"))


def series_and(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), on, "left_semi")


def series_or(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.unionByName(right.join(left.select(*on).distinct(), on, "left_anti"))


def topk(df: DataFrame, k: int, value: str, ties: list[str], within: list[str] = ()) -> DataFrame:
    """The k largest rows per group. The rank limit is applied in every task before the shuffle."""
    if not within:
        return df.orderBy(F.desc(value), *ties).limit(k)
    w = Window.partitionBy(*within).orderBy(F.desc(value), *ties)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")


def retention(files: DataFrame, group: list[str], mtime: str, tie: str, limit: int = 50) -> DataFrame:
    """Files that survive rotation: a group with ``limit`` or more keeps its newest limit / 2 - 1."""
    w = Window.partitionBy(*group).orderBy(F.desc(mtime), F.desc(tie))
    newest = files.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") < limit)
    counts = files.groupBy(*group).agg(F.count("*").alias("__n"))
    keep = (F.col("__n") < limit) | (F.col("__rn") <= limit // 2 - 1)
    return newest.join(counts, group).where(keep).drop("__rn", "__n")


def listing(df: DataFrame, order: list[tuple[str, bool]], size: int, after: tuple | None = None, more: str = "more") -> DataFrame:
    """The first ``size`` rows in order of ``order`` (column, descending) behind the row with the key ``after``.

    ``more`` says whether rows are left behind the page; the key of its last row is the next page's ``after``. Key columns
    are not null and name a row. The row limit is applied in every task before the rows meet.
    """
    if after is not None:
        behind, equal = F.lit(False), F.lit(True)
        for (name, down), value in zip(order, after, strict=True):
            col = F.col(name)
            behind = behind | (equal & (col < value if down else col > value))
            equal = equal & (col == value)
        df = df.where(behind)
    sort = [F.desc(name) if down else F.asc(name) for name, down in order]
    found = df.orderBy(*sort).limit(size + 1)
    # At most size + 1 rows are left.
    w = Window.orderBy(*sort)
    ranked = found.withColumns({"__rn": F.row_number().over(w), "__n": F.count("*").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    return ranked.where(F.col("__rn") <= size).withColumn(more, F.col("__n") > size).drop("__rn", "__n")


def page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """One page by keyset: rows behind the last key of the page before."""
    src = df if after is None else df.where(F.col(key) > after)
    return src.orderBy(key).limit(size)


def total_pages(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.ceil(F.count("*") / F.lit(size)).cast("long").alias("pages"))
