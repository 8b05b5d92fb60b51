"""Streams that the built-in streaming operators express: windows, de-duplication, snapshots on a timer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.operators import aggregate
from skeinwork.operators.scan import boxed, from_plain, plain_columns
from skeinwork.streaming.packs import packer
from skeinwork.streaming.seconds import BUCKETS, Seconds


def with_time(df: DataFrame, ts: str, delay: str, name: str = "event_time") -> DataFrame:
    """Timestamp column from nanoseconds and its watermark."""
    return df.withColumn(name, F.timestamp_micros(F.floor(F.col(ts) / 1000))).withWatermark(name, delay)


def preagg(records: DataFrame, keys: list[str], config: dict, ts: str = "ts_ns", every: str = "5 seconds", delay: str = "5 seconds") -> DataFrame:
    """Aggregate per label set and tumbling window of event time; a window is emitted once, when it is over."""
    timed = with_time(records, ts, delay)
    w = F.window("event_time", every)
    exprs = aggregate.agg_exprs(records.columns, config, F.struct(ts))
    out = timed.groupBy(w, *keys).agg(*exprs)
    return out.select(F.unix_micros("window.start").alias("window_us"), *[c for c in out.columns if c != "window"])


def segments(events: DataFrame, keys: list[str] = ("pid", "tid"), delay: str = "40 seconds", payload: list[str] = ("seq",), buckets: int = BUCKETS) -> DataFrame:
    """One-second segments of a thread: an event is in every second it touches; what is older than the watermark is late
    and dropped. A segment is emitted once. A group is one thread's second, which bounds the list.

    Events wait in ``buckets`` (``Seconds``), a thread's in another one for every 64 seconds.
    """
    start, end, chunk = F.floor(F.col("start_ns") / 1_000_000_000), F.floor(F.col("end_ns") / 1_000_000_000), F.col("chunk")
    span = events.withColumns({"lo": F.least(start, end), "hi": F.greatest(start, end)}).where(start.isNotNull() & end.isNotNull())
    parts = span.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("lo") / 64), F.floor(F.col("hi") / 64))))
    key, value = plain_columns(events, keys, "k"), plain_columns(events, payload, "v")
    rows = parts.select(F.pmod(F.xxhash64(*keys, "chunk"), F.lit(buckets)).alias("bucket"), *[c.alias(n) for n, c in {**key, **value}.items()],
                        F.greatest("lo", chunk * 64).cast("long").alias("first"), F.least("hi", chunk * 64 + 63).cast("long").alias("last"))
    packed = rows.mapInArrow(packer([*key, *value, "first", "last"], "last"), "bucket long, last long, packed binary")
    # A second is late when its end is; the watermark is that of the seconds' beginnings.
    timed = packed.withColumn("event_time", F.timestamp_seconds(F.col("last") + 1)).withWatermark("event_time", f"{delay} 1 second")
    out = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in key]).add("second", T.LongType()).add("n", T.LongType())
    for c in value:
        out = out.add(c, T.ArrayType(rows.schema[c].dataType))
    every = events.sparkSession.range(buckets).select(F.col("id").alias("bucket")).groupBy("bucket")
    groups = timed.groupBy("bucket").transformWithStateInPandas(Seconds(list(key), list(value)), out, "append", "eventTime", every)
    element = lambda e: F.struct(*[v.alias(c) for c, v in from_plain(e.getField, payload, "v", boxed(events, payload)).items()])
    own = from_plain(F.col, keys, "k", boxed(events, keys))
    return groups.select(*[own[c].cast(events.schema[c].dataType).alias(c) for c in keys], "second", "n", F.array_sort(F.transform(F.arrays_zip(*value), element)).alias("events"))


def trigger(records: DataFrame, apm_pids: DataFrame | None = None, every_s: int = 5, delay: str = "10 seconds", ts: str = "ts_ns") -> DataFrame:
    """Slow server traces that start a profile export: one per (content key, pid) and five seconds.

    A process with an in-process agent is triggered by the agent's traces only.
    """
    slow = records.where(F.col("is_slow") & F.col("is_server"))
    if apm_pids is not None:
        known = apm_pids.select("pid").distinct().withColumn("__apm", F.lit(True))
        slow = slow.join(known, "pid", "left").where(F.col("__apm").isNull() | F.coalesce("from_apm", F.lit(False))).drop("__apm")
    timed = with_time(slow.withColumn("bucket", F.floor(F.col(ts) / (every_s * 1_000_000_000))), ts, delay)
    return timed.dropDuplicatesWithinWatermark(["content_key", "pid", "bucket"]).select("content_key", "pid", "bucket")


def workload_info(ticks: DataFrame, pods: DataFrame, path: str, checkpoint: str, every: str = "15 seconds", node: str | None = None, once: bool = False):
    """Write the workload rows of a snapshot table again at every tick of ``ticks`` (any stream, e.g. a rate source)."""
    def emit(_, batch_id):
        aggregate.workload_info(pods, node).withColumn("tick", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/tick={batch_id}")
    writer = ticks.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
