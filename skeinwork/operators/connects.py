"""TCP connect attempts: opened by ``tcp_connect``, ended by the first event that decides them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork import constants as C
from skeinwork.operators import scan

KEY = ["src_ip", "src_port", "dst_ip", "dst_port"]
SENDS = ["write", "writev", "sendto", "sendmsg"]


def outcome(name: Column, ret: Column, old_state: Column, new_state: Column) -> Column:
    """What one event says: "open" (attempt goes on), "success", "failure", or null (nothing)."""
    established = 1
    return (F.when(name == "tcp_connect", F.when(ret == 0, "open").otherwise("failure"))
            .when(name == "connect", F.when(ret == 0, "success").when(ret.isin(C.CONNECT_PENDING), "open").otherwise("failure"))
            .when(name == "tcp_set_state", F.when((old_state == established) | (new_state == established), "success"))
            .when(name.isin(SENDS), "success"))


def number_attempts(events: DataFrame, slice_ns: int = scan.DEFAULT_SLICE_NS) -> DataFrame:
    """Events that belong to an attempt, with its number and what the event says (``__o``).

    ``tcp_connect`` opens an attempt when none is open; an attempt ends at its first deciding event. So an event
    belongs to one when the last opening or decision before it is an opening, or when it opens one itself.
    Events: KEY, ts_ns, seq, name, ret, old_state, new_state, pid.
    """
    sl = scan.SLICE
    e = events.where(F.col("src_port") != 0).withColumn("__o", outcome(F.col("name"), F.col("ret"), F.col("old_state"), F.col("new_state")))
    e = e.where(F.col("__o").isNotNull()).withColumn(sl, scan.time_slice("ts_ns", slice_ns))
    start = F.col("name") == "tcp_connect"
    decided = F.col("__o") != "open"
    # Only openings and decisions change whether an attempt is open after them.
    e = e.withColumns({"__start": start, "__mark": F.when(start | decided, ~decided)})
    w = Window.partitionBy(*KEY, sl).orderBy("ts_ns", "seq")
    rows = e.withColumn("__before", F.last("__mark", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("__opens", (F.col("__start") & ~F.coalesce("__before", F.lit(True))).cast("int"))
    # Rows in front of the first mark of a slice, and that mark, are decided by the slices before.
    at = F.struct("ts_ns", "seq")
    slices = rows.groupBy(*KEY, sl).agg(
        F.min_by("__start", F.when(F.col("__mark").isNotNull(), at)).alias("__first"), F.max_by("__mark", F.when(F.col("__mark").isNotNull(), at)).alias("__last"),
        F.sum("__opens").alias("__n"))
    ws = Window.partitionBy(*KEY).orderBy(sl)
    earlier = ws.rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("__open", F.coalesce(F.last("__last", ignorenulls=True).over(earlier), F.lit(False)))
    slices = slices.withColumn("__head", (F.coalesce("__first", F.lit(False)) & ~F.col("__open")).cast("int"))
    slices = slices.withColumn("__base", F.coalesce(F.sum(F.col("__n") + F.col("__head")).over(earlier), F.lit(0)))
    out = scan.join_same(rows, slices.select(*KEY, sl, "__open", "__base"), [*KEY, sl])
    opened = F.coalesce("__before", "__open")
    opens = (F.col("__start") & ~opened).cast("int")
    numbered = out.withColumns({"__is": opened | (opens == 1), "__opens": opens})
    numbered = numbered.withColumn("attempt", F.col("__base") + F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.where("__is").select(*events.columns, "__o", "attempt")


def attempts(events: DataFrame, slice_ns: int = scan.DEFAULT_SLICE_NS) -> DataFrame:
    """One row per attempt with its outcome, null while it is open."""
    return summarize(number_attempts(events, slice_ns))


def summarize(numbered: DataFrame) -> DataFrame:
    at = F.struct("ts_ns", "seq")
    return numbered.groupBy(*KEY, "attempt").agg(
        F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"),
        F.max_by("__o", F.when(F.col("__o") != "open", at)).alias("outcome"),
        F.max_by("ret", F.when(F.col("__o") == "failure", at)).alias("code"),
        F.max_by("pid", F.when(F.col("pid") != 0, at)).alias("pid"))


def finished(att: DataFrame) -> DataFrame:
    """Metric rows of ended attempts: one connect each, a duration for successful ones."""
    ok = F.col("outcome") == "success"
    return att.where(F.col("outcome").isNotNull()).select(
        *KEY, "attempt", F.coalesce("pid", F.lit(0)).alias("pid"), ok.alias("success"), F.when(ok, 0).otherwise(F.col("code")).cast("long").alias("errno"),
        F.col("last_ns").alias("ts_ns"), F.lit(1).cast("long").alias("connect_total"),
        F.when(ok, F.col("last_ns") - F.col("first_ns")).alias("connect_duration_nanoseconds_total"))


def expire(open_: DataFrame, sockets: DataFrame, now_ns: Column, wait_s: int = C.CONNECT_WAIT_S) -> DataFrame:
    """Outcome of attempts that waited long enough, by the state of their socket; null goes on waiting."""
    s = sockets.groupBy("pid", F.col("local_ip").alias("src_ip"), F.col("local_port").alias("src_port"), F.col("remote_ip").alias("dst_ip"),
                        F.col("remote_port").alias("dst_port")).agg(F.max("state").alias("state"))
    due = open_.where((F.coalesce("pid", F.lit(0)) != 0) & (now_ns - F.col("first_ns") >= F.lit(wait_s * 1_000_000_000)))
    state = F.col("state")
    return due.join(s, ["pid", *KEY], "left").withColumn(
        "outcome", F.when(state.isNull(), "failure").when(state.isin("02", "03"), None).otherwise("success"))
