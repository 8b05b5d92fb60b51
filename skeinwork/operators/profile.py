"""Thread profiles: slices of CPU events, sub-events, locks, spans and what a slow request spent its time on.

Times are nanoseconds. ``lo_ns`` / ``hi_ns`` on a row are the range its trace is looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork import constants as C
from skeinwork.functions import text
from skeinwork.operators import scan
from skeinwork.operators.events import const_map
from skeinwork.schema import SEGMENT_LISTS

MS = 1_000_000
S = 1_000_000_000


def first_by_start(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the first by ``order``; rows without a key are dropped."""
    rest = [c for c in df.columns if c not in keys]
    some = df.where(F.coalesce(*keys).isNotNull())
    return some.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")


def unpack_segments(segments: DataFrame) -> DataFrame:
    """The five JSON list columns as arrays of structs; a broken list reads as empty."""
    cols = {c: F.coalesce(F.from_json(F.col(c).cast("string"), t), F.array().cast(t)) for c, t in SEGMENT_LISTS.items()
            if c in segments.columns}
    return segments.withColumns(cols)


def timeline_offsets(cpu: DataFrame) -> DataFrame:
    """One row per slice of a CPU event (start_ns, time_type[], type_specs[], runq[], on_info, off_info, log, stack).

    Slices follow each other from the event's start. The n-th on-slice has the n-th log, stack and on-info, the n-th
    off-slice the n-th off-info and run-queue latency. All of it stays in the row: no shuffle.
    """
    specs, types = F.col("type_specs"), F.col("time_type")

    def one(spec, i):
        before = F.slice(specs, F.lit(1), i)
        start = F.col("start_ns") + F.aggregate(before, F.lit(0).cast("long"), lambda a, x: a + x)
        kinds = F.slice(types, F.lit(1), i)
        on_no = F.size(F.filter(kinds, lambda t: t == 0))
        return F.struct(i.alias("slice_no"), F.get(types, i).alias("type_no"), start.alias("slice_start"),
                        (start + spec).alias("slice_end"), spec.alias("slice_ns"), on_no.alias("on_no"), (i - on_no).alias("off_no"))

    rest = [c for c in cpu.columns if c not in ("type_specs", "time_type", "runq", "on_info", "off_info", "log")]
    rows = cpu.select("*", F.inline(F.transform(specs, one)))
    on = F.col("type_no") == 0

    def nth(column, number):
        return F.nullif(F.get(F.split(column, r"\|"), F.col(number)), F.lit(""))

    return rows.select(*rest, "slice_no", "slice_start", "slice_end", "slice_ns",
                       const_map(C.CPU_TYPES, F.col("type_no").cast("int")).alias("type"), "on_no",
                       F.when(on, nth("on_info", "on_no")).otherwise(nth("off_info", "off_no")).alias("info"),
                       F.when(on, nth("log", "on_no")).alias("log"), F.when(~on, F.get("runq", F.col("off_no"))).alias("runq_us"))


def in_range(slices: DataFrame) -> DataFrame:
    return slices.where(text.overlaps(F.col("slice_start"), F.col("slice_end"), F.col("lo_ns"), F.col("hi_ns")))


def _interval(start, end, duration, **more):
    c = text.clip_interval(start, end, duration, F.col("lo_ns"), F.col("hi_ns"))
    return F.struct(c["start"].alias("start_ns"), c["end"].alias("end_ns"), c["duration"].alias("time_ns"),
                    *[v.alias(k) for k, v in more.items()])


_EXTRA = {"type": "string", "event_type": "string", "on_off": "boolean", "file": "string", "operate": "string", "request_type": "string",
          "size": "string", "runq_us": "bigint", "log": "string"}


def _extra(**given):
    return {k: given[k] if k in given else F.lit(None).cast(t) for k, t in _EXTRA.items()}


def thread_timeline(slices: DataFrame, keys: list[str]) -> DataFrame:
    """Interval rows of threads: each slice in range, its sub-events from the info string and run-queue waits.

    A list of several sub-events keeps those in range; a single file or net sub-event is always kept.
    """
    t = in_range(slices)
    own = _interval(F.col("slice_start"), F.col("slice_end"), F.col("slice_ns"),
                    **_extra(type=F.col("type"), event_type=F.col("type"), on_off=F.lit(False), runq_us=F.col("runq_us").cast("long"),
                             log=F.col("log")))
    many = F.contains(F.col("info"), F.lit("#"))

    def sub(p):
        end = p["start_ns"] + p["duration_ns"]
        shown = F.when(p["type"].isin("file", "net"), F.concat(p["type"], p["operate"])).otherwise(p["type"])
        return _interval(p["start_ns"], end, p["duration_ns"],
                         **_extra(type=p["type"], event_type=shown, on_off=F.lit(True), file=p["file"], operate=p["operate"],
                                  request_type=p["request_type"], size=p["size"]))

    parts = text.info_parts(F.col("info"))
    kept = F.filter(parts, lambda p: F.coalesce(F.when(many, text.overlaps(
        p["start_ns"], p["start_ns"] + p["duration_ns"], F.col("lo_ns"), F.col("hi_ns"))).otherwise(p["type"].isin("file", "net")), F.lit(False)))
    subs = F.when(F.col("info").isNotNull(), F.transform(kept, sub))
    wait = F.when(F.col("runq_us") > 1000, F.array(_runq_struct()))
    none = F.filter(F.array(own), lambda _: F.lit(False))
    rows = F.concat(F.array(own), F.coalesce(subs, none), F.coalesce(wait, none))
    return t.select(*keys, F.inline(rows))


def _runq_struct():
    """Wait in the run queue in front of the end of an off-slice."""
    end = F.least("slice_end", "hi_ns")
    wait = F.col("runq_us").cast("long") * 1000
    extra = _extra(type=F.lit("runqLatency"), event_type=F.lit("runqLatency"), on_off=F.lit(False))
    return F.struct((end - wait).alias("start_ns"), end.alias("end_ns"), wait.alias("time_ns"), *[v.alias(k) for k, v in extra.items()])


def runq_latency(slices: DataFrame, keys: list[str]) -> DataFrame:
    r = in_range(slices).where(F.col("runq_us") > 1000)
    return r.select(*keys, F.inline(F.array(_runq_struct()))).select(*keys, "start_ns", "end_ns", "time_ns")


def thread_logs(slices: DataFrame, keys: list[str]) -> DataFrame:
    """Log texts of on-slices that start inside the range; the text follows the length and ``@``."""
    part = F.get(F.split("log", "@"), F.lit(1))
    inside = (F.col("slice_start") > F.col("lo_ns")) & (F.col("slice_start") < F.col("hi_ns"))
    rows = in_range(slices).where(F.col("log").isNotNull() & inside)
    return rows.select(*keys, F.col("slice_start").alias("start_ns"), part.alias("log")).where(F.coalesce("log", F.lit("")) != "")


def lock_waits(locks: DataFrame, threads: DataFrame, keys: list[str], scope: list[str]) -> DataFrame:
    """Lock intervals in range, one per (thread, start, end), with the name of the thread waited for.

    ``locks``: keys, start_ns, end_ns, data, lo_ns, hi_ns. ``threads``: scope, tid, thread_name.
    """
    s, e = F.col("start_ns"), F.col("end_ns")
    c = text.clip_interval(s, e, e - s, F.col("lo_ns"), F.col("hi_ns"))
    p = text.parse_lock("data")
    cut = (locks.where(text.overlaps(s, e, F.col("lo_ns"), F.col("hi_ns")))
           .select(*keys, c["start"].alias("start_ns"), c["end"].alias("end_ns"), c["duration"].alias("time_ns"), p.alias("l"))
           .select(*keys, "start_ns", "end_ns", "time_ns", F.col("l.address").alias("address"), F.col("l.type").alias("event_type"),
                   F.col("l.stack").alias("stack"), F.col("l.waiter").alias("waiter")))
    rest = F.struct("time_ns", "address", "event_type", "stack", "waiter")
    unique = cut.groupBy(*keys, "start_ns", "end_ns").agg(F.min(rest).alias("r")).select(*keys, "start_ns", "end_ns", "r.*")
    return lock_waiter(unique, threads, scope)


def lock_waiter(locks: DataFrame, threads: DataFrame, scope: list[str]) -> DataFrame:
    names = threads.groupBy(*scope, F.col("tid").cast("string").alias("waiter")).agg(F.min("thread_name").alias("__n"))
    return locks.join(names, [*scope, "waiter"], "left").withColumn("wait_thread", F.coalesce("__n", F.lit("--"))).drop("__n")


def thread_names(events: DataFrame, announced: DataFrame) -> DataFrame:
    """Latest announced name per (pid, tid) in place of the command."""
    last = announced.groupBy("pid", "tid").agg(F.max_by("name", F.struct("ts_ns", "name")).alias("__n"))
    return events.join(last, ["pid", "tid"], "left").withColumn("thread_name", F.coalesce("__n", "comm")).drop("__n")


def trace_intervals(marks: DataFrame, keys: list[str], order: list[str], slice_: Column) -> DataFrame:
    """Alternate entry (1) and exit (0) marks into intervals: leading exits and repeats are skipped, an entry without
    exit gives nothing. Marks with a url are left out and equal timestamps count once."""
    plain = marks.where(F.coalesce("url", F.lit("")) == "")
    rest = [c for c in plain.columns if c not in keys and c != "ts_ns"]
    once = plain.groupBy(*keys, "ts_ns").agg(F.min_by(F.struct(*rest), F.struct(*[o for o in order if o != "ts_ns"] or ["ts_ns"])).alias("r")).select(
        *keys, "ts_ns", "r.*")
    seen = scan.carry_last(once, keys, order, {"__before": F.col("is_entry")}, slice_)
    turn = seen.where(F.when(F.col("__before").isNull(), F.col("is_entry") == 1).otherwise(F.col("__before") != F.col("is_entry"))).drop("__before")
    paired = scan.carry_next(turn, keys, order, {"end_ns": F.col("ts_ns")}, slice_)
    return paired.where((F.col("is_entry") == 1) & F.col("end_ns").isNotNull()).select(
        *keys, F.col("ts_ns").alias("start_ns"), "end_ns", (F.col("end_ns") - F.col("ts_ns")).alias("time_ns"))


def resolve_trace_id(traces: DataFrame, marks: DataFrame, key: list[str], slice_ns: int = scan.DEFAULT_SLICE_NS) -> DataFrame:
    """Trace id of a trace without one: the last transaction its response thread had between start and end.

    The first one of the request thread is reported too, but only the response thread decides.
    ``traces``: key, pid, request_tid, response_tid, start_ns, end_ns, trace_id. ``marks``: pid, tid, ts_ns, trace_id.
    """
    open_ = traces.where(F.coalesce("trace_id", F.lit("")) == "")
    m = marks.select("pid", "tid", F.col("ts_ns").alias("__t"), F.col("trace_id").alias("__id"))
    span = [*key, "pid", "start_ns", "end_ns"]

    def nearest(thread, at, forward, name):
        probe = open_.select(*span, F.col(thread).alias("tid"))
        hit = scan.asof_join(probe, m, ["pid", "tid"], at, "__t", ["__t", "__id"], slice_ns, forward=forward, inclusive=False, ties=["__id"])
        inside = (F.col("__t") > F.col("start_ns")) & (F.col("__t") < F.col("end_ns"))
        return hit.select(*key, F.when(inside, F.col("__id")).alias(name))

    first = nearest("request_tid", "start_ns", True, "request_trace_id")
    last = nearest("response_tid", "end_ns", False, "response_trace_id")
    out = traces.join(first, key, "left").join(last, key, "left")
    return out.withColumn("trace_id", F.coalesce(F.nullif("trace_id", F.lit("")), "response_trace_id"))


def time_breakdown(timeline: DataFrame, locks: DataFrame, carrying: DataFrame, key: list[str]) -> DataFrame:
    """Time and share of the request per type over the threads that carry the trace.

    ``timeline``: key, tid, type, start_ns, end_ns, time_ns, on_off, request_start_ms, request_end_ms. Slices are cut to
    the request +- 2 ms, locks to the request. Lock time is a type of its own and is taken off futex.
    """
    thread = [*key, "tid"]
    lo, hi = F.col("request_start_ms") * MS, F.col("request_end_ms") * MS

    def cut(df, margin):
        a, b = lo - margin, hi + margin
        c = text.clip_interval(F.col("start_ns"), F.col("end_ns"), F.col("time_ns"), a, b)
        return df.join(carrying.select(*thread).distinct(), thread, "left_semi").where(text.overlaps(
            F.col("start_ns"), F.col("end_ns"), a, b)).withColumn("__t", c["duration"])

    span = [*key, "request_start_ms", "request_end_ms"]
    slices = cut(timeline.where(~F.col("on_off") & (F.col("type") != "runqLatency")), 2 * MS)
    waits = cut(locks, 0).withColumn("type", F.lit("lock"))
    sums = slices.select(*span, "type", "__t").unionByName(waits.select(*span, "type", "__t")).groupBy(*span, "type").agg(F.sum("__t").cast("long").alias("time_ns"))
    locked = sums.where("type = 'lock'").select(*key, F.col("time_ns").alias("__lock"))
    out = sums.join(locked, key, "left")
    futex = (F.col("type") == "futex") & F.col("__lock").isNotNull()
    out = out.where(~futex | (F.col("time_ns") > F.col("__lock"))).withColumn(
        "time_ns", F.when(futex, F.col("time_ns") - F.col("__lock")).otherwise(F.col("time_ns"))).drop("__lock")
    total = (F.col("request_end_ms") - F.col("request_start_ms")) * MS
    return out.withColumn("rate", F.col("time_ns").cast("double") / total.cast("double") * 100.0)


def event_type_counts(timeline: DataFrame, locks: DataFrame | None = None) -> DataFrame:
    counts = timeline.groupBy("event_type").agg(F.count("*").alias("n"))
    return counts if locks is None else counts.unionByName(locks.groupBy("event_type").agg(F.count("*").alias("n")))


def trace_bounds(intervals: DataFrame, key: list[str]) -> DataFrame:
    return intervals.groupBy(*key).agg(F.min("start_ns").alias("first_ns"), F.max("end_ns").alias("last_ns"))


def trace_spans(spans: DataFrame, bounds: DataFrame, key: list[str], margin_ns: int = 10 * MS) -> DataFrame:
    """Spans of the trace, cut to the widest of request and trace +- 10 ms. ``spans``: key, name, start_ns, end_ns,
    request_start_ns, request_end_ns."""
    t = spans.join(bounds, key, "left")
    lo = F.least("request_start_ns", "first_ns") - margin_ns
    hi = F.greatest("request_end_ns", "last_ns") + margin_ns
    s, e = F.col("start_ns"), F.col("end_ns")
    c = text.clip_interval(s, e, e - s, lo, hi)
    return t.where(text.overlaps(s, e, lo, hi)).withColumns({"start_ns": c["start"], "end_ns": c["end"], "time_ns": c["duration"]}).drop(
        "first_ns", "last_ns")


def timeline_filter(timeline: DataFrame, threads=(), types=(), logs=(), files=()) -> DataFrame:
    """Keep chosen threads and event types; file events by part of the file name, logged ones by part of the text."""
    def any_of(column, words):
        return F.coalesce(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col(column), w)), F.lit(False))
    out = timeline
    if threads:
        out = out.where(F.col("tid").isin(list(threads)))
    if types:
        out = out.where(F.col("event_type").isin(list(types)))
        if files:
            out = out.where(~F.contains(F.col("event_type"), F.lit("file")) | any_of("file", files))
    if logs:
        out = out.where(F.col("log").isNull() | any_of("log", logs))
    return out


def trace_threads(threads: DataFrame, carrying: DataFrame, key: list[str], chosen: list[int] = ()) -> DataFrame:
    """Threads that carry the trace (interval, log mark or both request ends) plus the chosen ones; all when none do.

    ``carrying``: key, tid. Whether a trace has any is a grouped flag joined back, so all traces are done at once.
    """
    flag = carrying.select(*key, "tid").distinct().withColumn("__hit", F.lit(True))
    t = threads.join(flag, [*key, "tid"], "left")
    hit = F.coalesce("__hit", F.lit(False)) | (F.col("tid").isin(list(chosen)) if chosen else F.lit(False))
    t = t.withColumn("__hit", hit)
    some = t.where("__hit").select(*key).distinct().withColumn("__some", F.lit(True))
    return t.join(some, key, "left").where(F.col("__hit") | F.col("__some").isNull()).drop("__hit", "__some")


def profile_filters(timeline: DataFrame, threads: DataFrame) -> DataFrame:
    """Distinct threads and files as filter options."""
    names = threads.select(F.lit("thread").alias("kind"), F.concat_ws("/", "thread_name", F.col("tid").cast("string")).alias("value"))
    files = timeline.where("type = 'file'").select(F.lit("file").alias("kind"), F.col("file").alias("value"))
    return names.unionByName(files).where(F.col("value").isNotNull()).distinct()


def flame_parents(frames: DataFrame, key: list[str], chunk: int = 100_000) -> DataFrame:
    """Frames with the index of their parent: the frame one level up whose [index, index + width) holds theirs.

    Frames of one level do not overlap, so the parent is the last one that starts at or before the frame: a merge of
    both levels by index, not a join of every pair.
    """
    up = frames.select(*key, (F.col("depth") + 1).alias("depth"), F.col("index").alias("parent_index"), F.col("width").alias("__w"),
                       F.col("name").alias("parent_name"))
    hit = scan.asof_join(frames, up, [*key, "depth"], "index", "parent_index", ["parent_index", "parent_name", "__w"], chunk)
    inside = F.col("index") < F.col("parent_index") + F.col("__w")
    return hit.select(*frames.columns, F.when(inside, F.col("parent_index")).alias("parent_index"), F.when(inside, F.col("parent_name")).alias("parent_name"))


def call_nodes(tree: str | None) -> Iterator[tuple[int, str, str | None, int, int]]:
    """(level, path, name, start, end) of the nodes of a nested call tree, top down; its depth is not limited by Python's."""
    todo = [(1, str(i), node) for i, node in enumerate(json.loads(tree or "[]"))]
    while todo:
        level, path, node = todo.pop()
        yield level, path, node.get("name"), node["from"], node["to"]
        todo.extend((level + 1, f"{path}.{i}", child) for i, child in enumerate(node.get("child") or []))


def stack_levels(calls: DataFrame, key: list[str], tree: str = "flames", part_rows: int = 100_000) -> DataFrame:
    """Nested call trees (JSON lists with from, to, name, child) -> rows with level, duration and share of the total.

    Trees are flattened in Arrow batches, in one pass over each tree; ``part_rows`` nodes are handed on at a time. Null and
    empty trees have no nodes, a node may lack name and children.
    """
    layout = {"level": pa.int32(), "path": pa.string(), "name": pa.string(), "start": pa.int64(), "end": pa.int64()}
    own = T.StructType().add("level", T.IntegerType()).add("path", T.StringType()).add("name", T.StringType()).add("start", T.LongType()).add("end", T.LongType())
    given = calls.select(*key, F.col(tree).alias("__tree"))
    schema = T.StructType([*given.drop("__tree").schema.fields, *own.fields])

    def made(batch: pa.RecordBatch, at: list[int], nodes: list[tuple]) -> pa.RecordBatch:
        where, columns = pa.array(at, pa.int64()), list(zip(*nodes)) or [()] * len(layout)
        return pa.RecordBatch.from_arrays([*[batch.column(k).take(where) for k in range(len(key))], *[pa.array(c, t) for c, t in zip(columns, layout.values())]], [*key, *layout])

    def flatten(batches):
        for batch in batches:
            at, nodes = [], []
            for row, text_ in enumerate(batch.column(len(key)).to_pylist()):
                for node in call_nodes(text_):
                    at.append(row)
                    nodes.append(node)
                    if len(nodes) >= part_rows:
                        yield made(batch, at, nodes)
                        at, nodes = [], []
            yield made(batch, at, nodes)

    rows = given.mapInArrow(flatten, schema)
    total = rows.where("level = 1").groupBy(*key).agg((F.max("end") - F.min("start")).alias("__total"))
    t = F.col("end") - F.col("start")
    return rows.join(total, key).withColumns({"time": t, "time_rate": t.cast("double") / F.col("__total").cast("double")}).drop("__total")


# --- attachments ----------------------------------------------------------------------------------------------

# Widths of the cells in which ranges meet points, in seconds; the last one holds any range.
_CELLS = [1 << k for k in (6, 8, 10, 12, 14, 18, 40)]


def points_in_ranges(ranges: DataFrame, lo: Column, hi: Column, points: DataFrame, keys: list[str], at: str = "second") -> DataFrame:
    """Every row of ``ranges`` with every row of ``points`` of its keys whose ``at`` lies between both ends (in either order).

    A range is put into the one or two cells it touches of the least width it fits into, a point into its cell of every width.
    So a range is two rows at most, however long it is, and the join is an equality on keys, width and cell.
    """
    a, b = F.col("__lo"), F.col("__hi")
    asked = ranges.withColumns({"__from": lo, "__to": hi}).where("__from IS NOT NULL AND __to IS NOT NULL")
    asked = asked.withColumns({"__lo": F.least("__from", "__to"), "__hi": F.greatest("__from", "__to")}).drop("__from", "__to")
    width = reduce(lambda rest, w: F.when(b - a < w, F.lit(w).cast("long")).otherwise(rest), reversed(_CELLS[:-1]), F.lit(_CELLS[-1]).cast("long"))
    asked = asked.withColumn("__width", width).withColumn(
        "__cell", F.explode(F.array_distinct(F.array(F.floor(a / F.col("__width")), F.floor(b / F.col("__width"))))))
    there = points.withColumn("__in", F.explode(F.array(*[F.struct(F.lit(w).cast("long").alias("w"), F.floor(F.col(at) / w).alias("c")) for w in _CELLS])))
    there = there.withColumns({"__width": F.col("__in.w"), "__cell": F.col("__in.c")}).drop("__in")
    hit = asked.join(there, [*keys, "__width", "__cell"]).where(F.col(at).between(a, b))
    return hit.select(*keys, at, *[c for c in [*ranges.columns, *points.columns] if c not in (*keys, at)])


def trace_segments(traces: DataFrame, segments: DataFrame, edge_s: int = 2) -> DataFrame:
    """Segments (one second of one thread) of a trace's process between start - edge and end + edge, whole seconds.

    Traces meet segments in cells of seconds (``points_in_ranges``).
    """
    lo = F.floor((F.col("start_ns") - edge_s * S) / S)
    hi = F.floor((F.col("end_ns") + edge_s * S) / S)
    have = segments.withColumn("second", F.floor(F.col("segment_start_ns") / S))
    return points_in_ranges(traces, lo, hi, have, ["pid"])


def apm_entry_exit(marks: DataFrame, slow_ms: int, slice_ns: int = scan.DEFAULT_SLICE_NS) -> DataFrame:
    """Exits with the latest entry of their trace and process, where the time between is above the limit."""
    keys = ["trace_id", "pid"]
    seen = scan.carry_last(marks, keys, ["ts_ns", "is_entry"], {"entry_ns": F.col("ts_ns"), "entry_url": F.col("url"), "entry_protocol": F.col("protocol")},
                           scan.time_slice("ts_ns", slice_ns), F.col("is_entry") == 1)
    spent = F.col("ts_ns") - F.col("entry_ns")
    return seen.where((F.col("is_entry") == 0) & (spent > slow_ms * MS)).select(
        *keys, F.col("entry_ns").alias("start_ns"), spent.alias("request_total_time"), F.col("entry_url").alias("content_key"),
        F.col("entry_protocol").alias("protocol"))


def inner_calls(records: DataFrame, segments: DataFrame) -> DataFrame:
    """Slow client-side requests put into every segment of their thread they touch.

    ``records``: pid, request_tid, start_ns, request_total_time, is_slow, is_server. ``segments``: pid, tid, second.
    """
    end = F.col("start_ns") + F.col("request_total_time")
    slow = records.where(F.col("is_slow") & ~F.col("is_server"))
    asked = slow.withColumns({"end_ns": end, "tid": F.col("request_tid")})
    return points_in_ranges(asked, F.floor(F.col("start_ns") / S), F.floor(F.col("end_ns") / S), segments.select("pid", "tid", "second").distinct(), ["pid", "tid"])


def net_call_match(net: DataFrame, calls: DataFrame, keys: list[str], window_ns: int = 5 * MS) -> DataFrame:
    """Network intervals with the outbound call of their thread that ends (reads) or starts (writes) within 5 ms.

    Calls are put into the time buckets around their end and start; an interval looks into its own bucket only. The
    last call in list order wins. ``net``: keys, id, event_type, operate, request_type, start_ns, end_ns. ``calls``:
    keys, call_no, start_ns, end_ns, request_payload, response_payload.
    """
    read = F.col("event_type") == "netread"
    asked = net.withColumns({"__at": F.when(read, F.col("end_ns")).otherwise(F.col("start_ns")), "__read": read})
    asked = asked.withColumn("__b", F.floor(F.col("__at") / window_ns))
    side = F.explode(F.array(F.struct(F.lit(True).alias("__read"), F.col("end_ns").alias("__c")),
                             F.struct(F.lit(False).alias("__read"), F.col("start_ns").alias("__c"))))
    near = calls.select(*keys, "call_no", "request_payload", "response_payload", side.alias("x")).select(
        *keys, "call_no", "request_payload", "response_payload", "x.*")
    b = F.floor(F.col("__c") / window_ns)
    near = near.withColumn("__b", F.explode(F.array(b - 1, b, b + 1)))
    hit = asked.join(near, [*keys, "__read", "__b"]).where(F.abs(F.col("__at") - F.col("__c")) < window_ns)
    best = hit.groupBy(*keys, "id").agg(F.max_by(F.struct("call_no", "request_payload", "response_payload"), "call_no").alias("m"))
    op, rt = F.col("operate"), F.col("request_type").cast("int")
    kind = (F.when(op.isin(C.READ_CALLS), F.when(rt == 1, "request").otherwise("response"))
            .when(op.isin(C.WRITE_CALLS), F.when(rt == 1, "response").otherwise("request")).otherwise(""))
    return net.join(best, [*keys, "id"], "left").withColumns({
        "direction": F.when(F.col("m").isNotNull(), kind), "call_no": F.col("m.call_no"),
        "message": F.when(F.col("m").isNotNull(), F.when(kind == "request", F.col("m.request_payload")).otherwise(F.col("m.response_payload")))}).drop("m")
