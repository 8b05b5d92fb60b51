"""Queries for thread profiles and attachments. One CPU event per captured event: an on-, an off- and an on-slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwork import constants as C
from skeinwork.operators import profile
from skeinwork.operators.enrich import parse_agent_lines
from skeinwork.plans.catalog import query

DAY = 86_400_000_000_000
# A trace per process and day looks at 06:00 to 18:00.
_RANGE = "CAST(floor(ts_ns / 86400000000000) AS BIGINT)"
_SLICES = f"""SELECT seq, pid, tid, day, day * 86400000000000 + 21600000000000 AS lo_ns, day * 86400000000000 + 64800000000000 AS hi_ns, n AS slice_no, k, res, fd, latency_ns, ts_ns,
  CASE n WHEN 0 THEN ts_ns WHEN 1 THEN ts_ns + latency_ns ELSE ts_ns + 3 * latency_ns + 1000000 END AS slice_start,
  CASE n WHEN 0 THEN ts_ns + latency_ns WHEN 1 THEN ts_ns + 3 * latency_ns + 1000000 ELSE ts_ns + 3 * latency_ns + 1000000 + 3599999000000 END AS slice_end,
  CASE WHEN n <> 1 THEN 'on' ELSE CASE k % 6 WHEN 0 THEN 'file' WHEN 1 THEN 'net' WHEN 2 THEN 'futex' WHEN 3 THEN 'idle' WHEN 4 THEN 'other' ELSE 'epoll' END END AS type,
  CASE WHEN n = 1 THEN k * 40 END AS runq_us FROM (SELECT *, {_RANGE} AS day FROM v_socket_events) e, (VALUES (0), (1), (2)) t(n)"""
_IN = f"SELECT * FROM ({_SLICES}) s WHERE slice_end > lo_ns AND slice_start < hi_ns"


def cpu_events(env):
    s = lambda c: F.col(c).cast("string")
    k, lat = F.col("k"), F.col("latency_ns")
    net = F.concat(F.lit("net@read@a->b@"), s("ts_ns"), F.lit("@"), s("latency_ns"), F.lit("@1@"), s("res"))
    files = F.concat(F.lit("file@write@/f"), s("fd"), F.lit("@"), s("ts_ns"), F.lit("@"), s("latency_ns"), F.lit("@32#futex@0x1"))
    e = env.v_socket_events.withColumn("day", F.floor(F.col("ts_ns") / DAY))
    return e.select("seq", "pid", "tid", "day", (F.col("day") * DAY + 21_600_000_000_000).alias("lo_ns"), (F.col("day") * DAY + 64_800_000_000_000).alias("hi_ns"),
                    F.col("ts_ns").alias("start_ns"), F.array(lat, lat * 2 + 1_000_000, F.lit(3_599_999_000_000).cast("long")).alias("type_specs"),
                    F.array(F.lit(0), (k % 6 + 1).cast("int"), F.lit(0)).alias("time_type"), F.array((k * 40).cast("long")).alias("runq"),
                    F.concat(net, F.lit("|")).alias("on_info"), F.when(k % 3 == 0, files).otherwise("").alias("off_info"),
                    F.concat(F.lit("|5@log"), s("k")).alias("log"), F.lit("").alias("stack"))


def slices(env):
    return profile.timeline_offsets(cpu_events(env))


@query("timeline_offsets", f"""
SELECT seq, slice_no, type, slice_start, slice_end, CAST(runq_us AS BIGINT) AS runq_us,
  CASE WHEN slice_no = 2 THEN concat('5@log', k) END AS log FROM ({_SLICES}) s""")
def timeline_offsets(env):
    return slices(env).select("seq", "slice_no", "type", "slice_start", "slice_end", "runq_us", "log")


_CLIP = "greatest({s}, lo_ns) AS start_ns, least({e}, hi_ns) AS end_ns, {e} - {s} - greatest(lo_ns - {s}, 0) - greatest({e} - hi_ns, 0) AS time_ns"
_RUNQ = "least(slice_end, hi_ns) - runq_us * 1000 AS start_ns, least(slice_end, hi_ns) AS end_ns, CAST(runq_us * 1000 AS BIGINT) AS time_ns"
TIMELINE = f"""SELECT seq, pid, tid, day, {_CLIP.format(s='slice_start', e='slice_end')}, type, type AS event_type, false AS on_off, NULL AS file FROM ({_IN}) i
UNION ALL SELECT seq, pid, tid, day, {_CLIP.format(s='ts_ns', e='(ts_ns + latency_ns)')}, 'net', 'netread', true, 'a->b' FROM ({_IN}) i WHERE slice_no = 0
UNION ALL SELECT seq, pid, tid, day, {_CLIP.format(s='ts_ns', e='(ts_ns + latency_ns)')}, 'file', 'filewrite', true, concat('/f', fd) FROM ({_IN}) i
  WHERE slice_no = 1 AND k % 3 = 0 AND ts_ns + latency_ns > lo_ns AND ts_ns < hi_ns
UNION ALL SELECT seq, pid, tid, day, {_RUNQ}, 'runqLatency', 'runqLatency', false, NULL FROM ({_IN}) i WHERE slice_no = 1 AND runq_us > 1000"""
_KEYS = ["seq", "pid", "tid", "day"]


def timeline(env):
    return profile.thread_timeline(slices(env), _KEYS)


@query("thread_timeline", TIMELINE)
def thread_timeline(env):
    return timeline(env).select(*_KEYS, "start_ns", "end_ns", "time_ns", "type", "event_type", "on_off", "file")


@query("runq_latency", f"SELECT seq, pid, tid, day, {_RUNQ} FROM ({_IN}) i WHERE slice_no = 1 AND runq_us > 1000")
def runq_latency(env):
    return profile.runq_latency(slices(env), _KEYS)


@query("thread_logs", f"SELECT seq, pid, tid, day, slice_start AS start_ns, concat('log', k) AS log FROM ({_IN}) i WHERE slice_no = 2 AND slice_start > lo_ns AND slice_start < hi_ns")
def thread_logs(env):
    return profile.thread_logs(slices(env), _KEYS)


_LOCKS = f"""SELECT pid, tid, day, greatest(s, lo_ns) AS start_ns, least(e, hi_ns) AS end_ns, e - s - greatest(lo_ns - s, 0) - greatest(e - hi_ns, 0) AS time_ns, concat('0x', k) AS address, waiter
  FROM (SELECT *, day * 86400000000000 + 21600000000000 AS lo_ns, day * 86400000000000 + 64800000000000 AS hi_ns FROM (
    SELECT pid, tid, {_RANGE} AS day, ts_ns AS s, ts_ns + latency_ns * 1000 AS e, k, CASE WHEN k % 3 = 0 THEN '' ELSE CAST(pid * 10 + k % 6 AS VARCHAR) END AS waiter FROM v_socket_events) a) b
  WHERE e > lo_ns AND s < hi_ns"""


def locks(env):
    e = env.v_socket_events.withColumn("day", F.floor(F.col("ts_ns") / DAY))
    k = F.col("k")
    waiter = F.when(k % 3 == 0, "-1").otherwise((F.col("pid") * 10 + k % 6).cast("string"))
    data = F.concat(F.lit("a!b!c!0x"), k.cast("string"), F.lit("!Enter!f!g!"), waiter, F.lit("!stack!"))
    src = e.select("pid", "tid", "day", F.col("ts_ns").alias("start_ns"), (F.col("ts_ns") + F.col("latency_ns") * 1000).alias("end_ns"), data.alias("data"),
                   (F.col("day") * DAY + 21_600_000_000_000).alias("lo_ns"), (F.col("day") * DAY + 64_800_000_000_000).alias("hi_ns"))
    return profile.lock_waits(src, threads(env), ["pid", "tid", "day"], ["pid"])


def threads(env):
    return env.v_socket_events.select("pid", "tid", F.concat(F.lit("thread-"), F.col("tid").cast("string")).alias("thread_name")).distinct()


_WAITER = "coalesce((SELECT min(concat('thread-', tid)) FROM v_socket_events v WHERE CAST(v.tid AS VARCHAR) = l.waiter AND v.pid = l.pid), '--')"


@query("lock_waits", f"""
SELECT l.pid, l.tid, l.day, start_ns, end_ns, time_ns, address, waiter, coalesce(name, '--') AS wait_thread FROM ({_LOCKS}) l
LEFT JOIN (SELECT DISTINCT pid, CAST(tid AS VARCHAR) AS w, concat('thread-', tid) AS name FROM v_socket_events) t ON t.pid = l.pid AND t.w = l.waiter""")
def lock_waits(env):
    return locks(env).select("pid", "tid", "day", "start_ns", "end_ns", "time_ns", "address", "waiter", "wait_thread")


@query("lock_waiter", """
SELECT e.seq, coalesce(t.name, '--') AS wait_thread FROM v_socket_events e LEFT JOIN (SELECT DISTINCT pid, tid, concat('thread-', tid) AS name FROM v_socket_events) t
ON t.pid = e.pid AND t.tid = e.pid * 10 + e.k % 6""")
def lock_waiter(env):
    e = env.v_socket_events.select("seq", "pid", (F.col("pid") * 10 + F.col("k") % 6).cast("string").alias("waiter"))
    return profile.lock_waiter(e, threads(env), ["pid"]).select("seq", "wait_thread")


@query("thread_names", """
SELECT e.seq, e.pid, e.tid, coalesce(n.name, 'java') AS thread_name FROM v_socket_events e LEFT JOIN (
  SELECT pid, tid, name FROM (SELECT pid, tid, concat('n', seq) AS name, row_number() OVER (PARTITION BY pid, tid ORDER BY ts_ns DESC, seq DESC) AS rn FROM v_socket_events WHERE name = 'connect') x WHERE rn = 1) n
ON e.pid = n.pid AND e.tid = n.tid""")
def thread_names(env):
    s = lambda c: F.col(c).cast("string")
    src = env.v_socket_events
    # Every event is a line of the agent: a thread's name or a transaction mark; threads without a name line have none.
    named = F.concat(F.lit("kd-tm@"), s("tid"), F.lit("!n"), s("seq"), F.lit("!"))
    marked = F.concat(F.lit("kd-txid@t"), s("seq"), F.lit("!1!http!/pay!"))
    lines = src.select("pid", "tid", "ts_ns", F.when(F.col("name") == "connect", named).otherwise(marked).alias("line"))
    announced = parse_agent_lines(lines).where("kind = 'thread'")
    return profile.thread_names(src.withColumn("comm", F.lit("java")), announced).select("seq", "pid", "tid", "thread_name")


# Marks of one trace per (pid, tid, day): entry or exit by k, some with a url.
_MARKS = f"""SELECT pid, tid, {_RANGE} AS day, seq, ts_ns, CASE WHEN k % 5 < 2 THEN 1 ELSE 0 END AS is_entry, CASE WHEN k % 11 = 0 THEN '/u' ELSE '' END AS url FROM v_socket_events"""
_W = "PARTITION BY pid, day ORDER BY ts_ns, seq"
_INTERVALS = f"""SELECT pid, day, ts_ns AS start_ns, nxt AS end_ns, nxt - ts_ns AS time_ns FROM (
  SELECT *, lead(ts_ns) OVER ({_W}) AS nxt FROM (SELECT *, lag(is_entry) OVER ({_W}) AS before FROM ({_MARKS}) m WHERE url = '') a
  WHERE CASE WHEN before IS NULL THEN is_entry = 1 ELSE before <> is_entry END) b WHERE is_entry = 1 AND nxt IS NOT NULL"""


def intervals(env):
    return profile.trace_intervals(env.sql(_MARKS), ["pid", "day"], ["ts_ns", "seq"], F.floor(F.col("ts_ns") / 3_600_000_000_000))


@query("entry_exit_alternate", _INTERVALS)
def entry_exit_alternate(env):
    return intervals(env)


@query("trace_bounds", f"SELECT pid, day, min(start_ns) AS first_ns, max(end_ns) AS last_ns FROM ({_INTERVALS}) i GROUP BY 1, 2")
def trace_bounds(env):
    return profile.trace_bounds(intervals(env), ["pid", "day"])


_TR = """SELECT seq AS trace_key, pid, tid AS request_tid, tid + 1 AS response_tid, ts_ns AS start_ns, ts_ns + latency_ns * 10000 AS end_ns,
  CASE WHEN k % 4 = 0 THEN 'known' ELSE '' END AS trace_id FROM v_socket_events"""


@query("resolve_trace_id", f"""
WITH t AS ({_TR}), h AS (SELECT t.trace_key, arg_min(concat('x', m.seq), m.ts_ns) FILTER (m.tid = t.request_tid) AS request_trace_id,
  arg_max(concat('x', m.seq), m.ts_ns) FILTER (m.tid = t.response_tid) AS response_trace_id
  FROM t JOIN v_socket_events m ON m.pid = t.pid AND m.ts_ns > t.start_ns AND m.ts_ns < t.end_ns AND m.tid IN (t.request_tid, t.response_tid) WHERE t.trace_id = '' GROUP BY 1)
SELECT t.trace_key, request_trace_id, response_trace_id, CASE WHEN t.trace_id <> '' THEN t.trace_id ELSE response_trace_id END AS trace_id FROM t LEFT JOIN h USING (trace_key)""")
def resolve_trace_id(env):
    marks = env.v_socket_events.select("pid", "tid", "ts_ns", F.concat(F.lit("x"), F.col("seq").cast("string")).alias("trace_id"))
    return profile.resolve_trace_id(env.sql(_TR), marks, ["trace_key"]).select("trace_key", "request_trace_id", "response_trace_id", "trace_id")


_REQ = "CAST(day * 86400000 + 28800000 AS BIGINT) AS a, CAST(day * 86400000 + 57600000 AS BIGINT) AS b"


def _cut(src, margin, tkey):
    lo, hi = f"(a * 1000000 - {margin})", f"(b * 1000000 + {margin})"
    return f"""SELECT pid, day, a, b, {tkey} AS type, time_ns - greatest({lo} - start_ns, 0) - greatest(end_ns - {hi}, 0) AS t FROM (SELECT *, {_REQ} FROM ({src}) q) x
      WHERE end_ns > {lo} AND start_ns < {hi} AND tid % 2 = 0"""


@query("time_breakdown", f"""
WITH s AS (SELECT pid, day, a, b, type, CAST(sum(t) AS BIGINT) AS time_ns FROM ({_cut(f"SELECT * FROM ({TIMELINE}) tl WHERE NOT on_off AND type <> 'runqLatency'", 2000000, "type")}
  UNION ALL {_cut(_LOCKS, 0, "'lock'")}) u GROUP BY 1, 2, 3, 4, 5),
j AS (SELECT s.*, l.time_ns AS locked FROM s LEFT JOIN s l ON s.pid = l.pid AND s.day = l.day AND l.type = 'lock')
SELECT pid, day, type, time_ns, CAST(time_ns AS DOUBLE) / CAST((b - a) * 1000000 AS DOUBLE) * CAST(100 AS DOUBLE) AS rate FROM (
  SELECT pid, day, a, b, type, CASE WHEN type = 'futex' AND locked IS NOT NULL THEN time_ns - locked ELSE time_ns END AS time_ns FROM j
  WHERE type <> 'futex' OR locked IS NULL OR time_ns > locked) z""")
def time_breakdown(env):
    span = {"request_start_ms": F.col("day") * 86_400_000 + 28_800_000, "request_end_ms": F.col("day") * 86_400_000 + 57_600_000}
    tl = timeline(env)
    carrying = threads(env).where("tid % 2 = 0").join(env.v_socket_events.select("pid", F.floor(F.col("ts_ns") / DAY).alias("day")).distinct(), "pid")
    return profile.time_breakdown(tl.withColumns(span), locks(env).withColumns(span), carrying, ["pid", "day"]).select("pid", "day", "type", "time_ns", "rate")


@query("event_type_counts", f"SELECT event_type, count(*) AS n FROM ({TIMELINE}) t GROUP BY 1")
def event_type_counts(env):
    return profile.event_type_counts(timeline(env))


_SPANS = f"""SELECT pid, {_RANGE} AS day, concat('span', seq) AS name, ts_ns AS start_ns, ts_ns + latency_ns * 100 AS end_ns,
  {_RANGE} * 86400000000000 + 28800000000000 AS request_start_ns, {_RANGE} * 86400000000000 + 43200000000000 AS request_end_ns FROM v_socket_events"""


@query("trace_spans", f"""
SELECT s.pid, s.day, name, greatest(s.start_ns, lo) AS start_ns, least(s.end_ns, hi) AS end_ns, s.end_ns - s.start_ns - greatest(lo - s.start_ns, 0) - greatest(s.end_ns - hi, 0) AS time_ns
FROM (SELECT s.*, least(request_start_ns, first_ns) - 10000000 AS lo, greatest(request_end_ns, last_ns) + 10000000 AS hi FROM ({_SPANS}) s
  LEFT JOIN (SELECT pid, day, min(start_ns) AS first_ns, max(end_ns) AS last_ns FROM ({_INTERVALS}) i GROUP BY 1, 2) b USING (pid, day)) s
WHERE s.end_ns > lo AND s.start_ns < hi""")
def trace_spans(env):
    b = profile.trace_bounds(intervals(env), ["pid", "day"])
    return profile.trace_spans(env.sql(_SPANS), b, ["pid", "day"]).select("pid", "day", "name", "start_ns", "end_ns", "time_ns")


@query("timeline_filter", f"""
SELECT seq, event_type, file, start_ns FROM ({TIMELINE}) t WHERE tid % 10 IN (0, 2) AND tid IN (12, 20, 22, 30, 100, 102) AND (event_type = 'netread' OR (event_type = 'filewrite' AND contains(file, 'f1')))""")
def timeline_filter(env):
    return profile.timeline_filter(timeline(env), [12, 20, 22, 30, 100, 102], ["netread", "filewrite"], files=["f1"]).select("seq", "event_type", "file", "start_ns")


@query("trace_threads", """
WITH t AS (SELECT DISTINCT pid, tid FROM v_socket_events), c AS (SELECT DISTINCT pid, tid FROM v_socket_events WHERE k = 7)
SELECT pid, tid FROM t WHERE (pid, tid) IN (SELECT (pid, tid) FROM c) OR pid NOT IN (SELECT pid FROM c)""")
def trace_threads(env):
    t = env.v_socket_events.select("pid", "tid").distinct()
    return profile.trace_threads(t, env.v_socket_events.where("k = 7").select("pid", "tid"), ["pid"])


@query("profile_filters", f"""
SELECT DISTINCT 'thread' AS kind, concat('thread-', tid, '/', tid) AS value FROM v_socket_events UNION SELECT DISTINCT 'file', file FROM ({TIMELINE}) t WHERE type = 'file' AND file IS NOT NULL""")
def profile_filters(env):
    return profile.profile_filters(timeline(env), threads(env))


# A flame graph per supplier: a root, its nations' parts below and lines below those.
_FLAME = """SELECT s_suppkey AS stack_id, 0 AS depth, 0 AS index, 1000 AS width, 'root' AS name FROM supplier
  UNION ALL SELECT s_suppkey, 1, n * 100, 90, concat('f', n) FROM (SELECT s_suppkey, UNNEST(0, 1, 2, 3, 4, 5, 6, 7, 8, 9) AS n FROM supplier) t WHERE (s_suppkey + n) % 3 <> 0
  UNION ALL SELECT s_suppkey, 2, CAST(l_linenumber * 37 + l_orderkey % 500 AS INT), 5, 'leaf' FROM (SELECT s_suppkey, l_linenumber, l_orderkey FROM supplier JOIN lineitem ON l_suppkey = s_suppkey) x"""


@query("flame_parents", f"""
WITH f AS ({_FLAME})
SELECT f.stack_id, f.depth, f.index, f.width, f.name, p.index AS parent_index, p.name AS parent_name FROM f
LEFT JOIN f p ON p.stack_id = f.stack_id AND p.depth = f.depth - 1 AND p.depth < 2 AND f.index >= p.index AND f.index < p.index + p.width""")
def flame_parents(env):
    return profile.flame_parents(env.sql(_FLAME), ["stack_id"])


@query("stack_levels", """
SELECT doc_id, level, path, name, s AS start, e AS "end", e - s AS time, CAST(e - s AS DOUBLE) / CAST(n_chars + 10 AS DOUBLE) AS time_rate FROM (
  SELECT doc_id, n_chars, 1 AS level, '0' AS path, 'main' AS name, CAST(0 AS BIGINT) AS s, n_chars AS e FROM documents
  UNION ALL SELECT doc_id, n_chars, 1, '1', 'tail', n_chars, n_chars + 10 FROM documents
  UNION ALL SELECT doc_id, n_chars, 2, '0.0', lang, 1, n_chars FROM documents UNION ALL SELECT doc_id, n_chars, 3, '0.0.0', 'leaf', 2, 3 FROM documents) t""")
def stack_levels(env):
    n = F.col("n_chars").cast("string")
    tree = F.concat(F.lit('[{"from":0,"to":'), n, F.lit(',"name":"main","child":[{"from":1,"to":'), n, F.lit(',"name":"'), "lang",
                    F.lit('","child":[{"from":2,"to":3,"name":"leaf"}]}]},{"from":'), n, F.lit(',"to":'), (F.col("n_chars") + 10).cast("string"), F.lit(',"name":"tail"}]'))
    return profile.stack_levels(env.documents.select("doc_id", tree.alias("flames")), ["doc_id"])


# --- attachments ----------------------------------------------------------------------------------------------

_TRACES = "SELECT seq AS trace_key, pid, ts_ns AS start_ns, ts_ns + latency_ns * 1000 AS end_ns FROM v_socket_events"


@query("trace_segments", f"""
SELECT t.trace_key, s.seq, s.tid FROM ({_TRACES}) t JOIN v_segments s ON s.pid = t.pid
  AND s.start_s BETWEEN CAST(floor((t.start_ns - 2000000000) / 1000000000) AS BIGINT) AND CAST(floor((t.end_ns + 2000000000) / 1000000000) AS BIGINT)""")
def trace_segments(env):
    seg = env.v_segments.select("seq", "pid", "tid", F.col("start_ns").alias("segment_start_ns"))
    return profile.trace_segments(env.sql(_TRACES), seg).select("trace_key", "seq", "tid")


@query("apm_entry_exit", f"""
SELECT trace_id, pid, ent AS start_ns, ts_ns - ent AS request_total_time, content_key, protocol FROM (
  SELECT *, last_value(CASE WHEN is_entry = 1 THEN ts_ns END IGNORE NULLS) OVER w AS ent, last_value(CASE WHEN is_entry = 1 THEN url END IGNORE NULLS) OVER w AS content_key,
    last_value(CASE WHEN is_entry = 1 THEN 'http' END IGNORE NULLS) OVER w AS protocol FROM (
    SELECT pid, concat('t', k % 4) AS trace_id, ts_ns, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS is_entry, concat('/u', k) AS url FROM v_socket_events) m
  WINDOW w AS (PARTITION BY trace_id, pid ORDER BY ts_ns, is_entry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) z
WHERE is_entry = 0 AND ts_ns - ent > 60000000000""")
def apm_entry_exit(env):
    k = F.col("k")
    m = env.v_socket_events.select("pid", F.concat(F.lit("t"), (k % 4).cast("string")).alias("trace_id"), "ts_ns", F.when(k % 3 == 0, 1).otherwise(0).alias("is_entry"),
                                   F.concat(F.lit("/u"), k.cast("string")).alias("url"), F.lit("http").alias("protocol"))
    return profile.apm_entry_exit(m, 60_000, 3_600_000_000_000)


@query("inner_calls", """
SELECT DISTINCT e.seq AS call_id, e.pid, e.tid, s.start_s AS second FROM v_socket_events e JOIN v_segments s ON s.pid = e.pid AND s.tid = e.tid
  AND s.start_s BETWEEN CAST(floor(e.ts_ns / 1000000000) AS BIGINT) AND CAST(floor((e.ts_ns + e.latency_ns * 100000) / 1000000000) AS BIGINT) WHERE NOT e.is_server_fd AND e.k % 2 = 0""")
def inner_calls(env):
    r = env.v_socket_events.select(F.col("seq").alias("call_id"), "pid", F.col("tid").alias("request_tid"), F.col("ts_ns").alias("start_ns"),
                                   (F.col("latency_ns") * 100_000).alias("request_total_time"), (F.col("k") % 2 == 0).alias("is_slow"), F.col("is_server_fd").alias("is_server"))
    return profile.inner_calls(r, env.v_segments.withColumnRenamed("start_s", "second")).select("call_id", "pid", "tid", "second")


# Network intervals around half of the calls: the offset of up to 6 ms decides whether they match.
_NET = """SELECT seq AS id, pid, tid, CASE WHEN name IN ('read', 'recvfrom') THEN 'netread' ELSE 'netwrite' END AS event_type, name AS operate, CASE WHEN k % 2 = 0 THEN '1' ELSE '0' END AS request_type,
  ts_ns - CASE WHEN name IN ('read', 'recvfrom') THEN 9000000 ELSE 0 END + k * 130000 - 6000000 AS start_ns, ts_ns + k * 130000 - 6000000 AS end_ns FROM v_socket_events WHERE name <> 'connect'"""
_CALLS = """SELECT seq AS call_no, pid, tid, CASE WHEN name IN ('read', 'recvfrom') THEN ts_ns - latency_ns ELSE ts_ns END AS start_ns,
  CASE WHEN name IN ('read', 'recvfrom') THEN ts_ns ELSE ts_ns + latency_ns END AS end_ns, concat('q', seq) AS request_payload, concat('r', seq) AS response_payload FROM v_socket_events WHERE k % 3 <> 0"""


@query("net_call_match", f"""
WITH h AS (SELECT n.id, max(c.call_no) AS call_no FROM ({_NET}) n JOIN ({_CALLS}) c ON n.pid = c.pid AND n.tid = c.tid AND CASE WHEN n.event_type = 'netread'
  THEN abs(n.end_ns - c.end_ns) < 5000000 ELSE abs(n.start_ns - c.start_ns) < 5000000 END GROUP BY 1)
SELECT n.id, h.call_no, CASE WHEN h.call_no IS NOT NULL THEN d END AS direction, CASE WHEN h.call_no IS NOT NULL THEN concat(CASE WHEN d = 'request' THEN 'q' ELSE 'r' END, h.call_no) END AS message
FROM (SELECT *, CASE WHEN (event_type = 'netread') = (request_type = '1') THEN 'request' ELSE 'response' END AS d FROM ({_NET}) x) n LEFT JOIN h ON h.id = n.id""")
def net_call_match(env):
    return profile.net_call_match(env.sql(_NET), env.sql(_CALLS), ["pid", "tid"]).select("id", "call_no", "direction", "message")
