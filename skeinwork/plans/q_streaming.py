"""Queries that run a stream over the events table until it is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwork.operators import connects, pairing
from skeinwork.plans.catalog import query
from skeinwork.plans.views import Env
from skeinwork.session import work_dir
from skeinwork.streaming import builtin, stateful
from skeinwork.streaming.ordered import BUCKETS
from skeinwork.streaming.run import run_append


class StreamEnv(Env):
    """The same views over a stream of the events table."""

    def _frame(self, name, make):
        if name == "events":
            batch = self.spark.read.parquet(self.path("events"))
            # The bracket makes the path a pattern, which a single file needs; a folder is read the same way.
            path = f"{self.sf_dir}/events.parque[t]"
            make = lambda: self.spark.readStream.schema(batch.schema).parquet(path)
        return super()._frame(name, make)


def stream(env) -> StreamEnv:
    return StreamEnv(env.spark, env.sf_dir)


def in_order(env, df, plan, ts="ts_ns", parts=3):
    """Run ``plan(stream)`` over ``df`` in time slices. Every slice is added to the stream's folder and taken by a query that
    is started again from its checkpoint, so the slices meet through the state only."""
    feed, root = work_dir(env.spark, "feed"), work_dir(env.spark, "stream")
    lo, hi = df.agg(F.min(ts), F.max(ts)).first()
    width = (hi - lo) // parts + 1
    for i in range(parts):
        df.where((F.col(ts) >= lo + i * width) & (F.col(ts) < lo + (i + 1) * width)).write.mode("append").parquet(feed)
        out = run_append(plan(env.spark.readStream.schema(df.schema).parquet(feed)), root)
    return out


# The watermark when a stream without delay is used up: the last event's millisecond.
def _watermark(src: str) -> str:
    return f"(SELECT CAST(floor(max(ts_ns) / 1000000) AS BIGINT) * 1000000 FROM {src})"


_END = "(SELECT max(ts_ns) FROM v_socket_events)"


@query("stream_preagg", f"""
SELECT CAST(floor(ts_ns / 5000000000) AS BIGINT) * 5000000 AS window_us, pid, name, CAST(sum(latency_ns) AS BIGINT) AS latency_ns, CAST(sum(latency_ns) // count(*) AS BIGINT) AS latency_avg, count(*) AS n
FROM v_socket_events WHERE CAST(floor(ts_ns / 5000000000) AS BIGINT) * 5000000000 + 5000000000 <= CAST(floor(({_END} - 5000000000) / 1000000) AS BIGINT) * 1000000 GROUP BY 1, 2, 3""")
def stream_preagg(env):
    config = {"latency_ns": [("sum", "latency_ns"), ("avg", "latency_avg"), ("count", "n")]}
    s = stream(env).v_socket_events.select("pid", "name", "ts_ns", "latency_ns")
    return run_append(builtin.preagg(s, ["pid", "name"], config), work_dir(env.spark, "preagg"))


@query("stream_segments", f"""
WITH e AS (SELECT pid, tid, seq, unnest(range(CAST(floor(start_ns / 1000000000) AS BIGINT), CAST(floor(end_ns / 1000000000) AS BIGINT) + 1)) AS second FROM v_segments)
SELECT pid, tid, second, count(*) AS n, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS events FROM e
WHERE second + 1 <= (SELECT max(second) FROM e) - 40 GROUP BY 1, 2, 3""")
def stream_segments(env):
    out = run_append(builtin.segments(stream(env).v_segments), work_dir(env.spark, "segments"))
    return out.withColumn("events", F.array_join(F.transform("events", lambda e: e["seq"].cast("string")), ","))


@query("stream_trigger", """
SELECT DISTINCT CAST(fd AS VARCHAR) AS content_key, pid, CAST(floor(ts_ns / 5000000000) AS BIGINT) AS bucket FROM v_socket_events WHERE k % 3 = 0 AND is_server_fd AND (pid % 10 <> 0 OR k % 2 = 0)""")
def stream_trigger(env):
    s = stream(env).v_socket_events
    r = s.select(F.col("fd").cast("string").alias("content_key"), "pid", "ts_ns", (F.col("k") % 3 == 0).alias("is_slow"), F.col("is_server_fd").alias("is_server"), (F.col("k") % 2 == 0).alias("from_apm"))
    apm = env.v_socket_events.where("pid % 10 = 0").select("pid").distinct()
    return run_append(builtin.trigger(r, apm), work_dir(env.spark, "trigger"))


# Socket events replayed 2,000 times faster than recorded, so that seconds of idle time occur as well as minutes.
_REPLAY = "SELECT seq, CAST(floor(ts_ns / 2000000) AS BIGINT) * 1000 AS ts_ns, name, pid, tid, fd, is_server_fd, sport, dport, latency_ns, res, k FROM v_socket_events"
_REPLAY_MESSAGES = f"""SELECT *, CASE WHEN name IN ('read', 'recvfrom') THEN is_server_fd ELSE NOT is_server_fd END AS is_request FROM ({_REPLAY}) r WHERE name <> 'connect'"""


@query("stream_pairing", f"""
WITH s AS ({_REPLAY_MESSAGES}), e AS (SELECT * FROM s WHERE ts_ns <= {_watermark("s")}),
l AS (SELECT *, lag(is_request) OVER w AS pq, lag(sport) OVER w AS ps, CAST(floor(ts_ns / 1000000000) AS BIGINT) - CAST(floor(lag(ts_ns) OVER w / 1000000000) AS BIGINT) AS gap FROM e WINDOW w AS (PARTITION BY pid, fd ORDER BY ts_ns, seq)),
n AS (SELECT *, sum(CASE WHEN is_request AND (pq IS NULL OR NOT pq OR ps <> sport OR gap >= 120) THEN 1 ELSE 0 END) OVER (PARTITION BY pid, fd ORDER BY ts_ns, seq) AS pair_no FROM l),
b AS (SELECT *, sum(CASE WHEN NOT is_request AND gap >= CASE WHEN pq THEN 120 ELSE 15 END THEN 1 ELSE 0 END) OVER (PARTITION BY pid, fd, pair_no ORDER BY ts_ns, seq) AS late FROM n WHERE pair_no > 0),
p AS (SELECT pid, fd, pair_no, min(ts_ns) FILTER (is_request) AS first_req_ts, arg_min(latency_ns, CASE WHEN is_request THEN ts_ns + seq % 1000 END) AS first_req_latency, max(ts_ns) FILTER (is_request) AS last_req_ts,
  count(*) FILTER (is_request) AS n_req, CAST(coalesce(sum(res) FILTER (is_request), 0) AS BIGINT) AS req_bytes, min(ts_ns) FILTER (NOT is_request) AS first_resp_ts,
  arg_min(latency_ns, CASE WHEN NOT is_request THEN ts_ns + seq % 1000 END) AS first_resp_latency, max(ts_ns) FILTER (NOT is_request) AS last_resp_ts, count(*) FILTER (NOT is_request) AS n_resp,
  CAST(coalesce(sum(res) FILTER (NOT is_request), 0) AS BIGINT) AS resp_bytes, arg_min(tid, CASE WHEN is_request THEN ts_ns + seq % 1000 END) AS request_tid, arg_min(tid, CASE WHEN NOT is_request THEN ts_ns + seq % 1000 END) AS response_tid
  FROM b WHERE late = 0 GROUP BY 1, 2, 3)
SELECT * EXCLUDE (pair_no, last_no) FROM (SELECT *, max(pair_no) OVER (PARTITION BY pid, fd) AS last_no FROM p) q
WHERE pair_no < last_no OR CAST(floor(coalesce(last_resp_ts, last_req_ts) / 1000000000) AS BIGINT) + CASE WHEN n_resp > 0 THEN 15 ELSE 120 END <= floor({_watermark("s")} / 1000000000)""")
def stream_pairing(env):
    src = env.sql(_REPLAY_MESSAGES).select("pid", "fd", "seq", "ts_ns", "latency_ns", "res", "tid", "sport", "is_request")
    return in_order(env, src, lambda s: stateful.pair_stream(s, delay="0 seconds", buckets=BUCKETS))


_REPLAY_DNS = f"SELECT *, '10.0.0.1' AS sip, '10.0.0.2' AS dip, k % 8 AS dns_id FROM ({_REPLAY_MESSAGES}) m WHERE dport = 53"


@query("stream_dns_pending", f"""
WITH s AS ({_REPLAY_DNS}), e AS (SELECT *, lead(is_request) OVER w AS n_q, lead(seq) OVER w AS n_seq, lead(ts_ns) OVER w AS n_ts,
  CAST(floor(lead(ts_ns) OVER w / 1000000000) AS BIGINT) - CAST(floor(ts_ns / 1000000000) AS BIGINT) >= 120 AS over FROM s WHERE ts_ns <= {_watermark("s")} WINDOW w AS (PARTITION BY pid, fd, dns_id ORDER BY ts_ns, seq))
SELECT pid, fd, dns_id, seq AS req_seq, ts_ns AS req_ts, CASE WHEN NOT over THEN n_seq END AS resp_seq, CASE WHEN NOT over THEN n_ts END AS resp_ts FROM e
WHERE is_request AND CASE WHEN n_ts IS NULL THEN CAST(floor(ts_ns / 1000000000) AS BIGINT) + 120 <= floor({_watermark("s")} / 1000000000) ELSE over OR NOT n_q END""")
def stream_dns_pending(env):
    src = env.sql(_REPLAY_DNS).select(*pairing.DNS_KEY, "seq", "ts_ns", "latency_ns", "res", "is_request")
    out = in_order(env, src, lambda s: stateful.dns_stream(s, delay="0 seconds"))
    return out.select("pid", "fd", "dns_id", "req_seq", "req_ts", "resp_seq", "resp_ts")


_ATTEMPTS = """
WITH e AS (SELECT *, CASE WHEN name = 'tcp_connect' THEN CASE WHEN ret = 0 THEN 'open' ELSE 'failure' END WHEN name = 'connect' THEN CASE WHEN ret = 0 THEN 'success' WHEN ret IN (-115, -114, -106, -4) THEN 'open' ELSE 'failure' END
  WHEN name = 'tcp_set_state' THEN CASE WHEN old_state = 1 OR new_state = 1 THEN 'success' END ELSE 'success' END AS o FROM v_connects WHERE src_port <> 0),
s AS (SELECT *, last_value(CASE WHEN o <> 'open' THEN 'end' WHEN name = 'tcp_connect' THEN 'open' END IGNORE NULLS) OVER (PARTITION BY src_ip, src_port, dst_ip, dst_port ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e WHERE o IS NOT NULL),
n AS (SELECT *, sum(CASE WHEN name = 'tcp_connect' AND coalesce(before, 'end') = 'end' THEN 1 ELSE 0 END) OVER (PARTITION BY src_ip, src_port, dst_ip, dst_port ORDER BY ts_ns, seq) AS attempt FROM s),
m AS (SELECT * FROM n WHERE before = 'open' OR (name = 'tcp_connect' AND coalesce(before, 'end') = 'end')),
a AS (SELECT src_ip, src_port, dst_ip, dst_port, attempt, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, max(CASE WHEN o <> 'open' THEN o END) AS outcome, max(CASE WHEN o = 'failure' THEN ret END) AS code, max(pid) AS pid FROM m GROUP BY 1, 2, 3, 4, 5)
SELECT src_ip, src_port, dst_ip, dst_port, pid, outcome = 'success' AS success, CAST(CASE WHEN outcome = 'success' THEN 0 ELSE code END AS BIGINT) AS errno, last_ns AS ts_ns, CAST(1 AS BIGINT) AS connect_total,
  CASE WHEN outcome = 'success' THEN last_ns - first_ns END AS connect_duration_nanoseconds_total FROM a WHERE outcome IS NOT NULL"""


@query("tcp_connects", _ATTEMPTS)
def tcp_connects(env):
    return connects.finished(connects.attempts(env.v_connects)).drop("attempt")


# Connects of which every third is decided 20 s late and every third 40 s late; a third of the sockets is established, a third still connecting, a third gone.
_SLOW_CONNECTS = """SELECT seq, ts_ns + CASE WHEN seq % 4 >= 2 THEN CAST(floor(seq / 4) AS BIGINT) % 3 * 20000000000 ELSE 0 END AS ts_ns, name, src_ip, src_port, dst_ip, dst_port, ret, old_state, new_state, pid FROM v_connects"""
_CONNECT_SOCKETS = """SELECT pid, src_ip AS local_ip, src_port AS local_port, dst_ip AS remote_ip, dst_port AS remote_port, CASE CAST(floor(seq / 4) AS BIGINT) % 7 % 3 WHEN 0 THEN '01' ELSE '02' END AS state
  FROM v_connects WHERE pid <> 0 AND CAST(floor(seq / 4) AS BIGINT) % 7 % 3 <> 2"""


@query("stream_connects", f"""
WITH s AS (SELECT *, CAST(floor(seq / 4) AS BIGINT) AS o FROM ({_SLOW_CONNECTS}) c WHERE src_port <> 0),
e AS (SELECT *, CASE WHEN name = 'tcp_connect' THEN CASE WHEN ret = 0 THEN 'open' ELSE 'failure' END WHEN name = 'connect' THEN CASE WHEN ret = 0 THEN 'success' WHEN ret IN (-115, -114, -106, -4) THEN 'open' ELSE 'failure' END
  WHEN name = 'tcp_set_state' THEN CASE WHEN old_state = 1 OR new_state = 1 THEN 'success' END ELSE 'success' END AS said FROM s WHERE ts_ns <= {_watermark("s")}),
f AS (SELECT src_ip, src_port, dst_ip, dst_port, o, min(ts_ns) FILTER (name = 'tcp_connect') AS first_ns, min(ts_ns) FILTER (said <> 'open') AS decided, arg_min(said, CASE WHEN said <> 'open' THEN ts_ns END) AS said,
  arg_min(ret, CASE WHEN said <> 'open' THEN ts_ns END) AS code, max(pid) AS pid, max(CASE WHEN name = 'connect' THEN ts_ns END) AS asked FROM e WHERE said IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
d AS (SELECT f.*, k.state, first_ns + 10000000000 <= least(coalesce(decided, {_watermark("s")}), {_watermark("s")}) AND asked IS NOT NULL AND f.pid <> 0 AND (asked < first_ns + 10000000000) AND coalesce(k.state, '') <> '02' AS over
  FROM f LEFT JOIN ({_CONNECT_SOCKETS}) k ON k.pid = f.pid AND local_ip = src_ip AND local_port = src_port AND remote_ip = dst_ip AND remote_port = dst_port)
SELECT src_ip, src_port, dst_ip, dst_port, CASE WHEN decided < asked THEN 0 ELSE pid END AS pid, CASE WHEN over THEN state IS NOT NULL ELSE said = 'success' END AS success,
  CAST(CASE WHEN over THEN CASE WHEN state IS NOT NULL THEN 0 END WHEN said = 'success' THEN 0 ELSE code END AS BIGINT) AS errno, CASE WHEN over THEN asked ELSE decided END AS ts_ns, CAST(1 AS BIGINT) AS connect_total,
  CASE WHEN over THEN CASE WHEN state IS NOT NULL THEN asked - first_ns END WHEN said = 'success' THEN decided - first_ns END AS connect_duration_nanoseconds_total
FROM d WHERE first_ns IS NOT NULL AND (over OR decided IS NOT NULL)""")
def stream_connects(env):
    sockets = env.sql(_CONNECT_SOCKETS)
    return in_order(env, env.sql(_SLOW_CONNECTS), lambda s: stateful.connect_stream(s, sockets, delay="0 seconds"))


_NAT = f"""SELECT seq AS id, ts_ns, concat('10.0.0.', pid) AS src_ip, sport AS src_port, '10.9.0.1' AS dst_ip, CAST(dport AS BIGINT) AS dst_port, concat('20.0.0.', k) AS dnat_ip, CAST(k AS BIGINT) AS dnat_port, k % 3 <> 0 AS is_lookup FROM ({_REPLAY}) r"""


@query("stream_nat", f"""
WITH t AS ({_NAT}), s AS (SELECT *, last_value(CASE WHEN NOT is_lookup THEN {{'ip': dnat_ip, 'port': dnat_port, 'at': ts_ns}} END IGNORE NULLS) OVER (PARTITION BY src_ip, src_port, dst_ip, dst_port ORDER BY ts_ns, is_lookup ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hit FROM t),
q AS (SELECT *, min(ts_ns) OVER (PARTITION BY src_ip, src_port, dst_ip, dst_port, hit.at) AS first_read FROM s WHERE is_lookup)
SELECT id, ts_ns, CASE WHEN first_read - hit.at <= 120000000000 THEN hit.ip END AS dnat_ip, CASE WHEN first_read - hit.at <= 120000000000 THEN hit.port END AS dnat_port FROM q WHERE ts_ns <= {_watermark("t")}""")
def stream_nat(env):
    out = in_order(env, env.sql(_NAT), lambda s: stateful.nat_stream(s, delay="0 seconds"))
    return out.select("id", "ts_ns", "dnat_ip", "dnat_port")


_CHANGES = """SELECT concat('10.1.0.', o_custkey % 250) AS ip, concat('u', o_orderkey) AS uid, 'add' AS op, EPOCH_US(o_orderdate) * 1000 AS ts_ns, concat('pod-', o_orderkey) AS pod FROM orders
  UNION ALL SELECT concat('10.1.0.', o_custkey % 250), concat('u', o_orderkey), 'delete', EPOCH_US(o_orderdate) * 1000 + (o_orderkey % 90) * 86400000000000, '' FROM orders WHERE o_orderkey % 3 <> 0"""


@query("stream_metadata", f"""
SELECT a.ip, a.uid, a.ts_ns AS valid_from, d.ts_ns AS valid_to, a.pod FROM ({_CHANGES}) a JOIN ({_CHANGES}) d ON a.op = 'add' AND d.op = 'delete' AND a.ip = d.ip AND a.uid = d.uid""")
def stream_metadata(env):
    out = in_order(env, env.sql(_CHANGES), lambda s: stateful.metadata_stream(s, ["pod"], delay="0 seconds"))
    return out.select("ip", "uid", "valid_from", "valid_to", "pod")


@query("stream_cumulative", f"""
WITH s AS ({_REPLAY}), e AS (SELECT *, coalesce(ts_ns - lag(ts_ns) OVER (PARTITION BY pid, name ORDER BY ts_ns) > 300000000000, false) AS anew FROM s WHERE ts_ns <= {_watermark("s")}),
g AS (SELECT *, sum(CASE WHEN anew THEN 1 ELSE 0 END) OVER (PARTITION BY pid, name ORDER BY ts_ns) AS life FROM e)
SELECT pid, name, count(*) AS n, CAST(sum(res) AS BIGINT) AS res, max(ts_ns) AS ts_ns, max(ts_ns) + 300000000000 < {_watermark("s")} AS expired FROM g GROUP BY pid, name, life""")
def stream_cumulative(env):
    src = env.sql(_REPLAY).select("pid", "name", "res", F.lit(1).cast("long").alias("n"), "ts_ns")
    out = in_order(env, src, lambda s: stateful.totals_stream(s, ["pid", "name"], ["n", "res"], delay="0 seconds"))
    # The last totals of every life of a label set.
    last = out.groupBy("pid", "name").agg(F.max_by(F.struct("n", "res", "ts_ns", "expired"), "clock").alias("t")).select("pid", "name", "t.*").where("NOT expired")
    return out.where("expired").select(last.columns).unionByName(last)


_MARKS = f"""SELECT pid, concat('t', k % 4) AS trace_id, ts_ns, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS is_entry, concat('/u', k) AS url, 'http' AS protocol FROM ({_REPLAY}) r"""


@query("stream_apm", f"""
SELECT trace_id, pid, ent AS start_ns, ts_ns - ent AS request_total_time, content_key, protocol FROM (
  SELECT *, last_value(CASE WHEN is_entry = 1 THEN ts_ns END IGNORE NULLS) OVER w AS ent, last_value(CASE WHEN is_entry = 1 THEN url END IGNORE NULLS) OVER w AS content_key FROM ({_MARKS}) m
  WINDOW w AS (PARTITION BY trace_id, pid ORDER BY ts_ns, is_entry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) z
WHERE is_entry = 0 AND ts_ns - ent > 500000000 AND ts_ns - ent <= 120000000000 AND ts_ns <= {_watermark(f"({_MARKS}) m2")} - 120000000000""")
def stream_apm(env):
    return in_order(env, env.sql(_MARKS), lambda s: stateful.apm_stream(s, slow_ms=500, delay="0 seconds"))


@query("stream_thread_exit", f"""
WITH s AS ({_REPLAY}), e AS (SELECT *, ts_ns AS at FROM s WHERE ts_ns <= {_watermark("s")}),
x AS (SELECT pid, tid, ts_ns AS exit_ns, lead(ts_ns) OVER (PARTITION BY pid, tid ORDER BY ts_ns, seq) AS again FROM e WHERE name = 'connect')
SELECT x.pid, x.tid, max(e.ts_ns) AS ts_ns, x.exit_ns FROM x JOIN e ON e.pid = x.pid AND e.tid = x.tid AND e.ts_ns < x.exit_ns + 10000000000
WHERE (again IS NULL OR again >= exit_ns + 10000000000) AND exit_ns + 10000000000 <= {_watermark("s")} GROUP BY x.pid, x.tid, x.exit_ns""")
def stream_thread_exit(env):
    name = F.when(F.col("name") == "connect", "procexit").otherwise(F.col("name"))
    src = env.sql(_REPLAY).select("pid", "tid", "ts_ns", name.alias("name"))
    return in_order(env, src, lambda s: stateful.thread_exit_stream(s, delay="0 seconds", buckets=BUCKETS))


@query("stream_workload_info", """
SELECT DISTINCT namespace, 'deployment' AS workload_kind, workload AS workload_name, CAST(1 AS BIGINT) AS value, 0 AS tick FROM v_pods""")
def stream_workload_info(env):
    root = work_dir(env.spark, "workloads")
    ticks = stream(env).events.select("event_id")
    builtin.workload_info(ticks, env.v_pod_info, f"{root}/out", f"{root}/checkpoint", once=True).awaitTermination()
    return env.spark.read.parquet(f"{root}/out").select("namespace", "workload_kind", "workload_name", "value", F.col("tick").cast("int"))
