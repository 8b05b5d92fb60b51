"""Queries for aggregation kinds and pre-aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwork import constants as C
from skeinwork.functions import registry
from skeinwork.operators import aggregate, relabel
from skeinwork.plans.catalog import query
from skeinwork.plans.q_filters import ENTITY_LABELS, ENTITY_SQL, TOPO_LABELS, TOPOLOGY_SQL

_G = "src_namespace, dst_namespace, protocol"
_K = [k.strip() for k in _G.split(",")]
_SIGNED = "request_total_time - 3000000000"


def _one(env, kind, expr="request_total_time", order="request_id"):
    order_col = F.struct("ts_ns", "request_id", "request_total_time", "dst_pod")
    return env.v_requests.groupBy(*_K).agg(registry.agg_kind(kind)(F.expr(expr), order_col).alias("value"))


@query("agg_sum", f"SELECT {_G}, CAST(sum(request_total_time) AS BIGINT) AS value FROM v_requests GROUP BY {_G}")
def agg_sum(env):
    return _one(env, "sum")


@query("agg_max", f"SELECT src_pod, greatest(max(-request_io), 0) AS a, greatest(max({_SIGNED}), 0) AS b FROM v_requests GROUP BY src_pod")
def agg_max(env):
    return env.v_requests.groupBy("src_pod").agg(aggregate.registry.agg_max(-F.col("request_io")).alias("a"),
                                                 aggregate.registry.agg_max(F.expr(_SIGNED)).alias("b"))


@query("agg_avg", f"""
SELECT {_G}, CAST(sum({_SIGNED}) // count(*) AS BIGINT) AS value FROM v_requests GROUP BY {_G}""")
def agg_avg(env):
    return _one(env, "avg", _SIGNED)


@query("agg_last", f"""
SELECT {_G}, request_total_time AS value FROM (SELECT *, row_number() OVER (PARTITION BY {_G}
  ORDER BY ts_ns DESC, request_id DESC, request_total_time DESC, dst_pod DESC) AS rn FROM v_requests) t WHERE rn = 1""")
def agg_last(env):
    return _one(env, "last")


@query("agg_count", f"SELECT {_G}, count(request_total_time) AS value FROM v_requests GROUP BY {_G}")
def agg_count(env):
    return _one(env, "count")


def _bucket_sql():
    return ", ".join(f"count(*) FILTER (request_total_time <= {b}) AS b{i}" for i, b in enumerate(C.TIME_BOUNDS))




def _flat(df, keys):
    return df.select(*keys, F.col("h.sum").alias("s"), F.col("h.count").alias("n"),
                     *[F.get("h.buckets", F.lit(i)).alias(f"b{i}") for i in range(len(C.TIME_BOUNDS))])


@query("agg_histogram", f"SELECT {_G}, CAST(sum(request_total_time) AS BIGINT) AS s, count(*) AS n, {_bucket_sql()} FROM v_requests GROUP BY {_G}")
def agg_histogram(env):
    return _flat(env.v_requests.groupBy(*_K).agg(aggregate.agg_histogram(F.col("request_total_time"), C.TIME_BOUNDS).alias("h")), _K)


@query("merge_histograms", f"SELECT protocol, CAST(sum(request_total_time) AS BIGINT) AS s, count(*) AS n, {_bucket_sql()} FROM v_requests GROUP BY protocol")
def merge_histograms(env):
    part = env.v_requests.groupBy("protocol", "src_pod").agg(aggregate.agg_histogram(F.col("request_total_time"), C.TIME_BOUNDS).alias("h"))
    return _flat(aggregate.merge_histograms(part, ["protocol"], "h", len(C.TIME_BOUNDS)), ["protocol"])


@query("agg_config", f"""
SELECT {_G}, CAST(sum(request_total_time) AS BIGINT) AS request_total_time, CAST(sum(request_total_time) // count(*) AS BIGINT) AS request_total_time_avg,
  count(*) AS request_count, CAST(sum(request_io) AS BIGINT) AS request_io, CAST(sum(response_io) AS BIGINT) AS response_io FROM v_requests GROUP BY {_G}""")
def agg_config(env):
    return aggregate.agg_config(env.v_requests, _K, C.NET_AGG)


@query("agg_all_labels", """
SELECT src_namespace, protocol, metric, CAST(CASE metric WHEN 'rtt' THEN max(value) ELSE sum(value) END AS BIGINT) AS value FROM (
  SELECT src_namespace, protocol, 'bytes' AS metric, request_io AS value FROM v_requests
  UNION ALL SELECT src_namespace, protocol, 'rtt', request_total_time FROM v_requests) t GROUP BY 1, 2, 3""")
def agg_all_labels(env):
    labels = F.create_map(F.lit("protocol"), "protocol", F.lit("src_namespace"), "src_namespace")
    long = env.v_requests.select(labels.alias("labels"), "ts_ns", F.inline(F.array(
        F.struct(F.lit("bytes").alias("metric"), F.col("request_io").alias("value")),
        F.struct(F.lit("rtt").alias("metric"), F.col("request_total_time").alias("value")))))
    out = aggregate.agg_all_labels(long, {"rtt": [("max", "rtt")]})
    return out.select(F.col("labels")["src_namespace"].alias("src_namespace"), F.col("labels")["protocol"].alias("protocol"), "metric", "value")


def _label_sql(name):
    default = "CAST(0 AS BIGINT)" if name in C.INT_LABELS else "false" if name in C.BOOL_LABELS else "''"
    return name if name in _RECORD_COLS else f"{default} AS {name}"


_RECORD_COLS = {"protocol", "is_server", "src_namespace", "src_workload_name", "src_workload_kind", "src_pod", "src_ip", "dst_namespace",
                "dst_workload_name", "dst_workload_kind", "dst_pod", "dst_node", "src_node", "src_node_ip", "dst_node_ip", "dst_service",
                "dst_ip", "dst_port", "dnat_ip", "dnat_port", "content_key", "http_status_code", "dns_rcode", "sql_error_code", "dns_domain",
                "kafka_topic", "is_error", "is_slow"}


@query("agg_net_requests", f"""
SELECT {", ".join(C.NET_LABELS)}, CAST(sum(request_total_time) AS BIGINT) AS request_total_time, CAST(sum(request_total_time) // count(*) AS BIGINT) AS request_total_time_avg,
  count(*) AS request_count, CAST(sum(request_io) AS BIGINT) AS request_io, CAST(sum(response_io) AS BIGINT) AS response_io
FROM (SELECT {", ".join(_label_sql(n) for n in C.NET_LABELS)}, request_total_time, request_io, response_io FROM v_records) t GROUP BY {", ".join(C.NET_LABELS)}""")
def agg_net_requests(env):
    return aggregate.agg_net_requests(env.v_records)


_TCP = """SELECT seq, ts_ns, concat('10.0.0.', pid % 250) AS src_ip, CAST(sport AS BIGINT) AS src_port, concat('10.4.0.', fd) AS dst_ip, CAST(dport AS BIGINT) AS dst_port,
  CASE WHEN k % 3 = 0 THEN k * 10 END AS srtt_microseconds, CASE WHEN k % 3 = 1 THEN k % 4 END AS retransmit_total, CASE WHEN k % 3 = 2 THEN 1 END AS packet_loss_total
  FROM v_socket_events"""


def _tcp_labels(names):
    have = {"src_ip", "src_port", "dst_ip", "dst_port"}
    return ", ".join(n if n in have else (f"CAST(0 AS BIGINT) AS {n}" if n in C.INT_LABELS else f"'' AS {n}") for n in names)


@query("agg_tcp", f"""
SELECT {_tcp_labels(C.TCP_LABELS)}, arg_max(srtt_microseconds, ts_ns) FILTER (srtt_microseconds IS NOT NULL) AS srtt_microseconds,
  CAST(sum(retransmit_total) AS BIGINT) AS retransmit_total, CAST(sum(packet_loss_total) AS BIGINT) AS packet_loss_total
FROM ({_TCP}) t GROUP BY src_ip, src_port, dst_ip, dst_port""")
def agg_tcp(env):
    return aggregate.agg_tcp(env.sql(_TCP))


@query("agg_tcp_connect", f"""
SELECT {", ".join(c if c in ("src_ip", "dst_ip", "dst_port", "errno", "success", "pid") else (f"CAST(0 AS BIGINT) AS {c}" if c in C.INT_LABELS else f"'' AS {c}") for c in C.TCP_CONNECT_LABELS)},
  count(*) AS connect_total, CAST(sum(CASE WHEN success THEN latency_ns END) AS BIGINT) AS connect_duration_nanoseconds_total
FROM (SELECT concat('10.0.0.', pid % 250) AS src_ip, '10.4.0.1' AS dst_ip, CAST(dport AS BIGINT) AS dst_port, CAST(CASE WHEN k % 5 = 0 THEN 111 ELSE 0 END AS BIGINT) AS errno,
  k % 5 <> 0 AS success, pid, latency_ns FROM v_socket_events WHERE name = 'connect') t GROUP BY src_ip, dst_ip, dst_port, errno, success, pid""")
def agg_tcp_connect(env):
    bad = F.col("k") % 5 == 0
    r = env.v_socket_events.where("name = 'connect'").select(
        F.concat(F.lit("10.0.0."), (F.col("pid") % 250).cast("string")).alias("src_ip"), F.lit("10.4.0.1").alias("dst_ip"), F.col("dport").alias("dst_port"),
        F.when(bad, 111).otherwise(0).alias("errno"), (~bad).alias("success"), "pid", "ts_ns", F.lit(1).alias("connect_total"),
        F.when(~bad, F.col("latency_ns")).alias("connect_duration_nanoseconds_total"))
    return aggregate.agg_tcp_connect(r)


@query("tcp_metrics", """
SELECT seq, metric, value, src_ip, dst_ip, CASE WHEN dst_ip = '10.4.0.1' THEN '10.5.0.1' ELSE '' END AS dnat_ip,
  CAST(CASE WHEN dst_ip = '10.4.0.1' THEN 81 ELSE -1 END AS BIGINT) AS dnat_port FROM (
  SELECT seq, concat('10.0.0.', pid % 250) AS src_ip, concat('10.4.0.', fd) AS dst_ip, k, dport,
    CASE k % 4 WHEN 0 THEN 'srtt_microseconds' WHEN 1 THEN 'srtt_microseconds' WHEN 2 THEN 'retransmit_total' ELSE 'packet_loss_total' END AS metric,
    CAST(CASE WHEN k % 4 < 2 THEN k * 10 WHEN k % 4 = 2 THEN CASE WHEN k % 8 = 2 THEN 1 ELSE k END ELSE 1 END AS BIGINT) AS value
  FROM v_socket_events WHERE dport <> 53) t WHERE value <> 0 OR metric <> 'srtt_microseconds'""")
def tcp_metrics(env):
    k = F.col("k")
    name = F.when(k % 4 == 0, "tcp_close").when(k % 4 == 1, "tcp_rcv_established").when(k % 4 == 2, "tcp_retransmit_skb").otherwise("tcp_drop")
    ev = env.v_socket_events.select("seq", "ts_ns", name.alias("name"), F.concat(F.lit("10.0.0."), (F.col("pid") % 250).cast("string")).alias("src_ip"),
                                    F.col("sport").alias("src_port"), F.concat(F.lit("10.4.0."), F.col("fd").cast("string")).alias("dst_ip"),
                                    F.when(F.col("dport") != 53, F.col("dport")).alias("dst_port"), (k * 10).alias("rtt"), F.when(k % 8 != 2, k).alias("segs"))
    nat = ev.select("dst_ip", "dst_port").distinct().where("dst_ip = '10.4.0.1'").withColumns({"dnat_ip": F.lit("10.5.0.1"), "dnat_port": F.lit(81)})
    return aggregate.tcp_metrics(ev, nat).select("seq", "metric", "value", "src_ip", "dst_ip", "dnat_ip", "dnat_port")


@query("node_traffic", """
SELECT src_node_ip, src_node, dst_node_ip, dst_node, role, CAST(sum(v) AS BIGINT) AS transmit_bytes_total FROM (
  SELECT src_node_ip, src_node, dst_node_ip, dst_node, CASE WHEN is_server THEN 'server' ELSE 'client' END AS role, request_io AS v FROM v_records WHERE src_node_ip <> ''
  UNION ALL SELECT dst_node_ip, dst_node, src_node_ip, src_node, CASE WHEN is_server THEN 'server' ELSE 'client' END, response_io FROM v_records WHERE src_node_ip <> '') t
GROUP BY 1, 2, 3, 4, 5""")
def node_traffic(env):
    return aggregate.node_traffic(env.v_records)


@query("workload_info", """
SELECT DISTINCT namespace, 'deployment' AS workload_kind, workload AS workload_name, CAST(1 AS BIGINT) AS value FROM v_pods WHERE node = 'node-3'""")
def workload_info(env):
    return aggregate.workload_info(env.v_pod_info, "node-3")


def _long_sql(src, labels, total, dur, req, resp):
    return f"""WITH s AS ({src})
SELECT {labels}, NULL AS is_slow, '{dur}' AS metric, CAST(sum(request_total_time) AS BIGINT) AS value FROM s GROUP BY {labels}
UNION ALL SELECT {labels}, NULL, '{req}', CAST(sum(request_io) AS BIGINT) FROM s GROUP BY {labels}
UNION ALL SELECT {labels}, NULL, '{resp}', CAST(sum(response_io) AS BIGINT) FROM s GROUP BY {labels}
UNION ALL SELECT {labels}, is_slow, '{total}', count(*) FROM s GROUP BY {labels}, is_slow"""


def preaggregated(env):
    """Records grouped by the 37 labels plus the two error labels the relabelling reads."""
    extra = [c for c in ("dubbo_error_code", "error_type")]
    r = env.v_records
    sel = relabel.select_labels(r, C.NET_LABELS, "ts_ns", *extra, *C.NET_AGG)
    return aggregate.agg_config(sel, C.NET_LABELS + extra, C.NET_AGG)


@query("entity_metrics", _long_sql(ENTITY_SQL, ENTITY_LABELS, "total", "duration_nanoseconds_total", "receive_bytes_total", "send_bytes_total"))
def entity_metrics(env):
    return aggregate.entity_metrics(preaggregated(env))


@query("topology_metrics", _long_sql(TOPOLOGY_SQL, TOPO_LABELS, "total", "duration_nanoseconds_total", "request_bytes_total", "response_bytes_total"))
def topology_metrics(env):
    return aggregate.topology_metrics(preaggregated(env))


_EXT_SQL = """SELECT src_namespace, dst_namespace, dst_pod, protocol, CASE WHEN dnat_ip <> '' AND dnat_port >= 1 THEN dnat_ip ELSE dst_ip END AS dst_ip,
  CASE WHEN dnat_ip <> '' AND dnat_port >= 1 THEN dnat_port ELSE dst_port END AS dst_port, is_slow, request_total_time, request_io, response_io
  FROM (SELECT * REPLACE ('NOT_FOUND_EXTERNAL' AS src_namespace) FROM v_records WHERE is_server) r"""


@query("external_topology", f"""
WITH s AS ({_EXT_SQL}), g AS (SELECT 'x' AS x)
SELECT dst_namespace, dst_pod, protocol, dst_ip, dst_port, metric, CAST(sum(v) AS BIGINT) AS value FROM (
  SELECT *, 'duration_nanoseconds_total' AS metric, request_total_time AS v FROM s UNION ALL SELECT *, 'request_bytes_total', request_io FROM s
  UNION ALL SELECT *, 'response_bytes_total', response_io FROM s UNION ALL SELECT *, 'total', 1 FROM s) t GROUP BY 1, 2, 3, 4, 5, 6""")
def external_topology(env):
    r = env.v_records.withColumn("src_namespace", F.lit(C.EXTERNAL))
    agg = aggregate.external_topology(aggregate.agg_net_requests(r))
    # Every edge has a row of each metric, so the four are summed side by side and become rows after the shuffle.
    labels = ["dst_namespace", "dst_pod", "protocol", "dst_ip", "dst_port"]
    metrics = [C.TOPOLOGY_METRICS[m] for m in ("request_total_time", "request_io", "response_io", "request_count")]
    sums = [F.sum(F.when(F.col("metric") == m, F.col("value"))).cast("long").alias(m) for m in metrics]
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return aggregate.group_packed(agg, labels, sums, least=5).select(*labels, F.inline(rows))


@query("trace_as_metric", """
WITH t AS (SELECT *, request_total_time // 10 AS snt, request_total_time // 2 AS wt, request_total_time // 3 AS dl FROM v_records WHERE is_slow OR is_error),
b AS (SELECT *, CASE WHEN snt <= 200000000 THEN '1' WHEN snt >= 1000000000 THEN '3' ELSE '2' END AS request_reqxfer_status,
  CASE WHEN wt <= 200000000 THEN '1' WHEN wt >= 1000000000 THEN '3' ELSE '2' END AS request_processing_status,
  CASE WHEN dl <= 200000000 THEN '1' WHEN dl >= 1000000000 THEN '3' ELSE '2' END AS response_rspxfer_status,
  CASE WHEN request_total_time <= 800000000 THEN '1' WHEN request_total_time >= 1500000000 THEN '3' ELSE '2' END AS request_duration_status FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY src_namespace, dst_workload_name, protocol, is_server, request_reqxfer_status, request_processing_status,
  response_rspxfer_status, request_duration_status ORDER BY ts_ns DESC, request_id DESC, request_total_time DESC) AS rn FROM b)
SELECT src_namespace, dst_workload_name, protocol, is_server, request_reqxfer_status, request_processing_status, response_rspxfer_status, request_duration_status,
  request_total_time AS trace_request_duration_nanoseconds FROM r WHERE rn = 1""")
def trace_as_metric(env):
    t = F.col("request_total_time")
    r = env.v_records.where("is_slow OR is_error").withColumns({"request_sent_time": F.floor(t / 10), "waiting_ttfb_time": F.floor(t / 2),
                                                                "content_download_time": F.floor(t / 3)})
    return aggregate.trace_as_metric(r, ["src_namespace", "dst_workload_name", "protocol"], ["ts_ns", "request_id", "request_total_time"])


@query("self_counts", """
SELECT 'event' AS kind, name AS label, count(*) AS n FROM v_socket_events GROUP BY 2
UNION ALL SELECT 'protocol', protocol, count(*) FROM v_requests GROUP BY 2
UNION ALL SELECT 'l4', CASE WHEN dport = 53 THEN 'udp' ELSE 'tcp' END, count(*) FROM v_socket_events WHERE name <> 'connect' GROUP BY 2""")
def self_counts(env):
    def count(df, kind, label):
        return df.groupBy(label.alias("label")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "label", "n")
    s = env.v_socket_events
    return (count(s, "event", F.col("name")).unionByName(count(env.v_requests, "protocol", F.col("protocol")))
            .unionByName(count(s.where("name <> 'connect'"), "l4", F.when(F.col("dport") == 53, "udp").otherwise("tcp"))))
