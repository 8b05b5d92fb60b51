"""Queries for topology graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwork.operators import topology
from skeinwork.plans.catalog import query

NS = "ASIA"
_ERR = """CASE WHEN protocol = 'http' AND TRY_CAST({c} AS INT) >= 400 THEN calls WHEN protocol = 'dns' AND TRY_CAST({c} AS INT) > 0 THEN calls ELSE 0 END"""
_EXT = "('NOT_FOUND_EXTERNAL', 'NOT_FOUND_INTERNAL', 'EXTERNAL', 'external')"


def _edge_sums(code="status_code"):
    s = lambda c: f"CAST(coalesce(sum({c}), 0) AS BIGINT)"
    return (f"{s('calls')} AS calls, {s('time_ns')} AS time_ns, {s('sent')} AS sent, {s('received')} AS received, {s('rtt_us')} AS rtt_us, "
            f"{s('retransmit')} AS retransmit, {s('loss')} AS loss, {s(_ERR.format(c=code))} AS errors")


_SHOW = """calls, sent, received, CASE WHEN calls = 0 THEN 0.0 ELSE CAST(time_ns AS DOUBLE) / CAST(calls AS DOUBLE) / CAST(1000000 AS DOUBLE) END AS latency,
  CASE WHEN calls = 0 THEN 0.0 ELSE CAST(errors AS DOUBLE) / CAST(calls AS DOUBLE) * CAST(100 AS DOUBLE) END AS error_rate"""
_SHOW_EDGE = f"{_SHOW}, retransmit, loss, CAST(rtt_us AS DOUBLE) / CAST(1000 AS DOUBLE) AS rtt"
NS_EDGES = f"""
WITH e AS (SELECT DISTINCT src_namespace AS source, CASE WHEN protocol = 'dns' THEN dst_ip ELSE dst_namespace END AS target, protocol = 'dns' AS dns_edge FROM v_edge_agg),
n AS (SELECT src_namespace AS source, dst_namespace AS target, false AS dns_edge, {_edge_sums()} FROM v_edge_agg GROUP BY 1, 2
  UNION ALL SELECT src_namespace, dst_ip, true, {_edge_sums()} FROM v_edge_agg GROUP BY 1, 2)
SELECT source, target, dns_edge, {_SHOW_EDGE} FROM e JOIN n USING (source, target, dns_edge) WHERE source <> target"""


@query("topo_namespace", NS_EDGES)
def topo_namespace(env):
    return topology.namespace_edges(env.v_edge_agg)


@query("topo_namespace_nodes", f"""
WITH n AS (SELECT id, min(t) AS node_type FROM (
  SELECT src_namespace AS id, CASE WHEN src_namespace IN {_EXT} THEN 'external' ELSE 'namespace' END AS t FROM v_edge_agg
  UNION ALL SELECT CASE WHEN protocol = 'dns' THEN dst_ip ELSE dst_namespace END, CASE WHEN protocol = 'dns' THEN 'dns' WHEN dst_namespace IN {_EXT} THEN 'external' ELSE 'namespace' END
  FROM v_edge_agg) a GROUP BY id),
s AS (SELECT namespace AS id, sum(calls) AS calls, sum(time_ns) AS time_ns, sum(sent) AS sent, sum(received) AS received, sum({_ERR.format(c='response_content')}) AS errors
  FROM v_entity_agg GROUP BY 1),
j AS (SELECT id, node_type, CASE WHEN node_type <> 'external' THEN CAST(coalesce(calls, 0) AS BIGINT) END AS calls, CASE WHEN node_type <> 'external' THEN coalesce(time_ns, 0) END AS time_ns,
  CASE WHEN node_type <> 'external' THEN CAST(coalesce(sent, 0) AS BIGINT) END AS sent, CASE WHEN node_type <> 'external' THEN CAST(coalesce(received, 0) AS BIGINT) END AS received,
  CASE WHEN node_type <> 'external' THEN coalesce(errors, 0) END AS errors FROM n LEFT JOIN s USING (id))
SELECT id, node_type, {_SHOW} FROM j""")
def topo_namespace_nodes(env):
    return topology.namespace_nodes(env.v_edge_agg, env.v_entity_agg)


_IN_NS = f"(src_namespace = '{NS}' OR dst_namespace = '{NS}')"


def _ports():
    return f"""p AS (SELECT namespace, ip, CASE WHEN count(port) = 0 THEN ip ELSE concat(ip, ':', string_agg(CAST(port AS VARCHAR), '%' ORDER BY port)) END AS shown
  FROM (SELECT DISTINCT dst_namespace AS namespace, dst_ip AS ip, CASE WHEN dst_port > 0 THEN dst_port END AS port FROM v_edge_agg WHERE dst_namespace IN {_EXT}) x GROUP BY 1, 2)"""


def _end(side, pods):
    ext = f"{side}_namespace IN {_EXT}"
    if not pods:
        return (f"CASE WHEN {ext} THEN 'external' ELSE 'workload' END", f"CASE WHEN {ext} THEN {side}_ip ELSE {side}_workload_name END")
    return (f"CASE WHEN {ext} THEN 'external' WHEN {side}_pod <> '' THEN 'pod' WHEN {side}_workload_kind = '' THEN 'unknow' ELSE 'workload' END",
            f"CASE WHEN {ext} THEN {side}_ip WHEN {side}_pod <> '' THEN {side}_pod ELSE {side}_workload_name END")


def _match(a, side):
    """Whether sample row x counts for end ``a`` of edge e."""
    return (f"x.{side}_namespace = e.{a}_ns AND CASE e.{a}_kind WHEN 'external' THEN x.{side}_ip = e.{a}_name WHEN 'pod' THEN x.{side}_pod = e.{a}_name "
            f"WHEN 'unknow' THEN x.{side}_workload_name = e.{a}_name AND x.{side}_pod = '' ELSE x.{side}_workload_name = e.{a}_name AND x.{side}_namespace NOT IN {_EXT} END")


def _detail(pods, services=False, where=_IN_NS):
    (sk, sn), (dk, dn) = _end("src", pods), _end("dst", pods)
    svc = f"CASE WHEN dst_namespace IN {_EXT} THEN '' ELSE dst_service END" if services else "''"
    line = "AND (e.service = '' OR x.dst_service = e.service)" if services else ""
    return f"""WITH {_ports()},
e AS (SELECT DISTINCT {sk} AS s_kind, src_namespace AS s_ns, {sn} AS s_name, {dk} AS d_kind, dst_namespace AS d_ns, {dn} AS d_name, {svc} AS service FROM v_edge_agg WHERE {where}),
a AS (SELECT e.*, {_edge_sums()} FROM e JOIN v_edge_agg x ON {_match('s', 'src')} AND {_match('d', 'dst')} {line}
  WHERE concat(s_ns, '_', s_name) <> concat(d_ns, '_', d_name) GROUP BY s_kind, s_ns, s_name, d_kind, d_ns, d_name, e.service)
SELECT concat(s_ns, '_', s_name) AS source, concat(d_ns, '_', CASE WHEN d_kind = 'external' THEN p.shown ELSE d_name END) AS target, service, {_SHOW_EDGE}
FROM a LEFT JOIN p ON d_kind = 'external' AND p.namespace = d_ns AND p.ip = d_name"""


@query("topo_workload", _detail(False))
def topo_workload(env):
    return topology.detail_edges(env.v_edge_agg, NS)


@query("topo_workload_services", _detail(False, True))
def topo_workload_services(env):
    return topology.detail_edges(env.v_edge_agg, NS, services=True)


_W = f"((src_namespace = '{NS}' AND src_workload_name = 'NATION_7') OR (dst_namespace = '{NS}' AND dst_workload_name = 'NATION_7'))"


@query("topo_pod", _detail(True, where=_W))
def topo_pod(env):
    return topology.detail_edges(env.v_edge_agg, NS, "NATION_7", pods=True)


@query("topo_workload_nodes", f"""
WITH {_ports()},
n AS (SELECT DISTINCT src_namespace AS namespace, src_workload_name AS name, src_workload_kind AS node_type FROM v_edge_agg WHERE {_IN_NS}
  UNION SELECT DISTINCT dst_namespace, CASE WHEN dst_namespace IN {_EXT} THEN dst_ip ELSE dst_workload_name END, CASE WHEN dst_namespace IN {_EXT} THEN 'external' ELSE dst_workload_kind END
  FROM v_edge_agg WHERE {_IN_NS}),
d AS (SELECT namespace, name, min(node_type) AS node_type FROM n GROUP BY 1, 2),
s AS (SELECT namespace, workload_name AS name, CAST(sum(calls) AS BIGINT) AS calls, sum(time_ns) AS time_ns, CAST(sum(sent) AS BIGINT) AS sent, CAST(sum(received) AS BIGINT) AS received,
  sum({_ERR.format(c='response_content')}) AS errors FROM v_entity_agg GROUP BY 1, 2),
j AS (SELECT d.namespace, CASE WHEN node_type = 'external' THEN p.shown ELSE d.name END AS name, node_type, node_type <> 'external' AND d.namespace <> '{NS}' AS show_namespace,
  CASE WHEN node_type <> 'external' THEN coalesce(calls, 0) END AS calls, CASE WHEN node_type <> 'external' THEN coalesce(time_ns, 0) END AS time_ns,
  CASE WHEN node_type <> 'external' THEN coalesce(sent, 0) END AS sent, CASE WHEN node_type <> 'external' THEN coalesce(received, 0) END AS received,
  CASE WHEN node_type <> 'external' THEN coalesce(errors, 0) END AS errors
  FROM d LEFT JOIN s ON d.namespace = s.namespace AND d.name = s.name AND node_type <> 'external' LEFT JOIN p ON node_type = 'external' AND p.namespace = d.namespace AND p.ip = d.name)
SELECT concat(namespace, '_', name) AS id, namespace, name, node_type, show_namespace, {_SHOW} FROM j""")
def topo_workload_nodes(env):
    return topology.detail_nodes(env.v_edge_agg, env.v_entity_agg, NS)


@query("topo_external_ports", f"""WITH {_ports()} SELECT namespace, ip, shown AS name FROM p""")
def topo_external_ports(env):
    return topology.external_ports(env.v_edge_agg).select("namespace", "ip", "name")


@query("error_rate", f"""
WITH s AS (SELECT src_namespace, dst_namespace, sum(calls) AS calls, sum({_ERR.format(c='status_code')}) AS errors FROM v_edge_agg GROUP BY 1, 2)
SELECT src_namespace, dst_namespace, CAST(calls AS BIGINT) AS calls, CASE WHEN calls = 0 THEN 0.0 ELSE CAST(errors AS DOUBLE) / CAST(calls AS DOUBLE) * CAST(100 AS DOUBLE) END AS error_rate FROM s""")
def error_rate(env):
    return topology.error_rate(env.v_edge_agg, ["src_namespace", "dst_namespace"])


_CONN = """SELECT src_namespace AS source, dst_namespace AS target, CAST(coalesce(sum(connects) FILTER (NOT success), 0) AS BIGINT) AS failed, CAST(sum(connects) AS BIGINT) AS total
  FROM v_connect_agg WHERE src_namespace <> dst_namespace GROUP BY 1, 2"""
_FAIL = "CASE WHEN failed = 0 THEN 0.0 ELSE CAST(failed AS DOUBLE) / CAST(total AS DOUBLE) * CAST(100 AS DOUBLE) END"


def connect_edges(env):
    c = env.v_connect_agg.where("src_namespace <> dst_namespace").withColumnsRenamed({"src_namespace": "source", "dst_namespace": "target"})
    return topology.conn_failures(c, ["source", "target"])


@query("conn_failures", f"SELECT source, target, failed, total, {_FAIL} AS conn_fail FROM ({_CONN}) c")
def conn_failures(env):
    return connect_edges(env)


@query("topology_overlay", f"""
WITH t AS (SELECT src_namespace AS source, dst_namespace AS target, CAST(sum(calls) AS BIGINT) AS calls FROM v_edge_agg WHERE src_namespace <> dst_namespace GROUP BY 1, 2),
f AS (SELECT source, target, {_FAIL} AS conn_fail FROM ({_CONN}) c)
SELECT coalesce(t.source, f.source) AS source, coalesce(t.target, f.target) AS target, calls, conn_fail FROM t FULL JOIN f ON t.source = f.source AND t.target = f.target""")
def topology_overlay(env):
    e = env.v_edge_agg.where("src_namespace <> dst_namespace")
    traffic = e.groupBy(F.col("src_namespace").alias("source"), F.col("dst_namespace").alias("target")).agg(F.sum("calls").cast("long").alias("calls"))
    return topology.overlay(traffic, connect_edges(env)).select("source", "target", "calls", "conn_fail")


@query("edge_status", f"""
SELECT source, target, dns_edge, CASE WHEN latency > 3000 THEN 'abnormal' WHEN latency > 2500 THEN 'warning' ELSE 'normal' END AS latency_status,
  CASE WHEN rtt > 30 THEN 'abnormal' WHEN rtt > 10 THEN 'warning' ELSE 'normal' END AS rtt_status,
  CASE WHEN error_rate > 0 THEN 'abnormal' ELSE 'normal' END AS error_status FROM ({NS_EDGES}) t""")
def edge_status(env):
    e = topology.namespace_edges(env.v_edge_agg)
    return e.select("source", "target", "dns_edge", topology.edge_status(F.col("latency"), 2500, 3000).alias("latency_status"),
                    topology.edge_status(F.col("rtt"), 10, 30).alias("rtt_status"), topology.edge_status(F.col("error_rate")).alias("error_status"))


@query("edge_volume_step", f"""
SELECT source, target, dns_edge, CAST(floor(CAST(sent AS DOUBLE) / ((SELECT CAST(max(sent) AS DOUBLE) FROM ({NS_EDGES}) m) / CAST(5 AS DOUBLE))) AS INT) AS step FROM ({NS_EDGES}) t""")
def edge_volume_step(env):
    return topology.volume_step(topology.namespace_edges(env.v_edge_agg)).select("source", "target", "dns_edge", "step")


@query("edge_volume_range", f"""
SELECT min(sent) AS min_sent, max(sent) AS max_sent, min(received) AS min_received, max(received) AS max_received FROM ({NS_EDGES}) t""")
def edge_volume_range(env):
    return topology.volume_range(topology.namespace_edges(env.v_edge_agg))


@query("opposite_edge", """
WITH e AS (SELECT src_workload_name AS source, dst_workload_name AS target, min(first_seen) AS first_seen FROM v_edge_agg WHERE src_workload_name <> dst_workload_name GROUP BY 1, 2)
SELECT e.source, e.target, e.first_seen, coalesce(b.first_seen < e.first_seen, false) AS opposite FROM e LEFT JOIN e b ON b.source = e.target AND b.target = e.source""")
def opposite_edge(env):
    e = env.v_edge_agg.where("src_workload_name <> dst_workload_name").groupBy(
        F.col("src_workload_name").alias("source"), F.col("dst_workload_name").alias("target")).agg(F.min("first_seen").alias("first_seen"))
    return topology.opposite_edge(e)


@query("label_rollup", """
SELECT namespace, workload_name, pod, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(time_ns) AS BIGINT) AS time_ns, 3 AS level FROM v_entity_agg GROUP BY 1, 2, 3
UNION ALL SELECT namespace, workload_name, NULL, CAST(sum(calls) AS BIGINT), CAST(sum(time_ns) AS BIGINT), 2 FROM v_entity_agg GROUP BY 1, 2
UNION ALL SELECT namespace, NULL, NULL, CAST(sum(calls) AS BIGINT), CAST(sum(time_ns) AS BIGINT), 1 FROM v_entity_agg GROUP BY 1""")
def label_rollup(env):
    return topology.label_rollup(env.v_entity_agg, ["namespace", "workload_name", "pod"], ["calls", "time_ns"])


@query("namespace_options", """
SELECT DISTINCT namespace, workload FROM (SELECT src_namespace AS namespace, src_workload_name AS workload FROM v_edge_agg
  UNION ALL SELECT dst_namespace, dst_workload_name FROM v_edge_agg) t""")
def namespace_options(env):
    return topology.options(env.v_edge_agg)


@query("label_values", "SELECT DISTINCT src_namespace FROM v_edge_agg WHERE protocol = 'dns'")
def label_values(env):
    return env.v_edge_agg.where("protocol = 'dns'").select("src_namespace").distinct()


# Traces with span groups: each conversation is a trace, a turn holds two span ids, its parent is the turn before.
_TRACES = """SELECT conv_id AS trace_id, turn, concat(conv_id, '-', turn, 'a,', conv_id, '-', turn, 'b') AS span_ids,
  CASE WHEN turn = 0 THEN '0' ELSE concat(conv_id, '-', turn - 1, CASE WHEN turn % 2 = 0 THEN 'a' ELSE 'b' END) END AS parent_id FROM conversations"""


@query("span_edges", """
SELECT DISTINCT conv_id AS trace_id, concat(conv_id, '-', turn - 1, 'a,', conv_id, '-', turn - 1, 'b') AS source, concat(conv_id, '-', turn, 'a,', conv_id, '-', turn, 'b') AS target
FROM conversations c WHERE turn > 0 AND EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)""")
def span_edges(env):
    return topology.span_edges(env.sql(_TRACES))
