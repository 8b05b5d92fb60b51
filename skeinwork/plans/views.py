"""Deterministic views over the given tables, one text for both engines.

Two words differ between the dialects: ``EPOCH_US(x)`` is ``unix_micros(CAST(x AS TIMESTAMP))`` in Spark and
``epoch_us(x)`` in DuckDB, ``UNNEST(a, b, ...)`` is ``explode(array(...))`` and ``unnest([...])``. A view may use the
views above it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from skeinwork.session import pin_session
from skeinwork.sources.events import scan_table

# Session setting: deal every table to so many partitions when it is read. Unset, splits are those of spark.sql.files.*.
PARTITIONS = "spark.skeinwork.inputPartitions"

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS: dict[str, str] = {}

VIEWS["v_requests"] = """
SELECT l_orderkey * 10 + l_linenumber AS request_id,
       EPOCH_US(l_shipdate) * 1000 + (l_orderkey % 86400) * 1000000000 AS ts_ns,
       CASE l_linenumber % 6 WHEN 0 THEN 'http' WHEN 1 THEN 'dns' WHEN 2 THEN 'mysql'
            WHEN 3 THEN 'redis' WHEN 4 THEN 'kafka' ELSE 'dubbo' END AS protocol,
       l_linestatus = 'F' AS is_server,
       cr.r_name AS src_namespace, cn.n_name AS src_workload, c_name AS src_pod,
       sr.r_name AS dst_namespace, sn.n_name AS dst_workload, s_name AS dst_pod,
       p_brand AS dst_service, p_type AS content_key,
       concat('10.1.', CAST(floor(c_custkey / 256) AS INT), '.', c_custkey % 256) AS src_ip,
       concat('10.2.', CAST(floor(s_suppkey / 256) AS INT), '.', s_suppkey % 256) AS dst_ip,
       8000 + l_suppkey % 100 AS dst_port,
       CAST(round(l_extendedprice * 100) AS BIGINT) * 100 AS request_total_time,
       CAST(floor(l_quantity) AS BIGINT) AS request_io,
       CAST(floor(o_totalprice) AS BIGINT) AS response_io,
       CASE WHEN l_linenumber % 6 = 0 THEN CASE l_returnflag WHEN 'R' THEN 500 WHEN 'A' THEN 404 ELSE 200 END
            WHEN l_linenumber % 6 = 1 THEN CASE l_returnflag WHEN 'R' THEN 3 ELSE 0 END
            WHEN l_linenumber % 6 = 2 THEN CASE l_returnflag WHEN 'R' THEN 1064 ELSE 0 END
            WHEN l_linenumber % 6 = 5 THEN CASE l_returnflag WHEN 'R' THEN 70 ELSE 20 END
            ELSE 0 END AS status_code
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation cn ON c_nationkey = cn.n_nationkey
JOIN region cr ON cn.n_regionkey = cr.r_regionkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN nation sn ON s_nationkey = sn.n_nationkey
JOIN region sr ON sn.n_regionkey = sr.r_regionkey
JOIN part ON l_partkey = p_partkey
"""

VIEWS["v_socket_events"] = """
SELECT event_id AS seq, EPOCH_US(ts) * 1000 AS ts_ns,
       CASE event_type WHEN 'click' THEN 'read' WHEN 'view' THEN 'write' WHEN 'purchase' THEN 'recvfrom'
            WHEN 'signup' THEN 'sendto' ELSE 'connect' END AS name,
       user_id AS pid, user_id * 10 + event_id % 4 AS tid, event_id % 3 AS fd,
       user_id % 2 = 0 AS is_server_fd,
       30000 + user_id AS sport, CASE WHEN user_id % 5 = 0 THEN 53 ELSE 8080 END AS dport,
       CAST(round(value * 100) AS BIGINT) * 1000 AS latency_ns,
       CAST(floor(value) AS BIGINT) AS res,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
FROM events
"""

VIEWS["v_messages"] = """
SELECT conv_id AS pid, 0 AS fd, turn AS seq, conv_id * 1000000000 + turn * 1000000 AS ts_ns,
       CAST(length(text) AS BIGINT) * 10 AS latency_ns, CAST(length(text) AS BIGINT) AS res,
       role = 'user' AS is_request, text AS data
FROM conversations
"""

VIEWS["v_segments"] = """
SELECT pid, tid, seq, ts_ns AS start_ns, ts_ns + latency_ns * 1000 AS end_ns, k % 7 AS cpu_type,
       CAST(floor(ts_ns / 1000000000) AS BIGINT) AS start_s
FROM v_socket_events
"""

VIEWS["v_series"] = """
SELECT src_namespace, dst_namespace, protocol, day,
       CAST(sum(n) OVER (PARTITION BY src_namespace, dst_namespace, protocol ORDER BY day) AS BIGINT) AS total
FROM (SELECT src_namespace, dst_namespace, protocol, CAST(floor(ts_ns / 86400000000000) AS BIGINT) AS day, count(*) AS n
      FROM v_requests GROUP BY 1, 2, 3, 4) d
"""

VIEWS["v_pods"] = """
SELECT c_name AS pod, r_name AS namespace, n_name AS workload, concat('node-', n_nationkey) AS node,
       concat('10.1.', CAST(floor(c_custkey / 256) AS INT), '.', c_custkey % 256) AS ip,
       c_mktsegment = 'MACHINERY' AS host_network
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

VIEWS["v_nodes"] = """
SELECT concat('node-', n_nationkey) AS node, concat('10.9.0.', n_nationkey) AS ip FROM nation
"""

VIEWS["v_services"] = """
SELECT DISTINCT r_name AS namespace, concat('svc-', n_name) AS service,
       concat('10.2.', CAST(floor(s_suppkey / 256) AS INT), '.', s_suppkey % 256) AS ip,
       8000 + s_suppkey % 100 AS port, s_suppkey % 2 = 0 AS node_port
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

VIEWS["v_pod_labels"] = """
SELECT r_name AS namespace, c_name AS pod, 'segment' AS k, c_mktsegment AS v
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT r_name, c_name, 'tier', CAST(c_custkey % 3 AS VARCHAR(9))
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

VIEWS["v_selectors"] = """
SELECT DISTINCT namespace, concat('svc-', v) AS service, k, v FROM v_pod_labels WHERE k = 'segment'
UNION ALL
SELECT DISTINCT namespace, 'svc-MACHINERY', 'tier', '1' FROM v_pod_labels WHERE v = 'MACHINERY'
"""

VIEWS["v_nat"] = """
SELECT DISTINCT src_ip, dst_ip, dst_port, concat('10.3.0.', dst_port % 256) AS dnat_ip, dst_port + 1000 AS dnat_port
FROM v_requests WHERE dst_port % 3 = 0
"""

VIEWS["v_urls"] = """
SELECT page_id, url, regexp_replace(url, '^https?://[^/]+', '') AS path FROM pages
"""

# Pods as the metadata tables need them: one container per pod, a declared port for two pods in three.
VIEWS["v_pod_info"] = """
SELECT p.pod, p.namespace, p.workload AS workload_name, 'deployment' AS workload_kind, p.node,
       coalesce(n.ip, '') AS node_ip, p.ip, p.host_network, concat('c-', p.pod) AS container,
       substr(concat(md5(p.pod), '0000'), 1, 12) AS container_id,
       CASE WHEN ascii(right(p.pod, 1)) % 3 = 0 THEN 0 ELSE 8000 + ascii(right(p.pod, 1)) END AS port,
       CASE WHEN ascii(right(p.pod, 1)) % 5 = 0 THEN 30000 + ascii(right(p.pod, 1)) ELSE 0 END AS host_port,
       CASE WHEN ascii(right(p.pod, 1)) % 2 = 0 THEN concat('svc-', p.workload) ELSE '' END AS service
FROM v_pods p LEFT JOIN v_nodes n ON p.node = n.node
"""

VIEWS["v_service_info"] = """
SELECT namespace, service, ip, port, CASE WHEN node_port THEN 30050 + port % 4 END AS node_port,
       'deployment' AS workload_kind, substr(service, 5) AS workload_name
FROM v_services
"""

# Requests whose ends are pods, services, nodes, host ports, the loopback or strangers.
VIEWS["v_calls"] = """
SELECT request_id, ts_ns, is_server, protocol, request_total_time, request_io, response_io,
       CASE request_id % 11 WHEN 0 THEN '127.0.0.1' WHEN 1 THEN '10.9.0.3' WHEN 2 THEN '8.8.8.8' ELSE src_ip END AS src_ip,
       32768 + request_id % 5000 AS src_port,
       CASE request_id % 7 WHEN 0 THEN '127.0.0.1' WHEN 1 THEN '10.9.0.4' WHEN 2 THEN '9.9.9.9' WHEN 3 THEN src_ip
            ELSE dst_ip END AS dst_ip,
       CASE WHEN request_id % 7 = 1 AND request_id % 4 = 0 THEN 30000 + 50 + request_id % 8
            WHEN request_id % 7 = 3 THEN 8000 + 48 + request_id % 10 ELSE dst_port END AS dst_port,
       CASE WHEN request_id % 3 = 0 THEN substr(concat(md5(src_pod), '0000'), 1, 12)
            WHEN request_id % 3 = 1 THEN '' ELSE 'unknown00000' END AS container_id,
       CASE WHEN request_id % 4 = 0 THEN src_ip WHEN request_id % 4 = 1 THEN '10.9.0.5' ELSE '' END AS dnat_ip,
       CASE WHEN request_id % 4 < 2 THEN 8000 + 48 + request_id % 10 ELSE -1 END AS dnat_port
FROM v_requests
"""

# Request records with the labels of the pre-aggregation.
VIEWS["v_records"] = """
SELECT request_id, ts_ns, protocol, is_server, src_namespace, src_workload AS src_workload_name,
       'deployment' AS src_workload_kind, src_pod, src_ip, CASE WHEN request_id % 9 = 0 THEN 'NOT_FOUND_EXTERNAL'
       ELSE dst_namespace END AS dst_namespace, dst_workload AS dst_workload_name, 'deployment' AS dst_workload_kind,
       dst_pod, concat('node-', dst_workload) AS dst_node, concat('node-', src_workload) AS src_node,
       CASE WHEN request_id % 13 = 0 THEN '' ELSE concat('ip-', src_workload) END AS src_node_ip,
       concat('ip-', dst_workload) AS dst_node_ip, dst_service, dst_ip, CAST(dst_port AS BIGINT) AS dst_port,
       CASE WHEN request_id % 5 = 0 THEN '10.3.0.9' ELSE '' END AS dnat_ip,
       CAST(CASE WHEN request_id % 5 = 0 THEN 9000 + request_id % 3 WHEN request_id % 5 = 1 THEN 77 ELSE -1 END AS BIGINT) AS dnat_port,
       content_key, request_total_time, request_io, response_io, status_code,
       CAST(CASE WHEN protocol = 'http' THEN status_code ELSE 0 END AS BIGINT) AS http_status_code,
       CAST(CASE WHEN protocol = 'dns' THEN status_code ELSE 0 END AS BIGINT) AS dns_rcode,
       CAST(CASE WHEN protocol = 'mysql' THEN status_code ELSE 0 END AS BIGINT) AS sql_error_code,
       CAST(CASE WHEN protocol = 'dubbo' THEN status_code ELSE 0 END AS BIGINT) AS dubbo_error_code,
       CASE WHEN protocol = 'dns' THEN concat(dst_service, '.') ELSE '' END AS dns_domain,
       CASE WHEN protocol = 'kafka' THEN dst_service ELSE '' END AS kafka_topic,
       CASE protocol WHEN 'http' THEN status_code >= 400 WHEN 'dns' THEN status_code > 0
            WHEN 'mysql' THEN status_code <> 0 WHEN 'dubbo' THEN status_code > 20 ELSE false END AS is_error,
       CAST(CASE WHEN (protocol = 'http' AND status_code >= 400) OR (protocol = 'dns' AND status_code > 0)
            OR (protocol = 'mysql' AND status_code <> 0) OR (protocol = 'dubbo' AND status_code > 20) THEN 3 ELSE 0 END AS BIGINT) AS error_type,
       request_total_time >= CASE WHEN protocol IN ('mysql', 'kafka', 'redis', 'dns') THEN 100000000 ELSE 500000000 END AS is_slow
FROM v_requests
"""

# Client side: one row per edge label set; server side: one row per entity label set.
VIEWS["v_edge_agg"] = """
SELECT src_namespace, src_workload_name, 'deployment' AS src_workload_kind, src_pod, src_ip, dst_namespace, dst_workload_name,
       CASE WHEN dst_workload_name < 'NATION_12' THEN '' ELSE 'deployment' END AS dst_workload_kind,
       CASE WHEN request_id % 4 = 0 THEN '' ELSE dst_pod END AS dst_pod, dst_ip, dst_port, dst_service, protocol,
       CASE WHEN protocol IN ('redis', 'kafka') THEN '' ELSE CAST(status_code AS VARCHAR(9)) END AS status_code,
       min(request_id) AS first_seen, count(*) AS calls, CAST(sum(request_total_time) AS BIGINT) AS time_ns,
       CAST(sum(request_io) AS BIGINT) AS sent, CAST(sum(response_io) AS BIGINT) AS received,
       CAST(sum(request_io * 10) AS BIGINT) AS rtt_us, CAST(sum(CASE WHEN request_id % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS retransmit,
       CAST(sum(CASE WHEN request_id % 31 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS loss
FROM v_records WHERE NOT is_server GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14
"""
VIEWS["v_entity_agg"] = """
SELECT dst_namespace AS namespace, dst_workload_name AS workload_name, CASE WHEN request_id % 4 = 0 THEN '' ELSE dst_pod END AS pod, protocol,
       CASE WHEN protocol IN ('redis', 'kafka') THEN '' ELSE CAST(status_code AS VARCHAR(9)) END AS response_content,
       count(*) AS calls, CAST(sum(request_total_time) AS BIGINT) AS time_ns,
       CAST(sum(response_io) AS BIGINT) AS sent, CAST(sum(request_io) AS BIGINT) AS received
FROM v_records WHERE is_server GROUP BY 1, 2, 3, 4, 5
"""
VIEWS["v_connect_agg"] = """
SELECT src_namespace, dst_namespace, request_io % 8 <> 0 AS success, count(*) AS connects
FROM v_records WHERE NOT is_server GROUP BY 1, 2, 3
"""

# Cumulative counters per day, as a metric store returns them.
VIEWS["v_dns_series"] = """
SELECT src_namespace, src_workload_name, dst_ip, status_code, is_slow, day,
       CAST(sum(n) OVER (PARTITION BY src_namespace, src_workload_name, dst_ip, status_code, is_slow ORDER BY day) AS BIGINT) AS total,
       CAST(sum(d) OVER (PARTITION BY src_namespace, src_workload_name, dst_ip, status_code, is_slow ORDER BY day) AS BIGINT) AS duration
FROM (SELECT src_namespace, src_workload_name, dst_ip, CAST(request_io % 6 AS VARCHAR(9)) AS status_code, is_slow,
        CAST(floor(ts_ns / 86400000000000) AS BIGINT) AS day, count(*) AS n, sum(request_total_time) AS d
      FROM v_records WHERE protocol = 'dns' AND NOT is_server GROUP BY 1, 2, 3, 4, 5, 6) t
"""
VIEWS["v_net_series"] = """
SELECT src_workload_name, dst_workload_name, src_namespace, day, CAST(r AS BIGINT) AS rtt_us,
       CAST(sum(rt) OVER (PARTITION BY src_workload_name, dst_workload_name, src_namespace ORDER BY day) AS BIGINT) AS retransmit,
       CAST(sum(lo) OVER (PARTITION BY src_workload_name, dst_workload_name, src_namespace ORDER BY day) AS BIGINT) AS loss,
       CAST(sum(se) OVER (PARTITION BY src_workload_name, dst_workload_name, src_namespace ORDER BY day) AS BIGINT) AS sent,
       CAST(sum(re) OVER (PARTITION BY src_workload_name, dst_workload_name, src_namespace ORDER BY day) AS BIGINT) AS received
FROM (SELECT src_workload_name, dst_workload_name, src_namespace, CAST(floor(ts_ns / 86400000000000) AS BIGINT) AS day,
        max(request_io) AS r, sum(CASE WHEN request_id % 7 = 0 THEN 1 ELSE 0 END) AS rt, sum(CASE WHEN request_id % 31 = 0 THEN 1 ELSE 0 END) AS lo,
        sum(request_io) AS se, sum(response_io) AS re
      FROM v_records WHERE NOT is_server GROUP BY 1, 2, 3, 4) t
"""
VIEWS["v_trace_metric"] = """
SELECT src_namespace, src_workload_name, dst_workload_name, protocol, dst_ip, max(request_id) AS last_id,
       CAST(max(request_total_time) AS BIGINT) AS duration
FROM v_records WHERE NOT is_server AND is_slow GROUP BY 1, 2, 3, 4, 5
"""
VIEWS["v_entity_series"] = """
SELECT namespace, workload_name, protocol, response_content, day,
       CAST(sum(n) OVER (PARTITION BY namespace, workload_name, protocol, response_content ORDER BY day) AS BIGINT) AS total,
       CAST(sum(d) OVER (PARTITION BY namespace, workload_name, protocol, response_content ORDER BY day) AS BIGINT) AS duration
FROM (SELECT dst_namespace AS namespace, dst_workload_name AS workload_name, protocol, CAST(status_code AS VARCHAR(9)) AS response_content,
        CAST(floor(ts_ns / 86400000000000) AS BIGINT) AS day, count(*) AS n, sum(request_total_time) AS d
      FROM v_records WHERE is_server GROUP BY 1, 2, 3, 4, 5) t
"""

# Attempts to connect: five kernel events per order, derived by line.
VIEWS["v_connects"] = """
SELECT o_orderkey * 4 + step AS seq,
       EPOCH_US(o_orderdate) * 1000 + (o_orderkey % 86400) * 1000000000 + step * 1000000 AS ts_ns,
       CASE WHEN step = 0 THEN 'tcp_connect' WHEN step = 1 THEN 'connect'
            WHEN step = 2 AND o_orderkey % 5 = 1 THEN 'sendto' ELSE 'tcp_set_state' END AS name,
       concat('10.1.', CAST(floor(o_custkey / 256) AS INT), '.', o_custkey % 256) AS src_ip,
       CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE 1024 + o_orderkey % 60000 END AS src_port,
       concat('10.2.0.', o_orderkey % 250) AS dst_ip, 8000 + o_orderkey % 100 AS dst_port,
       CASE WHEN step = 0 THEN CASE WHEN o_orderkey % 11 = 0 THEN 99 ELSE 0 END
            WHEN step = 1 THEN CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN -115 WHEN 2 THEN -111 ELSE -4 END
            ELSE 0 END AS ret,
       CASE WHEN step = 2 THEN 2 WHEN step = 3 THEN 1 ELSE 0 END AS old_state,
       CASE WHEN step = 2 THEN 1 WHEN step = 3 THEN 8 ELSE 0 END AS new_state,
       CASE WHEN step = 1 THEN o_custkey ELSE 0 END AS pid
FROM (SELECT *, UNNEST(0, 1, 2, 3) AS step FROM orders) o WHERE step <> 2 OR o_orderkey % 7 <> 0
"""


# Where Spark joins in another order than the text says: the same rows, of which fewer move. Customers meet the orders and
# not every line of theirs.
_SPARK_JOINS = {"v_requests": ("""FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation cn ON c_nationkey = cn.n_nationkey
JOIN region cr ON cn.n_regionkey = cr.r_regionkey
""", """FROM lineitem
JOIN (orders JOIN customer ON o_custkey = c_custkey
      JOIN nation cn ON c_nationkey = cn.n_nationkey
      JOIN region cr ON cn.n_regionkey = cr.r_regionkey) ON l_orderkey = o_orderkey
""")}


def _spark_text(view: str) -> str:
    """The text of a view with its joins in Spark's order."""
    return VIEWS[view].replace(*_SPARK_JOINS[view]) if view in _SPARK_JOINS else VIEWS[view]


def _names(sql: str) -> set[str]:
    return set(re.findall(r"\bv_\w+\b", sql)) & VIEWS.keys()


def _closure(names: set[str]) -> list[str]:
    need, todo = set(), list(names)
    while todo:
        name = todo.pop()
        if name not in need:
            need.add(name)
            todo.extend(_names(VIEWS[name]))
    return [v for v in VIEWS if v in need]


def duck_sql(body: str) -> str:
    """Put the views a DuckDB text uses in front of it as common table expressions."""
    views = _closure(_names(body))
    ctes = [f"{v} AS ({VIEWS[v].strip()})" for v in views]
    stripped = body.strip()
    if not ctes:
        text = stripped
    elif stripped[:5].upper() == "WITH ":
        text = "WITH " + ",\n".join(ctes) + ",\n" + stripped[5:]
    else:
        text = "WITH " + ",\n".join(ctes) + "\n" + stripped
    return re.sub(r"\bUNNEST\(([^()]*)\)", r"unnest([\1])", re.sub(r"\bEPOCH_US\(", "epoch_us(", text))


class Env:
    """Tables and views of one data folder as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = pin_session(spark)
        self.sf_dir = sf_dir.rstrip("/")
        dealt = spark.conf.get(PARTITIONS, None)
        self.partitions = int(dealt) if dealt else None
        self._frames: dict[str, DataFrame] = {}

    def path(self, table: str) -> str:
        return f"{self.sf_dir}/{table}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self._frame(name, lambda: scan_table(self.spark, self.path(name), self.partitions))
        if name in VIEWS:
            return self._frame(name, lambda: self.sql(_spark_text(name)))
        raise AttributeError(name)

    def _frame(self, name, make):
        if name not in self._frames:
            self._frames[name] = make()
        return self._frames[name]

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Run SQL whose FROM/JOIN names are tables, views or the given frames."""
        text = re.sub(r"\bEPOCH_US\((\w+)\)", r"unix_micros(CAST(\1 AS TIMESTAMP))", text)
        text = re.sub(r"\bUNNEST\(([^()]*)\)", r"explode(array(\1))", text)
        used = dict(frames)

        def swap(match):
            name = match.group(2)
            if name not in used and (name in TABLES or name in VIEWS):
                used[name] = getattr(self, name)
            return f"{match.group(1)}{{{name}}}" if name in used else match.group(0)

        text = re.sub(r"(?i)\b((?:FROM|JOIN)\s+\(?)(\w+)", swap, text)
        return self.spark.sql(text, **used)
