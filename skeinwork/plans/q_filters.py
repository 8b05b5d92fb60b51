"""Queries for filters, routing, classification and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwork import constants as C
from skeinwork.functions import payload, text
from skeinwork.functions.registry import url_method
from skeinwork.operators import aggregate, events, relabel
from skeinwork.plans.catalog import query

_REQ_KEYS = "request_id, ts_ns, request_total_time, dst_pod"


@query("subscribe_filter", """
SELECT seq, pid, name FROM v_socket_events
WHERE name IN ('read', 'write', 'recvfrom', 'sendto') AND k % 4 <> 0 OR name = 'connect'""")
def subscribe_filter(env):
    ev = env.v_socket_events.withColumn("category", F.when(F.col("k") % 4 != 0, "net").otherwise("file"))
    return events.subscribe_filter(ev).select("seq", "pid", "name")


@query("suppress_comm", "SELECT seq, pid FROM v_socket_events WHERE k % 5 NOT IN (0, 3)")
def suppress_comm(env):
    comm = F.when(F.col("k") % 5 == 0, "containerd").when(F.col("k") % 5 == 3, "dockerd").otherwise("app")
    return events.suppress_comm(env.v_socket_events.withColumn("comm", comm)).select("seq", "pid")


@query("route_events", """
SELECT seq, name, r.family FROM v_socket_events JOIN (VALUES ('read', 'network'), ('write', 'network'),
  ('recvfrom', 'network'), ('sendto', 'network'), ('write', 'tcp_connect'), ('sendto', 'tcp_connect'),
  ('connect', 'tcp_connect')) r(n, family) ON name = r.n""")
def route_events(env):
    return events.route_events(env.v_socket_events).select("seq", "name", "family")


@query("net_gate", "SELECT seq, pid, res FROM v_socket_events WHERE res > 0 AND k % 9 <> 0")
def net_gate(env):
    ev = env.v_socket_events.withColumns({
        "category": F.lit("net"), "l4": F.when(F.col("k") % 9 == 0, "udp").otherwise("tcp"), "data_len": F.col("res")})
    return events.net_gate(ev).select("seq", "pid", "res")


@query("udp_dns_gate", "SELECT seq, dport FROM v_socket_events WHERE k % 2 = 0 OR dport = 53")
def udp_dns_gate(env):
    ev = env.v_socket_events.withColumn("l4", F.when(F.col("k") % 2 == 0, "tcp").otherwise("udp"))
    return events.udp_dns_gate(ev).select("seq", "dport")


@query("is_request", """
SELECT seq, CASE WHEN name IN ('read', 'recvfrom') THEN is_server_fd WHEN name IN ('write', 'sendto')
  THEN NOT is_server_fd END AS is_request FROM v_socket_events WHERE name <> 'connect'""")
def is_request(env):
    ev = env.v_socket_events.withColumn("is_request", events.is_request(F.col("name"), F.col("is_server_fd")))
    return ev.where(F.col("is_request").isNotNull()).select("seq", "is_request")


@query("typed_attr", """
SELECT seq, k - 50 AS i32, CAST(k + 200 AS BIGINT) AS u16, ts_ns AS u64, CAST(0 AS BIGINT) AS missing FROM v_socket_events""")
def typed_attr(env):
    def le(col, width):
        h = F.lpad(F.right(F.hex(col), F.lit(2 * width)), 2 * width, "0")
        return F.unhex(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(width))]))
    attrs = F.create_map(F.lit("i32"), le((F.col("k") - 50).cast("long"), 4), F.lit("u16"), le((F.col("k") + 200).cast("long"), 2),
                         F.lit("u64"), le(F.col("ts_ns"), 8))
    ev = env.v_socket_events.withColumn("attrs", attrs)
    a = F.col("attrs")
    return ev.select("seq", payload.typed_attr(a, "i32", 4, True).cast("int").alias("i32"),
                     payload.typed_attr(a, "u16", 2, False).alias("u16"), payload.typed_attr(a, "u64", 8, False).alias("u64"),
                     payload.typed_attr(a, "none", 4, False).alias("missing"))


@query("ipv4_text", """
SELECT seq, concat(pid % 256, '.', tid % 256, '.', fd, '.', k) AS ip FROM v_socket_events""")
def ipv4_text(env):
    packed = (F.col("pid") % 256 + (F.col("tid") % 256) * 256 + F.col("fd").cast("long") * 65536
              + F.col("k").cast("long") * 16777216)
    return env.v_socket_events.select("seq", text.ipv4_text(packed).alias("ip"))


@query("explode_multimsg", """
SELECT conv_id, turn, part, CAST(length(data) AS BIGINT) AS res, data FROM (
  SELECT conv_id, turn, 0 AS part, concat('m', turn) AS data FROM conversations
  UNION ALL SELECT conv_id, turn, 1, concat(role, '/', conv_id) FROM conversations
  UNION ALL SELECT conv_id, turn, 2, 'cut' FROM conversations) t""")
def explode_multimsg(env):
    ev = _multi_messages(env)
    return events.explode_multimsg(ev).select("conv_id", "turn", "part", "res", F.decode("data", "UTF-8").alias("data"))


def _multi_messages(env):
    """Sends of three messages; the last one announces more bytes than are there."""
    def framed(body, size=None):
        size = F.octet_length(body) if size is None else size
        h = F.lpad(F.hex(size.cast("long")), 8, "0")
        return F.concat(F.unhex(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in (3, 2, 1, 0)])), body)
    a = F.concat(F.lit("m"), F.col("turn").cast("string")).cast("binary")
    b = F.concat("role", F.lit("/"), F.col("conv_id").cast("string")).cast("binary")
    c = F.lit("cut").cast("binary")
    return env.conversations.select("conv_id", "turn", F.lit("sendmmsg").alias("name"), F.lit(0).cast("long").alias("res"),
                                    F.concat(framed(a), framed(b), framed(c, F.lit(40))).alias("data"))


@query("udtf_multimsg", """
SELECT pid, CAST(count(*) AS BIGINT) AS messages, CAST(sum(length(data)) AS BIGINT) AS bytes FROM (
  SELECT conv_id AS pid, concat('m', turn) AS data FROM conversations
  UNION ALL SELECT conv_id, concat(role, '/', conv_id) FROM conversations
  UNION ALL SELECT conv_id, 'cut' FROM conversations) t GROUP BY pid""")
def udtf_multimsg(env):
    from skeinwork.functions.udtf import SplitMessages
    env.spark.udtf.register("split_messages", SplitMessages)
    parts = env.spark.sql("SELECT id AS pid, res FROM split_messages(TABLE(SELECT conv_id AS id, data FROM {m}))", m=_multi_messages(env))
    return parts.groupBy("pid").agg(F.count("*").alias("messages"), F.sum("res").cast("long").alias("bytes"))


# Bytes outside printable ASCII as dots, one per byte; the longest text of whole characters within some bytes.
_ASCII = "array_to_string(list_transform(string_split(data, ''), lambda c: CASE WHEN c BETWEEN ' ' AND '~' AND strlen(c) = 1 THEN c ELSE repeat('.', strlen(c)) END), '')"


def _utf8_sql(col, limit):
    return f"coalesce({', '.join(f'TRY(decode(encode({col})[1:{limit - k}]))' for k in range(4))})"


@query("payload_preview", f"""
SELECT pid, seq, left({_ASCII}, 200) AS preview, substr({_ASCII}, 17, 200) AS dubbo_preview, {_utf8_sql("data", 200)} AS http_preview FROM v_messages""")
def payload_preview(env):
    made = [payload.payload_preview("data", F.lit(p)).alias(n) for p, n in (("mysql", "preview"), ("dubbo", "dubbo_preview"), ("http", "http_preview"))]
    return env.v_messages.select("pid", "seq", *made)


@query("static_port_protocol", """
SELECT seq, dport, CASE WHEN dport = 53 THEN 'dns' END AS protocol FROM v_socket_events""")
def static_port_protocol(env):
    return events.static_port_protocol(env.v_socket_events, "dport").select("seq", "dport", "protocol")


@query("discern_protocol", """
SELECT doc_id, CASE WHEN starts_with(text, 'GET ') OR starts_with(text, 'POST ') THEN 'http'
  WHEN regexp_matches(lower(text), '^(select|insert|update|delete|drop|create|alter|set|commit)') THEN 'mysql'
  WHEN regexp_matches(text, '^[*$:]') THEN 'redis' ELSE 'NOSUPPORT' END AS protocol FROM documents""")
def discern_protocol(env):
    t = F.col("text")
    verbs = "|".join(v for v, _ in C.SQL_VERBS)
    hits = {"http": t.startswith("GET ") | t.startswith("POST "), "mysql": F.lower(t).rlike(f"^({verbs})"),
            "redis": t.rlike("^[*$:]")}
    return env.documents.select("doc_id", events.discern_protocol(hits).alias("protocol"))


@query("learn_port_protocol", """
SELECT dport, protocol, n, CAST(row_number() OVER (PARTITION BY dport ORDER BY n DESC, protocol) AS INT) AS priority FROM (
  SELECT dst_port AS dport, protocol, count(*) AS n FROM v_requests GROUP BY 1, 2) c WHERE n >= 50""")
def learn_port_protocol(env):
    return events.learn_port_protocol(env.v_requests.select(F.col("dst_port").alias("dport"), "protocol"))


@query("slow_flag", """
SELECT request_id, dst_pod, request_total_time, request_total_time >= CASE WHEN protocol IN ('mysql', 'kafka', 'redis', 'dns')
  THEN 100000000 ELSE 500000000 END AS is_slow FROM v_requests""")
def slow_flag(env):
    return env.v_requests.select("request_id", "dst_pod", "request_total_time", events.slow_flag(
        F.col("request_total_time"), F.col("protocol")).alias("is_slow"))


@query("error_class", """
SELECT request_id, dst_pod, request_total_time, CAST(CASE WHEN request_id % 17 = 0 THEN 1
  WHEN (protocol = 'http' AND status_code >= 400) OR (protocol = 'dns' AND status_code > 0 AND status_code <> 3)
    OR (protocol = 'mysql' AND status_code <> 0) OR (protocol = 'dubbo' AND status_code > 20) THEN 3
  WHEN request_id % 13 = 0 THEN 2 ELSE 0 END AS INT) AS error_type FROM v_requests""")
def error_class(env):
    failed = events.protocol_error(F.col("protocol"), F.col("status_code"), ignore_rcode3=True)
    kind = events.error_class(F.col("request_id") % 17 != 0, F.col("request_id") % 13 != 0, failed)
    return env.v_requests.select("request_id", "dst_pod", "request_total_time", kind.alias("error_type"))


@query("status_band", """
SELECT request_id, dst_pod, request_total_time,
  CASE WHEN request_total_time <= 800000000 THEN '1' WHEN request_total_time >= 1500000000 THEN '3' ELSE '2' END AS total_status,
  CASE WHEN request_total_time <= 200000000 THEN '1' WHEN request_total_time >= 1000000000 THEN '3' ELSE '2' END AS phase_status
FROM v_requests""")
def status_band(env):
    t = F.col("request_total_time")
    return env.v_requests.select("request_id", "dst_pod", "request_total_time",
                                 events.status_band(t, 800, 1500).alias("total_status"),
                                 events.status_band(t, 200, 1000).alias("phase_status"))


@query("abnormal_filter", f"SELECT {_REQ_KEYS} FROM v_records WHERE is_slow OR is_error OR error_type > 0")
def abnormal_filter(env):
    r = env.v_records.where(events.abnormal(F.col("is_slow"), F.col("is_error"), F.col("error_type")))
    return r.select("request_id", "ts_ns", "request_total_time", "dst_pod")


@query("sample_records", f"SELECT {_REQ_KEYS} FROM v_records WHERE is_slow OR is_error")
def sample_records(env):
    r = events.sample_records(env.v_records, F.col("request_id"))
    return r.select("request_id", "ts_ns", "request_total_time", "dst_pod")


@query("select_labels", """
SELECT protocol, is_server, dst_port, dst_service, '' AS comm, CAST(0 AS BIGINT) AS pid, false AS success FROM v_records""")
def select_labels(env):
    return relabel.select_labels(env.v_records, ["protocol", "is_server", "dst_port", "dst_service", "comm", "pid", "success"])


@query("prune_ports", """
SELECT seq, src_port0, dst_port0,
  CASE WHEN src_port0 < 32768 AND dst_port0 < 32768 THEN CASE WHEN src_port0 > dst_port0 THEN NULL ELSE src_port0 END
       WHEN src_port0 >= 32768 THEN NULL ELSE src_port0 END AS src_port,
  CASE WHEN src_port0 < 32768 AND dst_port0 < 32768 THEN CASE WHEN src_port0 > dst_port0 THEN dst_port0 ELSE NULL END
       WHEN dst_port0 >= 32768 THEN NULL ELSE dst_port0 END AS dst_port
FROM (SELECT seq, 1000 * (k % 60) AS src_port0, 900 * (k % 7) * (k % 13) AS dst_port0 FROM v_socket_events) t""")
def prune_ports(env):
    k = F.col("k")
    ev = env.v_socket_events.select("seq", (1000 * (k % 60)).alias("src_port0"), (900 * (k % 7) * (k % 13)).alias("dst_port0"))
    ev = ev.withColumns({"src_port": F.col("src_port0"), "dst_port": F.col("dst_port0")})
    return relabel.prune_ports(ev)


@query("apply_dnat", """
SELECT request_id, ts_ns, request_total_time,
  CASE WHEN dnat_ip <> '' THEN dnat_ip ELSE dst_ip END AS dst_ip, CASE WHEN dnat_port > 0 THEN dnat_port ELSE dst_port END AS dst_port,
  CASE WHEN dnat_ip <> '' AND dnat_port >= 1 THEN dnat_ip ELSE dst_ip END AS detail_ip,
  CASE WHEN dnat_ip <> '' AND dnat_port >= 1 THEN dnat_port ELSE dst_port END AS detail_port FROM v_records""")
def apply_dnat(env):
    r = env.v_records.select("request_id", "ts_ns", "request_total_time", "dst_ip", "dst_port", "dnat_ip", "dnat_port")
    detail = relabel.apply_dnat(r.withColumns({"tcp_ip": F.col("dst_ip"), "tcp_port": F.col("dst_port")}), "detail")
    swapped = detail.withColumnsRenamed({"dst_ip": "detail_ip", "dst_port": "detail_port", "tcp_ip": "dst_ip", "tcp_port": "dst_port"})
    return relabel.apply_dnat(swapped)


@query("hide_dst_pod", """
SELECT request_id, ts_ns, dst_namespace, CASE WHEN dst_namespace LIKE 'NOT_FOUND%' THEN dst_pod ELSE '' END AS dst_pod,
  CASE WHEN dst_namespace LIKE 'NOT_FOUND%' THEN dst_node ELSE '' END AS dst_node FROM v_records""")
def hide_dst_pod(env):
    return relabel.hide_dst_pod(env.v_records).select("request_id", "ts_ns", "dst_namespace", "dst_pod", "dst_node")


_RESPONSE = """CASE protocol WHEN 'http' THEN CAST(http_status_code AS VARCHAR) WHEN 'mysql' THEN CAST(sql_error_code AS VARCHAR)
  WHEN 'dns' THEN CAST(dns_rcode AS VARCHAR) WHEN 'dubbo' THEN CAST(dubbo_error_code AS VARCHAR)
  WHEN 'redis' THEN {redis} ELSE '' END"""
ENTITY_SQL = f"""
SELECT request_id, ts_ns, is_slow, request_total_time, request_io, response_io, dst_namespace AS namespace,
  dst_workload_kind AS workload_kind, dst_workload_name AS workload_name, dst_service AS service, protocol,
  CASE protocol WHEN 'kafka' THEN kafka_topic WHEN 'dns' THEN dns_domain ELSE content_key END AS request_content,
  {_RESPONSE.format(redis="CASE WHEN error_type = 3 THEN 'error' ELSE 'noerror' END")} AS response_content
FROM v_records WHERE is_server"""
TOPOLOGY_SQL = f"""
SELECT request_id, ts_ns, is_slow, request_total_time, request_io, response_io, src_namespace, src_workload_kind,
  src_workload_name, '' AS src_service, dst_namespace, dst_workload_kind, dst_workload_name, dst_service,
  CASE WHEN dst_namespace LIKE 'NOT_FOUND%' THEN dst_node ELSE '' END AS dst_node,
  CASE WHEN dst_namespace LIKE 'NOT_FOUND%' THEN dst_pod ELSE '' END AS dst_pod, protocol,
  {_RESPONSE.format(redis="CASE WHEN error_type = 3 THEN '1' ELSE '0' END")} AS status_code
FROM v_records WHERE NOT is_server"""
TOPO_LABELS = ("src_namespace, src_workload_kind, src_workload_name, src_service, dst_namespace, dst_workload_kind, "
               "dst_workload_name, dst_service, dst_node, dst_pod, protocol, status_code")
ENTITY_LABELS = "namespace, workload_kind, workload_name, service, protocol, request_content, response_content"


@query("relabel_entity", f"SELECT request_id, ts_ns, {ENTITY_LABELS} FROM ({ENTITY_SQL}) e")
def relabel_entity(env):
    return relabel.relabel_entity(env.v_records.where("is_server"), keep=["request_id", "ts_ns"])


@query("relabel_topology", f"SELECT request_id, ts_ns, {TOPO_LABELS} FROM ({TOPOLOGY_SQL}) e")
def relabel_topology(env):
    return relabel.relabel_topology(env.v_records.where("NOT is_server"), keep=["request_id", "ts_ns"])


@query("const_labels", """
SELECT request_id, ts_ns, 'eu' AS region, 'prod' AS cluster FROM v_requests""")
def const_labels(env):
    return relabel.const_labels(env.v_requests.select("request_id", "ts_ns"), {"region": "eu", "cluster": "prod"})


@query("metric_names", """
SELECT is_server, m AS metric, CASE WHEN is_server THEN concat('entity_request_', CASE m WHEN 'request_io' THEN 'receive_bytes_total'
   WHEN 'response_io' THEN 'send_bytes_total' ELSE 'duration_nanoseconds_total' END)
  ELSE concat('topology_request_', CASE m WHEN 'request_io' THEN 'request_bytes_total' WHEN 'response_io' THEN 'response_bytes_total'
   ELSE 'duration_nanoseconds_total' END) END AS name,
  CAST(sum(CASE m WHEN 'request_io' THEN request_io WHEN 'response_io' THEN response_io ELSE request_total_time END) AS BIGINT) AS total
FROM v_requests, (VALUES ('request_io'), ('response_io'), ('request_total_time')) t(m) GROUP BY 1, 2, 3""")
def metric_names(env):
    long = env.v_requests.select("is_server", "request_io", "response_io", "request_total_time").unpivot(
        ["is_server"], ["request_io", "response_io", "request_total_time"], "metric", "value")
    return (long.withColumn("name", relabel.metric_names(F.col("metric"), F.col("is_server")))
            .groupBy("is_server", "metric", "name").agg(F.sum("value").cast("long").alias("total")))


@query("sanitize_names", """
SELECT p_partkey, CASE WHEN starts_with(s2, '_') THEN concat('key', s2) ELSE s2 END AS label, CASE WHEN starts_with(s2, '__') THEN concat('key', s2) ELSE s2 END AS metric
FROM (SELECT p_partkey, CASE WHEN regexp_matches(s, '^[0-9]') THEN concat('key_', s) ELSE s END AS s2 FROM (
  SELECT p_partkey, regexp_replace(concat(CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '#' WHEN 2 THEN '--' ELSE '7' END, p_type), '[^A-Za-z0-9]', '_', 'g') AS s
  FROM part) a) b""")
def sanitize_names(env):
    k = F.col("p_partkey") % 4
    raw = F.concat(F.when(k == 0, "").when(k == 1, "#").when(k == 2, "--").otherwise("7"), F.col("p_type"))
    return env.part.select("p_partkey", text.sanitize_name(raw).alias("label"), text.sanitize_name(raw, True).alias("metric"))


@query("register_url_method", """
SELECT page_id, split_part(trim(url), '?', 1) AS noparam, '' AS blank, upper(path) AS custom FROM v_urls""")
def register_url_method(env):
    from skeinwork.functions.registry import register_url_method as register
    register("upper", F.upper)
    return env.v_urls.select("page_id", url_method("noparam")(F.col("url")).alias("noparam"),
                             url_method("blank")(F.col("url")).alias("blank"), url_method("upper")(F.col("path")).alias("custom"))


@query("register_agg_kind", """
SELECT protocol, CAST(min(request_io) AS BIGINT) AS smallest, CAST(sum(request_io) AS BIGINT) AS unknown_kind FROM v_requests GROUP BY protocol""")
def register_agg_kind(env):
    from skeinwork.functions.registry import register_agg_kind as register
    register("min", lambda value, order=None: F.min(value).cast("long"))
    return aggregate.agg_config(env.v_requests, ["protocol"], {"request_io": [("min", "smallest"), ("no_such", "unknown_kind")]})


@query("url_alphabet", """
SELECT page_id, array_to_string(list_transform(string_split(split_part(replace(path, ' ', ''), '?', 1), '/'),
  lambda s: CASE WHEN regexp_matches(s, '^[A-Za-z_-]{0,25}$') THEN s ELSE '*' END), '/') AS content_key FROM v_urls""")
def url_alphabet(env):
    return env.v_urls.select("page_id", text.url_alphabet("path").alias("content_key"))


@query("url_noparam", "SELECT page_id, split_part(trim(url), '?', 1) AS content_key FROM v_urls")
def url_noparam(env):
    return env.v_urls.select("page_id", text.url_noparam("url").alias("content_key"))


@query("url_blank", "SELECT page_id, '' AS content_key FROM v_urls")
def url_blank(env):
    return env.v_urls.select("page_id", text.url_blank("url").alias("content_key"))


_SQL_TEXT = """CASE o_orderkey % 8 WHEN 0 THEN concat('select * from ', lower(o_orderpriority), ' where id = ', o_orderkey)
  WHEN 1 THEN concat('INSERT INTO Orders', ' (a) values (', o_custkey, ')') WHEN 2 THEN concat('update  tab_', o_orderstatus, ' set x = 1')
  WHEN 3 THEN concat(' DELETE from t', o_custkey, ' where 1') WHEN 4 THEN 'CREATE DATABASE dbname;' WHEN 5 THEN 'SET autocommit=0'
  WHEN 6 THEN 'commit' ELSE concat(o_orderpriority, ' from x') END"""


def _digest_sql(col):
    flat = f"trim(regexp_replace({col}, '\\s+', ' ', 'g'))"
    words = f"string_split({flat}, ' ')"
    out = "''"
    for verb, word in reversed(C.SQL_VERBS):
        listed = ", ".join(f"'{w}'" for w in word.split("|"))
        at = f"list_position(list_transform({words}, lambda w: lower(w) IN ({listed})), true)"
        obj = f"coalesce({words}[{at} + 1], '')"
        out = (f"CASE WHEN starts_with(lower({flat}), '{verb}') THEN CASE WHEN {at} > 0 AND {obj} <> '' AND NOT regexp_matches({obj}, '[^-_[:alpha:]]') "
               f"THEN concat('{verb} ', {obj}, ' *') ELSE '{verb} *' END ELSE {out} END")
    return out


@query("sql_digest", f"SELECT o_orderkey, {_digest_sql('q')} AS digest FROM (SELECT o_orderkey, {_SQL_TEXT} AS q FROM orders) t")
def sql_digest(env):
    q = env.sql(f"SELECT o_orderkey, {_SQL_TEXT} AS q FROM orders")
    return q.select("o_orderkey", text.sql_digest("q").alias("digest"))


@query("trace_header", """
SELECT doc_id, CASE m WHEN 0 THEN 'skywalking' WHEN 1 THEN 'jaeger' WHEN 2 THEN 'w3c' WHEN 3 THEN 'zipkin' ELSE '' END AS trace_type,
  CASE m WHEN 0 THEN concat('t', doc_id) WHEN 1 THEN h WHEN 2 THEN h WHEN 3 THEN h ELSE '' END AS trace_id
FROM (SELECT doc_id, CAST(doc_id % 5 AS INT) AS m, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents) t""")
def trace_header(env):
    h = F.md5(F.col("doc_id").cast("string"))
    sw8 = F.concat(F.lit("1-"), F.base64(F.concat(F.lit("t"), F.col("doc_id").cast("string")).cast("binary")), F.lit("-x"))
    headers = (F.when(F.col("doc_id") % 5 == 0, F.create_map(F.lit("sw8"), sw8, F.lit("x-b3-traceid"), h))
               .when(F.col("doc_id") % 5 == 1, F.create_map(F.lit("uber-trace-id"), F.concat(h, F.lit(":1:0:1"))))
               .when(F.col("doc_id") % 5 == 2, F.create_map(F.lit("traceparent"), F.concat(F.lit("00-"), h, F.lit("-00f0-01"))))
               .when(F.col("doc_id") % 5 == 3, F.create_map(F.lit("x-b3-traceid"), h))
               .otherwise(F.create_map(F.lit("traceparent"), F.lit("short"))))
    return env.documents.select("doc_id", text.trace_header(headers).alias("t")).select("doc_id", "t.*")


@query("short_container_id", """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE substr(concat(md5(c_name), '://x'), 1, 12) END AS container_id FROM customer""")
def short_container_id(env):
    raw = F.concat(F.when(F.col("c_custkey") % 4 == 0, "docker:").otherwise("docker://"), F.md5("c_name"))
    return env.customer.select("c_custkey", text.short_container_id(raw).alias("container_id"))


@query("workload_kind", """
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'deployment' WHEN 1 THEN 'statefulset' WHEN 2 THEN 'job' ELSE 'example.com/v1/rollout' END AS kind FROM supplier""")
def workload_kind(env):
    k = F.col("s_suppkey") % 4
    api = F.when(k == 0, "apps/v1").when(k == 1, "").when(k == 2, "batch/v1").otherwise("example.com/v1")
    kind = F.when(k == 0, "Deployment").when(k == 1, "StatefulSet").when(k == 2, "Job").otherwise("Rollout")
    return env.supplier.select("s_suppkey", text.workload_kind(api, kind).alias("kind"))


@query("label_replace", """
SELECT event_id, CASE WHEN k LIKE '1%' THEN 'FormatErr' WHEN k LIKE '2%' THEN 'ServFail' WHEN k LIKE '3%' THEN 'NXDomain'
  WHEN k LIKE '4%' THEN 'NotImp' WHEN k LIKE '5%' THEN 'Refused' ELSE k END AS status_code
FROM (SELECT event_id, regexp_extract(props, '([0-9]+)', 1) AS k FROM events) t""")
def label_replace(env):
    k = F.regexp_extract("props", "([0-9]+)", 1)
    return env.events.select("event_id", text.dns_code_name(k).alias("status_code"))


def _duration_sql():
    def t(d, u):
        x = f"(CAST(a AS DOUBLE) / {float(d)})"
        return f"concat(printf('%.2f', CASE WHEN ({x} * 8.0) % 2.0 = 1.0 THEN {x} + 0.001 ELSE {x} END), '{u}')"
    return (f"concat(CASE WHEN t < 0 THEN '-' ELSE '' END, CASE WHEN a > 3600000000000 THEN {t(3600000000000, 'h')} "
            f"WHEN a >= 60000000000 THEN {t(60000000000, 'm')} WHEN a >= 1000000000 THEN {t(1000000000, 's')} "
            f"WHEN a >= 1000000 THEN {t(1000000, 'ms')} WHEN a > 1000 THEN {t(1000, 'μs')} ELSE {t(1, 'ns')} END)")


@query("format_duration", f"""
SELECT request_id, request_total_time, t, {_duration_sql()} AS text FROM (SELECT request_id, request_total_time, t, abs(t) AS a FROM (
  SELECT request_id, request_total_time, CASE request_id % 6 WHEN 0 THEN request_total_time WHEN 1 THEN -request_total_time
    WHEN 2 THEN request_total_time * 100000 WHEN 3 THEN request_io WHEN 4 THEN response_io ELSE request_total_time * 3000 END AS t
  FROM v_requests) x) y""")
def format_duration(env):
    r = env.sql("""SELECT request_id, request_total_time, CASE request_id % 6 WHEN 0 THEN request_total_time WHEN 1 THEN -request_total_time
      WHEN 2 THEN request_total_time * 100000 WHEN 3 THEN request_io WHEN 4 THEN response_io ELSE request_total_time * 3000 END AS t
      FROM v_requests""")
    return r.withColumn("text", text.format_duration("t"))


@query("clip_interval", """
SELECT seq, greatest(start_ns, lo) AS clip_start, least(end_ns, hi) AS clip_end,
  end_ns - start_ns - greatest(lo - start_ns, 0) - greatest(end_ns - hi, 0) AS clip_ns
FROM (SELECT seq, start_ns, end_ns, (start_s + 1) * 1000000000 AS lo, (start_s + 11) * 1000000000 AS hi FROM v_segments) t
WHERE end_ns > lo AND start_ns < hi""")
def clip_interval(env):
    s = env.v_segments.withColumns({"lo": (F.col("start_s") + 1) * 1000000000, "hi": (F.col("start_s") + 11) * 1000000000})
    a, b, lo, hi = F.col("start_ns"), F.col("end_ns"), F.col("lo"), F.col("hi")
    c = text.clip_interval(a, b, b - a, lo, hi)
    return s.where(text.overlaps(a, b, lo, hi)).select("seq", c["start"].alias("clip_start"), c["end"].alias("clip_end"),
                                                      c["duration"].alias("clip_ns"))


@query("parse_event_info", """
SELECT seq, n, CASE n WHEN 0 THEN 'net' WHEN 1 THEN 'file' WHEN 2 THEN 'futex' ELSE 'epoll' END AS type,
  CASE n WHEN 0 THEN name WHEN 1 THEN 'read' WHEN 3 THEN 'wait' END AS operate, CASE n WHEN 0 THEN concat('s', sport, '->', dport)
  WHEN 1 THEN concat('/f', fd) WHEN 3 THEN 'e' END AS file, CASE WHEN n < 2 THEN start_ns END AS start_ns, CASE WHEN n < 2 THEN latency_ns END AS duration_ns,
  CASE n WHEN 0 THEN '1' END AS request_type, CASE n WHEN 0 THEN CAST(res AS VARCHAR) WHEN 1 THEN '64' WHEN 3 THEN '3' END AS size,
  CASE n WHEN 2 THEN '0xff' END AS address
FROM (SELECT seq, ts_ns AS start_ns, latency_ns, res, name, sport, dport, fd FROM v_socket_events) e, (VALUES (0), (1), (2), (3)) t(n)""")
def parse_event_info(env):
    s = env.v_socket_events
    at = F.lit("@")
    t = lambda c: F.col(c).cast("string")
    info = F.concat(F.lit("net@"), F.col("name"), F.lit("@s"), t("sport"), F.lit("->"), t("dport"), at, t("ts_ns"), at, t("latency_ns"),
                    F.lit("@1@"), t("res"), F.lit("#file@read@/f"), t("fd"), at, t("ts_ns"), at, t("latency_ns"), F.lit("@64#futex@0xff#epoll@wait@e@3@9"))
    return (s.select("seq", F.posexplode(text.info_parts(info)).alias("n", "p"))
            .select("seq", "n", "p.type", "p.operate", "p.file", "p.start_ns", "p.duration_ns", "p.request_type", "p.size", "p.address"))


@query("parse_lock", """
SELECT seq, concat('0x', k) AS address, 'MonitorEnter' AS type, CASE WHEN k % 3 = 0 THEN '' ELSE CAST(tid AS VARCHAR) END AS waiter,
  CASE WHEN k % 2 = 0 THEN concat('stack', fd) ELSE 'before' END AS stack FROM v_socket_events""")
def parse_lock(env):
    return env.v_socket_events.select("seq", text.parse_lock(_lock_line()).alias("l")).select("seq", "l.*")


def _lock_line():
    k = F.col("k")
    waiter = F.when(k % 3 == 0, "-1").otherwise(F.col("tid").cast("string"))
    tail = F.when(k % 2 == 0, F.concat(F.lit("stack"), F.col("fd").cast("string"), F.lit("\n"))).otherwise("\n")
    return F.concat(F.lit("a!b!c!0x"), k.cast("string"), F.lit("!MonitorEnter!f!g!"), waiter, F.lit("!before!"), tail)


@query("parse_stack", """
SELECT seq, d AS depth, fd + d AS index, 10 - d AS width, k % 5 AS colour, CASE d WHEN 0 THEN 'main' ELSE 'run' END AS name
FROM v_socket_events, (VALUES (0), (1)) t(d)""")
def parse_stack(env):
    t = lambda c: c.cast("string")
    frames = F.concat_ws("#", *[F.concat_ws("-", F.lit(str(d)), t(F.col("fd") + d), F.lit(str(10 - d)), t(F.col("k") % 5), F.lit(str(d)))
                                for d in (0, 1)])
    stack = F.concat(F.lit("main#run||"), frames)
    return env.v_socket_events.select("seq", F.inline(text.parse_stack(stack, F.lit(1))))


@query("trace_path", """
SELECT request_id, ts_ns, CASE WHEN is_server THEN dst_workload_name ELSE src_workload_name END AS workload,
  CASE WHEN is_server THEN dst_pod ELSE src_pod END AS pod, 'NoContainerName' AS container FROM v_records""")
def trace_path(env):
    r = env.v_records
    p = text.trace_path(F.col("is_server"), lambda n: relabel.label(r, n))
    return r.select("request_id", "ts_ns", *[v.alias(k) for k, v in p.items()])
