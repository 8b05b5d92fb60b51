"""Queries for cluster metadata and translations."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwork.operators import metadata
from skeinwork.plans.catalog import query
from skeinwork.session import stage

LOCAL_NODE, LOCAL_IP = "node-1", "10.9.0.1"


def cluster(env) -> metadata.Cluster:
    p = stage(env.v_pod_info, "pods")
    by_port = p.withColumn("container_id", F.lit(""))
    host = by_port.where("host_port <> 0").withColumn("host_ip", F.col("node_ip"))
    return metadata.Cluster(p, by_port, host, stage(env.v_service_info, "services"), env.v_nodes, LOCAL_NODE, LOCAL_IP)


# One row per key, as CTEs: containers, exact port, port fallback, pod by ip, service, node port, host port, node.
_LOOKUPS = """
lc AS (SELECT * FROM v_pod_info),
lx AS (SELECT * FROM v_pod_info),
la AS (SELECT * FROM v_pod_info WHERE NOT host_network),
lsv AS (SELECT * FROM v_service_info),
lnp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_port ORDER BY namespace, service) AS rn FROM v_service_info WHERE node_port IS NOT NULL) x WHERE rn = 1),
lh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_ip, host_port ORDER BY pod) AS rn FROM v_pod_info WHERE host_port <> 0) x WHERE rn = 1)"""


def _ip_port(alias, ip, port):
    """Join of the port lookup: exact entry, else the one entry of a pod that is not on the host network."""
    return (f"LEFT JOIN lx {alias}x ON {alias}x.ip = {ip} AND {alias}x.port = {port} "
            f"LEFT JOIN la {alias}a ON {alias}a.ip = {ip}")


def _pick(alias, col):
    return f"CASE WHEN {alias}x.pod IS NOT NULL THEN {alias}x.{col} ELSE {alias}a.{col} END"


def _found(alias):
    return f"({alias}x.pod IS NOT NULL OR {alias}a.pod IS NOT NULL)"


@query("join_container", """
SELECT c.request_id, c.ts_ns, c.request_total_time, p.pod, p.container, p.workload_name, p.node FROM v_calls c
LEFT JOIN v_pod_info p ON p.container_id = c.container_id""")
def join_container(env):
    t = cluster(env).join_container(env.v_calls, F.nullif("container_id", F.lit("")), "m")
    return t.select("request_id", "ts_ns", "request_total_time", "m.pod", "m.container", "m.workload_name", "m.node")


@query("join_ip_port", f"""
WITH {_LOOKUPS.strip()}
SELECT c.request_id, c.ts_ns, c.request_total_time, {_pick('d', 'pod')} AS pod, {_pick('d', 'container')} AS container FROM v_calls c {_ip_port('d', 'c.dst_ip', 'c.dst_port')}""")
def join_ip_port(env):
    t = cluster(env).join_ip_port(env.v_calls, F.col("dst_ip"), F.col("dst_port"), "m")
    return t.select("request_id", "ts_ns", "request_total_time", "m.pod", "m.container")


@query("join_pod_ip", """
SELECT c.request_id, c.ts_ns, c.request_total_time, p.pod, p.workload_name FROM v_calls c LEFT JOIN v_pod_info p ON p.ip = c.src_ip AND NOT p.host_network""")
def join_pod_ip(env):
    t = cluster(env).join_pod_ip(env.v_calls, F.col("src_ip"), "m")
    return t.select("request_id", "ts_ns", "request_total_time", "m.pod", "m.workload_name")


@query("join_service", f"""
WITH {_LOOKUPS.strip()}
SELECT c.request_id, c.ts_ns, c.request_total_time, coalesce(s.service, np.service) AS service, coalesce(s.namespace, np.namespace) AS namespace
FROM v_calls c LEFT JOIN lsv s ON s.ip = c.dst_ip AND s.port = c.dst_port
LEFT JOIN v_nodes n ON n.ip = c.dst_ip LEFT JOIN lnp np ON n.ip IS NOT NULL AND np.node_port = c.dst_port""")
def join_service(env):
    t = cluster(env).join_service(env.v_calls, F.col("dst_ip"), F.col("dst_port"), "m")
    return t.select("request_id", "ts_ns", "request_total_time", "m.service", "m.namespace")


@query("join_host_port", f"""
WITH {_LOOKUPS.strip()}
SELECT c.request_id, c.ts_ns, c.request_total_time, h.pod, coalesce(h.ip, c.dst_ip) AS dst_ip, CAST(coalesce(h.port, c.dst_port) AS BIGINT) AS dst_port,
  CASE WHEN h.pod IS NOT NULL THEN concat(c.dst_ip, ':', c.dst_port) END AS service
FROM v_calls c LEFT JOIN lh h ON h.node_ip = c.dst_ip AND h.host_port = c.dst_port""")
def join_host_port(env):
    t = cluster(env).join_host_port(env.v_calls, F.col("dst_ip"), F.col("dst_port"), "m")
    hit = F.col("m").isNotNull()
    return t.select("request_id", "ts_ns", "request_total_time", "m.pod", F.coalesce("m.ip", "dst_ip").alias("dst_ip"),
                    F.coalesce("m.port", "dst_port").cast("long").alias("dst_port"),
                    F.when(hit, F.concat("dst_ip", F.lit(":"), F.col("dst_port").cast("string"))).alias("service"))


@query("join_node", """
SELECT c.request_id, c.ts_ns, c.request_total_time, n.node FROM v_calls c LEFT JOIN v_nodes n ON n.ip = c.dst_ip""")
def join_node(env):
    return cluster(env).join_node(env.v_calls, F.col("dst_ip"), "m").select("request_id", "ts_ns", "request_total_time", "m.node")


_NAT = """SELECT src_ip, dst_ip, dst_port, CASE WHEN dst_port % 2 = 0 THEN dst_ip ELSE dnat_ip END AS dnat_ip,
  CASE WHEN dst_port % 2 = 0 THEN dst_port ELSE dnat_port END AS dnat_port FROM v_nat"""


@query("lookup_dnat", f"""
SELECT r.request_id, r.ts_ns, r.request_total_time, CASE WHEN n.dnat_ip IS NOT NULL AND n.dnat_ip <> r.dst_ip THEN n.dnat_ip ELSE '' END AS dnat_ip,
  CAST(CASE WHEN n.dnat_ip IS NOT NULL AND n.dnat_ip <> r.dst_ip THEN n.dnat_port ELSE -1 END AS BIGINT) AS dnat_port
FROM v_requests r LEFT JOIN ({_NAT}) n USING (src_ip, dst_ip, dst_port)""")
def lookup_dnat(env):
    return metadata.lookup_dnat(env.v_requests, env.sql(_NAT)).select("request_id", "ts_ns", "request_total_time", "dnat_ip", "dnat_port")


_POD = ["node", "node_ip", "namespace", "workload_kind", "workload_name", "pod"]
_SIDE = ["node", "node_ip", "namespace", "workload_kind", "workload_name", "service", "pod", "container", "container_id", "ip"]
_LIT = {"local_node": f"'{LOCAL_NODE}'", "local_ip": f"'{LOCAL_IP}'", "int": "'NOT_FOUND_INTERNAL'", "ext": "'NOT_FOUND_EXTERNAL'"}


def _src_client(c):
    sc = {**{k: f"sc.{k}" for k in _POD}, "container": "sc.container", "container_id": "c.container_id", "ip": "sc.ip", "service": "sc.service"}
    un = {"node": _LIT["local_node"], "node_ip": _LIT["local_ip"], "namespace": _LIT["int"], "container_id": "c.container_id", "ip": "c.src_ip"}
    return (f"CASE WHEN c.container_id <> '' THEN CASE WHEN sc.pod IS NOT NULL THEN {sc[c]} ELSE {un.get(c, chr(39) * 2)} END ELSE {_src_pod(c)} END")


def _src_pod(c):
    """Pod by ip, else node, else outside; the loopback starts from the local node."""
    sp = {**{k: f"sp.{k}" for k in _POD}, "ip": "sp.ip", "service": "sp.service"}
    sn = {"node": "sn.node", "node_ip": "c.src_ip", "namespace": _LIT["int"], "ip": "c.src_ip"}
    out = {"node": f"CASE WHEN c.src_ip = '127.0.0.1' THEN {_LIT['local_node']} ELSE '' END",
           "node_ip": f"CASE WHEN c.src_ip = '127.0.0.1' THEN {_LIT['local_ip']} ELSE '' END", "namespace": _LIT["ext"], "ip": "c.src_ip"}
    e = "''"
    return f"CASE WHEN sp.pod IS NOT NULL THEN {sp.get(c, e)} WHEN sn.node IS NOT NULL THEN {sn.get(c, e)} ELSE {out.get(c, e)} END"


def _dst_client(c):
    e = "''"
    loop = {"node": f"CASE WHEN c.dst_ip = '127.0.0.1' THEN {_LIT['local_node']} ELSE '' END",
            "node_ip": f"CASE WHEN c.dst_ip = '127.0.0.1' THEN {_LIT['local_ip']} ELSE '' END"}
    svc = {"namespace": "sv.namespace", "service": "sv.service", "workload_kind": "sv.workload_kind", "workload_name": "sv.workload_name",
           "ip": "c.dst_ip", **loop}
    dd = {**{k: _pick("t", k) for k in _POD}, "container": _pick("t", "container"), "container_id": e, "ip": "c.dst_ip", "service": "sv.service"}
    dn = {**svc, "node": "tn.node", "node_ip": "c.dnat_ip"}
    con = {**{k: _pick("d", k) for k in _POD}, "container": _pick("d", "container"), "container_id": e, "ip": "c.dst_ip"}
    host = {**{k: f"h.{k}" for k in _POD}, "container": "h.container", "ip": "h.ip", "service": "concat(c.d_ip, ':', c.dst_port)"}
    node = {"node": "n.node", "node_ip": "c.d_ip", "namespace": _LIT["int"], "ip": "c.dst_ip"}
    out = {**loop, "namespace": _LIT["ext"], "ip": "c.dst_ip"}
    return (f"CASE WHEN sv.service IS NOT NULL THEN CASE WHEN c.dnat_ip <> '' AND c.dnat_port <> -1 AND {_found('t')} THEN {dd.get(c, e)} "
            f"WHEN c.dnat_ip <> '' AND c.dnat_port <> -1 AND tn.node IS NOT NULL THEN {dn.get(c, e)} ELSE {svc.get(c, e)} END "
            f"WHEN {_found('d')} THEN {con.get(c, e)} WHEN h.pod IS NOT NULL THEN {host.get(c, e)} WHEN n.node IS NOT NULL THEN {node.get(c, e)} "
            f"ELSE {out.get(c, e)} END")


_SV = """(SELECT c0.rid, coalesce(s.namespace, np.namespace) AS namespace, coalesce(s.service, np.service) AS service,
  coalesce(s.workload_kind, np.workload_kind) AS workload_kind, coalesce(s.workload_name, np.workload_name) AS workload_name
  FROM c c0 LEFT JOIN lsv s ON s.ip = c0.d_ip AND s.port = c0.dst_port LEFT JOIN v_nodes vn ON vn.ip = c0.d_ip
  LEFT JOIN lnp np ON vn.ip IS NOT NULL AND np.node_port = c0.dst_port)"""


def _calls(where, loopback=True):
    d = "CASE WHEN dst_ip = '127.0.0.1' THEN src_ip ELSE dst_ip END" if loopback else "dst_ip"
    return f"c AS (SELECT *, row_number() OVER () AS rid, {d} AS d_ip FROM v_calls WHERE {where})"


def _cols(side, fn, cols=_SIDE):
    return ", ".join(f"{fn(c)} AS {side}_{c}" for c in cols)


@query("enrich_client", f"""
WITH {_LOOKUPS.strip()}, {_calls('NOT is_server')}
SELECT c.request_id, c.ts_ns, c.request_total_time, {_cols('src', _src_client)}, {_cols('dst', _dst_client)},
  CAST(CASE WHEN sv.service IS NULL AND NOT {_found('d')} AND h.pod IS NOT NULL THEN h.port ELSE c.dst_port END AS BIGINT) AS dst_port
FROM c LEFT JOIN lc sc ON sc.container_id = c.container_id LEFT JOIN la sp ON sp.ip = c.src_ip LEFT JOIN v_nodes sn ON sn.ip = c.src_ip
LEFT JOIN {_SV} sv ON sv.rid = c.rid {_ip_port('t', 'c.dnat_ip', 'c.dnat_port')} LEFT JOIN v_nodes tn ON tn.ip = c.dnat_ip
{_ip_port('d', 'c.d_ip', 'c.dst_port')} LEFT JOIN lh h ON h.node_ip = c.d_ip AND h.host_port = c.dst_port LEFT JOIN v_nodes n ON n.ip = c.d_ip""")
def enrich_client(env):
    out = metadata.enrich_client(env.v_calls.where("NOT is_server"), cluster(env))
    return out.select("request_id", "ts_ns", "request_total_time", *[f"src_{c}" for c in _SIDE], *[f"dst_{c}" for c in _SIDE], "dst_port")


def _dst_server(c):
    e = "''"
    con = {**{k: f"dc.{k}" for k in _POD}, "container": "dc.container", "container_id": "dc.container_id", "service": "dc.service", "ip": "c.dst_ip"}
    out = {"node": _LIT["local_node"], "node_ip": _LIT["local_ip"], "namespace": _LIT["int"], "container_id": "c.container_id", "ip": "c.dst_ip"}
    return f"CASE WHEN dc.pod IS NOT NULL THEN {con[c]} ELSE {out.get(c, e)} END"


@query("enrich_server", f"""
WITH {_LOOKUPS.strip()}, {_calls('is_server')}
SELECT c.request_id, c.ts_ns, c.request_total_time, {_cols('src', _src_pod)}, {_cols('dst', _dst_server)}, CAST(c.dst_port AS BIGINT) AS dst_port
FROM c LEFT JOIN la sp ON sp.ip = c.src_ip LEFT JOIN v_nodes sn ON sn.ip = c.src_ip LEFT JOIN lc dc ON dc.container_id = c.container_id""")
def enrich_server(env):
    out = metadata.enrich_server(env.v_calls.where("is_server"), cluster(env))
    return out.select("request_id", "ts_ns", "request_total_time", *[f"src_{c}" for c in _SIDE], *[f"dst_{c}" for c in _SIDE], "dst_port")


def _src_tcp(c):
    e = "''"
    con = {**{k: _pick("s", k) for k in _POD}, "container": _pick("s", "container"), "ip": _pick("s", "ip"), "service": _pick("s", "service")}
    ns = f"CASE WHEN sn.node IS NOT NULL THEN {_LIT['int']} ELSE {_LIT['ext']} END"
    sp = {**{k: f"sp.{k}" for k in _POD}, "ip": "sp.ip", "service": "sp.service"}
    rest = {"namespace": ns, "ip": "c.src_ip"}
    return f"CASE WHEN {_found('s')} THEN {con.get(c, e)} WHEN sp.pod IS NOT NULL THEN {sp.get(c, e)} ELSE {rest.get(c, e)} END"


def _dst_tcp(c):
    e = "''"
    svc = {"namespace": "sv.namespace", "service": "sv.service", "workload_kind": "sv.workload_kind", "workload_name": "sv.workload_name", "ip": "c.dst_ip"}
    dd = {**{k: _pick("t", k) for k in _POD}, "container": _pick("t", "container"), "ip": "c.dst_ip", "service": "sv.service"}
    con = {**{k: _pick("d", k) for k in _POD}, "container": _pick("d", "container"), "ip": "c.dst_ip"}
    host = {**{k: f"h.{k}" for k in _POD}, "container": "h.container", "ip": "h.ip", "service": "concat(c.dst_ip, ':', c.dst_port)"}
    h = f"CASE WHEN h.pod IS NOT NULL THEN {host.get(c, e)} ELSE {'c.dst_ip' if c == 'ip' else e} END"
    if c in _POD:
        h_ns = f"CASE WHEN n.node IS NOT NULL THEN {_LIT['int']} ELSE {_LIT['ext']} END" if c == "namespace" else h
        h = f"CASE WHEN dp.pod IS NOT NULL THEN dp.{c} ELSE {h_ns} END"
    return (f"CASE WHEN sv.service IS NOT NULL THEN CASE WHEN c.dnat_ip <> '' AND c.dnat_port <> -1 AND {_found('t')} THEN {dd.get(c, e)} "
            f"ELSE {svc.get(c, e)} END WHEN {_found('d')} THEN {con.get(c, e)} ELSE {h} END")


@query("enrich_tcp", f"""
WITH {_LOOKUPS.strip()}, {_calls('true', False)}
SELECT request_id, ts_ns, request_total_time, {", ".join(f"src_{c}, dst_{c}" for c in _SIDE if c != 'ip')}, src_ip,
  CASE WHEN dnat_ip <> '' THEN dnat_ip ELSE dst_ip END AS dst_ip,
  CASE WHEN src_port < 32768 AND port < 32768 THEN CASE WHEN src_port > port THEN NULL ELSE src_port END WHEN src_port >= 32768 THEN NULL ELSE src_port END AS src_port,
  CASE WHEN src_port < 32768 AND port < 32768 THEN CASE WHEN src_port > port THEN port ELSE NULL END WHEN port >= 32768 THEN NULL ELSE port END AS dst_port
FROM (SELECT *, CAST(CASE WHEN dnat_port > 0 THEN dnat_port ELSE p0 END AS BIGINT) AS port FROM (
SELECT c.request_id, c.ts_ns, c.request_total_time, c.dnat_ip, c.dnat_port, c.src_port, {_cols('src', _src_tcp)}, {_cols('dst', _dst_tcp)},
  CASE WHEN sv.service IS NULL AND NOT {_found('d')} AND h.pod IS NOT NULL THEN h.port ELSE c.dst_port END AS p0
FROM c {_ip_port('s', 'c.src_ip', 'c.src_port')} LEFT JOIN la sp ON sp.ip = c.src_ip LEFT JOIN v_nodes sn ON sn.ip = c.src_ip
LEFT JOIN {_SV} sv ON sv.rid = c.rid {_ip_port('t', 'c.dnat_ip', 'c.dnat_port')} {_ip_port('d', 'c.d_ip', 'c.dst_port')}
LEFT JOIN lh h ON h.node_ip = c.d_ip AND h.host_port = c.dst_port LEFT JOIN la dp ON dp.ip = c.d_ip LEFT JOIN v_nodes n ON n.ip = c.d_ip) a) b""")
def enrich_tcp(env):
    out = metadata.enrich_tcp(env.v_calls, cluster(env))
    return out.select("request_id", "ts_ns", "request_total_time", *[f"{s}_{c}" for c in _SIDE for s in ("src", "dst")], "src_port", "dst_port")


@query("match_services", """
SELECT namespace, pod, min(service) AS service FROM (
  SELECT l.namespace, l.pod, s.service, count(*) AS met FROM v_pod_labels l JOIN v_selectors s ON l.namespace = s.namespace AND l.k = s.k AND l.v = s.v
  GROUP BY 1, 2, 3) m JOIN (SELECT namespace AS ns, service AS sv, count(*) AS need FROM v_selectors GROUP BY 1, 2) n
  ON namespace = ns AND service = sv AND met = need GROUP BY 1, 2""")
def match_services(env):
    return metadata.match_services(env.v_pod_labels, env.v_selectors)


_OWNED = """SELECT pod, namespace, CASE WHEN host_network THEN 'DaemonSet' ELSE 'ReplicaSet' END AS owner_kind,
  CASE WHEN host_network THEN concat('ds-', workload) ELSE concat(lower(workload), '-', substr(md5(workload), 1, 5)) END AS owner_name,
  CASE WHEN right(pod, 1) = '3' THEN 'example.com/v1' ELSE 'apps/v1' END AS owner_api FROM v_pods"""
_RS = """SELECT DISTINCT namespace, concat(lower(workload), '-', substr(md5(workload), 1, 5)) AS name, 'Rollout' AS owner_kind,
  concat('ro-', lower(workload)) AS owner_name, 'argo.example/v1' AS owner_api FROM v_pods WHERE workload < 'NATION_2'"""


@query("resolve_workload", f"""
SELECT p.pod, p.namespace, CASE WHEN p.owner_kind = 'ReplicaSet' AND r.name IS NOT NULL THEN 'argo.example/v1/rollout' WHEN p.owner_kind = 'ReplicaSet' THEN 'deployment'
  WHEN p.owner_api = 'apps/v1' THEN lower(p.owner_kind) ELSE concat(p.owner_api, '/', lower(p.owner_kind)) END AS workload_kind,
  CASE WHEN p.owner_kind = 'ReplicaSet' AND r.name IS NOT NULL THEN r.owner_name WHEN p.owner_kind = 'ReplicaSet'
  THEN regexp_extract(p.owner_name, '^(.*)-[0-9a-z]+$', 1) ELSE p.owner_name END AS workload_name
FROM ({_OWNED}) p LEFT JOIN ({_RS}) r ON p.namespace = r.namespace AND p.owner_name = r.name""")
def resolve_workload(env):
    return metadata.resolve_workload(env.sql(_OWNED), env.sql(_RS)).select("pod", "namespace", "workload_kind", "workload_name")


# Address reuse: each order gives its customer's address a new owner at the order date, half of them end later.
_VALIDITY = """SELECT concat('10.1.', CAST(floor(o_custkey / 256) AS INT), '.', o_custkey % 256) AS src_ip,
  EPOCH_US(o_orderdate) * 1000 + (o_orderkey % 1000) AS valid_from, concat('pod-', o_orderkey) AS owner,
  CASE WHEN o_orderkey % 2 = 0 THEN EPOCH_US(o_orderdate) * 1000 + (o_orderkey % 60) * 86400000000000 END AS valid_to FROM orders"""


@query("metadata_asof", f"""
WITH v AS ({_VALIDITY}), m AS (
  SELECT src_ip, valid_from AS t, 0 AS kind, owner, valid_to, NULL AS request_id, NULL AS request_total_time FROM v
  UNION ALL SELECT src_ip, ts_ns, 1, NULL, NULL, request_id, request_total_time FROM v_requests),
s AS (SELECT *, last_value(CASE WHEN kind = 0 THEN {{'o': owner, 'v': valid_to}} END IGNORE NULLS) OVER (PARTITION BY src_ip ORDER BY t, kind
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hit FROM m)
SELECT request_id, t AS ts_ns, request_total_time, src_ip, CASE WHEN hit.v IS NULL OR t <= hit.v + 60000000000 THEN hit.o END AS owner FROM s WHERE kind = 1""")
def metadata_asof(env):
    r = env.v_requests.select("request_id", "ts_ns", "request_total_time", "src_ip")
    return metadata.metadata_asof(r, env.sql(_VALIDITY), ["src_ip"], ["owner"], slice_ns=30 * 86_400_000_000_000)
