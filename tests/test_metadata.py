"""Cluster lookups, cascades and validity on hand rows."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from skeinwork.operators import connects, metadata
from skeinwork.session import work_dir
from skeinwork.sources import cluster, events

POD = "pod string, namespace string, node string, node_ip string, ip string, workload_kind string, workload_name string, service string, host_network boolean"


@pytest.fixture(scope="module")
def lookups(spark):
    a = ("web-1", "shop", "n1", "10.9.0.1", "10.1.0.1", "deployment", "web", "svc-web", False)
    b = ("db-1", "data", "n2", "10.9.0.2", "10.1.0.2", "statefulset", "db", "", False)
    h = ("host-1", "sys", "n2", "10.9.0.2", "10.9.0.2", "daemonset", "agent", "", True)
    containers = spark.createDataFrame([(*a, "c", "cid-web")], POD + ", container string, container_id string")
    ports = spark.createDataFrame([(*a, "web", "", 80), (*b, "db", "", 0), (*h, "agent", "", 9100)], POD + ", container string, container_id string, port int")
    host = spark.createDataFrame([(*b, "db", "", "10.9.0.2", 30306, 3306)], POD + ", container string, container_id string, host_ip string, host_port int, port int")
    services = spark.createDataFrame([("shop", "svc-web", "10.8.0.1", 80, 30080, "deployment", "web")],
                                     "namespace string, service string, ip string, port int, node_port int, workload_kind string, workload_name string")
    nodes = spark.createDataFrame([("n1", "10.9.0.1"), ("n2", "10.9.0.2")], "node string, ip string")
    return metadata.Cluster(containers, ports, host, services, nodes, "n1", "10.9.0.1").staged(work_dir(spark, "lookups"))


CALL = "id int, container_id string, src_ip string, src_port long, dst_ip string, dst_port long, dnat_ip string, dnat_port long"


def test_ip_port_rules(spark, lookups):
    df = spark.createDataFrame([(1, "10.1.0.1", 80), (2, "10.1.0.1", 81), (3, "10.1.0.2", 5432), (4, "10.9.0.2", 9100), (5, "10.9.0.2", 1), (6, "1.1.1.1", 1)], "id int, ip string, port int")
    got = lookups.join_ip_port(df, F.col("ip"), F.col("port"), "m")
    assert rows(got, "id", "m.pod") == [(1, "web-1"), (2, "web-1"), (3, "db-1"), (4, "host-1"), (5, None), (6, None)]


def test_service_by_node_port(spark, lookups):
    df = spark.createDataFrame([(1, "10.8.0.1", 80), (2, "10.9.0.2", 30080), (3, "10.1.0.1", 30080), (4, "10.9.0.1", 80)], "id int, ip string, port int")
    assert rows(lookups.join_service(df, F.col("ip"), F.col("port"), "m"), "id", "m.service") == [(1, "svc-web"), (2, "svc-web"), (3, None), (4, None)]


def test_client_cascade(spark, lookups):
    data = [(1, "cid-web", "10.1.0.1", 1, "10.8.0.1", 80, "10.1.0.2", 3306), (2, "unknown", "10.1.0.1", 1, "10.9.0.2", 30306, "", -1),
            (3, "", "127.0.0.1", 1, "127.0.0.1", 1, "", -1), (4, "", "8.8.8.8", 1, "10.9.0.1", 22, "", -1), (5, "", "10.9.0.2", 1, "10.8.0.1", 80, "10.9.0.2", 99)]
    out = metadata.enrich_client(spark.createDataFrame(data, CALL), lookups)
    got = rows(out, "id", "src_namespace", "src_pod", "src_node", "src_service", "dst_namespace", "dst_service", "dst_pod", "dst_node", "dst_ip", "dst_port")
    assert got == [
        (1, "shop", "web-1", "n1", "svc-web", "data", "svc-web", "db-1", "n2", "10.8.0.1", 80),
        (2, "NOT_FOUND_INTERNAL", "", "n1", "", "data", "10.9.0.2:30306", "db-1", "n2", "10.1.0.2", 3306),
        (3, "NOT_FOUND_EXTERNAL", "", "n1", "", "NOT_FOUND_EXTERNAL", "", "", "n1", "127.0.0.1", 1),
        (4, "NOT_FOUND_EXTERNAL", "", "", "", "NOT_FOUND_INTERNAL", "", "", "n1", "10.9.0.1", 22),
        (5, "NOT_FOUND_INTERNAL", "", "n2", "", "shop", "svc-web", "", "n2", "10.8.0.1", 80)]


def test_server_cascade(spark, lookups):
    data = [(1, "cid-web", "10.1.0.2", 1, "10.1.0.1", 80, "", -1), (2, "", "9.9.9.9", 1, "10.1.0.1", 80, "", -1)]
    got = rows(metadata.enrich_server(spark.createDataFrame(data, CALL), lookups), "id", "src_namespace", "src_pod", "dst_namespace", "dst_service", "dst_container_id", "dst_node")
    assert got == [(1, "data", "db-1", "shop", "svc-web", "cid-web", "n1"), (2, "NOT_FOUND_EXTERNAL", "", "NOT_FOUND_INTERNAL", "", "", "n1")]


def test_tcp_host_port_does_not_stop(spark, lookups):
    """The host-port hit sets pod and service; the node step after it overwrites the namespace."""
    data = [(1, "", "10.1.0.1", 40000, "10.9.0.2", 30306, "", -1), (2, "", "10.1.0.1", 40000, "10.8.0.1", 80, "10.1.0.2", 3306)]
    got = rows(metadata.enrich_tcp(spark.createDataFrame(data, CALL), lookups), "id", "dst_namespace", "dst_pod", "dst_service", "dst_ip", "src_port", "dst_port")
    assert got == [(1, "NOT_FOUND_INTERNAL", "db-1", "10.9.0.2:30306", "10.1.0.2", None, 3306), (2, "data", "db-1", "svc-web", "10.1.0.2", None, 3306)]


def test_selectors(spark):
    labels = spark.createDataFrame([("a", "p1", "app", "web"), ("a", "p1", "tier", "1"), ("a", "p2", "app", "web"), ("b", "p3", "app", "web")], "namespace string, pod string, k string, v string")
    sel = spark.createDataFrame([("a", "both", "app", "web"), ("a", "both", "tier", "1"), ("a", "one", "app", "web"), ("c", "other", "app", "web")], "namespace string, service string, k string, v string")
    assert rows(metadata.match_services(labels, sel)) == [("a", "p1", "both"), ("a", "p2", "one")]


def test_asof_grace(spark):
    s = 1_000_000_000
    v = spark.createDataFrame([("ip", 10 * s, 20 * s, "a"), ("ip", 100 * s, None, "b")], "ip string, valid_from long, valid_to long, owner string")
    r = spark.createDataFrame([("ip", t * s) for t in (5, 10, 80, 81, 100, 500)], "ip string, ts_ns long")
    assert rows(metadata.metadata_asof(r, v, ["ip"], ["owner"], slice_ns=7 * s)) == rows(
        spark.createDataFrame([("ip", 5 * s, None), ("ip", 10 * s, "a"), ("ip", 80 * s, "a"), ("ip", 81 * s, None), ("ip", 100 * s, "b"), ("ip", 500 * s, "b")], "a string, b long, c string"))


def test_nat(spark):
    t = spark.createDataFrame([(1, 6, "10.0.0.0", 12345, "50.30.40.10", 80, "20.0.0.0", 80, "10.0.0.0", 12345), (1, 6, "1.1.1.1", 1, "2.2.2.2", 2, "2.2.2.2", 2, "1.1.1.1", 1)],
                              "ts_ns long, proto int, origin_src string, origin_sport int, origin_dst string, origin_dport int, reply_src string, reply_sport int, reply_dst string, reply_dport int")
    nat = events.nat_table(t)
    assert nat.count() == 2
    q = spark.createDataFrame([(1, "10.0.0.0", 12345, "50.30.40.10", 80, "tcp"), (2, "10.0.0.0", 12345, "50.30.40.10", 80, "udp"), (3, "20.0.0.0", 80, "10.0.0.0", 12345, "tcp")],
                              "id int, src_ip string, src_port int, dst_ip string, dst_port int, transport string")
    assert rows(metadata.lookup_dnat(q, nat), "id", "dnat_ip", "dnat_port") == [
        # The way back is a translated source only.
        (1, "20.0.0.0", 80), (2, "", -1), (3, "", -1)]
    snat = nat.withColumns({"dnat_ip": F.col("dst_ip"), "dnat_port": F.col("dst_port")})
    assert rows(metadata.lookup_dnat(q, snat), "dnat_ip") == [("",)] * 3


def test_socket_lines(spark):
    df = spark.createDataFrame([("11: 00000000:0000 00000000:0000 0A 00000000:00000000 00:00000000 00000000     0        0 39309 1",), ("1: 0100007F:1F90 0200007F:0050 01 a b c d e f g",),
                                ("sl local rem st",), ("1: zz00007F:1F90 0200007F:0050 01 a b c d e f g",)], "line string")
    assert rows(events.parse_socket_lines(df)) == [("0.0.0.0", 0, "0.0.0.0", 0, "0A"), ("127.0.0.1", 8080, "127.0.0.2", 80, "01")]


def test_cluster_snapshot(spark, tmp_path):
    rs = {"kind": "ReplicaSet", "name": "web-5d4f", "api_version": "apps/v1", "controller": True}
    base = {"namespace": "shop", "host_ip": "10.9.0.1", "node": "n1", "host_network": False, "owners": [rs]}
    pods = [
        {**base, "name": "two", "ip": "10.1.0.1", "labels": {"app": "web"}, "statuses": [{"name": "a", "container_id": "docker://aaaaaaaaaaaaaaaa"}, {"name": "b", "container_id": "bad"}],
         "containers": [{"name": "a", "ports": [{"container_port": 80, "host_port": 30080}, {"container_port": 81, "host_port": 0}]}, {"name": "b", "ports": []}]},
        {**base, "name": "one", "ip": "10.1.0.2", "labels": {}, "statuses": [], "containers": [{"name": "only", "ports": []}]},
        {**base, "name": "pending", "ip": "", "labels": {"app": "web"}, "statuses": [], "containers": [{"name": "x", "ports": [{"container_port": 1, "host_port": 0}]}]}]
    services = [{"name": "web", "namespace": "shop", "cluster_ip": "10.8.0.1", "type": "NodePort", "selector": {"app": "web"}, "ports": [{"port": 80, "node_port": 31000}]},
                {"name": "headless", "namespace": "shop", "cluster_ip": "None", "type": "ClusterIP", "selector": {}, "ports": [{"port": 80, "node_port": 0}]}]
    nodes = [{"name": "n1", "addresses": [{"type": "InternalIP", "address": "10.9.0.1"}, {"type": "Hostname", "address": "n1"}]}]
    sets = [{"name": "web-5d4f", "namespace": "shop", "owners": [{"kind": "Rollout", "name": "web", "api_version": "argo/v1", "controller": True}]}]
    paths = {}
    for kind, objs in (("pods", pods), ("services", services), ("nodes", nodes), ("replicasets", sets)):
        (tmp_path / f"{kind}.json").write_text("\n".join(json.dumps(o) for o in objs))
        paths[kind] = str(tmp_path / f"{kind}.json")
    c = cluster.scan_cluster_snapshot(spark, paths)
    assert rows(c.containers, "container_id", "container", "pod", "service", "workload_kind", "workload_name") == [("aaaaaaaaaaaa", "a", "two", "web", "argo/v1/rollout", "web")]
    assert rows(c.ports, "ip", "port", "container") == [("10.1.0.1", 0, ""), ("10.1.0.1", 80, "a"), ("10.1.0.1", 81, "a"), ("10.1.0.2", 0, "only")]
    assert rows(c.host_ports, "host_ip", "host_port", "port") == [("10.9.0.1", 30080, 80)]
    assert rows(c.services, "service", "ip", "port", "node_port", "workload_name") == [("web", "10.8.0.1", 80, 31000, "web")]
    assert rows(c.nodes) == [("n1", "10.9.0.1")]


CONNECT = "seq long, ts_ns long, name string, src_ip string, src_port int, dst_ip string, dst_port int, ret int, old_state int, new_state int, pid long"


def conn(port, *steps):
    return [(port * 100 + i, ts, name, "a", port, "b", 80, ret, old, new, pid) for i, (ts, name, ret, old, new, pid) in enumerate(steps)]


CONNECT_ROWS = (
    conn(1, (10, "tcp_connect", 0, 0, 0, 0), (20, "connect", 0, 0, 0, 5), (30, "tcp_set_state", 0, 2, 1, 0))
    + conn(2, (10, "tcp_connect", 0, 0, 0, 0), (20, "connect", -115, 0, 0, 5), (35, "tcp_set_state", 0, 2, 1, 0))
    + conn(3, (10, "tcp_connect", 0, 0, 0, 0), (20, "connect", -111, 0, 0, 5))
    + conn(4, (10, "tcp_connect", 99, 0, 0, 0)) + conn(5, (10, "tcp_connect", 0, 0, 0, 0), (20, "connect", -4, 0, 0, 7))
    + conn(6, (10, "tcp_connect", 0, 0, 0, 0), (20, "sendto", 0, 0, 0, 5), (40, "tcp_connect", 0, 0, 0, 0), (50, "tcp_set_state", 0, 1, 8, 0))
    + conn(7, (20, "connect", 0, 0, 0, 5), (30, "tcp_set_state", 0, 2, 1, 0)) + conn(0, (10, "tcp_connect", 99, 0, 0, 0))
    + conn(8, (10, "tcp_connect", 0, 0, 0, 0), (12, "tcp_set_state", 0, 2, 3, 0), (15, "tcp_connect", 0, 0, 0, 0), (16, "connect", 0, 0, 0, 9)))


@pytest.mark.parametrize("width", [1, 10, 10 ** 9])
def test_connect_attempts(spark, width):
    out = connects.finished(connects.attempts(spark.createDataFrame(CONNECT_ROWS, CONNECT), width))
    assert rows(out, "src_port", "success", "errno", "ts_ns", "connect_duration_nanoseconds_total", "pid") == [
        (1, True, 0, 20, 10, 5), (2, True, 0, 35, 25, 5), (3, False, -111, 20, None, 5), (4, False, 99, 10, None, 0), (6, True, 0, 20, 10, 5), (6, True, 0, 50, 10, 0), (8, True, 0, 16, 6, 9)]


def test_expiry(spark):
    s = 1_000_000_000
    open_ = spark.createDataFrame([(i, pid, "a", i, "b", 80, t) for i, pid, t in [(1, 5, 0), (2, 5, 0), (3, 5, 0), (4, 5, 0), (5, 0, 0), (6, 5, 95 * s)]],
                                  "id int, pid long, src_ip string, src_port int, dst_ip string, dst_port int, first_ns long")
    socks = spark.createDataFrame([(5, "a", 2, "b", 80, "01"), (5, "a", 3, "b", 80, "02"), (5, "a", 4, "b", 80, "08")],
                                  "pid long, local_ip string, local_port int, remote_ip string, remote_port int, state string")
    assert rows(connects.expire(open_, socks, F.lit(100 * s)), "id", "outcome") == [(1, "failure"), (2, "success"), (3, None), (4, "success")]


def test_rows_of_one_key_are_split(spark):
    """A key that most rows share is no task of its own: the plan has the exchanges between which AQE splits a join."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.shuffle.partitions": "8",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        id_, pod = F.col("id"), F.concat(F.lit("p"), F.col("id").cast("string"))
        table = spark.range(200).select(pod.alias("container_id"), pod.alias("container"), *[pod.alias(c) for c in metadata.POD_COLS if c != "ip"], pod.alias("ip"), F.lit(1).alias("port"),
                                        F.lit(False).alias("host_network"))
        lookups = metadata.Cluster(table, table, table, table, table)
        df = spark.range(0, 60_000, 1, 8).select("id", F.when(id_ % 3 > 0, "p1").otherwise(F.concat(F.lit("p"), (id_ % 200).cast("string"))).alias("key"), F.hash("id").alias("x"))
        for out in (lookups.join_container(df, F.col("key"), "m"), lookups.join_address(df, F.col("key"), F.lit(1), "m")):
            got = out.select("id", "key", "m.pod", "x")
            assert got.where("pod <> key OR pod IS NULL").count() == 0
            got.collect()
            assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_client_and_tcp_labels_move_records_once_per_address(spark):
    """Three addresses of a connection, and the container of a client: not an exchange per lookup and none of finished rows."""
    conf, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    table = spark.range(1).select(*[F.lit("x").alias(c) for c in ("container_id", "container", *metadata.POD_COLS)], F.lit(1).alias("port"), F.lit(False).alias("host_network"))
    ports = table.withColumns({"host_ip": F.lit("y"), "host_port": F.lit(2), "node_port": F.lit(3)})
    df = spark.range(1).select("id", *[F.lit("x").alias(c) for c in ("container_id", "src_ip", "dst_ip", "dnat_ip")], *[F.lit(1).alias(c) for c in ("src_port", "dst_port", "dnat_port")])
    spark.conf.set(conf, "-1")
    try:
        for label in (metadata.enrich_tcp, metadata.enrich_client):
            plan = label(df, metadata.Cluster(ports, ports, ports, ports, ports))._jdf.queryExecution().optimizedPlan().toString()
            assert sum("Join LeftOuter" in line for line in plan.splitlines()) <= 10
    finally:
        spark.conf.set(conf, before)


def test_tcp_translated_and_not(spark, lookups):
    """Translated services, those whose translation is not known, a service by node port, and records without an address or port."""
    data = [(1, "", "10.1.0.2", 5432, "10.8.0.1", 80, "10.1.0.1", 80), (2, "", "10.1.0.2", 1, "10.8.0.1", 80, "10.7.7.7", 80), (3, "", "10.9.0.1", 1, "10.9.0.2", 30080, "10.1.0.1", 99),
            (4, "", "10.1.0.1", 80, "10.8.0.1", 80, "10.1.0.1", -1), (5, "", None, None, None, None, None, None), (6, "", "8.8.8.8", 1, "10.1.0.2", None, "10.1.0.1", 80), (7, "", "10.1.0.1", 1, "10.8.0.1", 80, None, 80)]
    got = metadata.enrich_tcp(spark.createDataFrame(data, CALL), lookups)
    assert "dnat_ip" not in got.columns and got.columns[:2] == ["id", "container_id"]
    assert rows(got, "id", "src_pod", "src_namespace", "dst_namespace", "dst_service", "dst_pod", "dst_container", "dst_ip", "dst_port", "src_port") == [
        (1, "db-1", "data", "shop", "svc-web", "web-1", "web", "10.1.0.1", 80, None), (2, "db-1", "data", "shop", "svc-web", "", "", "10.7.7.7", None, 1),
        (3, "", "NOT_FOUND_INTERNAL", "shop", "svc-web", "web-1", "web", "10.1.0.1", None, 1), (4, "web-1", "shop", "shop", "svc-web", "", "", "10.1.0.1", None, 80),
        (5, "", "NOT_FOUND_EXTERNAL", "NOT_FOUND_EXTERNAL", "", "", "", "", None, None), (6, "", "NOT_FOUND_EXTERNAL", "data", "", "db-1", "db", "10.1.0.1", None, 1),
        (7, "web-1", "shop", "shop", "svc-web", "", "", "10.8.0.1", None, 1)]


def test_tcp_records_move_once_per_end(spark):
    """A join by the address of either end and one for translated records, not one per table."""
    table = spark.range(1).select(*[F.lit("x").alias(c) for c in ("container_id", "container", *metadata.POD_COLS)], F.lit(1).alias("port"), F.lit(False).alias("host_network"))
    ports = table.withColumns({"host_ip": F.lit("y"), "host_port": F.lit(2), "node_port": F.lit(3)})
    df = spark.range(1).select("id", *[F.lit("x").alias(c) for c in ("container_id", "src_ip", "dst_ip", "dnat_ip")], *[F.lit(1).alias(c) for c in ("src_port", "dst_port", "dnat_port")])
    plan = metadata.enrich_tcp(df, metadata.Cluster(ports, ports, ports, ports, ports))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line.split("Join LeftOuter")[1] for line in plan.splitlines() if "Join LeftOuter" in line]
    # Those by node port broadcast a row per port; the destination's join is in both branches, whose records are dealt once.
    assert len(joins) - sum("rightHint=(strategy=broadcast)" in j for j in joins) <= 4, joins
