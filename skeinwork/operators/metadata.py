"""Cluster metadata: lookups, precedence cascades, selectors, owners, validity in time.

Lookup tables are joined without a hint, but for services by node port: below the session's broadcast threshold Spark broadcasts them, above it the
join is a shuffle join whose hot keys AQE splits. Every lookup table is reduced to one row per key first, so a join
never multiplies rows. ``Cluster.staged`` writes the tables to the shared work folder once: their size is then known from
the files instead of being guessed from the plan that makes them, and no record table is shuffled for a small one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork import constants as C
from skeinwork.functions import text
from skeinwork.operators import scan

POD_COLS = ["node", "node_ip", "namespace", "workload_kind", "workload_name", "pod", "ip", "service"]


def one_per_key(table: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """One row per key, the smallest by ``order``, as (keys, __m struct)."""
    return table.groupBy(*keys).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("__m"))


def _attach(df: DataFrame, table: DataFrame, on: dict[str, Column], name: str) -> DataFrame:
    """Left join a one-row-per-key table on computed keys; the match lands in struct column ``name``.

    Rows without a key keep a null key: they match nothing, and where they or those of a frequent key pile up in a shuffle
    join AQE splits them. It does so between two exchanges of the join's own only, so the table is dealt again: its first key
    is an expression, which is not known to be dealt already by the aggregation below it.
    """
    keys = {f"__k_{i}": v for i, v in enumerate(on.values())}
    first, *rest = on
    again = F.concat(F.col(first), F.lit("")) if isinstance(table.schema[first].dataType, T.StringType) else F.col(first) + F.lit(0)
    right = table.select(again.alias("__k_0"), *[F.col(c).alias(f"__k_{i}") for i, c in enumerate(rest, 1)], F.col("__m").alias(name))
    return df.withColumns(keys).join(right, list(keys), "left").drop(*keys)


def lookup_dnat(df: DataFrame, nat: DataFrame) -> DataFrame:
    """Translated destination of a connection; ("", -1) when there is none or only the source is translated."""
    keys = [c for c in ("src_ip", "src_port", "dst_ip", "dst_port", "transport") if c in nat.columns and c in df.columns]
    table = nat.groupBy(*keys).agg(F.min(F.struct("dnat_ip", "dnat_port")).alias("__m"))
    hit = _attach(df, table, {k: F.col(k) for k in keys}, "__nat")
    real = F.col("__nat").isNotNull() & ~((F.col("__nat.dnat_ip") == F.col("dst_ip")) & (F.col("__nat.dnat_port") == F.col("dst_port")))
    return hit.withColumns({"dnat_ip": F.when(real, F.col("__nat.dnat_ip")).otherwise(""),
                            "dnat_port": F.when(real, F.col("__nat.dnat_port").cast("long")).otherwise(F.lit(-1).cast("long"))}).drop("__nat")


class Cluster:
    """The lookup tables of a cluster.

    ``containers``: container_id, container, pod columns. ``ports``: ip, port (0 = undeclared), host_network, container,
    pod columns. ``host_ports``: host_ip, host_port, port, container, pod columns. ``services``: ip, port, node_port
    (null unless the service listens on every node), namespace, service, workload columns. ``nodes``: ip, node.
    """

    def __init__(self, containers, ports, host_ports, services, nodes, local_node="", local_ip=""):
        self.containers, self.ports, self.host_ports = containers, ports, host_ports
        self.services, self.nodes = services, nodes
        self.local_node, self.local_ip = local_node, local_ip

    def staged(self, root: str) -> Cluster:
        """The same tables, written below ``root`` once and read from there."""
        def put(name: str, table: DataFrame) -> DataFrame:
            table.write.mode("overwrite").parquet(f"{root}/{name}")
            return table.sparkSession.read.schema(table.schema).parquet(f"{root}/{name}")
        names = ("containers", "ports", "host_ports", "services", "nodes")
        return Cluster(*[put(n, getattr(self, n)) for n in names], self.local_node, self.local_ip)

    def _addresses(self) -> DataFrame:
        """All that the port table says of an address, a row each: entries by port, the one for any other port, the pod.

        ``any``: the undeclared-port entry unless on the host network, else the lowest entry that is not. ``pod``: the latter.
        """
        keep = ["container", "container_id", *POD_COLS]
        free = F.when(~F.col("host_network"), F.struct("pod"))
        by_port = self.ports.where(F.col("ip").isNotNull()).groupBy("ip", "port").agg(
            F.min_by(F.struct(*keep), F.struct("pod")).alias("m"), F.min_by(F.struct(*keep), free).alias("free"))
        own, has = F.col("port") == 0, F.col("free").isNotNull()
        every = by_port.groupBy("ip").agg(
            F.map_from_entries(F.collect_list(F.when(F.col("port").isNotNull(), F.struct(F.col("port").cast("int"), "m")))).alias("exact"),
            F.max(own.cast("int")).alias("has_own"), F.min_by("free", F.when(own & has, 0)).alias("own"),
            F.min_by("free", F.when(has, F.struct("port"))).alias("pod"))
        any_ = F.when(F.col("has_own") == 1, F.col("own")).otherwise(F.col("pod"))
        return every.select("ip", F.struct("exact", any_.alias("any"), "pod").alias("__m"))

    def _places(self) -> DataFrame:
        """All that the tables say of an address in one row: what ``_addresses`` has, services and host ports by port, the node."""
        def by(table: DataFrame, ip: str, port: str, name: str) -> DataFrame:
            return table.where(F.col(ip).isNotNull() & F.col(port).isNotNull()).select(F.col(ip).alias("ip"), F.struct(F.col(port).cast("long"), "__m").alias(name))
        keep = ["namespace", "service", "workload_kind", "workload_name"]
        services = by(one_per_key(self.services, ["ip", "port"], ["namespace", "service"], keep), "ip", "port", "__s")
        hosts = by(one_per_key(self.host_ports, ["host_ip", "host_port"], ["pod"], ["container", "container_id", *POD_COLS, "port"]), "host_ip", "host_port", "__h")
        nodes = one_per_key(self.nodes, ["ip"], ["node"], ["node"]).where(F.col("ip").isNotNull()).select("ip", F.col("__m").alias("__n"))
        ports = self._addresses().select("ip", F.col("__m").alias("__p"))
        every = ports.unionByName(services, True).unionByName(hosts, True).unionByName(nodes, True).groupBy("ip").agg(
            F.first("__p", True).alias("ports"), F.map_from_entries(F.collect_list("__s")).alias("services"),
            F.map_from_entries(F.collect_list("__h")).alias("hosts"), F.first("__n", True).alias("node"))
        # The condition always holds: fields are then taken from the whole row, which is made once for all joins.
        return every.select("ip", F.when(F.length("ip") >= 0, F.struct("ports", "services", "hosts", "node")).alias("__m"))

    def join_place(self, df, ip: str, port: Column, names: dict[str, str]):
        """``join_service``, ``join_host_port``, ``join_node``, ``join_ip_port`` (container) and ``join_pod_ip`` in one join by the
        address in column ``ip``; ``names`` has the column for each of service, host, node, container and pod that is wanted.

        A service listens on a port of every node: the table by node port has a row per port number at most and is broadcast.
        """
        places = self._places().select(F.concat("ip", F.lit("")).alias(ip), F.col("__m").alias("__at"))
        at, out = F.col("__at"), df.join(places, ip, "left")
        made = {"container": F.coalesce(F.try_element_at(at["ports"]["exact"], port.cast("int")), at["ports"]["any"]), "pod": at["ports"]["pod"], "node": at["node"],
                "host": F.try_element_at(at["hosts"], port.cast("int").cast("long")), "service": F.try_element_at(at["services"], port.cast("int").cast("long"))}
        out = out.withColumns({names[k]: v for k, v in made.items() if k in names}).withColumn("__on", F.when(at["node"].isNotNull(), port.cast("int"))).drop("__at")
        if "service" in names:
            by_node = one_per_key(self.services.where(F.col("node_port").isNotNull()), ["node_port"], ["namespace", "service"], ["namespace", "service", "workload_kind", "workload_name"])
            out = out.join(F.broadcast(by_node.select(F.col("node_port").alias("__on"), F.col("__m").alias("__np"))), "__on", "left")
            out = out.withColumn(names["service"], F.coalesce(names["service"], "__np")).drop("__np")
        return out.drop("__on")

    def join_address(self, df, ip: Column, port: Column, container: str | None, pod: str | None = None):
        """``join_ip_port`` into ``container`` and ``join_pod_ip`` into ``pod`` in one join by the address."""
        out = _attach(df, self._addresses(), {"ip": ip}, "__at")
        made = {}
        if container:
            made[container] = F.coalesce(F.try_element_at(F.col("__at.exact"), port.cast("int")), F.col("__at.any"))
        if pod:
            made[pod] = F.col("__at.pod")
        return out.withColumns(made).drop("__at")

    def join_container(self, df, key: Column, name: str):
        keep = ["container", "container_id", *POD_COLS]
        table = one_per_key(self.containers, ["container_id"], ["pod"], keep)
        return _attach(df, table, {"container_id": key}, name)

    def join_ip_port(self, df, ip: Column, port: Column, name: str):
        """Exact port, else the undeclared-port entry unless on the host network, else the lowest other entry."""
        return self.join_address(df, ip, port, name)

    def join_pod_ip(self, df, ip: Column, name: str):
        pods = one_per_key(self.ports.where(~F.col("host_network")), ["ip"], ["port", "pod"], POD_COLS)
        return _attach(df, pods, {"ip": ip}, name)

    def join_service(self, df, ip: Column, port: Column, name: str):
        """Service by cluster address, or by node port when the address is a node's."""
        keep = ["namespace", "service", "workload_kind", "workload_name"]
        order = ["namespace", "service"]
        by_ip = one_per_key(self.services, ["ip", "port"], order, keep)
        by_node = one_per_key(self.services.where(F.col("node_port").isNotNull()), ["node_port"], order, keep)
        out = _attach(df, by_ip, {"ip": ip, "port": port.cast("int")}, "__svc")
        out = self.join_node(out, ip, "__node")
        on_node = F.when(F.col("__node").isNotNull(), port.cast("int"))
        out = _attach(out, by_node, {"node_port": on_node}, "__np")
        return out.withColumn(name, F.coalesce("__svc", "__np")).drop("__svc", "__node", "__np")

    def join_host_port(self, df, ip: Column, port: Column, name: str):
        keep = ["container", "container_id", *POD_COLS, "port"]
        table = one_per_key(self.host_ports, ["host_ip", "host_port"], ["pod"], keep)
        return _attach(df, table, {"host_ip": ip, "host_port": port.cast("int")}, name)

    def join_node(self, df, ip: Column, name: str):
        return _attach(df, one_per_key(self.nodes, ["ip"], ["node"], ["node"]), {"ip": ip}, name)


_OUT = ["node", "node_ip", "namespace", "workload_kind", "workload_name", "service", "pod", "container", "container_id", "ip", "port"]


def _resolve(df: DataFrame, name: str, base: dict[str, Column], steps: list[tuple[Column, dict[str, Column]]]) -> tuple[DataFrame, dict[str, Column]]:
    """Apply ordered (condition, assignments); a later step overwrites what an earlier one set.

    The conditions become columns of their own first: every output column tests them, and copies of them in each would
    make the generated code too large to be compiled.
    """
    tests = {f"__{name}{i}": F.coalesce(when, F.lit(False)) for i, (when, _) in enumerate(steps)}
    out = dict(base)
    for test, (_, values) in zip(tests, steps):
        for k, v in values.items():
            out[k] = F.when(F.col(test), v if k == "port" else F.coalesce(v, F.lit(""))).otherwise(out[k])
    return df.withColumns(tests), out


def _pod(m: Column, src: bool, current_ip: Column | None = None, service: bool = True) -> dict[str, Column]:
    values = {"node": m["node"], "node_ip": m["node_ip"], "namespace": m["namespace"], "workload_kind": m["workload_kind"],
              "workload_name": m["workload_name"], "pod": m["pod"]}
    if src:
        # The source address becomes the pod's and its service is kept when it has one.
        values["ip"] = m["ip"]
    elif current_ip is not None:
        values["ip"] = F.when(F.coalesce(current_ip, F.lit("")) == "", m["ip"]).otherwise(current_ip)
    return values


def _container(m: Column, src: bool, current_ip: Column | None = None) -> dict[str, Column]:
    return {"container": m["container"], "container_id": m["container_id"], **_pod(m, src, current_ip)}


def _empty(ip: Column, port: Column | None) -> dict[str, Column]:
    base = {c: F.lit("") for c in _OUT}
    base["ip"] = F.coalesce(ip, F.lit(""))
    base["port"] = port if port is not None else F.lit(None).cast("long")
    return base


def _emit(df: DataFrame, side: str, values: dict[str, Column]) -> dict[str, Column]:
    return {f"{side}_{k}": v for k, v in values.items() if not (k == "port" and side == "src")}


def _settle(df: DataFrame, side: str, values: dict[str, Column], keep: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Make a side's labels now, so that later joins move them and not all they were chosen from."""
    made = _emit(df, side, values)
    return df.select(*keep, *[v.alias(f"__o_{k}") for k, v in made.items()]), {k: F.col(f"__o_{k}") for k in made}


def _service(when, m):
    has = when & m.isNotNull() & (F.coalesce(m["service"], F.lit("")) != "")
    return has, {"service": m["service"]}


def enrich_client(df: DataFrame, cluster: Cluster) -> DataFrame:
    """Labels of both ends of a client-side record, by the client precedence."""
    keep = df.columns
    cid, sip = F.coalesce("container_id", F.lit("")), F.coalesce("src_ip", F.lit(""))
    dip0, dport = F.coalesce("dst_ip", F.lit("")), F.col("dst_port").cast("long")
    dip = F.when(dip0 == C.LOOPBACK, sip).otherwise(dip0)
    local = {"node": F.lit(cluster.local_node), "node_ip": F.lit(cluster.local_ip)}
    t = cluster.join_service(df, dip, dport, "__ds")
    t = cluster.join_node(t, F.nullif(F.col("dnat_ip"), F.lit("")), "__ddn")
    t = cluster.join_host_port(t, dip, dport, "__dh")
    t = cluster.join_node(t, dip, "__dn")
    svc, s = F.col("__ds").isNotNull(), F.col("__ds")
    translated = svc & (F.coalesce("dnat_ip", F.lit("")) != "") & (F.col("dnat_port") != -1)
    t = cluster.join_address(t, F.when(translated, F.col("dnat_ip")), F.col("dnat_port"), "__dd")
    t = cluster.join_address(t, dip, dport, "__dc")
    has = {n: F.col(n).isNotNull() for n in ("__dd", "__ddn", "__dc", "__dh", "__dn")}
    con = ~svc & has["__dc"]
    host = ~svc & ~has["__dc"] & has["__dh"]
    rest = ~svc & ~has["__dc"] & ~has["__dh"]
    t, dst = _resolve(t, "d", _empty(dip0, dport), [
        (dip0 == C.LOOPBACK, local),
        (svc, {"namespace": s["namespace"], "service": s["service"], "workload_kind": s["workload_kind"], "workload_name": s["workload_name"]}),
        (translated & has["__dd"], _container(F.col("__dd"), False, dip0)),
        (translated & ~has["__dd"] & has["__ddn"], {"node_ip": F.col("dnat_ip"), "node": F.col("__ddn.node")}),
        (con, _container(F.col("__dc"), False, dip0)),
        (host, {**_container(F.col("__dh"), False), "ip": F.col("__dh.ip"), "port": F.col("__dh.port").cast("long"),
                "service": F.concat(dip, F.lit(":"), dport.cast("string"))}),
        (rest & has["__dn"], {"node_ip": dip, "node": F.col("__dn.node"), "namespace": F.lit(C.INTERNAL)}),
        (rest & ~has["__dn"], {"namespace": F.lit(C.EXTERNAL)}),
    ])
    t, dst = _settle(t, "dst", dst, keep)
    t = cluster.join_container(t, F.nullif(cid, F.lit("")), "__sc")
    t = cluster.join_pod_ip(t, sip, "__sp")
    t = cluster.join_node(t, sip, "__sn")
    has = {n: F.col(n).isNotNull() for n in ("__sc", "__sp", "__sn")}
    by_id = cid != ""
    no_pod = ~by_id & ~has["__sp"]
    t, src = _resolve(t, "s", _empty(sip, None), [
        (by_id, {"container_id": cid}),
        (by_id & has["__sc"], _container(F.col("__sc"), True)), _service(by_id, F.col("__sc")),
        (by_id & ~has["__sc"], {**local, "namespace": F.lit(C.INTERNAL)}),
        (~by_id & (sip == C.LOOPBACK), local),
        (~by_id & has["__sp"], _pod(F.col("__sp"), True)), _service(~by_id, F.col("__sp")),
        (no_pod & has["__sn"], {"node": F.col("__sn.node"), "node_ip": sip, "namespace": F.lit(C.INTERNAL)}),
        (no_pod & ~has["__sn"], {"namespace": F.lit(C.EXTERNAL)}),
    ])
    new = {**_emit(t, "src", src), **dst}
    return t.select(*[c for c in keep if c not in new], *[v.alias(k) for k, v in new.items()])


def enrich_server(df: DataFrame, cluster: Cluster) -> DataFrame:
    """Labels of both ends of a server-side record."""
    keep = df.columns
    sip, cid = F.coalesce("src_ip", F.lit("")), F.coalesce("container_id", F.lit(""))
    t = cluster.join_pod_ip(df, sip, "__sp")
    t = cluster.join_node(t, sip, "__sn")
    t = cluster.join_container(t, F.nullif(cid, F.lit("")), "__dc")
    local = {"node": F.lit(cluster.local_node), "node_ip": F.lit(cluster.local_ip)}
    pod, node, con = F.col("__sp").isNotNull(), F.col("__sn").isNotNull(), F.col("__dc").isNotNull()
    t, src = _resolve(t, "s", _empty(sip, None), [
        (sip == C.LOOPBACK, local), (pod, _pod(F.col("__sp"), True)), _service(pod, F.col("__sp")),
        (~pod & node, {"node": F.col("__sn.node"), "node_ip": sip, "namespace": F.lit(C.INTERNAL)}),
        (~pod & ~node, {"namespace": F.lit(C.EXTERNAL)})])
    dip = F.coalesce("dst_ip", F.lit(""))
    t, dst = _resolve(t, "d", _empty(dip, F.col("dst_port").cast("long")), [
        (F.lit(True), {"container_id": cid}), (con, _container(F.col("__dc"), False, dip)), _service(con, F.col("__dc")),
        (~con, {**local, "namespace": F.lit(C.INTERNAL)})])
    new = {**_emit(t, "src", src), **_emit(t, "dst", dst)}
    return t.select(*[c for c in keep if c not in new], *[v.alias(k) for k, v in new.items()])


def enrich_tcp(df: DataFrame, cluster: Cluster) -> DataFrame:
    """Labels of both ends of a TCP metric by address, then the translation and port pruning.

    A host-port hit does not stop the search: the pod and node steps after it can overwrite what it set. Records move once per
    end, those of a translated service once more.
    """
    from skeinwork.operators.relabel import apply_dnat, prune_ports
    keep = df.columns
    sip, dip = F.col("__sip"), F.col("__dip")
    sport, dport = F.col("src_port").cast("long"), F.col("dst_port").cast("long")
    t = df.withColumns({"__sip": F.coalesce("src_ip", F.lit("")), "__dip": F.coalesce("dst_ip", F.lit(""))})
    t = cluster.join_place(t, "__dip", dport, {"service": "__ds", "host": "__dh", "node": "__dn", "container": "__dc", "pod": "__dp"})
    svc, s = F.col("__ds").isNotNull(), F.col("__ds")
    translated = F.coalesce(svc & (F.coalesce("dnat_ip", F.lit("")) != "") & (F.col("dnat_port") != -1), F.lit(False))
    of_service = {"namespace": s["namespace"], "service": s["service"], "workload_kind": s["workload_kind"], "workload_name": s["workload_name"]}
    h = {n: F.col(n).isNotNull() for n in ("__dd", "__dc", "__dh", "__dp", "__dn")}
    later = ~svc & ~h["__dc"]
    host = later & h["__dh"]
    cur_ip = F.when(host, F.col("__dh.ip")).otherwise(dip)
    keep_dst = [*keep, "__sip"]
    there = cluster.join_address(t.where(translated), F.col("dnat_ip"), F.col("dnat_port"), "__dd")
    there, dst = _resolve(there, "d", _empty(dip, dport), [(svc, of_service), (h["__dd"], _container(F.col("__dd"), False, dip))])
    there, _ = _settle(there, "dst", dst, keep_dst)
    # The pod and node steps search with the address the record came with.
    here, dst = _resolve(t.where(~translated), "d", _empty(dip, dport), [
        (svc, of_service),
        (~svc & h["__dc"], _container(F.col("__dc"), False, dip)),
        (host, {**_container(F.col("__dh"), False), "ip": F.col("__dh.ip"), "port": F.col("__dh.port").cast("long"),
                "service": F.concat(dip, F.lit(":"), dport.cast("string"))}),
        (later & h["__dp"], _pod(F.col("__dp"), False, cur_ip)),
        (later & ~h["__dp"] & h["__dn"], {"namespace": F.lit(C.INTERNAL)}),
        (later & ~h["__dp"] & ~h["__dn"], {"namespace": F.lit(C.EXTERNAL)})])
    here, dst = _settle(here, "dst", dst, keep_dst)
    # What is translated is known now and need not move with the record.
    t = here.unionByName(there).withColumns({"dst_ip": F.col("__o_dst_ip"), "dst_port": F.col("__o_dst_port")})
    t = apply_dnat(t).drop("__o_dst_ip", "__o_dst_port")
    dst = {k: F.col(k) if k in ("dst_ip", "dst_port") else v for k, v in dst.items()}
    t = cluster.join_place(t, "__sip", sport, {"node": "__sn", "container": "__sc", "pod": "__sp"})
    h = {n: F.col(n).isNotNull() for n in ("__sc", "__sp", "__sn")}
    t, src = _resolve(t, "s", _empty(sip, None), [
        (h["__sc"], _container(F.col("__sc"), True)), _service(h["__sc"], F.col("__sc")),
        (~h["__sc"] & h["__sp"], _pod(F.col("__sp"), True)), _service(~h["__sc"] & h["__sp"], F.col("__sp")),
        (~h["__sc"] & ~h["__sp"] & h["__sn"], {"namespace": F.lit(C.INTERNAL)}),
        (~h["__sc"] & ~h["__sp"] & ~h["__sn"], {"namespace": F.lit(C.EXTERNAL)})])
    new = {**_emit(t, "src", src), **dst}
    return prune_ports(t.select(*[c for c in keep if c not in new and c not in ("dnat_ip", "dnat_port")], *[v.alias(k) for k, v in new.items()]))


def match_services(labels: DataFrame, selectors: DataFrame) -> DataFrame:
    """(namespace, pod, service): pods whose labels contain every pair of a service's selector, smallest name first.

    A selector row (namespace, service, k, v) joins labels on all three values; a pod matches when it met all pairs.
    A service without selector has no rows and never matches.
    """
    size = selectors.groupBy("namespace", "service").agg(F.countDistinct("k", "v").alias("need"))
    met = (labels.select("namespace", "pod", "k", "v").distinct().join(selectors.select("namespace", "service", "k", "v").distinct(),
                                                                      ["namespace", "k", "v"])
           .groupBy("namespace", "service", "pod").agg(F.count("*").alias("met")))
    full = met.join(size, ["namespace", "service"]).where(F.col("met") == F.col("need"))
    return full.groupBy("namespace", "pod").agg(F.min("service").alias("service"))


def resolve_workload(pods: DataFrame, replicasets: DataFrame) -> DataFrame:
    """Pods (owner_kind, owner_name, owner_api) -> workload; a replica set stands for its own owner."""
    rs = replicasets.groupBy("namespace", "name").agg(F.min(F.struct("owner_kind", "owner_name", "owner_api")).alias("__rs"))
    rs = rs.select(F.col("namespace"), F.col("name").alias("owner_name"), "__rs")
    is_rs = F.col("owner_kind") == "ReplicaSet"
    hit = pods.join(rs.withColumn("owner_kind", F.lit("ReplicaSet")), ["namespace", "owner_kind", "owner_name"], "left")
    found = is_rs & F.col("__rs").isNotNull()
    kind = (F.when(found, text.workload_kind("__rs.owner_api", "__rs.owner_kind")).when(is_rs, "deployment")
            .otherwise(text.workload_kind("owner_api", "owner_kind")))
    name = (F.when(found, F.col("__rs.owner_name")).when(is_rs, text.deployment_name("owner_name")).otherwise(F.col("owner_name")))
    return hit.withColumns({"workload_kind": F.coalesce(kind, F.lit("")), "workload_name": F.coalesce(name, F.lit(""))}).drop("__rs")


def metadata_asof(records: DataFrame, validity: DataFrame, keys: list[str], values: list[str], ts: str = "ts_ns",
                  grace_ns: int = C.METADATA_GRACE_S * 1_000_000_000, slice_ns: int = 3600 * 1_000_000_000, slice_rows: int | None = None) -> DataFrame:
    """Metadata that was current at a record's time.

    The newest entry of a key replaces older ones at its ``valid_from``; it is gone ``grace`` after its ``valid_to``
    (null = still there). Keys of very many rows are cut by ``slice_ns``; ``slice_rows`` also bounds the rows of a slice
    (bursts; counts the rows first).
    """
    table = validity.select(*keys, "valid_from", F.col("valid_to").alias("__valid_to"), *[F.col(v).alias(f"__m_{v}") for v in values])
    hit = scan.asof_join(records, table, keys, ts, "valid_from", ["valid_from", "__valid_to", *[f"__m_{v}" for v in values]], slice_ns, slice_rows=slice_rows)
    alive = F.col("valid_from").isNotNull() & (F.col("__valid_to").isNull() | (F.col(ts) <= F.col("__valid_to") + grace_ns))
    return hit.select(*records.columns, *[F.when(alive, F.col(f"__m_{v}")).alias(v) for v in values])
