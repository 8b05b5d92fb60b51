"""Service topology: nodes and edges with traffic, error and failure metrics.

Input samples are wide: the labels of an edge (or entity) and one column per metric, each row the latest value of one
series. ``edge_samples`` puts separately queried metrics into that form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork import constants as C

EDGE_METRICS = ["calls", "time_ns", "sent", "received", "rtt_us", "retransmit", "loss"]
NODE_METRICS = ["calls", "time_ns", "sent", "received"]


def edge_samples(frames: dict[str, DataFrame]) -> DataFrame:
    """Union of (labels..., value) frames, the value under its metric's name."""
    named = [df.withColumnRenamed("value", metric) for metric, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def is_error(protocol: Column, code: Column) -> Column:
    """Only http (>= 400) and dns (> 0) codes count as errors."""
    number = code.try_cast("int")
    return F.coalesce(F.when(protocol == "http", number >= 400).when(protocol == "dns", number > 0), F.lit(False))


def _sums(df: DataFrame, metrics: list[str], code: str) -> list[Column]:
    present = [m for m in metrics if m in df.columns]
    out = [F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) if m in present else F.lit(0).cast("long").alias(m) for m in metrics]
    failed = F.when(is_error(F.col("protocol"), F.col(code)), F.col("calls"))
    return out + [F.coalesce(F.sum(failed), F.lit(0)).cast("long").alias("errors")]


def finish(df: DataFrame, edge: bool = True) -> DataFrame:
    """Sums -> shown values: latency in ms, error rate in %, rtt in ms (a sum over series)."""
    out = {"latency": F.when(F.col("calls") == 0, 0.0).otherwise(F.col("time_ns").cast("double") / F.col("calls").cast("double") / 1000000.0),
           "error_rate": F.when(F.col("calls") == 0, 0.0).otherwise(F.col("errors").cast("double") / F.col("calls").cast("double") * 100.0)}
    if edge:
        out["rtt"] = F.col("rtt_us").cast("double") / 1000.0
    return df.withColumns(out).drop("time_ns", "errors", "rtt_us")


def error_rate(samples: DataFrame, keys: list[str], code: str = "status_code") -> DataFrame:
    return finish(samples.groupBy(*keys).agg(*_sums(samples, ["calls", "time_ns"], code)), edge=False).drop("latency")


# --- namespace graph ------------------------------------------------------------------------------------------

def _named(samples):
    return samples.where((F.coalesce("src_namespace", F.lit("")) != "") & (F.coalesce("dst_namespace", F.lit("")) != ""))


def _ns_type(ns: Column) -> Column:
    return F.when(ns.isin(C.EXTERNAL_NAMESPACES), "external").otherwise("namespace")


def namespace_nodes(samples: DataFrame, entities: DataFrame) -> DataFrame:
    t = _named(samples).select("src_namespace", "dst_namespace", "protocol", "dst_ip").distinct()
    dns = F.col("protocol") == "dns"
    ends = t.select(F.inline(F.array(
        F.struct(F.col("src_namespace").alias("id"), _ns_type(F.col("src_namespace")).alias("node_type")),
        F.struct(F.when(dns, F.col("dst_ip")).otherwise(F.col("dst_namespace")).alias("id"),
                 F.when(dns, "dns").otherwise(_ns_type(F.col("dst_namespace"))).alias("node_type")))))
    nodes = ends.groupBy("id").agg(F.min("node_type").alias("node_type"))
    sums = entities.groupBy(F.col("namespace").alias("id")).agg(*_sums(entities, NODE_METRICS, "response_content"))
    joined = nodes.join(sums, "id", "left").na.fill(0)
    plain = ["calls", "time_ns", "sent", "received", "errors"]
    hidden = joined.withColumns({m: F.when(F.col("node_type") != "external", F.col(m)) for m in plain})
    return finish(hidden, edge=False)


def namespace_edges(samples: DataFrame, order: str | None = None) -> DataFrame:
    """Edges between namespaces, or from a namespace to the address of a DNS server; self loops are left out."""
    t = _named(samples)
    m = [c for c in EDGE_METRICS if c in t.columns]
    part = t.groupBy("src_namespace", "dst_namespace", "dst_ip", "protocol", "status_code").agg(*[F.sum(c).alias(c) for c in m])
    # A namespace edge takes every row between its namespaces, a DNS edge every row to its address. A row counts for
    # both keys and makes one of them an edge, so edges and sums come out of one aggregation.
    dns = F.col("protocol") == "dns"
    keys = F.array(F.struct(F.lit(False).alias("dns_edge"), F.col("dst_namespace").alias("target"), (~dns).alias("__own")),
                   F.struct(F.lit(True).alias("dns_edge"), F.col("dst_ip").alias("target"), dns.alias("__own")))
    both = part.select(F.col("src_namespace").alias("source"), "protocol", "status_code", *m, F.inline(keys))
    sums = both.groupBy("source", "target", "dns_edge").agg(*_sums(both, EDGE_METRICS, "status_code"), F.max("__own").alias("__own"))
    return finish(sums.where(F.col("__own") & (F.col("source") != F.col("target"))).drop("__own"))


# --- workload and pod graph -----------------------------------------------------------------------------------

def _end(side: str, pods: bool) -> Column:
    """Node of one end: kind, namespace, name and shown type."""
    ns, ip = F.col(f"{side}_namespace"), F.col(f"{side}_ip")
    pod = F.coalesce(F.col(f"{side}_pod"), F.lit(""))
    kind = F.coalesce(F.col(f"{side}_workload_kind"), F.lit(""))

    def node(k, name, shown):
        return F.struct(F.lit(k).alias("kind"), ns.alias("namespace"), name.alias("name"), shown.alias("node_type"))

    bare = F.when(kind == "", node("unknow", F.col(f"{side}_workload_name"), F.lit("unknow"))).otherwise(
        node("workload", F.col(f"{side}_workload_name"), kind))
    inside = F.when(pod != "", node("pod", F.col(f"{side}_pod"), F.lit("pod"))).otherwise(bare) if pods else node(
        "workload", F.col(f"{side}_workload_name"), kind)
    return F.when(ns.isin(C.EXTERNAL_NAMESPACES), node("external", ip, F.lit("external"))).otherwise(inside)


def _candidates(side: str, pods: bool) -> Column:
    """Every node a row counts for: its pod, its workload, or its address when outside."""
    ns = F.col(f"{side}_namespace")
    pod = F.coalesce(F.col(f"{side}_pod"), F.lit(""))

    def key(k, name):
        return F.struct(F.lit(k).alias("kind"), ns.alias("namespace"), F.col(name).alias("name"))

    workload = key("workload", f"{side}_workload_name")
    if not pods:
        inside = F.array(workload)
    else:
        inside = F.when(pod != "", F.array(key("pod", f"{side}_pod"), workload)).otherwise(
            F.array(key("unknow", f"{side}_workload_name"), workload))
    return F.when(ns.isin(C.EXTERNAL_NAMESPACES), F.array(key("external", f"{side}_ip"))).otherwise(inside)


def _in_scope(namespace: str, workload: str | None = None) -> Column:
    def side(s):
        hit = F.col(f"{s}_namespace") == namespace
        return hit if workload is None else hit & (F.col(f"{s}_workload_name") == workload)
    return F.coalesce(side("dst") | side("src"), F.lit(False))


def in_scope(samples: DataFrame, namespace: str, workload: str | None = None) -> DataFrame:
    return samples.where(_in_scope(namespace, workload))


_LABELS = ["src_namespace", "src_workload_name", "src_workload_kind", "src_pod", "src_ip", "dst_namespace", "dst_workload_name",
           "dst_workload_kind", "dst_pod", "dst_ip", "dst_service"]


def external_ports(samples: DataFrame) -> DataFrame:
    """One row per outside (namespace, ip) with its ports joined in the name: ``ip:p1%p2``, ports sorted."""
    def side(s):
        port = F.col(f"{s}_port").cast("long") if f"{s}_port" in samples.columns else F.lit(None).cast("long")
        return samples.where(F.col(f"{s}_namespace").isin(C.EXTERNAL_NAMESPACES)).select(
            F.col(f"{s}_namespace").alias("namespace"), F.col(f"{s}_ip").alias("ip"), F.when(port > 0, port).alias("port"))
    # Distinct first: the number of ports of an address is bounded by 65535.
    seen = side("src").unionByName(side("dst")).distinct()
    ports = F.array_join(F.transform(F.array_sort(F.collect_set("port")), lambda p: p.cast("string")), "%")
    return (seen.groupBy("namespace", "ip").agg(ports.alias("ports"))
            .withColumn("name", F.when(F.col("ports") != "", F.concat("ip", F.lit(":"), "ports")).otherwise(F.col("ip"))))


def detail_edges(samples: DataFrame, namespace: str, workload: str | None = None, pods: bool = False, services: bool = False) -> DataFrame:
    """Edges between workloads (or pods) that touch a namespace or one workload; self calls are left out."""
    svc = F.when(F.col("dst_namespace").isin(C.EXTERNAL_NAMESPACES), "").otherwise(F.coalesce("dst_service", F.lit(""))) if services else F.lit("")
    m = [c for c in EDGE_METRICS if c in samples.columns]
    # All nodes that a row counts for are in its own namespaces, so a row outside the namespace counts for no edge that is shown.
    part = in_scope(samples, namespace).groupBy(*_LABELS, "protocol", "status_code").agg(*[F.sum(c).alias(c) for c in m])

    def bare(end):
        return F.struct(end["kind"].alias("kind"), end["namespace"].alias("namespace"), end["name"].alias("name"))

    # Each row counts for every node it belongs to and makes an edge of the one it is shown as, if it is in scope.
    part = part.withColumns({"__s": bare(_end("src", pods)), "__d": bare(_end("dst", pods)), "__svc": svc,
                             "__scope": _in_scope(namespace, workload)})
    lines = F.array_distinct(F.array(F.coalesce("dst_service", F.lit("")), F.lit(""))) if services else F.array(F.lit(""))
    part = part.withColumn("s", F.explode(_candidates("src", pods))).withColumn("d", F.explode(_candidates("dst", pods))).withColumn("service", F.explode(lines))
    own = F.col("__scope") & (F.col("s") == F.col("__s")) & (F.col("d") == F.col("__d")) & (F.col("service") == F.col("__svc"))
    ends = [F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in "sd" for c in ("kind", "namespace", "name")]
    part = part.select("protocol", "status_code", *m, "service", *ends, own.alias("__own"))
    key = ["s_kind", "s_namespace", "s_name", "d_kind", "d_namespace", "d_name", "service"]
    sums = part.groupBy(*key).agg(*_sums(part, EDGE_METRICS, "status_code"), F.max("__own").alias("__own"))
    loop = F.concat_ws("_", "s_namespace", "s_name") == F.concat_ws("_", "d_namespace", "d_name")
    return _named_external(finish(sums.where(F.col("__own") & ~loop).drop("__own")), samples)


def _named_external(edges: DataFrame, samples: DataFrame) -> DataFrame:
    """Edge ends as ids; outside ends carry their ports."""
    ports = external_ports(samples).select("namespace", "ip", "name")
    out = edges
    for e, side in (("s", "source"), ("d", "target")):
        p = ports.select(F.lit("external").alias(f"{e}_kind"), F.col("namespace").alias(f"{e}_namespace"), F.col("ip").alias(f"{e}_name"),
                         F.col("name").alias(f"{e}_shown"))
        out = out.join(p, [f"{e}_kind", f"{e}_namespace", f"{e}_name"], "left")
        out = out.withColumn(side, F.concat_ws("_", f"{e}_namespace", F.coalesce(f"{e}_shown", f"{e}_name")))
    return out.drop(*[f"{e}_{c}" for e in "sd" for c in ("kind", "namespace", "name", "shown")])


def detail_nodes(samples: DataFrame, entities: DataFrame, namespace: str, workload: str | None = None, pods: bool = False) -> DataFrame:
    scope = in_scope(samples, namespace, workload)
    ends = scope.groupBy(_end("src", pods).alias("s"), _end("dst", pods).alias("d")).agg(F.lit(1).alias("__x"))
    nodes = ends.select(F.explode(F.array("s", "d")).alias("n")).select("n.*").groupBy("kind", "namespace", "name").agg(F.min("node_type").alias("node_type"))
    pod = F.coalesce("pod", F.lit(""))

    def key(k, name):
        return F.struct(F.lit(k).alias("kind"), F.col("namespace"), F.col(name).alias("name"))

    ks = F.when(pod != "", F.array(key("pod", "pod"), key("workload", "workload_name"))).otherwise(
        F.array(key("unknow", "workload_name"), key("workload", "workload_name")))
    per = entities.withColumn("k", F.explode(ks)).select(F.col("k.kind"), F.col("k.namespace"), F.col("k.name"), "protocol", "response_content",
                                                         *[c for c in NODE_METRICS if c in entities.columns])
    sums = per.groupBy("kind", "namespace", "name").agg(*_sums(per, NODE_METRICS, "response_content"))
    joined = nodes.join(sums, ["kind", "namespace", "name"], "left").na.fill(0)
    joined = joined.withColumns({m: F.when(F.col("kind") != "external", F.col(m)) for m in NODE_METRICS + ["errors"]})
    shown = external_ports(samples).select(F.lit("external").alias("kind"), "namespace", F.col("ip").alias("name"), F.col("name").alias("__shown"))
    out = finish(joined, edge=False).join(shown, ["kind", "namespace", "name"], "left")
    return out.withColumn("name", F.coalesce("__shown", "name")).withColumns({
        "id": F.concat_ws("_", "namespace", "name"),
        "show_namespace": (F.col("kind") != "external") & (F.col("namespace") != namespace)}).drop("__shown", "kind")


# --- derived --------------------------------------------------------------------------------------------------

def conn_failures(connects: DataFrame, keys: list[str]) -> DataFrame:
    """Failed and all connects per edge and the failed share in %."""
    n = F.col("connects")
    out = connects.groupBy(*keys).agg(F.coalesce(F.sum(F.when(~F.col("success"), n)), F.lit(0)).cast("long").alias("failed"),
                                      F.sum(n).cast("long").alias("total"))
    return out.withColumn("conn_fail", F.when(F.col("failed") == 0, 0.0).otherwise(
        F.col("failed").cast("double") / F.col("total").cast("double") * 100.0))


def edge_status(value: Column, normal: float | None = None, abnormal: float | None = None) -> Column:
    """Class of a value: against two limits (strictly above), or above zero when there are none."""
    if normal is None:
        return F.when(value > 0, "abnormal").otherwise("normal")
    return F.when(value > abnormal, "abnormal").when(value > normal, "warning").otherwise("normal")


def volume_range(edges: DataFrame) -> DataFrame:
    return edges.agg(F.min("sent").alias("min_sent"), F.max("sent").alias("max_sent"), F.min("received").alias("min_received"),
                     F.max("received").alias("max_received"))


def volume_step(edges: DataFrame, column: str = "sent") -> DataFrame:
    """Volume class 0..5 relative to the largest edge; a single edge is 0. The maximum is one scalar, not a join."""
    top = edges.agg(F.max(column)).scalar().cast("double")
    n = edges.agg(F.count("*")).scalar()
    step = F.when((n == 1) | (top == 0), 0).otherwise(F.floor(F.col(column).cast("double") / (top / 5.0))).cast("int")
    return edges.withColumn("step", step)


def opposite_edge(edges: DataFrame, order: str = "first_seen") -> DataFrame:
    """Flag edges whose reverse appeared earlier."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), F.col(order).alias("__back"))
    out = edges.join(back, ["source", "target"], "left")
    return out.withColumn("opposite", F.coalesce(F.col("__back") < F.col(order), F.lit(False))).drop("__back")


def overlay(traffic: DataFrame, failures: DataFrame) -> DataFrame:
    """Traffic edges with the failure share of the same edge, plus the edges only the failures know."""
    f = failures.groupBy("source", "target").agg(F.max("conn_fail").alias("conn_fail"))
    return traffic.join(f, ["source", "target"], "full")


def overlay_nodes(nodes: DataFrame, traffic: DataFrame, failure_nodes: DataFrame, failures: DataFrame) -> DataFrame:
    """Nodes of the traffic graph plus the unknown ends of edges only the failures know."""
    new = failures.select("source", "target").distinct().join(traffic.select("source", "target"), ["source", "target"], "left_anti")
    ids = new.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    extra = failure_nodes.join(ids, "id", "left_semi").join(nodes.select("id"), "id", "left_anti")
    return nodes.unionByName(extra, allowMissingColumns=True)


def label_rollup(samples: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """The same sums at every prefix of the keys in one pass; keys that are rolled up are null."""
    out = samples.rollup(*keys).agg(*[F.sum(m).cast("long").alias(m) for m in metrics], F.grouping_id().alias("__g"))
    levels = {(1 << (len(keys) - i)) - 1: i for i in range(1, len(keys) + 1)}
    level = F.coalesce(*[F.when(F.col("__g") == g, F.lit(i)) for g, i in levels.items()])
    return out.withColumn("level", level).where(F.col("level").isNotNull()).drop("__g")


def options(samples: DataFrame) -> DataFrame:
    """Distinct (namespace, workload) over both ends; a namespace without workloads keeps a null one."""
    ends = samples.select(F.inline(F.array(
        F.struct(F.col("src_namespace").alias("namespace"), F.col("src_workload_name").alias("workload")),
        F.struct(F.col("dst_namespace").alias("namespace"), F.col("dst_workload_name").alias("workload")))))
    return ends.withColumn("workload", F.nullif("workload", F.lit(""))).distinct()


# --- spans ----------------------------------------------------------------------------------------------------

def span_edges(traces: DataFrame, key: str = "trace_id") -> DataFrame:
    """Edges between span groups: the parent is the group whose comma list holds the parent id, '0' is the root."""
    groups = traces.select(key, "span_ids").distinct()
    members = groups.select(key, F.explode(F.split("span_ids", ",")).alias("parent_id"), F.col("span_ids").alias("source"))
    owner = members.groupBy(key, "parent_id").agg(F.min("source").alias("source"))
    kids = traces.where(F.col("parent_id") != "0").select(key, "parent_id", F.col("span_ids").alias("target")).distinct()
    return kids.join(owner, [key, "parent_id"]).select(key, "source", "target").distinct()
