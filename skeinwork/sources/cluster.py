"""Cluster objects (JSON snapshots) -> metadata tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork import schema
from skeinwork.functions import text
from skeinwork.operators import metadata


def read_objects(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema({"pods": schema.POD, "services": schema.SERVICE, "nodes": schema.NODE, "replicasets": schema.REPLICASET}[kind]).json(path)


def node_addresses(nodes: DataFrame) -> DataFrame:
    """One row per node and internal address."""
    return nodes.select(F.col("name").alias("node"), F.explode("addresses").alias("a")).where("a.type = 'InternalIP'").select("node", F.col("a.address").alias("ip"))


def replicaset_owners(replicasets: DataFrame) -> DataFrame:
    owner = F.get(F.filter("owners", lambda o: o["controller"]), F.lit(0))
    return (replicasets.select("namespace", "name", owner.alias("o")).where(F.col("o").isNotNull())
            .select("namespace", "name", F.col("o.kind").alias("owner_kind"), F.col("o.name").alias("owner_name"), F.col("o.api_version").alias("owner_api")))


def pod_info(pods: DataFrame, replicasets: DataFrame, services: DataFrame) -> DataFrame:
    """Pods with workload and first matching service."""
    owner = F.get(F.filter("owners", lambda o: o["controller"]), F.lit(0))
    owned = pods.withColumns({"owner_kind": owner["kind"], "owner_name": owner["name"], "owner_api": owner["api_version"]})
    named = metadata.resolve_workload(owned, replicaset_owners(replicasets))
    labels = pods.select("namespace", F.col("name").alias("pod"), F.explode("labels").alias("k", "v"))
    selectors = services.select("namespace", F.col("name").alias("service"), F.explode("selector").alias("k", "v"))
    matched = metadata.match_services(labels, selectors)
    return (named.withColumnRenamed("name", "pod").join(matched, ["namespace", "pod"], "left")
            .withColumn("service", F.coalesce("service", F.lit(""))).withColumnRenamed("host_ip", "node_ip"))


_POD = ["pod", "namespace", "node", "node_ip", "ip", "workload_kind", "workload_name", "service", "host_network"]


def containers(info: DataFrame) -> DataFrame:
    """One row per container id (12 characters)."""
    return (info.select(*_POD, F.inline("statuses")).withColumn("container_id", text.short_container_id("container_id"))
            .where(F.col("container_id") != "").withColumnRenamed("name", "container"))


def _port_rows(info: DataFrame) -> DataFrame:
    n = F.size("containers")
    each = info.where(F.coalesce("ip", F.lit("")) != "").select(*_POD, n.alias("__n"), F.explode("containers").alias("c"))
    return each.select(*_POD, "__n", F.col("c.name").alias("container"), F.lit("").alias("container_id"), F.size("c.ports").alias("__p"),
                       F.explode_outer("c.ports").alias("p"))


def ports(info: DataFrame) -> DataFrame:
    """One row per pod ip and port; a container without ports takes port 0, without a name when it is not alone."""
    r = _port_rows(info)
    undeclared = F.col("p").isNull()
    name = F.when(undeclared & (F.col("__n") > 1), "").otherwise(F.col("container"))
    return r.withColumns({"container": name, "port": F.when(undeclared, 0).otherwise(F.col("p.container_port"))}).drop("__n", "__p", "p")


def host_ports(info: DataFrame) -> DataFrame:
    r = _port_rows(info).where(F.coalesce(F.col("p.host_port"), F.lit(0)) != 0)
    return r.withColumns({"host_ip": F.col("node_ip"), "host_port": F.col("p.host_port"), "port": F.col("p.container_port")}).drop("__n", "__p", "p")


def service_ports(services: DataFrame, info: DataFrame) -> DataFrame:
    """One row per service and port; headless services have none. The workload is that of the service's pods."""
    owner = info.where("service <> ''").groupBy("namespace", "service").agg(F.min(F.struct("workload_kind", "workload_name")).alias("w"))
    s = services.where(~F.coalesce("cluster_ip", F.lit("")).isin("", "None")).select(
        "namespace", F.col("name").alias("service"), F.col("cluster_ip").alias("ip"), "type", F.inline("ports"))
    s = s.withColumn("node_port", F.when(F.col("type") == "NodePort", F.col("node_port"))).drop("type")
    return s.join(owner, ["namespace", "service"], "left").select("namespace", "service", "ip", "port", "node_port",
                                                                  F.coalesce("w.workload_kind", F.lit("")).alias("workload_kind"),
                                                                  F.coalesce("w.workload_name", F.lit("")).alias("workload_name"))


def scan_cluster_snapshot(spark: SparkSession, paths: dict[str, str], local_node: str = "", local_ip: str = "") -> metadata.Cluster:
    """Lookup tables from JSON snapshots of pods, services, nodes and replica sets."""
    raw = {k: read_objects(spark, p, k) for k, p in paths.items()}
    info = pod_info(raw["pods"], raw["replicasets"], raw["services"])
    return metadata.Cluster(containers(info), ports(info), host_ports(info), service_ports(raw["services"], info), node_addresses(raw["nodes"]),
                            local_node, local_ip)
