"""Labels: selection, renaming per side, address replacement, port pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork import constants as C


def label(df: DataFrame, name: str) -> Column:
    """Typed read of a label: a missing column or a null reads as "", 0 or false."""
    default = F.lit(0).cast("long") if name in C.INT_LABELS else F.lit(False) if name in C.BOOL_LABELS else F.lit("")
    if name not in df.columns:
        return default.alias(name)
    value = F.col(name).cast("long") if name in C.INT_LABELS else F.col(name)
    return F.coalesce(value, default).alias(name)


def select_labels(df: DataFrame, names: list[str], *keep: str) -> DataFrame:
    return df.select(*[label(df, n) for n in names], *keep)


def const_labels(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in labels.items()})


def prune_ports(df: DataFrame, lowest_dynamic: int = 32768) -> DataFrame:
    """Null the port that is likely dynamic: the larger of two low ones (dst on a tie), else each high one."""
    s, d = F.col("src_port"), F.col("dst_port")
    both_low = (s < lowest_dynamic) & (d < lowest_dynamic)
    return df.withColumns({
        "src_port": F.when(both_low & (s > d), None).when(~both_low & (s >= lowest_dynamic), None).otherwise(s),
        "dst_port": F.when(both_low & (s <= d), None).when(~both_low & (d >= lowest_dynamic), None).otherwise(d),
    })


def apply_dnat(df: DataFrame, form: str = "tcp") -> DataFrame:
    """Replace the destination by its translation.

    ``tcp``: ip if given, port if positive, then drop the translation. ``detail``: only when both are valid.
    """
    ip, port = F.coalesce("dnat_ip", F.lit("")), F.coalesce("dnat_port", F.lit(0))
    if form == "tcp":
        return df.withColumns({
            "dst_ip": F.when(ip != "", ip).otherwise(F.col("dst_ip")),
            "dst_port": F.when(port > 0, port).otherwise(F.col("dst_port")),
        }).drop("dnat_ip", "dnat_port")
    valid = (ip != "") & (port >= 1)
    return df.withColumns({"dst_ip": F.when(valid, ip).otherwise(F.col("dst_ip")),
                           "dst_port": F.when(valid, port).otherwise(F.col("dst_port"))})


def hide_dst_pod(df: DataFrame) -> DataFrame:
    known = ~F.col("dst_namespace").isin(C.EXTERNAL, C.INTERNAL)
    cols = [c for c in ("dst_node", "dst_pod") if c in df.columns]
    return df.withColumns({c: F.when(known, "").otherwise(F.col(c)) for c in cols})


def _text(df, name):
    return label(df, name).cast("string")


def response_code(df: DataFrame) -> Column:
    """Response content of a record as text, by protocol."""
    p = F.col("protocol")
    return (F.when(p.isin("http", "grpc"), _text(df, "http_status_code")).when(p == "mysql", _text(df, "sql_error_code"))
            .when(p == "dns", _text(df, "dns_rcode"))
            .when(p == "dubbo", F.coalesce(F.col("dubbo_error_code"), F.lit(0)).cast("string")
                  if "dubbo_error_code" in df.columns else F.lit("0"))
            .when(p == "rocketmq", _text(df, "rocketmq_error_code")))


def _failed(df):
    return label(df, "error_type") == C.PROTOCOL_ERROR


def relabel_entity(df: DataFrame, detail: bool = False, keep: list[str] = ()) -> DataFrame:
    """Server records as labels of the serving workload."""
    p = F.col("protocol")
    request = (F.when(p == "kafka", label(df, "kafka_topic")).when(p == "dns", label(df, "dns_domain"))
               .when(p.isin("http", "mysql", "grpc", "dubbo", "redis", "rocketmq"), label(df, "content_key")).otherwise(""))
    response = F.when(p == "redis", F.when(_failed(df), "error").otherwise("noerror")).otherwise(
        F.coalesce(response_code(df), F.lit("")))
    out = [label(df, "dst_namespace").alias("namespace"), label(df, "dst_workload_kind").alias("workload_kind"),
           label(df, "dst_workload_name").alias("workload_name"), label(df, "dst_service").alias("service"), p]
    if detail:
        out += [label(df, "dst_ip").alias("ip"), label(df, "dst_port").alias("port"), label(df, "dst_node").alias("node"),
                label(df, "dst_pod").alias("pod"), label(df, "dst_container").alias("container"),
                label(df, "dst_container_id").alias("container_id")]
    return df.select(*out, request.alias("request_content"), response.alias("response_content"), *keep)


TOPOLOGY_BASE = ["src_namespace", "src_workload_kind", "src_workload_name", "src_service", "dst_namespace",
                 "dst_workload_kind", "dst_workload_name", "dst_service", "dst_node", "dst_pod"]
TOPOLOGY_DETAIL = ["src_ip", "dst_ip", "dst_port", "src_container_id", "src_container", "dst_container_id",
                   "dst_container", "src_node", "src_pod"]


def relabel_topology(df: DataFrame, detail: bool = False, keep: list[str] = ()) -> DataFrame:
    """Client records as labels of an edge with a status code."""
    p = F.col("protocol")
    status = F.when(p == "redis", F.when(_failed(df), "1").otherwise("0")).otherwise(
        F.coalesce(response_code(df), F.lit("")))
    src = apply_dnat(df, "detail") if detail else hide_dst_pod(df)
    names = TOPOLOGY_BASE + (TOPOLOGY_DETAIL if detail else [])
    return src.select(*[label(src, n) for n in names], "protocol", status.alias("status_code"), *keep)


def metric_name(metric: str, is_server: bool, prefix: str = "") -> str:
    """Exported name of a request metric; empty for an unknown one."""
    names = C.ENTITY_METRICS if is_server else C.TOPOLOGY_METRICS
    if metric not in names:
        return ""
    return f"{prefix}{'entity' if is_server else 'topology'}_request_{names[metric]}"


def metric_names(metric: Column, is_server: Column, prefix: str = "") -> Column:
    from skeinwork.operators.events import const_map
    entity = {m: metric_name(m, True, prefix) for m in C.ENTITY_METRICS}
    topology = {m: metric_name(m, False, prefix) for m in C.TOPOLOGY_METRICS}
    return F.coalesce(F.when(is_server, const_map(entity, metric)).otherwise(const_map(topology, metric)), F.lit(""))
