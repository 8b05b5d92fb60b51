"""Aggregation kinds, histograms and the pre-aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from skeinwork import constants as C
from skeinwork.functions import registry
from skeinwork.operators import relabel


def agg_histogram(value: Column, bounds: list[int]) -> Column:
    """Cumulative histogram with explicit bounds and no overflow bucket."""
    buckets = F.array(*[F.count(F.when(value <= b, 1)) for b in bounds])
    return F.struct(F.sum(value).cast("long").alias("sum"), F.count(value).alias("count"),
                    F.array(*[F.lit(b).cast("long") for b in bounds]).alias("bounds"), buckets.alias("buckets"))


registry.register_agg_kind("histogram", lambda v, order=None: agg_histogram(v, C.TIME_BOUNDS))


def merge_histograms(df: DataFrame, keys: list[str], hist: str, n_bounds: int) -> DataFrame:
    """Add up histograms per group element by element; histograms of one group with different bounds are an error."""
    h = F.col(hist)
    bad = F.raise_error(F.lit("histograms with different bounds can not be merged")).cast("long")
    part = F.when(F.size(h["bounds"]) == n_bounds, h["count"]).otherwise(bad)
    low, high = F.min(h["bounds"]), F.max(h["bounds"])
    same = F.when(low.eqNullSafe(high), low).otherwise(F.raise_error(F.lit("histograms with different bounds can not be merged")).cast("array<long>"))
    sums = [F.sum(F.get(h["buckets"], F.lit(i))).cast("long") for i in range(n_bounds)]
    merged = F.struct(F.sum(h["sum"]).cast("long").alias("sum"), F.sum(part).cast("long").alias("count"),
                      same.alias("bounds"), F.array(*sums).alias("buckets"))
    return df.groupBy(*keys).agg(merged.alias(hist))


def agg_exprs(columns: list[str], config: dict, order: Column) -> list[Column]:
    """Aggregates for the metrics that are both configured and present."""
    out = []
    for metric, kinds in config.items():
        if metric not in columns:
            continue
        for kind, *name in kinds:
            out.append(registry.agg_kind(kind)(F.col(metric), order).alias(name[0] if name else metric))
    return out


_SEPARATOR, _ESCAPE = "\x1f", "\x1e"
_NULL = f"{_ESCAPE}2"


def group_packed(df: DataFrame, keys: list[str], aggs: list[Column], least: int = 6) -> DataFrame:
    """``df.groupBy(*keys).agg(*aggs)`` for wide label sets: the text and integer keys are shuffled as one text.

    A row of twenty text columns is mostly offsets and padding; one text takes half the shuffle. Separators inside values are
    escaped and null has a mark of its own, so each label set has its own text. Keys of other types (booleans, which filters
    reach through the aggregation) stay columns; so do all when there are fewer than ``least`` to pack.
    """
    types = {f.name: f.dataType for f in df.select(*keys).schema}
    packed = [k for k in types if isinstance(types[k], (StringType, IntegralType))]
    if len(packed) < least:
        return df.groupBy(*keys).agg(*aggs)

    def escaped(value):
        return F.replace(F.replace(value, F.lit(_ESCAPE), F.lit(f"{_ESCAPE}0")), F.lit(_SEPARATOR), F.lit(f"{_ESCAPE}1"))

    def plain(part):
        value = F.replace(F.replace(part, F.lit(f"{_ESCAPE}1"), F.lit(_SEPARATOR)), F.lit(f"{_ESCAPE}0"), F.lit(_ESCAPE))
        return F.when(part != _NULL, value)

    # Lambdas over one array, not an expression per label: code of some thousand instructions in one method is not compiled.
    values = F.array(*[F.col(k).cast("string") for k in packed])
    key = F.array_join(F.transform(values, escaped), _SEPARATOR, _NULL).alias("__key")
    grouped = df.groupBy(key, *[k for k in types if k not in packed]).agg(*aggs)
    # A generator, since a projection would be merged with those behind it and split the text for every label again.
    parts = F.split("__key", _SEPARATOR)
    parts = F.when(F.contains("__key", F.lit(_ESCAPE)), F.transform(parts, plain)).otherwise(parts)
    grouped = grouped.select("*", F.explode(F.array(parts)).alias("__parts"))
    made = [c for c in grouped.columns if c not in types and c not in ("__key", "__parts")]
    return grouped.select(*[F.get("__parts", F.lit(packed.index(k))).cast(types[k]).alias(k) if k in packed else k for k in types], *made)


def agg_config(df: DataFrame, keys: list[str], config: dict, order: list[str] = ("ts_ns",)) -> DataFrame:
    return group_packed(df, keys, agg_exprs(df.columns, config, F.struct(*order)))


def agg_all_labels(long: DataFrame, config: dict | None = None) -> DataFrame:
    """Group (labels map, metric, value, ts_ns) by the whole label map; unconfigured metrics are summed."""
    key = F.array_sort(F.map_entries("labels")).alias("label_key")
    config = config or {}
    order = F.struct("ts_ns", "value")
    value = F.col("value")
    keyed = long.select(key, "metric", "value", "ts_ns")
    kinds = sorted({k for ks in config.values() for k, *_ in ks} | {"sum"})
    grouped = keyed.groupBy("label_key", "metric").agg(
        *[registry.agg_kind(k)(value, order).alias(f"__{k}") for k in kinds], F.max("ts_ns").alias("ts_ns"))
    rules = []
    for metric, ks in config.items():
        for kind, *name in ks:
            rules.append((metric, kind, name[0] if name else metric))
    default = ~F.col("metric").isin(list(config)) if config else F.lit(True)
    outs = F.array_compact(F.array(
        F.when(default, F.struct(F.col("metric").alias("metric"), F.col("__sum").alias("value"))),
        *[F.when(F.col("metric") == m, F.struct(F.lit(o).alias("metric"), F.col(f"__{k}").alias("value")))
          for m, k, o in rules]))
    return grouped.select(F.map_from_entries("label_key").alias("labels"), F.inline(outs), "ts_ns")


def agg_net_requests(records: DataFrame, config=None) -> DataFrame:
    """Pre-aggregate request records by the 37 request labels."""
    config = config or C.NET_AGG
    metrics = [m for m in config if m in records.columns]
    sel = relabel.select_labels(records, C.NET_LABELS, "ts_ns", *metrics)
    return agg_config(sel, C.NET_LABELS, config)


def agg_tcp(records: DataFrame, config=None) -> DataFrame:
    config = config or C.TCP_AGG
    metrics = [m for m in config if m in records.columns]
    sel = relabel.select_labels(records, C.TCP_LABELS, "ts_ns", "seq", *metrics)
    return agg_config(sel, C.TCP_LABELS, config, ["ts_ns", "seq"])


def agg_tcp_connect(records: DataFrame, config=None) -> DataFrame:
    config = config or C.CONNECT_AGG
    metrics = [m for m in config if m in records.columns]
    sel = relabel.select_labels(records, C.TCP_CONNECT_LABELS, "ts_ns", *metrics)
    return agg_config(sel, C.TCP_CONNECT_LABELS, config)


def tcp_metrics(events: DataFrame, nat: DataFrame | None = None) -> DataFrame:
    """TCP events -> one metric row each, labelled by the connection and its translation."""
    from skeinwork.operators import metadata
    e = events.where(F.col("src_ip").isNotNull() & F.col("src_port").isNotNull()
                     & F.col("dst_ip").isNotNull() & F.col("dst_port").isNotNull())
    name = F.col("name")
    metric = (F.when(name.isin("tcp_close", "tcp_rcv_established"), "srtt_microseconds")
              .when(name == "tcp_retransmit_skb", "retransmit_total").when(name == "tcp_drop", "packet_loss_total"))
    value = (F.when(metric == "srtt_microseconds", F.col("rtt"))
             .when(metric == "retransmit_total", F.coalesce("segs", F.lit(1)).cast("long")).otherwise(F.lit(1)))
    out = (e.withColumns({"metric": metric, "value": value.cast("long")})
           .where(F.col("metric").isNotNull() & ~((F.col("metric") == "srtt_microseconds") & (F.coalesce("value", F.lit(0)) == 0))))
    if nat is not None:
        out = metadata.lookup_dnat(out, nat)
    return out


def node_traffic(records: DataFrame) -> DataFrame:
    """Bytes between nodes: a request goes src -> dst, its response dst -> src."""
    both = records.where((F.coalesce("src_node_ip", F.lit("")) != "") & (F.coalesce("dst_node_ip", F.lit("")) != ""))
    role = F.when(F.col("is_server"), "server").otherwise("client")

    def leg(a, b, value):
        return F.struct(F.col(f"{a}_node_ip").alias("src_node_ip"), F.coalesce(f"{a}_node", F.lit("")).alias("src_node"),
                        F.col(f"{b}_node_ip").alias("dst_node_ip"), F.coalesce(f"{b}_node", F.lit("")).alias("dst_node"),
                        F.col(value).alias("value"))

    legs = both.select(role.alias("role"), F.inline(F.array(leg("src", "dst", "request_io"), leg("dst", "src", "response_io"))))
    return (legs.where(F.col("value").isNotNull()).groupBy("src_node_ip", "src_node", "dst_node_ip", "dst_node", "role")
            .agg(F.sum("value").cast("long").alias("transmit_bytes_total")))


def workload_info(pods: DataFrame, node: str | None = None) -> DataFrame:
    local = pods if node is None else pods.where(F.col("node") == node)
    return local.select("namespace", "workload_kind", "workload_name").distinct().withColumn("value", F.lit(1).cast("long"))


def side_metrics(labelled: DataFrame, labels: list[str], is_server: bool) -> DataFrame:
    """Durations and bytes per label set, and counts per label set with ``is_slow``, as (labels, is_slow, metric, value).

    ``is_slow`` is null where it is not a label. The rows are aggregated once, by labels, with a count for each value of
    ``is_slow``; ``__seen`` tells which values a label set has, since a count may be null.
    """
    n = C.ENTITY_METRICS if is_server else C.TOPOLOGY_METRICS
    sums = ["request_total_time", "request_io", "response_io"]
    slow, kinds = F.col("is_slow"), [(True, 1), (False, 2), (None, 4)]
    bit = F.when(slow, 1).when(~slow, 2).otherwise(4)
    counts = [F.sum(F.when(bit == b, F.col("request_count"))).cast("long").alias(f"__n{b}") for _, b in kinds]
    fine = group_packed(labelled, labels, [*[F.sum(c).cast("long").alias(c) for c in sums], *counts, F.bit_or(bit).alias("__seen")])

    def part(value, metric, column):
        return F.struct(F.lit(value).cast("boolean").alias("is_slow"), F.lit(n[metric]).alias("metric"), F.col(column).alias("value"))

    parts = [part(None, c, c) for c in sums]
    parts += [F.when(F.col("__seen").bitwiseAND(b) != 0, part(value, "request_count", f"__n{b}")) for value, b in kinds]
    return fine.select(*labels, F.inline(F.array_compact(F.array(*parts))))


ENTITY_LABELS = ["namespace", "workload_kind", "workload_name", "service", "protocol", "request_content", "response_content"]
ENTITY_DETAIL = ["ip", "port", "node", "pod", "container", "container_id"]
_METRIC_COLS = ["is_slow", "request_total_time", "request_io", "response_io", "request_count"]


def entity_metrics(aggregated: DataFrame, detail: bool = False) -> DataFrame:
    server = relabel.relabel_entity(aggregated.where(F.col("is_server")), detail, _METRIC_COLS)
    labels = ENTITY_LABELS + (ENTITY_DETAIL if detail else [])
    return side_metrics(server, labels, True)


def topology_metrics(aggregated: DataFrame, detail: bool = False) -> DataFrame:
    client = relabel.relabel_topology(aggregated.where(~F.col("is_server")), detail, _METRIC_COLS)
    labels = relabel.TOPOLOGY_BASE + (relabel.TOPOLOGY_DETAIL if detail else []) + ["protocol", "status_code"]
    return side_metrics(client, labels, False)


def external_topology(aggregated: DataFrame) -> DataFrame:
    """Edges for server records whose caller is outside the cluster."""
    outside = aggregated.where(F.col("is_server") & (F.col("src_namespace") == C.EXTERNAL))
    edges = relabel.relabel_topology(outside, True, _METRIC_COLS)
    labels = relabel.TOPOLOGY_BASE + relabel.TOPOLOGY_DETAIL + ["protocol", "status_code"]
    return side_metrics(edges, labels, False)


def trace_as_metric(records: DataFrame, labels: list[str], order: list[str]) -> DataFrame:
    """Last total time per label set, with status bands of the phases as labels."""
    from skeinwork.operators.events import status_band
    banded = records.withColumns({
        "request_reqxfer_status": status_band(F.col("request_sent_time"), 200, 1000),
        "request_processing_status": status_band(F.col("waiting_ttfb_time"), 200, 1000),
        "response_rspxfer_status": status_band(F.col("content_download_time"), 200, 1000),
        "request_duration_status": status_band(F.col("request_total_time"), 800, 1500)})
    keys = labels + ["request_reqxfer_status", "request_processing_status", "response_rspxfer_status",
                     "request_duration_status", "is_server"]
    return banded.groupBy(*keys).agg(F.max_by("request_total_time", F.struct(*order)).alias("trace_request_duration_nanoseconds"))
