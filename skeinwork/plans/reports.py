"""Dashboard questions as compositions of series operators.

Each takes cumulative series with a ``day`` sample time; the evaluation step is one sample interval.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions import text
from skeinwork.operators import series

DNS_KEYS = ["src_namespace", "src_workload_name", "dst_ip", "status_code", "is_slow"]
NET_KEYS = ["src_workload_name", "dst_workload_name", "src_namespace"]
ENTITY_KEYS = ["namespace", "workload_name", "protocol", "response_content"]
DAYS_PER_SLICE = 3650


def growth(df: DataFrame, keys: list[str], values: dict[str, str], by: list[str]) -> DataFrame:
    """Sum of growth per output name by labels (and day, where it is in ``by``), all values in one pass."""
    cols = list(values.values())
    d = series.deltas(df.select(*keys, "day", *cols), keys, "day", cols, F.floor(F.col("day") / DAYS_PER_SLICE))
    return d.groupBy(*by).agg(*[F.sum(f"delta_{c}").cast("long").alias(n) for n, c in values.items()])


def dns_requests(s: DataFrame, namespace: str) -> DataFrame:
    return growth(s.where(F.col("src_namespace") == namespace), DNS_KEYS, {"requests": "total"}, ["dst_ip", "day"])


def dns_errors(s: DataFrame, namespace: str) -> DataFrame:
    return growth(s.where((F.col("src_namespace") == namespace) & (F.col("status_code") != "0")), DNS_KEYS, {"errors": "total"}, ["dst_ip", "day"])


def dns_latency(s: DataFrame, namespace: str) -> DataFrame:
    src = s.where(F.col("src_namespace") == namespace)
    g = growth(src, DNS_KEYS, {"d": "duration", "n": "total"}, ["dst_ip", "day"])
    return g.where(F.col("n") > 0).select("dst_ip", "day", (F.col("d").cast("double") / F.col("n").cast("double")).alias("latency"))


def dns_top(s: DataFrame, namespace: str, k: int = 10) -> DataFrame:
    return series.topk(dns_errors(s, namespace), k, "errors", ["dst_ip"], ["day"])


def dns_codes(s: DataFrame, namespace: str) -> DataFrame:
    src = s.where((F.col("src_namespace") == namespace) & (F.col("status_code") != "0"))
    g = growth(src, DNS_KEYS, {"errors": "total"}, ["status_code", "day"])
    return g.groupBy(text.dns_code_name("status_code").alias("status_code"), "day").agg(F.sum("errors").cast("long").alias("errors"))


def dns_slow(s: DataFrame, namespace: str) -> DataFrame:
    return growth(s.where((F.col("src_namespace") == namespace) & F.col("is_slow")), DNS_KEYS, {"slow": "total"}, ["dst_ip", "day"])


def dns_detail(traces: DataFrame, namespace: str) -> DataFrame:
    return traces.where((F.col("src_namespace") == namespace) & (F.col("protocol") == "dns"))


def net_total(s: DataFrame, *values: str) -> DataFrame:
    return growth(s, NET_KEYS, {v: v for v in values}, ["day"])


def rtt_top(s: DataFrame, k: int = 10) -> DataFrame:
    pairs = s.groupBy("src_workload_name", "dst_workload_name", "day").agg(F.sum("rtt_us").cast("long").alias("rtt_us"))
    return series.topk(pairs, k, "rtt_us", ["src_workload_name", "dst_workload_name"], ["day"])


def connections(s: DataFrame, traces: DataFrame) -> DataFrame:
    """One row per (src, dst) workload with traces: latency, growth of four counters and the last rtt sum."""
    pair = ["src_workload_name", "dst_workload_name"]
    latency = traces.groupBy(*pair).agg(F.sum("duration").cast("long").alias("latency"))
    grown = growth(s, NET_KEYS, {v: v for v in ("retransmit", "loss", "sent", "received")}, pair)
    rtt = s.groupBy(*NET_KEYS).agg(F.max_by("rtt_us", "day").alias("r")).groupBy(*pair).agg(F.sum("r").cast("long").alias("rtt_us"))
    return series.series_and(grown.join(rtt, pair), latency, pair).join(latency, pair)


def series_growth(s: DataFrame, value: str) -> DataFrame:
    return growth(s, NET_KEYS, {value: value}, NET_KEYS)


def entity_calls(s: DataFrame) -> DataFrame:
    return growth(s, ENTITY_KEYS, {"calls": "total"}, ["namespace", "workload_name"])


def entity_latency(s: DataFrame) -> DataFrame:
    g = growth(s, ENTITY_KEYS, {"d": "duration", "n": "total"}, ["namespace", "workload_name"])
    return g.where(F.col("n") > 0).select(
        "namespace", "workload_name", (F.col("d").cast("double") / F.col("n").cast("double")).alias("latency"))


def http_error_ratio(s: DataFrame) -> DataFrame:
    http = s.where(F.col("protocol") == "http")
    d = series.deltas(http.select(*ENTITY_KEYS, "day", "total"), ENTITY_KEYS, "day", "total", F.floor(F.col("day") / DAYS_PER_SLICE))
    bad = F.when(F.col("response_content").rlike("^(?:4..|5..)$"), F.col("delta"))
    out = d.groupBy("namespace", "workload_name").agg(F.coalesce(F.sum(bad), F.lit(0)).alias("b"), F.sum("delta").alias("n"))
    return out.where(F.col("n") > 0).select("namespace", "workload_name", (F.col("b").cast("double") / F.col("n").cast("double") * 100.0).alias("error_ratio"))
