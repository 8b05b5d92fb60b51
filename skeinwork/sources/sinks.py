"""Exports: metric samples, search documents, spans, console."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions import text
from skeinwork.operators.relabel import label

# Metric column -> phase attribute of a span (fixed names).
PHASES = {"request_sent_time": "request_sent_ns", "waiting_ttfb_time": "waiting_ttfb_ns", "content_download_time": "content_download_ns",
          "request_total_time": "request_total_ns", "request_io": "requestio_bytes", "response_io": "responseio_bytes"}
# Span attribute -> label, per protocol (fixed names). The response payload of redis has a name of its own here.
SPAN_ATTRIBUTES = {
    "http": {"http.method": "http_method", "http.endpoint": "http_url", "http.status_code": "http_status_code", "http.trace_id": "trace_id",
             "http.trace_type": "trace_type", "http.request_headers": "request_payload", "http.request_body": None,
             "http.response_headers": "response_payload", "http.response_body": None},
    "kafka": {"request_payload": "request_payload", "response_payload": "response_payload"},
    "mysql": {"mysql.sql": "sql", "mysql.error_code": "sql_error_code", "mysql.error_msg": "sql_error_msg",
              "request_payload": "request_payload", "response_payload": "response_payload"},
    "dns": {"dns.domain": "dns_domain", "dns.rcode": "dns_rcode", "request_payload": "request_payload", "response_payload": "response_payload"},
    "dubbo": {"dubbo.request_body": "request_payload", "dubbo.response_body": "response_payload", "dubbo.error_code": "dubbo_error_code"},
    "redis": {"redis.command": "redis_command", "redis.error_msg": "redis_error_msg", "redis.request_payload": "request_payload",
              "redis.response_payload": "response_payload"},
    "rocketmq": {"rocketmq.request_msg": "rocketmq_request_msg", "rocketmq.error_msg": "rocketmq_error_msg",
                 "request_payload": "request_payload", "response_payload": "response_payload"},
}


def export_series(wide: DataFrame, labels: list[str], metrics: list[str], histograms: list[str] = (), ts: str = "ts_ns") -> DataFrame:
    """Long samples (name, labels, le, value, ts): one per metric, and count, sum and one per bucket of a histogram."""
    lab = F.create_map(*[x for c in labels for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))])

    def name(m, suffix=""):
        return text.sanitize_name(F.lit(m + suffix), skip_label=True)

    def sample(n, value, le=None):
        return F.struct(n.alias("name"), (F.lit(None).cast("long") if le is None else le).alias("le"), value.cast("long").alias("value"))

    rows = F.array(*[sample(name(m), F.col(m)) for m in metrics]) if metrics else None
    for h in histograms:
        c = F.col(h)
        buckets = F.transform(F.arrays_zip(c["bounds"].alias("b"), c["buckets"].alias("n")), lambda z: sample(name(h, "_bucket"), z["n"], z["b"]))
        part = F.concat(F.array(sample(name(h, "_count"), c["count"]), sample(name(h, "_sum"), c["sum"])), buckets)
        rows = part if rows is None else F.concat(rows, part)
    at = F.col(ts) if ts in wide.columns else F.lit(None).cast("long")
    return wide.select(lab.alias("labels"), at.alias("ts_ns"), F.inline(rows)).where(F.col("value").isNotNull())


def to_document(name: Column, labels: dict[str, Column], metrics: dict[str, Column], timestamp: Column) -> Column:
    """A record as one search document: labels as strings, metrics as numbers."""
    lab = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(v.cast("string"), F.lit("")).alias("value")) for k, v in labels.items()]))
    met = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("long").alias("value")) for k, v in metrics.items()]))
    return F.to_json(F.struct(name.alias("name"), met.alias("metrics"), lab.alias("labels"), timestamp.alias("timestamp")))


def to_record(name: Column, labels: dict[str, Column], metrics: dict[str, Column], timestamp: Column) -> Column:
    """A record in the form stored traces have: metrics as [{Name, Data: {Value}}]."""
    lab = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(v.cast("string"), F.lit("")).alias("value")) for k, v in labels.items()]))
    met = F.array(*[F.struct(F.lit(k).alias("Name"), F.struct(v.cast("long").alias("Value")).alias("Data")) for k, v in metrics.items()])
    return F.to_json(F.struct(name.alias("name"), met.alias("metrics"), lab.alias("labels"), timestamp.alias("timestamp")))


def export_documents(df: DataFrame, name: str, labels: list[str], metrics: list[str], ts: str = "ts_ns") -> DataFrame:
    doc = to_document(F.lit(name), {c: F.col(c) for c in labels}, {m: F.col(m) for m in metrics}, F.col(ts))
    return df.select(doc.alias("value"))


def export_spans(records: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One span row per trace: common labels, attributes by protocol, phases, flags as 0/1, time in ms."""
    def attribute(proto, name):
        if name is None:
            return F.lit("")
        return label(records, name).cast("string")

    attrs = F.lit(None)
    known = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), attribute(None, k).alias("value")) for k in ("request_payload", "response_payload")]))
    attrs = known
    for proto, names in SPAN_ATTRIBUTES.items():
        entries = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), attribute(proto, v).alias("value")) for k, v in names.items()]))
        attrs = F.when(F.col("protocol") == proto, entries).otherwise(attrs)
    phases = [F.coalesce(F.col(m), F.lit(0)).cast("long").alias(n) if m in records.columns else F.lit(0).cast("long").alias(n) for m, n in PHASES.items()]
    flags = [label(records, f).cast("int").alias(f) for f in ("is_server", "is_error", "is_slow")]
    return records.select(*keep, "protocol", *[label(records, c) for c in ("src_namespace", "src_pod", "dst_namespace", "dst_pod", "dnat_ip", "dnat_port", "pid", "comm")],
                          attrs.alias("attributes"), *phases, *flags, F.lit(0).alias("is_convergent"), F.floor(F.col("ts_ns") / 1_000_000).alias("timestamp"))


def console_sink(df: DataFrame, rows: int = 20):
    """Print records: a batch once, a stream per micro-batch (returns the query)."""
    if df.isStreaming:
        return df.writeStream.format("console").option("numRows", rows).option("truncate", False).start()
    df.write.format("console").mode("append").option("numRows", rows).option("truncate", False).save()
    return None
