"""Event, record and socket-table readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.schema import EVENT, RECORD


def scan_table(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A parquet table; with ``partitions`` its rows are dealt to so many tasks (for a few files with one row group each)."""
    table = spark.read.parquet(path)
    return table if partitions is None else table.repartition(partitions)


def scan_events(spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = False, schema=EVENT, **options: str) -> DataFrame:
    """Captured events from files (parquet, json, orc, ...) or, streaming, from a folder that grows."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).format(fmt).options(**options).load(path)


def scan_events_kafka(spark: SparkSession, servers: str, topic: str, schema=EVENT, **options: str) -> DataFrame:
    """Captured events as JSON messages of a topic (needs the Kafka connector on the class path)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e")).select("e.*")


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """Result records: name, metrics[{Name, Data{Value}}], labels, timestamp."""
    return spark.read.schema(RECORD).json(path)


def record_metric(name: str, metrics: str | Column = "metrics") -> Column:
    """Value of a named metric of a record, null when it has none."""
    hit = F.filter(metrics, lambda m: m["Name"] == name)
    return F.get(hit, F.lit(0))["Data"]["Value"]


def record_label(name: str, kind: str = "string") -> Column:
    """Typed read of a label; a missing one or another type reads as "", 0 or false."""
    raw = F.try_element_at(F.col("labels"), F.lit(name))
    default = {"string": F.lit(""), "long": F.lit(0).cast("long"), "boolean": F.lit(False)}[kind]
    return F.coalesce(raw if kind == "string" else raw.try_cast(kind), default)


_ADDRESS = r"^([0-9A-Fa-f]{8}):([0-9A-Fa-f]{1,16})$"


def parse_socket_lines(lines: DataFrame) -> DataFrame:
    """Socket-table lines -> local and remote address and state; lines that are no socket are left out.

    Addresses are hex with the first octet last, ports are hex.
    """
    f = F.split(F.trim("line"), r"\s+")

    def end(i, name):
        ip = F.regexp_extract(F.get(f, F.lit(i)), _ADDRESS, 1)
        octets = [F.conv(F.substring(ip, 2 * k + 1, 2), 16, 10) for k in (3, 2, 1, 0)]
        return {f"{name}_ip": F.concat_ws(".", *octets), f"{name}_port": F.conv(F.regexp_extract(F.get(f, F.lit(i)), _ADDRESS, 2), 16, 10).cast("long")}

    ok = (F.size(f) >= 10) & F.get(f, F.lit(1)).rlike(_ADDRESS) & F.get(f, F.lit(2)).rlike(_ADDRESS)
    return lines.where(ok).withColumns({**end(1, "local"), **end(2, "remote"), "state": F.get(f, F.lit(3))}).drop("line")


def socket_states(spark: SparkSession, path: str) -> DataFrame:
    """Collected socket tables, one file per host and pid: ``.../<host>/<pid>``."""
    lines = spark.read.text(path, recursiveFileLookup=True).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    at = F.split("file", "/")
    owned = lines.select("line", F.element_at(at, -2).alias("host"), F.regexp_extract(F.element_at(at, -1), r"^(\d+)", 1).try_cast("long").alias("pid"))
    return parse_socket_lines(owned)


def nat_table(tuples: DataFrame) -> DataFrame:
    """Lookup from connection-tracking tuples: translated TCP/UDP connections in both directions, newest per key.

    ``tuples``: ts_ns, proto (6 or 17) and src, sport, dst, dport of ``origin_`` and ``reply_``.
    """
    o, r = (lambda c: F.col(f"origin_{c}")), (lambda c: F.col(f"reply_{c}"))
    translated = (o("src") != r("dst")) | (o("dst") != r("src")) | (o("sport") != r("dport")) | (o("dport") != r("sport"))
    kept = tuples.where(translated & F.col("proto").isin(6, 17))

    def way(a, b):
        return F.struct(a("src").alias("src_ip"), a("sport").alias("src_port"), a("dst").alias("dst_ip"), a("dport").alias("dst_port"),
                        b("src").alias("dnat_ip"), b("sport").alias("dnat_port"))

    both = kept.select("ts_ns", F.when(F.col("proto") == 6, "tcp").otherwise("udp").alias("transport"), F.inline(F.array(way(o, r), way(r, o))))
    keys = ["src_ip", "src_port", "dst_ip", "dst_port", "transport"]
    return both.groupBy(*keys).agg(F.max_by(F.struct("dnat_ip", "dnat_port"), F.struct("ts_ns", "dnat_ip", "dnat_port")).alias("m")).select(*keys, "m.*")
