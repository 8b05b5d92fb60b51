"""Stored traces: files, catalog and writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions import text
from skeinwork.operators.profile import unpack_segments
from skeinwork.schema import RECORD

SEPARATOR = "\n------\n"
_SEGMENT = ["pid", "tid", "threadName", "startTime", "endTime", "isSent", "cpuEvents", "javaFutexEvents", "transactionIds", "spans", "innerCalls"]


def scan_trace_blocks(spark: SparkSession, path: str, of: Column | str | None = None) -> DataFrame:
    """Blocks of trace files as records with their file. The separator splits the file while it is read, so a block
    is a row and a large file is read by several tasks. Broken blocks are left out.

    ``of`` is a condition on what the paths say (``catalog_from_paths``: workload, pod, container, pid, time, protocol,
    content_key, is_server). It reads nothing but the file's path, so Spark decides it when it lists the files and opens only
    those that meet it; files whose path says nothing are then left out.
    """
    raw = spark.read.option("lineSep", SEPARATOR).option("recursiveFileLookup", True).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), "value")
    if of is not None:
        raw = catalog_from_paths(raw, "file").where(of).select("file", "value")
    parsed = raw.select("file", F.from_json(F.trim("value"), RECORD).alias("r")).select("file", "r.*")
    return parsed.where(F.col("labels").isNotNull())


def split_trace_blocks(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(traces, segments): a block with the profile lists is a segment of the trace in its file."""
    is_segment = F.map_contains_key("labels", "cpuEvents")
    segments = blocks.where(is_segment).select("file", *[F.try_element_at("labels", F.lit(c)).alias(c) for c in _SEGMENT])
    typed = segments.withColumns({c: F.col(c).try_cast("long") for c in ("pid", "tid", "startTime", "endTime")})
    return blocks.where(~is_segment), unpack_segments(typed)


def scan_trace_files(spark: SparkSession, path: str, of: Column | str | None = None) -> tuple[DataFrame, DataFrame]:
    """Traces and segments of the files below a folder; ``of`` as in ``scan_trace_blocks``."""
    return split_trace_blocks(scan_trace_blocks(spark, path, of))


def catalog_from_paths(files: DataFrame, path: str = "path") -> DataFrame:
    """File paths ``.../workload_pod_container_pid/time_protocol_key_isserver`` as typed columns (key is base64)."""
    folder = F.split(F.element_at(F.split(path, "/"), -2), "_")
    name = F.element_at(F.split(path, "/"), -1)
    part = lambda i: F.regexp_extract(name, r"^([^_]*)_([^_]*)_(.*)_([^_]*)$", i)
    key = F.decode(F.unbase64(F.translate(part(3), "-_", "+/")), "UTF-8")
    rows = files.where((F.size(folder) == 4) & (part(1) != ""))
    return rows.withColumns({"workload": F.get(folder, F.lit(0)), "pod": F.get(folder, F.lit(1)), "container": F.get(folder, F.lit(2)),
                             "pid": F.get(folder, F.lit(3)).try_cast("long"), "time": part(1), "protocol": part(2), "content_key": key,
                             "is_server": part(4) == "true"})


def trace_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Stored traces below a folder; only names and times are listed, contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    return catalog_from_paths(files)


def catalog_tree(catalog: DataFrame) -> DataFrame:
    """One row per (workload, pod) with its processes as ``container(pid)``, sorted."""
    leaf = F.concat("container", F.lit("("), F.col("pid").cast("string"), F.lit(")"))
    seen = catalog.select("workload", "pod", leaf.alias("leaf")).distinct()
    return seen.groupBy("workload", "pod").agg(F.array_join(F.array_sort(F.collect_set("leaf")), ",").alias("processes"), F.count("*").alias("n"))


def with_trace_path(traces: DataFrame) -> DataFrame:
    """Add the folder elements of records with a label map."""
    label = lambda n: F.try_element_at(F.col("labels"), F.lit(n))
    is_server = F.coalesce(label("is_server") == "true", F.lit(False))
    return traces.withColumns({**text.trace_path(is_server, label), "pid": F.coalesce(label("pid").try_cast("long"), F.lit(0))})


def write_traces(traces: DataFrame, path: str, mode: str = "append", compression: str = "gzip", file_rows: int = 1_000_000) -> None:
    """Store traces by workload, pod, container and pid. The rebalance hint joins small and splits skewed writers.

    Files are compressed (JSON repeats every name in every row) and cut after ``file_rows`` rows, since a compressed file is
    read by one task.
    """
    keys = ["workload", "pod", "container", "pid"]
    out = with_trace_path(traces).hint("rebalance", *keys).write.mode(mode).partitionBy(*keys)
    out.option("compression", compression).option("maxRecordsPerFile", file_rows).json(path)


def write_segments(segments: DataFrame, path: str, sent: DataFrame | None = None, mode: str = "append") -> DataFrame:
    """Store segments that were not stored before; returns what was written."""
    new = skip_sent(segments, sent)
    new.hint("rebalance", "pid").write.mode(mode).partitionBy("pid").json(path)
    return new


def skip_sent(segments: DataFrame, sent: DataFrame | None = None, keys=("pid", "tid", "startTime")) -> DataFrame:
    """Each segment once, without those already sent."""
    once = segments.dropDuplicates(list(keys))
    return once if sent is None else once.join(sent.select(*keys).distinct(), list(keys), "left_anti")
