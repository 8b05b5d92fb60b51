import glob

from conftest import rows
from pyspark.sql import functions as F

from skeinwork.plans import q_sources
from skeinwork.schema import RECORD
from skeinwork.session import work_dir
from skeinwork.sources import traces


def _records(spark, n):
    labels = F.create_map(F.lit("is_server"), F.lit("true"), F.lit("dst_workload_name"), F.lit("w"))
    return spark.range(n).select(F.lit("r").alias("name"), F.array().cast(RECORD["metrics"].dataType).alias("metrics"), labels.alias("labels"), F.col("id").alias("timestamp"))


def test_stored_traces_are_compressed_and_cut(spark):
    path = work_dir(spark, "stored")
    traces.write_traces(_records(spark, 25), path, file_rows=10)
    files = [f for f in glob.glob(f"{path}/**/*", recursive=True) if "part-" in f]
    assert len(files) >= 3 and all(f.endswith(".json.gz") for f in files)
    assert rows(spark.read.schema(RECORD).json(path), "timestamp") == sorted([(k,) for k in range(25)], key=str)


def test_record_lines_are_compressed(spark):
    columns = {c: F.lit("x") for c in q_sources._LABELS} | {c: F.col("id") for c in ("request_total_time", "request_io", "ts_ns", "dst_port")} | {c: F.lit(True) for c in ("is_server", "is_slow")}

    class Env:
        v_records = spark.range(3).select(*[v.alias(k) for k, v in columns.items()])

    Env.spark = spark
    read = q_sources.scan_records(Env)
    assert all(f.endswith(".txt.gz") for f in read.inputFiles()) and len(read.inputFiles()) > 0
    assert rows(read, "ts_ns", "dst_port", "is_server", "content_key", "request_io") == [(k, k, True, "x", k) for k in range(3)]


def test_reading_stored_traces_leaves_the_record_schema(spark):
    class Env:
        v_records = spark.range(3).select(*[F.lit("x").alias(c) for c in q_sources._LABELS if c != "is_server"], F.lit(True).alias("is_server"),
                                          *[F.col("id").alias(c) for c in ("request_total_time", "request_io", "ts_ns")])

    Env.spark, before = spark, RECORD.fieldNames()
    for _ in range(2):
        assert rows(q_sources.write_traces(Env), "workload", "n", "total") == [("x", 3, 3)]
    assert RECORD.fieldNames() == before
