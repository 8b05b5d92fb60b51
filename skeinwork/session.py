"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Only settings that change how results are computed or how skew is absorbed.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str | None = None, app: str = "skeinwork", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_session(spark: SparkSession) -> SparkSession:
    """A session of its own (tables and cache are shared) in UTC: time values are integer nanoseconds, and casts must not
    depend on the host zone. The caller's session keeps its settings."""
    if spark.conf.get("spark.sql.session.timeZone") == "UTC":
        return spark
    own = spark.newSession()
    for key, value in SESSION_CONF.items():
        own.conf.set(key, value)
    return own


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    Streaming state and written stages must outlive an executor, so on a cluster the folder has
    to come from ``spark.checkpoint.dir``. Only a local session may fall back to the temp folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder before running on a cluster")
        root = tempfile.mkdtemp(prefix="skeinwork-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more; one that is not there is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the work folder and read it from there: made once, and of known size."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
