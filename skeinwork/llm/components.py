"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import drop_folder, work_dir


def _stars(pairs: DataFrame) -> DataFrame:
    """Nearest smaller node of every node of (u, v), joined to its links; a node with many links is one row on that side."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(least, "u")


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node that can be reached) for every node of ``links`` (long columns ``u`` and ``v``).

    Every round is two aggregations and two joins of the links; the number of rounds grows with the logarithm of the longest
    path. Rounds are written to the shared folder, so lost executors cost one round at most. Nothing is collected but a
    count and a checksum per round. Links from a node to itself keep the node as a component of its own.
    """
    spark, folder, state, kept = links.sparkSession, work_dir(links.sparkSession, "components"), None, []
    nodes = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    while True:
        path = f"{folder}/{len(kept)}"
        edges.write.parquet(path)
        kept.append(path)
        edges = spark.read.schema("u long, v long").parquet(path)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if len(kept) > 2:
            drop_folder(links, kept[-3])
        if now == state or not now[0]:
            break
        state = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _stars(large)
        edges = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
    # At the end every node but the root of its component has one link, to the root.
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
