"""Sliced scans equal the plain window on hot keys, whatever the slice width."""

import random

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from skeinwork.operators import scan


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(3)
    # One key holds most rows.
    d = [("hot" if rnd.random() < 0.8 else f"k{rnd.randrange(5)}", i, rnd.randrange(300), rnd.randrange(10)) for i in range(600)]
    return spark.createDataFrame(d, "k string, seq long, ts long, v long").cache()


@pytest.mark.parametrize("width", [1, 13, 1000])
def test_carry_and_sum(data, width):
    w = Window.partitionBy("k").orderBy("ts", "seq")
    sl = F.floor(F.col("ts") / width)
    plain = data.withColumns({"last": F.last(F.when(F.col("v") > 5, F.col("v")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
                              "next": F.lead("v").over(w), "total": F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    got = scan.carry_last(data, ["k"], ["ts", "seq"], {"last": F.col("v")}, sl, F.col("v") > 5)
    got = scan.carry_next(got, ["k"], ["ts", "seq"], {"next": F.col("v")}, sl)
    got = scan.running_sum(got, ["k"], ["ts", "seq"], F.col("v"), "total", sl)
    assert rows(got, "seq", "last", "next", "total") == rows(plain, "seq", "last", "next", "total")


@pytest.mark.parametrize("forward,inclusive", [(False, True), (False, False), (True, False), (True, True)])
def test_asof(spark, data, forward, inclusive):
    table = data.where("v > 6").select("k", F.col("ts").alias("at"), F.col("seq").alias("id"))
    probes = data.where("v < 3").select("k", "seq", "ts")
    got = scan.asof_join(probes, table, ["k"], "ts", "at", ["id"], 17, forward, inclusive, ["id"])
    t = sorted((r["k"], r["at"], r["id"]) for r in table.collect())
    want = []
    for p in probes.collect():
        if forward:
            near = [x for x in t if x[0] == p["k"] and (x[1] > p["ts"] or (inclusive and x[1] == p["ts"]))]
            hit = max((x for x in near if x[1] == near[0][1]), key=lambda x: x[2])[2] if near else None
        else:
            near = [x for x in t if x[0] == p["k"] and (x[1] < p["ts"] or (inclusive and x[1] == p["ts"]))]
            hit = near[-1][2] if near else None
        want.append((p["seq"], hit))
    assert rows(got, "seq", "id") == sorted(want, key=lambda t: tuple((x is None, str(x)) for x in t))


def test_no_task_sees_a_whole_hot_key(data):
    """No window of the plan is partitioned by the key alone, but for the one over slice summaries."""
    plan = scan.running_sum(data, ["k"], ["ts", "seq"], F.col("v"), "t", F.floor(F.col("ts") / 10))._jdf.queryExecution().optimizedPlan().toString()
    assert "__slice" in plan and "[k#" in plan
    for line in (x for x in plan.splitlines() if "Window [" in x and "__slice" not in x.split("], [")[1]):
        assert "__n" in line, line


def test_a_burst_is_cut_by_count(spark):
    """Nine tenths of the rows in one second of one key: no slice holds twice the median, and scans agree with the window."""
    rnd = random.Random(4)
    burst = [("hot", i, 5_000_000_000 + rnd.randrange(1_000_000_000), i % 7) for i in range(18_000)]
    quiet = [(rnd.choice(["hot", "b", None]), 18_000 + i, rnd.randrange(3600) * 1_000_000_000, i % 7) for i in range(2000)]
    df = spark.createDataFrame(burst + quiet, "k string, seq long, ts long, v long")
    fine = scan.balanced_slices(df, ["k"], "ts", 60_000_000_000, rows=1000)
    sizes = sorted(r["count"] for r in fine.where("k = 'hot' AND ts >= 5000000000 AND ts < 6000000000").groupBy("__fine").count().collect())
    assert len(sizes) >= 60 and sizes[-1] < 2 * sizes[len(sizes) // 2], sizes
    assert fine.groupBy("k", "__fine").count().agg(F.max("count")).first()[0] <= 1000
    w = Window.partitionBy("k").orderBy("ts", "seq")
    plain = df.withColumn("total", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = scan.running_sum(fine, ["k"], ["ts", "seq"], F.col("v"), "total", F.col("__fine"))
    assert rows(got, "seq", "total") == rows(plain, "seq", "total")
    table = df.where("v > 5").select("k", F.col("ts").alias("at"), F.col("seq").alias("id"))
    probes = df.where("v < 2").select("k", "seq", "ts")
    args = (probes, table, ["k"], "ts", "at", ["id"], 60_000_000_000, False, True, ["id"])
    assert rows(scan.asof_join(*args, slice_rows=500), "seq", "id") == rows(scan.asof_join(*args), "seq", "id")


def test_series_without_slices_are_cut_by_count(spark):
    from skeinwork.operators import series

    df = spark.createDataFrame([("a", t, (t * 7) % 50) for t in range(500)] + [("b", 1, 3)], "k string, ts long, value long")
    want = {"a": sum(now if now < prev else now - prev for prev, now in zip([(t * 7) % 50 for t in range(499)], [(t * 7) % 50 for t in range(1, 500)])), "b": 0}
    assert {r.k: r.increase for r in series.increase(df, ["k"]).collect()} == want
    assert series.deltas(df, ["k"]).columns == ["k", "ts", "value", "delta"]


@pytest.mark.parametrize("forward,inclusive", [(False, True), (True, False)])
@pytest.mark.parametrize("hot_rows", [0, 60])
def test_asof_of_hot_keys(spark, data, forward, inclusive, hot_rows):
    """Keys that are cut into slices, one without a value among them, and rows without a position give what whole keys give."""
    odd = data.select(F.when(F.col("k") != "k1", F.col("k")).alias("k"), F.when(F.col("seq") % 50 > 0, F.col("ts")).alias("ts"), "seq", "v", (F.col("seq") % 3).cast("int").alias("n"))
    table = odd.where("v > 6").select("k", "n", F.col("ts").alias("at"), F.col("seq").alias("id"))
    probes = odd.where("v < 3").select("seq", "k", "ts", "n", F.create_map("k", "v").alias("m") if hot_rows else F.col("v").alias("m")).where("k IS NOT NULL OR m IS NOT NULL" if not hot_rows else "k IS NOT NULL")
    args = (probes, table, ["k", "n"], "ts", "at", ["id"], 17, forward, inclusive, ["id"])
    got, whole = scan.asof_join(*args, hot_rows=hot_rows), scan.asof_join(*args)
    assert got.schema == whole.schema and got.columns == [*probes.columns, "id"]
    assert rows(got, "seq", "k", "n", "ts", "id") == rows(whole, "seq", "k", "n", "ts", "id")
    if not hot_rows:
        w = Window.partitionBy("k", "n").orderBy(*([F.col("p").desc_nulls_first()] if forward else ["p"]), F.col("side") if inclusive else F.col("side").desc(), F.col("id"))
        both = probes.select("seq", "k", "n", F.col("ts").alias("p"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("id")).unionByName(
            table.select(F.lit(None).cast("long").alias("seq"), "k", "n", F.col("at").alias("p"), F.lit(0).alias("side"), "id"))
        plain = both.withColumn("hit", F.last("id", True).over(w.rowsBetween(Window.unboundedPreceding, -1))).where("side = 1")
        assert rows(got, "seq", "id") == rows(plain, "seq", "hit")


def test_asof_moves_rows_once(spark):
    """Keys with few rows are dealt once, not by slices that hold a row or two; the other exchange is that of the counts."""
    probes = spark.range(4000).select((F.col("id") % 400).cast("string").alias("k"), F.col("id").alias("seq"), (F.col("id") * 100).alias("ts"))
    table = spark.range(800).select((F.col("id") % 400).cast("string").alias("k"), (F.col("id") * 500).alias("at"), "id")
    got = scan.asof_join(probes, table, ["k"], "ts", "at", ["id"], 10)
    assert got.where("id IS NOT NULL").count() > 0
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") <= 2, plan
