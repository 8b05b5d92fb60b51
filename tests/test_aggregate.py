from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from skeinwork import constants as C
from skeinwork.operators import aggregate, series, topology


def test_kinds(spark):
    df = spark.range(100).select(F.lit(1).alias("g"), F.lit(100).cast("long").alias("duration"), F.col("id").alias("last"), F.col("id").alias("ts_ns"))
    kinds = {"duration": [("sum", "s"), ("count", "c"), ("max", "m"), ("avg", "a"), ("nothing", "u")], "last": [("last", "l")], "absent": [("sum", "x")]}
    assert rows(aggregate.agg_config(df, ["g"], kinds)) == [(1, 10000, 100, 100, 100, 10000, 99)]
    h = df.groupBy("g").agg(aggregate.agg_histogram(F.col("duration"), [0, 100, 200, 500, 1000]).alias("h")).first()["h"]
    assert (h["sum"], h["count"], h["buckets"]) == (10000, 100, [0, 100, 100, 100, 100])


def test_floor_and_truncation(spark):
    df = spark.createDataFrame([(-1, 1), (-2, 2)], "n long, p long")
    got = df.agg(aggregate.registry.agg_max(F.col("n")).alias("m"), aggregate.registry.agg_avg(F.col("n")).alias("n"), aggregate.registry.agg_avg(F.col("p")).alias("p")).first()
    assert tuple(got) == (0, -1, 1)


def test_merge_rejects_other_bounds(spark):
    df = spark.createDataFrame([(1, (5, 1, [1], [1])), (1, (7, 2, [1], [2]))], "g int, h struct<sum:bigint,count:bigint,bounds:array<bigint>,buckets:array<bigint>>")
    h = aggregate.merge_histograms(df, ["g"], "h", 1).first()["h"]
    assert (h["sum"], h["count"], h["buckets"]) == (12, 3, [3])
    with pytest.raises(Exception, match="different bounds"):
        aggregate.merge_histograms(df, ["g"], "h", 2).collect()


def test_counter_reset_and_rate(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([5, 8, 2, 4])], "k string, ts long, value long")
    for width in (1, 2, 100):
        assert rows(series.increase(df, ["k"], slice_=F.floor(F.col("ts") / width))) == [("a", 3 + 2 + 2)]


def test_quantile_edges(spark):
    df = spark.createDataFrame([("a", 10, 0, 4), ("a", 20, 2, 4), ("a", 40, 4, 4), ("b", 10, 1, 5)], "k string, le long, cumulative long, total long")
    assert rows(series.histogram_quantile(df, ["k"], 0.75)) == [("a", 30.0), ("b", 10.0)]


def test_retention(spark):
    df = spark.range(120).select(F.when(F.col("id") < 49, "small").otherwise("large").alias("g"), F.col("id").alias("m"))
    kept = series.retention(df, ["g"], "m", "m")
    assert rows(kept.groupBy("g").agg(F.count("*"), F.min("m"))) == [("large", 24, 96), ("small", 49, 0)]


def test_edge_helpers(spark):
    e = spark.createDataFrame([("a", "b", 10, 1), ("b", "a", 50, 2), ("a", "c", 24, 3)], "source string, target string, sent long, first_seen long")
    assert rows(topology.volume_step(e), "source", "target", "step") == [("a", "b", 1), ("a", "c", 2), ("b", "a", 5)]
    assert rows(topology.volume_step(e.limit(1)), "step") == [(0,)]
    assert rows(topology.opposite_edge(e), "source", "target", "opposite") == [("a", "b", False), ("a", "c", False), ("b", "a", True)]
    f = spark.createDataFrame([("a", "b", 5.0), ("x", "y", 7.0)], "source string, target string, conn_fail double")
    assert rows(topology.overlay(e.select("source", "target"), f)) == [("a", "b", 5.0), ("a", "c", None), ("b", "a", None), ("x", "y", 7.0)]


def test_histograms_with_other_bounds_are_an_error(spark):
    rows = [("a", (3, 2, [1, 2], [1, 2])), ("a", (30, 2, [10, 20], [1, 2]))]
    df = spark.createDataFrame(rows, "k string, h struct<sum:bigint,count:bigint,bounds:array<bigint>,buckets:array<bigint>>")
    with pytest.raises(Exception, match="different bounds"):
        aggregate.merge_histograms(df, ["k"], "h", 2).collect()


def test_listing_pages(spark):
    df = spark.createDataFrame([(k % 7, k) for k in range(50)], "a int, b long").repartition(4)
    want = sorted(((k % 7, k) for k in range(50)), key=lambda r: (-r[0], r[1]))
    got, after, more = [], None, True
    while more:
        page = series.listing(df, [("a", True), ("b", False)], 12, after).collect()
        got += sorted(((r.a, r.b) for r in page), key=lambda r: (-r[0], r[1]))
        after, more = got[-1], page[0].more
        assert len({r.more for r in page}) == 1
    assert got == want
    assert series.listing(df.where("b < 0"), [("a", True)], 5).count() == 0


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_packed_keys_are_the_keys(spark):
    """text and integer keys are shuffled as one text; separators, escapes, nulls and empty texts stay apart."""
    odd = ["", None, "a", "\x1f", "\x1e", "\x1e0", "\x1e1", "\x1e2", "a\x1fb", "\x1f\x1e1", "é\x1f"]
    data = [(x, y, None if i % 3 else i % 4, [None, True, False][(i + j) % 3], i, 1) for i, x in enumerate(odd) for j, y in enumerate(odd)]
    data = data * 2 + [("a\x1fb", "", 1, None, 0, 1), ("a", "b\x1f", 1, None, 0, 1)]
    df = spark.createDataFrame(data, "a string, b string, c int, d boolean, e long, v int").withColumn("f", F.lit("x"))
    keys, total = ["a", "b", "d", "c", "e", "f"], [F.sum("v").alias("s"), F.count("*").alias("n")]
    got, want = aggregate.group_packed(df, keys, total, least=2), df.groupBy(*keys).agg(*total)
    assert got.dtypes == want.dtypes
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert "__key" in got._jdf.queryExecution().executedPlan().toString()
    assert "__key" not in aggregate.group_packed(df, keys, total)._jdf.queryExecution().executedPlan().toString()


def test_net_requests_shuffle_one_text(spark):
    """the labels of a request go through the shuffle packed."""
    df = spark.createDataFrame([("p", "n1", 8080, 1, 5), ("p", None, 8080, 2, 7), ("p", "", 8080, 3, 9)], "src_pod string, dst_namespace string, dst_port int, ts_ns long, request_io long")
    out = aggregate.agg_net_requests(df)
    assert "__key" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.select("src_pod", "dst_namespace", "dst_port", "pid", "is_server", "request_io").collect())) == [
        ("p", "", 8080, 0, False, 16), ("p", "n1", 8080, 0, False, 5)]


def test_side_metrics_aggregate_once(spark):
    """durations, bytes and counts come from one aggregation, also where is_slow, a count or a sum is null."""
    data = [("a", True, 1, 2, 3, 1), ("a", False, 4, 5, 6, 1), ("a", True, 7, 8, 9, 2), ("b", None, 1, None, 1, 5), (None, False, None, None, None, None)]
    df = spark.createDataFrame(data, "l string, is_slow boolean, request_total_time long, request_io long, response_io long, request_count long")
    out = aggregate.side_metrics(df, ["l"], False)
    assert _exchanges(out) == 1
    d, q, p, t = (C.TOPOLOGY_METRICS[m] for m in ("request_total_time", "request_io", "response_io", "request_count"))
    assert Counter(map(tuple, out.select("l", "is_slow", "metric", "value").collect())) == Counter([
        ("a", None, d, 12), ("a", None, q, 15), ("a", None, p, 18), ("a", True, t, 3), ("a", False, t, 1),
        ("b", None, d, 1), ("b", None, q, None), ("b", None, p, 1), ("b", None, t, 5),
        (None, None, d, None), (None, None, q, None), (None, None, p, None), (None, False, t, None)])


def test_detail_edges_leave_other_namespaces_early(spark):
    """rows outside the asked namespace are left before the labels are shuffled."""
    labels = ["src_namespace", "src_workload_name", "src_workload_kind", "src_pod", "src_ip", "dst_namespace", "dst_workload_name",
              "dst_workload_kind", "dst_pod", "dst_ip", "dst_service", "protocol", "status_code"]
    data = [(a, f"w{a}", "deployment", f"p{a}", f"i{a}", b, f"w{b}", "deployment", f"p{b}", f"i{b}", "", "http", "500", 1) for a in ("n", "m", "o", None) for b in ("n", "m", "o")]
    df = spark.createDataFrame(data, ", ".join(f"{c} string" for c in labels) + ", calls long")
    out = topology.detail_edges(df, "n", pods=True)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("explode"):]
    assert "Filter" in below and "= n)" in below
    assert sorted((r["source"], r["target"], r["calls"]) for r in out.collect()) == [
        ("m_pm", "n_pn", 1), ("n_pn", "m_pm", 1), ("n_pn", "o_po", 1), ("o_po", "n_pn", 1), ("pNone", "n_pn", 1)]
