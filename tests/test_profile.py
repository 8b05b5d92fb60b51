from conftest import rows
from pyspark.sql import functions as F

from skeinwork.operators import profile
from skeinwork.session import work_dir
from skeinwork.sources import traces

MS = 1_000_000
CPU = "tid long, start_ns long, type_specs array<bigint>, time_type array<int>, runq array<bigint>, on_info string, off_info string, log string, stack string, lo_ns long, hi_ns long"


def cpu(spark, **kw):
    base = dict(tid=1, start_ns=100 * MS, type_specs=[3 * MS, 5 * MS, 2 * MS], time_type=[0, 2, 0], runq=[1500], on_info="|", off_info="net@read@a->b@103000000@4000000@1@64", log="|5@hello", stack="",
                lo_ns=101 * MS, hi_ns=200 * MS)
    base.update(kw)
    return spark.createDataFrame([tuple(base[c.split()[0]] for c in CPU.split(", "))], CPU)


def test_timeline(spark):
    sl = profile.timeline_offsets(cpu(spark))
    assert rows(sl, "slice_no", "type", "slice_start", "slice_end", "runq_us", "log") == [
        (0, "on", 100 * MS, 103 * MS, None, None), (1, "net", 103 * MS, 108 * MS, 1500, None), (2, "on", 108 * MS, 110 * MS, None, "5@hello")]
    t = profile.thread_timeline(sl, ["tid"])
    assert rows(t, "event_type", "start_ns", "end_ns", "time_ns", "on_off") == [
        ("net", 103 * MS, 108 * MS, 5 * MS, False), ("netread", 103 * MS, 107 * MS, 4 * MS, True), ("on", 101 * MS, 103 * MS, 2 * MS, False), ("on", 108 * MS, 110 * MS, 2 * MS, False),
        ("runqLatency", 108 * MS - 1_500_000, 108 * MS, 1_500_000, False)]
    assert rows(profile.thread_logs(sl, ["tid"])) == [(1, 108 * MS, "hello")]
    assert rows(profile.runq_latency(profile.timeline_offsets(cpu(spark, runq=[500])), ["tid"])) == []


def test_sub_events_in_range_only(spark):
    info = "net@read@a@90000000@1000000@1@1#file@open@/x@104000000@1000000@9#futex@0x1"
    t = profile.thread_timeline(profile.timeline_offsets(cpu(spark, off_info=info)), ["tid"])
    assert rows(t.where("on_off"), "event_type", "file") == [("fileopen", "/x")]


def test_entry_exit(spark):
    m = spark.createDataFrame([(1, t, e, u) for t, e, u in [(1, 0, ""), (2, 1, ""), (3, 1, ""), (4, 0, ""), (5, 0, ""), (6, 1, "/url"), (7, 1, ""), (8, 0, ""), (9, 1, "")]], "k int, ts_ns long, is_entry int, url string")
    for width in (1, 4, 100):
        assert rows(profile.trace_intervals(m, ["k"], ["ts_ns"], F.floor(F.col("ts_ns") / width)), "start_ns", "end_ns") == [(2, 4), (7, 8)]


def test_breakdown_takes_locks_off_futex(spark):
    cols = "k int, tid long, type string, start_ns long, end_ns long, time_ns long, on_off boolean, request_start_ms long, request_end_ms long"
    tl = spark.createDataFrame([(1, 1, "on", 0, 50 * MS, 50 * MS, False, 10, 30), (1, 1, "futex", 12 * MS, 20 * MS, 8 * MS, False, 10, 30), (1, 2, "on", 0, 50 * MS, 50 * MS, False, 10, 30)], cols)
    locks = spark.createDataFrame([(1, 1, 12 * MS, 15 * MS, 3 * MS, 10, 30)], "k int, tid long, start_ns long, end_ns long, time_ns long, request_start_ms long, request_end_ms long")
    carrying = spark.createDataFrame([(1, 1)], "k int, tid long")
    assert rows(profile.time_breakdown(tl, locks, carrying, ["k"]), "type", "time_ns", "rate") == [("futex", 5 * MS, 25.0), ("lock", 3 * MS, 15.0), ("on", 24 * MS, 120.0)]


def test_trace_threads_falls_back_to_all(spark):
    t = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2)], "k int, tid long")
    c = spark.createDataFrame([(1, 2)], "k int, tid long")
    assert rows(profile.trace_threads(t, c, ["k"])) == [(1, 2), (2, 1), (2, 2)]


def test_trace_files(spark):
    path = work_dir(spark, "trace-files")
    trace = '{"name":"t","metrics":[{"Name":"request_total_time","Data":{"Value":7}}],"labels":{"pid":12,"is_server":true},"timestamp":5}'
    seg = '{"name":"s","metrics":[],"labels":{"pid":12,"tid":3,"startTime":100,"endTime":200,"cpuEvents":"[{\\"startTime\\":1,\\"typeSpecs\\":[1,2]}]","spans":"{bad"},"timestamp":5}'
    spark.createDataFrame([(f"{trace}\n------\n{seg}\n------\nnot json",)], "v string").coalesce(1).write.option("lineSep", "\n").text(path)
    t, s = traces.scan_trace_files(spark, path)
    assert rows(t, "timestamp") == [(5,)]
    got = s.select("pid", "tid", "startTime", F.size("cpuEvents").alias("c"), F.size("spans").alias("s"))
    assert rows(got) == [(12, 3, 100, 1, 0)]


def test_a_filtered_scan_opens_only_its_files(spark):
    """Files are chosen by what their paths say; one of them is split among tasks at its record marks."""
    import json

    from skeinwork.session import work_dir

    root = work_dir(spark, "trace-files")
    block = lambda n: json.dumps({"name": "t", "metrics": [], "labels": {"pid": str(n)}, "timestamp": n})
    for w, pod, pid in [("w1", "p1", 1), ("w1", "p2", 2), ("w2", "p1", 1), ("w2", "p3", 3)]:
        for time in (100, 200):
            text_ = traces.SEPARATOR.join(block(pid * 1000 + k) for k in range(50))
            spark.createDataFrame([(text_,)], "value string").coalesce(1).write.text(f"{root}/tmp")
            jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
            fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(conf)
            found = [s.getPath() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/tmp")) if s.getPath().getName().startswith("part-")]
            folder = jvm.org.apache.hadoop.fs.Path(f"{root}/all/{w}_{pod}_c_{pid}")
            fs.mkdirs(folder)
            fs.rename(found[0], jvm.org.apache.hadoop.fs.Path(folder, f"{time}_http_YQ==_true"))
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/tmp"), True)

    def opened(of):
        blocks = traces.scan_trace_blocks(spark, f"{root}/all", of)
        rows_ = blocks.collect()
        plan = blocks._jdf.queryExecution().executedPlan()
        leaves = plan.collectLeaves()
        return leaves.head().metrics().get("numFiles").get().value(), len(rows_)

    assert opened(None) == (8, 400)
    assert opened("pid = 1 AND time = '100'") == (2, 100)
    assert opened((F.col("workload") == "w2") & F.col("pod").isin("p3") & F.col("is_server") & (F.col("content_key") == "a")) == (2, 100)
    assert opened("container = 'none'") == (0, 0)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        one = traces.scan_trace_blocks(spark, f"{root}/all", "pid = 2 AND time = '200'")
        assert one.rdd.getNumPartitions() > 2 and one.count() == 50
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_deep_and_odd_call_trees(spark):
    """A tree 300 deep, a node without name and children, empty and null trees; in parts of some nodes."""
    import json

    deep = "".join(f'[{{"from":{k},"to":{1000 - k},"name":"f{k}","child":' for k in range(1, 301)) + "[]" + "}]" * 300
    odd = json.dumps([{"from": 0, "to": 4}, {"from": 4, "to": 10, "name": "b", "child": [{"from": 5, "to": 6, "name": "c", "child": None}]}])
    df = spark.createDataFrame([("odd", odd), ("empty", ""), ("none", None), ("list", "[]")], "k string, flames string")
    got = rows(profile.stack_levels(df, ["k"], part_rows=2), "k", "level", "path", "name", "start", "end", "time_rate")
    assert got == [("odd", 1, "0", None, 0, 4, 0.4), ("odd", 1, "1", "b", 4, 10, 0.6), ("odd", 2, "1.0", "c", 5, 6, 0.1)]
    out = profile.stack_levels(spark.createDataFrame([("deep", deep)], "k string, flames string"), ["k"]).orderBy("level").collect()
    assert [r.level for r in out] == list(range(1, 301)) and out[-1].path == ".".join(["0"] * 300) and out[-1].name == "f300"


def test_ranges_of_any_length_meet_points(spark):
    calls = spark.createDataFrame([(1, 5, 0, 3 * 10 ** 18), (2, 5, 70 * 10 ** 9, 10 ** 9), (3, 6, 0, 10 ** 12), (4, 5, None, 1), (5, 5, 63 * 10 ** 9, -10 ** 9)],
                                  "id int, request_tid long, start_ns long, request_total_time long").withColumns({"pid": F.lit(1), "is_slow": F.lit(True), "is_server": F.lit(False)})
    seconds = spark.createDataFrame([(1, 5, 0), (1, 5, 63), (1, 5, 71), (1, 5, 71), (1, 5, 2 * 10 ** 9), (1, 7, 1)], "pid int, tid long, second long")
    # The first call lasts three thousand million seconds: a row for each of them can't be made.
    assert rows(profile.inner_calls(calls, seconds), "id", "second") == sorted(
        [(1, 0), (1, 63), (1, 71), (1, 2 * 10 ** 9), (2, 71), (5, 63)], key=lambda t: tuple((x is None, str(x)) for x in t))
