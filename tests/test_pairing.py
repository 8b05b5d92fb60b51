"""Pairing and phases against known traces; every case is one connection, split over slices of several widths."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from skeinwork.operators import enrich, events, pairing

SCHEMA = "pid long, fd int, seq long, ts_ns long, latency_ns long, res long, is_request boolean, sport int, tid long, data binary"

# requests (ts, latency, res), responses -> start, sent, wait, download, total, request bytes, response bytes
CASES = {
    "http": ([(100000000, 5000, 191)], [(101000000, 40000, 135)], (99995000, 5000, 960000, 40000, 1005000, 191, 135)),
    "http slow": ([(100000000, 1000, 193)], [(601000000, 2000, 135)], (99999000, 1000, 500998000, 2000, 501001000, 193, 135)),
    "mysql split": ([(100000000, 2000, 4), (100002000, 1000, 20)], [(100020000, 15000, 160)], (99998000, 4000, 3000, 15000, 22000, 24, 160)),
    "kafka split": ([(100000000, 80000, 143)], [(100020000, 8000, 8), (100030000, 5000, 61)], (99920000, 80000, 12000, 18000, 110000, 143, 69)),
    "redis": ([(100000000, 8000, 22)], [(100100000, 80000, 9)], (99992000, 8000, 20000, 80000, 108000, 22, 9)),
    "unsupported": ([(100000000, 2000, 15)], [(100020000, 15000, 18)], (99998000, 2000, 5000, 15000, 22000, 15, 18)),
    "rocketmq": ([(100000000, 40000, 108)], [(101000000, 8000, 332)], (99960000, 40000, 992000, 8000, 1040000, 108, 332)),
    "unanswered": ([(100000000, 40000, 108)], [], (99960000, 40000, -1, -1, 0, 108, 0)),
}


def frame(spark, sides, sport=1):
    data, seq = [], 0
    for q, (ts, lat, res) in sides:
        seq += 1
        data.append((1, 1, seq, ts, lat, res, q, sport, 7 if q else 8, bytearray(b"q" * 3 if q else b"r" * 3)))
    return spark.createDataFrame(data, SCHEMA)


@pytest.mark.parametrize("slice_ns", [1, 10_000, 60_000_000_000])
@pytest.mark.parametrize("name", CASES)
def test_phases(spark, name, slice_ns):
    req, resp, want = CASES[name]
    df = frame(spark, [(True, e) for e in req] + [(False, e) for e in resp])
    p = pairing.phase_split(pairing.pair_requests(df, slice_ns=slice_ns))
    assert rows(p, "start_ns", "request_sent_time", "waiting_ttfb_time", "content_download_time", "request_total_time", "request_io", "response_io") == [want]


def test_continue(spark):
    q = [(True, (100000000, 1000, 174)), (False, (104000000, 1000, 44)), (True, (108000000, 5000, 10220)), (True, (108100000, 3000, 5840)), (True, (108150000, 500, 22)),
         (False, (601000000, 2000, 199)), (False, (601100000, 300, 5))]
    p = pairing.pair_requests(frame(spark, q), payload=True).withColumn("status_code", F.when(F.col("pair_no") == 1, 100).otherwise(200))
    m = pairing.phase_split(pairing.merge_continue(p))
    assert rows(m, "start_ns", "request_sent_time", "waiting_ttfb_time", "content_download_time", "request_total_time", "request_io", "response_io") == [
        (99999000, 8151000, 492848000, 102000, 501101000, 16256, 204)]
    assert bytes(m.first()["request_data"]) == b"q" * 12


def test_single_pairs(spark):
    ev = [(1, 1, s, t, l, r, q, 1, "a", "b", 2, i) for s, q, t, l, r, i in [
        (1, True, 100000000, 5000, 42, 5), (2, True, 100400000, 4000, 42, 6), (3, False, 101000000, 30000, 89, 5), (4, False, 101500000, 80000, 73, 6)]]
    df = spark.createDataFrame(ev, "pid long, fd int, seq long, ts_ns long, latency_ns long, res long, is_request boolean, sport int, sip string, dip string, dport int, dns_id long")
    p = pairing.phase_split_single(pairing.pair_dns_udp(df))
    assert rows(p, "start_ns", "request_sent_time", "waiting_ttfb_time", "content_download_time", "request_total_time", "request_io", "response_io") == [
        (100396000, 4000, 1020000, 80000, 1104000, 42, 73), (99995000, 5000, 970000, 30000, 1005000, 42, 89)]


def test_source_port_change_opens_a_pair(spark):
    a = frame(spark, [(False, (1, 1, 1)), (True, (10, 1, 1))], sport=1)
    b = frame(spark, [(True, (20, 1, 1)), (False, (30, 1, 1))], sport=2).withColumn("seq", F.col("seq") + 10)
    p = pairing.pair_requests(a.unionByName(b))
    assert rows(p, "pair_no", "n_req", "n_resp") == [(1, 1, 0), (2, 1, 1)]


@pytest.mark.parametrize("slice_ns", [1, 7, 50, 10 ** 9])
def test_hot_connection_equals_plain_scan(spark, slice_ns):
    """One connection with all rows: the sliced numbering equals a walk over the sorted events."""
    import random
    rnd = random.Random(5)
    evs = [(1, 1, i, rnd.randrange(400), 1, 1, rnd.random() < 0.5, rnd.choice([1, 1, 1, 2]), 7, None) for i in range(500)]
    want, state, pairs = {}, None, 0
    for e in sorted(evs, key=lambda e: (e[3], e[2])):
        q, sport = e[6], e[7]
        if q and (state is None or not state[0] or state[1] != sport):
            pairs += 1
        state = (q, sport)
        want[e[2]] = pairs
    got = {r["seq"]: r["pair_no"] for r in pairing.number_pairs(spark.createDataFrame(evs, SCHEMA), slice_ns).collect()}
    assert got == want


def test_snap_length(spark):
    df = spark.createDataFrame([(1, 1, i, i, 0, 600, True, 1, 7, bytearray(bytes([65 + i]) * 600)) for i in range(3)], SCHEMA)
    data = bytes(pairing.pair_requests(df, payload=True).first()["request_data"])
    assert data == b"A" * 600 + b"B" * 400


def test_classes(spark):
    df = spark.createDataFrame([("http", 400, True), ("http", 200, False), ("dns", 3, True), ("mysql", 0, True), ("dubbo", 21, True)], "p string, c int, answered boolean")
    out = df.select("p", "c", events.error_class(F.lit(True), F.col("answered"), events.protocol_error(F.col("p"), F.col("c"), True)).alias("e"),
                    events.slow_flag(F.lit(100_000_000), F.col("p")).alias("s"))
    assert rows(out) == [("dns", 3, 0, True), ("dubbo", 21, 3, False), ("http", 200, 2, False), ("http", 400, 3, False), ("mysql", 0, 0, True)]


def test_enrich_edges(spark):
    msg = [(bytearray(b"GET /test HTTP/1.1\r\nuber-trace-id: ab:1\r\n\r\n"), bytearray(b"HTTP/1.1 200 OK\r\n\r\n")), (bytearray(b"short"), None),
           (bytearray(b"ET /test?x=1 HTTP/1.1\r\n\r\n"), None), (bytearray(b"GET /x HTTP/1.1\r\n\r\n"), bytearray(b"HTTP/1.1 abc\r\n\r\n"))]
    out = enrich.enrich_http(spark.createDataFrame(msg, "request_data binary, response_data binary"))
    got = [tuple(r) for r in out.select("matched", "http_method", "content_key", "http_status_code", "trace_type", "trace_id").collect()]
    assert got == [(True, "GET", "/test", 200, "jaeger", "ab"), (False, None, None, None, None, None), (True, "GET", "/test", None, None, None), (False, None, None, None, None, None)]
    redis = [(bytearray(b"*2\r\n$3\r\nget\r\n$1\r\nk\r\n"), bytearray(b"-ERR x\r\n")), (bytearray(b"*2\r\n$3\r\nget\r\n$9\r\nk"), None), (bytearray(b"$3\r\nget"), None)]
    out = enrich.enrich_redis(spark.createDataFrame(redis, "request_data binary, response_data binary"))
    assert [tuple(r) for r in out.select("matched", "redis_command", "redis_error_msg").collect()] == [(True, "get", "ERR x"), (False, None, None), (True, "get", None)]


def test_null_keys_and_long_payloads(spark):
    events = spark.createDataFrame([
        (None, 3, 1, 100, 10, 600, 7, 5000, True, "q" * 600), (None, 3, 2, 200, 10, 900, 7, 5000, False, "r" * 900),
        (8, None, 3, 100, 10, 2000, 7, 5000, True, "s" * 2000), (8, None, 4, 200, 10, 1, 7, 5000, False, "t")],
        "pid long, fd long, seq long, ts_ns long, latency_ns long, res long, tid long, sport long, is_request boolean, data string")
    pairs = pairing.pair_requests(events, payload=True, snap=5000)
    got = sorted((str(r.pid), str(r.fd), len(r.request_data), len(r.response_data)) for r in pairs.collect())
    assert got == [("8", "None", 2000, 1), ("None", "3", 600, 900)]
    chained = pairing.merge_continue(pairs.withColumn("status_code", F.lit(200)), snap=5000)
    assert sorted(len(r.request_data) for r in chained.collect()) == [600, 2000]


def test_gates_keep_rows_without_the_tested_value(spark):
    from skeinwork.operators import events

    df = spark.createDataFrame([(None, None, 1, None), ("java", "tcp", 2, "read")], "comm string, l4 string, dport int, name string").withColumn("data", F.lit(b""))
    assert events.suppress_comm(df).count() == 2 and events.udp_dns_gate(df).count() == 2
    assert events.explode_multimsg(df.withColumn("res", F.lit(0).cast("long"))).count() == 2


def test_multimsg_is_linear_in_bytes(spark):
    """A buffer of 10 MB of four-byte messages, with other columns, a null and an empty buffer beside it."""
    import struct
    import time

    n = 10_000_000 // 8
    rows = [("sendmmsg", b"".join(struct.pack("<II", 4, k) for k in range(n)), 0, "big"), ("sendmmsg", None, 0, "null"), ("sendmmsg", b"", 0, "empty"),
            ("sendmmsg", struct.pack("<I", 9) + b"cut", 0, "cut"), ("write", b"plain", 5, "single"), (None, b"x", 1, "none")]
    df = spark.createDataFrame(rows, "name string, data binary, res int, kind string")
    start = time.time()
    out = events.explode_multimsg(df).groupBy("kind").agg(F.count("*"), F.max("part"), F.sum("res"), F.sum(F.octet_length("data")))
    got = {r[0]: tuple(r)[1:] for r in out.collect()}
    assert got == {"big": (n, n - 1, 4 * n, 4 * n), "cut": (1, 0, 3, 3), "single": (1, 0, 5, 5), "none": (1, 0, 1, 1)}
    assert time.time() - start < 60
