"""Streams: timers, state across restarts, order of arrival, equality with the batch operators, one output per event."""

import random

import pytest
from conftest import rows
from test_metadata import CONNECT, CONNECT_ROWS

from skeinwork.operators import connects
from skeinwork.session import work_dir
from skeinwork.streaming import builtin, ordered, stateful
from skeinwork.streaming.run import STATE_CONF, run_append, start_append

S = 1_000_000_000
EVENT = "pid long, fd int, seq long, ts_ns long, latency_ns long, res long, is_request boolean, sport int, tid long"
PAIR = ["fd", "first_req_ts", "n_req", "n_resp", "last_resp_ts", "req_bytes"]


def feed(spark, plan, frames, delay="0 seconds", root=None):
    """Every frame is taken by a query that is started again from its checkpoint."""
    source, root = work_dir(spark, "feed"), root or work_dir(spark, "stream")
    for f in frames:
        f.write.mode("append").parquet(source)
        out = run_append(plan(spark.readStream.schema(f.schema).parquet(source), delay), root)
    return out


def state(spark, root, name="row"):
    return spark.read.format("statestore").option("stateVarName", name).load(f"{root}/checkpoint")


def ev(fd, seq, t, q, port=1):
    return (1, fd, seq, int(t * S), 10, 5, q, port, 7)


def test_pairing_timers(spark):
    a = spark.createDataFrame([ev(1, 1, 1, True), ev(1, 2, 2, False), ev(2, 3, 3, True), ev(3, 4, 4, True), ev(3, 5, 5, False)], EVENT)
    b = spark.createDataFrame([ev(3, 6, 14, False), ev(4, 7, 20, True)], EVENT)          # fd 1 idle 18 s, fd 3 goes on
    c = spark.createDataFrame([ev(4, 8, 125, False), ev(1, 9, 126, False)], EVENT)        # fd 2 unanswered 123 s, late response of fd 1
    root = work_dir(spark, "pair")
    got = feed(spark, lambda s, d: stateful.pair_stream(s, delay=d), [a, b, c], root=root)
    assert rows(got, "fd", "n_req", "n_resp", "resp_bytes") == [(1, 1, 1, 5), (2, 1, 0, 0), (3, 1, 2, 10)]
    # Connections without an open pair hold nothing.
    assert rows(state(spark, root), "key.fd", "value.n_req", "value.n_resp") == [(4, 1, 1)]


def plain_pairs(events, end, reuse=15, patience=120):
    """Pairs of one process's events by a loop over the sorted events, with the state at ``end``."""
    out, open_ = [], {}

    def done(fd, ns):
        p = open_.get(fd)
        if p and (p[4] or p[2]) // S + (reuse if p[3] else patience) <= ns // S:
            out.append((fd, *open_.pop(fd)))

    for _, fd, _, ts, _, res, q, port, _ in sorted(events, key=lambda e: (e[3], e[2])):
        done(fd, ts)
        p = open_.get(fd)
        if q and (p is None or p[3] or p[6] != port):
            if p:
                out.append((fd, *p))
            open_[fd] = [ts, 1, ts, 0, None, res, port]
        elif q:
            p[1], p[2], p[5] = p[1] + 1, ts, p[5] + res
        elif p:
            p[3], p[4] = p[3] + 1, ts
    for fd in list(open_):
        done(fd, end)
    return sorted(((r[0], r[1], r[2], r[4], r[5], r[6]) for r in out), key=str)


@pytest.mark.parametrize("cuts,delay", [((20, 40), 0), ((), 0), ((7, 30, 55), 200)])
def test_pairing_does_not_depend_on_batches_or_arrival(spark, cuts, delay):
    """In three batches, in one, and out of order within the watermark's delay."""
    rnd = random.Random(len(cuts))
    evs, t = [], 0
    for i in range(80):
        t += rnd.choice([1, 2, 14, 16, 60, 130])
        evs.append(ev(rnd.choice([1, 1, 1, 2]), i, t, rnd.random() < 0.5, rnd.choice([1, 1, 2])))
    given = list(evs)
    if delay:
        given.sort(key=lambda e: e[3] + rnd.randrange(delay) * S)
    frames = [spark.createDataFrame(given[i:j], EVENT) for i, j in zip((0, *cuts), (*cuts, len(given)))]
    end = (t - delay) * S
    got = feed(spark, lambda s, d: stateful.pair_stream(s, delay=d), frames, delay=f"{delay} seconds")
    found = sorted((tuple(r) for r in got.select(*PAIR).collect()), key=str)
    assert found == plain_pairs([e for e in evs if e[3] <= end], end)
    assert len({r[:2] for r in found}) == len(found)


@pytest.mark.parametrize("buckets", [1, 5])
def test_pairs_do_not_depend_on_buckets(spark, buckets):
    """Connections that share state, one without a number among them, end each by its own clock."""
    rnd, evs, t = random.Random(7), [], 0
    for i in range(80):
        t += rnd.choice([1, 2, 14, 16, 60])
        evs.append(ev(rnd.choice([1, 2, 3, 4]), i, t, rnd.random() < 0.5, rnd.choice([1, 1, 2])))
    frames = [spark.createDataFrame(evs[i:j], EVENT) for i, j in ((0, 30), (30, 31), (31, 80))]
    null_fd = spark.createDataFrame([(1, None, 90, S, 10, 5, True, 1, 7), (1, None, 91, 2 * S, 10, 5, False, 1, 7)], EVENT)
    got = feed(spark, lambda s, d: stateful.pair_stream(s, delay=d, buckets=buckets), [frames[0].union(null_fd), *frames[1:]])
    found = [tuple(r) for r in got.select(*PAIR).collect()]
    assert sorted((r for r in found if r[0] is not None), key=str) == plain_pairs(evs, t * S)
    assert [r for r in found if r[0] is None] == [(None, S, 1, 1, 2 * S, 5)]


def test_pairing_payload_is_bounded(spark):
    events = [(1, 1, i, (i + 1) * S // 1000, 10, 100, i == 0 or i % 500 > 0, 1, 7, b"x" * 100) for i in range(1000)] + [(1, 2, 2000, 90 * S, 10, 1, True, 1, 7, b"")]
    frames = [spark.createDataFrame(events[i:j], EVENT + ", data binary") for i, j in ((0, 600), (600, 1001))]
    root = work_dir(spark, "pair")
    got = feed(spark, lambda s, d: stateful.pair_stream(s, payload=True, snap=250, delay=d), frames, root=root)
    assert [(r.n_req, len(r.request_data), len(r.response_data)) for r in got.collect()] == [(500, 250, 100)]
    assert sorted((r.value.n_req, len(r.value.request_data)) for r in state(spark, root).collect()) == [(1, 0), (499, 250)]


def test_state_settings_are_the_querys_own(spark):
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    source = work_dir(spark, "feed")
    spark.createDataFrame([ev(1, 1, 1, True)], EVENT).write.parquet(source)
    query = start_append(stateful.pair_stream(spark.readStream.schema(spark.read.parquet(source).schema).parquet(source), delay="0 seconds"), work_dir(spark, "stream"))
    query.awaitTermination()
    assert {k: spark.conf.get(k, None) for k in STATE_CONF} == before
    assert any("rocksdbCommitFlushLatency" in str(p["stateOperators"]) or "rocksdb" in str(p["stateOperators"]).lower() for p in query.recentProgress)


def test_dns_replaced_expired_and_late(spark):
    schema = EVENT + ", sip string, dip string, dport int, dns_id long"

    def q(seq, t, is_request, id_):
        return (*ev(1, seq, t, is_request), "a", "b", 53, id_)

    frames = [spark.createDataFrame(f, schema) for f in (
        [q(1, 1, True, 7), q(2, 2, True, 7), q(3, 3, True, 8)],      # the second takes the place of the first
        [q(4, 4, False, 7), q(5, 5, False, 7), q(6, 10, True, 9)],   # answers the second; nothing is pending then
        [q(7, 124, False, 8), q(8, 125, False, 9)])]                 # 8 has expired at 123, 9 has not
    root = work_dir(spark, "dns")
    got = feed(spark, lambda s, d: stateful.dns_stream(s, delay=d), frames, root=root)
    assert rows(got, "dns_id", "req_seq", "resp_seq") == [(7, 2, 4), (8, 3, None), (9, 6, 8)]
    assert state(spark, root, "pending").count() == 0


def test_connects_across_batches(spark):
    data = sorted(((r[0], r[1] * 1_000_000, *r[2:]) for r in CONNECT_ROWS), key=lambda r: r[1])
    frames = [spark.createDataFrame(data[i:i + 8], CONNECT) for i in range(0, len(data), 8)]
    none = spark.createDataFrame([], "pid long, local_ip string, local_port int, remote_ip string, remote_port int, state string")
    # A last event of its own moves the watermark behind the others.
    last = spark.createDataFrame([(999, max(r[1] for r in data) + 1_000_000, "sendto", "x", 9, "b", 80, 0, 0, 0, 1)], CONNECT)
    got = feed(spark, lambda s, d: stateful.connect_stream(s, none, wait_s=10 ** 6, delay=d), [*frames, last])
    want = connects.finished(connects.attempts(spark.createDataFrame(data, CONNECT)))
    cols = ["src_port", "success", "errno", "ts_ns", "connect_duration_nanoseconds_total"]
    assert rows(got, *cols) == rows(want, *cols)


def test_connects_expire_by_socket(spark):
    """After 10 s: established, gone, still connecting (an event decides it later), process unknown."""
    a = [(10 * p + k, (p + k) * S, n, "a", p, "b", 80, r, 0, 0, pid) for p in (1, 2, 3, 4) for k, (n, r, pid) in enumerate([("tcp_connect", 0, 0), ("connect", -115, 5 if p < 4 else 0)])]
    b = [(100, 30 * S, "sendto", "a", 3, "b", 80, 0, 0, 0, 1), (101, 31 * S, "sendto", "x", 9, "b", 80, 0, 0, 0, 1)]
    socks = spark.createDataFrame([(5, "a", 1, "b", 80, "01"), (5, "a", 3, "b", 80, "02"), (6, "a", 2, "b", 80, "01")], "pid long, local_ip string, local_port int, remote_ip string, remote_port int, state string")
    frames = [spark.createDataFrame(x, CONNECT) for x in (a, b)]
    got = feed(spark, lambda s, d: stateful.connect_stream(s, socks, delay=d), frames)
    assert rows(got, "src_port", "success", "ts_ns") == [(1, True, 2 * S), (2, False, 3 * S), (3, True, 30 * S)]


def test_connects_late_beside_others(spark):
    """A late event that comes with one that is not, of the same connection, is dropped; null fields stay null."""
    def e(seq, t, name, ip="a", ret=0, pid=None):
        return (seq, t * S, name, ip, 1, None, 80, ret, 0, 0, pid)

    frames = [[e(1, 1, "tcp_connect"), e(2, 100, "sendto", "x")], [e(3, 50, "sendto"), e(None, 101, "connect", ret=None), e(4, 102, "connect", ret=-111, pid=5)], [e(5, 200, "sendto", "x")]]
    none = spark.createDataFrame([], "pid long, local_ip string, local_port int, remote_ip string, remote_port int, state string")
    got = feed(spark, lambda s, d: stateful.connect_stream(s, none, delay=d), [spark.createDataFrame(f, CONNECT) for f in frames])
    assert rows(got, "src_ip", "dst_ip", "success", "errno", "ts_ns", "pid") == [("a", None, False, None, 101 * S, 0)]


def test_connects_share_state(spark):
    """A state per bucket, with its waiting events and sockets, not some for every connection."""
    source, n = work_dir(spark, "feed"), 3000
    data = [(i, i * S // 1000, "tcp_connect", "a", i + 1, "b", 80, 0, 0, 0, 0) for i in range(n)]
    spark.createDataFrame(data, CONNECT).write.parquet(source)
    socks = spark.createDataFrame([(5, "a", i + 1, "b", 80, "01") for i in range(n)], "pid long, local_ip string, local_port int, remote_ip string, remote_port int, state string")
    plan = stateful.connect_stream(spark.readStream.schema(spark.read.parquet(source).schema).parquet(source), socks, delay="100 seconds")
    query = start_append(plan, work_dir(spark, "stream"))
    query.awaitTermination()
    assert max(sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress) < 2.5 * n


def test_totals_expire(spark):
    frames = [spark.createDataFrame([(k, v, t * S)], "k string, v long, ts_ns long") for k, v, t in [("a", 1, 1), ("a", 2, 10), ("b", 5, 400), ("b", 1, 401), ("a", 7, 402)]]
    got = feed(spark, lambda s, d: stateful.totals_stream(s, ["k"], ["v"], delay=d), frames)
    assert rows(got, "k", "v", "expired") == [("a", 1, False), ("a", 3, False), ("a", 3, True), ("a", 7, False), ("b", 5, False), ("b", 6, False)]


def test_totals_of_a_frequent_label_set(spark):
    data = [("hot", 1, i * 1000) for i in range(1, 20_001)] + [("cold", 1, S)]
    got = feed(spark, lambda s, d: stateful.totals_stream(s, ["k"], ["v"], delay=d), [spark.createDataFrame(data, "k string, v long, ts_ns long").repartition(3)])
    assert rows(got, "k", "v") == [("cold", 1), ("hot", 20_000)]


def test_nat_time_to_live(spark):
    cols = "id long, ts_ns long, src_ip string, src_port long, dst_ip string, dst_port long, dnat_ip string, dnat_port long, is_lookup boolean"
    def row(i, t, port, look):
        return (i, t * S, "s", port, "d", 80, None if look else "n", None if look else 8, look)
    frames = [spark.createDataFrame(r, cols) for r in ([row(1, 1, 1, False), row(2, 1, 2, False)], [row(3, 60, 1, True)], [row(4, 500, 1, True), row(5, 500, 2, True)])]
    root = work_dir(spark, "nat")
    got = feed(spark, lambda s, d: stateful.nat_stream(s, delay=d), frames, root=root)
    assert rows(got, "id", "dnat_ip") == [(3, "n"), (4, "n"), (5, None)]
    assert rows(state(spark, root), "key.src_port") == [(1,)]


def test_metadata_updates_and_what_is_open(spark):
    cols = "ip string, uid string, op string, ts_ns long, pod string"
    frames = [spark.createDataFrame(f, cols) for f in ([("i", "1", "add", S, "a"), ("i", "2", "add", 2 * S, "b")], [("i", "1", "update", 3 * S, "a2"), ("i", "9", "delete", 4 * S, "")], [("i", "1", "delete", 5 * S, ""), ("i", "2", "update", 6 * S, "b2")])]
    root = work_dir(spark, "metadata")
    got = feed(spark, lambda s, d: stateful.metadata_stream(s, ["pod"], delay=d), frames, root=root)
    assert rows(got, "uid", "valid_from", "valid_to", "pod") == [("1", S, 3 * S, "a"), ("1", 3 * S, 5 * S, "a2"), ("2", 2 * S, 6 * S, "b")]
    assert rows(stateful.open_metadata(spark, root), "uid", "valid_from", "pod") == [("2", 6 * S, "b2")]


def test_metadata_batch_writes_its_changes_only(spark):
    """Bytes of a batch's state files follow the batch, not the entries that are open."""
    import glob
    import os
    cols = "ip string, uid string, op string, ts_ns long, pod string"
    big = spark.createDataFrame([("i", str(k), "add", S + k, f"pod-{k}" * 20) for k in range(3000)], cols)
    small = [spark.createDataFrame([("i", str(k), "delete", (2 + k) * S, "")], cols) for k in (1, 2)]
    root = work_dir(spark, "metadata")
    feed(spark, lambda s, d: stateful.metadata_stream(s, ["pod"], delay=d), [big, *small], root=root)
    sizes = {}
    for path in glob.glob(f"{root}/checkpoint/state/0/*/*.changelog"):
        version = int(os.path.basename(path).split(".")[0].split("_")[0])
        sizes[version] = sizes.get(version, 0) + os.path.getsize(path)
    versions = sorted(sizes)
    assert sum(sizes[v] for v in versions[-2:]) < max(sizes.values()) / 20, sizes


def _puts(plan, source, root):
    query = start_append(plan(source, "0 seconds"), root)
    query.awaitTermination()
    return sum(o["customMetrics"]["rocksdbPutCount"] for p in query.recentProgress for o in p["stateOperators"])


def test_metadata_calls_the_state_store_per_bucket(spark, monkeypatch):
    """Entries that begin and end in a batch do not cost writes each."""
    monkeypatch.setattr(ordered, "BUCKETS", 64, raising=False)
    n, cols = 5000, "ip string, uid string, op string, ts_ns long, pod string"
    source, root = work_dir(spark, "feed"), work_dir(spark, "metadata")
    ids = spark.range(n).selectExpr("'i' ip", "cast(id as string) uid", "explode(array('add', 'delete')) op", "id")
    changes = ids.selectExpr("ip", "uid", "op", f"{S} + id + if(op = 'delete', {n}, 0) ts_ns", "'p' pod")
    changes.union(spark.createDataFrame([("i", "last", "add", 9 * S, "p")], cols)).write.parquet(source)
    puts = _puts(lambda s, d: stateful.metadata_stream(s, ["pod"], delay=d), spark.readStream.schema(cols).parquet(source), root)
    assert puts < 2 * n
    got = spark.read.parquet(f"{root}/out")
    assert got.count() == got.where(f"valid_to = valid_from + {n}").select("uid").distinct().count() == n


def test_totals_call_the_state_store_per_bucket(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKETS", 16, raising=False)
    n, root = 2000, work_dir(spark, "totals")
    source = work_dir(spark, "feed")
    spark.range(n).selectExpr("id k", "1L v", f"{S} + id ts_ns").union(spark.createDataFrame([(n, 1, 9 * S)], "k long, v long, ts_ns long")).write.parquet(source)
    puts = _puts(lambda s, d: stateful.totals_stream(s, ["k"], ["v"], delay=d), spark.readStream.schema("k long, v long, ts_ns long").parquet(source), root)
    assert puts < 2 * n
    assert spark.read.parquet(f"{root}/out").where("v = 1 AND NOT expired").count() == n + 1


def test_pairs_call_the_state_store_per_bucket(spark):
    """Connections that begin and end in a batch do not cost writes each."""
    n, source, root = 2000, work_dir(spark, "feed"), work_dir(spark, "pairs")
    every = spark.range(n).selectExpr("1L pid", "int(id) fd", "explode(array(true, false)) is_request", "id").selectExpr(
        "pid", "fd", "id seq", f"{S} + id + if(is_request, 0, {n}) ts_ns", "10L latency_ns", "5L res", "is_request", "1 sport", "7L tid")
    every.union(spark.createDataFrame([ev(n, n, 90, True)], EVENT)).write.parquet(source)
    puts = _puts(lambda s, d: stateful.pair_stream(s, delay=d, buckets=16), spark.readStream.schema(every.schema).parquet(source), root)
    assert puts < 2 * n
    assert spark.read.parquet(f"{root}/out").where("n_req = 1 AND n_resp = 1").count() == n


def test_threads_call_the_state_store_per_bucket(spark):
    n, source, root = 2000, work_dir(spark, "feed"), work_dir(spark, "threads")
    cols = "pid long, tid long, ts_ns long, name string"
    both = spark.range(n).selectExpr("1L pid", "id tid", "explode(array('read', 'procexit')) name")
    every = both.selectExpr("pid", "tid", f"if(name = 'read', {S}, {2 * S}) + tid ts_ns", "name")
    every.union(spark.createDataFrame([(1, n, 90 * S, "read")], cols)).write.parquet(source)
    puts = _puts(lambda s, d: stateful.thread_exit_stream(s, delay=d, buckets=16), spark.readStream.schema(cols).parquet(source), root)
    assert puts < 2 * n
    got = spark.read.parquet(f"{root}/out")
    assert got.count() == got.where(f"ts_ns = {2 * S} + tid AND exit_ns = ts_ns").select("tid").distinct().count() == n


@pytest.mark.parametrize("buckets", [1, 1 << 10])
def test_totals_do_not_depend_on_buckets(spark, monkeypatch, buckets):
    """Keys of one bucket, null among them, expire each by its own clock, also while others are updated."""
    monkeypatch.setattr(ordered, "BUCKETS", buckets, raising=False)
    rnd, events, t = random.Random(3), [], 0
    for _ in range(60):
        t += rnd.choice([1, 40, 150])
        events.append((rnd.choice([None, "a", "a", "b", "c"]), rnd.choice([1, 2, None]), t * S))
    frames = [spark.createDataFrame(events[i:i + 20], "k string, v long, ts_ns long") for i in (0, 20, 40)]
    got = feed(spark, lambda s, d: stateful.totals_stream(s, ["k"], ["v"], delay=d), frames)
    want, held = [], {}
    for i, (k, v, at) in enumerate(events):
        if k in held and held[k][1] + 300 * S < at:
            want.append((k, held.pop(k)[0]))
        held[k] = (held.get(k, (0, 0))[0] + (v or 0), at)
    want += [(k, total) for k, (total, last) in held.items() if last + 300 * S < t * S]
    assert rows(got.where("expired"), "k", "v") == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_thread_exit(spark):
    frames = [spark.createDataFrame(r, "pid long, tid long, ts_ns long, name string") for r in ([(1, 1, S, "read"), (1, 1, 2 * S, "procexit"), (1, 2, 3 * S, "read")], [(1, 2, 13 * S, "read"), (1, 1, 13 * S, "read")])]
    root = work_dir(spark, "threads")
    got = feed(spark, lambda s, d: stateful.thread_exit_stream(s, delay=d), frames, root=root)
    assert rows(got, "pid", "tid", "ts_ns", "exit_ns") == [(1, 1, 2 * S, 2 * S)]
    # The number is used again by a new thread.
    assert rows(state(spark, root), "key.tid", "value.ts_ns") == [(1, 13 * S), (2, 13 * S)]


def test_transactions_forget_their_entries(spark):
    cols = "trace_id string, pid long, ts_ns long, is_entry int, url string, protocol string"
    frames = [spark.createDataFrame(f, cols) for f in (
        [("t", 1, S, 1, "/a", "http"), ("t", 1, 2 * S, 1, "/b", "http"), ("t", 1, 4 * S, 0, "", "http"), ("u", 1, S, 1, "/c", "http")],
        [("t", 1, 5 * S, 0, "", "http"), ("u", 1, 130 * S, 0, "", "http"), ("v", 1, 131 * S, 1, "/d", "http")],
        [("v", 1, 500 * S, 1, "/e", "http")])]
    source, root, sizes = work_dir(spark, "feed"), work_dir(spark, "stream"), []
    for f in frames:
        f.write.mode("append").parquet(source)
        plan = stateful.apm_stream(spark.readStream.schema(f.schema).parquet(source), slow_ms=500, delay="0 seconds")
        query = start_append(plan, root)
        query.awaitTermination()
        sizes.append(max((sum(o["numRowsTotal"] for o in p["stateOperators"]), p["batchId"]) for p in query.recentProgress[-1:])[0])
    got = spark.read.parquet(f"{root}/out")
    assert rows(got, "trace_id", "start_ns", "request_total_time", "content_key") == [("t", 2 * S, 2 * S, "/b"), ("t", 2 * S, 3 * S, "/b")]
    # Three entries, an exit and what it met; at the end the last entry only.
    assert sizes[0] == 5 and sizes[-1] == 1, sizes


def test_segments_drop_late(spark):
    root = work_dir(spark, "seg-in")
    schema = "pid long, tid long, seq long, start_ns long, end_ns long"
    out = work_dir(spark, "seg-out")
    for data in ([(1, 1, 1, 100 * S, 102 * S)], [(1, 1, 2, 200 * S, 200 * S)], [(1, 1, 3, 101 * S, 101 * S)], [(1, 1, 4, 300 * S, 300 * S)]):
        spark.createDataFrame(data, schema).write.mode("append").parquet(root)
        got = run_append(builtin.segments(spark.readStream.schema(schema).parquet(root)), out)
    assert rows(got, "second", "n") == [(100, 1), (101, 1), (102, 1), (200, 1)]


def test_segments_of_events_that_are_late_in_part(spark):
    """The watermark is 160 s when they come: their seconds from 160 on count, in threads that were there before and in new ones."""
    schema = "pid long, tid long, seq long, start_ns long, end_ns long"
    frames = [[(1, 1, 1, 100 * S, 102 * S)], [(9, 9, 2, 200 * S, 200 * S)], [(1, 1, 3, 150 * S, 170 * S), (2, 2, 4, 170 * S, 150 * S), (5, 5, 5, 130 * S, 159 * S), (1, 1, 6, 160 * S, 161 * S)],
              [(1, 1, 7, 300 * S, None)], [(9, 9, 8, 400 * S, 400 * S)]]
    got = feed(spark, lambda s, d: builtin.segments(s), [spark.createDataFrame(f, schema) for f in frames])
    want = [(1, s, [1]) for s in (100, 101, 102)] + [(1, s, [3, 6] if s < 162 else [3]) for s in range(160, 171)] + [(2, s, [4]) for s in range(160, 171)] + [(9, 200, [2])]
    assert sorted((r.pid, r.second, [e.seq for e in r.events]) for r in got.collect()) == want
    assert rows(got.where("n <> size(events)")) == []


def test_segments_of_threads_and_payloads_without_value(spark):
    data = [(None, 1, None, "b", 5 * S, 6 * S), (None, 1, 0, None, 6 * S, 6 * S), (0, 1, 7, "a", 6 * S, 200 * S), (0, None, (1 << 60) + 1, "a", 6 * S, 6 * S), (8, 8, 8, "c", 300 * S, 300 * S)]
    frame = spark.createDataFrame(data, "pid long, tid int, seq long, name string, start_ns long, end_ns long")
    got = feed(spark, lambda s, d: builtin.segments(s, payload=["seq", "name"], buckets=3), [frame])
    found = {(r.pid, r.tid, r.second): [tuple(e) for e in r.events] for r in got.collect()}
    assert {k: v for k, v in found.items() if k[2] < 7} == {
        (None, 1, 5): [(None, "b")], (None, 1, 6): [(None, "b"), (0, None)], (0, 1, 6): [(7, "a")], (0, None, 6): [((1 << 60) + 1, "a")]}
    assert sorted(k[2] for k in found if k[:2] == (0, 1)) == list(range(6, 201))


def test_segments_share_state(spark):
    """A state per bucket, not one for every thread and second."""
    source = work_dir(spark, "seg-in")
    spark.createDataFrame([(i, i, i, i * S // 100, i * S // 100 + 5 * S) for i in range(1000)], "pid long, tid long, seq long, start_ns long, end_ns long").write.parquet(source)
    query = start_append(builtin.segments(spark.readStream.schema(spark.read.parquet(source).schema).parquet(source), delay="100 seconds"), work_dir(spark, "seg-out"))
    query.awaitTermination()
    assert max(sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress) < 3000


def test_trigger_prefers_agent(spark):
    root = work_dir(spark, "trig-in")
    schema = "content_key string, pid long, ts_ns long, is_slow boolean, is_server boolean, from_apm boolean"
    spark.createDataFrame([("/a", 1, S, True, True, False), ("/a", 1, 2 * S, True, True, False), ("/a", 1, 6 * S, True, True, False), ("/a", 2, S, True, True, False), ("/a", 2, S, True, True, True),
                           ("/b", 1, S, False, True, False), ("/c", 1, S, True, False, False)], schema).write.parquet(root)
    apm = spark.createDataFrame([(2,)], "pid long")
    got = run_append(builtin.trigger(spark.readStream.schema(schema).parquet(root), apm), work_dir(spark, "trig"))
    assert rows(got) == [("/a", 1, 0), ("/a", 1, 1), ("/a", 2, 0)]
