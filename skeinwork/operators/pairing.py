"""Requests and responses of a connection: pairing, phases, DNS matching, continued requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork import constants as C
from skeinwork.operators import scan

KEY = ["pid", "fd"]
_ORD = ["ts_ns", "seq"]


def number_pairs(events: DataFrame, slice_ns: int = scan.DEFAULT_SLICE_NS, keys: list[str] = KEY) -> DataFrame:
    """Add ``pair_no``: a request opens a pair unless the event before it is a request from the same source port.

    Responses before the first request get number 0. The numbering is a segmented running count: local counts per
    (key, slice) plus a scan over one summary row per slice, so a connection is never sorted in one task.
    """
    s = scan.SLICE
    sport = F.col("sport") if "sport" in events.columns else F.lit(0)
    rows = events.withColumn(s, scan.time_slice("ts_ns", slice_ns)).withColumn("__e", F.struct(
        F.col("is_request").alias("q"), sport.alias("p")))
    w = Window.partitionBy(*keys, s).orderBy(*_ORD)

    def opens(now: Column, before: Column) -> Column:
        return now["q"] & (~before["q"] | (before["p"] != now["p"]))

    before = F.lag("__e").over(w)
    # The first event of a slice is decided by the slice before it, so it counts 0 here.
    flagged = rows.withColumn("__open", F.when(before.isNotNull() & opens(F.col("__e"), before), 1).otherwise(0))
    order = F.struct(*_ORD)
    slices = flagged.groupBy(*keys, s).agg(F.min_by("__e", order).alias("__first"), F.max_by("__e", order).alias("__last"),
                                           F.sum("__open").alias("__n"))
    ws = Window.partitionBy(*keys).orderBy(s)
    prev = F.lag("__last").over(ws)
    head = F.when(prev.isNull(), F.col("__first.q")).otherwise(opens(F.col("__first"), prev)).cast("int")
    slices = slices.withColumn("__head", head)
    slices = slices.withColumn("__base", F.col("__head") + F.coalesce(
        F.sum(F.col("__n") + F.col("__head")).over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = flagged.withColumn("__local", F.sum("__open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = scan.join_same(local, slices.select(*keys, s, "__base"), [*keys, s])
    return out.select(*events.columns, (F.col("__base") + F.col("__local")).cast("long").alias("pair_no"))


def pair_requests(events: DataFrame, labels: list[str] = (), payload: bool = False, snap: int = C.SNAP_BYTES,
                  slice_ns: int = scan.DEFAULT_SLICE_NS) -> DataFrame:
    """One row per request/response pair of a connection with the first and last event of each side.

    ``labels`` are taken from the first request. With ``payload`` the data of each side is concatenated up to
    ``snap`` bytes.
    """
    return summarize_pairs(number_pairs(events, slice_ns), labels, payload, snap)


def summarize_pairs(numbered: DataFrame, labels: list[str] = (), payload: bool = False, snap: int = C.SNAP_BYTES) -> DataFrame:
    """Pairs of events that carry their ``pair_no``."""
    numbered = numbered.where(F.col("pair_no") > 0)
    q = F.col("is_request")
    ordq, ordr = F.when(q, F.struct(*_ORD)), F.when(~q, F.struct(*_ORD))
    aggs = []
    for side, flag, order in (("req", q, ordq), ("resp", ~q, ordr)):
        aggs += [F.min(F.when(flag, F.col("ts_ns"))).alias(f"first_{side}_ts"),
                 F.min_by("latency_ns", order).alias(f"first_{side}_latency"),
                 F.max(F.when(flag, F.col("ts_ns"))).alias(f"last_{side}_ts"),
                 F.count(F.when(flag, 1)).alias(f"n_{side}"),
                 F.coalesce(F.sum(F.when(flag, F.col("res"))), F.lit(0)).cast("long").alias(f"{side}_bytes")]
    if "tid" in numbered.columns:
        aggs += [F.min_by("tid", ordq).alias("request_tid"), F.min_by("tid", ordr).alias("response_tid")]
    aggs += [F.min_by(c, ordq).alias(c) for c in labels]
    pairs = numbered.groupBy(*KEY, "pair_no").agg(*aggs)
    if payload:
        pairs = scan.join_same(pairs, _payloads(numbered, snap), [*KEY, "pair_no"], "left")
    return pairs


def _payloads(numbered: DataFrame, snap: int) -> DataFrame:
    """Data of each side of a pair, cut at ``snap`` bytes.

    Every event with data adds at least one byte, so the first ``snap`` of them are enough; the row limit per group
    is pushed in front of the shuffle and bounds what one group can collect.
    """
    data = numbered.select(*KEY, "pair_no", "is_request", *_ORD, F.substring(F.col("data").cast("binary"), 1, snap).alias("data"))
    w = Window.partitionBy(*KEY, "pair_no", "is_request").orderBy(*_ORD)
    first = data.where(F.octet_length("data") > 0).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= snap)

    def joined(flag):
        parts = F.array_sort(F.collect_list(F.when(flag, F.struct(*_ORD, "data"))))
        return F.substring(F.aggregate(parts, F.lit(b""), lambda acc, e: F.concat(acc, e["data"])), 1, snap)

    return first.groupBy(*KEY, "pair_no").agg(joined(F.col("is_request")).alias("request_data"),
                                              joined(~F.col("is_request")).alias("response_data"))


def phase_split(pairs: DataFrame, connect: Column | None = None) -> DataFrame:
    """Start, phases, total and bytes of merged pairs; phases of a missing response are -1 and its duration is 0."""
    c = F.lit(0).cast("long") if connect is None else F.coalesce(connect, F.lit(0)).cast("long")
    answered = F.col("n_resp") > 0
    start = F.col("first_req_ts") - F.col("first_req_latency")
    return pairs.withColumns({
        "start_ns": start,
        "connect_time": c,
        "request_sent_time": F.col("last_req_ts") - F.col("first_req_ts") + F.col("first_req_latency"),
        "waiting_ttfb_time": F.when(answered, F.col("first_resp_ts") - F.col("first_resp_latency") - F.col("last_req_ts")).otherwise(-1),
        "content_download_time": F.when(answered, F.col("last_resp_ts") - F.col("first_resp_ts") + F.col("first_resp_latency")).otherwise(-1),
        "request_total_time": c + F.when(answered, F.col("last_resp_ts") - start).otherwise(0),
        "request_io": F.col("req_bytes"), "response_io": F.col("resp_bytes"),
    })


def phase_split_single(df: DataFrame) -> DataFrame:
    """Phases of one request event and at most one response event (req_ts, req_latency, resp_ts, resp_latency)."""
    answered = F.col("resp_ts").isNotNull()
    return df.withColumns({
        "start_ns": F.col("req_ts") - F.col("req_latency"),
        "connect_time": F.lit(0).cast("long"),
        "request_sent_time": F.col("req_latency"),
        "waiting_ttfb_time": F.when(answered, F.col("resp_ts") - F.col("resp_latency") - F.col("req_ts")).otherwise(-1),
        "content_download_time": F.when(answered, F.col("resp_latency")).otherwise(-1),
        "request_total_time": F.when(answered, F.col("resp_ts") + F.col("req_latency") - F.col("req_ts")).otherwise(0),
    })


def connect_fail_records(pairs: DataFrame) -> DataFrame:
    """Pairs that only have a connect: its latency is the connect and the total time, error type 1."""
    only = pairs.where((F.col("n_connect") > 0) & (F.col("n_req") == 0))
    return only.withColumns({
        "connect_time": F.col("connect_latency"), "request_total_time": F.col("connect_latency"),
        "request_tid": F.lit(0).cast("long"), "response_tid": F.lit(0).cast("long"), "is_error": F.lit(True),
        "error_type": F.lit(C.CONNECT_FAIL), "is_slow": F.lit(False), "dnat_ip": F.lit(""), "dnat_port": F.lit(-1).cast("long")})


def merge_continue(pairs: DataFrame, status: str = "status_code", chunk: int = 100_000, snap: int = C.SNAP_BYTES) -> DataFrame:
    """Put the request of a pair answered with status 100 in front of the next pair of the connection, up to ``snap`` bytes."""
    chunk_no = F.floor(F.col("pair_no") / F.lit(chunk))
    seen = scan.carry_last(pairs, KEY, ["pair_no"], {"__before": F.col(status)}, chunk_no)
    opened = F.when(F.coalesce("__before", F.lit(0)) == 100, 0).otherwise(1)
    grouped = scan.running_sum(seen, KEY, ["pair_no"], opened, "__group", chunk_no).drop("__before")
    n = F.col("pair_no")
    kept = {"first_req_ts": F.min("first_req_ts"), "first_req_latency": F.min_by("first_req_latency", n),
            "last_req_ts": F.max("last_req_ts"), "n_req": F.sum("n_req").cast("long"), "req_bytes": F.sum("req_bytes").cast("long"),
            "pair_no": F.min(n)}
    rest = [c for c in pairs.columns if c not in kept and c not in KEY and c != "request_data"]
    aggs = [v.alias(k) for k, v in kept.items()] + [F.max_by(c, n).alias(c) for c in rest]
    out = grouped.groupBy(*KEY, "__group").agg(*aggs).where(F.coalesce(F.col(status), F.lit(0)) != 100)
    if "request_data" in pairs.columns:
        out = scan.join_same(out, _chained_data(grouped, snap), [*KEY, "__group"], "left")
    return out.drop("__group")


def _chained_data(grouped: DataFrame, snap: int) -> DataFrame:
    """Request data of a chain cut to the snap length; as in ``_payloads`` the first ``snap`` parts are enough."""
    w = Window.partitionBy(*KEY, "__group").orderBy("pair_no")
    parts = grouped.where(F.octet_length("request_data") > 0).select(*KEY, "__group", "pair_no", "request_data")
    first = parts.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= snap)
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("pair_no", "request_data"))), F.lit(b""), lambda acc, e: F.concat(acc, e["request_data"]))
    return first.groupBy(*KEY, "__group").agg(F.substring(joined, 1, snap).alias("request_data"))


DNS_KEY = ["pid", "fd", "sip", "dip", "sport", "dport", "dns_id"]


def pair_dns_udp(events: DataFrame, slice_ns: int = scan.DEFAULT_SLICE_NS) -> DataFrame:
    """DNS over UDP: a response takes the pending request of its socket and id.

    A later request with the same id replaces the pending one and a response uses it up, so a response matches
    exactly when the event before it in its (socket, id) is a request. What is still pending is unanswered.
    """
    sl = scan.time_slice("ts_ns", slice_ns)
    me = F.struct("is_request", "ts_ns", "latency_ns", "res", "seq")
    seen = scan.carry_last(events, DNS_KEY, _ORD, {"__before": me}, sl)
    seen = scan.carry_next(seen, DNS_KEY, _ORD, {"__after": F.col("seq")}, sl)
    matched = seen.where(~F.col("is_request") & F.col("__before.is_request")).select(
        *DNS_KEY, F.col("__before.seq").alias("req_seq"), F.col("__before.ts_ns").alias("req_ts"),
        F.col("__before.latency_ns").alias("req_latency"), F.col("__before.res").alias("request_io"),
        F.col("seq").alias("resp_seq"), F.col("ts_ns").alias("resp_ts"), F.col("latency_ns").alias("resp_latency"),
        F.col("res").alias("response_io"))
    pending = seen.where(F.col("is_request") & F.col("__after").isNull()).select(
        *DNS_KEY, F.col("seq").alias("req_seq"), F.col("ts_ns").alias("req_ts"), F.col("latency_ns").alias("req_latency"),
        F.col("res").alias("request_io"))
    return matched.unionByName(pending, allowMissingColumns=True).withColumn("response_io", F.coalesce("response_io", F.lit(0)))


def pair_dns_multi(requests: DataFrame, responses: DataFrame, pair_key: list[str]) -> DataFrame:
    """Match every response of a merged pair to the first request with its id and domain.

    A response that finds none fails the whole pair (no rows); requests nobody asked for come out unanswered.
    """
    k = [*pair_key, "dns_id", "domain"]
    first = requests.groupBy(*k).agg(F.min_by(F.struct("req_seq", "req_ts", "req_latency"), F.struct("req_ts", "req_seq")).alias("q"))
    matched = responses.join(first, k, "left")
    failed = matched.where(F.col("q").isNull()).select(*pair_key).distinct()
    hits = (matched.where(F.col("q").isNotNull()).join(failed, pair_key, "left_anti")
            .select(*k, "q.*", "resp_seq", "resp_ts", "resp_latency"))
    # The first request of its id and domain is taken as soon as one response exists, later equal ones never are.
    taken = hits.select(*pair_key, "req_seq").distinct()
    open_ = (requests.join(failed, pair_key, "left_anti").join(taken, [*pair_key, "req_seq"], "left_anti")
             .select(*k, "req_seq", "req_ts", "req_latency"))
    return hits.unionByName(open_, allowMissingColumns=True)


def unanswered(requests: DataFrame, responses: DataFrame, key: list[str]) -> DataFrame:
    """Requests without a response, error type 2."""
    return requests.join(responses.select(*key).distinct(), key, "left_anti").withColumn("error_type", F.lit(C.NO_RESPONSE))
