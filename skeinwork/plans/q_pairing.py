"""Queries for request pairing and phases."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwork.functions.payload import utf8_text
from skeinwork.operators import events, pairing
from skeinwork.plans.catalog import query
from skeinwork.plans.q_filters import _utf8_sql

# Socket events with direction; NUMBERED gives each its pair number, PAIRS one row per pair.
_EVENTS_SQL = """SELECT pid, fd, seq, ts_ns, latency_ns, res, tid, sport,
  CASE WHEN name IN ('read', 'recvfrom') THEN is_server_fd ELSE NOT is_server_fd END AS is_request
  FROM v_socket_events WHERE name <> 'connect'"""


def _numbered(src):
    return f"""SELECT *, sum(CASE WHEN is_request AND (pq IS NULL OR NOT pq OR ps <> sport) THEN 1 ELSE 0 END)
      OVER (PARTITION BY pid, fd ORDER BY ts_ns, seq) AS pair_no FROM (
      SELECT *, lag(is_request) OVER (PARTITION BY pid, fd ORDER BY ts_ns, seq) AS pq,
        lag(sport) OVER (PARTITION BY pid, fd ORDER BY ts_ns, seq) AS ps FROM ({src}) e) l"""


def _pairs(src, extra=""):
    return f"""SELECT pid, fd, CAST(pair_no AS BIGINT) AS pair_no, min(CASE WHEN is_request THEN ts_ns END) AS first_req_ts,
      arg_min(latency_ns, CASE WHEN is_request THEN ts_ns + seq % 1000 END) AS first_req_latency,
      max(CASE WHEN is_request THEN ts_ns END) AS last_req_ts, count(*) FILTER (is_request) AS n_req,
      CAST(coalesce(sum(res) FILTER (is_request), 0) AS BIGINT) AS req_bytes, min(CASE WHEN NOT is_request THEN ts_ns END) AS first_resp_ts,
      arg_min(latency_ns, CASE WHEN NOT is_request THEN ts_ns + seq % 1000 END) AS first_resp_latency,
      max(CASE WHEN NOT is_request THEN ts_ns END) AS last_resp_ts, count(*) FILTER (NOT is_request) AS n_resp,
      CAST(coalesce(sum(res) FILTER (NOT is_request), 0) AS BIGINT) AS resp_bytes {extra}
      FROM ({_numbered(src)}) n WHERE pair_no > 0 GROUP BY pid, fd, pair_no"""


_TIDS = """, arg_min(tid, CASE WHEN is_request THEN ts_ns + seq % 1000 END) AS request_tid,
  arg_min(tid, CASE WHEN NOT is_request THEN ts_ns + seq % 1000 END) AS response_tid"""
PAIRS_SQL = _pairs(_EVENTS_SQL, _TIDS)
MESSAGES_SQL = "SELECT *, 0 AS sport FROM v_messages"
_PHASES = """connect_time, request_sent_time, waiting_ttfb_time, content_download_time, request_total_time, request_io, response_io"""


def socket_events(env):
    ev = env.v_socket_events.withColumn("is_request", events.is_request(F.col("name"), F.col("is_server_fd")))
    return ev.where(F.col("is_request").isNotNull())


@query("pair_requests", PAIRS_SQL)
def pair_requests(env):
    return pairing.pair_requests(socket_events(env))


_PAYLOAD = f"""SELECT pid, fd, CAST(pair_no AS BIGINT) AS pair_no, string_agg(CASE WHEN is_request THEN data ELSE '' END, '' ORDER BY ts_ns, seq) AS q,
  string_agg(CASE WHEN is_request THEN '' ELSE data END, '' ORDER BY ts_ns, seq) AS r
  FROM ({_numbered("SELECT pid, fd, seq, ts_ns, is_request, 0 AS sport, data FROM v_messages")}) n WHERE pair_no > 0 GROUP BY pid, fd, pair_no"""


@query("pair_requests_payload", f"SELECT pid, fd, pair_no, {_utf8_sql('q', 1000)} AS request_data, {_utf8_sql('r', 1000)} AS response_data FROM ({_PAYLOAD}) p")
def pair_requests_payload(env):
    p = pairing.pair_requests(env.v_messages, payload=True)
    return p.select("pid", "fd", "pair_no", *[F.coalesce(utf8_text(F.col(c)), F.lit("")).alias(c) for c in ("request_data", "response_data")])


@query("phase_split", f"""
SELECT pid, fd, pair_no, first_req_ts - first_req_latency AS start_ns, CAST(0 AS BIGINT) AS connect_time,
  last_req_ts - first_req_ts + first_req_latency AS request_sent_time,
  CASE WHEN n_resp > 0 THEN first_resp_ts - first_resp_latency - last_req_ts ELSE -1 END AS waiting_ttfb_time,
  CASE WHEN n_resp > 0 THEN last_resp_ts - first_resp_ts + first_resp_latency ELSE -1 END AS content_download_time,
  CASE WHEN n_resp > 0 THEN last_resp_ts - (first_req_ts - first_req_latency) ELSE 0 END AS request_total_time,
  req_bytes AS request_io, resp_bytes AS response_io FROM ({_pairs(MESSAGES_SQL)}) p""")
def phase_split(env):
    p = pairing.phase_split(pairing.pair_requests(env.v_messages))
    return p.select("pid", "fd", "pair_no", "start_ns", *[c.strip() for c in _PHASES.split(",")])


_DNS_SQL = """SELECT pid, fd, seq, ts_ns, latency_ns, res, '10.0.0.1' AS sip, '10.0.0.2' AS dip, sport, dport, k % 8 AS dns_id,
  CASE WHEN name IN ('read', 'recvfrom') THEN is_server_fd ELSE NOT is_server_fd END AS is_request
  FROM v_socket_events WHERE name <> 'connect' AND dport = 53"""
_DNS_W = "PARTITION BY pid, fd, dns_id ORDER BY ts_ns, seq"
_DNS_PAIRS = f"""SELECT pid, fd, dns_id, CASE WHEN is_request THEN seq ELSE p_seq END AS req_seq,
  CASE WHEN is_request THEN ts_ns ELSE p_ts END AS req_ts, CASE WHEN is_request THEN latency_ns ELSE p_lat END AS req_latency,
  CASE WHEN is_request THEN res ELSE p_res END AS request_io, CASE WHEN NOT is_request THEN seq END AS resp_seq,
  CASE WHEN NOT is_request THEN ts_ns END AS resp_ts, CASE WHEN NOT is_request THEN latency_ns END AS resp_latency,
  CASE WHEN is_request THEN 0 ELSE res END AS response_io
  FROM (SELECT *, lag(is_request) OVER ({_DNS_W}) AS p_q, lag(seq) OVER ({_DNS_W}) AS p_seq, lag(ts_ns) OVER ({_DNS_W}) AS p_ts,
    lag(latency_ns) OVER ({_DNS_W}) AS p_lat, lag(res) OVER ({_DNS_W}) AS p_res, lead(seq) OVER ({_DNS_W}) AS n_seq FROM ({_DNS_SQL}) d) w
  WHERE (NOT is_request AND p_q) OR (is_request AND n_seq IS NULL)"""


def dns_events(env):
    return socket_events(env).where("dport = 53").withColumns(
        {"sip": F.lit("10.0.0.1"), "dip": F.lit("10.0.0.2"), "dns_id": F.col("k") % 8})


@query("pair_dns_udp", _DNS_PAIRS)
def pair_dns_udp(env):
    return pairing.pair_dns_udp(dns_events(env)).drop("sip", "dip", "sport", "dport")


@query("phase_split_single", f"""
SELECT pid, fd, dns_id, req_seq, req_ts - req_latency AS start_ns, CAST(0 AS BIGINT) AS connect_time, req_latency AS request_sent_time,
  CASE WHEN resp_ts IS NULL THEN -1 ELSE resp_ts - resp_latency - req_ts END AS waiting_ttfb_time,
  CASE WHEN resp_ts IS NULL THEN -1 ELSE resp_latency END AS content_download_time,
  CASE WHEN resp_ts IS NULL THEN 0 ELSE resp_ts + req_latency - req_ts END AS request_total_time, request_io, response_io
FROM ({_DNS_PAIRS}) p""")
def phase_split_single(env):
    p = pairing.phase_split_single(pairing.pair_dns_udp(dns_events(env)))
    return p.select("pid", "fd", "dns_id", "req_seq", "start_ns", *[c.strip() for c in _PHASES.split(",")])


_MULTI_SQL = """SELECT pid, fd, CAST(floor(ts_ns / 600000000000) AS BIGINT) AS slot, seq, ts_ns, latency_ns, k % 3 AS dns_id, concat('d', k % 2) AS domain,
  CASE WHEN name IN ('read', 'recvfrom') THEN is_server_fd ELSE NOT is_server_fd END AS is_request FROM v_socket_events WHERE name <> 'connect'"""


@query("pair_dns_multi", f"""
WITH e AS ({_MULTI_SQL}), q AS (SELECT * FROM e WHERE is_request), r AS (SELECT * FROM e WHERE NOT is_request),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid, fd, slot, dns_id, domain ORDER BY ts_ns, seq) AS rn FROM q) x WHERE rn = 1),
m AS (SELECT r.pid, r.fd, r.slot, r.dns_id, r.domain, f.seq AS req_seq, f.ts_ns AS req_ts, f.latency_ns AS req_latency, r.seq AS resp_seq,
  r.ts_ns AS resp_ts, r.latency_ns AS resp_latency FROM r LEFT JOIN f USING (pid, fd, slot, dns_id, domain)),
bad AS (SELECT DISTINCT pid, fd, slot FROM m WHERE req_seq IS NULL)
SELECT * FROM m WHERE (pid, fd, slot) NOT IN (SELECT (pid, fd, slot) FROM bad)
UNION ALL SELECT pid, fd, slot, dns_id, domain, seq, ts_ns, latency_ns, NULL, NULL, NULL FROM q
WHERE (pid, fd, slot) NOT IN (SELECT (pid, fd, slot) FROM bad) AND seq NOT IN (SELECT req_seq FROM m WHERE req_seq IS NOT NULL)""")
def pair_dns_multi(env):
    ev = socket_events(env).withColumns({"slot": F.floor(F.col("ts_ns") / 600_000_000_000), "dns_id": F.col("k") % 3,
                                         "domain": F.concat(F.lit("d"), (F.col("k") % 2).cast("string"))})
    key = ["pid", "fd", "slot"]

    def side(p):
        return [*key, "dns_id", "domain", F.col("seq").alias(f"{p}_seq"), F.col("ts_ns").alias(f"{p}_ts"), F.col("latency_ns").alias(f"{p}_latency")]
    return pairing.pair_dns_multi(ev.where("is_request").select(*side("req")), ev.where("NOT is_request").select(*side("resp")), key)


@query("unanswered", f"""
SELECT seq, pid, fd, k, 2 AS error_type FROM (SELECT *, k FROM v_socket_events WHERE name <> 'connect') q
WHERE CASE WHEN name IN ('read', 'recvfrom') THEN is_server_fd ELSE NOT is_server_fd END AND NOT EXISTS (
  SELECT 1 FROM v_socket_events r WHERE r.name <> 'connect' AND NOT CASE WHEN r.name IN ('read', 'recvfrom') THEN r.is_server_fd ELSE NOT r.is_server_fd END
    AND r.pid = q.pid AND r.fd = q.fd AND r.k = q.k)""")
def unanswered(env):
    ev = socket_events(env)
    return pairing.unanswered(ev.where("is_request").select("seq", "pid", "fd", "k"), ev.where("NOT is_request"), ["pid", "fd", "k"])


@query("merge_continue", f"""
SELECT pid, fd, min(pair_no) AS pair_no, min(first_req_ts) AS first_req_ts, arg_min(first_req_latency, pair_no) AS first_req_latency,
  max(last_req_ts) AS last_req_ts, CAST(sum(n_req) AS BIGINT) AS n_req, CAST(sum(req_bytes) AS BIGINT) AS req_bytes,
  arg_max(resp_bytes, pair_no) AS resp_bytes, arg_max(status_code, pair_no) AS status_code
FROM (SELECT *, sum(CASE WHEN before = 100 THEN 0 ELSE 1 END) OVER (PARTITION BY pid, fd ORDER BY pair_no) AS g FROM (
  SELECT *, lag(status_code) OVER (PARTITION BY pid, fd ORDER BY pair_no) AS before FROM (
    SELECT *, CASE WHEN pair_no % 3 = 0 OR pair_no % 7 = 0 THEN 100 ELSE 200 END AS status_code FROM ({PAIRS_SQL}) p) a) b) c
GROUP BY pid, fd, g HAVING arg_max(status_code, pair_no) <> 100""")
def merge_continue(env):
    n = F.col("pair_no")
    p = pairing.pair_requests(socket_events(env)).withColumn("status_code", F.when((n % 3 == 0) | (n % 7 == 0), 100).otherwise(200))
    return pairing.merge_continue(p).select("pid", "fd", "pair_no", "first_req_ts", "first_req_latency", "last_req_ts", "n_req",
                                            "req_bytes", "resp_bytes", "status_code")


@query("connect_fail_record", """
SELECT pid, fd, day, latency AS connect_time, latency AS request_total_time, true AS is_error, 1 AS error_type, false AS is_slow FROM (
  SELECT pid, fd, CAST(floor(ts_ns / 86400000000000) AS BIGINT) AS day, CAST(sum(CASE WHEN name = 'connect' THEN 1 ELSE 0 END) AS BIGINT) AS n_connect,
    CAST(sum(CASE WHEN name <> 'connect' THEN 1 ELSE 0 END) AS BIGINT) AS n_req, max(CASE WHEN name = 'connect' THEN latency_ns END) AS latency
  FROM v_socket_events GROUP BY 1, 2, 3) t WHERE n_connect > 0 AND n_req = 0""")
def connect_fail_record(env):
    c = F.col("name") == "connect"
    p = env.v_socket_events.groupBy("pid", "fd", F.floor(F.col("ts_ns") / 86400_000_000_000).alias("day")).agg(
        F.count(F.when(c, 1)).alias("n_connect"), F.count(F.when(~c, 1)).alias("n_req"), F.max(F.when(c, F.col("latency_ns"))).alias("connect_latency"))
    return pairing.connect_fail_records(p).select("pid", "fd", "day", "connect_time", "request_total_time", "is_error", "error_type", "is_slow")
