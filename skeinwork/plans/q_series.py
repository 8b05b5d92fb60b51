"""Queries for time series, top-k, paging and the dashboard reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwork import constants as C
from skeinwork.operators import series
from skeinwork.plans import reports
from skeinwork.plans.catalog import query

_K = "src_namespace, dst_namespace, protocol"
_KEYS = ["src_namespace", "dst_namespace", "protocol"]
# A counter that starts again whenever it would reach 89.
_WRAP = f"SELECT {_K}, day AS ts, total % 89 AS value FROM v_series"
_DELTA = f"""SELECT *, CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END AS delta FROM (
  SELECT *, lag(value) OVER (PARTITION BY {_K} ORDER BY ts) AS p FROM ({_WRAP}) w) d"""


def _slice():
    return F.floor(F.col("ts") / 365)


@query("increase", f"SELECT {_K}, CAST(sum(delta) AS BIGINT) AS increase FROM ({_DELTA}) t GROUP BY {_K}")
def increase(env):
    return series.increase(env.sql(_WRAP), _KEYS, slice_=_slice())


@query("rate", f"SELECT {_K}, CAST(sum(delta) AS DOUBLE) / CAST(86400 AS DOUBLE) AS rate FROM ({_DELTA}) t GROUP BY {_K}")
def rate(env):
    return series.rate(env.sql(_WRAP), _KEYS, 86400, slice_=_slice())


@query("avg_over_time", f"SELECT {_K}, CAST(sum(value) AS DOUBLE) / CAST(count(value) AS DOUBLE) AS avg FROM ({_WRAP}) t GROUP BY {_K}")
def avg_over_time(env):
    return series.avg_over_time(env.sql(_WRAP), _KEYS)


@query("latest_sample", f"""
SELECT {_K}, coalesce(CASE WHEN value % 5 = 0 THEN NULL ELSE value END, 0) AS value FROM (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY ts DESC) AS rn FROM ({_WRAP}) w) t WHERE rn = 1""")
def latest_sample(env):
    w = env.sql(_WRAP).withColumn("value", F.when(F.col("value") % 5 != 0, F.col("value")))
    return series.latest(w, _KEYS)


_BOUNDS = ", ".join(f"({b})" for b in C.TIME_BOUNDS)
_BUCKETS = f"""SELECT dst_namespace, protocol, le, count(*) FILTER (request_total_time <= le) AS cumulative, count(*) AS total
  FROM v_requests, (VALUES {_BOUNDS}) b(le) GROUP BY 1, 2, 3"""


def _quantile(src, keys, q):
    return f"""SELECT {keys}, coalesce(arg_min(CASE WHEN n > 0 THEN CAST(lo AS DOUBLE) + CAST(le - lo AS DOUBLE) * ((CAST({q} AS DOUBLE) * CAST(total AS DOUBLE) - CAST(bef AS DOUBLE)) / CAST(n AS DOUBLE))
    ELSE CAST(le AS DOUBLE) END, le) FILTER (CAST(cumulative AS DOUBLE) >= CAST({q} AS DOUBLE) * CAST(total AS DOUBLE)), CAST(max(le) AS DOUBLE)) AS quantile FROM (
    SELECT *, cumulative - bef AS n FROM (SELECT *, coalesce(lag(le) OVER (PARTITION BY {keys} ORDER BY le), 0) AS lo,
      coalesce(lag(cumulative) OVER (PARTITION BY {keys} ORDER BY le), 0) AS bef FROM ({src}) b) x) y GROUP BY {keys}"""


def time_buckets(df, keys, value="request_total_time"):
    """Cumulative buckets as rows, one pass over the data."""
    from skeinwork.operators.aggregate import agg_histogram
    h = df.groupBy(*keys).agg(agg_histogram(F.col(value), C.TIME_BOUNDS).alias("h"))
    return h.select(*keys, F.col("h.count").alias("total"), F.inline(F.arrays_zip("h.bounds", "h.buckets"))).withColumnsRenamed(
        {"bounds": "le", "buckets": "cumulative"})


@query("histogram_quantile", _quantile(_BUCKETS, "dst_namespace, protocol", 0.9))
def histogram_quantile(env):
    return series.histogram_quantile(time_buckets(env.v_requests, ["dst_namespace", "protocol"]), ["dst_namespace", "protocol"], 0.9)


@query("rpt_latency_quantile", _quantile(_BUCKETS.replace("1, 2, 3", "1, 2, 3").replace("FROM v_requests,", "FROM (SELECT * FROM v_requests WHERE protocol = 'http') v,"), "dst_namespace, protocol", 0.99))
def rpt_latency_quantile(env):
    http = env.v_requests.where("protocol = 'http'")
    return series.histogram_quantile(time_buckets(http, ["dst_namespace", "protocol"]), ["dst_namespace", "protocol"], 0.99)


@query("series_and", f"""
WITH kept AS MATERIALIZED (SELECT DISTINCT src_namespace, dst_namespace FROM v_series WHERE protocol = 'http' AND total > 40), l AS MATERIALIZED ({_WRAP})
SELECT {_K}, ts, value FROM l SEMI JOIN kept USING (src_namespace, dst_namespace)""")
def series_and(env):
    right = env.v_series.where("protocol = 'http' AND total > 40")
    return series.series_and(env.sql(_WRAP), right, ["src_namespace", "dst_namespace"])


@query("series_or", f"""SELECT {_K}, day, total FROM v_series WHERE protocol IN ('http', 'dns')
UNION ALL SELECT {_K}, day, total FROM v_series r WHERE protocol IN ('dns', 'redis') AND NOT EXISTS (
  SELECT 1 FROM v_series l WHERE l.protocol IN ('http', 'dns') AND l.src_namespace = r.src_namespace AND l.dst_namespace = r.dst_namespace AND l.protocol = r.protocol)""")
def series_or(env):
    left, right = env.v_series.where("protocol IN ('http', 'dns')"), env.v_series.where("protocol IN ('dns', 'redis')")
    return series.series_or(left, right, _KEYS)


@query("topk", """
SELECT day, dst_ip, n FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, dst_ip) AS rn FROM (
  SELECT CAST(floor(ts_ns / 86400000000000) AS BIGINT) AS day, dst_ip, count(*) AS n FROM v_requests GROUP BY 1, 2) c) t WHERE rn <= 10""")
def topk(env):
    c = env.v_requests.groupBy(F.floor(F.col("ts_ns") / 86_400_000_000_000).alias("day"), "dst_ip").agg(F.count("*").alias("n"))
    return series.topk(c, 10, "n", ["dst_ip"], ["day"])


_TL = "is_server AND protocol = 'http' AND ts_ns >= 800000000000000000 AND ts_ns <= 900000000000000000"


@query("trace_list", f"""SELECT request_id, ts_ns, request_total_time, dst_pod, (SELECT count(*) > 100 FROM v_requests WHERE {_TL}) AS more FROM v_requests
WHERE {_TL} ORDER BY ts_ns DESC, request_id DESC, request_total_time DESC, dst_pod DESC LIMIT 100""")
def trace_list(env):
    rows = env.v_requests.where(_TL).select("request_id", "ts_ns", "request_total_time", "dst_pod")
    return series.listing(rows, [("ts_ns", True), ("request_id", True), ("request_total_time", True), ("dst_pod", True)], 100)


_SL = "pid = 10 AND start_ns <= 1705300000000000000 AND end_ns >= 1704300000000000000"


@query("segment_list", f"""SELECT seq, pid, tid, start_ns, end_ns, (SELECT count(*) > 10000 FROM v_segments WHERE {_SL}) AS more FROM v_segments WHERE {_SL}
ORDER BY tid DESC, start_ns, seq LIMIT 10000""")
def segment_list(env):
    rows = env.v_segments.where(_SL).select("seq", "pid", "tid", "start_ns", "end_ns")
    return series.listing(rows, [("tid", True), ("start_ns", False), ("seq", False)], 10_000)


@query("paged_search", """
SELECT doc_id, lang, (SELECT CAST(ceil(count(*) / 20.0) AS BIGINT) FROM documents WHERE contains(text, 'the')) AS pages
FROM (SELECT doc_id, lang FROM documents WHERE contains(text, 'the') AND doc_id > 60 ORDER BY doc_id LIMIT 20) t""")
def paged_search(env):
    hits = env.documents.where(F.col("text").contains("the")).select("doc_id", "lang")
    return series.page(hits, "doc_id", 60, 20).withColumn("pages", series.total_pages(hits, 20).scalar())


@query("retention_rank", """
SELECT pid, seq, ts_ns FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY ts_ns DESC, seq DESC) AS rn, count(*) OVER (PARTITION BY pid) AS n FROM v_socket_events) t
WHERE n < 50 OR rn <= 24""")
def retention_rank(env):
    return series.retention(env.v_socket_events.select("pid", "seq", "ts_ns"), ["pid"], "ts_ns", "seq")


@query("dedupe_profile", """
SELECT pid, tid, start_ns, min(seq) AS seq FROM (SELECT pid, tid, CAST(floor(start_ns / 3600000000000) AS BIGINT) AS start_ns, seq FROM v_segments) t GROUP BY 1, 2, 3""")
def dedupe_profile(env):
    from skeinwork.operators.profile import first_by_start
    s = env.v_segments.select("pid", "tid", F.floor(F.col("start_ns") / 3_600_000_000_000).alias("start_ns"), "seq")
    return first_by_start(s, ["pid", "tid", "start_ns"], "seq")


# --- reports --------------------------------------------------------------------------------------------------

def _growth(view, keys, value, by, name, where="true"):
    keys = ", ".join(keys)
    by = ", ".join(by)
    return f"""SELECT {by}, CAST(sum(delta) AS BIGINT) AS {name} FROM (SELECT *, CASE WHEN p IS NULL THEN 0 WHEN v < p THEN v ELSE v - p END AS delta FROM (
    SELECT *, {value} AS v, lag({value}) OVER (PARTITION BY {keys} ORDER BY day) AS p FROM {view} WHERE {where}) x) y GROUP BY {by}"""


_D = "src_namespace = 'ASIA'"
_DK, _NK, _EK = reports.DNS_KEYS, reports.NET_KEYS, reports.ENTITY_KEYS


@query("rpt_dns_requests", _growth("v_dns_series", _DK, "total", ["dst_ip", "day"], "requests", _D))
def rpt_dns_requests(env):
    return reports.dns_requests(env.v_dns_series, "ASIA")


_DNS_ERR = _growth("v_dns_series", _DK, "total", ["dst_ip", "day"], "errors", f"{_D} AND status_code <> '0'")


@query("rpt_dns_errors", _DNS_ERR)
def rpt_dns_errors(env):
    return reports.dns_errors(env.v_dns_series, "ASIA")


def _div(a, b, keys):
    return f"SELECT {keys}, CAST(d AS DOUBLE) / CAST(n AS DOUBLE) AS latency FROM ({a}) a JOIN ({b}) b USING ({keys}) WHERE n > 0"


@query("rpt_dns_latency", _div(_growth("v_dns_series", _DK, "duration", ["dst_ip", "day"], "d", _D), _growth("v_dns_series", _DK, "total", ["dst_ip", "day"], "n", _D), "dst_ip, day"))
def rpt_dns_latency(env):
    return reports.dns_latency(env.v_dns_series, "ASIA")


@query("rpt_dns_top10", f"SELECT dst_ip, day, errors FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY errors DESC, dst_ip) AS rn FROM ({_DNS_ERR}) e) t WHERE rn <= 10")
def rpt_dns_top10(env):
    return reports.dns_top(env.v_dns_series, "ASIA")


@query("rpt_dns_codes", f"""SELECT CASE status_code WHEN '1' THEN 'FormatErr' WHEN '2' THEN 'ServFail' WHEN '3' THEN 'NXDomain' WHEN '4' THEN 'NotImp' ELSE 'Refused' END AS status_code, day, errors
FROM ({_growth("v_dns_series", _DK, "total", ["status_code", "day"], "errors", f"{_D} AND status_code <> '0'")}) t""")
def rpt_dns_codes(env):
    return reports.dns_codes(env.v_dns_series, "ASIA")


@query("rpt_dns_slow", _growth("v_dns_series", _DK, "total", ["dst_ip", "day"], "slow", f"{_D} AND is_slow"))
def rpt_dns_slow(env):
    return reports.dns_slow(env.v_dns_series, "ASIA")


@query("rpt_dns_detail", f"SELECT * FROM v_trace_metric WHERE {_D} AND protocol = 'dns'")
def rpt_dns_detail(env):
    return reports.dns_detail(env.v_trace_metric, "ASIA")


for _name, _cols in (("rpt_retransmit", ["retransmit"]), ("rpt_loss", ["loss"]), ("rpt_volume", ["sent", "received"])):
    def _make(cols):
        return lambda env: reports.net_total(env.v_net_series, *cols)
    _texts = [_growth("v_net_series", _NK, c, ["day"], c) for c in _cols]
    query(_name, _texts[0] if len(_texts) == 1 else f"SELECT day, sent, received FROM ({_texts[0]}) a JOIN ({_texts[1]}) b USING (day)")(_make(_cols))


@query("rpt_rtt_top10", """SELECT src_workload_name, dst_workload_name, day, rtt_us FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY rtt_us DESC, src_workload_name, dst_workload_name) AS rn FROM (
  SELECT src_workload_name, dst_workload_name, day, CAST(sum(rtt_us) AS BIGINT) AS rtt_us FROM v_net_series GROUP BY 1, 2, 3) s) t WHERE rn <= 10""")
def rpt_rtt_top10(env):
    return reports.rtt_top(env.v_net_series)


_P = ["src_workload_name", "dst_workload_name"]
_J = "JOIN ({}) {} USING (src_workload_name, dst_workload_name)"


@query("rpt_connections", f"""SELECT src_workload_name, dst_workload_name, retransmit, loss, sent, received, rtt_us, latency FROM ({_growth("v_net_series", _NK, "retransmit", _P, "retransmit")}) a
{_J.format(_growth("v_net_series", _NK, "loss", _P, "loss"), "b")} {_J.format(_growth("v_net_series", _NK, "sent", _P, "sent"), "c")}
{_J.format(_growth("v_net_series", _NK, "received", _P, "received"), "d")}
{_J.format("SELECT src_workload_name, dst_workload_name, CAST(sum(rtt_us) AS BIGINT) AS rtt_us FROM (SELECT *, row_number() OVER (PARTITION BY src_workload_name, dst_workload_name, src_namespace ORDER BY day DESC) AS rn FROM v_net_series) x WHERE rn = 1 GROUP BY 1, 2", "e")}
{_J.format("SELECT src_workload_name, dst_workload_name, CAST(sum(duration) AS BIGINT) AS latency FROM v_trace_metric GROUP BY 1, 2", "f")}""")
def rpt_connections(env):
    return reports.connections(env.v_net_series, env.v_trace_metric)


@query("rpt_loss_detail", _growth("v_net_series", _NK, "loss", _NK, "loss"))
def rpt_loss_detail(env):
    return reports.series_growth(env.v_net_series, "loss")


@query("rpt_retransmit_detail", _growth("v_net_series", _NK, "retransmit", _NK, "retransmit"))
def rpt_retransmit_detail(env):
    return reports.series_growth(env.v_net_series, "retransmit")


_E = ["namespace", "workload_name"]


@query("rpt_entity_calls", _growth("v_entity_series", _EK, "total", _E, "calls"))
def rpt_entity_calls(env):
    return reports.entity_calls(env.v_entity_series)


@query("rpt_entity_latency", _div(_growth("v_entity_series", _EK, "duration", _E, "d"), _growth("v_entity_series", _EK, "total", _E, "n"), "namespace, workload_name"))
def rpt_entity_latency(env):
    return reports.entity_latency(env.v_entity_series)


@query("rpt_http_error_ratio", f"""SELECT namespace, workload_name, CAST(coalesce(b, 0) AS DOUBLE) / CAST(n AS DOUBLE) * CAST(100 AS DOUBLE) AS error_ratio
FROM ({_growth("v_entity_series", _EK, "total", _E, "n", "protocol = 'http'")}) a LEFT JOIN ({_growth("v_entity_series", _EK, "total", _E, "b", "protocol = 'http' AND response_content >= '4'")}) c
USING (namespace, workload_name) WHERE n > 0""")
def rpt_http_error_ratio(env):
    return reports.http_error_ratio(env.v_entity_series)
