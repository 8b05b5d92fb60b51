"""Queries for payload enrichment. Messages are built from table rows, so the expected attributes are known from the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwork.functions.registry import register_enricher as register
from skeinwork.operators import enrich
from skeinwork.plans.catalog import query
from skeinwork.plans.q_filters import _ASCII, _SQL_TEXT, _digest_sql


def be(col, width):
    """Integer column as big-endian bytes."""
    return F.unhex(F.lpad(F.right(F.hex(col.cast("long")), F.lit(2 * width)), 2 * width, "0"))


def raw(*parts):
    return F.concat(*[p.cast("binary") if hasattr(p, "cast") else F.lit(p) for p in parts])


# --- http -----------------------------------------------------------------------------------------------------

_HTTP = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat(path, '/café/menü') WHEN 3 THEN concat(path, '-東京/😀x') ELSE path END AS path, CASE page_id % 6 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'ET' WHEN 3 THEN 'BAD' WHEN 4 THEN 'DELETE' ELSE 'OPTIONS' END AS m,
  CASE page_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 100 WHEN 3 THEN 1200 ELSE 503 END AS status,
  CASE WHEN page_id % 7 = 0 THEN 'HTTP/2.0' ELSE 'HTTP/1.1' END AS version, md5(url) AS h FROM v_urls"""
_HTTP_OK = "m <> 'BAD' AND (m <> 'ET' OR starts_with(path, '/')) AND (page_id % 11 = 0 OR version = 'HTTP/1.1')"


def http_pairs(env):
    p = env.sql(_HTTP)
    req = F.concat("m", F.lit(" "), "path", F.lit(" HTTP/1.1\r\nHost: shop\r\nX-B3-TraceId: "), "h", F.lit("\r\n\r\n"))
    resp = F.concat("version", F.lit(" "), F.col("status").cast("string"), F.lit(" Reason\r\nServer: x\r\n\r\nbody"))
    return p.select("page_id", req.cast("binary").alias("request_data"), F.when(F.col("page_id") % 11 != 0, resp.cast("binary")).alias("response_data"))


@query("enrich_http", f"""
SELECT page_id, CASE m WHEN 'ET' THEN 'GET' ELSE m END AS http_method, path AS http_url, CASE WHEN k = '' THEN '*' ELSE k END AS content_key, 'zipkin' AS trace_type, h AS trace_id,
  CASE WHEN page_id % 11 <> 0 THEN CASE WHEN status > 999 THEN 0 ELSE status END END AS http_status_code, CASE WHEN page_id % 11 <> 0 THEN status = 100 END AS http_continue,
  page_id % 11 <> 0 AND status BETWEEN 400 AND 999 AS is_error
FROM (SELECT *, array_to_string(list_transform(string_split(split_part(replace(path, ' ', ''), '?', 1), '/'),
  lambda s: CASE WHEN regexp_matches(s, '^[A-Za-z_-]{{0,25}}$') THEN s ELSE '*' END), '/') AS k FROM ({_HTTP}) t) u WHERE {_HTTP_OK}""")
def enrich_http(env):
    return enrich.enrich_http(http_pairs(env)).where("matched").drop("matched", "request_data", "response_data")


# --- mysql ----------------------------------------------------------------------------------------------------

_MYSQL = f"""SELECT o_orderkey, CAST(o_orderkey % 9 AS INT) AS c, o_custkey % 3 AS r, 1000 + o_orderkey % 99 AS code, concat({_SQL_TEXT}, CASE WHEN o_custkey % 2 = 0 THEN ' /* Orléans, 東京 😀 */' ELSE '' END) AS q FROM orders"""


def mysql_pairs(env):
    t = env.sql(_MYSQL)
    c, r = F.col("c"), F.col("r")
    head = b"\x20\x00\x00\x00"
    zero = F.when(c == 1, F.lit(b"\x00\x01")).otherwise(F.lit(b""))
    cmd = F.when(c == 8, F.lit(b"\x01")).when(c % 2 == 0, F.lit(b"\x16")).otherwise(F.lit(b"\x03"))
    swapped = F.concat(F.substring(be(F.col("code"), 2), 2, 1), F.substring(be(F.col("code"), 2), 1, 1))
    err = F.concat(F.lit(b"\x10\x00\x00\x01\xff"), swapped, F.lit(b"#"), F.lit("#4200Bad syntax").cast("binary"))
    resp = F.when(r == 0, err).when(r == 1, F.lit(b"\x07\x00\x00\x01\x00\x00\x00")).otherwise(F.lit(b"\x01\x00\x00\x01\x02\x27"))
    return t.select("o_orderkey", F.concat(F.lit(head), cmd, F.when(c == 8, F.lit(b"")).otherwise(F.concat(zero, F.col("q").cast("binary")))).alias("request_data"),
                    resp.alias("response_data"))


@query("enrich_mysql", f"""
SELECT o_orderkey, CASE WHEN c <> 8 THEN q END AS sql, CASE WHEN c <> 8 THEN {_digest_sql('q')} END AS content_key, c = 8 AS oneway,
  CASE WHEN r = 0 THEN code END AS sql_error_code, CASE WHEN r = 0 THEN '#4200:Bad syntax' END AS sql_error_msg, r = 0 AS is_error
FROM ({_MYSQL}) t WHERE (c = 8 AND r < 2) OR (c <> 8 AND regexp_matches(q, '^(select|insert|update|delete|drop|create|alter|set|commit)', 'i'))""")
def enrich_mysql(env):
    return enrich.enrich_mysql(mysql_pairs(env)).where("matched").drop("matched", "request_data", "response_data")


# --- redis ----------------------------------------------------------------------------------------------------

@query("enrich_redis", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE cmd END AS redis_command, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE cmd END AS content_key,
  CASE WHEN o_custkey % 5 = 0 THEN 'ERR wrong type' END AS redis_error_msg, o_custkey % 5 = 0 AS is_error
FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'get' WHEN 1 THEN 'HSET' ELSE 'Expire' END AS cmd FROM orders) t WHERE o_orderkey % 10 <> 9""")
def enrich_redis(env):
    k = F.col("o_orderkey") % 4
    cmd = F.when(k == 0, "get").when(k == 1, "HSET").when(k == 2, "Expire").otherwise("nosuch")
    key = F.concat(F.lit("order:"), F.col("o_orderkey").cast("string"))
    size = F.when(F.col("o_orderkey") % 10 == 9, F.length(key) + 1).otherwise(F.length(key))
    req = F.concat(F.lit("*2\r\n$"), F.length(cmd).cast("string"), F.lit("\r\n"), cmd, F.lit("\r\n$"), size.cast("string"), F.lit("\r\n"), key, F.lit("\r\n"))
    resp = F.when(F.col("o_custkey") % 5 == 0, "-ERR wrong type\r\n").otherwise("$2\r\n-1\r\n")
    p = env.orders.select("o_orderkey", req.cast("binary").alias("request_data"), resp.cast("binary").alias("response_data"))
    return enrich.enrich_redis(p).where("matched").drop("matched", "request_data", "response_data")


# --- binary headers -------------------------------------------------------------------------------------------

@query("enrich_dns_header", """
SELECT event_id, event_id % 65536 AS dns_id, user_id % 3 AS questions, CASE WHEN event_id % 8 <> 0 THEN event_id % 65536 END AS response_dns_id,
  CASE WHEN event_id % 8 <> 0 THEN user_id % 6 END AS dns_rcode, event_id % 8 <> 0 AND user_id % 6 <> 0 AND user_id % 6 <> 3 AS is_error FROM events WHERE user_id % 3 > 0""")
def enrich_dns_header(env):
    e, u = F.col("event_id"), F.col("user_id")
    tail = F.lit(b"\x00\x00\x00\x00\x00\x00\x03www\x00\x00\x01\x00\x01")
    req = F.concat(be(e % 65536, 2), F.lit(b"\x01\x00"), be(u % 3, 2), tail)
    resp = F.concat(be(e % 65536, 2), F.lit(b"\x81"), be(128 + u % 6, 1), be(u % 3, 2), tail)
    p = env.events.select("event_id", req.alias("request_data"), F.when(e % 8 != 0, resp).alias("response_data"))
    return enrich.enrich_dns_header(p, ignore_rcode3=True).where("matched").drop("matched", "request_data", "response_data")


@query("enrich_kafka_header", """
SELECT event_id, user_id % 64 AS kafka_api, event_id % 12 AS kafka_version, event_id AS kafka_correlation_id, CAST(6 AS BIGINT) AS client_id_length, false AS is_error
FROM events JOIN (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 37, 38, 39,
  40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50, 51, 56, 57, 60, 61]) AS api, unnest([9, 12, 7, 11, 5, 3, 7, 3, 8, 8, 4, 7, 4, 4, 5, 5, 4, 1, 3, 7, 6, 2, 4, 4, 3, 3, 3, 1, 3, 2, 2,
  2, 4, 2, 2, 2, 2, 3, 2, 2, 2, 2, 2, 2, 1, 0, 0, 0, 1, 1, 0, 0, 0, 0, 0, 0]) AS top) v ON user_id % 64 = api AND event_id % 12 <= top WHERE event_id % 9 <> 0""")
def enrich_kafka_header(env):
    e, u = F.col("event_id"), F.col("user_id")
    req = F.concat(be(F.lit(40), 4), be(u % 64, 2), be(e % 12, 2), be(e, 4), be(F.lit(6), 2), F.lit(b"client"), F.lit(b"rest"))
    resp = F.concat(be(F.lit(20), 4), be(F.when(e % 9 == 0, e + 1).otherwise(e), 4), F.lit(b"body"))
    p = env.events.select("event_id", req.alias("request_data"), resp.alias("response_data"))
    return enrich.enrich_kafka_header(p).where("matched").drop("matched", "request_data", "response_data")


@query("enrich_dubbo_header", """
SELECT event_id, s AS serializer, ev AS heartbeat, NOT ev AND NOT tw AS oneway, CASE WHEN ev THEN 'Heartbeat' WHEN NOT tw THEN 'Oneway' WHEN s NOT IN (2, 6) THEN 'UnSupportSerialFormat' END AS content_key,
  code AS dubbo_error_code, code > 20 AS is_error
FROM (SELECT event_id, event_id % 8 AS s, event_id % 5 = 0 AS ev, event_id % 3 <> 0 AS tw, event_id % 7 <> 0 AS rq, 20 + user_id % 80 AS code FROM events) t WHERE s > 0 AND (ev OR rq)""")
def enrich_dubbo_header(env):
    e, u = F.col("event_id"), F.col("user_id")
    flags = e % 8 + F.when(e % 5 == 0, 32).otherwise(0) + F.when(e % 3 != 0, 64).otherwise(0) + F.when(e % 7 != 0, 128).otherwise(0)
    req = F.concat(F.lit(b"\xda\xbb"), be(flags, 1), F.lit(b"\x00" * 13), F.lit(b"xx"))
    resp = F.concat(F.lit(b"\xda\xbb\x02"), be(20 + u % 80, 1), F.lit(b"\x00" * 12))
    p = env.events.select("event_id", req.alias("request_data"), resp.alias("response_data"))
    return enrich.enrich_dubbo_header(p).where("matched").drop("matched", "request_data", "response_data")


@query("enrich_rocketmq_json", """
SELECT event_id, CAST(event_id AS INT) AS rocketmq_opaque, CASE event_id % 3 WHEN 0 THEN 'SEND_MESSAGE' WHEN 1 THEN 'HEART_BEAT' ELSE '' END AS rocketmq_request_msg,
  CASE event_id % 4 WHEN 0 THEN concat('Topic:t', user_id) WHEN 1 THEN concat('Topic:b', user_id) ELSE CASE event_id % 3 WHEN 0 THEN 'SEND_MESSAGE' WHEN 1 THEN 'HEART_BEAT' ELSE '' END END AS content_key,
  CAST(code AS INT) AS rocketmq_error_code, CASE code WHEN 0 THEN NULL WHEN 17 THEN 'TOPIC_NOT_EXIST' WHEN 1 THEN 'system busy' ELSE 'error:response code is 2' END AS rocketmq_error_msg, code > 0 AS is_error
FROM (SELECT event_id, user_id, CASE user_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 17 WHEN 2 THEN 1 ELSE 2 END AS code FROM events) t WHERE event_id % 10 <> 0""")
def enrich_rocketmq_json(env):
    e, u = F.col("event_id"), F.col("user_id")
    s = lambda c: c.cast("string")
    ext = F.when(e % 4 == 0, F.concat(F.lit('{"topic":"t'), s(u), F.lit('"}'))).when(e % 4 == 1, F.concat(F.lit('{"b":"b'), s(u), F.lit('"}'))).otherwise("{}")
    qh = F.concat(F.lit('{"code":'), F.when(e % 3 == 0, "10").when(e % 3 == 1, "34").otherwise("999"), F.lit(',"opaque":'), s(e), F.lit(',"extFields":'), ext, F.lit("}"))
    code = F.when(u % 4 == 0, "0").when(u % 4 == 1, "17").when(u % 4 == 2, "1").otherwise("2")
    rh = F.concat(F.lit('{"code":'), code, F.lit(',"opaque":'), s(F.when(e % 10 == 0, e + 1).otherwise(e)),
                  F.when(u % 4 == 2, ',"remark":"system busy"').otherwise(""), F.lit("}"))

    def message(h):
        return F.concat(be(F.length(h) + 8, 4), be(F.length(h), 4), h.cast("binary"), F.lit(b"body"))
    p = env.events.select("event_id", message(qh).alias("request_data"), message(rh).alias("response_data"))
    return enrich.enrich_rocketmq_json(p).where("matched").drop("matched", "request_data", "response_data")


@query("enrich_generic", f"""
SELECT pid, seq, 'NOSUPPORT' AS protocol, left({_ASCII}, 200) AS request_payload FROM v_messages""")
def enrich_generic(env):
    p = env.v_messages.select("pid", "seq", F.col("data").cast("binary").alias("request_data"), F.lit(None).cast("binary").alias("response_data"))
    return enrich.enrich_generic(p).select("pid", "seq", "protocol", "request_payload")


@query("register_enricher", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'echo' WHEN doc_id % 3 = 1 THEN 'redis' ELSE 'NOSUPPORT' END AS protocol,
  CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN 'PING' END AS content_key FROM documents""")
def register_enricher(env):
    def echo(df):
        """A plug-in protocol: ``ECHO <word>``."""
        word = F.regexp_extract(F.decode("request_data", "ISO-8859-1"), r"^ECHO ([a-z]+)$", 1)
        return df.withColumns({"matched": word != "", "content_key": word})
    register("echo", echo)
    m = F.col("doc_id") % 3
    req = F.when(m == 0, F.concat(F.lit("ECHO "), "lang")).when(m == 1, "*1\r\n$4\r\nPING\r\n").otherwise("??")
    p = env.documents.select("doc_id", req.cast("binary").alias("request_data"), F.lit(None).cast("binary").alias("response_data"))
    return enrich.detect(p, ["echo", "redis"]).select("doc_id", "protocol", "content_key")


@query("detect_protocol", f"""
SELECT page_id, CASE WHEN {_HTTP_OK} THEN 'http' ELSE 'NOSUPPORT' END AS protocol FROM ({_HTTP}) t""")
def detect_protocol(env):
    return enrich.detect(http_pairs(env), ["http", "mysql", "redis", "kafka", "rocketmq"]).select("page_id", "protocol")


# --- agent lines ----------------------------------------------------------------------------------------------

_LINE = """SELECT event_id, user_id AS pid, user_id * 10 AS tid, EPOCH_US(ts) * 1000 AS ts_ns, event_id % 6 AS m FROM events"""


@query("parse_agent_lines", f"""
SELECT pid, CASE WHEN m = 4 THEN event_id ELSE tid END AS tid, ts_ns, CASE m WHEN 0 THEN 'lock' WHEN 1 THEN 'transaction' WHEN 4 THEN 'thread' ELSE 'span' END AS kind,
  CASE m WHEN 0 THEN ts_ns - 500 WHEN 1 THEN ts_ns WHEN 2 THEN ts_ns - 700 WHEN 3 THEN ts_ns - 900 END AS start_ns, CASE WHEN m IN (0, 2, 3) THEN ts_ns END AS end_ns,
  CASE WHEN m = 0 THEN concat('kd-jf@', ts_ns - 500, '!', ts_ns, '!', tid, '!0x1!Mon!') END AS data, CASE WHEN m IN (1, 2, 3) THEN concat('t', event_id) END AS trace_id,
  CASE WHEN m = 1 THEN CAST(event_id % 2 AS INT) END AS is_entry, CASE WHEN m = 1 THEN 'http' END AS protocol, CASE WHEN m = 1 THEN '/pay' END AS url,
  CASE m WHEN 2 THEN 'old' WHEN 3 THEN 'new' WHEN 4 THEN concat('worker-', event_id) END AS name
FROM ({_LINE}) l WHERE m < 5""")
def parse_agent_lines(env):
    t = env.sql(_LINE)
    s = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    m, e, ts = F.col("m"), F.col("event_id"), F.col("ts_ns")
    bang = F.lit("!")
    line = (F.when(m == 0, F.concat(F.lit("kd-jf@"), s(ts - 500), bang, s(ts), bang, s("tid"), F.lit("!0x1!Mon!")))
            .when(m == 1, F.concat(F.lit("kd-txid@t"), s(e), bang, s(e % 2), F.lit("!http!/pay!")))
            .when(m == 2, F.concat(F.lit("kd-span@700!old!t"), s(e), bang)).when(m == 3, F.concat(F.lit("kd-span@1!"), s(ts - 900), F.lit("!new!t"), s(e), bang))
            .when(m == 4, F.concat(F.lit("kd-tm@"), s(e), F.lit("!worker-"), s(e), bang)).otherwise("other"))
    return enrich.parse_agent_lines(t.select("pid", "tid", "ts_ns", line.alias("line")))
