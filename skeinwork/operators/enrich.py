"""Attribute extraction from paired payloads, one table-wide job per protocol.

Input: ``request_data`` and ``response_data`` (binary, response null when there is none). Each job adds ``matched`` and
its attribute columns, built from column functions only; attributes of rows that do not match are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork import constants as C
from skeinwork.functions import payload, text
from skeinwork.functions.registry import ENRICHERS, register_enricher, url_method
from skeinwork.operators.events import const_map


def _latin(data: Column) -> Column:
    """One character per byte, so text positions are byte positions."""
    return F.decode(data, "ISO-8859-1")


def _finish(df: DataFrame, request_ok: Column, response_ok: Column, attrs: dict[str, Column], only_response: dict[str, Column]) -> DataFrame:
    """``matched``: the request parses, and the response too when there is one."""
    answered = F.col("response_data").isNotNull()
    ok = F.coalesce(request_ok, F.lit(False)) & (~answered | F.coalesce(response_ok, F.lit(False)))
    m = F.col("matched")
    out = {**{k: F.when(m, v) for k, v in attrs.items()}, **{k: F.when(m & answered, v) for k, v in only_response.items()}}
    out["is_error"] = F.coalesce(out.get("is_error", F.lit(False)), F.lit(False))
    # Its own projection: the test is computed once and not copied into every attribute.
    return df.withColumn("matched", ok).withColumns(out)


def enrich_http(df: DataFrame, url_clustering: str = "alphabet") -> DataFrame:
    t = df.withColumns({"__q": _latin(F.col("request_data")), "__r": _latin(F.col("response_data"))})
    q, r = F.col("__q"), F.col("__r")
    t = t.withColumns({
        "__m": F.regexp_extract(q, r"(?s)^([^ ]{1,7}) ", 1),
        "__u": payload.utf8_text(F.encode(F.regexp_extract(q, r"(?s)^[^ ]+ ([^ ]*)", 1), "ISO-8859-1")),
        "__c": F.regexp_extract(r, r"(?s)^HTTP/1\.[01] ([+-]?[0-9]{1,5})(?: |$)", 1).try_cast("int"),
        "__qh": text.header_map(q), "__rh": text.header_map(F.coalesce(r, F.lit("")))})
    t = t.withColumns({"__own": text.trace_header("__qh"), "__other": text.trace_header("__rh"),
                       "__k": url_method(url_clustering)(F.col("__u"))})
    token, code, key = F.col("__m"), F.col("__c"), F.col("__k")
    cut_get = (token == "ET") & q.startswith("ET /")
    ok = (F.length(q) >= 14) & (token.isin(C.HTTP_METHODS) | cut_get)
    status = F.when((code > 999) | (code < 99), 0).otherwise(code)

    def trace(field):
        def full(t):
            return (F.col(f"{t}.trace_type") != "") & (F.col(f"{t}.trace_id") != "")
        return F.when(full("__own"), F.col(f"__own.{field}")).when(full("__other"), F.col(f"__other.{field}"))

    out = _finish(t, ok, (F.length(r) >= 14) & code.isNotNull(), {
        "http_method": F.when(cut_get, "GET").otherwise(token), "http_url": F.col("__u"),
        "content_key": F.when(key == "", "*").otherwise(key), "trace_type": trace("trace_type"), "trace_id": trace("trace_id"),
    }, {"http_status_code": status, "http_continue": status == 100, "is_error": status >= 400})
    return out.drop("__q", "__r", "__m", "__u", "__c", "__qh", "__rh", "__own", "__other", "__k")


def enrich_mysql(df: DataFrame) -> DataFrame:
    q, r = F.col("request_data"), F.col("response_data")
    body = F.substring(q, 6, 2 ** 31 - 1)
    prefixed = (F.col("__cmd") == 3) & (F.octet_length(body) > 2) & (F.hex(F.substring(body, 1, 2)) == "0001")
    t = df.withColumns({"__cmd": payload.uint_be(q, 4, 1), "__kind": payload.uint_be(r, 4, 1)})
    t = t.withColumn("__body", F.when(prefixed, F.substring(body, 3, 2 ** 31 - 1)).otherwise(body))
    verbs = "|".join(v for v, _ in C.SQL_VERBS)
    t = t.withColumns({"__is_sql": F.coalesce(F.col("__cmd").isin(3, 22) & _latin(F.col("__body")).rlike(f"(?is)^({verbs})"), F.lit(False)),
                       "__code": F.when(F.col("__kind") == 255, payload.uint_le(r, 5, 2))})
    t = t.withColumn("__sql", F.when(F.col("__is_sql"), payload.utf8_text(F.col("__body"))))
    t = t.withColumn("__digest", text.sql_digest("__sql"))
    is_sql, oneway, kind, code = F.col("__is_sql"), F.col("__cmd") == 1, F.col("__kind"), F.col("__code")
    state = (F.octet_length(r) > 14) & (payload.uint_be(r, 8, 1) == 35)
    rest = F.when(state, F.concat(F.substring(r, 9, 5), F.lit(b":"), F.substring(r, 14, 2 ** 31 - 1))).otherwise(F.substring(r, 9, 2 ** 31 - 1))
    out = _finish(t, (F.octet_length(q) >= 5) & (is_sql | oneway), kind.isin(255, 0, 254) | is_sql, {
        "sql": F.col("__sql"), "content_key": F.when(is_sql, F.col("__digest")), "oneway": oneway,
    }, {"sql_error_code": code, "sql_error_msg": F.when(kind == 255, payload.utf8_text(rest)), "is_error": F.coalesce(code, F.lit(0)) != 0})
    return out.drop("__cmd", "__kind", "__body", "__is_sql", "__code", "__sql", "__digest")


# Single-word commands of the key-value protocol (fixed values).
REDIS_COMMANDS = """
APPEND AUTH BGREWRITEAOF BGSAVE BITCOUNT BITFIELD BITOP BITPOS BLMOVE BLPOP BRPOP BRPOPLPUSH BZPOPMAX BZPOPMIN COMMAND COPY
DBSIZE DECR DECRBY DEL DISCARD DUMP ECHO EVAL EVALSHA EXEC EXISTS EXPIRE EXPIREAT FAILOVER FLUSHALL FLUSHDB GEOADD GEODIST
GEOHASH GEOPOS GEORADIUS GEORADIUSBYMEMBER GEOSEARCH GEOSEARCHSTORE GET GETBIT GETDEL GETEX GETRANGE GETSET HDEL HELLO
HEXISTS HGET HGETALL HINCRBY HINCRBYFLOAT HKEYS HLEN HMGET HMSET HRANDFIELD HSCAN HSET HSETNX HSTRLEN HVALS INCR INCRBY
INCRBYFLOAT INFO KEYS LASTSAVE LINDEX LINSERT LLEN LMOVE LOLWUT LPOP LPOS LPUSH LPUSHX LRANGE LREM LSET LTRIM MGET MIGRATE
MONITOR MOVE MSET MSETNX MULTI OBJECT PERSIST PEXPIRE PEXPIREAT PFADD PFCOUNT PFMERGE PING PSETEX PSUBSCRIBE PSYNC PTTL
PUBLISH PUBSUB PUNSUBSCRIBE QUIT RANDOMKEY READONLY READWRITE RENAME RENAMENX REPLICAOF RESET RESTORE ROLE RPOP RPOPLPUSH
RPUSH RPUSHX SADD SAVE SCAN SCARD SDIFF SDIFFSTORE SELECT SENTINEL SET SETBIT SETEX SETNX SETRANGE SHUTDOWN SINTER
SINTERSTORE SISMEMBER SLAVEOF SLOWLOG SMEMBERS SMISMEMBER SMOVE SORT SPOP SRANDMEMBER SREM SSCAN STRALGO STRLEN SUBSCRIBE
SUNION SUNIONSTORE SWAPDB SYNC TIME TOUCH TTL TYPE UNLINK UNSUBSCRIBE UNWATCH WAIT WATCH XACK XADD XAUTOCLAIM XCLAIM XDEL
XGROUP XINFO XLEN XPENDING XRANGE XREAD XREADGROUP XREVRANGE XTRIM ZADD ZCARD ZCOUNT ZDIFF ZDIFFSTORE ZINCRBY ZINTER
ZINTERSTORE ZLEXCOUNT ZMSCORE ZPOPMAX ZPOPMIN ZRANDMEMBER ZRANGE ZRANGEBYLEX ZRANGEBYSCORE ZRANGESTORE ZRANK ZREM
ZREMRANGEBYLEX ZREMRANGEBYRANK ZREMRANGEBYSCORE ZREVRANGE ZREVRANGEBYLEX ZREVRANGEBYSCORE ZREVRANK ZSCAN ZSCORE ZUNION
ZUNIONSTORE
""".split()


# A bulk string: size line and value. Matches are taken from left to right, so a value is never read as a size line.
_BULK = r"\$([0-9]{1,9})\r\n([^\r]*)(?:\r\n|\r?$)"
_CUT_SIZE = r"(?:^|\n)\$[0-9]{1,9}\r?$"


def _bulk_ok(message: Column) -> Column:
    """Every bulk string has the announced length and none is cut off."""
    sizes = F.regexp_extract_all(message, F.lit(_BULK), F.lit(1))
    values = F.regexp_extract_all(message, F.lit(_BULK), F.lit(2))
    same = F.forall(F.arrays_zip(sizes.alias("n"), values.alias("v")), lambda z: z["n"].cast("int") == F.length(z["v"]))
    return same & ~F.regexp_replace(message, _BULK, "").rlike(_CUT_SIZE)


def enrich_redis(df: DataFrame, commands: list[str] = REDIS_COMMANDS) -> DataFrame:
    """``commands`` are the names that count as a command; multi-word names can be given as well."""
    t = df.withColumns({"__q": _latin(F.col("request_data")), "__r": _latin(F.col("response_data"))})
    q, r = F.col("__q"), F.col("__r")
    names = F.filter(F.regexp_extract_all(q, F.lit(_BULK), F.lit(2)), lambda v: F.upper(v).isin(commands))
    # What is left without the bulk strings: an error is a line of its own.
    error = F.nullif(F.regexp_extract(F.regexp_replace(r, _BULK, ""), r"(?:^|\n)-([^\r]+)\r\n", 1), F.lit(""))
    t = t.withColumns({"__command": F.try_element_at(names, F.lit(-1)), "__error": error})
    out = _finish(t, q.rlike(r"^[*$:]") & _bulk_ok(q), r.rlike(r"^[-+:$*]") & _bulk_ok(r),
                  {"redis_command": F.col("__command"), "content_key": F.col("__command")},
                  {"redis_error_msg": F.col("__error"), "is_error": F.col("__error").isNotNull()})
    return out.drop("__q", "__r", "__command", "__error")


def enrich_dns_header(df: DataFrame, tcp: bool = False, ignore_rcode3: bool = False) -> DataFrame:
    """Header fields; the domain is taken as given (decoded names are an input)."""
    at = 2 if tcp else 0
    q, r = F.col("request_data"), F.col("response_data")

    def ok(d):
        return (F.octet_length(d) > 12) & (payload.uint_be(d, at + 4, 2) > 0)

    rcode = payload.uint_be(r, at + 2, 2).bitwiseAND(F.lit(15).cast("long"))
    failed = (rcode > 0) & (rcode != 3) if ignore_rcode3 else rcode > 0
    return _finish(df, ok(q), ok(r), {"dns_id": payload.uint_be(q, at, 2), "questions": payload.uint_be(q, at + 4, 2)},
                   {"response_dns_id": payload.uint_be(r, at, 2), "dns_rcode": rcode, "is_error": failed})


def enrich_kafka_header(df: DataFrame) -> DataFrame:
    q, r = F.col("request_data"), F.col("response_data")
    api, version = payload.int_be(q, 4, 2), payload.int_be(q, 6, 2)
    correlation, client = payload.int_be(q, 8, 4), payload.int_be(q, 12, 2)
    top = const_map(C.KAFKA_MAX_VERSION, api.cast("int"))
    ok = ((F.octet_length(q) >= 12) & (payload.int_be(q, 0, 4) > 8) & (version >= 0) & (version <= top) & (correlation >= 0) & (client >= 0)
          & (F.octet_length(q) >= client + 14))
    good = (F.octet_length(r) >= 8) & (payload.int_be(r, 0, 4) > 4) & (payload.int_be(r, 4, 4) == correlation)
    return _finish(df, ok, good, {"kafka_api": api, "kafka_version": version, "kafka_correlation_id": correlation, "client_id_length": client}, {})


def enrich_dubbo_header(df: DataFrame) -> DataFrame:
    """Flags of the third byte: serialiser in the low five bits, then event, two-way and request."""
    q, r = F.col("request_data"), F.col("response_data")

    def header(d):
        flags = payload.uint_be(d, 2, 1)
        bit = lambda m: flags.bitwiseAND(F.lit(m).cast("long")) != 0
        ok = (F.octet_length(d) >= 16) & (F.hex(F.substring(d, 1, 2)) == "DABB") & bit(0x1F)
        return ok, flags.bitwiseAND(F.lit(0x1F).cast("long")), bit(0x20), bit(0x40), bit(0x80)

    ok, serial, event, two_way, request = header(q)
    r_ok, _, r_event, _, r_request = header(r)
    code = F.when(r_event, 20).otherwise(payload.uint_be(r, 3, 1))
    key = F.when(event, "Heartbeat").when(~two_way, "Oneway").when(~serial.isin(2, 6), "UnSupportSerialFormat")
    return _finish(df, ok & (event | request), r_ok & (r_event | ~r_request),
                   {"serializer": serial, "heartbeat": event, "oneway": ~event & ~two_way, "content_key": key},
                   {"dubbo_error_code": code, "is_error": code > 20})


# Request code -> name (fixed values).
ROCKETMQ_REQUESTS = {
    10: "SEND_MESSAGE", 11: "PULL_MESSAGE", 12: "QUERY_MESSAGE", 13: "QUERY_BROKER_OFFSET", 14: "QUERY_CONSUMER_OFFSET",
    15: "UPDATE_CONSUMER_OFFSET", 17: "UPDATE_AND_CREATE_TOPIC", 21: "GET_ALL_TOPIC_CONFIG", 22: "GET_TOPIC_CONFIG_LIST",
    23: "GET_TOPIC_NAME_LIST", 25: "UPDATE_BROKER_CONFIG", 26: "GET_BROKER_CONFIG", 27: "TRIGGER_DELETE_FILES",
    28: "GET_BROKER_RUNTIME_INFO", 29: "SEARCH_OFFSET_BY_TIMESTAMP", 30: "GET_MAX_OFFSET", 31: "GET_MIN_OFFSET",
    32: "GET_EARLIEST_MSG_STORETIME", 33: "VIEW_MESSAGE_BY_ID", 34: "HEART_BEAT", 36: "CONSUMER_SEND_MSG_BACK",
    37: "END_TRANSACTION", 38: "GET_CONSUMER_LIST_BY_GROUP", 39: "CHECK_TRANSACTION_STATE", 40: "NOTIFY_CONSUMER_IDS_CHANGED",
    41: "LOCK_BATCH_MQ", 42: "UNLOCK_BATCH_MQ", 43: "GET_ALL_CONSUMER_OFFSET", 45: "GET_ALL_DELAY_OFFSET", 46: "CHECK_CLIENT_CONFIG",
    50: "UPDATE_AND_CREATE_ACL_CONFIG", 51: "DELETE_ACL_CONFIG", 52: "GET_BROKER_CLUSTER_ACL_INFO",
    53: "UPDATE_GLOBAL_WHITE_ADDRS_CONFIG", 54: "GET_BROKER_CLUSTER_ACL_CONFIG", 100: "PUT_KV_CONFIG", 101: "GET_KV_CONFIG",
    102: "DELETE_KV_CONFIG", 103: "REGISTER_BROKER", 104: "UNREGISTER_BROKER", 105: "GET_ROUTEINFO_BY_TOPIC", 106: "GET_BROKER_CLUSTER_INFO",
    200: "UPDATE_AND_CREATE_SUBSCRIPTIONGROUP", 201: "GET_ALL_SUBSCRIPTIONGROUP_CONFIG", 202: "GET_TOPIC_STATS_INFO",
    203: "GET_CONSUMER_CONNECTION_LIST", 204: "GET_PRODUCER_CONNECTION_LIST", 205: "WIPE_WRITE_PERM_OF_BROKER",
    206: "GET_ALL_TOPIC_LIST_FROM_NAMESERVER", 207: "DELETE_SUBSCRIPTIONGROUP", 208: "GET_CONSUME_STATS", 209: "SUSPEND_CONSUMER",
    210: "RESUME_CONSUMER", 211: "RESET_CONSUMER_OFFSET_IN_CONSUMER", 212: "RESET_CONSUMER_OFFSET_IN_BROKER", 213: "ADJUST_CONSUMER_THREAD_POOL",
    214: "WHO_CONSUME_THE_MESSAGE", 215: "DELETE_TOPIC_IN_BROKER", 216: "DELETE_TOPIC_IN_NAMESRV", 219: "GET_KVLIST_BY_NAMESPACE",
    220: "RESET_CONSUMER_CLIENT_OFFSET", 221: "GET_CONSUMER_STATUS_FROM_CLIENT", 222: "INVOKE_BROKER_TO_RESET_OFFSET",
    223: "INVOKE_BROKER_TO_GET_CONSUMER_STATUS", 224: "GET_TOPICS_BY_CLUSTER", 300: "QUERY_TOPIC_CONSUME_BY_WHO", 301: "REGISTER_FILTER_SERVER",
    302: "REGISTER_MESSAGE_FILTER_CLASS", 303: "QUERY_CONSUME_TIME_SPAN", 304: "GET_SYSTEM_TOPIC_LIST_FROM_NS",
    305: "GET_SYSTEM_TOPIC_LIST_FROM_BROKER", 306: "CLEAN_EXPIRED_CONSUMEQUEUE", 307: "GET_CONSUMER_RUNNING_INFO", 308: "QUERY_CORRECTION_OFFSET",
    309: "CONSUME_MESSAGE_DIRECTLY", 310: "SEND_MESSAGE_V2", 311: "GET_UNIT_TOPIC_LIST", 312: "GET_HAS_UNIT_SUB_TOPIC_LIST",
    313: "GET_HAS_UNIT_SUB_UNUNIT_TOPIC_LIST", 314: "CLONE_GROUP_OFFSET", 315: "VIEW_BROKER_STATS_DATA", 316: "CLEAN_UNUSED_TOPIC",
    317: "GET_BROKER_CONSUME_STATS", 318: "UPDATE_NAMESRV_CONFIG", 319: "GET_NAMESRV_CONFIG", 320: "SEND_BATCH_MESSAGE",
    321: "QUERY_CONSUME_QUEUE", 322: "QUERY_DATA_VERSION", 323: "RESUME_CHECK_HALF_MESSAGE", 324: "SEND_REPLY_MESSAGE",
    325: "SEND_REPLY_MESSAGE_V2", 326: "PUSH_REPLY_MESSAGE_TO_CLIENT", 327: "ADD_WRITE_PERM_OF_BROKER", 328: "GET_ALL_PRODUCER_INFO",
    329: "DELETE_EXPIRED_COMMITLOG",
}
# Response code -> error text (fixed values).
ROCKETMQ_ERRORS = {
    10: "FLUSH_DISK_TIMEOUT", 11: "SLAVE_NOT_AVAILABLE", 12: "FLUSH_SLAVE_TIMEOUT", 13: "MESSAGE_ILLEGAL", 14: "SERVICE_NOT_AVAILABLE",
    15: "VERSION_NOT_SUPPORTED", 16: "NO_PERMISSION", 17: "TOPIC_NOT_EXIST", 18: "TOPIC_EXIST_ALREADY", 19: "PULL_NOT_FOUND",
    20: "PULL_RETRY_IMMEDIATELY", 21: "PULL_OFFSET_MOVED", 22: "QUERY_NOT_FOUND", 23: "SUBSCRIPTION_PARSE_FAILED", 24: "SUBSCRIPTION_NOT_EXIST",
    25: "SUBSCRIPTION_NOT_LATEST", 26: "SUBSCRIPTION_GROUP_NOT_EXIST", 27: "FILTER_DATA_NOT_EXIST", 28: "FILTER_DATA_NOT_LATEST",
    200: "TRANSACTION_SHOULD_COMMIT", 201: "TRANSACTION_SHOULD_ROLLBACK", 202: "TRANSACTION_STATE_UNKNOW", 203: "TRANSACTION_STATE_GROUP_WRONG",
    204: "NO_BUYER_ID", 205: "NOT_IN_CURRENT_UNIT", 206: "CONSUMER_NOT_ONLINE", 207: "CONSUME_MSG_TIMEOUT", 208: "NO_MESSAGE",
    209: "UPDATE_AND_CREATE_ACL_CONFIG_FAILED", 210: "DELETE_ACL_CONFIG_FAILED", 211: "UPDATE_GLOBAL_WHITE_ADDRS_CONFIG_FAILED",
}
_HEADER = "code int, opaque int, flag int, remark string, extFields map<string,string>"


def enrich_rocketmq_json(df: DataFrame) -> DataFrame:
    """Messages whose header is JSON (serialise type 0)."""
    def header(d):
        size = payload.int_be(d, 4, 4)
        complete = (payload.uint_be(d, 4, 1) == 0) & (F.octet_length(d) >= size + 8)
        raw = F.substr(d, F.lit(9), size.cast("int"))
        return F.when(complete, F.from_json(F.decode(raw, "UTF-8"), _HEADER))

    t = df.withColumns({"__q": header(F.col("request_data")), "__r": header(F.col("response_data"))})
    name = F.coalesce(const_map(ROCKETMQ_REQUESTS, F.col("__q.code")), F.lit(""))
    ext = F.col("__q.extFields")

    def topic(k):
        return F.nullif(F.try_element_at(ext, F.lit(k)), F.lit(""))

    found = F.coalesce(topic("topic"), topic("b"))
    code = F.col("__r.code")
    msg = F.coalesce(const_map(ROCKETMQ_ERRORS, code), F.nullif(F.col("__r.remark"), F.lit("")),
                     F.concat(F.lit("error:response code is "), code.cast("string")))
    out = _finish(t, F.col("__q").isNotNull() & F.col("__q.code").isNotNull(), F.col("__r.opaque") == F.col("__q.opaque"),
                  {"rocketmq_request_msg": name, "rocketmq_opaque": F.col("__q.opaque"),
                   "content_key": F.when(found.isNotNull(), F.concat(F.lit("Topic:"), found)).otherwise(name)},
                  {"rocketmq_error_code": code, "rocketmq_error_msg": F.when(code > 0, msg), "is_error": code > 0})
    return out.drop("__q", "__r")


def enrich_generic(df: DataFrame) -> DataFrame:
    return df.withColumns({"matched": F.lit(True), "is_error": F.lit(False), "protocol": F.lit(C.NOSUPPORT),
                           "request_payload": payload.payload_preview("request_data", F.lit(C.NOSUPPORT)),
                           "response_payload": payload.payload_preview("response_data", F.lit(C.NOSUPPORT))})


for _p, _f in [("http", enrich_http), ("mysql", enrich_mysql), ("dns", enrich_dns_header), ("redis", enrich_redis),
               ("kafka", enrich_kafka_header), ("rocketmq", enrich_rocketmq_json), ("dubbo", enrich_dubbo_header), (C.NOSUPPORT, enrich_generic)]:
    register_enricher(_p, _f)


def detect(pairs: DataFrame, order: list[str]) -> DataFrame:
    """Protocol and content key of each pair by the first enricher in ``order`` that matches; unmatched is NOSUPPORT.

    Enrichers run one after the other on the same row, so the whole detection is one pass without a shuffle.
    """
    base = pairs.columns
    found, key, error = "__found", "__found_key", "__found_error"
    out = pairs.withColumns({found: F.lit(None).cast("string"), key: F.lit(None).cast("string"), error: F.lit(False)})
    for name in order:
        hit = ENRICHERS[name](out)
        its_key = F.col("content_key") if "content_key" in hit.columns else F.lit(None).cast("string")
        its_error = F.col("is_error") if "is_error" in hit.columns else F.lit(False)
        take = F.col(found).isNull() & F.col("matched")
        out = hit.select(*base, F.when(take, F.lit(name)).otherwise(F.col(found)).alias(found), F.when(take, its_key).otherwise(F.col(key)).alias(key),
                         F.when(take, its_error).otherwise(F.col(error)).alias(error))
    return out.select(*base, F.coalesce(found, F.lit(C.NOSUPPORT)).alias("protocol"), F.col(key).alias("content_key"), F.col(error).alias("is_error"))


def parse_agent_lines(lines: DataFrame) -> DataFrame:
    """Lines an in-process agent wrote (pid, tid, ts_ns, line) as typed rows, one kind per prefix; one pass over the lines."""
    line, ts = F.col("line"), F.col("ts_ns")
    kinds = {"lock": C.LINE_LOCK, "transaction": C.LINE_TXN, "span": C.LINE_SPAN, "thread": C.LINE_THREAD}

    def num(c):
        return F.coalesce(c.try_cast("long"), F.lit(0))

    kind, body = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, prefix in kinds.items():
        hit = line.startswith(prefix) & ((F.octet_length("line") >= 10) if name == "span" else F.lit(True))
        kind = F.when(hit, name).otherwise(kind)
        body = F.when(hit, F.substring(line, len(prefix) + 1, 2 ** 31 - 1)).otherwise(body)
    rows = lines.withColumns({"kind": kind, "__p": F.split(body, "!")}).where(F.col("kind").isNotNull())
    is_ = {name: F.col("kind") == name for name in kinds}
    at = lambda i: F.get("__p", F.lit(i))
    new = at(0) == "1"
    span = lambda i: F.when(new, at(i + 1)).otherwise(at(i))
    return rows.select(
        "pid", F.when(is_["thread"], num(at(0))).otherwise(F.col("tid")).alias("tid"), "ts_ns", "kind",
        F.when(is_["lock"], num(at(0))).when(is_["transaction"], ts).when(is_["span"], F.when(new, num(span(0))).otherwise(ts - num(span(0)))).alias("start_ns"),
        F.when(is_["lock"], num(at(1))).when(is_["span"], ts).alias("end_ns"), F.when(is_["lock"], line).alias("data"),
        F.when(is_["transaction"], at(0)).when(is_["span"], span(2)).alias("trace_id"),
        F.when(is_["transaction"], num(F.substring(at(1), 1, 1)).cast("int")).alias("is_entry"), F.when(is_["transaction"], at(2)).alias("protocol"),
        F.when(is_["transaction"], at(3)).alias("url"), F.when(is_["span"], span(1)).when(is_["thread"], at(1)).alias("name"))
