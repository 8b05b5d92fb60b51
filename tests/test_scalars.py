"""Scalar functions against known values."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from skeinwork.functions import payload, text


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn("v").alias("r")).first()["r"]


@pytest.mark.parametrize("url,want", [
    (None, None), ("shop", "shop"), ("/shop/cart", "/shop/cart"), ("/shop/cart/17", "/shop/cart/*"), ("/shop/café/menu?lang=fr", "/shop/*/menu"), ("/x y/z", "/xy/z"),
    ("?only=query", ""), ("/v2/items//", "/*/items//"), ("/" + "k" * 25 + "/" + "k" * 26, "/" + "k" * 25 + "/*"), ("/snake_case/kebab-case", "/snake_case/kebab-case")])
def test_url_alphabet(spark, url, want):
    assert one(spark, url, text.url_alphabet) == want


@pytest.mark.parametrize("sql,want", [
    ("SELECT name\n  FROM  staff WHERE city = 'Orléans'", "select staff *"), ("select 1", "select *"), ("select a from", "select *"), ("insert into line_items values (1)", "insert line_items *"),
    ("  delete from old-rows", "delete old-rows *"), ("Drop Table if exists t", "drop if *"), ("create view v", "create *"), ("alter table t9 add c", "alter *"), ("update café set x = 1", "update *"),
    ("set names utf8", "set names *"), ("commit", "commit *"), ("show tables", ""), ("", ""), (None, "")])
def test_sql_digest(spark, sql, want):
    assert one(spark, sql, text.sql_digest) == want


@pytest.mark.parametrize("headers,want", [
    ({"uber-trace-id": "aa11:bb22:0:1"}, ("jaeger", "aa11")), ({"uber-trace-id": "no separator"}, ("jaeger", "no separator")),
    ({"traceparent": "00-" + "12" * 16 + "-" + "34" * 8 + "-00"}, ("w3c", "12" * 16)), ({"traceresponse": "00-" + "ef" * 16 + "-x"}, ("w3c", "ef" * 16)),
    ({"sw8": "1-" + "b3JkZXItNDI=" + "-3-4"}, ("skywalking", "order-42")), ({"sw8": "1-b3JkZXItNDI="}, ("skywalking", "order-42")), ({"sw8": "x"}, ("skywalking", "")),
    ({"x-b3-traceid": "z9", "uber-trace-id": "aa:b"}, ("zipkin", "z9")), ({"apm-transactionid": "tx", "x-b3-traceid": "z9"}, ("apm", "tx")), ({"traceparent": "00-12"}, ("", "")), ({}, ("", ""))])
def test_trace_header(spark, headers, want):
    df = spark.createDataFrame([(headers,)], "h map<string,string>")
    assert tuple(df.select(text.trace_header("h").alias("t")).first()["t"]) == want


def test_header_map(spark):
    message = "GET / HTTP/1.1\r\nB: one\r\na: x:y\r\nb: two\r\nbroken\r\nc: late\r\n\r\nbody"
    assert one(spark, message, text.header_map) == {"b": "two", "a": "x:y"}
    assert one(spark, "GET / HTTP/1.1", text.header_map) == {}
    many = "\r\n".join(["GET /", *(f"h{k}: v{k}" for k in range(150_000)), "last: here"])
    found = spark.createDataFrame([(many,)], "v string").select(text.header_map("v")["last"].alias("l"), F.size(text.header_map("v")).alias("n")).first()
    assert tuple(found) == ("here", 150_001)


@pytest.mark.parametrize("ns,want", [
    (0, "0.00ns"), (1000, "1000.00ns"), (1001, "1.00μs"), (1_500_000, "1.50ms"), (1_005_000_000, "1.00s"), (60_000_000_000, "1.00m"),
    (3_600_000_000_000, "60.00m"), (7_200_000_000_000, "2.00h"), (-2_000_000, "-2.00ms"), (1_125_000, "1.13ms")])
def test_format_duration(spark, ns, want):
    assert spark.range(1).select(text.format_duration(F.lit(ns)).alias("r")).first()["r"] == want


@pytest.mark.parametrize("whole", ["GET /café/menu/list", "select * from t where city = 'Orléans' and id = 7", "résumé", "東京 12", "\U0001f600!", "ß", ""])
def test_utf8_text_drops_only_a_cut_character(spark, whole):
    raw = whole.encode()
    cuts = [raw[:k] for k in range(len(raw) + 1)]
    df = spark.createDataFrame([(k, bytearray(c)) for k, c in enumerate(cuts)], "k int, d binary")
    got = {r.k: r.t for r in df.select("k", payload.utf8_text(F.col("d")).alias("t")).collect()}
    assert got == {k: c.decode("utf-8", "ignore") for k, c in enumerate(cuts)}


def test_utf8_text_marks_broken_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb\x80 c\xe2\x82"),)], "d binary")
    assert df.select(payload.utf8_text(F.col("d")).alias("t")).first()["t"] == "a\ufffdb\ufffd c"


def test_previews(spark):
    df = spark.createDataFrame([(bytearray(b"ab\x00\xff" + b"x" * 300),)], "d binary")
    got = df.select(payload.payload_preview("d", F.lit("mysql")).alias("m"), payload.payload_preview("d", F.lit("dubbo")).alias("u")).first()
    assert got["m"] == "ab.." + "x" * 196 and got["u"] == "x" * 200


def test_ip_and_container(spark):
    df = spark.range(1).select(text.ipv4_text(F.lit(16777343).cast("long")).alias("ip"), text.short_container_id(F.lit("docker://0123456789abcdef")).alias("c"),
                               text.short_container_id(F.lit("plain")).alias("n"))
    assert tuple(df.first()) == ("127.0.0.1", "0123456789ab", "")


def test_workload_kind_and_names(spark):
    df = spark.createDataFrame([("apps/v1", "Deployment"), ("", "Pod"), ("example.com/v1", "Rollout")], "a string, k string")
    assert rows(df.select(text.workload_kind("a", "k").alias("r"))) == [("deployment",), ("example.com/v1/rollout",), ("pod",)]
    names = spark.createDataFrame([("web-5d4f",), ("web-app-77ab",), ("plain",)], "n string")
    assert rows(names.select(text.deployment_name("n").alias("r"))) == [("",), ("web",), ("web-app",)]


def test_info_and_lock(spark):
    df = spark.createDataFrame([("net@read@a->b@100@50@1@64#futex@0x1",)], "i string")
    got = df.select(F.inline(text.info_parts(F.col("i")))).collect()
    assert (got[0]["type"], got[0]["operate"], got[0]["file"], got[0]["start_ns"], got[0]["duration_ns"], got[0]["size"]) == ("net", "read", "a->b", 100, 50, "64")
    assert (got[1]["type"], got[1]["address"]) == ("futex", "0x1")
    lock = spark.createDataFrame([("a!b!c!0x7!Enter!e!f!-1!stack!\n",)], "l string").select(text.parse_lock("l").alias("p")).first()["p"]
    assert (lock["address"], lock["type"], lock["waiter"], lock["stack"]) == ("0x7", "Enter", "", "stack")


def test_sanitize(spark):
    df = spark.createDataFrame([("a.b",), ("9x",), ("_x",), ("__x",), ("",)], "n string")
    assert rows(df.select("n", text.sanitize_name("n").alias("l"), text.sanitize_name("n", True).alias("m"))) == [
        ("", "", ""), ("9x", "key_9x", "key_9x"), ("__x", "key__x", "key__x"), ("_x", "key_x", "_x"), ("a.b", "a_b", "a_b")]
