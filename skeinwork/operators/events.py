"""Filters, routing and direction of captured events."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork import constants as C

_SIZE = struct.Struct("<I")


def const_map(mapping: dict, key: Column, value_type: str | None = None) -> Column:
    """Look a key up in a fixed mapping; null when it is not there."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    hit = F.try_element_at(F.create_map(*pairs), key)
    return hit.cast(value_type) if value_type else hit


def subscribe_filter(events: DataFrame, subscription=C.SUBSCRIPTION) -> DataFrame:
    """Keep events whose (name, category) is subscribed; a rule without category takes any."""
    names = {}
    for name, category in subscription:
        names.setdefault(name, set()).add(category)
    anything = sorted(n for n, c in names.items() if None in c)
    keep = F.col("name").isin(anything)
    for category in sorted({c for cs in names.values() for c in cs if c is not None}):
        listed = sorted(n for n, c in names.items() if category in c)
        keep = keep | ((F.col("category") == category) & F.col("name").isin(listed))
    return events.where(keep)


def suppress_comm(events: DataFrame, commands=C.SUPPRESSED_COMMANDS) -> DataFrame:
    return events.where(~F.coalesce(F.col("comm").isin([c[:C.COMMAND_LENGTH] for c in commands]), F.lit(False)))


def route_events(events: DataFrame, routes=C.ROUTES) -> DataFrame:
    """One row per event and family that takes it."""
    families = {}
    for name, family in routes:
        families.setdefault(name, []).append(family)
    listed = F.lit(None).cast("array<string>")
    for name, fs in families.items():
        listed = F.when(F.col("name") == name, F.array(*[F.lit(f) for f in sorted(set(fs))])).otherwise(listed)
    return events.withColumn("family", F.explode(listed))


def net_gate(events: DataFrame) -> DataFrame:
    """TCP payload events worth pairing."""
    keep = F.lit(True)
    for name, test in [("category", F.col("category") == "net"), ("fd", F.col("fd").isNotNull()),
                       ("sip", F.col("sip").isNotNull()), ("l4", F.col("l4") == "tcp"),
                       ("data_len", F.col("data_len") > 0), ("res", F.col("res") >= 0)]:
        if name in events.columns:
            keep = keep & test
    return events.where(keep)


def udp_dns_gate(events: DataFrame, ports=C.STATIC_PORTS) -> DataFrame:
    dns = [p for p, proto in ports.items() if proto == "dns"]
    return events.where(~F.col("l4").eqNullSafe("udp") | F.col("dport").isin(dns))


def is_request(name: Column, is_server_fd: Column) -> Column:
    """Reads are requests on a server socket, writes on a client socket; null for other calls."""
    return F.when(name.isin(C.READ_CALLS), is_server_fd).when(name.isin(C.WRITE_CALLS), ~is_server_fd)


def static_port_protocol(df: DataFrame, port: str, out: str = "protocol", ports=C.STATIC_PORTS) -> DataFrame:
    return df.withColumn(out, const_map(ports, F.col(port).cast("int")))


def discern_protocol(matches: dict[str, Column]) -> Column:
    """First detector that accepts, in the given order."""
    return F.coalesce(*[F.when(hit, F.lit(p)) for p, hit in matches.items()], F.lit(C.NOSUPPORT))


def learn_port_protocol(parsed: DataFrame, add_at: int = C.LEARN_AFTER, forget_at: int = C.FORGET_GENERIC_AT) -> DataFrame:
    """Protocols a port has shown often enough to be tried first, most frequent first.

    The generic protocol is learned too, but forgotten once it reaches ``forget_at``.
    """
    counts = parsed.groupBy("dport", "protocol").agg(F.count("*").alias("n"))
    learned = counts.where((F.col("n") >= add_at) & ((F.col("protocol") != C.NOSUPPORT) | (F.col("n") < forget_at)))
    # At most one row per port and protocol is left here.
    w = Window.partitionBy("dport").orderBy(F.desc("n"), "protocol")
    return learned.withColumn("priority", F.row_number().over(w))


def slow_flag(duration_ns: Column, protocol: Column, thresholds=C.SLOW_MS, default_ms: int = C.DEFAULT_SLOW_MS) -> Column:
    limit = F.coalesce(F.nullif(const_map(thresholds, protocol), F.lit(0)), F.lit(default_ms)).cast("long")
    return duration_ns >= limit * 1_000_000


def protocol_error(protocol: Column, code: Column, ignore_rcode3: bool = False, error_text: Column | None = None) -> Column:
    """Whether the response code (or error text, for redis) says the request failed."""
    dns = (code > 0) & (code != 3) if ignore_rcode3 else code > 0
    redis = F.coalesce(error_text, F.lit("")) != "" if error_text is not None else F.lit(False)
    return F.coalesce(
        F.when(protocol == "http", code >= 400).when(protocol == "dns", dns).when(protocol == "mysql", code != 0)
         .when(protocol == "dubbo", code > 20).when(protocol == "rocketmq", code > 0).when(protocol == "redis", redis),
        F.lit(False))


def error_class(has_request: Column, has_response: Column, failed: Column) -> Column:
    """0 none, 1 connect failed, 2 no response, 3 protocol error."""
    return (F.when(~has_request, C.CONNECT_FAIL).when(failed, C.PROTOCOL_ERROR)
            .when(~has_response, C.NO_RESPONSE).otherwise(C.NO_ERROR))


def abnormal(is_slow: Column, is_error: Column, error_type: Column) -> Column:
    return is_slow | is_error | (error_type > C.NO_ERROR)


def sample_records(df: DataFrame, key: Column, slow: int = 100, error: int = 100, normal: int = 0) -> DataFrame:
    """Percent sampling by a hash of the row key, so that a re-run task keeps the same rows."""
    draw = F.pmod(F.xxhash64(key), F.lit(100))
    is_abnormal = abnormal(F.col("is_slow"), F.col("is_error"), F.col("error_type"))
    keep = F.when(is_abnormal, (F.col("is_slow") & (draw < slow)) | (F.col("is_error") & (draw < error))).otherwise(draw < normal)
    return df.where(keep)


def status_band(ns: Column, green_ms: int, red_ms: int) -> Column:
    return F.when(ns <= green_ms * 1_000_000, "1").when(ns >= red_ms * 1_000_000, "3").otherwise("2")


def message_bounds(buffer: memoryview) -> list[tuple[int, int]]:
    """Offset and length of the messages of a buffer of repeated ``uint32 size + data``; the last one may be cut."""
    at, total, out = 0, len(buffer), []
    while at + 4 < total:
        (size,) = _SIZE.unpack_from(buffer, at)
        at += 4
        out.append((at, min(size, total - at)))
        at += size
    return out


def explode_multimsg(events: DataFrame, name: str = "sendmmsg", part_bytes: int = 1 << 24) -> DataFrame:
    """One row per message of a multi-message send (``message_bounds``), ``part`` from 0; other events are part 0.

    Buffers are walked in Arrow batches, in time linear in their bytes; what is made of a batch is handed on some
    ``part_bytes`` at a time. A null or empty buffer has no message.
    """
    columns = events.columns
    schema = T.StructType([*[T.StructField("res", T.LongType()) if f.name == "res" else f for f in events.schema.fields], T.StructField("part", T.IntegerType())])

    def split(batches):
        for batch in batches:
            buffers, rows, parts, bodies, held = batch.column(columns.index("data")), [], [], [], 0

            def made():
                at = pa.array(rows, pa.int64())  # noqa: B023 (called before the next batch)
                own = {"data": pa.array(bodies, buffers.type), "res": pa.array([len(b) for b in bodies], pa.int64())}  # noqa: B023
                taken = [own[c] if c in own else batch.column(k).take(at) for k, c in enumerate(columns)]  # noqa: B023
                return pa.RecordBatch.from_arrays([*taken, pa.array(parts, pa.int32())], [*columns, "part"])  # noqa: B023

            for row in range(batch.num_rows):
                buffer = memoryview(buffers[row].as_buffer() or b"")
                for part, (at, size) in enumerate(message_bounds(buffer)):
                    rows.append(row)
                    parts.append(part)
                    bodies.append(bytes(buffer[at : at + size]))
                    held += size + 64
                    if held >= part_bytes:
                        yield made()
                        rows, parts, bodies, held = [], [], [], 0
            yield made()

    multi = events.where(F.col("name") == name).mapInArrow(split, schema)
    single = events.where(~F.col("name").eqNullSafe(name)).withColumns({"res": F.col("res").cast("long"), "part": F.lit(0)})
    return single.unionByName(multi)
