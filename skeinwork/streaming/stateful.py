"""Streams with timers: pairing, pending DNS requests, connects, translations, metadata, totals, threads; entry/exit joins."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork import constants as C
from skeinwork.operators import connects, pairing
from skeinwork.streaming.builtin import with_time
from skeinwork.streaming.ordered import MS, NEVER, Ordered, S, run_bucketed, run_ordered, run_packed

DELAY = "5 seconds"


def _fields(schema: T.StructType, names: list[str]) -> T.StructType:
    return T.StructType([schema[n] for n in names])


class _OneRow(Ordered):
    """A machine whose state is one row (a dictionary) or nothing."""

    def __init__(self, events: T.StructType, state: T.StructType, **kwargs):
        super().__init__(events, **kwargs)
        self.layout, self.fields = state, state.fieldNames()

    def open(self, handle):
        self.cell = handle.getValueState("row", self.layout)

    def load(self, key):
        self.key, found = key, self.cell.get()
        self.before = None if found is None else tuple(found)
        self.row = None if found is None else dict(zip(self.fields, found))

    def save(self):
        now = None if self.row is None else tuple(self.row[f] for f in self.fields)
        if now is None and self.before is not None:
            self.cell.clear()
        elif now is not None and now != self.before:
            self.cell.update(now)


def _run(events: DataFrame, keys: list[str], machine: _OneRow, output: T.StructType, delay: str, buckets: int | None) -> DataFrame:
    """A state per key, or with ``buckets`` a state per group of keys."""
    return run_bucketed(events, keys, machine, output, delay, buckets) if buckets else run_ordered(events, keys, machine, output, delay)


# Pairing -------------------------------------------------------------------------------------------------------------


class _Pairing(_OneRow):
    def __init__(self, events, state, labels, payload, fd_reuse_s, no_response_s, snap):
        super().__init__(events, state)
        self.labels, self.payload, self.snap = labels, payload, snap
        self.reuse, self.patience = fd_reuse_s, no_response_s

    def _side(self, side: str, e: dict) -> None:
        p = self.row
        if not p[f"n_{side}"]:
            p[f"first_{side}_ts"], p[f"first_{side}_latency"] = e["ts_ns"], e["latency_ns"]
            if "tid" in e:
                p["request_tid" if side == "req" else "response_tid"] = e["tid"]
        p[f"last_{side}_ts"] = e["ts_ns"]
        p[f"n_{side}"] += 1
        p[f"{side}_bytes"] += e["res"] or 0
        if self.payload:
            name = "request_data" if side == "req" else "response_data"
            p[name] = (bytes(p[name]) + bytes(e["data"] or b""))[: self.snap]

    def _emit(self) -> Iterator[dict]:
        out, self.row = self.row, None
        yield {**dict(zip(pairing.KEY, self.key)), **{k: v for k, v in out.items() if k != "port"}}

    def take(self, e):
        p, port = self.row, e.get("sport")
        if e["is_request"]:
            if p is not None and (p["n_resp"] or p["port"] != port):
                yield from self._emit()
            if self.row is None:
                start = {"n_req": 0, "n_resp": 0, "req_bytes": 0, "resp_bytes": 0, "request_data": b"", "response_data": b""}
                self.row = {f: start.get(f) for f in self.fields} | {"port": port} | {c: e[c] for c in self.labels}
            self._side("req", e)
        elif p is not None:
            self._side("resp", e)

    def deadline(self):
        p = self.row
        if p is None:
            return NEVER
        # Ages are whole seconds.
        return (p["last_resp_ts"] // S + self.reuse) * S if p["n_resp"] else (p["last_req_ts"] // S + self.patience) * S

    def due(self, ns):
        if self.row is not None and self.deadline() <= ns:
            yield from self._emit()


def pair_stream(events: DataFrame, labels: list[str] = (), payload: bool = False, fd_reuse_s: int = C.FD_REUSE_S, no_response_s: int = C.NO_RESPONSE_S,
                snap: int = C.SNAP_BYTES, delay: str = DELAY, buckets: int | None = None) -> DataFrame:
    """``pair_requests`` with timers over a stream. A pair is emitted once: when the next one opens, when it is answered and
    idle for ``fd_reuse_s``, or when it stays unanswered for ``no_response_s``; what comes after that belongs to no pair.

    The state of a connection is its open pair: counters and, with ``payload``, up to ``snap`` bytes of each side. With
    ``buckets`` connections share so many groups of state, which many connections with few events each need.
    """
    long, binary = T.LongType(), T.BinaryType()
    names = ["ts_ns", "seq", "is_request", "latency_ns", "res", *[c for c in ("tid", "sport") if c in events.columns], *(["data"] if payload else [])]
    names += [c for c in labels if c not in names]
    out = T.StructType()
    for side in ("req", "resp"):
        for c in (f"first_{side}_ts", f"first_{side}_latency", f"last_{side}_ts", f"n_{side}", f"{side}_bytes"):
            out = out.add(c, long)
    for c in ("request_tid", "response_tid") if "tid" in names else ():
        out = out.add(c, long)
    for c in labels:
        out = out.add(events.schema[c])
    for c in ("request_data", "response_data") if payload else ():
        out = out.add(c, binary)
    machine = _Pairing(_fields(events.schema, names), T.StructType([*out.fields, T.StructField("port", long)]), list(labels), payload, fd_reuse_s, no_response_s, snap)
    return _run(events, pairing.KEY, machine, T.StructType([*_fields(events.schema, pairing.KEY).fields, *out.fields]), delay, buckets)


# DNS -----------------------------------------------------------------------------------------------------------------


SOCKET = [c for c in pairing.DNS_KEY if c != "dns_id"]


class _PendingDns(Ordered):
    """Pending requests of a socket by id; a request of the same id takes the place of the one before."""

    def __init__(self, events, patience):
        super().__init__(events)
        self.patience = patience

    def open(self, handle):
        self.pending = handle.getMapState("pending", _fields(self.events, ["dns_id"]), "seq long, ts_ns long, latency_ns long, res long")

    def load(self, key):
        self.key = key
        self.held = {k[0]: tuple(v) for k, v in self.pending.iterator()}
        self.before = dict(self.held)

    def save(self):
        for id_ in self.before.keys() - self.held.keys():
            self.pending.removeKey((id_,))
        for id_, request in self.held.items():
            if self.before.get(id_) != request:
                self.pending.updateValue((id_,), request)

    def _row(self, id_, request, response=None) -> dict:
        r = response or {}
        return {**dict(zip(SOCKET, self.key)), "dns_id": id_, "req_seq": request[0], "req_ts": request[1], "req_latency": request[2], "request_io": request[3],
                "resp_seq": r.get("seq"), "resp_ts": r.get("ts_ns"), "resp_latency": r.get("latency_ns"), "response_io": r.get("res", 0)}

    def take(self, e):
        if e["is_request"]:
            self.held[e["dns_id"]] = (e["seq"], e["ts_ns"], e["latency_ns"], e["res"])
        else:
            request = self.held.pop(e["dns_id"], None)
            if request is not None:
                yield self._row(e["dns_id"], request, e)

    def deadline(self):
        return min(((r[1] // S + self.patience) * S for r in self.held.values()), default=NEVER)

    def due(self, ns):
        for id_, request in sorted((k, r) for k, r in self.held.items() if (r[1] // S + self.patience) * S <= ns):
            del self.held[id_]
            yield self._row(id_, request)


def dns_stream(events: DataFrame, no_response_s: int = C.NO_RESPONSE_S, delay: str = DELAY) -> DataFrame:
    """``pair_dns_udp`` over a stream with expiry: a request pending for ``no_response_s`` is emitted unanswered, and an answer
    after that finds nothing."""
    machine = _PendingDns(_fields(events.schema, ["ts_ns", "seq", "is_request", "dns_id", "latency_ns", "res"]), no_response_s)
    out = _fields(events.schema, pairing.DNS_KEY)
    for c in ("req_seq", "req_ts", "req_latency", "request_io", "resp_seq", "resp_ts", "resp_latency", "response_io"):
        out = out.add(c, T.LongType())
    return run_ordered(events, SOCKET, machine, out, delay)


# Connects ------------------------------------------------------------------------------------------------------------


class _Connects(_OneRow):
    """At most one open attempt per address pair; its socket's state decides when it has waited long enough."""

    def __init__(self, events, wait_s):
        super().__init__(events, T.StructType().add("first_ns", T.LongType()).add("last_ns", T.LongType()).add("pid", T.LongType()).add("asked", T.BooleanType()))
        self.wait = wait_s * S

    def open(self, handle):
        self.sockets = handle.getListState("sockets", "packed binary")

    def given(self, packs):
        if packs:
            self.sockets.appendList([(p,) for p in packs])

    def begin(self):
        self.known = None

    def _socket(self) -> tuple | None:
        """State of the attempt's socket. A bucket's sockets are read when the first of its attempts in a run asks for one."""
        if self.known is None:
            self.known = {}
            for (packed,) in self.sockets.get():
                *key, state, _ = (c.tolist() for c in pickle.loads(packed))
                self.known.update(zip(zip(*key), zip(state)))
        return self.known.get((*self.key, self.row["pid"]))

    def _end(self, outcome: str, ns: int, code: int | None) -> Iterator[dict]:
        a, self.row = self.row, None
        ok = outcome == "success"
        yield {**dict(zip(connects.KEY, self.key)), "pid": a["pid"], "success": ok, "errno": 0 if ok else code, "ts_ns": ns, "connect_total": 1,
               "connect_duration_nanoseconds_total": ns - a["first_ns"] if ok else None}

    def take(self, e):
        if self.row is None:
            if e["name"] != "tcp_connect":
                return
            self.row = {"first_ns": e["ts_ns"], "last_ns": e["ts_ns"], "pid": 0, "asked": False}
        self.row["last_ns"] = e["ts_ns"]
        self.row["pid"] = e["pid"] or self.row["pid"]
        if e["said"] != "open":
            yield from self._end(e["said"], e["ts_ns"], e["ret"])

    def deadline(self):
        a = self.row
        return NEVER if a is None or a["asked"] or not a["pid"] else a["first_ns"] + self.wait

    def due(self, ns):
        if self.deadline() <= ns:
            found = self._socket()
            if found is not None and found[0] in ("02", "03"):
                # Still on its way: an event has to decide.
                self.row["asked"] = True
            else:
                yield from self._end("failure" if found is None else "success", self.row["last_ns"], None)


def connect_stream(events: DataFrame, sockets: DataFrame, wait_s: int = C.CONNECT_WAIT_S, delay: str = DELAY) -> DataFrame:
    """Connect attempts over a stream, emitted once: when an event decides them, or by their socket (pid, local and remote
    address, state) when they have waited for ``wait_s``: established is success, no socket is failure, one that is still
    connecting goes on waiting. The socket table is the initial state of its connections; attempts whose process is not
    known are not asked for."""
    said = connects.outcome(F.col("name"), F.col("ret"), F.col("old_state"), F.col("new_state"))
    e = events.where("src_port <> 0").withColumn("said", said).where("said IS NOT NULL")
    e = e.select(*connects.KEY, *[F.col(c).cast("long").alias(c) for c in ("ts_ns", "seq", "ret", "pid")], "name", "said")
    machine = _Connects(_fields(e.schema, ["ts_ns", "seq", "name", "said", "ret", "pid"]), wait_s)
    s = sockets.groupBy(F.col("local_ip").alias("src_ip"), F.col("local_port").cast(e.schema["src_port"].dataType).alias("src_port"), F.col("remote_ip").alias("dst_ip"),
                        F.col("remote_port").cast(e.schema["dst_port"].dataType).alias("dst_port"), F.col("pid").cast("long").alias("pid")).agg(F.max("state").alias("state"))
    out = _fields(e.schema, connects.KEY).add("pid", T.LongType()).add("success", T.BooleanType())
    for c in ("errno", "ts_ns", "connect_total", "connect_duration_nanoseconds_total"):
        out = out.add(c, T.LongType())
    return run_packed(e, connects.KEY, machine, out, delay, s)


# Translations --------------------------------------------------------------------------------------------------------


NAT_KEY = ["src_ip", "src_port", "dst_ip", "dst_port"]


class _Nat(_OneRow):
    def __init__(self, events, ttl_s):
        super().__init__(events, T.StructType([*_fields(events, ["dnat_ip", "dnat_port", "ts_ns"]).fields, T.StructField("is_read", T.BooleanType())]), order=("ts_ns", "is_lookup", "id"))
        self.ttl = ttl_s * S

    def take(self, e):
        if not e["is_lookup"]:
            self.row = {"dnat_ip": e["dnat_ip"], "dnat_port": e["dnat_port"], "ts_ns": e["ts_ns"], "is_read": False}
            return
        if self.row is not None:
            self.row["is_read"] = True
        hit = self.row or {}
        yield {**dict(zip(NAT_KEY, self.key)), "ts_ns": e["ts_ns"], "id": e["id"], "dnat_ip": hit.get("dnat_ip"), "dnat_port": hit.get("dnat_port")}

    def deadline(self):
        return NEVER if self.row is None or self.row["is_read"] else self.row["ts_ns"] + self.ttl + 1

    def due(self, ns):
        if self.deadline() <= ns:
            self.row = None
        return iter(())


def nat_stream(events: DataFrame, ttl_s: int = 120, delay: str = DELAY) -> DataFrame:
    """Registrations (is_lookup false) and lookups in one stream -> lookups with the translation registered last before
    them. One that is not read within ``ttl_s`` is gone; one that was read stays."""
    machine = _Nat(_fields(events.schema, ["ts_ns", "id", "is_lookup", "dnat_ip", "dnat_port"]), ttl_s)
    return run_ordered(events, NAT_KEY, machine, _fields(events.schema, [*NAT_KEY, "ts_ns", "id", "dnat_ip", "dnat_port"]), delay)


# Metadata ------------------------------------------------------------------------------------------------------------


class _Validity(_OneRow):
    def __init__(self, events, values):
        super().__init__(events, T.StructType([T.StructField("valid_from", T.LongType()), *_fields(events, values).fields]), order=("ts_ns", "op"))
        self.values = values

    def take(self, e):
        if self.row is not None:
            yield {"ip": self.key[0], "uid": self.key[1], "valid_from": self.row["valid_from"], "valid_to": e["ts_ns"], **{v: self.row[v] for v in self.values}}
        self.row = None if e["op"] == "delete" else {"valid_from": e["ts_ns"], **{v: e[v] for v in self.values}}


def metadata_stream(changes: DataFrame, values: list[str], delay: str = DELAY) -> DataFrame:
    """Validity rows (ip, uid, valid_from, valid_to, values) from a stream of add, update and delete events, emitted when they
    end: a delete ends the entry of its own uid, an update begins a new one. What is still valid is the state, of which a
    batch writes its changes only; Spark's state reader shows it (``open_metadata``)."""
    machine = _Validity(_fields(changes.schema, ["ts_ns", "op", *values]), values)
    ends = [T.StructField("valid_from", T.LongType()), T.StructField("valid_to", T.LongType())]
    out = T.StructType([*_fields(changes.schema, ["ip", "uid"]).fields, *ends, *_fields(changes.schema, values).fields])
    return run_bucketed(changes, ["ip", "uid"], machine, out, delay)


def open_metadata(spark, root: str) -> DataFrame:
    """Entries that are still valid after the last batch below ``root``: ip, uid, valid_from, values."""
    state = spark.read.format("statestore").option("stateVarName", "row").load(f"{root}/checkpoint")
    return state.select("user_map_key.*", "user_map_value.*")


# Totals --------------------------------------------------------------------------------------------------------------


class _Totals(_OneRow):
    def __init__(self, events, metrics, labels, expire_s):
        super().__init__(events, T.StructType([*[T.StructField(m, T.LongType()) for m in metrics], T.StructField("ts_ns", T.LongType())]), order=("first_ns",), since="first_ns")
        self.labels, self.metrics, self.ttl = labels, metrics, expire_s * S

    def _total(self, ns: int, expired: bool) -> dict:
        return {**dict(zip(self.labels, self.key)), **self.row, "clock": ns, "expired": expired}

    def take(self, e):
        if self.row is None:
            self.row = dict.fromkeys(self.metrics, 0) | {"ts_ns": e["ts_ns"]}
        for m in self.metrics:
            self.row[m] += e[m] or 0
        self.row["ts_ns"] = e["ts_ns"]
        return iter(())

    def deadline(self):
        return NEVER if self.row is None else self.row["ts_ns"] + self.ttl + 1

    def due(self, ns):
        at = self.deadline()
        if at <= ns:
            yield self._total(at, True)
            self.row = None

    def seen(self, ns):
        if self.row is not None:
            yield self._total(ns, False)


def _presummed(labels: list[str], metrics: list[str], schema: T.StructType):
    """Sums per label set and millisecond inside every input partition, so that a frequent label set does not send all its
    rows to one task. ``first_ns`` and ``ts_ns`` are the first and last time of a sum."""
    names = [*labels, *metrics, "first_ns", "ts_ns"]

    def summed(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table.append_column("__ms", pc.divide(table["ts_ns"], MS))
            grouped = table.group_by([*labels, "__ms"]).aggregate([*[(m, "sum") for m in metrics], ("ts_ns", "min"), ("ts_ns", "max")])
            columns = [grouped[c] for c in labels] + [grouped[f"{m}_sum"] for m in metrics] + [grouped["ts_ns_min"], grouped["ts_ns_max"]]
            yield from pa.Table.from_arrays(columns, names).to_batches()

    return summed, T.StructType([*_fields(schema, labels).fields, *[T.StructField(m, T.LongType()) for m in [*metrics, "first_ns", "ts_ns"]]])


def totals_stream(events: DataFrame, labels: list[str], metrics: list[str], expire_s: int = 300, delay: str = DELAY) -> DataFrame:
    """Running totals per label set. A run emits the totals of the label sets it touched; one that is not updated for more
    than ``expire_s`` is emitted a last time (``expired``) and starts at 0 again."""
    summed, layout = _presummed(labels, metrics, events.schema)
    part = events.select(*labels, *[F.col(m).cast("long").alias(m) for m in metrics], "ts_ns").mapInArrow(summed, layout)
    machine = _Totals(_fields(layout, ["first_ns", "ts_ns", *metrics]), metrics, labels, expire_s)
    out = _fields(layout, [*labels, *metrics, "ts_ns"]).add("clock", T.LongType()).add("expired", T.BooleanType())
    return run_bucketed(part, labels, machine, out, delay)


# Threads -------------------------------------------------------------------------------------------------------------


class _Threads(_OneRow):
    def __init__(self, events, delay_s):
        super().__init__(events, T.StructType().add("ts_ns", T.LongType()).add("exit_ns", T.LongType()), order=("ts_ns",))
        self.grace = delay_s * S

    def take(self, e):
        self.row = {"ts_ns": e["ts_ns"], "exit_ns": e["ts_ns"] if e["name"] == "procexit" else self.row and self.row["exit_ns"]}
        return iter(())

    def deadline(self):
        return NEVER if self.row is None or self.row["exit_ns"] is None else self.row["exit_ns"] + self.grace

    def due(self, ns):
        if self.deadline() <= ns:
            out, self.row = self.row, None
            yield {"pid": self.key[0], "tid": self.key[1], **out}


def thread_exit_stream(events: DataFrame, delay_s: int = 10, delay: str = DELAY, buckets: int | None = None) -> DataFrame:
    """Threads seen in events; one is emitted and forgotten ``delay_s`` after its last exit event. Events after that are
    those of a new thread with its number. With ``buckets`` threads share so many groups of state."""
    machine = _Threads(_fields(events.schema, ["ts_ns", "name"]), delay_s)
    return _run(events, ["pid", "tid"], machine, _fields(events.schema, ["pid", "tid"]).add("ts_ns", T.LongType()).add("exit_ns", T.LongType()), delay, buckets)


# Transactions --------------------------------------------------------------------------------------------------------


def apm_stream(marks: DataFrame, slow_ms: int, expire_s: int = 120, delay: str = DELAY) -> DataFrame:
    """Slow transactions: exits joined with the entries of their trace and process in the ``expire_s`` before them, of which
    the latest counts. Both sides have watermarks, so an entry is forgotten when no exit can meet it any more; an exit is
    decided when the watermark has passed it by ``expire_s``."""
    timed = with_time(marks, "ts_ns", delay)
    entry = timed.where("is_entry = 1").select(F.col("trace_id").alias("e_trace"), F.col("pid").alias("e_pid"), F.col("ts_ns").alias("entry_ns"), F.col("event_time").alias("entry_time"),
                                               F.col("url").alias("content_key"), "protocol")
    exit_ = timed.where("is_entry = 0").select("trace_id", "pid", "ts_ns", F.col("event_time").alias("exit_time"))
    near = f"trace_id = e_trace AND pid = e_pid AND entry_ns < ts_ns AND entry_time <= exit_time AND entry_time >= exit_time - INTERVAL {expire_s} SECONDS"
    met = exit_.join(entry, F.expr(near)).groupBy("exit_time", "trace_id", "pid", "ts_ns").agg(F.max_by(F.struct("entry_ns", "content_key", "protocol"), "entry_ns").alias("e"))
    spent = F.col("ts_ns") - F.col("e.entry_ns")
    return met.where(spent > slow_ms * 1_000_000).select("trace_id", "pid", F.col("e.entry_ns").alias("start_ns"), spent.alias("request_total_time"), "e.content_key", "e.protocol")
