"""Keyed state machines that see their events in the order of event time and act on event-time timers."""

from __future__ import annotations

import pickle
from abc import abstractmethod
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from skeinwork.streaming.builtin import with_time
from skeinwork.streaming.packs import packer

S, MS, US = 1_000_000_000, 1_000_000, 1_000
NEVER = 1 << 62
# Buckets of a machine whose keys share calls to the state store; a checkpoint belongs to their number.
BUCKETS = 1 << 10


class Waiting:
    """Rows that wait for the watermark, many to an element of a list state: an element costs a call, a row next to nothing."""

    def __init__(self, handle: StatefulProcessorHandle, part_rows: int = 1 << 14):
        self.state, self.part_rows = handle.getListState("waiting", "rows binary"), part_rows

    def _packed(self, rows: list[tuple]) -> list[tuple]:
        return [(pickle.dumps(rows[k : k + self.part_rows], 5),) for k in range(0, len(rows), self.part_rows)]

    def add(self, rows: list[tuple]) -> None:
        self.state.appendList(self._packed(rows))

    def all(self) -> list[tuple]:
        return [row for (packed,) in self.state.get() for row in pickle.loads(packed)]

    def keep(self, rest: list[tuple]) -> None:
        """What is left of the rows that ``all`` gave."""
        if rest:
            self.state.put(self._packed(rest))
        else:
            self.state.clear()


def columns(rows: Iterable[Row], names: list[str]) -> list[tuple]:
    """Columns of rows of one schema, by place."""
    places, out = None, []
    for row in rows:
        if places is None:
            places = [row.__fields__.index(c) for c in names]
        out.append(tuple([row[k] for k in places]))
    return out


class Ordered(StatefulProcessor):
    """Rows of a key wait in a list state until the watermark has passed them, then are taken in order.

    So results do not depend on how the input is cut into micro-batches or in which order it arrives within the watermark's
    delay; rows behind the watermark are dropped by Spark. Between two rows, and at the watermark, everything due is done:
    ``due(ns)`` is called for every time up to which nothing more can happen. A key has one timer, at the earlier of its
    first waiting row and its ``deadline``; a key without rows, deadline and state holds nothing.

    A key's waiting rows are those of the watermark's delay and of one micro-batch, which the source's rate limit bounds.
    """

    def __init__(self, events: T.StructType, order: Iterable[str] = ("ts_ns", "seq"), ts: str = "ts_ns", since: str | None = None):
        """``since`` names the time up to which is ``due`` before a row that stands for several; ``ts`` is then its latest."""
        self.events, self.names, self.ts = events, events.fieldNames(), ts
        self.order = [self.names.index(c) for c in order]
        self.at, self.since = self.names.index(ts), self.names.index(since or ts)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = Waiting(handle)
        self.alarm = handle.getValueState("alarm", "ms long")
        self.open(handle)

    def close(self) -> None:
        pass

    # What a machine defines ------------------------------------------------------------------------------------------

    @abstractmethod
    def open(self, handle: StatefulProcessorHandle) -> None:
        """Make the state variables."""

    @abstractmethod
    def load(self, key: tuple) -> None:
        """Read the key's state."""

    @abstractmethod
    def save(self) -> None:
        """Write the key's state if it changed."""

    @abstractmethod
    def take(self, row: dict) -> Iterator[dict]:
        """Rows that an event gives."""

    def due(self, ns: int) -> Iterator[dict]:
        """Rows that the passing of time up to ``ns`` gives."""
        return iter(())

    def deadline(self) -> int:
        """Time of the next ``due`` that does something."""
        return NEVER

    def seen(self, ns: int) -> Iterator[dict]:
        """Rows that a key gives once per run, after its rows."""
        return iter(())

    def given(self, packs: list[bytes]) -> None:
        """Take the packs of a bucket's initial state (``Packed``)."""

    def begin(self) -> None:
        """A run of a bucket begins (``Packed``)."""

    # Spark's calls ---------------------------------------------------------------------------------------------------

    def _arm(self, ns: int) -> None:
        ms, now = -(-ns // MS), self.alarm.get()
        if now is not None and now[0] <= ms:
            return
        if now is not None:
            self.handle.deleteTimer(now[0])
        self.handle.registerTimer(ms)
        self.alarm.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        got = columns(rows, self.names)
        self.waiting.add(got)
        self._arm(min(r[self.at] for r in got) // US * US)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * MS
        self.alarm.clear()
        rows = self.waiting.all()
        # The watermark counts in microseconds of the event time column.
        ready = sorted((r for r in rows if r[self.at] // US * US <= now), key=lambda r: tuple(r[k] for k in self.order))
        rest = [r for r in rows if r[self.at] // US * US > now]
        self.load(tuple(key))
        for row in ready:
            for out in self.due(row[self.since]):
                yield Row(**out)
            for out in self.take(dict(zip(self.names, row))):
                yield Row(**out)
        for out in self.due(now):
            yield Row(**out)
        for out in self.seen(now):
            yield Row(**out)
        self.save()
        if ready:
            self.waiting.keep(rest)
        after = min([self.deadline(), *[r[self.at] // US * US for r in rest]])
        if after < NEVER:
            self._arm(after)


class Bucketed(StatefulProcessor):
    """A machine with one row of state per key, for keys that are many and have few rows each: keys share a bucket, whose rows
    wait together and whose states are the entries of a map.

    A call to the state store costs more than an event. Here a batch makes some calls per bucket, one per key whose state
    changes, and one per key that is looked up; where the bucket holds few states for the keys looked up, they are read at
    once instead. Deadlines have a lower bound per bucket; when the watermark passes it, the bucket's states are gone through.
    What the machine does with a key, and in which order, is as in ``Ordered``.
    """

    def __init__(self, machine: Ordered, keys: T.StructType, looked_up: int = 4):
        """States are read at once up to ``looked_up`` of them per key."""
        self.machine, self.keys, self.looked_up = machine, keys, looked_up
        self.names, self.n = [*keys.fieldNames(), *machine.names], len(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = Waiting(handle)
        self.rows = handle.getMapState("row", self.keys, self.machine.layout)
        # Number of states, lower bound of their deadlines, time of the timer.
        self.bounds = handle.getValueState("bounds", "states long, soonest long, alarm long")

    def close(self) -> None:
        pass

    def _arm(self, bounds: tuple, ns: int) -> None:
        states, soonest, now = bounds
        ms = -(-ns // MS)
        if now is None or now > ms:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(ms)
            self.bounds.update((states, soonest, ms))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        got, at = columns(rows, self.names), self.n + self.machine.at
        self.waiting.add(got)
        self._arm(self.bounds.get() or (0, NEVER, None), min(r[at] for r in got) // US * US)
        return iter(())

    def _states(self, keys: Iterable[tuple], everything: bool) -> dict[tuple, tuple]:
        if everything:
            return {tuple(k): tuple(v) for k, v in self.rows.iterator()}
        found = ((k, self.rows.getValue(k)) for k in keys)
        return {k: tuple(v) for k, v in found if v is not None}

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, m, at = timerValues.getCurrentWatermarkInMs() * MS, self.machine, self.n + self.machine.at
        states, soonest, _ = self.bounds.get()
        ready, rest = {}, []
        for row in self.waiting.all():
            if row[at] // US * US <= now:
                ready.setdefault(row[: self.n], []).append(row[self.n :])
            else:
                rest.append(row)
        over = soonest <= now
        held = self._states(ready, over or states <= self.looked_up * len(ready)) if states else {}
        after = NEVER if over else soonest
        for k in {**ready, **held} if over else ready:
            before, mine = held.get(k), ready.get(k)
            m.key, m.row = k, None if before is None else dict(zip(m.fields, before))
            for row in sorted(mine or (), key=lambda r: tuple(r[c] for c in m.order)):
                for out in m.due(row[m.since]):
                    yield Row(**out)
                for out in m.take(dict(zip(m.names, row))):
                    yield Row(**out)
            for out in m.due(now):
                yield Row(**out)
            for out in m.seen(now) if mine else ():
                yield Row(**out)
            state = None if m.row is None else tuple(m.row[f] for f in m.fields)
            if state is None and before is not None:
                self.rows.removeKey(k)
            elif state is not None and state != before:
                self.rows.updateValue(k, state)
            states += (state is not None) - (before is not None)
            after = min(after, m.deadline())
        if ready:
            self.waiting.keep(rest)
        alarm = min([after, *[r[at] // US * US for r in rest]])
        if alarm < NEVER:
            self._arm((states, after, None), alarm)
        elif states:
            self.bounds.update((states, after, None))
        else:
            self.bounds.clear()


class Packed(StatefulProcessor):
    """``Bucketed`` for very many rows: they come packed by bucket and wait so, and the rows that come out are made as columns.

    Spark drops packs of which every row is late. Other late rows are dropped here: ``done`` is the watermark of the run before.
    So every bucket is there from the first run on (its initial state, which may bring packs that the machine is given) and has a
    timer in every run.
    """

    def __init__(self, machine: Ordered, keys: T.StructType, output: T.StructType, looked_up: int = 4, out_rows: int = 1 << 15):
        self.machine, self.keys, self.output, self.looked_up, self.out_rows = machine, keys, output, looked_up, out_rows
        self.n = len(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "packed binary")
        self.rows = handle.getMapState("row", self.keys, self.machine.layout)
        # Number of states, lower bound of their deadlines, watermark of the run before.
        self.bounds = handle.getValueState("bounds", "states long, soonest long, done long")
        self.machine.open(handle)

    def close(self) -> None:
        pass

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.machine.given([bytes(p) for p in initialState["packed"] if p is not None])
        ms = timerValues.getCurrentWatermarkInMs()
        self.bounds.update((0, NEVER, ms))
        self.handle.registerTimer(ms + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.waiting.appendList([(bytes(p),) for part in rows for p in part["packed"]])
        return iter(())

    def _ready(self, now: int, before: int) -> tuple[list[list], list[int]]:
        """Columns of the rows that the watermark has passed, by key and in order, and where keys begin."""
        parts, m = [pickle.loads(packed) for (packed,) in self.waiting.get()], self.machine
        if not parts:
            return [], []
        columns = [np.concatenate(c) for c in zip(*parts)]
        us = columns[self.n + m.at] // US * US
        ready, rest = (us > before) & (us <= now), us > now
        if not rest.any():
            self.waiting.clear()
        elif not rest.all():
            self.waiting.put([(pickle.dumps([c[rest] for c in columns], 5),)])
        columns = [c[ready] for c in columns]
        if not len(columns[0]):
            return [], []
        group = pd.DataFrame(dict(enumerate(columns[: self.n]))).groupby(list(range(self.n)), sort=False, dropna=False).ngroup().to_numpy()
        # Objects (numbers, some of which are null) are ranked.
        by = [columns[self.n + k] for k in m.order]
        by = [pd.Series(c).rank(method="dense", na_option="top").to_numpy() if c.dtype == object else c for c in by]
        order = np.lexsort([*by[::-1], group])
        group = group[order]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        return [c[order].tolist() for c in columns], [*first.tolist(), len(group)]

    def _took(self, ready: dict[tuple, tuple[int, int]], columns: list[list], held: dict[tuple, tuple], keys: Iterable[tuple], now: int, left: list) -> Iterator[dict]:
        m = self.machine
        rows = list(zip(*columns[self.n :]))
        for k in keys:
            before, (a, b) = held.get(k), ready.get(k, (0, 0))
            m.key, m.row = k, None if before is None else dict(zip(m.fields, before))
            for row in rows[a:b]:
                yield from m.due(row[m.since])
                yield from m.take(dict(zip(m.names, row)))
            yield from m.due(now)
            if a < b:
                yield from m.seen(now)
            state = None if m.row is None else tuple(m.row[f] for f in m.fields)
            if state is None and before is not None:
                self.rows.removeKey(k)
            elif state is not None and state != before:
                self.rows.updateValue(k, state)
            left[0] += (state is not None) - (before is not None)
            left[1] = min(left[1], m.deadline())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = timerValues.getCurrentWatermarkInMs()
        states, soonest, done = self.bounds.get()
        now, over = ms * MS, soonest <= ms * MS
        self.machine.begin()
        columns, first = self._ready(now, done * MS)
        ready = {tuple(c[a] for c in columns[: self.n]): (a, b) for a, b in zip(first, first[1:])}
        held = {}
        if states and (over or states <= self.looked_up * len(ready)):
            held = {tuple(k): tuple(v) for k, v in self.rows.iterator()}
        elif states:
            found = ((k, self.rows.getValue(k)) for k in ready)
            held = {k: tuple(v) for k, v in found if v is not None}
        left, out = [states, NEVER if over else soonest], []
        for row in self._took(ready, columns, held, {**ready, **held} if over else ready, now, left):
            out.append(row)
            if len(out) == self.out_rows:
                yield self._frame(out)
                out = []
        self.bounds.update((left[0], left[1], ms))
        self.handle.registerTimer(ms + 1)
        if out:
            yield self._frame(out)

    def _frame(self, rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in self.output.fieldNames()})


def run_ordered(events: DataFrame, keys: list[str], machine: Ordered, output: str | T.StructType, delay: str, initial: DataFrame | None = None) -> DataFrame:
    """The rows that a machine per key gives over a stream of events; ``initial`` is a table with state to begin with."""
    timed = with_time(events, machine.ts, delay)
    given = initial.groupBy(*keys) if initial is not None else None
    return timed.groupBy(*keys).transformWithState(machine, output, "append", "eventTime", given)


def run_bucketed(events: DataFrame, keys: list[str], machine: Ordered, output: str | T.StructType, delay: str, buckets: int | None = None) -> DataFrame:
    """``run_ordered`` for many keys with few rows each; a key's rows are taken in one of ``buckets`` groups."""
    held = T.StructType([events.schema[k] for k in keys])
    timed = with_time(events, machine.ts, delay).withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets or BUCKETS)))
    return timed.groupBy("__bucket").transformWithState(Bucketed(machine, held), output, "append", "eventTime")


def run_packed(events: DataFrame, keys: list[str], machine: Ordered, output: T.StructType, delay: str, initial: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """``run_bucketed`` for very many rows, which are packed inside the input partitions. A machine gets the packs of ``initial``
    (which has ``keys``) once for each bucket (``given``)."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets or BUCKETS)).alias("bucket")

    def packs(df: DataFrame, names: list[str], last: str) -> DataFrame:
        return df.select(bucket, *names).mapInArrow(packer(names, last), "bucket long, last long, packed binary")

    held = T.StructType([events.schema[k] for k in keys])
    start = events.sparkSession.range(buckets or BUCKETS).selectExpr("id AS bucket", "CAST(null AS binary) AS packed")
    if initial is not None:
        start = start.unionByName(packs(initial.withColumn("last", F.lit(0).cast("long")), [*initial.columns, "last"], "last").select("bucket", "packed"))
    timed = with_time(packs(events.where(F.col(machine.ts).isNotNull()), [*keys, *machine.names], machine.ts), "last", delay)
    return timed.groupBy("bucket").transformWithStateInPandas(Packed(machine, held, output), output, "append", "eventTime", start.groupBy("bucket"))
