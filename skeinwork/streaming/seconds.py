"""Seconds that events touch: events wait as packed columns and are spread over their seconds when the watermark has passed them."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# A bucket costs some calls in every run, and its events are in memory at once; a checkpoint belongs to their number.
BUCKETS = 1 << 8
MS = 1000


class Seconds(StatefulProcessor):
    """Packed events (``keys``, ``values``, first and last second) of a bucket wait in a list state. When the watermark passes the
    ends of seconds, those seconds come out: one row per key and second with a list of each value.

    A state for every key and second costs some 40 microseconds of calls to the state store, many times what its rows cost.
    Spark drops packs of which every second is late. Other late seconds are dropped here: ``done`` is the watermark of the run
    before. So every bucket is there from the first run on (its initial state) and has a timer in every run.
    """

    def __init__(self, keys: list[str], values: list[str], part_rows: int = 1 << 16):
        self.keys, self.values, self.part_rows = keys, values, part_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "packed binary")
        self.done = handle.getValueState("done", "ms long")

    def close(self) -> None:
        pass

    def _reached(self, ms: int) -> None:
        self.done.update((ms,))
        self.handle.registerTimer(ms + 1)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._reached(timerValues.getCurrentWatermarkInMs())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.waiting.appendList([(bytes(p),) for part in rows for p in part["packed"]])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, (before,) = timerValues.getCurrentWatermarkInMs(), self.done.get()
        parts = [pickle.loads(packed) for (packed,) in self.waiting.get()]
        self._reached(now)
        if not parts:
            return
        *rows, first, last = [np.concatenate(c) for c in zip(*parts)]
        rest = (last + 1) * MS > now
        if not rest.any():
            self.waiting.clear()
        elif not rest.all():
            self.waiting.put([(pickle.dumps([c[rest] for c in (*rows, first, last)], 5),)])
        start, end = np.maximum(first, before // MS), np.minimum(last, now // MS - 1)
        some = start <= end
        rows, start, n = [c[some] for c in rows], start[some], (end - start + 1)[some]
        if len(n):
            yield from self._groups(np.repeat(np.arange(len(n)), n), np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()), rows)

    def _groups(self, row: np.ndarray, second: np.ndarray, rows: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        k = len(self.keys)
        # Structs are told apart by their text.
        keys = pd.DataFrame({i: pd.Series(c).map(repr) if isinstance(c[0], dict) else c for i, c in enumerate(rows[:k])})
        group = keys.groupby(list(range(k)), sort=False).ngroup().to_numpy()[row]
        order = np.lexsort((second, group))
        row, second, group = row[order], second[order], group[order]
        first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        ends = np.r_[first[1:], len(row)]
        for p in range(0, len(first), self.part_rows):
            a, b = first[p : p + self.part_rows], ends[p : p + self.part_rows]
            out = {c: rows[i][row[a]] for i, c in enumerate(self.keys)} | {"second": second[a], "n": b - a}
            for i, c in enumerate(self.values, k):
                values = rows[i][row[a[0] : b[-1]]]
                out[c] = pd.Series([values[x:y] for x, y in zip(a - a[0], b - a[0])], dtype=object)
            yield pd.DataFrame(out)
