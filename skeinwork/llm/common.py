"""What several operators share: text column functions in Arrow batches, staged tables, column names."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.session import stage, work_dir

__all__ = ["Scratch", "by_text", "drop_folder", "fresh", "held", "null_safe_key", "stage", "texts", "work_dir"]


def texts(column: pa.Array) -> list[str]:
    """Texts of a batch; null is the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


_HELD: dict = {}


def held(key: object, make: Callable[[], object]) -> object:
    """The object that this worker process keeps under ``key``. It keeps one: workers serve one stage after another, and what
    an earlier stage needed (a cache, an index) gives way. ``key`` must be unique to what is made, not an ``id()``."""
    if key not in _HELD:
        _HELD.clear()
        pa.default_memory_pool().release_unused()
        _HELD[key] = make()
    return _HELD[key]


def by_text(make: Callable[[], Callable[[str], object]], returns: str, arrow_type: pa.DataType, part_bytes: int = 1 << 25) -> Callable[[Column], Column]:
    """A column function that applies ``make()(text)`` to every text.

    ``make`` runs once per batch and may return a function that keeps caches in its module; texts are turned into Python
    objects some ``part_bytes`` at a time. The result is marked as not deterministic, so that a filter on it is not pushed
    below the projection and does not evaluate it twice; the functions themselves are deterministic.
    """

    def batch(column):
        one, done = make(), []
        rows = max(1, int(part_bytes / max(1, column.nbytes / max(1, len(column)))))
        for start in range(0, len(column), rows):
            done.append(pa.array([one(t) for t in texts(column.slice(start, rows))], arrow_type))
        return pa.concat_arrays(done) if done else pa.array([], arrow_type)

    batch.__annotations__ = {"column": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(batch, returns).asNondeterministic()
    return lambda column: udf(column)


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores in front until no column has it (names are compared without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def null_safe_key(*columns: str) -> Column:
    """One text per combination of values, with nulls as a value of their own."""
    parts = [F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(c).cast("string"))) for c in columns]
    return F.concat_ws("\x1f", *parts)


def drop_folder(df: DataFrame, path: str) -> None:
    """Remove a staged folder that nothing reads any more."""
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Staged tables that are removed before the result is returned."""

    def __init__(self):
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def stage(self, df: DataFrame, purpose: str) -> DataFrame:
        path = work_dir(df.sparkSession, purpose)
        df.write.parquet(path)
        staged = df.sparkSession.read.schema(df.schema).parquet(path)
        self._paths[id(staged)] = (staged, path)
        return staged

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for table in tables:
            drop_folder(*self._paths.pop(id(table)))

    def drop_all(self) -> None:
        self.drop(*[table for table, _ in self._paths.values()])
