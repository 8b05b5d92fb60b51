"""Name -> function registries: url methods, aggregation kinds, protocol enrichers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions import text

URL_METHODS: dict[str, Callable[[Column], Column]] = {
    "alphabet": text.url_alphabet, "noparam": text.url_noparam, "blank": text.url_blank,
}
AGG_KINDS: dict[str, Callable[..., Column]] = {}
ENRICHERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_url_method(name: str, fn: Callable[[Column], Column]) -> None:
    URL_METHODS[name] = fn


def url_method(name: str) -> Callable[[Column], Column]:
    return URL_METHODS.get(name, text.url_alphabet)


def register_agg_kind(name: str, fn: Callable[..., Column]) -> None:
    """``fn(value, order) -> Column``; ``order`` is the column that decides what "last" means."""
    AGG_KINDS[name] = fn


def agg_kind(name: str) -> Callable[..., Column]:
    return AGG_KINDS.get(name, AGG_KINDS["sum"])


def register_enricher(protocol: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """``fn`` takes paired messages (request_data, response_data) and adds attribute columns and ``matched``."""
    ENRICHERS[protocol] = fn


def agg_sum(value: Column, order: Column | None = None) -> Column:
    return F.sum(value).cast("long")


def agg_max(value: Column, order: Column | None = None) -> Column:
    return F.greatest(F.max(value), F.lit(0)).cast("long")


def agg_avg(value: Column, order: Column | None = None) -> Column:
    # Integer division truncates toward zero.
    return int_div(F.sum(value), F.count(value))


def int_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def agg_last(value: Column, order: Column | None = None) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), order))


def agg_count(value: Column, order: Column | None = None) -> Column:
    return F.count(value)


for _name, _fn in [("sum", agg_sum), ("max", agg_max), ("avg", agg_avg), ("last", agg_last), ("count", agg_count)]:
    register_agg_kind(_name, _fn)
