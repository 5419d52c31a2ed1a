"""Aggregates: name -> (fewest and most arguments, result's default name, lowering)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values
from .values import DYNAMIC, LONG, REAL, STRING, Value, text

def _numeric(v: Value) -> tuple[Column, str]:
    return (v.column, v.type) if v.type in (LONG, REAL) else (v.column.cast("bigint"), LONG) if v.type == values.BOOL else (text(v).try_cast("double"), REAL)


def _count(a: list[Value]) -> Value:
    return Value(F.count(F.lit(1)), LONG)


def _countif(a: list[Value]) -> Value:
    return Value(F.count_if(values.truth(a[0])), LONG)


def _sum(a: list[Value]) -> Value:
    x, t = _numeric(a[0])
    return Value(F.try_sum(x), t)


def _sumif(a: list[Value]) -> Value:
    x, t = _numeric(a[0])
    return Value(F.try_sum(F.when(values.truth(a[1]), x)), t)


def _avg(a: list[Value]) -> Value:
    return Value(F.avg(_numeric(a[0])[0].cast("double")), REAL)


def _extreme(f):
    def run(a: list[Value]) -> Value:
        v = a[0]
        return Value(f(text(v)), STRING) if v.type == DYNAMIC else Value(f(v.column), v.type)

    return run


def element(a: list[Value]) -> Value:
    """JSON text of a collected value; text that looks like JSON is taken as it is."""
    return Value(_json_text(a[0]), DYNAMIC)


def _json_text(v: Value) -> Column:
    if v.type == DYNAMIC:
        return v.column
    if v.type != STRING:
        return values.to_dynamic(v)
    trimmed = F.trim(v.column)
    looks = trimmed.rlike(r'^[{\["]') & F.try_parse_json(trimmed).isNotNull()
    return F.when(looks, trimmed).otherwise(values.to_dynamic(v))


#: Collections: name -> whether of distinct values. They are lowered apart, as a buffer of a whole group has no bound.
COLLECTIONS = {"make_set": True, "make_list": False}


AGGREGATES: dict[str, tuple[int, int, str, Callable[[list[Value]], Value]]] = {
    "count": (0, 0, "count_", _count),
    "countif": (1, 1, "countif_", _countif),
    "sum": (1, 1, "sum_", _sum),
    "sumif": (2, 2, "sumif_", _sumif),
    "min": (1, 1, "min_", _extreme(F.min)),
    "max": (1, 1, "max_", _extreme(F.max)),
    "avg": (1, 1, "avg_", _avg),
    "make_set": (1, 1, "set_", element),
    "make_list": (1, 1, "list_", element),
    "take_any": (1, 1, "any_", _extreme(F.min)),
}
