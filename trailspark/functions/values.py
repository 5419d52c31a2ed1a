"""Typed values: a Spark column together with its query-language type.

Dynamic values are JSON text. ``text`` unwraps one to plain text (a JSON string
loses its quotes), which is what comparisons and string functions work on.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

BOOL, LONG, REAL, STRING, DATETIME, DYNAMIC, TIMESPAN, NULL = "bool", "long", "real", "string", "datetime", "dynamic", "timespan", "null"
SPARK = {BOOL: "boolean", LONG: "bigint", REAL: "double", STRING: "string", DATETIME: "timestamp_ntz", DYNAMIC: "string"}
#: Names a cast or typeof() may use.
ALIASES = {"bool": BOOL, "boolean": BOOL, "long": LONG, "int": LONG, "real": REAL, "double": REAL, "string": STRING, "datetime": DATETIME, "date": DATETIME, "dynamic": DYNAMIC}


@dataclass(frozen=True)
class Value:
    column: Column
    type: str
    #: The Python value of a compile-time constant.
    const: object = None
    constant: bool = False
    #: A dynamic path: the column it starts from and its keys.
    base: Column | None = None
    keys: tuple[str | int, ...] = ()
    #: Plain text that is kept in a column of its own.
    plain: Column | None = None

    def typed(self, type_: str) -> Value:
        return replace(self, type=type_)


def literal(value: object, type_: str) -> Value:
    if type_ == NULL:
        return Value(F.lit(None).cast("string"), NULL, None, True)
    if type_ == LONG and not -(2**63) <= int(value) < 2**63:
        value, type_ = float(value), REAL
    column = F.lit(value) if type_ != LONG else F.lit(int(value)).cast("bigint")
    return Value(column, type_, value, True)


def stamp(value: dt.datetime) -> Value:
    naive = value.astimezone(dt.timezone.utc).replace(tzinfo=None) if value.tzinfo else value
    return Value(F.lit(naive.isoformat(sep=" ")).cast("timestamp_ntz"), DATETIME, naive, True)


def json_path(keys: tuple[str | int, ...]) -> str | None:
    """A path for get_json_object; None if a key cannot be written in one."""
    out = "$"
    for k in keys:
        if isinstance(k, int):
            if k < 0:
                return None
            out += f"[{k}]"
        elif "'" in k or not k:
            return None
        else:
            out += f"['{k}']"
    return out


def member(v: Value, key: str | int) -> Value:
    """One step into a dynamic value."""
    base, keys = (v.base, v.keys) if v.base is not None else (v.column, ())
    keys = (*keys, key)
    return Value(path_json(base, keys), DYNAMIC, base=base, keys=keys)


def _variant(base: Column, keys: tuple[str | int, ...]) -> Column:
    path = "$" + "".join(f"[{k}]" if isinstance(k, int) else '["' + k.replace("\\", "\\\\").replace('"', '\\"') + '"]' for k in keys)
    return F.try_variant_get(F.try_parse_json(base), path, "variant")


def path_json(base: Column, keys: tuple[str | int, ...]) -> Column:
    """JSON text at a path: strings keep their quotes; missing and JSON null give null."""
    if any(isinstance(k, int) and k < 0 for k in keys):
        return F.lit(None).cast("string")
    got = F.to_json(_variant(base, keys))
    return F.when(got != F.lit("null"), got)


def text(v: Value) -> Column:
    """Plain text of a value of any type."""
    if v.type == DYNAMIC:
        if v.plain is not None:
            return v.plain
        if v.base is not None and (path := json_path(v.keys)) is not None:
            return F.get_json_object(v.base, path)
        unwrapped = F.get_json_object(v.column, "$")
        # text that is no JSON stands for itself
        return F.when(F.trim(v.column) == F.lit("null"), F.lit(None).cast("string")).otherwise(F.coalesce(F.when(F.trim(v.column).startswith('"'), unwrapped), v.column))
    if v.type == DATETIME:
        return F.date_format(v.column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'000Z'")
    if v.type in (STRING, NULL):
        return v.column
    return v.column.cast("string")


_LEADING_INT = r"^\s*([+-]?\d+)"
_LEADING_REAL = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def to_long(v: Value) -> Column:
    """The longest numeric prefix, else 0; null stays null."""
    if v.type == LONG:
        return v.column
    if v.type == BOOL:
        return v.column.cast("bigint")
    if v.type == REAL:
        # toward zero, held to the range of a long
        x = v.column
        return F.when(x >= 9.2233720368547758e18, F.lit(2**63 - 1)).when(x <= -9.2233720368547758e18, F.lit(-(2**63))).when(F.isnan(x), F.lit(0)).otherwise(x.try_cast("bigint"))
    t = text(v)
    if v.type == DYNAMIC:
        t = F.when(t == "true", "1").when(t == "false", "0").otherwise(t)
    return F.when(t.isNull(), F.lit(None)).otherwise(F.coalesce(F.regexp_extract(t, _LEADING_INT, 1).try_cast("bigint"), F.lit(0))).cast("bigint")


def to_real(v: Value) -> Column:
    if v.type == REAL:
        return v.column
    if v.type in (LONG, BOOL):
        return v.column.cast("double")
    t = text(v)
    if v.type == DYNAMIC:
        t = F.when(t == "true", "1").when(t == "false", "0").otherwise(t)
    return F.when(t.isNull(), F.lit(None)).otherwise(F.coalesce(F.regexp_extract(t, _LEADING_REAL, 1).try_cast("double"), F.lit(0.0))).cast("double")


def number(v: Value) -> Column:
    """A number for comparisons: text that is none gives null."""
    if v.type in (LONG, REAL):
        return v.column
    if v.type == BOOL:
        return v.column.cast("bigint")
    return text(v).try_cast("double")


def truth(v: Value) -> Column:
    """A condition."""
    if v.type == BOOL:
        return v.column
    if v.type in (LONG, REAL):
        return v.column != 0
    t = text(v)
    return F.when(t == "true", True).when(t == "false", False).otherwise(t.try_cast("double") != 0)


_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?(?:Z|[+-]\d{2}:\d{2})?)?\z"


def to_datetime(v: Value) -> Column:
    """Strict ISO 8601 text in UTC, to microseconds; anything else is null."""
    if v.type == DATETIME:
        return v.column
    if v.type not in (STRING, DYNAMIC):
        return F.lit(None).cast("timestamp_ntz")
    t = text(v)
    cut = F.regexp_replace(t, r"(\.\d{6})\d+", "$1")
    return F.when(t.rlike(_ISO), cut.try_cast("timestamp")).try_cast("timestamp_ntz")


def to_dynamic(v: Value) -> Column:
    """JSON text of a value."""
    if v.type == DYNAMIC:
        return v.column
    if v.type in (BOOL, LONG, REAL):
        return v.column.cast("string")
    quoted = F.to_json(F.struct(text(v).alias("x")))
    return F.when(text(v).isNotNull(), F.regexp_replace(quoted, r'^\{"x":|\}$', ""))


def convert(v: Value, type_: str) -> Value:
    """A value in another type, leniently."""
    if v.type == type_:
        return v
    made = {LONG: to_long, REAL: to_real, STRING: text, DATETIME: to_datetime, BOOL: truth, DYNAMIC: to_dynamic}[type_]
    return Value(made(v), type_)


def common(values: list[Value]) -> tuple[list[Column], str]:
    """Columns of one type for values that stand for each other, as in branches."""
    types = {v.type for v in values if v.type != NULL}
    if not types:
        return [v.column for v in values], STRING
    if len(types) == 1:
        t = next(iter(types))
    elif types <= {LONG, REAL, BOOL}:
        t = REAL if REAL in types else LONG
    elif types <= {STRING, DYNAMIC}:
        return [text(v) for v in values], STRING
    else:
        t = DYNAMIC
    return [F.lit(None).cast(SPARK[t]) if v.type == NULL else (v.column if v.type == t else convert(v, t).column) for v in values], t
