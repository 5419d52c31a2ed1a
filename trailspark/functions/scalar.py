"""Scalar functions: name -> (fewest and most arguments, lowering).

A lowering gets the call's context and its typed arguments. Wrong kinds of input
give null, not an error.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import functions as F

from . import arrow, values
from .regex import RegexError, n_groups, to_java
from .values import BOOL, DATETIME, DYNAMIC, LONG, NULL, REAL, STRING, TIMESPAN, Value, text


@dataclass(frozen=True)
class Context:
    now: dt.datetime
    fail: Callable[[str], Exception]


_UNITS = {"tick": 1e-7, "microsecond": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
#: Go durations are 64-bit nanoseconds.
_LONGEST = (2**63 - 1) / 1e9


def duration(text_: str) -> dt.timedelta:
    """A duration such as 90m, 2.5d or 1w."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)(ms|microsecond|tick|[smhdw])", text_)
    if not m:
        raise ValueError(f"invalid duration {text_!r}")
    seconds = float(m[1]) * _UNITS[m[2]]
    if seconds > _LONGEST:
        raise ValueError(f"duration {text_} is out of range")
    return dt.timedelta(seconds=seconds)


def _now(c: Context, args: list[Value]) -> Value:
    return values.stamp(c.now)


def _ago(c: Context, args: list[Value]) -> Value:
    if not args[0].constant or args[0].type != TIMESPAN:
        raise c.fail("ago() takes a duration such as 1d")
    try:
        return values.stamp(c.now - duration(str(args[0].const)))
    except (ValueError, OverflowError) as e:
        raise c.fail(str(e)) from e


def instant(text_: str) -> dt.datetime:
    """An RFC 3339 instant or an ISO date, in UTC."""
    m = re.fullmatch(r"(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}:\d{2})(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})?)?", text_)
    if not m:
        raise ValueError(f"invalid datetime {text_!r}")
    fraction = (m[3] or "")[:7]
    whole = dt.datetime.fromisoformat(f"{m[1]}T{m[2] or '00:00:00'}{fraction.ljust(7, '0') if fraction else ''}{(m[4] or 'Z').replace('Z', '+00:00')}")
    return whole.astimezone(dt.timezone.utc)


def _datetime(c: Context, args: list[Value]) -> Value:
    if not args[0].constant or not isinstance(args[0].const, str):
        raise c.fail("datetime() takes a constant string")
    try:
        return values.stamp(instant(args[0].const))
    except ValueError as e:
        raise c.fail(str(e)) from e


def _cast(type_: str):
    return lambda c, a: Value(values.convert(a[0], type_).column, type_) if a[0].type != NULL else Value(F.lit(None).cast(values.SPARK[type_]), type_)


def _tostring(c: Context, args: list[Value]) -> Value:
    return Value(text(args[0]), STRING)


def _on_text(make):
    return lambda c, a: Value(make(*[text(x) for x in a]), STRING)


def _isnull(c: Context, a: list[Value]) -> Value:
    return Value(text(a[0]).isNull() if a[0].type == DYNAMIC else a[0].column.isNull(), BOOL)


def _isnotnull(c: Context, a: list[Value]) -> Value:
    return Value(~_isnull(c, a).column, BOOL)


def _isempty(c: Context, a: list[Value]) -> Value:
    t = text(a[0])
    return Value(t.isNull() | (t == ""), BOOL)


def _isnotempty(c: Context, a: list[Value]) -> Value:
    return Value(~_isempty(c, a).column, BOOL)


def _parse_json(c: Context, a: list[Value]) -> Value:
    if a[0].type == DYNAMIC:
        return a[0]
    t = text(a[0])
    ok = F.try_parse_json(t).isNotNull()
    checked = F.when(t.isNull() | ok, t).otherwise(F.raise_error(F.lit("malformed JSON")).cast("string"))
    return Value(checked, DYNAMIC)


def _kind(v: Value, opens: str):
    """The JSON text of a dynamic or string value that begins like an array or object."""
    if v.type not in (DYNAMIC, STRING):
        return F.lit(None).cast("string")
    t = text(v)
    return F.when(F.ltrim(F.translate(t, "\n\t\r", "   ")).startswith(opens), t)


def _array_length(c: Context, a: list[Value]) -> Value:
    return Value(F.json_array_length(_kind(a[0], "[")).cast("bigint"), LONG)


def _bag_keys(c: Context, a: list[Value]) -> Value:
    return Value(F.to_json(F.array_sort(F.json_object_keys(_kind(a[0], "{")))), DYNAMIC)


def _bag_has_key(c: Context, a: list[Value]) -> Value:
    if a[0].type not in (DYNAMIC, STRING) or a[1].type not in (DYNAMIC, STRING):
        return Value(F.lit(None).cast("boolean"), BOOL)
    bag = text(a[0])
    if a[1].constant and isinstance(a[1].const, str) and not a[1].const.startswith("$") and len(a[1].const.encode()) <= arrow.MAX_PATH:
        small = F.when(F.octet_length(bag) <= arrow.MAX_DYNAMIC, bag)
        # json_object_keys reads the root's keys alone; the whole text must be JSON
        ok = F.try_parse_json(small).isNotNull()
        return Value(F.when(ok, F.array_contains(F.json_object_keys(_kind(Value(small, STRING), "{")), a[1].const)), BOOL)
    return Value(arrow.has_key_udf(bag, text(a[1])), BOOL)


def _set_has_element(c: Context, a: list[Value]) -> Value:
    if a[0].type not in (DYNAMIC, STRING) or a[1].type == NULL:
        return Value(F.lit(None).cast("boolean"), BOOL)
    if a[1].type in (LONG, REAL, BOOL):
        wanted = a[1].column.cast("bigint") if a[1].type == BOOL else a[1].column
        # reals keep a fraction or exponent in their text
        return Value(arrow.set_has_number_udf(text(a[0]), wanted.cast("string")), BOOL)
    return Value(arrow.set_has_text_udf(text(a[0]), text(a[1])), BOOL)


def _base64(c: Context, a: list[Value]) -> Value:
    t = F.when(F.octet_length(text(a[0])) <= arrow.MAX_DECODE, text(a[0]))
    raw = F.try_to_binary(t, F.lit("base64"))
    same = F.regexp_replace(F.base64(raw), "[\r\n]", "") == t
    return Value(F.when(same, F.try_validate_utf8(raw.cast("string"))), STRING)


def _url_decode(c: Context, a: list[Value]) -> Value:
    t = F.when(F.octet_length(text(a[0])) <= arrow.MAX_DECODE, text(a[0]))
    well = ~t.rlike("%(?![0-9A-Fa-f]{2})")
    decoded = F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B")))
    # bytes that are no UTF-8 decode to U+FFFD, which only its own escape may give
    honest = ~F.contains(decoded, F.lit("�")) | F.contains(t, F.lit("�")) | F.contains(F.upper(t), F.lit("%EF%BF%BD"))
    return Value(F.when(well & honest, decoded), STRING)


_OCTET = r"(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"
_ADDRESS = rf"^{_OCTET}(?:\.{_OCTET}){{3}}"
_PRIVATE = r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)"


def _ipv4_is_private(c: Context, a: list[Value]) -> Value:
    if a[0].type not in (STRING, DYNAMIC):
        return Value(F.lit(None).cast("boolean"), BOOL)
    t = text(a[0])
    return Value(F.when(t.rlike(_ADDRESS + r"(?:/(?:[0-9]|[12]\d|3[0-2]))?\z"), t.rlike(_PRIVATE)), BOOL)


def _ipv4_is_in_range(c: Context, a: list[Value]) -> Value:
    if any(x.type not in (STRING, DYNAMIC) for x in a):
        return Value(F.lit(None).cast("boolean"), BOOL)
    if not a[1].constant:
        return Value(arrow.in_range_udf(text(a[0]), text(a[1])), BOOL)
    spans = arrow.ranges(a[1].const)
    if spans is None:
        return Value(F.lit(None).cast("boolean"), BOOL)
    t = text(a[0])
    part = F.split(t, r"\.")
    ip = sum((part[i].try_cast("bigint") * (1 << (24 - 8 * i)) for i in range(1, 4)), part[0].try_cast("bigint") * (1 << 24))
    inside = F.lit(False)
    for first, last in spans:
        inside = inside | ip.between(first, last)
    return Value(F.when(t.rlike(_ADDRESS + r"\z"), inside), BOOL)


def _iff(c: Context, a: list[Value]) -> Value:
    (yes, no), t = values.common(a[1:])
    return Value(F.when(values.truth(a[0]), yes).otherwise(no), t)


def _case(c: Context, a: list[Value]) -> Value:
    if len(a) % 2 == 0:
        raise c.fail("case() takes pairs and a default")
    branches, t = values.common([*a[1::2], a[-1]])
    out = None
    for condition, branch in zip(a[:-1:2], branches[:-1], strict=True):
        out = F.when(values.truth(condition), branch) if out is None else out.when(values.truth(condition), branch)
    return Value(out.otherwise(branches[-1]), t)


def _coalesce(c: Context, a: list[Value]) -> Value:
    columns, t = values.common(a)
    return Value(F.coalesce(*columns), t)


def _strlen(c: Context, a: list[Value]) -> Value:
    return Value(F.char_length(text(a[0])).cast("bigint"), LONG)


def _substring(c: Context, a: list[Value]) -> Value:
    start = F.greatest(values.to_long(a[1]), F.lit(0)).cast("int") + 1
    length = values.to_long(a[2]).cast("int") if len(a) > 2 else F.lit(2**31 - 1)
    return Value(F.substring(text(a[0]), start, length), STRING)


def _strcat(c: Context, a: list[Value]) -> Value:
    return Value(F.concat(*[F.coalesce(text(x), F.lit("")) for x in a]), STRING)


def _split(c: Context, a: list[Value]) -> Value:
    if not a[1].constant or not isinstance(a[1].const, str):
        raise c.fail("split() takes a constant delimiter")
    if not a[1].const:
        raise c.fail("split() delimiter cannot be empty")
    from .regex import quote

    return Value(F.to_json(F.split(text(a[0]), quote(a[1].const), -1)), DYNAMIC)


def _pattern(c: Context, v: Value) -> str:
    if not v.constant or not isinstance(v.const, str):
        raise c.fail("a regular expression must be a constant string")
    try:
        return to_java(v.const)
    except RegexError as e:
        raise c.fail(str(e)) from e


def _extract(c: Context, a: list[Value]) -> Value:
    pattern = _pattern(c, a[0])
    if not a[1].constant or not isinstance(a[1].const, int):
        raise c.fail("extract() takes a constant capture number")
    t = text(a[2])
    if not 0 <= a[1].const <= n_groups(a[0].const):
        return Value(F.when(t.isNotNull(), F.lit("")), STRING)
    return Value(F.regexp_extract(t, pattern, a[1].const), STRING)


def _trim(c: Context, a: list[Value]) -> Value:
    p = _pattern(c, a[0])
    return Value(F.regexp_replace(text(a[1]), rf"^(?:{p})+|(?:{p})+\z", ""), STRING)


def _replace_string(c: Context, a: list[Value]) -> Value:
    return Value(F.when(text(a[1]) == "", text(a[0])).otherwise(F.replace(text(a[0]), text(a[1]), text(a[2]))), STRING)


FUNCTIONS: dict[str, tuple[int, int, Callable[[Context, list[Value]], Value]]] = {
    "now": (0, 0, _now), "ago": (1, 1, _ago), "datetime": (1, 1, _datetime), "todatetime": (1, 1, _cast(DATETIME)),
    "toint": (1, 1, _cast(LONG)), "tolong": (1, 1, _cast(LONG)), "toreal": (1, 1, _cast(REAL)), "todouble": (1, 1, _cast(REAL)), "tostring": (1, 1, _tostring),
    "tolower": (1, 1, _on_text(F.lower)), "toupper": (1, 1, _on_text(F.upper)),
    "isnull": (1, 1, _isnull), "isnotnull": (1, 1, _isnotnull), "isempty": (1, 1, _isempty), "isnotempty": (1, 1, _isnotempty),
    "parse_json": (1, 1, _parse_json), "parsejson": (1, 1, _parse_json), "array_length": (1, 1, _array_length), "bag_keys": (1, 1, _bag_keys),
    "bag_has_key": (2, 2, _bag_has_key), "set_has_element": (2, 2, _set_has_element), "base64_decode_tostring": (1, 1, _base64), "url_decode": (1, 1, _url_decode),
    "ipv4_is_private": (1, 1, _ipv4_is_private), "ipv4_is_in_range": (2, 2, _ipv4_is_in_range),
    "iff": (3, 3, _iff), "case": (3, 65, _case), "coalesce": (1, 64, _coalesce), "strlen": (1, 1, _strlen), "substring": (2, 3, _substring), "strcat": (1, 64, _strcat),
    "split": (2, 2, _split), "extract": (3, 3, _extract), "trim": (2, 2, _trim), "replace_string": (3, 3, _replace_string),
}
