"""JSON as text: numbers keep their spelling, and re-written records have sorted keys."""

from __future__ import annotations

import json
import re

MAX_DEPTH = 32


class Number(str):
    """A JSON number as it is written."""

    __slots__ = ()


def _constant(x: str):
    raise ValueError(f"invalid JSON value {x}")


_decoder = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_constant)
_SPACE = re.compile(r'("(?:[^"\\]|\\.)*")|[ \t\r\n]+')
_LEADING = re.compile(r"[ \t\r\n]*")


def loads(text: str):
    value, end = _decoder.raw_decode(text, _LEADING.match(text).end())
    if _LEADING.match(text, end).end() != len(text):
        raise ValueError("content after the JSON value")
    return value


def minify(text: str) -> str:
    """The same JSON without white space between tokens."""
    return _SPACE.sub(lambda m: m[1] or "", text)


_ESCAPE = re.compile(r'[\x00-\x1f"\\<>&\u2028\u2029]')
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def quote(text: str) -> str:
    return '"' + _ESCAPE.sub(lambda m: _SHORT.get(m[0]) or f"\\u{ord(m[0]):04x}", text) + '"'


def dumps(value) -> str:
    """Compact JSON with sorted keys; numbers as they were written."""
    if value is None:
        return "null"
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, str):
        return quote(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{quote(k)}:{dumps(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(dumps, value)) + "]"
    return json.dumps(value)


def embedded(text: str):
    """The value of a string that holds a JSON object or array, else None."""
    trimmed = text.strip(" \t\r\n")
    if trimmed[:1] not in ("{", "["):
        return None
    try:
        return loads(trimmed)
    except (ValueError, RecursionError):
        return None


ELEMENT = "[]"


def normalize(value, known: set[tuple[str, ...]] | None, found: set[tuple[str, ...]] | None = None, path: tuple[str, ...] = (), depth: int = 0):
    """(value, changed): strings that hold objects or arrays become them, recursively.

    known: the only paths where that is tried; None: everywhere. found collects
    the paths where it happened; an array's elements share one path.
    """
    if depth > MAX_DEPTH:
        return value, False
    if isinstance(value, dict):
        changed, out = False, {}
        for k, v in value.items():
            out[k], c = normalize(v, known, found, (*path, k), depth + 1)
            changed |= c
        return (out, True) if changed else (value, False)
    if isinstance(value, list):
        pairs = [normalize(v, known, found, (*path, ELEMENT), depth + 1) for v in value]
        return ([v for v, _ in pairs], True) if any(c for _, c in pairs) else (value, False)
    if isinstance(value, str) and not isinstance(value, Number) and (known is None or path in known):
        inner = embedded(value)
        if inner is not None:
            if found is not None:
                found.add(path)
            return normalize(inner, known, found, path, depth + 1)[0], True
    return value, False


_KEY = re.compile(r"((?:[^.\\]|\\.)+)(?:\.|\Z)", re.S)


def split_path(path: str) -> list[str]:
    """Keys of a dotted path; a backslash takes the next character as it is."""
    keys, at = [], 0
    while at < len(path):
        m = _KEY.match(path, at)
        if not m:
            raise ValueError(f"malformed path {path!r}")
        keys.append(re.sub(r"\\(.)", r"\1", m[1], flags=re.S))
        at = m.end()
    if not keys or path.endswith(".") and not path.endswith("\\."):
        raise ValueError(f"malformed path {path!r}")
    return keys


_MISSING = object()


def at_path(value, keys: list[str]):
    """(found, value) at a path; digits index arrays."""
    for k in keys:
        if isinstance(value, dict) and k in value:
            value = value[k]
        elif isinstance(value, list) and k.isdigit() and int(k) < len(value):
            value = value[int(k)]
        else:
            return False, None
    return True, value


def plain(value) -> str:
    """Text of a value: a string as it is, anything else as JSON."""
    return value if isinstance(value, str) and not isinstance(value, Number) else dumps(value)


def members(text: str) -> dict[str, str]:
    """Each root key of a minified object with its value's text."""
    out, at = {}, 1
    while text[at] != "}":
        key, at = _decoder.raw_decode(text, at)
        _, end = _decoder.raw_decode(text, at + 1)
        out[key] = text[at + 1 : end]
        at = end + (text[end] == ",")
    return out
