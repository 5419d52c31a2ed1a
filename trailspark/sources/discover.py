"""Fields of a dataset: paths with types, from a bounded sample of records."""

from __future__ import annotations

import re

from .jsontext import MAX_DEPTH, Number

RESERVED = {"timegenerated", "source", "rawdata"}
_IDENTIFIER = re.compile(r"[^\W\d]\w*\Z")


def is_identifier(name: str) -> bool:
    return bool(_IDENTIFIER.match(name))


def type_of(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, Number):
        return "real" if re.search(r"[.eE]", value) else "long"
    if isinstance(value, str):
        return "string"
    return "dynamic"


def merge(a: str | None, b: str) -> str:
    """The type of a field seen as both: nothing overrides null, two kinds are mixed."""
    if a is None or a == "null" or a == b:
        return b
    return a if b == "null" else "mixed"


def walk(value: dict, into: dict[tuple[str, ...], str], path: tuple[str, ...] = ()) -> None:
    """Record the type at each object path; arrays are leaves."""
    if len(path) > MAX_DEPTH:
        return
    for k, v in value.items():
        at = (*path, k)
        into[at] = merge(into.get(at), type_of(v))
        if isinstance(v, dict):
            walk(v, into, at)


def root_columns(fields: dict[tuple[str, ...], str]) -> dict[str, str]:
    """Root keys that become columns: identifiers that are not reserved and differ by more than case."""
    roots = [p[0] for p in fields if len(p) == 1]
    folded: dict[str, int] = {}
    for r in roots:
        folded[r.lower()] = folded.get(r.lower(), 0) + 1
    return {r: fields[(r,)] for r in roots if is_identifier(r) and r.lower() not in RESERVED and folded[r.lower()] == 1}


def catalogue_path(path: tuple[str, ...], columns: dict[str, str]) -> str:
    """How a query writes a path."""

    def step(key: str) -> str:
        return "." + key if is_identifier(key) else '["' + key.replace("\\", "\\\\").replace('"', '\\"') + '"]'

    head = path[0] if path[0] in columns else 'RawData["' + path[0].replace("\\", "\\\\").replace('"', '\\"') + '"]'
    return head + "".join(map(step, path[1:]))
