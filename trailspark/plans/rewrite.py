"""Edits of a query's text: its source, and filters put behind the source."""

from __future__ import annotations

import datetime as dt
import json

from .errors import QueryError
from .lexer import Lexer, Token


def _source(query: str) -> Token | None:
    """The name that the main statement starts with; let statements are passed over."""
    try:
        tokens = Lexer(query).tokens()
    except QueryError:
        return None
    start = 0
    for i, t in enumerate(tokens):
        if t.kind == "op" and t.text == ";":
            start = i + 1
    t = tokens[start]
    follows = tokens[min(start + 1, len(tokens) - 1)]
    return t if t.kind == "name" and t.text.lower() != "let" and (follows.kind == "end" or follows.text == "|") else None


def source(query: str) -> str | None:
    t = _source(query)
    return t.text if t else None


def replace_source(query: str, name: str) -> str:
    t = _source(query)
    return query[: t.start] + name + query[t.start + len(t.text) :] if t else f"{name}\n{query.lstrip()}"


def insert_after_source(query: str, clause: str) -> str:
    t = _source(query)
    if t is None:
        return f"{query.rstrip()}\n{clause}"
    end = t.start + len(t.text)
    return f"{query[:end]}\n{clause}\n{query[end:].lstrip()}".rstrip("\n") if query[end:].strip() else f"{query[:end]}\n{clause}"


def time_range(query: str, start: dt.datetime, end: dt.datetime, column: str = "TimeGenerated") -> str:
    """Only rows from start on and before end."""

    def text(t: dt.datetime) -> str:
        return t.astimezone(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond // 1000:03d}Z"

    return insert_after_source(query, f'| where {column} >= datetime("{text(start)}") and {column} < datetime("{text(end)}")')


def value_filter(query: str, column: str, value: object, exclude: bool = False) -> str:
    """Only rows with a value, or only those without it."""
    written = json.dumps(value) if isinstance(value, (bool, int, float)) else json.dumps(str(value), ensure_ascii=False)
    return insert_after_source(query, f"| where {column} {'!=' if exclude else '=='} {written}")
