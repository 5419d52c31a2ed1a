"""Order of returned rows by one column."""

from __future__ import annotations

import json
import re
from functools import cmp_to_key


def _natural(text: str) -> list[tuple[int, int, str]]:
    return [(0, int(p), "") if p.isdigit() else (1, 0, p.casefold()) for p in re.split(r"(\d+)", text) if p]


def _compare(a: object, b: object) -> int:
    if a is None or b is None:
        return (a is None) - (b is None)
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool):
        return (a > b) - (a < b)
    x, y = (_natural(v if isinstance(v, str) else json.dumps(v)) for v in (a, b))
    return (x > y) - (x < y)


def sort_rows(rows: list[dict], column: str | None, descending: bool = False) -> list[dict]:
    """Numbers by value, other cells in natural order without case; nulls are last when ascending, first when descending."""
    if not column:
        return rows
    sign = -1 if descending else 1
    return sorted(rows, key=cmp_to_key(lambda a, b: sign * _compare(a.get(column), b.get(column))))
