"""Equi-joins and lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from trailspark.functions import values
from trailspark.functions.values import Value
from trailspark.plans.nodes import Operator
from trailspark.plans.parser import JOIN_KINDS

from .expressions import Binder
from .relation import ColumnInfo, Relation

MAX_KEYS = 16
_HOW = {"inner": "inner", "leftouter": "left", "rightouter": "right", "fullouter": "full", "leftsemi": "left_semi", "leftanti": "left_anti"}


def join(left: Relation, right: Relation, op: Operator, fail) -> Relation:
    """Columns of the right side that clash get a number; keys compare by plain equality, so nulls never match.

    Which side is broadcast is left to the planner, which knows sizes.
    """
    lookup = op.name == "lookup"
    kind = op.options.get("kind", "leftouter" if lookup else None)
    if kind is None or kind == "innerunique":
        raise fail("join kind innerunique is not supported; write kind=inner", op)
    if kind not in (("inner", "leftouter") if lookup else JOIN_KINDS):
        raise fail(f"unsupported {op.name} kind {kind}", op)
    keys = op.options["keys"]
    if len(keys) > MAX_KEYS:
        raise fail(f"at most {MAX_KEYS} join keys are supported", op)
    taken = set(left.names)
    renamed: dict[str, str] = {}
    for c in right.columns:
        name, n = c.name, 1
        while name in taken:
            name, n = f"{c.name}{n}", n + 1
        taken.add(name)
        renamed[c.name] = name
    pairs = []
    for a, b, token in keys:
        x, y = left.find(a), right.find(b)
        if x is None or y is None:
            op.token = token
            raise fail(f"unknown column {a if x is None else b}", op)
        pairs.append((x, y))
    # a self-join reads each side's columns under names of its own
    ldf = left.df.select(*[c.column().alias(f"__l{i}") for i, c in enumerate(left.columns)])
    rdf = right.df.select(*[c.column().alias(f"__r{i}") for i, c in enumerate(right.columns)])
    li = {c.name: f"__l{i}" for i, c in enumerate(left.columns)}
    ri = {c.name: f"__r{i}" for i, c in enumerate(right.columns)}
    conditions = []
    for x, y in pairs:
        p, q = Binder.comparable(Value(F.col(li[x.name]), x.type), Value(F.col(ri[y.name]), y.type)) if x.type != y.type or x.type == values.DYNAMIC else (F.col(li[x.name]), F.col(ri[y.name]))
        conditions.append(p == q)
    both = ldf.join(rdf, reduce(lambda a, b: a & b, conditions), _HOW[kind])
    out = [(F.col(li[c.name]), c) for c in left.columns]
    if kind not in ("leftsemi", "leftanti"):
        dropped = {y.name for _, y in pairs} if lookup else set()
        out += [(F.col(ri[c.name]), ColumnInfo(renamed[c.name], c.type)) for c in right.columns if c.name not in dropped]
    return Relation(both.select(*[x.alias(c.name) for x, c in out]), tuple(c for _, c in out))
