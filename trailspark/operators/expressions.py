"""Expressions to typed columns."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailspark.functions import values
from trailspark.functions.aggregates import AGGREGATES
from trailspark.functions.regex import RegexError, quote, term, to_java
from trailspark.functions.scalar import FUNCTIONS, Context, duration
from trailspark.functions.values import BOOL, DATETIME, DYNAMIC, LONG, NULL, REAL, STRING, TIMESPAN, Value, text
from trailspark.plans.errors import QueryError
from trailspark.plans.nodes import Between, Binary, Call, InList, Literal, Member, Name, Node, Unary

from .relation import Relation


class Binder:
    """Binds expressions against a relation and scalar bindings."""

    def __init__(self, relation: Relation | None, scalars: dict[str, Value], now: dt.datetime):
        self.relation, self.scalars, self.now = relation, scalars, now

    @staticmethod
    def fail(message: str, node: Node) -> QueryError:
        return QueryError(message, node.token.line, node.token.column)

    def bind(self, e: Node) -> Value:
        return getattr(self, "_" + type(e).__name__.lower())(e)

    def condition(self, e: Node) -> Column:
        v = self.bind(e)
        if v.type in (DATETIME, TIMESPAN):
            raise self.fail("expected a condition", e)
        return values.truth(v)

    def _literal(self, e: Literal) -> Value:
        if e.type == "timespan":
            return Value(F.lit(None).cast("string"), TIMESPAN, e.value, True)
        return values.literal(e.value, e.type)

    def _name(self, e: Name) -> Value:
        if self.relation is not None and (c := self.relation.find(e.name)) is not None:
            return Value(c.column(), c.type)
        if (v := self.scalars.get(e.name.lower())) is not None:
            return v
        raise self.fail(f"unknown column {e.name}", e)

    def _member(self, e: Member) -> Value:
        base = self.bind(e.base)
        if base.type == STRING:
            base = base.typed(DYNAMIC)
        if base.type != DYNAMIC:
            raise self.fail(f"a {base.type} value has no members", e)
        out = values.member(base, e.key)
        if self.relation is not None and self.relation.indexes and (path := _dotted(e)) is not None and path in self.relation.indexes:
            return replace(out, plain=F.col(f"`{self.relation.indexes[path]}`"))
        return out

    def _call(self, e: Call) -> Value:
        if e.name in AGGREGATES and e.name not in FUNCTIONS:
            raise self.fail(f"aggregate {e.name}() is only allowed in summarize", e)
        if e.name not in FUNCTIONS:
            raise self.fail(f"unknown function {e.name}", e)
        low, high, lower = FUNCTIONS[e.name]
        if not low <= len(e.args) <= high:
            raise self.fail(f"{e.name}() takes {low if low == high else f'{low} to {high}'} argument{'s' * (high != 1)}", e)
        return lower(Context(self.now, lambda m: self.fail(m, e)), [self.bind(a) for a in e.args])

    def _unary(self, e: Unary) -> Value:
        if e.op == "not":
            return Value(~self.condition(e.arg), BOOL)
        v = self.bind(e.arg)
        if e.op == "+":
            return v
        if v.constant and v.type in (LONG, REAL):
            return values.literal(-v.const, v.type)
        if v.type == DYNAMIC:
            return self._arithmetic("-", values.literal(0, LONG), v, e)
        if v.type not in (LONG, REAL):
            raise self.fail(f"cannot negate a {v.type} value", e)
        return Value(F.try_subtract(F.lit(0).cast(values.SPARK[v.type]), v.column), v.type)

    def _binary(self, e: Binary) -> Value:
        if e.op in ("and", "or"):
            left, right = self.condition(e.left), self.condition(e.right)
            return Value(left & right if e.op == "and" else left | right, BOOL)
        left, right = self.bind(e.left), self.bind(e.right)
        if e.op in ("+", "-", "*", "/", "%"):
            return self._arithmetic(e.op, left, right, e)
        if e.op in ("==", "!=", "<", "<=", ">", ">="):
            return Value(self.compare(e.op, left, right, e), BOOL)
        if e.op in ("=~", "!~"):
            same = F.lower(text(left)) == F.lower(text(right))
            return Value(same if e.op == "=~" else ~same, BOOL)
        return Value(self._string_op(e.op, left, right, e), BOOL)

    # -- arithmetic
    def _arithmetic(self, op: str, a: Value, b: Value, e: Node) -> Value:
        if TIMESPAN in (a.type, b.type):
            return self._shift(op, a, b, e)
        if a.type == DATETIME or b.type == DATETIME:
            raise self.fail(f"cannot apply {op} to a datetime", e)
        if STRING in (a.type, b.type):
            a, b = (x if x.type != STRING else Value(text(x).try_cast("double"), REAL) for x in (a, b))
        if DYNAMIC in (a.type, b.type):
            # whole numbers stay whole
            whole = self._numbers(op, *[x.column if x.type == LONG else text(x).try_cast("bigint") if x.type == DYNAMIC else F.lit(None).cast("bigint") for x in (a, b)], LONG)
            real = self._numbers(op, values.number(a).cast("double"), values.number(b).cast("double"), REAL)
            return Value(F.coalesce(whole.cast("string"), real.cast("string")), DYNAMIC)
        t = REAL if REAL in (a.type, b.type) else LONG
        cast = values.SPARK[t]
        return Value(self._numbers(op, values.number(a).cast(cast), values.number(b).cast(cast), t), t)

    @staticmethod
    def _numbers(op: str, x: Column, y: Column, t: str) -> Column:
        if op == "+":
            return F.try_add(x, y)
        if op == "-":
            return F.try_subtract(x, y)
        if op == "*":
            return F.try_multiply(x, y)
        if op == "%":
            return F.try_mod(x, y)
        if t == REAL:
            return F.try_divide(x, y)
        # whole division rounds toward zero; the one overflow is the least long by -1
        unsafe = (y == 0) | ((y == -1) & (x == F.lit(-(2**63))))
        return F.when(~unsafe, F.call_function("div", x, F.when(unsafe, F.lit(1)).otherwise(y)))

    def _shift(self, op: str, a: Value, b: Value, e: Node) -> Value:
        if op not in "+-" or (b.type != TIMESPAN) or a.type != DATETIME:
            raise self.fail("a duration can only be added to or taken from a datetime", e)
        try:
            seconds = duration(str(b.const)).total_seconds()
        except ValueError as x:
            raise self.fail(str(x), e) from x
        shift = F.make_interval(secs=F.lit(seconds))
        return Value(a.column + shift if op == "+" else a.column - shift, DATETIME)

    # -- comparison
    def compare(self, op: str, a: Value, b: Value, e: Node) -> Column:
        if TIMESPAN in (a.type, b.type):
            raise self.fail("a duration cannot be compared", e)
        x, y = self.comparable(a, b)
        return {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    @staticmethod
    def comparable(a: Value, b: Value) -> tuple[Column, Column]:
        kinds = {a.type, b.type} - {NULL}
        if DATETIME in kinds:
            return values.to_datetime(a), values.to_datetime(b)
        if kinds & {LONG, REAL}:
            if kinds == {LONG, DYNAMIC}:
                # exact beyond 2^53
                x, y = (v.column if v.type == LONG else text(v).try_cast("decimal(38,6)") for v in (a, b))
                return x, y
            return values.number(a), values.number(b)
        if BOOL in kinds:
            return values.truth(a), values.truth(b)
        return text(a), text(b)

    # -- text
    def _string_op(self, op: str, left: Value, right: Value, e: Binary) -> Column:
        sensitive = op.endswith("_cs")
        name = op.removesuffix("_cs")
        t = text(left)
        if name.startswith("has"):
            return self._has(name, t, right, sensitive, e)
        x, y = (t, text(right)) if sensitive else (F.lower(t), F.lower(text(right)))
        return {"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith}[name](x, y)

    def _has(self, name: str, t: Column, wanted: Value, sensitive: bool, e: Node) -> Column:
        if not wanted.constant or not isinstance(wanted.const, str):
            raise self.fail(f"{name} takes a constant term", e)
        return term_match(t, wanted.const, name != "hassuffix", name != "hasprefix", sensitive)

    def _inlist(self, e: InList) -> Value:
        left = self.bind(e.left)
        items = [self.bind(i) for i in e.items]
        if e.op in ("has_any", "has_all"):
            parts = [self._has("has", text(left), i, False, e) for i in items]
            out = reduce(lambda a, b: a | b if e.op == "has_any" else a & b, parts)
        elif e.op == "in~":
            t = F.lower(text(left))
            out = t.isin([i.const.lower() for i in items]) if all(isinstance(i.const, str) for i in items) else reduce(lambda a, b: a | b, [t == F.lower(text(i)) for i in items])
        elif left.type in (STRING, DYNAMIC) and all(isinstance(i.const, str) for i in items):
            out = text(left).isin([i.const for i in items])
        else:
            out = reduce(lambda a, b: a | b, [self.compare("==", left, i, e) for i in items])
        return Value(~out if e.negated else out, BOOL)

    def _between(self, e: Between) -> Value:
        left, low, high = self.bind(e.left), self.bind(e.low), self.bind(e.high)
        out = self.compare(">=", left, low, e) & self.compare("<=", left, high, e)
        return Value(~out if e.negated else out, BOOL)

    def pattern(self, text_: str, e: Node) -> str:
        try:
            return to_java(text_)
        except RegexError as x:
            raise self.fail(str(x), e) from x


def _dotted(e: Node) -> str | None:
    """The path of a chain of names."""
    if isinstance(e, Name):
        return e.name
    if isinstance(e, Member) and isinstance(e.key, str) and (base := _dotted(e.base)) is not None:
        return f"{base}.{e.key}"
    return None


def folded(t: Column) -> Column:
    """Lower case in which ASCII letters stand for all their simple case variants: the long s and the Kelvin sign, but no dotted capital i."""
    return F.replace(F.lower(F.replace(t, F.lit("\u0130"), F.lit("\u0131"))), F.lit("\u017f"), F.lit("s"))


def term_match(t: Column, wanted: str, left: bool = True, right: bool = True, sensitive: bool = False) -> Column:
    """A term with boundaries; plain containment is tested first, as it is cheap and rarely true."""
    if not wanted:
        return F.lit(False)
    if sensitive:
        match = F.contains(t, F.lit(wanted)) & t.rlike(term(wanted, left, right, True))
    elif wanted.isascii():
        # matched in lower case, without slow folding
        low, small = folded(t), wanted.lower()
        match = F.contains(low, F.lit(small)) & low.rlike(term(small, left, right, True))
    else:
        match = t.rlike(term(wanted, left, right, False))
    # as for a value that is no text, a null does not match
    return F.coalesce(match, F.lit(False))


def word_match(t: Column, wanted: str, sensitive: bool = False) -> Column:
    """A term between characters that are no Unicode letter, digit or underscore; a library function, not of the language."""
    if not wanted:
        return F.when(t.isNotNull(), F.lit(False))
    return t.rlike(("" if sensitive else "(?iu)") + r"(?<![\p{L}\p{Nd}_])" + quote(wanted) + r"(?![\p{L}\p{Nd}_])")
