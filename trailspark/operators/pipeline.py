"""Operators to DataFrame calls."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions import values
from trailspark.functions.aggregates import AGGREGATES, COLLECTIONS
from trailspark.functions.values import BOOL, DATETIME, DYNAMIC, LONG, NULL, STRING, TIMESPAN, Value
from trailspark.plans.errors import QueryError
from trailspark.plans.nodes import Binary, Call, Item, Literal, Member, Name, Node, Operator, Pipeline, Script, Unary

from .collect import collect
from .expressions import Binder, folded, term_match
from .joins import join
from .relation import ColumnInfo, Relation

MAX_ITEMS = 32
MAX_EXPANSIONS = 1


class Lowering:
    """Lowers one script; ``table`` finds a named relation."""

    def __init__(self, table: Callable[[str], Relation | None], now: dt.datetime):
        self.table, self.now = table, now
        self.scalars: dict[str, Value] = {}
        self.tables: dict[str, Relation] = {}
        self.expansions = 0

    @staticmethod
    def fail(message: str, node: Node) -> QueryError:
        return QueryError(message, node.token.line, node.token.column)

    def script(self, s: Script) -> Relation:
        for let in s.lets:
            key = let.name.lower()
            if isinstance(let.value, Pipeline):
                p = let.value
                if not p.operators and isinstance(p.source, str) and p.source.lower() in self.scalars:
                    self.scalars[key] = self.scalars[p.source.lower()]
                else:
                    self.tables[key] = self.pipeline(p)
            else:
                v = Binder(None, self.scalars, self.now).bind(let.value)
                self.scalars[key] = v
        return self.pipeline(s.main)

    def pipeline(self, p: Pipeline) -> Relation:
        if isinstance(p.source, Pipeline):
            rel = self.pipeline(p.source)
        else:
            found = self.tables.get(p.source.lower()) or self.table(p.source)
            if found is None:
                raise self.fail(f'unknown table "{p.source}"', p)
            rel = found
        for op in p.operators:
            rel = self.operator(rel, op)
        return rel

    def operator(self, rel: Relation, op: Operator) -> Relation:
        return getattr(self, "_" + op.name.replace("-", "_"))(rel, op)

    def binder(self, rel: Relation) -> Binder:
        return Binder(rel, self.scalars, self.now)

    # -- rows
    def _where(self, rel: Relation, op: Operator) -> Relation:
        return rel.with_df(rel.df.where(self.binder(rel).condition(op.exprs[0])))

    def _search(self, rel: Relation, op: Operator) -> Relation:
        return rel.with_df(rel.df.where(self._matches(rel, op.exprs[0])))

    def _matches(self, rel: Relation, e: Node):
        if isinstance(e, Literal) and isinstance(e.value, str) and e.type == "string":
            wanted = e.value
            parts = [term_match(values.text(Value(c.column(), c.type)), wanted) for c in rel.columns if c.type in (STRING, DATETIME, DYNAMIC)]
            if not parts:
                return F.lit(False)
            out = parts[0]
            for x in parts[1:]:
                out = out | x
            if rel.raw is not None and len(wanted) >= 3 and wanted.isascii() and wanted.isalnum():
                # every searched column is part of the record, its time or its source; a record may write any letter as an escape
                columns = [folded(F.col(rel.raw))] + [folded(values.text(Value(c.column(), c.type))) for c in rel.columns if c.name in ("TimeGenerated", "Source")]
                near = F.contains(columns[0], F.lit(wanted.lower())) | F.contains(F.col(rel.raw), F.lit("\\u"))
                for x in columns[1:]:
                    near = near | F.contains(x, F.lit(wanted.lower()))
                out = F.coalesce(near, F.lit(False)) & out
            return out
        if isinstance(e, Binary) and e.op in ("and", "or"):
            a, b = self._matches(rel, e.left), self._matches(rel, e.right)
            return a & b if e.op == "and" else a | b
        if isinstance(e, Unary) and e.op == "not":
            return ~self._matches(rel, e.arg)
        return self.binder(rel).condition(e)

    def _count_of(self, rel: Relation, op: Operator) -> int:
        v = Binder(None, self.scalars, self.now).bind(op.options["count"])
        if not v.constant or v.type != LONG or v.const < 0:
            raise self.fail(f"{op.name} takes a whole number", op)
        return min(int(v.const), 2**31 - 1)

    def _take(self, rel: Relation, op: Operator) -> Relation:
        return rel.with_df(rel.df.limit(self._count_of(rel, op)))

    def _sample(self, rel: Relation, op: Operator) -> Relation:
        return rel.with_df(rel.df.orderBy(F.rand()).limit(self._count_of(rel, op)))

    def _sample_distinct(self, rel: Relation, op: Operator) -> Relation:
        c = self._known(rel, op.names[0], op)
        df = rel.df.select(c.column()).distinct().orderBy(F.rand()).limit(self._count_of(rel, op))
        return Relation(df, (c,))

    def _sort_keys(self, rel: Relation, op: Operator) -> list:
        keys = []
        for e, direction, nulls in op.exprs:
            v = self.binder(rel).bind(e)
            c = values.text(v) if v.type == DYNAMIC else v.column
            if v.type == DYNAMIC:
                # numbers in number order, other text after them
                n = c.try_cast("double")
                keys += [(n.asc_nulls_first() if direction == "asc" else n.desc_nulls_last())] if nulls is None else []
            first = nulls == "first" if nulls else direction == "asc"
            keys.append(getattr(c, f"{direction}_nulls_{'first' if first else 'last'}")())
        return keys

    def _order(self, rel: Relation, op: Operator) -> Relation:
        return rel.with_df(rel.df.orderBy(*self._sort_keys(rel, op)))

    def _top(self, rel: Relation, op: Operator) -> Relation:
        return rel.with_df(rel.df.orderBy(*self._sort_keys(rel, op)).limit(self._count_of(rel, op)))

    def _serialize(self, rel: Relation, op: Operator) -> Relation:
        return self._extend(rel, op) if op.items else rel

    def _as(self, rel: Relation, op: Operator) -> Relation:
        self.tables[op.names[0].lower()] = rel
        return rel

    # -- columns
    def _known(self, rel: Relation, name: str, op: Node) -> ColumnInfo:
        if (c := rel.find(name)) is None:
            raise self.fail(f"unknown column {name}", op)
        return c

    def _named(self, rel: Relation, items: list[Item], taken: set[str] | None = None) -> list[tuple[str, Value]]:
        out: list[tuple[str, Value]] = []
        used = set(taken or ())
        for n, i in enumerate(items, 1):
            v = self.binder(rel).bind(i.expr)
            if v.type == TIMESPAN:
                raise self.fail("a duration cannot be a column", i)
            name = i.name or default_name(i.expr) or f"Column{n}"
            if name in used:
                if i.name:
                    raise self.fail(f"duplicate column {name}", i)
                base, k = name, 1
                while name in used:
                    name, k = f"{base}{k}", k + 1
            if i.name is None and isinstance(i.expr, Name) and (c := rel.find(i.expr.name)):
                name = c.name
            used.add(name)
            out.append((name, v.typed(STRING) if v.type == NULL else v))
        return out

    def _limit_items(self, op: Operator) -> None:
        if len(op.items) + len(op.by) > MAX_ITEMS:
            raise self.fail(f"{op.name} takes at most {MAX_ITEMS} items", op)

    def _project(self, rel: Relation, op: Operator) -> Relation:
        self._limit_items(op)
        named = self._named(rel, op.items)
        return Relation(rel.df.select(*[v.column.alias(n) for n, v in named]), tuple(ColumnInfo(n, v.type) for n, v in named))

    def _extend(self, rel: Relation, op: Operator) -> Relation:
        self._limit_items(op)
        named = dict(self._named(rel, op.items))
        kept = [(c.name, named.pop(c.name, None) or Value(c.column(), c.type)) for c in rel.columns]
        everything = kept + list(named.items())
        return Relation(rel.df.select(*[v.column.alias(n) for n, v in everything]), tuple(ColumnInfo(n, v.type) for n, v in everything))

    def _only(self, rel: Relation, columns: list[ColumnInfo]) -> Relation:
        return Relation(rel.df.select(*[c.column() for c in columns]), tuple(columns))

    def _project_away(self, rel: Relation, op: Operator) -> Relation:
        gone = {self._known(rel, n, op).name for n in op.names}
        return self._only(rel, [c for c in rel.columns if c.name not in gone])

    def _project_keep(self, rel: Relation, op: Operator) -> Relation:
        keep = {self._known(rel, n, op).name for n in op.names}
        return self._only(rel, [c for c in rel.columns if c.name in keep])

    def _project_reorder(self, rel: Relation, op: Operator) -> Relation:
        first = list(dict.fromkeys(self._known(rel, n, op) for n in op.names))
        return self._only(rel, first + [c for c in rel.columns if c not in first])

    def _project_rename(self, rel: Relation, op: Operator) -> Relation:
        new = {self._known(rel, i.expr.name, i).name: i.name for i in op.items}
        names = [new.get(c.name, c.name) for c in rel.columns]
        if len(set(names)) < len(names):
            raise self.fail("project-rename makes a duplicate column", op)
        return Relation(rel.df.select(*[c.column().alias(n) for c, n in zip(rel.columns, names, strict=True)]), tuple(ColumnInfo(n, c.type) for c, n in zip(rel.columns, names, strict=True)))

    def _distinct(self, rel: Relation, op: Operator) -> Relation:
        return self._only(rel, [self._known(rel, n, op) for n in op.names]).with_df(rel.df.select(*[self._known(rel, n, op).column() for n in op.names]).distinct())

    def _count(self, rel: Relation, op: Operator) -> Relation:
        return Relation(rel.df.agg(F.count(F.lit(1)).alias("Count")), (ColumnInfo("Count", LONG),))

    # -- groups
    def _summarize(self, rel: Relation, op: Operator) -> Relation:
        self._limit_items(op)
        keys = self._named(rel, op.by)
        # keys are computed below the aggregation, so their names stay apart from input columns
        inputs = rel.df.select("*", *[v.column.alias(f"__key_{i}") for i, (_, v) in enumerate(keys)]) if keys else rel.df
        used = {n for n, _ in keys}
        made: list[tuple[str, Value]] = []
        parts: list[tuple[str, Column]] = []
        for n, i in enumerate(op.items, 1):
            v = self._aggregate(rel, i.expr, parts)
            name = i.name or aggregate_name(i.expr) or f"Column{n}"
            if name in used:
                if i.name:
                    raise self.fail(f"duplicate column {name}", i)
                base, k = name, 1
                while name in used:
                    name, k = f"{base}{k}", k + 1
            used.add(name)
            made.append((name, v))
        by = [f"__key_{i}" for i in range(len(keys))]
        aggregated = self._parts(inputs, by, parts) if parts else inputs.select(*by).distinct() if by else inputs.agg(F.lit(0).alias("__none"))
        columns = [F.col(f"__key_{i}").alias(n) for i, (n, _) in enumerate(keys)] + [v.column.alias(n) for n, v in made]
        return Relation(aggregated.select(*columns), tuple(ColumnInfo(n, v.type) for n, v in keys + made))

    @staticmethod
    def _parts(inputs: DataFrame, by: list[str], parts: list[tuple[str, Column]]) -> DataFrame:
        """A row a group: its keys and each aggregate as __part_i; collections are made apart and meet the others by key."""
        plain = [(f"__part_{i}", c) for i, (n, c) in enumerate(parts) if n not in COLLECTIONS]
        kept = [(f"__part_{i}", n, c) for i, (n, c) in enumerate(parts) if n in COLLECTIONS]
        # without any plain aggregate, a count makes the groups
        out = inputs.groupBy(*by).agg(*[c.alias(n) for n, c in plain or [("__rows", F.count(F.lit(1)))]])
        if not kept:
            return out
        both = out
        for name, function, column in kept:
            held = inputs.select(*by, column.alias("__value"))
            both = both.unionByName(collect(held, by, "__value", COLLECTIONS[function]).withColumnRenamed("collected", name), allowMissingColumns=True)
        # one row of each group comes from each frame at most
        one = [F.first(n, ignorenulls=True).alias(n) for n in out.columns if n not in by]
        return both.groupBy(*by).agg(*one, *[F.coalesce(F.first(n, ignorenulls=True), F.lit("[]")).alias(n) for n, _, _ in kept])

    def _aggregate(self, rel: Relation, e: Node, parts: list[tuple[str, Column]]) -> Value:
        """A value over the groups' row; the aggregates it is made of are added to ``parts``."""
        if isinstance(e, Call) and e.name in AGGREGATES:
            low, high, _, lower = AGGREGATES[e.name]
            if not low <= len(e.args) <= high:
                raise self.fail(f"{e.name}() takes {low} argument{'s' * (low != 1)}", e)
            v = lower([self.binder(rel).bind(a) for a in e.args])
            parts.append((e.name, v.column))
            return Value(F.col(f"__part_{len(parts) - 1}"), v.type)
        binder = self.binder(rel)
        if isinstance(e, Literal):
            return binder.bind(e)
        if isinstance(e, Binary) and e.op in ("+", "-", "*", "/", "%"):
            return binder._arithmetic(e.op, self._aggregate(rel, e.left, parts), self._aggregate(rel, e.right, parts), e)
        if isinstance(e, Unary) and e.op == "-":
            return binder._arithmetic("-", values.literal(0, LONG), self._aggregate(rel, e.arg, parts), e)
        if isinstance(e, Call) and e.name in ("toint", "tolong", "toreal", "todouble", "tostring", "array_length", "iff", "coalesce"):
            from trailspark.functions.scalar import FUNCTIONS, Context

            return FUNCTIONS[e.name][2](Context(self.now, lambda m: self.fail(m, e)), [self._aggregate(rel, a, parts) for a in e.args])
        raise self.fail("summarize takes aggregates", e)

    # -- arrays
    def _expanded(self, rel: Relation, op: Operator) -> tuple[Relation, str]:
        self.expansions += 1
        if self.expansions > MAX_EXPANSIONS:
            raise self.fail("a query supports one array expansion", op)
        item = op.items[0]
        v = self.binder(rel).bind(item.expr)
        if v.type not in (DYNAMIC, STRING):
            raise self.fail("only a dynamic array can be expanded", op)
        name = item.name or default_name(item.expr)
        if not name:
            raise self.fail("an expanded expression needs a name", op)
        body = v.column
        # only arrays expand: objects, scalars, null and malformed text give no rows
        whole = F.when(F.json_array_length(body).isNotNull(), body)
        elements = F.transform(F.from_json(whole, "array<variant>"), lambda x: F.to_json(x))
        if "limit" in op.options:
            n = Binder(None, self.scalars, self.now).bind(op.options["limit"])
            if not n.constant or n.type != LONG or n.const < 0:
                raise self.fail("limit takes a whole number", op)
            elements = F.slice(elements, 1, int(n.const)) if n.const else F.filter(elements, lambda x: F.lit(False))
        df = rel.df.select("*", F.posexplode(elements).alias("__index", "__element"))
        element: Value = Value(F.when(F.col("__element") != "null", F.col("__element")), DYNAMIC)
        if kind := op.options.get("type"):
            if kind not in values.ALIASES:
                raise self.fail(f"unknown type {kind}", op)
            element = values.convert(element, values.ALIASES[kind])
        out = [(c.name, Value(c.column(), c.type)) for c in rel.columns if c.name != name]
        position = next((i for i, c in enumerate(rel.columns) if c.name == name), len(out))
        out.insert(position, (name, element))
        if index := op.options.get("index"):
            if index in [n for n, _ in out]:
                raise self.fail(f"duplicate column {index}", op)
            out.append((index, Value(F.col("__index").cast("bigint"), LONG)))
        return Relation(df.select(*[x.column.alias(n) for n, x in out]), tuple(ColumnInfo(n, x.type) for n, x in out)), name

    def _mv_expand(self, rel: Relation, op: Operator) -> Relation:
        return self._expanded(rel, op)[0]

    def _mv_apply(self, rel: Relation, op: Operator) -> Relation:
        out, _ = self._expanded(rel, op)
        for inner in op.options["inner"]:
            out = self.operator(out, inner)
        return out

    # -- several relations
    def _union(self, rel: Relation, op: Operator) -> Relation:
        for p in op.pipelines:
            other = self.pipeline(p)
            if len(other.columns) != len(rel.columns):
                raise self.fail("union inputs need the same columns in the same order", op)
            left, right, columns = [], [], []
            for a, b in zip(rel.columns, other.columns, strict=True):
                (x, y), t = ([a.column(), b.column()], a.type) if a.type == b.type else values.common([Value(a.column(), a.type), Value(b.column(), b.type)])
                left.append(x.alias(a.name))
                right.append(y.alias(a.name))
                columns.append(ColumnInfo(a.name, t))
            rel = Relation(rel.df.select(*left).union(other.df.select(*right)), tuple(columns))
        return rel

    def _join(self, rel: Relation, op: Operator) -> Relation:
        return join(rel, self.pipeline(op.pipelines[0]), op, self.fail)

    def _lookup(self, rel: Relation, op: Operator) -> Relation:
        return join(rel, self.pipeline(op.pipelines[0]), op, self.fail)


def default_name(e: Node) -> str | None:
    """The name an unnamed expression gets."""
    if isinstance(e, Name):
        return e.name
    if isinstance(e, Member) and isinstance(e.key, str):
        base = default_name(e.base)
        return f"{base}_{e.key}" if base else e.key
    if isinstance(e, Call) and e.args and e.name in ("tostring", "tolong", "toint", "toreal", "todouble", "todatetime", "tolower", "toupper"):
        return default_name(e.args[0])
    return None


def aggregate_name(e: Node) -> str | None:
    if not isinstance(e, Call) or e.name not in AGGREGATES:
        return None
    prefix = AGGREGATES[e.name][2]
    if e.args and e.name not in ("countif", "sumif"):
        return prefix + (default_name(e.args[0]) or "")
    return prefix


def boolean_columns(rel: Relation) -> set[str]:
    return {c.name for c in rel.columns if c.type == BOOL}


def frame(rel: Relation) -> DataFrame:
    return rel.df.select(*[c.column() for c in rel.columns])
