"""Compile, validate and run queries."""

from __future__ import annotations

import datetime as dt
import json
import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from trailspark.functions.aggregates import AGGREGATES
from trailspark.functions.scalar import FUNCTIONS
from trailspark.functions.values import DATETIME, DYNAMIC
from trailspark.operators.pipeline import Lowering, frame
from trailspark.operators.relation import Relation
from trailspark.plans.errors import QueryError
from trailspark.plans.parser import OPERATORS, parse
from trailspark.sources.catalog import Catalog, typed

MAX_ROWS = 1000
DEADLINE_S = 5.0


@dataclass
class Compiled:
    """A query as an uncapped frame and its typed columns."""

    relation: Relation

    @property
    def df(self) -> DataFrame:
        return frame(self.relation)

    @property
    def columns(self) -> list[str]:
        return self.relation.names

    @property
    def types(self) -> dict[str, str]:
        return {c.name: c.type for c in self.relation.columns}


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, now: dt.datetime | None = None):
        self.spark, self.catalog, self.now = spark, catalog or Catalog(), now

    def register(self, name: str, df: DataFrame, dynamic: set[str] | None = None) -> None:
        """A frame of fixed schema as a table."""
        self.catalog.add(name, typed(df, dynamic))

    def compile(self, query: str) -> Compiled:
        now = self.now or dt.datetime.now(dt.timezone.utc)
        relation = Lowering(self.catalog.find, now).script(parse(query))
        try:
            relation.df.schema  # noqa: B018  analysis happens here
        except PySparkException as e:
            raise QueryError(f"invalid column or expression: {str(e).splitlines()[0]}") from e
        return Compiled(relation)

    def validate(self, query: str) -> QueryError | None:
        """None, or what is wrong with a query; nothing runs."""
        try:
            self.compile(query)
        except QueryError as e:
            return e
        return None

    def query(self, query: str, deadline: float | None = DEADLINE_S) -> dict:
        """Rows of a query, at most MAX_ROWS, as the service returns them."""
        compiled = self.compile(query)
        began, tag = time.monotonic(), f"query-{uuid.uuid4().hex}"
        done, context = threading.Event(), self.spark.sparkContext

        def watch() -> None:
            # jobs that begin after the deadline are ended too
            wait = deadline
            while not done.wait(wait):
                context.cancelJobsWithTag(tag)
                wait = 0.2

        context.addJobTag(tag)
        try:
            if deadline:
                threading.Thread(target=watch, daemon=True).start()
            rows = compiled.df.limit(MAX_ROWS).collect()
        except Exception as e:
            if deadline and time.monotonic() - began >= deadline:
                raise TimeoutError(f"the query took more than {deadline:g} s") from e
            if isinstance(e, PySparkException):
                raise QueryError("query execution failed") from e
            raise
        finally:
            done.set()
            context.removeJobTag(tag)
        out = [{n: encode(v, compiled.types[n]) for n, v in zip(compiled.columns, r, strict=True)} for r in rows]
        return {"columns": compiled.columns, "rows": out, "rowCount": len(out), "durationMs": int((time.monotonic() - began) * 1000)}

    def schema(self) -> dict:
        """Tables with their columns, and what queries may use."""
        return {
            "tables": [{"name": n, "columns": [{"name": c.name, "type": c.type} for c in self.catalog.find(n).columns]} for n in self.catalog.names()],
            "operators": ["order by" if o == "order" else "sort by" if o == "sort" else o for o in OPERATORS],
            "functions": sorted([*FUNCTIONS, *AGGREGATES]),
        }


class Raw:
    """JSON text that is written as it stands."""

    def __init__(self, text: str):
        self.text = text


def encode(value: object, type_: str) -> object:
    """A cell for JSON output; dynamic text stays verbatim."""
    if value is None:
        return None
    if type_ == DATETIME:
        return value.strftime("%Y-%m-%dT%H:%M:%S.") + f"{value.microsecond:06d}000Z"
    if type_ == DYNAMIC:
        try:
            json.loads(value)
        except ValueError:
            return value
        return Raw(value)
    return value


def to_json(result: dict) -> str:
    """A result as JSON, with dynamic cells spliced in verbatim."""
    held: list[str] = []
    mark = uuid.uuid4().hex

    def default(x: object) -> str:
        if isinstance(x, Raw):
            held.append(x.text)
            return f"{mark}{len(held) - 1:09d}"
        raise TypeError(type(x))

    text = json.dumps(result, default=default, ensure_ascii=False)
    parts = text.split(f'"{mark}')
    return parts[0] + "".join(held[int(p[:9])] + p[10:] for p in parts[1:])
