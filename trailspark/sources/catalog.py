"""Tables that queries can name: typed frames and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailspark.functions.values import BOOL, DATETIME, DYNAMIC, LONG, REAL, STRING
from trailspark.operators.relation import ColumnInfo, Relation


def kind_of(t: T.DataType) -> str:
    """The query type of a Spark type."""
    if isinstance(t, T.BooleanType):
        return BOOL
    if isinstance(t, T.IntegralType):
        return LONG
    if isinstance(t, (T.FractionalType, T.DecimalType)):
        return REAL
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return DYNAMIC
    return STRING


def typed(df: DataFrame, dynamic: set[str] | None = None) -> Relation:
    """A frame of fixed schema as a relation; dynamic: string columns that hold JSON."""
    columns, out = [], []
    for f in df.schema.fields:
        c, t = F.col("`" + f.name.replace("`", "``") + "`"), kind_of(f.dataType)
        if t == LONG and not isinstance(f.dataType, T.LongType):
            c = c.cast("bigint")
        elif t == REAL and not isinstance(f.dataType, T.DoubleType):
            c = c.cast("double")
        elif t == DATETIME and not isinstance(f.dataType, T.TimestampNTZType):
            c = c.cast("timestamp_ntz")
        elif t == DYNAMIC:
            c = F.to_json(c)
        elif isinstance(f.dataType, T.BinaryType):
            c = F.lit(None).cast("string")
        if t == STRING and f.name in (dynamic or ()):
            t = DYNAMIC
        out.append(c.alias(f.name))
        columns.append(ColumnInfo(f.name, t))
    return Relation(df.select(*out), tuple(columns))


class Catalog:
    """Named relations; names resolve without regard to case."""

    def __init__(self) -> None:
        self._tables: dict[str, tuple[str, Relation]] = {}

    def add(self, name: str, relation: Relation) -> None:
        self._tables[name.lower()] = (name, relation)

    def find(self, name: str) -> Relation | None:
        got = self._tables.get(name.lower())
        return got[1] if got else None

    def names(self) -> list[str]:
        return sorted((n for n, _ in self._tables.values()), key=str.lower)
