"""A relation while a pipeline is lowered: a frame and its typed columns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    type: str

    def column(self) -> Column:
        return F.col("`" + self.name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    columns: tuple[ColumnInfo, ...]
    #: Column that holds the whole record, for search.
    raw: str | None = None
    #: Physical text column of a dotted path, where one is kept.
    indexes: dict[str, str] | None = None

    def find(self, name: str) -> ColumnInfo | None:
        """A column by name; another case is found where it is the only one."""
        for c in self.columns:
            if c.name == name:
                return c
        same = [c for c in self.columns if c.name.lower() == name.lower()]
        return same[0] if len(same) == 1 else None

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def with_df(self, df: DataFrame) -> Relation:
        return replace(self, df=df)
