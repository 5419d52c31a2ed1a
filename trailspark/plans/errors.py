"""Diagnostics with a position in the query."""

from __future__ import annotations


class QueryError(ValueError):
    """A query that cannot be compiled; line and column count from 1."""

    def __init__(self, message: str, line: int = 1, column: int = 1):
        super().__init__(message)
        self.message, self.line, self.column = message, line, column

    def to_dict(self) -> dict:
        return {"message": self.message, "line": self.line, "column": self.column}
