"""Writes Spark SQL expressions from Python.

Per-trace steps nest higher-order functions deeply.  Built from ``Column``
objects, such an expression costs thousands of calls between Python and the
JVM; written as SQL text it costs one.  ``X.name(...)`` writes the SQL function
``name``; a Python lambda among its arguments becomes a SQL lambda, and a plain
string argument names a column.
"""

from __future__ import annotations

import inspect
import itertools
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_fresh = itertools.count()


def _write(value: Any) -> str:
    """SQL text of an operand; strings are column names."""
    if isinstance(value, Text):
        return value.sql
    if isinstance(value, str):
        return value
    return _literal(value)


def _literal(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        if value in (float("inf"), float("-inf")):
            return f"double('{value}')"
        return f"{value!r}D"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _operand(value: Any) -> str:
    return value.sql if isinstance(value, Text) else _literal(value)


class Text:
    """One SQL expression."""

    def __init__(self, sql: str, name: str | None = None) -> None:
        self._sql, self._name = sql, name

    @property
    def sql(self) -> str:
        return self._sql

    def column(self) -> Column:
        return F.expr(self.sql)

    def _binary(self, op: str, other: Any, swap: bool = False) -> Text:
        left, right = self.sql, _operand(other)
        return Text(f"({right} {op} {left})" if swap else f"({left} {op} {right})")

    def __add__(self, o: Any) -> Text: return self._binary("+", o)
    def __radd__(self, o: Any) -> Text: return self._binary("+", o, True)
    def __sub__(self, o: Any) -> Text: return self._binary("-", o)
    def __rsub__(self, o: Any) -> Text: return self._binary("-", o, True)
    def __mul__(self, o: Any) -> Text: return self._binary("*", o)
    def __rmul__(self, o: Any) -> Text: return self._binary("*", o, True)
    def __truediv__(self, o: Any) -> Text: return self._binary("/", o)
    def __rtruediv__(self, o: Any) -> Text: return self._binary("/", o, True)
    def __mod__(self, o: Any) -> Text: return self._binary("%", o)
    def __lt__(self, o: Any) -> Text: return self._binary("<", o)
    def __le__(self, o: Any) -> Text: return self._binary("<=", o)
    def __gt__(self, o: Any) -> Text: return self._binary(">", o)
    def __ge__(self, o: Any) -> Text: return self._binary(">=", o)
    def __eq__(self, o: Any) -> Text: return self._binary("=", o)  # type: ignore[override]
    def __ne__(self, o: Any) -> Text: return self._binary("<>", o)  # type: ignore[override]
    def __and__(self, o: Any) -> Text: return self._binary("AND", o)
    def __or__(self, o: Any) -> Text: return self._binary("OR", o)
    def __invert__(self) -> Text: return Text(f"(NOT {self.sql})")
    def __neg__(self) -> Text: return Text(f"(- {self.sql})")
    __hash__ = None  # type: ignore[assignment]

    def __getattr__(self, field: str) -> Text:
        if field.startswith("__"):
            raise AttributeError(field)
        return self[field]

    def __getitem__(self, field: str) -> Text:
        return Text(f"{self.sql}.{field}")

    def is_null(self) -> Text: return Text(f"({self.sql} IS NULL)")
    def is_set(self) -> Text: return Text(f"({self.sql} IS NOT NULL)")
    def cast(self, kind: str) -> Text: return Text(f"CAST({self.sql} AS {kind})")
    def alias(self, name: str) -> Text: return Text(self.sql, name)

    def between(self, lo: Any, hi: Any) -> Text:
        return Text(f"({self.sql} BETWEEN {_operand(lo)} AND {_operand(hi)})")


class Case(Text):
    """CASE WHEN in progress; usable as it stands (ELSE NULL)."""

    def __init__(self, branches: list[tuple[str, str]]) -> None:
        super().__init__("")
        self._branches = branches

    @property
    def sql(self) -> str:
        return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in self._branches) + " END"

    def when(self, condition: Text, value: Any) -> Case:
        return Case([*self._branches, (condition.sql, _operand(value))])

    def otherwise(self, value: Any) -> Text:
        return Text(self.sql[: -len("END")] + f"ELSE {_operand(value)} END")


class _Functions:
    """``X.name(args)`` writes ``name(args)``."""

    def col(self, name: str) -> Text: return Text(name)
    def lit(self, value: Any) -> Text: return Text(_literal(value))

    def when(self, condition: Text, value: Any) -> Case:
        return Case([(condition.sql, _operand(value))])

    def struct(self, *fields: Text) -> Text:
        return Text(
            "named_struct(" + ", ".join(f"'{f._name}', {f.sql}" for f in fields) + ")"
        )

    def __getattr__(self, name: str) -> Callable[..., Text]:
        def call(*args: Any) -> Text:
            return Text(f"{name}({', '.join(self._argument(a) for a in args)})")

        return call

    @staticmethod
    def _argument(value: Any) -> str:
        if callable(value) and not isinstance(value, Text):
            names = [f"_x{next(_fresh)}" for _ in inspect.signature(value).parameters]
            body = value(*[Text(n) for n in names])
            head = names[0] if len(names) == 1 else f"({', '.join(names)})"
            return f"{head} -> {_operand(body)}"
        return _write(value)


X = _Functions()


def _kept_whole(value: Text) -> Column:
    """A step's expression, guarded so the optimizer evaluates it once per row.

    Inlining would repeat a step wherever its result is used: in a filter pushed
    below it, or inside a lambda, once per element.  The partition id is always
    at least zero, but an expression that reads it is never copied.
    """
    sql = value.sql
    if "->" in sql:
        sql = f"CASE WHEN spark_partition_id() >= 0 THEN {sql} END"
    return F.expr(sql)


def put(df: DataFrame, columns: str | dict[str, Any], value: Any = None) -> DataFrame:
    """Add one named column, or a dict of them, given as SQL text or ``Column``.

    Filters on keys belong before the first step: none is pushed below it.
    """
    both = {columns: value} if isinstance(columns, str) else columns
    return df.withColumns(
        {n: _kept_whole(c) if isinstance(c, Text) else c for n, c in both.items()}
    )
