"""Build one SQL expression as text and hand it to Spark in one call.

A detector set is an expression of several thousand nodes.  Built from PySpark Columns,
every node costs several Python-JVM round trips, which adds up to tens of seconds of
driver time per query; as text it is parsed by Spark in one step.  ``fn`` mirrors the SQL
functions (``fn.concat(a, b)``), ``Sql`` the usual Column operators; ``.column()`` gives
the Column.  Python strings and numbers given as arguments are literals.
"""

from __future__ import annotations

import inspect
import itertools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_names = itertools.count(1)


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    out = []
    for ch in text:
        code = ord(ch)
        if code < 32 or 126 < code <= 0xFFFF:
            out.append(f"\\u{code:04X}")
        elif code > 0xFFFF:
            out.append(f"\\U{code:08X}")
        else:
            out.append(ch)
    return "'" + "".join(out) + "'"


# Binding strength, used to write parentheses only where they are needed: the parser looks
# through a parenthesis to its end before it knows what it is, so nesting them is slow.
_OR, _AND, _NOT, _COMPARE, _SUM, _PRODUCT, _UNARY, _ATOM = range(8)


class Sql:
    """An SQL expression; immutable text with Column-like operators."""

    __slots__ = ("text", "strength")

    def __init__(self, text: str, strength: int = _ATOM) -> None:
        self.text = text
        self.strength = strength

    def __str__(self) -> str:
        return self.text

    def column(self) -> Column:
        return F.expr(self.text)

    def _at(self, strength: int) -> str:
        return self.text if self.strength >= strength else f"({self.text})"

    def _binary(self, op: str, other: object, strength: int) -> "Sql":
        right = sql(other)._at(strength + 1)
        return Sql(f"{self._at(strength)} {op} {right}", strength)

    def _compare(self, op: str, other: object) -> "Sql":
        left, right = self._at(_SUM), sql(other)._at(_SUM)
        return Sql(f"{left} {op} {right}", _COMPARE)

    def __add__(self, other): return self._binary("+", other, _SUM)
    def __radd__(self, other): return sql(other)._binary("+", self, _SUM)
    def __sub__(self, other): return self._binary("-", other, _SUM)
    def __rsub__(self, other): return sql(other)._binary("-", self, _SUM)
    def __mul__(self, other): return self._binary("*", other, _PRODUCT)
    def __truediv__(self, other): return self._binary("/", other, _PRODUCT)
    def __mod__(self, other): return self._binary("%", other, _PRODUCT)
    def __and__(self, other): return self._binary("AND", other, _AND)
    def __or__(self, other): return self._binary("OR", other, _OR)
    def __eq__(self, other): return self._compare("=", other)  # type: ignore[override]
    def __ne__(self, other): return self._compare("<>", other)  # type: ignore[override]
    def __lt__(self, other): return self._compare("<", other)
    def __le__(self, other): return self._compare("<=", other)
    def __gt__(self, other): return self._compare(">", other)
    def __ge__(self, other): return self._compare(">=", other)
    def __neg__(self): return Sql(f"- {self._at(_ATOM)}", _UNARY)
    def __invert__(self): return Sql(f"NOT {self._at(_COMPARE)}", _NOT)

    __hash__ = None  # type: ignore[assignment]

    def __getitem__(self, key: object) -> "Sql":
        if isinstance(key, str):
            return Sql(f"{self._at(_ATOM)}.`{key}`")
        return Sql(f"{self._at(_ATOM)}[{sql(key).text}]")

    def cast(self, kind: str) -> "Sql":
        return Sql(f"CAST({self.text} AS {kind})")

    def rlike(self, regex: str) -> "Sql":
        return Sql(f"rlike({self.text}, {_literal(regex)})")

    def isin(self, values: list) -> "Sql":
        if not values:
            return Sql("false")
        listed = ", ".join(_literal(v) for v in values)
        return Sql(f"{self._at(_SUM)} IN ({listed})", _COMPARE)

    def between(self, low: object, high: object) -> "Sql":
        return (self >= low) & (self <= high)

    def is_null(self) -> "Sql":
        return Sql(f"isnull({self.text})")

    def is_not_null(self) -> "Sql":
        return Sql(f"isnotnull({self.text})")


class Case(Sql):
    """``when(c, v).when(...).otherwise(...)``."""

    __slots__ = ("branches",)

    def __init__(self, branches: list[tuple[str, str]], default: str | None = None):
        self.branches = branches
        arms = " ".join(f"WHEN {c} THEN {v}" for c, v in branches)
        tail = "" if default is None else f" ELSE {default}"
        super().__init__(f"CASE {arms}{tail} END")

    def when(self, condition: Sql, value: object) -> "Case":
        return Case([*self.branches, (condition.text, sql(value).text)])

    def otherwise(self, value: object) -> "Case":
        return Case(self.branches, sql(value).text)


def sql(value: object) -> Sql:
    return value if isinstance(value, Sql) else Sql(_literal(value))


def lit(value: object) -> Sql:
    return Sql(_literal(value))


def col(name: str) -> Sql:
    """A column, possibly a field path such as ``content.text``."""
    return Sql(".".join(f"`{part}`" for part in name.split(".")))


def named(value: "Sql | str") -> Sql:
    """Operator arguments: a column name or an expression."""
    return col(value) if isinstance(value, str) else value


def when(condition: Sql, value: object) -> Case:
    return Case([(condition.text, sql(value).text)])


def struct(**fields: object) -> Sql:
    inside = ", ".join(f"{_literal(k)}, {sql(v).text}" for k, v in fields.items())
    return Sql(f"named_struct({inside})")


def function(body: Callable[..., Sql]) -> str:
    """A Python lambda as SQL lambda text with fresh variable names."""
    count = len(inspect.signature(body).parameters)
    variables = [f"v{next(_names)}" for _ in range(count)]
    result = sql(body(*[Sql(v) for v in variables]))
    heads = variables[0] if count == 1 else f"({', '.join(variables)})"
    return f"{heads} -> {result.text}"


class _Functions:
    """``fn.name(args)`` is ``name(args)``; callables become lambdas."""

    def __getattr__(self, name: str) -> Callable[..., Sql]:
        def call(*args: object) -> Sql:
            shown = [
                function(a) if callable(a) and not isinstance(a, Sql) else sql(a).text
                for a in args
            ]
            return Sql(f"{name}({', '.join(shown)})")

        return call


fn = _Functions()
