"""Expression nodes to Spark columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import expr as E
from ..errors import SelectError, require
from ..functions import buckets, dates, shortcuts, text
from ..limits import Limits
from ..types import FLOATS, INSTANTS, WALL_TIMES, category, spark_type


@dataclass(frozen=True)
class Typed:
    """A column with its declared type."""

    col: Column
    kind: str
    items: str | None = None
    storage: str | None = None


#: Resolves a field path, or a node that was computed before; None if it is neither.
Lookup = Callable[[Any], Typed]


def lit_for(value: Any, kind: str) -> Column:
    """A literal to compare with a column of a declared type. Strings keep their
    identity unless the type is temporal; decimals keep their own scale."""
    if value is None:
        return F.lit(None)
    group = category(kind)
    if group == "boolean" and not isinstance(value, bool):
        require(value in (0, 1, "0", "1", "true", "false"), "invalid_query", "expected a truth value", value=str(value))
        return F.lit(value in (1, "1", "true"))
    if kind == "date" and isinstance(value, str) and len(value) <= 10:
        return F.lit(value).cast("date")
    if kind in WALL_TIMES and isinstance(value, (str, dt.date)):
        return F.lit(value).cast("timestamp_ntz")
    if kind in INSTANTS and isinstance(value, (str, dt.date)):
        return F.lit(value).cast("timestamp")
    if group == "decimal" and kind.lower() not in FLOATS and isinstance(value, (int, float, Decimal, str)) and not isinstance(value, bool):
        return exact(value)
    if kind.lower() in FLOATS and isinstance(value, Decimal):
        return F.lit(float(value))
    if isinstance(value, Decimal):
        return exact(value)
    return F.lit(value)


def exact(value: Any) -> Column:
    """A number as DECIMAL of its own precision and scale, at most 38 digits."""
    try:
        number = Decimal(str(value))
    except ArithmeticError:
        return F.lit(value)
    sign, digits, exponent = number.as_tuple()
    require(isinstance(exponent, int), "invalid_query", "expected a finite number")
    scale = max(0, -exponent)
    precision = max(len(digits) + max(0, exponent), scale, 1)
    require(precision <= 38, "unsupported_precision", "a number of more than 38 digits")
    return F.lit(format(number, "f")).cast(f"decimal({precision},{scale})")


class Values:
    """Compiles nodes within a scope."""

    def __init__(self, lookup: Lookup, limits: Limits, timezone: str | None = None, today: str | None = None):
        self.lookup, self.limits, self.timezone, self.today = lookup, limits, timezone, today

    def column(self, node: E.Node) -> Column:
        return self.typed(node).col

    def typed(self, node: E.Node) -> Typed:
        bound = self.lookup(node.bare)
        if bound is not None:
            return bound
        method = getattr(self, f"_{node.kind}", None)
        if node.kind in E.COMPARE:
            return self._compare(node)
        if node.kind in E.TEXT:
            return self._text(node)
        if node.kind in E.ARRAYS:
            return self._array(node)
        require(method is not None, "invalid_query", f"{node.kind} has no value here")
        return method(*node.args)

    # -- leaves ----------------------------------------------------------------

    def _field(self, path: str) -> Typed:
        raise SelectError("invalid_query", "group_by: lacks a field that is shown", {"field": path})

    def _literal(self, value: Any) -> Typed:
        kind = "boolean" if isinstance(value, bool) else "integer" if isinstance(value, int) else "double" if isinstance(value, float) else "decimal" if isinstance(value, Decimal) else "string"
        return Typed(exact(value) if isinstance(value, Decimal) else F.lit(value), kind)

    # -- predicates --------------------------------------------------------------

    def _pair(self, left: E.Node, right: E.Node) -> tuple[Column, Column]:
        a = self.typed(left)
        b = lit_for(right.args[0], a.kind) if right.kind == "literal" else self.column(right)
        return a.col, b

    def _compare(self, node: E.Node) -> Typed:
        a, b = self._pair(*node.args)
        made = {"eq": a.__eq__, "ne": a.__ne__, "gt": a.__gt__, "gte": a.__ge__, "lt": a.__lt__, "lte": a.__le__}[node.kind](b)
        return Typed(made, "boolean")

    def _between(self, a: E.Node, low: E.Node, high: E.Node) -> Typed:
        x, lo = self._pair(a, low)
        return Typed((x >= lo) & (x <= self._pair(a, high)[1]), "boolean")

    def _in(self, a: E.Node, values: tuple[Any, ...]) -> Typed:
        x = self.typed(a)
        return Typed(x.col.isin(*[lit_for(v, x.kind) for v in values]), "boolean")

    def _is_null(self, a: E.Node) -> Typed:
        return Typed(self.column(a).isNull(), "boolean")

    def _not_null(self, a: E.Node) -> Typed:
        return Typed(self.column(a).isNotNull(), "boolean")

    def _all(self, *nodes: E.Node) -> Typed:
        return Typed(reduce(lambda a, b: a & b, map(self.column, nodes)), "boolean")

    def _any(self, *nodes: E.Node) -> Typed:
        return Typed(reduce(lambda a, b: a | b, map(self.column, nodes)), "boolean")

    def _not(self, node: E.Node) -> Typed:
        return Typed(~self.column(node), "boolean")

    def _text(self, node: E.Node) -> Typed:
        x, wanted = self.column(node.args[0]), F.lit(node.args[1])
        if node.kind.endswith("_ci"):
            x, wanted = F.lower(x), F.lower(wanted)
        op = node.kind.removesuffix("_ci")
        made = x.startswith(wanted) if op == "starts_with" else x.endswith(wanted) if op == "ends_with" else x.contains(wanted)
        return Typed(made, "boolean")

    def _array(self, node: E.Node) -> Typed:
        x = self.typed(node.args[0])
        require(x.kind == "array", "invalid_query", f"{node.kind} looks into arrays")
        return Typed(text.array_predicate(node.kind, x.col, node.args[1], spark_type(x.items or "string").simpleString()), "boolean")

    def _json_contains(self, a: E.Node, document: E.Frozen | None) -> Typed:
        x = self.typed(a)
        require(category(x.kind) == "json", "invalid_query", "json_contains looks into JSON")
        return Typed(text.json_contains(x.col, document.value if document else None), "boolean")

    def _structured_compare(self, a: E.Node, op: str, value: E.Frozen) -> Typed:
        x = self.typed(a)
        wanted = value.value if value else None
        if x.kind == "array":
            kind = spark_type(x.items or "string").simpleString()
            same = lambda v: x.col == text.array_literal(tuple(v), kind)
        else:
            require(category(x.kind) == "json", "invalid_query", "structured values are JSON or arrays")
            same = lambda v: text.json_equal(x.col, v)
        hit = reduce(lambda p, q: p | q, map(same, wanted)) if op in ("in", "not_in") else same(wanted)
        return Typed(~hit if op in ("neq", "not_in") else hit, "boolean")

    def _date_shortcut(self, a: E.Node, shortcut: str, today: str | None) -> Typed:
        x = self.typed(a)
        require(x.kind in ("date", "epoch_datetime") or category(x.kind) == "datetime", "invalid_query", "date shortcuts apply to dates and times")
        value = dates.read_instant(x.col, x.kind, x.storage) if x.kind == "epoch_datetime" else x.col
        if self.timezone and x.kind in (*INSTANTS, "epoch_datetime"):
            value = dates.shown_in_zone(x.col, x.kind, x.storage, self.timezone)
        return Typed(shortcuts.predicate(value, shortcut, today or self.today), "boolean")

    def _text_search(self, fields: tuple[E.Node, ...], query: str, mode: str, configuration: str) -> Typed:
        return Typed(text.matches([self.column(f) for f in fields], query, mode, configuration), "boolean")

    def _text_rank(self, fields: tuple[E.Node, ...], query: str, mode: str, configuration: str) -> Typed:
        return Typed(text.rank([self.column(f) for f in fields], query, configuration), "double")

    # -- scalars -----------------------------------------------------------------

    def _trim(self, a: E.Node) -> Typed:
        return Typed(F.trim(self.column(a)), "string")

    def _epoch_datetime(self, a: E.Node) -> Typed:
        x = self.typed(a)
        return Typed(dates.read_instant(x.col, "epoch_datetime"), "utc_datetime")

    def _datetime_format(self, a: E.Node, style: str, timezone: str | None) -> Typed:
        x = self.typed(a)
        require(x.kind in ("date", "epoch_datetime") or category(x.kind) == "datetime", "invalid_query", "date formats apply to dates and times")
        value = dates.read_instant(x.col, x.kind, x.storage) if x.kind in (*INSTANTS, "epoch_datetime") else x.col
        kind = "integer" if style.startswith("epoch_") else "string"
        return Typed(dates.format_datetime(value, style, x.kind, timezone or self.timezone), kind)

    def _bucket(self, a: E.Node, spec: E.Frozen, today: str | None) -> Typed:
        x = self.typed(a)
        return Typed(buckets.bucket(x.col, x.kind, spec.value, today or self.today, self.limits.get("max_bucket_ranges")), "string")

    def _value(self, ast: tuple[Any, ...]) -> Typed:
        kind = E.value_category(ast, self._kind_of)
        return Typed(self.value(ast), {"decimal": "decimal", "datetime": "utc_datetime"}.get(kind, kind))

    def _kind_of(self, path: Any) -> str | None:
        return self._path(path).kind

    def _path(self, path: Any) -> Typed:
        found = self.lookup(("previous", path[1]) if isinstance(path, tuple) else E.field(path))
        return found if found is not None else self._field(str(path))

    def value(self, ast: tuple[Any, ...]) -> Column:
        op, *args = ast
        if op == "field":
            return self._path(args[0]).col
        if op == "previous":
            return self._path(("previous", args[0])).col
        if op == "literal":
            value, kind = args
            if kind == "decimal":
                return exact(value)
            return F.lit(str(value) if kind != "boolean" else value).cast(spark_type(kind).simpleString())
        if op == "coalesce":
            return F.coalesce(*map(self.value, args))
        if op in ("add", "subtract", "multiply"):
            a, b = map(self.value, args)
            return a + b if op == "add" else a - b if op == "subtract" else a * b
        if op == "divide":
            a, b = (self.value(x).cast("double") for x in args)
            return a / F.nullif(b, F.lit(0.0))
        if op in ("lower", "upper"):
            return (F.lower if op == "lower" else F.upper)(self.value(args[0]))
        if op == "concat":
            return F.concat_ws("", *[self.value(x).cast("string") for x in args])
        if op == "days_between":
            return dates.days_between(*map(self.value, args))
        if op == "cast":
            return self.value(args[0]).cast(spark_type(args[1]).simpleString())
        if op == "json_text":
            return F.get_json_object(self._path(args[0]).col, text.json_path(args[1]))
        made: Column | None = None
        for condition, value in args:
            if condition == "else":
                return made.otherwise(self.value(value))
            test = self.column(condition)
            made = F.when(test, self.value(value)) if made is None else made.when(test, self.value(value))
        return made
