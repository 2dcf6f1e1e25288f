"""Window nodes to Spark window expressions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .. import expr as E
from ..errors import require
from .values import Typed, Values


def ordered(column: Column, direction: str) -> Column:
    """NULLs are the largest values: last ascending, first descending."""
    return column.asc_nulls_last() if direction == "asc" else column.desc_nulls_first()


def _bound(bound: Any, start: bool) -> int:
    if bound == "current_row":
        return 0
    if bound == "unbounded_preceding":
        require(start, "invalid_query", "frame: no row stands before the first")
        return Window.unboundedPreceding
    if bound == "unbounded_following":
        require(not start, "invalid_query", "frame: no row stands after the last")
        return Window.unboundedFollowing
    require(isinstance(bound, dict) and len(bound) == 1, "invalid_query", "frame: no such bound")
    (side, n), = bound.items()
    require(side in ("preceding", "following") and isinstance(n, int) and not isinstance(n, bool) and n >= 0, "invalid_query", "frame: an offset is a whole number from 0")
    return -n if side == "preceding" else n


def frame_of(frame: E.Frozen | None) -> tuple[str, int, int] | None:
    if frame is None:
        return None
    spec = frame.value
    unit = spec.get("unit", spec.get("type", "rows"))
    require(unit in ("rows", "range", "groups"), "invalid_query", "frame: rows, range or groups")
    start, end = _bound(spec.get("start"), True), _bound(spec.get("end", "current_row"), False)
    require(start <= end, "invalid_query", "frame: its end stands before its start")
    return unit, start, end


def add_windows(df: DataFrame, nodes: list[E.Node], values: Values) -> tuple[DataFrame, dict[E.Node, tuple[str, str]]]:
    """The frame with a column for each window node: {node: (column, type)}."""
    made: dict[E.Node, tuple[str, str]] = {}
    for node in nodes:
        name, arguments, partition, orders, frame = node.args
        spec = Window.partitionBy(*[values.column(p) for p in partition])
        keys = [ordered(values.column(o), d) for o, d in orders]
        spec = spec.orderBy(*keys) if keys else spec
        shape = frame_of(frame)
        column = f"w{len(made)}"
        if shape is not None:
            unit, start, end = shape
            if unit == "rows":
                spec = (spec if keys else spec.orderBy(F.lit(1))).rowsBetween(start, end)
            elif unit == "range":
                offsets = any(b not in (0, Window.unboundedPreceding, Window.unboundedFollowing) for b in (start, end))
                require(not offsets or len(orders) == 1, "invalid_query", "frame: a range counts along one order key")
                spec = spec.rangeBetween(start, end)
            else:  # peer groups are numbered first, then framed as a range of numbers
                require(keys, "invalid_query", "frame: groups are told by an order")
                df = df.withColumn(f"{column}_peer", F.dense_rank().over(spec))
                spec = Window.partitionBy(*[values.column(p) for p in partition]).orderBy(f"{column}_peer").rangeBetween(start, end)
        typed = _function(name, arguments, values, spec, bool(keys))
        df = df.withColumn(column, typed.col)
        made[node.bare] = (column, typed.kind)
    return df, made


def _number(node: E.Node, label: str) -> int:
    require(node.kind == "literal" and isinstance(node.args[0], int) and not isinstance(node.args[0], bool), "invalid_query", f"{label}: a whole number")
    return node.args[0]


def _function(name: str, arguments: tuple[E.Node, ...], values: Values, spec: WindowSpec, sorted_: bool) -> Typed:
    if name in ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist"):
        over = spec if sorted_ else spec.orderBy(F.lit(1))
        kind = "double" if name in ("percent_rank", "cume_dist") else "integer"
        column = getattr(F, name)().over(over)
        return Typed(column if kind == "double" else column.cast("long"), kind)
    if name == "ntile":
        n = _number(arguments[0], "ntile")
        require(n > 0, "invalid_query", "ntile: 1 part at least")
        return Typed(F.ntile(n).over(spec if sorted_ else spec.orderBy(F.lit(1))).cast("long"), "integer")
    if name == "count" and not arguments:
        return Typed(F.count(F.lit(1)).over(spec), "integer")
    x = values.typed(arguments[0])
    if name in ("lag", "lead"):
        offset = _number(arguments[1], name) if len(arguments) > 1 else 1
        default = arguments[2].args[0] if len(arguments) > 2 else None
        return Typed(getattr(F, name)(x.col, offset, default).over(spec if sorted_ else spec.orderBy(F.lit(1))), x.kind)
    if name == "nth_value":
        n = _number(arguments[1], "nth_value")
        require(n > 0, "invalid_query", "nth_value: counts from 1")
        return Typed(F.nth_value(x.col, n).over(spec), x.kind)
    column = getattr(F, name)(x.col).over(spec)
    return Typed(column, "integer" if name == "count" else "decimal" if name == "avg" else x.kind)
