"""Transforms of an ordered series, as window expressions, with unit tracking.

A series is a DataFrame with an order (and optionally a partition); NULL in, NULL out.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..domain import BEHAVIORS, UNIT_KINDS
from ..errors import require

MAX_CHAINED = 8
#: Per transform its result unit, and what it asks of its input.
TRANSFORMS: dict[str, dict[str, Any]] = {
    "percent_of_total": {"result": "percentage"},
    "percent_change": {"result": "percentage", "ordered": True},
    "percentage_point_change": {"result": "input_scale", "ordered": True, "kinds": ("percentage",)},
    "index_to_first": {"result": "ratio", "ordered": True},
    "cumulative": {"result": "preserve", "ordered": True, "behaviors": ("flow",)},
    "moving_average": {"result": "preserve", "ordered": True, "parameters": ("window",)},
    "exponential_moving_average": {"result": "preserve", "ordered": True, "parameters": ("alpha",)},
    "min_max": {"result": "ratio", "ordered": True},
    "z_score": {"result": "scalar", "ordered": True},
}
#: Transforms that fold a series instead of looking through a window.
FOLDED = ("exponential_moving_average",)
COUNTING = ("count", "count_distinct", "true_count", "false_count", "buckets", "age_buckets")
PRESERVING = ("sum", "avg", "min", "max")


def normalize_unit(unit: Any) -> dict[str, Any]:
    """A unit as {kind, ...}: a kind, or an object with one."""
    made = {"kind": unit} if isinstance(unit, str) else dict(unit) if isinstance(unit, dict) else {}
    require(made.get("kind") in UNIT_KINDS, "invalid_analytics", "no kind of unit has this name", unit=str(unit))
    if made["kind"] == "percentage":
        made.setdefault("scale", "whole")
    return made


def aggregate_unit(function: str, unit: Any) -> dict[str, Any]:
    """The unit of an aggregate of a column."""
    if function in COUNTING:
        return {"kind": "count"}
    if function == "true_percentage":
        return {"kind": "percentage", "scale": "whole"}
    require(function in PRESERVING, "invalid_analytics", "what this aggregate gives has no unit", aggregate=function)
    return normalize_unit(unit)


def allows(transform: str, unit: Any, behavior: str | None = None) -> bool:
    if transform not in TRANSFORMS:
        return False
    require(behavior is None or behavior in BEHAVIORS, "invalid_analytics", "no behavior has this name", behavior=behavior)
    rule = TRANSFORMS[transform]
    kind = normalize_unit(unit)["kind"]
    return kind in rule.get("kinds", (kind,)) and (behavior is None or behavior in rule.get("behaviors", (behavior,)))


def catalog(unit: Any, behavior: str | None = None) -> list[str]:
    """Transforms that accept a unit and behavior."""
    return [t for t in TRANSFORMS if allows(t, unit, behavior)]


def result_unit(transform: str, unit: Any, behavior: str | None = None) -> dict[str, Any]:
    require(allows(transform, unit, behavior), "invalid_analytics", "no transform of this name fits the unit and behavior", transform=transform)
    given = normalize_unit(unit)
    result = TRANSFORMS[transform]["result"]
    if result == "preserve":
        return given
    if result == "input_scale":
        return {"kind": "percentage", "scale": given["scale"]}
    return {"kind": "percentage", "scale": "whole"} if result == "percentage" else {"kind": result}


def _column(value: Column, transform: str, parameters: dict[str, Any], rows: Any, whole: Any) -> Column:
    """rows: the ordered window; whole: its partition without order."""
    if transform == "percent_of_total":
        return value / F.nullif(F.sum(value).over(whole), F.lit(0.0)) * 100
    if transform in ("percent_change", "percentage_point_change"):
        before = F.lag(value).over(rows)
        return value - before if transform == "percentage_point_change" else (value - before) / F.nullif(before, F.lit(0.0)) * 100
    if transform == "index_to_first":
        first = F.first(F.when(value != 0, value), ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return value / first * 100
    if transform == "cumulative":
        return F.when(value.isNotNull(), F.sum(value).over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    if transform == "moving_average":
        n = parameters.get("window")
        require(isinstance(n, int) and 2 <= n <= 365, "invalid_analytics", "window: 2 to 365 points")
        return F.when(value.isNotNull(), F.avg(value).over(rows.rowsBetween(-(n - 1), 0)))
    if transform == "min_max":
        low, high = F.min(value).over(whole), F.max(value).over(whole)
        return (value - low) / F.nullif(high - low, F.lit(0.0)) * 100
    if transform == "z_score":
        return (value - F.avg(value).over(whole)) / F.nullif(F.stddev_pop(value).over(whole), F.lit(0.0))
    raise AssertionError(transform)


def _exponential(frame: DataFrame, out: str, parameters: dict[str, Any], order_by: Sequence[str], partition_by: Sequence[str]) -> DataFrame:
    """The exponential average: each value depends on the one before, so a series is
    folded in one pass over its ordered values, as an Arrow table. Nulls are passed over."""
    alpha = parameters.get("alpha")
    require(isinstance(alpha, (int, float)) and 0 < alpha <= 1, "invalid_analytics", "alpha weighs the new value: above 0, 1 at most")

    def fold(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in order_by], null_placement="at_end"))
        folded, last = [], None
        for x in table.column(out).to_pylist():
            if x is not None:
                last = x if last is None else x * alpha + last * (1 - alpha)
            folded.append(None if x is None else last)
        return table.set_column(table.schema.get_field_index(out), out, pa.array(folded, pa.float64()))

    return frame.groupBy(*partition_by).applyInArrow(fold, frame.schema)


def transform(
    series: DataFrame,
    value: str,
    steps: Sequence[str | dict[str, Any]],
    *,
    order_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    unit: Any = "scalar",
    behavior: str | None = None,
    out: str = "transformed",
) -> tuple[DataFrame, dict[str, Any]]:
    """The series with ``out``, the value after all steps (names or {id, ...}), and the
    unit of the result."""
    require(len(steps) <= MAX_CHAINED, "invalid_analytics", "the chain of transforms is too long", maximum=MAX_CHAINED)
    whole = Window.partitionBy(*partition_by)
    rows = whole.orderBy(*[F.col(c).asc_nulls_last() for c in order_by])
    now = normalize_unit(unit)
    frame = series.withColumn(out, F.col(value).cast("double"))
    for step in steps:
        spec = {"id": step} if isinstance(step, str) else dict(step)
        name = spec.pop("id", None)
        require(name in TRANSFORMS, "invalid_analytics", "no transform of this name fits the unit and behavior", transform=str(name))
        rule = TRANSFORMS[name]
        require(set(spec) <= set(rule.get("parameters", ())), "invalid_analytics", "the transform reads no such parameter", transform=name)
        require(not rule.get("ordered") or order_by, "invalid_analytics", "the transform goes along an order, and none is given", transform=name)
        now = result_unit(name, now, behavior)
        if name in FOLDED:
            frame = _exponential(frame, out, spec, order_by, partition_by)
        else:
            frame = frame.withColumn(out, _column(F.col(out), name, spec, rows, whole))
    return frame, now
