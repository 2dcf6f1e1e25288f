"""Grouping: plain, rollup, cube and grouping sets, by one aggregation each."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import expr as E
from ..errors import require
from ..functions import buckets
from .values import Typed

if TYPE_CHECKING:
    from .lower import Lowering


def group(low: Lowering, outputs: list[E.Node]) -> None:
    """Replace the lowering's frame by its groups and bind group keys, aggregates and
    grouping masks.

    An empty grouping set must give its grand total even over no rows, which Spark's
    grouping sets don't. So one row of NULLs that no aggregate counts joins the input,
    and the groups that consist of it alone are dropped again, all in the same pass."""
    q = low.query
    keys = list(dict.fromkeys(g.bare for g in q.groups))
    found = list(dict.fromkeys(n for o in outputs for n in _aggregates(o)))
    typed_keys = [low.values.typed(k) for k in keys]
    arguments: list[Column] = []
    plans = []
    for node in found:
        argument = _argument(low, node)
        name = None
        if argument is not None:
            name = f"v{len(arguments)}"
            arguments.append(argument.col.alias(name))
        plans.append((node, name, argument))
    source = low.frame.select(*[t.col.alias(f"g{i}") for i, t in enumerate(typed_keys)], *arguments)
    sets = q.grouping_positions() if q.mode != "plain" else []
    totals = () in sets
    real = F.lit(1)
    if totals:
        nothing = low.engine.spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in source.schema.fields], F.lit(False).alias("_real"))
        source = source.withColumn("_real", F.lit(True)).unionByName(nothing)
        real = F.when(F.col("_real"), 1)
    made = [_aggregate(node, name, real).alias(f"a{j}") for j, (node, name, _) in enumerate(plans)]
    names = [f"g{i}" for i in range(len(keys))]
    if q.mode == "plain":
        low.frame = source.select(*names).distinct() if not made else source.groupBy(*names).agg(*made) if names else source.agg(*made)
    else:
        # the position of a key in q.groups, not in the distinct keys, is what sets name
        place = [keys.index(g.bare) for g in q.groups]
        chosen = [[names[place[i]] for i in s] for s in sets]
        extra = [F.grouping(n).alias(f"{n}_up") for n in names]
        if totals:
            extra += [F.count(real).alias("_n")]
        low.frame = source.groupingSets(chosen, *names).agg(*made, *extra)
        if totals:
            all_up = F.lit(True)
            for n in names:
                all_up = all_up & (F.col(f"{n}_up") == 1)
            low.frame = low.frame.where(all_up | (F.col("_n") > 0))
    low.bound = {}
    for i, (k, t) in enumerate(zip(keys, typed_keys)):
        low.bound[k] = Typed(F.col(f"g{i}"), t.kind, t.items, t.storage)
    for j, (node, _, argument) in enumerate(plans):
        column = F.col(f"a{j}")
        if node.kind == "dimension_display" and q.mode != "plain":
            key = node.args[1].bare
            require(key in keys, "invalid_query", "group_by: lacks the key of a dimension that is shown")
            column = F.when(F.col(f"g{keys.index(key)}_up") == 0, column)
        low.bound[node] = Typed(column, _kind(node, argument))
    for o in outputs:
        for n in E.walk(o):
            if n.kind == "grouping":
                low.bound[n.bare] = Typed(_mask(n, keys, q.mode), "integer")
    low.grouped = True


def _aggregates(node: E.Node) -> list[E.Node]:
    if node.kind in E.AGGREGATES:
        return [node.bare]
    return [a for c in E.children(node) for a in _aggregates(c)]


def _mask(node: E.Node, keys: list[E.Node], mode: str) -> Column:
    """GROUPING(f1, ..., fn): bit n - 1 for f1, ..., bit 0 for fn."""
    total = F.lit(0).cast("long")
    for i, f in enumerate(node.args):
        require(f.bare in keys, "invalid_query", "grouping marks fields that rows are grouped by")
        if mode != "plain":
            total = total + F.shiftleft(F.col(f"g{keys.index(f.bare)}_up").cast("long"), len(node.args) - 1 - i)
    return total


def _argument(low: Lowering, node: E.Node) -> Typed | None:
    if node.kind == "count":
        return None
    x = low.values.typed(node.args[0])
    if node.kind == "count_bucket":
        _, low_, high, mode, today = node.args
        return Typed(F.when(buckets.count_bucket(x.col, low_, high, mode, today or low.engine.today), 1), "integer")
    if node.kind == "sum_zero":
        return Typed(F.coalesce(x.col, F.lit(0)), x.kind)
    return x


def _aggregate(node: E.Node, name: str | None, real: Column) -> Column:
    x = F.col(name) if name else None
    kind = node.kind
    if kind == "count":
        return F.count(real)
    if kind in ("count_field", "count_bucket"):
        return F.count(x)
    if kind == "count_distinct":
        return F.count_distinct(x)
    if kind in ("sum", "sum_zero"):
        return F.sum(x)
    if kind == "avg":
        return F.avg(x)
    if kind in ("min", "dimension_display"):
        return F.min(x)
    if kind == "max":
        return F.max(x)
    if kind == "true_count":
        return F.count(F.when(x, 1))
    if kind == "false_count":
        return F.count(F.when(~x, 1))
    return F.lit(100.0) * F.count(F.when(x, 1)) / F.nullif(F.count(x), F.lit(0))


def _kind(node: E.Node, argument: Typed | None) -> str:
    if node.kind in ("count", "count_field", "count_distinct", "count_bucket", "true_count", "false_count"):
        return "integer"
    if node.kind == "true_percentage":
        return "double"
    if node.kind == "avg":
        return "double" if argument and argument.kind != "decimal" else "decimal"
    return argument.kind if argument else "integer"
