"""Related collections: child rows as arrays, sums and counts beside their parents."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import expr as E
from ..errors import require
from ..query import Query
from ..types import FLOATS, category
from .values import Typed, lit_for
from .windows import ordered

if TYPE_CHECKING:
    from .lower import Lowering


def add_related(low: Lowering, node: E.Node) -> None:
    """Join a related node's column to the root and bind it."""
    name = f"n{len(low.bound)}"
    if node.kind == "related_collection":
        column = _attach(low, node, name)
        empty = F.lit("[]")
        low.bound[node] = Typed(F.coalesce(F.to_json(column, {"ignoreNullFields": "false"}), empty), "json")
        return
    association, path = node.args
    child, key, keys = _child(low, association, [E.field(path)], {})
    value = child.values.typed(E.field(path))
    measured = child.frame.select(*[k.alias(f"{name}_k{i}") for i, k in enumerate((key, *keys))], value.col.alias(f"{name}_v"))
    total = F.sum(f"{name}_v") if node.kind == "related_sum" else F.count(f"{name}_v")
    sums = measured.groupBy(*[f"{name}_k{i}" for i in range(1 + len(keys))]).agg(total.alias(name))
    _join_to_parent(low, association, sums, name)
    low.bound[node] = Typed(F.coalesce(F.col(name), F.lit(0)), value.kind if node.kind == "related_sum" else "integer")


def _child(low: Lowering, association: str, nodes: list[E.Node], filters: dict[str, Any]) -> tuple[Lowering, Column, list[Column]]:
    """A lowering rooted at a direct association's target, with its frame built: the
    association's predicates and equality filters hold; and its key columns."""
    from .lower import Lowering

    require("." not in association, "invalid_query", "the association isn't one to-many step away")
    associations, relation = low.domain.association(association)
    a = associations[-1]
    child = Lowering(low.engine, low.domain.reroot(association), Query())
    held: dict[str, Column] = {}
    stored = child.stored

    def target(relation_, prefix: str) -> DataFrame:
        if prefix != "r_":
            return stored(relation_, prefix)
        child.stored = stored
        frame, key = child.target(a, relation, prefix)
        held["key"] = key
        return frame

    child.stored = target
    child.base([*nodes, *[E.field(f) for f in filters]])
    for f, value in filters.items():
        x = child.values.typed(E.field(f))
        child.frame = child.frame.where(x.col.isNull() if value is None else x.col == lit_for(value, x.kind))
    return child, held["key"], [F.col("r_" + theirs) for _, theirs in a.scope]


def _join_to_parent(low: Lowering, association: str, frame: DataFrame, name: str) -> None:
    a = low.domain.association(association)[0][-1]
    condition = low._owner_key((), a) == F.col(f"{name}_k0")
    for i, (mine, _) in enumerate(a.scope):
        condition = condition & (F.col(low.prefixes[()] + mine) == F.col(f"{name}_k{i + 1}"))
    low.frame = low.frame.join(frame, condition, "left").drop(*[f"{name}_k{i}" for i in range(1 + len(a.scope))])


def _attach(low: Lowering, node: E.Node, name: str) -> Column:
    """Join the array of a collection's children; gives the array column."""
    association, items, filters, orders, limit, after = node.args
    relation = low.domain.association(association)[1]
    plain = [n for _, n in items if n.kind != "related_collection"]
    for n in plain:
        require(len(E.fields_of(n)) == 1, "invalid_query", "an entry of a collection reads one field of the child")
    tiebreak = (E.field(relation.primary_key), "asc")
    ordering = list(orders) + ([tiebreak] if tiebreak[0] not in [o.bare for o, _ in orders] and relation.primary_key in relation.columns else [])
    child, key, scope = _child(low, association, [*plain, *[o for o, _ in ordering]], filters.value if filters else {})
    if after is not None:
        child.frame = child.frame.where(_cursor(child, key, list(orders), after.value))
    fields = []
    for k, n in items:
        if n.kind == "related_collection":
            inner = E.Node("related_collection", (n.args[0].removeprefix(association + "."), *n.args[1:]))
            array = _attach(child, inner, f"{name}i{len(fields)}")
            fields.append(F.coalesce(array, F.array().cast(_array_type(child, array))).alias(k))
        else:
            fields.append(_portable(child.values.typed(n)).alias(k))
    held = [c.alias(f"{name}_k{i}") for i, c in enumerate((key, *scope))]
    keys = [(child.values.column(o), d) for o, d in ordering] or [(F.to_json(F.struct(*fields)), "asc")]
    shown = F.struct(*fields).alias("f")
    if limit is None and all(d == "asc" for _, d in keys):
        # a flag before each key puts NULLs last
        sorted_by = [c for i, (k, _) in enumerate(keys) for c in (k.isNull().alias(f"n{i}"), k.alias(f"o{i}"))]
        rows = child.frame.select(*held, F.struct(*sorted_by, shown).alias("x"))
        gathered = F.transform(F.sort_array(F.collect_list("x")), lambda x: x["f"])
    elif limit is None:
        rows = child.frame.select(*held, F.struct(*[k.alias(f"o{i}") for i, (k, _) in enumerate(keys)], shown).alias("x"))
        gathered = F.array_sort(F.collect_list("x"), lambda a, b: _compared(a, b, [d for _, d in keys]))
        gathered = F.transform(gathered, lambda x: x["f"])
    else:
        place = F.row_number().over(Window.partitionBy(key, *scope).orderBy(*[ordered(k, d) for k, d in keys]))
        rows = child.frame.select(*held, place.alias("p"), shown).where(F.col("p") <= limit)
        gathered = F.transform(F.sort_array(F.collect_list(F.struct("p", "f"))), lambda x: x["f"])
    arrays = rows.groupBy(*[f"{name}_k{i}" for i in range(1 + len(scope))]).agg(gathered.alias(name))
    _join_to_parent(low, association, arrays, name)
    return F.col(name)


def _compared(a: Column, b: Column, directions: list[str]) -> Column:
    """-1, 0 or 1 by the keys o0, o1, ... of two structs; NULLs are the largest values."""
    out = F.lit(0)
    for i in reversed(range(len(directions))):
        x, y = a[f"o{i}"], b[f"o{i}"]
        less, more = (1, -1) if directions[i] == "desc" else (-1, 1)
        before = y.isNull() & x.isNotNull() | F.coalesce(x < y, F.lit(False))
        after = x.isNull() & y.isNotNull() | F.coalesce(x > y, F.lit(False))
        out = F.when(before, less).when(after, more).otherwise(out)
    return out


def _array_type(low: Lowering, array: Column) -> str:
    return low.frame.select(array.alias("x")).schema["x"].dataType.simpleString()


def _portable(t: Typed) -> Column:
    """Decimals as text: JSON readers turn numbers into inexact floats."""
    if category(t.kind) == "decimal" and t.kind.lower() not in FLOATS:
        return t.col.cast("string")
    return t.col


def _cursor(child: Lowering, key: Column, orders: list[tuple[E.Node, str]], after: dict[str, Any]) -> Column:
    """Rows past the cursor for its parent, all rows for the others; NULLs are the
    largest values."""
    require(set(after) == {"parent", "values"} and len(after["values"]) == len(orders), "invalid_query", "a cursor names its parent and one value for each order")
    past: Column | None = None
    same = F.lit(True)
    for (node, direction), value in zip(orders, after["values"]):
        x = child.values.typed(node)
        if value is None:
            beyond = x.col.isNotNull() if direction == "desc" else F.lit(False)
            equal = x.col.isNull()
        else:
            v = lit_for(value, x.kind)
            beyond = x.col < v if direction == "desc" else (x.col > v) | x.col.isNull()
            equal = x.col.eqNullSafe(v)
        term = same & beyond
        past = term if past is None else past | term
        same = same & equal
    return ~key.eqNullSafe(F.lit(after["parent"])) | F.coalesce(past, F.lit(False))
