"""Query members: sub-plans that a domain declares and a query activates by name."""

from __future__ import annotations

from dataclasses import replace
from typing import TYPE_CHECKING, Any

from .. import expr as E
from ..domain import Domain
from ..errors import require
from ..query import Query

if TYPE_CHECKING:
    from ..engine import Engine

GROUPS = ("ctes", "subqueries", "laterals", "values", "unnests")
DEFAULT_DEPTH, MAX_DEPTH = 100, 10_000


def expand_members(engine: Engine, domain: Domain, query: Query) -> Query:
    names, query = query.members, replace(query, members=())
    for name in names:
        found = [(g, domain.query_members[g][name]) for g in GROUPS if name in domain.query_members.get(g, {})]
        require(len(found) == 1, "invalid_query", "the domain declares no such member", member=name)
        query = _activate(engine, domain, query, name, *found[0])
    return query


def member_query(data: dict[str, Any], previous: bool = False) -> Query:
    """{select: [field | {as, value} | {as, aggregate, field?}], filter?, group_by?,
    order_by?, limit?}"""
    q = Query()
    for s in data.get("select", ()):
        if isinstance(s, str):
            q = q.select(s)
        elif "value" in s:
            q = q.select(E.parse_value(s["value"], previous=previous).as_(s["as"]))
        else:
            q = q.select(aggregate(s["aggregate"], s.get("field")).as_(s["as"]))
    if data.get("filter"):
        q = q.where(data["filter"])
    if data.get("group_by"):
        q = q.group_by(*data["group_by"])
    for o in data.get("order_by", ()):
        q = q.order_by(*((o,) if isinstance(o, str) else o))
    return q.limit(data.get("limit"))


def aggregate(name: str, field: str | None) -> E.Node:
    made = {
        "count": E.count_field, "count_distinct": E.count_distinct, "sum": E.sum_, "avg": E.avg, "min": E.min_, "max": E.max_,
        "sum_zero": E.sum_zero, "true_count": E.true_count, "false_count": E.false_count, "true_percentage": E.true_percentage,
    }
    require(name in made, "invalid_query", "no aggregate has this name", aggregate=name)
    if field is None:
        require(name == "count", "invalid_query", f"{name}: of which field?")
        return E.count()
    return made[name](field)


def _activate(engine: Engine, domain: Domain, query: Query, name: str, group: str, spec: Any) -> Query:
    other = engine.registry.get(spec["source"]) if isinstance(spec, dict) and spec.get("source") else domain
    join = spec.get("join") or {}
    if group == "ctes" and "base" in spec:
        depth = spec.get("max_depth", DEFAULT_DEPTH)
        require(1 <= depth <= MAX_DEPTH, "invalid_query", "max_depth: 1 to 10000")
        return query.with_recursive_cte(
            name, member_query(spec["base"]), member_query(spec["step"], previous=True), step_on=tuple(spec["step_join"]), domain=other, step_domain=other,
            columns=spec["columns"], max_depth=depth, owner=join.get("owner"), related=join.get("related"), join_type=join.get("type", "left"),
        )
    if group == "ctes":
        return query.with_cte(name, member_query(spec["query"]), domain=other, columns=spec.get("columns"), owner=join.get("owner"), related=join.get("related"), join_type=join.get("type", "left"))
    if group == "subqueries":
        return query.subquery_join(name, member_query(spec["query"]), spec["on"], domain=other, join_type=spec.get("type", "left"))
    if group == "laterals":
        if isinstance(spec.get("query"), (list, tuple)) and spec["query"][0] == "function":
            return query.function_lateral(spec["query"][1], spec["query"][2], name)
        return query.lateral_join(name, member_query(spec["query"]), spec["correlations"], domain=other, join_type=spec.get("join_type", "left"))
    if group == "values":
        return query.with_values(spec["rows"], spec["columns"], spec.get("as", name), owner=join.get("owner"), related=join.get("related"), join_type=join.get("type", "left"))
    return query.array_rowset(spec["array_field"], spec.get("as", name), ordinality=spec.get("ordinality"), join_type=spec.get("join_type", "cross"))
