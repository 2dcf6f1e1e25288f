"""Immutable queries. Every method returns a changed copy."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from . import expr as E
from .errors import require


@dataclass(frozen=True)
class Source:
    """A further relation of a query, visible as ``alias.column``."""

    kind: str  # cte, recursive_cte, values, subquery, lateral, array_rowset, json_rowset, function
    alias: str
    spec: Any


@dataclass(frozen=True)
class Query:
    selections: tuple[E.Node, ...] = ()
    predicate: E.Node | None = None
    groups: tuple[E.Node, ...] = ()
    mode: str = "plain"  # plain, rollup, cube, grouping_sets
    sets: tuple[tuple[int, ...], ...] = ()
    orders: tuple[tuple[E.Node, str], ...] = ()
    limit_value: int | None = None
    offset_value: int | None = None
    joins: tuple[str, ...] = ()
    set_operations: tuple[tuple[str, Query], ...] = ()
    sources: tuple[Source, ...] = ()
    members: tuple[str, ...] = ()
    timezone: str | None = None
    retargeted: Any = None
    lock_mode: str | None = None
    applied: Any = None  # query-library ids in use

    # -- selections ----------------------------------------------------------

    def select(self, *given: Any) -> Query:
        """Append; fields by path, expressions as nodes."""
        return replace(self, selections=self.selections + tuple(map(E.operand, _flat(given))))

    def replace_selections(self, *given: Any) -> Query:
        return replace(self, selections=tuple(map(E.operand, _flat(given))))

    def clear_selections(self) -> Query:
        return replace(self, selections=())

    # -- predicate -----------------------------------------------------------

    def where(self, condition: Any) -> Query:
        """AND a node or a filter AST to the predicate."""
        node = condition if isinstance(condition, E.Node) else E.parse_filter(condition)
        return replace(self, predicate=node if self.predicate is None else E.all_([self.predicate, node]))

    filter = where

    def replace_where(self, condition: Any) -> Query:
        return replace(self, predicate=None).where(condition)

    def clear_where(self) -> Query:
        return replace(self, predicate=None)

    # -- grouping ------------------------------------------------------------

    def _grouped(self, mode: str, given: tuple[Any, ...], sets: tuple[tuple[int, ...], ...] = ()) -> Query:
        nodes = tuple(map(E.operand, _flat(given)))
        require(nodes, "invalid_query", "there is nothing to group by")
        return replace(self, groups=nodes, mode=mode, sets=sets)

    def group_by(self, *given: Any) -> Query:
        return self._grouped("plain", given)

    def group_by_rollup(self, *given: Any) -> Query:
        return self._grouped("rollup", given)

    def group_by_cube(self, *given: Any) -> Query:
        require(len(_flat(given)) <= 8, "invalid_query", "a cube has 8 dimensions at most")
        return self._grouped("cube", given)

    def group_by_grouping_sets(self, dimensions: Any, sets: Any) -> Query:
        """dimensions: fields; sets: lists of positions, [] is the grand total."""
        given = _flat((dimensions,))
        require(isinstance(sets, (list, tuple)) and 0 < len(sets) <= 64, "invalid_query", "1 to 64 grouping sets")
        chosen = []
        for s in sets:
            require(all(isinstance(i, int) and 0 <= i < len(given) for i in s) and len(set(s)) == len(s), "invalid_query", "a grouping set counts dimensions by place, each once")
            chosen.append(tuple(sorted(s)))
        require(len(set(chosen)) == len(chosen), "invalid_query", "two grouping sets are the same")
        require({i for s in chosen for i in s} == set(range(len(given))), "invalid_query", "a dimension is in no grouping set")
        return self._grouped("grouping_sets", (given,), tuple(chosen))

    def grouping_positions(self) -> list[tuple[int, ...]]:
        """The grouping sets in order: rollup and cube with the most detailed first."""
        n = len(self.groups)
        if self.mode == "rollup":
            return [tuple(range(k)) for k in range(n, -1, -1)]
        if self.mode == "cube":
            masks = sorted(range(1 << n), key=lambda m: (-m.bit_count(), tuple(i for i in range(n) if m >> i & 1)))
            return [tuple(i for i in range(n) if m >> i & 1) for m in masks]
        return list(self.sets) if self.mode == "grouping_sets" else [tuple(range(n))]

    # -- order and page --------------------------------------------------------

    def order_by(self, what: Any, direction: str = "asc") -> Query:
        require(direction in ("asc", "desc"), "invalid_query", "direction: asc or desc")
        return replace(self, orders=self.orders + ((E.operand(what), direction),))

    def replace_orders(self, orders: Any) -> Query:
        return replace(self, orders=tuple(E._order(o) for o in orders))

    def limit(self, n: int | None) -> Query:
        require(n is None or isinstance(n, int) and n >= 0, "invalid_query", "limit: a whole number from 0")
        return replace(self, limit_value=n)

    def offset(self, n: int | None) -> Query:
        require(n is None or isinstance(n, int) and n >= 0, "invalid_query", "offset: a whole number from 0")
        return replace(self, offset_value=n)

    def count_query(self) -> Query:
        """The same rows without order and page; the engine counts them."""
        return replace(self, orders=(), limit_value=None, offset_value=None)

    def use_timezone(self, zone: str) -> Query:
        from zoneinfo import ZoneInfo

        try:
            ZoneInfo(zone)
        except Exception:  # noqa: BLE001  any bad name
            require(False, "invalid_query", "no time zone has this name", timezone=str(zone))
        return replace(self, timezone=zone)

    def lock(self, mode: str) -> Query:
        require(mode in ("share", "update"), "invalid_query", "lock: share or update")
        return replace(self, lock_mode=mode)

    # -- relations -------------------------------------------------------------

    def join(self, association: str) -> Query:
        """Make an association take part though nothing refers to it."""
        return replace(self, joins=self.joins + (association,))

    def retarget(self, association: str, strategy: str = "in") -> Query:
        """Switch the row grain to an association's target: its rows reachable from the
        rows that this query selects so far."""
        require(strategy in ("in", "exists"), "invalid_query", "strategy: in or exists")
        context = replace(self, selections=(), orders=(), limit_value=None, offset_value=None)
        return Query(retargeted=(association, strategy, context), timezone=self.timezone)

    def _set(self, op: str, other: Query) -> Query:
        for q in (self, other):
            require(not q.orders and q.limit_value is None and q.offset_value is None, "invalid_query", "order and limit belong to the whole set operation")
        return replace(self, set_operations=self.set_operations + ((op, other),))

    def union(self, other: Query) -> Query:
        return self._set("union", other)

    def union_all(self, other: Query) -> Query:
        return self._set("union_all", other)

    def intersect(self, other: Query) -> Query:
        return self._set("intersect", other)

    def except_(self, other: Query) -> Query:
        return self._set("except", other)

    def _source(self, kind: str, alias: str, **spec: Any) -> Query:
        require(isinstance(alias, str) and E.IDENTIFIER.fullmatch(alias), "invalid_query", "alias: expected a name of letters, digits and underscores", alias=str(alias))
        require(alias not in [s.alias for s in self.sources], "invalid_query", "alias: another source has it", alias=alias)
        return replace(self, sources=self.sources + (Source(kind, alias, spec),))

    def with_cte(self, name: str, query: Query, *, domain: Any = None, columns: Any = None, owner: str | None = None, related: str | None = None, join_type: str = "left") -> Query:
        """A named sub-query, joined on owner = related if these are given."""
        require(join_type in ("left", "inner"), "invalid_query", "join: left or inner")
        return self._source("cte", name, query=query, domain=domain, columns=columns, owner=owner, related=related, join_type=join_type)

    def with_recursive_cte(
        self, name: str, base: Query, step: Query, *, step_on: Any, domain: Any = None, step_domain: Any = None, columns: Any,
        max_depth: int | None = None, owner: str | None = None, related: str | None = None, join_type: str = "left",
    ) -> Query:
        """step_on: (column of the level before, field of the step's domain). A
        max_depth adds the column ``recursion_depth``, 1 at the anchor."""
        require(max_depth is None or isinstance(max_depth, int) and 1 <= max_depth <= 10_000, "invalid_query", "max_depth: 1 to 10000")
        return self._source("recursive_cte", name, base=base, step=step, step_on=step_on, domain=domain, step_domain=step_domain, columns=columns, max_depth=max_depth, owner=owner, related=related, join_type=join_type)

    def with_values(self, rows: Any, columns: Any, alias: str, *, owner: str | None = None, related: str | None = None, join_type: str = "left") -> Query:
        """Inline rows; without owner and related a cross join."""
        return self._source("values", alias, rows=tuple(map(tuple, rows)), columns=columns, owner=owner, related=related, join_type=join_type)

    def subquery_join(self, alias: str, query: Query, on: Any, *, domain: Any = None, join_type: str = "left") -> Query:
        """on: one or more (field, column of the sub-query)."""
        require(on, "invalid_query", "a sub-query is joined on pairs of field and column")
        return self._source("subquery", alias, query=query, domain=domain, on=tuple(map(tuple, on)), join_type=join_type)

    def lateral_join(self, alias: str, query: Query, correlations: Any, *, domain: Any = None, join_type: str = "left") -> Query:
        """A sub-query per row. correlations: (field of this query, field of the
        sub-query's domain), equalities."""
        require(correlations, "invalid_query", "nothing ties the lateral query to its row")
        require(join_type in ("left", "inner", "cross"), "invalid_query", "join: left, inner or cross")
        return self._source("lateral", alias, query=query, domain=domain, on=tuple(map(tuple, correlations)), join_type=join_type)

    def array_rowset(self, path: str, alias: str, *, ordinality: str | None = None, join_type: str = "cross") -> Query:
        """A row per array element, as alias.value."""
        require(join_type in ("left", "inner", "cross"), "invalid_query", "join: left, inner or cross")
        return self._source("array_rowset", alias, path=path, ordinality=ordinality, join_type=join_type)

    def json_rowset(self, path: str, alias: str, columns: dict[str, str], *, json_path: Any = (), join_type: str = "left") -> Query:
        """A row per object of a JSON array, with typed columns."""
        require(columns, "invalid_query", "columns to read from the objects are not given")
        return self._source("json_rowset", alias, path=path, columns=columns, json_path=tuple(json_path), join_type=join_type)

    def function_lateral(self, function: str, arguments: Any, alias: str, *, column: str = "value", kind: str = "integer", join_type: str = "cross") -> Query:
        """A table function per row, by its name in the engine's registry."""
        return self._source("function", alias, function=function, arguments=tuple(arguments), column=column, type=kind, join_type=join_type)

    def with_member(self, name: str) -> Query:
        """Activate a query member that the domain declares."""
        return self if name in self.members else replace(self, members=self.members + (name,))


def _flat(given: Any) -> list[Any]:
    out: list[Any] = []
    for x in given:
        out += list(x) if isinstance(x, (list, tuple)) else [x]
    return out
