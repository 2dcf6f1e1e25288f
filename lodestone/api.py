"""Request bodies to queries, and explorer views built from them.

    {select | projection | view, segments, parameters, filters: [{field, op, value, end} |
     {any | all: [...]}], ordering | order_by: [{field, direction}], group_by: [path |
     {field, alias, format | ranges | step + kind}], rollup | cube | grouping_sets, limit,
     offset, timezone, row_format}
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import expr as E
from . import library
from .domain import Resolved
from .engine import Engine
from .errors import SelectError, require
from .functions.dates import FORMATS
from .functions.shortcuts import SHORTCUTS
from .plans.lower import _name
from .query import Query
from .types import is_numeric, is_temporal

CODE = "invalid_api_query"
KEYS = {
    "select", "projection", "view", "segments", "parameters", "filters", "ordering", "order_by", "group_by", "limit", "offset", "timezone",
    "row_format", "rollup", "cube", "grouping_sets",
}

RANGE_OPERATORS = ("eq", "gt", "gte", "lt", "lte")
#: The key of a group object that says how its rows are grouped, and who does it.
GROUP_MAKERS = {"format": "_by_format", "ranges": "_by_ranges", "step": "_by_step"}


@dataclass(frozen=True)
class Options:
    max_filters: int = 50
    max_filter_depth: int = 4
    max_orders: int = 10
    max_segments: int = 20
    max_limit: int = 1000
    max_count_rows: int | None = None  # none: exact counts of any size
    max_export_rows: int = 100_000
    max_offset: int = 1_000_000
    default_limit: int = 50
    filter_groups: bool = True
    explorer: bool = False  # group objects, {group: alias}, more aggregates
    timezone: str | None = None  # of the explorer's formats


class Api:
    """Runs request bodies against an engine."""

    def __init__(self, engine: Engine, options: Options | None = None):
        self.engine, self.domain, self.options = engine, engine.domain, options or Options()

    # -- fields ------------------------------------------------------------------

    def _public(self, path: Any, purpose: str) -> Resolved:
        require(isinstance(path, str), CODE, f"{purpose}: a field is given by its path")
        found = self.domain.resolve(path)
        require(self.domain.is_public(path), "field_not_public", f"{purpose}: this field is kept from callers", field=path)
        return found

    @staticmethod
    def _object(value: Any, keys: set[str], label: str) -> dict[str, Any]:
        require(isinstance(value, dict), CODE, f"{label}: expected an object")
        require(set(value) <= keys, CODE, f"{label}: keys that nothing reads", keys=sorted(set(value) - keys))
        return value

    # -- filters -----------------------------------------------------------------

    def filters(self, given: Any) -> list[E.Node]:
        require(isinstance(given, list), CODE, "filters: expected a list")
        left = [self.options.max_filters]
        return [self._entry(f, 0, left) for f in given]

    def _entry(self, f: Any, depth: int, left: list[int]) -> E.Node:
        require(isinstance(f, dict), CODE, "filters: each one is an object")
        if self.options.filter_groups and len(f) == 1 and ("any" in f or "all" in f):
            (kind, members), = f.items()
            require(isinstance(members, list) and members, CODE, "any/all: expected a list of one filter or more")
            require(depth < self.options.max_filter_depth, CODE, "any/all: groups stand too deep in each other")
            made = [self._entry(m, depth + 1, left) for m in members]
            return made[0] if len(made) == 1 else E.any_(made) if kind == "any" else E.all_(made)
        left[0] -= 1
        require(left[0] >= 0, CODE, "filters: more leaves than are allowed")
        return self._leaf(f)

    def _leaf(self, f: dict[str, Any]) -> E.Node:
        if self.options.explorer and "format" in f:
            return self._derived_leaf(f)
        self._object(f, {"field", "op", "value", "end"}, "filter")
        op, path = str(f.get("op", "")).lower(), f.get("field")
        choice = self.domain.filter_choices.get(path, {}) if isinstance(path, str) else {}
        if isinstance(choice.get("conditional"), dict):
            return self._conditional(f, op, choice)
        r = self._public(path, "filter")
        operand = E.epoch_datetime(path) if r.column.type == "epoch_datetime" else E.field(path)
        return self._condition(f, op, r.column.type, operand)

    def _conditional(self, f: dict[str, Any], op: str, choice: dict[str, Any]) -> E.Node:
        """One of two fields, by whether a third is NULL."""
        require(op in ("eq", "ne", "in", "not_in", "is_null", "not_null"), CODE, f"op: {op} doesn't apply to this field")
        c = choice["conditional"]
        if not all(self.domain.is_public(c[k]) for k in ("when_field", "present_field", "absent_field")):
            declared = {str(x["value"]) for x in choice.get("choices", ())}
            values = f.get("value") if op in ("in", "not_in") else [f.get("value")]
            require(op not in ("is_null", "not_null") and all(str(v) in declared for v in values), "field_not_public", "value: not among the choices that the field declares", field=f["field"])
        kind = self.domain.resolve(c["present_field"]).column.type
        present = self._condition(f, op, kind, E.field(c["present_field"]))
        absent = self._condition(f, op, kind, E.field(c["absent_field"]))
        when = E.field(c["when_field"])
        return E.any_([E.all_([E.not_null(when), present]), E.all_([E.is_null(when), absent])])

    def _derived_leaf(self, f: dict[str, Any]) -> E.Node:
        self._object(f, {"field", "format", "op", "value"}, "filter")
        node = self._formatted(f.get("field"), f["format"], "filter")
        op = str(f.get("op", "")).lower()
        if op == "is_null":
            require("value" not in f, CODE, "value: is_null compares with nothing")
            return E.is_null(node)
        require(op == "eq" and isinstance(f.get("value"), str), CODE, "op: a formatted field is compared by eq with a text, or by is_null")
        return E.eq(node, f["value"])

    def _plain(self, value: Any, what: str) -> Any:
        require(value is not None and not isinstance(value, (list, dict)), CODE, f"{what}: expected one plain value")
        return value

    def _several(self, value: Any) -> list[Any]:
        require(isinstance(value, list) and value, CODE, "value: expected a list of one value or more")
        self.engine.limits.check("max_filter_values", len(value), CODE, "values to choose from")
        return [self._plain(v, "value in the list") for v in value]

    def _shortcut(self, operand: E.Node, f: dict[str, Any]) -> E.Node:
        require(f.get("value") in SHORTCUTS, CODE, "value: no date shortcut has this name", value=str(f.get("value")))
        return E.date_shortcut(operand, f["value"], self.engine.today)

    def _condition(self, f: dict[str, Any], op: str, kind: str, operand: E.Node) -> E.Node:
        """The test that a filter asks for, made by the operator's entry."""
        tests: dict[str, Callable[[], E.Node]] = {
            "is_null": lambda: E.is_null(operand),
            "not_null": lambda: E.not_null(operand),
            "in": lambda: E.in_(operand, self._several(f.get("value"))),
            "not_in": lambda: E.not_in(operand, self._several(f.get("value"))),
            "between": lambda: E.between(operand, self._plain(f.get("value"), "value"), self._plain(f.get("end"), "end")),
            **{c: lambda: E.compare(op, operand, self._plain(f.get("value"), "value")) for c in E.COMPARE},
        }
        if kind in ("string", "text"):
            tests |= {t: lambda: E.text_match(op, operand, str(self._plain(f.get("value"), "value"))) for t in E.TEXT}
        if kind == "epoch_datetime" or is_temporal(kind):
            tests["date_shortcut"] = lambda: self._shortcut(operand, f)
        require(op in tests, CODE, f"op: {op} doesn't apply to this field")
        return tests[op]()

    # -- selections and groups -----------------------------------------------------

    def _formatted(self, path: Any, style: Any, purpose: str) -> E.Node:
        r = self._public(path, purpose)
        require(style in FORMATS, CODE, "format: no date format has this name", format=str(style))
        require(is_temporal(r.column.type), CODE, "format: the field holds no date or time", field=path)
        zone = self.options.timezone if r.column.type in ("utc_datetime", "epoch_datetime") else None
        return E.datetime_format(E.field(path), style, zone)

    def _bounds(self, path: str, where: Any) -> list[Any]:
        """A filter of [operator, value] pairs on one field."""
        require(isinstance(where, list) and where, CODE, "expected [operator, value] pairs", field=path)
        for pair in where:
            require(isinstance(pair, list) and len(pair) == 2 and pair[0] in RANGE_OPERATORS, CODE, "a pair starts with eq, gt, gte, lt or lte", field=path)
            require(pair[1] is not None and not isinstance(pair[1], (list, dict)), CODE, "a pair ends with one plain value", field=path)
        tests = [[op, path, value] for op, value in where]
        return tests[0] if len(tests) == 1 else ["and", tests]

    def _by_format(self, g: dict[str, Any]) -> E.Node:
        return self._formatted(g["field"], g["format"], "group")

    def _by_ranges(self, g: dict[str, Any]) -> E.Node:
        """A label for each range, Other for the rest."""
        require(isinstance(g["ranges"], list) and g["ranges"], CODE, "ranges: expected objects of label and where", field=g["field"])
        text = lambda label: ["literal", label, "string"]
        branches: list[Any] = [[self._bounds(g["field"], r.get("where")), text(r["label"])] for r in g["ranges"]]
        return E.parse_value(["case", *branches, ["else", text("Other")]], self.engine.limits)

    def _by_step(self, g: dict[str, Any]) -> E.Node:
        require(g.get("kind") in ("numeric", "year"), CODE, "kind: a step counts numbers or years", kind=str(g.get("kind")))
        require(isinstance(g["step"], int) and g["step"] >= 1, CODE, "step: expected a whole number from 1", step=str(g["step"]))
        return E.bucket(E.field(g["field"]), {"kind": g["kind"] + "_increment", "increment": g["step"]})

    def _group_object(self, g: Any, taken: dict[str, E.Node]) -> tuple[str, E.Node]:
        """(alias, node) of a group object: its one key among GROUP_MAKERS decides."""
        self._object(g, {"field", "alias", "kind", *GROUP_MAKERS}, "group")
        ways = [k for k in GROUP_MAKERS if k in g]
        require(len(ways) == 1, CODE, f"a group object has one of {', '.join(GROUP_MAKERS)}", found=ways)
        alias = g.get("alias")
        require(isinstance(alias, str) and E.IDENTIFIER.fullmatch(alias), CODE, "alias: a group object needs a name of its own", alias=str(alias))
        require(alias not in taken, CODE, "alias: another group has it", alias=alias)
        self._public(g.get("field"), "group")
        return alias, getattr(self, GROUP_MAKERS[ways[0]])(g)

    def _groups(self, entries: Any) -> tuple[list[E.Node], dict[str, E.Node]]:
        """The nodes that rows are grouped by, and those of them that have an alias."""
        require(isinstance(entries, list) and entries, CODE, "group_by: expected fields or group objects in a list")
        self.engine.limits.check("max_fields", len(entries), CODE, "groups")
        plain = [g for g in entries if isinstance(g, str)]
        require(len(set(plain)) == len(plain), CODE, "group_by: a field stands there twice")
        require(self.options.explorer or len(plain) == len(entries), CODE, "group_by: only explorers take group objects")
        nodes: list[E.Node] = []
        named: dict[str, E.Node] = {}
        for g in entries:
            if isinstance(g, str):
                self._public(g, "group")
                nodes.append(E.field(g))
            else:
                alias, node = self._group_object(g, named)
                named[alias] = node
                nodes.append(node)
        return nodes, named

    def _selections(self, entries: Any, aliases: dict[str, E.Node]) -> list[E.Node]:
        require(isinstance(entries, list) and entries, CODE, "select: expected fields or objects in a list")
        out: list[E.Node] = []
        hidden: list[str] = []
        for e in entries:
            made = self._subtable(e, hidden) if isinstance(e, list) else self._selection(e, aliases, hidden)
            if made is not None:
                require(_name(made) not in [_name(o) for o in out], CODE, "select: two columns of the result would share a name", column=_name(made))
                out.append(made)
        self.engine.limits.check("max_fields", len(out), CODE, "selected columns")
        require(not hidden, "field_not_public", "select: this field is kept from callers", field=hidden[0] if hidden else None)
        return out

    def _selection(self, e: Any, aliases: dict[str, E.Node], hidden: list[str]) -> E.Node | None:
        if isinstance(e, str):
            e = {"field": e}
        require(isinstance(e, dict), CODE, "select: an entry is a path, an object, or a list for a collection")
        if "group" in e:
            require(e["group"] in aliases, CODE, "group: no group object has this alias", group=str(e["group"]))
            return aliases[e["group"]].as_(e["group"])
        if "aggregate" in e:
            return self._aggregate(e, hidden)
        self._object(e, {"field", "alias", "format"}, "select entry")
        self.domain.resolve(e.get("field"))
        if not self.domain.is_public(e["field"]):
            hidden.append(e["field"])
            return None
        node = self._formatted(e["field"], e["format"], "select") if "format" in e else E.field(e["field"])
        return node.as_(e["alias"]) if "alias" in e else node

    def _aggregate(self, e: dict[str, Any], hidden: list[str]) -> E.Node | None:
        self._object(e, {"aggregate", "field", "alias", "ignore_nulls", "where"}, "select entry")
        name, alias, path = e["aggregate"], e.get("alias"), e.get("field")
        plain = {"count": E.count_field, "count_distinct": E.count_distinct, "sum": E.sum_, "avg": E.avg, "min": E.min_, "max": E.max_}
        more = {"true_count": E.true_count, "false_count": E.false_count, "true_percentage": E.true_percentage}
        require(name in plain or self.options.explorer and (name in more or name == "count_where"), CODE, "aggregate: no such aggregate here", aggregate=str(name))
        require(("where" in e) == (name == "count_where"), CODE, "where: goes with count_where, and count_where with it")
        require("ignore_nulls" not in e or name == "sum" and e["ignore_nulls"] == "auto", CODE, "ignore_nulls: only sum reads it, and only as auto")
        require(isinstance(alias, str), CODE, "alias: an aggregate needs a name")
        if path is None:
            require(name == "count", CODE, "field: only count does without one", aggregate=name)
            return E.count().as_(alias)
        r = self.domain.resolve(path)
        if not self.domain.is_public(path):
            hidden.append(path)
            return None
        require(not any(a.cardinality == "many" for a in r.associations), CODE, "field: behind a to-many association values would count repeatedly", field=path)
        require(name not in ("sum", "avg") or is_numeric(r.column.type), CODE, f"field: {name} adds up numbers", field=path)
        require(name not in more or r.column.type == "boolean", CODE, f"field: {name} counts truth values", field=path)
        if name == "count_where":
            return E.count_field(E.parse_value(["case", [self._bounds(path, e["where"]), ["literal", 1, "integer"]]])).as_(alias)
        make = E.sum_zero if "ignore_nulls" in e else plain.get(name) or more[name]
        return make(path).as_(alias)

    def _subtable(self, entries: list[Any], hidden: list[str]) -> E.Node | None:
        """Fields of one direct to-many association, as a bounded collection."""
        require(entries, CODE, "select: a collection has no fields")
        association, items = None, []
        for e in entries:
            e = {"field": e} if isinstance(e, str) else e
            require(isinstance(e, dict), CODE, "select: collections don't nest here")
            self._object(e, {"field", "alias"}, "subtable select entry")
            r = self.domain.resolve(e.get("field"))
            if not self.domain.is_public(e["field"]):
                hidden.append(e["field"])
                continue
            require(len(r.associations) == 1 and r.associations[0].cardinality == "many", CODE, "select: a collection's fields stand one to-many step away", field=e["field"])
            require(association in (None, r.steps[0]), CODE, "select: a collection mixes associations", field=e["field"])
            association = r.steps[0]
            items.append((e.get("alias", r.column.name), E.field(r.column.name)))
        if association is None:
            return None
        require(len({k for k, _ in items}) == len(items), CODE, "select: two fields of a collection share a name")
        relation = self.domain.association(association)[1]
        # one more than is shown tells whether there are more
        most = self.engine.limits.get("max_collection_rows")
        return E.related_collection(association, items, order_by=[relation.primary_key], limit=most + 1).as_(association)

    # -- the request -------------------------------------------------------------------

    def query(self, body: Any) -> Query:
        """The query of a body."""
        self._object(body, KEYS, "query body")
        require(sum(k in body for k in ("select", "projection", "view")) == 1, CODE, "body: one of select, projection and view says what is shown")
        require(not ("ordering" in body and "order_by" in body), CODE, "body: ordering and order_by exclude each other")
        require(body.get("row_format", "arrays") in ("arrays", "objects"), CODE, "row_format: arrays or objects")
        groups, aliases = self._groups(body["group_by"]) if "group_by" in body else ([], {})
        segments = list(body.get("segments", ()))
        ordering = body.get("ordering")
        q = self.engine.query()
        if "select" in body:
            q = q.select(*self._selections(body["select"], aliases))
        else:
            projection = body.get("projection")
            if "view" in body:
                view = library.definition(self.domain, "views", body["view"])
                projection = view.get("projection")
                require(projection, CODE, "view: has no projection to show", view=body["view"])
                segments += view.get("segments", ())
                if ordering is None and "order_by" not in body:
                    ordering = view.get("ordering")
            q = library.apply_projection(self.domain, q, projection)
            for s in q.selections:
                for p in E.fields_of(s):
                    self._public(p, "select")
        require(len(segments) <= self.options.max_segments, CODE, "segments: more than are allowed, those of the view included")
        if segments:
            for p in library.parameterized_fields(self.domain, segments):
                self._public(p, "filter")
            q = library.apply_segments(self.domain, q, segments, body.get("parameters", {}), self.engine.limits)
        else:
            require(not body.get("parameters"), CODE, "parameters: nothing here declares any")
        for f in self.filters(body.get("filters", [])):
            q = q.where(f)
        q = self._ordered(q, body, ordering)
        q = self._grouped(q, body, groups, aliases)
        aggregate = any(E.is_aggregate(s) for s in q.selections)
        if "timezone" in body:
            try:
                q = q.use_timezone(body["timezone"])
            except SelectError as e:
                raise SelectError(CODE, e.message, e.details) from e
        limit, offset = body.get("limit", self.options.default_limit), body.get("offset", 0)
        require(isinstance(limit, int) and 0 <= limit <= self.options.max_limit, CODE, "limit: outside of what is allowed")
        require(isinstance(offset, int) and 0 <= offset <= self.options.max_offset, CODE, "offset: outside of what is allowed")
        children = sum(s.args[4] for s in q.selections if s.kind == "related_collection" and s.args[4])
        require(limit * max(children - 1, 0) <= self.engine.limits.get("max_total_collection_rows") or not children, CODE, "limit: rows times collection rows go beyond the ceiling")
        # an aggregate without groups is one summary row, which is not paged
        return q if aggregate and not groups else q.limit(limit).offset(offset)

    def _ordered(self, q: Query, body: dict[str, Any], ordering: Any) -> Query:
        if ordering is not None:
            for path, _ in library.ordering_entries(self.domain, ordering):
                self._public(path, "sort")
            return library.apply_ordering(self.domain, q, ordering)
        orders = body.get("order_by", [])
        require(isinstance(orders, list) and len(orders) <= self.options.max_orders, CODE, "order_by: expected a list, not too long")
        for o in orders:
            self._object(o, {"field", "column", "direction"}, "order_by entry")
            direction = str(o.get("direction", "asc")).lower()
            require(direction in ("asc", "desc"), CODE, "direction: asc or desc")
            if "column" in o:
                q = q.order_by(self._aggregate_called(q, o), direction)
                continue
            self._public(o.get("field"), "sort")
            if self.options.explorer and o["field"] != self.domain.primary_key:
                # explorers show NULL first ascending and last descending
                rank = E.parse_value(["case", [["is_null", o["field"]], ["literal", 0, "integer"]], ["else", ["literal", 1, "integer"]]])
                q = q.order_by(rank, direction)
            q = q.order_by(o["field"], direction)
        return q

    def _aggregate_called(self, q: Query, o: dict[str, Any]) -> E.Node:
        """The selected aggregate that an explorer's order names by its alias."""
        require(self.options.explorer and "field" not in o, CODE, "order_by: only explorers order by a column of the result")
        found = [s for s in q.selections if s.alias == o["column"] and E.is_aggregate(s)]
        require(found, CODE, "order_by: no selected aggregate has this alias", column=str(o["column"]))
        return found[0].bare

    def _grouped(self, q: Query, body: dict[str, Any], groups: list[E.Node], aliases: dict[str, E.Node]) -> Query:
        modes = [k for k in ("rollup", "cube", "grouping_sets") if k in body]
        require(len(modes) <= 1, CODE, "body: rollup, cube and grouping_sets exclude each other")
        plain = [s for s in q.selections if not E.is_aggregate(s)]
        aggregate = len(plain) < len(q.selections)
        if not groups:
            require(not modes, CODE, f"{modes[0] if modes else 'rollup'}: there is nothing to group by")
            require(not aggregate or not plain and not q.orders, CODE, "group_by: lacks a field that is shown or ordered by")
            return q
        keys = {g.args[0] for g in groups if g.kind == "field"}
        made = set(aliases.values())
        loose = [p for s in plain if s.bare not in made for p in E.fields_of(s) if p not in keys]
        loose += [p for o, _ in q.orders if not E.is_aggregate(o) for p in E.fields_of(o) if p not in keys]
        require(not loose, CODE, "group_by: lacks a field that is shown or ordered by", field=loose[0] if loose else None)
        if not modes:
            return q.group_by(*groups)
        require(aggregate, CODE, "select: totals need an aggregate")
        value = body[modes[0]]
        if modes[0] == "grouping_sets":
            q = q.group_by_grouping_sets(groups, value)
        else:
            require(value is True, CODE, f"{modes[0]}: true turns it on, nothing else does")
            q = q.group_by_rollup(*groups) if modes[0] == "rollup" else q.group_by_cube(*groups)
        return q.select(E.grouping(*groups).as_("grouping"))

    def frame(self, body: Any) -> DataFrame:
        return self.engine.dataframe(self.query(body))

    def run(self, body: dict[str, Any]) -> dict[str, Any]:
        """{columns, rows}; rows as arrays or objects, collections decoded."""
        q = self.query(body)
        if q.limit_value == 0:
            return {"columns": list(self.engine.compile(q).names), "rows": []}
        found = self.engine.all(q)
        nested = {i: _name(s) for i, s in enumerate(q.selections) if s.kind == "related_collection"}
        most = self.engine.limits.get("max_collection_rows")
        for row in found["rows"]:
            for i, name in nested.items():
                row[i] = json.loads(row[i])
                require(len(row[i]) <= most, "result_limit_exceeded", "a collection holds more rows than are returned", column=name)
        if body.get("row_format") == "objects":
            found["rows"] = [dict(zip(found["columns"], r)) for r in found["rows"]]
        return found

    def resource(self, key: Any, fields: list[Any]) -> dict[str, Any] | None:
        """One row by primary key."""
        selections = self._selections(fields, {})
        q = self.engine.query().select(*selections).where(E.eq(self.domain.primary_key, key))
        return self.engine.one(q)

    def nested_detail(self, association: str, fields: list[Any], child_fields: list[str], *, parents: int = 25, children: int = 20, offset: int = 0) -> Query:
        """A page of parents, each with its first children by primary key; at most 25
        parents and 20 children."""
        require(1 <= parents <= 25 and 1 <= children <= 20, CODE, "nested detail: up to 25 parents with up to 20 children each")
        a, relation = self.domain.association(association)
        require(len(a) == 1 and a[0].cardinality == "many", CODE, "nested detail: the association isn't one to-many step", association=association)
        for f in child_fields:
            self._public(f"{association}.{f}", "select")
        nested = E.related_collection(association, child_fields, order_by=[relation.primary_key], limit=children).as_(association)
        return self.engine.query().select(*self._selections(fields, {}), nested).order_by(self.domain.primary_key).limit(parents).offset(offset)

    # -- explorer --------------------------------------------------------------------

    def grid(self, body: dict[str, Any], measure: str) -> DataFrame:
        """Two groups and a measure as a table: a row per value of the first group, a
        column per value of the second, sorted. The column values are read first, at
        most ``max_fields`` of them."""
        q = self.query(body | {"limit": self.options.max_limit})
        require(len(q.groups) == 2, CODE, "grid: needs a group for rows and one for columns")
        flat = self.engine.dataframe(q.limit(None).offset(None))
        row, column = (c for c in flat.columns if c != measure)
        most = self.engine.limits.get("max_fields")
        values = [r[0] for r in flat.select(F.col(f"`{column}`")).distinct().orderBy(F.col(f"`{column}`").asc_nulls_last()).limit(most + 1).collect()]
        require(len(values) <= most, "result_limit_exceeded", "grid: the second group has more values than fit", maximum=most)
        return flat.groupBy(f"`{row}`").pivot(column, values).agg(F.first(f"`{measure}`"))

    def levels(self, body: dict[str, Any]) -> DataFrame:
        """Grouped rows of every level in one aggregation: the body's groups rolled up,
        with ``level``, the number of groups that a row is about (0: the total). Parents
        stand before their children. More than ``max_limit`` rows are refused: a part of a
        hierarchy would look like all of it."""
        q = self.query({k: v for k, v in body.items() if k not in ("limit", "offset", "order_by")} | {"rollup": True})
        flat = self.engine.dataframe(q.limit(None).offset(None))
        n = len(q.groups)
        level = F.lit(n) - F.bit_count(F.col("grouping")).cast("int")
        keys = [F.col(f"`{_name(s)}`") for s in q.selections if not E.is_aggregate(s) and s.kind != "grouping"]
        made = flat.withColumn("level", level.cast("long")).drop("grouping")
        order = [c for i, k in enumerate(keys) for c in ((F.col("level") > i).asc(), k.asc_nulls_last())]
        most = self.options.max_limit
        require(made.limit(most + 1).count() <= most, "result_limit_exceeded", "there are more groups than a response may hold", maximum=most)
        return made.orderBy(*order)

    def whole(self, body: dict[str, Any]) -> DataFrame:
        """The rows of a request without its page."""
        return self.engine.dataframe(self.query({k: v for k, v in body.items() if k not in ("limit", "offset")}).limit(None).offset(None))

    def exact_count(self, body: dict[str, Any]) -> int:
        """How many rows or groups a request has: all of them, summed up in the tasks. With
        ``max_count_rows`` refused beyond it, where no more than that is counted."""
        most = self.options.max_count_rows
        made = self.whole({k: v for k, v in body.items() if k not in ("order_by", "ordering")})
        if most is None:
            return made.count()
        n = made.limit(most + 1).count()
        require(n <= most, "count_unavailable", "there are more rows than are counted", maximum=most)
        return n

    def export(self, body: dict[str, Any], measure: str | None = None) -> DataFrame:
        """All rows of a request, or with ``measure`` its grid, for a sink."""
        if measure is not None:
            return self.grid(body, measure)
        made, most = self.whole(body), self.options.max_export_rows
        require(made.limit(most + 1).count() <= most, "export_limit_exceeded", "there are more rows than are exported", maximum=most)
        return made

    def row_meta(self, body: dict[str, Any]) -> DataFrame:
        """The rows of a grouped request with ``meta``: a JSON array of the filters that
        lead from a row to what it is about."""
        q = self.query({k: v for k, v in body.items() if k not in ("limit", "offset")})
        require(q.groups, CODE, "only grouped rows are about others")
        made = self.engine.dataframe(q.limit(None).offset(None))
        entries = []
        for g, given in zip(q.groups, body["group_by"]):
            names = [_name(s) for s in q.selections if s.bare == g.bare]
            require(names, CODE, "select: lacks a group, so its rows can't be told apart")
            key = F.col(f"`{names[0]}`")
            path, style = (given, None) if isinstance(given, str) else (given["field"], given.get("format"))
            named = [F.lit(path).alias("field"), F.when(key.isNull(), "is_null").otherwise("eq").alias("op"), key.cast("string").alias("value")]
            entries.append(F.to_json(F.struct(*named, *([F.lit(style).alias("format")] if style else []))))
        return made.withColumn("meta", F.concat(F.lit("["), F.concat_ws(",", *entries), F.lit("]")))

    def summary(self, path: str) -> DataFrame:
        """Count, distinct count, minimum and maximum of a field."""
        self._public(path, "select")
        q = self.engine.query().select(E.count().as_("rows"), E.count_field(path).as_("filled"), E.count_distinct(path).as_("distinct"), E.min_(path).as_("minimum"), E.max_(path).as_("maximum"))
        return self.engine.dataframe(q)

    def choices(self, path: str, search: str | None = None, limit: int = 50) -> DataFrame:
        """A field's distinct values with counts, the most frequent first."""
        self._public(path, "filter")
        require(1 <= limit <= self.options.max_limit, CODE, "limit: outside of what is allowed")
        n = E.count()
        q = self.engine.query().select(E.field(path).as_("value"), n.as_("count")).where(E.not_null(path)).group_by(path).order_by(n, "desc").order_by(path).limit(limit)
        return self.engine.dataframe(q.where(E.text_match("starts_with_ci", path, search)) if search else q)


