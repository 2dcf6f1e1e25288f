"""Canned pages: detail or aggregate views of one dataset with facet, range and text
controls, totals, facet counts and drill-down."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from . import expr as E
from .engine import Engine
from .errors import SelectError, require
from .plans.lower import _name
from .query import Query
from .types import category

CODE = "invalid_page"
MAX_CONTROLS, MAX_FACET_VALUES, MAX_TEXT, MAX_PAGE, MAX_LIMIT, OPTIONS = 20, 100, 4096, 100_000, 100, 30


def _number(make: Any, value: Any, what: str) -> Any:
    try:
        return make(value)
    except (TypeError, ValueError):
        raise SelectError(CODE, f"{what}: expected a number") from None


def _text(value: Any, what: str) -> str:
    require(len(str(value)) <= MAX_TEXT, CODE, f"{what}: too many characters")
    return str(value)


#: Readers of one state value, by the category of the field that it is compared with.
READERS = {
    "integer": lambda value, what: _number(int, value, what),
    "decimal": lambda value, what: _number(float, value, what),
    "boolean": lambda value, what: value in (True, 1, "1", "true"),
}


def _typed(kind: str, value: Any, what: str) -> Any:
    require(value is not None and not isinstance(value, (list, dict)), CODE, f"{what}: expected one plain value")
    return READERS.get(category(kind), _text)(value, what)


class Control:
    """What a page's visitor may set about one field: ``read`` checks a value of the
    state, ``condition`` is what it asks of the rows."""

    def __init__(self, spec: dict[str, Any], kind: str):
        self.spec, self.field, self.type = spec, spec["field"], kind

    def read(self, value: Any) -> Any:
        raise NotImplementedError

    def condition(self, value: Any) -> E.Node | None:
        raise NotImplementedError


class Facet(Control):
    """Any of some values."""

    def read(self, value: Any) -> list[Any]:
        require(isinstance(value, list) and len(value) <= MAX_FACET_VALUES, CODE, "facet: expected a list of choices, not too long", most=MAX_FACET_VALUES)
        chosen = list(dict.fromkeys(_typed(self.type, v, "choice") for v in value))
        values = self.spec.get("values", {})
        if values.get("source") == "fixed":
            strangers = set(chosen) - {o["value"] for o in values["options"]}
            require(not strangers, CODE, "facet: a choice is none of its options")
        return chosen

    def condition(self, value: list[Any]) -> E.Node | None:
        return E.in_(self.field, value) if value else None


class Range(Control):
    """From min to max, either of which may be open."""

    ENDS = {"min": E.gte, "max": E.lte}

    def read(self, value: Any) -> dict[str, Any]:
        require(isinstance(value, dict) and value.keys() <= self.ENDS.keys(), CODE, "range: expected an object of min and max")
        return {end: _typed(self.type, v, end) for end, v in value.items() if v not in (None, "")}

    def condition(self, value: dict[str, Any]) -> E.Node | None:
        return _all([test(self.field, value[end]) for end, test in self.ENDS.items() if end in value])


class Text(Control):
    """Text that the field contains; with ``multiple``, any of several parted by commas."""

    def read(self, value: Any) -> str:
        return _typed("string", value, "text")

    def condition(self, value: str) -> E.Node | None:
        wanted = [t.strip() for t in value.split(",")] if self.spec.get("multiple") else [value]
        op = "text_contains_ci" if self.spec.get("ignore_case") else "text_contains"
        tests = [E.text_match(op, self.field, t) for t in wanted if t]
        return E.any_(tests) if tests else None


CONTROLS: dict[str, type[Control]] = {"facet": Facet, "range": Range, "text": Text}


def _all(nodes: list[E.Node]) -> E.Node | None:
    return None if not nodes else nodes[0] if len(nodes) == 1 else E.all_(nodes)


@dataclass(frozen=True)
class Plan:
    state: dict[str, Any]
    view: dict[str, Any]
    query: Query
    total: Query
    facets: dict[str, Query]
    selected: dict[str, Query]


class Page:
    """views: [{id, kind: detail | aggregate, query, label?}]; controls: [{id, kind:
    facet | range | text, field, label_field?, values?: {source: dataset | fixed,
    options, limit, searchable}, ignore_case?, multiple?}]; predicate: what the dataset
    is; initial_state: {view, filters}."""

    def __init__(self, engine: Engine, views: list[dict[str, Any]], controls: list[dict[str, Any]] = (), predicate: Any = None, initial_state: dict[str, Any] | None = None):
        self.engine, self.domain = engine, engine.domain
        self.key = self.domain.primary_key
        require(views, CODE, "page: declares no views")
        require(len(controls) <= MAX_CONTROLS, CODE, "page: more controls than are allowed")
        self.views = {v["id"]: v for v in views}
        self.controls = {c["id"]: c for c in controls}
        require(len(self.controls) == len(controls) and len(self.views) == len(views), CODE, "page: an id stands there twice")
        self.readers: dict[str, Control] = {}
        for c in controls:
            require(c.get("kind") in CONTROLS, CODE, "control: no such kind", control=c["id"])
            self.readers[c["id"]] = CONTROLS[c["kind"]](c, self.domain.resolve(c["field"]).column.type)
        for v in views:
            self._check_view(v)
        self.predicate = None if predicate is None else predicate if isinstance(predicate, E.Node) else E.parse_filter(predicate)
        self.initial = {"view": views[0]["id"], "filters": {}} | (initial_state or {})

    def _check_view(self, view: dict[str, Any]) -> None:
        q: Query = view["query"]
        require(view.get("kind") in ("detail", "aggregate"), CODE, "view: detail or aggregate")
        if view["kind"] == "aggregate":
            groups = {g.bare for g in q.groups}
            for s in q.selections:  # joined filters can multiply rows; only distinct entities count right
                good = s.bare in groups or s.kind == "count_distinct" and s.args[0] == E.field(self.key)
                require(good, CODE, "view: an aggregate one shows its groups and counts of entities", column=_name(s))

    # -- state -------------------------------------------------------------------

    def normalize(self, state: dict[str, Any]) -> dict[str, Any]:
        """The state with every part checked and defaults filled in."""
        require(isinstance(state, dict), CODE, "state: expected an object")
        foreign = sorted(state.keys() - {"version", "view", "filters", "facet_search", "drilldown", "page", "limit"})
        require(not foreign, CODE, "state: keys that nothing reads", keys=foreign)
        require(state.get("version", 1) == 1, CODE, "state: of another version")
        view = state.get("view", self.initial["view"])
        require(view in self.views, CODE, "state: no view has this id")
        out = {"version": 1, "view": view, "filters": self._read_filters(state), "facet_search": self._read_searches(state)}
        if "drilldown" in state:
            out["drilldown"] = self._drilldown(state["drilldown"])
        for key, usual, most in (("page", 1, MAX_PAGE), ("limit", 25, MAX_LIMIT)):
            out[key] = state.get(key, usual)
            require(isinstance(out[key], int) and 1 <= out[key] <= most, CODE, f"{key}: a whole number from 1 to {most}")
        return out

    def _read_filters(self, state: dict[str, Any]) -> dict[str, Any]:
        given = state.get("filters", self.initial["filters"])
        require(isinstance(given, dict) and given.keys() <= self.readers.keys(), CODE, "filters: no control has this id")
        return {name: self.readers[name].read(value) for name, value in given.items()}

    def _read_searches(self, state: dict[str, Any]) -> dict[str, str]:
        given = state.get("facet_search", {})
        open_ = {name for name, c in self.controls.items() if c["kind"] == "facet" and c.get("values", {}).get("searchable")}
        require(given.keys() <= open_, CODE, "facet_search: names a facet whose options aren't searched")
        return {name: _typed("string", sought, "facet_search") for name, sought in given.items()}

    def _drilldown(self, raw: Any) -> dict[str, Any]:
        """A row of an aggregate view, by the value of each of its groups."""
        require(isinstance(raw, dict) and raw.keys() == {"view", "values"}, CODE, "drilldown: expected view and values")
        view = self.views.get(raw["view"], {})
        require(view.get("kind") == "aggregate", CODE, "drilldown: no aggregate view has this id")
        types = [self.domain.resolve(g.args[0]).column.type if g.kind == "field" else "string" for g in view["query"].groups]
        require(isinstance(raw["values"], list) and len(raw["values"]) == len(types), CODE, "drilldown: one value for each group of the view")
        return {"view": raw["view"], "values": [v if v is None else _typed(t, v, "drilldown") for t, v in zip(types, raw["values"])]}

    # -- queries -------------------------------------------------------------------

    def _predicate(self, state: dict[str, Any], without: str | None, scope: E.Node | None) -> E.Node | None:
        parts = [self.predicate, scope]
        parts += [self.readers[name].condition(value) for name, value in state["filters"].items() if name != without]
        if "drilldown" in state:
            groups = self.views[state["drilldown"]["view"]]["query"].groups
            parts += [E.is_null(g.bare) if v is None else E.eq(g.bare, v) for g, v in zip(groups, state["drilldown"]["values"])]
        return _all([p for p in parts if p is not None])

    def plan(self, state: dict[str, Any], scope: E.Node | None = None) -> Plan:
        state = self.normalize(state)
        view = self.views[state["view"]]
        template: Query = view["query"]
        predicate = self._predicate(state, None, scope)
        if view["kind"] == "detail":
            # one row an entity, though filters may join to-many relations
            plain = [E.field(p) for s in template.selections if not s.kind.startswith("related_") for p in E.fields_of(s)]
            groups = tuple(dict.fromkeys([E.field(self.key), *plain, *[o.bare for o, _ in template.orders]]))
            orders = (*template.orders, (E.field(self.key), "asc"))
            nested = any(s.kind.startswith("related_") for s in template.selections)
        else:
            groups, nested = template.groups, False
            orders = (*template.orders, *[(g.bare, "asc") for g in template.groups if g.bare not in [o.bare for o, _ in template.orders]])
        query = Query(selections=template.selections, groups=() if nested else groups, orders=orders, limit_value=state["limit"] + 1, offset_value=(state["page"] - 1) * state["limit"])
        query = query if predicate is None else query.where(predicate)
        total = Query().select(E.count_distinct(self.key).as_("total"))
        facets, chosen = {}, {}
        for name, c in self.controls.items():
            if c["kind"] == "facet":
                facets[name], chosen[name] = self._facet(name, c, state, scope)
        kept = {k: q for k, q in chosen.items() if q is not None}
        return Plan(state, view, query, total if predicate is None else total.where(predicate), facets, kept)

    def _facet(self, name: str, c: dict[str, Any], state: dict[str, Any], scope: E.Node | None) -> tuple[Query, Query | None]:
        values = c.get("values", {})
        fixed = values.get("source") == "fixed"
        others = self._predicate(state, name, scope)
        field = c["field"]
        n = E.count_distinct(self.key)
        q = Query().select(E.field(field).as_("value"))
        groups = [field]
        if c.get("label_field"):
            q, groups = q.select(E.field(c["label_field"]).as_("label")), [*groups, c["label_field"]]
        q = q.select(n.as_("count")).group_by(*groups)
        q = q if others is None else q.where(others)
        options = q.where(E.not_null(field)).order_by(n, "desc").order_by(field)
        if fixed:
            options = options.where(E.in_(field, [o["value"] for o in values["options"]]))
        else:
            options = options.limit(values.get("limit", OPTIONS) + 1)
        if state["facet_search"].get(name):
            options = options.where(E.text_match("starts_with", c.get("label_field", field), state["facet_search"][name]))
        picked = state["filters"].get(name)
        return options, q.where(E.in_(field, picked)) if picked else None

    # -- results ---------------------------------------------------------------------

    def run(self, state: dict[str, Any], scope: E.Node | None = None) -> dict[str, Any]:
        plan = self.plan(state, scope)
        found = self.engine.all(plan.query)
        total = self.engine.all(plan.total)["rows"][0][0]
        limit = plan.state["limit"]
        facets = {}
        for name, q in plan.facets.items():
            c = self.controls[name]
            facets[name] = self._options(c, self.engine.all(q)["rows"], self.engine.all(plan.selected[name])["rows"] if name in plan.selected else [], plan.state["filters"].get(name, []))
        return {
            "state": plan.state,
            "view": {k: plan.view.get(k, plan.view["id"]) for k in ("id", "kind", "label")},
            "columns": found["columns"],
            "rows": found["rows"][:limit],
            "has_more": len(found["rows"]) > limit,
            "total": total,
            "facets": facets,
        }

    @staticmethod
    def _options(c: dict[str, Any], rows: list[list[Any]], selected: list[list[Any]], picked: list[Any]) -> dict[str, Any]:
        values = c.get("values", {})
        made = [{"value": r[0], "label": r[1] if c.get("label_field") else r[0], "count": r[-1]} for r in rows]
        fixed, limit = values.get("source") == "fixed", values.get("limit", OPTIONS)
        truncated = not fixed and len(made) > limit
        if fixed:
            counts = {o["value"]: o["count"] for o in made}
            made = [{"value": o["value"], "label": o.get("label", o["value"]), "count": counts.get(o["value"], 0)} for o in values["options"]]
        elif truncated:
            made = made[:limit]
        shown = {o["value"] for o in made}
        known = {r[0]: r for r in selected}
        for v in picked:
            if v not in shown:
                r = known.get(v)
                made.append({"value": v, "label": r[1] if r and c.get("label_field") else v, "count": r[-1] if r else 0})
        return {"options": made, "truncated": truncated}


def facet_frame(page: Page, state: dict[str, Any], name: str):
    """A facet's option counts as a DataFrame."""
    return page.engine.dataframe(page.plan(state).facets[name])


def detail_frame(page: Page, state: dict[str, Any]):
    """A page's rows (one more than its limit, if there are more) as a DataFrame."""
    return page.engine.dataframe(page.plan(state).query)


