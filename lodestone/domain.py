"""Domains: one root relation, its typed fields, relationships and named parts.

``Domain.parse(document)`` reads a declarative document::

    {"name": ..., "source": {"source_table", "primary_key", "columns": {field: {"type", ...}},
                             "associations": {name: {"queryable", "owner_key", "related_key", ...}}},
     "schemas": {name: {... like source; "values" instead of a table}},
     "joins": {association: {"type": left | inner | star_dimension, ...}},
     "required_filters": [...], "default_selected": [...], "query_library": {...}, ...}
"""

from __future__ import annotations

import copy
import hashlib
import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from . import expr as E
from .errors import SelectError, require
from .types import declared_type, is_numeric

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
UNIT_KINDS = ("count", "currency", "distance", "duration", "mass", "percentage", "ratio", "scalar")
BEHAVIORS = ("flow", "stock", "ratio", "rate")
MAX_BUCKETS = 50


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    items: str | None = None
    storage: str | None = None
    text_case: str | None = None
    unit: Any = None
    behavior: str | None = None
    internal: bool = False
    label: str | None = None
    computed: Any = None  # None, or (kind, payload)


@dataclass(frozen=True)
class Association:
    name: str
    queryable: str
    owner_key: str
    related_key: str
    cardinality: str
    join_type: str = "left"
    mode: str = "left"
    through: Any = None
    where: Any = None
    scope: tuple[tuple[str, str], ...] = ()
    display_field: str | None = None
    dimension_key: str | None = None
    display_fallback: bool = False
    join_strategy: str | None = None


@dataclass(frozen=True)
class Relation:
    name: str
    table: str | None
    primary_key: str
    columns: dict[str, Column]
    associations: dict[str, Association]
    values: tuple[tuple[Any, ...], ...] | None = None
    value_fields: tuple[str, ...] = ()
    tenant_field: str | None = None


@dataclass(frozen=True)
class Resolved:
    """A field path: the associations to walk, the relation at its end, the column."""

    path: str
    steps: tuple[str, ...]
    associations: tuple[Association, ...]
    relation: Relation
    column: Column


@dataclass(frozen=True)
class Domain:
    name: str
    root: Relation
    schemas: dict[str, Relation]
    required: E.Node | None = None
    default_selected: tuple[str, ...] = ()
    required_selected: tuple[str, ...] = ()
    required_order_by: tuple[tuple[str, str], ...] = ()
    required_group_by: tuple[str, ...] = ()
    redacted: frozenset[str] = frozenset()
    query_members: dict[str, Any] = field(default_factory=dict)
    query_library: dict[str, Any] = field(default_factory=dict)
    retarget: dict[str, Any] = field(default_factory=dict)
    co_domains: dict[str, Any] = field(default_factory=dict)
    filter_choices: dict[str, Any] = field(default_factory=dict)
    writes: dict[str, Any] = field(default_factory=dict)
    document: dict[str, Any] = field(default_factory=dict, compare=False)

    @property
    def primary_key(self) -> str:
        return self.root.primary_key

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(self.document, sort_keys=True, default=str).encode()).hexdigest()

    def association(self, path: str) -> tuple[tuple[Association, ...], Relation]:
        """The associations along a dotted path and the relation at its end."""
        at, found = self.root, []
        for step in path.split("."):
            a = at.associations.get(step)
            require(a is not None, "unknown_association", "no association has this name here", association=path)
            found.append(a)
            at = self.schemas[a.queryable]
        return tuple(found), at

    def resolve(self, path: str) -> Resolved:
        require(isinstance(path, str) and E.PATH.fullmatch(path), "unknown_field", "no field has this path", field=str(path))
        *steps, name = path.split(".")
        try:
            associations, relation = self.association(".".join(steps)) if steps else ((), self.root)
        except SelectError as e:
            raise SelectError("unknown_field", "no field has this path", {"field": path}) from e
        require(name in relation.columns, "unknown_field", "no field has this path", field=path)
        return Resolved(path, tuple(steps), associations, relation, relation.columns[name])

    def is_public(self, path: str) -> bool:
        r = self.resolve(path)
        return not (r.column.internal or path in self.redacted or r.column.name in self.redacted)

    def reroot(self, association: str) -> Domain:
        """The domain seen from an association's target."""
        _, relation = self.association(association)
        return Domain(self.name, relation, self.schemas, redacted=self.redacted, document=self.document | {"rerooted": association})

    @staticmethod
    def parse(document: dict[str, Any]) -> Domain:
        return _parse(document)

    @staticmethod
    def from_schema(name: str, schema: T.StructType, primary_key: str = "id") -> Domain:
        """A default domain of a table's own columns."""
        columns = {}
        for f in schema.fields:
            columns[f.name] = {"type": declared_type(f.dataType)}
            if isinstance(f.dataType, T.ArrayType):
                columns[f.name]["items"] = declared_type(f.dataType.elementType)
        return _parse({"name": name, "source": {"source_table": name, "primary_key": primary_key, "columns": columns}})

    def check_schema(self, tables: dict[str, T.StructType]) -> None:
        """Every stored column must exist in its table."""
        for relation in (self.root, *self.schemas.values()):
            if relation.table is not None and relation.table in tables:
                names = set(tables[relation.table].fieldNames())
                for c in relation.columns.values():
                    require(c.computed is not None or c.name in names, "invalid_domain", "the table lacks a declared column", table=relation.table, field=c.name)


def _object(value: Any, label: str) -> dict[str, Any]:
    require(isinstance(value, dict), "invalid_domain", f"{label}: expected an object")
    return value


def _identifier(value: Any, label: str) -> str:
    require(isinstance(value, str) and NAME.fullmatch(value), "invalid_domain", f"{label}: expected a name of letters, digits and underscores", value=str(value))
    return value


def _parse(document: dict[str, Any]) -> Domain:
    document = copy.deepcopy(_object(document, "domain"))
    name = _identifier(document.get("name"), "domain name")
    raw_schemas = _object(document.get("schemas", {}), "schemas")
    joins = _object(document.get("joins", {}), "joins")
    source = _object(document.get("source"), "source")
    require("source_table" in source, "invalid_domain", "source: names no table")
    root = _relation(name, source, raw_schemas, joins)
    schemas = {k: _relation(k, _object(v, f"schema {k}"), raw_schemas, {}) for k, v in raw_schemas.items()}
    # joins below the first level are declared inside their parents' entries
    for k, v in joins.items():
        for association in root.associations.values():
            if association.name == k and isinstance(v, dict) and v.get("joins"):
                target = association.queryable
                schemas[target] = _relation(target, raw_schemas[target], raw_schemas, v["joins"])
    required = _required(document.get("required_filters", []))
    domain = Domain(
        name=name,
        root=root,
        schemas=schemas,
        required=required,
        default_selected=tuple(document.get("default_selected", ())),
        required_selected=tuple(document.get("required_selected", ())),
        required_order_by=tuple((o, "asc") if isinstance(o, str) else (o[0], o[1]) for o in document.get("required_order_by", ())),
        required_group_by=tuple(document.get("required_group_by", ())),
        redacted=frozenset(document.get("redact_fields", ())),
        query_members=_object(document.get("query_members", {}), "query members"),
        query_library=_object(document.get("query_library", {}), "query library"),
        retarget=_object(document.get("retarget", {}), "retarget"),
        co_domains=_object(document.get("co_domains", {}), "co-domains"),
        filter_choices=_object(document.get("filter_choices", {}), "filter choices"),
        writes=_object(document.get("writes", {}), "writes"),
        document=document,
    )
    for path in (*domain.default_selected, *domain.required_selected, *domain.required_group_by, *[p for p, _ in domain.required_order_by]):
        domain.resolve(path)
    if required is not None:
        for path in E.fields_of(required):
            domain.resolve(path)
    _check_computed(domain)
    return domain


def _relation(name: str, raw: dict[str, Any], schemas: dict[str, Any], joins: dict[str, Any]) -> Relation:
    table, values = raw.get("source_table"), raw.get("values")
    require((table is None) != (values is None), "invalid_domain", f"schema {name}: rows come from source_table or from values")
    columns = {}
    raw_columns = _object(raw.get("columns"), f"columns of {name}")
    for f in raw.get("fields") or raw_columns:
        spec = _object(raw_columns.get(f), f"column {f}")
        kind = spec.get("type")
        require(isinstance(kind, str) and kind, "invalid_domain", "column: its type is not given", field=f)
        require(spec.get("storage") in (None, "naive_utc"), "invalid_domain", "column: storage is none that can be read", field=f)
        require(spec.get("text_case") in (None, "upper", "lower"), "invalid_domain", "text_case: upper or lower", field=f)
        if "unit" in spec or "behavior" in spec:
            require(is_numeric(kind), "invalid_domain", "unit: only numbers have one", field=f)
            unit = spec.get("unit")
            require(unit is None or (unit.get("kind") if isinstance(unit, dict) else unit) in UNIT_KINDS, "invalid_domain", "unit: no such kind", field=f)
            require(spec.get("behavior") in (None, *BEHAVIORS), "invalid_domain", "behavior: no such one", field=f)
        columns[_identifier(f, "field")] = Column(
            f, kind, spec.get("items"), spec.get("storage"), spec.get("text_case"), spec.get("unit"), spec.get("behavior"),
            bool(spec.get("internal")), spec.get("label"), _computed(f, spec["computed"], kind) if "computed" in spec else None,
        )
    associations = {}
    for a, spec in _object(raw.get("associations", {}), f"associations of {name}").items():
        associations[a] = _association(a, _object(spec, f"association {a}"), schemas, _object(joins.get(a, {}), f"join {a}"), raw)
    rows: tuple[tuple[Any, ...], ...] | None = None
    fields = tuple(raw.get("fields") or raw_columns)
    if values is not None:
        rows = tuple(tuple(r[f] for f in fields) if isinstance(r, dict) else tuple(r) for r in values)
        require(all(len(r) == len(fields) for r in rows), "invalid_domain", f"schema {name}: a row of values is longer or shorter than the fields")
    return Relation(name, table, raw.get("primary_key", "id"), columns, associations, rows, fields, raw.get("tenant_field"))


def _association(name: str, spec: dict[str, Any], schemas: dict[str, Any], join: dict[str, Any], owner: dict[str, Any]) -> Association:
    queryable = spec.get("queryable")
    require(queryable in schemas, "invalid_domain", f"no schema is called {queryable}")
    for key in ("owner_key", "related_key"):
        _identifier(spec.get(key), f"association {name} {key}")
    target = schemas[queryable]
    mode = str(join.get("type", "left")).lower()
    require(mode in ("left", "inner", "star_dimension"), "invalid_domain", f"join: {mode} is no kind of join")
    fallback = join.get("display_fallback")
    require(fallback is None or mode == "star_dimension" and fallback == "dimension_key", "invalid_domain", "display_fallback: belongs to star dimensions")
    scope = []
    if spec.get("source_scope_key") or spec.get("target_scope_key"):
        scope.append((_identifier(spec.get("source_scope_key"), "scope key"), _identifier(spec.get("target_scope_key"), "scope key")))
    if owner.get("tenant_field") and target.get("tenant_field") and not spec.get("through"):
        pair = (owner["tenant_field"], target["tenant_field"])
        if pair not in scope:
            scope.append(pair)
    through = spec.get("through")
    if through is not None:
        for key in ("table", "owner_key", "related_key"):
            require(isinstance(_object(through, "through").get(key), str), "invalid_domain", f"through: {key} is not given")
    cardinality = spec.get("cardinality") or ("one" if spec["related_key"] == target.get("primary_key", "id") else "many")
    require(cardinality in ("one", "many"), "invalid_domain", "cardinality: one or many")
    return Association(
        name, queryable, spec["owner_key"], spec["related_key"], cardinality, "left" if mode == "star_dimension" else mode, mode,
        E._frozen(through), E._frozen(spec.get("where")), tuple(scope), join.get("display_field", "name") if mode == "star_dimension" else None,
        join.get("dimension_key", spec["owner_key"]) if mode == "star_dimension" else None, fallback is not None, spec.get("join_strategy"),
    )


def _required(filters: Any) -> E.Node | None:
    """Filter ASTs; or [field, value], [field, None], [field, [op, value]]."""
    operators = {*E.COMPARE, *E.TEXT, *E.ARRAYS, "and", "or", "not", "in", "between", "is_null", "not_null", "json_contains"}
    nodes = []
    for f in filters:
        require(isinstance(f, (list, tuple)) and f, "invalid_domain", "required filter: expected [operator, ...] or [field, value]")
        if len(f) == 2 and f[0] not in operators:
            name, value = f
            ast = ["is_null", name] if value is None else [value[0], name, *value[1:]] if isinstance(value, (list, tuple)) else ["eq", name, value]
            nodes.append(E.parse_filter(ast))
        else:
            nodes.append(E.parse_filter(f))
    return None if not nodes else nodes[0] if len(nodes) == 1 else E.all_(nodes)


def _computed(name: str, spec: Any, kind: str) -> tuple[str, Any]:
    spec = _object(spec, f"computed column {name}")
    style = spec.get("kind")
    if style == "association_exists":
        return style, _identifier(spec.get("association"), "computed association")
    if style == "predicate":
        require(kind == "boolean", "invalid_domain", "computed predicate: its column holds truth values", field=name)
        return style, E.parse_filter(spec.get("expression"))
    if style == "coalesce_fields":
        fields = spec.get("fields")
        require(isinstance(fields, list) and len(fields) == 2 and "." in fields[0] and "." not in fields[1], "invalid_domain", "computed coalesce: an association's field, then a field of the root", field=name)
        return style, tuple(fields)
    if style == "temporal_delta":
        return "expression", E.parse_value(["days_between", ["field", spec.get("start")], ["field", spec.get("end")]])
    if style == "bucket":
        return "expression", E.parse_value(_bucket_ast(name, spec))
    require(style == "expression", "invalid_domain", f"computed column: {style} is no kind of it", field=name)
    try:
        return "expression", E.parse_value(spec.get("expression"))
    except SelectError as e:
        raise SelectError("invalid_domain", "computed value: the expression doesn't hold", {"field": name, "reason": e.message}) from e


def _bucket_ast(name: str, spec: dict[str, Any]) -> list[Any]:
    """Inclusive ranges that don't overlap, as a case expression."""
    ranges = spec.get("ranges")
    require(isinstance(ranges, list) and 0 < len(ranges) <= MAX_BUCKETS, "invalid_domain", "computed bucket: 1 to 50 ranges", field=name)
    spans = sorted((float("-inf") if r.get("min") is None else r["min"], float("inf") if r.get("max") is None else r["max"]) for r in ranges)
    require(all(a <= b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:])), "invalid_domain", "computed bucket: two ranges hold one value", field=name)
    branches: list[Any] = []
    for r in ranges:
        parts = [[op, spec["field"], r[k]] for k, op in (("min", "gte"), ("max", "lte")) if r.get(k) is not None]
        branches.append([parts[0] if len(parts) == 1 else ["and", parts], ["literal", r["label"], "string"]])
    if spec.get("otherwise") is not None:
        branches.append(["else", ["literal", spec["otherwise"], "string"]])
    return ["case", *branches]


def _check_computed(domain: Domain) -> None:
    """Computed columns of the root must resolve, be well typed and not depend on
    themselves."""
    below: dict[str, list[str]] = {}
    for c in domain.root.columns.values():
        if c.computed is None:
            continue
        kind, payload = c.computed
        if kind == "association_exists":
            found, _ = domain.association(payload)
            require(found[-1].through is None, "invalid_domain", "computed existence: the association is one step away", field=c.name)
            continue
        if kind == "coalesce_fields":
            paths = list(payload)
            require({domain.resolve(p).column.type for p in paths} == {c.type}, "invalid_domain", "computed coalesce: both fields have the column's type", field=c.name)
        else:
            paths = E.fields_of(payload)
            if kind == "predicate":
                require(not any("." in p for p in paths), "invalid_domain", "computed predicate: reads fields of the root alone", field=c.name)
            for p in paths:
                domain.resolve(p)
            if kind == "expression":
                try:
                    E.value_category(payload.args[0], lambda p: domain.resolve(p).column.type)
                except SelectError as e:
                    raise SelectError("invalid_domain", "computed value: the expression doesn't hold", {"field": c.name, "reason": e.message}) from e
        below[c.name] = [p for p in paths if "." not in p]
    state: dict[str, int] = {}

    def visit(name: str) -> None:
        if state.get(name) == 1:
            raise SelectError("invalid_domain", "computed columns: each waits for the other", {"field": name})
        if name in below and state.get(name) is None:
            state[name] = 1
            for p in below[name]:
                visit(p)
            state[name] = 2

    for name in below:
        visit(name)


def overlay(document: dict[str, Any], changes: dict[str, Any]) -> dict[str, Any]:
    """A domain document with another one merged in: objects key by key, all else
    replaced."""
    out = copy.deepcopy(document)
    for k, v in changes.items():
        out[k] = overlay(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


class Registry:
    """Domains by name."""

    def __init__(self) -> None:
        self._domains: dict[str, Domain] = {}

    def add(self, domain: Domain) -> None:
        require(domain.name not in self._domains, "invalid_domain", "another domain has this name", domain=domain.name)
        self._domains[domain.name] = domain

    def get(self, name: str) -> Domain:
        require(name in self._domains, "unknown_domain", "no domain has this name", domain=name)
        return self._domains[name]

    def names(self) -> list[str]:
        return sorted(self._domains)
