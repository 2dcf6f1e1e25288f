"""Queries to DataFrames.

Every stored column gets a flat name made of its relation's prefix and its own name, so
nothing is ambiguous after joins; Catalyst prunes what is not read. A relation is joined
once per path, and only if an expression (or ``join``) refers to it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import expr as E
from ..domain import Association, Domain, Relation
from ..errors import SelectError, require
from ..functions import buckets, dates
from ..query import Query, Source
from ..types import INSTANTS, category, declared_type, spark_type
from .values import Typed, Values, lit_for
from .windows import add_windows, ordered

if TYPE_CHECKING:
    from ..engine import Engine


@dataclass(frozen=True)
class Compiled:
    """A query's DataFrame; positional ``names`` may repeat, so columns are c0, c1, ..."""

    frame: DataFrame
    names: tuple[str, ...]
    types: tuple[str, ...]

    @property
    def df(self) -> DataFrame:
        return self.frame.toDF(*self.names)


class Lowering:
    """One query over one domain."""

    def __init__(self, engine: Engine, domain: Domain, query: Query, previous: dict[str, Typed] | None = None):
        self.engine, self.domain, self.query, self.previous = engine, domain, query, previous or {}
        self.prefixes: dict[tuple[str, ...], str] = {}
        self.sources: dict[str, dict[str, Typed]] = {}
        self.bound: dict[Any, Typed] = {}
        self.grouped = False
        self.frame: DataFrame | None = None
        self.values = Values(self.lookup, engine.limits, query.timezone, engine.today)

    # -- names -----------------------------------------------------------------

    def lookup(self, node: Any) -> Typed | None:
        if node in self.bound:
            return self.bound[node]
        if isinstance(node, tuple):  # ('previous', column)
            require(node[1] in self.previous, "unknown_field", "the last level has no such column", field=str(node[1]))
            return self.previous[node[1]]
        if node.kind != "field" or self.grouped:
            return None
        return self.field(node.args[0])

    def field(self, path: str) -> Typed:
        head, _, tail = path.partition(".")
        if head in self.sources and tail:
            require(tail in self.sources[head], "unknown_field", "no field has this path", field=path)
            return self.sources[head][tail]
        r = self.domain.resolve(path)
        c = r.column
        if c.computed is not None:
            return self._computed(r.steps, c.name, c.type, c.computed)
        typed = Typed(F.col(self.prefixes[r.steps] + c.name), c.type, c.items, c.storage)
        last = r.associations[-1] if r.associations else None
        if last is not None and last.display_fallback and c.name == last.display_field:
            owner = F.col(self.prefixes[r.steps[:-1]] + last.dimension_key)
            return replace(typed, col=F.coalesce(typed.col, owner))
        return typed

    def _computed(self, steps: tuple[str, ...], name: str, kind: str, computed: tuple[str, Any]) -> Typed:
        style, payload = computed
        at = (lambda p: ".".join((*steps, p))) if steps else (lambda p: p)
        if style == "association_exists":
            return Typed(F.coalesce(F.col(self._marker_name(steps, payload)), F.lit(False)), "boolean")
        if style == "coalesce_fields":
            return Typed(F.coalesce(*[self.field(at(p)).col for p in payload]), kind)
        inner = Values(lambda n: self.field(at(n.args[0])) if isinstance(n, E.Node) and n.kind == "field" else None, self.engine.limits, None, self.engine.today)
        return Typed(inner.typed(payload).col, kind)

    @staticmethod
    def _marker_name(steps: tuple[str, ...], association: str) -> str:
        return "e_" + "__".join((*steps, association))

    # -- relations ---------------------------------------------------------------

    def stored(self, relation: Relation, prefix: str) -> DataFrame:
        """A relation's stored columns under a prefix."""
        if relation.values is not None:
            kinds = T.StructType([T.StructField(prefix + f, spark_type(relation.columns[f].type)) for f in relation.value_fields])
            rows = [tuple(_typed_cell(v, k.dataType) for v, k in zip(r, kinds)) for r in relation.values]
            return F.broadcast(self.engine.spark.createDataFrame(rows, kinds))  # literals of the domain document
        table = self.engine.catalog.table(relation.table)
        names = [c.name for c in relation.columns.values() if c.computed is None]
        missing = [n for n in names if n not in table.columns]
        require(not missing, "invalid_domain", "the table lacks a declared column", table=relation.table, fields=missing)
        return table.select(*[F.col(f"`{n}`").alias(prefix + n) for n in names])

    def association_where(self, frame: DataFrame, prefix: str, where: Any, columns: dict[str, Any]) -> DataFrame:
        """Constant predicates of a join, applied to its target first."""
        for name, value in (where.value if where else {}).items():
            col = F.col(prefix + name)
            kind = columns[name].type if name in columns else "string"
            if value is None:
                frame = frame.where(col.isNull())
            elif isinstance(value, list):
                require(len(value) == 2 and value[0] == "ne" and value[1][0] == "field", "invalid_domain", "unequal keys compare stored fields")
                frame = frame.where(col != F.col(prefix + value[1][1]))
            else:
                frame = frame.where(col == lit_for(value, kind))
        return frame

    def tenant_bound(self, frame: DataFrame, relation: Relation, prefix: str) -> DataFrame:
        """A joined relation with a tenant column holds the engine's tenant only."""
        if relation.tenant_field is None or self.engine.tenant is None:
            return frame
        kind = relation.columns[relation.tenant_field].type
        return frame.where(F.col(prefix + relation.tenant_field) == lit_for(self.engine.tenant, kind))

    def _join(self, steps: tuple[str, ...]) -> None:
        associations, relation = self.domain.association(".".join(steps))
        a, parent = associations[-1], self.prefixes[steps[:-1]]
        prefix = f"a{len(self.prefixes)}_"
        self.prefixes[steps] = prefix
        owner = self._owner_key(steps[:-1], a)
        target, key = self.target(a, relation, prefix)
        condition = owner == key
        for mine, theirs in a.scope:
            condition = condition & (F.col(parent + mine) == F.col(prefix + theirs))
        self.frame = self.frame.join(target, condition, a.join_type)

    def _owner_key(self, steps: tuple[str, ...], a: Association) -> Column:
        relation = self.domain.association(".".join(steps))[1] if steps else self.domain.root
        require(a.owner_key in relation.columns, "invalid_domain", "the key of the association is no field", field=a.owner_key)
        key = F.col(self.prefixes[steps] + a.owner_key)
        case = relation.columns[a.owner_key].text_case
        return key if case is None else F.upper(key) if case == "upper" else F.lower(key)

    def target(self, a: Association, relation: Relation, prefix: str) -> tuple[DataFrame, Column]:
        """An association's target with its constant predicates, through its bridge if
        it has one, and the column that equals the owner key."""
        frame = self.association_where(self.stored(relation, prefix), prefix, a.where, relation.columns)
        frame = self.tenant_bound(frame, relation, prefix)
        if a.through is None:
            return frame, F.col(prefix + a.related_key)
        t = a.through.value
        bridge = self.engine.catalog.table(t["table"])
        bridge = bridge.select(*[F.col(f"`{c}`").alias(f"{prefix}b_{c}") for c in bridge.columns])
        bridge = self.association_where(bridge, f"{prefix}b_", E._frozen(t.get("where")), {})
        target_key = F.col(prefix + a.related_key)
        if t.get("target_key_cast"):
            target_key = target_key.cast(spark_type(t["target_key_cast"]).simpleString())
        on = F.col(f"{prefix}b_{t['related_key']}") == target_key
        if t.get("through_scope_key") and t.get("target_scope_key"):
            on = on & (F.col(f"{prefix}b_{t['through_scope_key']}") == F.col(prefix + t["target_scope_key"]))
        return bridge.join(frame, on, "inner"), F.col(f"{prefix}b_{t['owner_key']}")

    def _paths(self, nodes: list[E.Node]) -> tuple[list[tuple[str, ...]], list[tuple[tuple[str, ...], str]]]:
        """The association paths, and the existence markers, that nodes refer to."""
        paths: set[tuple[str, ...]] = set()
        markers: set[tuple[tuple[str, ...], str]] = set()

        def visit(path: str) -> None:
            head, _, tail = path.partition(".")
            if tail and head in {s.alias for s in self.query.sources}:
                return
            r = self.domain.resolve(path)
            paths.update(r.steps[:k] for k in range(1, len(r.steps) + 1))
            if r.column.computed is not None:
                style, payload = r.column.computed
                if style == "association_exists":
                    markers.add((r.steps, payload))
                    return
                below = payload if style == "coalesce_fields" else E.fields_of(payload)
                for p in below:
                    visit(".".join((*r.steps, p)))

        for node in nodes:
            for path in E.fields_of(node):
                visit(path)
        for name in self.query.joins:
            self.domain.association(name)
            steps = tuple(name.split("."))
            paths.update(steps[:k] for k in range(1, len(steps) + 1))
        return sorted(paths, key=lambda s: (len(s), s)), sorted(markers)

    def _mark(self, steps: tuple[str, ...], name: str) -> None:
        """A left join with the distinct keys of an association that has rows."""
        associations, relation = self.domain.association(".".join((*steps, name)))
        a = associations[-1]
        prefix = f"m{len(self.bound)}_{len(self.frame.columns)}_"
        target, key = self.target(a, relation, prefix)
        keys = [key.alias(prefix + "k"), *[F.col(prefix + theirs).alias(f"{prefix}s{i}") for i, (_, theirs) in enumerate(a.scope)]]
        found = target.select(*keys).distinct().withColumn(self._marker_name(steps, name), F.lit(True))
        condition = self._owner_key(steps, a) == F.col(prefix + "k")
        for i, (mine, _) in enumerate(a.scope):
            condition = condition & (F.col(self.prefixes[steps] + mine) == F.col(f"{prefix}s{i}"))
        self.frame = self.frame.join(found, condition, "left").drop(prefix + "k", *[f"{prefix}s{i}" for i in range(len(a.scope))])

    def base(self, nodes: list[E.Node]) -> DataFrame:
        """The root with everything joined that ``nodes`` and the query need."""
        self.prefixes[()] = "r_"
        self.frame = self.stored(self.domain.root, "r_")
        needed = list(nodes)
        for s in self.query.sources:
            needed += [E.field(p) for p in _source_paths(s)]
        paths, markers = self._paths(needed)
        for steps in paths:
            self._join(steps)
        for steps, name in markers:
            self._mark(steps, name)
        from .sources import add_source

        for k, source in enumerate(self.query.sources):
            add_source(self, source, f"x{k}_")
        return self.frame

    # -- the query -----------------------------------------------------------------

    def compile(self) -> Compiled:
        q = self.query
        require(q.lock_mode is None, "unsupported_feature", "files have no row locks")
        q = self.query = self._with_policy(q)
        require(q.selections, "invalid_query", "the query shows nothing")
        self._check_names(q.selections)
        predicate = self._whole_predicate(q)
        used = [*q.selections, *q.groups, *[o for o, _ in q.orders], *([predicate] if predicate is not None else [])]
        for node in used:
            E.check_size(node, self.engine.limits)
        outputs = [*q.selections, *q.groups, *[o for o, _ in q.orders]]
        predicate, existence = self._existence(predicate, outputs)
        used = [*outputs, *([predicate] if predicate is not None else [])]
        self.frame = self.base(used)
        for name, wanted in existence:
            self._semi(name, wanted)
        if predicate is not None:
            require(not E.is_aggregate(predicate), "invalid_query", "rows are filtered before they are aggregated")
            self.frame = self.frame.where(self.values.column(predicate))
        self._related([n for s in q.selections for n in E.walk(s) if n.kind.startswith("related_")])
        outputs = [*q.selections, *[o for o, _ in q.orders]]
        if q.groups or any(E.is_aggregate(n) or _window_aggregates(n) for n in outputs):
            from .grouping import group

            group(self, outputs)
        windows = list(dict.fromkeys(n.bare for o in outputs for n in E.walk(o) if n.kind == "window"))
        if windows:
            self.frame, made = add_windows(self.frame, windows, self.values)
            for node, (name, kind) in made.items():
                self.bound[node] = Typed(F.col(name), kind)
        selected = [self._selected(s) for s in q.selections]
        columns = [t.col.alias(f"c{i}") for i, t in enumerate(selected)]
        keys = []
        for j, (node, direction) in enumerate(q.orders):
            name = f"o{j}"
            columns.append(self.values.column(node).alias(name))
            keys.append(self._order_key(F.col(name), node, direction))
        frame = self.frame.select(*columns)
        frame = _paged(frame, keys, q)
        frame = frame.select(*[f"c{i}" for i in range(len(selected))])
        return Compiled(frame, tuple(_name(s) for s in q.selections), tuple(t.kind for t in selected))

    def _selected(self, node: E.Node) -> Typed:
        """A selection; instants become wall time of the query's zone."""
        t = self.values.typed(node)
        if self.query.timezone and node.kind == "field" and t.kind in (*INSTANTS, "epoch_datetime"):
            return Typed(dates.shown_in_zone(t.col, t.kind, t.storage, self.query.timezone), "naive_datetime")
        if node.kind == "field" and t.kind == "epoch_datetime":
            return t
        return t

    def _order_key(self, column: Column, node: E.Node, direction: str) -> Column:
        if self.query.mode == "plain":
            return ordered(column, direction)
        # a rolled-up NULL comes first, unless the dimension's marker decides before it
        marked = any(o.kind == "grouping" and o.args == (node.bare,) for o, _ in self.query.orders)
        if marked:
            return ordered(column, direction)
        return column.asc_nulls_first() if direction == "asc" else column.desc_nulls_first()

    def _whole_predicate(self, q: Query) -> E.Node | None:
        parts = [p for p in (self.domain.required, self.engine.tenant_predicate(self.domain), *self.engine.required_predicates(self.domain), q.predicate) if p is not None]
        return None if not parts else parts[0] if len(parts) == 1 else E.all_(parts)

    def _with_policy(self, q: Query) -> Query:
        """Default and required selections, orders and groups of the domain."""
        d = self.domain
        grouped = bool(q.groups) or any(E.is_aggregate(s) for s in q.selections)
        if d.required_group_by and grouped:
            missing = [E.field(f) for f in d.required_group_by if E.field(f) not in [g.bare for g in q.groups]]
            q = replace(q, groups=(*missing, *q.groups), sets=tuple(tuple(i + len(missing) for i in s) for s in q.sets))
        if not q.selections and not grouped:
            q = replace(q, selections=tuple(map(E.field, d.default_selected)))
        keys = {g.bare for g in q.groups}
        usable = lambda f: not grouped or E.field(f) in keys
        given = {s.bare for s in q.selections}
        q = replace(q, selections=(*[E.field(f) for f in d.required_selected if usable(f) and E.field(f) not in given], *q.selections))
        asked = {o.bare for o, _ in q.orders}
        if d.required_order_by and not q.set_operations:
            q = replace(q, orders=(*[(E.field(f), way) for f, way in d.required_order_by if usable(f) and E.field(f) not in asked], *q.orders))
        return q

    @staticmethod
    def _check_names(selections: tuple[E.Node, ...]) -> None:
        seen: dict[str, E.Node] = {}
        for s in selections:
            name = _name(s)
            clash = seen.get(name)
            require(clash is None or s.alias is None and clash.alias is None, "invalid_query", "two columns of the result share a name", column=name)
            seen[name] = s

    def _existence(self, predicate: E.Node | None, outputs: list[E.Node]) -> tuple[E.Node | None, list[tuple[str, bool]]]:
        """Takes the tests of association_exists columns out of a conjunction, where the
        column is used for nothing else: they become semi- and anti-joins."""
        if predicate is None:
            return None, []
        parts = _conjuncts(predicate)
        tests = [(p, *_existence_test(p)) for p in parts]
        found: list[tuple[str, bool]] = []
        kept = []
        for node, path, wanted in tests:
            good = path is not None and "." not in path and path in self.domain.root.columns
            computed = self.domain.root.columns[path].computed if good else None
            elsewhere = [n for n in (*outputs, *[p for p in parts if p is not node]) if path in E.fields_of(n)] if good else []
            if computed is not None and computed[0] == "association_exists" and not elsewhere:
                found.append((computed[1], wanted))
            else:
                kept.append(node)
        return (None if not kept else kept[0] if len(kept) == 1 else E.all_(kept)), found

    def _semi(self, name: str, wanted: bool) -> None:
        associations, relation = self.domain.association(name)
        a, prefix = associations[-1], f"s{len(self.frame.columns)}_"
        target, key = self.target(a, relation, prefix)
        condition = self._owner_key((), a) == key
        for mine, theirs in a.scope:
            condition = condition & (F.col(self.prefixes[()] + mine) == F.col(prefix + theirs))
        self.frame = self.frame.join(target, condition, "left_semi" if wanted else "left_anti")

    def _related(self, nodes: list[E.Node]) -> None:
        from .nested import add_related

        for node in dict.fromkeys(n.bare for n in nodes):
            require(not self.query.groups, "unsupported_feature", "a collection goes with single rows, not with groups")
            add_related(self, node)


def _conjuncts(node: E.Node) -> list[E.Node]:
    return [p for n in node.args for p in _conjuncts(n)] if node.kind == "all" else [node]


def _existence_test(node: E.Node) -> tuple[str | None, bool]:
    """(path, wanted) of ``path = TRUE``, ``path = FALSE`` and their negations. An
    existence column is never NULL, so these are complements."""
    if node.kind == "not":
        path, wanted = _existence_test(node.args[0])
        return path, not wanted
    if node.kind in ("eq", "ne") and node.args[0].kind == "field" and node.args[1].kind == "literal" and isinstance(node.args[1].args[0], bool):
        return node.args[0].args[0], node.args[1].args[0] == (node.kind == "eq")
    return None, False


def _typed_cell(value: Any, kind: T.DataType) -> Any:
    import datetime as dt
    from decimal import Decimal

    if value is None:
        return None
    if isinstance(kind, T.DecimalType):
        return Decimal(str(value))
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.LongType):
        return int(value)
    if isinstance(kind, T.DateType) and isinstance(value, str):
        return dt.date.fromisoformat(value)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) and isinstance(value, str):
        return dt.datetime.fromisoformat(value)
    if isinstance(kind, T.StringType):
        return str(value)
    return value


def _name(node: E.Node) -> str:
    return node.alias or (node.args[0] if node.kind == "field" else node.kind)


def _window_aggregates(node: E.Node) -> bool:
    """Whether a window node orders or sums up aggregates, as over grouped rows."""
    return any(n.kind == "window" and any(c.kind in E.AGGREGATES for c in E.children(n)) for n in E.walk(node))


def _source_paths(s: Source) -> list[str]:
    spec = s.spec
    paths = [spec.get("owner"), spec.get("path")]
    if s.kind in ("subquery", "lateral"):
        paths += [p for p, _ in spec["on"]]
    if s.kind == "function":
        paths += [a[1] for a in spec["arguments"] if isinstance(a, (list, tuple)) and a[0] == "field"]
    return [p for p in paths if p]


def _paged(frame: DataFrame, keys: list[Column], q: Query) -> DataFrame:
    if keys:
        frame = frame.orderBy(*keys)
    if q.offset_value:
        frame = frame.offset(q.offset_value)
    return frame if q.limit_value is None else frame.limit(q.limit_value)


def compile_query(engine: Engine, domain: Domain, query: Query, previous: dict[str, Typed] | None = None) -> Compiled:
    """Members expanded, retargeting and set operations resolved, then lowered."""
    from .members import expand_members

    query = expand_members(engine, domain, query)
    if query.set_operations:
        return _set_operations(engine, domain, query)
    if query.retargeted is not None:
        return _retargeted(engine, domain, query)
    return Lowering(engine, domain, query, previous).compile()


def _set_operations(engine: Engine, domain: Domain, query: Query) -> Compiled:
    first = compile_query(engine, domain, replace(query, set_operations=(), orders=(), limit_value=None, offset_value=None))
    frame = first.frame
    for op, other in query.set_operations:
        right = compile_query(engine, domain, other)
        require(len(right.names) == len(first.names), "invalid_query", "both sides of a set operation show as many columns")
        frame = {
            "union": lambda a, b: a.union(b).distinct(),
            "union_all": lambda a, b: a.unionAll(b),
            "intersect": lambda a, b: a.intersect(b),
            "except": lambda a, b: a.subtract(b),
        }[op](frame, right.frame)
        frame = frame.toDF(*[f"c{i}" for i in range(len(first.names))])
    keys = []
    for node, direction in query.orders:
        name = _name(node)
        require(name in first.names, "invalid_query", "a set result is ordered by columns that it shows", column=name)
        keys.append(ordered(F.col(f"c{first.names.index(name)}"), direction))
    return Compiled(_paged(frame, keys, query), first.names, first.types)


def _retargeted(engine: Engine, domain: Domain, query: Query) -> Compiled:
    """Rows of an association's target whose key the context query reaches."""
    association, _, context = query.retargeted
    _, relation = domain.association(association)
    key = relation.primary_key
    reached = compile_query(engine, domain, context.replace_selections(f"{association}.{key}").join(association))
    keys = reached.frame.where(F.col("c0").isNotNull()).select(F.col("c0").alias("_reached")).distinct()
    lowering = Lowering(engine, domain.reroot(association), replace(query, retargeted=None))
    stored = lowering.stored

    def semi(relation_: Relation, prefix: str) -> DataFrame:
        frame = stored(relation_, prefix)
        return frame.join(keys, F.col(prefix + key) == F.col("_reached"), "left_semi") if prefix == "r_" else frame

    lowering.stored = semi  # type: ignore[method-assign]
    return lowering.compile()


def types_of(frame: DataFrame) -> list[str]:
    return [declared_type(f.dataType) for f in frame.schema.fields]


