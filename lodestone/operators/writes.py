"""Writes as copies: each gives the table's next version as a DataFrame, and what it
changed. Nothing is stored until the caller writes that version; a file format without
transactions can promise no more."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import expr as E
from ..engine import Engine
from ..errors import SelectError, require
from ..plans.values import Typed, Values, lit_for


MUTATIONS = ("literal", "field", "current_timestamp", "default", "add", "subtract", "multiply", "divide", "coalesce", "increment", "decrement")


@dataclass(frozen=True)
class Written:
    """table: the next version; affected: rows changed; returning: these rows."""

    table: DataFrame
    affected: int
    returning: DataFrame


class Writer:
    """Writes to an engine's root relation. Its document's ``writes`` says which:
    {operations: [...], fields: [...], defaults: {...}}; without it nothing may be
    written. The tenant column is pinned to the engine's tenant."""

    def __init__(self, engine: Engine):
        self.engine, self.domain = engine, engine.domain
        self.contract = self.domain.writes
        self.table = engine.catalog.table(self.domain.root.table)

    def _allowed(self, operation: str, fields: list[str]) -> None:
        require(operation in self.contract.get("operations", ()), "write_not_allowed", "the domain declares no such write", operation=operation)
        writable = set(self.contract.get("fields", ()))
        for f in fields:
            c = self.domain.resolve(f).column
            require("." not in f and c.computed is None and f in writable, "field_not_writable", "this field is not for writing", field=f)

    def _tenant(self, row: dict[str, Any]) -> dict[str, Any]:
        field = self.domain.root.tenant_field
        if field is None:
            return row
        require(self.engine.tenant is not None, "missing_tenant_scope", "rows are written for one tenant, and none was given", tenant_field=field)
        require(row.get(field, self.engine.tenant) == self.engine.tenant, "tenant_mismatch", "the row names another tenant", tenant_field=field)
        return row | {field: self.engine.tenant}

    def _lookup(self, node: Any) -> Typed | None:
        if isinstance(node, E.Node) and node.kind == "field":
            c = self.domain.resolve(node.args[0]).column
            require("." not in node.args[0], "invalid_write", "rows to write are told by fields of the root", field=node.args[0])
            return Typed(F.col(c.name), c.type, c.items, c.storage)
        return None

    def _matching(self, predicate: Any) -> Column:
        require(predicate is not None, "invalid_write", "which rows to write is not said")
        node = predicate if isinstance(predicate, E.Node) else E.parse_filter(predicate)
        parts = [p for p in (self.domain.required, self.engine.tenant_predicate(self.domain), *self.engine.required_predicates(self.domain), node) if p is not None]
        return F.coalesce(Values(self._lookup, self.engine.limits, None, self.engine.today).column(E.all_(parts)), F.lit(False))

    def _assignment(self, field: str, value: Any) -> Column:
        """A literal, or a mutation [op, ...]."""
        c = self.domain.root.columns[field]
        kind = self.table.schema[field].dataType
        if not isinstance(value, (list, tuple)) or not value or value[0] not in MUTATIONS:
            return lit_for(value, c.type).cast(kind)
        op, *args = value
        one = lambda v: F.col(v[1]) if isinstance(v, (list, tuple)) and v[0] == "field" else self._assignment(field, v)
        if op == "field":
            require(args[0] in self.domain.root.columns, "unknown_field", "no field has this path", field=str(args[0]))
            made = F.col(args[0])
        elif op == "literal":
            made = lit_for(args[0], c.type)
        elif op == "current_timestamp":
            made = F.current_timestamp()
        elif op == "default":
            made = lit_for(self.contract.get("defaults", {}).get(field), c.type)
        elif op == "coalesce":
            made = F.coalesce(*map(one, args))
        elif op in ("increment", "decrement"):
            step = lit_for(args[0] if args else 1, c.type)
            made = F.col(field) + step if op == "increment" else F.col(field) - step
        else:
            a, b = map(one, args)
            made = {"add": lambda: a + b, "subtract": lambda: a - b, "multiply": lambda: a * b, "divide": lambda: a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))}[op]()
        return made.cast(kind)

    def _rows(self, rows: list[dict[str, Any]]) -> DataFrame:
        defaults = self.contract.get("defaults", {})
        made = [tuple((defaults | self._tenant(r)).get(f.name) for f in self.table.schema) for r in rows]
        from ..plans.lower import _typed_cell

        return self.engine.spark.createDataFrame([tuple(_typed_cell(v, f.dataType) for v, f in zip(r, self.table.schema)) for r in made], self.table.schema)

    def insert(self, rows: list[dict[str, Any]]) -> Written:
        fields = sorted({f for r in rows for f in r})
        self._allowed("insert", [f for f in fields if f != self.domain.root.tenant_field])
        new = self._rows(rows)
        self._fresh(new, len(rows))
        return Written(self.table.unionByName(new), len(rows), new)

    def _fresh(self, new: DataFrame, n: int) -> None:
        """Refuse rows whose primary key another row has, in the table or among them."""
        key = self.domain.primary_key
        if key not in new.columns:
            return
        given = new.where(F.col(key).isNotNull()).select(F.col(key).alias("_new_key"))
        require(given.distinct().count() == given.count(), "duplicate_key", "two of the rows to insert have one primary key", field=key)
        found = self.table.join(F.broadcast(given), F.col(key) == F.col("_new_key"), "left_semi").limit(1).count()
        require(not found, "duplicate_key", "a row of the table has this primary key already", field=key)

    def update(self, assignments: dict[str, Any], predicate: Any, expected_count: int | None = None) -> Written:
        self._allowed("update", sorted(assignments))
        hit = self._matching(predicate)
        changed = {f: F.when(F.col("_hit"), self._assignment(f, v)).otherwise(F.col(f)) for f, v in assignments.items()}
        marked = self.table.withColumn("_hit", hit)
        n = _guard(marked.where("_hit"), expected_count)
        after = marked.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in self.table.columns], "_hit")
        return Written(after.drop("_hit"), n, after.where("_hit").drop("_hit"))

    def delete(self, predicate: Any, expected_count: int | None = None) -> Written:
        self._allowed("delete", [])
        hit = self._matching(predicate)
        gone = self.table.where(hit)
        return Written(self.table.where(~hit), _guard(gone, expected_count), gone)

    def upsert(self, rows: list[dict[str, Any]], keys: list[str]) -> Written:
        """Rows whose keys match replace the fields that they bring; the others are
        inserted."""
        fields = sorted({f for r in rows for f in r})
        self._allowed("upsert", [f for f in fields if f != self.domain.root.tenant_field])
        require(keys and all(k in fields for k in keys), "invalid_write", "keys: given, and part of the rows")
        seen = [tuple(r.get(k) for k in keys) for r in rows]
        require(len(set(seen)) == len(seen), "invalid_write", "two of the rows have the same keys")
        new = self._rows(rows).select(*[F.col(c).alias(f"_new_{c}") for c in self.table.columns])
        tenant = self.domain.root.tenant_field
        ids = [*keys, *([tenant] if tenant and tenant not in keys else [])]
        # the rows that the caller spelled out are broadcast; the table stays where it is
        met = self.table.join(F.broadcast(new.withColumn("_given", F.lit(True))), [F.col(k) == F.col(f"_new_{k}") for k in ids], "left")
        given = F.col("_given").isNotNull()
        value = lambda c: (F.when(given, F.col(f"_new_{c}")).otherwise(F.col(c)) if c in fields else F.col(c)).alias(c)
        updated = met.select(*[value(c) for c in self.table.columns], given.alias("_given"))
        known = updated.where("_given").select(*[F.col(k).alias(f"_known_{k}") for k in ids]).distinct()  # no more than the rows given
        fresh = new.join(F.broadcast(known), [F.col(f"_new_{k}") == F.col(f"_known_{k}") for k in ids], "left_anti")
        inserted = fresh.select(*[F.col(f"_new_{c}").alias(c) for c in self.table.columns], F.lit(True).alias("_given"))
        after = updated.unionByName(inserted)
        return Written(after.drop("_given"), len(rows), after.where("_given").drop("_given"))

    def batch(self, steps: list[tuple[str, tuple[Any, ...]]]) -> list[Written]:
        """Steps (method, arguments) in order, each on the version before; a step that
        is refused refuses them all."""
        kept, done = self.table, []
        try:
            for method, arguments in steps:
                require(method in ("insert", "update", "delete", "upsert"), "invalid_write", "insert, update, delete or upsert", operation=method)
                made: Written = getattr(self, method)(*arguments)
                done.append(made)
                self.table = made.table
        except SelectError:
            self.table = kept
            raise
        return done

    def sync_owned(self, owner: dict[str, Any], rows: list[dict[str, Any]], keys: list[str]) -> list[Written]:
        """Make the rows of one owner exactly ``rows``: upsert them, delete its others."""
        given = [owner | r for r in rows]
        mine = E.all_([E.eq(k, v) for k, v in owner.items()])
        listed = [E.all_([E.eq(k, r[k]) for k in keys]) for r in given]
        others = E.all_([mine, E.not_(E.any_(listed))]) if listed else mine
        steps: list[tuple[str, tuple[Any, ...]]] = [("delete", (others,))]
        if given:
            steps.append(("upsert", (given, [*owner, *[k for k in keys if k not in owner]])))
        return self.batch(steps)


def _guard(rows: DataFrame, expected: int | None) -> int:
    n = rows.count()
    require(expected is None or n == expected, "cardinality_mismatch", "as many rows as expected were not met", expected=expected, found=n)
    return n


def write_graph(steps: list[tuple[Writer, str, Callable[[list[Written]], tuple[Any, ...]]]]) -> list[Written]:
    """Writes to several relations in order; each step's arguments are made from the
    results so far (child rows bind their parents' keys). All versions are returned
    together, so that the caller stores all or none."""
    done: list[Written] = []
    for writer, method, arguments in steps:
        done += writer.batch([(method, arguments(done))])
    return done


