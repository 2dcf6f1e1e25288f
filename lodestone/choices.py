"""Choice sources: where the options of a field come from, and whether a value is one.

A source names a domain of the registry (or the engine's own), the fields of value and
label, filters and an order; relationships add filters that several sources share; a
binding says which source a field draws from. Options are a query like any other, so they
are filtered, searched and paged where the data is."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from . import expr as E
from .domain import Domain
from .engine import Engine
from .errors import require
from .query import Query

CODE = "invalid_choice_request"


@dataclass(frozen=True)
class ChoiceSource:
    value: str
    label: str
    domain: str | None = None
    filters: tuple[Any, ...] = ()
    relationship: str | None = None
    order_by: tuple[str, ...] = ()


@dataclass
class Choices:
    """The sources of an engine; ``bindings``: field path to source name."""

    engine: Engine
    sources: dict[str, ChoiceSource]
    relationships: dict[str, tuple[Any, ...]] = field(default_factory=dict)
    bindings: dict[str, str] = field(default_factory=dict)

    def source(self, name: str) -> ChoiceSource:
        require(name in self.sources, "choice_source_not_found", "no choice source has this name", choice_source=name)
        return self.sources[name]

    def source_of(self, path: str) -> ChoiceSource:
        require(path in self.bindings, CODE, "the field draws from no choice source", field=path)
        return self.source(self.bindings[path])

    def _over(self, source: ChoiceSource) -> tuple[Engine, Query]:
        """The source's engine and the query of all its rows."""
        domain: Domain = self.engine.registry.get(source.domain) if source.domain else self.engine.domain
        engine = self.engine if domain is self.engine.domain else Engine(self.engine.spark, domain, self.engine.catalog, registry=self.engine.registry, tenant=self.engine.tenant, limits=self.engine.limits, today=self.engine.today)
        shared: tuple[Any, ...] = ()
        if source.relationship is not None:
            require(source.relationship in self.relationships, "source_relationship_not_found", "no relationship has this name", source_relationship=source.relationship)
            shared = self.relationships[source.relationship]
        q = Query()
        for f in (*shared, *source.filters):
            q = q.where(f)
        return engine, q

    def options(self, path: str | None = None, *, source: str | None = None, search: str | None = None, limit: int = 50, offset: int = 0, filters: tuple[Any, ...] = ()) -> DataFrame:
        """(value, label) of a field's options or of a source's, one page of them."""
        require((path is None) != (source is None), CODE, "options are asked for by field or by source")
        require(isinstance(limit, int) and limit >= 1, CODE, "limit: a whole number from 1")
        require(isinstance(offset, int) and offset >= 0, CODE, "offset: a whole number from 0")
        chosen = self.source(source) if source is not None else self.source_of(str(path))
        engine, q = self._over(chosen)
        for f in filters:
            q = q.where(f)
        if search:
            q = q.where(E.text_match("text_contains_ci", chosen.label, search))
        q = q.select(E.field(chosen.value).as_("value"), E.field(chosen.label).as_("label"))
        for o in (*chosen.order_by, chosen.label, chosen.value):
            q = q.order_by(o)
        return engine.dataframe(q.limit(limit).offset(offset))

    def valid(self, path: str, value: Any) -> bool:
        """Whether a value is among the field's options, all of them."""
        chosen = self.source_of(path)
        engine, q = self._over(chosen)
        return not engine.dataframe(q.select(chosen.value).where(E.eq(chosen.value, value)).limit(1)).isEmpty()
