"""One domain over one catalog: compiles queries and delivers their rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import expr as E
from .domain import Domain, Registry
from .errors import require
from .limits import Limits
from .plans.lower import Compiled, compile_query
from .query import Query
from .sources.catalog import Catalog


class Engine:
    """tenant: the trusted tenant; a domain whose root has a tenant_field can't be read
    without. required: further filters that every read holds. today: an ISO date that
    stands for the current one."""

    def __init__(
        self,
        spark: SparkSession,
        domain: Domain,
        catalog: Catalog,
        *,
        limits: Limits | None = None,
        tenant: Any = None,
        required: Any = (),
        registry: Registry | None = None,
        today: str | None = None,
        table_functions: dict[str, Callable[..., Any]] | None = None,
    ):
        self.spark, self.domain, self.catalog = spark, domain, catalog
        self.limits, self.tenant, self.today = limits or Limits(), tenant, today
        self.registry = registry or Registry()
        self.table_functions = table_functions or {}
        self._required = [r if isinstance(r, E.Node) else E.parse_filter(r) for r in required]

    def query(self) -> Query:
        return Query()

    # -- scope -------------------------------------------------------------------

    def tenant_predicate(self, domain: Domain) -> E.Node | None:
        field = domain.root.tenant_field
        if field is None:
            return None
        require(self.tenant is not None, "missing_tenant_scope", "this domain is read for one tenant, and none was given", tenant_field=field)
        return E.eq(field, self.tenant)

    def required_predicates(self, domain: Domain) -> list[E.Node]:
        return self._required if domain is self.domain else []

    # -- results -----------------------------------------------------------------

    def compile(self, query: Query) -> Compiled:
        return compile_query(self, self.domain, query)

    def dataframe(self, query: Query) -> DataFrame:
        return self.compile(query).df

    def all(self, query: Query) -> dict[str, Any]:
        """{'columns': [...], 'rows': [[...]]}, within the response's cell limit."""
        compiled = self.compile(query)
        width = len(compiled.names)
        most = self.limits.get("max_total_cells") // max(width, 1)
        rows = compiled.frame.limit(most + 1).collect()
        require(len(rows) <= most, "result_limit_exceeded", "rows times columns go beyond the ceiling", limit="max_total_cells")
        return {"columns": list(compiled.names), "rows": [list(r) for r in rows]}

    def one(self, query: Query) -> dict[str, Any] | None:
        found = self.all(query.limit(1))
        return dict(zip(found["columns"], found["rows"][0])) if found["rows"] else None

    def stream(self, query: Query, prefetch: bool = True) -> Iterator[list[Any]]:
        """Rows one by one; the driver holds one partition at a time."""
        from .streaming.cursor import rows_of

        return rows_of(self.compile(query), prefetch)

    def count(self, query: Query) -> int:
        """Rows of a query without its order and page."""
        q = query.count_query()
        if not q.selections and not q.groups:
            q = q.select(self.domain.primary_key)
        return self.compile(q).frame.count()

    def projection_sum(self, query: Query, column: str) -> DataFrame:
        """COALESCE(SUM(column), 0) over a whole query, as one row ``total``."""
        compiled = self.compile(query)
        require(column in compiled.names, "unknown_field", "the query shows no such column", column=column)
        return compiled.frame.agg(F.coalesce(F.sum(f"c{compiled.names.index(column)}"), F.lit(0)).alias("total"))

    def explain(self, query: Query, mode: str = "formatted") -> str:
        frame = self.compile(query).frame
        return frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), mode)
