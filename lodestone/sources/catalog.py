"""Where tables come from: DataFrames by name, or functions that make them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..domain import Domain
from ..errors import require

Provider = Callable[[], DataFrame]


class Catalog:
    """A registry of tables. Providers run once, when a query first reads them."""

    def __init__(self, tables: dict[str, DataFrame | Provider] | None = None):
        self._tables: dict[str, DataFrame | Provider] = dict(tables or {})

    def add(self, name: str, table: DataFrame | Provider) -> Catalog:
        require(name not in self._tables, "invalid_catalog", "another table has this name", table=name)
        self._tables[name] = table
        return self

    def table(self, name: str | None) -> DataFrame:
        require(name in self._tables, "unknown_table", "no table has this name", table=str(name))
        found = self._tables[name]
        if not isinstance(found, DataFrame):
            found = self._tables[name] = found()
        return found

    def names(self) -> list[str]:
        return sorted(self._tables)

    @staticmethod
    def parquet(spark: SparkSession, folder: str, *names: str) -> Catalog:
        """``<folder>/<name>.parquet`` for each name, read when first asked for."""
        return Catalog({n: (lambda n=n: spark.read.parquet(f"{folder}/{n}.parquet")) for n in names})

    @staticmethod
    def tables(spark: SparkSession, *names: str) -> Catalog:
        """Tables of the session's own catalog; a prefix such as ``schema.`` is part of
        the name."""
        return Catalog({n.rpartition(".")[2]: (lambda n=n: spark.table(n)) for n in names})

    # -- introspection ---------------------------------------------------------

    def schema(self, name: str) -> T.StructType:
        return self.table(name).schema

    def default_domain(self, name: str, primary_key: str = "id") -> Domain:
        return Domain.from_schema(name, self.schema(name), primary_key)

    def check(self, domain: Domain) -> None:
        """Refuse a domain whose columns its tables lack."""
        used = {r.table for r in (domain.root, *domain.schemas.values()) if r.table}
        for t in used:
            self.table(t)
        domain.check_schema({t: self.schema(t) for t in used})
