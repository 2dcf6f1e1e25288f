"""Domains over the sample tables, for the registered queries and tests."""

from __future__ import annotations

from functools import cached_property
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .domain import Domain, Registry
from .engine import Engine
from .sources.catalog import Catalog

TODAY = "2024-01-17"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def _columns(text: str) -> dict[str, dict[str, Any]]:
    kinds = {"i": "integer", "s": "string", "f": "double", "t": "naive_datetime", "j": "json", "b": "boolean", "d": "date", "u": "utc_datetime", "e": "epoch_datetime", "m": "decimal"}
    out = {}
    for item in text.split():
        name, kind = item.split(":")
        out[name] = {"type": "array", "items": kinds[kind[1]]} if kind[0] == "a" else {"type": kinds[kind]}
    return out


def _one(queryable: str, owner: str, related: str, **more: Any) -> dict[str, Any]:
    return {"queryable": queryable, "owner_key": owner, "related_key": related} | more


REGION = {"source_table": "region", "primary_key": "r_regionkey", "columns": _columns("r_regionkey:i r_name:s")}
NATION = {"source_table": "nation", "primary_key": "n_nationkey", "columns": _columns("n_nationkey:i n_name:s n_regionkey:i"), "associations": {"region": _one("region", "n_regionkey", "r_regionkey")}}
CUSTOMER = {
    "source_table": "customer",
    "primary_key": "c_custkey",
    "columns": _columns("c_custkey:i c_name:s c_nationkey:i c_acctbal:f c_mktsegment:s"),
    "associations": {"nation": _one("nation", "c_nationkey", "n_nationkey"), "orders": _one("orders", "c_custkey", "o_custkey", cardinality="many")},
}
SUPPLIER = {"source_table": "supplier", "primary_key": "s_suppkey", "columns": _columns("s_suppkey:i s_name:s s_nationkey:i s_acctbal:f"), "associations": {"nation": _one("nation", "s_nationkey", "n_nationkey")}}
PART = {"source_table": "part", "primary_key": "p_partkey", "columns": _columns("p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:f")}
ORDERS = {
    "source_table": "orders",
    "primary_key": "o_orderkey",
    "columns": _columns("o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:f o_orderdate:t o_orderpriority:s"),
    "associations": {"customer": _one("customer", "o_custkey", "c_custkey"), "lines": _one("lineitem", "o_orderkey", "l_orderkey", cardinality="many")},
}
LINEITEM = {
    "source_table": "lineitem",
    "primary_key": "l_linenumber",
    "columns": _columns("l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:f l_extendedprice:f l_discount:f l_tax:f l_returnflag:s l_linestatus:s l_shipdate:t"),
    "associations": {"order": _one("orders", "l_orderkey", "o_orderkey"), "part": _one("part", "l_partkey", "p_partkey"), "supplier": _one("supplier", "l_suppkey", "s_suppkey")},
}
STATUSES = {
    "values": [{"code": "F", "label": "Finished"}, {"code": "O", "label": "Open"}],
    "primary_key": "code",
    "fields": ["code", "label"],
    "columns": _columns("code:s label:s"),
}
SCHEMAS = {"region": REGION, "nation": NATION, "customer": CUSTOMER, "supplier": SUPPLIER, "part": PART, "orders": ORDERS, "lineitem": LINEITEM, "statuses": STATUSES}


def _computed(type_: str, **spec: Any) -> dict[str, Any]:
    return {"type": type_, "computed": spec}


def lines_document() -> dict[str, Any]:
    return {"name": "lines", "source": LINEITEM | {"primary_key": "l_orderkey"}, "schemas": SCHEMAS}


def orders_document() -> dict[str, Any]:
    columns = ORDERS["columns"] | {
        "has_lines": _computed("boolean", kind="association_exists", association="lines"),
        "is_large": _computed("boolean", kind="predicate", expression=["gte", "o_totalprice", 150000]),
        "size_band": _computed("string", kind="bucket", field="o_totalprice", ranges=[{"max": 50000, "label": "small"}, {"min": 50000.01, "max": 150000, "label": "medium"}], otherwise="large"),
        "customer_label": _computed("string", kind="expression", expression=["coalesce", ["field", "customer.c_name"], ["literal", "nobody", "string"]]),
    }
    associations = ORDERS["associations"] | {
        "status": _one("statuses", "o_orderstatus", "code"),
        "returned_lines": _one("lineitem", "o_orderkey", "l_orderkey", cardinality="many", where={"l_returnflag": "R"}),
        "big_lines": _one("lineitem", "o_orderkey", "l_orderkey", cardinality="many", where={"l_returnflag": "A", "l_linestatus": "F"}),
        "active_customer": _one("customer", "o_custkey", "c_custkey"),
        "suppliers": _one("supplier", "o_orderkey", "s_suppkey", cardinality="many", through={"table": "lineitem", "owner_key": "l_orderkey", "related_key": "l_suppkey"}),
    }
    joins = {
        "status": {"type": "star_dimension", "display_field": "label", "dimension_key": "o_orderstatus", "display_fallback": "dimension_key"},
        "active_customer": {"type": "inner"},
    }
    library = {
        "segments": {
            "open": {"filters": [["eq", "o_orderstatus", "O"]]},
            "finished": {"filters": [["eq", "o_orderstatus", "F"]]},
            "at_least": {"filters": [["gte", "o_totalprice", ["param", "price"]]], "parameters": {"price": {"type": "float"}}},
            "priorities": {"filters": [["csv_in", "o_orderpriority", ["param", "list"]]], "parameters": {"list": {"type": "string", "default": "1-URGENT, 2-HIGH"}}},
            "open_and_dear": {"segments": ["open"], "filters": [["gt", "o_totalprice", 200000]]},
            "not_open_nor_finished": {"segment_groups": [{"operator": "nor", "segments": ["open", "finished"]}]},
            "one_of": {"segment_groups": [{"operator": "xor", "segments": ["open", "at_least"]}]},
        },
        "projections": {"brief": {"fields": ["o_orderkey", "o_totalprice"]}, "wide": {"projections": ["brief"], "fields": ["customer.c_name"]}},
        "orderings": {"dear_first": [["o_totalprice", "desc"], ["o_orderkey", "asc"]]},
        "views": {"dear_open": {"segments": ["open_and_dear"], "projection": "wide", "ordering": "dear_first"}},
    }
    members = {
        "ctes": {"spend": {"query": {"select": ["o_custkey", {"as": "spent", "aggregate": "sum", "field": "o_totalprice"}], "group_by": ["o_custkey"]}, "columns": ["custkey", "spent"], "join": {"owner": "o_custkey", "related": "custkey", "type": "inner"}}},
        "values": {"weights": {"rows": [["F", 1], ["O", 2]], "columns": ["code", "weight"], "join": {"owner": "o_orderstatus", "related": "code", "type": "left"}}},
    }
    return {
        "name": "orders",
        "source": ORDERS | {"columns": columns, "associations": associations},
        "schemas": SCHEMAS,
        "joins": joins,
        "query_library": library,
        "query_members": members,
        "co_domains": {"people": {"value": "o_custkey", "label": "customer.c_name"}},
    }


def customers_document() -> dict[str, Any]:
    columns = CUSTOMER["columns"] | {
        "has_orders": _computed("boolean", kind="association_exists", association="orders"),
        "in_debt": _computed("boolean", kind="predicate", expression=["lt", "c_acctbal", 0]),
    }
    return {"name": "customers", "source": CUSTOMER | {"columns": columns}, "schemas": SCHEMAS}


def parts_document() -> dict[str, Any]:
    suppliers = _one("supplier", "p_partkey", "s_suppkey", cardinality="many", through={"table": "lineitem", "owner_key": "l_partkey", "related_key": "l_suppkey", "where": {"l_returnflag": "R"}})
    return {"name": "parts", "source": PART | {"associations": {"suppliers": suppliers}}, "schemas": SCHEMAS}


def events_document() -> dict[str, Any]:
    columns = _columns("event_id:i ts:t user_id:i event_type:s value:f props:j day:d late_day:d active:b score:f tags:as items:j epoch:e amount:m stamp:u")
    columns["gap_days"] = _computed("integer", kind="temporal_delta", start="day", end="late_day")
    return {"name": "events", "source": {"source_table": "events_more", "primary_key": "event_id", "columns": columns}}


def tree_document() -> dict[str, Any]:
    return {"name": "tree", "source": {"source_table": "tree", "primary_key": "id", "columns": _columns("id:i parent_id:i name:s")}}


def documents_document() -> dict[str, Any]:
    return {"name": "texts", "source": {"source_table": "documents", "primary_key": "doc_id", "columns": _columns("doc_id:i text:s lang:s source:s n_chars:i")}}


def events_more(spark: SparkSession, folder: str):
    """events with derived columns that hold NULLs, arrays, JSON arrays, dates."""
    e = spark.read.parquet(f"{folder}/events.parquet")
    k = F.col("event_id")
    return e.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        "props",
        F.to_date("ts").alias("day"),
        F.date_add(F.to_date("ts"), (k % 9).cast("int")).alias("late_day"),
        F.when(k % 5 == 0, None).otherwise(k % 2 == 0).alias("active"),
        F.when(k % 7 == 0, None).otherwise(F.col("value")).alias("score"),
        F.when(k % 11 == 0, None).otherwise(F.array(F.col("event_type"), F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")))).alias("tags"),
        F.concat(F.lit('[{"sku":"a'), (k % 4).cast("string"), F.lit('","n":'), (k % 3).cast("string"), F.lit('},{"sku":"b","n":2}]')).alias("items"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch"),
        (k * F.lit(1).cast("decimal(10,0)") / 100).cast("decimal(18,2)").alias("amount"),
        F.col("ts").cast("timestamp").alias("stamp"),
    )


def tree(spark: SparkSession, folder: str):
    """A hierarchy made of nations: node k hangs under (k - 1) / 3."""
    n = spark.read.parquet(f"{folder}/nation.parquet")
    k = F.col("n_nationkey").cast("long")
    return n.select(k.alias("id"), F.when(k > 0, F.floor((k - 1) / 3)).alias("parent_id"), F.col("n_name").alias("name"))


class Site:
    """Engines over the sample tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.catalog = Catalog.parquet(spark, folder, *TABLES).add("events_more", lambda: events_more(spark, folder)).add("tree", lambda: tree(spark, folder))
        self.registry = Registry()

    def engine(self, document: dict[str, Any], **options: Any) -> Engine:
        return Engine(self.spark, Domain.parse(document), self.catalog, registry=self.registry, today=TODAY, **options)

    @cached_property
    def lines(self) -> Engine:
        return self.engine(lines_document())

    @cached_property
    def orders(self) -> Engine:
        return self.engine(orders_document())

    @cached_property
    def customers(self) -> Engine:
        return self.engine(customers_document())

    @cached_property
    def parts(self) -> Engine:
        return self.engine(parts_document())

    @cached_property
    def events(self) -> Engine:
        return self.engine(events_document())

    @cached_property
    def tree(self) -> Engine:
        return self.engine(tree_document())

    @cached_property
    def texts(self) -> Engine:
        return self.engine(documents_document())
