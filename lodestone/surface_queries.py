"""Registered queries of the surfaces: sinks, streams, catalogs, naming, refusals, writes,
search. Results that are no DataFrame (bytes, iterators, codes) are shown as one."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable
from typing import Any
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import expr as E
from . import library, sinks
from .api import Api, Options
from .choices import Choices, ChoiceSource
from .domain import Domain, Registry, overlay
from .engine import Engine
from .errors import SelectError
from .forms import field_states
from .functions import shortcuts, text
from .limits import Limits
from .operators import analytics
from .operators.actions import Actions, Grant
from .operators.rules import apply_rules
from .operators.writes import Writer, write_graph
from .query import Query
from .remote import RemoteReads, openapi
from .sample_domains import Site, customers_document, events_document, orders_document
from .sources import csv_import
from .sources.catalog import Catalog
from .streaming.cursor import Bounded, Stream

Run = Callable[[Site], DataFrame]
_FOUND: dict[str, tuple[Run, str]] = {}


def _add(name: str, run: Run, sql: str) -> None:
    assert name not in _FOUND, name
    _FOUND[name] = (run, sql)


def _shown(s: Site, rows: list[Any], schema: str) -> DataFrame:
    return s.spark.createDataFrame(rows, schema)


def _code(call: Callable[[], Any]) -> str:
    try:
        call()
    except SelectError as e:
        return e.code
    return "accepted"


def _refusals(name: str, cases: Callable[[Site], dict[str, Callable[[], Any]]], codes: dict[str, str]) -> None:
    """A table of (case, code), held against the codes that are promised."""
    values = ", ".join(f"('{case}', '{code}')" for case, code in codes.items())
    _add(name, lambda s: _shown(s, [(case, _code(call)) for case, call in cases(s).items()], "case string, code string"), f'SELECT * FROM (VALUES {values}) v("case", code)')


# -- catalogs and naming ---------------------------------------------------------------


def _session_table(s: Site) -> DataFrame:
    s.catalog.table("nation").createOrReplaceTempView("session_nation")
    catalog = Catalog.tables(s.spark, "session_nation")
    engine = Engine(s.spark, catalog.default_domain("session_nation", "n_nationkey"), catalog)
    return engine.dataframe(Query().select("n_nationkey", "n_name").where(["gt", "n_nationkey", 3]))


def _introspected(s: Site) -> DataFrame:
    domain = s.catalog.default_domain("customer", "c_custkey")
    return _shown(s, [(name, c.type) for name, c in domain.root.columns.items()], "name string, type string")


def _names(s: Site) -> DataFrame:
    q = Query().select("o_orderstatus", E.count(), E.sum_("o_totalprice"), E.max_("o_orderkey").as_("last")).group_by("o_orderstatus")
    return _shown(s, list(enumerate(s.orders.compile(q).names)), "place int, name string")


def _overlaid(s: Site) -> DataFrame:
    more = {"source": {"columns": {"dear": {"type": "boolean", "computed": {"kind": "predicate", "expression": ["gte", "o_totalprice", 250000]}}}}}
    registry = Registry()
    registry.add(Domain.parse(overlay(orders_document(), more)))
    engine = Engine(s.spark, registry.get("orders"), s.catalog, registry=registry)
    return engine.dataframe(Query().select("o_orderkey", "dear"))


_add("catalog_session_table", _session_table, "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 3")
_add("catalog_introspection", _introspected, "SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'integer' WHEN 'INTEGER' THEN 'integer' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END AS type FROM (DESCRIBE customer)")
_add("result_names", _names, "SELECT * FROM (VALUES (0, 'o_orderstatus'), (1, 'count'), (2, 'sum'), (3, 'last')) v(place, name)")
_add("domain_overlay", _overlaid, "SELECT o_orderkey, o_totalprice >= 250000 AS dear FROM orders")


# -- sinks and streams -------------------------------------------------------------------


def _few_customers() -> Query:
    return Query().select("c_custkey", "c_name", "c_acctbal").where(["lt", "c_custkey", 200]).order_by("c_custkey")


def _sheet(s: Site) -> DataFrame:
    """The rows of a workbook, read back from its bytes."""
    book = zipfile.ZipFile(io.BytesIO(sinks.xlsx(s.customers.all(_few_customers()))))
    root = ElementTree.fromstring(book.read("xl/worksheets/sheet1.xml"))
    rows = [["".join(cell.itertext()) for cell in row] for row in root.iter() if row.tag.endswith("}row")]
    return _shown(s, [(int(r[0]), r[1], float(r[2])) for r in rows[1:]], "c_custkey long, c_name string, c_acctbal double")


def _streamed(s: Site) -> DataFrame:
    with Stream(s.customers.compile(_few_customers())) as stream:
        rows = stream.fetch(7) + list(stream)
    return _shown(s, rows, "c_custkey long, c_name string, c_acctbal double")


_FEW = "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey < 200"
_add("sink_rows", lambda s: _shown(s, s.customers.all(_few_customers())["rows"], "c_custkey long, c_name string, c_acctbal double"), _FEW)
_add("sink_xlsx", _sheet, _FEW)
_add("sink_encoded", lambda s: _shown(s, [tuple(r) for r in json.loads(sinks.encode(s.customers.all(Query().select("c_custkey", "c_name").where(["lt", "c_custkey", 200]))))["rows"]], "c_custkey long, c_name string"), "SELECT c_custkey, c_name FROM customer WHERE c_custkey < 200")
_add("stream_rows", _streamed, _FEW)
_add("stream_bounded", lambda s: _shown(s, Bounded(s.customers, max_rows=200, seconds=600).all(_few_customers())["rows"], "c_custkey long, c_name string, c_acctbal double"), _FEW)
_refusals(
    "stream_refusals",
    lambda s: {
        "rows": lambda: Bounded(s.customers, max_rows=3).all(_few_customers()),
        "cells": lambda: Bounded(s.customers, max_rows=500, max_cells=20).all(_few_customers()),
        "bytes": lambda: Bounded(s.customers, max_rows=500, max_bytes=50).all(_few_customers()),
        "fetch": lambda: Stream(s.customers.compile(_few_customers())).fetch(0),
    },
    {"rows": "result_limit_exceeded", "cells": "result_limit_exceeded", "bytes": "result_limit_exceeded", "fetch": "invalid_query"},
)

# -- requests ------------------------------------------------------------------------------


def _conditional(s: Site) -> DataFrame:
    """One of two fields, by whether a third is NULL."""
    document = events_document()
    document["source"]["columns"]["kind"] = {"type": "string", "computed": {"kind": "expression", "expression": ["concat", ["literal", "no ", "string"], ["field", "event_type"]]}}
    document["filter_choices"] = {"what": {"conditional": {"when_field": "score", "present_field": "event_type", "absent_field": "kind"}, "choices": [{"value": "click"}, {"value": "no view"}]}}
    api = Api(s.engine(document))
    q = api.query({"select": ["event_id"], "filters": [{"field": "what", "op": "in", "value": ["click", "no view"]}]})
    return api.engine.dataframe(q.limit(None).offset(None))


def _lists(s: Site, query: Query, column: str, shape: str, show: Callable[[Any], Any]) -> DataFrame:
    made = s.orders.dataframe(query)
    items = F.from_json(F.col(f"`{column}`"), f"array<struct<{shape}>>")
    return made.select("o_orderkey", F.array_join(F.transform(items, show), ",").alias("items"))


def _subtable(s: Site) -> DataFrame:
    q = Api(s.orders).query({"select": ["o_orderkey", [{"field": "lines.l_linenumber", "alias": "line"}]]})
    return _lists(s, q.limit(None).offset(None), "lines", "line: int", lambda x: x["line"].cast("string"))


def _to_one(s: Site) -> DataFrame:
    q = Query().select("o_orderkey", E.related_rows("customer", ["c_name", "c_mktsegment"]).as_("who"))
    return _lists(s, q, "who", "c_name: string, c_mktsegment: string", lambda x: F.concat_ws(":", x["c_name"], x["c_mktsegment"]))


_add("api_conditional_choice", _conditional, "SELECT event_id FROM events WHERE CASE WHEN event_id % 7 = 0 THEN event_type = 'view' ELSE event_type = 'click' END")
_add("api_subtable", _subtable, "SELECT o_orderkey, coalesce(string_agg(l_linenumber, ',' ORDER BY l_linenumber), '') AS items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
_add("related_rows_to_one", _to_one, "SELECT o_orderkey, coalesce(c_name || ':' || c_mktsegment, '') AS items FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
_add("api_resource", lambda s: _shown(s, [tuple(Api(s.orders).resource(7, ["o_orderkey", "o_orderstatus", "customer.c_name"]).values())], "o_orderkey long, o_orderstatus string, c_name string"), "SELECT o_orderkey, o_orderstatus, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderkey = 7")
_add("count_query", lambda s: _shown(s, [(s.orders.count(Query().select("o_orderkey").where(["eq", "o_orderstatus", "O"]).order_by("o_orderkey").limit(5)),)], "n long"), "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
_add("lookup_entries", lambda s: _shown(s, [(r["value"], r["label"]) for r in library.lookup(_people(s), "people", "customer", limit=25)], "value long, label string"), "SELECT c_custkey AS value, c_name AS label FROM customer ORDER BY c_name, c_custkey LIMIT 25")


def _people(s: Site) -> Engine:
    return s.engine(customers_document() | {"co_domains": {"people": {"value": "c_custkey", "label": "c_name"}}})


def _set_order(s: Site) -> DataFrame:
    """The grouping sets of rollup, cube and sets, in the order in which they count."""
    made = {"rollup": Query().group_by_rollup("a", "b"), "cube": Query().group_by_cube("a", "b"), "sets": Query().group_by_grouping_sets(["a", "b"], [[1], [0, 1], []])}
    rows = [(kind, place, ",".join(map(str, positions))) for kind, q in made.items() for place, positions in enumerate(q.grouping_positions())]
    return _shown(s, rows, "kind string, place int, positions string")


_add("grouping_order", _set_order, "SELECT * FROM (VALUES ('rollup', 0, '0,1'), ('rollup', 1, '0'), ('rollup', 2, ''), ('cube', 0, '0,1'), ('cube', 1, '0'), ('cube', 2, '1'), ('cube', 3, ''), ('sets', 0, '1'), ('sets', 1, '0,1'), ('sets', 2, '')) v(kind, place, positions)")


# -- explorers and choices -------------------------------------------------------------------

_BY_PRIORITY: dict[str, Any] = {"select": ["o_orderpriority", {"aggregate": "count", "alias": "n"}], "group_by": ["o_orderpriority"]}
_LARGE: dict[str, Any] = {"select": ["o_orderkey", "o_totalprice"], "filters": [{"field": "o_totalprice", "op": "gt", "value": 150000}]}


def _explorer(s: Site) -> Api:
    return Api(s.orders, Options(explorer=True))


def _choices(s: Site) -> Choices:
    registry = Registry()
    registry.add(Domain.parse(customers_document()))
    engine = Engine(s.spark, Domain.parse(orders_document()), s.catalog, registry=registry)
    source = ChoiceSource("c_custkey", "c_name", "customers", (["eq", "c_mktsegment", "BUILDING"],), "solvent")
    return Choices(engine, {"buyers": source}, {"solvent": (["gte", "c_acctbal", 0],)}, {"o_custkey": "buyers"})


_BUYERS = "FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0"
_add("explorer_order_by_aggregate", lambda s: s.orders.dataframe(_explorer(s).query(_BY_PRIORITY | {"order_by": [{"column": "n", "direction": "desc"}], "limit": 3})), "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC LIMIT 3")
_add("explorer_exact_count", lambda s: _shown(s, [("rows", _explorer(s).exact_count(_LARGE)), ("groups", _explorer(s).exact_count(_BY_PRIORITY))], "what string, n long"), "SELECT 'rows' AS what, count(*) AS n FROM orders WHERE o_totalprice > 150000 UNION ALL SELECT 'groups', count(DISTINCT o_orderpriority) FROM orders")
_add("explorer_export", lambda s: Api(s.orders, Options(explorer=True, max_export_rows=10_000_000)).export(_LARGE), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000")
_add("explorer_row_meta", lambda s: _explorer(s).row_meta({"select": [{"group": "year"}, "o_orderstatus", {"aggregate": "count", "alias": "n"}], "group_by": [{"field": "o_orderdate", "alias": "year", "format": "year"}, "o_orderstatus"]}), """SELECT strftime(o_orderdate, '%Y') AS year, o_orderstatus, count(*) AS n, '[{"field":"o_orderdate","op":"eq","value":"' || strftime(o_orderdate, '%Y') || '","format":"year"},{"field":"o_orderstatus","op":"eq","value":"' || o_orderstatus || '"}]' AS meta FROM orders GROUP BY 1, 2""")
_add("choice_options", lambda s: _choices(s).options("o_custkey", search="customer#", limit=30, offset=5), f"SELECT c_custkey AS value, c_name AS label {_BUYERS} AND contains(lower(c_name), 'customer#') ORDER BY c_name, c_custkey LIMIT 30 OFFSET 5")
_add("choice_validity", lambda s: _shown(s, [(k, _choices(s).valid("o_custkey", k)) for k in range(1, 6)], "value int, valid boolean"), f"SELECT CAST(k AS INTEGER) AS value, k IN (SELECT c_custkey {_BUYERS}) AS valid FROM range(1, 6) t(k)")
_refusals(
    "explorer_refusals",
    lambda s: {
        "count": lambda: Api(s.orders, Options(explorer=True, max_count_rows=10)).exact_count(_LARGE),
        "export": lambda: Api(s.orders, Options(explorer=True, max_export_rows=10)).export(_LARGE),
        "column": lambda: _explorer(s).query(_BY_PRIORITY | {"order_by": [{"column": "m"}]}),
        "source": lambda: _choices(s).options(source="gone"),
        "field": lambda: _choices(s).options("o_orderkey"),
    },
    {"count": "count_unavailable", "export": "export_limit_exceeded", "column": "invalid_api_query", "source": "choice_source_not_found", "field": "invalid_choice_request"},
)


def _hidden(s: Site) -> dict[str, Callable[[], Any]]:
    api = Api(s.engine(overlay(orders_document(), {"redact_fields": ["o_totalprice"]})))
    bodies: dict[str, dict[str, Any]] = {
        "select": {"select": ["o_totalprice"]},
        "filter": {"select": ["o_orderkey"], "filters": [{"field": "o_totalprice", "op": "gt", "value": 1}]},
        "order": {"select": ["o_orderkey"], "order_by": [{"field": "o_totalprice"}]},
        "aggregate": {"select": [{"aggregate": "sum", "field": "o_totalprice", "alias": "n"}]},
        "shown": {"select": ["o_orderkey"]},
    }
    return {name: lambda body=body: api.query(body) for name, body in bodies.items()}


_refusals("public_fields", _hidden, dict.fromkeys(("select", "filter", "order", "aggregate"), "field_not_public") | {"shown": "accepted"})
_refusals(
    "row_locks",
    lambda s: {"update": lambda: s.orders.dataframe(Query().select("o_orderkey").lock("update")), "share": lambda: s.orders.dataframe(Query().select("o_orderkey").lock("share"))},
    {"update": "unsupported_feature", "share": "unsupported_feature"},
)
_refusals(
    "ceilings",
    lambda s: {
        "filter values": lambda: E.parse_filter(["in", "a", list(range(101))], Limits(max_filter_values=100)),
        "depth": lambda: E.parse_filter(["not", ["not", ["not", ["is_null", "a"]]]], Limits(max_expression_depth=2)),
        "fan-out": lambda: E.parse_filter(["and", [["is_null", "a"]] * 5], Limits(max_expression_arity=4)),
        "collection": lambda: Api(Engine(s.spark, s.orders.domain, s.catalog, limits=Limits(max_collection_rows=1))).run({"select": ["o_orderkey", ["lines.l_linenumber"]], "limit": 50}),
        "unknown": lambda: Limits(max_fun=1),
        "levels": lambda: Api(s.orders, Options(explorer=True, max_limit=3, default_limit=3)).levels({"select": ["o_orderstatus", "o_orderpriority", {"aggregate": "count", "alias": "n"}], "group_by": ["o_orderstatus", "o_orderpriority"]}),
    },
    {"filter values": "invalid_query", "depth": "invalid_query", "fan-out": "invalid_query", "collection": "result_limit_exceeded", "unknown": "invalid_limits", "levels": "result_limit_exceeded"},
)


def _day_starts(s: Site) -> DataFrame:
    days = {"2024-03-10": "America/New_York", "2024-07-01": "America/New_York", "2018-11-04": "America/Sao_Paulo", "2024-02-29": "UTC"}
    return _shown(s, [(day, zone, int(shortcuts.day_start_instant(day, zone).timestamp())) for day, zone in days.items()], "day string, zone string, epoch long")


_add("day_starts", _day_starts, "SELECT day, zone, CAST(epoch(CAST(moment AS TIMESTAMP)) AS BIGINT) AS epoch FROM (VALUES ('2024-03-10', 'America/New_York', '2024-03-10 05:00:00'), ('2024-07-01', 'America/New_York', '2024-07-01 04:00:00'), ('2018-11-04', 'America/Sao_Paulo', '2018-11-04 03:00:00'), ('2024-02-29', 'UTC', '2024-02-29 00:00:00')) v(day, zone, moment)")


def _units(s: Site) -> DataFrame:
    asked = [("percent_change", "currency", None), ("percentage_point_change", "percentage", None), ("percentage_point_change", "count", None), ("cumulative", "count", "flow"), ("cumulative", "count", "stock"), ("z_score", "count", None)]
    rows = [(t, unit, behavior, analytics.result_unit(t, unit, behavior)["kind"] if analytics.allows(t, unit, behavior) else None) for t, unit, behavior in asked]
    return _shown(s, rows, "transform string, unit string, behavior string, result string")


_add("analytics_units", _units, "SELECT * FROM (VALUES ('percent_change', 'currency', NULL, 'percentage'), ('percentage_point_change', 'percentage', NULL, 'percentage'), ('percentage_point_change', 'count', NULL, NULL), ('cumulative', 'count', 'flow', 'count'), ('cumulative', 'count', 'stock', NULL), ('z_score', 'count', NULL, 'scalar')) v(transform, unit, behavior, result)")

# -- imports, rules, writes ------------------------------------------------------------------


def _csv(s: Site) -> DataFrame:
    """A CSV file's bytes, inspected, mapped and previewed."""
    suppliers = s.catalog.table("supplier").where("s_suppkey < 90").orderBy("s_suppkey").collect()
    content = "Key;Name\r\n" + "".join(f'{r["s_suppkey"] * 2};" {r["s_name"]}"\r\n' for r in suppliers)
    found = csv_import.inspect_csv(content.encode(), delimiter=";")
    mapping = {"c_custkey": {"column": "Key"}, "c_name": {"column": "Name", "transforms": ["trim", "lowercase"], "required": True}}
    return csv_import.preview(csv_import.frame_of(s.spark, found), mapping, s.catalog.table("customer"), ["c_custkey"]).select("c_custkey", "c_name", "operation")


_add("import_csv", _csv, "SELECT CAST(s_suppkey * 2 AS VARCHAR) AS c_custkey, lower(s_name) AS c_name, CASE WHEN c.c_custkey IS NULL THEN 'insert' ELSE 'update' END AS operation FROM supplier LEFT JOIN customer c ON c.c_custkey = s_suppkey * 2 WHERE s_suppkey < 90")
_add(
    "pattern_rules",
    lambda s: apply_rules(
        s.catalog.table("customer").select("c_custkey", "c_name", "c_mktsegment"),
        [("name", "c_name", {"op": "text.pattern", "profile": "ascii_v1", "pattern": "Customer#[0-9]+[02468]", "match": "full"}), ("segment", "c_mktsegment", {"op": "text.pattern", "profile": "ascii_v1", "pattern": "(?:IN|ER)Y?", "match": "search"})],
    ).select("c_custkey", "rule_name", "rule_segment"),
    "SELECT c_custkey, CASE WHEN NOT regexp_full_match(c_name, 'Customer#[0-9]+[02468]') THEN 'pattern_mismatch' END AS rule_name, CASE WHEN NOT regexp_matches(c_mktsegment, '(?:IN|ER)Y?') THEN 'pattern_mismatch' END AS rule_segment FROM customer",
)


def _writer(s: Site) -> Writer:
    return Writer(s.engine(orders_document() | {"writes": {"operations": ["insert", "update", "upsert", "delete"], "fields": ["o_orderkey", "o_custkey", "o_orderstatus"], "defaults": {"o_orderstatus": "N"}}}))


_SHOWN = ["o_orderkey", "o_custkey", "o_orderstatus"]
_KEPT = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"


def _batch(s: Site) -> DataFrame:
    steps: list[tuple[str, tuple[Any, ...]]] = [
        ("insert", ([{"o_orderkey": -5, "o_custkey": 1}],)),
        ("update", ({"o_custkey": ["add", ["field", "o_custkey"], 10]}, ["eq", "o_orderkey", -5], 1)),
        ("delete", (["between", "o_orderkey", 0, 9],)),
    ]
    return _writer(s).batch(steps)[-1].table.select(*_SHOWN)


def _graph(s: Site) -> DataFrame:
    made = write_graph([(_writer(s), "insert", lambda _: ([{"o_orderkey": -7, "o_custkey": 2}],)), (_writer(s), "insert", lambda done: ([{"o_orderkey": -8, "o_custkey": done[0].returning.first()["o_orderkey"]}],))])
    return made[0].returning.unionByName(made[1].returning).select(*_SHOWN)


_add("write_insert", lambda s: _writer(s).insert([{"o_orderkey": -1, "o_custkey": 4}, {"o_orderkey": -2, "o_orderstatus": "X"}]).table.select(*_SHOWN), f"{_KEPT} UNION ALL VALUES (-1, 4, 'N'), (-2, NULL, 'X')")
_add("write_batch", _batch, f"{_KEPT} WHERE o_orderkey NOT BETWEEN 0 AND 9 UNION ALL VALUES (-5, 11, 'N')")
_add("write_owned", lambda s: _writer(s).sync_owned({"o_custkey": 3}, [{"o_orderkey": -11}, {"o_orderkey": -12, "o_orderstatus": "Y"}], ["o_orderkey"])[-1].table.select(*_SHOWN), f"{_KEPT} WHERE o_custkey <> 3 UNION ALL VALUES (-11, 3, 'N'), (-12, 3, 'Y')")
_add("write_graph", _graph, "SELECT * FROM (VALUES (-7, 2, 'N'), (-8, -7, 'N')) v(o_orderkey, o_custkey, o_orderstatus)")
_refusals(
    "write_refusals",
    lambda s: {
        "cardinality": lambda: _writer(s).update({"o_orderstatus": "X"}, ["lt", "o_orderkey", 10], expected_count=3),
        "field": lambda: _writer(s).update({"o_totalprice": 1}, ["eq", "o_orderkey", 1]),
        "operation": lambda: Writer(s.orders).delete(["eq", "o_orderkey", 1]),
        "duplicate": lambda: _writer(s).insert([{"o_orderkey": 1}]),
        "twice": lambda: _writer(s).insert([{"o_orderkey": -1}, {"o_orderkey": -1}]),
    },
    {"cardinality": "cardinality_mismatch", "field": "field_not_writable", "operation": "write_not_allowed", "duplicate": "duplicate_key", "twice": "duplicate_key"},
)

# -- actions and forms -----------------------------------------------------------------------


def _actions(s: Site) -> Actions:
    declared = {
        "close": {"set": {"o_orderstatus": "F"}, "when": ["eq", "o_orderstatus", "O"]},
        "assign": {"set": {"o_custkey": ["param", "customer"]}, "parameters": {"customer": {"type": "integer"}}},
        "void": {"set": {"o_orderstatus": "V"}, "grant": True},
    }
    document = orders_document() | {"writes": {"operations": ["update"], "fields": ["o_custkey", "o_orderstatus"]}, "actions": declared}
    return Actions(Writer(s.engine(document)))


def _acted(s: Site) -> DataFrame:
    actions = _actions(s)
    actions.run("assign", 7, {"customer": "12"})
    actions.run("void", 7, grant=Grant("void", 7))
    return actions.writer.table.select(*_SHOWN)


def _action_cases(s: Site) -> dict[str, Callable[[], Any]]:
    actions, grant = _actions(s), Grant("void", 7)
    actions.run("void", 7, grant=grant)
    return {
        "unknown": lambda: actions.run("gone", 7),
        "state": lambda: actions.run("close", 7),
        "missing": lambda: actions.run("close", -99),
        "no grant": lambda: actions.run("void", 7),
        "other grant": lambda: actions.run("void", 7, grant=Grant("void", 8)),
        "used grant": lambda: actions.run("void", 7, grant=grant),
        "parameter": lambda: actions.run("assign", 7, {"customer": "nobody"}),
    }


def _form(s: Site) -> DataFrame:
    domain = Domain.parse(overlay(orders_document(), {"redact_fields": ["o_totalprice"], "writes": {"operations": ["update"], "fields": ["o_custkey", "o_orderstatus"]}}))
    states = field_states(domain, ["o_custkey", {"field": "o_orderstatus", "mode": "read_only"}, "o_totalprice", "customer.c_name", "size_band", "o_orderkey"])
    return _shown(s, [(f["field"], f["state"], f["reason"], f["editor"]) for f in states], "field string, state string, reason string, editor string")


_add("action_runs", _acted, "SELECT o_orderkey, CASE WHEN o_orderkey = 7 THEN 12 ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey = 7 THEN 'V' ELSE o_orderstatus END AS o_orderstatus FROM orders")
_refusals("action_refusals", _action_cases, {"unknown": "unknown_action", "state": "action_precondition_failed", "missing": "action_target_missing", "no grant": "grant_required", "other grant": "grant_required", "used grant": "grant_used", "parameter": "invalid_action_intent"})
_add("form_fields", _form, "SELECT * FROM (VALUES ('o_custkey', 'editable', NULL, 'number'), ('o_orderstatus', 'read_only', 'profile_read_only', 'text'), ('o_totalprice', 'hidden', 'field_not_public', NULL), ('customer.c_name', 'read_only', 'related_field', 'text'), ('size_band', 'read_only', 'computed_field', 'text'), ('o_orderkey', 'read_only', 'field_not_writable', 'number')) v(field, state, reason, editor)")

# -- manifests and remote reads ----------------------------------------------------------------


def _row_schema(s: Site) -> DataFrame:
    shown = openapi(Domain.parse(overlay(orders_document(), {"redact_fields": ["o_totalprice"]})), "/orders")
    key = shown["paths"]["/orders/rows/{key}"]["get"]["parameters"][0]["schema"]["type"]
    properties = shown["components"]["schemas"]["Row"]["properties"]
    return _shown(s, [("key", key), *((name, schema["type"]) for name, schema in properties.items())], "name string, type string")


def _request(reads: RemoteReads, **more: Any) -> dict[str, Any]:
    query = {"select": ["o_orderkey", "customer.c_name"], "filters": [{"field": "o_totalprice", "op": "gt", "value": 300000}], "order_by": [{"field": "o_orderkey"}], "limit": 40}
    return {"format": "lodestone.remote-read", "format_version": 1, "fingerprint": reads.fingerprint, "query": query} | more


def _remote(s: Site) -> DataFrame:
    reads = RemoteReads(Api(s.orders))
    return _shown(s, [tuple(r) for r in reads.read(_request(reads, request_id="a"))["rows"]], "o_orderkey long, name string")


def _remote_cases(s: Site) -> dict[str, Callable[[], Any]]:
    reads = RemoteReads(Api(s.orders))
    ask = lambda **more: lambda: reads.read(_request(reads, **more))
    return {
        "format": ask(format="other"),
        "version": ask(format_version=2),
        "fingerprint": ask(fingerprint="0"),
        "aggregate": ask(query={"select": [{"aggregate": "count", "alias": "n"}]}),
        "group": ask(query={"select": ["o_orderstatus"], "group_by": ["o_orderstatus"]}),
        "filter": ask(query={"select": ["o_orderkey"], "filters": [{"any": []}]}),
        "accepted": ask(),
    }


_add("openapi_row", _row_schema, "SELECT * FROM (VALUES ('key', 'integer'), ('o_orderkey', 'integer'), ('o_custkey', 'integer'), ('o_orderstatus', 'string'), ('o_orderdate', 'string'), ('o_orderpriority', 'string'), ('has_lines', 'boolean'), ('is_large', 'boolean'), ('size_band', 'string'), ('customer_label', 'string')) v(name, type)")
_add("remote_read", _remote, "SELECT o_orderkey, c_name AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 300000 ORDER BY o_orderkey LIMIT 40")
_refusals("remote_refusals", _remote_cases, {"format": "malformed_request", "version": "unsupported_protocol_version", "fingerprint": "stale_domain_fingerprint", "aggregate": "operation_unsupported", "group": "operation_unsupported", "filter": "operation_unsupported", "accepted": "accepted"})

# -- search ------------------------------------------------------------------------------------

_TOKENS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_STOPS = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
_STEM = "CASE WHEN regexp_matches(x, '[^ae]ies$') THEN x[:-4] || 'y' WHEN regexp_matches(x, '[^aeo]es$') THEN x[:-2] WHEN regexp_matches(x, '[^us]s$') THEN x[:-2] ELSE x END"
_ENGLISH = f"list_transform(list_filter({_TOKENS}, lambda x: NOT list_contains({_STOPS}, x)), lambda x: {_STEM})"


def _search(name: str, query: str, mode: str, configuration: str, sql: str) -> None:
    _add(name, lambda s: s.texts.dataframe(Query().select("doc_id").where(E.text_search(["text"], query, configuration, mode))), f"SELECT doc_id FROM documents WHERE {sql}")


_search("text_search_boolean", 'apache AND NOT "worthless" OR trash*', "boolean", "simple", f"(list_contains({_TOKENS}, 'apache') AND NOT list_contains({_TOKENS}, 'worthless')) OR len(list_filter({_TOKENS}, lambda x: starts_with(x, 'trash'))) > 0")
_search("text_search_english", "the licenses of an Apache", "plain", "english", f"list_has_all({_ENGLISH}, ['license', 'apache'])")
_search("text_search_english_phrase", "under the licenses", "phrase", "english", f"contains(' ' || array_to_string({_ENGLISH}, ' ') || ' ', ' under license ')")


def _bm25(s: Site) -> DataFrame:
    scored = text.bm25(s.catalog.table("documents").select("doc_id", "text"), ["text"], "apache licenses", configuration="english")
    return scored.where("score > 0").select("doc_id", F.round("score", 6).alias("score"))


_BM = "len(list_filter(w, lambda x: x = '{t}'))"
_add(
    "text_rank_bm25",
    _bm25,
    f"WITH d AS (SELECT doc_id, {_ENGLISH} AS w FROM documents), c AS (SELECT doc_id, len(w) AS n, {_BM.format(t='apache')} AS f0, {_BM.format(t='license')} AS f1 FROM (SELECT doc_id, coalesce(w, []) AS w FROM d)),"
    " h AS (SELECT count(*) AS r, avg(n) AS m, count(*) FILTER (WHERE f0 > 0) AS h0, count(*) FILTER (WHERE f1 > 0) AS h1 FROM c),"
    " s AS (SELECT doc_id, ln(1 + (r - h0 + 0.5) / (h0 + 0.5)) * 2.2 * f0 / (f0 + 1.2 * (0.25 + 0.75 * n / m)) + ln(1 + (r - h1 + 0.5) / (h1 + 0.5)) * 2.2 * f1 / (f1 + 1.2 * (0.25 + 0.75 * n / m)) AS score FROM c, h)"
    " SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0",
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: (lambda spark, folder, run=run: run(Site(spark, folder))) for k, (run, _) in _FOUND.items()}
ORACLES: dict[str, str] = {k: sql for k, (_, sql) in _FOUND.items()}
