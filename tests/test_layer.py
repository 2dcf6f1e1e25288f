"""The semantic layer: refusals, plans, NULL rules, zones, writes, rules, imports."""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodestone import expr as E
from lodestone import library, sinks
from lodestone.api import Api, Options
from lodestone.domain import Domain, Registry, overlay
from lodestone.engine import Engine
from lodestone.errors import SelectError
from lodestone.functions import shortcuts, text
from lodestone.limits import DEFAULTS, Limits
from lodestone.operators import analytics, rules
from lodestone.operators.writes import Writer, write_graph
from lodestone.pages import Page
from lodestone.query import Query
from lodestone.sample_domains import Site, customers_document, events_document, orders_document
from lodestone.sources.catalog import Catalog
from lodestone.sources import csv_import
from lodestone.streaming.cursor import Bounded, Stream


def code(run):
    with pytest.raises(SelectError) as e:
        run()
    return e.value.code


@pytest.fixture(scope="module")
def site(spark, small):
    return Site(spark, small)


def engine(spark, columns, rows, schema, **more):
    document = {"name": "t", "source": {"source_table": "t", "primary_key": "id", "columns": columns} | more.pop("source", {})} | more.pop("document", {})
    return Engine(spark, Domain.parse(document), Catalog({"t": spark.createDataFrame(rows, schema)} | more.pop("tables", {})), **more)


PEOPLE = {"id": {"type": "integer"}, "name": {"type": "string"}, "score": {"type": "decimal"}, "active": {"type": "boolean"}}
ROWS = [(1, "Ann", Decimal("20.25"), True), (2, "bob 50%_off", Decimal("3.5"), None), (3, None, None, False)]


@pytest.fixture(scope="module")
def people(spark):
    return engine(spark, PEOPLE, ROWS, "id long, name string, score decimal(12,4), active boolean")


# -- refusals ----------------------------------------------------------------------------


def test_codes(site):
    run = site.orders.dataframe
    assert code(lambda: run(Query().select("nope"))) == "unknown_field"
    assert code(lambda: run(Query().select("customer.nope"))) == "unknown_field"
    assert code(lambda: run(Query().select("o_orderkey").join("nope"))) == "unknown_association"
    assert code(lambda: run(Query())) == "invalid_query"
    assert code(lambda: run(Query().select("o_orderkey", E.count().as_("n")).group_by("o_custkey"))) == "invalid_query"
    assert code(lambda: run(Query().select("o_orderkey").lock("update"))) == "unsupported_feature"
    assert code(lambda: Query().select({"raw_sql": "1"})) == "raw_sql_forbidden"
    assert code(lambda: Query().select("o_orderkey; drop")) == "invalid_query"
    assert code(lambda: Query().select("a").limit(-1)) == "invalid_query"
    assert code(lambda: E.in_("a", [])) == "invalid_query"
    assert code(lambda: E.parse_filter(["like", "a", "b"])) == "invalid_query"
    assert code(lambda: E.parse_filter([])) == "invalid_query"
    assert code(lambda: E.window("median", ["a"])) == "invalid_query"
    assert code(lambda: E.window("lag", [])) == "invalid_query"
    assert code(lambda: E.datetime_format("a", "weekly")) == "invalid_query"
    assert code(lambda: E.date_shortcut("a", "someday")) == "invalid_query"
    assert code(lambda: E.text_search(["a"], "x", configuration="danish")) == "unsupported_feature"
    assert code(lambda: Query().select("a").order_by("a").union(Query().select("b"))) == "invalid_query"
    assert code(lambda: Query().group_by_cube(*"abcdefghi")) == "invalid_query"
    assert code(lambda: Query().group_by_grouping_sets(["a", "b"], [[0]])) == "invalid_query"
    assert code(lambda: Query().use_timezone("Mars/Olympus")) == "invalid_query"
    assert code(lambda: run(Query().select("o_orderkey").with_member("nope"))) == "invalid_query"


def test_value_types(site):
    run = lambda ast: site.orders.dataframe(Query().select(E.parse_value(ast).as_("x")))
    bad = "invalid_value_expression"
    assert code(lambda: run(["add", ["field", "o_orderstatus"], ["literal", 1]])) == bad
    assert code(lambda: run(["coalesce", ["field", "o_orderstatus"], ["literal", 1]])) == bad
    assert code(lambda: run(["lower", ["literal", 1]])) == bad
    assert code(lambda: run(["json_text", "o_orderstatus", ["a"]])) == bad
    assert code(lambda: run(["days_between", ["field", "o_orderdate"], ["literal", "x"]])) == bad
    assert code(lambda: E.parse_value(["literal", None])) == bad
    assert code(lambda: E.parse_value(["previous", "x"])) == bad
    assert code(lambda: E.parse_value(["sql", "1"])) == bad
    assert E.parse_value(["literal", "5"]).args[0] == ("literal", "5", "integer")
    assert E.parse_value(["literal", "5.0"]).args[0][2] == "decimal"


def test_domain_refusals():
    def parse(**source):
        base = {"source_table": "t", "columns": {"id": {"type": "integer"}, "name": {"type": "string"}}}
        return lambda: Domain.parse({"name": "t", "source": base | source})

    assert code(lambda: Domain.parse({"name": "t", "source": {"columns": {}}})) == "invalid_domain"
    assert code(parse(associations={"x": {"queryable": "gone", "owner_key": "id", "related_key": "id"}})) == "invalid_domain"
    assert code(parse(columns={"id": {"type": "integer"}, "a": {"type": "integer", "computed": {"kind": "expression", "expression": ["field", "a"]}}})) == "invalid_domain"
    assert code(parse(columns={"id": {"type": "integer"}, "a": {"type": "string", "computed": {"kind": "predicate", "expression": ["eq", "id", 1]}}})) == "invalid_domain"
    assert code(parse(columns={"name": {"type": "string", "unit": "currency"}})) == "invalid_domain"
    overlap = {"kind": "bucket", "field": "id", "ranges": [{"max": 5, "label": "a"}, {"min": 5, "label": "b"}]}
    assert code(parse(columns={"id": {"type": "integer"}, "b": {"type": "string", "computed": overlap}})) == "invalid_domain"


def test_limits():
    assert len(DEFAULTS) == 29
    assert code(lambda: Limits(nope=1)) == "invalid_limits"
    assert code(lambda: E.parse_filter(["in", "a", list(range(101))])) == "invalid_query"
    deep = ["eq", "a", 1]
    for _ in range(70):
        deep = ["not", deep]
    assert code(lambda: E.parse_filter(deep)) == "invalid_query"


# -- plans ---------------------------------------------------------------------------------


def plan(e, q):
    return e.explain(q, "simple")


def test_unused_associations_are_not_joined(site):
    assert "Join" not in plan(site.orders, Query().select("o_orderkey").where(["gt", "o_totalprice", 5]))
    assert plan(site.orders, Query().select("customer.c_name", "customer.c_acctbal")).count("Join") == 1


def test_filters_and_columns_reach_the_scan(site):
    text = site.lines.explain(Query().select("l_orderkey").where(["gt", "l_quantity", 45]))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text


def test_top_k_is_not_a_full_sort(site):
    assert "TakeOrderedAndProject" in plan(site.orders, Query().select("o_orderkey").order_by("o_totalprice", "desc").limit(5))


def test_existence_tests_are_semi_joins(site):
    q = Query().select("o_orderkey")
    assert "LeftSemi" in plan(site.orders, q.where(["eq", "has_lines", True]))
    assert "LeftAnti" in plan(site.orders, q.where(["and", [["not", ["eq", "has_lines", True]], ["gt", "o_totalprice", 5]]]))
    n = site.orders.count(q)
    both = site.orders.count(q.where(["eq", "has_lines", True])) + site.orders.count(q.where(["ne", "has_lines", True]))
    assert both == n == site.orders.count(q.where(["or", [["eq", "has_lines", True], ["eq", "has_lines", False]]]))


def test_limited_laterals_are_limited_before_the_shuffle(site):
    top = Query().select("o_orderkey").order_by("o_totalprice", "desc").limit(2)
    text = plan(site.customers, Query().select("c_custkey", "t.o_orderkey").lateral_join("t", top, [("c_custkey", "o_custkey")], domain=site.orders.domain))
    assert text.count("WindowGroupLimit") == 2


def test_left_join_keeps_the_grain(site):
    n = site.orders.catalog.table("orders").count()
    assert site.orders.count(Query().select("o_orderkey", "customer.nation.region.r_name")) == n


# -- results ---------------------------------------------------------------------------------


def rows(e, q):
    return e.all(q)["rows"]


def test_null_order(people):
    q = Query().select("id")
    assert rows(people, q.order_by("score")) == [[2], [1], [3]]
    assert rows(people, q.order_by("score", "desc")) == [[3], [1], [2]]


def test_text_filters_are_literal(people):
    q = Query().select("id")
    assert rows(people, q.where(["text_contains", "name", "50%_o"])) == [[2]]
    assert rows(people, q.where(["text_contains", "name", "5_%"])) == []
    assert rows(people, q.where(["starts_with", "name", "a"])) == []
    assert rows(people, q.where(["starts_with_ci", "name", "a"])) == [[1]]
    assert rows(people, q.where(["starts_with", "name", ""])) == [[1], [2]]


def test_exact_decimals(people):
    q = Query().select("id")
    assert rows(people, q.where(["eq", "score", "20.25"])) == [[1]]
    assert rows(people, q.where(["eq", "score", "20.2501"])) == []
    assert code(lambda: rows(people, q.where(["eq", "score", "1" * 39]))) == "unsupported_precision"


def test_names(people):
    assert people.compile(Query().select("name", E.count().as_("n")).group_by("name")).names == ("name", "n")
    assert people.compile(Query().select("id", "id")).names == ("id", "id")
    assert code(lambda: people.compile(Query().select("id", E.field("name").as_("id")))) == "invalid_query"


def test_booleans(people):
    q = Query().select(E.true_count("active").as_("t"), E.false_count("active").as_("f"), E.true_percentage("active").as_("p"))
    assert rows(people, q) == [[1, 1, 50.0]]
    assert rows(people, q.where(["eq", "id", 2])) == [[0, 0, None]]


def test_empty_groups(people):
    q = Query().select("name", E.count().as_("n"), E.sum_zero("score").as_("s")).where(["eq", "id", 99])
    assert rows(people, q.group_by("name")) == []
    assert rows(people, q.group_by_rollup("name")) == [[None, 0, None]]
    assert rows(people, q.group_by_cube("name")) == [[None, 0, None]]


def test_rollup_order(people):
    q = Query().select("name", E.count().as_("n"), E.grouping("name").as_("g")).group_by_rollup("name")
    assert [r[2] for r in rows(people, q.order_by(E.grouping("name"), "desc").order_by("name"))] == [1, 0, 0, 0]
    last = rows(people, q.order_by(E.grouping("name"), "desc").order_by("name"))
    assert last[-1][0] is None and last[-1][2] == 0  # the real NULL group is last


def test_zones(spark):
    instants = [(1, dt.datetime(2024, 3, 10, 6, 59, 59, 123456)), (2, dt.datetime(2024, 3, 10, 7, 0)), (3, dt.datetime(2024, 11, 3, 5, 30)), (4, None)]
    df = spark.createDataFrame(instants, "id long, naive timestamp_ntz").select("id", "naive", F.to_utc_timestamp("naive", "UTC").alias("at"), F.unix_seconds(F.to_utc_timestamp("naive", "UTC")).alias("epoch"))
    columns = {"id": {"type": "integer"}, "naive": {"type": "naive_datetime"}, "held": {"type": "utc_datetime", "storage": "naive_utc"}, "at": {"type": "utc_datetime"}, "epoch": {"type": "epoch_datetime"}}
    e = Engine(spark, Domain.parse({"name": "t", "source": {"source_table": "t", "columns": columns}}), Catalog({"t": df.withColumn("held", F.col("naive"))}))
    ny = "America/New_York"
    shown = lambda f, style, zone=None: [r[0] for r in rows(e, Query().select(E.datetime_format(f, style, timezone=zone).as_("x")).order_by("id"))]
    expected = ["2024-03-10T01:59:59.123-05:00", "2024-03-10T03:00:00.000-04:00", "2024-11-03T01:30:00.000-04:00", None]
    assert shown("at", "rfc3339_millis", ny) == shown("held", "rfc3339_millis", ny) == expected
    assert shown("at", "iso8601") == ["2024-03-10T06:59:59Z", "2024-03-10T07:00:00Z", "2024-11-03T05:30:00Z", None]
    assert shown("naive", "iso8601")[0] == "2024-03-10T06:59:59"
    assert shown("epoch", "timezone_offset", ny) == ["-05:00", "-04:00", "-04:00", None]
    assert shown("naive", "epoch_seconds")[1] == 1710054000 == shown("at", "epoch_seconds", ny)[1]
    local = [r[0] for r in rows(e, Query().select("at").order_by("id").use_timezone(ny))]
    assert local[1] == dt.datetime(2024, 3, 10, 3, 0)


def test_day_starts():
    assert shortcuts.day_start_instant("2024-03-10", "America/New_York") == dt.datetime(2024, 3, 10, 5, tzinfo=dt.timezone.utc)
    # midnight doesn't exist on this day in Sao Paulo
    assert shortcuts.day_start_instant("2018-11-04", "America/Sao_Paulo") == dt.datetime(2018, 11, 4, 3, tzinfo=dt.timezone.utc)
    assert len(shortcuts.SHORTCUTS) == 30
    assert code(lambda: shortcuts.bounds("today", "2024-02-30")) == "invalid_query"


def test_current_date_shortcuts_equal_bound_ones(spark):
    now = spark.range(1).select(F.current_date()).first()[0]
    days = [(k, now + dt.timedelta(days=k)) for k in range(-800, 800)]
    df = spark.createDataFrame(days, "id long, day date")
    for name in shortcuts.SHORTCUTS:
        a = df.where(shortcuts.predicate(F.col("day"), name, None))
        b = df.where(shortcuts.predicate(F.col("day"), name, now.isoformat()))
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), name


def test_json_containment(spark):
    bodies = ['{"a": 1, "b": [1, {"c": true}], "d": null}', '{"a": "1"}', "[1, 2, [3]]", "null", None, "not json"]
    e = engine(spark, {"id": {"type": "integer"}, "body": {"type": "json"}}, list(enumerate(bodies)), "id long, body string")
    held = lambda doc: [r[0] for r in rows(e, Query().select("id").where(E.json_contains("body", doc)).order_by("id"))]
    assert held({"a": 1}) == [0]
    assert held({"a": "1"}) == [1]
    assert held({"b": [{"c": True}]}) == [0]
    assert held({"b": [{"c": 1}]}) == []
    assert held({"d": None}) == [0]
    assert held([2]) == [2] and held([[3]]) == [2] and held(2) == [2]
    assert held({}) == [0, 1]
    same = rows(e, Query().select("id").where(E.structured_compare("body", "eq", {"b": [1, {"c": True}], "a": 1, "d": None})))
    assert same == [[0]]


def test_array_nulls(spark):
    e = engine(spark, {"id": {"type": "integer"}, "tags": {"type": "array", "items": "string"}}, [(1, ["a", "b"]), (2, []), (3, None)], "id long, tags array<string>")
    found = lambda op, v: [r[0] for r in rows(e, Query().select("id").where(E.array_match(op, "tags", v)).order_by("id"))]
    assert found("array_contains", ["a"]) == [1]
    assert found("array_contains", []) == [1, 2]
    assert found("array_contained", ["a", "b", "c"]) == [1, 2]
    assert found("array_overlap", ["b", "x"]) == [1]


# -- scope -----------------------------------------------------------------------------------


def test_tenants(spark):
    schemas = {"item": {"source_table": "item", "primary_key": "id", "tenant_field": "tenant", "columns": {"id": {"type": "integer"}, "tenant": {"type": "integer"}, "owner": {"type": "integer"}}}}
    source = {"tenant_field": "tenant", "associations": {"items": {"queryable": "item", "owner_key": "id", "related_key": "owner", "cardinality": "many"}}}
    tables = {"item": spark.createDataFrame([(1, 7, 1), (2, 8, 1)], "id long, tenant long, owner long")}
    args = ({"id": {"type": "integer"}, "tenant": {"type": "integer"}}, [(1, 7), (2, 8)], "id long, tenant long")
    assert code(lambda: rows(engine(spark, *args, source=source, document={"schemas": schemas}, tables=tables), Query().select("id"))) == "missing_tenant_scope"
    e = engine(spark, *args, source=source, document={"schemas": schemas}, tables=tables, tenant=7)
    assert rows(e, Query().select("id", "items.id")) == [[1, 1]]
    assert rows(e, Query().select("id", E.related_count("items", "id").as_("n"))) == [[1, 1]]
    w = Writer(engine(spark, *args, source=source, document={"schemas": schemas, "writes": {"operations": ["insert"], "fields": ["id"]}}, tables=tables, tenant=7))
    assert code(lambda: w.insert([{"id": 5, "tenant": 8}])) == "tenant_mismatch"
    assert w.insert([{"id": 5}]).returning.first()["tenant"] == 7


def test_internal_fields(site):
    document = overlay(orders_document(), {"redact_fields": ["o_totalprice"]})
    api = Api(site.engine(document))
    for body in ({"select": ["o_totalprice"]}, {"select": ["o_orderkey"], "filters": [{"field": "o_totalprice", "op": "gt", "value": 1}]}, {"select": ["o_orderkey"], "order_by": [{"field": "o_totalprice"}]}):
        assert code(lambda b=body: api.query(b)) == "field_not_public"


# -- surfaces --------------------------------------------------------------------------------


def test_api_refusals(site):
    api = Api(site.orders)
    bad = "invalid_api_query"
    for body in (
        {},
        {"select": [], "limit": 1},
        {"select": ["o_orderkey"], "projection": "brief"},
        {"select": ["o_orderkey"], "unknown": 1},
        {"select": ["o_orderkey", "o_orderkey"]},
        {"select": ["o_orderkey"], "limit": 10**9},
        {"select": ["o_orderkey", {"aggregate": "count", "alias": "n"}]},
        {"select": [{"aggregate": "sum", "field": "o_orderstatus", "alias": "n"}]},
        {"select": [{"aggregate": "sum", "field": "lines.l_quantity", "alias": "n"}]},
        {"select": ["o_orderkey"], "filters": [{"field": "o_orderkey", "op": "starts_with", "value": "1"}]},
        {"select": ["o_orderkey"], "filters": [{"any": []}]},
        {"select": ["o_orderkey"], "parameters": {"x": 1}},
        {"select": ["o_orderkey"], "rollup": True},
        {"select": ["o_orderkey"], "timezone": "nowhere"},
    ):
        assert code(lambda b=body: api.query(b)) == bad, body


def test_api_rows(site):
    api = Api(site.orders)
    found = api.run({"select": ["o_orderkey", ["lines.l_linenumber", {"field": "lines.l_quantity", "alias": "q"}]], "limit": 3, "order_by": [{"field": "o_orderkey"}], "row_format": "objects"})
    assert found["columns"] == ["o_orderkey", "lines"]
    assert all(set(x) == {"l_linenumber", "q"} for r in found["rows"] for x in r["lines"])
    assert api.run({"select": ["o_orderkey"], "limit": 0}) == {"columns": ["o_orderkey"], "rows": []}
    assert api.resource(0, ["o_orderkey", "o_orderstatus"])["o_orderkey"] == 0
    assert api.run({"select": [{"aggregate": "count", "alias": "n"}]})["rows"] == [[site.orders.catalog.table("orders").count()]]


def test_collection_limit(site):
    api = Api(Engine(site.spark, site.orders.domain, site.catalog, limits=Limits(max_collection_rows=2)))
    assert code(lambda: api.run({"select": ["o_orderkey", ["lines.l_linenumber"]], "limit": 50})) == "result_limit_exceeded"


def test_conditional_choices(site):
    choices = {"who": {"conditional": {"when_field": "o_orderstatus", "present_field": "o_orderpriority", "absent_field": "o_orderpriority"}, "choices": [{"value": "1-URGENT"}]}}
    api = Api(site.engine(orders_document() | {"filter_choices": choices}))
    q = api.query({"select": ["o_orderkey"], "filters": [{"field": "who", "op": "eq", "value": "1-URGENT"}]})
    assert q.predicate.kind == "any" and len(q.predicate.args) == 2


def test_library(site):
    q = library.apply_view(site.orders.domain, Query(), "dear_open")
    assert [s.args[0] for s in q.selections] == ["o_orderkey", "o_totalprice", "customer.c_name"]
    assert q.applied.value["views"] == ["dear_open"]
    bad = "invalid_query_library"
    apply = lambda names, values=None: library.apply_segments(site.orders.domain, Query(), names, values)
    assert code(lambda: apply(["at_least"])) == bad
    assert code(lambda: apply(["at_least"], {"price": "dear"})) == bad
    assert code(lambda: apply(["open"], {"x": 1})) == bad
    assert code(lambda: apply(["gone"])) == bad
    looping = orders_document()
    looping["query_library"]["segments"]["open"]["segments"] = ["open_and_dear"]
    assert code(lambda: library.apply_segments(Domain.parse(looping), Query(), ["open"])) == "query_library_cycle"
    for group in ({"operator": "xor", "segments": ["open"]}, {"operator": "not", "segments": ["open", "finished"]}, {"operator": "nand", "segments": ["open"]}):
        odd = orders_document()
        odd["query_library"]["segments"]["odd"] = {"segment_groups": [group]}
        assert code(lambda d=odd: library.apply_segments(Domain.parse(d), Query(), ["odd"])) == bad
    picking = orders_document()
    picking["query_library"]["segment_picker_groups"] = {"g": {"label": "State", "choices": [{"segment": "open", "label": "o"}, {"segment": "finished", "label": "f"}]}}
    assert code(lambda: library.apply_segments(Domain.parse(picking), Query(), ["open", "finished"])) == bad
    found = library.lookup(site.orders, "people", "customer#000000001", limit=3)
    assert found and set(found[0]) == {"value", "label", "description"}


def test_page(site):
    views = [{"id": "list", "kind": "detail", "query": Query().select("c_custkey", "c_name")}]
    controls = [
        {"id": "segment", "kind": "facet", "field": "c_mktsegment", "values": {"limit": 2, "searchable": True}},
        {"id": "fixed", "kind": "facet", "field": "c_mktsegment", "values": {"source": "fixed", "options": [{"value": "BUILDING"}, {"value": "NONE", "label": "None"}]}},
        {"id": "name", "kind": "text", "field": "c_name", "ignore_case": True, "multiple": True},
        {"id": "balance", "kind": "range", "field": "c_acctbal"},
    ]
    page = Page(site.customers, views, controls)
    made = page.run({"filters": {"segment": ["MACHINERY"], "name": "customer#0000001, nobody", "balance": {"min": 0}}, "limit": 5})
    assert len(made["rows"]) == 5 and made["has_more"] and made["total"] > 5
    options = made["facets"]["segment"]
    assert options["truncated"] and options["options"][-1]["value"] == "MACHINERY"
    assert [o["value"] for o in made["facets"]["fixed"]["options"]] == ["BUILDING", "NONE"]
    for state in ({"page": 0}, {"limit": 101}, {"view": "x"}, {"filters": {"x": 1}}, {"filters": {"fixed": ["OTHER"]}}, {"facet_search": {"fixed": "a"}}, {"more": 1}):
        assert code(lambda s=state: page.normalize(s)) == "invalid_page"
    bad = [{"id": "a", "kind": "aggregate", "query": Query().select("c_mktsegment", E.sum_("c_acctbal")).group_by("c_mktsegment")}]
    assert code(lambda: Page(site.customers, bad)) == "invalid_page"


def test_explorer_null_order(spark):
    e = engine(spark, PEOPLE, ROWS, "id long, name string, score decimal(12,4), active boolean")
    api = Api(e, Options(explorer=True))
    first = lambda d: api.run({"select": ["id"], "order_by": [{"field": "score", "direction": d}]})["rows"][0]
    assert first("asc") == [3] and first("desc") == [1]


def test_streams(site):
    q = Query().select("o_orderkey").order_by("o_orderkey")
    n = site.orders.count(q)
    assert sum(1 for _ in site.orders.stream(q)) == n
    with Stream(site.orders.compile(q)) as s:
        assert len(s.fetch(7)) == 7 and s.delivered == 7
    assert code(lambda: next(s)) == "stream_closed"
    assert code(lambda: Bounded(site.orders, max_rows=3).all(q)) == "result_limit_exceeded"
    assert len(Bounded(site.orders, max_rows=n, seconds=60).all(q)["rows"]) == n


def test_members_and_registry(site):
    r = Registry()
    r.add(site.orders.domain)
    assert code(lambda: r.add(site.orders.domain)) == "invalid_domain"
    document = customers_document() | {
        "query_members": {
            "subqueries": {"spend": {"source": "orders", "query": {"select": ["o_custkey", {"as": "n", "aggregate": "count"}], "group_by": ["o_custkey"]}, "on": [["c_custkey", "o_custkey"]], "type": "inner"}},
            "laterals": {"last": {"source": "orders", "query": {"select": ["o_orderkey"], "order_by": [["o_orderkey", "desc"]], "limit": 1}, "correlations": [["c_custkey", "o_custkey"]]}},
        }
    }
    e = Engine(site.spark, Domain.parse(document), site.catalog, registry=r)
    got = e.dataframe(Query().select("c_custkey", E.field("spend.n").as_("n"), E.field("last.o_orderkey").as_("last")).with_member("spend").with_member("last"))
    orders = site.catalog.table("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))
    assert got.exceptAll(orders).isEmpty() and got.count() == orders.join(site.catalog.table("customer"), F.col("o_custkey") == F.col("c_custkey")).count()


def test_catalog(spark, small):
    c = Catalog.parquet(spark, small, "nation")
    d = c.default_domain("nation", "n_nationkey")
    assert d.resolve("n_name").column.type == "string"
    c.check(d)
    assert code(lambda: c.table("gone")) == "unknown_table"
    missing = Domain.parse({"name": "nation", "source": {"source_table": "nation", "columns": {"gone": {"type": "string"}}}})
    assert code(lambda: c.check(missing)) == "invalid_domain"


# -- operators ---------------------------------------------------------------------------------


def test_analytics_units():
    assert analytics.result_unit("percent_change", {"kind": "currency", "code": "USD"}) == {"kind": "percentage", "scale": "whole"}
    assert "cumulative" not in analytics.catalog("currency", "stock")
    assert "percentage_point_change" in analytics.catalog("percentage")
    assert analytics.aggregate_unit("count", "currency") == {"kind": "count"}
    assert code(lambda: analytics.result_unit("percentage_point_change", "count")) == "invalid_analytics"


def test_analytics_gaps(spark):
    series = spark.createDataFrame([(1, 10.0), (2, None), (3, 0.0), (4, 20.0)], "k long, v double")
    run = lambda *steps, **o: [r["y"] for r in analytics.transform(series, "v", steps, order_by=["k"], out="y", **o)[0].orderBy("k").collect()]
    assert run("cumulative", behavior="flow") == [10.0, None, 10.0, 30.0]
    assert run("percent_change") == [None, None, None, None]
    assert run("index_to_first") == [100.0, None, 0.0, 200.0]
    assert run({"id": "moving_average", "window": 2}) == [10.0, None, 0.0, 10.0]
    assert run({"id": "exponential_moving_average", "alpha": 0.5}) == [10.0, None, 5.0, 12.5]
    assert run("min_max") == [50.0, None, 0.0, 100.0]
    assert code(lambda: run({"id": "moving_average", "window": 1})) == "invalid_analytics"
    assert code(lambda: run(*["z_score"] * 9)) == "invalid_analytics"
    assert code(lambda: analytics.transform(series, "v", ["cumulative"])) == "invalid_analytics"


@pytest.mark.parametrize(
    ("rule", "codes"),
    [
        ({"op": "presence.required"}, [None] * 4),
        ({"op": "presence.non_null"}, [None, None, None, "null"]),
        ({"op": "text.nonblank"}, [None, "blank", None, "invalid_type"]),
        ({"op": "text.length", "min": 2, "max": 5}, [None, None, "invalid_text_length", "invalid_type"]),
        ({"op": "text.pattern", "profile": "ascii_v1", "pattern": "[a-z]+", "match": "full", "flags": []}, [None, "pattern_mismatch", "pattern_mismatch", "invalid_type"]),
        ({"op": "text.prefix", "text": "ab"}, [None, "text_mismatch", "text_mismatch", "invalid_type"]),
        ({"op": "value.eq", "value": "abc"}, [None, "not_equal", "not_equal", "not_equal"]),
        ({"op": "value.neq", "value": None}, [None, None, None, "equal_to_excluded"]),
        ({"op": "membership.not_in", "values": ["abc", None]}, ["excluded", None, None, "excluded"]),
        ({"op": "number.integer"}, ["invalid_type"] * 4),
        ({"op": "not", "rule": {"op": "text.contains", "text": "b"}}, ["negated_rule_matched", None, None, None]),
        ({"op": "any", "rules": [{"op": "text.suffix", "text": "c"}, {"op": "type.is", "type": "integer"}]}, [None, "no_rule_matched", "no_rule_matched", "no_rule_matched"]),
    ],
)
def test_rules_on_text(spark, rule, codes):
    df = spark.createDataFrame([(0, "abc"), (1, " \t"), (2, "Éxyz-long"), (3, None)], "k long, x string")
    assert [r["c"] for r in df.select("k", rules.failure(df, "x", rule).alias("c")).orderBy("k").collect()] == codes


def test_rules_on_numbers_and_collections(spark):
    df = spark.createDataFrame([(0, 6.0, 7, [(1, "a"), (2, "b")]), (1, 6.5, 6, [(1, "a"), (1, "a")]), (2, None, 9, [])], "k long, x double, y long, items array<struct<n: long, s: string>>")
    run = lambda path, rule: [r["c"] for r in df.select("k", rules.failure(df, path, rule).alias("c")).orderBy("k").collect()]
    assert run("x", {"op": "number.integer"}) == [None, "not_integer", "invalid_type"]
    assert run("x", {"op": "number.range", "min": 6, "max": 7, "include_min": False}) == ["numeric_range", None, "invalid_type"]
    assert run("x", {"op": "number.multiple_of", "factor": 3}) == [None, "not_multiple", "invalid_type"]
    assert run("x", {"op": "value.compare_path", "comparison": "lt", "path": "y"}) == [None, "related_value_comparison", "invalid_related_value_type"]
    assert run("x", {"op": "value.compare_path", "comparison": "lt", "path": "z"}) == ["missing_related_value"] * 3
    assert run("items", {"op": "collection.sum", "path": "n", "exact": 3}) == [None, "invalid_collection_sum", "invalid_collection_sum"]
    assert run("items", {"op": "collection.unique_by", "paths": ["n", "s"]}) == [None, "duplicate_collection_value", None]
    assert run("gone", {"op": "presence.required"}) == ["required"] * 3
    assert run("x", {"op": "presence.absent"}) == ["forbidden"] * 3
    assert len(rules.SCHEMAS) == 28
    assert code(lambda: rules.check_rule({"op": "text.magic"})) == "unsupported_rule_operator"
    assert code(lambda: rules.check_rule({"op": "number.range", "min": 2, "max": 1})) == "invalid_data_rules_contract"
    assert code(lambda: rules.ascii_pattern("(?=x)")) == "invalid_text_pattern"


def test_normalizers(spark):
    df = spark.createDataFrame([(" éa\r\nb ",), ("  ",), (None,)], "x string")
    made = [r[0] for r in df.select(rules.normalize(F.col("x"), ["trim", "nfc", "line_endings", "uppercase", "empty_to_null"])).collect()]
    assert made == ["éA\nB", None, None]


def test_writes(site):
    document = orders_document() | {"writes": {"operations": ["insert", "update", "delete", "upsert"], "fields": ["o_orderkey", "o_orderstatus", "o_custkey"], "defaults": {"o_orderstatus": "N"}}}
    w = Writer(site.engine(document))
    n = w.table.count()
    assert code(lambda: w.update({"o_totalprice": 1}, ["eq", "o_orderkey", 1])) == "field_not_writable"
    assert code(lambda: w.update({"o_orderstatus": "X"}, ["lt", "o_orderkey", 10], expected_count=3)) == "cardinality_mismatch"
    done = w.batch([("insert", ([{"o_orderkey": -5, "o_custkey": 1}],)), ("update", ({"o_custkey": ["add", ["field", "o_custkey"], 10]}, ["eq", "o_orderkey", -5], 1)), ("delete", (["lt", "o_orderkey", 10],))])
    assert done[1].returning.select("o_custkey", "o_orderstatus").first() == (11, "N")
    assert w.table.count() == n - 10
    before = w.table
    assert code(lambda: w.batch([("insert", ([{"o_orderkey": -6}],)), ("delete", (["eq", "o_orderkey", -6], 2))])) == "cardinality_mismatch"
    assert w.table is before
    owned = w.sync_owned({"o_custkey": 3}, [{"o_orderkey": 900001}, {"o_orderkey": 900002}], ["o_orderkey"])
    assert sorted(r[0] for r in owned[-1].table.where("o_custkey = 3").select("o_orderkey").collect()) == [900001, 900002]
    parent, child = Writer(site.engine(document)), Writer(site.engine(document))
    made = write_graph([(parent, "insert", lambda _: ([{"o_orderkey": -7}],)), (child, "insert", lambda d: ([{"o_orderkey": -8, "o_custkey": d[0].returning.first()["o_orderkey"]}],))])
    assert made[1].returning.first()["o_custkey"] == -7
    assert code(lambda: Writer(site.orders).delete(["eq", "o_orderkey", 1])) == "write_not_allowed"


def test_upsert_leaves_the_table_in_place(site):
    document = orders_document() | {"writes": {"operations": ["upsert", "insert"], "fields": ["o_orderkey", "o_orderstatus"]}}
    made = Writer(site.engine(document)).upsert([{"o_orderkey": 1, "o_orderstatus": "Z"}, {"o_orderkey": -3, "o_orderstatus": "Y"}], ["o_orderkey"])
    plan = made.table._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in plan and "SortMergeJoin" not in plan
    assert sorted(r[0] for r in made.returning.select("o_orderkey").collect()) == [-3, 1]
    assert made.table.count() == site.catalog.table("orders").count() + 1


def test_exponential_average_of_a_long_series(spark):
    values = [None if k % 7 == 3 else float((k * 37) % 101) for k in range(30_000)]
    df = spark.createDataFrame([(g, k, v, Decimal(k)) for g in "ab" for k, v in enumerate(values)], "g string, k long, v double, d decimal(20,3)")
    made, _ = analytics.transform(df, "v", [{"id": "exponential_moving_average", "alpha": 0.3}], order_by=["k"], partition_by=["g"], behavior="flow", unit="count", out="y")
    last, want = None, []
    for v in values:
        last = last if v is None else v if last is None else v * 0.3 + last * 0.7
        want.append(None if v is None else last)
    got = made.where("g = 'b'").orderBy("k").collect()
    assert [r["y"] for r in got] == pytest.approx(want)
    assert got[5]["d"] == Decimal("5.000")


def test_levels_refuse_a_part_of_them(site):
    body = {"select": ["o_orderstatus", "o_orderpriority", {"aggregate": "count", "alias": "n"}], "group_by": ["o_orderstatus", "o_orderpriority"]}
    few = Options(explorer=True, max_limit=5, default_limit=5)
    assert code(lambda: Api(site.orders, few).levels(body)) == "result_limit_exceeded"
    assert Api(site.orders, Options(explorer=True)).levels(body).count() > 5


def test_exact_counts_of_large_tables(spark):
    """Rows and groups beyond a million are counted; a ceiling that a host sets holds."""
    rows = spark.range(1_200_000).selectExpr("id", "CAST(id % 1100000 AS STRING) AS name")
    e = Engine(spark, Domain.parse({"name": "t", "source": {"source_table": "t", "primary_key": "id", "columns": {k: PEOPLE[k] for k in ("id", "name")}}}), Catalog({"t": rows}))
    detail = {"select": ["id"], "filters": [{"field": "id", "op": "gte", "value": 50_000}], "order_by": [{"field": "name"}], "limit": 5}
    grouped = {"select": ["name", {"aggregate": "count", "alias": "n"}], "group_by": ["name"]}
    count = lambda body, **options: Api(e, Options(explorer=True, **options)).exact_count(body)
    assert count(detail) == 1_150_000 and count(grouped) == 1_100_000
    assert count(detail, max_count_rows=1_150_000) == 1_150_000
    assert code(lambda: count(detail, max_count_rows=1_149_999)) == "count_unavailable"


def test_delimited_parts_have_headers(spark, tmp_path):
    df = spark.range(10).repartition(3)
    sinks.write_delimited(df, str(tmp_path / "parts"))
    parts = [p.read_bytes() for p in (tmp_path / "parts").glob("part-*")]
    assert len(parts) == 3 and all(p.startswith(b"id\r\n") for p in parts)
    assert sum(p.count(b"\r\n") for p in parts) == 13
    sinks.write_delimited(df.where("id < 0"), str(tmp_path / "none"))
    assert b"".join(p.read_bytes() for p in (tmp_path / "none").glob("part-*")) == b"id\r\n"


def test_stems():
    assert [text.stemmed(w) for w in ("licenses", "ponies", "gas", "bus", "class", "shoes", "trees", "cats")] == ["license", "pony", "ga", "bus", "class", "shoe", "tree", "cat"]


def test_imports(spark):
    content = "id,name,name,\n1, Ann ,x,\n2,,y,\n,Bob,z,\n4,Cy,w,\n".encode()
    found = csv_import.inspect_csv(content)
    assert found["columns"] == ["id", "name", "name_2", "column_4"] and found["row_count"] == 4
    target = spark.createDataFrame([("1",), ("4",), ("4",)], "id string")
    mapping = {"id": {"column": "id"}, "name": {"column": "name", "transforms": ["trim", "uppercase"], "required": True}}
    made = csv_import.preview(csv_import.frame_of(spark, found), mapping, target, ["id"]).collect()
    assert sorted((r["id"], r["name"], r["error"], r["operation"]) for r in made) == [
        ("", "BOB", "import_key_incomplete", None),
        ("1", "ANN", None, "update"),
        ("2", "", "import_required_value_missing", None),
        ("4", "CY", "import_key_ambiguous", None),
    ]
    assert code(lambda: csv_import.inspect_csv(b"\xff")) == "import_encoding"
    assert code(lambda: csv_import.inspect_csv(b"a\n1,2\n")) == "import_row_width"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', Decimal("1.50"), None), (2, " =1+1", Decimal("-2.00"), "é")], "k long, x string, d decimal(5,2), y string")
    lines = [r[0] for r in sinks.delimited_lines(df).collect()]
    assert lines == ['1,"a ""b"", c",1.50,', '2,\' =1+1,-2.00,"é"']
    sinks.write_delimited(df.coalesce(1), str(tmp_path / "out"), "tsv")
    text = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*"))
    assert text.startswith(b"k\tx\td\ty\r\n") and text.count(b"\r\n") == 3
    result = {"columns": df.columns, "rows": [list(r) for r in df.collect()]}
    assert json.loads(sinks.encode(result))["rows"][0] == [1, 'a "b", c', "1.5", None]
    assert sinks.encode(result, "csv").decode().split("\r\n")[1] == '1,"a ""b"", c",1.5,'
    assert sinks.xlsx(result)[:2] == b"PK"
    assert code(lambda: sinks.encode(result, "json", Limits(max_response_bytes=10))) == "result_limit_exceeded"
    assert [r[0] for r in sinks.json_rows(df.select("y", "k")).collect()] == ['{"k":1,"y":null}', '{"k":2,"y":"é"}']


def test_events_schema(site):
    site.catalog.check(Domain.parse(events_document()))
