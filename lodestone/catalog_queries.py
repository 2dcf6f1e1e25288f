"""Registered queries over the sample tables, each beside DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import expr as E
from .api import Api, Options
from .functions.dates import FORMATS
from .functions.shortcuts import RECURRING, SHORTCUTS, bounds
from .operators.analytics import transform
from .operators.rules import apply_rules, normalize
from .operators.writes import Writer
from .pages import Page
from .query import Query
from .sample_domains import TODAY, Site, orders_document
from .sinks import delimited_lines, json_rows
from .sources.csv_import import preview

Run = Callable[[Site], DataFrame]
_FOUND: dict[str, tuple[Run, str | None]] = {}


def _add(name: str, run: Run, sql: str | None) -> None:
    assert name not in _FOUND, name
    _FOUND[name] = (run, sql)


def _rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Sums of doubles depend on their order in the last digits."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue by region and order year, over a chain of left joins."""
    return _flagship(Site(spark, folder))


def _flagship(s: Site) -> DataFrame:
    region, year = "order.customer.nation.region.r_name", E.datetime_format("order.o_orderdate", "year")
    revenue = E.sum_(E.parse_value(["subtract", ["field", "l_extendedprice"], ["multiply", ["field", "l_extendedprice"], ["field", "l_discount"]]]))
    q = Query().select(E.field(region).as_("region"), year.as_("year"), E.count().as_("lines"), revenue.as_("revenue")).group_by(region, year).order_by(region).order_by(year)
    return _rounded(s.lines.dataframe(q), "revenue", digits=2)


_CHAIN = "lineitem l LEFT JOIN orders o ON l_orderkey = o_orderkey LEFT JOIN customer c ON o_custkey = c_custkey LEFT JOIN nation n ON c_nationkey = n_nationkey LEFT JOIN region r ON n_regionkey = r_regionkey"
_add("flagship", _flagship, f"SELECT r_name AS region, strftime(o_orderdate, '%Y') AS year, count(*) AS lines, round(sum(l_extendedprice - l_extendedprice * l_discount), 2) AS revenue FROM {_CHAIN} GROUP BY ALL")

def _whole(api: Api, body: dict) -> DataFrame:
    """A request's rows without its page."""
    return api.engine.dataframe(api.query(body).limit(None).offset(None))


# -- filters ---------------------------------------------------------------------------


def _lines(*where: object) -> Run:
    def run(s: Site) -> DataFrame:
        q = Query().select("l_orderkey", "l_linenumber", "l_quantity")
        for w in where:
            q = q.where(w)
        return s.lines.dataframe(q)

    return run


_LINES = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE "
for _name, _filter, _sql in (
    ("filter_eq", ["eq", "l_returnflag", "R"], "l_returnflag = 'R'"),
    ("filter_ne", ["ne", "l_returnflag", "R"], "l_returnflag <> 'R'"),
    ("filter_compare", ["and", [["gt", "l_quantity", 45], ["lte", "l_discount", 0.03], ["gte", "l_tax", 0.01], ["lt", "l_linenumber", 5]]], "l_quantity > 45 AND l_discount <= 0.03 AND l_tax >= 0.01 AND l_linenumber < 5"),
    ("filter_between", ["between", "l_quantity", 10, 12], "l_quantity BETWEEN 10 AND 12"),
    ("filter_in", ["in", "l_linenumber", [1, 3]], "l_linenumber IN (1, 3)"),
    ("filter_not_in", ["not", ["in", "l_linenumber", [1, 3]]], "l_linenumber NOT IN (1, 3)"),
    ("filter_or_nested", ["or", [["and", [["eq", "l_returnflag", "A"], ["gt", "l_quantity", 48]]], ["not", ["lt", "l_quantity", 50]]]], "(l_returnflag = 'A' AND l_quantity > 48) OR NOT l_quantity < 50"),
    ("filter_field_vs_field", ["gt", "l_linenumber", ["field", "l_quantity"]], "l_linenumber > l_quantity"),
    ("filter_time", ["gte", "l_shipdate", "2001-01-01"], "l_shipdate >= TIMESTAMP '2001-01-01'"),
):
    _add(_name, _lines(_filter), _LINES + _sql)

for _name, _filter, _sql in (
    ("filter_starts_with", ["starts_with", "c_name", "Customer#00000001"], "starts_with(c_name, 'Customer#00000001')"),
    ("filter_starts_with_ci", ["starts_with_ci", "c_name", "CUSTOMER#00000002"], "starts_with(lower(c_name), 'customer#00000002')"),
    ("filter_text_contains", ["text_contains", "c_mktsegment", "UIL"], "contains(c_mktsegment, 'UIL')"),
    ("filter_text_contains_ci", ["text_contains_ci", "c_mktsegment", "uil"], "contains(lower(c_mktsegment), 'uil')"),
    ("filter_ends_with", ["ends_with", "c_name", "7"], "ends_with(c_name, '7')"),
    ("filter_ends_with_ci", ["ends_with_ci", "c_mktsegment", "Y"], "ends_with(lower(c_mktsegment), 'y')"),
    ("filter_wildcards_are_text", ["text_contains", "c_name", "%0_"], "contains(c_name, '%0_')"),
):
    _add(_name, lambda s, f=_filter: s.customers.dataframe(Query().select("c_custkey", "c_name").where(f)), f"SELECT c_custkey, c_name FROM customer WHERE {_sql}")

_EVENTS = """(SELECT *, CAST(ts AS DATE) AS day, CAST(ts AS DATE) + CAST(event_id % 9 AS INTEGER) AS late_day,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 2 = 0 END AS active, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS score,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE [event_type, 'u' || CAST(user_id % 3 AS VARCHAR)] END AS tags,
  CAST(epoch(ts) AS BIGINT) AS epoch_s, CAST(event_id / 100.0 AS DECIMAL(18,2)) AS amount FROM events) e"""


def _events(*where: object) -> Run:
    def run(s: Site) -> DataFrame:
        q = Query().select("event_id", "event_type")
        for w in where:
            q = q.where(w)
        return s.events.dataframe(q)

    return run


for _name, _filter, _sql in (
    ("filter_null", ["is_null", "score"], "score IS NULL"),
    ("filter_not_null", ["not_null", "active"], "active IS NOT NULL"),
    ("filter_boolean", ["eq", "active", True], "active = TRUE"),
    ("filter_exact_decimal", ["eq", "amount", "1.25"], "amount = 1.25"),
    ("array_contains", ["array_contains", "tags", ["click", "u1"]], "list_has_all(tags, ['click', 'u1'])"),
    ("array_contained", ["array_contained", "tags", ["click", "view", "u0", "u1"]], "list_has_all(['click', 'view', 'u0', 'u1'], tags)"),
    ("array_overlap", ["array_overlap", "tags", ["u2", "click"]], "list_has_any(tags, ['u2', 'click'])"),
    ("json_contains", ["json_contains", "props", {"k": 7}], "CAST(json_extract(props, '$.k') AS INTEGER) = 7"),
    ("computed_temporal_delta", ["gte", "gap_days", 7], "event_id % 9 >= 7"),
):
    _add(_name, _events(_filter), f"SELECT event_id, event_type FROM {_EVENTS} WHERE {_sql}")
_add("json_structured_in", _events(E.structured_compare("props", "in", [{"k": 3}, {"k": 4}])), f"SELECT event_id, event_type FROM {_EVENTS} WHERE CAST(json_extract(props, '$.k') AS INTEGER) IN (3, 4)")
_add("array_structured_eq", _events(E.structured_compare("tags", "eq", ["click", "u1"])), f"SELECT event_id, event_type FROM {_EVENTS} WHERE tags = ['click', 'u1']")
_add("trim", lambda s: s.customers.dataframe(Query().select("c_custkey", E.trim("c_name").as_("name"))), "SELECT c_custkey, trim(c_name) AS name FROM customer")
_add("select_repeats", lambda s: s.customers.compile(Query().select("c_custkey", "c_name").select("c_custkey")).frame.toDF("a", "b", "c"), "SELECT c_custkey AS a, c_name AS b, c_custkey AS c FROM customer")


def _required_predicate(s: Site) -> DataFrame:
    document = orders_document() | {"required_filters": [["o_orderstatus", "F"], ["o_totalprice", ["gt", 100000]]], "required_selected": ["o_orderkey"], "required_order_by": [["o_orderkey", "desc"]]}
    return s.engine(document).dataframe(Query().select("o_totalprice").where(["lt", "o_totalprice", 150000]))


_add("required_predicate", _required_predicate, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 AND o_totalprice < 150000")


def _tenant_scope(s: Site) -> DataFrame:
    from .sample_domains import ORDERS

    document = orders_document()
    document["source"] = document["source"] | {"tenant_field": "o_custkey"}
    return s.engine(document, tenant=7).dataframe(Query().select(*list(ORDERS["columns"])[:3]))


_add("tenant_scope", _tenant_scope, "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey = 7")

# -- joins -------------------------------------------------------------------------------

_add("join_left_chain", lambda s: s.orders.dataframe(Query().select("o_orderkey", "customer.nation.region.r_name")), 'SELECT o_orderkey, r_name AS "customer.nation.region.r_name" FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey')
_add("join_inner", lambda s: s.orders.dataframe(Query().select("o_orderkey", E.field("active_customer.c_name").as_("name"))), "SELECT o_orderkey, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey")
_add("join_declared", lambda s: s.orders.dataframe(Query().select("o_orderkey").join("lines")), "SELECT o_orderkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
_add("join_constant_where", lambda s: s.orders.dataframe(Query().select("o_orderkey", E.field("returned_lines.l_linenumber").as_("line"))), "SELECT o_orderkey, l_linenumber AS line FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R'")
_add("join_bridge", lambda s: s.parts.dataframe(Query().select("p_partkey", E.field("suppliers.s_name").as_("supplier"))), "SELECT p_partkey, s_name AS supplier FROM part LEFT JOIN (lineitem JOIN supplier ON l_suppkey = s_suppkey) ON p_partkey = l_partkey AND l_returnflag = 'R'")
_STATUS = "orders LEFT JOIN (VALUES ('F', 'Finished'), ('O', 'Open')) v(code, label) ON o_orderstatus = code"
_add("star_dimension_fallback", lambda s: s.orders.dataframe(Query().select(E.field("status.label").as_("status"), E.count().as_("n")).group_by("status.label")), f"SELECT coalesce(label, o_orderstatus) AS status, count(*) AS n FROM {_STATUS} GROUP BY 1")
_add("inline_values_join", lambda s: s.orders.dataframe(Query().select("o_orderkey", E.field("status.code").as_("code"))), f"SELECT o_orderkey, code FROM {_STATUS}")
_add("values_join", lambda s: s.orders.dataframe(Query().select("o_orderkey", E.field("w.weight").as_("weight")).with_values([("F", 1.5), ("P", 2.0)], ["code", "weight"], "w", owner="o_orderstatus", related="code", join_type="inner")), "SELECT o_orderkey, CAST(weight AS DOUBLE) AS weight FROM orders JOIN (VALUES ('F', 1.5), ('P', 2.0)) w(code, weight) ON o_orderstatus = code")
_add("values_cross", lambda s: s.customers.dataframe(Query().select("c_custkey", E.field("k.n").as_("n")).with_values([(1,), (2,)], ["n"], "k")), "SELECT c_custkey, CAST(n AS BIGINT) AS n FROM customer, (VALUES (1), (2)) k(n)")
_SPENT = "SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY 1"


def _spent() -> Query:
    return Query().select("o_custkey", E.sum_("o_totalprice").as_("spent")).group_by("o_custkey")


_add("subquery_join", lambda s: _rounded(s.customers.dataframe(Query().select("c_custkey", E.field("t.spent").as_("spent")).subquery_join("t", _spent(), [("c_custkey", "o_custkey")], domain=s.orders.domain)), "spent", digits=2), f"SELECT c_custkey, round(spent, 2) AS spent FROM customer LEFT JOIN ({_SPENT}) ON c_custkey = o_custkey")
_add("cte_join", lambda s: _rounded(s.customers.dataframe(Query().select("c_custkey", E.field("t.spent").as_("spent")).with_cte("t", _spent(), domain=s.orders.domain, columns=["key", "spent"], owner="c_custkey", related="key", join_type="inner")), "spent", digits=2), f"SELECT c_custkey, round(spent, 2) AS spent FROM customer JOIN ({_SPENT}) ON c_custkey = o_custkey")
_add("members_cte", lambda s: _rounded(s.orders.dataframe(Query().select("o_orderkey", E.field("spend.spent").as_("spent")).with_member("spend")), "spent", digits=2), f"SELECT o_orderkey, round(spent, 2) AS spent FROM orders o JOIN ({_SPENT}) t ON o.o_custkey = t.o_custkey")
_add("members_values", lambda s: s.orders.dataframe(Query().select("o_orderkey", E.field("weights.weight").as_("weight")).with_member("weights")), "SELECT o_orderkey, CAST(weight AS BIGINT) AS weight FROM orders LEFT JOIN (VALUES ('F', 1), ('O', 2)) v(code, weight) ON o_orderstatus = code")
_add("lateral_top1", lambda s: s.customers.dataframe(Query().select("c_custkey", E.field("t.o_orderkey").as_("top")).lateral_join("t", Query().select("o_orderkey").order_by("o_totalprice", "desc").order_by("o_orderkey").limit(1), [("c_custkey", "o_custkey")], domain=s.orders.domain)), "SELECT c_custkey, t.o_orderkey AS top FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) t ON t.o_custkey = c_custkey AND k = 1")
_add("lateral_agg", lambda s: s.customers.dataframe(Query().select("c_custkey", E.field("t.n").as_("n")).lateral_join("t", Query().select(E.count().as_("n")).where(["gt", "o_totalprice", 100000]), [("c_custkey", "o_custkey")], domain=s.orders.domain)), "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) AS n FROM customer")
_add("function_lateral", lambda s: s.customers.dataframe(Query().select("c_custkey", E.field("g.k").as_("k")).function_lateral("generate_series", [1, 3], "g", column="k")), "SELECT c_custkey, CAST(k AS BIGINT) AS k FROM customer, generate_series(1, 3) g(k)")
_add("unnest_array", lambda s: s.events.dataframe(Query().select("event_id", E.field("t.value").as_("tag")).array_rowset("tags", "t")), f"SELECT event_id, unnest(tags) AS tag FROM {_EVENTS}")
_add("unnest_ordinality_left", lambda s: s.events.dataframe(Query().select("event_id", E.field("t.value").as_("tag"), E.field("t.k").as_("k")).array_rowset("tags", "t", ordinality="k", join_type="left")), f"SELECT event_id, unnest(coalesce(tags, [NULL])) AS tag, CAST(unnest(CASE WHEN tags IS NULL THEN [NULL] ELSE [1, 2] END) AS BIGINT) AS k FROM {_EVENTS}")
_add("json_rowset", lambda s: s.events.dataframe(Query().select("event_id", E.field("i.sku").as_("sku"), E.field("i.n").as_("n")).json_rowset("items", "i", {"sku": "string", "n": "integer"})), "SELECT event_id, 'a' || CAST(event_id % 4 AS VARCHAR) AS sku, CAST(event_id % 3 AS BIGINT) AS n FROM events UNION ALL SELECT event_id, 'b', CAST(2 AS BIGINT) FROM events")
_add("semi_exists", lambda s: s.customers.dataframe(Query().select("c_custkey").where(["eq", "has_orders", True])), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_add("anti_exists", lambda s: s.orders.dataframe(Query().select("o_orderkey").where(["not", ["eq", "has_lines", True]])), "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
_add("exists_selected", lambda s: s.orders.dataframe(Query().select("o_orderkey", "has_lines")), "SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS has_lines FROM orders")
_RETARGET = "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"
for _how in ("in", "exists"):
    _add(f"retarget_{_how}", lambda s, how=_how: s.orders.dataframe(Query().where(["gt", "o_totalprice", 300000]).retarget("customer", how).select("c_custkey", E.field("nation.n_name").as_("nation"))), _RETARGET)

# -- aggregates ------------------------------------------------------------------------------

_add("group_by", lambda s: _rounded(s.lines.dataframe(Query().select("l_returnflag", "l_linestatus", E.count().as_("n"), E.sum_("l_quantity").as_("total"), E.avg("l_extendedprice").as_("mean"), E.min_("l_discount").as_("low"), E.max_("l_shipdate").as_("latest")).group_by("l_returnflag", "l_linestatus")), "total", "mean"), "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS total, round(avg(l_extendedprice), 4) AS mean, min(l_discount) AS low, max(l_shipdate) AS latest FROM lineitem GROUP BY ALL")
_add("group_by_expression", lambda s: s.orders.dataframe(Query().select(E.datetime_format("o_orderdate", "quarter").as_("quarter"), E.count().as_("n")).group_by(E.datetime_format("o_orderdate", "quarter"))), "SELECT strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) AS quarter, count(*) AS n FROM orders GROUP BY 1")
_add("global_aggregate", lambda s: s.orders.dataframe(Query().select(E.count().as_("n"), E.max_("o_orderkey").as_("top"), E.sum_("o_custkey").as_("none")).where(["lt", "o_totalprice", -1])), "SELECT count(*) AS n, max(o_orderkey) AS top, CAST(sum(o_custkey) AS BIGINT) AS none FROM orders WHERE o_totalprice < -1")
_SETS = (E.field("l_returnflag"), E.field("l_linestatus"))


def _sets(group: Callable[[Query], Query]) -> Run:
    measures = (E.count().as_("n"), E.count_distinct("l_suppkey").as_("suppliers"), E.grouping(*_SETS).as_("mask"))
    return lambda s: s.lines.dataframe(group(Query().select(*_SETS, *measures)))


_SETS_SQL = "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, GROUPING(l_returnflag, l_linestatus) AS mask FROM lineitem GROUP BY "
_add("rollup", _sets(lambda q: q.group_by_rollup(*_SETS)), _SETS_SQL + "ROLLUP (l_returnflag, l_linestatus)")
_add("cube", _sets(lambda q: q.group_by_cube(*_SETS)), _SETS_SQL + "CUBE (l_returnflag, l_linestatus)")
_add("grouping_sets", _sets(lambda q: q.group_by_grouping_sets(list(_SETS), [[0], [1], []])), _SETS_SQL + "GROUPING SETS ((l_returnflag), (l_linestatus), ())")
_add("rollup_empty_input", lambda s: s.lines.dataframe(Query().select("l_returnflag", E.count().as_("n"), E.sum_zero("l_linenumber").as_("total")).group_by_rollup("l_returnflag").where(["lt", "l_quantity", 0])), "SELECT CAST(NULL AS VARCHAR) AS l_returnflag, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS total")
_add("rollup_ordered", lambda s: s.lines.dataframe(Query().select("l_returnflag", E.count().as_("n")).group_by_rollup("l_returnflag").order_by("l_returnflag").limit(2)), "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag) ORDER BY l_returnflag NULLS FIRST LIMIT 2")
_add("count_kinds", lambda s: s.events.dataframe(Query().select("event_type", E.count().as_("all_rows"), E.count_field("score").as_("scored"), E.count_distinct("user_id").as_("users")).group_by("event_type")), f"SELECT event_type, count(*) AS all_rows, count(score) AS scored, count(DISTINCT user_id) AS users FROM {_EVENTS} GROUP BY 1")
_add("sum_zero", lambda s: _rounded(s.events.dataframe(Query().select("event_type", E.sum_zero("score").as_("total")).group_by("event_type")), "total"), f"SELECT event_type, round(sum(coalesce(score, 0)), 4) AS total FROM {_EVENTS} GROUP BY 1")
_add("true_percentage", lambda s: s.events.dataframe(Query().select("event_type", E.true_count("active").as_("yes"), E.false_count("active").as_("no"), E.true_percentage("active").as_("share")).group_by("event_type")), f"SELECT event_type, count(*) FILTER (WHERE active) AS yes, count(*) FILTER (WHERE NOT active) AS no, 100.0::DOUBLE * count(*) FILTER (WHERE active) / nullif(count(active), 0) AS share FROM {_EVENTS} GROUP BY 1")
_add("count_bucket", lambda s: s.parts.dataframe(Query().select("p_brand", E.count_bucket("p_size", 10, 20).as_("middle"), E.count_bucket("p_size", 30).as_("large")).group_by("p_brand")), "SELECT p_brand, count(*) FILTER (WHERE p_size BETWEEN 10 AND 20) AS middle, count(*) FILTER (WHERE p_size >= 30) AS large FROM part GROUP BY 1")
_add("count_bucket_elapsed", lambda s: s.events.dataframe(Query().select(E.count_bucket("ts", 0, 7, "elapsed_days").as_("week"))), f"SELECT count(*) FILTER (WHERE DATE '{TODAY}' - CAST(ts AS DATE) BETWEEN 0 AND 7) AS week FROM events")
_add("dimension_display", lambda s: s.orders.dataframe(Query().select("o_orderstatus", E.dimension_display("status.label", "o_orderstatus").as_("label"), E.count().as_("n")).group_by_rollup("o_orderstatus")), f"SELECT o_orderstatus, CASE WHEN GROUPING(o_orderstatus) = 0 THEN min(coalesce(label, o_orderstatus)) END AS label, count(*) AS n FROM {_STATUS} GROUP BY ROLLUP (o_orderstatus)")
_add("projection_sum", lambda s: _rounded(s.orders.projection_sum(Query().select("o_totalprice").order_by("o_totalprice", "desc").order_by("o_orderkey").limit(10), "o_totalprice"), "total", digits=2), "SELECT round(sum(o_totalprice), 2) AS total FROM (SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 10)")
_add("aggregate_to_many", lambda s: s.customers.dataframe(Query().select("c_mktsegment", E.count_field("orders.o_orderkey").as_("orders")).group_by("c_mktsegment")), "SELECT c_mktsegment, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")

# -- windows -----------------------------------------------------------------------------------

_OVER = {"partition_by": ["o_custkey"], "order_by": [("o_totalprice", "desc"), ("o_orderkey", "asc")]}
_OVER_SQL = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey NULLS LAST"


def _windows(**nodes: E.Node) -> Run:
    return lambda s: s.orders.dataframe(Query().select("o_orderkey", *[n.as_(k) for k, n in nodes.items()]))


_add("window_ranks", _windows(place=E.window("row_number", **_OVER), part=E.window("ntile", [3], **_OVER)), f"SELECT o_orderkey, row_number() {_OVER_SQL}) AS place, ntile(3) {_OVER_SQL}) AS part FROM orders")
_BY_DAY = {"partition_by": ["o_orderstatus"], "order_by": ["o_custkey"]}
_BY_DAY_SQL = "OVER (PARTITION BY o_orderstatus ORDER BY o_custkey NULLS LAST"
_add("window_rank_ties", _windows(rank=E.window("rank", **_BY_DAY), dense=E.window("dense_rank", **_BY_DAY), percent=E.window("percent_rank", **_BY_DAY), cume=E.window("cume_dist", **_BY_DAY)), f"SELECT o_orderkey, rank() {_BY_DAY_SQL}) AS rank, dense_rank() {_BY_DAY_SQL}) AS dense, percent_rank() {_BY_DAY_SQL}) AS percent, cume_dist() {_BY_DAY_SQL}) AS cume FROM orders")
_add("window_lag_lead", _windows(before=E.window("lag", ["o_orderkey"], **_OVER), after=E.window("lead", ["o_orderkey", 2, -1], **_OVER)), f"SELECT o_orderkey, lag(o_orderkey) {_OVER_SQL}) AS before, lead(o_orderkey, 2, -1) {_OVER_SQL}) AS after FROM orders")
_FULL = {"unit": "rows", "start": "unbounded_preceding", "end": "unbounded_following"}
_FULL_SQL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
_add("window_first_last_nth", _windows(first=E.window("first_value", ["o_orderkey"], frame=_FULL, **_OVER), last=E.window("last_value", ["o_orderkey"], frame=_FULL, **_OVER), third=E.window("nth_value", ["o_orderkey", 3], frame=_FULL, **_OVER)), f"SELECT o_orderkey, first_value(o_orderkey) {_OVER_SQL} {_FULL_SQL} AS first, last_value(o_orderkey) {_OVER_SQL} {_FULL_SQL} AS last, nth_value(o_orderkey, 3) {_OVER_SQL} {_FULL_SQL} AS third FROM orders")
_add("window_rows_frame", _windows(n=E.window("count", [], frame={"unit": "rows", "start": {"preceding": 2}, "end": {"following": 1}}, **_OVER), total=E.window("sum", ["o_custkey"], frame={"unit": "rows", "start": "unbounded_preceding", "end": "current_row"}, **_OVER), low=E.window("min", ["o_orderkey"], frame={"unit": "rows", "start": {"preceding": 1}, "end": "current_row"}, **_OVER)), f"SELECT o_orderkey, count(*) {_OVER_SQL} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n, CAST(sum(o_custkey) {_OVER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total, min(o_orderkey) {_OVER_SQL} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS low FROM orders")
_add("window_range_frame", _windows(near=E.window("count", [], frame={"unit": "range", "start": {"preceding": 5}, "end": {"following": 5}}, **_BY_DAY)), f"SELECT o_orderkey, count(*) {_BY_DAY_SQL} RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM orders")
_add("window_groups_frame", _windows(near=E.window("count", [], frame={"unit": "groups", "start": {"preceding": 1}, "end": {"following": 2}}, **_BY_DAY), top=E.window("max", ["o_orderkey"], frame={"unit": "groups", "start": {"preceding": 1}, "end": "current_row"}, **_BY_DAY)), f"SELECT o_orderkey, count(*) {_BY_DAY_SQL} GROUPS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS near, max(o_orderkey) {_BY_DAY_SQL} GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS top FROM orders")
_add("window_over_groups", lambda s: s.orders.dataframe(Query().select("o_orderstatus", "o_orderpriority", E.count().as_("n"), E.window("rank", partition_by=["o_orderstatus"], order_by=[(E.count(), "desc")]).as_("place")).group_by("o_orderstatus", "o_orderpriority")), "SELECT o_orderstatus, o_orderpriority, count(*) AS n, rank() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC) AS place FROM orders GROUP BY 1, 2")

# -- order, page, sets, recursion -------------------------------------------------------------

_add("order_nulls", lambda s: s.events.dataframe(Query().select("event_id", "score").order_by("score", "desc").order_by("event_id").limit(30)), f"SELECT event_id, score FROM {_EVENTS} ORDER BY score DESC NULLS FIRST, event_id LIMIT 30")
_add("order_nulls_asc", lambda s: s.events.dataframe(Query().select("event_id", "score").order_by("score").order_by("event_id").offset(5).limit(30)), f"SELECT event_id, score FROM {_EVENTS} ORDER BY score ASC NULLS LAST, event_id LIMIT 30 OFFSET 5")
_add("order_by_expression", lambda s: s.orders.dataframe(Query().select("o_orderkey").order_by(E.parse_value(["days_between", ["field", "o_orderdate"], ["literal", "2000-01-01", "date"]])).order_by("o_orderkey").limit(10)), "SELECT o_orderkey FROM orders ORDER BY DATE '2000-01-01' - CAST(o_orderdate AS DATE), o_orderkey LIMIT 10")


def _keys(status: str, low: int, high: int) -> Query:
    return Query().select("o_custkey").where(["and", [["eq", "o_orderstatus", status], ["between", "o_totalprice", low, high]]])


_K = "SELECT o_custkey FROM orders WHERE o_orderstatus = '{}' AND o_totalprice BETWEEN {} AND {}"
_A, _B, _C = _K.format("F", 1000, 90000), _K.format("O", 50000, 200000), _K.format("P", 1000, 300000)
for _op, _word in (("union", "UNION"), ("union_all", "UNION ALL"), ("intersect", "INTERSECT"), ("except_", "EXCEPT")):
    _add(f"set_{_op.strip('_')}", lambda s, op=_op: s.orders.dataframe(getattr(_keys("F", 1000, 90000), op)(_keys("O", 50000, 200000))), f"{_A} {_word} {_B}")
_add("set_left_to_right", lambda s: s.orders.dataframe(_keys("F", 1000, 90000).union(_keys("O", 50000, 200000)).intersect(_keys("P", 1000, 300000)).order_by("o_custkey")), f"SELECT * FROM (({_A} UNION {_B}) INTERSECT {_C}) ORDER BY 1")


def _tree(s: Site) -> DataFrame:
    base = Query().select("id", "name", E.parse_value(["literal", "", "string"]).as_("path")).where(["is_null", "parent_id"])
    path = E.parse_value(["concat", ["previous", "path"], ["literal", "/", "string"], ["field", "name"]], previous=True)
    step = Query().select("id", "name", path.as_("path"))
    q = Query().select(E.field("t.id").as_("id"), E.field("t.path").as_("path"), E.field("t.recursion_depth").as_("depth"))
    q = q.with_recursive_cte("t", base, step, step_on=("id", "parent_id"), columns=["id", "name", "path"], max_depth=3, owner="id", related="id", join_type="inner")
    return s.tree.dataframe(q)


_add("recursive_depth", _tree, "WITH RECURSIVE t(id, path, depth) AS (SELECT CAST(n_nationkey AS BIGINT), '', CAST(1 AS BIGINT) FROM nation WHERE n_nationkey = 0 UNION ALL SELECT CAST(n_nationkey AS BIGINT), path || '/' || n_name, depth + 1 FROM nation JOIN t ON n_nationkey > 0 AND (n_nationkey - 1) // 3 = t.id WHERE depth < 3) SELECT * FROM t")
_add("library_segments", lambda s: _whole(Api(s.orders), {"select": ["o_orderkey"], "segments": ["at_least", "priorities"], "parameters": {"price": 250000}, "order_by": [{"field": "o_orderkey"}]}), "SELECT o_orderkey FROM orders WHERE o_totalprice >= 250000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_orderkey")
_add("library_view", lambda s: _whole(Api(s.orders), {"view": "dear_open"}), 'SELECT o_orderkey, o_totalprice, c_name AS "customer.c_name" FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = \'O\' AND o_totalprice > 200000 ORDER BY o_totalprice DESC, o_orderkey')
_add("library_nor", lambda s: _whole(Api(s.orders), {"select": ["o_orderkey"], "segments": ["not_open_nor_finished"], "order_by": [{"field": "o_orderkey"}]}), "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'O' OR o_orderstatus = 'F') ORDER BY 1")
_add("library_xor", lambda s: _whole(Api(s.orders), {"select": ["o_orderkey"], "segments": ["one_of"], "parameters": {"price": 200000}, "order_by": [{"field": "o_orderkey"}]}), "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O') <> (o_totalprice >= 200000) ORDER BY 1")

# -- values, dates, buckets --------------------------------------------------------------------


def _value(name: str, ast: object, sql: str, digits: int | None = None) -> None:
    def run(s: Site) -> DataFrame:
        df = s.events.dataframe(Query().select("event_id", E.parse_value(ast).as_("x")))
        return df if digits is None else _rounded(df, "x", digits=digits)

    _add(name, run, f"SELECT event_id, {sql if digits is None else f'round({sql}, {digits})'} AS x FROM {_EVENTS}")


_value("value_coalesce", ["coalesce", ["field", "score"], ["field", "value"]], "coalesce(score, value)")
_value("value_case", ["case", [["gt", "value", 50], ["literal", "high"]], [["is_null", "score"], ["literal", "none"]], ["else", ["literal", "low"]]], "CASE WHEN value > 50 THEN 'high' WHEN score IS NULL THEN 'none' ELSE 'low' END")
_value("value_arithmetic", ["add", ["multiply", ["field", "value"], ["field", "value"]], ["subtract", ["field", "score"], ["field", "value"]]], "value * value + (score - value)", 6)
_value("value_divide", ["divide", ["field", "user_id"], ["subtract", ["field", "event_id"], ["literal", 5, "integer"]]], "CAST(user_id AS DOUBLE) / nullif(CAST(event_id - 5 AS DOUBLE), 0)", 9)
_value("value_concat_null", ["concat", ["field", "event_type"], ["literal", "-"], ["field", "active"]], "concat(event_type, '-', CAST(active AS VARCHAR))")
_value("value_lower_upper", ["concat", ["upper", ["field", "event_type"]], ["lower", ["literal", "ABC"]]], "upper(event_type) || 'abc'")
_value("value_json_text", ["json_text", "props", ["k"]], "json_extract_string(props, '$.k')")
_value("value_json_index", ["json_text", "items", ["1", "sku"]], "'b'")
_value("value_days_between", ["days_between", ["field", "day"], ["literal", "2024-02-01", "date"]], "CAST(DATE '2024-02-01' - day AS BIGINT)")
_value("value_cast", ["cast", ["field", "user_id"], "string"], "CAST(user_id AS VARCHAR)")
_add("computed_columns", lambda s: s.orders.dataframe(Query().select("o_orderkey", "is_large", "size_band", "customer_label")), "SELECT o_orderkey, o_totalprice >= 150000 AS is_large, CASE WHEN o_totalprice <= 50000 THEN 'small' WHEN o_totalprice >= 50000.01 AND o_totalprice <= 150000 THEN 'medium' ELSE 'large' END AS size_band, coalesce(c_name, 'nobody') AS customer_label FROM orders LEFT JOIN customer ON o_custkey = c_custkey")

_DATE_SQL = {
    "day": "strftime(ts, '%Y-%m-%d')", "time": "strftime(ts, '%H:%M:%S')", "day_hour": "strftime(ts, '%Y-%m-%d %H')", "day_minute": "strftime(ts, '%Y-%m-%d %H:%M')",
    "month": "strftime(ts, '%Y-%m')", "year": "strftime(ts, '%Y')", "month_of_year": "strftime(ts, '%m')", "month_day": "strftime(ts, '%m-%d')",
    "day_of_month": "strftime(ts, '%d')", "day_of_year": "strftime(ts, '%j')", "hour": "strftime(ts, '%H')", "quarter": "strftime(ts, '%Y') || '-Q' || quarter(ts)",
    "day_of_week": "strftime(ts, '%A')", "us_date": "strftime(ts, '%m/%d/%Y')", "us_datetime": "strftime(ts, '%m/%d/%Y %-I:%M %p')",
    "week": "strftime(ts, '%G-W%V')", "iso_week": "strftime(ts, '%G-W%V')", "iso_week_date": "strftime(ts, '%G-W%V-%u')", "day_of_week_num": "strftime(ts, '%u')",
    "iso8601": "strftime(ts, '%Y-%m-%dT%H:%M:%S')", "rfc3339_millis": "strftime(ts, '%Y-%m-%dT%H:%M:%S.%g')", "epoch_seconds": "CAST(floor(epoch(ts)) AS BIGINT)",
    "epoch_milliseconds": "epoch_us(ts) // 1000", "timezone_offset": "'+00:00'",
}
for _style in FORMATS:
    _add(f"date_format_{_style}", lambda s, style=_style: s.events.dataframe(Query().select("event_id", E.datetime_format("ts", style).as_("x"))), f"SELECT event_id, {_DATE_SQL[_style]} AS x FROM events")
_add("date_format_epoch_instant", lambda s: s.events.dataframe(Query().select("event_id", E.datetime_format("epoch", "iso8601").as_("x"))), "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS x FROM events")
_add("date_format_zone", lambda s: s.events.dataframe(Query().select("event_id", E.datetime_format("stamp", "iso8601", timezone="America/New_York").as_("x"))), "SELECT event_id, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%S-05:00') AS x FROM events")
for _id in SHORTCUTS:
    _low, _high = bounds(_id, TODAY)
    _test = f"strftime(ts, '%m-%d') BETWEEN '{_low}' AND '{_high}'" if _id in RECURRING else f"ts >= DATE '{_low}' AND ts < DATE '{_high}'"
    _add(f"date_shortcut_{_id}", lambda s, i=_id: s.events.dataframe(Query().select("event_id").where(E.date_shortcut("ts", i))), f"SELECT event_id FROM events WHERE {_test}")


def _bucket(name: str, engine: str, field: str, spec: dict, sql: str, table: str) -> None:
    node = E.bucket(field, spec)
    _add(name, lambda s: getattr(s, engine).dataframe(Query().select(node.as_("bucket"), E.count().as_("n")).group_by(node)), f"SELECT {sql} AS bucket, count(*) AS n FROM {table} GROUP BY 1")


_bucket("bucket_numeric", "parts", "p_size", {"kind": "numeric_increment", "increment": 10}, "CAST(p_size // 10 * 10 AS VARCHAR) || '-' || CAST(p_size // 10 * 10 + 9 AS VARCHAR)", "part")
_bucket("bucket_numeric_null", "events", "score", {"kind": "numeric_increment", "increment": 20}, "CASE WHEN score IS NULL THEN 'Other' ELSE CAST(CAST(floor(score / 20) AS BIGINT) * 20 AS VARCHAR) || '-' || CAST(CAST(floor(score / 20) AS BIGINT) * 20 + 19 AS VARCHAR) END", _EVENTS)
_bucket("bucket_year", "orders", "o_orderdate", {"kind": "year_increment", "increment": 2}, "CAST(year(o_orderdate) // 2 * 2 AS VARCHAR) || '-' || CAST(year(o_orderdate) // 2 * 2 + 1 AS VARCHAR)", "orders")
_bucket("bucket_text_prefix", "parts", "p_name", {"kind": "text_prefix", "prefix_length": 3, "exclude_articles": True}, "CASE WHEN trim(p_name) = '' THEN 'Other' ELSE upper(left(regexp_replace(trim(p_name), '^(a|an|the)(\\s+|$)', '', 'i'), 3)) END", "part")
_bucket("bucket_ranges", "parts", "p_size", {"kind": "numeric_ranges", "ranges": [{"maximum": 9, "label": "small"}, {"minimum": 10, "maximum": 29, "label": "middle"}]}, "CASE WHEN p_size <= 9 THEN 'small' WHEN p_size BETWEEN 10 AND 29 THEN 'middle' ELSE 'Other' END", "part")
_bucket("bucket_year_ranges", "orders", "o_orderdate", {"kind": "year_ranges", "ranges": [{"maximum": 1996, "label": "early"}, {"minimum": 1999, "label": "late"}]}, "CASE WHEN year(o_orderdate) <= 1996 THEN 'early' WHEN year(o_orderdate) >= 1999 THEN 'late' ELSE 'Other' END", "orders")
_bucket("bucket_elapsed_days", "events", "ts", {"kind": "elapsed_days_ranges", "ranges": [{"minimum": 0, "maximum": 7, "label": "week"}, {"minimum": 8, "label": "older"}]}, f"CASE WHEN DATE '{TODAY}' - CAST(ts AS DATE) BETWEEN 0 AND 7 THEN 'week' WHEN DATE '{TODAY}' - CAST(ts AS DATE) >= 8 THEN 'older' ELSE 'Other' END", "events")
_bucket("bucket_relative_days", "events", "ts", {"kind": "date_relative_ranges", "ranges": [{"minimum": "today", "maximum": "today", "label": "today"}, {"minimum": "tomorrow", "maximum": "tomorrow", "label": "tomorrow"}, {"minimum": 1, "maximum": 7, "label": "last week"}]}, f"CASE WHEN CAST(ts AS DATE) = DATE '{TODAY}' THEN 'today' WHEN CAST(ts AS DATE) = DATE '{TODAY}' + 1 THEN 'tomorrow' WHEN DATE '{TODAY}' - CAST(ts AS DATE) BETWEEN 1 AND 7 THEN 'last week' ELSE 'Other' END", "events")
_bucket("bucket_months", "events", "ts", {"kind": "month_ranges", "ranges": [{"minimum": 0, "maximum": 0, "label": "this month"}, {"minimum": 1, "label": "before"}]}, "CASE WHEN (2024 * 12 + 1) - (year(ts) * 12 + month(ts)) = 0 THEN 'this month' WHEN (2024 * 12 + 1) - (year(ts) * 12 + month(ts)) >= 1 THEN 'before' ELSE 'Other' END", "events")

# -- nested, text ----------------------------------------------------------------------------


def _decoded(df: DataFrame, shape: str) -> DataFrame:
    """A JSON collection as one text that both engines write alike."""
    return df.withColumn("items", F.from_json("items", f"array<struct<{shape}>>"))


def _nested(name: str, sql: str, **options: object) -> None:
    def run(s: Site) -> DataFrame:
        q = Query().select("o_orderkey", E.related_collection("lines", ["l_linenumber", "l_suppkey"], **options).as_("items"))
        made = _decoded(s.orders.dataframe(q), "l_linenumber: int, l_suppkey: bigint")
        return made.select("o_orderkey", F.size("items").cast("long").alias("n"), F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_suppkey"].cast("string"))), ",").alias("items"))

    _add(name, run, sql)


_LIST = "coalesce(string_agg(l_linenumber || ':' || l_suppkey, ',' ORDER BY {o}), '')"
_nested("related_collection", f"SELECT o_orderkey, count(l_orderkey) AS n, {_LIST.format(o='l_linenumber, l_suppkey')} AS items FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1", order_by=["l_linenumber", "l_suppkey"])
_TOP = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_suppkey) AS k FROM lineitem) t ON o_orderkey = l_orderkey AND k <= 2"
_nested("related_topn", f"SELECT o_orderkey, count(l_orderkey) AS n, {_LIST.format(o='k')} AS items FROM orders LEFT JOIN {_TOP} GROUP BY 1", order_by=[("l_quantity", "desc"), ("l_linenumber", "asc"), ("l_suppkey", "asc")], limit=2)
_nested("related_filtered", f"SELECT o_orderkey, count(l_orderkey) AS n, {_LIST.format(o='l_linenumber, l_suppkey')} AS items FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R' GROUP BY 1", order_by=["l_linenumber", "l_suppkey"], filters={"l_returnflag": "R"})
_nested("related_cursor", f"SELECT o_orderkey, count(l_orderkey) AS n, {_LIST.format(o='l_linenumber, l_suppkey')} AS items FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND (l_orderkey <> 5 OR l_linenumber > 2) GROUP BY 1", order_by=["l_linenumber", "l_suppkey"], after={"parent": 5, "values": [2, 1000000]})
_add("related_sum_count", lambda s: _rounded(s.orders.dataframe(Query().select("o_orderkey", E.related_sum("lines", "l_quantity").as_("total"), E.related_count("lines", "l_linenumber").as_("n"), E.related_count("suppliers", "s_suppkey").as_("suppliers"))), "total"), "SELECT o_orderkey, round(coalesce(sum(l_quantity), 0), 4) AS total, count(l_linenumber) AS n, count(s_suppkey) AS suppliers FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")


def _nested_twice(s: Site) -> DataFrame:
    lines = E.related_collection("lines", ["l_linenumber"], order_by=["l_linenumber"])
    q = Query().select("c_custkey", E.related_collection("orders", ["o_orderkey", ("lines", lines)], order_by=["o_orderkey"]).as_("items"))
    made = _decoded(s.customers.dataframe(q), "o_orderkey: bigint, lines: array<struct<l_linenumber: int>>")
    return made.select("c_custkey", F.size("items").cast("long").alias("orders"), F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + F.size(x["lines"])).alias("lines"))


def _nested_detail(s: Site) -> DataFrame:
    made = _decoded(s.orders.dataframe(Api(s.orders).nested_detail("lines", ["o_orderkey"], ["l_linenumber"], children=2)).withColumnRenamed("lines", "items"), "l_linenumber: int")
    return made.select("o_orderkey", F.array_join(F.transform("items", lambda x: x["l_linenumber"].cast("string")), ",").alias("lines"))


_add("nested_detail", _nested_detail, "SELECT o_orderkey, coalesce(string_agg(l_linenumber, ',' ORDER BY k), '') AS lines FROM (SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 25) LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem) ON o_orderkey = l_orderkey AND k <= 2 GROUP BY 1")
_add("related_nested", _nested_twice, "SELECT c_custkey, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS lines FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
_TOKENS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_add("text_search_plain", lambda s: s.texts.dataframe(Query().select("doc_id").where(E.text_search(["text"], "The apache license"))), f"SELECT doc_id FROM documents WHERE list_has_all({_TOKENS}, ['the', 'apache', 'license'])")
_add("text_search_phrase", lambda s: s.texts.dataframe(Query().select("doc_id").where(E.text_search(["text"], "apache license", mode="phrase"))), f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_TOKENS}, ' ') || ' ', ' apache license ')")
_add("text_search_prefix", lambda s: s.texts.dataframe(Query().select("doc_id").where(E.text_search(["text", "source"], "licens src1", mode="prefix"))), r"SELECT doc_id FROM documents WHERE len(list_filter(string_split_regex(lower(text || ' ' || source), '[^\p{L}\p{N}]+'), lambda x: starts_with(x, 'licens'))) > 0 AND len(list_filter(string_split_regex(lower(text || ' ' || source), '[^\p{L}\p{N}]+'), lambda x: starts_with(x, 'src1'))) > 0")
_add("text_search_websearch", lambda s: s.texts.dataframe(Query().select("doc_id").where(E.text_search(["text"], '"apache license" -worthless or trash', mode="websearch"))), f"SELECT doc_id FROM documents WHERE (contains(' ' || array_to_string({_TOKENS}, ' ') || ' ', ' apache license ') AND NOT list_contains({_TOKENS}, 'worthless')) OR list_contains({_TOKENS}, 'trash')")
_add("text_rank", lambda s: _rounded(s.texts.dataframe(Query().select("doc_id", E.text_rank(["text"], "license").as_("score")).where(E.text_search(["text"], "license"))), "score"), f"SELECT doc_id, round(len(list_filter({_TOKENS}, lambda x: x = 'license')) * 1000.0 / greatest(len({_TOKENS}), 1), 4) AS score FROM documents WHERE list_contains({_TOKENS}, 'license')")

# -- analytics ---------------------------------------------------------------------------------

_SERIES_SQL = "(SELECT strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN count(*) % 4 = 0 THEN NULL ELSE CAST(count(*) AS DOUBLE) END AS v FROM orders GROUP BY 1)"


def _series(s: Site) -> DataFrame:
    month = E.datetime_format("o_orderdate", "month")
    flat = s.orders.dataframe(Query().select(month.as_("month"), E.count().as_("n")).group_by(month))
    return flat.select("month", F.when(F.col("n") % 4 != 0, F.col("n").cast("double")).alias("v"))


def _analytic(name: str, steps: list, sql: str, unit: str = "count", behavior: str | None = "flow") -> None:
    def run(s: Site) -> DataFrame:
        made, _ = transform(_series(s), "v", steps, order_by=["month"], unit=unit, behavior=behavior, out="y")
        return _rounded(made.select("month", "y"), "y", digits=6)

    _add(f"analytics_{name}", run, sql if sql.startswith("SELECT") else f"SELECT month, round({sql}, 6) AS y FROM {_SERIES_SQL}")


_analytic("percent_of_total", ["percent_of_total"], "v / nullif(sum(v) OVER (), 0) * 100")
_analytic("percent_change", ["percent_change"], "(v - lag(v) OVER (ORDER BY month)) / nullif(lag(v) OVER (ORDER BY month), 0) * 100")
_analytic("percentage_point_change", ["percentage_point_change"], "v - lag(v) OVER (ORDER BY month)", "percentage", None)
_analytic("index_to_first", ["index_to_first"], "v / (SELECT arg_min(v, month) FROM " + _SERIES_SQL + " WHERE v <> 0) * 100")
_analytic("cumulative", ["cumulative"], "CASE WHEN v IS NOT NULL THEN sum(v) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) END")
_analytic("moving_average", [{"id": "moving_average", "window": 3}], "CASE WHEN v IS NOT NULL THEN avg(v) OVER (ORDER BY month ROWS 2 PRECEDING) END")
_analytic("min_max", ["min_max"], "(v - min(v) OVER ()) / nullif(max(v) OVER () - min(v) OVER (), 0) * 100")
_analytic("z_score", ["z_score"], "(v - avg(v) OVER ()) / nullif(stddev_pop(v) OVER (), 0)")
_analytic("exponential_moving_average", [{"id": "exponential_moving_average", "alpha": 0.4}], "CASE WHEN v IS NOT NULL THEN list_reduce(list(v) FILTER (WHERE v IS NOT NULL) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING), lambda s, x: x * 0.4::DOUBLE + s * 0.6::DOUBLE) END")
_analytic("chained", ["cumulative", {"id": "moving_average", "window": 2}], f"SELECT month, round(CASE WHEN c IS NOT NULL THEN avg(c) OVER (ORDER BY month ROWS 1 PRECEDING) END, 6) AS y FROM (SELECT month, CASE WHEN v IS NOT NULL THEN sum(v) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) END AS c FROM {_SERIES_SQL})")

# -- surfaces ----------------------------------------------------------------------------------

_add("api_filters", lambda s: _whole(Api(s.orders), {"select": ["o_orderkey", {"field": "customer.c_name", "alias": "name"}], "filters": [{"any": [{"field": "o_orderstatus", "op": "eq", "value": "P"}, {"all": [{"field": "o_totalprice", "op": "between", "value": 1000, "end": 20000}, {"field": "customer.c_mktsegment", "op": "not_in", "value": ["BUILDING"]}]}]}], "order_by": [{"field": "o_orderkey"}]}), "SELECT o_orderkey, c_name AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' OR (o_totalprice BETWEEN 1000 AND 20000 AND c_mktsegment NOT IN ('BUILDING')) ORDER BY 1")
_add("api_page", lambda s: Api(s.orders).frame({"select": ["o_orderkey", "o_totalprice"], "order_by": [{"field": "o_totalprice", "direction": "desc"}, {"field": "o_orderkey"}], "limit": 40, "offset": 20}), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 20")
_add("api_aggregates", lambda s: _rounded(_whole(Api(s.orders), {"select": ["o_orderpriority", {"aggregate": "count", "alias": "n"}, {"aggregate": "avg", "field": "o_totalprice", "alias": "mean"}, {"aggregate": "count_distinct", "field": "o_custkey", "alias": "customers"}], "group_by": ["o_orderpriority"]}), "mean"), "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
_add("api_rollup", lambda s: _whole(Api(s.orders), {"select": ["o_orderpriority", {"aggregate": "count", "alias": "n"}], "group_by": ["o_orderpriority"], "rollup": True}), "SELECT o_orderpriority, count(*) AS n, GROUPING(o_orderpriority) AS grouping FROM orders GROUP BY ROLLUP (o_orderpriority)")
_EXPLORER = Options(explorer=True)
_add("explorer_groups", lambda s: _whole(Api(s.orders, _EXPLORER), {"select": [{"group": "year"}, {"group": "band"}, {"aggregate": "count_where", "field": "o_totalprice", "where": [["gt", 100000]], "alias": "dear"}], "group_by": [{"field": "o_orderdate", "alias": "year", "format": "year"}, {"field": "o_totalprice", "alias": "band", "ranges": [{"where": [["lt", 50000]], "label": "low"}, {"where": [["gte", 50000], ["lt", 200000]], "label": "mid"}]}]}), "SELECT strftime(o_orderdate, '%Y') AS year, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice >= 50000 AND o_totalprice < 200000 THEN 'mid' ELSE 'Other' END AS band, count(*) FILTER (WHERE o_totalprice > 100000) AS dear FROM orders GROUP BY 1, 2")
_add("explorer_grid", lambda s: Api(s.orders, _EXPLORER).grid({"select": ["o_orderpriority", "o_orderstatus", {"aggregate": "count", "alias": "n"}], "group_by": ["o_orderpriority", "o_orderstatus"]}, "n"), "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
_add("explorer_levels", lambda s: Api(s.orders, _EXPLORER).levels({"select": ["o_orderstatus", "o_orderpriority", {"aggregate": "count", "alias": "n"}], "group_by": ["o_orderstatus", "o_orderpriority"]}), "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(2 - bit_count(GROUPING(o_orderstatus, o_orderpriority)) AS BIGINT) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_add("explorer_drilldown", lambda s: _whole(Api(s.orders, _EXPLORER), {"select": ["o_orderkey"], "filters": [{"field": "o_orderdate", "format": "month", "op": "eq", "value": "1996-03"}], "order_by": [{"field": "o_orderkey"}]}), "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1996-03' ORDER BY 1")
_add("explorer_summary", lambda s: Api(s.orders).summary("o_custkey"), "SELECT count(*) AS rows, count(o_custkey) AS filled, count(DISTINCT o_custkey) AS distinct, min(o_custkey) AS minimum, max(o_custkey) AS maximum FROM orders")
_add("explorer_choices", lambda s: Api(s.customers).choices("c_mktsegment", "b"), "SELECT c_mktsegment AS value, count(*) AS count FROM customer WHERE starts_with(lower(c_mktsegment), 'b') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")


def _page(s: Site) -> Page:
    views = [{"id": "list", "kind": "detail", "query": Query().select("o_orderkey", "o_totalprice").order_by("o_totalprice", "desc")}, {"id": "by_status", "kind": "aggregate", "query": Query().select("o_orderstatus", E.count_distinct("o_orderkey").as_("n")).group_by("o_orderstatus")}]
    controls = [{"id": "priority", "kind": "facet", "field": "o_orderpriority"}, {"id": "price", "kind": "range", "field": "o_totalprice"}, {"id": "flag", "kind": "facet", "field": "lines.l_returnflag"}]
    return Page(s.orders, views, controls)


_STATE = {"filters": {"priority": ["1-URGENT"], "price": {"min": 100000}, "flag": ["R"]}, "limit": 20, "page": 2}
_PAGE_WHERE = "o_totalprice >= 100000 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"
_add("page_rows", lambda s: s.orders.dataframe(_page(s).plan(_STATE).query), f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND {_PAGE_WHERE} ORDER BY o_totalprice DESC, o_orderkey LIMIT 21 OFFSET 20")
_add("page_total", lambda s: s.orders.dataframe(_page(s).plan(_STATE).total), f"SELECT count(*) AS total FROM orders WHERE o_orderpriority = '1-URGENT' AND {_PAGE_WHERE}")
_add("page_facet", lambda s: s.orders.dataframe(_page(s).plan(_STATE).facets["priority"]), f"SELECT o_orderpriority AS value, count(*) AS count FROM orders WHERE {_PAGE_WHERE} GROUP BY 1")
_add("page_drilldown", lambda s: s.orders.dataframe(_page(s).plan({"drilldown": {"view": "by_status", "values": ["P"]}, "limit": 100}).query), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 101")

# -- rules, imports, writes, sinks ---------------------------------------------------------------

_add("data_rules", lambda s: apply_rules(s.catalog.table("events_more"), [("type", "event_type", {"op": "membership.in", "values": ["click", "view"]}), ("score", "score", {"op": "all", "rules": [{"op": "presence.non_null"}, {"op": "number.range", "min": 10, "max": 60}]}), ("tags", "tags", {"op": "any", "rules": [{"op": "collection.count", "min": 3}, {"op": "not", "rule": {"op": "type.is", "type": "collection"}}]})]).select("event_id", "rule_type", "rule_score", "rule_tags", "rule_failures"), f"SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view') THEN 'not_included' END AS rule_type, CASE WHEN score IS NULL THEN 'null' WHEN NOT (score >= 10 AND score <= 60) THEN 'numeric_range' END AS rule_score, CASE WHEN tags IS NOT NULL THEN 'no_rule_matched' END AS rule_tags, CAST((event_type NOT IN ('click', 'view'))::INT + (score IS NULL OR score < 10 OR score > 60)::INT + (tags IS NOT NULL)::INT AS INTEGER) AS rule_failures FROM {_EVENTS}")
_add("normalizers", lambda s: s.catalog.table("customer").select("c_custkey", normalize(F.concat(F.lit(" "), "c_name", F.lit("\t")), ["trim", "uppercase"]).alias("name")), "SELECT c_custkey, upper(c_name) AS name FROM customer")


def _import(s: Site) -> DataFrame:
    rows = s.catalog.table("supplier").select((F.col("s_suppkey") * 3).cast("string").alias("Key"), F.concat(F.lit("  "), "s_name").alias("Name"), F.lit("").alias("Note"))
    mapping = {"c_custkey": {"column": "Key"}, "c_name": {"column": "Name", "transforms": ["trim", "uppercase"], "required": True}, "c_mktsegment": {"source": "static", "value": "BUILDING"}, "note": {"column": "Note", "blank": "null"}}
    return preview(rows, mapping, s.catalog.table("customer"), ["c_custkey"])


_add("import_preview", _import, "SELECT CAST(s_suppkey * 3 AS VARCHAR) AS c_custkey, upper(s_name) AS c_name, 'BUILDING' AS c_mktsegment, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS VARCHAR) AS error, CASE WHEN c.c_custkey IS NULL THEN 'insert' ELSE 'update' END AS operation, CAST((c.c_custkey IS NOT NULL)::INT AS BIGINT) AS matches FROM supplier LEFT JOIN customer c ON c.c_custkey = s_suppkey * 3")


def _writer(s: Site) -> Writer:
    return Writer(s.engine(orders_document() | {"writes": {"operations": ["insert", "update", "upsert", "delete"], "fields": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]}}))


_ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
_add("write_update", lambda s: _writer(s).update({"o_orderstatus": "X", "o_totalprice": ["increment", 100]}, ["eq", "o_orderpriority", "5-LOW"]).table, "SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice + 100 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders")
_add("write_delete", lambda s: _writer(s).delete(["gt", "o_totalprice", 200000]).table, f"SELECT {_ORDER_COLUMNS} FROM orders WHERE NOT o_totalprice > 200000")
_add("write_upsert", lambda s: _writer(s).upsert([{"o_orderkey": 1, "o_orderstatus": "Z"}, {"o_orderkey": -1, "o_orderstatus": "N"}], ["o_orderkey"]).table, f"SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey = 1 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders UNION ALL SELECT -1, NULL, 'N', NULL, NULL, NULL")
_add("sink_csv", lambda s: delimited_lines(s.customers.dataframe(Query().select("c_custkey", "c_name", E.parse_value(["literal", "=1,2", "string"]).as_("x")))), "SELECT CAST(c_custkey AS VARCHAR) || ',' || c_name || ',\"''=1,2\"' AS line FROM customer")
_add("sink_json", lambda s: json_rows(s.customers.dataframe(Query().select("c_mktsegment", "c_custkey"))), "SELECT '{\"c_custkey\":' || c_custkey || ',\"c_mktsegment\":\"' || c_mktsegment || '\"}' AS json FROM customer")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: (lambda spark, folder, run=run: run(Site(spark, folder))) for k, (run, _) in _FOUND.items()}
ORACLES: dict[str, str] = {k: sql for k, (_, sql) in _FOUND.items() if sql is not None}
