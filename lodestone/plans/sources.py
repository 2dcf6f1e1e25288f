"""Further relations of a query: CTEs, inline values, sub-queries, laterals, rowsets."""

from __future__ import annotations

from dataclasses import replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import expr as E
from ..errors import require
from ..functions.text import json_path
from ..query import Query, Source
from ..scratch import written
from ..types import category, spark_type
from .values import Typed


if TYPE_CHECKING:
    from .lower import Compiled, Lowering

ROOT_LEVELS = 100  # of a recursion without max_depth


def add_source(low: Lowering, source: Source, prefix: str) -> None:
    """Join a source to the lowering's frame and make ``alias.column`` known."""
    {
        "cte": _cte,
        "recursive_cte": _recursive,
        "values": _values,
        "subquery": _subquery,
        "lateral": _lateral,
        "array_rowset": _array_rowset,
        "json_rowset": _json_rowset,
        "function": _function,
    }[source.kind](low, source.alias, source.spec, prefix)


def _compile(low: Lowering, spec: dict[str, Any], key: str = "query", domain_key: str = "domain") -> Compiled:
    from .lower import compile_query

    domain = spec.get(domain_key) or low.domain
    query = spec[key](low.engine, domain) if callable(spec[key]) else spec[key]
    require(isinstance(query, Query), "invalid_query", "expected a query as source")
    return compile_query(low.engine, domain, query)


def _named(low: Lowering, alias: str, compiled: Compiled, prefix: str, columns: Any = None) -> DataFrame:
    names = list(columns or compiled.names)
    require(len(names) == len(compiled.names) and len(set(names)) == len(names), "invalid_query", "columns of a source: one name each, and all named", source=alias)
    low.sources[alias] = {n: Typed(F.col(prefix + n), k) for n, k in zip(names, compiled.types)}
    return compiled.frame.toDF(*[prefix + n for n in names])


def _attach(low: Lowering, alias: str, frame: DataFrame, spec: dict[str, Any], prefix: str) -> None:
    """Join on owner = related, or cross join without them."""
    if spec["owner"] is None:
        low.frame = low.frame.crossJoin(frame)
        return
    require(spec["related"] in low.sources[alias], "unknown_field", "no field has this path", field=str(spec["related"]))
    owner = low.field(spec["owner"]).col
    low.frame = low.frame.join(frame, owner == F.col(prefix + spec["related"]), spec["join_type"])


def _cte(low: Lowering, alias: str, spec: dict[str, Any], prefix: str) -> None:
    frame = _named(low, alias, _compile(low, spec), prefix, spec["columns"])
    _attach(low, alias, frame, spec, prefix)


def _subquery(low: Lowering, alias: str, spec: dict[str, Any], prefix: str) -> None:
    frame = _named(low, alias, _compile(low, spec), prefix)
    condition = F.lit(True)
    for mine, theirs in spec["on"]:
        require(theirs in low.sources[alias], "unknown_field", "no field has this path", field=theirs)
        condition = condition & (low.field(mine).col == F.col(prefix + theirs))
    low.frame = low.frame.join(frame, condition, spec["join_type"])


def _values(low: Lowering, alias: str, spec: dict[str, Any], prefix: str) -> None:
    """Cells are BIGINT, DOUBLE, BOOLEAN or text; a column's type is that of its cells."""
    from .lower import _typed_cell

    names = [c if isinstance(c, str) else c[0] for c in spec["columns"]]
    kinds = []
    for i, c in enumerate(spec["columns"]):
        cells = [r[i] for r in spec["rows"] if r[i] is not None]
        guess = "boolean" if cells and all(isinstance(v, bool) for v in cells) else "integer" if cells and all(isinstance(v, int) for v in cells) else "double" if cells and all(isinstance(v, (int, float)) for v in cells) else "string"
        kinds.append(guess if isinstance(c, str) else c[1])
    require(all(len(r) == len(names) for r in spec["rows"]), "invalid_query", "a row is longer or shorter than the columns", source=alias)
    schema = T.StructType([T.StructField(prefix + n, spark_type(k)) for n, k in zip(names, kinds)])
    rows = [tuple(_typed_cell(v, f.dataType) for v, f in zip(r, schema)) for r in spec["rows"]]
    frame = F.broadcast(low.engine.spark.createDataFrame(rows, schema))  # rows written in the query
    low.sources[alias] = {n: Typed(F.col(prefix + n), k) for n, k in zip(names, kinds)}
    _attach(low, alias, frame, spec, prefix)


def _lateral(low: Lowering, alias: str, spec: dict[str, Any], prefix: str) -> None:
    """The sub-query for each row's correlation values. Equalities let it run once for
    all rows: grouped by the correlated fields if it aggregates, numbered within them if
    it is limited."""
    domain = spec.get("domain") or low.domain
    q = spec["query"](low.engine, domain) if callable(spec["query"]) else spec["query"]
    keys = [E.field(theirs).as_(f"k{i}_") for i, (_, theirs) in enumerate(spec["on"])]
    aggregated = any(E.is_aggregate(s) for s in q.selections)
    outer = spec["join_type"]
    page = (q.limit_value, q.offset_value)
    if aggregated and not q.groups:
        inner = replace(q, groups=tuple(k.bare for k in keys), selections=(*q.selections, *keys), orders=(), limit_value=None, offset_value=None)
    elif page != (None, None):
        order = [E.window("row_number", partition_by=[k.bare for k in keys], order_by=list(q.orders)).as_("place_")]
        inner = replace(q, selections=(*q.selections, *keys, *order), orders=(), limit_value=None, offset_value=None, groups=(*q.groups, *[k.bare for k in keys]) if q.groups else ())
    else:
        inner = replace(q, selections=(*q.selections, *keys), orders=(), groups=(*q.groups, *[k.bare for k in keys]) if q.groups else ())
    compiled = _compile(low, {"query": inner, "domain": domain})
    frame = _named(low, alias, compiled, prefix)
    if page != (None, None) and not (aggregated and not q.groups):
        limit, offset = page
        place = F.col(prefix + "place_")
        if limit is not None:  # a plain bound, for which Spark limits each group before the shuffle
            frame = frame.where(place <= limit + (offset or 0))
        if offset:
            frame = frame.where(place > offset)
    condition = F.lit(True)
    for i, (mine, _) in enumerate(spec["on"]):
        condition = condition & (low.field(mine).col == F.col(f"{prefix}k{i}_"))
    if aggregated and not q.groups:
        # an aggregate has a row for every parent; counts of nothing are 0
        low.frame = low.frame.join(frame, condition, "left")
        for s in q.selections:
            name = s.alias or (s.args[0] if s.kind == "field" else s.kind)
            if s.kind in ("count", "count_field", "count_distinct", "true_count", "false_count", "count_bucket"):
                known = low.sources[alias][name]
                low.sources[alias][name] = replace(known, col=F.coalesce(known.col, F.lit(0)))
    else:
        low.frame = low.frame.join(frame, condition, "left" if outer == "left" else "inner")


def _array_rowset(low: Lowering, alias: str, spec: dict[str, Any], prefix: str) -> None:
    x = low.field(spec["path"])
    require(x.kind == "array", "invalid_query", "only an array has elements", field=spec["path"])
    make = F.posexplode_outer if spec["join_type"] == "left" else F.posexplode
    low.frame = low.frame.select("*", make(x.col).alias(prefix + "position", prefix + "value"))
    low.sources[alias] = {"value": Typed(F.col(prefix + "value"), x.items or "string")}
    if spec["ordinality"]:
        low.sources[alias][spec["ordinality"]] = Typed((F.col(prefix + "position") + 1).cast("long"), "integer")


def _json_rowset(low: Lowering, alias: str, spec: dict[str, Any], prefix: str) -> None:
    x = low.field(spec["path"])
    require(category(x.kind) == "json", "invalid_query", "only JSON has objects", field=spec["path"])
    text = F.get_json_object(x.col, json_path(spec["json_path"])) if spec["json_path"] else x.col
    shape = T.StructType([T.StructField(n, spark_type(k)) for n, k in spec["columns"].items()])
    parsed = F.from_json(text, T.ArrayType(shape))
    make = F.inline_outer if spec["join_type"] == "left" else F.inline
    low.frame = low.frame.select("*", make(F.transform(parsed, lambda s: F.struct(*[s[n].alias(prefix + n) for n in spec["columns"]]))))
    low.sources[alias] = {n: Typed(F.col(prefix + n), k) for n, k in spec["columns"].items()}


def _series(start: Column, stop: Column, step: Column | None = None) -> Column:
    return F.explode(F.sequence(start, stop) if step is None else F.sequence(start, stop, step))


#: Table functions by name: columns in, a generator out.
TABLE_FUNCTIONS = {
    "generate_series": _series,
    "string_to_table": lambda text, separator: F.explode(F.split(text, separator)),
    "regexp_split_to_table": lambda text, pattern: F.explode(F.split(text, pattern)),
}


def _function(low: Lowering, alias: str, spec: dict[str, Any], prefix: str) -> None:
    functions = TABLE_FUNCTIONS | low.engine.table_functions
    require(spec["function"] in functions, "unsupported_feature", "no table function has this name", function=spec["function"])
    arguments = [low.field(a[1]).col if isinstance(a, (list, tuple)) and a[0] == "field" else F.lit(a) for a in spec["arguments"]]
    low.frame = low.frame.select("*", functions[spec["function"]](*arguments).alias(prefix + spec["column"]))
    column = F.col(prefix + spec["column"]).cast(spark_type(spec["type"]).simpleString())
    low.sources[alias] = {spec["column"]: Typed(column, spec["type"])}


def _recursive(low: Lowering, alias: str, spec: dict[str, Any], prefix: str) -> None:
    """Level by level: each one joins the step's rows to the level before and is written
    to the shared folder, until a level is empty or the depth is reached. Without a
    max_depth, a recursion that is not over after ROOT_LEVELS levels is refused."""
    from .lower import compile_query

    columns = list(spec["columns"])
    base = _compile(low, spec, "base")
    require(len(base.names) == len(columns), "invalid_query", "the anchor shows other columns than are declared")
    kinds = base.types
    depth = spec["max_depth"]
    level = written(base.frame.toDF(*columns).withColumn("recursion_depth", F.lit(1).cast("long")), "recursion")
    levels = [level]
    before, step_field = spec["step_on"]
    require(before in columns, "invalid_query", "the step joins on a column that the recursion lacks", column=before)
    domain = spec.get("step_domain") or spec.get("domain") or low.domain
    step = spec["step"](low.engine, domain) if callable(spec["step"]) else spec["step"]
    for k in range(2, (depth or ROOT_LEVELS + 1) + 1):
        if level.isEmpty():
            break
        require(depth is not None or k <= ROOT_LEVELS, "invalid_query", "the recursion doesn't end; bound it by max_depth")
        known = {c: Typed(F.col(f"p_{c}"), t) for c, t in zip(columns, kinds)}
        level = written(_step(low, compile_query, domain, step, level, known, before, step_field, columns, k), "recursion")
        levels.append(level)
    frame = levels[0]
    for one in levels[1:]:
        frame = frame.unionAll(one)
    names = [*columns, *(["recursion_depth"] if depth is not None else [])]
    low.sources[alias] = {n: Typed(F.col(prefix + n), k) for n, k in zip(names, [*kinds, "integer"])}
    _attach(low, alias, frame.select(*[F.col(n).alias(prefix + n) for n in names]), spec, prefix)


def _step(low: Lowering, compile_query: Any, domain: Any, step: Query, level: DataFrame, known: dict[str, Typed], before: str, step_field: str, columns: list[str], k: int) -> DataFrame:
    from .lower import Lowering

    one = Lowering(low.engine, domain, step, known)
    predicate = one._whole_predicate(step)
    used = [*step.selections, E.field(step_field), *([predicate] if predicate is not None else [])]
    frame = one.base(used)
    frame = frame.join(level.select(*[F.col(c).alias(f"p_{c}") for c in columns]), one.field(step_field).col == F.col(f"p_{before}"), "inner")
    if predicate is not None:
        frame = frame.where(one.values.column(predicate))
    require(len(step.selections) == len(columns), "invalid_query", "the step shows other columns than the anchor")
    return frame.select(*[one.values.column(s).alias(c) for s, c in zip(step.selections, columns)], F.lit(k).cast("long").alias("recursion_depth"))


