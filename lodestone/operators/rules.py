"""Row rules and normalizers as columns: a rule gives the code of its first failure,
or NULL where the row passes."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SelectError, require

CODE = "invalid_data_rules_contract"
MAX_DEPTH, MAX_CHILDREN = 16, 1000
TYPES = ("boolean", "integer", "decimal", "text", "string", "collection", "object")
@dataclass(frozen=True)
class Subject:
    """What a rule tests: its column, Spark type, and whether the row has the field."""

    col: Column
    kind: T.DataType
    present: bool


def subject(df: DataFrame, path: str) -> Subject:
    """A column or a field inside struct columns; missing ones are absent."""
    kind: Any = df.schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
            return Subject(F.lit(None), T.NullType(), False)
        kind = kind[part].dataType
    return Subject(F.col(path), kind, True)


def failure(df: DataFrame, path: str, rule: dict[str, Any]) -> Column:
    """The code of the first failure of ``rule`` at ``path``, else NULL."""
    check_rule(rule)
    return _failure(subject(df, path), rule, df)


def apply_rules(df: DataFrame, rules: list[tuple[str, str, dict[str, Any]]], prefix: str = "rule_") -> DataFrame:
    """Columns <prefix><name> for (name, path, rule), and <prefix>failures: how many."""
    made = {f"{prefix}{name}": failure(df, path, rule) for name, path, rule in rules}
    out = df.withColumns(made)
    return out.withColumn(f"{prefix}failures", reduce(lambda a, b: a + b, [F.col(n).isNotNull().cast("int") for n in made], F.lit(0)))

# -- the schema of rules -----------------------------------------------------------


def _numeric(value: Any) -> bool:
    try:
        return number(value) is not None
    except SelectError:
        return False


def _one_of(*names: Any) -> Callable[[Any], bool]:
    return lambda value: isinstance(value, str) and value in names


def _is_text(value: Any) -> bool:
    return isinstance(value, str)


def _is_flag(value: Any) -> bool:
    return isinstance(value, bool)


def _bounded_list(value: Any) -> bool:
    return isinstance(value, list) and 0 < len(value) <= MAX_CHILDREN


def _anything(value: Any) -> bool:
    return True


@dataclass(frozen=True)
class Schema:
    """The keys of an operator and what each may hold; which of them must be there; what
    must hold between them; the code of a breach."""

    keys: dict[str, Callable[[Any], bool]] = field(default_factory=dict)
    needs: tuple[str, ...] = ()
    between: Callable[[dict[str, Any]], bool] = _anything
    code: str = CODE


_BOUNDS: dict[str, Callable[[Any], bool]] = {"exact": _numeric, "min": _numeric, "max": _numeric}
_ORDERS = ("gt", "gte", "lt", "lte", "eq", "neq")


def _has_bounds(rule: dict[str, Any]) -> bool:
    """At least one bound, and the lower one not above the upper one."""
    given = [k for k in _BOUNDS if k in rule]
    return bool(given) and ("min" not in given or "max" not in given or number(rule["min"]) <= number(rule["max"]))


_BOUND = Schema({"bound": _numeric}, ("bound",))
_TEXT = Schema({"text": _is_text}, ("text",))
_VALUES = Schema({"values": _bounded_list}, ("values",))
_VALUE = Schema({"value": _anything}, ("value",))
_RULES = Schema({"rules": _bounded_list}, ("rules",))
SCHEMAS: dict[str, Schema] = {
    "presence.required": Schema(),
    "presence.non_null": Schema(),
    "presence.absent": Schema(),
    "type.is": Schema({"type": _one_of(*TYPES)}, ("type",)),
    "text.nonblank": Schema(),
    "text.length": Schema(_BOUNDS | {"unit": _one_of("unicode_scalar")}, between=_has_bounds),
    "text.pattern": Schema(
        {"profile": _one_of("ascii_v1"), "match": _one_of("full", "search"), "flags": lambda value: value == [], "pattern": lambda value: bool(ascii_pattern(value)) or value == ""},
        ("profile", "match", "pattern"),
        code="invalid_text_pattern",
    ),
    **dict.fromkeys(("text.prefix", "text.suffix", "text.contains"), _TEXT),
    "number.integer": Schema(),
    **dict.fromkeys(("number.gt", "number.gte", "number.lt", "number.lte"), _BOUND),
    "number.range": Schema({"min": _numeric, "max": _numeric, "include_min": _is_flag, "include_max": _is_flag}, ("min", "max"), _has_bounds),
    "number.multiple_of": Schema({"factor": lambda value: _numeric(value) and number(value) != 0}, ("factor",)),
    **dict.fromkeys(("membership.in", "membership.not_in"), _VALUES),
    **dict.fromkeys(("value.eq", "value.neq"), _VALUE),
    "value.compare_path": Schema({"comparison": _one_of(*_ORDERS), "path": _is_text}, ("comparison", "path"), code="invalid_related_value_rule"),
    "collection.count": Schema(_BOUNDS, between=_has_bounds),
    "collection.sum": Schema(_BOUNDS | {"path": _is_text}, ("path",), _has_bounds),
    "collection.unique_by": Schema({"paths": lambda value: _bounded_list(value) and len(set(value)) == len(value)}, ("paths",)),
    **dict.fromkeys(("all", "any"), _RULES),
    "not": Schema({"rule": _anything}, ("rule",)),
}


def check_rule(rule: Any, depth: int = 0) -> None:
    """Hold a rule and those inside it against their schemas."""
    require(depth <= MAX_DEPTH, CODE, f"rules stand more than {MAX_DEPTH} deep in each other")
    require(isinstance(rule, dict), CODE, "expected a rule as an object with op")
    op = rule.get("op")
    require(isinstance(op, str) and op in SCHEMAS, "unsupported_rule_operator", "no rule operator has this name", op=str(op))
    schema = SCHEMAS[op]
    foreign = sorted(rule.keys() - schema.keys.keys() - {"op"})
    require(not foreign, CODE, f"{op} has no such keys", keys=foreign)
    for key, holds in schema.keys.items():
        if key in rule or key in schema.needs:
            require(key in rule and holds(rule[key]), schema.code, f"{op}: {key} is missing or of another kind")
    require(schema.between(rule), schema.code, f"{op}: its bounds are missing or the wrong way round")
    for child in [*rule.get("rules", ()), *([rule["rule"]] if op == "not" else [])]:
        check_rule(child, depth + 1)


def number(value: Any) -> Decimal:
    """A finite number given as number or text."""
    try:
        require(value is not None and not isinstance(value, bool), CODE, "expected a number")
        made = Decimal(str(value))
        require(made.is_finite(), CODE, "expected a finite number")
        return made
    except InvalidOperation:
        require(False, CODE, "expected a number", value=str(value))
        raise


def ascii_pattern(pattern: Any) -> str:
    """A regular expression of the ascii_v1 subset: literals, classes, groups,
    alternation and bounded or unbounded repeats; no anchors, look-around,
    back-references or modifiers."""
    require(isinstance(pattern, str) and pattern.isascii(), "invalid_text_pattern", "pattern: expected ASCII text")
    require(not re.search(r"\(\?(?!:)|\\[1-9bBAzZGk]|(?<!\\)(?:\\\\)*[\^$](?![^\[]*\])", re.sub(r"\[\^", "[", pattern)), "invalid_text_pattern", "pattern: holds a construct that ascii_v1 leaves out")
    try:
        re.compile(pattern)
    except re.error:
        require(False, "invalid_text_pattern", "pattern: no regular expression")
    return pattern


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _literal_equal(s: Subject, value: Any) -> Column:
    """Equality of value and type: text never equals a number."""
    if value is None:
        return s.col.isNull()
    if isinstance(value, bool):
        return (s.col == F.lit(value)) if isinstance(s.kind, T.BooleanType) else F.lit(False)
    if isinstance(value, (int, float, Decimal)):
        return (s.col == F.lit(Decimal(str(value))).cast("decimal(38,10)")) if _is_number(s.kind) else F.lit(False)
    if isinstance(value, str):
        return (s.col == F.lit(value)) if isinstance(s.kind, T.StringType) else F.lit(False)
    if isinstance(value, list) and isinstance(s.kind, T.ArrayType):
        return F.to_json(F.struct(s.col.alias("x"))) == F.to_json(F.struct(F.array(*map(F.lit, value)).cast(s.kind).alias("x")))
    return F.lit(False)


def _code(ok: Column, code: str) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), code)


def _within(x: Column, rule: dict[str, Any]) -> Column:
    ok = F.lit(True)
    for key, test in (("exact", x.__eq__), ("min", x.__ge__), ("max", x.__le__)):
        if key in rule:
            ok = ok & test(F.lit(number(rule[key])).cast("decimal(38,10)"))
    return ok


def _failure(s: Subject, rule: dict[str, Any], df: DataFrame) -> Column:
    op = rule["op"]
    if op == "all":
        return F.coalesce(*[_failure(s, r, df) for r in rule["rules"]])
    if op == "any":
        passed = reduce(lambda a, b: a | b, [_failure(s, r, df).isNull() for r in rule["rules"]])
        return F.when(~passed, "no_rule_matched")
    if op == "not":
        return F.when(_failure(s, rule["rule"], df).isNull(), "negated_rule_matched")
    if op == "presence.required":
        return F.lit(None if s.present else "required").cast("string")
    if op == "presence.non_null":
        return _code(s.col.isNotNull() if s.present else F.lit(False), "null")
    if op == "presence.absent":
        return F.lit("forbidden" if s.present else None).cast("string")
    if not s.present:
        return F.lit("invalid_type")
    if op == "value.compare_path":
        return _compare_path(s, rule, df)
    if op in ("value.eq", "value.neq"):
        same = F.coalesce(_literal_equal(s, rule["value"]), F.lit(False))
        return F.when(~same, "not_equal") if op == "value.eq" else F.when(same, "equal_to_excluded")
    if op in ("membership.in", "membership.not_in"):
        same = reduce(lambda a, b: a | b, [F.coalesce(_literal_equal(s, v), F.lit(False)) for v in rule["values"]])
        return F.when(~same, "not_included") if op == "membership.in" else F.when(same, "excluded")
    typed = F.when(s.col.isNull(), "invalid_type")
    if op == "type.is":
        return F.coalesce(typed, _type_code(s, rule["type"]))
    if op.startswith("text."):
        if not isinstance(s.kind, T.StringType):
            return F.lit("invalid_type")
        return F.coalesce(typed, _text(s.col, rule))
    if op.startswith("number."):
        if not _is_number(s.kind):
            return F.lit("invalid_type")
        return F.coalesce(typed, _number(s.col, rule))
    if not isinstance(s.kind, T.ArrayType):
        return F.lit("invalid_type")
    return F.coalesce(typed, _collection(s, rule))


def _type_code(s: Subject, name: str) -> Column:
    ok: Any = {
        "boolean": isinstance(s.kind, T.BooleanType),
        "text": isinstance(s.kind, T.StringType),
        "string": isinstance(s.kind, T.StringType),
        "collection": isinstance(s.kind, T.ArrayType),
        "object": isinstance(s.kind, (T.StructType, T.MapType)),
        "decimal": _is_number(s.kind),
        "integer": _is_number(s.kind),
    }[name]
    if name == "integer" and ok:
        return _code(s.col == F.floor(s.col), "invalid_type")
    return _code(F.lit(ok), "invalid_type")


def _text(x: Column, rule: dict[str, Any]) -> Column:
    op = rule["op"]
    if op == "text.nonblank":
        return _code(x.rlike(r"[^\p{IsWhite_Space}]"), "blank")
    if op == "text.length":
        return _code(_within(F.length(x), rule), "invalid_text_length")
    if op == "text.pattern":
        pattern = rule["pattern"]
        return _code(x.rlike(rf"\A(?:{pattern})\z" if rule["match"] == "full" else pattern), "pattern_mismatch")
    wanted = F.lit(rule["text"])
    ok = x.startswith(wanted) if op == "text.prefix" else x.endswith(wanted) if op == "text.suffix" else x.contains(wanted)
    return _code(ok, "text_mismatch")


def _number(x: Column, rule: dict[str, Any]) -> Column:
    op = rule["op"]
    lit = lambda k: F.lit(number(rule[k])).cast("decimal(38,10)")
    if op == "number.integer":
        return _code(x == F.floor(x), "not_integer")
    if op == "number.range":
        low = x >= lit("min") if rule.get("include_min", True) else x > lit("min")
        high = x <= lit("max") if rule.get("include_max", True) else x < lit("max")
        return _code(low & high, "numeric_range")
    if op == "number.multiple_of":
        return _code(x.cast("decimal(38,10)") % lit("factor") == 0, "not_multiple")
    test = {"number.gt": x.__gt__, "number.gte": x.__ge__, "number.lt": x.__lt__, "number.lte": x.__le__}[op]
    return _code(test(lit("bound")), "numeric_bound")


def _compare_path(s: Subject, rule: dict[str, Any], df: DataFrame) -> Column:
    other = subject(df, rule["path"])
    if not other.present:
        return F.lit("missing_related_value")
    op = rule["comparison"]
    if op in ("eq", "neq"):
        same = s.col.eqNullSafe(other.col) if type(s.kind) is type(other.kind) or _is_number(s.kind) and _is_number(other.kind) else F.lit(False)
        return _code(same if op == "eq" else ~same, "related_value_comparison")
    if not (_is_number(s.kind) and _is_number(other.kind)):
        return F.lit("invalid_related_value_type")
    test = {"gt": s.col.__gt__, "gte": s.col.__ge__, "lt": s.col.__lt__, "lte": s.col.__le__}[op]
    return F.when(s.col.isNull() | other.col.isNull(), "invalid_related_value_type").otherwise(_code(test(other.col), "related_value_comparison"))


def _item(x: Column, path: str) -> Column:
    for part in path.split("."):
        x = x[part]
    return x


def _has(kind: T.DataType, path: str) -> bool:
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
            return False
        kind = kind[part].dataType
    return True


def _collection(s: Subject, rule: dict[str, Any]) -> Column:
    op, inner = rule["op"], s.kind.elementType  # type: ignore[attr-defined]
    if op == "collection.count":
        return _code(_within(F.size(s.col), rule), "invalid_collection_count")
    if op == "collection.sum":
        if not _has(inner, rule["path"]):
            return F.when(F.size(s.col) > 0, "missing_sum_field").otherwise(_code(_within(F.lit(0), rule), "invalid_collection_sum"))
        parts = F.transform(s.col, lambda x: _item(x, rule["path"]).cast("decimal(38,10)"))
        total = F.aggregate(parts, F.lit(0).cast("decimal(38,10)"), lambda a, x: (a + x).cast("decimal(38,10)"))
        return F.when(F.exists(parts, lambda x: x.isNull()), "invalid_type").otherwise(_code(_within(total, rule), "invalid_collection_sum"))
    if not all(_has(inner, p) for p in rule["paths"]):
        return F.when(F.size(s.col) > 0, "invalid_collection_item")
    tuples = F.transform(s.col, lambda x: F.struct(*[_item(x, p).alias(f"p{i}") for i, p in enumerate(rule["paths"])]))
    return _code(F.size(F.array_distinct(tuples)) == F.size(s.col), "duplicate_collection_value")


NORMALIZERS = ("trim", "uppercase", "lowercase", "nfc", "line_endings", "empty_to_null")


def normalize(x: Column, steps: list[str]) -> Column:
    """Normalizers in order. nfc is the one that needs Python (an Arrow batch at a time)."""
    for step in steps:
        require(step in NORMALIZERS, "invalid_data_rules_contract", "no normalizer has this name", normalizer=step)
        if step == "trim":
            x = F.regexp_replace(x, r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")
        elif step == "uppercase":
            x = F.translate(x, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        elif step == "lowercase":
            x = F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        elif step == "line_endings":
            x = F.regexp_replace(x, r"\r\n?", "\n")
        elif step == "empty_to_null":
            x = F.nullif(x, F.lit(""))
        else:
            x = _nfc(x)
    return x


def _nfc(x: Column) -> Column:
    import pandas as pd

    def nfc(values):
        import unicodedata

        return values.map(lambda v: v if v is None else unicodedata.normalize("NFC", v))

    nfc.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(nfc, "string")(x)
