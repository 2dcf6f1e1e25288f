"""Closed expression trees, and the two array languages that parse into them: filters
(``['and', [...]]``, ``['eq', field, value]``, ...) and values (``['coalesce', ...]``).

There is no node for SQL text. Every node is ``Node(kind, args, alias)``, immutable."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import partial
from typing import Any

from .errors import SelectError, require
from .limits import Limits
from .types import category

PATH = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,62}")
SEGMENT = re.compile(r"[A-Za-z0-9_]+")
INTEGER, DECIMAL = re.compile(r"-?\d+"), re.compile(r"-?\d+\.\d+")

COMPARE = ("eq", "ne", "gt", "gte", "lt", "lte")
TEXT = tuple(f"{m}{ci}" for m in ("starts_with", "text_contains", "ends_with") for ci in ("", "_ci"))
ARRAYS = ("array_contains", "array_contained", "array_overlap")
ARITHMETIC = ("add", "subtract", "multiply", "divide")
CASTS = ("string", "integer", "decimal", "boolean", "date", "utc_datetime")
AGGREGATES = frozenset(
    "count count_field count_distinct sum avg min max sum_zero true_count false_count true_percentage count_bucket dimension_display".split()
)
WINDOW_ARITY = {
    "row_number": (0, 0), "rank": (0, 0), "dense_rank": (0, 0), "percent_rank": (0, 0), "cume_dist": (0, 0), "ntile": (1, 1),
    "lag": (1, 3), "lead": (1, 3), "first_value": (1, 1), "last_value": (1, 1), "nth_value": (2, 2),
    "count": (0, 1), "sum": (1, 1), "avg": (1, 1), "min": (1, 1), "max": (1, 1),
}
WINDOW_FIELD_FIRST = ("sum", "avg", "min", "max", "count", "first_value", "last_value", "nth_value", "lag", "lead")


@dataclass(frozen=True)
class Node:
    kind: str
    args: tuple[Any, ...] = ()
    alias: str | None = None

    def as_(self, alias: str) -> Node:
        require(isinstance(alias, str) and IDENTIFIER.fullmatch(alias), "invalid_query", "alias: expected a name of letters, digits and underscores", alias=alias)
        return replace(self, alias=alias)

    @property
    def bare(self) -> Node:
        return replace(self, alias=None)


def operand(value: Any) -> Node:
    """A node as it is; a string names a field."""
    if isinstance(value, Node):
        return value
    require(not isinstance(value, dict) or "raw_sql" not in value, "raw_sql_forbidden", "SQL text has no place in a query")
    return field(value)


def field(path: Any) -> Node:
    require(isinstance(path, str) and PATH.fullmatch(path), "invalid_query", "expected a field path: names joined by dots", field=str(path))
    return Node("field", (path,))


def literal(value: Any) -> Node:
    require(not isinstance(value, (dict, set)), "invalid_query", "a constant is one value or a list of values")
    return Node("literal", (value,))


def _right(value: Any) -> Node:
    return value if isinstance(value, Node) else literal(value)


def compare(op: str, left: Any, right: Any) -> Node:
    require(op in COMPARE, "invalid_query", f"{op} compares nothing")
    return Node(op, (operand(left), _right(right)))


def eq(a: Any, b: Any) -> Node: return compare("eq", a, b)
def ne(a: Any, b: Any) -> Node: return compare("ne", a, b)
def gt(a: Any, b: Any) -> Node: return compare("gt", a, b)
def gte(a: Any, b: Any) -> Node: return compare("gte", a, b)
def lt(a: Any, b: Any) -> Node: return compare("lt", a, b)
def lte(a: Any, b: Any) -> Node: return compare("lte", a, b)
def is_null(a: Any) -> Node: return Node("is_null", (operand(a),))
def not_null(a: Any) -> Node: return Node("not_null", (operand(a),))


def text_match(op: str, a: Any, text: Any) -> Node:
    require(op in TEXT, "invalid_query", f"{op} is no test of text")
    require(isinstance(text, str), "invalid_query", f"{op} looks for a text")
    return Node(op, (operand(a), text))


def between(a: Any, low: Any, high: Any) -> Node:
    return Node("between", (operand(a), _right(low), _right(high)))


def in_(a: Any, values: Sequence[Any]) -> Node:
    require(isinstance(values, (list, tuple)) and values, "invalid_query", "in chooses from a list of one value or more")
    return Node("in", (operand(a), tuple(values)))


def not_in(a: Any, values: Sequence[Any]) -> Node:
    return not_(in_(a, values))


def all_(nodes: Sequence[Node]) -> Node:
    require(nodes, "invalid_query", "all of nothing is no condition")
    return Node("all", tuple(nodes))


def any_(nodes: Sequence[Node]) -> Node:
    require(nodes, "invalid_query", "any of nothing is no condition")
    return Node("any", tuple(nodes))


def not_(node: Node) -> Node:
    return Node("not", (node,))


def array_match(op: str, a: Any, values: Sequence[Any]) -> Node:
    require(op in ARRAYS, "invalid_query", f"{op} is no test of arrays")
    require(isinstance(values, (list, tuple)), "invalid_query", f"{op} compares with a list of values")
    return Node(op, (operand(a), tuple(values)))


def json_contains(a: Any, document: Any) -> Node:
    return Node("json_contains", (operand(a), _frozen(document)))


def structured_compare(a: Any, op: str, value: Any) -> Node:
    require(op in ("eq", "neq", "in", "not_in"), "invalid_query", "structured values compare by eq, neq, in or not_in")
    require(op in ("eq", "neq") or isinstance(value, (list, tuple)) and value, "invalid_query", "there is nothing in the list to compare with")
    return Node("structured_compare", (operand(a), op, _frozen(value)))


def date_shortcut(a: Any, shortcut: str, today: str | None = None) -> Node:
    from .functions.shortcuts import terms

    terms(shortcut)
    return Node("date_shortcut", (operand(a), shortcut, today))


def count() -> Node: return Node("count")
def count_field(a: Any) -> Node: return Node("count_field", (operand(a),))
def count_distinct(a: Any) -> Node: return Node("count_distinct", (operand(a),))
def sum_(a: Any) -> Node: return Node("sum", (operand(a),))
def avg(a: Any) -> Node: return Node("avg", (operand(a),))
def min_(a: Any) -> Node: return Node("min", (operand(a),))
def max_(a: Any) -> Node: return Node("max", (operand(a),))
def sum_zero(a: Any) -> Node: return Node("sum_zero", (operand(a),))
def true_count(a: Any) -> Node: return Node("true_count", (operand(a),))
def false_count(a: Any) -> Node: return Node("false_count", (operand(a),))
def true_percentage(a: Any) -> Node: return Node("true_percentage", (operand(a),))
def trim(a: Any) -> Node: return Node("trim", (operand(a),))
def epoch_datetime(a: Any) -> Node: return Node("epoch_datetime", (operand(a),))


def grouping(*fields: Any) -> Node:
    given = fields[0] if len(fields) == 1 and isinstance(fields[0], (list, tuple)) else fields
    require(1 <= len(given) <= 31, "invalid_query", "grouping marks 1 to 31 fields")
    return Node("grouping", tuple(operand(x) for x in given))


def dimension_display(display: Any, key: Any) -> Node:
    return Node("dimension_display", (operand(display), operand(key)))


def count_bucket(a: Any, minimum: int | None = None, maximum: int | None = None, mode: str = "numeric", today: str | None = None) -> Node:
    require(mode in ("numeric", "elapsed_days"), "invalid_query", "mode: numeric or elapsed_days")
    require(minimum is not None or maximum is not None, "invalid_query", "a counted bucket has a lower or an upper bound")
    for bound in (minimum, maximum):
        require(bound is None or isinstance(bound, int) and bound >= 0, "invalid_query", "bounds of a counted bucket are whole numbers from 0")
    return Node("count_bucket", (operand(a), minimum, maximum, mode, today))


def bucket(a: Any, specification: dict[str, Any], today: str | None = None) -> Node:
    require(isinstance(specification, dict), "invalid_query", "a bucket is described by an object")
    return Node("bucket", (operand(a), _frozen(specification), today))


def datetime_format(a: Any, style: str, timezone: str | None = None) -> Node:
    from .functions.dates import FORMATS

    require(style in FORMATS, "invalid_query", "no date format has this name", format=style)
    return Node("datetime_format", (operand(a), style, timezone))


def text_search(fields: Sequence[Any], query: str, configuration: str = "simple", mode: str = "plain") -> Node:
    require(fields and isinstance(query, str), "invalid_query", "a search needs fields to look into and a text to look for")
    require(mode in ("plain", "phrase", "websearch", "prefix", "boolean"), "invalid_query", "no search mode has this name", mode=mode)
    require(configuration in ("simple", "english"), "unsupported_feature", "search configurations are simple and english", configuration=configuration)
    return Node("text_search", (tuple(operand(f) for f in fields), query, mode, configuration))


def text_rank(fields: Sequence[Any], query: str, configuration: str = "simple", mode: str = "plain") -> Node:
    return replace(text_search(fields, query, configuration, mode), kind="text_rank")


def window(
    function: str,
    arguments: Any = (),
    *,
    partition_by: Any = (),
    order_by: Any = (),
    frame: dict[str, Any] | None = None,
) -> Node:
    """A window function. order_by: fields or (field, direction); frame:
    {unit, start, end} with unit rows, range or groups and bounds
    unbounded_preceding, current_row, unbounded_following, {preceding: n},
    {following: n}."""
    name = (function or "").lower()
    require(name in WINDOW_ARITY, "invalid_query", "no window function has this name", function=function)
    given = list(arguments) if isinstance(arguments, (list, tuple)) else [arguments]
    low, high = WINDOW_ARITY[name]
    require(low <= len(given) <= high, "invalid_query", f"{name}: between {low} and {high} arguments")
    nodes = [a if isinstance(a, Node) else field(a) if i == 0 and name in WINDOW_FIELD_FIRST else literal(a) for i, a in enumerate(given)]
    partition = partition_by if isinstance(partition_by, (list, tuple)) else (partition_by,)
    ordering = order_by if isinstance(order_by, list) or isinstance(order_by, tuple) and not _is_order(order_by) else (order_by,)
    orders = tuple(_order(o) for o in ordering)
    return Node("window", (name, tuple(nodes), tuple(operand(p) for p in partition), orders, _frozen(frame)))


def _is_order(value: Any) -> bool:
    return isinstance(value, tuple) and len(value) == 2 and value[1] in ("asc", "desc")


def _order(value: Any) -> tuple[Node, str]:
    f, direction = value if isinstance(value, (list, tuple)) else (value, "asc")
    require(direction in ("asc", "desc"), "invalid_query", "direction: asc or desc")
    return operand(f), direction


def related_collection(
    association: str,
    fields: Sequence[Any],
    *,
    filters: dict[str, Any] | None = None,
    order_by: Sequence[Any] = (),
    limit: int | None = None,
    after: dict[str, Any] | None = None,
) -> Node:
    """A JSON array of child objects per row. fields: names, (key, field) pairs or
    nested related_collection nodes; after: {parent: key value, values: [...]}, a keyset
    cursor that applies to one parent only."""
    require(limit is None or order_by, "invalid_query", "the first rows of a collection are told by an order")
    require(limit is None or isinstance(limit, int) and limit > 0, "invalid_query", "limit of a collection: a whole number from 1")
    require(after is None or order_by, "invalid_query", "a cursor goes on in an order")
    items = tuple((f[0], operand(f[1])) if isinstance(f, (list, tuple)) else (f.alias or f.args[0], f) if isinstance(f, Node) else (f, field(f)) for f in fields)
    require(items, "invalid_query", "a collection shows no fields")
    require(len({k for k, _ in items}) == len(items), "invalid_query", "two fields of a collection share a key")
    return Node("related_collection", (association, items, _frozen(filters or {}), tuple(_order(o) for o in order_by), limit, _frozen(after)))


related_rows = related_collection


def related_sum(association: str, path: str) -> Node:
    return Node("related_sum", (association, path))


def related_count(association: str, path: str) -> Node:
    return Node("related_count", (association, path))


@dataclass(frozen=True)
class Frozen:
    """A hashable copy of a JSON-like value."""

    text: str

    @property
    def value(self) -> Any:
        import json

        return json.loads(self.text)


def _frozen(value: Any) -> Any:
    import json
    from decimal import Decimal

    return None if value is None else Frozen(json.dumps(value, sort_keys=True, default=lambda x: str(x) if isinstance(x, Decimal) else list(x)))


def children(node: Node) -> Iterator[Node]:
    stack = list(node.args)
    while stack:
        x = stack.pop()
        if isinstance(x, Node):
            yield x
        elif isinstance(x, tuple):
            stack.extend(x)


def walk(node: Node) -> Iterator[Node]:
    """All nodes of a tree; a related collection's inside belongs to the child."""
    yield node
    if node.kind not in ("related_collection", "related_sum", "related_count"):
        for c in children(node):
            yield from walk(c)


def fields_of(node: Node) -> list[str]:
    """Field paths that an expression reads."""
    out: list[str] = []
    for n in walk(node):
        if n.kind == "field":
            out.append(n.args[0])
        elif n.kind == "value":
            out += value_fields(n.args[0])
    return list(dict.fromkeys(out))


def is_aggregate(node: Node) -> bool:
    return node.kind != "window" and (node.kind in AGGREGATES or any(is_aggregate(c) for c in children(node) if c.kind != "window"))


def check_size(node: Node, limits: Limits) -> None:
    """Charges nodes, depth and fan-out."""
    total, stack = 0, [(node, 1)]
    while stack:
        n, depth = stack.pop()
        total += 1
        require(depth <= limits.get("max_expression_depth"), "invalid_query", "the expression tree is too high")
        below = list(children(n))
        limits.check("max_expression_arity", len(below), "invalid_query", "branches of one expression")
        stack += [(c, depth + 1) for c in below]
        require(total <= limits.get("max_expression_nodes"), "invalid_query", "the expression tree has too many nodes")


# -- the filter language ---------------------------------------------------------
#
# A filter is a tree. Inner nodes (JOINTS) combine filters; a leaf names a field and what
# it is tested against. LEAVES is the grammar of the leaves: the readers of the operands
# that follow the field, and what makes a node of them.

Reader = Callable[[Any, Limits], Any]


def _plain(value: Any, limits: Limits) -> Any:
    require(not isinstance(value, (list, dict)), "invalid_query", "expected one plain value as operand")
    return value


def _sized(value: Any, limits: Limits) -> Any:
    limits.check_bytes("max_value_bytes", _plain(value, limits), "invalid_query", "operand")
    return value


def _side(value: Any, limits: Limits) -> Any:
    """A plain value, or ``['field', path]``."""
    if isinstance(value, (list, tuple)) and len(value) == 2 and value[0] == "field":
        return field(value[1])
    return _sized(value, limits)


def _several(value: Any, limits: Limits) -> Any:
    require(isinstance(value, (list, tuple)), "invalid_query", "expected a list as operand")
    limits.check("max_filter_values", len(value), "invalid_query", "operands of a list")
    return value


def _choices(value: Any, limits: Limits) -> Any:
    require(_several(value, limits), "invalid_query", "expected a list of one value or more")
    return [_plain(v, limits) for v in value]


def _as_is(value: Any, limits: Limits) -> Any:
    return value


@dataclass(frozen=True)
class Leaf:
    make: Callable[..., Node]
    readers: tuple[Reader, ...] = ()


LEAVES: dict[str, Leaf] = {
    "is_null": Leaf(is_null),
    "not_null": Leaf(not_null),
    "between": Leaf(between, (_plain, _plain)),
    "in": Leaf(in_, (_choices,)),
    "json_contains": Leaf(json_contains, (_as_is,)),
    **{op: Leaf(partial(array_match, op), (_several,)) for op in ARRAYS},
    **{op: Leaf(partial(text_match, op), (_as_is,)) for op in TEXT},
    **{op: Leaf(partial(compare, op), (_side,)) for op in COMPARE},
}
JOINTS: dict[str, Callable[[list[Node]], Node]] = {"and": all_, "or": any_, "not": lambda made: not_(made[0])}


def joined_filters(ast: Sequence[Any]) -> list[Any]:
    """The filters below a joint: ``['and', f, g]`` and ``['and', [f, g]]`` mean the same."""
    rest = list(ast[1:])
    if len(rest) == 1 and isinstance(rest[0], (list, tuple)) and not (rest[0] and isinstance(rest[0][0], str)):
        rest = list(rest[0])
    return rest


def parse_filter(ast: Any, limits: Limits | None = None, depth: int = 0) -> Node:
    """The node of a filter tree. Comparisons take ``['field', path]`` as right side."""
    limits = limits or Limits()
    require(depth <= limits.get("max_expression_depth"), "invalid_query", "filter tree is too high", depth=depth)
    require(isinstance(ast, (list, tuple)) and ast and isinstance(ast[0], str), "invalid_query", "expected [operator, ...] as filter")
    op = ast[0].lower()
    if op in JOINTS:
        below = joined_filters(ast)
        require(len(below) == 1 if op == "not" else below, "invalid_query", f"wrong number of filters below {op}", found=len(below))
        limits.check("max_expression_arity", len(below), "invalid_query", f"filters below {op}")
        return JOINTS[op]([parse_filter(f, limits, depth + 1) for f in below])
    require(op in LEAVES, "invalid_query", f"no filter operator is called {op}")
    leaf = LEAVES[op]
    require(len(ast) == 2 + len(leaf.readers), "invalid_query", f"{op} needs a field and {len(leaf.readers)} operands", found=len(ast) - 2)
    return leaf.make(field(ast[1]), *[read(value, limits) for read, value in zip(leaf.readers, ast[2:])])


# -- the value language ----------------------------------------------------------
#
# A value is a tree, too. Most operators take values only: OPERANDS says how many, and
# RESULTS what type comes out. The others (FORMS) take names, types or branches as well
# and are read by a function each.


def _value_error(message: str) -> SelectError:
    return SelectError("invalid_value_expression", message)


def _expect(condition: object, message: str) -> None:
    if not condition:
        raise _value_error(message)


@dataclass(frozen=True)
class Reading:
    """Where a value tree is read: its limits, whether a recursion's last level can be
    named, and how deep the reader stands."""

    limits: Limits
    previous: bool
    depth: int = 0

    def read(self, ast: Any) -> tuple[Any, ...]:
        _expect(self.depth <= self.limits.get("max_expression_depth"), "the value tree is too high")
        _expect(isinstance(ast, (list, tuple)) and ast and isinstance(ast[0], str), "expected [operator, ...] as value")
        op, args = ast[0], list(ast[1:])
        if op in FORMS:
            return FORMS[op](args, replace(self, depth=self.depth + 1))
        _expect(op in OPERANDS, f"no value operator is called {op}")
        least, most = OPERANDS[op]
        _expect(least <= len(args) and (most is None or len(args) <= most), f"{op}: {least} values{'' if most else ' at least'}")
        below = replace(self, depth=self.depth + 1)
        return (op, *map(below.read, args))


def _field_form(args: list[Any], at: Reading) -> tuple[Any, ...]:
    _expect(len(args) == 1 and isinstance(args[0], str) and PATH.fullmatch(args[0]), "field: one path")
    return ("field", args[0])


def _previous_form(args: list[Any], at: Reading) -> tuple[Any, ...]:
    _expect(at.previous and len(args) == 1, "previous: a column of the recursion's last level, and only there")
    return ("previous", args[0])


def _guessed(value: Any) -> str:
    """The type of a literal that doesn't say it."""
    if isinstance(value, bool):
        return "boolean"
    return next((kind for kind, pattern in (("integer", INTEGER), ("decimal", DECIMAL)) if pattern.fullmatch(str(value))), "string")


def _literal_form(args: list[Any], at: Reading) -> tuple[Any, ...]:
    _expect(len(args) in (1, 2) and args[0] is not None and not isinstance(args[0], (list, dict)), "literal: one value, not null, and perhaps its type")
    kind = _guessed(args[0]) if len(args) == 1 or args[1] is None else args[1]
    _expect(kind in CASTS, "literal: no such type")
    return ("literal", args[0], kind)


def _cast_form(args: list[Any], at: Reading) -> tuple[Any, ...]:
    _expect(len(args) == 2 and args[1] in CASTS, "cast: a value and the name of a type")
    return ("cast", at.read(args[0]), args[1])


def _json_form(args: list[Any], at: Reading) -> tuple[Any, ...]:
    _expect(len(args) == 2 and isinstance(args[0], str) and isinstance(args[1], (list, tuple)) and args[1], "json_text: a field and the way into it")
    at.limits.check("max_json_path_segments", len(args[1]), "invalid_value_expression", "steps into JSON")
    steps = tuple(map(str, args[1]))
    _expect(all(map(SEGMENT.fullmatch, steps)), "json_text: a step holds letters, digits and underscores")
    return ("json_text", args[0], steps)


def _case_form(args: list[Any], at: Reading) -> tuple[Any, ...]:
    _expect(args and all(isinstance(x, (list, tuple)) and len(x) == 2 for x in args), "case: expected branches of a filter, or else, and a value")
    otherwise = [i for i, (test, _) in enumerate(args) if test == "else"]
    _expect(otherwise in ([], [len(args) - 1]) and otherwise != [0], "case: else closes other branches")
    return ("case", *[(test if test == "else" else parse_filter(test, at.limits), at.read(value)) for test, value in args])


FORMS: dict[str, Callable[[list[Any], Reading], tuple[Any, ...]]] = {
    "field": _field_form,
    "previous": _previous_form,
    "literal": _literal_form,
    "cast": _cast_form,
    "json_text": _json_form,
    "case": _case_form,
}
#: How many values the other operators take: least and most.
OPERANDS: dict[str, tuple[int, int | None]] = {
    "coalesce": (2, None),
    "concat": (2, None),
    **dict.fromkeys((*ARITHMETIC, "days_between"), (2, 2)),
    **dict.fromkeys(("lower", "upper"), (1, 1)),
}


def parse_value(ast: Any, limits: Limits | None = None, previous: bool = False, depth: int = 0) -> Node:
    """A validated value tree, ``Node('value', (ast,))`` with a nested-tuple ast whose
    literals carry their type and whose case filters are parsed nodes."""
    return Node("value", (Reading(limits or Limits(), previous, depth).read(ast),))


def _common(kinds: list[str], op: str) -> str:
    """The type that several values share; whole numbers are decimals among decimals."""
    found = set(kinds)
    _expect(len(found) == 1 or found == {"integer", "decimal"}, f"{op}: its values are of several types ({', '.join(sorted(found))})")
    return "decimal" if len(found) == 2 else kinds[0]


def _numbers(kinds: list[str], op: str) -> str:
    strange = [k for k in kinds if k not in ("integer", "decimal")]
    _expect(not strange, f"{op} calculates with numbers, not with {', '.join(strange)}")
    return "decimal" if op == "divide" else _common(kinds, op)


def _days(kinds: list[str], op: str) -> str:
    _expect(set(kinds) <= {"date", "datetime"}, f"{op} counts from date to date, not from {', '.join(kinds)}")
    return "integer"


def _letters(kinds: list[str], op: str) -> str:
    _expect(kinds == ["string"], f"{op} changes text only")
    return "string"


#: The type of what an operator makes of values of some types.
RESULTS: dict[str, Callable[[list[str], str], str]] = {
    "coalesce": _common,
    "concat": lambda kinds, op: "string",
    "days_between": _days,
    "lower": _letters,
    "upper": _letters,
    **dict.fromkeys(ARITHMETIC, _numbers),
}


def value_category(ast: tuple[Any, ...], resolve: Callable[[Any], str | None]) -> str:
    """The category of a value tree; mismatches are invalid_value_expression."""
    op, *args = ast
    if op in RESULTS:
        return RESULTS[op]([value_category(a, resolve) for a in args], op)
    if op == "case":
        for test, _ in args:
            for path in fields_of(test) if isinstance(test, Node) else ():
                resolve(path)
        return _common([value_category(value, resolve) for _, value in args], op)
    if op == "cast":
        value_category(args[0], resolve)
    if op in ("cast", "literal"):
        return category(args[1])
    found = category(resolve(("previous", args[0]) if op == "previous" else args[0]))
    _expect(op != "json_text" or found == "json", "json_text reads JSON")
    return "string" if op == "json_text" else found


def value_fields(ast: Any) -> list[str]:
    """Field paths that a value tree reads."""
    out: list[str] = []

    def visit(x: Any) -> None:
        if isinstance(x, Node):
            out.extend(fields_of(x))
        elif isinstance(x, tuple):
            if x and x[0] in ("field", "json_text") and len(x) > 1 and isinstance(x[1], str):
                out.append(x[1])
            elif x and x[0] in ("literal", "previous"):
                return
            else:
                for y in x:
                    visit(y)

    visit(ast)
    return list(dict.fromkeys(out))
