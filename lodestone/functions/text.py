"""Full-text predicates on tokens, JSON containment, array predicates."""

from __future__ import annotations

import json
import math
import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Words that a search in English passes over.
STOP_WORDS = "a an and are as at be by for from has he in is it its of on that the to was were will with".split()
CONFIGURATIONS = ("simple", "english")


def tokens(text: Column, configuration: str = "simple") -> Column:
    """Lower-cased runs of letters and digits; in English without stop words and plural
    endings (Harman's s-stemmer, 1991)."""
    found = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    if configuration == "simple":
        return found
    return F.transform(F.filter(found, lambda t: ~t.isin(STOP_WORDS)), _stem)


def _stem(t: Column) -> Column:
    cut = lambda n: F.substring(t, F.lit(1), F.length(t) - n)
    return (
        F.when(t.rlike("[^ae]ies$"), F.concat(cut(3), F.lit("y")))
        .when(t.rlike("[^aeo]es$"), cut(1))
        .when(t.rlike("[^us]s$"), cut(1))
        .otherwise(t)
    )


def stemmed(word: str) -> str:
    """The s-stem of one word, as ``tokens`` has it."""
    if re.search("[^ae]ies$", word):
        return word[:-3] + "y"
    return word[:-1] if re.search("[^aeo]es$", word) or re.search("[^us]s$", word) else word


def _query_tokens(text: str, configuration: str = "simple") -> list[str]:
    found = [t for t in re.split(r"[\W_]+", text.lower()) if t]
    return found if configuration == "simple" else [stemmed(t) for t in found if t not in STOP_WORDS]


def document(columns: list[Column]) -> Column:
    return F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def _any_starts(found: Column, prefix: str) -> Column:
    return F.exists(found, lambda t: t.startswith(prefix))


def _phrase(found: Column, terms: list[str]) -> Column:
    """Whether the tokens hold ``terms`` in sequence: marked off by spaces, the one is
    part of the other."""
    line = F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))
    return line.contains(" " + " ".join(terms) + " ")


Term = tuple[str, bool, list[str]]  # how it is looked for, whether it must be missing, its tokens


def _websearch(query: str, configuration: str) -> list[list[Term]]:
    """OR of AND of terms, from quotes, ``or`` and a leading minus."""
    groups: list[list[Term]] = [[]]
    for minus, quoted, plain in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if not quoted and plain.lower() == "or":
            groups.append([])
            continue
        terms = _query_tokens(quoted or plain, configuration)
        if terms:
            groups[-1].append(("phrase", bool(minus), terms))
    return [g for g in groups if g]


def _boolean(query: str, configuration: str) -> list[list[Term]]:
    """AND, OR, NOT between words and quoted phrases; a trailing * is a prefix."""
    groups: list[list[Term]] = [[]]
    negated = False
    for quoted, plain in re.findall(r'"([^"]*)"|([^\s()]+)', query):
        if not quoted and plain in ("AND", "OR", "NOT"):
            if plain == "OR":
                groups.append([])
            negated = plain == "NOT"
            continue
        terms = _query_tokens(quoted or plain, configuration)
        if terms:
            groups[-1].append(("prefix" if plain.endswith("*") else "phrase", negated, terms))
        negated = False
    return [g for g in groups if g]


def _holds(found: Column, kind: str, terms: list[str]) -> Column:
    if kind == "prefix":
        return reduce(lambda a, b: a & b, [_any_starts(found, p) for p in terms])
    return _phrase(found, terms)


def matches(columns: list[Column], query: str, mode: str, configuration: str = "simple") -> Column:
    """plain: every term; phrase: in sequence; prefix: each term starts a token;
    websearch and boolean: their operators. No term matches nothing. The document is cut
    into tokens once, however many terms look into them."""
    terms = _query_tokens(query, configuration)
    if mode in ("websearch", "boolean"):
        groups = (_websearch if mode == "websearch" else _boolean)(query, configuration)
        test = lambda found: reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [(~_holds(found, k, t) if no else _holds(found, k, t)) for k, no, t in g]) for g in groups])
    else:
        groups = [terms] if terms else []
        test = lambda found: F.size(F.array_except(F.array(*map(F.lit, terms)), found)) == 0 if mode == "plain" else _holds(found, mode, terms)
    if not groups:
        return F.lit(False)
    return F.exists(F.array(tokens(document(columns), configuration)), test)


def rank(columns: list[Column], query: str, configuration: str = "simple") -> Column:
    """Occurrences of the terms per token, times 1000: a term-frequency score of one row.
    ``bm25`` weighs the terms by how rare they are among all rows."""
    terms = _query_tokens(query, configuration)
    if not terms:
        return F.lit(0.0)
    score = lambda found: F.size(F.filter(found, lambda t: t.isin(terms))) * 1000.0 / F.greatest(F.size(found), F.lit(1))
    return F.transform(F.array(tokens(document(columns), configuration)), score)[0]


def bm25(df: DataFrame, columns: list[str], query: str, out: str = "score", *, configuration: str = "simple", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``df`` with the Okapi BM25 score of each row for a query of plain terms: sum over
    terms of idf * f * (k1 + 1) / (f + k1 * (1 - b + b * length / mean length)), with
    idf = ln(1 + (rows - rows that hold it + 0.5) / (rows that hold it + 0.5)). One
    aggregation over all rows gives the counts, read first as one row."""
    terms = list(dict.fromkeys(_query_tokens(query, configuration)))
    if not terms:
        return df.withColumn(out, F.lit(0.0))
    found = tokens(document([F.col(f"`{c}`") for c in columns]), configuration)
    count = lambda words, w: F.size(F.filter(words, lambda t: t == F.lit(w)))
    times = lambda words: F.struct(F.size(words).alias("n"), *[count(words, w).alias(f"f{i}") for i, w in enumerate(terms)])
    counted = df.withColumn("_bm", F.transform(F.array(found), times)[0])
    rows, mean, *held = counted.agg(F.count(F.lit(1)), F.avg("_bm.n"), *[F.count_if(F.col(f"_bm.f{i}") > 0) for i in range(len(terms))]).first()
    score = F.lit(0.0)
    for i, holding in enumerate(held):
        f = F.col(f"_bm.f{i}")
        weight = math.log(1 + (rows - holding + 0.5) / (holding + 0.5)) * (k1 + 1)
        score = score + weight * f / (f + k1 * (1 - b + b * F.col("_bm.n") / max(mean or 0.0, 1e-9)))
    scored = counted
    return scored.select(*[F.col(f"`{c}`") for c in df.columns if c != out], score.alias(out))


def array_literal(values: tuple[Any, ...], kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def array_predicate(op: str, column: Column, values: tuple[Any, ...], kind: str) -> Column:
    """NULL arrays give NULL, which a filter drops."""
    given = array_literal(values, kind)
    if op == "array_contains":
        return F.size(F.array_except(given, column)) == 0
    if op == "array_contained":
        return F.size(F.array_except(column, given)) == 0
    return F.coalesce(F.arrays_overlap(column, given), column.isNull() & F.lit(None).cast("boolean"), F.lit(False))


def json_contains(column: Column, wanted: Any) -> Column:
    """Structural containment in a JSON string column: objects hold every wanted key,
    arrays hold every wanted element, scalars are equal in type and value."""
    return _variant_contains(F.try_parse_json(column), wanted, top=True)


def _any_contains(items: Column, wanted: Any) -> Column:
    return F.exists(items, lambda x: _variant_contains(x, wanted))


def _variant_contains(value: Column, wanted: Any, top: bool = False) -> Column:
    kind = F.schema_of_variant(value)
    if isinstance(wanted, dict):
        parts = [kind.startswith("OBJECT")]
        for key, v in wanted.items():
            inner = F.try_variant_get(value, "$[" + json.dumps(key).replace('"', "'") + "]", "variant")
            parts.append(inner.isNotNull() & _variant_contains(inner, v))
        return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))
    items = F.try_variant_get(value, "$", "array<variant>")
    if isinstance(wanted, list):
        parts = [kind.startswith("ARRAY")]
        parts += [_any_contains(items, w) for w in wanted]
        return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))
    same = _scalar_equal(value, kind, wanted)
    if top:  # an array holds a bare scalar, at the top only
        same = same | (kind.startswith("ARRAY") & F.exists(items, lambda x: _scalar_equal(x, F.schema_of_variant(x), wanted)))
    return F.coalesce(same, F.lit(False))


def _scalar_equal(value: Column, kind: Column, wanted: Any) -> Column:
    if wanted is None:
        return F.coalesce(F.is_variant_null(value), F.lit(False))
    if isinstance(wanted, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == wanted)
    if isinstance(wanted, (int, float)):
        numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        return numeric & (F.try_variant_get(value, "$", "double") == float(wanted))
    return (kind == "STRING") & (F.try_variant_get(value, "$", "string") == str(wanted))


def json_equal(column: Column, wanted: Any) -> Column:
    """Equality of JSON values whatever the order of keys."""
    shape = F.to_json(F.try_parse_json(column))
    return shape == F.to_json(F.parse_json(F.lit(json.dumps(wanted))))


def json_path(segments: tuple[str, ...]) -> str:
    return "$" + "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in segments)
