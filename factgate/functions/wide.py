"""Scalar functions of the wide profile where Spark's built-ins differ from PostgreSQL's semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that a request may use unless its product says otherwise.
ALLOWED = {
    "math": ("abs", "ceil", "ceiling", "floor", "round"),
    "string": ("btrim", "ltrim", "rtrim", "trim", "char_length", "length", "lower", "upper", "concat", "concat_ws", "replace", "substring"),
    "date": ("date_part", "date_trunc", "to_char"),
    "json": ("jsonb_array_length", "jsonb_extract_path", "jsonb_extract_path_text"),
    "aggregate": ("avg", "count", "max", "min", "sum"),
    "operator": ("=", "<>", "!=", "<", "<=", ">", ">=", "+", "-", "*", "/", "%", "||", "~~", "!~~", "~~*", "!~~*", "->", "->>", "#>", "#>>", "@>", "<@"),
}

# The date patterns that are supported, and what they are called in Spark.
TO_CHAR = {"YYYY-MM-DD": "yyyy-MM-dd", "YYYY-MM": "yyyy-MM", "YYYY": "yyyy", "MM": "MM", "DD": "dd", "HH24:MI:SS": "HH:mm:ss", "YYYY-MM-DD HH24:MI:SS": "yyyy-MM-dd HH:mm:ss"}


# What the allowed names that Spark calls otherwise are there.
SPARK_NAMES = ("json_array_length", "get_json_object", "coalesce", "nullif", "case_when", "date_format", "between", "in", "and", "or", "not", "isnull", "isnotnull", "like", "ilike")


def check_allowed(names: list[str], granted: tuple[str, ...] = ()) -> None:
    """Refuses names that are neither allowed by default nor granted by the product."""
    known = {n for group in ALLOWED.values() for n in group} | set(SPARK_NAMES) | set(granted)
    bad = sorted(set(names) - known)
    if bad:
        raise PermissionError(f"not allowed: {', '.join(bad)}")


def concat(*parts: Column) -> Column:
    """Joins texts; null counts as nothing."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def int_div(a: Column, b: Column) -> Column:
    """Division of whole numbers, truncated to zero; null for a zero divisor."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def to_char(value: Column, pattern: str) -> Column:
    if pattern not in TO_CHAR:
        raise ValueError(f"pattern {pattern} is not supported")
    return F.date_format(value, TO_CHAR[pattern])


def json_array_length(text: Column) -> Column:
    return F.json_array_length(text)


def json_path_text(text: Column, *path: str | int) -> Column:
    """The element at a path as text (``#>>``, ``->>``)."""
    steps = "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in path)
    return F.get_json_object(text, "$" + steps)


def json_path(text: Column, *path: str | int) -> Column:
    """The element at a path as a variant (``#>``, ``->``); null where there is none."""
    steps = "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in path)
    return F.try_variant_get(F.parse_json(text), "$" + steps, "variant")


def array_contains_all(a: Column, b: Column) -> Column:
    """``a @> b`` for arrays: every element of b is in a."""
    return F.forall(b, lambda x: F.array_contains(a, x))


def map_contains(a: Column, b: Column) -> Column:
    """``a @> b`` for flat JSON objects given as maps: every entry of b is in a."""
    return F.forall(F.map_entries(b), lambda e: F.try_element_at(a, e["key"]).eqNullSafe(e["value"]) & F.map_contains_key(a, e["key"]))


def equal(a: Column, b: Column) -> Column:
    """SQL equality: unknown where either side is null."""
    return a == b


def not_distinct(a: Column, b: Column) -> Column:
    """Grouping equality: nulls are equal."""
    return a.eqNullSafe(b)
