"""Canonical text of typed values, injective composite keys, and fact hashes, as Column expressions and as the same SQL."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Canonical tag of each admitted type. Floating-point columns are not admitted as facts.
TAGS = {"smallint": "i", "int": "i", "bigint": "i", "decimal": "n", "string": "s", "date": "d", "timestamp": "t", "timestamp_ntz": "t", "boolean": "b", "binary": "x"}


def base_type(sql_type: str) -> str:
    return sql_type.split("(")[0]


def canonical(value: Column, sql_type: str) -> Column:
    """Text of a value that equal values share: decimals without trailing zeros, ISO dates, microsecond times; null has its own."""
    kind = base_type(sql_type)
    if kind not in TAGS:
        raise ValueError(f"type {sql_type} is not admitted as a fact")
    if kind == "decimal":
        text = F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1")
        text = F.regexp_replace(text, r"\.$", "")
    elif kind == "date":
        text = F.date_format(value, "yyyy-MM-dd")
    elif kind in ("timestamp", "timestamp_ntz"):
        text = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif kind == "binary":
        text = F.lower(F.hex(value))
    else:
        text = value.cast("string")
    return F.coalesce(F.concat(F.lit(TAGS[kind] + ":"), text), F.lit("null"))


def canonical_literal(value: object, sql_type: str) -> str:
    """The same text of a literal that is known on the driver: however it is written, equal values of the type share it."""
    kind = base_type(sql_type)
    if value is None:
        return "null"
    if kind == "decimal":
        text = format(Decimal(str(value)), "f")
        text = (text.rstrip("0").rstrip(".") if "." in text else text).removeprefix("+") or "0"
        text = "0" if text in ("-0", "") else text
    elif kind in ("smallint", "int", "bigint"):
        text = str(int(value))
    elif kind == "date":
        text = (value if isinstance(value, date) else datetime.fromisoformat(str(value))).strftime("%Y-%m-%d")
    elif kind in ("timestamp", "timestamp_ntz"):
        text = (value if isinstance(value, datetime) else datetime.fromisoformat(str(value))).isoformat(" ", "microseconds")
    elif kind == "boolean":
        text = str(value).lower()
    else:
        text = value.hex() if isinstance(value, bytes) else str(value)
    return f"{TAGS[kind]}:{text}"


def composite(*parts: Column | str) -> Column:
    """Injective join of texts: each is preceded by its length in bytes. Strings given are literals."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.concat(*[F.concat(F.octet_length(c).cast("string"), F.lit(":"), c) for c in cols])


def digest(*parts: Column | str) -> Column:
    return F.sha2(composite(*parts), 256)


def composite_text(*parts: str) -> str:
    """The same join of texts that are known on the driver."""
    return "".join(f"{len(p.encode())}:{p}" for p in parts)


def composite_list(values: Column) -> Column:
    """Injective join of a list of texts; null has a mark of its own."""
    return F.array_join(F.transform(values, lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))), "")


def order_free(*parts: Column) -> Column:
    """Identity of a combination that doesn't depend on the order of its parts."""
    return F.sha2(composite_list(F.array_sort(F.array(*parts))), 256)


def canonical_row(types: dict[str, str]) -> Column:
    """Injective text of a row's values by column name; floating-point values, which are no facts, by their shortest text."""
    kind = lambda c: base_type(types[c])
    text = lambda c: canonical(F.col(c), types[c]) if kind(c) in TAGS else F.coalesce(F.concat(F.lit(kind(c) + ":"), F.col(c).cast("string")), F.lit("null"))
    return composite(*[text(c) for c in sorted(types)])


def row_fact(namespace: str, snapshot: str, key: Column) -> Column:
    return digest("row", namespace, snapshot, key)


def cell_fact(namespace: str, snapshot: str, key: Column, field: str, sql_type: str, value: Column) -> Column:
    return digest("cell", namespace, snapshot, key, field, base_type(sql_type), canonical(value, sql_type))


def derived_fact(bundle: Column | str, row_key: Column, expression: Column | str, sql_type: Column | str, value: Column, commitment: Column) -> Column:
    return digest("derived", bundle, row_key, expression, sql_type, value, commitment)


# -- the same as SQL text, for comparison with another engine --------------------------------------------------------


def sql_composite(*parts: str) -> str:
    return " || ".join(f"strlen({p}) || ':' || {p}" for p in parts)


def sql_digest(*parts: str) -> str:
    return f"sha256({sql_composite(*parts)})"


def sql_canonical(value: str, sql_type: str) -> str:
    kind = base_type(sql_type)
    if kind == "decimal":
        text = f"regexp_replace(regexp_replace(CAST({value} AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"
    elif kind == "date":
        text = f"strftime({value}, '%Y-%m-%d')"
    else:
        text = f"CAST({value} AS VARCHAR)"
    return f"coalesce('{TAGS[kind]}:' || {text}, 'null')"
