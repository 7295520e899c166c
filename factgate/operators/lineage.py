"""The first lineage algebra: rows carry the set of base facts they came from.

A base or joined row has its facts in an array column, which its width bounds. A merged row can come from any number of
base rows, so its facts are a long table (keys..., fact_hash) that a shuffle makes distinct; no task gathers a group's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical, digest
from .digest import set_digest

LINE = "__lineage"


def value_version(value: Column, sql_type: str) -> Column:
    return digest("version", canonical(value, sql_type))


def fact(product: str, snapshot: str, key: Column, field: str, version: Column) -> Column:
    """A base fact by product, snapshot, entity, field and value version."""
    return digest("fact", product, snapshot, key, field, version)


def base(df: DataFrame, product: str, snapshot: str, key: Column, columns: dict[str, str]) -> DataFrame:
    """A table whose rows each carry the facts of their cells."""
    return df.select(*columns, F.array_sort(F.array(*[fact(product, snapshot, key, c, value_version(F.col(c), t)) for c, t in columns.items()])).alias(LINE))


def select(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(predicate)


def project(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, LINE)


def join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Equality join on values, where null equals null; lineages are united."""
    r = right.withColumnRenamed(LINE, "__right")
    both = left.join(r, left[left_key].eqNullSafe(r[right_key]))
    return both.withColumn(LINE, F.array_sort(F.array_union(LINE, "__right"))).drop("__right")


def union(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct union, and the facts of all rows that equal each of its rows."""
    both = left.unionByName(right)
    keys = [c for c in both.columns if c != LINE]
    return both.select(*keys).distinct(), facts(both, keys)


def aggregate(df: DataFrame, keys: list[str], aggs: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Grouped aggregates, and the facts of all members of each group."""
    return df.groupBy(*keys).agg(*aggs), facts(df, keys)


def facts(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., fact_hash): the different facts of each group."""
    return df.select(*keys, F.explode(LINE).alias("fact_hash")).distinct()


def sized(rows: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """The merged rows with ``facts`` and ``digest``, the number and two-level digest of their facts."""
    d = set_digest(lines, "fact_hash", keys)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"v.{k}").eqNullSafe(F.col(f"l.{k}"))
    return rows.alias("v").join(d.alias("l"), cond, "left").select("v.*", F.coalesce("l.n", F.lit(0)).alias("facts"), "l.digest")


def observed(df: DataFrame) -> DataFrame:
    """(fact_hash): every fact in some row's lineage."""
    return df.select(F.explode(LINE).alias("fact_hash")).distinct()
