"""Products: logical read-only tables with keys, scopes and a pinned snapshot."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical, composite


@dataclass(frozen=True)
class Scope:
    """A mandatory filter domain: kind is enum or date_range."""

    name: str
    column: str
    kind: str = "enum"
    domain: tuple = ()


@dataclass(frozen=True)
class Product:
    name: str
    table: str
    key: tuple[str, ...]
    columns: dict[str, str]
    namespace: str
    snapshot: str = "day0"
    sensitivity: str = "internal"
    scopes: tuple[Scope, ...] = ()
    aggregates: tuple[str, ...] = ("count", "sum", "min", "max")
    prepare: Callable[[DataFrame], DataFrame] | None = field(default=None, compare=False)


def _line_copies(df: DataFrame) -> DataFrame:
    """Order and line number don't tell lines apart, so equal ones are numbered by all their other columns."""
    rest = [c for c in df.columns if c not in ("l_orderkey", "l_linenumber")]
    return df.withColumn("l_copy", F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*rest)))


MONEY = "decimal(18,2)"
PRODUCTS: dict[str, Product] = {
    p.name: p
    for p in (
        Product("region", "region", ("r_regionkey",), {"r_regionkey": "int", "r_name": "string"}, "shop.region", sensitivity="public"),
        Product("nation", "nation", ("n_nationkey",), {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}, "shop.nation", sensitivity="public"),
        Product("customer", "customer", ("c_custkey",), {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": MONEY, "c_mktsegment": "string"}, "shop.customer", sensitivity="confidential", scopes=(Scope("segment", "c_mktsegment"),)),
        Product("supplier", "supplier", ("s_suppkey",), {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": MONEY}, "shop.supplier"),
        Product("part", "part", ("p_partkey",), {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": MONEY}, "shop.part"),
        Product("orders", "orders", ("o_orderkey",), {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": MONEY, "o_orderdate": "date", "o_orderpriority": "string"}, "shop.orders", scopes=(Scope("status", "o_orderstatus"), Scope("ordered", "o_orderdate", "date_range"))),
        Product("lineitem", "lineitem", ("l_orderkey", "l_linenumber", "l_copy"), {"l_orderkey": "bigint", "l_linenumber": "int", "l_copy": "int", "l_partkey": "bigint", "l_suppkey": "bigint", "l_quantity": MONEY, "l_extendedprice": MONEY, "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "date"}, "shop.lineitem", prepare=_line_copies),
        Product("events", "events", ("event_id",), {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": MONEY, "props": "string"}, "web.events", sensitivity="confidential"),
    )
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A product's columns with their declared types; only these columns are read."""
    p = PRODUCTS[name]
    df = spark.read.parquet(f"{sf_dir}/{p.table}.parquet")
    if p.prepare:
        df = p.prepare(df)
    return df.select([typed(F.col(c), t).alias(c) for c, t in p.columns.items()])


def typed(value: Column, sql_type: str) -> Column:
    """A column as its declared type; money in binary floats is rounded to cents first, which is exact."""
    return F.round(value, 2).cast(sql_type) if sql_type.startswith("decimal") else value.cast(sql_type)


def scan(spark: SparkSession, sf_dir: str, name: str, role: str | None = None) -> DataFrame:
    """A product under a role: columns ``role__column`` and ``role__key``, the canonical entity key."""
    p = PRODUCTS[name]
    role = role or name
    df = load(spark, sf_dir, name)
    return df.select(entity_key(p).alias(f"{role}__key"), *[F.col(c).alias(f"{role}__{c}") for c in p.columns])


def entity_key(p: Product) -> Column:
    return composite(*[canonical(F.col(c), p.columns[c]) for c in p.key])


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number; a snapshot must have none."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def schema_mismatches(df: DataFrame, p: Product) -> list[tuple[str, str, str]]:
    """(column, declared, found) where a table doesn't have a product's columns in a form that can hold their types."""
    found = dict(df.dtypes)
    loose = {"int": ("smallint", "int", "bigint"), "bigint": ("smallint", "int", "bigint"), "date": ("date", "timestamp", "timestamp_ntz")}
    out = []
    for c, t in p.columns.items():
        have = found.get(c)
        base = t.split("(")[0]
        ok = have == t or have in loose.get(base, ()) or base == "decimal" and have is not None and (have == "double" or have.startswith("decimal"))
        if not ok and not (p.prepare and have is None and c in p.key):
            out.append((c, t, have or "missing"))
    return out


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """A table over JDBC, read in ranges of a numeric key by as many tasks."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=options)


def attested_jdbc(spark: SparkSession, url: str, p: Product, partition_column: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """A product's snapshot over JDBC; raises if the table there lacks a column, or has it in a form that cannot hold its type.

    The schema is looked at before any row is read. Names in other letters are taken as the product's. Only the product's
    columns are asked for; values are cast as ``load`` does.
    """
    df = read_jdbc(spark, url, p.table, partition_column, lower, upper, partitions, **options)
    names = {c.lower(): c for c in df.columns}
    df = df.select(*[F.col(f"`{names[c]}`").alias(c) for c in p.columns if c in names])
    wrong = schema_mismatches(df, p)
    if wrong:
        raise ValueError(f"{p.name} is not as declared: " + "; ".join(f"{c} is {found}, not {kind}" for c, kind, found in wrong))
    return df.select([typed(F.col(c), t).alias(c) for c, t in p.columns.items()])


def read_json(spark: SparkSession, path: str, p: Product) -> DataFrame:
    """A snapshot given as JSON lines; the schema is declared, never inferred. Decimals are read from text, not floats."""
    ddl = ", ".join(f"{c} {t}" for c, t in p.columns.items())
    return spark.read.schema(ddl).option("mode", "FAILFAST").json(path)


def governed_view(spark: SparkSession, sf_dir: str, name: str, view: str) -> DataFrame:
    """A temporary view of a product with a constant scope column."""
    df = load(spark, sf_dir, name).withColumn("eval_scope", F.lit("all"))
    df.createOrReplaceTempView(view)
    return df
