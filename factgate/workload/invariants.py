"""Annotated relations that break their rules on purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonical, cell_fact, row_fact
from ..operators.invariants import violations
from ..sources.products import PRODUCTS, entity_key, load
from . import query

RULES = ("row twice", "no cell", "wrong type", "another snapshot", "support without witness", "witness without support", "no multiplicity", "release of another value", "release without support", "not a base fact", "cell without a row")


def annotated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Orders as a relation of two fields with base facts; of every 12 orders the first 11 break one of RULES each."""
    p = PRODUCTS["orders"]
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", entity_key(p).alias("row_key"), (F.col("o_orderkey") % 12).alias("k"))
    fact = lambda c: cell_fact(p.namespace, p.snapshot, F.col("row_key"), c, p.columns[c], F.col(c))
    whole = o.where("k <> 10")
    rows = whole.select("row_key").unionByName(o.where("k = 0").select("row_key"))
    cells = o.select("row_key", "k", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.lit(p.columns[c]).alias("type"), canonical(F.col(c), p.columns[c]).alias("value"), F.lit(c).alias("expression"), fact(c).alias("fact_hash")) for c in ("o_orderkey", "o_orderstatus")])).alias("c")).select("row_key", "k", "c.*")
    # order 10 of 12 has no row, and of it only the first cell
    cells = cells.where("not (k = 10 and field = 'o_orderstatus')").where("not (k = 1 and field = 'o_orderstatus')").withColumn("type", F.when((F.col("k") == 2) & (F.col("field") == "o_orderstatus"), "int").otherwise(F.col("type")))
    base = whole.select("row_key", "k", F.lit("").alias("field"), row_fact(p.namespace, p.snapshot, F.col("row_key")).alias("fact_hash"), F.lit("base-row").alias("kind"))
    base = base.unionByName(cells.select("row_key", "k", "field", "fact_hash", F.lit("base-cell").alias("kind")))
    support = base.where("not (k = 5 and field = '')").withColumn("namespace", F.lit(p.namespace)).withColumn("snapshot", F.when((F.col("k") == 3) & (F.col("field") == ""), "day9").otherwise(p.snapshot)).withColumn("kind", F.when((F.col("k") == 9) & (F.col("field") == ""), "derived").otherwise(F.col("kind")))
    witness = base.where("not (k = 4 and field = '')").select("row_key", "field", "fact_hash", F.when((F.col("k") == 6) & (F.col("field") == ""), 0).otherwise(1).cast("long").alias("n"))
    shown = cells.where("field = 'o_orderkey'").withColumn("value", F.when(F.col("k") == 7, "i:0").otherwise(F.col("value"))).withColumn("fact_hash", F.when(F.col("k") == 8, F.sha2("fact_hash", 256)).otherwise(F.col("fact_hash")))
    releases = shown.select("row_key", "field", "fact_hash", F.lit("base-cell").alias("kind"), "type", "value", "expression", F.lit(None).cast("string").alias("commitment"))
    return rows, cells.drop("k", "fact_hash"), support.drop("k"), witness, releases


@query("SELECT rule, n FROM (SELECT CASE o_orderkey % 12 " + " ".join(f"WHEN {k} THEN '{r}'" for k, r in enumerate(RULES)) + " END AS rule, count(*) AS n FROM orders GROUP BY 1) WHERE rule IS NOT NULL")
def annotated_relation_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules between rows, cells, support, witnesses and releases: each is broken by a twelfth of the orders, and found there only."""
    p = PRODUCTS["orders"]
    found = violations(*annotated(spark, sf), {"o_orderkey": "bigint", "o_orderstatus": "string"}, {p.namespace: p.snapshot})
    return found.groupBy("rule").agg(F.count("*").alias("n"))
