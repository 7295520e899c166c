"""Exposure of questions over views, typed questions in logs, and the settlement of one root with all requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import sql_composite
from ..operators import facts, footprint, ledger
from ..operators.digest import set_digest, sql_set_digest
from ..plans.plan import Filter
from ..sources.products import load
from ..sources.views import View, composed
from . import query
from .history import CAPPED, requests, root_caps
from .tables import ORDERS, cell, key, row

VIEWS = {
    "early": View("early", "orders", ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), (Filter("o_orderdate", "<", "1996-01-01"),)),
    "closed": View("closed", "early", ("o_orderkey", "o_totalprice"), (Filter("o_orderstatus", "=", "F"),)),
    "by_status": View("by_status", "early", group_by=("o_orderstatus",), aggregates=(("count", "*", "n"), ("sum", "o_totalprice", "total"))),
    "totals": View("totals", "by_status", ("o_orderstatus", "total")),
}
LARGE = View("q", "", ("o_orderkey",), (Filter("o_totalprice", ">", 100000),))
SEEN = f"(SELECT *, {key('orders')} AS ok FROM {ORDERS} WHERE o_orderdate < DATE '1996-01-01')"
HELD = f"(SELECT * FROM {SEEN} WHERE o_orderstatus = 'F' AND o_totalprice > 100000)"


def evidence(rows: str, *columns: str) -> str:
    """SQL of the row facts and the given columns' cell facts of some orders, as a set digest."""
    parts = [row("orders", "ok"), *[cell("orders", c, "ok") for c in columns]]
    return sql_set_digest("SELECT DISTINCT h, h AS t FROM (" + " UNION ALL ".join(f"SELECT {x} AS h FROM {rows}" for x in parts) + ")")


@query(evidence(HELD, "o_orderdate", "o_orderstatus", "o_totalprice", "o_orderkey"))
def view_influence(spark: SparkSession, sf: str) -> DataFrame:
    """A question over two stacked views depends on base rows and on the cells that every level tests."""
    return set_digest(facts.influence(spark, sf, composed(VIEWS, "closed", LARGE)), "fact_hash")


@query(f"SELECT {cell('orders', 'o_orderkey', 'ok')} AS fact_hash FROM {HELD}")
def view_release(spark: SparkSession, sf: str) -> DataFrame:
    """What it reveals are base cells of the product under the views."""
    return facts.release(spark, sf, composed(VIEWS, "closed", LARGE))


@query(evidence(SEEN, "o_orderdate", "o_orderstatus", "o_totalprice"))
def view_barrier_influence(spark: SparkSession, sf: str) -> DataFrame:
    """Two columns of a view above one that aggregates: all base rows of the groups, and nothing of the count that isn't picked."""
    return set_digest(facts.influence(spark, sf, composed(VIEWS, "totals", View("q", "", ("total", "o_orderstatus")))), "fact_hash")


@query(f"SELECT 2 * count(DISTINCT o_orderstatus) AS facts FROM {SEEN}")
def view_barrier_release(spark: SparkSession, sf: str) -> DataFrame:
    """Each picked cell of each group is a derived fact."""
    return facts.release(spark, sf, composed(VIEWS, "totals", View("q", "", ("total", "o_orderstatus")))).agg(F.count("*").alias("facts"))


def price_log(spark: SparkSession, sf: str) -> DataFrame:
    """A question for each order, whose price is written in one of several ways, or is null, or is the text null asked of the priority."""
    k = F.floor(F.col("o_totalprice") / 1000).cast("bigint").cast("string")
    way = F.col("o_orderkey") % 5
    value = F.when(way == 0, k).when(way == 1, F.concat(k, F.lit(".00"))).when(way == 2, F.concat(F.lit("0"), k, F.lit(".0"))).when(way == 3, F.lit("null"))
    term = F.struct(F.when(way >= 3, "o_orderpriority").otherwise("o_totalprice").alias("col"), F.lit("=").alias("op"), F.array(value).alias("values"))
    none = F.array().cast("array<string>")
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.lit("orders").alias("product"), F.array(F.lit("o_orderkey")).alias("columns"), none.alias("aggregates"), F.array(term).alias("filters"), none.alias("group_by"), F.lit(0).alias("limit"), F.lit(0).alias("offset"))


TERM = f"(SELECT CASE WHEN o_orderkey % 5 >= 3 THEN 'o_orderpriority' ELSE 'o_totalprice' END AS col, CASE o_orderkey % 5 WHEN 3 THEN 's:null' WHEN 4 THEN 'null' ELSE 'n:' || CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) END AS v FROM {ORDERS})"
ONE = sql_composite(sql_composite("col", "'='", "(" + sql_composite("v") + ")"))


@query(f"SELECT sha256({sql_composite(chr(39) + 'orders' + chr(39), '(' + sql_composite(chr(39) + 'o_orderkey' + chr(39)) + ')', chr(39) * 2, chr(39) * 2, '(' + ONE + ')', chr(39) + '0' + chr(39), chr(39) + '0' + chr(39))}) AS plan_key, count(*) AS queries FROM {TERM} GROUP BY col, v")
def typed_plan_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of questions whose literals are compared as values of their columns: 50 and 50.00 are one, null and the text null are two."""
    log = footprint.typed(price_log(spark, sf), {"o_totalprice": "decimal(18,2)", "o_orderpriority": "string"})
    return footprint.log_plan_keys(log).groupBy("plan_key").agg(F.count("*").alias("queries"))


@query(f"{CAPPED.replace('user_id % 10', 'CAST(0 AS BIGINT)')} SELECT accepted, count(*) AS requests, CAST(sum(seq) AS BIGINT) AS seqs, CAST(sum(charged_release) AS BIGINT) AS charged_release, CAST(sum(charged_influence) AS BIGINT) AS charged_influence, CAST(sum(charged_outcome) AS BIGINT) AS charged_outcome FROM settled GROUP BY accepted")
def hot_root_settlement(spark: SparkSession, sf: str) -> DataFrame:
    """One root that has all requests, settled in rounds."""
    asked = requests(spark, sf).withColumn("root", F.lit(0).cast("bigint"))
    done = ledger.settle(asked, root_caps(spark), folded=0)
    return done.groupBy("accepted").agg(F.count("*").alias("requests"), F.sum("seq").alias("seqs"), *[F.sum(f"charged_{d}").alias(f"charged_{d}") for d in ledger.DIMS])
