"""Accounting on ordinals of published rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordinals
from ..operators.digest import set_digest, sql_set_digest
from ..plans.plan import Filter, Plan
from ..streaming.shared import shared_folder
from . import query
from .exposure import INFLUENCE
from .relational import join2_plan
from .tables import ORDERS

_published: dict[tuple[str, str, str], str] = {}


def published(spark: SparkSession, sf: str, *products: str) -> str:
    """The folder where a session has published the products; that is done once, before the first question."""
    app = spark.sparkContext.applicationId
    base = _published.setdefault((app, sf, ""), shared_folder(spark, "ordinals"))
    for p in products:
        if (app, sf, p) not in _published:
            ordinals.publish(spark, sf, p, base)
            _published[app, sf, p] = base
    return base


@query(sql_set_digest(f"SELECT fact_hash AS h, fact_hash AS t FROM ({INFLUENCE})"))
def ordinal_influence(spark: SparkSession, sf: str) -> DataFrame:
    """What ``influence_join_group`` finds, derived on ordinals, kept as stored pages, and hashed when read out."""
    base = published(spark, sf, "orders", "lineitem")
    stored = ordinals.packed(ordinals.influence_pages(spark, base, join2_plan()))
    return set_digest(ordinals.facts_of(spark, base, ordinals.unpacked(stored)), "fact_hash")


JOINED = f"(SELECT o_orderkey, count(*) AS lines FROM {ORDERS} JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate < DATE '1996-01-01' GROUP BY o_orderkey)"


@query(" UNION ALL ".join([f"SELECT 'orders' AS product, '{c}' AS plane, count(*) AS n FROM {JOINED}" for c in ("", "o_orderkey", "o_orderdate", "o_orderstatus")] + [f"SELECT 'lineitem', '{c}', CAST(sum(lines) AS BIGINT) FROM {JOINED}" for c in ("", "l_orderkey", "l_extendedprice")]))
def ordinal_influence_pages(spark: SparkSession, sf: str) -> DataFrame:
    """How many facts of each plane a grouped join depends on; no fact is hashed."""
    return ordinals.cardinalities(ordinals.influence_pages(spark, published(spark, sf, "orders", "lineitem"), join2_plan()))


O = {"orders": "orders"}  # noqa: E741
CLOSED = Plan(O, ("orders.o_orderkey",), filters=(Filter("orders.o_orderstatus", "=", "F"),))
EARLY = Plan(O, ("orders.o_orderkey",), filters=(Filter("orders.o_orderdate", "<", "1996-01-01"),))
PAGED = Plan(O, ("orders.o_orderkey",), filters=(Filter("orders.o_orderstatus", "=", "F"),), limit=10)
IS_F, IS_EARLY = "o_orderstatus = 'F'", "o_orderdate < DATE '1996-01-01'"


@query(f"""SELECT CAST(1 AS BIGINT) AS seq, 3 * count(*) FILTER ({IS_F}) AS actual, 3 * count(*) FILTER ({IS_F}) AS charged FROM {ORDERS}
UNION ALL SELECT 2, 3 * count(*) FILTER ({IS_EARLY}), count(*) FILTER ({IS_EARLY}) + 2 * count(*) FILTER ({IS_EARLY} AND NOT {IS_F}) FROM {ORDERS}
UNION ALL SELECT 3, 3 * least(10, count(*) FILTER ({IS_F})), 0 FROM {ORDERS}""")
def ordinal_charges(spark: SparkSession, sf: str) -> DataFrame:
    """Three questions of one root settled as pages: the second costs what the first didn't show, a page of the first nothing."""
    base = published(spark, sf, "orders")
    stream = None
    for seq, plan in enumerate((CLOSED, EARLY, PAGED), 1):
        own = ordinals.influence_pages(spark, base, plan).select(F.lit("root").alias("root"), F.lit(seq).cast("long").alias("seq"), *ordinals.PAGE, "bits")
        stream = own if stream is None else stream.unionByName(own)
    return ordinals.page_charges(stream).drop("root")
