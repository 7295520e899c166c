"""Free SQL under grants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.plan import Rule
from ..sources.statements import Grant, authorize
from . import query
from .tables import CUSTOMER, ORDERS

GRANTS = [
    Grant("customer", ("c_custkey", "c_nationkey", "c_acctbal"), {"segment": Rule("not_in", ("BUILDING",))}, ("max", "count"), ("=", "<", "is not")),
    Grant("orders", ("o_custkey", "o_totalprice", "o_orderpriority"), {"status": Rule("in", ("F", "O"))}, name="sales"),
    Grant("nation", ("n_nationkey", "n_name"), functions=("upper",)),
]
STATEMENT = """
WITH buyers AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM sales GROUP BY o_custkey HAVING count(*) >= 3),
     picked(k) AS (SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM buyers)
                   UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0)
SELECT upper(n.n_name) AS nation, count(*) AS customers, max(b.spent) AS most
FROM customer c JOIN picked p ON c.c_custkey = p.k LEFT JOIN buyers b ON b.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
WHERE NOT EXISTS (SELECT 1 FROM sales s WHERE s.o_custkey = c.c_custkey AND s.o_orderpriority LIKE '1%')
GROUP BY n.n_name
"""


@query(STATEMENT.replace("FROM sales", f"FROM (SELECT * FROM {ORDERS} WHERE o_orderstatus IN ('F', 'O'))").replace("FROM customer", f"FROM (SELECT * FROM {CUSTOMER} WHERE c_mktsegment <> 'BUILDING')"))
def governed_statement(spark: SparkSession, sf: str) -> DataFrame:
    """Common tables, a set operation and nested queries over granted views, in one statement of a user."""
    return authorize(spark, sf, STATEMENT, GRANTS, 1000).rows.withColumn("most", F.col("most").cast("decimal(38,2)"))
