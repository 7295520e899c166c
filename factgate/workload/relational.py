"""Projection, filters, joins, aggregates, windows, paging, set operations and scalar functions over products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import wide
from ..plans.build import visible
from ..plans.plan import Aggregate, Filter, Join, Order, Plan
from ..sources.products import duplicate_keys, governed_view, load
from . import query
from .tables import CUSTOMER, LINES, ORDERS

O = {"orders": "orders"}  # noqa: E741
ORDER_LINES = Join((("orders.o_orderkey", "lineitem.l_orderkey"),))


@query(f"SELECT o_orderkey, o_orderstatus AS status, o_totalprice FROM {ORDERS}")
def scan_project(spark: SparkSession, sf: str) -> DataFrame:
    return visible(spark, sf, Plan(O, ("orders.o_orderkey", "orders.o_orderstatus", "orders.o_totalprice"), aliases={"orders.o_orderstatus": "status"}))


@query(f"SELECT o_orderkey, o_totalprice FROM {ORDERS} WHERE o_totalprice >= 200000 AND o_orderdate < DATE '1997-01-01' AND o_orderstatus <> 'P'")
def filter_cmp(spark: SparkSession, sf: str) -> DataFrame:
    f = (Filter("orders.o_totalprice", ">=", 200000), Filter("orders.o_orderdate", "<", "1997-01-01"), Filter("orders.o_orderstatus", "<>", "P"))
    return visible(spark, sf, Plan(O, ("orders.o_orderkey", "orders.o_totalprice"), filters=f))


@query("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%1_' AND c_mktsegment LIKE 'B%'")
def filter_like(spark: SparkSession, sf: str) -> DataFrame:
    f = (Filter("customer.c_name", "like", "%1_"), Filter("customer.c_mktsegment", "like", "B%"))
    return visible(spark, sf, Plan({"customer": "customer"}, ("customer.c_custkey", "customer.c_name"), filters=f))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey BETWEEN 7 AND 3500")
def filter_in_long(spark: SparkSession, sf: str) -> DataFrame:
    return visible(spark, sf, Plan(O, ("orders.o_orderkey", "orders.o_orderpriority"), filters=(Filter("orders.o_orderkey", "in", tuple(range(7, 3501, 7))),)))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
def filter_in(spark: SparkSession, sf: str) -> DataFrame:
    return visible(spark, sf, Plan(O, ("orders.o_orderkey",), filters=(Filter("orders.o_orderstatus", "in", ("F", "P")), Filter("orders.o_orderpriority", "not_in", ("1-URGENT", "5-LOW")))))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', NULL)")
def filter_not_in_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return visible(spark, sf, Plan(O, ("orders.o_orderkey",), filters=(Filter("orders.o_orderstatus", "not_in", ("F", None)),)))


@query(f"SELECT o_orderstatus, count(*) AS n FROM {ORDERS} WHERE o_orderstatus IN ('F', 'O') AND o_orderdate >= DATE '1994-01-01' AND o_orderdate <= DATE '1996-12-31' GROUP BY o_orderstatus")
def scope_range(spark: SparkSession, sf: str) -> DataFrame:
    plan = Plan(O, ("orders.o_orderstatus",), group_by=("orders.o_orderstatus",), aggregates=(Aggregate("count", "*", "n"),))
    return visible(spark, sf, plan, {"status": ["F", "O"], "ordered": ("1994-01-01", "1996-12-31")})


@query(f"SELECT c_custkey, c_acctbal FROM {CUSTOMER} WHERE c_mktsegment = 'BUILDING' AND c_acctbal IS NOT NULL")
def scope_view(spark: SparkSession, sf: str) -> DataFrame:
    plan = Plan({"customer": "customer"}, ("customer.c_custkey", "customer.c_acctbal"), filters=(Filter("customer.c_acctbal", "is_not_null"),))
    return visible(spark, sf, plan, {"segment": "BUILDING"})


@query("SELECT count(*) AS n FROM lineitem")
def agg_count_star(spark: SparkSession, sf: str) -> DataFrame:
    return visible(spark, sf, Plan({"lineitem": "lineitem"}, aggregates=(Aggregate("count", "*", "n"),)))


@query("SELECT event_type, count(value) AS n FROM events GROUP BY event_type")
def agg_count_col(spark: SparkSession, sf: str) -> DataFrame:
    return visible(spark, sf, Plan({"events": "events"}, ("events.event_type",), group_by=("events.event_type",), aggregates=(Aggregate("count", "events.value", "n"),)))


@query(f"SELECT l_returnflag, l_linestatus, CAST(sum(l_extendedprice) AS DECIMAL(38,2)) AS total, CAST(sum(l_orderkey) AS DECIMAL(38,0)) AS keys FROM {LINES} GROUP BY ALL")
def agg_sum_decimal(spark: SparkSession, sf: str) -> DataFrame:
    keys = ("lineitem.l_returnflag", "lineitem.l_linestatus")
    return visible(spark, sf, Plan({"lineitem": "lineitem"}, keys, group_by=keys, aggregates=(Aggregate("sum", "lineitem.l_extendedprice", "total"), Aggregate("sum", "lineitem.l_orderkey", "keys"))))


@query(f"SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderdate) AS first, max(o_orderstatus) AS last_status FROM {ORDERS} GROUP BY o_orderpriority")
def agg_min_max(spark: SparkSession, sf: str) -> DataFrame:
    aggs = (Aggregate("min", "orders.o_totalprice", "lo"), Aggregate("max", "orders.o_totalprice", "hi"), Aggregate("min", "orders.o_orderdate", "first"), Aggregate("max", "orders.o_orderstatus", "last_status"))
    return visible(spark, sf, Plan(O, ("orders.o_orderpriority",), group_by=("orders.o_orderpriority",), aggregates=aggs))


@query(f"SELECT c_mktsegment, round(CAST(sum(c_acctbal) AS DOUBLE) / count(c_acctbal), 4) AS mean FROM {CUSTOMER} GROUP BY c_mktsegment")
def agg_avg(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).cast("double").alias("mean"))


@query(f"SELECT CAST(sum(o_totalprice) AS DECIMAL(38,2)) AS total FROM {ORDERS} GROUP BY o_orderpriority")
def agg_hidden_key(spark: SparkSession, sf: str) -> DataFrame:
    return visible(spark, sf, Plan(O, group_by=("orders.o_orderpriority",), aggregates=(Aggregate("sum", "orders.o_totalprice", "total"),)))


@query(f"SELECT count(*) AS n, CAST(sum(o_totalprice) AS DECIMAL(38,2)) AS total FROM {ORDERS} WHERE o_orderstatus = 'none such'")
def agg_global_empty(spark: SparkSession, sf: str) -> DataFrame:
    return visible(spark, sf, Plan(O, filters=(Filter("orders.o_orderstatus", "=", "none such"),), aggregates=(Aggregate("count", "*", "n"), Aggregate("sum", "orders.o_totalprice", "total"))))


@query(f"SELECT o_orderkey, o_totalprice FROM {ORDERS} ORDER BY o_orderpriority ASC NULLS LAST, o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 20 OFFSET 10")
def page_stable(spark: SparkSession, sf: str) -> DataFrame:
    df = load(spark, sf, "orders").orderBy(F.col("o_orderpriority").asc_nulls_last(), F.col("o_totalprice").desc_nulls_first(), "o_orderkey")
    return df.offset(10).limit(20).select("o_orderkey", "o_totalprice")


@query(f"SELECT o_totalprice, o_orderkey FROM {ORDERS} ORDER BY o_totalprice DESC NULLS FIRST, strlen('i:' || o_orderkey) || ':i:' || o_orderkey LIMIT 25")
def page_plan(spark: SparkSession, sf: str) -> DataFrame:
    return visible(spark, sf, Plan(O, ("orders.o_totalprice", "orders.o_orderkey"), order_by=(Order("orders.o_totalprice", True),), limit=25))


@query(f"SELECT o_orderstatus, CAST(sum(l_extendedprice) AS DECIMAL(38,2)) AS total, count(*) AS n FROM {ORDERS} JOIN {LINES} ON o_orderkey = l_orderkey WHERE o_orderdate < DATE '1996-01-01' GROUP BY o_orderstatus")
def join2_group(spark: SparkSession, sf: str) -> DataFrame:
    return visible(spark, sf, join2_plan())


def join2_plan() -> Plan:
    return Plan({"orders": "orders", "lineitem": "lineitem"}, ("orders.o_orderstatus",), (ORDER_LINES,), (Filter("orders.o_orderdate", "<", "1996-01-01"),), ("orders.o_orderstatus",), (Aggregate("sum", "lineitem.l_extendedprice", "total"), Aggregate("count", "*", "n")))


@query(f"""SELECT r_name, c_mktsegment, CAST(sum(l_extendedprice) AS DECIMAL(38,2)) AS total, count(*) AS n FROM {ORDERS} JOIN {LINES} ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, c_mktsegment""")
def join5_graph(spark: SparkSession, sf: str) -> DataFrame:
    joins = (ORDER_LINES, Join((("customer.c_custkey", "orders.o_custkey"),)), Join((("customer.c_nationkey", "nation.n_nationkey"),)), Join((("region.r_regionkey", "nation.n_regionkey"),)))
    keys = ("region.r_name", "customer.c_mktsegment")
    return visible(spark, sf, Plan({x: x for x in ("orders", "lineitem", "customer", "nation", "region")}, keys, joins, group_by=keys, aggregates=(Aggregate("sum", "lineitem.l_extendedprice", "total"), Aggregate("count", "*", "n"))))


@query("SELECT c_custkey, s_name, c_name FROM customer JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey")
def join_composite_key(spark: SparkSession, sf: str) -> DataFrame:
    """An edge of two equalities: customers with the supplier of the same number and nation."""
    on = Join((("customer.c_custkey", "supplier.s_suppkey"), ("customer.c_nationkey", "supplier.s_nationkey")))
    return visible(spark, sf, Plan({"customer": "customer", "supplier": "supplier"}, ("customer.c_custkey", "supplier.s_name", "customer.c_name"), (on,)))


@query("SELECT n_name, count(*) AS pairs FROM customer JOIN supplier ON c_nationkey = s_nationkey JOIN nation ON n_nationkey = c_nationkey AND n_nationkey = s_nationkey GROUP BY n_name")
def join_composite_key_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The same join over whole tables, counted: both sides are grouped by nation before they meet."""
    c = load(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    s = load(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("s"))
    both = c.join(s, F.col("c_nationkey") == F.col("s_nationkey"))
    return both.join(load(spark, sf, "nation"), (F.col("n_nationkey") == F.col("c_nationkey")) & (F.col("n_nationkey") == F.col("s_nationkey"))).select("n_name", (F.col("c") * F.col("s")).alias("pairs"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders WHERE (o_orderstatus = 'F') OR (o_orderpriority LIKE '1%')")
def union_distinct_subset(spark: SparkSession, sf: str) -> DataFrame:
    cols = ("orders.o_orderstatus", "orders.o_orderpriority")
    return visible(spark, sf, Plan(O, cols, union=((Filter("orders.o_orderstatus", "=", "F"),), (Filter("orders.o_orderpriority", "like", "1%"),))))


@query("""(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0""")
def setops_intersect_except(spark: SparkSession, sf: str) -> DataFrame:
    c, s, n = load(spark, sf, "customer"), load(spark, sf, "supplier"), load(spark, sf, "nation")
    return c.select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey")).subtract(n.where("n_regionkey = 0").select("n_nationkey"))


@query("SELECT o_orderpriority AS p FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'O'")
def setops_except_all(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_orderpriority").alias("p")).exceptAll(o.where("o_orderstatus = 'O'").select("o_orderpriority"))


@query(f"SELECT o_custkey, count(*) AS n, CAST(sum(o_totalprice) AS DECIMAL(38,2)) AS total FROM {ORDERS} GROUP BY o_custkey HAVING count(*) >= 12")
def having(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").cast("decimal(38,2)").alias("total")).where("n >= 12")


GROUPED = "count(*) AS n, CAST(grouping(o_orderstatus) AS INTEGER) AS g1, CAST(grouping(o_orderpriority) AS INTEGER) AS g2"


def grouped(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.grouping("o_orderstatus").cast("int").alias("g1"), F.grouping("o_orderpriority").cast("int").alias("g2"))


@query(f"SELECT o_orderstatus, o_orderpriority, {GROUPED} FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(spark: SparkSession, sf: str) -> DataFrame:
    return grouped(load(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority"))


@query(f"SELECT o_orderstatus, o_orderpriority, {GROUPED} FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark: SparkSession, sf: str) -> DataFrame:
    return grouped(load(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority"))


@query(f"SELECT o_orderstatus, o_orderpriority, {GROUPED} FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    return grouped(o.groupingSets([[F.col("o_orderstatus")], [F.col("o_orderpriority")], []], "o_orderstatus", "o_orderpriority"))


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS kinds, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS list FROM orders GROUP BY o_custkey")
def agg_modifiers(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",")
    return load(spark, sf, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("kinds"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), kinds.alias("list"))


@query(f"SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {ORDERS}) WHERE r = 1")
def distinct_on_key(spark: SparkSession, sf: str) -> DataFrame:
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey")))
    return load(spark, sf, "orders").groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.o_orderkey", "b.o_totalprice")


@query(f"SELECT o_orderkey, CAST(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DECIMAL(38,2)) AS running, CAST(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DECIMAL(38,2)) AS last3 FROM {ORDERS}")
def window_running_sum(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    total = lambda x: F.sum("o_totalprice").over(x).cast("decimal(38,2)")
    return load(spark, sf, "orders").select("o_orderkey", total(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"), total(w.rowsBetween(-2, 0)).alias("last3"))


@query(f"SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first FROM {ORDERS} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def window_rank(spark: SparkSession, sf: str) -> DataFrame:
    w, by = Window.partitionBy("o_custkey").orderBy("o_orderpriority"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return load(spark, sf, "orders").select("o_orderkey", F.rank().over(w).cast("bigint").alias("r"), F.dense_rank().over(w).cast("bigint").alias("d"), F.lag("o_totalprice").over(by).alias("before"), F.first_value("o_orderkey").over(by).alias("first"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_exists(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").where("o_orderstatus = 'P'")
    return load(spark, sf, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_not_exists(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").where("o_orderstatus = 'F'")
    return load(spark, sf, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey GROUP BY c_custkey")
def left_outer(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").where("o_orderstatus = 'P'")
    return load(spark, sf, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query(f"SELECT n_name, s.n AS suppliers, c.n AS customers FROM (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal < 0 GROUP BY 1) s FULL JOIN (SELECT c_nationkey, count(*) AS n FROM {CUSTOMER} WHERE c_acctbal < 0 GROUP BY 1) c ON s_nationkey = c_nationkey RIGHT JOIN nation ON n_nationkey = coalesce(s_nationkey, c_nationkey)")
def full_and_right_outer(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers and customers in debt by nation; some nations have neither, some one of them."""
    s = load(spark, sf, "supplier").where("s_acctbal < 0").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    c = load(spark, sf, "customer").where("c_acctbal < 0").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    both = s.join(c, F.col("s_nationkey") == F.col("c_nationkey"), "full").withColumn("k", F.coalesce("s_nationkey", "c_nationkey"))
    return both.join(load(spark, sf, "nation"), F.col("n_nationkey") == F.col("k"), "right").select("n_name", "suppliers", "customers")


@query("SELECT n_name, s.n AS suppliers, c.n AS customers FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s FULL JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON s_nationkey = c_nationkey RIGHT JOIN nation ON n_nationkey = coalesce(s_nationkey, c_nationkey)")
def full_and_right_outer_whole(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    c = load(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    both = s.join(c, F.col("s_nationkey") == F.col("c_nationkey"), "full").withColumn("k", F.coalesce("s_nationkey", "c_nationkey"))
    return both.join(load(spark, sf, "nation"), F.col("n_nationkey") == F.col("k"), "right").select("n_name", "suppliers", "customers")


@query("SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def self_join_theta(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation")
    return n.alias("a").join(n.alias("b"), (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("left_name"), F.col("b.n_name").alias("right_name"))


@query(f"SELECT o_orderkey FROM {ORDERS} WHERE o_totalprice > (SELECT max(o_totalprice) * 0.95 FROM {ORDERS})")
def scalar_subquery(spark: SparkSession, sf: str) -> DataFrame:
    load(spark, sf, "orders").createOrReplaceTempView("fg_orders")
    return spark.sql("SELECT o_orderkey FROM fg_orders WHERE o_totalprice > (SELECT max(o_totalprice) * 0.95 FROM fg_orders)")


@query(f"SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM {ORDERS} WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)")
def lateral_top1(spark: SparkSession, sf: str) -> DataFrame:
    load(spark, sf, "orders").createOrReplaceTempView("fg_orders")
    load(spark, sf, "customer").createOrReplaceTempView("fg_customer")
    return spark.sql("SELECT c_custkey, t.o_orderkey FROM fg_customer, LATERAL (SELECT max_by(o_orderkey, struct(o_totalprice, -o_orderkey)) AS o_orderkey FROM fg_orders WHERE o_custkey = c_custkey) t WHERE t.o_orderkey IS NOT NULL")


@query("WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), top AS (SELECT * FROM big WHERE n > 11) SELECT c_name, n FROM top JOIN customer ON c_custkey = o_custkey")
def cte_derived(spark: SparkSession, sf: str) -> DataFrame:
    load(spark, sf, "orders").createOrReplaceTempView("fg_orders")
    load(spark, sf, "customer").createOrReplaceTempView("fg_customer")
    return spark.sql("WITH big (k, n) AS (SELECT o_custkey, count(*) FROM fg_orders GROUP BY 1), top AS (SELECT * FROM big WHERE n > 11) SELECT c_name, n FROM top JOIN fg_customer ON c_custkey = k")


@query(f"""SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'O'), 'open') AS s, greatest(o_orderkey, o_custkey) AS g, least(o_orderkey, o_custkey) AS l, (o_orderstatus = 'F') IS TRUE AS done FROM {ORDERS}""")
def case_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    band = F.when(F.col("o_totalprice") >= 300000, "high").when(F.col("o_totalprice") >= 100000, "mid").otherwise("low")
    return load(spark, sf, "orders").select("o_orderkey", band.alias("band"), F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("O")), F.lit("open")).alias("s"), F.greatest("o_orderkey", "o_custkey").alias("g"), F.least("o_orderkey", "o_custkey").alias("l"), (F.col("o_orderstatus") == "F").eqNullSafe(F.lit(True)).alias("done"))


@query("""SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, trim(p_type) AS t, CAST(length(p_name) AS BIGINT) AS n, replace(p_type, 'E', '3') AS r, substring(p_name, 2, 5) AS s, concat(p_brand, NULL, '-', p_size) AS c, concat_ws('/', p_brand, NULL, p_type) AS w, p_name NOT LIKE '%a%' AS na, p_name ILIKE '%A%' AS ia FROM part""")
def string_funcs(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part")
    none = F.lit(None).cast("string")
    return p.select("p_partkey", F.upper("p_name").alias("u"), F.lower("p_brand").alias("l"), F.trim("p_type").alias("t"), F.length("p_name").cast("bigint").alias("n"), F.replace("p_type", F.lit("E"), F.lit("3")).alias("r"), F.substring("p_name", 2, 5).alias("s"), wide.concat(F.col("p_brand"), none, F.lit("-"), F.col("p_size")).alias("c"), F.concat_ws("/", "p_brand", none, "p_type").alias("w"), (~F.col("p_name").like("%a%")).alias("na"), F.col("p_name").ilike("%A%").alias("ia"))


@query("SELECT p_partkey, p_size // 7 AS q, (-p_size) // 7 AS neg, p_size % 7 AS m, CAST(abs(-p_size) AS INTEGER) AS a, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c FROM part")
def math_funcs(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part")
    return p.select("p_partkey", wide.int_div(F.col("p_size"), F.lit(7)).cast("int").alias("q"), wide.int_div(-F.col("p_size"), F.lit(7)).cast("int").alias("neg"), (F.col("p_size") % 7).alias("m"), F.abs(-F.col("p_size")).alias("a"), F.floor("p_retailprice").cast("bigint").alias("f"), F.ceil("p_retailprice").cast("bigint").alias("c"))


@query(f"SELECT o_orderkey, CAST(date_part('year', o_orderdate) AS INTEGER) AS y, CAST(date_part('quarter', o_orderdate) AS INTEGER) AS q, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, strftime(o_orderdate, '%Y-%m') AS ym FROM {ORDERS}")
def date_funcs(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    return o.select("o_orderkey", F.date_part(F.lit("YEAR"), "o_orderdate").alias("y"), F.date_part(F.lit("QUARTER"), "o_orderdate").alias("q"), F.date_trunc("month", "o_orderdate").cast("date").alias("m"), wide.to_char(F.col("o_orderdate"), "YYYY-MM").alias("ym"))


@query("SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS k FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(wide.json_path_text(F.col("props"), "k")).alias("k"))


@query("SELECT o_custkey, list_has_all(s, ['F', 'O']) AS both FROM (SELECT o_custkey, list(DISTINCT o_orderstatus) AS s FROM orders GROUP BY 1)")
def containment(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    return s.select("o_custkey", wide.array_contains_all(F.col("s"), F.array(F.lit("F"), F.lit("O"))).alias("both"))


@query(f"SELECT c_mktsegment, count(*) AS n FROM (SELECT *, 'all' AS eval_scope FROM {CUSTOMER}) WHERE eval_scope = 'all' GROUP BY c_mktsegment")
def governed_views(spark: SparkSession, sf: str) -> DataFrame:
    governed_view(spark, sf, "customer", "fg_customers_by_segment")
    return spark.sql("SELECT c_mktsegment, count(*) AS n FROM fg_customers_by_segment WHERE eval_scope = 'all' GROUP BY c_mktsegment")


@query(f"SELECT strftime(o_orderdate, '%Y-%m') AS month, c_mktsegment, CAST(sum(o_totalprice) AS DECIMAL(38,2)) AS total, count(*) AS requests FROM {ORDERS} JOIN customer ON c_custkey = o_custkey GROUP BY ALL")
def preaggregated_publication(spark: SparkSession, sf: str) -> DataFrame:
    both = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return both.groupBy(wide.to_char(F.col("o_orderdate"), "YYYY-MM").alias("month"), "c_mktsegment").agg(F.sum("o_totalprice").cast("decimal(38,2)").alias("total"), F.count("*").alias("requests"))


@query(f"""SELECT c_mktsegment, CAST(sum(spent) AS DECIMAL(38,2)) AS total, count(*) AS customers FROM (SELECT o_custkey, sum(o_totalprice) AS spent FROM {ORDERS} WHERE o_orderstatus <> 'P' GROUP BY o_custkey) JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment""")
def view_stack_depth4(spark: SparkSession, sf: str) -> DataFrame:
    """Four stacked views as functions: filter, group, join, group."""
    settled = lambda: load(spark, sf, "orders").where("o_orderstatus <> 'P'")
    spent = lambda: settled().groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"))
    named = lambda: spent().join(load(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return named().groupBy("c_mktsegment").agg(F.sum("spent").cast("decimal(38,2)").alias("total"), F.count("*").alias("customers"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_key_check(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_keys(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])

