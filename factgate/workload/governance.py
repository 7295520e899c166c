"""Grants, sensitivity, scopes, view stacks and catalogs, made from the tables by arithmetic on their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import governance as g
from ..sources.products import load
from . import query

LEVEL = "CASE {0} % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'confidential' ELSE 'restricted' END"


def set_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer requests the suppliers numbered like it and like half of it, modulo 40."""
    c = load(spark, sf, "customer")
    one = lambda x: F.concat(F.lit("p"), (x % 40).cast("string"))
    return c.select(F.col("c_custkey").alias("request"), F.array(one(F.col("c_custkey")), one(F.floor(F.col("c_custkey") / 2))).alias("products"))


def product_levels(spark: SparkSession) -> DataFrame:
    return spark.range(40).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("product"), F.expr(LEVEL.format("id")).alias("sensitivity"))


RANKED = "SELECT c_custkey AS request, greatest((c_custkey % 40) % 4, ((c_custkey // 2) % 40) % 4) AS r FROM customer"


@query(f"SELECT request, {LEVEL.format('r')} AS sensitivity FROM ({RANKED})")
def sensitivity_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return g.effective_sensitivity(set_requests(spark, sf), product_levels(spark))


@query(f"""SELECT request, CASE WHEN a = 1 AND b = 0 THEN 'pair' WHEN a IN (0, 1) OR b IN (0, 1) THEN 'refused' WHEN r < 2 THEN 'auto' WHEN r = 2 THEN 'owner' ELSE 'refused' END AS route
  FROM (SELECT request, r, request % 40 AS a, (request // 2) % 40 AS b FROM ({RANKED}))""")
def approval_route(spark: SparkSession, sf: str) -> DataFrame:
    """The pair p0, p1 has a route of its own; sets that only touch it are refused; others go by sensitivity."""
    r = set_requests(spark, sf)
    known = r.join(g.effective_sensitivity(r, product_levels(spark)), "request")
    routes = spark.createDataFrame([(["p0", "p1"], "pair")], "products array<string>, route string")
    defaults = spark.createDataFrame([("public", "auto"), ("internal", "auto"), ("confidential", "owner")], "sensitivity string, route string")
    return g.approval_routes(known, routes, defaults)


def grants(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's task is delegated by the one numbered half of it, with limits that follow from its number."""
    k = F.col("c_custkey")
    return load(spark, sf, "customer").select(
        k.alias("task"),
        F.when(k > 1, F.floor(k / 2)).alias("parent"),
        F.lit(1).alias("root"),
        F.when(k % 5 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("products"),
        F.array(F.lit("a.x")).alias("columns"),
        F.expr(LEVEL.format("(c_custkey % 3)")).alias("sensitivity"),
        (1000 - k % 100).alias("max_queries"),
        F.lit(10).alias("max_rows"),
        F.lit("2030-01-01").cast("timestamp").alias("expires"),
    )


PAIRS = "(SELECT c.c_custkey AS task, p.c_custkey AS p FROM customer c JOIN customer p ON p.c_custkey = c.c_custkey // 2 WHERE c.c_custkey > 1)"


@query(f"SELECT task, 'products' AS reason FROM {PAIRS} WHERE task % 5 = 0 AND p % 5 <> 0 UNION ALL SELECT task, 'sensitivity' FROM {PAIRS} WHERE task % 3 > p % 3 UNION ALL SELECT task, 'queries' FROM {PAIRS} WHERE task % 100 < p % 100 UNION ALL SELECT c_custkey, 'no parent' FROM customer WHERE c_custkey > 1 AND c_custkey // 2 NOT IN (SELECT c_custkey FROM customer)")
def grant_narrowing(spark: SparkSession, sf: str) -> DataFrame:
    return g.narrowing_violations(grants(spark, sf))


@query(f"SELECT task, 'days' AS name, 'wider' AS reason FROM {PAIRS} WHERE (task % 7) < (p % 7) UNION ALL SELECT task, 'kind', 'missing' FROM {PAIRS} WHERE task % 11 = 0 AND p % 11 <> 0 UNION ALL SELECT task, 'kind', 'wider' FROM {PAIRS} WHERE task % 11 <> 0 AND p % 11 <> 0 AND task % 2 = 1 AND p % 2 = 0")
def scope_narrowing(spark: SparkSession, sf: str) -> DataFrame:
    """Scopes of delegates inside their parents': a date range that starts on day task % 7, and a list unless task % 11 is 0."""
    t = grants(spark, sf).select("task", "parent")
    days = t.select("task", "parent", F.lit("days").alias("name"), F.lit("date_range").alias("kind"), F.array(F.concat(F.lit("2024-01-0"), (F.col("task") % 7 + 1).cast("string")), F.lit("2024-02-01")).alias("values"))
    kinds = t.where("task % 11 <> 0").select("task", "parent", F.lit("kind").alias("name"), F.lit("enum").alias("kind"), F.when(F.col("task") % 2 == 1, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x"))).alias("values"))
    scopes = days.unionByName(kinds)
    return g.scope_violations(scopes, scopes)


@query("SELECT o_orderkey AS request, 'status' AS name, 'outside' AS reason FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 'ordered', 'missing' FROM orders WHERE o_orderkey % 6 = 0")
def scope_domain(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    status = o.select(F.col("o_orderkey").alias("request"), F.lit("orders").alias("product"), F.lit("status").alias("name"), F.array("o_orderstatus").alias("values"))
    day = F.col("o_orderdate").cast("string")
    ordered = o.where("o_orderkey % 6 <> 0").select(F.col("o_orderkey").alias("request"), F.lit("orders").alias("product"), F.lit("ordered").alias("name"), F.array(day, day).alias("values"))
    domains = spark.createDataFrame([("orders", "status", "enum", ["F", "O"], False), ("orders", "ordered", "date_range", ["1990-01-01", "2010-01-01"], True)], "product string, name string, kind string, domain array<string>, required boolean")
    return g.scope_problems(status.unionByName(ordered), domains)


@query('SELECT p_partkey AS request, \'c\' || (p_size % 5) AS "column", CASE WHEN p_size % 5 = 4 THEN \'unknown\' ELSE \'repeated\' END AS reason FROM part WHERE p_size % 5 IN (2, 4)')
def requested_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Parts ask for a column named by their size; one kind asks for it twice."""
    c = F.concat(F.lit("c"), (F.col("p_size") % 5).cast("string"))
    r = load(spark, sf, "part").select(F.col("p_partkey").alias("request"), F.lit("p").alias("product"), F.when(F.col("p_size") % 5 == 2, F.array(c, c)).otherwise(F.array(c)).alias("columns"))
    fields = spark.range(4).select(F.lit("p").alias("product"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("column"))
    return g.column_problems(r, fields)


@query(f"SELECT task, least(1000 - task % 100, 1000 - p % 100) AS max_queries, CAST(10 AS INTEGER) AS max_rows FROM {PAIRS}")
def delegated_budget(spark: SparkSession, sf: str) -> DataFrame:
    return g.delegated_budget(grants(spark, sf).where("parent is not null"), grants(spark, sf), ["max_queries", "max_rows"])


@query("WITH RECURSIVE up AS (SELECT c_custkey AS view, c_custkey // 2 AS base, 1 AS depth FROM customer WHERE c_custkey > 1 UNION ALL SELECT view, base // 2, depth + 1 FROM up WHERE base > 1) SELECT view, base, depth FROM up")
def view_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Everything each view rests on, with its distance; view k rests on view k / 2."""
    return g.closure(load(spark, sf, "customer").where("c_custkey > 1").select(F.col("c_custkey").alias("view"), F.floor(F.col("c_custkey") / 2).alias("depends_on")))


@query("WITH RECURSIVE up AS (SELECT c_custkey AS task, c_custkey // 2 AS ancestor FROM customer WHERE c_custkey > 1 UNION ALL SELECT task, ancestor // 2 FROM up WHERE ancestor > 1) SELECT task, ancestor FROM up WHERE ancestor % 10 = 7")
def inactive_families(spark: SparkSession, sf: str) -> DataFrame:
    t = load(spark, sf, "customer").select(F.col("c_custkey").alias("task"), F.when(F.col("c_custkey") > 1, F.floor(F.col("c_custkey") / 2)).alias("parent"), F.when(F.col("c_custkey") % 10 == 7, "revoked").otherwise("active").alias("state"))
    return g.inactive_ancestors(t)


def registry(spark: SparkSession, sf: str, version: int) -> DataFrame:
    p = load(spark, sf, "part").where("p_partkey % 10 <> " + str(8 + version))
    kind = F.when((F.col("p_size") < 5) & F.lit(version == 1), "text").otherwise("bigint")
    return p.select(F.col("p_brand").alias("table_name"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("column"), kind.alias("type"))


@query("SELECT p_brand AS table_name, 'c' || p_partkey AS \"column\", CASE WHEN p_partkey % 10 = 8 THEN 'added' WHEN p_partkey % 10 = 9 THEN 'dropped' ELSE 'retyped' END AS change FROM part WHERE p_partkey % 10 IN (8, 9) OR p_size < 5")
def schema_drift(spark: SparkSession, sf: str) -> DataFrame:
    return g.drift(registry(spark, sf, 0), registry(spark, sf, 1))


@query("SELECT DISTINCT p_brand AS task FROM part WHERE p_partkey % 10 IN (8, 9) OR p_size < 5")
def rebound_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks whose set of view contracts has another digest in the next version."""
    contracts = lambda v: registry(spark, sf, v).select(F.col("table_name").alias("task"), F.col("column").alias("view"), F.col("type").alias("contract"))
    return g.rebound(contracts(0), contracts(1))


@query("SELECT n_name AS subject, 'no fields' AS problem FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT n_name || '.s' || s_suppkey, 'type' FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 9 = 0")
def catalog_consistency(spark: SparkSession, sf: str) -> DataFrame:
    n, s = load(spark, sf, "nation"), load(spark, sf, "supplier")
    fields = s.join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("n_name").alias("product"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("column"), F.when(F.col("s_suppkey") % 9 == 0, "timetz").otherwise("numeric(12,2)").alias("type"))
    return g.catalog_problems(n.select(F.col("n_name").alias("product")), fields, ["numeric", "text", "bigint"])


@query("""WITH e AS (SELECT user_id AS task, event_id AS seq, CASE event_type WHEN 'view' THEN 'approve' WHEN 'click' THEN 'complete' WHEN 'error' THEN 'reject' ELSE 'expire' END AS event FROM events),
  d AS (SELECT task, min(seq) AS at, arg_min(event, seq) AS event FROM e WHERE event IN ('approve', 'reject') GROUP BY task),
  c AS (SELECT e.task, arg_min(e.event, e.seq) AS event FROM e JOIN d ON e.task = d.task AND d.event = 'approve' WHERE e.seq > d.at AND e.event IN ('complete', 'expire') GROUP BY e.task)
  SELECT e.task, CASE WHEN c.event = 'complete' THEN 'completed' WHEN c.event = 'expire' THEN 'expired' WHEN d.event = 'approve' THEN 'active' WHEN d.event = 'reject' THEN 'rejected' ELSE 'pending' END AS state,
  count(*) - max(CAST(d.task IS NOT NULL AS INTEGER) + CAST(c.task IS NOT NULL AS INTEGER)) AS illegal FROM e LEFT JOIN d ON d.task = e.task LEFT JOIN c ON c.task = e.task GROUP BY ALL""")
def task_state_fold(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "approve").when(F.col("event_type") == "click", "complete").when(F.col("event_type") == "error", "reject").otherwise("expire")
    return g.task_states(load(spark, sf, "events").select(F.col("user_id").alias("task"), F.col("event_id").alias("seq"), kind.alias("event")))
