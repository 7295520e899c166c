"""Stored results and publications, first lineage algebra, rewrites, routing, view gaps and streaming settlement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import digest, sql_digest
from ..operators.digest import sql_set_digest
from ..operators import facts, footprint, governance, ledger, lineage, snapshots, stats
from ..plans.build import provenance, visible
from ..plans.plan import Filter, Join, Plan
from ..sources import publications
from ..sources.products import PRODUCTS, entity_key, load, read_json, schema_mismatches
from ..streaming import novelty
from ..streaming.shared import durable, shared_folder
from . import query
from .history import CAPPED, STREAM, requests, root_caps
from .relational import O, join2_plan
from .tables import ORDERS, cell, row


@query(f"SELECT o_orderkey, o_totalprice, p AS position FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM {ORDERS}) WHERE p >= 40 AND p < 65")
def stored_result_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of a result stored as Parquet with its positions."""
    base = shared_folder(spark, "result")
    publications.write_result(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), base, "r1", ["o_orderkey"])
    return publications.read_page(spark, base, 40, 25)


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def published_version(spark: SparkSession, sf: str) -> DataFrame:
    """A version written with its manifest last, and read back."""
    base = shared_folder(spark, "publication")
    publications.publish(load(spark, sf, "customer"), "c_custkey", base, "customer", "day0")
    return publications.published(spark, base, "customer", "day0").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS n, CAST(sum(o_totalprice) AS DECIMAL(38,2)) AS total, max(o_orderdate) AS last FROM {ORDERS}")
def json_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot that arrives as JSON lines, read with its declared types."""
    base = shared_folder(spark, "json")
    o = load(spark, sf, "orders")
    o.write.json(base)
    return read_json(spark, base, PRODUCTS["orders"]).agg(F.count("*").alias("n"), F.sum("o_totalprice").cast("decimal(38,2)").alias("total"), F.max("o_orderdate").alias("last"))


@query("SELECT CAST(500 AS BIGINT) AS shown, count(*) > 500 AS truncated FROM events")
def bounded_query(spark: SparkSession, sf: str) -> DataFrame:
    rows, more = publications.bounded(load(spark, sf, "events"), 500)
    return rows.agg(F.count("*").alias("shown"), F.lit(more).alias("truncated"))


@query("SELECT o_orderstatus, o_orderkey AS remaining_first FROM orders ORDER BY o_orderkey LIMIT 37")
def row_cap_from_budget(spark: SparkSession, sf: str) -> DataFrame:
    """At most as many rows as the budget has left: 100 less what the first 63 queries took, a row each."""
    left = 100 - load(spark, sf, "events").where("event_id < 63").count()
    return load(spark, sf, "orders").orderBy("o_orderkey").limit(left).select("o_orderstatus", F.col("o_orderkey").alias("remaining_first"))


@query("SELECT t.name, t.n FROM (VALUES " + ", ".join(f"('{p}', (SELECT count(*) FROM {PRODUCTS[p].table}))" for p in ("orders", "customer", "part")) + ") t(name, n)")
def schema_attested(spark: SparkSession, sf: str) -> DataFrame:
    """Tables whose columns can hold what their products declare, with their sizes; a mismatch would raise."""
    out = None
    for p in ("orders", "customer", "part"):
        df = spark.read.parquet(f"{sf}/{PRODUCTS[p].table}.parquet")
        if bad := schema_mismatches(df, PRODUCTS[p]):
            raise ValueError(f"{p}: {bad}")
        one = df.agg(F.lit(p).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


# -- first lineage algebra --------------------------------------------------------------------------------------------


def lineage_orders(spark: SparkSession, sf: str) -> DataFrame:
    p = PRODUCTS["orders"]
    cols = {c: p.columns[c] for c in ("o_orderkey", "o_custkey", "o_orderstatus")}
    return lineage.base(load(spark, sf, "orders"), p.name, p.snapshot, entity_key(p), cols)


def lineage_customers(spark: SparkSession, sf: str) -> DataFrame:
    p = PRODUCTS["customer"]
    return lineage.base(load(spark, sf, "customer"), p.name, p.snapshot, entity_key(p), {c: p.columns[c] for c in ("c_custkey", "c_mktsegment")})


@query("SELECT c_mktsegment, count(*) AS orders, count(*) * 3 + count(DISTINCT c_custkey) * 2 AS facts FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def lineage_join_group(spark: SparkSession, sf: str) -> DataFrame:
    both = lineage.join(lineage_orders(spark, sf), lineage_customers(spark, sf), "o_custkey", "c_custkey")
    out = lineage.aggregate(both, ["c_mktsegment"], [F.count("*").alias("orders")])
    return lineage.sized(*out, ["c_mktsegment"]).select("c_mktsegment", "orders", "facts")


@query("SELECT o_orderstatus, count(*) * 3 AS facts FROM orders WHERE o_orderstatus = 'F' OR o_orderkey % 2 = 0 GROUP BY o_orderstatus")
def lineage_union(spark: SparkSession, sf: str) -> DataFrame:
    o = lineage_orders(spark, sf)
    a, b = lineage.select(o, F.col("o_orderstatus") == "F"), lineage.select(o, F.col("o_orderkey") % 2 == 0)
    out = lineage.union(lineage.project(a, "o_orderstatus"), lineage.project(b, "o_orderstatus"))
    return lineage.sized(*out, ["o_orderstatus"]).select("o_orderstatus", "facts")


@query("SELECT count(*) * 3 AS facts FROM orders WHERE o_orderstatus = 'O'")
def lineage_observed(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.observed(lineage.select(lineage_orders(spark, sf), F.col("o_orderstatus") == "O")).agg(F.count("*").alias("facts"))


# -- rewrites, keys, replays ------------------------------------------------------------------------------------------


REWRITTEN = f"(SELECT * FROM {ORDERS} JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' AND c_mktsegment = 'BUILDING')"


@query(f"SELECT 'release' AS dim, count(DISTINCT o_orderkey) + count(DISTINCT c_custkey) AS n, CAST(0 AS BIGINT) AS different FROM {REWRITTEN} UNION ALL SELECT 'influence', count(DISTINCT o_orderkey) * 4 + count(DISTINCT c_custkey) * 4, 0 FROM {REWRITTEN} UNION ALL SELECT 'outcome', 3, 0")
def rewrite_invariance(spark: SparkSession, sf: str) -> DataFrame:
    """Two spellings of a join, its sources, terms and the equality turned around: facts by dimension, and those that only one has."""
    a = Plan({"orders": "orders", "customer": "customer"}, ("customer.c_name", "orders.o_totalprice"), (Join((("orders.o_custkey", "customer.c_custkey"),)),), (Filter("orders.o_orderstatus", "=", "P"), Filter("customer.c_mktsegment", "=", "BUILDING")))
    b = Plan({"customer": "customer", "orders": "orders"}, ("orders.o_totalprice", "customer.c_name"), (Join((("customer.c_custkey", "orders.o_custkey"),)),), tuple(reversed(a.filters)))
    x, y = facts.observation(spark, sf, a), facts.observation(spark, sf, b)
    both = x.withColumn("x", F.lit(1)).join(y.withColumn("y", F.lit(1)), ["dim", "fact_hash"], "full")
    return both.groupBy("dim").agg(F.count("x").alias("n"), F.count(F.when(F.col("x").isNull() | F.col("y").isNull(), 1)).alias("different"))


SCANS = tuple(sql_digest("'scan'", f"'{t}'") for t in ("orders", "lineitem"))
SCAN_PAIR = f"(least({SCANS[0]}, {SCANS[1]}) || ',' || greatest({SCANS[0]}, {SCANS[1]}))"
NODE_KEY = f"CASE o_orderkey % 4 WHEN 1 THEN {sql_digest(chr(39) + 'union' + chr(39), chr(39) * 2, SCAN_PAIR)} WHEN 2 THEN {sql_digest(chr(39) + 'filter' + chr(39), chr(39) * 2, SCANS[0])} WHEN 3 THEN {sql_digest(chr(39) + 'join' + chr(39), chr(39) + 'on' + chr(39), SCAN_PAIR)} ELSE {sql_digest(chr(39) + 'join' + chr(39), chr(39) * 2, SCAN_PAIR)} END"


@query(f"SELECT key, count(*) AS nodes FROM (SELECT {NODE_KEY} AS key FROM orders) GROUP BY key")
def algebra_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Nested algebra with a node for every order under order-free keys: joins of the same two scans are one, whichever comes first."""
    return node_keys(spark, load(spark, sf, "orders").select("o_orderkey")).groupBy("key").agg(F.count("*").alias("nodes"))


@query("SELECT o_orderkey % 4 AS kind, count(*) AS nodes, CAST(1 AS BIGINT) AS keys FROM orders GROUP BY 1")
def algebra_keys_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a node for every order."""
    return keys_by_kind(spark, load(spark, sf, "orders").select("o_orderkey"))


def node_keys(spark: SparkSession, o: DataFrame) -> DataFrame:
    scans = spark.createDataFrame([(-1, "scan", "orders", []), (-2, "scan", "lineitem", [])], "node long, kind string, text string, children array<long>")
    kind = F.element_at(F.array(F.lit("join"), F.lit("union"), F.lit("filter"), F.lit("join")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    pair = F.when(F.col("o_orderkey") % 8 < 4, F.array(F.lit(-1), F.lit(-2))).otherwise(F.array(F.lit(-2), F.lit(-1)))
    children = F.when(F.col("o_orderkey") % 4 == 2, F.array(F.lit(-1))).otherwise(pair).cast("array<long>")
    nodes = o.select(F.col("o_orderkey").alias("node"), kind.alias("kind"), F.when(F.col("o_orderkey") % 4 == 3, "on").otherwise("").alias("text"), children.alias("children"))
    return footprint.algebra_keys(scans.unionByName(nodes)).where("node >= 0")


def keys_by_kind(spark: SparkSession, o: DataFrame) -> DataFrame:
    return node_keys(spark, o).groupBy((F.col("node") % 4).alias("kind")).agg(F.count("*").alias("nodes"), F.count_distinct("key").alias("keys"))


SHOWN = f"SELECT {cell('orders', 'o_totalprice')} AS h FROM {ORDERS} WHERE o_orderstatus = 'P'"
SEEN = " UNION ALL ".join(f"SELECT {x} AS h FROM {ORDERS} WHERE o_orderstatus = 'P'" for x in (row("orders"), cell("orders", "o_orderstatus"), cell("orders", "o_totalprice")))


@query(f"SELECT 'release' AS dim, n, digest FROM ({sql_set_digest(f'SELECT h, h AS t FROM ({SHOWN})')}) UNION ALL SELECT 'influence', n, digest FROM ({sql_set_digest(f'SELECT h, h AS t FROM ({SEEN})')}) UNION ALL SELECT 'outcome', 2, NULL")
def observation_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Size and digest of each dimension of an observation; of the question, whose facts are made on the driver, the size."""
    o = facts.observation(spark, sf, Plan(O, ("orders.o_totalprice",), filters=(Filter("orders.o_orderstatus", "=", "P"),)))
    return facts.observation_digest(o).select("dim", "n", F.when(F.col("dim") != "outcome", F.col("digest")).alias("digest"))


@query("""SELECT seq, 'release' AS dim, CASE seq WHEN 0 THEN p WHEN 2 THEN f ELSE 0 END AS charged FROM (SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS p, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders) CROSS JOIN (VALUES (0), (1), (2), (3)) v(seq)
  UNION ALL SELECT seq, 'influence', CASE seq WHEN 0 THEN p * 3 WHEN 2 THEN f * 3 ELSE 0 END FROM (SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS p, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders) CROSS JOIN (VALUES (0), (1), (2), (3)) v(seq)
  UNION ALL SELECT seq, 'outcome', n FROM (VALUES (0, 2), (1, 0), (2, 2), (3, 1)) v(seq, n)""")
def replay_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """A sequence of questions and what each is charged by dimension: one status, the same under another alias, two statuses, the second alone."""
    plan = lambda f, **more: Plan(O, ("orders.o_totalprice",), filters=(f,), **more)
    status = lambda op, v: Filter("orders.o_orderstatus", op, v)
    asked = [plan(status("=", "P")), plan(status("=", "P"), aliases={"orders.o_totalprice": "price"}), plan(status("in", ("P", "F"))), plan(status("=", "F"))]
    stream = [facts.observation(spark, sf, p).select(F.lit("root").alias("root"), F.lit(k).alias("seq"), "dim", "fact_hash") for k, p in enumerate(asked)]
    return ledger.charges(reduce(DataFrame.unionByName, stream)).select("seq", "dim", "charged")


@query("SELECT page, dim, CASE WHEN page = 0 THEN n * facts ELSE CAST(0 AS BIGINT) END AS charged FROM (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P') CROSS JOIN (VALUES ('release', 1), ('influence', 4)) d(dim, facts) CROSS JOIN (VALUES (0), (1)) v(page)")
def replay_charges(spark: SparkSession, sf: str) -> DataFrame:
    """The same question asked twice: what is charged in each dimension, an order's row and its three cells as influence."""
    plan = lambda f: Plan(O, ("orders.o_totalprice",), filters=f)
    f = (Filter("orders.o_orderstatus", "=", "P"), Filter("orders.o_orderkey", ">=", 0))
    ask = lambda k, g: facts.observation(spark, sf, plan(g)).where("dim <> 'outcome'").select(F.lit("root").alias("root"), F.lit(k).alias("seq"), "dim", "fact_hash")
    both = ledger.charges(ask(0, f).unionByName(ask(1, f[::-1])))
    return both.groupBy(F.col("seq").alias("page"), "dim").agg(F.sum("charged").alias("charged"))


@query(f"SELECT root, count(*) AS novel FROM (SELECT DISTINCT root, f FROM {STREAM} WHERE dim = 'release' AND seq % 3 = 0 EXCEPT SELECT root, f FROM {STREAM} WHERE dim = 'release' AND seq % 3 <> 0) GROUP BY root")
def touched_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """Novelty against a ledger stored by hash prefix, of which only the prefixes asked for are read."""
    base = shared_folder(spark, "ledger")
    s = requests(spark, sf).where("dim = 'release'").select("root", F.sha2(F.concat_ws(":", "root", "fact_hash"), 256).alias("fact_hash"), "seq")
    s.where("seq % 3 <> 0").select("fact_hash").distinct().withColumn("prefix", F.substring("fact_hash", 1, 2)).write.partitionBy("prefix").parquet(base)
    known = spark.read.schema("fact_hash string, prefix string").parquet(base)
    return ledger.touched_difference(s.where("seq % 3 = 0").select("root", "fact_hash").distinct(), known).groupBy("root").agg(F.count("*").alias("novel"))


@query("SELECT user_id % 20 AS task, CASE WHEN user_id % 20 % 5 = 0 THEN 'expired' WHEN count(*) > 400 OR sum(event_id % 97) > 20000 THEN 'exhausted' ELSE 'active' END AS state FROM events GROUP BY 1, user_id % 20 % 5")
def task_states(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    log = e.select((F.col("user_id") % 20).alias("task"), F.col("event_id").alias("seq"), F.lit("completed").alias("status"), F.lit(0).alias("reserved_rows"), (F.col("event_id") % 97).alias("rows"), F.lit(0).alias("ms"))
    budget = spark.range(20).select(F.col("id").alias("task"), F.lit(400).alias("max_queries"), F.lit(20000).alias("max_rows"), F.lit(1).alias("max_ms"))
    tasks = e.select((F.col("user_id") % 20).alias("task")).distinct().withColumn("expires", F.when(F.col("task") % 5 == 0, F.lit("2020-01-01")).otherwise(F.lit("2040-01-01")).cast("timestamp"))
    return ledger.task_states(ledger.spend(log, budget), tasks, "2026-01-01")


@query("SELECT event_id AS result_id FROM events WHERE event_id % 4 = 0 AND event_id % 8 <> 0")
def unusable_cache(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select(F.col("event_id").alias("result_id"))
    return ledger.unusable(e.where("result_id % 4 = 0"), e.where("result_id % 8 = 0"))


@query("SELECT c_custkey AS request, CASE WHEN c_custkey % 2 = 1 THEN 'day1' ELSE 'day0' END AS snapshot, CASE WHEN c_custkey % 2 = 1 THEN (SELECT count(*) FROM part WHERE p_partkey % 100 <> 98) ELSE (SELECT count(*) FROM part WHERE p_partkey % 100 <> 99) END AS rows FROM customer")
def snapshot_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Requests stay on the version they were approved for; 'latest' was resolved when they were made."""
    part = load(spark, sf, "part")
    manifest = part.where("p_partkey % 100 <> 99").agg(F.lit("day0").alias("snapshot"), F.count("*").alias("rows")).unionByName(part.where("p_partkey % 100 <> 98").agg(F.lit("day1").alias("snapshot"), F.count("*").alias("rows")))
    asked = load(spark, sf, "customer").select(F.col("c_custkey").alias("request"), F.when(F.col("c_custkey") % 2 == 1, "latest").otherwise("day0").alias("wanted"))
    latest = manifest.agg(F.max("snapshot").alias("newest"))
    pinned = asked.crossJoin(F.broadcast(latest)).select("request", F.when(F.col("wanted") == "latest", F.col("newest")).otherwise(F.col("wanted")).alias("snapshot"))
    return pinned.join(manifest, "snapshot").select("request", "snapshot", "rows")


# -- governance -------------------------------------------------------------------------------------------------------


REACH = "WITH RECURSIVE up AS (SELECT c_custkey AS view, c_custkey // 2 AS base FROM customer WHERE c_custkey > 1 UNION ALL SELECT view, base // 2 FROM up WHERE base > 1)"


@query(f"{REACH} SELECT view, base, 'scope segment' AS reason FROM up WHERE view % 3 <> 0 AND base % 16 = 1 UNION ALL SELECT view, base, 'sensitivity' FROM up WHERE base % 4 > view % 4")
def view_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Views, one for each customer on that of half its number, over those at any depth whose scope they lack or that are more sensitive."""
    c = load(spark, sf, "customer").where("c_custkey > 1").select(F.col("c_custkey").alias("view"), F.floor(F.col("c_custkey") / 2).alias("depends_on"))
    every = c.select(F.col("view").alias("name")).unionByName(c.select(F.col("depends_on").alias("name"))).distinct()
    level = F.element_at(F.array(*[F.lit(x) for x in governance.LEVELS]), (F.col("name") % 4 + 1).cast("int"))
    required = every.where("name % 16 = 1").select(F.col("name").alias("base"), F.lit("segment").alias("name"))
    return governance.view_gaps(c, c.where("view % 3 = 0").select("view", F.lit("segment").alias("name")), required, every.withColumn("level", level))


@query("SELECT c_custkey AS view, -1 - c_custkey // 2 AS base, 'scope segment' AS reason FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey // 2 % 2 = 1 UNION ALL SELECT c_custkey, -1 - c_custkey // 2, 'sensitivity' FROM customer WHERE c_custkey // 2 % 4 > c_custkey % 4")
def view_gaps_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a view for every customer, over base tables that two views share."""
    half = F.floor(F.col("c_custkey") / 2)
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("view"), (-1 - half).alias("depends_on"))
    bases = c.select(F.col("depends_on").alias("base")).distinct()
    names = c.select(F.col("view").alias("name"), (F.col("view") % 4).alias("k")).unionByName(bases.select(F.col("base").alias("name"), ((-1 - F.col("base")) % 4).alias("k")))
    level = F.element_at(F.array(*[F.lit(x) for x in governance.LEVELS]), (F.col("k") + 1).cast("int"))
    return governance.view_gaps(c, c.where("view % 3 = 0").select("view", F.lit("segment").alias("name")), bases.where("(-1 - base) % 2 = 1").withColumn("name", F.lit("segment")), names.select("name", level.alias("level")))


@query("SELECT c_custkey AS request, CASE WHEN c_custkey % 4 < 2 THEN 'auto' WHEN c_custkey % 4 = 2 THEN 'owner' ELSE 'refused' END AS route, CASE c_custkey % 4 WHEN 0 THEN CAST(1000 AS INTEGER) WHEN 1 THEN 500 WHEN 2 THEN 100 END AS max_rows FROM customer")
def task_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Products to sensitivity, to approval route, to budget."""
    r = load(spark, sf, "customer").select(F.col("c_custkey").alias("request"), F.array(F.concat(F.lit("p"), (F.col("c_custkey") % 4).cast("string"))).alias("products"))
    products = spark.createDataFrame([(f"p{k}", x) for k, x in enumerate(governance.LEVELS)], "product string, sensitivity string")
    routes = spark.createDataFrame([], "products array<string>, route string")
    defaults = spark.createDataFrame([("public", "auto"), ("internal", "auto"), ("confidential", "owner")], "sensitivity string, route string")
    budgets = spark.createDataFrame([("public", 1000), ("internal", 500), ("confidential", 100)], "sensitivity string, max_rows int")
    return governance.task_policy(r, products, routes, defaults, budgets).select("request", "route", "max_rows")


TYPE_COLUMN = sql_digest("p_type", "'text'")


@query(sql_set_digest(f"SELECT DISTINCT p_brand AS table_name, {TYPE_COLUMN} AS h, {TYPE_COLUMN} AS t FROM part", "table_name"))
def schema_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Size and digest of each table of a registry, whatever the order of its columns."""
    f = load(spark, sf, "part").select(F.col("p_brand").alias("table_name"), F.col("p_type").alias("column"), F.lit("text").alias("type"))
    return governance.schema_digest(f)


# -- streams and results ----------------------------------------------------------------------------------------------


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a file stream, read where it stands."""
    return spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def settle_next(asked: DataFrame, caps: DataFrame, base: str) -> None:
    """Writes requests to the stream's input and settles them as its next micro-batch."""
    spark = asked.sparkSession
    asked.write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(asked.schema).parquet(f"{base}/in")
    novelty.settle_batches(stream, caps, base, f"{base}/checkpoint").awaitTermination()


@query(f"{CAPPED} SELECT root, count(*) FILTER (WHERE accepted) AS accepted, CAST(sum(charged_release) AS BIGINT) AS charged_release, CAST(sum(charged_influence) AS BIGINT) AS charged_influence, CAST(sum(charged_outcome) AS BIGINT) AS charged_outcome FROM settled GROUP BY root")
def stream_settlement(spark: SparkSession, sf: str) -> DataFrame:
    """A request stream settled over several micro-batches, each with the ledger of those before, under caps that refuse requests."""
    base = shared_folder(spark, "settlement")
    asked = requests(spark, sf)
    most = asked.agg(F.max("seq")).first()[0] or 0
    for k in range(3):  # what is there when the stream starts is a batch, of as many files as its rows are dealt to
        third = asked.where((F.col("seq") * 3 >= k * (most + 1)) & (F.col("seq") * 3 < (k + 1) * (most + 1)))
        settle_next(third, root_caps(spark), base)
    done = spark.read.parquet(f"{base}/settled")
    return done.groupBy("root").agg(F.count_if("accepted").alias("accepted"), *[F.sum(f"charged_{d}").alias(f"charged_{d}") for d in ledger.DIMS])


@query("SELECT count(*) AS requests FROM (SELECT DISTINCT user_id % 20, event_id % 50 FROM events)")
def stream_exactly_once(spark: SparkSession, sf: str) -> DataFrame:
    novelty.off_heap(spark)
    base = shared_folder(spark, "once")
    asked = event_stream(spark, sf).select((F.col("user_id") % 20).alias("task"), (F.col("event_id") % 50).alias("request_id"))
    q = novelty.once(asked).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("task long, request_id long").parquet(f"{base}/out").agg(F.count("*").alias("requests"))


@query("SELECT p - 1 AS position FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS p FROM orders) WHERE o_orderkey % 500 = 0")
def result_equality_ordered(spark: SparkSession, sf: str) -> DataFrame:
    """Positions at which two ordered results differ."""
    rows = durable(snapshots.numbered(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], "position"))
    changed = rows.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 500 == 0, F.lit(0)).otherwise(F.col("o_totalprice")).cast("decimal(18,2)"))
    return stats.equal_ordered(rows, changed, "position")


@query(f"SELECT count(*) AS groups FROM (SELECT o_orderstatus FROM {ORDERS} WHERE o_orderdate < DATE '1996-01-01' GROUP BY 1)")
def visible_and_proofs(spark: SparkSession, sf: str) -> DataFrame:
    """The visible result and its proofs over one pinned version have the same groups."""
    shown = visible(spark, sf, join2_plan()).select("o_orderstatus")
    proven = provenance(spark, sf, join2_plan()).select(F.col("orders__o_orderstatus").alias("o_orderstatus")).distinct()
    return shown.join(proven, "o_orderstatus", "left_semi").agg(F.count("*").alias("groups"))


@query("SELECT o_orderstatus AS s, count(*) AS n FROM orders WHERE o_orderkey % 10 = 0 GROUP BY 1")
def hot_cold_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Ordinals of some rows, found by hash in the hot part and decoded with the cold one."""
    p = PRODUCTS["orders"]
    rows = load(spark, sf, "orders").select(digest("row", p.namespace, p.snapshot, entity_key(p)).alias("fact_hash"), "o_orderkey", "o_orderstatus")
    hot, cold = snapshots.hot_and_cold(snapshots.numbered(rows, ["fact_hash"]))
    wanted = rows.where("o_orderkey % 10 = 0").select("fact_hash").join(hot, "fact_hash")
    return snapshots.decode(wanted, cold).groupBy(F.col("o_orderstatus").alias("s")).agg(F.count("*").alias("n"))


@query("SELECT p_brand AS name, count(*) FILTER (WHERE p_size % 7 <> 0 AND p_size % 5 <> 0) AS pinned, count(*) AS asked FROM part GROUP BY p_brand")
def publication_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Requests pinned to publications by name, snapshot and content; some are gone, some have changed."""
    p = load(spark, sf, "part")
    at = F.col("p_partkey").cast("string")
    asked = p.select(F.col("p_partkey").alias("request"), F.col("p_brand").alias("name"), at.alias("snapshot"), F.sha2(at, 256).alias("content_digest"))
    known = p.where("p_size % 7 <> 0").select(F.col("p_brand").alias("name"), at.alias("snapshot"), F.when(F.col("p_size") % 5 == 0, "changed").otherwise(F.sha2(at, 256)).alias("content_digest"))
    return snapshots.resolve(asked, known).groupBy("name").agg(F.count_if("ok").alias("pinned"), F.count("*").alias("asked"))


PUBLICATION = sql_digest("p_brand", "CAST(p_partkey AS VARCHAR)", "p_type")


@query(sql_set_digest(f"SELECT DISTINCT {PUBLICATION} AS h, {PUBLICATION} AS t FROM part"))
def manifest_digests(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").cast("string").alias("snapshot"), F.col("p_type").alias("content_digest"))
    return snapshots.manifest_digest(p)


@query(f"SELECT o_orderkey, [o_orderstatus, o_orderpriority][2] AS second, (o_orderstatus, o_orderkey) < ('F', 100) AS before, CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(18,2)) AS again FROM {ORDERS}")
def row_and_array_expressions(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    return o.select("o_orderkey", F.array("o_orderstatus", "o_orderpriority")[1].alias("second"), (F.struct("o_orderstatus", "o_orderkey") < F.struct(F.lit("F").alias("o_orderstatus"), F.lit(100).cast("bigint").alias("o_orderkey"))).alias("before"), F.col("o_totalprice").cast("string").cast("decimal(18,2)").alias("again"))


@query("SELECT user_id % 10 AS root, CASE WHEN seq = first THEN 'novel' ELSE 'hit' END AS path, count(*) AS n, round(quantile_cont(CAST(value AS DOUBLE), 0.5), 6) AS p50 FROM (SELECT user_id, event_id AS seq, value, min(event_id) OVER (PARTITION BY user_id % 10, event_type, user_id) AS first FROM (SELECT event_id, user_id, event_type, CAST(round(value, 2) AS DECIMAL(18,2)) AS value FROM events)) GROUP BY ALL")
def latency_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Latency samples by path: the first request of a kind is novel, later ones hit the history."""
    e = load(spark, sf, "events").withColumn("root", F.col("user_id") % 10)
    first = e.groupBy("root", "event_type", "user_id").agg(F.min("event_id").alias("event_id")).select("event_id", F.lit("novel").alias("path"))
    labelled = e.join(first, "event_id", "left").select("root", F.coalesce("path", F.lit("hit")).alias("path"), F.col("value").cast("double").alias("value"))
    return stats.quantiles(labelled, ["root", "path"], "value", [0.5]).select("root", "path", "n", F.round("p50", 6).alias("p50"))
