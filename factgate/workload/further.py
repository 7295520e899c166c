"""Paged groups and unions, identities of joined rows, indexed publications, view stacks, outcome charges, and free SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import wide
from ..functions.canonical import digest, sql_canonical, sql_composite, sql_digest
from ..operators import facts, footprint, governance, ledger, snapshots
from ..operators.digest import set_digest, sql_set_digest
from ..plans.build import delivered, joined, provenance, visible
from ..plans.plan import Aggregate, Filter, Join, Order, Plan, Rule
from ..sources import publications, views
from ..sources.products import PRODUCTS, entity_key, load
from ..streaming import novelty
from ..streaming.shared import durable, parts_of, shared_folder, spread
from . import query
from .exposure import UNION, query_log
from .relational import O
from .tables import CUSTOMER, ORDERS, cell, key, row

OK, CK = key("orders"), key("customer")
PAGED = Plan(O, ("orders.o_orderpriority",), group_by=("orders.o_orderpriority",), aggregates=(Aggregate("sum", "orders.o_totalprice", "total"), Aggregate("count", "*", "n")), order_by=(Order("total", True),), limit=2, offset=1)
DELIVERED = f"(SELECT *, {OK} AS ok FROM {ORDERS} WHERE o_orderpriority IN (SELECT o_orderpriority FROM {ORDERS} GROUP BY 1 ORDER BY sum(o_totalprice) DESC NULLS FIRST, o_orderpriority LIMIT 2 OFFSET 1))"
SEEN = " UNION ".join(f"SELECT {x} AS h FROM {DELIVERED}" for x in (row("orders", "ok"), cell("orders", "o_orderpriority", "ok"), cell("orders", "o_totalprice", "ok")))


@query(sql_set_digest(f"SELECT h, h AS t FROM ({SEEN})"))
def influence_group_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of groups depends on the members of the delivered groups only."""
    return set_digest(facts.influence(spark, sf, PAGED), "fact_hash")


G = "(" + sql_composite("'group-row'", f"({sql_canonical('o_orderpriority', 'string')})") + ")"
MEMBERS = f"(SELECT *, {G} AS g FROM {DELIVERED})"
WITNESS = f"SELECT g, 'orders.o_orderpriority' AS output, {cell('orders', 'o_orderpriority', 'ok')} AS h FROM {MEMBERS} UNION ALL SELECT g, 'total', {cell('orders', 'o_totalprice', 'ok')} FROM {MEMBERS} UNION ALL SELECT g, 'n', {row('orders', 'ok')} FROM {MEMBERS}"
COMMITS = sql_set_digest(f"SELECT g, output, h, h || ':' || count(*) AS t FROM ({WITNESS}) GROUP BY g, output, h", "g, output")
GROUPS = f"(SELECT g, o_orderpriority, CAST(sum(o_totalprice) AS DECIMAL(38,2)) AS total, count(*) AS n FROM {MEMBERS} GROUP BY g, o_orderpriority)"
CELLS = f"""SELECT g, 'orders.o_orderpriority' AS output, 'key:orders.o_orderpriority' AS e, 'string' AS ty, {sql_canonical('o_orderpriority', 'string')} AS v FROM {GROUPS}
 UNION ALL SELECT g, 'total', 'sum:orders.o_totalprice', 'decimal(38,2)', {sql_canonical('total', 'decimal(38,2)')} FROM {GROUPS}
 UNION ALL SELECT g, 'n', 'count:*', 'bigint', {sql_canonical('n', 'bigint')} FROM {GROUPS}"""
GROUP_FACT = sql_digest("'derived'", f"'{facts.bundle(PAGED)}'", "c.g", "e", "ty", "v", "digest")


@query(f"SELECT {GROUP_FACT} AS fact_hash FROM ({CELLS}) c JOIN ({COMMITS}) w ON c.g = w.g AND c.output = w.output")
def release_group_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of groups reveals the cells of the delivered groups only."""
    return facts.release(spark, sf, PAGED)


TUPLE = "(" + sql_composite("'tuple'", f"({sql_canonical('o_orderstatus', 'string')})", f"({sql_canonical('o_orderpriority', 'string')})") + ")"
CANDIDATES = f"(SELECT ok, u, o_orderstatus, o_orderpriority, count(*) AS m FROM (SELECT *, {OK} AS ok, {TUPLE} AS u FROM {ORDERS} WHERE o_orderstatus = 'F' UNION ALL SELECT *, {OK}, {TUPLE} FROM {ORDERS} WHERE o_orderpriority LIKE '1%') GROUP BY ALL)"
BEHIND = " UNION ALL ".join(f"SELECT u, {x} AS h, m FROM {CANDIDATES}" for x in (row("orders", "ok"), cell("orders", "o_orderstatus", "ok"), cell("orders", "o_orderpriority", "ok")))
TUPLE_COMMITS = sql_set_digest(f"SELECT u, h, h || ':' || max(m) AS t FROM ({BEHIND}) GROUP BY u, h", "u")
TUPLE_CELLS = " UNION ALL ".join(f"SELECT u, 'orders.{c}' AS field, {sql_canonical(c, 'string')} AS v, min({cell('orders', c, 'ok')}) AS lo, max({cell('orders', c, 'ok')}) AS hi FROM {CANDIDATES} GROUP BY u, {c}" for c in ("o_orderstatus", "o_orderpriority"))
UNION_FACT = sql_digest("'derived'", f"'{facts.bundle(UNION)}'", "c.u", "'union:' || field", "'string'", "v", "digest")


@query(f"SELECT DISTINCT CASE WHEN lo = hi THEN lo ELSE {UNION_FACT} END AS fact_hash FROM ({TUPLE_CELLS}) c JOIN ({TUPLE_COMMITS}) w ON c.u = w.u")
def union_release(spark: SparkSession, sf: str) -> DataFrame:
    """What a distinct union reveals: a base cell where one candidate stands behind a row, else a fact bound to all of them."""
    return facts.release(spark, sf, UNION)


ONCE = f"(SELECT {OK} AS ok, {sql_canonical('o_orderkey', 'bigint')} AS v, * FROM {ORDERS} WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%')"
ALTERNATIVES = " UNION ALL ".join(f"SELECT v AS u, ok, branch, {h} AS h FROM {ONCE}, (SELECT 1 AS branch)" for h in (row("orders", "ok"), cell("orders", "o_orderkey", "ok")))


@query(f"SELECT CAST(count(*) AS BIGINT) AS facts, CAST(max(n) AS BIGINT) AS most FROM (SELECT u, h, max(n) AS n FROM (SELECT u, ok, h, count(*) AS n FROM ({ALTERNATIVES}) GROUP BY u, ok, h) GROUP BY u, h)")
def union_identical_branches(spark: SparkSession, sf: str) -> DataFrame:
    """Two branches with the same terms in another order are one: no candidate counts twice."""
    f = (Filter("orders.o_orderstatus", "=", "F"), Filter("orders.o_orderpriority", "like", "1%"))
    plan = Plan(O, ("orders.o_orderkey",), union=(f, f[::-1]))
    return facts.union_witnesses(provenance(spark, sf, plan), plan).agg(F.count("*").alias("facts"), F.max("n").alias("most"))


PAIR = Plan({"orders": "orders", "customer": "customer"}, ("orders.o_orderkey", "customer.c_custkey"), (Join((("orders.o_custkey", "customer.c_custkey"),)),), (Filter("orders.o_orderstatus", "=", "P"),))
PAIRS = f"(SELECT *, {OK} AS ok, {CK} AS ck FROM {ORDERS} JOIN {CUSTOMER} ON o_custkey = c_custkey WHERE o_orderstatus = 'P')"
BOTH = (row("orders", "ok"), row("customer", "ck"))


@query(f"SELECT o_orderkey, sha256('64:' || least({BOTH[0]}, {BOTH[1]}) || '64:' || greatest({BOTH[0]}, {BOTH[1]})) AS identity FROM {PAIRS}")
def join_row_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Identity of joined rows, the same whichever side comes first."""
    return joined(spark, sf, PAIR).select(F.col("orders__o_orderkey").alias("o_orderkey"), facts.row_identity(PAIR).alias("identity"))


@query(f"SELECT o_orderkey, c_custkey, row_number() OVER (ORDER BY ck, ok) - 1 AS position FROM {PAIRS}")
def join_delivery_order(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of an unpaged join in the order of all entity keys."""
    return delivered(spark, sf, PAIR)


# -- the ledger -------------------------------------------------------------------------------------------------------


@query(f"SELECT {row('orders')} AS fact_hash, CAST(o_orderkey AS VARCHAR) AS lo, o_orderkey || '!' AS hi FROM {ORDERS} WHERE o_orderkey % 50 = 0")
def payload_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Stored facts of which some come back with another payload under the same hash: those are reported, repeats are not."""
    p = PRODUCTS["orders"]
    stored = load(spark, sf, "orders").select("o_orderkey", digest("row", p.namespace, p.snapshot, entity_key(p)).alias("fact_hash"), F.col("o_orderkey").cast("string").alias("payload"))
    again = stored.withColumn("payload", F.when(F.col("o_orderkey") % 50 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return facts.collisions(stored.unionByName(again))


def asked_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """(root, seq, kind, fact_hash): the literals and the whole question of each logged query, by root.

    The log is dealt by query before it is taken apart, so its facts are never shuffled by query, and no task has more of
    them than a bounded number of queries has.
    """
    log = query_log(spark, sf)
    parts = parts_of(log)
    log = spread(log, "query_id", parts=parts)
    atoms = footprint.log_atoms(log).select("query_id", F.lit("predicate-atom").alias("kind"), footprint.atom_hash("atom").alias("fact_hash"))
    whole = footprint.log_plan_keys(log).select("query_id", F.lit("composite-outcome").alias("kind"), digest("question", F.col("plan_key")).alias("fact_hash"))
    users = spread(load(spark, sf, "events").select(F.col("event_id").alias("query_id"), (F.col("user_id") % 10).alias("root")), "query_id", parts=parts)
    return atoms.unionByName(whole).join(users, "query_id").select("root", F.col("query_id").alias("seq"), "kind", "fact_hash")


ASKED = "(SELECT user_id % 10 AS root, event_id AS seq, event_type AS e, CAST(floor(round(value, 2)) AS BIGINT) % 7 AS x, CAST(floor(round(value, 2)) AS BIGINT) % 3 AS y FROM events)"
LITERALS = f"(SELECT root, seq, e AS a FROM {ASKED} UNION SELECT root, seq, 'b' || x FROM {ASKED} UNION SELECT root, seq, 'b' || y FROM {ASKED})"


@query(f"""SELECT root, seq, atoms, charged_atoms, CAST(seq = min(seq) OVER (PARTITION BY root, e, least(x, y), greatest(x, y)) AS BIGINT) AS charged_composite FROM {ASKED}
  JOIN (SELECT root, seq, count(*) AS atoms, count(*) FILTER (WHERE seq = first) AS charged_atoms FROM (SELECT *, min(seq) OVER (PARTITION BY root, a) AS first FROM {LITERALS}) GROUP BY root, seq) USING (root, seq)""")
def outcome_settlement(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes settled in two parts: each literal when it is first tested, each question when it is first asked."""
    return ledger.outcome_charges(asked_outcomes(spark, sf))


@query(f"SELECT root, seq, atoms - CAST(seq % 3 = 0 AS BIGINT) * 0 AS atoms, CASE WHEN seq % 5 = 0 THEN CAST(0 AS BIGINT) ELSE 2 END AS composites FROM (SELECT root, seq, count(*) AS atoms FROM {LITERALS} GROUP BY root, seq) WHERE seq % 5 = 0 OR seq % 7 = 0")
def outcome_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes that aren't their literals and one question: those without a question and those with two."""
    asked = asked_outcomes(spark, sf)
    extra = asked.where("kind = 'composite-outcome' and seq % 7 = 0 and seq % 5 <> 0").withColumn("fact_hash", F.sha2("fact_hash", 256))
    return facts.cardinality_problems(asked.where("kind <> 'composite-outcome' or seq % 5 <> 0").unionByName(extra))


@query("SELECT root, dim, count(*) AS links, count(*) FILTER (WHERE seq = first) AS new FROM (SELECT *, min(seq) OVER (PARTITION BY root, dim, f) AS first FROM (SELECT user_id % 10 AS root, event_id AS seq, 'influence' AS dim, CAST(user_id AS VARCHAR) AS f FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT user_id % 10, event_id, 'outcome', event_type FROM events WHERE event_id % 3 <> 0)) GROUP BY root, dim")
def query_fact_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links from accepted requests to the facts that they showed, and how many of these were new; a third of all were refused."""
    e = load(spark, sf, "events")
    shown = F.array(F.struct(F.lit("influence").alias("dim"), digest("user", F.col("user_id").cast("string")).alias("fact_hash")), F.struct(F.lit("outcome").alias("dim"), digest(F.col("event_type")).alias("fact_hash")))
    stream = e.select((F.col("user_id") % 10).alias("root"), F.col("event_id").alias("seq"), F.explode(shown).alias("f")).select("root", "seq", "f.*")
    settled = e.select((F.col("user_id") % 10).alias("root"), F.col("event_id").alias("seq"), (F.col("event_id") % 3 != 0).alias("accepted"))
    return ledger.linked(stream, settled).groupBy("root", "dim").agg(F.count("*").alias("links"), F.count_if("new").alias("new"))


# -- snapshots --------------------------------------------------------------------------------------------------------

HANDLES = f"(SELECT *, {CK} AS k, {row('customer')} AS h, row_number() OVER (ORDER BY {row('customer')}) - 1 AS handle FROM {CUSTOMER})"


@query(f"SELECT c_custkey, handle, k AS entity_key, c_mktsegment FROM {HANDLES} WHERE c_custkey % 10 = 3")
def publication_index(spark: SparkSession, sf: str) -> DataFrame:
    """A version written with hot, cold and sidecar parts: hashes found in the hot part, decoded with the cold one, named by the sidecar."""
    p, base = PRODUCTS["customer"], shared_folder(spark, "publication")
    customers = load(spark, sf, "customer")
    publications.publish_indexed(customers, p, base, "day0")
    hot, cold, sidecar = publications.indexed(spark, base, p, "day0")
    asked = customers.where("c_custkey % 10 = 3").select(digest("row", p.namespace, "day0", entity_key(p)).alias("fact_hash"))
    asked = asked.withColumn("prefix", F.substring("fact_hash", 1, 1))
    found = snapshots.decode(asked.join(hot, ["prefix", "fact_hash"]), cold)
    return found.join(sidecar, found["ordinal"] == sidecar["handle"]).select("c_custkey", "handle", "entity_key", "c_mktsegment")


@query(f"SELECT c_custkey, k AS entity_key, handle FROM {HANDLES} WHERE handle % 7 = 0 OR c_custkey % 7 = 0")
def handle_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Handles both ways: the keys of some handles and the handles of some keys."""
    p = PRODUCTS["customer"]
    keyed = load(spark, sf, "customer").select("c_custkey", entity_key(p).alias("entity_key")).withColumn("h", digest("row", p.namespace, p.snapshot, F.col("entity_key")))
    index = durable(snapshots.numbered(keyed.select("entity_key", "h"), ["h"], "handle").select("handle", "entity_key"))
    by_handle = index.where("handle % 7 = 0").select("handle").join(index, "handle").select("handle", "entity_key")
    by_key = keyed.where("c_custkey % 7 = 0").select("entity_key").join(index, "entity_key").select("handle", "entity_key")
    return by_handle.unionByName(by_key).distinct().join(keyed.select("c_custkey", "entity_key"), "entity_key").select("c_custkey", "entity_key", "handle")


@query("SELECT 1 + o_orderkey // 32768 AS bucket, count(*) AS n, max(o_orderkey % 32768) = 7 OR bool_or(o_orderkey = 7) AS changed FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey = 7 GROUP BY 1")
def bitmap_page_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of a set's pages, and whether their digests differ from those of the set without one order; made from other partitions they don't."""
    o = load(spark, sf, "orders").where("o_orderstatus <> 'P' or o_orderkey = 7")
    at = F.col("o_orderkey") + 1  # pages hold the numbers from 1 to 32768, and so on
    pages = lambda df: snapshots.portable(snapshots.bitmap(df.select(at.alias("ordinal"))))
    a, b = pages(o), pages(o.where("o_orderkey <> 7").repartition(5))
    return a.join(b.select("bucket", F.col("digest").alias("other")), "bucket", "left").select("bucket", "n", (~F.col("digest").eqNullSafe(F.col("other"))).alias("changed"))


@query("SELECT o_orderkey AS ordinal, o_orderstatus = 'F' AS held FROM orders WHERE o_orderkey % 4 = 1")
def bitmap_contains(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").withColumnRenamed("o_orderkey", "ordinal")
    return snapshots.contains(snapshots.bitmap(o.where("o_orderstatus = 'F'")), o.where("ordinal % 4 = 1"))


@query("SELECT (SELECT count(DISTINCT 1 + (o_orderkey - 1) // 32768) FROM orders WHERE o_orderkey % 1000 = 999) AS unequal, CAST(0 AS BIGINT) AS same")
def bitmap_equal(spark: SparkSession, sf: str) -> DataFrame:
    """Pages in which two sets differ: all orders against those without some, and against themselves from other partitions."""
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("ordinal"))
    whole = snapshots.bitmap(o)
    one = lambda df, n: snapshots.unequal_pages(whole, snapshots.bitmap(df)).agg(F.count("*").alias(n))
    return one(o.where("ordinal % 1000 <> 999"), "unequal").crossJoin(one(o.repartition(5), "same"))


@query(f"SELECT h AS fact_hash, string_agg(s, '+' ORDER BY s) AS segments, row_number() OVER (ORDER BY h) - 1 AS position FROM (SELECT 'all' AS s, {row('customer')} AS h FROM {CUSTOMER} UNION ALL SELECT 'debt', {row('customer')} FROM {CUSTOMER} WHERE c_acctbal < 0 UNION ALL SELECT 'nation', {row('nation')} FROM nation) GROUP BY h")
def merged_index(spark: SparkSession, sf: str) -> DataFrame:
    """Several indexes read as one in hash order: a hash that two of them have comes once."""

    def part(segment: str, product: str, where: str = "true") -> DataFrame:
        p = PRODUCTS[product]
        return load(spark, sf, product).where(where).select(F.lit(segment).alias("segment"), digest("row", p.namespace, p.snapshot, entity_key(p)).alias("fact_hash"))

    out = snapshots.merged_index(part("all", "customer"), part("debt", "customer", "c_acctbal < 0"), part("nation", "nation"))
    return out.select("fact_hash", F.array_join("segments", "+").alias("segments"), "position")


@query(f"SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS position FROM {ORDERS} QUALIFY row_number() OVER (ORDER BY o_totalprice, o_orderkey) <= 100")
def result_preview(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred rows of a stored result, though more are asked for."""
    base = shared_folder(spark, "result")
    publications.write_result(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), base, "r2", ["o_totalprice", "o_orderkey"])
    return publications.preview(spark, base, 500)


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN r = 1 THEN 'first' WHEN event_type = f THEN 'replays' ELSE 'conflicts' END AS status FROM (SELECT event_type, row_number() OVER w AS r, first_value(event_type) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id % 20, event_id % 50 ORDER BY event_id))) GROUP BY status")
def stream_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Request ids over several micro-batches: first results, replays, and the side output of conflicts."""
    base, e = shared_folder(spark, "conflicts"), load(spark, sf, "events")
    asked = e.select((F.col("user_id") % 20).alias("task"), (F.col("event_id") % 50).alias("request_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload"))
    most = asked.agg(F.max("seq")).first()[0] or 0
    for k in range(3):  # three files, written one after the other: as many batches, in order
        asked.where((F.col("seq") * 3 >= k * (most + 1)) & (F.col("seq") * 3 < (k + 1) * (most + 1))).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    novelty.once_or_conflict(stream, base, f"{base}/checkpoint").awaitTermination()
    parts = [spark.read.schema(asked.schema).parquet(f"{base}/{s}").agg(F.lit(s).alias("status"), F.count("*").alias("n")) for s in ("first", "replays", "conflicts")]
    return reduce(DataFrame.unionByName, parts).where("n > 0")


# -- scopes, views, free SQL ------------------------------------------------------------------------------------------

OPS = (("=", "F", "= 'F'"), ("<>", "F", "<> 'F'"), ("<", "O", "< 'O'"), ("<=", "O", "<= 'O'"), (">", "F", "> 'F'"), (">=", "O", ">= 'O'"), ("in", ("F", "P"), "IN ('F', 'P')"), ("not_in", ("F", "P"), "NOT IN ('F', 'P')"), ("is_null", None, "IS NULL"), ("is_not_null", None, "IS NOT NULL"))


@query(" UNION ALL ".join(f"SELECT '{op}' AS op, count(*) AS n FROM orders WHERE o_orderstatus {sql}" for op, _, sql in OPS))
def scope_operators(spark: SparkSession, sf: str) -> DataFrame:
    """Mandatory scopes by every operator."""
    plan = Plan(O, aggregates=(Aggregate("count", "*", "n"),))
    return reduce(DataFrame.unionByName, [visible(spark, sf, plan, {"status": Rule(op, v)}).select(F.lit(op).alias("op"), "n") for op, v, _ in OPS])


@query(f"SELECT c_custkey, upper(c_name) AS name, round(c_acctbal, 1) AS balance FROM {CUSTOMER} WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 40")
def scoped_view_capped(spark: SparkSession, sf: str) -> DataFrame:
    """Free SQL over a view that has the approved columns of one segment; its functions are checked, its rows capped."""
    views.scoped_view(spark, sf, "customer", ("c_custkey", "c_name", "c_acctbal"), {"segment": "BUILDING"}, "fg_building")
    return views.run_scoped(spark, "SELECT c_custkey, upper(c_name) AS name, round(c_acctbal, 1) AS balance FROM fg_building ORDER BY c_custkey", 40)


STACK = {
    v.name: v
    for v in (
        views.View("settled", "orders", ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), (Filter("o_orderstatus", "<>", "P"),)),
        views.View("large", "settled", ("o_custkey", "o_orderstatus", "o_totalprice"), (Filter("o_totalprice", ">", 50000),)),
        views.View("spent", "large", group_by=("o_custkey",), aggregates=(("sum", "o_totalprice", "total"), ("count", "*", "n"))),
    )
}


@query(f"SELECT o_custkey, CAST(sum(o_totalprice) AS DECIMAL(38,2)) AS total, count(*) AS n FROM {ORDERS} WHERE o_orderstatus <> 'P' AND o_totalprice > 50000 GROUP BY o_custkey")
def view_stack_compiled(spark: SparkSession, sf: str) -> DataFrame:
    """Three declared views on one another, expanded to their product; one of them aggregates."""
    return views.compiled(spark, sf, STACK, "spent").withColumn("total", F.col("total").cast("decimal(38,2)"))


@query(f"SELECT o_orderstatus AS k, max(o_totalprice) AS most FROM {ORDERS} WHERE o_orderstatus <> 'P' AND o_totalprice > 50000 AND o_totalprice < 200000 GROUP BY 1 UNION ALL SELECT 'picked', max(n) FROM (SELECT count(*) AS n FROM {ORDERS} WHERE o_orderstatus <> 'P' AND o_totalprice > 50000 GROUP BY o_custkey)")
def plan_over_view(spark: SparkSession, sf: str) -> DataFrame:
    """Questions asked of views: a transparent one is filtered and grouped, of an aggregated one a column is picked."""
    grouped = views.View("q", "", filters=(Filter("o_totalprice", "<", 200000),), group_by=("o_orderstatus",), aggregates=(("max", "o_totalprice", "most"),))
    a = views.query_view(spark, sf, STACK, "large", grouped).select(F.col("o_orderstatus").alias("k"), "most")
    b = views.query_view(spark, sf, STACK, "spent", views.View("q", "", ("n",))).agg(F.lit("picked").alias("k"), F.max("n").cast("decimal(18,2)").alias("most"))
    return a.unionByName(b)


@query("SELECT p_partkey AS view, unnest(CASE WHEN p_partkey % 10 = 8 THEN ['added'] WHEN p_partkey % 10 = 9 THEN ['dropped'] ELSE list_concat(CASE WHEN p_size % 2 = 0 THEN ['interface'] ELSE [] END, CASE WHEN p_size % 3 = 0 THEN ['definition'] ELSE [] END, CASE WHEN p_size % 5 = 0 THEN ['dependencies'] ELSE [] END) END) AS change FROM part")
def view_drift(spark: SparkSession, sf: str) -> DataFrame:
    """What changed of views between two registries; dependencies in another order are the same."""

    def registry(version: int) -> DataFrame:
        moved = lambda n, a, b: F.when((F.col("p_size") % n == 0) & F.lit(version == 1), b).otherwise(a)
        one, two = F.lit("orders"), F.lit("customer")
        deps = moved(5, F.array(one, two), F.array(one)) if version == 0 else moved(5, F.array(two, one), F.array(one))
        p = load(spark, sf, "part").where(f"p_partkey % 10 <> {8 + version}")
        return p.select(F.col("p_partkey").alias("view"), moved(2, F.lit("a"), F.lit("b")).alias("interface"), moved(3, F.lit("c"), F.lit("d")).alias("definition"), deps.alias("depends_on"))

    return governance.view_drift(registry(0), registry(1))


@query("SELECT c_custkey AS task, least(c_custkey % 500, greatest(c_custkey % 7 * 60 - 120, 0)) AS seconds FROM customer")
def delegated_lifetime(spark: SparkSession, sf: str) -> DataFrame:
    """A delegate lives no longer than its parent still does; parents end from two minutes ago to four from now."""
    c = load(spark, sf, "customer")
    asked = c.select(F.col("c_custkey").alias("task"), (F.col("c_custkey") % 7).alias("parent"), (F.col("c_custkey") % 500).alias("seconds"))
    parents = spark.range(7).select(F.col("id").alias("task"), F.timestamp_seconds(F.unix_timestamp(F.lit("2026-01-01").cast("timestamp")) + F.col("id") * 60 - 120).alias("expires"))
    return governance.delegated_lifetime(asked, parents, "2026-01-01")


@query("SELECT count(*) FILTER (WHERE a = b) AS equal, count(*) FILTER (WHERE a IS NOT DISTINCT FROM b) AS same, count(*) FILTER (WHERE (a = b) IS NULL) AS unknown FROM (SELECT nullif(o_orderstatus, 'O') AS a, nullif(o_orderstatus, 'P') AS b FROM orders UNION ALL SELECT nullif(o_orderstatus, 'O'), nullif(o_orderstatus, 'O') FROM orders)")
def typed_equality(spark: SparkSession, sf: str) -> DataFrame:
    """Equality, which null leaves unknown, and sameness, by which nulls are alike."""
    o, status = load(spark, sf, "orders"), F.col("o_orderstatus")
    a = o.select(F.nullif(status, F.lit("O")).alias("a"), F.nullif(status, F.lit("P")).alias("b")).unionByName(o.select(F.nullif(status, F.lit("O")).alias("a"), F.nullif(status, F.lit("O")).alias("b")))
    eq = wide.equal(F.col("a"), F.col("b"))
    return a.agg(F.count_if(eq).alias("equal"), F.count_if(wide.not_distinct(F.col("a"), F.col("b"))).alias("same"), F.count_if(eq.isNull()).alias("unknown"))


@query("SELECT r_name, n_name, c.n AS customers FROM region NATURAL JOIN (SELECT n_name, n_regionkey AS r_regionkey, n_nationkey AS k FROM nation) JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c USING (k) UNION ALL SELECT r_name, 'all', n FROM region CROSS JOIN (SELECT count(*) AS n FROM nation)")
def join_natural_using_cross(spark: SparkSession, sf: str) -> DataFrame:
    load(spark, sf, "region").createOrReplaceTempView("fg_region")
    load(spark, sf, "nation").createOrReplaceTempView("fg_nation")
    load(spark, sf, "customer").createOrReplaceTempView("fg_customer")
    return spark.sql("""SELECT r_name, n_name, c.n AS customers FROM fg_region NATURAL JOIN (SELECT n_name, n_regionkey AS r_regionkey, n_nationkey AS k FROM fg_nation) JOIN (SELECT c_nationkey AS k, count(*) AS n FROM fg_customer GROUP BY 1) c USING (k)
      UNION ALL SELECT r_name, 'all', n FROM fg_region CROSS JOIN (SELECT count(*) AS n FROM fg_nation)""")


@query("SELECT 'some null' AS list, count(*) AS n FROM customer WHERE c_mktsegment NOT IN (SELECT nullif(o_orderstatus, 'P') FROM orders) UNION ALL SELECT 'none', count(*) FROM customer WHERE c_mktsegment NOT IN (SELECT o_orderstatus FROM orders)")
def not_in_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """NOT IN over a subquery: a null in it leaves nothing, whatever else it has.

    A null-aware anti join sends the subquery to every task, so only its different values go, of which there are few.
    """
    load(spark, sf, "orders").createOrReplaceTempView("fg_orders")
    load(spark, sf, "customer").createOrReplaceTempView("fg_customer")
    return spark.sql("SELECT 'some null' AS list, count(*) AS n FROM fg_customer WHERE c_mktsegment NOT IN (SELECT DISTINCT nullif(o_orderstatus, 'P') FROM fg_orders) UNION ALL SELECT 'none', count(*) FROM fg_customer WHERE c_mktsegment NOT IN (SELECT DISTINCT o_orderstatus FROM fg_orders)")


@query("SELECT o_orderpriority AS p FROM orders WHERE o_orderstatus = 'P' INTERSECT ALL SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def setops_intersect_all(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    return o.where("o_orderstatus = 'P'").select(F.col("o_orderpriority").alias("p")).intersectAll(o.where("o_orderstatus = 'F'").select("o_orderpriority"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS near FROM orders")
def window_range_frame(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rangeBetween(-1000, 1000)
    return load(spark, sf, "orders").select("o_orderkey", F.count("*").over(w).alias("near"))


@query("SELECT p_partkey, round(p_size / 4.0, 1) AS r, p_size + p_partkey AS plus, p_size - p_partkey AS minus, p_size * p_partkey AS times, ltrim(p_type || ' ') AS l, rtrim('  ' || p_type || '  ') AS t, trim('  ' || p_type, ' ') AS b, CAST(length(p_brand) AS BIGINT) AS n, p_brand || ':' || p_size AS c FROM part")
def arithmetic_and_trims(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part")
    size, k, kind = F.col("p_size"), F.col("p_partkey"), F.col("p_type")
    return p.select("p_partkey", F.round(size / 4.0, 1).cast("double").alias("r"), (size + k).alias("plus"), (size - k).alias("minus"), (size * k).alias("times"), F.ltrim(F.concat(kind, F.lit(" "))).alias("l"), F.rtrim(F.concat(F.lit("  "), kind, F.lit("  "))).alias("t"), F.btrim(F.concat(F.lit("  "), kind)).alias("b"), F.char_length("p_brand").cast("bigint").alias("n"), F.concat("p_brand", F.lit(":"), size.cast("string")).alias("c"))


@query("SELECT o_orderkey, CAST(json_array_length(j, '$.tags') AS BIGINT) AS n, json_extract_string(j, '$.tags[1]') AS second, CAST(json_extract(j, '$.by.key') AS BIGINT) AS key, json_extract(j, '$.none') IS NULL AS none FROM (SELECT o_orderkey, '{\"tags\": [\"' || o_orderstatus || '\", \"' || o_orderpriority || '\"], \"by\": {\"key\": ' || o_custkey || '}}' AS j FROM orders)")
def json_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Arrays, paths and missing elements of JSON texts."""
    o = load(spark, sf, "orders")
    j = F.concat(F.lit('{"tags": ["'), "o_orderstatus", F.lit('", "'), "o_orderpriority", F.lit('"], "by": {"key": '), F.col("o_custkey").cast("string"), F.lit("}}"))
    at = F.col("j")
    tags = wide.json_path_text(at, "tags")
    return o.select("o_orderkey", j.alias("j")).select("o_orderkey", wide.json_array_length(tags).cast("bigint").alias("n"), wide.json_path_text(at, "tags", 1).alias("second"), wide.json_path(at, "by", "key").cast("bigint").alias("key"), wide.json_path(at, "none").isNull().alias("none"))


@query("SELECT o_orderkey, o_orderstatus = 'F' AS holds FROM orders")
def object_containment(spark: SparkSession, sf: str) -> DataFrame:
    """Containment of flat objects: each order's object has the entry asked for, or has another value there."""
    o = load(spark, sf, "orders")
    own = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    return o.select("o_orderkey", wide.map_contains(own, F.create_map(F.lit("status"), F.lit("F"))).alias("holds"))
