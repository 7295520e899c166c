"""What queries expose: facts, witnesses, influence, release, outcomes, and logs of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import cell_fact, row_fact, sql_canonical, sql_composite, sql_digest
from ..operators import facts, footprint
from ..operators.digest import set_digest, sql_set_digest
from ..operators.snapshots import snapshot_facts
from ..plans.build import provenance, visible
from ..plans.plan import Aggregate, Filter, Order, Plan
from ..sources.products import PRODUCTS, entity_key, load
from . import query
from .relational import O, join2_plan
from .tables import LINES, ORDERS, cell, key, row

OK, LK = key("orders"), key("lineitem")


@query(f"SELECT 'base-row' AS kind, {row('orders')} AS fact_hash FROM {ORDERS}")
def fact_base_rows(spark: SparkSession, sf: str) -> DataFrame:
    p = PRODUCTS["orders"]
    return load(spark, sf, "orders").select(F.lit("base-row").alias("kind"), row_fact(p.namespace, p.snapshot, entity_key(p)).alias("fact_hash"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, {cell('orders', c)} AS fact_hash FROM {ORDERS}" for c in PRODUCTS["orders"].columns))
def fact_base_cells(spark: SparkSession, sf: str) -> DataFrame:
    p = PRODUCTS["orders"]
    return snapshot_facts(load(spark, sf, "orders"), p.namespace, p.snapshot, entity_key(p), p.columns).where("kind = 'base-cell'").select("field", "fact_hash")


JOINED = f"(SELECT *, {OK} AS ok, {LK} AS lk FROM {ORDERS} JOIN {LINES} ON o_orderkey = l_orderkey WHERE o_orderdate < DATE '1996-01-01')"
INFLUENCE = " UNION ".join([f"SELECT {row('orders', 'ok')} AS fact_hash FROM {JOINED}", *[f"SELECT {cell('orders', c, 'ok')} FROM {JOINED}" for c in ("o_orderkey", "o_orderdate", "o_orderstatus")], f"SELECT {row('lineitem', 'lk')} FROM {JOINED}", *[f"SELECT {cell('lineitem', c, 'lk')} FROM {JOINED}" for c in ("l_orderkey", "l_extendedprice")]])


@query(sql_set_digest(f"SELECT fact_hash AS h, fact_hash AS t FROM ({INFLUENCE})"))
def influence_join_group(spark: SparkSession, sf: str) -> DataFrame:
    """Number and digest of the facts that orders with their lines, grouped, depend on."""
    return set_digest(facts.influence(spark, sf, join2_plan()), "fact_hash")


GROUP = "(" + sql_composite("'group-row'", f"({sql_canonical('o_orderstatus', 'string')})") + ")"
MEMBERS = f"(SELECT *, {GROUP} AS g FROM {JOINED})"
WITNESS = " UNION ALL ".join(
    [f"SELECT g, 'orders.o_orderstatus' AS output, {cell('orders', 'o_orderstatus', 'ok')} AS h FROM {MEMBERS}", f"SELECT g, 'total', {cell('lineitem', 'l_extendedprice', 'lk')} FROM {MEMBERS}"]
    + [f"SELECT g, 'n', {x} FROM {MEMBERS}" for x in (row("orders", "ok"), cell("orders", "o_orderdate", "ok"), cell("orders", "o_orderkey", "ok"), row("lineitem", "lk"), cell("lineitem", "l_orderkey", "lk"))]
)
COMMITS = sql_set_digest(f"SELECT g, output, h, h || ':' || count(*) AS t FROM ({WITNESS}) GROUP BY g, output, h", "g, output")
SHOWN = f"(SELECT {GROUP} AS g, o_orderstatus, CAST(sum(l_extendedprice) AS DECIMAL(38,2)) AS total, count(*) AS n FROM {JOINED} GROUP BY o_orderstatus)"
CELLS = f"""SELECT g, 'orders.o_orderstatus' AS output, 'key:orders.o_orderstatus' AS e, 'string' AS ty, {sql_canonical('o_orderstatus', 'string')} AS v FROM {SHOWN}
 UNION ALL SELECT g, 'total', 'sum:lineitem.l_extendedprice', 'decimal(38,2)', {sql_canonical('total', 'decimal(38,2)')} FROM {SHOWN}
 UNION ALL SELECT g, 'n', 'count:*', 'bigint', {sql_canonical('n', 'bigint')} FROM {SHOWN}"""


DERIVED = sql_digest("'derived'", f"'{facts.bundle(join2_plan())}'", "c.g", "e", "ty", "v", "digest")


@query(f"SELECT c.g AS group_key, c.output, {DERIVED} AS fact_hash FROM ({CELLS}) c JOIN ({COMMITS}) w ON c.g = w.g AND c.output = w.output")
def fact_derived_group(spark: SparkSession, sf: str) -> DataFrame:
    """The facts that the cells of a grouped join reveal, each bound to the commitment over its witness."""
    return facts.derived(spark, sf, join2_plan())


@query(f"SELECT output, count(*) AS facts, CAST(sum(m) AS BIGINT) AS witnesses, max(m) AS most FROM (SELECT g, output, h, count(*) AS m FROM ({WITNESS}) GROUP BY g, output, h) GROUP BY output")
def witness_multiplicity(spark: SparkSession, sf: str) -> DataFrame:
    w = facts.witnesses(provenance(spark, sf, join2_plan()), join2_plan())
    return w.groupBy("output").agg(F.count("*").alias("facts"), F.sum("n").alias("witnesses"), F.max("n").alias("most"))


UNION = Plan(O, ("orders.o_orderstatus", "orders.o_orderpriority"), union=((Filter("orders.o_orderstatus", "=", "F"),), (Filter("orders.o_orderpriority", "like", "1%"),)))


@query("SELECT o_orderstatus || '|' || o_orderpriority AS pair, count(DISTINCT o_orderkey) * 3 AS facts, CAST(max(m) AS BIGINT) AS most FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority, count(*) AS m FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT * FROM orders WHERE o_orderpriority LIKE '1%') GROUP BY ALL) GROUP BY pair")
def witness_max_union(spark: SparkSession, sf: str) -> DataFrame:
    """Facts behind each distinct row of a union: each candidate has its row and both cells, as often as it was a candidate."""
    w = facts.union_witnesses(provenance(spark, sf, UNION), UNION)
    pair = F.regexp_replace("tuple", r"^5:tuple\d+:s:(.+?)\d+:s:(.+)$", "$1|$2")
    return w.groupBy(pair.alias("pair")).agg(F.count("*").alias("facts"), F.max("n").alias("most"))


@query(f"SELECT {cell('orders', 'o_totalprice')} AS fact_hash FROM {ORDERS} WHERE o_orderstatus = 'P'")
def release_projection(spark: SparkSession, sf: str) -> DataFrame:
    return facts.release(spark, sf, Plan(O, ("orders.o_totalprice",), filters=(Filter("orders.o_orderstatus", "=", "P"),)))


@query("SELECT count(*) * 3 AS n FROM orders WHERE o_orderstatus = 'P'")
def influence_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, shown cells and filtered cells of a plain selection."""
    return facts.influence(spark, sf, Plan(O, ("orders.o_totalprice",), filters=(Filter("orders.o_orderstatus", "=", "P"),))).agg(F.count("*").alias("n"))


def paged(offset: int, limit: int) -> Plan:
    return Plan(O, ("orders.o_totalprice", "orders.o_orderkey"), order_by=(Order("orders.o_totalprice", True),), limit=limit, offset=offset)


@query("SELECT least(160, count(*)) * 3 AS n FROM orders")
def page_overlap_union(spark: SparkSession, sf: str) -> DataFrame:
    """Two overlapping pages together depend on just what one page over both does."""
    a, b = facts.influence(spark, sf, paged(0, 100)), facts.influence(spark, sf, paged(60, 100))
    return facts.merged(a, b).agg(F.count("*").alias("n"))


@query("SELECT 'release' AS dim, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') UNION ALL SELECT 'influence', count(*) * 3 FROM orders WHERE o_orderstatus IN ('F', 'P') UNION ALL SELECT 'outcome', 4")
def observation_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Two halves of a question observed together: facts add up, each half asks for itself."""
    one = lambda s: facts.observation(spark, sf, Plan(O, ("orders.o_totalprice",), filters=(Filter("orders.o_orderstatus", "=", s),)))
    return facts.merged(one("F"), one("P")).groupBy("dim").agg(F.count("*").alias("n"))


@query(sql_set_digest(f"SELECT {row('orders')} AS h, {row('orders')} AS t FROM {ORDERS}"))
def set_digest_rows(spark: SparkSession, sf: str) -> DataFrame:
    return set_digest(fact_base_rows(spark, sf), "fact_hash")


@query(sql_set_digest(f"SELECT o_orderstatus, {row('orders')} AS h, h AS t FROM {ORDERS}", "o_orderstatus"))
def set_digest_by_group(spark: SparkSession, sf: str) -> DataFrame:
    p = PRODUCTS["orders"]
    rows = load(spark, sf, "orders").select("o_orderstatus", row_fact(p.namespace, p.snapshot, entity_key(p)).alias("h"))
    return set_digest(rows, "h", ["o_orderstatus"])


RELEASED = sql_set_digest(f"SELECT o_orderstatus, {cell('orders', 'o_orderkey')} AS h, h AS t FROM {ORDERS}", "o_orderstatus")
OUTCOME = sql_digest("'outcome'", "'plan'", "digest", "CAST(n AS VARCHAR)")


@query(f"SELECT o_orderstatus, {OUTCOME} AS fact_hash FROM ({RELEASED})")
def outcome_fact(spark: SparkSession, sf: str) -> DataFrame:
    """One outcome per status: what was asked, the set that was released, how many rows came."""
    p = PRODUCTS["orders"]
    cells = load(spark, sf, "orders").select("o_orderstatus", cell_fact(p.namespace, p.snapshot, entity_key(p), "o_orderkey", "bigint", F.col("o_orderkey")).alias("h"))
    return set_digest(cells, "h", ["o_orderstatus"]).select("o_orderstatus", footprint.outcome_fact(F.lit("plan"), F.col("digest"), F.col("n")).alias("fact_hash"))


@query("SELECT CAST(3 AS BIGINT) AS release_facts, count(*) AS rows_shown FROM (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'none such')")
def release_group_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A global aggregate releases one derived fact per shown value, on no rows at all too."""
    plan = Plan(O, filters=(Filter("orders.o_orderstatus", "=", "none such"),), aggregates=(Aggregate("count", "*", "n"), Aggregate("sum", "orders.o_totalprice", "total"), Aggregate("max", "orders.o_orderdate", "last")))
    return facts.release(spark, sf, plan).agg(F.count("*").alias("release_facts"), F.lit(1).cast("bigint").alias("rows_shown"))


def query_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log of queries made from events: what each asks follows from its user, type and value."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    lit = F.floor("value").cast("bigint")
    member = F.array(F.concat(F.lit(""), (lit % 7).cast("string")), F.concat(F.lit(""), (lit % 3).cast("string")), F.concat(F.lit(""), (lit % 7).cast("string")))
    eq = F.struct(F.lit("event_type").alias("col"), F.lit("=").alias("op"), F.array(F.col("event_type")).alias("values"))
    isin = F.struct(F.lit("bucket").alias("col"), F.lit("in").alias("op"), member.alias("values"))
    both = F.when(F.col("event_id") % 2 == 0, F.array(eq, isin)).otherwise(F.array(isin, eq))
    columns = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("a")))
    return e.select(F.col("event_id").alias("query_id"), F.lit("web").alias("product"), columns.alias("columns"), F.array(F.lit("count(*)")).alias("aggregates"), both.alias("filters"), F.array(F.lit("a")).alias("group_by"), F.lit(0).alias("limit"), F.lit(0).alias("offset"))


LOG = "(SELECT event_id AS query_id, event_type, CAST(CAST(floor(value) AS BIGINT) % 7 AS VARCHAR) AS x, CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR) AS y FROM events)"
ATOMS = f"(SELECT query_id, 'event_type' AS col, '=' AS op, event_type AS literal FROM {LOG} UNION SELECT query_id, 'bucket', '=', x FROM {LOG} UNION SELECT query_id, 'bucket', '=', y FROM {LOG})"


@query(f"SELECT col, op, literal, count(*) AS queries FROM {ATOMS} GROUP BY ALL")
def predicate_atoms(spark: SparkSession, sf: str) -> DataFrame:
    return footprint.log_atoms(query_log(spark, sf)).groupBy("col", "op", "literal").agg(F.count("*").alias("queries"))


ATOM_SETS = sql_set_digest(f"SELECT query_id, {sql_digest('col', 'op', 'literal')} AS h, h AS t FROM {ATOMS}", "query_id")


@query(f"SELECT digest, n, count(*) AS queries FROM ({ATOM_SETS}) GROUP BY ALL")
def predicate_sets(spark: SparkSession, sf: str) -> DataFrame:
    return footprint.log_predicate_sets(query_log(spark, sf)).groupBy("digest", "n").agg(F.count("*").alias("queries"))


@query(f"SELECT count(*) AS queries, min(query_id) AS first FROM {LOG} GROUP BY event_type, CASE WHEN x = y THEN x ELSE least(x, y) || ',' || greatest(x, y) END")
def plan_key_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that differ only in order or repetition share a key."""
    log = query_log(spark, sf)
    return footprint.log_plan_keys(log).groupBy("plan_key").agg(F.count("*").alias("queries"), F.min("query_id").alias("first")).drop("plan_key")


@query(f"SELECT o_orderstatus, CASE o_orderstatus WHEN 'F' THEN total + 1 WHEN 'O' THEN total END AS shown, CASE WHEN o_orderstatus <> 'O' THEN total END AS proven FROM (SELECT o_orderstatus, CAST(sum(l_extendedprice) AS DECIMAL(38,2)) AS total FROM {JOINED} GROUP BY 1)")
def reconcile_visible(spark: SparkSession, sf: str) -> DataFrame:
    """Visible totals against those from the proofs, where one was changed, one isn't shown and one has no proof: each is found."""
    shown = visible(spark, sf, join2_plan()).where("o_orderstatus <> 'P'").select("o_orderstatus", (F.col("total") + F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).cast("decimal(38,2)").alias("total"))
    proven = provenance(spark, sf, join2_plan()).where("orders__o_orderstatus <> 'O'").groupBy(F.col("orders__o_orderstatus").alias("o_orderstatus")).agg(F.sum("lineitem__l_extendedprice").cast("decimal(38,2)").alias("total"))
    return facts.reconcile(shown, proven, ["o_orderstatus"], "total")


@query("SELECT rule, n FROM (SELECT CASE o_orderkey % 6 WHEN 1 THEN 'hash' WHEN 2 THEN 'kind' WHEN 3 THEN 'row with a field' WHEN 5 THEN 'no entity' END AS rule, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'cell without a field', count(*) FROM orders WHERE o_orderkey % 6 = 4) WHERE rule IS NOT NULL")
def relation_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of which five sixths break a rule of their kind, by the order they are about; sound ones are not reported."""
    p = PRODUCTS["orders"]
    o = load(spark, sf, "orders").select("o_orderkey", entity_key(p).alias("entity_key"))
    k, sound = F.col("o_orderkey") % 6, row_fact(p.namespace, p.snapshot, F.col("entity_key"))
    f = o.select(F.when(k == 1, F.upper(sound)).otherwise(sound).alias("fact_hash"), F.when(k == 2, "other").when(k == 4, "base-cell").otherwise("base-row").alias("kind"), F.when(k == 3, "o_orderkey").alias("field"), F.when(k != 5, F.col("entity_key")).alias("entity_key"))
    return facts.violations(f).groupBy("rule").agg(F.count("*").alias("n"))


@query("SELECT count(*) * 4 + (SELECT count(*) FROM lineitem) * 3 AS most FROM orders")
def fact_upper_bound(spark: SparkSession, sf: str) -> DataFrame:
    """How many base facts the grouped join can touch at most."""
    return facts.upper_bound(spark, sf, join2_plan())
