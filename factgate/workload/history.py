"""Snapshots and their versions, the ledger over request streams, budgets, audit and retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import digest, sql_canonical, sql_composite
from ..operators import audit, ledger, snapshots, stats
from ..operators.digest import sql_set_digest
from ..sources.products import PRODUCTS, entity_key, load
from ..streaming import novelty
from ..streaming.shared import durable, shared_folder
from . import query
from .tables import CUSTOMER, EVENTS, ORDERS, cell, key, row

COLS = ("o_orderkey", "o_orderstatus", "o_totalprice")
FACTS = " UNION ALL ".join([f"SELECT {row('orders')} AS fact_hash, 'base-row' AS kind, CAST(NULL AS VARCHAR) AS field FROM {ORDERS}", *[f"SELECT {cell('orders', c)}, 'base-cell', '{c}' FROM {ORDERS}" for c in COLS]])


def order_facts(spark: SparkSession, sf: str) -> DataFrame:
    p = PRODUCTS["orders"]
    return snapshots.snapshot_facts(load(spark, sf, "orders"), p.namespace, p.snapshot, entity_key(p), {c: p.columns[c] for c in COLS})


@query(f"SELECT fact_hash, kind, field, row_number() OVER (ORDER BY fact_hash) - 1 AS ordinal FROM ({FACTS})")
def snapshot_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of a snapshot with dense ordinals in hash order."""
    # sorted and stored with the number of the field; a row fact, which has none, with 0
    facts = order_facts(spark, sf).select("fact_hash", F.coalesce(F.array_position(F.array(*[F.lit(c) for c in COLS]), F.col("field")), F.lit(0)).cast("tinyint").alias("at"))
    of = lambda *names: F.element_at(F.array(*[F.lit(x) for x in names]), F.col("at") + 1)
    return snapshots.compile_ordinals(facts).select("fact_hash", of("base-row", *["base-cell"] * len(COLS)).alias("kind"), of(None, *COLS).alias("field"), "ordinal")


@query(f"SELECT o_orderkey, ordinal AS handle FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {row('orders')}) - 1 AS ordinal FROM {ORDERS})")
def snapshot_handles(spark: SparkSession, sf: str) -> DataFrame:
    """Row handles of a snapshot, joined back to its rows by entity key."""
    p = PRODUCTS["orders"]
    rows = load(spark, sf, "orders").select("o_orderkey", entity_key(p).alias("entity_key"))
    keyed = rows.select("entity_key", digest("row", p.namespace, p.snapshot, F.col("entity_key")).alias("fact_hash"))
    handles = snapshots.numbered(keyed, ["fact_hash"], "handle").select("handle", "entity_key")
    return rows.join(handles, "entity_key").select("o_orderkey", "handle")


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0) AS either, (SELECT count(*) FROM orders WHERE o_orderkey % 15 = 0) AS both, (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0) AS novel")
def ordinal_bitmap_algebra(spark: SparkSession, sf: str) -> DataFrame:
    """Union, intersection and novelty of two sets of orders as bitmaps."""
    o = load(spark, sf, "orders")
    a, b = (snapshots.bitmap(o.where(f"o_orderkey % {k} = 0"), "o_orderkey") for k in (3, 5))
    one = lambda df, n: snapshots.cardinality(df).withColumnRenamed("n", n)
    return one(snapshots.bitmap_union(a, b), "either").crossJoin(one(snapshots.bitmap_intersection(a, b), "both")).crossJoin(snapshots.novelty(b, a))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0")
def ordinal_expand(spark: SparkSession, sf: str) -> DataFrame:
    """A bitmap turned back to the rows that it stands for."""
    o = load(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("ordinal"))
    pages = snapshots.bitmap(load(spark, sf, "orders").where("o_orderstatus = 'P' and o_orderkey % 2 = 0"), "o_orderkey")
    return snapshots.expand(pages, o).select("o_orderkey")


@query("SELECT CAST(l_orderkey % 4 AS INTEGER) AS segment, l_orderkey AS ordinal FROM lineitem WHERE l_orderkey >= 1000 * (l_orderkey % 4 + 1) OR l_orderkey % 4 = 3")
def ordinal_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """References beyond their segment or to an unknown one."""
    refs = load(spark, sf, "lineitem").select((F.col("l_orderkey") % 4).cast("int").alias("segment"), F.col("l_orderkey").alias("ordinal"))
    return snapshots.out_of_bounds(refs, spark.range(3).select(F.col("id").cast("int").alias("segment"), ((F.col("id") + 1) * 1000).alias("size")))


CUSTOMER_HANDLES = f"(SELECT c_custkey, {key('customer')} AS k, row_number() OVER (ORDER BY {row('customer')}) - 1 AS handle FROM {CUSTOMER})"


@query(f"SELECT handle, CASE WHEN c_custkey % 50 = 0 THEN k || '!' WHEN c_custkey % 70 <> 0 THEN k END AS sidecar_key, CASE WHEN c_custkey % 110 <> 0 THEN k END AS index_key FROM {CUSTOMER_HANDLES} WHERE c_custkey % 50 = 0 OR c_custkey % 70 = 0 AND c_custkey % 110 <> 0 OR c_custkey % 110 = 0 AND c_custkey % 70 <> 0")
def sidecar_verified(spark: SparkSession, sf: str) -> DataFrame:
    """A sidecar in which some keys are wrong and some handles missing, against an index that lacks others: each is found."""
    p = PRODUCTS["customer"]
    keyed = load(spark, sf, "customer").select("c_custkey", entity_key(p).alias("entity_key")).withColumn("h", digest("row", p.namespace, p.snapshot, F.col("entity_key")))
    index = durable(snapshots.numbered(keyed, ["h"], "handle").select("c_custkey", "handle", "entity_key"))
    wrong = F.when(F.col("c_custkey") % 50 == 0, F.concat("entity_key", F.lit("!"))).otherwise(F.col("entity_key"))
    sidecar = index.where("c_custkey % 50 = 0 or c_custkey % 70 <> 0").select("handle", wrong.alias("entity_key"))
    return snapshots.handle_mismatches(sidecar, index.where("c_custkey % 110 <> 0"))


def versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    old = load(spark, sf, "orders").where("o_orderkey % 100 <> 99")
    new = snapshots.next_version(load(spark, sf, "orders").where("o_orderkey % 100 <> 98"), "o_orderkey", "o_totalprice", 5)
    return old, new


@query("SELECT count(*) FILTER (WHERE o_orderkey % 100 = 99) AS inserted, count(*) FILTER (WHERE o_orderkey % 100 = 98) AS deleted, count(*) FILTER (WHERE o_orderkey % 100 < 5) AS updated, count(*) FILTER (WHERE o_orderkey % 100 BETWEEN 5 AND 97) AS unchanged FROM orders")
def version_diff(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.version_diff(*versions(spark, sf), ["o_orderkey"])


@query(sql_set_digest(f"SELECT sha256({sql_composite(*[f"({sql_canonical(c, PRODUCTS['orders'].columns[c])})" for c in ('o_custkey', 'o_orderkey', 'o_orderstatus', 'o_totalprice')])}) AS h, h AS t FROM {ORDERS}"))
def version_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """A digest of a version's rows that doesn't depend on their order or partitions."""
    return stats.content_digest(load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice"))


@query("SELECT count(*) FILTER (WHERE o_orderkey % 10 < 5) AS candidate, count(*) FILTER (WHERE o_orderkey % 10 >= 3) AS history, count(*) FILTER (WHERE o_orderkey % 10 IN (3, 4)) AS shared, round(count(*) FILTER (WHERE o_orderkey % 10 IN (3, 4)) * 100.0 / count(*) FILTER (WHERE o_orderkey % 10 < 5), 4) AS percent FROM orders")
def overlap_percent(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    return stats.overlap(o.where("o_orderkey % 10 < 5"), o.where("o_orderkey % 10 >= 3"), "o_orderkey").withColumn("percent", F.col("percent").cast("double"))


# -- the ledger: every event asks for a fact on behalf of one of ten roots --------------------------------------------


def requests(spark: SparkSession, sf: str, by: str = "root") -> DataFrame:
    """A request stream by root or task: each event reveals one fact, depends on another and asks a third."""
    e = load(spark, sf, "events")
    cents = F.floor("value").cast("string")
    facts = F.array(F.struct(F.lit("release").alias("dim"), digest(F.col("event_type"), cents).alias("fact_hash")), F.struct(F.lit("influence").alias("dim"), digest("user", F.col("user_id").cast("string")).alias("fact_hash")), F.struct(F.lit("outcome").alias("dim"), digest(F.col("event_type")).alias("fact_hash")))
    who = F.col("user_id") % 10 if by == "root" else F.col("user_id")
    return e.select(who.alias(by), F.col("event_id").alias("seq"), F.explode(facts).alias("f")).select(by, "seq", "f.dim", "f.fact_hash")


def root_caps(spark: SparkSession) -> DataFrame:
    """Ceilings of the ten roots, which all refuse something."""
    return spark.range(10).select(F.col("id").alias("root"), (F.col("id") * 4 + 12).alias("max_release"), (F.col("id") + 3).alias("max_influence"), F.lit(4).cast("bigint").alias("max_outcome"))


STREAM = f"(SELECT user_id % 10 AS root, event_id AS seq, 'release' AS dim, event_type || ':' || CAST(floor(value) AS VARCHAR) AS f FROM {EVENTS} UNION ALL SELECT user_id % 10, event_id, 'influence', CAST(user_id AS VARCHAR) FROM {EVENTS} UNION ALL SELECT user_id % 10, event_id, 'outcome', event_type FROM {EVENTS})"


@query(f"SELECT root, seq, dim, CAST(1 AS BIGINT) AS actual, CAST(seq = first AS BIGINT) AS charged FROM (SELECT *, min(seq) OVER (PARTITION BY root, dim, f) AS first FROM {STREAM})")
def novelty_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """What each request would be charged if all were accepted: its facts that no earlier one of its root had."""
    return ledger.charges(requests(spark, sf))


@query(f"SELECT root, dim, count(*) AS known FROM (SELECT DISTINCT root, dim, f FROM {STREAM}) GROUP BY root, dim")
def root_family_shared(spark: SparkSession, sf: str) -> DataFrame:
    """Every user is a task of one of ten roots; all tasks of a root learn together."""
    tasks = load(spark, sf, "events").select(F.col("user_id").alias("task"), (F.col("user_id") % 10).alias("root")).distinct()
    return ledger.first_seen(ledger.by_root(tasks, requests(spark, sf, "task"))).groupBy("root", "dim").agg(F.count("*").alias("known"))


@query(f"SELECT root, count(*) AS novel FROM (SELECT DISTINCT root, dim, f FROM {STREAM} WHERE seq % 2 = 1 EXCEPT SELECT root, dim, f FROM {STREAM} WHERE seq % 2 = 0) GROUP BY root")
def novelty_against_ledger(spark: SparkSession, sf: str) -> DataFrame:
    s = requests(spark, sf)
    known = s.where("seq % 2 = 0").select("root", "dim", "fact_hash").distinct()
    return ledger.novel(s.where("seq % 2 = 1").select("root", "dim", "fact_hash").distinct(), known).groupBy("root").agg(F.count("*").alias("novel"))


#: Settlement one request after another, all roots at once: what each has learned, and what the next request is charged.
CAPPED = f"""WITH RECURSIVE ask AS (SELECT user_id % 10 AS root, event_id AS seq, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS k, event_type || ':' || CAST(floor(value) AS VARCHAR) AS r, CAST(user_id AS VARCHAR) AS i, event_type AS o FROM {EVENTS}),
fold AS (SELECT DISTINCT root, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST([] AS VARCHAR[]) AS kr, CAST([] AS VARCHAR[]) AS ki, CAST([] AS VARCHAR[]) AS ko, true AS accepted, false AS nr, false AS ni, false AS n_o FROM ask
  UNION ALL SELECT root, k, seq, CASE WHEN ok AND nr THEN list_append(kr, r) ELSE kr END, CASE WHEN ok AND ni THEN list_append(ki, i) ELSE ki END, CASE WHEN ok AND n_o THEN list_append(ko, o) ELSE ko END, ok, ok AND nr, ok AND ni, ok AND n_o
  FROM (SELECT *, (NOT nr OR len(kr) < root * 4 + 12) AND (NOT ni OR len(ki) < root + 3) AND (NOT n_o OR len(ko) < 4) AS ok
    FROM (SELECT a.root, a.k, a.seq, a.r, a.i, a.o, f.kr, f.ki, f.ko, NOT list_contains(f.kr, a.r) AS nr, NOT list_contains(f.ki, a.i) AS ni, NOT list_contains(f.ko, a.o) AS n_o FROM fold f JOIN ask a ON a.root = f.root AND a.k = f.k + 1))),
settled AS (SELECT root, seq, accepted, CAST(nr AS BIGINT) AS charged_release, CAST(ni AS BIGINT) AS charged_influence, CAST(n_o AS BIGINT) AS charged_outcome FROM fold WHERE k > 0)"""


@query(f"{CAPPED} SELECT * FROM settled")
def capped_settlement(spark: SparkSession, sf: str) -> DataFrame:
    """Requests in order under caps, all or nothing; refused ones teach nothing."""
    return ledger.settle(requests(spark, sf), root_caps(spark))


@query(f"SELECT root, seq, true AS accepted, CAST(sum(charged) FILTER (WHERE dim = 'release') AS BIGINT) AS charged_release, CAST(sum(charged) FILTER (WHERE dim = 'influence') AS BIGINT) AS charged_influence, CAST(sum(charged) FILTER (WHERE dim = 'outcome') AS BIGINT) AS charged_outcome FROM (SELECT root, seq, dim, CAST(seq = min(seq) OVER (PARTITION BY root, dim, f) AS BIGINT) AS charged FROM {STREAM}) GROUP BY root, seq")
def uncapped_settlement(spark: SparkSession, sf: str) -> DataFrame:
    caps = spark.range(10).select(F.col("id").alias("root"), *[F.lit(1 << 40).alias(f"max_{d}") for d in ledger.DIMS])
    return ledger.settle(requests(spark, sf), caps)


@query(f"SELECT root, seq, first_seq FROM (SELECT root, seq, min(seq) OVER (PARTITION BY root, user_id, event_type, floor(value)) AS first_seq FROM (SELECT user_id % 10 AS root, event_id AS seq, user_id, event_type, value FROM {EVENTS})) WHERE seq > first_seq")
def replay_zero(spark: SparkSession, sf: str) -> DataFrame:
    """Requests that an earlier one of their root covers in full."""
    return ledger.replays(requests(spark, sf))


@query(f"SELECT root, release, 500 - release AS left_release FROM (SELECT root, count(*) AS release FROM (SELECT DISTINCT root, f FROM {STREAM} WHERE dim = 'release') GROUP BY root)")
def ledger_balance(spark: SparkSession, sf: str) -> DataFrame:
    caps = spark.range(10).select(F.col("id").alias("root"), *[F.lit(500).cast("bigint").alias(f"max_{d}") for d in ledger.DIMS])
    return ledger.balance(ledger.first_seen(requests(spark, sf)), caps).select("root", F.col("used_release").alias("release"), "left_release")


STATUS = "CASE WHEN event_id % 11 = 0 THEN 'reserved' WHEN event_id % 7 = 0 THEN 'failed' WHEN event_id % 13 = 0 THEN 'indeterminate' ELSE 'completed' END"


def resource_log(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    return e.select((F.col("user_id") % 20).alias("task"), F.col("event_id").alias("seq"), F.expr(STATUS).alias("status"), F.lit(100).cast("bigint").alias("reserved_rows"), (F.col("event_id") % 97).alias("rows"), (F.col("event_id") % 31).alias("ms"))


RESOURCE = f"(SELECT user_id % 20 AS task, event_id AS seq, {STATUS} AS status, event_id % 97 AS n, event_id % 31 AS ms FROM events)"


@query(f"""SELECT task, seq, status, q AS queries_used, r AS rows_used, m AS ms_used, q > 400 OR r > 20000 OR m > 6000 AS exhausted FROM (SELECT task, seq, status, count(*) OVER w AS q,
  CAST(sum(CASE status WHEN 'completed' THEN n WHEN 'failed' THEN 0 ELSE 100 END) OVER w AS BIGINT) AS r, CAST(sum(ms) OVER w AS BIGINT) AS m FROM {RESOURCE} WINDOW w AS (PARTITION BY task ORDER BY seq))""")
def budget_running(spark: SparkSession, sf: str) -> DataFrame:
    budget = spark.range(20).select(F.col("id").alias("task"), F.lit(400).alias("max_queries"), F.lit(20000).alias("max_rows"), F.lit(6000).alias("max_ms"))
    return ledger.spend(resource_log(spark, sf), budget)


@query(f"SELECT seq, CASE status WHEN 'reserved' THEN 'indeterminate' ELSE status END AS status, CASE status WHEN 'reserved' THEN 100 ELSE n END AS charged_rows FROM {RESOURCE}")
def recover_interrupted(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.recover(resource_log(spark, sf)).select("seq", "status", "charged_rows")


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN r = 1 THEN 'first' WHEN event_type = f THEN 'replay' ELSE 'conflict' END AS status FROM (SELECT event_type, row_number() OVER w AS r, first_value(event_type) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id % 20, event_id % 50 ORDER BY event_id))) GROUP BY status")
def request_id_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    log = load(spark, sf, "events").select((F.col("user_id") % 20).alias("task"), (F.col("event_id") % 50).alias("request_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload"))
    return ledger.idempotent(log).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT a.event_id AS query_id, min(b.event_id) AS result_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type WHERE a.event_id % 2 = 1 AND b.event_id % 2 = 0 AND b.event_id % 3 <> 0 GROUP BY 1")
def result_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """Stored results that answer later requests: all bound fields agree, and they completed and live."""
    e = load(spark, sf, "events").withColumn("binding", ledger.binding_key("user_id", "event_type"))
    results = e.where("event_id % 2 = 0").select("binding", F.col("event_id").alias("result_id"), F.when(F.col("event_id") % 3 == 0, "failed").otherwise("completed").alias("status"), F.lit("2030-01-01").cast("timestamp").alias("expires"))
    return ledger.reusable(e.where("event_id % 2 = 1").select("binding", F.col("event_id").alias("query_id")), results, ["binding"], "2026-01-01")


@query("SELECT user_id % 10 AS root, count(*) AS queries, CAST(sum(event_id % 97) AS BIGINT) AS rows, CAST(sum(event_id % 97 * 8) AS BIGINT) AS bytes, CAST(sum(event_id % 97 * 3) AS BIGINT) AS cells, CAST(sum(event_id % 97 + 4) AS BIGINT) AS without_history FROM events GROUP BY 1")
def baseline_costs(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.col("event_id") % 97
    log = load(spark, sf, "events").select((F.col("user_id") % 10).alias("root"), rows.alias("rows"), (rows * 8).alias("bytes"), F.lit(3).alias("columns"), (rows + 4).alias("facts"))
    return ledger.baselines(log)


@query("SELECT event_id, ts FROM events WHERE (ts, event_id) > (SELECT (ts, event_id) FROM events WHERE event_id = 100) ORDER BY ts, event_id LIMIT 50")
def log_keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select("ts", "event_id")
    at = e.where("event_id = 100").first()
    return ledger.keyset_page(e, ["ts", "event_id"], (at["ts"], at["event_id"]), 50).select("event_id", "ts")


@query(f"SELECT root, dim, count(*) AS facts FROM (SELECT DISTINCT root, dim, f FROM {STREAM}) GROUP BY ALL")
def stream_novelty(spark: SparkSession, sf: str) -> DataFrame:
    """First-seen facts of a stream over the events table; together they are what a batch finds. State is kept off the heap."""
    novelty.off_heap(spark)
    base = shared_folder(spark, "novelty")
    events = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    cents = F.floor(F.round("value", 2).cast("decimal(18,2)")).cast("string")
    facts = F.array(F.struct(F.lit("release").alias("dim"), digest(F.col("event_type"), cents).alias("fact_hash")), F.struct(F.lit("influence").alias("dim"), digest("user", F.col("user_id").cast("string")).alias("fact_hash")), F.struct(F.lit("outcome").alias("dim"), digest(F.col("event_type")).alias("fact_hash")))
    stream = events.select((F.col("user_id") % 10).alias("root"), F.explode(facts).alias("f")).select("root", "f.dim", "f.fact_hash")
    q = novelty.first_seen(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("root long, dim string, fact_hash string").parquet(f"{base}/out").groupBy("root", "dim").agg(F.count("*").alias("facts"))


# -- audit ------------------------------------------------------------------------------------------------------------


def chain(spark: SparkSession, sf: str) -> DataFrame:
    """A chain over all events whose links are hashes of the numbers, so that each can be made apart."""
    e = load(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("actor"), "event_type", F.col("props").alias("payload"))
    head = lambda s: F.when(s < 0, audit.START).otherwise(F.sha2(s.cast("string"), 256))
    return e.select("*", head(F.col("seq") - 1).alias("prev_hash"), head(F.col("seq")).alias("hash"))


@query("SELECT event_id AS seq, 'hash' AS problem FROM events")
def audit_chain_forged(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes that don't come from their events' contents are found, every one."""
    return audit.breaks(chain(spark, sf))


SEGMENT = 1000


def linked_events(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("actor"), "event_type", F.col("props").alias("payload"))
    return durable(audit.link(e, size=SEGMENT))


@query("SELECT 'linked' AS part, count(*) AS events, CAST(0 AS BIGINT) AS breaks FROM events UNION ALL SELECT 'changed', count(*), 1 FROM events UNION ALL SELECT 'missing', count(*) - 1, 1 FROM events UNION ALL SELECT 'heads', count(DISTINCT event_id // 1000), 0 FROM events")
def audit_chain_verify(spark: SparkSession, sf: str) -> DataFrame:
    """All events linked in segments hold, as do the linked heads of the segments; a changed and a missing event show as a break each."""
    good = linked_events(spark, sf)
    changed = good.withColumn("payload", F.when(F.col("seq") == 7, "{}").otherwise(F.col("payload")))
    one = lambda df, n, size=SEGMENT: df.agg(F.lit(n).alias("part"), F.count("*").alias("events")).crossJoin(audit.breaks(df, size=size).agg(F.count("*").alias("breaks")))
    parts = [one(good, "linked"), one(changed, "changed"), one(good.where("seq <> 7"), "missing"), one(durable(audit.link(audit.heads(good, SEGMENT))), "heads", None)]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT CAST(12 AS BIGINT) AS seq, true AS whole, false AS cut, false AS other FROM region WHERE r_regionkey = 0")
def audit_inclusion(spark: SparkSession, sf: str) -> DataFrame:
    """Whether event 12 is linked to its segment's head: in the whole log, without event 20, and to another hash."""
    good = linked_events(spark, sf)
    last = good.where(F.floor(F.col("seq") / SEGMENT) == 0).orderBy(F.desc("seq")).first()
    held = [audit.included(df, 12, last["seq"], h) for df, h in ((good, last["hash"]), (good.where("seq <> 20"), last["hash"]), (good, audit.START))]
    return spark.range(1).select(F.lit(12).cast("bigint").alias("seq"), *[F.lit(v).alias(n) for n, v in zip(("whole", "cut", "other"), held)])


@query("SELECT event_id AS result_id FROM events WHERE ts < TIMESTAMP '2024-01-03' AND user_id % 9 <> 0")
def retention_purge(spark: SparkSession, sf: str) -> DataFrame:
    """Results past the cutoff whose task no one holds."""
    e = load(spark, sf, "events")
    artifacts = e.select(F.col("event_id").alias("result_id"), F.col("user_id").alias("task"), F.col("ts").cast("timestamp").alias("created_at"))
    holds = e.where("user_id % 9 = 0 or user_id % 4 = 0").select(F.col("user_id").alias("task"), F.when(F.col("user_id") % 9 != 0, F.current_timestamp()).alias("released_at"))
    return audit.expired(artifacts, holds, "2024-01-03").select("result_id")


@query("SELECT action, count(*) AS n FROM (SELECT CASE WHEN b.event_id IS NULL THEN 'orphan' WHEN a.event_id IS NULL THEN 'missing' WHEN b.event_type = 'view' THEN 'promote' END AS action FROM (SELECT * FROM events WHERE event_id % 3 <> 0) a FULL JOIN (SELECT * FROM events WHERE event_id % 4 <> 0) b ON a.event_id = b.event_id) WHERE action IS NOT NULL GROUP BY 1")
def artifacts_awaiting(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    files = e.where("event_id % 3 <> 0").select(F.col("event_id").alias("name"))
    known = e.where("event_id % 4 <> 0").select(F.col("event_id").alias("name"), F.when(F.col("event_type") == "view", "pending").otherwise("stored").alias("status"))
    return audit.awaiting(files, known).groupBy("action").agg(F.count("*").alias("n"))


# -- statistics -------------------------------------------------------------------------------------------------------


@query(f"SELECT event_type, count(*) AS n, round(quantile_cont(CAST(value AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(value AS DOUBLE), 0.95), 6) AS p95 FROM {EVENTS} GROUP BY event_type")
def quantiles_type7(spark: SparkSession, sf: str) -> DataFrame:
    q = stats.quantiles(load(spark, sf, "events").withColumn("value", F.col("value").cast("double")), ["event_type"], "value", [0.5, 0.95])
    return q.select("event_type", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("SELECT CAST(0 AS BIGINT) AS only_a, (SELECT count(*) FROM orders WHERE o_orderkey % 1000 = 0) AS only_b")
def result_equality(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows in another order are equal; what is repeated shows."""
    o = load(spark, sf, "orders")
    return stats.equal_unordered(o, o.orderBy(F.desc("o_orderkey")).unionByName(o.where("o_orderkey % 1000 = 0")))


@query("SELECT count(*) * 4 AS expected, count(*) * 4 - count(*) FILTER (WHERE o_orderkey % 100 = 7) AS stored, count(*) FILTER (WHERE o_orderkey % 100 = 7) + 2 * count(*) FILTER (WHERE o_orderkey % 100 < 5) AS different FROM orders")
def facts_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Expected facts of a snapshot against stored ones, of which some were lost and some come from later prices."""
    p = PRODUCTS["orders"]
    later = snapshots.next_version(load(spark, sf, "orders"), "o_orderkey", "o_totalprice", 5)
    held = snapshots.snapshot_facts(later, p.namespace, p.snapshot, entity_key(p), {c: p.columns[c] for c in COLS})
    lost = load(spark, sf, "orders").where("o_orderkey % 100 = 7").select(entity_key(p).alias("entity_key"))
    stored = held.where("kind <> 'base-row'").unionByName(held.where("kind = 'base-row'").join(lost, "entity_key", "left_anti").select(held.columns))
    both = order_facts(spark, sf).select("fact_hash", F.lit(1).alias("a")).join(stored.select("fact_hash", F.lit(1).alias("b")), "fact_hash", "full")
    return both.agg(F.count("a").alias("expected"), F.count("b").alias("stored"), F.count(F.when(F.col("a").isNull() | F.col("b").isNull(), 1)).alias("different"))


@query()
def bootstrap_median(spark: SparkSession, sf: str) -> DataFrame:
    return stats.bootstrap_median(load(spark, sf, "events").select(F.col("value").cast("double").alias("value")), "value", 50)
