"""Logs and sets as they are looked up and checked later, later versions, and results kept as publications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wide
from ..functions.canonical import digest, sql_canonical, sql_composite
from ..operators import audit, snapshots
from ..operators.digest import set_digest, sql_set_digest, unverified
from ..sources import publications
from ..sources.products import load
from ..streaming.shared import durable, shared_folder
from . import query
from .tables import ORDERS

LOG = "(SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS actor, event_type, CAST(user_id % 10 AS VARCHAR) AS task FROM events)"
WANTED = "task = '3' AND event_type = 'click'"


def log(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("actor"), "event_type", (F.col("user_id") % 10).cast("string").alias("task"))


@query(f"SELECT page, seq, actor, event_type FROM (SELECT (row_number() OVER (ORDER BY seq) - 1) // 40 AS page, * FROM {LOG} WHERE {WANTED}) WHERE page < 3")
def audit_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The first three pages of one task's clicks, each from the last number of the page before."""
    out, after = None, -1
    for page in range(3):
        part = durable(audit.listed(log(spark, sf), after, 40, task="3", event_type="click", actor=""))
        out = part.withColumn("page", F.lit(page).cast("long")) if out is None else out.unionByName(part.withColumn("page", F.lit(page).cast("long")))
        after = part.agg(F.coalesce(F.max("seq"), F.lit(after))).first()[0]
    return out.select("page", "seq", "actor", "event_type")


@query(f"SELECT event_type, count(*) AS events, min(seq) AS first, max(seq) AS last FROM {LOG} WHERE seq > 100 AND seq <= 900 GROUP BY event_type")
def audit_range(spark: SparkSession, sf: str) -> DataFrame:
    """What happened between two numbers of the log."""
    return audit.between(log(spark, sf), 100, 900).groupBy("event_type").agg(F.count("*").alias("events"), F.min("seq").alias("first"), F.max("seq").alias("last"))


@query("SELECT CASE WHEN root = 9 THEN 10 ELSE root END AS root, CASE root WHEN 2 THEN 'digest' WHEN 4 THEN 'count' WHEN 9 THEN 'empty' END AS problem FROM (SELECT DISTINCT user_id % 10 AS root FROM events) WHERE root IN (2, 4, 9) UNION ALL SELECT DISTINCT user_id % 10, 'unclaimed' FROM events WHERE user_id % 10 = 9")
def unverified_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Claimed digests of each root's set of users' facts: one is of other members, one lacks one, one is under another root's name."""
    facts = load(spark, sf, "events").select((F.col("user_id") % 10).alias("root"), digest("user", F.col("user_id").cast("string"), F.col("event_type")).alias("h"))
    claims = set_digest(facts, "h", ["root"])
    claims = claims.withColumn("digest", F.when(F.col("root") == 2, F.sha2("digest", 256)).otherwise(F.col("digest"))).withColumn("n", F.when(F.col("root") == 4, F.col("n") - 1).otherwise(F.col("n")))
    return unverified(claims.withColumn("root", F.when(F.col("root") == 9, 10).otherwise(F.col("root")).cast("long")), facts, "h", ["root"])


def _counts(name: str, changed: str) -> str:
    return f"SELECT '{name}' AS version, {changed} FROM orders"


@query(" UNION ALL ".join([*[_counts(f"{k} %", f"0 AS inserted, 0 AS deleted, count(*) FILTER (WHERE o_orderkey % 100 < {k}) AS updated, count(*) FILTER (WHERE o_orderkey % 100 >= {k}) AS unchanged") for k in (1, 5, 10)], _counts("churn", "count(*) FILTER (WHERE o_orderkey % 100 < 1), count(*) FILTER (WHERE o_orderkey % 100 < 1), 0, count(*) FILTER (WHERE o_orderkey % 100 >= 1)")]))
def daily_versions(spark: SparkSession, sf: str) -> DataFrame:
    """What a day changed: versions with 1, 5 and 10 % of the prices raised, and one with 1 % of the orders replaced."""
    old = load(spark, sf, "orders")
    days = {f"{k} %": snapshots.next_version(old, "o_orderkey", "o_totalprice", k) for k in (1, 5, 10)} | {"churn": snapshots.churned(old, "o_orderkey", 1)}
    out = None
    for name, new in days.items():
        one = snapshots.version_diff(old, new, ["o_orderkey"]).select(F.lit(name).alias("version"), "*")
        out = one if out is None else out.unionByName(one)
    return out


JOINED = f"(SELECT o_orderkey, c_mktsegment, o_totalprice FROM {ORDERS} JOIN customer ON c_custkey = o_custkey)"
MONTHS = f"(SELECT strftime(o_orderdate, '%Y-%m') AS month, c_mktsegment, CAST(sum(o_totalprice) AS DECIMAL(38,2)) AS total, count(*) AS requests FROM {ORDERS} JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"


def _content(name: str, rows: str, kinds: dict[str, str]) -> str:
    each = f"SELECT sha256({sql_composite(*[f'({sql_canonical(c, kinds[c])})' for c in sorted(kinds)])}) AS h, h AS t FROM {rows}"
    return f"SELECT '{name}' AS name, n AS rows, digest AS content_digest FROM ({sql_set_digest(each)})"


@query(_content("joined", JOINED, {"o_orderkey": "bigint", "c_mktsegment": "string", "o_totalprice": "decimal(18,2)"}) + " UNION ALL " + _content("months", MONTHS, {"month": "string", "c_mktsegment": "string", "total": "decimal(38,2)", "requests": "bigint"}))
def materialised_publications(spark: SparkSession, sf: str) -> DataFrame:
    """A join and its monthly totals kept as immutable versions: their manifests, for rows read back from them."""
    base = shared_folder(spark, "materialised")
    both = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    publications.publish(both.select("o_orderkey", "c_mktsegment", "o_totalprice"), "o_orderkey", base, "joined", "day0")
    months = both.groupBy(wide.to_char(F.col("o_orderdate"), "YYYY-MM").alias("month"), "c_mktsegment").agg(F.sum("o_totalprice").cast("decimal(38,2)").alias("total"), F.count("*").alias("requests"))
    publications.publish(months, "month", base, "months", "day0")
    out = None
    for name in ("joined", "months"):
        n = publications.published(spark, base, name, "day0").agg(F.count("*").alias("__n"))
        one = spark.read.parquet(f"{base}/{name}/snapshot=day0/manifest").join(n, F.col("rows") == F.col("__n"), "left_semi").select("name", "rows", "content_digest")
        out = one if out is None else out.unionByName(one)
    return out
