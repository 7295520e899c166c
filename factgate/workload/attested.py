"""Published versions of which some files were changed afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import publications
from ..sources.products import PRODUCTS, load
from ..streaming.shared import durable, shared_folder
from . import query
from .tables import CUSTOMER, row

SHARD = 64
HELD = f"(SELECT *, row_number() OVER (ORDER BY h) - 1 AS ordinal FROM (SELECT c_custkey, {row('customer')} AS h FROM {CUSTOMER}))"


def changed(spark: SparkSession, path: str, part: str, shard: str, change) -> None:
    """Rewrites a shard within its folder as somebody might who knows nothing of its attestation."""
    every = publications.stored(spark, path, part)
    folder = every.where(F.col("shard") == shard).select("folder").first()[0]
    rows = durable(every.where(F.col("folder") == folder))
    mine = change(rows.where(F.col("shard") == shard)).unionByName(rows.where(F.col("shard") != shard))
    mine.drop("folder", *(["shard"] if part == "hot" else [])).coalesce(1).write.mode("overwrite").parquet(f"{path}/{part}/folder={folder}")


@query(f"SELECT 'hot' AS part, substr(min(h), 1, CASE WHEN count(*) > {SHARD * 16 ** 3} THEN 4 WHEN count(*) > {SHARD * 16 ** 2} THEN 3 WHEN count(*) > {SHARD * 16} THEN 2 ELSE 1 END) AS shard FROM {HELD} UNION ALL SELECT 'cold', '0' UNION ALL SELECT 'sidecar', CAST((count(*) - 1) // {SHARD} AS VARCHAR) FROM {HELD}")
def tampered_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Customers published in small shards; a hash, a balance and a key are changed, and their shards are named."""
    p, base = PRODUCTS["customer"], shared_folder(spark, "attested")
    publications.publish_indexed(load(spark, sf, "customer"), p, base, "day0", SHARD)
    path = f"{base}/{p.name}/snapshot=day0"
    assert publications.tampered(spark, base, p, "day0").isEmpty()
    hot, _, sidecar = publications.indexed(spark, base, p, "day0")
    first, last = hot.agg(F.min(F.struct("fact_hash", "prefix"))).first()[0]["prefix"], sidecar.agg(F.max("handle")).first()[0]
    changed(spark, path, "hot", first, lambda r: r.withColumn("ordinal", F.col("ordinal") + F.when(F.col("ordinal") == 0, 1).otherwise(0)))
    changed(spark, path, "cold", "0", lambda r: r.withColumn("c_acctbal", F.when(F.col("ordinal") == 1, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).cast("decimal(18,2)")))
    changed(spark, path, "sidecar", str(last // SHARD), lambda r: r.where(F.col("handle") != last).unionByName(r.where(F.col("handle") == last).withColumn("entity_key", F.lit("1:x"))))
    return publications.tampered(spark, base, p, "day0")
