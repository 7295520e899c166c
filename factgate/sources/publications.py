"""Sinks: results and immutable snapshot publications as Parquet, and their readers."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import digest
from ..operators.digest import set_digest
from ..operators.stats import content_digest, row_hash
from .products import Product, entity_key


def write_result(df: DataFrame, path: str, result_id: str, order: list[str]) -> None:
    """A result in delivery order: rows get their position by a range sort and per-partition counts; metadata stands beside."""
    from ..operators.snapshots import numbered

    numbered(df, order, "position").write.mode("errorifexists").parquet(f"{path}/rows")
    meta = json.dumps({"result_id": result_id, "schema": df.schema.jsonValue()})
    df.sparkSession.range(1).select(F.lit(meta).alias("meta")).coalesce(1).write.mode("errorifexists").json(f"{path}/_meta_json")


def read_page(spark: SparkSession, path: str, offset: int, limit: int) -> DataFrame:
    """Rows of a stored result from a position on; a range filter on the position, so other row groups aren't read."""
    rows = spark.read.parquet(f"{path}/rows")
    return rows.where((F.col("position") >= offset) & (F.col("position") < offset + limit)).orderBy("position")


def preview(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    """The first rows of a stored result, 100 at most."""
    return read_page(spark, path, 0, min(limit, 100))


def kept(df: DataFrame) -> DataFrame:
    """A few rows that are looked at twice."""
    from ..streaming.shared import durable

    return durable(df)


def bounded(df: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """At most ``most`` rows and whether there were more."""
    held = kept(df.limit(most + 1))  # one more than asked for, so that the query runs once
    return held.limit(most), held.count() > most


def publish(df: DataFrame, key: str, base: str, name: str, snapshot: str) -> None:
    """An immutable version: rows under ``snapshot=...``, then the manifest row, so a version without one is unfinished."""
    path = f"{base}/{name}/snapshot={snapshot}"
    df.write.mode("errorifexists").parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    content = content_digest(rows)
    manifest = content.select(F.lit(name).alias("name"), F.lit(snapshot).alias("snapshot"), F.lit(key).alias("key"), F.col("n").alias("rows"), F.col("digest").alias("content_digest"))
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest")


def published(spark: SparkSession, base: str, name: str, snapshot: str) -> DataFrame:
    """The rows of a finished version; raises if it has no manifest."""
    path = f"{base}/{name}/snapshot={snapshot}"
    spark.read.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/rows")


#: Rows of a shard of a published part.
SHARD_ROWS = 1 << 20
PARTS = ("hot", "cold", "sidecar")
#: Shards of a folder, and digits of a folder of hashes at most; so folders are few however small shards are.
FOLDER, FOLDER_DIGITS = 1024, 2


def publish_indexed(df: DataFrame, p: Product, base: str, snapshot: str, shard_rows: int = SHARD_ROWS) -> None:
    """An immutable version with its index: what settlement needs apart from what decoding needs.

    ``cold`` has the rows by ordinal, ``hot`` the ordinals of row facts by hash prefix, so that a lookup reads only those
    of its hashes, and ``sidecar`` the entity key of every row handle. Prefixes are as long as the number of rows asks for, the
    other parts are sharded by ranges of ordinals of the same size. A folder holds many shards in order, and each row names
    its own, so that the number of files doesn't grow with that of the shards. Every shard of every part is attested
    (``attested``), and the manifest binds all of them.

    All of it is written under a name of its own and renamed at the end, in one step of the file system: a writer that is
    cut off leaves no version behind, and one that comes second fails.
    """
    from ..operators.snapshots import hot_and_cold, numbered

    spark, path = df.sparkSession, f"{base}/{p.name}/snapshot={snapshot}"
    stage = f"{base}/staged-{uuid.uuid4().hex}"
    rows = df.withColumn("entity_key", entity_key(p)).withColumn("fact_hash", digest("row", p.namespace, snapshot, F.col("entity_key")))
    hot, cold = hot_and_cold(numbered(rows, ["fact_hash"]))
    shard = F.floor(F.col("ordinal") / shard_rows).cast("string").alias("shard")
    folder = F.floor(F.col("ordinal") / (shard_rows * FOLDER)).cast("string").alias("folder")
    write = lambda df, part, *order: df.repartitionByRange(*order).sortWithinPartitions("folder", *order).write.partitionBy("folder").parquet(f"{stage}/{part}")
    write(cold.select("*", shard, folder).drop("entity_key"), "cold", "ordinal")
    count, depth = spark.read.parquet(f"{stage}/cold").count(), 1
    while count > shard_rows << (4 * depth):
        depth += 1
    write(hot.select("*", F.substring("fact_hash", 1, depth).alias("prefix"), F.substring("fact_hash", 1, min(depth, FOLDER_DIGITS)).alias("folder")), "hot", "fact_hash")
    write(cold.select(F.col("ordinal").alias("handle"), "entity_key", shard, folder), "sidecar", "handle")
    attested(spark, stage, snapshot).write.parquet(f"{stage}/shards")
    shards = spark.read.parquet(f"{stage}/shards")
    whole = set_digest(shards.select(digest(F.col("part"), F.col("shard"), F.col("n").cast("string"), F.col("digest")).alias("h")), "h")
    manifest = whole.select(F.lit(p.name).alias("name"), F.lit(snapshot).alias("snapshot"), F.lit(count).cast("long").alias("rows"), F.lit(depth).alias("depth"), F.col("digest").alias("content_digest"))
    manifest.coalesce(1).write.parquet(f"{stage}/manifest")
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    source, target = jvm.Path(stage), jvm.Path(path)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)
        raise FileExistsError(f"{p.name} has a version {snapshot} already")


def stored(spark: SparkSession, path: str, part: str) -> DataFrame:
    """A part's rows with ``shard``, that they belong to, and ``folder``, where they stand, as text."""
    kinds = {"hot": "ordinal long, fact_hash string, prefix string, folder string", "sidecar": "handle long, entity_key string, shard string, folder string"}
    rows = (spark.read.schema(kinds[part]) if part in kinds else spark.read).parquet(f"{path}/{part}")
    return rows.withColumn("shard", F.col("prefix" if part == "hot" else "shard").cast("string")).withColumn("folder", F.col("folder").cast("string"))


def attested(spark: SparkSession, path: str, snapshot: str) -> DataFrame:
    """(part, shard, n, digest): the rows of every shard of a version as they are now."""
    out = None
    for part in PARTS:
        rows = stored(spark, path, part).drop("folder")
        each = set_digest(rows.select("shard", digest(part, snapshot, row_hash(rows, "shard")).alias("h")), "h", ["shard"]).select(F.lit(part).alias("part"), "shard", "n", "digest")
        out = each if out is None else out.unionByName(each)
    return out


def tampered(spark: SparkSession, base: str, p: Product, snapshot: str) -> DataFrame:
    """(part, shard) of a version that is not as it was published; part 'manifest' if the record of the shards itself was changed."""
    path = f"{base}/{p.name}/snapshot={snapshot}"
    shards = spark.read.parquet(f"{path}/shards")
    now = attested(spark, path, snapshot).select("part", "shard", F.col("n").alias("m"), F.col("digest").alias("d"))
    bad = shards.join(now, ["part", "shard"], "full").where("n is null or m is null or n <> m or digest <> d").select("part", "shard")
    whole = set_digest(shards.select(digest(F.col("part"), F.col("shard"), F.col("n").cast("string"), F.col("digest")).alias("h")), "h").select(F.col("digest").alias("w"))
    manifest = spark.read.parquet(f"{path}/manifest").join(whole, F.col("content_digest") == F.col("w"), "left_anti")
    return bad.unionByName(manifest.select(F.lit("manifest").alias("part"), F.lit("").alias("shard")))


def indexed(spark: SparkSession, base: str, p: Product, snapshot: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hot, cold, sidecar) of a finished version; raises if it has no manifest. ``hot`` has a ``prefix``, as many digits as the manifest's ``depth``."""
    path = f"{base}/{p.name}/snapshot={snapshot}"
    spark.read.parquet(f"{path}/manifest")
    return stored(spark, path, "hot").drop("shard", "folder"), stored(spark, path, "cold").drop("shard", "folder"), stored(spark, path, "sidecar").drop("shard", "folder")
