"""A stored set of hashes as a radix tree: small leaves, kept in order; a union rewrites the leaves that it adds to.

Hashes are hex texts. A leaf is named by the shortest prefix, of two digits at least, under which the set has no more than
LEAF members, so the tree, and with it the digest of the set, depends on the members alone and not on how they came.
Two digits name a block. A version has

* ``members``: the hashes of the leaves that were written with it, in order of leaves, in folders by the first digit,
* ``nodes``: for each block that it touched, all leaves and inner nodes with sizes, digests, and the version that wrote a leaf, in order,
* ``manifest``: for every block the version of its nodes, its size and digest; it comes last, and is at most 256 rows.

Versions are immutable, so older ones stay readable and a writer that was cut off leaves nothing that a reader would see.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..streaming.shared import durable
from .digest import join_sorted

#: Members of a leaf at most; digits of a block's name.
LEAF, BLOCK = 4096, 2
NODE = "prefix string, n long, digest string, written int"
#: Leaves that are looked for by a list of their names; more are joined.
LISTED = 256


@dataclass(frozen=True)
class Change:
    """What a union did: members that were new, leaves and members written, blocks touched, members read."""

    new: int
    leaves: int
    written: int
    blocks: int
    read: int


def union(spark: SparkSession, path: str, candidates: DataFrame, base: int | None, version: int, split: int = LEAF) -> Change:
    """Writes ``version`` of the set: that of ``base`` (None: empty) and the column ``fact_hash`` of the candidates.

    Everything about a block is settled where its rows meet: candidates, the names of its leaves and their members are
    shuffled once, by block; what is new, which leaves that changes and how they divide follows from their order there.
    """
    asked = candidates.select("fact_hash").where(F.col("fact_hash").isNotNull()).withColumn("block", F.substring("fact_hash", 1, BLOCK))
    old = nodes_of(spark, path, base, asked) if base is not None else None
    rows = asked.select("block", F.col("fact_hash").alias("at"), F.lit(None).cast("string").alias("leaf"), F.lit(True).alias("asked"), F.lit(False).alias("held"))
    if old is not None:
        leaves_then = durable(old.where("written is not null"))
        rows = rows.unionByName(leaves_then.select("block", F.col("prefix").alias("at"), F.col("prefix").alias("leaf"), F.lit(False).alias("asked"), F.lit(False).alias("held")))
        few = asked.limit(leaves_then.count()).count() < leaves_then.count()
        wanted = in_leaves(asked, old).where("written is not null") if few else leaves_then.withColumnRenamed("prefix", "leaf")
        held = members_of(spark, path, wanted)
        if held is not None:
            rows = rows.unionByName(held.select(F.substring("leaf", 1, BLOCK).alias("block"), F.col("fact_hash").alias("at"), "leaf", F.lit(False).alias("asked"), F.lit(True).alias("held")))
    rows = rows.repartition("block").groupBy("block", "at").agg(F.max("leaf").alias("leaf"), F.max("asked").alias("asked"), F.max("held").alias("held"))
    placed = neighboured(rows) if old is not None else rows.withColumn("leaf", F.col("block"))
    own = Window.partitionBy("block", "was")
    fresh = F.max(F.col("asked") & ~F.col("held")).over(own).alias("fresh")
    met = placed.withColumnRenamed("leaf", "was").select("*", fresh, F.max("asked").over(own).alias("touched")).where("touched and (asked or held)")
    groups = divided(met.withColumnRenamed("at", "fact_hash"), split).groupBy("block", "was", "leaf", "fresh").agg(F.count_if("held").alias("before"), F.sort_array(F.collect_list(F.when(F.col("fresh"), F.col("fact_hash")))).alias("hashes"))
    groups = durable(groups)
    done = groups.where("fresh")
    mine = f"{path}/members/version={version}"
    done.select("leaf", F.explode("hashes").alias("fact_hash"), F.substring("leaf", 1, 1).alias("part")).sortWithinPartitions("part", "leaf").write.mode("overwrite").partitionBy("part").parquet(mine)
    leaves = durable(done.select(F.col("leaf").alias("prefix"), F.size("hashes").cast("long").alias("n"), F.sha2(F.array_join("hashes", ""), 256).alias("digest"), F.lit(version).alias("written")))
    leaves_now = leaves
    if old is not None:
        changed = done.select(F.col("was").alias("prefix")).distinct()
        blocks = done.select("block").distinct()
        kept = leaves_then.join(changed, "prefix", "left_anti").join(blocks, "block", "left_semi")
        leaves_now = durable(leaves.unionByName(kept.select("prefix", "n", "digest", "written")))
    tree = with_inner(leaves_now)
    tree.repartitionByRange("prefix").sortWithinPartitions("prefix").write.mode("overwrite").parquet(f"{path}/nodes/version={version}")
    nodes = spark.read.schema(NODE).parquet(f"{path}/nodes/version={version}").withColumn("block", F.substring("prefix", 1, BLOCK))
    own = F.length("prefix") == BLOCK
    top = nodes.groupBy("block").agg(F.lit(version).alias("version"), F.max(F.when(own, F.col("n"))).alias("n"), F.max(F.when(own, F.col("digest"))).alias("digest"), F.max(F.length("prefix")).alias("depth"))
    if base is not None:
        top = top.unionByName(manifest(spark, path, base).join(nodes.select("block").distinct(), "block", "left_anti"))
    top.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
    sizes = leaves.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_distinct(F.substring("prefix", 1, BLOCK))).first()
    read, replaced = groups.agg(F.coalesce(F.sum("before"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("fresh"), F.col("before"))), F.lit(0))).first()
    return Change(sizes[1] - replaced, sizes[0], sizes[1], sizes[2], read)


def manifest(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(block, version, n, digest, depth) of a finished version; raises if there is none."""
    return spark.read.parquet(f"{path}/manifest/version={version}").select("block", "version", "n", "digest", "depth")


def root(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(n, digest) of the whole set, from the manifest alone."""
    return manifest(spark, path, version).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), join_sorted(F.concat("block", "digest")).alias("digest"))


def nodes_of(spark: SparkSession, path: str, version: int, asked: DataFrame | None = None) -> DataFrame | None:
    """(prefix, n, digest, written, block) of the blocks that ``asked`` names (all without it); None if the set has none of them."""
    top = manifest(spark, path, version)
    if asked is not None:
        top = top.join(asked.select("block").distinct(), "block", "left_semi")
    held: dict[int, list[str]] = {}
    for r in top.collect():  # a row for each block, so 256 at most
        held.setdefault(r["version"], []).append(r["block"])
    parts = []
    for v, blocks in sorted(held.items()):
        rows = spark.read.schema(NODE).parquet(f"{path}/nodes/version={v}").where((F.col("prefix") >= min(blocks)) & (F.col("prefix") < max(blocks) + "g"))
        parts.append(rows.withColumn("block", F.substring("prefix", 1, BLOCK)).where(F.col("block").isin(blocks)))
    return reduce(DataFrame.unionByName, parts) if parts else None


def in_leaves(asked: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """(fact_hash, block, leaf, n, written): the leaf where each hash belongs; one that doesn't exist yet has no members."""
    if nodes is None:
        return asked.select("fact_hash", "block", F.col("block").alias("leaf"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("written")).distinct()
    names = nodes.where("written is not null").select("block", F.col("prefix").alias("at"), F.struct("prefix", "n", "written").alias("stored"), F.lit(False).alias("asked"))
    hashes = asked.select("block", F.col("fact_hash").alias("at"), F.lit(None).cast(names.schema["stored"].dataType).alias("stored"), F.lit(True).alias("asked"))
    rows = hashes.unionByName(names).repartition("block").groupBy("block", "at").agg(F.max("stored").alias("stored"), F.max("asked").alias("asked"))
    upto = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    met = neighboured(rows.select("*", F.col("stored.prefix").alias("leaf"), F.last("stored", True).over(upto).alias("near"))).where("asked")
    inside = F.col("near.prefix") == F.col("leaf")
    return met.select(F.col("at").alias("fact_hash"), "block", "leaf", F.when(inside, F.col("near.n")).otherwise(0).alias("n"), F.when(inside, F.col("near.written")).alias("written"))


def neighboured(rows: DataFrame) -> DataFrame:
    """Rows (block, at, leaf, ...), of which the leaves' names have their ``leaf`` and hashes none, with the leaf where each hash belongs.

    No leaf's name begins another's. So if any leaf holds a hash, it is the last whose name isn't after the hash. If none
    does, the inner node below which its leaf would be is what the hash shares with the leaf before it or the one after.
    """
    upto = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("block").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("__after", F.last("leaf", True).over(down)).withColumn("__before", F.last("leaf", True).over(upto))
    inside = F.coalesce(F.col("leaf"), F.when(F.col("at").startswith(F.col("__before")), F.col("__before")))
    met = met.withColumn("leaf", inside).withColumn("__at", F.when(F.col("leaf").isNull(), F.col("at")))
    missing = F.substring("at", F.lit(1), F.greatest(shared("__at", "__before"), shared("__at", "__after"), F.lit(BLOCK - 1)) + 1)
    return met.withColumn("leaf", F.when(F.col("leaf").isNull(), missing).otherwise(F.col("leaf"))).select(*rows.columns)


def shared(a: str, b: str) -> Column:
    """The number of leading digits that two columns share, 127 at most; 0 where one is null. Beyond 8 they are compared in halves."""
    first = lambda k: F.substring(a, 1, k) == F.substring(b, 1, k)
    piece = lambda c, k, step: F.substring(c, k + 1, step)
    same = lambda k, step: (F.length(piece(a, k, step)) == step) & (piece(a, k, step) == piece(b, k, step))
    far = F.aggregate(F.array(*[F.lit(2**j) for j in range(6, -1, -1)]), F.lit(0), lambda k, step: F.when(same(k, step), k + step).otherwise(k))
    near = reduce(Column.__add__, [(F.length(a) >= k).cast("int") * (F.length(b) >= k).cast("int") * first(k).cast("int") for k in range(1, 8)])
    return F.when(F.col(a).isNull() | F.col(b).isNull(), 0).when(first(8), far).otherwise(near)


def members_of(spark: SparkSession, path: str, placed: DataFrame) -> DataFrame | None:
    """(leaf, fact_hash) of the stored leaves that hashes were placed in; no other folder is read, and no other row group of few leaves."""
    wanted = durable(placed.where("written is not null").select("leaf", "written", "block").distinct())
    folders = wanted.select("written", F.substring("block", 1, 1).alias("part")).distinct().collect()  # 16 for each version that wrote in them
    if not folders:
        return None
    names = wanted.select("leaf").limit(LISTED + 1).collect()
    parts = []
    for version in sorted({r["written"] for r in folders}):
        paths = [f"{path}/members/version={version}/part={r['part']}" for r in folders if r["written"] == version]
        rows = spark.read.schema("leaf string, fact_hash string").parquet(*paths)
        rows = rows.where(F.col("leaf").isin([r["leaf"] for r in names])) if len(names) <= LISTED else rows
        parts.append(rows.join(wanted.where(F.col("written") == version).select("leaf"), "leaf", "left_semi"))
    return reduce(DataFrame.unionByName, parts)


def divided(rows: DataFrame, split: int) -> DataFrame:
    """Rows (block, was, fact_hash, ...) with ``leaf``: the shortest prefix, of at least the length of ``was``, that ``split`` rows or fewer of it share.

    More than ``split`` rows share a prefix where, in their order, a row and the one ``split`` places on do. So a row's
    leaf has one digit more than the most that such two share among those that it stands between. That most is over a
    sliding stretch of rows, found as running maxima from both ends of blocks as long, so that it is one pass for any split.
    """
    own = Window.partitionBy("block", "was").orderBy("fact_hash")
    met = rows.select("*", (F.row_number().over(own) - 1).alias("__r"), F.lead("fact_hash", split).over(own).alias("__far"))
    met = met.withColumn("__k", F.when(F.col("__far").isNotNull(), shared("fact_hash", "__far"))).drop("__far").withColumn("__s", F.floor(F.col("__r") / (split + 1)))
    stretch = Window.partitionBy("block", "was", "__s")
    met = met.withColumn("__down", F.max("__k").over(stretch.orderBy(F.desc("fact_hash")).rowsBetween(Window.unboundedPreceding, 0)))
    met = met.withColumn("__up", F.max("__k").over(stretch.orderBy("fact_hash").rowsBetween(Window.unboundedPreceding, 0)))
    most = F.greatest(F.col("__up"), F.lag("__down", split).over(own))
    met = met.withColumn("__k", most)
    depth = F.greatest(F.length("was"), F.col("__k") + 1)
    return met.withColumn("leaf", F.substring("fact_hash", F.lit(1), depth)).select(*rows.columns, "leaf")


def with_inner(leaves: DataFrame) -> DataFrame:
    """The leaves (prefix, n, digest, written) and the inner nodes over them, up to the blocks; an inner digest is of its children's."""
    out, level = leaves, None
    deepest = leaves.agg(F.max(F.length("prefix"))).first()[0] or BLOCK
    for k in range(deepest, BLOCK, -1):
        children = leaves.where(F.length("prefix") == k)
        children = children if level is None else children.unionByName(level)
        level = children.groupBy(F.substring("prefix", 1, k - 1).alias("p")).agg(F.sum("n").alias("n"), join_sorted(F.concat(F.substring("prefix", k, 1), "digest")).alias("digest"))
        level = durable(level.select(F.col("p").alias("prefix"), "n", "digest", F.lit(None).cast("int").alias("written")))
        out = out.unionByName(level)
    return out


def members(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(fact_hash) of the whole set."""
    nodes = nodes_of(spark, path, version)
    if nodes is None:
        return spark.createDataFrame([], "fact_hash string")
    leaves = nodes.where("written is not null").select(F.col("prefix").alias("leaf"), "written", "block")
    return members_of(spark, path, leaves).select("fact_hash")


def difference(spark: SparkSession, path: str, version: int, candidates: DataFrame) -> DataFrame:
    """(fact_hash): the candidates that a version lacks; only the leaves where they belong are read."""
    asked = durable(candidates.select("fact_hash").where(F.col("fact_hash").isNotNull()).distinct().withColumn("block", F.substring("fact_hash", 1, BLOCK)))
    placed = durable(in_leaves(asked, nodes_of(spark, path, version, asked)))
    held = members_of(spark, path, placed)
    return placed.select("fact_hash") if held is None else placed.join(held, "fact_hash", "left_anti").select("fact_hash")


def damaged(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(prefix, what) where a stored version contradicts itself: leaves whose members were changed, inner nodes or blocks whose digests don't follow."""
    nodes = nodes_of(spark, path, version)
    if nodes is None:
        return spark.createDataFrame([], "prefix string, what string")
    leaves = durable(nodes.where("written is not null"))
    rows = members_of(spark, path, leaves.select(F.col("prefix").alias("leaf"), "written", "block"))
    real = rows.groupBy(F.col("leaf").alias("prefix")).agg(F.count("*").alias("m"), join_sorted("fact_hash").alias("d"), F.min(F.col("fact_hash").startswith(F.col("leaf"))).alias("inside"))
    bad = leaves.join(real, "prefix", "left").where("m is null or m <> n or d <> digest or not inside").select("prefix", F.lit("leaf").alias("what"))
    inner = with_inner(leaves.select("prefix", "n", "digest", "written")).where("written is null").select("prefix", F.col("n").alias("m"), F.col("digest").alias("d"))
    have = nodes.where("written is null").join(inner, "prefix", "full").where("n is null or m is null or n <> m or d <> digest").select("prefix", F.lit("inner").alias("what"))
    top = nodes.where(F.length("prefix") == BLOCK).select("prefix", F.col("n").alias("m"), F.col("digest").alias("d"))
    blocks = manifest(spark, path, version).join(top, F.col("block") == F.col("prefix"), "full").where("n is null or m is null or n <> m or d <> digest").select(F.coalesce("block", "prefix").alias("prefix"), F.lit("block").alias("what"))
    return bad.unionByName(have).unionByName(blocks)
