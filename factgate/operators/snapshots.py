"""Snapshots: ordinals by hash order, handles, bitmaps of ordinals, and comparison of versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.shared import durable


def numbered(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """Rows numbered from 0 in the order of the columns, without a sort in one task. Nulls come first.

    Rows are dealt to ranges by samples of their values, whatever these look like, and sorted within each; a row's place
    in its range is where Spark's running number within the partition puts it, and the sizes of all earlier ranges, a
    number each, are added. The sorted rows stand on storage, so that a repeated task sees the same ranges.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    rows = durable(sorted_)
    part, at = F.shiftrightunsigned("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__o"))
    return rows.withColumn("__p", part).join(before, "__p").select(*df.columns, (at + F.col("__o")).cast("bigint").alias(name))


def snapshot_facts(df: DataFrame, namespace: str, snapshot: str, key: Column, columns: dict[str, str]) -> DataFrame:
    """(fact_hash, kind, entity_key, field): a row fact and a cell fact for each column of every row."""
    from ..functions.canonical import cell_fact, row_fact

    facts = [F.struct(row_fact(namespace, snapshot, F.col("entity_key")).alias("fact_hash"), F.lit("base-row").alias("kind"), F.lit(None).cast("string").alias("field"))]
    facts += [F.struct(cell_fact(namespace, snapshot, F.col("entity_key"), c, t, F.col(c)).alias("fact_hash"), F.lit("base-cell").alias("kind"), F.lit(c).alias("field")) for c, t in columns.items()]
    rows = df.select(key.alias("entity_key"), *[F.col(c) for c in columns])
    return rows.select("entity_key", F.explode(F.array(*facts)).alias("f")).select("f.fact_hash", "f.kind", "entity_key", "f.field")


def compile_ordinals(facts: DataFrame) -> DataFrame:
    """Facts with dense ordinals in hash order: a dictionary between facts and whole numbers.

    Hashes are lower-case hex, as ``digest`` makes them, and anything else is refused. They are sorted and stored as
    bytes, which have the same order and half the size.
    """
    h = F.col("fact_hash")
    raw = F.when(h.isNull(), None).when(F.lower(F.hex(F.unhex(h))) == h, F.unhex(h)).otherwise(F.raise_error(F.concat(F.lit("not a hash: "), h)))
    return numbered(facts.withColumn("fact_hash", raw), ["fact_hash"]).withColumn("fact_hash", F.lower(F.hex("fact_hash")))


def bitmap(refs: DataFrame, ordinal: str = "ordinal", by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by..., bucket, bits): sets of ordinals as compressed pages of 32768 bits."""
    return refs.groupBy(*by, F.bitmap_bucket_number(F.col(ordinal)).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(ordinal))).alias("bits"))


def bitmap_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("bucket").agg(F.count("*").alias("n"), F.bitmap_and_agg("bits").alias("bits")).where("n = 2").drop("n")


def cardinality(pages: DataFrame) -> DataFrame:
    return pages.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def novelty(candidate: DataFrame, history: DataFrame) -> DataFrame:
    """How many ordinals of the candidate the history lacks: what the union has more than the history."""
    both = candidate.select("bucket", "bits", F.lit(0).cast("long").alias("known")).unionByName(history.select("bucket", "bits", F.bitmap_count("bits").alias("known")))
    page = both.groupBy("bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("u"), F.sum("known").alias("n"))
    return page.agg(F.coalesce(F.sum(F.col("u") - F.col("n")), F.lit(0)).alias("novel"))


def contains(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """(ordinal, held): which ordinals a set of pages has."""
    at = refs.select("ordinal").distinct()
    return at.join(expand(pages, at).withColumn("held", F.lit(True)), "ordinal", "left").select("ordinal", F.coalesce("held", F.lit(False)).alias("held"))


def unequal_pages(a: DataFrame, b: DataFrame) -> DataFrame:
    """Buckets whose pages differ; none if the sets are equal. A page without a bit is no page."""
    some = lambda p, c: p.where(F.bitmap_count("bits") > 0).select("bucket", F.col("bits").alias(c))
    return some(a, "a").join(some(b, "b"), "bucket", "full").where("not (a <=> b)").select("bucket")


def portable(pages: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by..., bucket, n, digest): each page's size and the digest of its bits, by which pages can be compared elsewhere."""
    return pages.select(*by, "bucket", F.bitmap_count("bits").alias("n"), F.sha2("bits", 256).alias("digest"))


def merged_index(*dictionaries: DataFrame) -> DataFrame:
    """(fact_hash, segments, position): the hashes of several dictionaries (segment, fact_hash) in hash order, each once with all that have it."""
    every = reduce(DataFrame.unionByName, [d.select("segment", "fact_hash") for d in dictionaries])
    return numbered(every.groupBy("fact_hash").agg(F.array_sort(F.collect_set("segment")).alias("segments")), ["fact_hash"], "position")


def expand(pages: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The facts of a set of pages: bits are tested against the dictionary's rows of the same page."""
    at = dictionary.withColumn("bucket", F.bitmap_bucket_number("ordinal")).withColumn("bit", F.bitmap_bit_position("ordinal"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return at.join(pages, "bucket").where(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1).select(*dictionary.columns)


def out_of_bounds(refs: DataFrame, segments: DataFrame) -> DataFrame:
    """References (segment, ordinal) to unknown segments or beyond their sizes (segment, size)."""
    return refs.join(segments, "segment", "left").where("size is null or ordinal < 0 or ordinal >= size").select("segment", "ordinal")


def handle_mismatches(handles: DataFrame, index: DataFrame) -> DataFrame:
    """Handles (handle, entity_key) of a sidecar that the index lacks or has for another key, and the reverse."""
    a, b = handles.select("handle", F.col("entity_key").alias("sidecar_key")), index.select("handle", F.col("entity_key").alias("index_key"))
    return a.join(b, "handle", "full").where(~F.col("sidecar_key").eqNullSafe(F.col("index_key")))


def version_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(inserted, deleted, updated, unchanged) between two versions of one table."""
    rest = [c for c in old.columns if c not in key]
    a, b = old.select(*key, F.struct(*rest).alias("a"), F.lit(1).alias("in_a")), new.select(*key, F.struct(*rest).alias("b"), F.lit(1).alias("in_b"))
    both = a.join(b, key, "full")
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return both.agg(
        one(F.col("in_a").isNull()).alias("inserted"),
        one(F.col("in_b").isNull()).alias("deleted"),
        one(F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & ~F.col("a").eqNullSafe(F.col("b"))).alias("updated"),
        one(F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & F.col("a").eqNullSafe(F.col("b"))).alias("unchanged"),
    )


def next_version(df: DataFrame, key: str, price: str, percent: int) -> DataFrame:
    """A later version: the price of every row whose key modulo 100 is below ``percent`` goes up by one."""
    kind = dict(df.dtypes)[price]
    return df.withColumn(price, F.when(F.col(key) % 100 < percent, F.col(price) + F.lit(1)).otherwise(F.col(price)).cast(kind))


def churned(df: DataFrame, key: str, percent: int) -> DataFrame:
    """A later version: rows whose key modulo 100 is below ``percent`` are gone, and as many new ones have their values under new keys.

    New keys are the old ones moved beyond the largest, so they clash with none; that largest key is all that is computed first.
    """
    leaving = F.col(key) % 100 < percent
    top = df.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    new = df.where(leaving).withColumn(key, (F.col(key) + F.lit(top + 1)).cast(dict(df.dtypes)[key]))
    return df.where(~leaving).unionByName(new)


def hot_and_cold(dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A dictionary's hashes with their ordinals, which settlement needs, apart from the payloads, which only decoding needs."""
    rest = [c for c in dictionary.columns if c not in ("fact_hash", "ordinal")]
    return dictionary.select("ordinal", "fact_hash"), dictionary.select("ordinal", *rest)


def decode(refs: DataFrame, cold: DataFrame) -> DataFrame:
    """The payloads of ordinals."""
    return refs.select("ordinal").distinct().join(cold, "ordinal")


def manifest_digest(publications: DataFrame) -> DataFrame:
    """(n, digest) of a set of publications (name, snapshot, content_digest), whatever their order."""
    from ..functions.canonical import digest
    from .digest import set_digest

    return set_digest(publications.select(digest(F.col("name"), F.col("snapshot"), F.col("content_digest")).alias("h")), "h")


def resolve(requests: DataFrame, manifest: DataFrame) -> DataFrame:
    """(request, name, snapshot, content_digest, ok): the publication a request is pinned to; not ok if it is gone or changed."""
    m = manifest.select("name", "snapshot", F.col("content_digest").alias("__d"))
    return requests.join(m, ["name", "snapshot"], "left").select("request", "name", "snapshot", "content_digest", F.coalesce(F.col("__d") == F.col("content_digest"), F.lit(False)).alias("ok"))
