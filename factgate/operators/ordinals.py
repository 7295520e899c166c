"""Accounting on ordinals: a published row is a whole number, a set of facts is pages of such numbers, and hashes are made only to read facts out.

A product's rows are numbered in the order of their keys. Its facts lie in planes: one of the rows themselves and one for
each column, so a fact is a plane and a row's ordinal, and no fact needs a table to be found. A page holds up to 32,768
ordinals of a plane as a bitmap; stored pages with few are arrays of two-byte positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.canonical import cell_fact, row_fact
from ..plans.build import paged_provenance
from ..plans.plan import Plan
from ..sources.products import PRODUCTS, entity_key, load
from .facts import influence_columns, role_column
from .snapshots import numbered

#: The plane of the rows themselves, bits of a page, and members up to which a stored page is an array.
ROWS, BITS, SPARSE = "", 32_768, 2_047
PAGE = ["product", "plane", "bucket"]


def publish(spark: SparkSession, sf_dir: str, product: str, base: str) -> None:
    """Writes a product's typed rows with their ordinals, in order."""
    numbered(load(spark, sf_dir, product), list(PRODUCTS[product].key)).write.mode("errorifexists").parquet(f"{base}/{product}")


def indexed(spark: SparkSession, base: str, name: str, role: str | None = None) -> DataFrame:
    """A published product under a role, like ``products.scan``, with ``role__ordinal``; the key's text is made only where it is asked for."""
    p, role = PRODUCTS[name], role or name
    df = spark.read.parquet(f"{base}/{name}")
    return df.select(entity_key(p).alias(f"{role}__key"), F.col("ordinal").alias(f"{role}__ordinal"), *[F.col(c).alias(f"{role}__{c}") for c in p.columns])


def influence_pages(spark: SparkSession, base: str, plan: Plan, scope: dict[str, object] | None = None) -> DataFrame:
    """(product, plane, bucket, bits): the facts of ``facts.influence``, of all sources in one pass over the proofs.

    A source's evidence is the same columns of all its rows that took part, so one set of ordinals is made for each source,
    and stands for all its planes. Ordinals are made distinct, then dealt by pages and only then combined: a join deals
    rows by its own keys, so that pages combined before would be nearly all pages in nearly every task.
    """
    wanted = {role: list(dict.fromkeys(role_column(c) if c else ROWS for c in cols)) for role, cols in influence_columns(plan).items()}
    proofs = paged_provenance(spark, base, plan, scope, indexed, ("ordinal",))
    rows = proofs.select(F.explode(F.array(*[F.struct(F.lit(plan.sources[r]).alias("product"), F.col(f"{r}__ordinal").alias("ordinal")) for r in wanted])).alias("s")).select("s.*")
    rows = rows.distinct().withColumn("bucket", F.bitmap_bucket_number("ordinal")).repartition("product", "bucket")
    pages = rows.groupBy("product", "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("ordinal")).alias("bits"))
    planes = F.lit(None)
    for role, columns in wanted.items():
        planes = F.when(F.col("product") == plan.sources[role], F.array(*[F.lit(c) for c in columns])).otherwise(planes)
    return pages.select("product", F.explode(planes).alias("plane"), "bucket", "bits")


def cardinalities(pages: DataFrame, by: list[str] = ["product", "plane"]) -> DataFrame:  # noqa: B006
    """(by..., n): how many facts there are."""
    return pages.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias("n"))


def united(*sets: DataFrame) -> DataFrame:
    """The facts of several sets."""
    every = sets[0]
    for s in sets[1:]:
        every = every.unionByName(s)
    return every.groupBy(*PAGE).agg(F.bitmap_or_agg("bits").alias("bits"))


def novelty(candidate: DataFrame, history: DataFrame) -> DataFrame:
    """(product, plane, n): facts of the candidate that the history lacks; pages meet by their names only."""
    both = candidate.select(*PAGE, "bits", F.lit(0).cast("long").alias("known")).unionByName(history.select(*PAGE, "bits", F.bitmap_count("bits").alias("known")))
    page = both.groupBy(*PAGE).agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("all"), F.sum("known").alias("known"))
    return page.groupBy("product", "plane").agg(F.sum(F.col("all") - F.col("known")).alias("n"))


def page_charges(stream: DataFrame) -> DataFrame:
    """(root, seq, actual, charged) of requests given as pages (root, seq, product, plane, bucket, bits), if all are accepted.

    What a page has gathered up to each request is a running union; a request is charged by how much that grows. A
    window holds one page of a root, over all requests that touch it.
    """
    each = stream.groupBy("root", "seq", *PAGE).agg(F.bitmap_or_agg("bits").alias("bits"))
    w = Window.partitionBy("root", *PAGE).orderBy("seq")
    upto = each.select("root", "seq", *PAGE, F.bitmap_count("bits").alias("actual"), F.bitmap_count(F.bitmap_or_agg("bits").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("held"))
    grown = upto.select("root", "seq", "actual", (F.col("held") - F.coalesce(F.lag("held").over(w), F.lit(0))).alias("charged"))
    return grown.groupBy("root", "seq").agg(F.sum("actual").alias("actual"), F.sum("charged").alias("charged"))


# -- stored pages and reading facts out ------------------------------------------------------------------------------


def positions(bits: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))


def packed(pages: DataFrame) -> DataFrame:
    """(product, plane, bucket, n, data): pages as they are stored; ``data`` has two bytes a member, or the bitmap if there are very many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, data = [], []
            for bits in batch.column(3).to_pylist():
                at = positions(bits)
                n.append(len(at))
                data.append(at.astype("<u2").tobytes() if len(at) <= SPARSE else bits)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(data, pa.binary())], [*PAGE, "n", "data"])

    return pages.select(*PAGE, "bits").mapInArrow(run, "product string, plane string, bucket long, n long, data binary")


def unpacked(stored: DataFrame) -> DataFrame:
    """The pages of stored ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, data in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if n <= SPARSE:
                    on = np.zeros(BITS, bool)
                    on[np.frombuffer(data, "<u2")] = True
                    data = np.packbits(on, bitorder="little").tobytes()
                out.append(data)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], [*PAGE, "bits"])

    return stored.select(*PAGE, "n", "data").mapInArrow(run, "product string, plane string, bucket long, bits binary")


def ordinals_of(pages: DataFrame) -> DataFrame:
    """(product, planes, ordinal): each row once with the planes that have it; planes with the same page are read together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at = positions(batch.column(2)[k].as_py())
                bucket = batch.column(1)[k].as_py()
                ordinal = at + (bucket - 1) * BITS + 1 if bucket else at
                own = pa.array(np.full(len(at), k))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(3).take(own), pa.array(ordinal.astype(np.int64))], ["product", "planes", "ordinal"])

    same = pages.groupBy("product", "bucket", "bits").agg(F.array_sort(F.collect_set("plane")).alias("planes"))
    return same.mapInArrow(run, "product string, planes array<string>, ordinal long")


def facts_of(spark: SparkSession, base: str, pages: DataFrame) -> DataFrame:
    """(fact_hash): the facts of a set of pages, the same hashes as elsewhere, from the published rows."""
    rows, out = ordinals_of(pages), None
    for name in sorted(r["product"] for r in pages.select("product").distinct().collect()):  # products of one set: a few
        p = PRODUCTS[name]
        # a page is small, the rows that it stands for are not: by the pages' size Spark would broadcast them
        held = rows.where(F.col("product") == name).select("ordinal", "planes").hint("merge").join(spark.read.parquet(f"{base}/{name}"), "ordinal")
        key = F.col("k")

        def fact(plane: Column) -> Column:
            found = row_fact(p.namespace, p.snapshot, key)  # noqa: B023
            for c, kind in p.columns.items():  # noqa: B023
                found = F.when(plane == c, cell_fact(p.namespace, p.snapshot, key, c, kind, F.col(c))).otherwise(found)  # noqa: B023
            return found

        long = held.withColumn("k", entity_key(p)).select(F.explode("planes").alias("plane"), "k", *p.columns).select(fact(F.col("plane")).alias("fact_hash"))
        out = long if out is None else out.unionByName(long)
    return out if out is not None else spark.createDataFrame([], "fact_hash string")
