"""Comparison of results and statistics of measurements."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical_row
from .digest import set_digest


def row_hash(df: DataFrame, without: str | None = None) -> Column:
    """Identity of a row's values by column name and type; null is no text."""
    return F.sha2(canonical_row({c: t for c, t in df.dtypes if c != without}), 256)


def equal_unordered(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_a, only_b): rows, counted with repetition, that only one result has."""
    n = lambda df, x: df.select(row_hash(df).alias("h")).groupBy("h").agg(F.count("*").alias(x))
    both = n(a, "a").join(n(b, "b"), "h", "full").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return both.agg(F.coalesce(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))), F.lit(0)).alias("only_b"))


def equal_ordered(a: DataFrame, b: DataFrame, position: str) -> DataFrame:
    """Positions at which two ordered results differ; each has its position as a column."""
    h = lambda df, x: df.select(position, row_hash(df, position).alias(x))
    return h(a, "a").join(h(b, "b"), position, "full").where("not (a <=> b)").select(position)


def content_digest(df: DataFrame) -> DataFrame:
    """(n, digest) of a table's distinct rows, whatever their order."""
    return set_digest(df.select(row_hash(df).alias("h")), "h")


def quantiles(samples: DataFrame, by: list[str], value: str, at: list[float]) -> DataFrame:
    """Interpolated quantiles (linear between order statistics) by group."""
    names = [f"p{round(q * 100)}" for q in at]
    return samples.groupBy(*by).agg(F.count("*").alias("n"), F.percentile(value, [float(q) for q in at]).alias("q")).select(*by, "n", *[F.col("q")[k].alias(x) for k, x in enumerate(names)])


def bootstrap_median(samples: DataFrame, value: str, draws: int = 200, seed: int = 1) -> DataFrame:
    """(lo, hi): a 95 % interval of the median from resamples; draws are hashes of (resample, position), so they repeat.

    Positions are in order of the values, so the middle of a resample is found among the positions drawn: these are tallied
    by stretches of about the root of their number, then those in the stretch with the middle one by one. Draws are made
    where they are tallied and never meet the values; only the two middle positions of each resample do. Nulls, which come
    first, are no values.
    """
    from .snapshots import numbered

    spark, rows = samples.sparkSession, numbered(samples.select(value), [value], "at")
    n, nulls = rows.agg(F.count("*"), F.count_if(F.col(value).isNull())).first()
    picks = spark.range(n).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("resample")).select("resample", F.pmod(F.xxhash64("resample", "k", F.lit(seed)), F.lit(max(n, 1))).alias("at"))
    picks = picks.where(F.col("at") >= nulls).withColumn("stretch", F.floor(F.col("at") / (math.isqrt(n) + 1)))
    whole = Window.partitionBy("resample")
    upto = lambda c: F.sum("c").over(whole.orderBy(c).rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    tally = picks.groupBy("resample", "stretch").agg(F.count("*").alias("c")).select("*", F.sum("c").over(whole).alias("m"), upto("stretch").alias("before"))
    tally = tally.select("resample", "stretch", "c", "before", F.expr("(m - 1) div 2").alias("low"), F.expr("m div 2").alias("high"))
    middle = tally.where("before <= high and before + c > low").select("resample", "stretch", "before", "low", "high")
    near = picks.join(F.broadcast(middle), ["resample", "stretch"])  # two rows a resample at most
    each = near.groupBy("resample", "at").agg(F.count("*").alias("c"), *[F.first(x).alias(x) for x in ("before", "low", "high")])
    # of two stretches the second begins where the first ends
    each = each.select("*", (upto("at") + F.min("before").over(whole)).alias("from"))
    at = lambda c: F.max(F.when((F.col("from") <= F.col(c)) & (F.col("from") + F.col("c") > F.col(c)), F.col("at")))
    places = each.groupBy("resample").agg(F.array(at("low"), at("high")).alias("at")).select("resample", F.explode("at").alias("at"))
    medians = rows.join(F.broadcast(places), "at").groupBy("resample").agg(F.sum(F.col(value).cast("double") * 0.5).alias("m"))
    return medians.agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))


def overlap(candidate: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """(candidate, history, shared, percent) of two sets of keys."""
    both = candidate.select(key).distinct().withColumn("c", F.lit(1)).join(history.select(key).distinct().withColumn("h", F.lit(1)), key, "full")
    out = both.agg(F.count("c").alias("candidate"), F.count("h").alias("history"), F.count(F.when(F.col("c").isNotNull() & F.col("h").isNotNull(), 1)).alias("shared"))
    return out.withColumn("percent", F.when(F.col("candidate") > 0, F.round(F.col("shared") * 100.0 / F.col("candidate"), 4)))
