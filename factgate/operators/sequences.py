"""Sequences of questions, each settled against what the steps before it have learned, in one job for all of them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.plan import Plan, validate
from .facts import base_cells, fact_of, observation, release
from .footprint import outcome, plan_text
from .ledger import DIMS, settle

#: Plans that one whole number marks.
WORD = 62


@dataclass(frozen=True)
class Step:
    """One question of a sequence; the steps of a sequence count as requests of one root, in the order given."""

    sequence: str
    name: str
    plan: Plan


def placed(steps: Iterable[Step]) -> list[tuple[Step, int]]:
    """Each step with its place in its sequence."""
    places: dict[str, int] = {}
    out = []
    for s in steps:
        places[s.sequence] = places.get(s.sequence, -1) + 1
        out.append((s, places[s.sequence]))
    return out


def observed(spark: SparkSession, sf_dir: str, steps: Iterable[Step]) -> DataFrame:
    """(root, seq, dim, fact_hash): what every step exposes, under its sequence and place.

    Plans are validated before anything runs. Those with one canonical text are one question, however they are spelt and
    in whichever sequences they are asked, and are derived once.
    """
    asked: dict[str, tuple[Plan, list[Column]]] = {}
    for s, k in placed(steps):
        validate(s.plan)
        asked.setdefault(plan_text(s.plan), (s.plan, []))[1].append(F.struct(F.lit(s.sequence).alias("root"), F.lit(k).cast("long").alias("seq")))
    parts = [observation(spark, sf_dir, plan).select(F.explode(F.array(*by)).alias("by"), "dim", "fact_hash").select("by.root", "by.seq", "dim", "fact_hash") for plan, by in asked.values()]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "root string, seq long, dim string, fact_hash string")


def first_charges(spark: SparkSession, sf_dir: str, steps: Iterable[Step]) -> DataFrame:
    """(root, seq, dim, charged): how many facts each step is the first of its sequence to show; what ``charges`` says of ``observed``.

    Every different question is derived once and marks its facts with a bit, however many steps ask it. Base facts are
    shuffled as the source rows that have them, once for both dimensions, and meet there by row and cell; they are
    counted by the set of questions that show them, of which there are few, and a sequence charges each such set to its first
    step. Facts are hashed only where they are no base facts, or where distinct rows release base facts by their hashes.
    """
    plans: dict[str, tuple[int, Plan]] = {}
    asked = []
    for s, k in placed(steps):
        validate(s.plan)
        n = plans.setdefault(plan_text(s.plan), (len(plans), s.plan))[0]
        asked.append((s.sequence, k, n // WORD + 1, n % WORD))
    marks = [f"w{w}" for w in range((len(plans) - 1) // WORD + 1)]
    both = [F.bit_or(w).alias(w) for w in marks]
    cells, others = [], []
    for n, plan in plans.values():
        mark = [F.lit(1 << n % WORD if n // WORD == k else 0).cast("long").alias(w) for k, w in enumerate(marks)]
        cells.append(base_cells(spark, sf_dir, plan).select("*", *mark))
        others.append(outcome(spark, plan).select(F.lit("outcome").alias("dim"), "fact_hash", *mark))
        if plan.aggregates or plan.union:
            others.append(release(spark, sf_dir, plan).select(F.lit("release").alias("dim"), "fact_hash", *mark))
    row = ["namespace", "snapshot", "key"]
    rows = reduce(DataFrame.unionByName, cells).repartition(*row).groupBy(*row, "cells").agg(*both)
    base = rows.select(*row, F.explode("cells").alias("c"), *marks).groupBy(*row, "c").agg(*both)
    hashed = reduce(DataFrame.unionByName, others)
    if any(plan.union for _, plan in plans.values()):
        hashed = hashed.unionByName(base.select(F.col("c.output").alias("dim"), fact_of().alias("fact_hash"), *marks))
    sets = hashed.groupBy("dim", "fact_hash").agg(*both).select("dim", *marks)
    if not any(plan.union for _, plan in plans.values()):
        sets = sets.unionByName(base.select(F.col("c.output").alias("dim"), *marks))
    sets = sets.groupBy("dim", *marks).agg(F.count("*").alias("n"))
    by = spark.createDataFrame(asked, "root string, seq long, word int, bit int")
    shown = sets.join(F.broadcast(by), F.getbit(F.element_at(F.array(*marks), F.col("word")), F.col("bit")) == 1)  # steps were given one by one
    first = shown.groupBy("root", "dim", *marks).agg(F.min("seq").alias("seq"), F.first("n").alias("n"))
    return first.groupBy("root", "seq", "dim").agg(F.sum("n").alias("charged"))


def named(spark: SparkSession, steps: Iterable[Step]) -> DataFrame:
    """(root, seq, step) of the steps, of which there are a few for each sequence."""
    return spark.createDataFrame([(s.sequence, k, s.name) for s, k in placed(steps)], "root string, seq long, step string")


def replayed(spark: SparkSession, sf_dir: str, steps: list[Step], caps: DataFrame | None = None) -> DataFrame:
    """(root, seq, step, accepted, charged_release, charged_influence, charged_outcome): what each step costs after those before it.

    Without ``caps`` all are accepted; with them (root, max_release, ...) a step that would pass a cap is refused whole and
    teaches nothing.
    """
    names = named(spark, steps)
    if not steps:
        return names.select("*", F.lit(True).alias("accepted"), *[F.lit(0).cast("long").alias(f"charged_{d}") for d in DIMS])
    if caps is None:
        of = lambda d: F.coalesce(F.sum(F.when(F.col("dim") == d, F.col("charged"))), F.lit(0)).cast("long").alias(f"charged_{d}")
        done = first_charges(spark, sf_dir, steps).groupBy("root", "seq").agg(F.lit(True).alias("accepted"), *[of(d) for d in DIMS])
    else:
        done = settle(observed(spark, sf_dir, steps), caps)
    out = names.join(done, ["root", "seq"], "left")
    return out.select("root", "seq", "step", F.coalesce("accepted", F.lit(True)).alias("accepted"), *[F.coalesce(f"charged_{d}", F.lit(0)).cast("long").alias(f"charged_{d}") for d in DIMS])
