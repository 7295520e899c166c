"""What must not grow with the input beyond its share: rows of a task, what is shuffled, what goes through the driver."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from factgate.operators import audit, facts, governance, ledger, snapshots
from factgate.streaming import shared
from factgate.workload import further, invariants


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


# -- F12


def test_rows_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS", 1000)
    sizes = [r["count"] for r in shared.spread(spark.range(20_000), "id").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2000


def test_facts_of_queries_are_not_shuffled(spark, sf):
    assert "literal" not in " ".join(x for x in physical(further.asked_outcomes(spark, sf)).splitlines() if "Exchange" in x)


# -- F14


def test_tables_of_a_relation_meet_once_for_each_key(spark, sf):
    dealt = [x for x in physical(invariants.annotated_relation_rules(spark, sf)).splitlines() if "Exchange hashpartitioning" in x]
    assert len(dealt) <= 8 and not any("fact_hash" in x for x in dealt)


# -- F15


def test_outcomes_are_counted_without_a_copy_for_each_count(spark):
    rows = [(0, 1, "predicate-atom", "a"), (0, 1, "composite-outcome", "b"), (0, 2, "predicate-atom", "a"), (0, 2, "composite-outcome", "a"), (0, 3, "predicate-atom", None), (0, 3, None, "c")]
    found = facts.cardinality_problems(spark.createDataFrame(rows + rows, "root int, seq int, kind string, fact_hash string"))
    assert sorted(map(tuple, found.collect())) == [(0, 2, 1, 1), (0, 3, 0, 0)]
    assert "Expand" not in physical(found)


# -- F16, F17


def test_steps_of_a_closure_are_not_broadcast(spark, monkeypatch):
    plans, put = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (plans.append(physical(self._df)), put(self, *a, **b))[1])
    got = governance.closure(spark.range(1, 9).selectExpr("id as view", "id div 2 as depends_on"))
    assert got.count() == sum(len(bin(k)) - 2 for k in range(1, 9))
    assert "SortMergeJoin" in plans[1] and not any("Broadcast" in p for p in plans)


# -- F18


def test_not_in_sends_different_values_only(spark, sf):
    plan = physical(further.not_in_nulls(spark, sf)).splitlines()
    sent = [k for k, x in enumerate(plan) if "BroadcastExchange" in x]
    assert sent and all("HashAggregate" in plan[k + 1] for k in sent)


# -- F19


def test_ordinals_of_hashes_only(spark):
    some = spark.createDataFrame([("b" * 64, 1), ("a" * 64, 2)], "fact_hash string, x int")
    assert sorted(map(tuple, snapshots.compile_ordinals(some).collect())) == [("a" * 64, 2, 0), ("b" * 64, 1, 1)]
    with pytest.raises(Exception, match="not a hash"):
        snapshots.compile_ordinals(some.withColumn("fact_hash", F.upper("fact_hash"))).collect()


# -- F20


def test_payloads_are_not_shuffled_to_find_breaks(spark):
    chain = spark.range(9).selectExpr("id as seq", "'a' as actor", "'k' as event_type", "cast(id as string) as payload", "'p' as prev_hash", "'h' as hash").localCheckpoint()
    plan = audit.breaks(chain)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    dealt = [plan[k + 1] for k, x in enumerate(plan) if "RepartitionByExpression" in x]
    assert dealt and "AS __wrong" in dealt[0]
    assert audit.breaks(chain).count() == 9


# -- F21


def test_a_stream_is_shuffled_by_task(spark):
    stream, tasks = spark.range(9).selectExpr("id % 3 as task", "id as seq"), spark.range(3).selectExpr("id as task", "id as root")
    got = ledger.by_root(tasks, stream)
    assert got.count() == 9 and "ShuffledHashJoin" in physical(got)
