import pytest
from pyspark.sql import functions as F

from factgate.operators import audit, snapshots
from factgate.operators.digest import set_digest, unverified
from factgate.sources import products
from factgate.sources.products import PRODUCTS

DERBY = "org.apache.derby.jdbc.EmbeddedDriver"


@pytest.fixture
def log(spark):
    rows = [(i, f"t{i % 3}", None if i % 7 == 0 else f"q{i % 4}", ["ann", "bob"][i % 2], ["read", "write", None][i % 3]) for i in range(1, 60)]
    return rows, spark.createDataFrame(rows, "seq long, task string, query string, actor string, event_type string").repartition(4)


@pytest.mark.parametrize("after,limit,wanted", [(-1, 100, {}), (10, 5, {"actor": "bob"}), (0, 500, {"task": "t1", "query": "q2"}), (0, 3, {"event_type": "read", "actor": ""}), (59, 10, {}), (0, 10, {"query": "none"})])
def test_pages_of_a_log(log, after, limit, wanted):
    rows, df = log
    at = {"task": 1, "query": 2, "actor": 3, "event_type": 4}
    want = sorted(r for r in rows if r[0] > after and all(v in ("", r[at[c]]) for c, v in wanted.items()))[:limit]
    assert [tuple(r) for r in audit.listed(df, after, limit, **wanted).collect()] == want


def test_pages_that_cannot_be_asked_for(log):
    for bad in ({"limit": 0}, {"limit": 501}, {"colour": "red"}):
        with pytest.raises(ValueError):
            audit.listed(log[1], **bad)
    for after, through in ((-1, 3), (4, 3)):
        with pytest.raises(ValueError):
            audit.between(log[1], after, through)
    assert audit.between(log[1], 4, 4).isEmpty()
    assert sorted(r.seq for r in audit.between(log[1], 4, 7).collect()) == [5, 6, 7]


def test_claims_that_do_not_hold(spark):
    rows = [(k, f"{i * 7919 + k:064x}") for k in range(5) for i in range(20)]
    sets = spark.createDataFrame(rows, "k long, h string").unionByName(spark.createDataFrame(rows[:9], "k long, h string"))
    claims = set_digest(sets, "h", ["k"])
    assert unverified(claims, sets, "h", ["k"]).isEmpty()
    swapped = sets.withColumn("h", F.when(F.col("h") == rows[0][1], F.lit("f" * 64)).otherwise(F.col("h")))
    less = swapped.where(F.col("h") != rows[25][1]).where("k <> 3").unionByName(spark.createDataFrame([(9, "a" * 64)], "k long, h string"))
    got = {r.k: r.problem for r in unverified(claims.where("k <> 4"), less, "h", ["k"]).collect()}
    assert got == {0: "digest", 1: "count", 3: "empty", 4: "unclaimed", 9: "unclaimed"}


def test_churn_keeps_the_number_of_rows(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(250)], "k int, v double")
    new = snapshots.churned(df, "k", 2)
    assert new.schema == df.schema and new.count() == 250 and new.select("k").distinct().count() == 250
    assert sorted(r.v for r in new.collect()) == sorted(float(i) for i in range(250))
    assert tuple(snapshots.version_diff(df, new, ["k"]).first()) == (6, 6, 0, 244)
    assert snapshots.churned(df.where("k < 0"), "k", 2).count() == 0


def test_a_database_that_is_not_as_declared(spark, sf, tmp_path):
    p = PRODUCTS["customer"]
    held = products.load(spark, sf, "customer")
    for name, df in (("good", held), ("lacking", held.drop("c_acctbal")), ("other", held.withColumn("c_nationkey", F.col("c_nationkey").cast("string")))):
        url = f"jdbc:derby:{tmp_path}/{name};create=true"
        df.write.jdbc(url, p.table, properties={"driver": DERBY})
        read = lambda: products.attested_jdbc(spark, url, p, "C_CUSTKEY", 1, 100, 3, driver=DERBY)  # noqa: B023, E731
        if name == "good":
            assert read().schema.simpleString() == held.schema.simpleString()
            assert sorted(map(tuple, read().collect())) == sorted(map(tuple, held.collect()))
        else:
            with pytest.raises(ValueError, match={"lacking": "c_acctbal is missing", "other": "c_nationkey is string"}[name]):
                read()
