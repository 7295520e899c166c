from pyspark.sql import functions as F

from factgate.operators import lineage


def test_merged_rows_gather_no_facts(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), "id", F.array(F.sha2(F.col("id").cast("string"), 256), F.sha2((F.col("id") % 7).cast("string"), 256)).alias(lineage.LINE))
    df = df.withColumn("k", F.when(F.col("id") >= 10, F.col("k")))
    for rows, lines in (lineage.aggregate(df, ["k"], [F.count("*").alias("n")]), lineage.union(df.select("k", lineage.LINE), df.select("k", lineage.LINE))):
        assert all("array" not in t for _, t in rows.dtypes + lines.dtypes)
        got = {r.k: (r.facts, r.digest) for r in lineage.sized(rows, lines, ["k"]).collect()}
        assert {k: n for k, (n, _) in got.items()} == {None: 10, 0: 1495 + 7, 1: 1495 + 7} and len({d for _, d in got.values()}) == 3


def test_rows_without_facts_stay(spark):
    df = spark.createDataFrame([(1, []), (2, ["a"])], f"k long, {lineage.LINE} array<string>")
    rows, lines = lineage.aggregate(df, ["k"], [F.count("*").alias("n")])
    assert sorted((r.k, r.n, r.facts) for r in lineage.sized(rows, lines, ["k"]).collect()) == [(1, 1, 0), (2, 1, 1)]
