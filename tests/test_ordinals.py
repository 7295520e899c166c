import random

from factgate.operators import ordinals


def frame(spark, ids, plane="", product="p"):
    df = spark.createDataFrame([(i,) for i in ids], "ordinal long")
    from factgate.operators.snapshots import bitmap

    return bitmap(df).selectExpr(f"'{product}' as product", f"'{plane}' as plane", "bucket", "bits")


def test_pages_are_stored_and_read_back(spark):
    draw = random.Random(4)
    dense, sparse = draw.sample(range(32_769), 9000), draw.sample(range(200_000), 40) + [0, 1, 32_768, 32_769, 65_536]
    pages = frame(spark, dense).unionByName(frame(spark, sparse, "c"))
    stored = ordinals.packed(pages)
    assert {(r.n <= ordinals.SPARSE, len(r.data) == 2 * r.n) for r in stored.collect()} == {(True, True), (False, False)}
    back = ordinals.unpacked(stored)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, pages.collect()))
    rows = ordinals.ordinals_of(back).collect()
    assert sorted(r.ordinal for r in rows if "" in r.planes) == sorted(dense)
    assert sorted(r.ordinal for r in rows if "c" in r.planes) == sorted(set(sparse))


def test_novelty_and_charges(spark):
    draw = random.Random(6)
    sets = [set(draw.sample(range(100_000), 3000)) for _ in range(4)]
    pages = [frame(spark, s) for s in sets]
    assert ordinals.novelty(pages[1], ordinals.united(pages[0], pages[2])).first().n == len(sets[1] - sets[0] - sets[2])
    stream = None
    for seq, p in enumerate([*pages, pages[0]]):
        own = p.selectExpr("'r' as root", f"cast({seq} as long) as seq", "product", "plane", "bucket", "bits")
        stream = own if stream is None else stream.unionByName(own)
    known, want = set(), []
    for seq, s in enumerate([*sets, sets[0]]):
        want.append(("r", seq, len(s), len(s - known)))
        known |= s
    assert sorted(map(tuple, ordinals.page_charges(stream).collect())) == want


def test_no_pages(spark):
    none = frame(spark, [1]).limit(0)
    assert ordinals.packed(none).isEmpty() and ordinals.facts_of(spark, "/nowhere", none).isEmpty()


def test_rows_of_pages_are_not_broadcast(spark, sf, tmp_path):
    """However small the pages are, the rows read out of them are joined by a shuffle."""
    ordinals.publish(spark, sf, "orders", str(tmp_path))
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    got = ordinals.facts_of(spark, str(tmp_path), frame(spark, range(n), "", "orders"))
    assert got.distinct().count() == n
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_pages_are_built_where_they_belong(spark, sf, tmp_path):
    """Every page leaves one task only, whatever the join has dealt its rows by: no bitmap is shuffled."""
    from factgate.workload.relational import join2_plan

    for p in ("orders", "lineitem"):
        ordinals.publish(spark, sf, p, str(tmp_path))
    pages = ordinals.influence_pages(spark, str(tmp_path), join2_plan())
    plan = pages._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Exchange")]
    assert above.count("bitmap_construct_agg") >= 2 and "bitmap_construct_agg" not in plan[len(above) :]
    assert not pages.groupBy(*ordinals.PAGE).count().where("count > 1").count()
