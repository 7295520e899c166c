import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factgate.operators import audit, digest, governance, ledger, snapshots, stats
from factgate.streaming import novelty

CAPS = "root string, max_release long, max_influence long, max_outcome long"
STREAM = "root string, seq long, dim string, fact_hash string"
ROOMS = "max_release long, max_influence long, max_outcome long"


def sequential(rows, caps):
    """The same settlement, one request after another."""
    known, out = {}, []
    for root, seq in sorted({(r, s) for r, s, _, _ in rows}):
        mine = known.setdefault(root, {d: set() for d in ledger.DIMS})
        new = {d: {f for r, s, k, f in rows if (r, s, k) == (root, seq, d)} - mine[d] for d in ledger.DIMS}
        limits = caps.get(root, (0, 0, 0))
        ok = all(not new[d] or len(mine[d]) + len(new[d]) <= m for d, m in zip(ledger.DIMS, limits))
        for d in ledger.DIMS:
            mine[d] |= new[d] if ok else set()
        out.append((root, seq, ok, *(len(new[d]) if ok else 0 for d in ledger.DIMS)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_settlement_is_sequential(spark, seed):
    draw = random.Random(seed)
    rows = [(draw.choice("abc"), draw.randrange(30), draw.choice(ledger.DIMS), f"f{draw.randrange(40)}") for _ in range(300)]
    caps = {"a": (8, 12, 9), "b": (3, 30, 30)}
    df = spark.createDataFrame(rows, STREAM).repartition(3)
    c = spark.createDataFrame([(k, *v) for k, v in caps.items()], CAPS)
    assert sorted(tuple(r) for r in ledger.settle(df, c).collect()) == sequential(rows, caps)
    first = [r for r in rows if r[1] < 12]
    done = ledger.settle(spark.createDataFrame(first, STREAM), c)
    book = ledger.learned(spark.createDataFrame(first, STREAM), done)
    later = ledger.settle(spark.createDataFrame([r for r in rows if r[1] >= 12], STREAM), c, book)
    assert sorted(tuple(r) for r in done.unionByName(later).collect()) == sequential(rows, caps)


def test_empty_stream(spark):
    caps = spark.createDataFrame([("a", 1, 1, 1)], CAPS)
    assert ledger.settle(spark.createDataFrame([], STREAM), caps).count() == 0


def test_stream_settles_like_a_batch(spark, tmp_path):
    draw = random.Random(5)
    rows = [(draw.choice("ab"), k // 4, draw.choice(ledger.DIMS), f"f{draw.randrange(60)}") for k in range(400)]
    caps = {"a": (9, 9, 9), "b": (20, 20, 20)}
    for k in range(4):
        spark.createDataFrame([r for r in rows if r[1] // 25 == k], STREAM).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(STREAM).parquet(f"{tmp_path}/in")
        c = spark.createDataFrame([(x, *v) for x, v in caps.items()], CAPS)
        novelty.settle_batches(stream, c, f"{tmp_path}/book", f"{tmp_path}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/book/settled").drop("batch")
    assert sorted(tuple(r) for r in got.collect()) == sequential(rows, caps)


def test_digest_ignores_order_and_repeats(spark):
    hashes = [f"{draw:064x}" for draw in range(3000)]
    a = spark.createDataFrame([(h,) for h in hashes], "h string")
    b = spark.createDataFrame([(h,) for h in reversed(hashes + hashes[:50])], "h string").repartition(7)
    x, y = digest.set_digest(a, "h").first(), digest.set_digest(b, "h").first()
    assert x == y and x.n == 3000
    assert digest.set_digest(a.where("h <> '" + hashes[5] + "'"), "h").first().digest != x.digest
    assert digest.set_digest(a.limit(0), "h").first().n == 0
    assert digest.same_set(a, b, "h").isEmpty()


def test_ordinals_are_dense(spark):
    df = spark.range(5000).selectExpr("sha2(cast(id as string), 256) as fact_hash")
    got = [r.ordinal for r in snapshots.compile_ordinals(df).orderBy("fact_hash").collect()]
    assert got == list(range(5000))
    numbers = snapshots.numbered(spark.createDataFrame([(x,) for x in (5, None, 3, 3, 900)], "x int"), ["x"], "n").orderBy("n").collect()
    assert [r.x for r in numbers] == [None, 3, 3, 5, 900] and [r.n for r in numbers] == list(range(5))
    assert snapshots.numbered(df.limit(0), ["fact_hash"]).count() == 0


def test_bitmaps_give_back_their_rows(spark):
    ids = sorted(random.Random(1).sample(range(200_000), 500))
    d = spark.range(200_000).withColumnRenamed("id", "ordinal")
    pages = snapshots.bitmap(spark.createDataFrame([(i,) for i in ids], "ordinal long"))
    assert sorted(r.ordinal for r in snapshots.expand(pages, d).collect()) == ids


def test_chain_breaks_are_found(spark):
    events = spark.createDataFrame([(k, "a", "t", f"p{k}") for k in range(1, 40)], "seq long, actor string, event_type string, payload string")
    chain = audit.link(events).cache()
    assert audit.breaks(chain).isEmpty()
    last = chain.where("seq = 39").first()
    assert audit.included(chain, 12, 39, last.hash) and not audit.included(chain.where("seq <> 20"), 12, 39, last.hash) and not audit.included(chain, 12, 39, "0")
    assert [tuple(r) for r in audit.breaks(chain.where("seq <> 20")).collect()] == [(21, "gap")]
    rows = [tuple(r) for r in chain.collect()]
    forged = [r if r[0] < 20 else (r[0], r[1], r[2], "other", *r[4:]) if r[0] == 20 else r for r in rows]
    assert [r.seq for r in audit.breaks(spark.createDataFrame(forged, chain.schema)).collect()] == [20]
    relinked = audit.link(events.where("seq >= 20").replace("p20", "other"), rows[18][5]).collect()  # from 20 on rebuilt in full
    assert audit.breaks(spark.createDataFrame(rows[:19] + [tuple(r) for r in relinked], chain.schema)).isEmpty()
    assert not audit.included(spark.createDataFrame(rows[:19] + [tuple(r) for r in relinked], chain.schema), 5, 39, last.hash)


def test_cycles_are_refused(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "view string, depends_on string")
    with pytest.raises(ValueError):
        governance.closure(edges)
    with pytest.raises(ValueError):
        governance.closure(spark.range(1, 9).selectExpr("id as view", "id - 1 as depends_on"), most=5)
    assert governance.closure(edges.limit(0)).count() == 0


@settings(max_examples=10, deadline=None)
@given(values=st.lists(st.integers(-50, 50), min_size=1, max_size=30))
def test_quantiles_interpolate(spark, values):
    import numpy as np

    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    r = stats.quantiles(df, [], "x", [0.25, 0.95]).first()
    assert (round(r.p25, 9), round(r.p95, 9)) == (round(float(np.quantile(values, 0.25)), 9), round(float(np.quantile(values, 0.95)), 9))


@pytest.mark.parametrize("rounds", [1, 12])
def test_one_root_with_all_requests(spark, monkeypatch, rounds):
    """A hot root is settled in rounds, and by the fold where rounds run out."""
    monkeypatch.setattr(ledger.in_rounds, "__defaults__", (rounds,))
    draw = random.Random(rounds)
    rows = [("a", draw.randrange(200), draw.choice(ledger.DIMS), f"f{int(draw.expovariate(0.01))}") for _ in range(2000)]
    caps = {"a": (60, 90, 200)}
    c = spark.createDataFrame([(k, *v) for k, v in caps.items()], CAPS)
    got = sorted(tuple(r) for r in ledger.settle(spark.createDataFrame(rows, STREAM).repartition(3), c, folded=0).collect())
    assert got == sequential(rows, caps)
    assert 0 < sum(r[2] for r in got) < len(got)


def test_batches_read_what_they_touch(spark, tmp_path):
    """The rows that a batch reads of the stored ledger don't grow with the batches before it."""
    c = spark.createDataFrame([("a", 10**6, 10**6, 10**6)], CAPS)
    for k in range(4):
        rows = [("a", k, "release", f"f{k}-{j}") for j in range(300 if k < 3 else 20)] + [("a", k, "influence", "f0-1")]
        spark.createDataFrame(rows, STREAM).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        novelty.settle_batches(spark.readStream.schema(STREAM).parquet(f"{tmp_path}/in"), c, f"{tmp_path}/book", f"{tmp_path}/checkpoint", 4).awaitTermination()
    changes = [r.asDict() for r in spark.read.parquet(f"{tmp_path}/book/changes").orderBy("batch").collect()]
    assert [r["new"] for r in changes] == [301, 300, 300, 20]
    assert changes[3]["read"] <= 4 * 21 and changes[3]["leaves"] <= 8 * 21
    assert spark.read.parquet(f"{tmp_path}/book/settled").agg({"charged_release": "sum"}).first()[0] == 920


def test_a_full_dimension_refuses_at_once(spark, monkeypatch):
    """Users of whom the root may learn two, with very many requests each: decided in rounds, none is left to be folded."""
    rows = [("r", s, "influence", f"u{s % 9}") for s in range(400)] + [("r", s, "release", f"x{s % 3}") for s in range(400)]
    stream = spark.createDataFrame(rows, "root string, seq long, dim string, fact_hash string")
    caps = spark.createDataFrame([("r", 9, 2, 9)], "root string, max_release long, max_influence long, max_outcome long")
    want = sorted(map(tuple, ledger.settle(stream, caps).collect()))

    def folded(*_):
        raise AssertionError("requests were left after the rounds")

    monkeypatch.setattr(ledger, "in_order", folded)
    assert sorted(map(tuple, ledger.settle(stream, caps, folded=0).collect())) == want


def test_free_roots_are_charged_by_minima_only(spark):
    """What fits altogether is neither counted apart by dimension nor joined with the sizes of requests."""
    rows = [(k % 2, k, d, f"{d}{k // 3}") for k in range(30) for d in ledger.DIMS]
    done = ledger.settle(spark.createDataFrame(rows, "root long, seq long, dim string, fact_hash string"), spark.createDataFrame([(0, 99, 99, 99), (1, 99, 99, 99)], "root long, " + ROOMS))
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftOuter") == 1 and "Expand" not in plan
    first = {}
    for root, seq, d, f in rows:
        first.setdefault((root, d, f), seq)
    got = {(r.root, r.seq): (r.accepted, r.charged_release, r.charged_influence, r.charged_outcome) for r in done.collect()}
    assert got == {(r, s): (True, *[int(first[r, d, f"{d}{s // 3}"] == s) for d in ledger.DIMS]) for r, s, _, _ in rows}


def test_a_batch_may_have_many_files(spark, tmp_path):
    """Requests of a micro-batch are not drawn together in one task."""
    from factgate.workload.more import settle_next

    c, base = spark.createDataFrame([("a", 99, 99, 99)], "root string, " + ROOMS), str(tmp_path / "book")
    for k in range(2):
        rows = [("a", s, d, f"{d}{s // 2}") for s in range(20 * k, 20 * k + 20) for d in ledger.DIMS]
        settle_next(spark.createDataFrame(rows, STREAM).repartition(3), c, base)
    assert len(list((tmp_path / "book" / "in").rglob("*.parquet"))) == 6
    done = spark.read.parquet(f"{base}/settled")
    assert {tuple(r) for r in done.groupBy("batch").agg(F.count("*"), F.sum("charged_release")).collect()} == {(0, 20, 10), (1, 20, 10)}
