import numpy as np
import pytest

from factgate.llm import partitions
from factgate.llm.partitions import Learning


def exact(rows, queries, k):
    """All candidates of each query by brute force, as {query: [(vec_id, score)]} of the k best."""
    fine = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    good = [(i, v) for i, v in rows if i is not None and fine(v)]
    out = {}
    for q, v in queries:
        if q is None or not fine(v):
            continue
        scores = []
        for i, w in good:
            if i != q and len(w) == len(v):
                total = 0.0
                for x, y in zip(v, w):
                    total += float(np.float32(x)) * float(np.float32(y))
                scores.append((-total, i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q, x in out.items():
        assert [r for r, *_ in sorted(x)] == list(range(1, len(x) + 1))
    return {q: [(i, s) for _, i, s in sorted(x)] for q, x in out.items()}


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(11)
    base = draw.normal(size=(12, 24)) * 2
    out = [(i, (base[i % 12] + draw.normal(size=24) * 0.7).astype("f4").tolist()) for i in range(900)]
    hot = out[5][1]
    out += [(2000 + i, hot) for i in range(450)] + [(2000, hot), (2001, out[7][1])]
    out += [(3000, None), (3001, []), (3002, [0.0] * 24), (3003, [float("nan")] + [1.0] * 23), (3004, [None] + [1.0] * 23), (3005, [float("inf")] * 24), (None, hot)]
    return out + [(4000 + i, draw.normal(size=3).astype("f4").tolist()) for i in range(40)] + [(5000, [1.0])]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "s") for i, v in rows], "vec_id long, embedding array<float>, label int, part int, stripe string").repartition(4)


@pytest.mark.parametrize("stripe, block", [(1 << 19, 4096), (24 * 50, 16)])
def test_all_probes_are_exact(table, rows, monkeypatch, stripe, block):
    """With a recall of all asked for, every part is probed, and results equal brute force, ties and scores too."""
    monkeypatch.setattr(partitions, "STRIPE_NUMBERS", stripe)
    monkeypatch.setattr(partitions, "QUERIES", block)
    queries = [(i, v) for i, v in rows if i is None or i % 10 == 0 and i != 2000] + [(2000, rows[5][1])]
    got = found(partitions.neighbours(table, table.where("vec_id is null or vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id"), 15, Learning(recall=1)))
    want = {q: x for q, x in exact(rows, queries, 15).items() if x}
    assert got == want
    assert 5000 not in got and len(got[4000]) == 15


def test_recall_and_few_probes(table, rows):
    how = Learning(sample=700, parts=8, recall=0.95)
    queries = [(i, v) for i, v in rows if i is not None and i < 900 and i % 5 == 0]
    spark = table.sparkSession
    want = exact(rows, queries, 10)
    got = found(partitions.neighbours(table, table.where("vec_id < 900 and vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id"), 10, how))
    floor = {q: x[-1][1] for q, x in want.items()}  # the hot vector's copies tie
    hit = sum(s >= floor[q] for q, x in got.items() for _, s in x)
    assert hit >= 0.9 * 10 * len(queries)
    x = np.array([v for i, v in rows if i is not None and i < 900])
    router = partitions.fitted(spark, x, 10, how)
    assert router.parts == 8 and router.probes < 8  # clustered rows need few parts


def test_balanced_parts():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(400, 16)) + np.repeat(np.eye(4), 100, 0) @ draw.normal(size=(4, 16)) * 4
    near = partitions.nearest(x, x, 8, np.arange(400))
    part = partitions.balanced(near, 2, draw)
    assert np.bincount(part).tolist() == [100] * 4
    assert (part[near] == part[:, None]).mean() > 0.95


def test_few_and_none(spark):
    table = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 9.0]), (40, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    ask = table.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    assert found(partitions.neighbours(table, ask)) == {20: [(1, 0.5), (2, 0.5), (40, -1.0)], 40: [(1, -0.5), (2, -0.5), (20, -1.0)]}
    assert partitions.neighbours(table.limit(0), ask).count() == partitions.neighbours(table, ask.limit(0)).count() == 0
    assert partitions.neighbours(table.where("vec_id = 1"), ask).count() == 2


def test_query_against_brute_force(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = found(partitions.op11_learned_partitions(spark, sf))
    want = exact(rows, [(i, v) for i, v in rows if i % 20 == 0], 20)
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)
    every = dict(rows)
    for q, x in got.items():
        for i, s in x:
            total = 0.0
            for a, b in zip(every[q], every[i]):
                total += a * b
            assert s == total
