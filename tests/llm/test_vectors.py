import numpy as np
import pytest

from factgate.llm import vectors


def brute(rows, threshold):
    good = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = [(i, v / np.linalg.norm(v)) for i, v in good]
    near = [[j for j in range(len(unit)) if j != i and len(unit[i][1]) == len(unit[j][1]) and float(unit[i][1] @ unit[j][1]) >= threshold] for i in range(len(unit))]
    comp = list(range(len(unit)))
    for i in range(len(unit)):
        stack, seen = [i], {i}
        while stack:
            for j in near[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        comp[i] = min(unit[j][0] for j in seen)
    return sorted((unit[i][0], len(near[i]), comp[i]) for i in range(len(unit)))


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(5)
    base = draw.normal(size=(60, 40))
    out = [(i, v.astype("f4").tolist()) for i, v in enumerate(base)]
    for i in range(200):
        out.append((1000 + i, (base[i % 7] + draw.normal(size=40) * draw.choice([0.1, 0.25, 0.4])).astype("f4").tolist()))
    out += [(2000 + i, out[3][1]) for i in range(30)] + [(2000, out[3][1])]
    out += [(3000, [2 * x for x in out[3][1]]), (3001, None), (3002, [0.0] * 40), (3003, [float("nan")] + [1.0] * 39), (3004, [None] + [1.0] * 39), (3005, []), (3006, [1.0, 2.0]), (3007, [1.0, 2.1]), (3008, [float("inf")] + [1.0] * 39), (None, out[3][1])]
    return out


@pytest.mark.parametrize("stripe, tile", [(8192, 1024), (40, 16)])
def test_against_all_pairs(spark, rows, monkeypatch, stripe, tile):
    monkeypatch.setattr(vectors, "STRIPE", stripe)
    monkeypatch.setattr(vectors, "TILE", tile)
    table = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, rep string")
    got = vectors.near_duplicates(table).collect()
    assert len(got) == len(rows)
    want = brute(rows, 0.9)
    bad = {3001, 3002, 3003, 3004, 3005, 3008, None}
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id not in bad) == want
    for r in got:
        assert r.kept == (r.vec_id is not None and r.vec_id == r.component_id)
        if r.vec_id in bad:
            assert (r.n_links, r.component_id) == (0, r.vec_id)


def test_nothing_to_compare(spark):
    table = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, vectors.near_duplicates(table).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert vectors.near_duplicates(table.limit(0)).count() == 0


def test_query_against_all_pairs(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = vectors.op6_embedding_near_dedup(spark, sf).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows, 0.9)
