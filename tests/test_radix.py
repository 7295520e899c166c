import hashlib

import pytest
from pyspark.sql import functions as F

from factgate.operators import radix


def tree(hashes, split, prefix):
    """(n, digest) under a prefix, by recursion."""
    own = sorted(h for h in hashes if h.startswith(prefix)) if prefix else sorted(hashes)
    if len(own) <= split:
        return len(own), hashlib.sha256("".join(own).encode()).hexdigest()
    parts = [(d, tree(own, split, prefix + d)) for d in "0123456789abcdef"]
    return len(own), hashlib.sha256("".join(d + x for d, (n, x) in parts if n).encode()).hexdigest()


def whole(hashes, split):
    blocks = {}
    for h in set(hashes):
        blocks.setdefault(h[:2], set()).add(h)
    return len(set(hashes)), hashlib.sha256("".join(b + tree(blocks[b], split, b)[1] for b in sorted(blocks)).encode()).hexdigest()


def some(low, high):
    return [hashlib.sha256(str(k).encode()).hexdigest() for k in range(low, high)]


def frame(spark, hashes):
    return spark.createDataFrame([(h,) for h in hashes], "fact_hash string")


@pytest.mark.parametrize("split", [3, 4096])
def test_versions_equal_a_rebuild(spark, tmp_path, split):
    path = str(tmp_path / "set")
    first, second = some(0, 150), some(100, 250)
    a = radix.union(spark, path, frame(spark, first + first[:50] + [None]), None, 0, split)
    assert (a.new, a.read) == (150, 0)
    b = radix.union(spark, path, frame(spark, second), 0, 1, split)
    assert b.new == 100
    c = radix.union(spark, path, frame(spark, second), 1, 2, split)  # nothing new
    assert (c.new, c.leaves, c.blocks) == (0, 0, 0)
    for v, known in ((0, first), (1, first + second), (2, first + second)):
        assert tuple(radix.root(spark, path, v).first()) == whole(known, split)
        assert sorted(r[0] for r in radix.members(spark, path, v).collect()) == sorted(set(known))
        assert radix.damaged(spark, path, v).isEmpty()
    lacking = radix.difference(spark, path, 1, frame(spark, some(240, 260) + ["zz"]))
    assert sorted(r[0] for r in lacking.collect()) == sorted(some(250, 260) + ["zz"])


def test_deep_shared_prefixes(spark, tmp_path):
    """Hashes that agree in very many digits, which no spread of counts would foresee."""
    path = str(tmp_path / "set")
    hard = [f"abcdef0{k:02x}" + "7" * 55 for k in range(20)] + some(0, 20)
    radix.union(spark, path, frame(spark, hard[:5]), None, 0, 2)
    radix.union(spark, path, frame(spark, hard), 0, 1, 2)
    assert tuple(radix.root(spark, path, 1).first()) == whole(hard, 2)
    assert sorted(r[0] for r in radix.members(spark, path, 1).collect()) == sorted(hard)


def test_one_hash_rewrites_one_leaf(spark, tmp_path):
    path = str(tmp_path / "set")
    facts = spark.range(100_000).select(F.sha2(F.col("id").cast("string"), 256).alias("fact_hash"))
    radix.union(spark, path, facts, None, 0)
    done = radix.union(spark, path, frame(spark, [hashlib.sha256(b"new").hexdigest()]), 0, 1)
    assert (done.new, done.leaves, done.blocks) == (1, 1, 1) and done.written == done.read + 1 < 600
    everything = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(100_000)] + [hashlib.sha256(b"new").hexdigest()]
    assert tuple(radix.root(spark, path, 1).first()) == whole(everything, 4096)
    assert {r.prefix[:2] for r in spark.read.parquet(f"{path}/nodes/version=1").collect()} == {everything[-1][:2]}


def test_an_empty_set(spark, tmp_path):
    path = str(tmp_path / "set")
    assert radix.union(spark, path, frame(spark, some(0, 3)).limit(0), None, 0).new == 0
    assert tuple(radix.root(spark, path, 0).first()) == (0, hashlib.sha256(b"").hexdigest())
    assert radix.members(spark, path, 0).isEmpty() and radix.damaged(spark, path, 0).isEmpty()
    assert radix.union(spark, path, frame(spark, some(0, 3)), 0, 1).new == 3
    assert tuple(radix.root(spark, path, 1).first()) == whole(some(0, 3), 4096)


def test_damage_is_found(spark, tmp_path):
    path = str(tmp_path / "set")
    hashes = some(0, 300)
    radix.union(spark, path, frame(spark, hashes), None, 0, 4)
    victim = hashes[7]
    block = victim[:2]
    rows = spark.read.parquet(f"{path}/members/version=0").where(F.col("part") == block[0]).select("leaf", "fact_hash").collect()
    forged = [(r.leaf, r.fact_hash[:-1] + ("0" if r.fact_hash[-1] != "0" else "1") if r.fact_hash == victim else r.fact_hash) for r in rows]
    spark.createDataFrame(forged, "leaf string, fact_hash string").write.mode("overwrite").parquet(f"{path}/members/version=0/part={block[0]}")
    found = radix.damaged(spark, path, 0).collect()
    assert [(r.what, victim.startswith(r.prefix)) for r in found] == [("leaf", True)]
    top = radix.manifest(spark, path, 0).collect()
    spark.createDataFrame([(*r[:2], r[2] + (r.block == block), *r[3:]) for r in top], "block string, version int, n long, digest string, depth int").write.parquet(f"{path}/manifest/version=5")
    assert {(r.prefix, r.what) for r in radix.damaged(spark, path, 5).collect()} >= {(block, "block")}


def test_one_more_counts_the_block(spark):
    """Where a block has several leaves, one is written, and the sizes are still the block's."""
    from factgate.functions.canonical import digest
    from factgate.workload.radix import one_more

    facts = spark.range(6000).selectExpr("sha2(cast(id as string), 256) as fact_hash")
    block = spark.range(1).select(digest("one more", "fact").alias("h")).first().h[:2]
    n = facts.where(f"substr(fact_hash, 1, 2) = '{block}'").count()
    got = one_more(spark, facts, 4).first()
    assert n > 4 and (got.new, got.blocks, got["read"], got.written) == (1, 1, n, n + 1)


def test_divided_reads_rows_once(spark):
    """However deep the prefixes that very many hashes share, dividing them joins nothing with counts by level."""
    hashes = [f"ab{k % 3}0000{k:057x}" for k in range(40)] + some(0, 40)
    rows = frame(spark, hashes).selectExpr("substr(fact_hash, 1, 2) as block", "substr(fact_hash, 1, 2) as was", "fact_hash").repartition("block")
    done = radix.divided(rows, 5)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    for r in done.collect():
        like = lambda k: sum(h.startswith(r.fact_hash[:k]) for h in hashes)  # noqa: E731, B023
        k = len(r.leaf)
        assert like(k) <= 5 and (k == 2 or like(k - 1) > 5)
