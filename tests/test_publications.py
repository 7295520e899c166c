import pytest
from pyspark.sql import functions as F

from factgate.sources import products, publications


def test_versions_are_bound_to_all_parts(spark, sf, tmp_path):
    p = products.PRODUCTS["supplier"]
    rows = products.load(spark, sf, "supplier")
    publications.publish_indexed(rows, p, str(tmp_path), "day0", 4)
    publications.publish_indexed(rows.withColumn("s_acctbal", (F.col("s_acctbal") + 1).cast("decimal(18,2)")), p, str(tmp_path), "day1", 4)
    one, two = (spark.read.parquet(f"{tmp_path}/supplier/snapshot={d}/manifest").first() for d in ("day0", "day1"))
    assert one.content_digest != two.content_digest and one.rows == two.rows == rows.count()
    hot, cold, sidecar = publications.indexed(spark, str(tmp_path), p, "day0")
    assert hot.count() == cold.count() == sidecar.count() == one.rows
    assert hot.agg(F.max(F.length("prefix"))).first()[0] == one.depth
    assert publications.tampered(spark, str(tmp_path), p, "day0").isEmpty()
    shards = spark.read.parquet(f"{tmp_path}/supplier/snapshot=day1/shards").collect()
    assert {s.part for s in shards} == set(publications.PARTS) and len([s for s in shards if s.part == "cold"]) == -(-one.rows // 4)
    spark.createDataFrame([(*s[:3], "0" * 64) if s.part == "cold" and s.shard == "0" else tuple(s) for s in shards], "part string, shard string, n long, digest string").coalesce(1).write.parquet(f"{tmp_path}/forged")
    import os

    os.rename(f"{tmp_path}/supplier/snapshot=day1/shards", f"{tmp_path}/old")
    os.rename(f"{tmp_path}/forged", f"{tmp_path}/supplier/snapshot=day1/shards")
    assert sorted(map(tuple, publications.tampered(spark, str(tmp_path), p, "day1").collect())) == [("cold", "0"), ("manifest", "")]


def test_a_version_is_written_once_and_whole(spark, sf, tmp_path):
    p = products.PRODUCTS["region"]
    publications.publish_indexed(products.load(spark, sf, "region"), p, str(tmp_path), "day0")
    with pytest.raises(FileExistsError):
        publications.publish_indexed(products.load(spark, sf, "region"), p, str(tmp_path), "day0")
    broken = products.load(spark, sf, "region").withColumn("r_name", F.raise_error(F.lit("cut off")).cast("string"))
    with pytest.raises(Exception):
        publications.publish_indexed(broken, p, str(tmp_path), "day1")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        publications.indexed(spark, str(tmp_path), p, "day1")


def test_files_do_not_grow_with_shards(spark, sf, tmp_path):
    """Very small shards share folders and files; each is attested and found on its own all the same."""
    p = products.PRODUCTS["customer"]
    publications.publish_indexed(products.load(spark, sf, "customer"), p, str(tmp_path), "day0", 1)
    path = tmp_path / "customer" / "snapshot=day0"
    shards = {r.part: r.n for r in spark.read.parquet(f"{path}/shards").groupBy("part").agg(F.count("*").alias("n")).collect()}
    for part in ("cold", "sidecar"):
        assert shards[part] > 100 and len(list((path / part).rglob("*.parquet"))) <= 16
    assert publications.tampered(spark, str(tmp_path), p, "day0").isEmpty()
