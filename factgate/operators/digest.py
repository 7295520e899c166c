"""Digests of sets of hashes in two levels, so that no task ever holds a whole set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_digest(df: DataFrame, hash_col: str, by: list[str] = [], count: str | None = None) -> DataFrame:  # noqa: B006
    """(by..., n, digest) of the distinct hashes, or of (hash, multiplicity) pairs if ``count`` names a column.

    Hashes are hex texts. Those that share 16 leading bits are sorted and hashed, then the digests that share 8 bits,
    then these. What a task sorts is a 65536th of a set; rows beyond one per hash are removed or added up before.
    """
    if count is None:
        rows = df.select(*by, F.col(hash_col).alias("__h")).distinct().withColumn("__t", F.col("__h"))
    else:
        rows = df.groupBy(*by, F.col(hash_col).alias("__h")).agg(F.sum(count).alias("__n")).withColumn("__t", F.concat_ws(":", "__h", "__n"))
    leaf = rows.groupBy(*by, F.substring("__h", 1, 4).alias("__p")).agg(F.count("*").alias("n"), join_sorted("__t").alias("__t"))
    block = leaf.groupBy(*by, F.substring("__p", 1, 2).alias("__b")).agg(F.sum("n").alias("n"), join_sorted(F.concat("__p", "__t")).alias("__t"))
    return block.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), join_sorted(F.concat("__b", "__t")).alias("digest"))


def join_sorted(value: Column | str) -> Column:
    return F.sha2(F.array_join(F.sort_array(F.collect_list(value)), ""), 256)


def sql_set_digest(rows: str, by: str = "") -> str:
    """The same as SQL over a query of distinct (by..., h, t): h the hash, t the hash or the hash and its multiplicity."""
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""SELECT {keys}CAST(coalesce(sum(n), 0) AS BIGINT) AS n, sha256(coalesce(string_agg(b || t, '' ORDER BY b || t), '')) AS digest FROM (
      SELECT {keys}substr(p, 1, 2) AS b, sum(n) AS n, sha256(string_agg(p || t, '' ORDER BY p || t)) AS t FROM (
        SELECT {keys}substr(h, 1, 4) AS p, count(*) AS n, sha256(string_agg(t, '' ORDER BY t)) AS t FROM ({rows}) GROUP BY {keys}p) GROUP BY {keys}b){group}"""


def same_set(a: DataFrame, b: DataFrame, hash_col: str) -> DataFrame:
    """Hashes that only one side has, with the side; empty if the sets are equal."""
    left, right = a.select(hash_col).distinct().withColumn("in_a", F.lit(True)), b.select(hash_col).distinct().withColumn("in_b", F.lit(True))
    return left.join(right, hash_col, "full").where("in_a is null or in_b is null").select(hash_col, F.when(F.col("in_a").isNull(), "b").otherwise("a").alias("only_in"))


def unverified(claims: DataFrame, members: DataFrame, hash_col: str, by: list[str]) -> DataFrame:
    """(by..., problem): sets whose claim (by..., n, digest) is not what their members give: count, digest, empty or unclaimed.

    Digests are made again from all members; sets meet their claims by key, so only two numbers and a text a set are joined.
    """
    now = set_digest(members, hash_col, by).select(*by, F.col("n").alias("__n"), F.col("digest").alias("__d"))
    both = claims.select(*by, F.col("n"), F.col("digest"), F.lit(True).alias("__c")).join(now, by, "full")
    problem = F.when(F.col("__c").isNull(), "unclaimed").when(F.col("__n").isNull() & (F.col("n") != 0), "empty").when(F.col("n") != F.col("__n"), "count").when(F.col("digest") != F.col("__d"), "digest")
    return both.select(*by, problem.alias("problem")).where("problem is not null")
