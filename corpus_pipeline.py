"""A corpus pipeline: language ID, near-duplicates, repeated passages, private data, packing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from factgate.llm import langid, pack, private, simhash, suffixes
from factgate.llm.common import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", lambda spark, docs, sf_dir: langid.keep_identified(docs)),
    ("simhash_near_dedup", lambda spark, docs, sf_dir: simhash.keep_one_alike(docs)),
    ("suffix_array_dedup", lambda spark, docs, sf_dir: suffixes.cut_repeats(docs)),
    ("pii_surrogates", lambda spark, docs, sf_dir: private.replaced(docs, private.key_of(spark))),
    ("packing", lambda spark, docs, sf_dir: pack.pack(docs, public_tokenizers.path("word_bpe_49k.json"))),
]

#: The stages tokenise, hash with XXH64 and compress, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage's result is written to the shared folder and read again."""
    base = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{base}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
