"""The chunk corpus and its index as Parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passagemill.sources import schema as S
from passagemill.sources.jsonl import path_exists


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The corpus, or an empty one where nothing was written yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], S.CHUNK)
    return spark.read.schema(S.CHUNK).parquet(path).select(*S.CHUNK_COLUMNS)


def append_corpus(chunks: DataFrame, path: str) -> None:
    (
        chunks.select(*S.CHUNK_COLUMNS)
        .write.mode("append").partitionBy("source_type").parquet(path)
    )


def write_bucketed(df: DataFrame, path: str, key: str = "chunk_id", buckets: int = 64) -> DataFrame:
    """Write rows dealt to ``buckets`` files by a hash of their key, and read them back as such.

    Joins on the key with rows dealt to as many parts need no exchange of this
    table; see ``dedup.only_new``.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key)  # one file a bucket
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def reset_corpus(spark: SparkSession, *paths: str) -> None:
    """Replace corpus or index tables by empty ones: an index keeps its schema."""
    for path in paths:
        schema = spark.read.parquet(path).schema if path_exists(spark, path) else S.CHUNK
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def build_index(
    chunks: DataFrame, encoder: Callable[[DataFrame], DataFrame], path: str, mode: str = "overwrite"
) -> DataFrame:
    """Write chunks with their encoding; vectors stay beside their chunk.

    ``mode="append"`` indexes only the chunks passed in, so a sync encodes no
    chunk twice.
    """
    if chunks.isEmpty():
        raise ValueError("no chunks to index")
    encoder(chunks).write.mode(mode).parquet(path)
    return load_index(chunks.sparkSession, path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no index at {path}; build it first")
    return spark.read.parquet(path)
