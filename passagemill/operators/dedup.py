"""Insert-if-absent joins and known-key sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.operators.ranking import keep_first


def truthy(key: str) -> Column:
    return F.col(key).isNotNull() & (F.col(key).cast("string") != "")


def absent(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the existing keys.

    Only distinct keys of the existing side travel, partly merged before the
    shuffle, so a key repeated there does not make one heavy task.
    """
    known = existing.where(truthy(key)).select(key).distinct()
    return df.join(known, key, "left_anti")


def only_new(
    df: DataFrame, existing: DataFrame, key: str, order: list[Column], buckets: int | None = None
) -> DataFrame:
    """First row per key of the batch, unless the key already exists.

    The keep-first cut and the join hash on the same key: one shuffle of the batch.
    Where ``existing`` was written by ``write_bucketed`` on that key, give its number
    of ``buckets``: the batch is dealt likewise and the existing rows stay in place.
    """
    batch = df.where(truthy(key))
    if buckets is None:
        return absent(keep_first(batch, key, order), existing, key)
    batch = keep_first(batch.repartition(buckets, key), key, order)
    known = existing.where(truthy(key)).select(key).distinct()
    return batch.join(known.hint("merge"), key, "left_anti")


def known_values(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct non-blank values of one key of ``extra``."""
    value = chunks.select(F.col("extra")[key].alias(key))
    return value.where(truthy(key)).distinct()


def known_entries(chunks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Distinct ``(key, value)`` of several keys of ``extra`` in one pass."""
    entries = chunks.select(F.explode("extra").alias("key", "value"))
    return entries.where(F.col("key").isin(list(keys)) & truthy("value")).distinct()


def known_chunk_ids(chunks: DataFrame) -> DataFrame:
    return chunks.where(truthy("chunk_id")).select("chunk_id").distinct()
