"""Corpus statistics, document labels and per-question counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.operators.dedup import truthy
from passagemill.operators.ranking import keep_first
from passagemill.sources.jsonl import is_object


def corpus_stats(chunks: DataFrame, by: str) -> DataFrame:
    """Chunks per non-blank value of a column."""
    return chunks.where(truthy(by)).groupBy(by).agg(F.count("*").alias("n"))


def type_stats(lines: DataFrame, absent: str = "other") -> DataFrame:
    """Chunks per source type from JSON lines: a missing key counts as ``absent``,
    a blank or null value does not count."""
    keys = F.map_keys(F.from_json("value", "map<string,string>"))
    kind = F.when(
        F.array_contains(keys, "source_type"),
        F.from_json("value", "source_type string")["source_type"],
    ).otherwise(F.lit(absent))
    return corpus_stats(
        lines.where(is_object(F.col("value"))).select(kind.alias("source_type")), "source_type"
    )


def doc_labels(chunks: DataFrame, source_type: str = "local") -> DataFrame:
    """``(doc_id, label)``: file name, saved name or id of each document of a type."""
    extra = F.col("extra")
    own = chunks.where(F.lower("source_type") == source_type).select(
        "chunk_id",
        extra["doc_id"].alias("doc_id"),
        F.coalesce(
            F.nullif(extra["file_name"], F.lit("")),
            F.nullif(extra["saved_as"], F.lit("")),
            extra["doc_id"],
        ).alias("label"),
    )
    return keep_first(own.where(truthy("doc_id")), "doc_id", [F.asc("chunk_id")]).drop("chunk_id")


def retrieval_debug(
    queries: DataFrame, searched: DataFrame, filtered: DataFrame, returned: DataFrame, mode: str,
    internal_k: int, min_score: float, keyword_filter: bool,
) -> DataFrame:
    """Result counts of each question after every stage, with the settings used."""
    out = queries.select("query_id")
    stages = {"after_search": searched, "after_filters": filtered, "returned": returned}
    for name, df in stages.items():
        counts = df.groupBy("query_id").agg(F.count("*").alias(name))
        out = out.join(counts, "query_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.withColumns({
        "internal_k": F.lit(internal_k), "mode": F.lit(mode), "min_score": F.lit(min_score),
        "keyword_filter": F.lit(keyword_filter),
    })
