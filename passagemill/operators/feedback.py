"""Feedback records and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill import values as V
from passagemill.functions.text import strip
from passagemill.sources import schema as S


def top_sources(results: DataFrame, n: int = V.FEEDBACK_SOURCES) -> DataFrame:
    """``(query_id, retrieval_sources)``: the first ``n`` results as structs in rank order."""
    item = F.struct(
        F.col("rank").cast("int").alias("rank"), "score", "title", "url", "source_type", "date",
        "chunk_id", F.col("extra")["doc_id"].alias("doc_id"),
    )
    return results.where(F.col("rank") <= n).groupBy("query_id").agg(
        F.array_sort(F.collect_list(item)).alias("retrieval_sources")
    )


def feedback_records(
    ratings: DataFrame, answers: DataFrame, results: DataFrame, settings: dict | None = None
) -> DataFrame:
    """Rating records ``(query_id, ts, rating, comment)`` with answer and sources."""
    settings = settings or {}
    types = {f.name: f.dataType for f in S.FEEDBACK.fields}
    no_sources = F.array().cast(types["retrieval_sources"])
    joined = ratings.join(answers, "query_id", "left").join(
        top_sources(results), "query_id", "left"
    )
    made = {
        "ts": F.col("ts").cast("string"),
        "query": F.coalesce("query", F.lit("")),
        "comment": strip(F.coalesce("comment", F.lit(""))),
        "rating": F.col("rating").cast("int"),
        "answer_snippet": F.left(F.coalesce("markdown", F.lit("")), F.lit(V.ANSWER_SNIP)),
        "used_sources": F.coalesce("used_sources", F.array().cast("array<int>")),
        "warnings": F.coalesce("warnings", F.array().cast("array<string>")),
        "retrieval_sources": F.coalesce("retrieval_sources", no_sources),
    }
    for name, value in settings.items():
        if name == "doc_scope_ids":
            value = sorted(value)
        made[name] = F.lit(value).cast(types[name])
    return joined.select("query_id", *[
        made.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in S.FEEDBACK.fields
    ])


def verdict_records(verdicts: DataFrame) -> DataFrame:
    """Verdict records from ``(ts, query, verdict, comment[, top_urls, meta])``."""
    have = set(verdicts.columns)
    made = {
        "ts": F.col("ts").cast("string"),
        "query": strip(F.col("query")),
        "verdict": F.col("verdict"),
        "comment": strip(F.coalesce("comment", F.lit(""))),
        "top_urls": F.coalesce("top_urls", F.array().cast("array<string>"))
        if "top_urls" in have else F.array().cast("array<string>"),
        "meta": F.coalesce("meta", F.create_map().cast("map<string,string>"))
        if "meta" in have else F.create_map().cast("map<string,string>"),
    }
    return verdicts.select(*[
        made.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in S.FEEDBACK.fields
    ])


def bad_feedback(log: DataFrame) -> DataFrame:
    """Entries rated -1; none where the log has no ratings."""
    return log.where(F.col("rating") == -1) if "rating" in log.columns else log.limit(0)


def feedback_counts(log: DataFrame) -> DataFrame:
    """Entries by rating and verdict."""
    return log.groupBy("rating", "verdict").agg(F.count("*").alias("n"))
