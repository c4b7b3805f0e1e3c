"""Result filters by source type and document scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.operators.ranking import with_rank


def _type_in(types) -> Column:
    return F.lower(F.coalesce("source_type", F.lit(""))).isin([t.lower() for t in types])


def _doc_in(df: DataFrame, doc_ids) -> tuple[DataFrame, Column]:
    """The results and a condition on them: a list of ids, or a table with a ``doc_id`` column
    of any size, which is joined."""
    own = F.col("extra")["doc_id"]
    if not isinstance(doc_ids, DataFrame):
        return df, F.coalesce(own.isin(list(doc_ids)), F.lit(False))
    scope = doc_ids.select(F.col("doc_id").alias("_scope")).where("_scope is not null").distinct()
    return df.join(scope, own == F.col("_scope"), "left"), F.col("_scope").isNotNull()


def _rerank(df: DataFrame) -> DataFrame:
    return with_rank(df, ["query_id"], [F.asc("_before")]).drop("_before")


def filter_results(results: DataFrame, types=None, doc_ids=None) -> DataFrame:
    """Strict form: an empty set does not filter; a question may lose all results."""
    df = results.withColumnRenamed("rank", "_before")
    if types:
        df = df.where(_type_in(types))
    if isinstance(doc_ids, DataFrame) or doc_ids:
        df, inside = _doc_in(df, doc_ids)
        df = df.where(inside).drop("_scope")
    return _rerank(df)


def _keep_or_all(df: DataFrame, ok: Column) -> DataFrame:
    per_query = Window.partitionBy("query_id")
    return (
        df.withColumn("_ok", ok)
        .withColumn("_any", F.max("_ok").over(per_query))
        .where(F.col("_ok") | ~F.col("_any"))
        .drop("_ok", "_any")
    )


def filter_fallback(
    results: DataFrame, types, doc_ids=(), scope_enabled: bool = False
) -> DataFrame:
    """Lenient form: a filter that would leave a question without results is skipped.

    Here an empty type set matches nothing, hence keeps everything.  Groups are
    at most the candidate count per question, so the windows stay small.
    """
    df = results.withColumnRenamed("rank", "_before")
    if types:
        df = _keep_or_all(df, _type_in(types))
    if scope_enabled and (isinstance(doc_ids, DataFrame) or doc_ids):
        df = _keep_or_all(*_doc_in(df, doc_ids)).drop("_scope")
    return _rerank(df)
