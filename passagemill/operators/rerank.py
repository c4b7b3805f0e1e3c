"""Second-stage scoring of the candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill import values as V
from passagemill.functions.text import keywords
from passagemill.operators.ranking import with_rank

Scorer = Callable[[Column, Column, Column], Column]


def keyword_share(query: Column, text: Column, score: Column) -> Column:
    """Offline default: prior score plus the share of question keywords in the text."""
    kws = keywords(query)
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = F.size(F.filter(kws, lambda k: low.contains(k)))
    share = F.when(F.size(kws) > 0, hits / F.size(kws)).otherwise(F.lit(0.0))
    return F.round(score + share, V.SCORE_DIGITS)


def model_scorer(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> Scorer:
    """Scorer around a pair model; ``load()`` runs once per Python worker."""

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for query, text in batches:
            pairs = list(zip(query.fillna(""), text.fillna("")))
            yield pd.Series(model(pairs), dtype="float64")

    return lambda query, text, score: run(query, text)


def rerank(
    results: DataFrame,
    scorer: Scorer = keyword_share,
    top_n: int = V.RERANK_TOP_N,
    top_k: int = V.TOP_K,
    enabled: bool = True,
) -> DataFrame:
    """Score the first ``top_n`` results again, order by the new score (ties keep
    their order) and keep ``top_k``.  Disabled: results as they are."""
    if not enabled:
        return results
    rescored = (
        results.where(F.col("rank") <= top_n)
        .withColumn("score", scorer(F.col("query"), F.col("text"), F.col("score")))
        .withColumnRenamed("rank", "_before")
    )
    ranked = with_rank(rescored, ["query_id"], [F.desc("score"), F.asc("_before")])
    return ranked.where(F.col("rank") <= max(top_k, 1)).drop("_before")
