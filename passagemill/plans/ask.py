"""Asking a batch of questions, and measuring retrieval over a rule set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill import values as V
from passagemill.operators.answers import ENGLISH, Wording, extractive_answers
from passagemill.operators.evaluation import eval_metrics, eval_rows, with_settings
from passagemill.operators.filters import filter_fallback
from passagemill.operators.rerank import Scorer
from passagemill.operators.rerank import rerank as second_stage
from passagemill.operators.search import cut, search
from passagemill.session import materialize


def retrieve(
    queries: DataFrame,
    index: DataFrame,
    top_k: int = V.TOP_K,
    min_score: float = V.MIN_SCORE,
    keyword_filter: bool = True,
    types=None,
    doc_ids=(),
    scope_enabled: bool = False,
    scorer: Scorer | None = None,
    top_n: int = V.RERANK_TOP_N,
    method: str = "vector",
    chunks: DataFrame | None = None,
) -> DataFrame:
    """Search, lenient filters, then second-stage scoring or the plain cut to ``top_k``."""
    found = search(queries, index, top_k, min_score, keyword_filter, method=method, chunks=chunks)
    kept = filter_fallback(found, types, doc_ids, scope_enabled)
    return cut(kept, top_k) if scorer is None else second_stage(kept, scorer, top_n, top_k)


def ask(
    queries: DataFrame, index: DataFrame, wording: Wording = ENGLISH, **options
) -> tuple[DataFrame, DataFrame]:
    """``(answers, results)``; blank questions are left out.

    The results are a few rows per question and feed several consumers, so they
    are written once.
    """
    asked = queries.where(F.trim("query") != "")
    results = materialize(retrieve(asked, index, **options), "results")
    return extractive_answers(results, asked, wording), results


def evaluate(
    rules: DataFrame,
    encode: Callable[[DataFrame], DataFrame],
    index: DataFrame,
    top_k: int = V.TOP_K,
    cut_ranks: bool = True,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """``(rows, metrics)`` of all rules at once.

    ``encode`` turns the rules' questions into what the index is scored with;
    with ``cut_ranks=False`` every candidate that passes the filters counts.
    """
    queries = encode(rules.select("query_id", "query"))
    mode = "index" if options.get("scorer") is None else "reranker"
    if cut_ranks:
        results = retrieve(queries, index, top_k, **options)
    else:
        results = search(queries, index, top_k, **options)
    rows = materialize(eval_rows(rules, results, top_k, cut_ranks, mode), "eval")
    settings = {
        "mode": mode,
        "min_score": float(options.get("min_score", V.MIN_SCORE)),
        "keyword_filter": bool(options.get("keyword_filter", True)),
    }
    return rows, with_settings(eval_metrics(rows, top_k), **settings)
