"""Batch search: best candidates, then score, noise and keyword filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill import values as V
from passagemill.functions.predicates import is_noise, matches_keywords
from passagemill.functions.text import keywords
from passagemill.operators.blocks import best_pairs
from passagemill.operators.ranking import with_rank
from passagemill.operators.termindex import TermIndex, best_by_terms
from passagemill.sources.schema import CHUNK_COLUMNS

# Best pairs are joined back by broadcast only while their number is provably small.
MAX_BROADCAST_PAIRS = 500_000


def candidates(
    queries: DataFrame, index: DataFrame | TermIndex, k: int, method: str = "vector",
    chunks: DataFrame | None = None, block_rows: int | None = None, least: float = 0.0,
) -> DataFrame:
    """The k best chunks of each question with their columns: ``query_id, query,
    keywords, first_rank, score, chunk...``; no filter applied.

    A stored term index is searched by its postings; its chunk table is read for
    the best chunks only, and scores below ``least`` may be left out there.
    """
    stored = isinstance(index, TermIndex)
    if chunks is not None and not stored:  # an encoding without its chunk must not take a place among the best
        index = index.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    pairs, n_queries = best_by_terms(queries, index, k, least) if stored else best_pairs(queries, index, k, method, block_rows)
    pairs = pairs.withColumnRenamed("rank", "first_rank")
    if n_queries * k <= MAX_BROADCAST_PAIRS:
        pairs = F.broadcast(pairs)
    asked = queries.select("query_id", "query", keywords(F.col("query")).alias("keywords"))
    described = index.chunks if stored else index if chunks is None else chunks
    return described.select(*CHUNK_COLUMNS).join(pairs, "chunk_id").join(asked, "query_id")


def search(
    queries: DataFrame,
    index: DataFrame | TermIndex,
    top_k: int = V.TOP_K,
    min_score: float = V.MIN_SCORE,
    keyword_filter: bool = True,
    internal_k: int | None = None,
    method: str = "vector",
    chunks: DataFrame | None = None, block_rows: int | None = None,
) -> DataFrame:
    """Every candidate that passes the filters, ranked again per question.

    The filters run after the cut to ``internal_k``, so fewer rows than
    ``top_k`` may remain; the caller cuts to ``top_k``.  Where the index holds
    only ids and encodings, ``chunks`` gives the chunk columns.  ``block_rows`` bounds
    the questions answered in one pass over an index of encodings.
    """
    k = V.internal_k(top_k) if internal_k is None else internal_k
    found = candidates(queries, index, k, method, chunks, block_rows, min_score)
    text = F.col("text")
    useful = ~is_noise(text)
    if keyword_filter:
        useful = useful & matches_keywords(text, F.col("title"), F.col("url"), F.col("keywords"))
    # One condition that starts from the score: Spark would move a test of the text
    # alone below the join and run it on every chunk of the corpus.
    passed = found.where(F.when(F.col("score") >= min_score, useful).otherwise(False))
    return with_rank(passed, ["query_id"], [F.asc("first_rank")]).drop("first_rank", "keywords")


def cut(results: DataFrame, n: int) -> DataFrame:
    return results.where(F.col("rank") <= n)
