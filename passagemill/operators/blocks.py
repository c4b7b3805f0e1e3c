"""Exact best-k of questions x chunks without a cross join.

Questions whose encoding is proven small are shipped to every task, which scores
its own chunks block by block and keeps the best k per question; no chunk is
shuffled.  Larger question sets are cut into blocks within the same bounds; each
block is one pass over the chunks, whose result is written before the next one
starts.  Either way a task only emits candidates for the final best-k per question.

Vectors are scored from the longest on: the product of two lengths bounds a score,
so a tile of chunks is left out for the questions that it can no longer change.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill import values as V
from passagemill.operators.ranking import top_per_group
from passagemill.session import scratch_path

# Bounds of what is shipped to every task, and of the arrays a task works on.
MAX_SHIPPED_ROWS = 50_000
MAX_SHIPPED_VALUES = 8_000_000
MAX_CELLS = 4_000_000
TILE_ROWS = 2_000
SCORING_WAVES = 8
BOUND_SLACK = 2e-6  # above the rounding of a score and of its bound


def _round(scores: np.ndarray) -> np.ndarray:
    """Half-up at the fixed number of digits, as SQL engines round."""
    factor = 10.0 ** V.SCORE_DIGITS
    return np.sign(scores) * np.floor(np.abs(scores) * factor + 0.5) / factor


class Best:
    """Running best k per question over any number of score blocks."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.floor = np.full(n_queries, -np.inf)
        self.parts: list[pd.DataFrame] = []
        self.pending = 0

    def offer(
        self, scores: np.ndarray, ids: np.ndarray, valid: np.ndarray | None = None,
        queries: np.ndarray | slice = slice(None),
    ) -> None:
        """``scores`` is chunks x ``queries``; ties at the cut stay until ids decide."""
        if valid is not None:
            scores = np.where(valid, scores, -np.inf)
        if len(scores) > self.k:
            at = len(scores) - self.k
            own = np.where(np.isnan(scores), -np.inf, scores)
            self.floor[queries] = np.maximum(self.floor[queries], np.partition(own, at, axis=0)[at])
        row, query = np.nonzero((scores >= self.floor[queries]) & np.isfinite(scores))
        if len(row):
            self.parts.append(pd.DataFrame({
                "query": np.arange(len(self.floor))[queries][query], "score": scores[row, query],
                "chunk_id": ids[row],
            }))
            self.pending += len(row)
        if self.pending > max(200_000, 4 * self.k * len(self.floor)):
            self.prune()

    def prune(self) -> pd.DataFrame:
        if not self.parts:
            return pd.DataFrame({
                "query": np.empty(0, int), "score": np.empty(0), "chunk_id": np.empty(0, object)
            })
        best = pd.concat(self.parts, ignore_index=True).sort_values(
            ["query", "score", "chunk_id"], ascending=[True, False, True], ignore_index=True
        )
        place = best.groupby("query").cumcount()
        best = best[place < self.k]
        last = best.groupby("query")["score"].agg(["size", "last"])
        full = last[last["size"] == self.k]
        self.floor[full.index.to_numpy()] = full["last"].to_numpy()
        self.parts, self.pending = [best], len(best)
        return best


def _flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values of a list column and the row each value belongs to."""
    rows = pc.list_parent_indices(column).to_numpy()
    return pc.list_flatten(column), rows


class DenseQuestions:
    """Inner products of float vectors."""

    value, extra = "embedding", ()

    def __init__(self, table: pa.Table):
        self.ids = table.column("query_id").to_pylist()
        self.matrix = self._matrix(table.column("embedding").combine_chunks())
        self.length = np.linalg.norm(self.matrix, axis=1)

    @staticmethod
    def _matrix(column: pa.Array) -> np.ndarray:
        values, _ = _flat(column)
        return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)

    def score(self, batch: pa.RecordBatch, best: Best) -> None:
        vectors = self._matrix(batch.column("embedding"))
        ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)
        lengths = np.linalg.norm(vectors, axis=1)
        order = np.argsort(-lengths, kind="stable")  # nan last: such scores are no results
        step = max(1, min(TILE_ROWS, MAX_CELLS // max(1, len(self.ids))))
        for at in range(0, len(ids), step):
            tile = order[at:at + step]
            bound = lengths[tile[0]] * self.length + BOUND_SLACK * (1 + lengths[tile[0]] * self.length)
            within = np.flatnonzero(~(bound < best.floor))
            if not len(within):
                break  # what follows is shorter still
            best.offer(_round(vectors[tile] @ self.matrix[within].T), ids[tile], queries=within)


class TermQuestions:
    """Cosine of term counts; integer sums, so the score is the same everywhere."""

    value, extra = "terms", ("norm2",)

    def __init__(self, table: pa.Table):
        self.ids = table.column("query_id").to_pylist()
        self.norm2 = table.column("norm2").to_numpy().astype(np.float64)
        terms, rows = _flat(table.column("terms").combine_chunks())
        counted = (
            pd.DataFrame({"term": terms.to_pandas(), "query": rows})
            .value_counts(sort=False).reset_index(name="tf").sort_values(["term", "query"])
        )
        vocabulary, start = np.unique(counted["term"].to_numpy(dtype=object).astype(str), return_index=True)
        self.vocabulary = pa.array(vocabulary, pa.string())
        self.start = np.append(start, len(counted))
        self.query = counted["query"].to_numpy()
        self.tf = counted["tf"].to_numpy().astype(np.float64)

    def score(self, batch: pa.RecordBatch, best: Best) -> None:
        ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)
        norm2 = batch.column("norm2").to_numpy(zero_copy_only=False).astype(np.float64)
        terms, rows = _flat(batch.column("terms"))
        found = pc.index_in(terms, value_set=self.vocabulary)
        hit = pc.is_valid(found).to_numpy(zero_copy_only=False)
        rows = rows[hit]
        term = pc.drop_null(found).to_numpy().astype(np.int64)
        width = self.start[term + 1] - self.start[term]
        n = len(self.ids)
        # Rows per step so that postings and score cells of a step stay bounded.
        cost = np.bincount(rows, weights=width, minlength=len(ids)) + n
        steps = (np.cumsum(cost) // MAX_CELLS).astype(np.int64)
        cuts = np.flatnonzero(np.diff(steps, prepend=-1, append=steps[-1] + 1 if len(steps) else 0))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            a, b = np.searchsorted(rows, [lo, hi])
            w = width[a:b]
            offset = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            posting = np.repeat(self.start[term[a:b]], w) + offset
            cell = np.repeat(rows[a:b] - lo, w) * n + self.query[posting]
            dots = np.bincount(cell, weights=self.tf[posting], minlength=(hi - lo) * n)
            dots = dots.reshape(hi - lo, n)
            length = np.sqrt(norm2[lo:hi, None] * self.norm2[None, :])
            with np.errstate(invalid="ignore", divide="ignore"):
                scores = _round(np.where(dots > 0, dots / length, 0.0))
            best.offer(scores, ids[lo:hi], dots > 0)


METHODS = {"vector": DenseQuestions, "lexical": TermQuestions}


def _emit(questions, best: Best, schema: pa.Schema) -> pa.RecordBatch:
    kept = best.prune()
    ids = pa.array(questions.ids, schema.field("query_id").type)
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(kept["query"].to_numpy(), pa.int64())),
            pa.array(kept["chunk_id"].to_numpy(dtype=object), pa.string()),
            pa.array(kept["score"].to_numpy(dtype=float), pa.float64()),
        ],
        schema=schema,
    )


def _arrow_type(spark_type: T.DataType) -> pa.DataType:
    if isinstance(spark_type, T.StringType):
        return pa.string()
    if isinstance(spark_type, T.LongType):
        return pa.int64()
    if isinstance(spark_type, T.IntegerType):
        return pa.int32()
    raise TypeError(f"query_id must be string, int or bigint, not {spark_type.simpleString()}")


def best_pairs(
    queries: DataFrame, index: DataFrame, k: int, method: str = "vector", block_rows: int | None = None
) -> tuple[DataFrame, int]:
    """``(query_id, chunk_id, score, rank)`` of the k best chunks of each question,
    and the number of questions, which bounds the size of the result.

    More than ``block_rows`` questions (by default the bound of what is shipped) are
    answered block by block; the result is the same.
    """
    most = min(block_rows or MAX_SHIPPED_ROWS, MAX_SHIPPED_ROWS)
    kind = METHODS[method]
    wanted = [kind.value, *kind.extra]
    asked = queries.select("query_id", *wanted).where(F.col(kind.value).isNotNull())
    chunks = index.select("chunk_id", *wanted).where(F.col(kind.value).isNotNull())
    id_type = queries.schema["query_id"].dataType
    spark_schema = T.StructType([
        T.StructField("query_id", id_type),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ])
    out = pa.schema([
        ("query_id", _arrow_type(id_type)), ("chunk_id", pa.string()), ("score", pa.float64()),
    ])
    size = asked.agg(*_size(kind)).first()
    order = [F.desc("score"), F.asc("chunk_id")]

    def ranked(part: DataFrame):
        pairs, shared = _shipped(kind, part, chunks, k, spark_schema, out)
        return top_per_group(pairs, ["query_id"], order, k), shared

    if _fits(size, most):
        return ranked(asked)[0], size["rows"]
    return _in_turns(kind, asked, ranked, size, most), size["rows"]


def _size(kind) -> list[Column]:
    values = F.coalesce(F.sum(F.size(kind.value)), F.lit(0))
    return [F.count("*").alias("rows"), values.alias("values")]


def _fits(size, most: int) -> bool:
    return size["rows"] <= most and size["values"] <= MAX_SHIPPED_VALUES


def _shipped(kind, asked, chunks, k, spark_schema, out):
    """Candidates of questions within the bounds, and the broadcast they need."""
    shared = chunks.sparkSession.sparkContext.broadcast(asked.toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value.num_rows == 0:
            return
        questions = kind(shared.value)
        best = Best(len(questions.ids), k)
        for batch in batches:
            if batch.num_rows:
                questions.score(batch, best)
        yield _emit(questions, best, out)

    # Every task emits up to k rows per question, so a corpus of very many splits is
    # read by a few waves of larger tasks; fewer splits stay as they are.
    tasks = SCORING_WAVES * chunks.sparkSession.sparkContext.defaultParallelism
    return chunks.coalesce(tasks).mapInArrow(run, spark_schema), shared


def _in_turns(kind, asked: DataFrame, ranked, size, most: int) -> DataFrame:
    """Best pairs of questions dealt by hash to blocks that fit; the largest block is
    measured, not estimated, and a question alone always is a block."""
    spark = asked.sparkSession
    blocks = 2 * max(ceil(size["rows"] / most), ceil(size["values"] / MAX_SHIPPED_VALUES))
    while True:
        dealt = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        measured = dealt.groupBy("_block").agg(*_size(kind))
        if blocks >= 4 * size["rows"] or _fits(measured.agg(*(F.max(c).alias(c) for c in ("rows", "values"))).first(), most):
            break
        blocks *= 2
    path, found = scratch_path(spark, "questions"), scratch_path(spark, "best_pairs")
    dealt.repartition("_block").write.partitionBy("_block").parquet(path)
    stored = spark.read.schema(dealt.schema).parquet(path)
    for block in range(blocks):
        pairs, shared = ranked(stored.where(F.col("_block") == block).drop("_block"))
        pairs.write.mode("append").parquet(found)
        shared.destroy()
    return spark.read.schema(pairs.schema).parquet(found)
