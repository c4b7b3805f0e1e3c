"""Exact top-k inner products on a bit-sliced index.

Every component is an integer of ``SLICES`` bits; slice s of component j is a
bitmap over the rows of an index block.  A query's score is a sum of shifted
slices (complemented under a negative weight), added up by carry-save adders on
whole bitmaps.  The best rows are then selected from the most significant slice
of the sum downward; rows that tie at the boundary are resolved by id.

Index blocks meet query blocks of a fixed size, which are broadcast one after
the other; every task returns k rows per query and block, and the best k of
these are ranked.

Vectors too wide for sums of 64 bits (``SPAN``) are kept as doubles, in blocks of
their own, and scored in Python's integers; so are wide queries in all blocks.

Cases: vectors that are null or hold null or non-finite components take no part;
vectors of different lengths are multiplied over the components both have, as
the SQL does, and without any the score is null and ranks last; a score beyond
64 bits ranks by its exact value and is shown as null; equal scores go to the
smaller id; repeated ids never answer a query of that id; fewer rows than k give
all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.session import materialize

SCALE = 64
BLOCK = 16_384  # rows of an index block
QUERY_BLOCK = 8_192  # queries broadcast at once
SPAN = 1 << 20  # wider components aren't sliced
WIDEST = float(1 << 62)  # sum of squares up to which scores surely fit into 64 bits
HITS = "query_id long, vec_id long, score long, side int, big binary"


def quantised(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``v`` array of floor(64 x) as long, null where ``x``, the components, is too wide; only finite vectors."""
    x = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    )
    squares = F.aggregate(x, F.lit(0.0), lambda s, c: s + (F.abs(c) * SCALE + 1) * (F.abs(c) * SCALE + 1))
    narrow = F.forall(x, lambda c: F.abs(c) < float(SPAN)) & (squares < WIDEST)
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding")).where(good).select(
        "vec_id", F.when(narrow, F.transform(x, lambda c: F.floor(c * SCALE).cast("long"))).alias("v"),
        F.when(~narrow, x).alias("x"),
    )


def exact(components: list[float]) -> list[int]:
    """floor(64 x) of each, of any size."""
    return [int(c) * SCALE if abs(c) >= SPAN << 33 else math.floor(c * SCALE) for c in components]


def order_key(score: int) -> bytes:
    """Bytes that rise with a score beyond 64 bits, among scores of its sign."""
    size = abs(score)
    raw = size.to_bytes(-(-size.bit_length() // 8), "big")
    raw = len(raw).to_bytes(4, "big") + raw
    return raw if score > 0 else bytes(255 - b for b in raw)


def pack_bits(matrix: np.ndarray, slices: int) -> np.ndarray:
    """Bitmaps (component, slice, words) of a non-negative matrix rows x components."""
    rows, width = matrix.shape
    words = -(-rows // 64)
    padded = np.zeros((words * 64, width), np.uint64)
    padded[:rows] = matrix
    out = np.empty((width, slices, words), np.uint64)
    for s in range(slices):
        bits = ((padded >> np.uint64(s)) & np.uint64(1)).astype(np.uint8).T.copy()
        out[:, s] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return out


def add_slices(levels: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Sum of bitmaps by weight: carry-save adders, three of a weight to one and a carry."""
    out, level = [], 0
    while level < len(levels):
        stack = levels[level]
        while (number := sum(len(s) for s in stack)) > 1:
            maps = stack[0] if len(stack) == 1 else np.concatenate(stack)
            third = number // 3
            if third:
                a, b, c = maps[:third], maps[third : 2 * third], maps[2 * third : 3 * third]
                half = a ^ b
                carry, total = (a & b) | (c & half), half ^ c
                rest = maps[3 * third :]
            else:
                carry, total, rest = maps[:1] & maps[1:], maps[:1] ^ maps[1:], maps[2:]
            if level + 1 == len(levels):
                levels.append([])
            levels[level + 1].append(carry)
            stack = [total, rest] if len(rest) else [total]
        out.append(stack[0][0] if number else None)
        level += 1
    words = next((m for m in out if m is not None), None)
    return [np.zeros_like(words) if m is None else m for m in out] if words is not None else []


def select_top(slices: list[np.ndarray], valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows surely among the k best, and the rows that tie at the boundary."""
    sure, tied = np.zeros_like(valid), valid.copy()
    have = 0
    for bitmap in reversed(slices):
        ones = tied & bitmap
        number = int(np.bitwise_count(ones).sum())
        if have + number > k:
            tied = ones
        else:
            sure |= ones
            have += number
            tied = tied & ~bitmap
            if have == k:
                tied = np.zeros_like(tied)
                break
    return sure, tied


def rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


class Block:
    """The bit-sliced index of some rows."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, matrix = ids[order], matrix[order]
        self.low = int(matrix.min())
        self.slices = max(1, int(matrix.max() - self.low).bit_length())
        self.matrix = matrix
        self.maps = pack_bits((matrix - self.low).astype(np.uint64), self.slices)
        self.all = pack_bits(np.ones((len(ids), 1), np.uint64), 1)[0, 0]

    def best(self, query: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        size = np.abs(weights).astype(np.uint64)
        negative = weights < 0
        maps = np.where(negative[:, None, None], ~self.maps, self.maps) if negative.any() else self.maps
        levels: list[list[np.ndarray]] = [[] for _ in range(int(size.max()).bit_length() + self.slices - 1)]
        for b in range(int(size.max()).bit_length()):
            used = np.flatnonzero((size >> np.uint64(b)) & np.uint64(1))
            if len(used):
                for s in range(self.slices):
                    levels[b + s].append(maps[used, s])
        valid = self.all.copy()
        own = slice(*np.searchsorted(self.ids, [query, query + 1]))
        for row in range(own.start, own.stop):
            valid[row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
        sure, tied = select_top(add_slices(levels), valid, k)
        rows = rows_of(sure)
        rows = np.r_[rows, rows_of(tied)[: k - len(rows)]]  # rows are in id order
        return self.ids[rows], self.matrix[rows] @ weights


def _scorer(shipped, k: int):
    """The best k of one index block for every query of the block shipped."""

    def score(block: pd.DataFrame) -> pd.DataFrame:
        wide = bool(block["v"].isna().any())
        rows = [exact(x) if v is None else list(v) for v, x in zip(block["v"], block["x"])]
        ids, width = block["vec_id"].to_numpy(), max(map(len, rows))
        none = np.zeros(0, np.int64)
        index = None
        if width and not wide:
            matrix = np.zeros((len(rows), width), np.int64)  # what a shorter vector lacks counts nothing
            for n, r in enumerate(rows):
                matrix[n, : len(r)] = r
            index = Block(ids, matrix)
        found = []  # query, ids, scores, sides and keys
        for q, v, x in shipped.value:
            if index is not None and v is not None and len(v):
                weights = np.zeros(width, np.int64)
                weights[: min(width, len(v))] = v[:width]
                if weights.any():
                    best, scores = index.best(q, weights, k)
                else:
                    best = np.sort(ids[ids != q])[:k]
                    scores = np.zeros(len(best), np.int64)
                found.append((q, best, scores.tolist(), [0] * len(best), [None] * len(best)))
                continue
            asked = exact(x) if v is None else v.tolist()
            ranked = []
            for i, r in zip(ids.tolist(), rows):
                if i != q:
                    total = sum(int(a) * int(b) for a, b in zip(asked, r))
                    ranked.append((not (asked and r), -total, i))
            ranked = heapq.nsmallest(k, ranked)
            fits = [-(1 << 63) <= -t < 1 << 63 for _, t, _ in ranked]
            found.append((
                q, np.array([i for _, _, i in ranked], np.int64), [-t if f and not e else None for f, (e, t, _) in zip(fits, ranked)],
                [-2 if e else 0 if f else 1 if t < 0 else -1 for f, (e, t, _) in zip(fits, ranked)],
                [None if f else order_key(-t) for f, (_, t, _) in zip(fits, ranked)],
            ))
        return pd.DataFrame({
            "query_id": np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found]),
            "vec_id": np.concatenate([none, *(f[1] for f in found)]),
            "score": pd.array([s for f in found for s in f[2]], "Int64"),
            "side": np.array([s for f in found for s in f[3]], np.int32),
            "big": pd.Series([s for f in found for s in f[4]], dtype=object),
        })

    return score


def search(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for each query, all rows searched."""
    spark = vectors.sparkSession
    rows = materialize(quantised(vectors), "quantised")
    asked = materialize(quantised(queries).distinct(), "queries")
    # rows of a block are of similar length and either narrow or wide
    kind = F.coalesce(F.length(F.bin(F.size("v"))) * F.when(F.size("v") > 0, 1).otherwise(0), -F.length(F.bin(F.size("x"))))
    rows = rows.withColumn("kind", kind)
    sizes = {r[0]: max(1, -(-r[1] // block)) for r in rows.groupBy("kind").count().collect()}  # at most 64
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = F.element_at(F.create_map(*(F.lit(x) for pair in sizes.items() for x in pair)), F.col("kind"))
    number = asked.count()
    passes = -(-number // QUERY_BLOCK)
    hits = None
    for n in range(passes):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == n) if passes > 1 else asked
        pdf = part.toPandas()
        shipped = spark.sparkContext.broadcast([
            (int(q), None if v is None else np.array(v, np.int64), x) for q, v, x in zip(pdf["vec_id"], pdf["v"], pdf["x"])
        ])

        dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks))
        done = dealt.groupBy("kind", "block").applyInPandas(_scorer(shipped, k), HITS)
        hits = done if hits is None else hits.union(done)
    if hits is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    own = Window.partitionBy("query_id").orderBy(F.desc("side"), F.desc("big"), F.desc("score"), "vec_id")
    return materialize(hits, "hits").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
