"""Helpers of the operators: text as bytes, per-worker caches, anchors, ragged arrays."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
POSITION_BITS = 24
MAX_ANCHOR_UNITS = 1 << 23  # units hashed at once; below 2 ** POSITION_BITS
PART_BYTES = 1 << 20  # of short texts hashed at once


def text_bytes(name: str = "text") -> Column:
    """The whole text as UTF-8 bytes; a null text is empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def text_key(name: str = "text") -> Column:
    """128-bit digest of the whole text: equal texts share it."""
    return F.unhex(F.md5(text_bytes(name)))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_cache(name: str, make: Callable):
    """A value kept by the Python worker process, so that tasks share it.

    Task code travels by value, hence its own globals live for one task only.
    """
    holder = sys.modules.setdefault("_passagemill_llm_cache", types.ModuleType("_passagemill_llm_cache"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def parts_of(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows of about ``limit`` bytes; a longer row stands alone."""
    data = batch.column(batch.schema.get_field_index(column))
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(data), 0), dtype=np.int64)
    ends = np.cumsum(size)
    start = 0
    while start < len(size):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    give_back()  # workers live on between batches and jobs


def give_back() -> None:
    """Return memory that this worker has freed to the system, as far as its allocators can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` neighbours."""
    out, step = values, 1
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every run of ``gram`` units (a power of two) from the units' hashes."""
    out, step, factor = values, 1, 0x9E3779B97F4A7C15
    while step < gram:
        out = out[:-step] * np.uint64(factor) + out[step:]
        out ^= out >> np.uint64(31)
        factor = (factor * factor) % (1 << 64) | 1
        step *= 2
    out = out * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def anchor_runs(units: np.ndarray, lengths: np.ndarray, gram: int, window: int):
    """Runs of window starts that share an anchor.

    ``units`` holds the unit hashes of several texts in a row, ``lengths`` their
    lengths.  The anchor of a window is the leftmost of its grams with the least
    hash, so equal windows have equal anchors at equal places.  Returns arrays
    (text, first start, end of starts, anchor, key of the anchor's gram) with
    positions relative to the text.
    """
    none = np.zeros(0, np.int64)
    if len(units) < window:
        return none, none, none, none, np.zeros(0, np.uint64)
    mask = np.uint64((1 << POSITION_BITS) - 1)
    keys = gram_hashes(units, gram)
    ranked = (keys & ~mask) | np.arange(len(keys), dtype=np.uint64)
    least = sliding_min(ranked, window - gram + 1)
    begin = np.cumsum(lengths) - lengths
    counts = np.maximum(lengths - window + 1, 0)
    starts = ragged(begin, counts)
    if not len(starts):
        return none, none, none, none, np.zeros(0, np.uint64)
    least = least[starts]
    cut = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    first = starts[cut]
    last = starts[np.r_[cut[1:], len(starts)] - 1]
    anchor = (least[cut] & mask).astype(np.int64)
    text = np.searchsorted(np.cumsum(counts), cut, side="right")
    base = begin[text]
    return text, first - base, last + 1 - base, anchor - base, keys[anchor]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + count - 1`` of all ranges in a row."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return np.arange(total, dtype=np.int64) + shift


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of half-open spans."""
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


SHIPPED_KEYS = 4_000_000  # 32 MB of keys go to the tasks at most


def repeated_keys(keys: DataFrame) -> DataFrame:
    """Keys (``key``, ``n`` per task, ``gram`` of some) that occur at least twice."""
    from passagemill.session import materialize

    grouped = keys.groupBy("key").agg(F.sum("n").alias("n"), F.first("gram", ignorenulls=True).alias("gram"))
    return materialize(grouped.where("n > 1"), "repeated_keys")


def shipped_keys(repeated: DataFrame):
    """The keys as a broadcast sorted array, or None where they are too many."""
    if repeated.count() > SHIPPED_KEYS:
        return None
    keys = repeated.select("key").toArrow().column(0).to_numpy()
    return repeated.sparkSession.sparkContext.broadcast(np.sort(keys))


def among(keys: np.ndarray, known) -> np.ndarray:
    """Which keys (unsigned) are in the shipped array; all, if none was shipped."""
    if known is None:
        return np.ones(len(keys), bool)
    own, table = keys.view(np.int64), known.value
    if not len(table):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, own), len(table) - 1)
    return table[at] == own


def key_counts(runs, gram_of) -> pa.RecordBatch:
    """Counts of a part's anchor keys; one key in 64 carries its gram."""
    _, _, _, anchor, keys = runs
    distinct, first, counts = np.unique(keys, return_index=True, return_counts=True)
    grams = [gram_of(f) if k & 63 == 0 else None for k, f in zip(distinct.tolist(), first.tolist())]
    return pa.RecordBatch.from_arrays(
        [pa.array(distinct.view(np.int64)), pa.array(counts.astype(np.int64)), pa.array(grams, pa.binary())],
        names=["key", "n", "gram"],
    )
