"""SimHash near-duplicates by covering locality-sensitive hashing.

For radius 2 every bit gets a non-zero vector of three bits, and each of the 7
non-zero vectors ``v`` gives a mask: the bits whose vector has an odd product
with ``v``.  For any two bits some ``v`` is orthogonal to both of their vectors,
so two fingerprints within the radius agree on at least one whole mask.

Fingerprints that share a masked value are candidates.  Two of them are within
two bits exactly if some point is within one bit of both; so each candidate is
sent to itself and its one-bit neighbours, at most 65 meet at a point, and all
who meet are linked to the least.  Nothing is paired within a bucket.

Cases: null or blank texts have fingerprint zero and link like any other;
repeated rows share a component; a component without any id has none; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import text_bytes
from passagemill.llm.components import components
from passagemill.session import materialize

SHINGLE = 3
SEED = 42
BITS = 64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def covering_masks(bits: int = BITS) -> list[int]:
    """Seven masks such that any difference of up to two bits misses one of them."""
    vectors = [1 + i % 7 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vectors[i] & v).bit_count() % 2) for v in range(1, 8)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: bytes) -> int:
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    width = min(SHINGLE, len(words))
    number = len(words) - width + 1
    ones = np.zeros(BITS, np.int64)
    for low in range(0, number, 50_000):
        high = min(number, low + 50_000)
        spans = zip(starts[low:high].tolist(), ends[low + width - 1 : high + width - 1].tolist())
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > number))


def fingerprints(docs: DataFrame, *kept: Column) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed long) of whole texts, and more columns if asked for."""
    rows = docs.select(text_bytes().alias("text"), F.col("doc_id").cast("long"), *kept)
    names = rows.columns[1:]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [signed(fingerprint(t.as_py())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(values, pa.int64())], names=[*names, "fp"])

    return rows.mapInArrow(of, rows.drop("text").schema.add("fp", "long"))


def links(fps: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) that connect all distinct fingerprints within two bits."""
    tables = fps.select("fp", F.explode(F.array([F.lit(signed(m)) for m in covering_masks()])).alias("mask"))
    tables = tables.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    shared = tables.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1").select("mask", "key")
    candidates = tables.join(shared, ["mask", "key"]).select("fp").distinct()
    steps = F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << i)) for i in range(BITS)))
    meeting = candidates.select("fp", F.explode(steps).alias("step")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("step")).alias("point")
    )
    met = meeting.groupBy("point").agg(F.sort_array(F.collect_set("fp")).alias("fps")).where("size(fps) > 1")
    return met.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, BITS + 1)).alias("b")).distinct()


def near_duplicates(docs: DataFrame, *kept: Column) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` (the smallest ``doc_id`` reachable), and more columns if asked for."""
    marked = materialize(fingerprints(docs, *kept), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fps")
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = materialize(rooted, "rooted_fps")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp")
