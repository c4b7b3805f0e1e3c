"""Quality by a factorisation machine.

Features of a text are its hashed words, structure statistics (each as a value
and as one of ``BINS`` bins) and metadata (whole-number columns by magnitude).
A pair of features interacts through the inner product of two vectors of ``RANK``
entries; all pairs together cost one pass over the features, as half the
difference of the squared sum and the sum of squares.

The machine is fitted by adaptive gradient steps on a bounded sample of labelled
rows (``SAMPLE``) in one task; features are made by Spark tasks for the sample
and for all rows alike, and scoring is one map over all rows.

Cases: null, empty and blank texts have no word features and the statistics of an
empty text; null metadata count as -1; repeated rows and equal texts score alike
(given equal metadata); without labelled rows every score is 0.5; with one label
only, the score leans to it; an empty table gives no rows; ``with_quality`` keeps
all other columns.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from passagemill.llm.common import parts_of

SAMPLE = 12_000  # labelled rows to fit on, by hash of the id
HASHED = 1 << 15
RANK = 8
BINS = 10
EPOCHS = 4
BATCH = 64
STEP = 0.1
DECAY = 1e-5
PART_BYTES = 4 << 20
SCORED = "quality_score double, quality int"
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
STATISTICS = (
    "log words", "log lines", "distinct words", "equal neighbours", "distinct triples", "upper case", "digits",
    "signs", "signs within words' ends", "mean word length", "distinct lines", "words a line", "one-letter words",
)


def held_out(doc_id: Column, folds: int = 3) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 1, F.lit(False))


def width(metadata: int) -> int:
    return HASHED + (len(STATISTICS) + metadata) * (BINS + 1)


def per_text(text: np.ndarray, amount: np.ndarray | None, texts: int) -> np.ndarray:
    return np.bincount(text, amount, texts).astype(float)


def distinct(text: np.ndarray, value: np.ndarray, texts: int) -> np.ndarray:
    """How many different values each text has."""
    if not len(value):
        return np.zeros(texts)
    order = np.lexsort((value, text))
    t, v = text[order], value[order]
    return per_text(t[np.r_[True, (t[1:] != t[:-1]) | (v[1:] != v[:-1])]], None, texts)


def features(texts: pa.Array, metadata: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the texts from 0 on, features and values, for all texts of a part."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    many = len(texts)
    parts = pc.utf8_split_whitespace(texts)
    words = parts.values.dictionary_encode()
    code = words.indices.to_numpy()
    ends = parts.offsets.to_numpy()
    # splitting leaves empty strings where a text begins or ends with white space
    text = np.repeat(np.arange(many), np.diff(ends))
    known = words.dictionary.to_pylist()
    cleaned = [EDGE.sub("", w).lower() for w in known]
    bucket = np.array([zlib.crc32(w.encode()) % HASHED if w else -1 for w in cleaned], np.int64)
    shape = np.array([
        (len(w), sum(map(str.isupper, w)), sum(map(str.isdigit, w)), sum(not c.isalnum() for c in w),
         sum(not c.isalnum() for c in w[-3:]), len(w) == 1)
        for w in known
    ], float).reshape(len(known), 6)
    real = np.array([bool(w) for w in known], bool)
    text, code = text[real[code]], code[real[code]]
    number = per_text(text, None, many)
    some = np.maximum(number, 1)
    sums = [per_text(text, shape[code, c], many) for c in range(6)]
    chars = np.maximum(sums[0], 1)
    same = text[1:] == text[:-1]
    pairs = text[1:][same & (code[1:] == code[:-1])]
    triples = np.flatnonzero(same[1:] & same[:-1])
    size = len(known) + 1
    mixed = (code[triples].astype(np.uint64) * np.uint64(size) + code[triples + 1].astype(np.uint64)) * np.uint64(size) + code[triples + 2].astype(np.uint64)
    lines = pc.split_pattern(texts, "\n")
    line_text = np.repeat(np.arange(many), np.diff(lines.offsets.to_numpy()))
    line_code = lines.values.dictionary_encode().indices.to_numpy()
    rows = per_text(line_text, None, many)
    measured = [
        np.minimum(np.log2(1 + number) / 16, 1), np.minimum(np.log2(rows) / 12, 1), distinct(text, code, many) / some,
        per_text(pairs, None, many) / some, distinct(text[triples], mixed, many) / np.maximum(per_text(text[triples], None, many), 1),
        sums[1] / chars, sums[2] / chars, sums[3] / chars, sums[4] / (3 * some), np.minimum(sums[0] / some / 20, 1),
        distinct(line_text, line_code, many) / rows, np.minimum(number / rows / 60, 1), sums[5] / some,
    ]
    measured += [np.minimum(np.log2(2 + np.maximum(m, -1)) / 32, 1) for m in metadata]
    row, feature, value = [], [], []
    spans = np.flatnonzero(bucket[code] >= 0)
    cell, often = np.unique(text[spans] * HASHED + bucket[code[spans]], return_counts=True)
    at, which = np.divmod(cell, HASHED)
    amount = 1 + np.log(often)
    length = np.sqrt(per_text(at, amount**2, many))
    row.append(at)
    feature.append(which)
    value.append(amount / length[at])
    every = np.arange(many)
    for n, m in enumerate(measured):
        base = HASHED + n * (BINS + 1)
        row += [every, every]
        feature += [np.full(many, base), base + 1 + np.minimum((m * BINS).astype(np.int64), BINS - 1)]
        value += [m, np.full(many, 0.5)]
    row, feature, value = (np.concatenate(x) for x in (row, feature, value))
    order = np.lexsort((feature, row))
    return np.searchsorted(row[order], np.arange(many + 1)), feature[order], value[order]


def margins(model: tuple, ends: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Bias, linear part and all pairs by the sum-of-squares identity."""
    bias, linear, vectors = model
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    many = len(ends) - 1
    out = bias + np.bincount(row, linear[feature] * value, many)
    for f in range(vectors.shape[1]):
        own = vectors[feature, f] * value
        out += 0.5 * (np.bincount(row, own, many) ** 2 - np.bincount(row, own * own, many))
    return out


def rate(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(ends: np.ndarray, feature: np.ndarray, value: np.ndarray, labels: np.ndarray, size: int) -> tuple:
    """Adaptive gradient steps on the logistic loss, rows in a fixed order of chance."""
    chance = np.random.default_rng(11)
    linear, vectors = np.zeros(size), chance.normal(0, 0.05, (size, RANK))
    bias, seen = 0.0, 1.0
    seen_linear, seen_vectors = np.full(size, 1e-2), np.full((size, RANK), 1e-2)
    rows = len(ends) - 1
    for _ in range(EPOCHS if rows else 0):
        order = chance.permutation(rows)
        for at in range(0, rows, BATCH):
            own = order[at : at + BATCH]
            counts = ends[own + 1] - ends[own]
            place = np.repeat(ends[own] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            f, x = feature[place], value[place]
            r = np.repeat(np.arange(len(own)), counts)
            v = vectors[f] * x[:, None]
            sums = np.add.reduceat(v, np.cumsum(counts) - counts)  # no text is without features
            margin = bias + np.bincount(r, linear[f] * x, len(own)) + 0.5 * ((sums**2).sum(1) - np.bincount(r, (v * v).sum(1), len(own)))
            error = (rate(margin) - labels[own]) / len(own)
            seen += float(error.sum()) ** 2
            bias -= STEP * float(error.sum()) / np.sqrt(seen)
            used, inverse = np.unique(f, return_inverse=True)
            step = np.bincount(inverse, error[r] * x, len(used)) + DECAY * linear[used]
            seen_linear[used] += step**2
            linear[used] -= STEP * step / np.sqrt(seen_linear[used])
            pull = (error[r] * x)[:, None] * (sums[r] - v)
            slope = np.stack([np.bincount(inverse, pull[:, c], len(used)) for c in range(RANK)], axis=1) + DECAY * vectors[used]
            seen_vectors[used] += slope**2
            vectors[used] -= STEP * slope / np.sqrt(seen_vectors[used])
    vectors[seen_linear == 1e-2] = 0.0  # features that no row has
    return bias, linear, vectors


def learn(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = ("n_chars",), sample: int = SAMPLE) -> tuple:
    """Bias, linear weights and vectors from labelled rows: ``labels`` has ``doc_id`` and ``quality``, held-out rows left out by the caller."""
    usable = labels.where("doc_id is not null and quality is not null").select(
        F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y")
    ).groupBy("_id").agg(F.min("_y").alias("_y"))
    chosen = usable.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    wanted = [F.coalesce(F.col(m).cast("long"), F.lit(-1)).alias(f"_m{n}") for n, m in enumerate(metadata)]
    train = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"), *wanted).join(
        F.broadcast(chosen), "_id"  # the sample is bounded
    )
    size, extra = width(len(metadata)), len(metadata)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, "text", PART_BYTES):
                found = features(part.column("text"), [part.column(f"_m{n}").to_numpy() for n in range(extra)])
                lists = [pa.ListArray.from_arrays(pa.array(found[0], pa.int32()), pa.array(x, t)) for x, t in zip(found[1:], (pa.int32(), pa.float32()))]
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_y"), *lists], names=["id", "y", "f", "x"])

    def train_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        ids, y = (np.concatenate([np.zeros(0, np.int64), *(b.column(c).to_numpy() for b in parts)]) for c in ("id", "y"))
        counts = np.concatenate([np.zeros(0, np.int64), *(pc.list_value_length(b.column("f")).to_numpy() for b in parts)])
        f = np.concatenate([np.zeros(0, np.int64), *(b.column("f").flatten().to_numpy() for b in parts)]).astype(np.int64)
        x = np.concatenate([np.zeros(0), *(b.column("x").flatten().to_numpy() for b in parts)]).astype(float)
        ends = np.r_[0, np.cumsum(counts)].astype(np.int64)
        # the order of arrival is chance: rows of one id follow their features
        keys = [f[a:b].tobytes() + x[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        order = np.array(sorted(range(len(ids)), key=lambda r: (ids[r], keys[r])), np.int64)
        place = np.repeat(ends[order] - (np.cumsum(counts[order]) - counts[order]), counts[order]) + np.arange(counts.sum())
        bias, linear, vectors = fit(np.r_[0, np.cumsum(counts[order])].astype(np.int64), f[place], x[place], y[order].astype(float), size)
        yield pa.RecordBatch.from_arrays(
            [pa.array([bias]), pa.array([linear.astype(np.float32).tobytes()]), pa.array([vectors.astype(np.float32).tobytes()])],
            names=["bias", "linear", "vectors"],
        )

    described = train.mapInArrow(describe, "id long, y int, f array<int>, x array<float>")
    fitted = described.repartition(1).mapInArrow(train_all, "bias double, linear binary, vectors binary").collect()
    if not fitted:  # not even an empty partition
        return 0.0, np.zeros(size, np.float32), np.zeros((size, RANK), np.float32)
    row = fitted[0]
    vectors = np.frombuffer(row["vectors"], np.float32).reshape(size, RANK)
    return row["bias"], np.frombuffer(row["linear"], np.float32), vectors


def with_quality(docs: DataFrame, model: tuple, metadata: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """The rows with ``quality_score`` and ``quality`` added, in place of columns of these names."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    extra = len(metadata)
    kept = docs.drop(*(f.split()[0] for f in SCORED.split(", ")))
    given = docs.select(
        F.struct(*kept.columns).alias("row"), F.col("text").cast("string").alias("text"),
        *(F.coalesce(F.col(m).cast("long"), F.lit(-1)).alias(f"m{n}") for n, m in enumerate(metadata)),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0)]
            for part in parts_of(batch, "text", PART_BYTES):
                meta = [part.column(f"m{n}").to_numpy() for n in range(extra)]
                found.append(rate(margins(shipped.value, *features(part.column("text"), meta))))
            scores = np.concatenate(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                names=["row", *(f.split()[0] for f in SCORED.split(", "))],
            )

    schema = StructType([given.schema["row"], *StructType.fromDDL(SCORED).fields])
    return given.mapInArrow(run, schema).select("row.*", "quality_score", "quality")
