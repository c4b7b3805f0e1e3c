"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier for each bit weighs the
byte trigrams of a text by their log odds between the languages with the bit set
and those without.  Trigram counts come from all documents to learn from, each
with the same mass.  A bit's classifier is then scaled and its reliability
measured on a sample of at most ``SAMPLE`` of these documents, of any length, equal
ones counted once and taken by hash; decoding takes
the codeword of least loss, bits weighing by reliability, and flags a text whose
two nearest codewords are close.

Only a table of languages x ``BUCKETS`` numbers and the margins of the sample reach
the driver, after the number of languages is known to be within ``LANGUAGES``.

Cases: a text that is null or has no letter is ``und`` with score 0; without any
labelled text all are ``und``; languages tie by code point; repeated rows count
as often as they stand; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import PART_BYTES, parts_of
from passagemill.session import materialize

BUCKETS = 1 << 15
SAMPLE = 4_000
LANGUAGES = 1_000  # a code table for more is refused
CHUNK = 1 << 20
CLOSE = 0.75  # a score below it is flagged
LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def codewords(languages: int) -> np.ndarray:
    """A row of -1 and 1 for each language: exhaustive up to five, else rows far apart by chance, seeded."""
    if languages <= 5:
        columns = range(1, 1 << max(languages - 1, 0)) if languages > 1 else [1]
        words = np.array([[(c >> i & 1) * 2 - 1 for c in columns] for i in range(languages)])
        return words if languages > 1 else np.ones((1, 1), int)
    width = 6 * int(np.ceil(np.log2(languages))) + 7
    best = None
    for seed in range(50):
        words = np.random.default_rng(seed).choice([-1, 1], (languages, width))
        near = width - np.abs(words @ words.T - 2 * width * np.eye(languages)).max()
        if (np.abs(words.sum(axis=0)) < languages).all() and (best is None or near > best[0]):
            best = (near, words)
    return best[1]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of all texts in a row, and their number in each."""
    data = [f" {t} ".lower().encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    codes = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761) >> np.uint32(17)
    number = np.maximum(lengths - 2, 0)
    begin = np.cumsum(lengths) - lengths
    keep = np.ones(len(codes) + 2, bool)
    keep[np.r_[begin[1:] - 1, begin[1:] - 2]] = False
    keep[len(codes) :] = False
    return codes[keep[: len(codes)]].astype(np.int64), number


def groups(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of about a chunk of characters."""
    start = size = 0
    for n, text in enumerate(texts):
        size += len(text)
        if size > CHUNK:
            yield slice(start, n + 1)
            start, size = n + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def margins(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Mean weight of a text's trigrams, for every bit; a text of any length in pieces."""
    out = np.zeros((len(texts), weights.shape[1]))
    for part in groups(texts):
        if part.stop - part.start == 1 and len(texts[part.start]) > 2 * CHUNK:
            text, total, number = texts[part.start], 0.0, 0
            for low in range(0, len(text), CHUNK):
                codes, n = trigrams([text[low : low + CHUNK]])
                total = total + weights[codes].sum(axis=0, dtype=np.float64)
                number += int(n.sum())
            out[part.start] = total / max(number, 1)
            continue
        codes, number = trigrams(texts[part])
        sums = np.cumsum(np.vstack([np.zeros((1, weights.shape[1])), weights[codes]]), axis=0, dtype=np.float64)
        ends = np.cumsum(number)
        out[part] = (sums[ends] - sums[ends - number]) / np.maximum(number, 1)[:, None]
    return out


class Model:
    """Languages, codewords, bit classifiers and what weighs them."""

    def __init__(self, languages: list[str], words: np.ndarray, weights: np.ndarray):
        self.languages, self.words, self.weights = languages, words, weights.astype(np.float32)
        self.scale = np.ones(words.shape[1])
        self.trust = np.ones(words.shape[1])

    @classmethod
    def of(cls, state: dict) -> Model:
        model = cls(state["languages"], state["words"], state["weights"])
        model.scale, model.trust = state["scale"], state["trust"]
        return model

    def state(self) -> dict:
        """Plain values and arrays: workers that read them need no copy of this package."""
        return {n: getattr(self, n) for n in ("languages", "words", "weights", "scale", "trust")}

    def fit(self, found: np.ndarray, labels: np.ndarray) -> None:
        """Scale of the margins and trust in each bit, from the margins of labelled texts."""
        if not len(found):
            return
        right = found * self.words[labels]
        self.scale = 2.0 / np.maximum(np.abs(right).mean(axis=0), 1e-9)
        error = (np.sum(right <= 0, axis=0) + 0.5) / (len(found) + 1)
        self.trust = np.maximum(np.log((1 - error) / error), 1e-3)

    def decode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Language number and score of each text."""
        scaled = margins(texts, self.weights) * self.scale
        agree = scaled[:, None, :] * self.words[None]
        loss = np.logaddexp(0, -agree) @ (self.trust / self.trust.sum())
        loss *= np.log2(len(self.languages) + 1) * 2
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        return best, share[np.arange(len(texts)), best]


def learn(train: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from ``text`` and ``lang``; null if there is nothing to learn from."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in groups(texts):
                codes, number = trigrams(texts[part])
                own = np.array(langs[part], object)
                share = np.repeat(1.0 / np.maximum(number, 1), number)
                of = np.repeat(np.arange(len(own)), number)
                for lang in set(langs[part]):
                    at = (own == lang)[of]
                    mass[lang] = mass.get(lang, 0) + np.bincount(codes[at], weights=share[at], minlength=BUCKETS)
        for lang, table in mass.items():
            at = np.flatnonzero(table)
            whole = np.rint(table[at] * 1e9).astype(np.int64)  # sums of whole numbers need no order
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at), pa.array(whole)], names=["lang", "bucket", "mass"]
            )

    labelled = train.where("text is not null and lang is not null").select("text", "lang")
    counted = labelled.mapInArrow(count, "lang string, bucket long, mass long").groupBy("lang", "bucket").agg(F.sum("mass").alias("mass"))
    counted = materialize(counted, "trigrams")
    languages = sorted(r[0] for r in counted.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if not languages:
        return None
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    table = counted.toArrow()
    place = {lang: n for n, lang in enumerate(languages)}
    mass = np.zeros((len(languages), BUCKETS))
    rows = np.array([place[v] for v in table.column("lang").to_pylist()])
    mass[rows, table.column("bucket").to_numpy()] = table.column("mass").to_numpy() / 1e9
    share = (mass + 1e-3) / (mass + 1e-3).sum(axis=1, keepdims=True)
    words = codewords(len(languages))
    weights = np.stack([
        np.log(share[words[:, j] > 0].mean(axis=0)) - np.log(share[words[:, j] <= 0].mean(axis=0))
        if (words[:, j] > 0).any() and (words[:, j] <= 0).any() else np.ones(BUCKETS)
        for j in range(words.shape[1])
    ], axis=1)
    model = Model(languages, words, weights)
    number = labelled.count()
    part = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < 1_000_000 * sample / max(number, sample))
    part = part.distinct().orderBy(F.xxhash64("text"), "lang").limit(sample)  # a text counts once, however many copies it has
    shipped = train.sparkSession.sparkContext.broadcast(model.weights)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in parts_of(batch, "text", PART_BYTES):
                rows = margins(some.column(0).to_pylist(), shipped.value)
                yield pa.RecordBatch.from_arrays(
                    [some.column(1), pa.array([r.tobytes() for r in rows], pa.binary())], names=["lang", "margins"]
                )

    found = part.mapInArrow(measure, "lang string, margins binary").toArrow()  # at most the sample
    shipped.destroy()
    rows = np.frombuffer(b"".join(found.column("margins").to_pylist())).reshape(-1, words.shape[1])
    model.fit(rows, np.array([place[v] for v in found.column("lang").to_pylist()], np.int64))
    return model


def identify(docs: DataFrame, train: DataFrame) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` of whole texts."""
    model = learn(train)
    shipped = docs.sparkSession.sparkContext.broadcast(model.state() if model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.of(shipped.value) if shipped.value else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            known = [n for n, t in enumerate(texts) if t and LETTER.search(t)] if own else []
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if known:
                best, share = own.decode([texts[n] for n in known])
                score[known] = share
                for n, b in zip(known, best):
                    lang[n] = own.languages[b]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang), pa.array(score), pa.array(score < CLOSE)],
                names=["doc_id", "lang_pred", "score", "ambiguous"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, ambiguous boolean"
    )
