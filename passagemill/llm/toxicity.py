"""Toxicity by the nearest labelled examples, exact TF-IDF cosine, block-max inverted index.

The features of a text are all its words that some example has, weighted by the
document frequencies of all documents.  Examples are a bounded sample of labelled
rows (``SAMPLE``).

The inverted index keeps examples in blocks, those of similar length together.
Queries are scored in batches: postings of rare words are added up, which with
the greatest weight of each common word bounds every block; common words are
multiplied out only in blocks that can still reach a query's k best.  That runs in
single precision; for what is within rounding of the k best, the common words are
multiplied out again in double precision, so the result is exact.

Votes weigh by similarity.  Calibration adds to the log odds of the vote what the
number of a text's leaning words tells (words and first letters that toxic
examples have more often; they do not enter the similarity, and their absence
tells nothing where an example is a near copy), and maps the sum to
a rate by isotonic regression on the examples' own leave-one-out votes.

Terms are chosen and words counted by Spark tasks, the index is laid out and
calibrated in one task over the sample; the driver sees words, their document
frequencies and the arrays of the sample.

Cases: null and empty texts, and those that share no word with any example, vote
with the rate among such examples; equal similarities go to the smaller example
id; without any labelled row every score is 0; repeated rows score alike; an
empty table gives no rows; other columns are kept by ``with_scores``, columns
named like the added ones are replaced.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from passagemill.llm.common import give_back, parts_of, ragged
from passagemill.session import materialize

SAMPLE = 12_000  # labelled rows to fit on, by hash of the id
TERMS = 2_048
NEIGHBOURS = 15
BLOCK = 512
BATCH = 128  # texts scored together
COMMON = 1 / 16  # share of the examples from which a feature is multiplied out
POSTINGS = 1 << 19  # added up together, however long a text is
WEIGHED = 1 << 10  # examples weighed together
SLACK = 2e-5  # far above the rounding of single precision
CALIBRATION = 1_500  # examples whose own votes calibrate the scores
PART_BYTES = 2 << 20  # of texts split into words together
SUPPORT = 5  # examples a term needs
EVIDENCE = 10.0  # log-likelihood ratio a term needs: the sample has some e**10 terms, so chance alone yields about one
EDGE = re.compile(r"^[\W_]+|[\W_]+$")  # signs around a word
SIGNS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
CASED = r"[\x{130}-\x{10ffff}]"  # below these, Arrow's lower case is Python's
PREFIXES = (4, 5, 6)
COUNTED = 1 << 14  # features whose counts travel together
LEANING = 4  # numbers of leaning words told apart: none, one, two, three, more
NEAR_COPY = 0.8  # similarity from which an example's label stands where leaning words are absent
CERTAIN = 0.01  # a vote closer to 0 or 1 counts as this close

LAID_OUT = {
    "ids": np.int64, "labels": np.float64, "ends": np.int64, "feature": np.int32, "number": np.int32,
    "empty": np.float64, "lean": np.float64, "votes": np.float64, "rates": np.float64,
}
SCORED = "toxic_score double, toxic int, evidence_id array<long>, evidence_similarity array<double>"
CELLS = ("feature", "number")  # one entry a word and example: by far the longest arrays, they travel compressed
ADDED = tuple(f.split()[0] for f in SCORED.split(", "))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def lowered(texts: list[str | None] | pa.Array) -> pa.Array:
    """Texts in lower case as Python has it, null as empty."""
    given = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    given = pa.compute.fill_null(given.cast(pa.large_string()), "")
    cased = pa.compute.match_substring_regex(given, CASED)
    out = pa.compute.utf8_lower(given)
    if not cased.true_count:
        return out
    return pa.compute.replace_with_mask(out, cased, pa.array([t.lower() for t in given.filter(cased).to_pylist()], pa.large_string()))


def without_signs(word: str) -> str:
    """The word without what is no letter or digit around it; plain signs go first, as most words have no others."""
    word = word.strip(SIGNS)
    return word if word[:1].isalnum() and word[-1:].isalnum() else EDGE.sub("", word)


def coded_words(texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words of lower-cased texts: text number and code of each, and the words by code."""
    parts = pa.compute.utf8_split_whitespace(lowered(texts))
    coded = parts.values.dictionary_encode()
    words = [w if w.isalnum() else without_signs(w) for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
    text = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    return text, coded.indices.to_numpy(), words


def distinct(numbers: np.ndarray) -> np.ndarray:
    """The numbers in order, each once; ``np.unique`` without counts hashes them, which takes ten times as long."""
    numbers = np.sort(numbers)
    return numbers[np.diff(numbers, prepend=-1) != 0]


def terms_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


class Terms:
    """Leaning terms, and the words of all examples by number; these stay in Arrow, as a dict takes many times their size."""

    def __init__(self, terms: list[str], words: pa.Array | None = None):
        self.whole = pa.array(sorted(t for t in terms if not t.endswith("*")), pa.string())
        self.starts = pa.array(sorted(t[:-1] for t in terms if t.endswith("*")), pa.string())
        self.words = pa.array([], pa.string()) if words is None else words

    def __len__(self) -> int:
        return len(self.words)

    def leaning(self, words: pa.Array) -> np.ndarray:
        """Which words are leaning terms or go on from one of the leaning starts (``terms_of``)."""
        found = pa.compute.is_in(words, value_set=self.whole)
        length = pa.compute.utf8_length(words)
        for n in PREFIXES:
            start = pa.compute.is_in(pa.compute.utf8_slice_codeunits(words, 0, n), value_set=self.starts)
            found = pa.compute.or_(found, pa.compute.and_(start, pa.compute.greater(length, n)))
        return found.to_numpy(zero_copy_only=False)

    def cells(self, text: np.ndarray, code: np.ndarray, words: list[str]) -> np.ndarray:
        """Text and number of each word of an example, as one integer, by text."""
        found = pa.compute.index_in(pa.array(words, pa.string()), value_set=self.words)
        word = pa.compute.fill_null(found, -1).to_numpy().astype(np.int64)[code]
        known = word >= 0
        return text[known] * max(len(self), 1) + word[known]

    def counts(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ends of the texts from 0 on, their words by number and how often, and the leaning words of each text."""
        text, code, words = coded_words(texts)
        hits = np.bincount(text[self.leaning(pa.array(words, pa.string()))[code]], minlength=len(texts))
        cells, number = np.unique(self.cells(text, code, words), return_counts=True)
        row, feature = np.divmod(cells, max(len(self), 1))
        return np.searchsorted(row, np.arange(len(texts) + 1)), feature, number, np.minimum(hits, LEANING)

    def occurrence(self, texts: list[str | None] | pa.Array) -> np.ndarray:
        """In how many of the texts each word is."""
        text, code, words = coded_words(texts)
        cells = distinct(self.cells(text, code, words))
        return np.bincount(cells % max(len(self), 1), minlength=len(self))


class Lists:
    """Slices of one array."""

    def __init__(self, flat: np.ndarray, ends: np.ndarray):
        self.flat, self.ends = flat, ends

    def __getitem__(self, n: int) -> np.ndarray:
        return self.flat[self.ends[n] : self.ends[n + 1]]


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Slices of the values in a row, taken some at a time."""
    out, done = np.empty(int(sizes.sum()), np.int32), 0
    for low in range(0, len(starts), WEIGHED):
        at = ragged(starts[low : low + WEIGHED], sizes[low : low + WEIGHED])
        out[done : done + len(at)] = values[at]
        done += len(at)
    return out


def closed(values: np.ndarray) -> bytes:
    """The numbers, steps from one to the next in as few bytes as all of them need, compressed."""
    steps = np.diff(values.astype(np.int64), prepend=0)
    kind = np.result_type(np.min_scalar_type(int(steps.min(initial=0))), np.min_scalar_type(int(steps.max(initial=0))), np.int8)
    data = steps.astype(kind).tobytes()
    return pickle.dumps((kind.str, len(data), pa.compress(data, "zstd", asbytes=True) if data else b""))


def opened(data: bytes) -> np.ndarray:
    kind, size, data = pickle.loads(data)
    steps = np.frombuffer(pa.decompress(data, size, "zstd") if size else b"", kind)
    return np.cumsum(steps, dtype=np.int32)


def odds(rate):
    rate = np.clip(rate, CERTAIN, 1 - CERTAIN)
    return np.log(rate / (1 - rate))


class Index:
    """Block-max inverted index of the examples and calibrated votes, from plain arrays (``state``)."""

    def __init__(self, state: dict):
        self.idf, self.ids, self.labels, self.ends = state["idf"], state["ids"], state["labels"], state["ends"]
        self.feature, self.number = (opened(state[n]) if isinstance(state[n], bytes) else state[n] for n in CELLS)
        self.empty, self.lean, self.steps = float(state["empty"][0]), state["lean"], (state["votes"], state["rates"])
        self.terms = Terms(state["terms"], state["words"])
        self.build()

    def build(self) -> None:
        number, features = len(self.ids), len(self.idf)
        sizes = np.bincount(self.feature, minlength=features)
        common = np.flatnonzero(sizes > number * COMMON)
        self.column = np.full(features, -1, np.int32)
        self.column[common] = np.arange(len(common))
        blocks = max(1, -(-number // BLOCK))
        self.near = np.zeros((blocks * BLOCK, len(common)), np.float32)  # weights of common words by example
        amount = int(sizes[common].sum())
        # what single precision leaves of them, example by example
        self.rest, self.rest_column = np.empty(amount, np.float32), np.empty(amount, np.int32)
        self.rest_ends = np.zeros(blocks * BLOCK + 1, np.int64)
        sizes[common] = 0
        ends = np.r_[0, np.cumsum(sizes)]
        order = np.empty(len(self.feature) - amount, np.int64)  # cells of rare words, to be sorted by word and example
        self.length = np.ones(number)
        rare = done = 0
        for low in range(0, number, WEIGHED):
            own = self.ends[low : low + WEIGHED + 1]
            first, span = own[0], slice(own[0], own[-1])
            row = np.repeat(np.arange(low, low + len(own) - 1, dtype=np.int32), np.diff(own))
            raw = self.raw(self.feature[span], self.number[span])
            self.length[low : low + len(own) - 1] = self.lengths(own, raw)
            weight = raw / self.length[row]
            column = self.column[self.feature[span]]
            cell = np.flatnonzero(column >= 0)
            at, weight = (row[cell], column[cell]), weight[cell]
            self.near[at] = weight
            self.rest[done : done + len(cell)] = weight - weight.astype(np.float32)
            self.rest_column[done : done + len(cell)] = at[1]
            np.add.at(self.rest_ends, at[0] + 1, 1)
            done += len(cell)
            cell = np.flatnonzero(column < 0) + first
            order[rare : rare + len(cell)] = self.feature[cell].astype(np.int64) << 32 | cell
            rare += len(cell)
        np.cumsum(self.rest_ends, out=self.rest_ends)
        self.dense = self.near.reshape(blocks, BLOCK, len(common))
        self.bound = self.dense.max(axis=1).T
        order.sort()
        order &= (1 << 32) - 1
        places, values = np.empty(len(order), np.int32), np.empty(len(order))
        for low in range(0, len(order), POSTINGS):
            cell = order[low : low + POSTINGS]
            row = np.searchsorted(self.ends, cell, side="right") - 1
            places[low : low + POSTINGS] = row
            values[low : low + POSTINGS] = self.raw(self.feature[cell], self.number[cell]) / self.length[row]
        self.places, self.values = Lists(places, ends), Lists(values, ends)

    def forget(self) -> Index:
        """Without what only the calibration reads."""
        del self.feature, self.number
        return self

    def raw(self, feature: np.ndarray, number: np.ndarray) -> np.ndarray:
        return (1 + np.log(number.astype(float))) * self.idf[feature]

    def lengths(self, ends: np.ndarray, raw: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        length = np.sqrt(np.bincount(row, raw**2, len(ends) - 1))
        return np.where(length > 0, length, 1.0)

    def weighted(self, ends: np.ndarray, feature: np.ndarray, number: np.ndarray) -> np.ndarray:
        """TF-IDF weights of the words of each text, of length one."""
        raw = self.raw(feature, number)
        return raw / np.repeat(self.lengths(ends, raw), np.diff(ends))

    @property
    def weight(self) -> np.ndarray:
        """Weights of all examples' words, made anew each time."""
        return self.weighted(self.ends, self.feature, self.number)

    def best(self, ends: np.ndarray, feature: np.ndarray, weight: np.ndarray, skip: np.ndarray | None = None) -> Iterator[tuple]:
        """For each text its nearest examples and their cosines, best first: exactly the k best above zero."""
        for low in range(0, len(ends) - 1, BATCH):
            part = ends[low : low + BATCH + 1]
            span = slice(part[0], part[-1])
            text, place, exact = self.candidates(part - part[0], feature[span], weight[span], NEIGHBOURS + (skip is not None))
            if skip is not None:
                other = place != skip[low + text]
                text, place, exact = text[other], place[other], exact[other]
            order = np.lexsort((self.ids[place], -np.round(exact, 9), text))
            text, place, exact = text[order], place[order], exact[order]
            bounds = np.searchsorted(text, np.arange(len(part)))
            for first, last in zip(bounds[:-1], np.minimum(bounds[1:], bounds[:-1] + NEIGHBOURS)):
                yield place[first:last], exact[first:last]

    def candidates(self, ends: np.ndarray, feature: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts of a batch, examples that are among their k best up to rounding, and the cosines."""
        texts, blocks = len(ends) - 1, len(self.dense)
        row = np.repeat(np.arange(texts), np.diff(ends))
        column = self.column[feature]
        common, rare = column >= 0, column < 0
        asked = np.zeros((texts, self.near.shape[1]))
        asked[row[common], column[common]] = weight[common]
        single = asked.astype(np.float32)
        first = self.places.ends[feature[rare]]
        sizes = self.places.ends[feature[rare] + 1] - first
        own, amount = row[rare], weight[rare]
        exact = np.zeros((texts, blocks * BLOCK))  # of the rare words
        # one text after another, so that its postings and sums stay in the cache
        turn = np.cumsum(sizes) // POSTINGS
        cuts = np.flatnonzero((np.diff(own) > 0) | (np.diff(turn) > 0)) + 1
        for some in map(slice, [0, *cuts], [*cuts, len(own)] if len(own) else []):
            at = ragged(first[some], sizes[some])
            value = np.repeat(amount[some], sizes[some])
            value *= self.values.flat.take(at, mode="clip")
            exact[own[some.start]] += np.bincount(self.places.flat.take(at, mode="clip"), value, blocks * BLOCK)
        scores = exact.astype(np.float32).reshape(texts, blocks, BLOCK)
        bounds = scores.max(axis=2) + single @ self.bound
        top = np.zeros((texts, k), np.float32)
        for b in np.argsort(-bounds.sum(axis=0), kind="stable"):
            visit = bounds[:, b] > np.maximum(top[:, 0] - SLACK, 0)
            scores[~visit, b] = 0
            own = np.flatnonzero(visit)
            if len(own):
                scores[own, b] += single[own] @ self.dense[b].T
                seen = np.concatenate([top[own], scores[own, b]], axis=1)
                top[own] = np.partition(seen, seen.shape[1] - k, axis=1)[:, -k:]
        scores = scores.reshape(texts, blocks * BLOCK)
        least = np.maximum(top[:, :1] - np.float32(SLACK), np.nextafter(np.float32(0), np.float32(1)))
        text, place = np.divmod(np.flatnonzero(scores >= least), blocks * BLOCK)
        found = exact[text, place]
        for some in np.split(np.arange(len(text)), np.arange(WEIGHED, len(text), WEIGHED)):
            weights = self.near[place[some]].astype(float)
            first, sizes = self.rest_ends[place[some]], np.diff(self.rest_ends)[place[some]]
            at = ragged(first, sizes)
            weights[np.repeat(np.arange(len(some)), sizes), self.rest_column[at]] += self.rest[at]
            found[some] += np.einsum("ij,ij->i", asked[text[some]], weights)
        return text, place, found

    def vote(self, places: np.ndarray, scores: np.ndarray) -> float:
        if not len(places):
            return self.empty
        near = scores**4  # close examples count most
        return float((near * self.labels[places]).sum() / near.sum())

    def told(self, vote: float, scores: np.ndarray, hits: int) -> float:
        """Log odds of the vote, and what the leaning words tell; their absence tells nothing beside a near copy."""
        copy = len(scores) and scores[0] >= NEAR_COPY
        lean = float(self.lean[hits])
        return float(odds(vote)) + (max(lean, 0.0) if copy else lean)

    def score(self, texts: list[str | None] | pa.Array) -> Iterator[tuple[float, list[int], list[float]]]:
        """Rate of toxicity and the evidence for each text."""
        if not len(self.ids):
            yield from ((self.empty, [], []) for _ in texts)
            return
        ends, feature, number, hits = self.terms.counts(texts)
        for hit, (places, scores) in zip(hits, self.best(ends, feature, self.weighted(ends, feature, number))):
            rate = np.interp(self.told(self.vote(places, scores), scores, hit), *self.steps)
            yield float(rate), self.ids[places].tolist(), np.round(scores, 6).tolist()


def arranged(words: dict, ids: np.ndarray, labels: np.ndarray, hits: np.ndarray, ends: np.ndarray, feature: np.ndarray, number: np.ndarray) -> dict:
    """State of an index over the examples: ordered by length, votes calibrated.  ``words`` has terms, words and idf."""
    sizes = np.diff(ends)
    order = np.lexsort((ids, sizes))  # of similar length in one block
    order = order[sizes[order] > 0]
    base = float(labels.sum()) / max(len(ids), 1)
    without = labels[sizes == 0]
    empty = (float(without.sum()) + base) / (len(without) + 1) if len(ids) else 0.0
    told = [np.bincount(hits[labels == y], minlength=LEANING + 1) + 0.5 for y in (0, 1)]
    state = words | {
        "ids": ids[order], "labels": labels[order].astype(float), "ends": np.r_[0, np.cumsum(sizes[order])].astype(np.int64),
        "feature": gathered(feature, ends[order], sizes[order]), "number": gathered(number, ends[order], sizes[order]), "empty": np.array([empty]),
        "lean": np.log(told[1] / told[1].sum()) - np.log(told[0] / told[0].sum()), "votes": np.zeros(1), "rates": np.full(1, base),
    }
    index = Index(state)
    own = np.arange(0, len(index.ids), max(1, -(-len(index.ids) // CALIBRATION)))
    if len(own):
        at = ragged(index.ends[own], np.diff(index.ends)[own])
        ends = np.r_[0, np.cumsum(np.diff(index.ends)[own])]
        near = index.best(ends, index.feature[at], index.weighted(ends, index.feature[at], index.number[at]), skip=own)
        told = [index.told(index.vote(*found), found[1], hit) for found, hit in zip(near, hits[order][own].tolist())]
        state["votes"], state["rates"] = isotonic(np.array(told), index.labels[own])
    return state


def isotonic(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points of a rising curve from vote to rate."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []  # sum of labels, number, sum of votes
    for v, y in zip(votes[order], labels[order]):
        pools.append([y, 1.0, v])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[2] / p[1] for p in pools]), np.array([(p[0] + 0.2) / (p[1] + 0.4) for p in pools])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """State of an ``Index`` of labelled rows: ``labels`` has ``doc_id`` and ``toxic``, held-out rows left out by the caller."""
    spark = docs.sparkSession
    usable = labels.where("doc_id is not null and toxic is not null").select(
        F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_y")
    ).groupBy("_id").agg(F.max("_y").alias("_y"))
    chosen = usable.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text"))
    # the sample is bounded, so it is broadcast
    train = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_id", "_y", "text")
    train = materialize(train, "toxicity_sample")  # read twice

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts_of(whole, "text", PART_BYTES):
                bad = batch.column(1).to_numpy().astype(np.int64)
                text, code, words = coded_words(batch.column(2))
                number: dict[str, int] = {"": 0}  # counts the documents
                lists = [[number.setdefault(t, len(number)) for t in terms_of(w)] if w else [] for w in words]
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                flat = np.fromiter((t for own in lists for t in own), np.int64, int(sizes.sum()))
                pair = distinct(text * len(words) + code)  # each word once a text
                text, code = np.divmod(pair, max(len(words), 1))
                low = np.cumsum(sizes) - sizes
                term = flat[ragged(low[code], sizes[code])]
                pair = distinct(np.repeat(text, sizes[code]) * len(number) + term)
                text, term = np.divmod(pair, len(number))
                often, toxic = np.bincount(term, minlength=len(number)), np.bincount(term, bad[text], len(number)).astype(np.int64)
                often[0], toxic[0] = len(bad), bad.sum()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(number), pa.string()), pa.array(often), pa.array(toxic)], names=["term", "n", "bad"]
                )

    counted = materialize(
        train.mapInArrow(count, "term string, n long, bad long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")),
        "toxicity_terms",
    )
    whole = counted.where("term = ''").first()
    base = min(max(whole["bad"] / max(whole["n"], 1), 1e-9), 1 - 1e-9) if whole else 0.5
    rate, good = F.col("bad") / F.col("n"), F.col("n") - F.col("bad")
    gain = F.col("bad") * F.log(rate / base) + F.when(good > 0, good * F.log((1 - rate) / (1 - base))).otherwise(0.0)
    strong = counted.where((F.col("term") != "") & (F.col("bad") >= SUPPORT) & (rate > base)).withColumn("gain", gain)
    terms = [r["term"] for r in strong.where(F.col("gain") > EVIDENCE).orderBy(F.desc("gain"), "term").limit(TERMS).collect()]
    words = counted.where((F.col("term") != "") & ~F.col("term").endswith("*")).select("term").toArrow().column(0)  # of the sample
    words = pa.concat_arrays([pa.array([], pa.string()), *(c.cast(pa.string()) for c in words.chunks)])
    words = words.take(pa.compute.sort_indices(words))
    shipped = spark.sparkContext.broadcast((terms, words))

    def own_terms() -> Terms:
        return Terms(*shipped.value)

    def occur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = own_terms()
        seen = np.zeros(len(own) + 1, np.int64)
        for batch in batches:
            for part in parts_of(batch, "text", PART_BYTES):
                seen[-1] += part.num_rows
                seen[:-1] += own.occurrence(part.column(0))
        starts = np.arange(0, len(seen), COUNTED)
        yield pa.RecordBatch.from_arrays(
            [pa.array(starts), pa.array([seen[a : a + COUNTED].tobytes() for a in starts], pa.binary())], names=["low", "n"]
        )

    def total(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in rows:
            for one in batch.column(1).to_pylist():
                own = np.frombuffer(one, np.int64)
                out = own if out is None else out + own
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([out.tobytes()], pa.binary())], names=["low", "n"])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = own_terms()
        for batch in batches:
            for part in parts_of(batch, "text", PART_BYTES):
                ends, feature, number, hits = own.counts(part.column(2))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (feature, number)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(hits, pa.int32()), *lists], names=["id", "y", "hits", "term", "n"])

    seen = np.zeros(len(words) + 1, np.int64)
    parts = texts.select("text").mapInArrow(occur, "low long, n binary").groupBy("low").applyInArrow(total, "low long, n binary")
    for row in parts.toLocalIterator():
        own = np.frombuffer(row[1], np.int64)
        seen[row[0] : row[0] + len(own)] = own
    weights = spark.sparkContext.broadcast(np.log((int(seen[-1]) + 1) / (seen[:-1] + 1)) + 1e-3)

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        ids, labelled, hits = (np.concatenate([np.zeros(0, np.int64), *(b.column(c).to_numpy() for b in rows)]) for c in ("id", "y", "hits"))
        sizes = np.concatenate([np.zeros(0, np.int64), *(pa.compute.list_value_length(b.column("term")).to_numpy() for b in rows)]).astype(np.int64)
        feature, number = (np.concatenate([np.zeros(0, np.int32), *(b.column(c).flatten().to_numpy() for b in rows)]) for c in ("term", "n"))
        del rows
        # repeated ids: one row each, the one of the fewest and least words
        low = np.cumsum(sizes) - sizes
        order = sorted(range(len(ids)), key=lambda r: (ids[r], sizes[r], feature[low[r] : low[r] + sizes[r]].tobytes()))
        kept = np.sort(np.array([r for n, r in enumerate(order) if not n or ids[r] != ids[order[n - 1]]], np.int64))
        if len(kept) < len(order):
            feature, number = gathered(feature, low[kept], sizes[kept]), gathered(number, low[kept], sizes[kept])
        ends = np.r_[0, np.cumsum(sizes[kept])].astype(np.int64)
        known = {"terms": shipped.value[0], "words": shipped.value[1], "idf": weights.value}
        state = arranged(known, ids[kept], labelled[kept], hits[kept], ends, feature, number)
        del feature, number
        for name, kind in LAID_OUT.items():
            data = closed(state.pop(name)) if name in CELLS else np.asarray(state.pop(name), kind).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], names=["name", "data"])
        give_back()

    described = train.mapInArrow(describe, "id long, y int, hits int, term array<int>, n array<int>")
    laid_out = described.repartition(1).mapInArrow(lay_out, "name string, data binary").collect()  # at most the sample
    state = {"terms": terms, "words": words, "idf": np.log((int(seen[-1]) + 1) / (seen[:-1] + 1)) + 1e-3}
    state |= {n: np.zeros(1 if n in ("empty", "votes", "rates") else LEANING + 1 if n == "lean" else 0, t) for n, t in LAID_OUT.items()}
    state |= {row["name"]: bytes(row["data"]) if row["name"] in CELLS else np.frombuffer(row["data"], LAID_OUT[row["name"]]) for row in laid_out}
    shipped.destroy()
    weights.destroy()
    del laid_out, seen, parts
    give_back()
    return state


def scored(docs: DataFrame, state: dict) -> DataFrame:
    """Each row as the struct ``row``, with its score, decision and evidence beside it."""
    shipped = docs.sparkSession.sparkContext.broadcast(state)
    given = docs.select(F.struct(*docs.columns).alias("row"))
    own = [n for n, f in enumerate(docs.schema) if f.name == "text" and f.dataType == StringType()]
    if not own:  # texts of another type travel beside the row
        given = given.withColumn("text", F.col("row.text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shipped.value).forget()  # gone with the task: workers live on
        give_back()
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([batch.column(0), batch.column(0).field(own[0]) if own else batch.column(1)], names=["row", "text"])
            for part in parts_of(pair, "text", PART_BYTES):
                found = list(index.score(part.column(1)))
                scores = np.clip([f[0] for f in found], 0.0, 1.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32)),
                        pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.list_(pa.float64())),
                    ],
                    names=["row", *ADDED],
                )

    return given.mapInArrow(run, StructType([given.schema["row"], *StructType.fromDDL(SCORED).fields]))


def with_scores(docs: DataFrame, state: dict) -> DataFrame:
    """The rows with ``toxic_score``, ``toxic`` and the evidence added, in place of columns of these names."""
    return scored(docs.drop(*ADDED), state).select("row.*", *ADDED)
