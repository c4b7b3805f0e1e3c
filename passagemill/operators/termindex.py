"""A stored inverted index of chunk terms, and exact best-k search in it.

Chunks are dealt to blocks of bounded size, those of similar vector length
together.  ``postings`` holds one row per term and block: the places of the
chunks that have the term, how often, and the greatest weight that the term has
in the block.  Files are sorted by term, so a batch of questions reads the row
groups of its own terms; only their postings are shuffled, by block.  A block is
scored against the questions that can still gain from it: the sum of a
question's greatest weights bounds every score of the block.  Accumulators are
one block long; no array of chunks times questions is made.

The index is written once and read by any number of searches.  Chunks without a
term are in no posting; ties are broken by chunk id; scores equal those of a
direct comparison to the last digit, as sums are whole numbers.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill import values as V
from passagemill.functions.text import words
from passagemill.operators.ranking import top_per_group
from passagemill.session import materialize
from passagemill.sources.jsonl import path_exists
from passagemill.sources.schema import CHUNK_COLUMNS

BLOCK_CHUNKS = 4096
CLASSES_PER_DOUBLING = 2
CLASS_SPACE = 1 << 32  # numbers of blocks of one length class
# Questions scored in one pass; more are scored in several.
MAX_PASS_ROWS = 50_000
MAX_PASS_TERMS = 8_000_000


@dataclass(frozen=True)
class TermIndex:
    """Tables of a stored index."""

    spark: SparkSession
    path: str

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def chunks(self) -> DataFrame:
        """Chunk columns, distinct ``terms`` with their counts ``tfs``, and ``norm2``."""
        return self._read("chunks")

    @property
    def postings(self) -> DataFrame:
        return self._read("entries/kind=posting").select("block", "term", "bound", "places", "tfs")

    @property
    def blocks(self) -> DataFrame:
        """Ids and squared lengths of a block's chunks by place."""
        return self._read("entries/kind=block").select("block", "ids", "norms")


def term_counts(chunks: DataFrame) -> DataFrame:
    """The rows with the distinct ``terms`` of their text, how often each occurs (``tfs``), and ``norm2``."""
    given = chunks.withColumn("_words", F.array_join(words(F.col("text")), " "))  # one value travels faster than a list

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pc.split_pattern(batch.column(batch.num_columns - 1), " ")
            flat = lists.flatten()
            row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            found = pc.not_equal(flat, "")  # of a text without words
            row, coded = row[found.to_numpy(zero_copy_only=False)], flat.filter(found).dictionary_encode()
            names = max(len(coded.dictionary), 1)
            pair, often = np.unique(row * names + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row = pair // names
            norm2 = np.bincount(row, often.astype(np.float64) ** 2, len(lists)).astype(np.int64)
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=len(lists)))], pa.int32())
            terms = coded.dictionary.take(pa.array(pair % names))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.ListArray.from_arrays(ends, terms),
                 pa.ListArray.from_arrays(ends, pa.array(often, pa.int32())), pa.array(norm2)],
                names=[*batch.schema.names[:-1], "terms", "tfs", "norm2"],
            )

    schema = T.StructType([
        *chunks.schema.fields, T.StructField("terms", T.ArrayType(T.StringType())),
        T.StructField("tfs", T.ArrayType(T.IntegerType())), T.StructField("norm2", T.LongType()),
    ])
    return given.mapInArrow(count, schema)


ENTRY = pa.schema([
    ("kind", pa.string()), ("block", pa.int64()), ("term", pa.string()), ("bound", pa.float64()),
    ("places", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("ids", pa.list_(pa.string())), ("norms", pa.list_(pa.int64())),
])


def block_entries(key: tuple, chunks: pa.Table) -> pa.Table:
    """One block turned over: a row of its ids and squared lengths by place, and a row a term."""
    chunks = chunks.take(pc.sort_indices(chunks, [("chunk_id", "ascending")])).combine_chunks()
    lists, tfs = (chunks.column(n).combine_chunks() for n in ("terms", "tfs"))
    norms = chunks.column("norm2").to_numpy()
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    place = np.repeat(np.arange(len(norms)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    order = np.argsort(code, kind="stable")
    place, often = place[order], tfs.flatten().to_numpy(zero_copy_only=False)[order]
    begin = np.r_[0, np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))]
    bound = np.maximum.reduceat(often / np.sqrt(norms[place].astype(np.float64)), begin[:-1]) if len(code) else np.empty(0)
    number, ends = len(begin) - 1, pa.array(begin, pa.int32())
    head = {
        "kind": ["block"], "block": [key[0].as_py()], "term": [None], "bound": [None], "places": [None], "tfs": [None],
        "ids": [chunks.column("chunk_id").to_pylist()], "norms": [norms.tolist()],
    }
    postings = [
        pa.repeat("posting", number), pa.repeat(key[0].as_py(), number), coded.dictionary, pa.array(bound),
        pa.ListArray.from_arrays(ends, pa.array(place, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(often, pa.int32())),
        pa.nulls(number, ENTRY.field("ids").type), pa.nulls(number, ENTRY.field("norms").type),
    ]
    postings = [c.cast(f.type) for c, f in zip(postings, ENTRY)]
    return pa.concat_tables([pa.table(head, schema=ENTRY), pa.Table.from_arrays(postings, schema=ENTRY)])


def build_term_index(chunks: DataFrame, path: str) -> TermIndex:
    """Write the index of all chunks; an existing one is replaced.

    Words are taken from a text once and counted before anything is shuffled; only
    ids and counts are dealt to the blocks, and a task turns over one block at a time.
    """
    spark = chunks.sparkSession
    term_counts(chunks.select(*CHUNK_COLUMNS)).write.mode("overwrite").parquet(f"{path}/chunks")
    length = F.floor(F.log2(F.greatest("norm2", F.lit(1))) * CLASSES_PER_DOUBLING).cast("long")
    stored = TermIndex(spark, path)
    counted = stored.chunks.select("chunk_id", "terms", "tfs", "norm2", length.alias("_class"))
    # Some dozens of length classes, each cut into blocks by hash.
    sizes = counted.groupBy("_class").agg(F.ceil(F.count("*") / BLOCK_CHUNKS).alias("_cuts"))
    dealt = counted.join(F.broadcast(sizes), "_class").withColumn(
        "block", F.col("_class") * CLASS_SPACE + F.pmod(F.xxhash64("chunk_id"), F.col("_cuts"))
    )
    entries = dealt.select("block", "chunk_id", "terms", "tfs", "norm2").groupBy("block").applyInArrow(
        block_entries,
        "kind string, block long, term string, bound double, places array<int>, tfs array<int>, ids array<string>, norms array<long>",
    )
    # The order begins with the kind, so that writing sorts no more.
    entries.sortWithinPartitions("kind", "term", "block").write.mode("overwrite").partitionBy("kind").parquet(f"{path}/entries")
    return stored


def open_term_index(spark: SparkSession, path: str) -> TermIndex:
    if not path_exists(spark, f"{path}/entries/_SUCCESS"):  # written last
        raise FileNotFoundError(f"no term index at {path}; build it first")
    return TermIndex(spark, path)


def _rounded(scores: np.ndarray) -> np.ndarray:
    factor = 10.0 ** V.SCORE_DIGITS
    return np.floor(scores * factor + 0.5) / factor


class Asked:
    """Questions by term, and the best k of each so far."""

    def __init__(self, questions: pa.Table, k: int, least: float = 0.0):
        self.k = k
        self.ids = questions.column("query_id").combine_chunks()
        self.norm2 = questions.column("norm2").to_numpy().astype(np.float64)
        counts: dict[str, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        for number, terms in enumerate(questions.column("terms").to_pylist()):
            for term in terms or ():
                counts[term][number] += 1
        self.by_term = {
            t: (np.fromiter(own, np.int64), np.fromiter(own.values(), np.float64)) for t, own in counts.items()
        }
        self.floor = np.full(len(self.norm2), max(least, 0.0))
        self.best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def score(self, ids: list[str], norms: np.ndarray, found: list[tuple]) -> None:
        """One block: ``found`` has (term, bound, places, counts)."""
        bound = np.zeros(len(self.norm2))
        for term, most, _, _ in found:
            asking, often = self.by_term[term]
            bound[asking] += often * most
        # bounds and scores differ by rounding at most
        worth = (bound > 0) & (bound / np.sqrt(np.maximum(self.norm2, 1)) + 2e-6 >= self.floor)
        parts: dict[int, list] = defaultdict(list)
        for term, _, places, counts in found:
            asking, often = self.by_term[term]
            use = worth[asking]
            for number, times in zip(asking[use].tolist(), often[use].tolist()):
                parts[number].append((places, counts, times))
        for number, own in parts.items():  # weights are made for one question at a time
            sums = np.bincount(
                np.concatenate([p for p, _, _ in own]), np.concatenate([c * t for _, c, t in own]), len(norms)
            )
            place = np.flatnonzero(sums)
            scores = _rounded(sums[place] / np.sqrt(norms[place] * self.norm2[number]))
            self.offer(number, scores, place, ids)

    def offer(self, number: int, scores: np.ndarray, place: np.ndarray, ids: list[str]) -> None:
        use = scores >= self.floor[number]
        if use.sum() > self.k:
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            use &= scores >= cut
        if not use.any():
            return
        old = self.best.get(number, (np.empty(0), np.empty(0, object)))
        scores = np.concatenate([old[0], scores[use]])
        names = np.concatenate([old[1], np.array([ids[p] for p in place[use].tolist()], object)])
        order = np.lexsort((names.astype(str), -scores))[: self.k]
        self.best[number] = (scores[order], names[order])
        if len(order) == self.k:
            self.floor[number] = scores[order[-1]]

    def rows(self, schema: pa.Schema) -> pa.RecordBatch:
        numbers = [n for n, (s, _) in self.best.items() for _ in range(len(s))]
        return pa.RecordBatch.from_arrays(
            [
                self.ids.take(pa.array(numbers, pa.int64())).cast(schema.field(0).type),
                pa.array([i for _, names in self.best.values() for i in names], pa.string()),
                pa.array(np.concatenate([np.empty(0), *(s for s, _ in self.best.values())])),
            ],
            schema=schema,
        )


def best_by_terms(queries: DataFrame, index: TermIndex, k: int, least: float = 0.0) -> tuple[DataFrame, int]:
    """``(query_id, chunk_id, score, rank)`` of the k best chunks of each question by the
    cosine of term counts, and the number of questions; scores below ``least`` are left out."""
    asked = queries.select("query_id", "terms", "norm2").where(F.size("terms") > 0)
    size = asked.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first()
    passes = max(1, -(-size["rows"] // MAX_PASS_ROWS), -(-size["terms"] // MAX_PASS_TERMS))
    if passes == 1:
        pairs = _pass(asked, index, k, least)
    else:  # one written table a pass keeps plan and memory the same for any number of questions
        own = F.pmod(F.xxhash64("query_id"), F.lit(passes))
        parts = [materialize(_pass(asked.where(own == n), index, k, least), "pass") for n in range(passes)]
        pairs = parts[0]
        for part in parts[1:]:
            pairs = pairs.unionByName(part)
    return top_per_group(pairs, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k), size["rows"]


def _pass(asked: DataFrame, index: TermIndex, k: int, least: float) -> DataFrame:
    from passagemill.operators.blocks import _arrow_type

    spark = asked.sparkSession
    id_type = asked.schema["query_id"].dataType
    questions = asked.toArrow()
    shared = spark.sparkContext.broadcast(questions)  # bounded by the pass
    terms = asked.select(F.explode("terms").alias("term")).distinct()
    wanted = index.postings.join(F.broadcast(terms), "term", "left_semi")
    out = pa.schema([("query_id", _arrow_type(id_type)), ("chunk_id", pa.string()), ("score", pa.float64())])
    ids, norms = F.lit(None).cast("array<string>"), F.lit(None).cast("array<bigint>")
    entries = wanted.select("block", "term", "bound", "places", "tfs", ids.alias("ids"), norms.alias("norms"))
    heads = index.blocks.select(
        "block", F.lit(None).cast("string").alias("term"), F.lit(None).cast("double").alias("bound"),
        F.lit(None).cast("array<int>").alias("places"), F.lit(None).cast("array<int>").alias("tfs"), "ids", "norms",
    )
    dealt = heads.unionByName(entries).repartition("block").sortWithinPartitions("block", F.asc_nulls_first("term"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, block, found = Asked(shared.value, k, least), (None, None), []
        for batch in batches:
            columns = [batch.column(n) for n in ("term", "bound", "places", "tfs")]
            for row, term in enumerate(columns[0].to_pylist()):
                if term is None:
                    if found:
                        state.score(*block, found)
                    found = []
                    block = (
                        batch.column("ids")[row].as_py(),
                        batch.column("norms")[row].values.to_numpy().astype(np.float64),
                    )
                else:
                    found.append((
                        term, columns[1][row].as_py(), columns[2][row].values.to_numpy(), columns[3][row].values.to_numpy()
                    ))
        if found:
            state.score(*block, found)
        yield state.rows(out)

    return dealt.mapInArrow(run, T.StructType([
        T.StructField("query_id", id_type), T.StructField("chunk_id", T.StringType()), T.StructField("score", T.DoubleType()),
    ]))
