"""Encoders: chunk text to something a question can be scored against."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions.text import words

HASH_DIM = 256
SIGNED_ROWS = 2_000  # vectors made at once in a task


def hash_encoder(dim: int = HASH_DIM, text: str = "text", out: str = "embedding"):
    """Offline default: hashed word counts of unit length, all inside the JVM."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    def encode(df: DataFrame) -> DataFrame:
        counted = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim).transform(
            df.withColumn("_words", words(F.col(text), 1))
        )
        unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(counted)
        return unit.withColumn(out, vector_to_array("_unit", "float32")).drop(
            "_words", "_tf", "_unit"
        )

    return encode


def signed_encoder(dim: int = HASH_DIM, text: str = "text", out: str = "embedding"):
    """Signed feature hashing by SHA-1, so that any SQL engine gives the same vectors.

    A word adds 1 or -1, by its ninth hex digit, to the component that its first
    eight digits name; words that meet in a component partly cancel instead of
    adding up.  Vectors have unit length; texts without words stay zero.
    """
    def encode(df: DataFrame) -> DataFrame:
        given = [c for c in df.columns if c != out]
        found = df.select(*given, F.array_join(words(F.col(text), 1), " ").alias("_words"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, SIGNED_ROWS):
                    part = batch.slice(low, SIGNED_ROWS)
                    vectors = pa.array(signed_vectors(part.column(part.num_columns - 1), dim).ravel(), pa.float32())
                    ends = pa.array(np.arange(part.num_rows + 1) * dim, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[:-1], pa.ListArray.from_arrays(ends, vectors)], names=[*given, out]
                    )

        return found.mapInArrow(run, T.StructType([*found.schema.fields[:-1], T.StructField(out, T.ArrayType(T.FloatType()))]))

    return encode


def signed_vectors(texts: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of texts whose words are joined by one space; each distinct word is hashed once."""
    lists = pc.split_pattern(texts, " ")
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    held = pc.not_equal(flat, "")  # of a text without words
    row, coded = row[held.to_numpy(zero_copy_only=False)], flat.filter(held).dictionary_encode()
    digests = [hashlib.sha1(w.encode()).digest() for w in coded.dictionary.to_pylist()]
    place = np.array([int.from_bytes(d[:4], "big") % dim for d in digests], np.int64)
    sign = np.array([-1.0 if d[4] & 16 else 1.0 for d in digests])
    code = coded.indices.to_numpy(zero_copy_only=False)
    sums = np.bincount(row * dim + place[code], sign[code], len(lists) * dim).reshape(len(lists), dim)
    length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    return (sums / np.where(length > 0, length, 1.0)).astype(np.float32)


def model_encoder(
    load: Callable[[], Callable[[list[str]], list]], text: str = "text", out: str = "embedding"
):
    """Encoder around a model: ``load()`` runs once per Python worker and returns a
    function from a list of texts to a list of vectors."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(list(model(batch.fillna("").tolist())), dtype=object)

    def encode(df: DataFrame) -> DataFrame:
        return df.withColumn(out, run(F.col(text)))

    return encode


def term_norm2(tokens: Column) -> Column:
    """Squared length of the term-count vector, from runs of the sorted words."""
    zero = F.struct(
        F.lit("").alias("word"), F.lit(0).cast("bigint").alias("run"),
        F.lit(0).cast("bigint").alias("total"),
    )

    def step(acc: Column, word: Column) -> Column:
        run = F.when(acc["word"] == word, acc["run"] + 1).otherwise(F.lit(1).cast("bigint"))
        return F.struct(
            word.alias("word"), run.alias("run"), (acc["total"] + 2 * run - 1).alias("total")
        )

    return F.aggregate(F.array_sort(tokens), zero, step, lambda acc: acc["total"])


def term_encoder(text: str = "text"):
    """Lexical encoding: the words of the text and their squared vector length."""

    def encode(df: DataFrame) -> DataFrame:
        return df.withColumn("terms", words(F.col(text))).withColumn(
            "norm2", term_norm2(F.col("terms"))
        )

    return encode
