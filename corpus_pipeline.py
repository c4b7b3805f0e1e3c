"""A corpus pipeline of five stages; each takes the documents its predecessor kept.

Rows keep the columns of ``documents`` up to the last stage, which packs them;
further columns, whatever their names, pass through.  Empty tables pass through;
null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm import mixing, packing, simhash, suffix, toxicity
from passagemill.llm.common import table, text_key
from passagemill.llm.queries import tokenizer_path
from passagemill.session import materialize


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the nearest labelled examples do not call toxic; equal texts share their fate, repeated rows stay."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    return toxicity.scored(docs, toxicity.learn(docs, labels)).where("toxic = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that of the smallest id.

    Rows without id stay as one row a text if no document with an id is near them;
    of repeated rows, and of different texts under one id, one row stays.
    """
    marked = simhash.near_duplicates(docs, text_key().alias("key")).where(
        F.coalesce(F.col("component_id") == F.col("doc_id"), F.col("component_id").isNull())
    )
    kept = marked.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp")).agg(
        F.min("doc_id").alias("id"), F.min("key").alias("text")
    ).select("id", "text")
    rows = docs.select(F.struct(*docs.columns).alias("given"), F.col("doc_id").cast("long").alias("own"), text_key().alias("key"))
    rows = rows.join(kept, F.col("id").eqNullSafe(F.col("own")) & (F.col("text") == F.col("key")), "left_semi")
    return rows.dropDuplicates(["own", "key"]).select("given.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur more than once; characters cut in two go whole.

    Every row stays, repeated ones too, though its text may become empty.
    """
    rows = docs.select(F.struct(*docs.columns).alias("given"), "text")
    cut = suffix.cut_documents(rows, as_text=True)
    done = F.col("n_removed") > 0
    given = F.col("given")
    new = {
        "text": F.when(done, F.col("kept")).otherwise(given["text"]),
        "n_chars": F.when(done, F.length("kept")).otherwise(given["n_chars"]).cast("long") if "n_chars" in docs.columns else None,
    }
    return cut.select(*(new.get(c, given[c]).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; copies of a row are rows of their own."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences; repeated rows are packed each."""
    return packing.pack_digest(docs, tokenizer_path())


STAGES = [
    ("toxicity", reject_toxic), ("simhash", drop_near_duplicates), ("suffix_array", cut_repeats),
    ("mixing", mix_sources), ("packing", pack_sequences),
]

ORACLE_SQL = None  # fingerprints, votes, hashes and token ids are beyond SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
