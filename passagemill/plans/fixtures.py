"""The driver's tables seen as this engine's inputs (documents, messages, questions...).

Everything is derived from whole tables; no rows are left out.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.operators.chunking import chunk_documents
from passagemill.operators.encoding import term_encoder
from passagemill.operators.termindex import TermIndex, build_term_index
from passagemill.session import materialize, scratch_path, spread
from passagemill.sources import schema as S
from passagemill.sources.corpus import write_bucketed
from passagemill.sources.jsonl import overwrite_objects, path_exists, read_rules

TYPE_BY_LANG = {"en": "web", "de": "msg", "fr": "portal", "es": "local"}
GOOD_MARKERS = (" the ", " que ")
BAD_MARKERS = (" und ",)
AS_OF = "2024-01-03 00:00:00"
SINCE_DAYS = 1
CHANNEL_CAP = 50
LEXICAL_MIN_SCORE = 0.2
VECTOR_MIN_SCORE = 0.2
KNOWN_BUCKETS = 16
BLOCK_QUESTIONS = 4  # in one pass, where a search goes in blocks
RATED_QUESTIONS = 40  # ratings are dealt to the first questions
PAGE_DAY = dt.date(2024, 1, 3)


def as_of():
    """The moment of the run, free of any session time zone."""
    return F.lit(AS_OF).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str, by_content: bool = False) -> DataFrame:
    """Documents with type, URL, title, date and extra.

    ``by_content`` gives copies of a text the same URL, as a re-crawl would.
    """
    d = spread(table(spark, sf_dir, "documents"))
    kind = F.coalesce(*[F.when(F.col("lang") == k, v) for k, v in TYPE_BY_LANG.items()], F.lit("other"))
    url = F.concat(F.lit("https://"), F.col("lang"), F.lit(".example.org/")) if by_content else F.concat(
        F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string")
    )
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    extra = (
        F.when((kind == "local") & (F.col("n_chars") >= 1000), F.create_map(F.lit("file_name"), name))
        .when((kind == "local") & (F.col("n_chars") >= 500), F.create_map(F.lit("saved_as"), name))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    return d.select(
        F.col("doc_id").alias("row_id"),
        kind.alias("source_type"),
        url.alias("url"),
        F.substring(F.substring_index("text", "\n", 1), 1, 60).alias("title"),
        F.col("text").alias("raw_text"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), F.pmod("n_chars", F.lit(60)).cast("int"))
        .cast("string").alias("date"),
        extra.alias("extra"),
    )


def chunks(spark: SparkSession, sf_dir: str, by_content: bool = False) -> DataFrame:
    return chunk_documents(docs(spark, sf_dir, by_content), keep=("row_id",))


def no_chunks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], S.CHUNK)


def labelled_chunks(spark: SparkSession, sf_dir: str, by_content: bool = False) -> DataFrame:
    """The corpus as it already exists: chunks of the documents that have labels."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"))
    return chunk_documents(
        docs(spark, sf_dir, by_content).join(labels, "row_id", "left_semi"), keep=("row_id",)
    )


_STORED: dict[tuple, object] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, build):
    """What ``build`` writes from the documents: once for a session and the files that they
    consist of, then read by every query after that."""
    read = table(spark, sf_dir, "documents").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    files = tuple(sorted(tuple(map(str, r)) for r in read.distinct().collect()))  # one row a file
    key = (spark.sparkContext.applicationId, sf_dir, files, name)
    path, held = _STORED.get(key, (None, None))
    if path is None or not path_exists(spark, path):
        path = scratch_path(spark, name)
        held = build(path)
        _STORED[key] = (path, held)
    return held


def lexical_index(spark: SparkSession, sf_dir: str) -> TermIndex:
    """The stored term index of all chunks."""
    return _stored(spark, sf_dir, "terms", lambda path: build_term_index(chunks(spark, sf_dir), path))


def known_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as it already exists (labelled documents), stored in buckets of the chunk id."""
    return _stored(
        spark, sf_dir, "known",
        lambda path: write_bucketed(labelled_chunks(spark, sf_dir, by_content=True), path, buckets=KNOWN_BUCKETS),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as questions, with their lexical encoding."""
    asked = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
    return term_encoder("query")(asked)


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as a user keeps them: written as JSON lines and read back.

    In turn, a rule asks for a source's address, for words of the question, and
    for a type and an address.
    """
    b = table(spark, sf_dir, "benchmark")
    kind = F.pmod("item_id", F.lit(3))
    source = F.concat(F.lit("https://SRC"), F.pmod("item_id", F.lit(20)).cast("string"), F.lit(".example.org/"))
    stated = b.select(
        F.col("text").alias("query"),
        F.when(kind == 0, source).when(kind == 2, F.lit("example.org/")).alias("must_contain_url"),
        F.when(kind == 1, F.substring("text", 20, 30)).alias("must_contain_text"),
        F.when(kind == 2, F.lit("web")).alias("must_contain_type"),
    )
    path = scratch_path(spark, "rules")
    overwrite_objects(stated, path)
    numbered = b.groupBy(F.col("text").alias("query")).agg(F.min("item_id").alias("query_id"))
    return read_rules(spark, path).drop("query_id").join(numbered, "query")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as channel messages, dated and qualified by events."""
    c, e = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "events")
    c = c.withColumn("msg_id", F.col("conv_id") * 8 + F.col("turn"))
    e = e.select(F.col("event_id").alias("msg_id"), "ts", "event_type", "value", "props")
    name = F.concat(F.lit("ch"), F.pmod("conv_id", F.lit(10)).cast("string"))
    return c.join(e, "msg_id", "left").select(
        F.when(F.col("role") == "user", F.concat(F.lit("https://t.me/"), name))
        .when(F.col("role") == "assistant", F.concat(F.lit("@"), name))
        .otherwise(F.concat(F.lit(" t.me/"), name, F.lit("/ "))).alias("channel"),
        "msg_id",
        "ts",
        F.when(F.col("event_type") == "view", F.lit("  ")).otherwise(F.col("text")).alias("text"),
        F.coalesce(F.col("value") > 10, F.lit(False)).alias("has_media"),
        (F.col("role") != "system").alias("is_message"),
        F.get_json_object("props", "$.k").cast("int").alias("views"),
        "event_type",
    )


def known_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the messages that were ingested before: those of purchase events."""
    from passagemill.functions import ids
    from passagemill.functions.text import channel_handle
    from passagemill.plans.ingest import message_documents, message_text

    m = messages(spark, sf_dir).where(F.col("event_type") == "purchase")
    m = m.withColumn("channel", channel_handle(F.col("channel"))).withColumn(
        "text", message_text(F.col("text"), F.col("has_media"))
    ).withColumn("message_key", ids.message_key(F.col("channel"), F.col("msg_id")))
    return chunk_documents(message_documents(m), 600, 80)


def vec_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors; a vector belongs to the document of the same number."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("chunk_id"), "embedding"
    )


def vec_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents under the ids of their vectors."""
    return docs(spark, sf_dir).select(
        F.concat(F.lit("vec_"), F.col("row_id").cast("string")).alias("chunk_id"),
        F.col("raw_text").alias("text"), "title", "source_type", "url", "date", "extra",
    )


def vec_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per vector label: the label's mean vector, and a benchmark text."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    from passagemill.functions.vectors import normalize

    e = table(spark, sf_dir, "embeddings")
    means = e.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        Summarizer.mean(array_to_vector("embedding")).alias("mean")
    )
    text = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
    asked = means.join(text, "query_id", "left").select(
        "query_id", "query", normalize(vector_to_array("mean")).alias("embedding")
    )
    # One row per label: written, so that the vectors are averaged once.
    return materialize(asked, "questions")


def completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn as a generated answer to the question of its message number."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    turns = c.withColumn("query_id", F.col("conv_id") * 8 + F.col("turn"))

    def every(n: int):
        return F.pmod("query_id", F.lit(n)) == 0

    cited = F.concat(
        "text", F.lit(" ["), F.pmod("turn", F.lit(9)).cast("string"), F.lit("] ["),
        F.pmod("conv_id", F.lit(9)).cast("string"), F.lit("]"),
    )
    answer = (
        F.when(every(7), F.concat(cited, F.lit(" Sadly the passages do not say.")))
        .when(every(11), F.col("text"))
        .when(every(13), F.concat(cited, F.lit("\nSources : [1]")))
        .otherwise(cited)
    )
    return turns.select(
        "query_id", answer.alias("answer"),
        F.when(every(9), F.lit("timeout")).alias("error"),
    )


def labelled(spark: SparkSession, sf_dir: str, with_query: bool = True) -> DataFrame:
    """Labels with a minute stamp, the rating and verdict they imply, and a question."""
    lab = table(spark, sf_dir, "labels")
    if with_query:
        title = docs(spark, sf_dir).select(
            F.col("row_id").alias("doc_id"), F.col("title").alias("query")
        )
        lab = lab.join(title, "doc_id", "left")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"))
    return lab.select(
        "doc_id",
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + minutes).cast("string").alias("ts"),
        *(["query"] if with_query else []),
        F.when(good, 1).otherwise(-1).alias("rating"),
        F.when(F.col("toxic") == 1, "bad_answer").when(F.col("quality") == 0, "bad_retrieval")
        .otherwise("good").alias("verdict"),
        F.concat(F.lit(" seen "), F.col("doc_id").cast("string")).alias("comment"),
    )


def feedback_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating records and verdict records in one wide log."""
    from passagemill.operators.feedback import verdict_records

    source = labelled(spark, sf_dir)
    ratings = source.select(*[
        F.col(f.name).cast(f.dataType).alias(f.name) if f.name in ("ts", "query", "comment", "rating")
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in S.FEEDBACK.fields
    ])
    return ratings.unionByName(verdict_records(source.select("ts", "query", "verdict", "comment")))


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table as JSON lines with what real files contain besides: lines cut
    short, blank lines, arrays, foreign keys, glued records, records without a type,
    repeated keys and bare ``NaN``."""
    c = chunks(spark, sf_dir)
    record = F.to_json(F.struct(
        "chunk_id", "text", "title",
        F.when(F.col("source_type") != "portal", F.col("source_type")).alias("source_type"),
        "url", "date", "extra",
    ))
    odd = F.to_json(F.struct("chunk_id", "text", "title", "source_type", F.lit(1).alias("foreign")))
    first = F.col("part") == 0
    return c.select(F.explode(F.array_compact(F.array(
        record,
        F.when(first, F.substring(record, 1, 40)),
        F.when(first, F.lit("   ")),
        F.when(first, F.concat(F.lit("["), record, F.lit("]"))),
        F.when(first, odd),
        F.when(first, F.concat(record, record)),
        F.when(first, F.concat(F.lit('{"text": "older", '), F.substr(record, F.lit(2)))),
        F.when(first, F.concat(F.lit('{"weight": NaN, '), F.substr(record, F.lit(2)))),
    ))).alias("value"))


MESSAGE_SCHEMA = T.StructType([
    T.StructField("channel", T.StringType()),
    T.StructField("msg_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("text", T.StringType()),
    T.StructField("has_media", T.BooleanType()),
    T.StructField("is_message", T.BooleanType()),
    T.StructField("views", T.IntegerType()),
    T.StructField("event_type", T.StringType()),
])
