"""Ingest jobs for pages and messages, and the sync that combines them.

Each job returns the new chunks and a per-item log; reports are aggregates of
the log, so nothing is counted on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill import values as V
from passagemill.functions import html as H
from passagemill.functions import ids
from passagemill.functions import text as X
from passagemill.functions.predicates import is_fresh, is_relevant
from passagemill.operators.chunking import chunk_array, chunk_documents
from passagemill.operators.dedup import only_new, truthy
from passagemill.operators.ranking import top_per_group
from passagemill.session import materialize, spread
from passagemill.sources.corpus import append_corpus, build_index, read_corpus
from passagemill.sources.jsonl import path_exists
from passagemill.sources.schema import CHUNK_COLUMNS
from passagemill.sources.snapshots import Store


# --- Pages ------------------------------------------------------------------

def page_documents(
    pages: DataFrame, good, bad=(), source_type: str = "web", as_of: Column | None = None,
    origin: str = "pages",
) -> DataFrame:
    """Pages ``(page_id, url, html)`` as documents with a ``status``:
    ``skipped`` (blank URL or not relevant), ``error`` (no content) or ``ok``.

    Only ``ok`` documents keep their text.  No filter is put on the status here:
    it would be pushed below the extraction and run all patterns a second time.
    """
    day = (F.current_date() if as_of is None else as_of).cast("date").cast("string")
    url = X.strip(F.coalesce("url", F.lit("")))
    read = H.with_page_text(spread(pages).select("page_id", url.alias("url"), "html"))
    read = read.withColumn("raw_text", H.clean_lines(F.col("text"))).drop("text")
    doc = F.concat(F.lit(f"{source_type}::"), "url")
    status = (
        F.when(F.col("url") == "", F.lit("skipped"))
        .when(F.col("html").isNull(), F.lit("error"))
        .when(is_relevant(F.col("raw_text"), good, bad), F.lit("ok"))
        .otherwise(F.lit("skipped"))
    )
    return read.withColumn("status", status).select(
        "page_id",
        F.lit(source_type).alias("source_type"),
        "url",
        H.page_title(F.col("html"), F.col("url")).alias("title"),
        F.when(F.col("status") == "ok", F.col("raw_text")).alias("raw_text"),
        day.alias("date"),
        F.create_map(
            F.lit("origin"), F.lit(origin), F.lit("doc_id"), doc, F.lit("seed_url"), F.col("url")
        ).alias("extra"),
        doc.alias("doc_id"),
        "status",
    )


def page_chunks(
    documents: DataFrame, existing: DataFrame, size: int = V.CHUNK_SIZE,
    overlap: int = V.CHUNK_OVERLAP, refresh: bool = False,
) -> DataFrame:
    """New chunks of relevant pages.

    Page ids depend on the URL only, so by default an edited page just adds its
    further parts.  ``refresh=True`` returns all chunks of the batch instead,
    for a caller that replaces the pages it re-reads.
    """
    chunks = chunk_documents(documents, size, overlap, keep=("page_id",))
    none = existing.limit(0) if refresh else existing
    return only_new(chunks, none, "chunk_id", [F.asc("page_id"), F.asc("part")])


def page_log(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(page_id, url, status, reason, chunks, added)`` of every page."""
    added = chunks.groupBy("page_id").agg(F.count("*").alias("added"))
    reason = F.when(
        (F.col("status") == "skipped") & (F.col("url") != ""), F.lit("not_relevant_or_too_short")
    )
    return (
        documents.select(
            "page_id", "url", "status", reason.alias("reason"),
            F.size(chunk_array(F.col("raw_text"))).cast("bigint").alias("chunks"),
        )
        .join(added, "page_id", "left")
        .withColumn("added", F.coalesce("added", F.lit(0)))
    )


def page_report(log: DataFrame, source: str = "web") -> DataFrame:
    return log.agg(
        F.lit(source).alias("source"),
        F.count("*").alias("processed"),
        F.coalesce(F.sum("added"), F.lit(0)).alias("added"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )


def ingest_pages(
    pages: DataFrame, existing: DataFrame, good, bad=(), **options
) -> tuple[DataFrame, DataFrame]:
    """``(new chunks, page log)``.

    The extracted documents are written once, so that the pages are read and
    taken apart once for both results.
    """
    documents = materialize(page_documents(pages, good, bad, **options), "pages")
    chunks = page_chunks(documents, existing)
    return chunks, page_log(documents, chunks)


# --- Messages ---------------------------------------------------------------

def message_text(text: Column, has_media: Column, placeholder: str = V.MEDIA_PLACEHOLDER) -> Column:
    body = X.strip(F.coalesce(text, F.lit("")))
    return F.when(body != "", body).when(has_media, F.lit(placeholder)).otherwise(F.lit(""))


def classify_messages(
    messages: DataFrame, known: DataFrame, as_of: Column, limit: int | None = V.MESSAGE_LIMIT,
    since_days: int | None = V.SINCE_DAYS, placeholder: str = V.MEDIA_PLACEHOLDER,
) -> DataFrame:
    """Messages with their ``status``, tested in this order: ``skipped`` (no message,
    too old), ``duplicate``, ``empty``, ``kept``.

    Needs ``channel, msg_id, ts, text, has_media, is_message`` and keeps further
    columns.  The newest ``limit`` rows of each channel are taken before any
    test.  ``known`` holds a ``message_key`` column.
    """
    df = messages.withColumn("channel", X.channel_handle(F.col("channel")))
    newest = [F.desc_nulls_last("ts"), F.desc("msg_id")]
    if limit is not None:
        df = top_per_group(df, ["channel"], newest, limit, "_place").drop("_place")
    df = df.withColumn("message_key", ids.message_key(F.col("channel"), F.col("msg_id"))).withColumn(
        "text", message_text(F.col("text"), F.col("has_media"), placeholder)
    )
    keys = known.where(truthy("message_key")).select("message_key").distinct().withColumn(
        "_known", F.lit(True)
    )
    df = df.join(keys, "message_key", "left")
    passed = F.col("is_message") & is_fresh(F.col("ts"), as_of, since_days)
    fresh = df.withColumn("_passed", F.coalesce(passed, F.lit(False))).withColumn(
        "_keepable", F.col("_passed") & F.col("_known").isNull() & (F.col("text") != "")
    )
    # A key repeats within a batch only inside one channel's capped rows.
    earlier = Window.partitionBy("message_key").orderBy(*newest).rowsBetween(
        Window.unboundedPreceding, -1
    )
    seen = F.coalesce(F.max("_keepable").over(earlier), F.lit(False))
    return fresh.withColumn("_seen", seen).withColumn(
        "status",
        F.when(~F.col("_passed"), F.lit("skipped"))
        .when(F.col("_known").isNotNull() | F.col("_seen"), F.lit("duplicate"))
        .when(F.col("text") == "", F.lit("empty"))
        .otherwise(F.lit("kept")),
    ).drop("_known", "_passed", "_keepable", "_seen")


MESSAGE_FACTS = ("views", "forwards", "replies", "has_media", "is_pinned", "is_forward")


def message_documents(kept: DataFrame, source_type: str = "msg") -> DataFrame:
    """Kept messages as documents; their chunk ids depend on the content."""
    channel, msg_id = F.col("channel"), F.col("msg_id")
    pairs = [
        F.lit("channel"), channel,
        F.lit("msg_id"), msg_id.cast("string"),
        F.lit("message_key"), F.col("message_key"),
        F.lit("doc_id"), F.col("message_key"),
    ]
    for name in MESSAGE_FACTS:
        if name in kept.columns:
            pairs += [F.lit(name), F.col(name).cast("string")]
    return kept.select(
        "message_key",
        "ts",
        F.lit(source_type).alias("source_type"),
        ids.message_url(channel, msg_id).alias("url"),
        ids.message_title(channel, msg_id).alias("title"),
        F.col("text").alias("raw_text"),
        X.iso_day(F.col("ts")).alias("date"),
        F.create_map(*pairs).alias("extra"),
        "channel",
    )


def message_chunks(
    classified: DataFrame, existing: DataFrame, size: int = V.MESSAGE_CHUNK_SIZE,
    overlap: int = V.MESSAGE_CHUNK_OVERLAP, source_type: str = "msg",
) -> DataFrame:
    documents = message_documents(classified.where(F.col("status") == "kept"), source_type)
    chunks = chunk_documents(documents, size, overlap, keep=("message_key", "channel", "ts"))
    return only_new(
        chunks, existing, "chunk_id",
        [F.desc_nulls_last("ts"), F.asc("message_key"), F.asc("part")],
    )


def message_report(classified: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per channel: processed, skipped, duplicate and empty messages, added chunks."""
    added = chunks.groupBy("channel").agg(F.count("*").alias("added"))

    def number(status: str) -> Column:
        return F.count_if(F.col("status") == status).alias(status)

    counts = classified.groupBy("channel").agg(
        F.count("*").alias("processed"), number("skipped"), number("duplicate"), number("empty")
    )
    return counts.join(added, "channel", "left").withColumn(
        "added", F.coalesce("added", F.lit(0))
    )


def ingest_messages(
    messages: DataFrame, existing: DataFrame, as_of: Column, limit: int | None = V.MESSAGE_LIMIT,
    since_days: int | None = V.SINCE_DAYS,
) -> tuple[DataFrame, DataFrame]:
    """``(new chunks, classified messages)``; the capped messages are written once."""
    known = existing.select(F.col("extra")["message_key"].alias("message_key"))
    classified = materialize(
        classify_messages(messages, known, as_of, limit, since_days), "messages"
    )
    return message_chunks(classified, existing), classified


# --- Sync -------------------------------------------------------------------

def union_chunks(*parts: DataFrame) -> DataFrame:
    """One corpus from the chunks of several sources."""
    out = parts[0].select(*CHUNK_COLUMNS)
    for part in parts[1:]:
        out = out.unionByName(part.select(*CHUNK_COLUMNS), allowMissingColumns=True)
    return out


def sync(
    pages: DataFrame,
    messages: DataFrame | None,
    corpus_path: str,
    index_path: str,
    encoder,
    good,
    bad=(),
    as_of: Column | None = None,
    limit: int | None = V.SYNC_MESSAGE_LIMIT,
    since_days: int | None = V.SINCE_DAYS,
) -> DataFrame:
    """Ingest both sources, append to the corpus, index the new chunks; returns totals.

    Messages are left out where they are not configured.  Vectors are keyed by
    chunk id, so only new chunks are encoded.
    """
    spark = pages.sparkSession
    now = F.current_timestamp() if as_of is None else as_of
    page_new, log = ingest_pages(pages, read_corpus(spark, corpus_path), good, bad, as_of=now)
    added = [materialize(page_new.select(*CHUNK_COLUMNS, "page_id"), "new-pages")]
    append_corpus(added[0], corpus_path)
    log = log.drop("added").join(
        added[0].groupBy("page_id").agg(F.count("*").alias("added")), "page_id", "left"
    ).withColumn("added", F.coalesce("added", F.lit(0)))
    report = None
    if messages is not None:
        existing = read_corpus(spark, corpus_path)
        new, classified = ingest_messages(messages, existing, now, limit, since_days)
        added.append(materialize(new.select(*CHUNK_COLUMNS, "channel"), "new-messages"))
        append_corpus(added[1], corpus_path)
        report = message_report(classified, added[1])
    fresh = union_chunks(*added)
    if not fresh.isEmpty():
        build_index(fresh, encoder, index_path, mode="append")
    return sync_summary(page_report(log), report, path_exists(spark, index_path))


def sync_store(
    pages: DataFrame,
    messages: DataFrame | None,
    store: Store,
    encoder,
    good,
    bad=(),
    as_of: Column | None = None,
    limit: int | None = V.SYNC_MESSAGE_LIMIT,
    since_days: int | None = V.SINCE_DAYS,
) -> DataFrame:
    """The same job on a store of snapshots: corpus and index change together or not at all.

    All new chunks are found against one snapshot, written and encoded, and one
    commit makes both parts visible.  A job that fails before it, or is run
    again, leaves the state as it was; ``index_ok`` compares both tables.
    """
    now = F.current_timestamp() if as_of is None else as_of
    base = store.latest()
    existing = store.corpus(base)
    page_new, log = ingest_pages(pages, existing, good, bad, as_of=now)
    page_part = materialize(page_new.select(*CHUNK_COLUMNS, "page_id"), "new-pages")
    log = log.drop("added").join(
        page_part.groupBy("page_id").agg(F.count("*").alias("added")), "page_id", "left"
    ).withColumn("added", F.coalesce("added", F.lit(0)))
    fresh, report = page_part.select(*CHUNK_COLUMNS), None
    if messages is not None:
        new, classified = ingest_messages(messages, union_chunks(existing, fresh), now, limit, since_days)
        message_part = materialize(new.select(*CHUNK_COLUMNS, "channel"), "new-messages")
        report = message_report(classified, message_part)
        fresh = union_chunks(fresh, message_part)
    if not fresh.isEmpty():
        part = store.write_part(fresh, "corpus")
        written = store.spark.read.schema(fresh.schema).parquet(f"{store.path}/parts/{part}")
        base = store.commit(base, [part], [store.write_part(encoder(written), "index")])
    return sync_summary(page_report(log), report, store.index_matches(base))


def sync_summary(pages: DataFrame, messages: DataFrame | None, index_ok: bool) -> DataFrame:
    """Totals over the reports; messages may be left out."""
    parts = pages.select("added", "errors")
    if messages is not None:
        parts = parts.unionByName(messages.select("added", F.lit(0).cast("bigint").alias("errors")))
    return parts.agg(
        F.sum("added").alias("total_added"),
        F.sum("errors").alias("total_errors"),
    ).withColumn("index_ok", F.lit(index_ok)).withColumn(
        "messages_synced", F.lit(messages is not None)
    )
