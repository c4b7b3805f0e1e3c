"""Incremental message ingest as a Structured Streaming job.

Which keys are known is keyed state, seeded once with the keys of the corpus and
later with those of parts that other jobs added.  A batch therefore reads its own
messages only, however large the corpus is.  Each batch becomes one part of the
store, named by query and batch, so a replayed batch adds nothing.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from passagemill import values as V
from passagemill.functions import ids
from passagemill.functions import text as X
from passagemill.functions.predicates import is_fresh
from passagemill.operators.chunking import chunk_documents
from passagemill.operators.dedup import truthy
from passagemill.plans.ingest import message_documents, message_text
from passagemill.sources.jsonl import path_exists
from passagemill.sources.schema import CHUNK_COLUMNS
from passagemill.sources.snapshots import Snapshot, Store

KEY = "message_key"
NO_TIME = -(1 << 62)  # place of messages without a time: the oldest
SEED = NO_TIME - 1  # marks keys that the corpus holds
DAY_MS = 86_400_000


def message_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 64
) -> DataFrame:
    """Stream of message files; ``ts`` becomes a TIMESTAMP so that it can be watermarked."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def fresh_messages(
    stream: DataFrame, as_of: Column, since_days: int | None = V.SINCE_DAYS
) -> DataFrame:
    """Messages of the allowed age with text, and their key."""
    return (
        stream.where(F.col("is_message") & is_fresh(F.col("ts"), as_of.cast("timestamp"), since_days))
        .withColumn("channel", X.channel_handle(F.col("channel")))
        .withColumn(KEY, ids.message_key(F.col("channel"), F.col("msg_id")))
        .withColumn("text", message_text(F.col("text"), F.col("has_media")))
        .where((F.col("text") != "") & truthy(KEY))
    )


def known_keys(store: Store, path: str, own: str = "") -> DataFrame:
    """Stream of the corpus's message keys: at each start those of parts that came since
    the last one, but for this stream's ``own``, which its state holds.

    Keys written twice by a start that failed half-way do no harm.
    """
    spark, now, seen = store.spark, store.latest(), -1
    if path_exists(spark, f"{path}/versions"):
        seen = spark.read.parquet(f"{path}/versions").agg(F.max("version")).first()[0]
    if seen < now.version:
        old = set(store.at(seen).corpus) if seen > 0 else set()
        fresh = [p for p in now.corpus if p not in old and not (own and p.startswith(own))]
        added = store.corpus(Snapshot(now.version, tuple(fresh)))
        keys = added.select(F.col("extra")[KEY].alias(KEY)).where(truthy(KEY)).distinct()
        keys.write.mode("append").parquet(f"{path}/keys")
        spark.createDataFrame([(now.version,)], "version bigint").write.mode("append").parquet(f"{path}/versions")
    return spark.readStream.schema(f"{KEY} string").parquet(f"{path}/keys")


def take_once(
    messages: DataFrame, known: DataFrame, as_of: Column, since_days: int | None = V.SINCE_DAYS,
    life_days: int | None = None,
) -> DataFrame:
    """The newest message of each key that was neither known nor taken before.

    Columns must be of plain types other than binary.  Repeats within an Arrow
    batch go before the shuffle, so a key that holds many rows is no heavy task.
    State is a key alone: the rows of a batch are dealt by key, a task keeps the
    best row of each of its keys, and Spark's own deduplication tells which keys
    are new, so that no Python runs for single keys.  With ``life_days`` a key is
    forgotten that long after it was last met, which is safe where a message
    never comes again with a later time; then state is a flag per key, and a
    key's rows are folded one batch at a time.  A checkpoint stays with the form
    of state it was begun with.
    """
    fields = [f for f in messages.schema.fields if f.name != KEY]
    names = [f.name for f in fields]
    now = as_of.cast("timestamp")

    def as_text(f: T.StructField) -> Column:
        moment = isinstance(f.dataType, T.TimestampType)
        return (F.unix_micros(f.name) if moment else F.col(f.name)).cast("string").alias(f.name)

    def as_given(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.TimestampType):
            return F.timestamp_micros(F.col(f.name).cast("bigint")).alias(f.name)
        return F.col(f.name).cast(f.dataType).alias(f.name)

    order, falling = ["_at", "text"], [False, True]

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.sort_values(order, ascending=falling).drop_duplicates(KEY)

    at = F.coalesce(F.unix_micros("ts"), F.lit(NO_TIME)).alias("_at")
    texts = messages.select(KEY, *map(as_text, fields), at)
    seeds = known.select(
        KEY, *(F.lit(None).cast("string").alias(n) for n in names), F.lit(SEED).alias("_at")
    )
    seen = F.when(F.col("_at") > NO_TIME, F.least(F.timestamp_micros("_at"), now)).otherwise(now)
    rows = texts.mapInPandas(thin, texts.schema).unionByName(seeds)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, ascending=falling)
        return rows.assign(_own=rows["_at"] != SEED).sort_values("_own", kind="stable").drop_duplicates(KEY).drop(columns="_own")

    def best_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, parts, held = None, [], 0
        for part in batches:
            parts.append(part)
            held += len(part)
            if best is None or held > len(best):  # what is kept doubles before it is sorted again
                best, parts, held = fold(pd.concat(parts if best is None else [best, *parts])), [], 0
        if parts:
            best = fold(pd.concat([best, *parts]))
        if best is not None:
            yield best

    if life_days is None:  # a known key's mark comes first, so that its messages go with it
        once = rows.repartition(KEY).mapInPandas(best_rows, rows.schema).dropDuplicates([KEY]).where(F.col("_at") > SEED)
        return once.select(KEY, *map(as_given, fields))
    rows = rows.withColumn("_seen", seen).withColumn("_ms", F.unix_millis("_seen"))
    # a day more, so that no row within the allowed age counts as late
    rows = rows.withWatermark("_seen", f"{max(since_days or life_days, 0) + 1} days")

    def take(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.exists
        taken, best, last = held, None, 0
        for part in batches:
            if not len(part):
                continue
            last = max(last, int(part["_ms"].max()))
            taken = taken or bool((part["_at"] == SEED).any())
            if not taken:
                part = part if best is None else pd.concat([best, part])
                best = part.sort_values(order, ascending=falling).head(1)
        if not held:
            state.update((True,))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + life_days * DAY_MS)
        if not taken and best is not None:
            yield best[[KEY, *names]]

    strings = T.StructType([T.StructField(n, T.StringType()) for n in (KEY, *names)])
    once = rows.groupBy(KEY).applyInPandasWithState(take, strings, "taken boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return once.select(KEY, *map(as_given, fields))


def _parts_of(stream_id: str) -> str:
    return f"stream-{stream_id}-"


def run_message_ingest(
    stream: DataFrame, store: Store, checkpoint_path: str, as_of: Column,
    since_days: int | None = V.SINCE_DAYS, life_days: int | None = None,
    encoder: Callable[[DataFrame], DataFrame] | None = None,
) -> list:
    """Drain what has arrived into the store; returns the progress of the batches.

    With an ``encoder`` the new chunks are indexed by the same commit.  A store
    that was reset needs a new checkpoint: the old one still knows its keys.
    """
    spark, progress = store.spark, f"{checkpoint_path}/progress"
    own = ""
    if path_exists(spark, f"{progress}/metadata"):  # an earlier start named the stream
        own = _parts_of(json.loads(spark.read.text(f"{progress}/metadata", wholetext=True).first()[0])["id"])
    begun, names = threading.Event(), []

    def land(batch: DataFrame, batch_id: int) -> None:
        begun.wait()
        name = f"{names[0]}{batch_id:012d}"
        if name in store.latest().corpus:  # replayed after its commit; the state still has to follow
            batch.write.format("noop").mode("overwrite").save()
            return
        chunks = chunk_documents(message_documents(batch), V.MESSAGE_CHUNK_SIZE, V.MESSAGE_CHUNK_OVERLAP)
        store.write_part(chunks.select(*CHUNK_COLUMNS), "corpus", name)  # the batch runs once
        part = store.corpus(Snapshot(0, (name,)))
        if part.isEmpty():
            return
        index = [] if encoder is None else [store.write_part(encoder(part), "index", f"{name}-index")]
        store.add([name], index)

    known = known_keys(store, f"{checkpoint_path}/known", own)
    query = (
        take_once(fresh_messages(stream, as_of, since_days), known, as_of, since_days, life_days)
        .writeStream.foreachBatch(land)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    names.append(_parts_of(query.id))
    begun.set()
    query.awaitTermination()
    return query.recentProgress
