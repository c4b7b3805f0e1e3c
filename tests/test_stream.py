"""Message ingest as a stream: keyed state, restarts, replays, life span."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from passagemill.operators.encoding import signed_encoder
from passagemill.plans.ingest import message_chunks
from passagemill.session import scratch_path
from passagemill.sources import schema as S
from passagemill.sources.snapshots import Store
from passagemill.streaming import messages as stream

MESSAGES = (
    "channel string, msg_id bigint, ts timestamp_ntz, text string, has_media boolean, is_message boolean, views int"
)
AS_OF = "2024-01-03 00:00:00"


def message(msg_id, ts="2024-01-02T10:00:00", text="some words", channel="@ch"):
    import datetime as dt

    return (channel, msg_id, None if ts is None else dt.datetime.fromisoformat(ts), text, False, True, None)


class Feed:
    def __init__(self, spark):
        self.spark = spark
        self.arrivals, self.progress = scratch_path(spark, "arrivals"), scratch_path(spark, "progress")
        self.store = Store(spark, scratch_path(spark, "store"))

    def arrive(self, *rows):
        self.spark.createDataFrame(list(rows), MESSAGES).coalesce(1).write.mode("append").parquet(self.arrivals)

    def drain(self, as_of=AS_OF, since_days=30, **options):
        schema = self.spark.createDataFrame([], MESSAGES).schema
        source = stream.message_stream(self.spark, self.arrivals, schema)
        now = F.lit(as_of).cast("timestamp_ntz")
        return stream.run_message_ingest(source, self.store, self.progress, now, since_days, **options)

    def keys(self):
        return sorted(r["extra"]["message_key"] for r in self.store.corpus().collect())


def test_keys_are_taken_once_over_restarts(spark):
    feed = Feed(spark)
    feed.arrive(message(1), message(2, ts="2022-01-01T00:00:00"), message(3, text=" "), message(9, ts=None))
    feed.drain()
    assert feed.keys() == ["tg:ch:1", "tg:ch:9"]
    feed.arrive(message(1, text="edited"), message(4, text="old", ts="2024-01-01T00:00:00"), message(4, text="new"))
    feed.drain()
    assert feed.keys() == ["tg:ch:1", "tg:ch:4", "tg:ch:9"]
    texts = {r["extra"]["message_key"]: r["text"] for r in feed.store.corpus().collect()}
    assert texts["tg:ch:4"] == "new" and texts["tg:ch:1"] == "some words"


def test_a_batch_reads_only_its_messages(spark):
    """Known keys enter the state once; those that other jobs add follow at the next start."""
    feed = Feed(spark)
    many = spark.range(500).select(
        F.lit("ch").alias("channel"), F.col("id").alias("msg_id"), F.lit(None).cast("timestamp").alias("ts"),
        F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"),
        F.concat(F.lit("tg:ch:"), F.col("id").cast("string")).alias("message_key"), F.lit("kept").alias("status"),
    )
    old = message_chunks(many, spark.createDataFrame([], S.CHUNK)).select(*S.CHUNK_COLUMNS)
    feed.store.add([feed.store.write_part(old, "corpus")])
    feed.arrive(message(1), message(1000))
    assert sum(p["numInputRows"] for p in feed.drain()) == 502
    feed.arrive(message(7), message(1001))
    assert sum(p["numInputRows"] for p in feed.drain()) == 2
    assert len(feed.keys()) == 502
    other = message_chunks(
        many.withColumn("msg_id", F.col("msg_id") + 5000).withColumn("message_key", F.concat(F.lit("tg:ch:"), F.col("msg_id").cast("string"))).limit(3),
        spark.createDataFrame([], S.CHUNK),
    ).select(*S.CHUNK_COLUMNS)
    feed.store.add([feed.store.write_part(other, "corpus")])
    feed.arrive(message(5001), message(1002))
    feed.drain()
    assert len(feed.keys()) == 502 + 3 + 1


def test_a_replayed_batch_adds_nothing(spark):
    feed = Feed(spark)
    feed.arrive(message(1), message(2))
    feed.drain()
    state = feed.store.latest()
    for name in ("0", ".0.crc"):  # as after a loss between the store's commit and the stream's
        (Path(feed.progress) / "progress" / "commits" / name).unlink()
    feed.arrive(message(2), message(3))
    feed.drain()
    assert feed.keys() == ["tg:ch:1", "tg:ch:2", "tg:ch:3"]
    assert set(state.corpus) < set(feed.store.latest().corpus)


def test_keys_have_a_life_span(spark):
    feed = Feed(spark)
    feed.arrive(message(1))
    feed.drain(life_days=5, since_days=2)
    feed.arrive(message(1), message(2))
    feed.drain(life_days=5, since_days=2)
    assert feed.keys() == ["tg:ch:1", "tg:ch:2"]
    later = "2024-02-01 00:00:00"
    feed.arrive(message(3, ts="2024-01-31T12:00:00"))
    feed.drain(later, life_days=5, since_days=2)
    feed.arrive(message(4, ts="2024-01-31T13:00:00"))
    feed.drain(later, life_days=5, since_days=2)  # the watermark of the batch before retires old keys
    assert feed.keys() == [f"tg:ch:{i}" for i in (1, 2, 3, 4)]
    held = spark.read.format("statestore").load(f"{feed.progress}/progress")
    assert {json.loads(r[0])["message_key"] for r in held.select(F.to_json("key")).collect()} == {"tg:ch:3", "tg:ch:4"}


def test_new_chunks_are_indexed_by_the_same_commit(spark):
    feed = Feed(spark)
    feed.arrive(message(1), message(2, text="word " * 300))
    feed.drain(encoder=signed_encoder())
    assert feed.store.index_matches()
    feed.arrive(message(1))
    before = feed.store.latest()
    feed.drain(encoder=signed_encoder())
    assert feed.store.latest() == before


def test_state_runs_no_python_for_single_keys(spark):
    """Spark's own deduplication holds the keys; a known key takes its newer messages with it, the newest of the others stays."""
    feed = Feed(spark)
    many = spark.createDataFrame(
        [("ch", n, None, f"text {n}", f"tg:ch:{n}", "kept") for n in range(3)],
        "channel string, msg_id bigint, ts timestamp, text string, message_key string, status string",
    )
    old = message_chunks(many, spark.createDataFrame([], S.CHUNK)).select(*S.CHUNK_COLUMNS)
    feed.store.add([feed.store.write_part(old, "corpus")])
    feed.arrive(message(1, text="later"), message(5, text="b"), message(5, text="a"), message(5, text="0", ts=None))
    feed.arrive(message(2, ts=None), message(5, text="newest", ts="2024-01-02T11:00:00"), message(6, ts=None))
    done = feed.drain()
    assert {o["operatorName"] for p in done for o in p["stateOperators"]} == {"dedupe"}
    texts = {r["extra"]["message_key"]: r["text"] for r in feed.store.corpus().collect()}
    assert texts == {"tg:ch:0": "text 0", "tg:ch:1": "text 1", "tg:ch:2": "text 2", "tg:ch:5": "newest", "tg:ch:6": "some words"}
    feed.arrive(message(6), message(0), message(7))
    feed.drain()
    assert len(feed.keys()) == 6 and "tg:ch:7" in feed.keys()
