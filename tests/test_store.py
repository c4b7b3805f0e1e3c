"""Snapshots of corpus and index, the sync job on them, and joins that leave a bucketed corpus in place."""

import pytest
from pyspark.sql import functions as F

from passagemill.operators.dedup import only_new
from passagemill.operators.encoding import hash_encoder
from passagemill.plans import catalog
from passagemill.plans import ingest as I
from passagemill.session import scratch_path
from passagemill.sources import schema as S
from passagemill.sources.corpus import write_bucketed
from passagemill.sources.snapshots import Conflict, Snapshot, Store

GOOD = "<html><body><main>" + "a text about the good things of life. " * 40 + "</main></body></html>"


def chunks(spark, ids):
    return spark.createDataFrame([(i, f"text {i}", "t", "web", None, None, {}) for i in ids], S.CHUNK)


def test_states_change_as_a_whole(spark):
    store = Store(spark, scratch_path(spark, "store"))
    assert store.latest() == Snapshot() and store.corpus().count() == 0 and store.index_matches()
    with pytest.raises(FileNotFoundError):
        store.index()
    one = store.write_part(chunks(spark, ["a", "b"]), "corpus")
    assert store.corpus().count() == 0  # written, not committed
    first = store.commit(store.latest(), [one], [store.write_part(hash_encoder(8)(chunks(spark, ["a", "b"])), "index")])
    assert first.version == 1 and store.latest() == first and store.index_matches()
    two = store.write_part(chunks(spark, ["c"]), "corpus")
    second = store.commit(first, [two])
    assert {r[0] for r in store.corpus().select("chunk_id").collect()} == {"a", "b", "c"}
    assert not store.index_matches() and store.index_matches(first) and store.at(1) == first
    with pytest.raises(Conflict):
        store.commit(first, [two])
    assert store.latest() == second
    empty = store.reset()
    assert empty.version == 3 and store.corpus().count() == 0 and store.corpus(first).count() == 2


def test_failed_and_repeated_syncs_leave_whole_states(spark):
    store = Store(spark, scratch_path(spark, "store"))
    pages = spark.createDataFrame(
        [(1, "https://x.org/a", GOOD), (2, "https://x.org/b", GOOD.replace("life", "work")), (3, "", GOOD)],
        "page_id long, url string, html string",
    )

    def failing(df):
        raise RuntimeError("no encoder")

    with pytest.raises(RuntimeError):
        I.sync_store(pages, None, store, failing, [" the "])
    assert store.latest() == Snapshot() and store.corpus().count() == 0
    first = I.sync_store(pages, None, store, hash_encoder(8), [" the "]).first()
    assert first["total_added"] == store.corpus().count() == store.index().count() > 0
    assert first["index_ok"] and not first["messages_synced"]
    state = store.latest()
    again = I.sync_store(pages, None, store, hash_encoder(8), [" the "]).first()
    assert again["total_added"] == 0 and again["index_ok"] and store.latest() == state


def test_existing_rows_stay_in_their_buckets(spark):
    known = write_bucketed(chunks(spark, [f"k{n}" for n in range(300)]), scratch_path(spark, "known"), buckets=8)
    batch = spark.createDataFrame(
        [(f"k{n % 450}", n) for n in range(900)] + [(None, 1), ("", 2)], "chunk_id string, n int"
    ).repartition(3)
    new = only_new(batch, known, "chunk_id", [F.asc("n")], buckets=8)
    assert sorted(tuple(r) for r in new.select("chunk_id", "n").collect()) == sorted((f"k{n}", n) for n in range(300, 450))
    plan = new._jdf.queryExecution().executedPlan().toString()
    kept = plan[plan.index("SortMergeJoin"):]
    assert kept.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in kept
    assert {tuple(r) for r in only_new(batch, known, "chunk_id", [F.asc("n")]).collect()} == {tuple(r) for r in new.collect()}


def test_whole_query_leaves_the_stored_corpus_in_place(spark, sf_dir):
    plan = catalog.QUERIES["dedup_chunks"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    right = plan[plan.index("SortMergeJoin"):]
    scan = right.index("bucketed_")
    assert "Bucketed: true" in right and "Exchange" not in right[right.rindex("HashAggregate", 0, scan):scan]
