"""Answers, evaluation, ingest, interchange and streaming."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from passagemill.operators import answers as A
from passagemill.operators import dedup, evaluation, feedback, stats
from passagemill.operators.chunking import chunk_documents
from passagemill.operators.encoding import hash_encoder, term_encoder
from passagemill.operators.rerank import keyword_share
from passagemill.plans import ask
from passagemill.plans import ingest as I
from passagemill.session import scratch_path, shared_dir
from passagemill.sources import corpus, jsonl
from passagemill.sources import schema as S
from passagemill.sources.snapshots import Store
from passagemill.streaming import messages as stream

LONG = "This opening sentence is long enough. "


def results(spark, rows):
    made = [(q, r, f"c{q}{r}", 0.5, f"T[{r}]", "web", f"u{r}", "2024-01-01", {"doc_id": f"d{r}"}, text)
            for q, r, text in rows]
    return spark.createDataFrame(
        made, "query_id bigint, rank int, chunk_id string, score double, title string, source_type string, "
              "url string, date string, extra map<string,string>, text string")


def questions(spark, *ids):
    return spark.createDataFrame([(i, f"what about words{i}") for i in ids], "query_id bigint, query string")


def test_bullets_skip_copies_and_stop_at_three(spark):
    texts = [LONG + "Second sentence is also long enough.", LONG, LONG, "Another sentence that is quite long. Rest.",
             "A third sentence, which is long as well."]
    df = results(spark, [(1, i + 1, t) for i, t in enumerate(texts)])
    got = [(r["rank"], r["bullet"], r["summary"]) for r in A.answer_bullets(df).orderBy("bullet").collect()]
    assert [g[:2] for g in got] == [(1, 1), (2, 2), (4, 3)]
    assert got[0][2] == LONG + "Second sentence is also long enough."
    assert got[1][2] == LONG.strip()


def test_bullets_drop_the_lead_and_short_texts(spark):
    df = results(spark, [(1, 1, LONG), (1, 2, LONG.upper()), (1, 3, "tiny"), (2, 1, "  "), (2, 2, LONG)])
    got = sorted((r["query_id"], r["rank"], r["bullet"]) for r in A.answer_bullets(df).collect())
    assert got == [(1, 1, 1), (2, 2, 1)]


def test_answers_for_every_question(spark):
    df = results(spark, [(1, 1, LONG + "words1"), (3, 1, "  ")])
    rows = {r["query_id"]: r for r in A.extractive_answers(df, questions(spark, 1, 2, 3)).collect()}
    assert rows[1]["used_sources"] == [1] and rows[1]["warnings"] == []
    assert "[1] [T(1)](u1) — `web` • 2024-01-01 • score=0.500" in rows[1]["markdown"]
    assert "<mark>words1</mark>" in rows[1]["markdown"]
    assert rows[2]["warnings"] == ["no_results"] and rows[2]["used_sources"] == []
    assert A.ENGLISH.no_text in rows[3]["markdown"] and rows[3]["used_sources"] == [1]


def test_context_budget(spark):
    df = results(spark, [(1, 1, "a" * 100), (1, 2, "b" * 100), (1, 3, "c")])
    first = len("[1] (web) T[1]\nURL: u1\nDATE: 2024-01-01\nTEXT: " + "a" * 100 + "\n\n")
    packed = [r["rank"] for r in A.pack_context(df, max_chars=2 * first).collect()]
    assert sorted(packed) == [1, 2]
    assert A.pack_context(df, max_chars=first - 1).count() == 0
    prompt = A.prompts(df, questions(spark, 1, 2), max_chars=first - 1).collect()
    assert len(prompt) == 1 and prompt[0]["k_max"] == 3
    nothing = df.withColumn("url", F.lit(None).cast("string"))
    assert "URL: None" in A.pack_context(nothing).first()["piece"]


def test_audit(spark):
    df = results(spark, [(i, 1, LONG) for i in (1, 2, 3)])
    done = spark.createDataFrame(
        [(1, "fact [1] and [2].", None), (2, "Here THE PASSAGES do not say", None), (3, None, "timeout"),
         (4, "x [1]", None)], "query_id bigint, answer string, error string")
    rows = {r["query_id"]: r for r in A.audit_answers(done, df, questions(spark, 1, 2, 3, 4)).collect()}
    assert rows[1]["used_sources"] == [1] and rows[1]["warnings"] == []
    assert "**Sources:** [1]" in rows[1]["markdown"]
    assert rows[2]["warnings"] == ["no_citations_found", "llm_says_no_data"]
    assert rows[3]["warnings"] == ["llm_error: timeout"] and A.ENGLISH.extractive_head in rows[3]["markdown"]
    assert rows[4]["warnings"] == ["no_results"]


def test_citations_and_source_table(spark):
    df = results(spark, [(1, 1, LONG), (1, 2, "z" * 200), (2, 1, LONG)])
    ans = spark.createDataFrame([(1, [2, 9]), (2, [])], "query_id bigint, used_sources array<int>")
    assert [tuple(r) for r in A.citation_map(ans, df).collect()] == [(1, 2, "c12")]
    used = A.source_table(df, ans, used_only=True).collect()
    assert sorted((r["query_id"], r["rank"], r["used"]) for r in used) == [(1, 2, True), (2, 1, False)]
    assert [r["snippet"] for r in used if r["query_id"] == 1] == ["z" * 180 + "…"]
    assert A.source_table(df, ans).count() == 3


def rules_frame(spark):
    return spark.createDataFrame(
        [(1, "q1", None, "long enough", None), (2, "q2", "nowhere", None, None), (3, "q3", None, None, None),
         (4, "q4", None, None, "web")],
        "query_id bigint, query string, must_contain_url string, must_contain_text string, must_contain_type string")


def test_evaluation(spark):
    rows = [(1, r, LONG if r in (3, 4, 7) else "other") for r in range(1, 8)] + [(2, 1, LONG), (3, 1, LONG)]
    df = results(spark, rows)
    table = evaluation.eval_rows(rules_frame(spark), df)
    got = {r["query_id"]: (r["hit"], r["hit_rank"], r["precision_at_k"], r["top1_score"]) for r in table.collect()}
    assert got == {1: (True, 3, 0.4, 0.5), 2: (False, None, 0.0, 0.5), 3: (True, 1, 0.2, 0.5), 4: (False, None, 0.0, None)}
    m = evaluation.eval_metrics(table).first()
    assert (m["n"], m["recall_at_k"], m["mrr_at_k"]) == (4, 0.5, round((1 / 3 + 1) / 4, 6))
    assert (m["hit_at_1"], m["hit_at_3"], m["hit_at_5"], m["avg_precision_at_k"]) == (0.25, 0.5, 0.5, 0.15)
    assert m["top1_score_median"] == 0.5
    assert m["recall_at_k"] >= m["hit_at_1"] and m["mrr_at_k"] <= m["recall_at_k"]
    hist = evaluation.score_histogram(table).orderBy("bin").collect()
    assert [r["n"] for r in hist] == [0, 0, 0, 0, 0, 3, 0, 0, 0, 0] and hist[0]["lower"] == 0.0
    assert {r["hit"]: r["n"] for r in evaluation.hit_ratio(table).collect()} == {True: 2, False: 2}
    assert {r["hit_rank"]: r["n"] for r in evaluation.rank_histogram(table).collect()} == {1: 1, 3: 1}


def test_metrics_of_nothing(spark):
    rows = evaluation.eval_rows(rules_frame(spark).limit(0), results(spark, [(1, 1, "x")]))
    m = evaluation.eval_metrics(rows).first()
    assert (m["n"], m["recall_at_k"], m["top1_score_mean"], m["top1_score_median"]) == (0, 0.0, None, None)


def test_median_interpolates(spark):
    rows = spark.createDataFrame(
        [(True, 1, 0.2, s) for s in (0.1, 0.2, 0.4, 0.9)] + [(False, None, 0.0, None)],
        "hit boolean, hit_rank int, precision_at_k double, top1_score double")
    m = evaluation.eval_metrics(rows).first()
    assert m["top1_score_median"] == 0.3 and m["top1_score_mean"] == 0.4


def test_report_is_written(spark):
    path = scratch_path(spark, "report")
    table = evaluation.eval_rows(rules_frame(spark), results(spark, [(1, 1, LONG)]))
    evaluation.write_report(table, evaluation.eval_metrics(table), path)
    assert spark.read.option("header", True).csv(f"{path}/eval_results").count() == 4
    assert spark.read.json(f"{path}/metrics").first()["n"] == 4


def test_feedback(spark):
    df = results(spark, [(1, r, LONG) for r in range(1, 13)])
    ans = A.extractive_answers(df, questions(spark, 1, 2))
    ratings = spark.createDataFrame([(1, "t1", 1, " ok "), (2, "t2", -1, None)], "query_id bigint, ts string, rating int, comment string")
    rows = {r["query_id"]: r for r in feedback.feedback_records(ratings, ans, df, {"doc_scope_ids": ["b", "a"]}).collect()}
    assert [s["rank"] for s in rows[1]["retrieval_sources"]] == list(range(1, 11))
    assert rows[1]["comment"] == "ok" and rows[1]["doc_scope_ids"] == ["a", "b"]
    assert rows[2]["retrieval_sources"] == [] and rows[2]["warnings"] == ["no_results"]
    verdicts = feedback.verdict_records(spark.createDataFrame([("t", " q ", "good", None)], "ts string, query string, verdict string, comment string"))
    log = feedback.feedback_records(ratings, ans, df).drop("query_id").unionByName(verdicts)
    path = scratch_path(spark, "feedback")
    jsonl.append_objects(log, path)
    back = jsonl.read_objects(spark, path, S.FEEDBACK)
    assert feedback.bad_feedback(back).count() == 1
    assert feedback.bad_feedback(back.drop("rating")).count() == 0
    counts = {(r["rating"], r["verdict"]): r["n"] for r in feedback.feedback_counts(back).collect()}
    assert counts == {(1, None): 1, (-1, None): 1, (None, "good"): 1}
    assert [r["ts"] for r in jsonl.tail(back, [F.desc("ts")], 2).collect()] == ["t2", "t1"]
    assert jsonl.tail(back, [F.desc("ts")], None).count() == 3


GOOD = {"chunk_id": "a", "text": "t", "title": "x", "source_type": "web"}
LINES = [
    json.dumps(GOOD), "  " + json.dumps({**GOOD, "extra": None, "url": None}) + "  ", "",
    json.dumps({**GOOD, "extra": {"k": "v"}, "date": "2024-01-01"}), json.dumps({**GOOD, "who": 1}),
    json.dumps({"chunk_id": "b"}), "[1, 2]", "7", '{"chunk_id": "c"', "not json", "null",
    json.dumps(GOOD) + json.dumps(GOOD), json.dumps(GOOD) + ", " + json.dumps(GOOD), json.dumps(GOOD) + " x",
]


@pytest.fixture(scope="module")
def lines_path(spark):
    path = scratch_path(spark, "lines")
    spark.createDataFrame([(v,) for v in LINES], "value string").coalesce(1).write.text(path)
    return path


def test_jsonl(spark, lines_path):
    assert jsonl.read_objects(spark, lines_path, S.CHUNK).count() == 5
    assert jsonl.parse_values(jsonl.read_lines(spark, lines_path)).count() == 8
    strict = jsonl.read_chunks(spark, lines_path).collect()
    assert [r["extra"] for r in strict] == [{}, {}, {"k": "v"}]
    assert jsonl.read_objects(spark, lines_path + "-missing", S.CHUNK).count() == 0
    odd = spark.createDataFrame([(v,) for v in (
        '{"chunk_id": "a", "chunk_id": "b", "text": "t"}', '{"chunk_id": "c", "score": NaN}',
        "{'chunk_id': 'd'}", '"{"', '{"chunk_id": "e"', '{"chunk_id": "f"}{}', '{"chunk_id": "g"}, {}', "", "NaN",
    )], "value string")
    assert [r["chunk_id"] for r in jsonl.parse_objects(odd, S.CHUNK).collect()] == ["b", "c"]
    assert [r["json"] for r in jsonl.parse_values(odd).collect()] == [odd.collect()[n][0] for n in (0, 1, 3, 8)]
    with pytest.raises(Exception, match="broken JSONL line"):
        jsonl.read_objects(spark, lines_path, S.CHUNK, strict=True).collect()


def test_type_stats(spark):
    lines = ['{"source_type":"web"}', '{"source_type":""}', '{"source_type":null}', '{"a":1}', "bad", "[1]", '{"source_type":"web"} {}']
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    assert {r["source_type"]: r["n"] for r in stats.type_stats(df).collect()} == {"web": 1, "other": 1}


def test_overwrite_and_corpus_tables(spark, lines_path):
    path = scratch_path(spark, "corpus")
    assert corpus.read_corpus(spark, path).count() == 0
    chunks = jsonl.read_chunks(spark, lines_path)
    corpus.append_corpus(chunks, path)
    corpus.append_corpus(chunks, path)
    assert corpus.read_corpus(spark, path).count() == 6
    assert corpus.read_corpus(spark, path).columns == S.CHUNK_COLUMNS
    index = scratch_path(spark, "index")
    corpus.build_index(chunks, hash_encoder(8), index)
    corpus.reset_corpus(spark, path, index)
    assert corpus.load_index(spark, index).count() == 0
    assert "embedding" in corpus.load_index(spark, index).columns
    assert corpus.read_corpus(spark, path).count() == 0
    out = scratch_path(spark, "sidecar")
    jsonl.overwrite_objects(chunks, out)
    jsonl.overwrite_objects(chunks, out)
    assert jsonl.read_chunks(spark, out).count() == 3


def test_index_table(spark, lines_path):
    path = scratch_path(spark, "index")
    with pytest.raises(FileNotFoundError):
        corpus.load_index(spark, path)
    chunks = jsonl.read_chunks(spark, lines_path)
    with pytest.raises(ValueError):
        corpus.build_index(chunks.limit(0), hash_encoder(8), path)
    assert corpus.build_index(chunks, hash_encoder(8), path).count() == 3


def test_shared_dir_comes_from_the_session(spark):
    class Session:
        def __init__(self, named, master):
            self.conf = type("Conf", (), {"get": staticmethod(lambda key, default: named)})
            self.sparkContext = type("Context", (), {"master": master})

    assert scratch_path(spark, "x").startswith(shared_dir(spark) + "/x-")
    assert shared_dir(Session("hdfs:///shared/", "yarn")) == "hdfs:///shared"
    assert shared_dir(Session(None, "local[2]")) == shared_dir(Session(None, "local[2]"))
    with pytest.raises(RuntimeError):
        shared_dir(Session(None, "yarn"))


def page(i, url, body):
    return (i, url, f"<title>T{i}</title><article><p>{body}</p></article>")


def pages_frame(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_page_ingest_is_idempotent(spark):
    body = "good words here " * 100
    batch = pages_frame(spark, [
        page(1, "u1", body), page(2, " ", body), page(3, "u3", "short good"), (4, "u4", None),
        page(5, "u1", body + "more " * 300), page(6, "u6", body + " bad marker"),
    ])
    empty = spark.createDataFrame([], S.CHUNK)
    chunks, log = I.ingest_pages(batch, empty, ["good"], ["bad marker"])
    assert {r["page_id"]: (r["status"], r["added"] > 0) for r in log.collect()} == {
        1: ("ok", True), 2: ("skipped", False), 3: ("skipped", False), 4: ("error", False),
        5: ("ok", True), 6: ("skipped", False),
    }
    ids = [r["chunk_id"] for r in chunks.collect()]
    assert len(ids) == len(set(ids)) and ids[0].startswith("web_web::u1_")
    report = I.page_report(log).first()
    assert (report["processed"], report["skipped"], report["errors"], report["added"]) == (6, 3, 1, len(ids))
    path = scratch_path(spark, "pages")
    corpus.append_corpus(chunks, path)
    again, _ = I.ingest_pages(batch, corpus.read_corpus(spark, path), ["good"], ["bad marker"])
    assert again.count() == 0
    documents = I.page_documents(batch, ["good"], ["bad marker"])
    assert I.page_chunks(documents, corpus.read_corpus(spark, path), refresh=True).count() == len(ids)


def message(i, channel="@ch", ts="2024-01-02T00:00:00", text="hello", media=False, real=True):
    return (channel, i, dt.datetime.fromisoformat(ts) if ts else None, text, media, real)


MESSAGES = "channel string, msg_id bigint, ts timestamp_ntz, text string, has_media boolean, is_message boolean"


def classify(spark, rows, known=(), **options):
    df = spark.createDataFrame(rows, MESSAGES)
    keys = spark.createDataFrame([(k,) for k in known], "message_key string")
    as_of = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    return I.classify_messages(df, keys, as_of, **options)


def test_message_classes(spark):
    rows = [
        message(1), message(2, ts="2023-01-01T00:00:00"), message(3, ts=None), message(4, text=" "),
        message(5, text=None, media=True), message(6), message(7, real=False), message(1, channel="https://t.me/ch"),
        message(8, text="", ts="2023-01-01T00:00:00"),
    ]
    got = classify(spark, rows, known=["tg:ch:6", "", None], since_days=30)
    assert sorted((r["msg_id"], r["status"]) for r in got.collect()) == [
        (1, "duplicate"), (1, "kept"), (2, "skipped"), (3, "kept"), (4, "empty"), (5, "kept"), (6, "duplicate"),
        (7, "skipped"), (8, "skipped"),
    ]
    everything = classify(spark, rows, since_days=0)
    assert everything.where("status = 'kept'").count() == 5


def test_message_cap_comes_first(spark):
    rows = [message(i, ts=f"2024-01-02T00:00:{i:02d}", text=" " if i > 5 else "x") for i in range(10)]
    got = classify(spark, rows, limit=5)
    assert sorted((r["msg_id"], r["status"]) for r in got.collect()) == [
        (5, "kept"), (6, "empty"), (7, "empty"), (8, "empty"), (9, "empty")]


def test_message_ingest_and_sync(spark):
    rows = [message(i, text=f"text {i} " * 100) for i in range(4)]
    df = spark.createDataFrame(rows, MESSAGES)
    as_of = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    empty = spark.createDataFrame([], S.CHUNK)
    chunks, classified = I.ingest_messages(df, empty, as_of)
    path = scratch_path(spark, "messages")
    corpus.append_corpus(chunks, path)
    stored = corpus.read_corpus(spark, path)
    first = stored.first()
    assert first["extra"]["doc_id"].startswith("tg:ch:") and first["url"].startswith("https://t.me/ch/")
    again, classified_again = I.ingest_messages(df, stored, as_of)
    assert again.count() == 0
    report = I.message_report(classified_again, again).first()
    assert (report["processed"], report["duplicate"], report["added"]) == (4, 4, 0)
    summary = I.sync_summary(spark.createDataFrame([(3, 1)], "added bigint, errors bigint"),
                             I.message_report(classified, chunks), True).first()
    assert summary["total_added"] == 3 + stored.count() and summary["total_errors"] == 1
    alone = I.sync_summary(spark.createDataFrame([(3, 0)], "added bigint, errors bigint"), None, False).first()
    assert (alone["total_added"], alone["messages_synced"]) == (3, False)


def test_sync_twice_and_without_messages(spark):
    corpus_path, index_path = scratch_path(spark, "corpus"), scratch_path(spark, "index")
    pages = pages_frame(spark, [page(1, "u1", "good words here " * 100)])
    messages = spark.createDataFrame([message(1, text="hello there " * 20)], MESSAGES)
    as_of = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")

    def go(m, *rest):
        return I.sync(pages, m, corpus_path, index_path, hash_encoder(8), ["good"], as_of=as_of).first()

    first = go(None)
    assert first["total_added"] == 2 and first["index_ok"] and not first["messages_synced"]
    second = go(messages)
    assert second["total_added"] == 1 and second["messages_synced"]
    assert go(messages)["total_added"] == 0
    ids = [r["chunk_id"] for r in corpus.load_index(spark, index_path).collect()]
    assert len(ids) == len(set(ids)) == corpus.read_corpus(spark, corpus_path).count() == 3


def test_sync_of_nothing(spark):
    paths = scratch_path(spark, "corpus"), scratch_path(spark, "index")
    out = I.sync(pages_frame(spark, [page(1, "u", "short")]), None, *paths, hash_encoder(8), ["good"]).first()
    assert (out["total_added"], out["index_ok"]) == (0, False)


def test_ask_and_evaluate(spark, lines_path):
    docs = spark.createDataFrame(
        [("web", f"https://e.org/{i}", f"t{i}", f"This document speaks about topic{i} and nothing else at all, really.", None)
         for i in range(6)], "source_type string, url string, title string, raw_text string, date string")
    index = term_encoder("text")(chunk_documents(docs))
    asked = spark.createDataFrame([(1, "about topic3"), (2, "  "), (3, "unheard")], "query_id bigint, query string")
    answers, results = ask.ask(term_encoder("query")(asked), index, method="lexical", min_score=0.1)
    rows = {r["query_id"]: r for r in answers.collect()}
    assert set(rows) == {1, 3} and rows[3]["warnings"] == ["no_results"]
    assert results.where("query_id = 1 and rank = 1").first()["url"] == "https://e.org/3"

    path = scratch_path(spark, "rules")
    rules = ['{"query": "about topic3", "must_contain_url": "E.ORG/3"}', '{"query": "about topic4", "must_contain_text": "topic4"}',
             '{"query": "about topic4", "must_contain_text": "topic4"}', '{"query": "about topic5", "must_contain_type": "tg"}', "bad"]
    spark.createDataFrame([(r,) for r in rules], "value string").write.text(path)
    frame = jsonl.read_rules(spark, path)
    assert frame.select("query_id").distinct().count() == 4
    for options in ({}, {"scorer": keyword_share}):
        table, metrics = ask.evaluate(frame, term_encoder("query"), index, method="lexical", min_score=0.1, **options)
        m = metrics.first()
        assert (m["n"], m["recall_at_k"], m["mrr_at_k"], table.count()) == (4, 0.75, 0.75, 4)
        assert m["mode"] == ("reranker" if options else "index")
    _, uncut = ask.evaluate(frame, term_encoder("query"), index, cut_ranks=False, method="lexical", min_score=0.1)
    assert uncut.first()["recall_at_k"] == 0.75


def test_known_values_and_only_new(spark):
    chunks = spark.createDataFrame(
        [("a", {"doc_id": "d1", "k": ""}), ("b", {"doc_id": "d1"}), ("c", None)], "chunk_id string, extra map<string,string>")
    assert [r["doc_id"] for r in dedup.known_values(chunks).collect()] == ["d1"]
    assert dedup.known_values(chunks, "k").count() == 0
    batch = spark.createDataFrame([("a", 1), ("n", 2), ("n", 1), ("", 1), (None, 1)], "chunk_id string, o int")
    assert [tuple(r) for r in dedup.only_new(batch, chunks, "chunk_id", [F.asc("o")]).collect()] == [("n", 1)]


def test_doc_labels(spark):
    rows = [("c2", "Local", {"doc_id": "d1", "file_name": "late"}), ("c1", "local", {"doc_id": "d1", "saved_as": "s"}),
            ("c3", "local", {"doc_id": "d2"}), ("c4", "web", {"doc_id": "d3"}), ("c5", "local", {})]
    df = spark.createDataFrame(rows, "chunk_id string, source_type string, extra map<string,string>")
    assert {r["doc_id"]: r["label"] for r in stats.doc_labels(df).collect()} == {"d1": "s", "d2": "d2"}


def test_stream_is_exact_over_restarts(spark):
    arrivals, progress = (scratch_path(spark, n) for n in ("arrivals", "progress"))
    store = Store(spark, scratch_path(spark, "store"))
    as_of = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")

    def arrive(rows):
        spark.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("append").parquet(arrivals)

    def drain():
        schema = spark.createDataFrame([], MESSAGES).schema
        stream.run_message_ingest(stream.message_stream(spark, arrivals, schema), store, progress, as_of, 30)
        return sorted(r["extra"]["message_key"] for r in store.corpus().collect())

    arrive([message(1), message(2, ts="2022-01-01T00:00:00"), message(3, text=" ")])
    assert drain() == ["tg:ch:1"]
    arrive([message(1), message(4), message(5, ts="2023-12-20T00:00:00")])
    assert drain()[0] == "tg:ch:1"
    arrive([message(1, ts="2024-01-02T23:00:00"), message(4), message(6)])
    assert drain() == ["tg:ch:1", "tg:ch:4", "tg:ch:5", "tg:ch:6"]


def test_reingest_of_chunks_adds_nothing(spark):
    docs = spark.createDataFrame(
        [("web", f"u{i % 5}", "t", f"text {i % 5} " * 300, None, i) for i in range(20)],
        "source_type string, url string, title string, raw_text string, date string, i int")
    chunks = chunk_documents(docs, keep=("i",))
    new = dedup.only_new(chunks, spark.createDataFrame([], S.CHUNK), "chunk_id", [F.asc("i")])
    kept = new.collect()
    assert {r["i"] for r in kept} == set(range(5)) and len({r["chunk_id"] for r in kept}) == len(kept)
    assert dedup.only_new(chunks, new, "chunk_id", [F.asc("i")]).count() == 0
