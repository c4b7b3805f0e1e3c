"""Search against brute force, in both forms, with ties and hot groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.operators import blocks, filters, search
from passagemill.operators.encoding import hash_encoder, model_encoder, term_encoder
from passagemill.operators.ranking import keep_first, top_per_group
from passagemill.operators.rerank import model_scorer, rerank

K = 7


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    chunks = rng.normal(size=(600, 16)).astype(np.float32)
    chunks[200:400] = chunks[0]  # a third of all rows are copies
    queries = rng.normal(size=(9, 16)).astype(np.float32)
    ids = [f"c{i:04d}" for i in rng.permutation(600)]
    c = spark.createDataFrame(
        [(ids[i], [float(x) for x in chunks[i]]) for i in range(600)], "chunk_id string, embedding array<float>"
    ).repartition(5)
    q = spark.createDataFrame(
        [(i, [float(x) for x in queries[i]]) for i in range(9)], "query_id bigint, embedding array<float>"
    )
    scores = queries.astype(np.float64) @ chunks.astype(np.float64).T
    scores = np.sign(scores) * np.floor(np.abs(scores) * 1e6 + 0.5) / 1e6
    want = {}
    for i in range(9):
        order = sorted(range(600), key=lambda j: (-scores[i, j], ids[j]))[:K]
        want[i] = [(ids[j], scores[i, j]) for j in order]
    return q, c, want


def collected(pairs):
    out = {}
    for r in sorted(pairs.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    return out


def test_shipped_form_is_exact(vectors):
    q, c, want = vectors
    pairs, n = blocks.best_pairs(q, c, K)
    assert n == 9 and collected(pairs) == want


def test_blocked_form_is_exact(vectors, monkeypatch):
    q, c, want = vectors
    monkeypatch.setattr(blocks, "MAX_SHIPPED_ROWS", 3)
    monkeypatch.setattr(blocks, "TILE_ROWS", 7)
    pairs, _ = blocks.best_pairs(q, c, K)
    assert "Cartesian" not in pairs._jdf.queryExecution().toString()
    assert collected(pairs) == want


def test_short_vectors_are_left_out_by_their_length(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    chunks = rng.normal(size=(400, 8)) * (1 / (1 + np.arange(400)))[:, None]
    chunks[0], chunks[1], chunks[2] = np.nan, 0.0, chunks[7]  # nan, no length, a tie
    asked = rng.normal(size=(6, 8))
    asked[0] = 0.0

    def batch(name, vectors):
        names = [f"{name}{n:03}" for n in range(len(vectors))]
        return pa.table({f"{name}_id": names, "embedding": pa.array(vectors.tolist(), pa.list_(pa.float64()))})

    questions, scored = blocks.DenseQuestions(batch("query", asked)), []
    offer = blocks.Best.offer
    monkeypatch.setattr(blocks, "TILE_ROWS", 20)
    monkeypatch.setattr(blocks.Best, "offer", lambda self, s, *a, **b: (scored.append(s.size), offer(self, s, *a, **b)))
    best = blocks.Best(6, 5)
    questions.score(batch("chunk", chunks).to_batches()[0], best)
    assert sum(scored) < 400 * 6
    kept = best.prune()
    for q in range(6):
        all_scores = blocks._round(chunks @ asked[q])
        want = sorted((-s, f"chunk{n:03}") for n, s in enumerate(all_scores) if np.isfinite(s))[:5]
        mine = kept[kept["query"] == q]
        assert list(zip(-mine["score"], mine["chunk_id"])) == want


def test_small_steps_do_not_change_the_result(vectors):
    q, c, want = vectors
    questions = blocks.DenseQuestions(q.toArrow())
    best = blocks.Best(9, K)
    table = c.toArrow().combine_chunks()
    for batch in table.to_batches(max_chunksize=11):
        questions.score(batch, best)
        best.prune()
    kept = best.prune()
    for i in range(9):
        mine = kept[kept["query"] == i]
        assert list(zip(mine["chunk_id"], mine["score"])) == want[questions.ids[i]]


def lexical_by_hand(queries, texts, k):
    from collections import Counter
    from math import floor, sqrt

    def counts(t):
        return Counter(w for w in t.lower().split() if len(w) >= 4)

    want = {}
    for qid, q in queries:
        qc, found = counts(q), []
        for cid, t in texts:
            tc = counts(t)
            dot = sum(qc[w] * tc[w] for w in qc)
            if dot:
                norm = sqrt(sum(v * v for v in qc.values()) * sum(v * v for v in tc.values()))
                found.append((cid, floor(dot / norm * 1e6 + 0.5) / 1e6))
        found.sort(key=lambda p: (-p[1], p[0]))
        if found:
            want[qid] = found[:k]
    return want


@pytest.mark.parametrize("cells", [4_000_000, 50])
@pytest.mark.parametrize("shipped", [True, False])
def test_lexical_is_exact(spark, monkeypatch, shipped, cells):
    rng = np.random.default_rng(2)
    vocabulary = [f"word{i}" for i in range(30)] + ["the", "of"]
    texts = [(f"c{i:03d}", " ".join(rng.choice(vocabulary, rng.integers(0, 25)))) for i in range(200)]
    texts += [(f"d{i:03d}", "word1 word2 word2") for i in range(100)]
    queries = [(f"q{i}", " ".join(rng.choice(vocabulary, 5))) for i in range(8)] + [("none", "of the")]
    monkeypatch.setattr(blocks, "MAX_CELLS", cells)
    if not shipped:
        monkeypatch.setattr(blocks, "MAX_SHIPPED_ROWS", 1)
        monkeypatch.setattr(blocks, "MAX_SHIPPED_VALUES", 12)
    q = term_encoder("query")(spark.createDataFrame(queries, "query_id string, query string"))
    c = term_encoder("text")(spark.createDataFrame(texts, "chunk_id string, text string").repartition(3))
    pairs, _ = blocks.best_pairs(q, c, K, "lexical")
    assert collected(pairs) == lexical_by_hand(queries, texts, K)


def test_empty_questions_and_empty_index(spark, vectors):
    q, c, _ = vectors
    assert blocks.best_pairs(q.limit(0), c, K)[0].count() == 0
    assert blocks.best_pairs(q, c.limit(0), K)[0].count() == 0


def test_term_norms_count_repeats(spark):
    df = term_encoder("text")(spark.createDataFrame([("aaaa bbbb aaaa aaaa",), ("x",), (None,)], "text string"))
    assert [r["norm2"] for r in df.collect()] == [10, 0, 0]


def test_filters_run_after_the_cut(spark):
    long = "some words about spark joins that are long enough to be no noise at all"
    rows = [(f"c{i}", "x" if i < 3 else long, "t", "web", "u", None, {"doc_id": f"d{i}"}, [1.0, float(i)])
            for i in range(6)]
    index = spark.createDataFrame(rows, "chunk_id string, text string, title string, source_type string, "
                                        "url string, date string, extra map<string,string>, embedding array<float>")
    q = spark.createDataFrame([(1, "spark joins", [1.0, -1.0])], "query_id bigint, query string, embedding array<float>")
    kept = search.search(q, index, internal_k=4, min_score=-9.0).orderBy("rank").collect()
    assert [(r["rank"], r["chunk_id"]) for r in kept] == [(1, "c3")]
    q2 = q.withColumn("query", F.lit("other topic"))
    assert search.search(q2, index, min_score=-9.0).count() == 0
    assert search.search(q2, index, min_score=-9.0, keyword_filter=False).count() == 3
    q3 = q.withColumn("query", F.lit("a b"))
    assert search.search(q3, index, min_score=-9.0).count() == 3


def results(spark, rows):
    return spark.createDataFrame(
        [(q, r, f"c{r}", kind, {"doc_id": doc}, float(10 - r), "query words", text) for q, r, kind, doc, text in rows],
        "query_id bigint, rank int, chunk_id string, source_type string, extra map<string,string>, "
        "score double, query string, text string",
    )


def test_type_and_scope_filters(spark):
    df = results(spark, [(1, 1, "Web", "a", ""), (1, 2, "msg", "b", ""), (1, 3, "web", "b", ""), (2, 1, "msg", "a", ""),
                         (3, 1, None, None, "")])

    def ranks(out):
        return sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in out.collect())

    everything = ranks(df)
    assert ranks(filters.filter_results(df)) == everything
    assert ranks(filters.filter_results(df, {"web"})) == [(1, 1, "c1"), (1, 2, "c3")]
    assert ranks(filters.filter_results(df, {"web"}, {"b"})) == [(1, 1, "c3")]
    assert ranks(filters.filter_fallback(df, {"web"})) == [(1, 1, "c1"), (1, 2, "c3"), (2, 1, "c1"), (3, 1, "c1")]
    assert ranks(filters.filter_fallback(df, set())) == everything
    scoped = filters.filter_fallback(df, {"web"}, {"b"}, scope_enabled=True)
    assert ranks(scoped) == [(1, 1, "c3"), (2, 1, "c1"), (3, 1, "c1")]
    assert ranks(filters.filter_fallback(df, {"web"}, {"b"})) == ranks(filters.filter_fallback(df, {"web"}))


def test_rerank_keeps_order_of_ties_and_cuts(spark):
    df = results(spark, [(1, r, "web", "a", "words" if r == 3 else "") for r in range(1, 9)])
    flat = rerank(df, lambda q, t, s: F.lit(1.0), top_n=6, top_k=3)
    assert [r["chunk_id"] for r in flat.orderBy("rank").collect()] == ["c1", "c2", "c3"]
    best = rerank(df, lambda q, t, s: F.when(t.contains("words"), 2.0).otherwise(1.0), top_n=6, top_k=2)
    assert [r["chunk_id"] for r in best.orderBy("rank").collect()] == ["c3", "c1"]
    assert rerank(df, enabled=False).count() == 8
    assert rerank(df, top_k=0).count() == 1

    def load():
        return lambda pairs: [float(len(text)) for _, text in pairs]

    by_model = rerank(df, model_scorer(load), top_k=1)
    assert by_model.first()["chunk_id"] == "c3"


def test_encoders(spark):
    df = spark.createDataFrame([("red green red",), ("",), (None,)], "text string")
    rows = [r["embedding"] for r in hash_encoder(8)(df).collect()]
    assert [len(v) for v in rows] == [8, 8, 8]
    assert abs(sum(x * x for x in rows[0]) - 1) < 1e-6 and not any(rows[1])

    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    assert [r["embedding"] for r in model_encoder(load)(df).collect()] == [[13.0, 1.0], [0.0, 1.0], [0.0, 1.0]]


@pytest.mark.parametrize("n", [2, 1500])
def test_top_per_group_with_a_hot_key(spark, n):
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
        "id",
    ).repartition(6)
    got = top_per_group(df, ["k"], [F.asc("id")], n)
    hot = [r["id"] for r in got.where("k = 'hot'").orderBy("rank").collect()]
    assert hot == [i * 3 for i in range(min(n, 2000))]
    assert got.groupBy("k").agg(F.max("rank").alias("m")).where(F.col("m") > n).count() == 0


def test_keep_first(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], "k string, o int")
    assert sorted((r["k"], r["o"]) for r in keep_first(df, "k", [F.asc("o")]).collect()) == [("a", 1), ("b", 5)]


def test_signed_vectors_equal_word_by_word_sums(spark):
    import hashlib

    import numpy as np
    import pyarrow as pa

    from passagemill.operators import encoding

    texts = ["one two two three", "", None, "Zwei zwei eins", "a b c d e f g " * 40]
    rows = spark.createDataFrame([(n, t, {"k": "v"}) for n, t in enumerate(texts)], "n int, text string, extra map<string,string>")
    got = {r["n"]: r for r in encoding.signed_encoder(16)(rows).collect()}
    for n, text in enumerate(texts):
        sums = np.zeros(16)
        for word in (text or "").lower().split():
            digest = hashlib.sha1(word.encode()).hexdigest()
            sums[int(digest[:8], 16) % 16] += -1 if int(digest[8], 16) % 2 else 1
        length = np.sqrt((sums * sums).sum())
        assert got[n]["embedding"] == (sums / length if length else sums).astype(np.float32).tolist()
        assert got[n]["text"] == text and got[n]["extra"] == {"k": "v"}
    assert encoding.signed_vectors(pa.array(["", "x"]), 4).shape == (2, 4)
