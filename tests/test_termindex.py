"""The stored term index against a direct comparison of every question with every chunk."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from passagemill.functions.text import words
from passagemill.operators import termindex
from passagemill.operators.encoding import term_encoder
from passagemill.operators.search import search
from passagemill.plans import fixtures
from passagemill.session import scratch_path
from passagemill.sources import schema as S


def chunk_rows(texts):
    return [(f"c{n:04d}", t, "title", "web", None, None, {}) for n, t in enumerate(texts)]


def brute(chunks, questions, k):
    out = {}
    for qid, own in questions.items():
        scored = []
        for cid, bag in chunks.items():
            dots = sum(n * bag.get(t, 0) for t, n in own.items())
            if dots:
                length = math.sqrt(float(sum(v * v for v in bag.values())) * float(sum(v * v for v in own.values())))
                scored.append((-math.floor(dots / length * 1e6 + 0.5) / 1e6, cid))
        out[qid] = [(cid, -s) for s, cid in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("block, rows", [(4096, 50_000), (16, 3)])
def test_best_k_equal_brute_force(spark, monkeypatch, block, rows):
    """Ties, copies, empty and null texts, one and many blocks, one and many passes."""
    monkeypatch.setattr(termindex, "BLOCK_CHUNKS", block)
    monkeypatch.setattr(termindex, "MAX_PASS_ROWS", rows)
    r = random.Random(9)
    pool = [f"term{n:02d}" for n in range(40)]

    def text(most):
        return " ".join(pool[min(int(r.expovariate(0.1)), 39)] for _ in range(r.randrange(most)))

    texts = [text(30) for _ in range(400)] + ["", None, "other words here"] + ["term01 term01 term02"] * 60
    chunks = spark.createDataFrame(chunk_rows(texts), S.CHUNK)
    asked = [(n, text(12)) for n in range(9)] + [(20, ""), (21, "unseen"), (22, "term01 term02 term02"), (23, None)]
    queries = term_encoder("query")(spark.createDataFrame(asked, "query_id int, query string"))
    bags = {c["chunk_id"]: Counter(c["w"]) for c in chunks.select("chunk_id", words(F.col("text")).alias("w")).collect()}
    questions = {q["query_id"]: Counter(q["terms"]) for q in queries.collect()}
    index = termindex.build_term_index(chunks, scratch_path(spark, "terms"))
    assert index.chunks.count() == len(texts)
    got, number = termindex.best_by_terms(queries, index, 7)
    found = {q: [] for q in questions}
    for row in got.orderBy("query_id", "rank").collect():
        found[row["query_id"]].append((row["chunk_id"], row["score"]))
    assert found == brute(bags, questions, 7)
    assert number == sum(bool(own) for own in questions.values())


def test_blocks_out_of_reach_are_not_scored(spark):
    texts = ["alpha beta gamma"] * 5 + [f"alpha filler{n} " + "padding words " * 60 for n in range(200)]
    index = termindex.build_term_index(spark.createDataFrame(chunk_rows(texts), S.CHUNK), scratch_path(spark, "terms"))
    blocks = {r["block"]: r for r in index.blocks.collect()}
    assert len(blocks) == 2
    asked = termindex.Asked(
        term_encoder("query")(spark.createDataFrame([(1, "alpha beta gamma")], "query_id int, query string"))
        .select("query_id", "terms", "norm2").toArrow(), 3,
    )
    scored = []
    monkey = asked.offer
    asked.offer = lambda *args: (scored.append(args[0]), monkey(*args))
    import numpy as np

    for block in sorted(blocks):
        rows = index.postings.where((F.col("block") == block) & F.col("term").isin("alpha", "beta", "gamma")).collect()
        asked.score(
            blocks[block]["ids"], np.array(blocks[block]["norms"], float),
            [(r["term"], r["bound"], np.array(r["places"]), np.array(r["tfs"])) for r in rows],
        )
    assert scored == [0] and asked.floor[0] == 1.0


def test_index_is_written_once_and_read(spark, sf_dir):
    first, again = fixtures.lexical_index(spark, sf_dir), fixtures.lexical_index(spark, sf_dir)
    assert first.path == again.path
    found = search(fixtures.queries(spark, sf_dir), first, min_score=fixtures.LEXICAL_MIN_SCORE, method="lexical")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 0 and plan.count(f"{first.path}/chunks") == 1
    with pytest.raises(FileNotFoundError):
        termindex.open_term_index(spark, scratch_path(spark, "nothing"))


def test_entries_are_made_from_counts_in_one_shuffle(spark):
    """Repeated chunk ids and words: places fit in postings and blocks, and no exchange moves a text."""
    rows = chunk_rows(["alpha alpha beta", "beta", "", None]) + chunk_rows(["beta gamma"])
    chunks = spark.createDataFrame(rows, S.CHUNK)
    counted = {r["text"]: (dict(zip(r["terms"], r["tfs"])), r["norm2"]) for r in termindex.term_counts(chunks).collect()}
    assert counted["alpha alpha beta"] == ({"alpha": 2, "beta": 1}, 5)
    assert counted[""] == counted[None] == ({}, 0)
    index = termindex.build_term_index(chunks, scratch_path(spark, "terms"))
    blocks = {r["block"]: r for r in index.blocks.collect()}
    found = []
    for r in index.postings.collect():
        own = blocks[r["block"]]
        weights = [tf / math.sqrt(own["norms"][p]) for p, tf in zip(r["places"], r["tfs"])]
        assert r["bound"] == max(weights)
        found += [(own["ids"][p], r["term"], tf) for p, tf in zip(r["places"], r["tfs"])]
    assert sorted(found) == [
        ("c0000", "alpha", 2), ("c0000", "beta", 1), ("c0000", "beta", 1), ("c0000", "gamma", 1), ("c0001", "beta", 1)
    ]
    assert sum(len(b["ids"]) for b in blocks.values()) == 5
    assert "text" not in index.postings.columns and "place" not in index.chunks.columns


def test_scores_below_the_least_are_left_out(spark):
    texts = ["alpha beta", "alpha gamma delta", "alpha " + "x1 x2 x3 x4 x5 x6 x7 x8"]
    index = termindex.build_term_index(spark.createDataFrame(chunk_rows(texts), S.CHUNK), scratch_path(spark, "terms"))
    queries = term_encoder("query")(spark.createDataFrame([(1, "alpha beta")], "query_id int, query string"))
    every = [(r["chunk_id"], r["score"]) for r in termindex.best_by_terms(queries, index, 9)[0].orderBy("rank").collect()]
    least = every[1][1]
    some = [(r["chunk_id"], r["score"]) for r in termindex.best_by_terms(queries, index, 9, least)[0].orderBy("rank").collect()]
    assert len(every) == 3 and some == every[:2]
