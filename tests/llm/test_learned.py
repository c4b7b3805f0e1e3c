"""Quality, whitening and the prefix trie against brute force, NumPy and held-out labels."""

import hashlib
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from parity import compare, connect  # noqa: E402

from passagemill.llm import prefixtrie, quality, whitening  # noqa: E402
from passagemill.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, depth int, node string"


def brute_trie(rows):
    """Nodes of the trie by definition, for rows without ties of different texts."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        family = c - int(np.fmod(c, 100))
        whole[c] = tuple(own.get(family, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own_size = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = own_size + sum(saved[k] for k in children[node])
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(whole[c]) == len(node))
        out.append((
            convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), len(children[node]), leaves[node],
            saved[node], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def trie_rows(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def conversations(seed, many):
    """Shared beginnings, copies, absent family heads, turnless results, nulls, negative ids, long ones."""
    r = random.Random(seed)
    rows = [(n, t, None if t == 3 else "user", f"turn {t}") for n in range(500, 560) for t in range(r.randrange(1, 9))]
    for n in range(many):
        conv = r.choice([r.randrange(-150, 300), r.randrange(100_000)])
        rows += [(conv, t, r.choice(["user", "assistant"]), r.choice(["a", "b", None, "", "häuser"])) for t in range(r.randrange(1, 5))]
    rows += [(700, t, "user", f"long {t}") for t in range(900)] + [(701, t, "user", f"long {t}") for t in range(700)]
    rows += [(None, 1, "user", "nobody"), (800, None, None, None), (800, 1, "x", "y"), (900, 1, "r", "same"), (900, 1, "r", "same")]
    first = {}
    for conv, turn, role, text in rows:  # one text a turn, as ties of different texts are free
        first.setdefault((conv, turn), (conv, turn, role, text))
    return list(first.values()) + [(900, 1, "r", "same")]


@pytest.mark.parametrize("limits", [(prefixtrie.BLOCK_BYTES, prefixtrie.BLOCK_MEMBERS, prefixtrie.FLUSH), (300, 7, 5)])
def test_prefix_trie_equals_brute_force(spark, monkeypatch, limits):
    monkeypatch.setattr(prefixtrie, "BLOCK_BYTES", limits[0])
    monkeypatch.setattr(prefixtrie, "BLOCK_MEMBERS", limits[1])
    monkeypatch.setattr(prefixtrie, "FLUSH", limits[2])
    rows = conversations(3, 120)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*row, 1, "z") for row in rows], TURNS).repartition(5)
    assert trie_rows(prefixtrie.prefix_trie(df)) == brute_trie(rows)


def test_prefix_trie_spreads_a_hot_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "BLOCK_MEMBERS", 50)
    rows = [(n, t, "user", f"hot {t}") for n in range(2000, 2600) for t in range(7)] + conversations(4, 30)
    df = spark.createDataFrame([(*row, 1, "z") for row in rows], TURNS)
    assert trie_rows(prefixtrie.prefix_trie(df)) == brute_trie(rows)


def test_prefix_trie_of_an_empty_table_and_of_one_turn(spark):
    assert prefixtrie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    one = [(7, 1, None, None)]
    assert trie_rows(prefixtrie.prefix_trie(spark.createDataFrame([(*one[0], 1, "z")], TURNS))) == brute_trie(one)


def test_prefix_trie_query_equals_sql(spark):
    assert compare(spark, connect(SF), "op13_prefix_trie", SF)[0] is None


def test_radix_tree_grows_through_all_layouts():
    keys = sorted({bytes([a, b]) * 8 for a in range(256) for b in (0, 1, 7)} | {b"", b"\0" * 16, b"\0" * 32, b"\0" * 48})
    random.Random(2).shuffle(keys)
    tree, layouts = prefixtrie.Tree(), set()
    for key in keys:
        tree.insert(key)
        layouts.add(tree.root.layout)
    assert layouts == {0, 1, 2, 3}
    found = []
    for node, _ in tree.postorder():
        if not isinstance(node, prefixtrie.Inner):
            found.append(keys[node])
        elif node.end >= 0:
            found.append(keys[node.end])
    assert sorted(found) == sorted(keys)


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x string")


def test_whitening_equals_numpy(spark):
    g = np.random.default_rng(5)
    data = (g.normal(size=(400, 20)) * np.linspace(3, 0.2, 20)).astype(np.float32)
    rows = [(n, data[n].tolist(), 1, "x") for n in range(400)] + [(n, data[7].tolist(), 1, "x") for n in range(400, 600)]
    rows += [(900, None, 1, "x"), (901, [None] * 20, 1, "x"), (902, [float("nan")] * 20, 1, "x"), (903, [float("inf")] * 20, 1, "x"),
             (904, [1.0], 1, "x"), (905, [], 1, "x"), (None, data[3].tolist(), 1, "x"), (5, data[5].tolist(), 1, "x")]
    got = whitening.whiten(vectors_of(spark, rows)).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == 602 * 16 and set(got.n) == {400}
    x = np.floor(64 * data.astype(float)).astype(np.int64) + 1_000_000
    assert len(np.unique(x, axis=0)) == 400
    values, axes = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    want = ((x - x.mean(0)) @ axes[:, :16]) / np.sqrt(values[:16])
    own = got[got.vec_id < 400].drop_duplicates(["vec_id", "component"]).sort_values(["vec_id", "component"])
    table = own.whitened.to_numpy().reshape(400, 16)
    for k in range(16):
        assert min(abs(table[:, k] - want[:, k]).max(), abs(table[:, k] + want[:, k]).max()) < 1e-8
    assert abs(own.explained.to_numpy()[:16] / (values[:16] / values.sum()) - 1).max() < 1e-9
    assert got.identity_error.max() < 1e-10
    apart = ((400 * x - x.sum(0)) ** 2).sum(1)
    assert (own.deviation.to_numpy().reshape(400, 16)[:, 0] == apart).all()


def test_whitening_of_few_wide_and_no_vectors(spark):
    assert whitening.whiten(vectors_of(spark, [])).collect() == []
    assert whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0], 1, "x")] * 3)).collect() == []  # no variance
    flat = whitening.whiten(vectors_of(spark, [(n, [float(n), 2.0 * n, 5.0], 1, "x") for n in range(4)])).collect()
    assert {r["component"] for r in flat} == {1} and len(flat) == 4 and flat[0]["identity_error"] < 1e-9
    wide = whitening.whiten(vectors_of(spark, [(n, [1e30 * n, 1.0 * n * n], 1, "x") for n in range(5)])).collect()
    assert {r["vec_id"] for r in wide} == set(range(5)) and all(r["deviation"] is None or r["deviation"] >= 0 for r in wide)


def test_slices_certify_close_and_repeated_eigenvalues():
    g = np.random.default_rng(8)
    turn, _ = np.linalg.qr(g.normal(size=(30, 30)))
    values = np.sort(np.r_[9.0, 9.0, 9.0, 8.0, 8.0 - 1e-9, g.uniform(1, 5, 20), np.zeros(5)])[::-1]
    matrix = (turn * values) @ turn.T
    matrix = (matrix + matrix.T) / 2
    for shift in (8.5, 4.0, 1e-3, -1.0):
        assert whitening.inertia(matrix, shift) == ((values > shift).sum(), (values < shift).sum())
    found, axes = whitening.Slicer(matrix).leading(30)
    assert len(found) == 25 and abs(found - values[:25]).max() < 1e-12
    assert abs(axes @ axes.T - np.eye(25)).max() < 1e-10
    assert abs(matrix @ axes.T - axes.T * found).max() < 1e-12


def test_pairs_by_squares_equal_all_pairs():
    g = np.random.default_rng(1)
    bias, linear, vectors = 0.3, g.normal(size=40), g.normal(size=(40, quality.RANK))
    ends, feature, value = np.array([0, 3, 3, 9]), g.permutation(40)[:9], g.normal(size=9)
    want = []
    for a, b in zip(ends, ends[1:]):
        total = bias + linear[feature[a:b]] @ value[a:b]
        for i in range(a, b):
            for j in range(i + 1, b):
                total += (vectors[feature[i]] @ vectors[feature[j]]) * value[i] * value[j]
        want.append(total)
    assert np.allclose(quality.margins((bias, linear, vectors), ends, feature, value), want)


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op11_quality"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(got) == docs.count()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 3 == 1 and i in got]
    assert held and all(got[i]["held_out"] for i in held)
    assert np.mean([got[i]["predicted"] == labels[i] for i in held]) > 0.97
    by_text = defaultdict(set)
    for r in docs.collect():
        by_text[r["text"]].add(got[r["doc_id"]]["score"])
    assert all(len(scores) == 1 for scores in by_text.values())


def test_quality_of_odd_texts(spark):
    schema = "doc_id long, text string, n_chars long, quality string, row int, m0 int, quality_score double"
    texts = [None, "", " \n ", "one", "!!! ???", "w " * 30_000, "ab cd ef", "ab cd ef", "\u2028x\u00a0y"]
    docs = spark.createDataFrame([(n if n != 3 else None, t, None if n == 1 else len(t or ""), "q", 1, 2, 0.1) for n, t in enumerate(texts)], schema)
    none = spark.createDataFrame([], "doc_id long, quality int")
    for labels in (none, spark.createDataFrame([(n, n % 2) for n in range(9)] + [(None, 1), (4, None), (2, 1)], "doc_id long, quality int")):
        got = quality.with_quality(docs, quality.learn(docs, labels)).collect()
        assert len(got) == len(texts) and all(0 <= r["quality_score"] <= 1 and r["row"] == 1 for r in got)
        if labels is none:
            assert {r["quality_score"] for r in got} == {0.5}
    empty = docs.limit(0)
    assert quality.with_quality(empty, quality.learn(empty, none)).collect() == []


def test_language_calibration_counts_texts_once_and_whole(spark, monkeypatch):
    import pickletools

    from passagemill.llm import langid

    rows = [("der hund und die katze " + "x" * n, "de") for n in range(8)] + [("the dog and the cat " + "y" * n, "en") for n in range(8)]
    rows += [("the bird and the tree " * 6_000, "en")]  # over 100,000 characters
    copies = rows + rows[:1] * 40
    seen = []
    fit = langid.Model.fit
    monkeypatch.setattr(langid.Model, "fit", lambda self, found, labels: (seen.append((len(found), np.sort(labels).tolist())), fit(self, found, labels)))
    first = langid.learn(spark.createDataFrame(copies, "text string, lang string"))
    again = langid.learn(spark.createDataFrame(copies[::-1], "text string, lang string"))
    assert seen[0] == seen[1] == (17, [0] * 8 + [1] * 9)
    assert np.array_equal(first.scale, again.scale) and np.array_equal(first.trust, again.trust)
    # workers get plain values: nothing in the broadcast is imported from the package
    import pickle

    names = [str(arg) for _, arg, _ in pickletools.genops(pickle.dumps(first.state())) if arg is not None]
    assert not any("passagemill" in n for n in names)
