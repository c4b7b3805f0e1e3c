"""The pipeline operators against SQL, brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from parity import compare, connect  # noqa: E402

from passagemill.llm import common, langid, license, media, mixing, packing, relative, simhash, suffix, topk, toxicity  # noqa: E402
from passagemill.llm.components import components  # noqa: E402
from passagemill.llm.queries import ORACLE, QUERIES, tokenizer_path  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, fp string"


def words(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, copies, repeated rows and columns with clashing names."""
    passage = " ".join(words(1, 90))
    rows = [
        (0, None), (1, ""), (2, " \n "), (3, "one"), (4, passage), (5, passage), (5, passage),
        (6, "Head " + passage + " tail"), (7, " ".join(words(2, 4000))), (None, "Licensed under CC BY-NC 4.0."),
        (8, "ab " * 700), (9, "x. Released  under the\nMIT License. y"), (10, " ".join(words(3, 60))),
    ]
    data = [(i, t, None if n % 3 == 0 else "en", None if n % 4 == 0 else f"s{n % 3}", 1, 7, "z") for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def brute_repeats(texts, length):
    """Covered bytes of each text, by definition."""
    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("name", [n for n in ORACLE if n != "op6_suffix_dedup"])
def test_query_equals_sql(spark, name):
    problem, rows, _, _ = compare(spark, connect(SF), name, SF)
    assert problem is None, problem
    assert rows > 0


def test_license_scan_is_native_and_whole(spark, odd, none):
    found = license.scan(odd)
    assert not re.search("Python|Arrow|Pandas", found._jdf.queryExecution().toString())
    assert {(r["doc_id"], r["template"]) for r in found.collect()} == {(None, "cc-by-nc-4.0"), (9, "mit")}
    assert license.scan(none).count() == 0


def test_masks_cover_every_pair_of_bits():
    masks = simhash.covering_masks()
    assert all(any(not m & (1 << i | 1 << j) for m in masks) for i in range(64) for j in range(i, 64))


def test_simhash_components_equal_brute_force(spark, none):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(40)]
    values = {b ^ sum(1 << k for k in r.sample(range(64), r.randrange(4))) for b in base for _ in range(6)} | set(base)
    fps = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    got = {r["node"]: r["root"] for r in components(simhash.links(fps)).collect()}
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    for a in values:
        for b in values:
            same = got.get(simhash.signed(a), simhash.signed(a)) == got.get(simhash.signed(b), simhash.signed(b))
            assert same == (root(a) == root(b))
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_of_odd_texts(odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r["component_id"] for r in rows}
    assert by_id[0] == by_id[1] == by_id[2] == 0 and by_id[5] == 4


def test_encoder_gives_the_tokenizers_ids():
    """Words remembered one by one against whole texts, white space of all kinds included."""
    r = random.Random(5)
    texts = ["", " ", "a", "a \nb", "it's  ok", "<|endoftext|> x", "\nfoo bar", "foo \tbar\n\n"]
    texts += ["".join(r.choices("ab é\n\t '1.-\u3000\xa0\x85s", k=r.randrange(25))) for _ in range(3000)]
    encoder = packing.Encoder(tokenizer_path())
    for _ in range(2):  # new words, then remembered ones
        ids, counts = encoder.encode(texts)
        for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
            assert encoder.tokenizer.encode(text, add_special_tokens=False).ids == own.tolist()
    assert [len(a) for a in encoder.encode([])] == [0, 0]


def test_encoder_encodes_each_unit_once_in_bounded_runs():
    """Words that differ in marks or stand around line breaks share their units; signs among letters are no letters."""
    encoder, model, sent = packing.Encoder(tokenizer_path()), packing.Encoder(tokenizer_path()).units, []

    class Watched:
        def encode_batch_fast(self, runs, add_special_tokens):
            sent.append([r.split(" ")[1:] for r in runs])
            return model.encode_batch_fast(runs, add_special_tokens=add_special_tokens)

    encoder.units = Watched()
    r = random.Random(8)
    texts = ["foo foo, foo. foo\nfoo foo!! foo??", *("".join(r.choices("aé×÷ßɏ \n.,(12'œʯ", k=r.randrange(30))) for _ in range(2000))]
    texts += [" ".join(f"w{n}x" for n in range(low, low + 1000)) for low in range(0, 40_000, 1000)]
    for _ in range(2):
        ids, counts = encoder.encode(texts)
        for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
            assert encoder.tokenizer.encode(text, add_special_tokens=False).ids == own.tolist()
    units = [u for runs in sent for run in runs for u in run]
    assert len(units) == len(set(units)) and units.count("Ġfoo") == units.count("foo") == 1
    assert len(sent) > 1 and max(map(len, sent)) <= packing.RUNS and max(len(run) for runs in sent for run in runs) <= packing.RUN_UNITS


def test_packing_keeps_every_id_once(spark, odd, none):
    rows = packing.pack(odd, tokenizer_path(), 128).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = sorted(tuple(tok.encode(r["text"] or "", add_special_tokens=False).ids) + (0,) for r in odd.collect())
    docs = {}
    for r in rows:
        docs.setdefault((r["doc_id"], r["doc_tokens"], r["start"]), []).append(tuple(np.frombuffer(r["ids"], "<u4")))
    flat = Counter(i for ids in docs.values() for one in ids for i in one)
    assert flat == Counter(i for ids in want for i in ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert packing.pack_digest(none, tokenizer_path()).count() == 0


def test_patterns_cover_the_histogram_with_little_padding():
    rests = np.random.default_rng(0).integers(1, 1024, 3000)  # cut at the grid, as documents are
    lengths = np.concatenate([rests - rests % packing.GRID, rests % packing.GRID])
    lengths = lengths[lengths > 0]
    histogram = Counter(lengths.tolist())
    plan = packing.patterns(histogram)
    got = Counter()
    for pattern, n in plan.items():
        assert sum(pattern) <= 1024
        for length in pattern:
            got[length] += n
    assert got == histogram
    assert sum(plan.values()) * 1024 < 1.01 * lengths.sum() + 2048
    sizes = np.array(sorted(histogram))
    _, amount, gap = packing.column_generation(sizes, np.array([float(histogram[int(n)]) for n in sizes]), 1024)
    assert gap <= packing.TOLERANCE and sum(plan.values()) <= amount.sum() + len(sizes)


def test_mix_meets_targets(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs.where("source is not null")).join(docs.select("doc_id", "source"), "doc_id").collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    for source, want in target.items():
        assert abs(taken[source] - want) <= 2
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in rows))
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    total = mixed.agg(F.sum(mixing.size_of(F.col("text")))).first()[0]
    assert abs(total - sum(r["taken"] for r in rows)) <= 2 * len(target)


def test_media_round_trip(odd, none):
    rows = media.decode_media(media.encode_media(odd), tensors=True).collect()
    texts = [(r["text"] or "").encode() for r in odd.collect()]
    padded = [t + bytes(-len(t) % 64 if t else 64) for t in texts]
    want = Counter((zlib.crc32(b[-64:]), len(b)) for b in padded)
    assert Counter((r["tail_crc32"], r["payload_bytes"]) for r in rows) == want
    assert all(len(r["rgb"]) == r["height"] * r["width"] * 3 for r in rows)
    assert media.decode_media(media.encode_media(none)).count() == 0


def test_media_reads_runs_and_new_coefficients():
    """Zero runs, ends of band and coefficients that a refinement adds, without restart markers."""
    table = ([0, 0, 0, 8] + [0] * 12, [0x00, 0x01, 0x02, 0x11, 0x21, 0xF0, 0x10, 0x31])
    code = {s: f"{c:0{w}b}" for s, (c, w) in media._codes(table).items()}

    def scan(bits):
        bits += "1" * (-len(bits) % 8)
        raw = np.packbits(np.array(list(map(int, bits)), np.uint8))
        return np.r_[raw, np.zeros(8, np.uint8)], np.array([0]), np.array([len(raw)])

    coefs = np.zeros((2, 64), np.int16)
    blocks, counts, look = np.array([0, 1]), np.array([2]), media._lookup(table)
    # block 0: +2 at 1, two zeros, -2 at 4, end; block 1: end
    first = code[0x01] + "1" + code[0x21] + "0" + code[0x10] + "0"
    media._ac_first(media.Bits(*scan(first)), blocks, counts, look, coefs, (1, 63), (0, 1))
    assert coefs[0, 1] == 2 and coefs[0, 4] == -2 and not coefs[1].any()
    # block 0: correct 1 by 1, a new -1 at 3 after one zero, correct 4 by 0, end; block 1: +1 at 1, end
    second = code[0x11] + "0" + "1" + code[0x00] + "0" + code[0x01] + "1" + code[0x00]
    media._ac_refine(media.Bits(*scan(second)), blocks, counts, look, coefs, (1, 63), (1, 0))
    assert coefs[0, :6].tolist() == [0, 3, 0, -1, -2, 0] and coefs[1, :3].tolist() == [0, 1, 0]


def test_suffix_dedup_equals_brute_force(spark, odd, none):
    r = random.Random(9)
    shared = "".join(r.choice("abcd ") for _ in range(900))
    texts = [shared[a : a + n] + "".join(r.choice("efgh") for _ in range(60)) for a, n in ((0, 300), (50, 500), (200, 250), (0, 900))]
    near = [shared[:k] + "#" + shared[k + 1 :] for k in (100, 333, 700)]
    texts += near + ["xy" * 300, None, "é" * 200 + shared[:150]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raw = [(t or "").encode() for t in texts]
    got = {x["doc_id"]: bytes(x["kept"]) for x in suffix.remove_repeats(docs, 130).collect()}
    for n, gone in enumerate(brute_repeats(raw, 130)):
        assert got[n] == bytes(b for b, g in zip(raw[n], gone) if not g)
    assert suffix.remove_repeats(odd).count() == odd.count()
    assert {bytes(x["kept"]) for x in suffix.remove_repeats(odd).where("doc_id in (4, 5)").collect()} == {b""}
    assert suffix.remove_repeats(none).count() == 0


def test_loser_tree_merges_and_knows_prefixes():
    r = random.Random(3)
    runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randrange(9))) for _ in range(20)) for _ in range(5)]
    coded = [suffix.front_coded([(s, b"", 0, 1, b"") for s in run]) for run in runs]
    out = list(suffix.LoserTree([suffix.decoded(b) for b in coded]))
    assert [s for _, s, _ in out] == sorted(s for run in runs for s in run)
    assert all(p == suffix.common_prefix(a[1], b, 0) for a, (p, b, _) in zip(out, out[1:]))


def test_relative_dedup_of_odd_texts(odd, none):
    rows = relative.remove_repeats(odd).collect()
    got = {(r["doc_id"], r["n_removed"]) for r in rows}
    assert (4, 0) in got and (5, 90) in got and (6, 90) in got and (8, 0) in got
    assert relative.remove_repeats(none).count() == 0


def test_top_k_equals_brute_force_with_ties_and_bad_vectors(spark):
    r = np.random.default_rng(1)
    data = np.round(r.normal(size=(300, 6)), 1)
    data[7] = data[8]
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(900, None), (901, [1.0, None] * 3), (902, [float("nan")] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(vectors, vectors.where("vec_id % 20 = 0"), 9, block=70)
    whole = np.floor(64 * data).astype(int)
    want = set()
    for q in range(0, 300, 20):
        best = sorted((-int(whole[q] @ whole[i]), i) for i in range(300) if i != q)[:9]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    assert {tuple(x) for x in got.collect()} == want
    assert topk.search(vectors.where("false"), vectors, 3).count() == 0


def test_language_on_held_out_documents(spark, odd, none):
    found = QUERIES["op9_language"](spark, "/root/testdata/sf0.01").where("held_out")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = found.join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    rows = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, odd).collect()}
    assert rows[0] == rows[1] == rows[2] == "und" and rows[7] == "en"
    assert langid.identify(odd, none).where("lang_pred <> 'und'").count() == 0


def test_toxicity_on_held_out_documents(spark, odd, none):
    sf = "/root/testdata/sf0.1"
    found = QUERIES["op10_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = Counter((r["toxic"], r["predicted"]) for r in found.select("toxic", "predicted").collect())
    assert rows[1, 1] > 0.9 * (rows[1, 0] + rows[1, 1]) and rows[0, 1] < 0.02 * (rows[0, 0] + rows[0, 1])
    index = toxicity.learn(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.with_scores(odd, index).where("toxic_score > 0").count() == 0
    assert toxicity.with_scores(none, index).count() == 0


def test_nearest_examples_equal_a_dense_brute_force_from_texts(spark, monkeypatch):
    """Neighbours and cosines from the texts alone: own words, weights and ranking, over several blocks and batches."""
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    monkeypatch.setattr(toxicity, "BATCH", 7)
    monkeypatch.setattr(toxicity, "POSTINGS", 40)
    monkeypatch.setattr(toxicity, "WEIGHED", 9)
    r = random.Random(4)
    vocabulary = [f"Wort{n}" for n in range(60)]

    def text():
        return " ".join(r.choice(["", "(", "'"]) + vocabulary[min(int(r.expovariate(0.12)), 59)] + r.choice(["", ",", "!"]) for _ in range(r.randrange(0, 14)))

    texts = [text() for _ in range(260)] + ["", None, "fremd", "wort1 WORT1 wort2"]
    texts += texts[:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = {n: int(n % 3 == 0) for n in range(0, 200)}
    state = toxicity.learn(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    bags = [Counter(w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in (t or "").lower().split()) if w) for t in texts]
    df = Counter(w for bag in bags for w in bag)
    known = {w for n in labels for w in bags[n]}

    def unit(bag):
        out = {w: (1 + np.log(c)) * (np.log((len(texts) + 1) / (df[w] + 1)) + 1e-3) for w, c in bag.items() if w in known}
        size = sum(v * v for v in out.values()) ** 0.5
        return {w: v / size for w, v in out.items()}

    units = [unit(bag) for bag in bags]
    for row in toxicity.with_scores(docs, state).collect():
        own = units[row["doc_id"]]
        near = sorted(((-round(sum(v * units[n].get(w, 0) for w, v in own.items()), 9), n) for n in labels))
        near = [(n, -s) for s, n in near if s < 0][: toxicity.NEIGHBOURS]
        assert row["evidence_id"] == [n for n, _ in near]
        assert np.allclose(row["evidence_similarity"], [s for _, s in near], atol=2e-6)


def test_stages_take_clashing_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = (
        "text_key kept n_removed n_spans _spans _key _bytes given spans bytes key target source_size _size _s _given _whole "
        "toxic toxic_score evidence_id row _id _text fp component_id _c _p"
    ).split()
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), f"clash_{name}")
        assert docs.columns[-len(names):] == names and docs.count() > 0
        assert docs.where(" OR ".join(f"`{c}` <> 'own {c}' OR `{c}` IS NULL" for c in names)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_toxicity_and_stages_replace_or_keep_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(n, "vile slur" if n % 2 else f"kind word {n}", "a", 1, 0.5, "z") for n in range(40)],
        "doc_id long, text string, row string, toxic int, toxic_score double, evidence_id string",
    )
    labels = spark.createDataFrame([(n, n % 2) for n in range(30)], "doc_id long, toxic int")
    state = toxicity.learn(docs, labels)
    got = toxicity.with_scores(docs, state)
    assert sorted(got.columns) == sorted(["doc_id", "text", "row", *toxicity.ADDED])
    assert all(r["toxic"] == r["doc_id"] % 2 and r["row"] == "a" for r in got.collect())
    kept = toxicity.scored(docs, state).where("toxic = 0").select("row.*")
    assert kept.columns == docs.columns and kept.count() == 20


def test_pipeline_runs_and_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), f"test_{name}")
        assert docs.columns == columns and docs.count() > 0
    kept = {r[0] for r in docs.select("doc_id").distinct().collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == kept
    assert common.merged([(3, 5), (1, 3), (8, 9)]) == [(1, 5), (8, 9)]


def test_toxicity_finds_copies_in_rare_words(spark):
    """One toxic example without any selected term, its copy, and texts that share a word only."""
    rare = "quolm brindlex zofty marwick pelg " * 3
    rows = [(n, "plain talk of " + " ".join(words(n, 12))) for n in range(60)]
    rows += [(n, "vile slur here " + " ".join(words(n, 12))) for n in range(60, 90)]
    rows += [(90, rare), (91, rare), (92, rare.replace("zofty", "other")), (93, "brindlex"), (94, "unseen entirely")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(n, int(n >= 60)) for n in range(91)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.with_scores(docs, toxicity.learn(docs, labels)).collect()}
    for n, least in ((91, 0.999999), (92, 0.6), (93, 0.1)):
        assert got[n]["evidence_id"][0] == 90 and got[n]["evidence_similarity"][0] >= least
    assert got[91]["toxic"] == got[92]["toxic"] == 1
    assert got[94]["evidence_id"] == []


def test_relative_dedup_spreads_a_hot_passage(spark, monkeypatch):
    """A passage of every second text: no block takes it all, and all copies but the first go."""
    passage = " ".join(words(77, 40))
    texts = [" ".join(words(1000 + n, 15)) + (" " + passage if n % 2 else "") for n in range(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(relative, "BLOCK_PHRASES", 100)
    monkeypatch.setattr(relative, "HOT", 50)
    blocks = relative.dealt_phrases(docs).groupBy("block").count().toPandas()
    assert blocks["count"].sum() > 3000 and blocks["count"].max() < 500
    got = {r["doc_id"]: r["n_removed"] for r in relative.remove_repeats(docs).collect()}
    seen = set()
    for n, t in enumerate(texts):
        own = t.split()
        grams = [tuple(own[i : i + 13]) for i in range(len(own) - 12)]
        assert got[n] == len({i + j for i, g in enumerate(grams) if g in seen for j in range(13)})
        seen.update(grams)


def test_encoder_gives_a_fresh_tokenizers_ids_for_added_tokens():
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokenizer_path())
    texts = ["hello <|endoftext|> x", "<|endoftext|>", "a b<|endoftext|>c d", "plain words here", "no <|endof text|> here"]
    ids, counts = packing.Encoder(tokenizer_path()).encode(texts)
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert fresh.encode(text, add_special_tokens=False).ids == own.tolist()
    assert 50256 in ids


def test_top_k_keeps_wide_vectors_and_all_lengths(spark):
    r = random.Random(2)
    data = {n: [r.uniform(-2, 2) for _ in range(r.choice((3, 4, 5)))] for n in range(120)}
    data |= {20: [2.0**21, -3.5, 1.0], 21: [-(2.0**30) - 0.25, 2.0, 0.0, 1.0], 22: [1e300, 1.0, 2.0], 40: [-1e200, 0.5], 23: [], 60: [], 80: [0.0] * 4}
    vectors = spark.createDataFrame(list(data.items()), "vec_id long, embedding array<double>")
    whole = {n: [int(Fraction(c) * 64 // 1) for c in v] for n, v in data.items()}
    want = set()
    for q in range(0, 120, 20):
        scores = {n: sum(a * b for a, b in zip(whole[q], v)) if whole[q] and v else None for n, v in whole.items() if n != q}
        best = sorted(scores, key=lambda n: (scores[n] is None, -(scores[n] or 0), n))
        want |= {(q, rank, n, scores[n] if scores[n] is not None and abs(scores[n]) < 2**63 else None) for rank, n in enumerate(best, 1)}
    assert {tuple(x) for x in topk.search(vectors, vectors.where("vec_id % 20 = 0"), 200, block=30).collect()} == want
    got = {tuple(x) for x in topk.search(vectors, vectors.where("vec_id % 20 = 0"), 7, block=30).collect()}
    assert got == {w for w in want if w[1] <= 7}


def test_license_scan_finds_headers_and_grants_with_changed_words(spark):
    texts = {
        "apache-2.0-header": 'x Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "strict compliance with the License. You may obtain a copy of the License at y",
        "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this notice appear in all copies.",
        "agpl-header": "Foo is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "mit-grant": "a " + license.TEMPLATES["mit-grant"].replace("without restriction,", "without any restriction,") + " b",
        "bsd-conditions": license.TEMPLATES["bsd-conditions"].replace("1. ", "* ").replace("2. ", "* "),
    }
    docs = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    found = {(r["doc_id"], r["template"]) for r in license.scan(docs).collect()}
    assert {(n, t) for n, t in enumerate(texts)} <= found


def test_media_round_trip_of_whole_payloads(odd):
    rows = media.decode_media(media.encode_media(odd)).collect()
    texts = [(r["text"] or "").encode() for r in odd.collect()]
    want = Counter(hashlib.sha256(t + bytes(-len(t) % 64 if t else 64)).hexdigest() for t in texts)
    assert Counter(r["payload_sha256"] for r in rows) == want


def test_media_features_come_from_stored_tensors(spark, odd, sf_dir, monkeypatch):
    """The query writes RGB tensors and reads them back; features equal those of the decoder."""
    written = []
    real = media.materialize
    monkeypatch.setattr(media, "materialize", lambda df, name, **how: written.append((name, real(df, name, **how))) or written[-1][1])
    stored = media.store_tensors(media.store_media(odd))
    assert [name for name, _ in written] == ["media", "tensors"]
    for row in stored.collect():
        assert len(row["rgb"]) == row["height"] * row["width"] * 3
    direct = media.decode_media(media.encode_media(odd))
    found = media.with_features(stored)
    assert found.columns == direct.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, direct.collect()))
    # a stored tensor that differs changes the feature
    black = stored.withColumn("rgb", F.unhex(F.repeat(F.lit("00"), F.length("rgb"))))
    assert all(r["feature"].split(",")[2:5] == ["0", "0", "0"] for r in media.with_features(black).collect())
    written.clear()
    assert QUERIES["op5_media"](spark, sf_dir).count() and [name for name, _ in written] == ["media", "tensors"]


def test_cut_goes_part_by_part(spark, monkeypatch):
    """Rows are cut in parts of bounded bytes, in place and with the same results."""
    r = random.Random(4)
    same = "".join(r.choice("abcdef ") for _ in range(500))
    texts = [same + "x" * n for n in range(3)] + ["plain", None, same]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = sorted(map(tuple, suffix.remove_repeats(docs).collect()))
    monkeypatch.setattr(suffix, "PART_BYTES", 10)
    assert sorted(map(tuple, suffix.remove_repeats(docs).collect())) == whole
    assert [row[2] for row in whole] == [500, 501, 501, 0, 0, 500]  # an x after the passage repeats too


def test_toxicity_words_are_those_of_python():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [a + "Σ." + a for a in every] + [None, "", "ΟΔΥΣΣΕΥΣ (İ) _x_ «Ä» a-b ..."]
    assert toxicity.lowered(pa.array(texts)).to_pylist() == [(t or "").lower() for t in texts]
    signs = [a + "-x" + b + "_" for a, b in zip(every, reversed(every))]
    assert [toxicity.without_signs(w) for w in signs] == [toxicity.EDGE.sub("", w) for w in signs]
    assert toxicity.distinct(np.array([3, 0, 3, 1, 0])).tolist() == [0, 1, 3] and not len(toxicity.distinct(np.zeros(0, np.int64)))


def test_toxicity_lists_hold_rare_words_only():
    rng = np.random.default_rng(5)
    texts = [" ".join(["the", "all"] * int(rng.integers(0, 2)) + [f"w{n}" for n in rng.integers(0, 400, 30)]) for _ in range(300)]
    words = pa.array(sorted({w for t in texts for w in t.split()}))
    known = {"terms": [], "words": words, "idf": rng.random(len(words)) + 0.1}
    ends, feature, number, hits = toxicity.Terms([], words).counts(texts)
    state = toxicity.arranged(known, np.arange(300), rng.integers(0, 2, 300).astype(float), hits, ends, feature, number)
    index = toxicity.Index(state)
    sizes = np.bincount(feature, minlength=len(words))
    common = sizes > 300 * toxicity.COMMON
    assert common.any() and len(index.places.flat) == sizes[~common].sum()
    vectors = np.zeros((300, len(words)))
    vectors[np.repeat(np.arange(300), np.diff(index.ends)), index.feature] = index.weight
    index.forget()
    assert not hasattr(index, "weight")
    asked = texts[:70] + ["the", "w1 the", "none"]
    ends, feature, number, _ = index.terms.counts(asked)
    weight = index.weighted(ends, feature, number)
    for t, (places, scores) in enumerate(index.best(ends, feature, weight)):
        whole = vectors[:, feature[ends[t] : ends[t + 1]]] @ weight[ends[t] : ends[t + 1]]
        near = [n for n in np.lexsort((index.ids, -np.round(whole, 9))) if whole[n] > 0][: toxicity.NEIGHBOURS]
        assert places.tolist() == near and np.allclose(scores, whole[near], atol=1e-12)


def test_toxicity_cells_travel_compressed(spark):
    """What is long in a learned state goes through the driver and into the tasks compressed, and comes back as it was."""
    rng = np.random.default_rng(6)
    for values in ([], [7], [300, 0, 300, 5], rng.integers(0, 1 << 31, 5_000), rng.integers(1, 4, 5_000)):
        values = np.array(values, np.int32)
        assert toxicity.opened(toxicity.closed(values)).tolist() == values.tolist()
    assert len(toxicity.closed(rng.integers(1, 4, 5_000).astype(np.int32))) < 2_500
    texts = [(n, " ".join(f"w{x}" for x in rng.integers(0, 90, 40))) for n in range(60)]
    labels = spark.createDataFrame([(n, n % 2) for n in range(60)], "doc_id long, toxic int")
    state = toxicity.learn(spark.createDataFrame(texts, "doc_id long, text string"), labels)
    assert all(type(state[n]) is bytes for n in toxicity.CELLS)
    index = toxicity.Index(state)
    words = state["words"].to_pylist()
    for n, low, high in zip(index.ids.tolist(), index.ends[:-1], index.ends[1:]):
        found = {words[f]: c for f, c in zip(index.feature[low:high].tolist(), index.number[low:high].tolist())}
        own = texts[n][1].split()
        assert found == {w: own.count(w) for w in own}


def test_toxicity_index_holds_no_weights_twice(spark):
    """An index keeps rare words as postings and common ones by example; a part's results leave before the next is read."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in np.minimum(rng.geometric(0.02, 50), 300)) for _ in range(400)]
    words = pa.array(sorted({w for t in texts for w in t.split()}))
    known = {"terms": [], "words": words, "idf": rng.random(len(words)) + 0.1}
    ends, feature, number, hits = toxicity.Terms([], words).counts(texts)
    state = toxicity.arranged(known, np.arange(400), rng.integers(0, 2, 400).astype(float), hits, ends, feature, number)
    index = toxicity.Index(state)
    whole, exact = index.weight, index.near.astype(float)
    row = np.repeat(np.arange(len(index.near)), np.diff(index.rest_ends))
    exact[row, index.rest_column] += index.rest
    held = index.column[index.feature] >= 0
    example = np.repeat(np.arange(400), np.diff(index.ends))
    assert 0 < held.sum() == len(index.rest) < len(held)
    assert np.allclose(exact[example[held], index.column[index.feature[held]]], whole[held], rtol=1e-13, atol=0)
    assert sorted(index.values.flat.tolist()) == sorted(whole[~held].tolist())
    assert not isinstance(index.terms.__dict__.get("number"), dict)
