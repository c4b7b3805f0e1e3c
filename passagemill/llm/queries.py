"""The operators as registered queries over the given tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm import (
    langid, license, media, mixing, packing, prefixtrie, quality, relative, simhash, suffix, topk, toxicity, whitening,
)
from passagemill.llm.common import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.with_features(media.store_tensors(media.store_media(table(spark, sf_dir, "documents"))))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return found.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relative.remove_repeats(table(spark, sf_dir, "documents"))
    return found.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train = docs.where(~langid.held_out(F.col("doc_id")))
    found = langid.identify(docs, train)
    return found.withColumn("held_out", langid.held_out(F.col("doc_id")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    found = toxicity.with_scores(docs, toxicity.learn(docs, labels))
    return found.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"),
        F.col("toxic").alias("predicted"), "evidence_id", "evidence_similarity",
    )


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id")))
    found = quality.with_quality(docs, quality.learn(docs, labels))
    return found.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"),
        F.col("quality").alias("predicted"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_license_scan, op3_simhash, op4_mixing, op5_media, op6_suffix_dedup, op7_topk,
        op8_substring_dedup, op9_language, op10_toxicity, op11_quality,
        op12_whitening, op13_prefix_trie, pipeline,
    )
}
ORACLE = {
    "op7_topk": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op8_substring_dedup": r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), g AS (
    SELECT doc_id, i, array_to_string(list_slice(words, i, i + 12), ' ') AS gram
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 11, 1))) AS i FROM w)
), f AS (
    SELECT gram, min(doc_id) AS least FROM g GROUP BY gram
), hit AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM g JOIN f USING (gram) WHERE least < doc_id
), gone AS (
    SELECT doc_id, list(j) AS js, count(*) AS n FROM hit GROUP BY doc_id
)
SELECT w.doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(array_to_string(
           list_filter(words, lambda x, k: NOT list_contains(coalesce(js, []), k)), ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
""",
    "op6_suffix_dedup": r"""
WITH d AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), s AS (
    SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS m
    FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 399, 0))) AS i FROM d)
), r AS (
    SELECT m FROM s GROUP BY m HAVING count(*) > 1
), hit AS (
    SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM s JOIN r USING (m)
), spans AS (
    SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM hit GROUP BY doc_id, island
), marked AS (
    SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans
), numbered AS (
    SELECT *, sum(CASE WHEN reach >= a THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY a) AS run FROM marked
), runs AS (
    SELECT doc_id, run, min(a) AS a, max(b) AS b FROM numbered GROUP BY doc_id, run
), gaps AS (
    SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS kept_from FROM runs
), kept AS (
    SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS tail,
           string_agg(substr(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) AS parts
    FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(parts, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op13_prefix_trie": r"""
WITH turns AS (
    SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT c, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda k: ascii(substr(c::VARCHAR, k, 1))::BIGINT)),
        lambda crc, byte: list_reduce(
            list_prepend(xor(crc, byte), range(8)),
            lambda v, bit: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END
        )
    )) % 6 AS h
    FROM (SELECT DISTINCT c FROM turns)
), rebuilt AS (
    SELECT convs.c, i, r, x FROM convs JOIN turns ON turns.c = convs.c - convs.c % 100 AND i <= h
    UNION ALL
    SELECT c, i, r, x FROM turns JOIN convs USING (c) WHERE i > h
), placed AS (
    SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, length(x) AS size, md5(length(r) || ':' || r || x) AS m FROM rebuilt
), steps AS (
    SELECT c, d, size, md5(string_agg(m, '') OVER (PARTITION BY c ORDER BY d)) AS node FROM placed
    UNION ALL
    SELECT c, 0, 0, '' FROM convs
), path AS (
    SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS parent FROM steps
), nodes AS (
    SELECT node, any_value(d) AS d, any_value(size) AS size, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n FROM path GROUP BY node
), kids AS (
    SELECT parent AS node, count(*) AS kids FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), ends AS (
    SELECT node, string_agg(c::VARCHAR, ',' ORDER BY c) AS members FROM (SELECT c, arg_max(node, d) AS node FROM path GROUP BY c) GROUP BY node
), below AS (
    SELECT a.node, sum((m.n - 1) * m.size) AS saved, sum(CASE WHEN kids IS NULL THEN 1 ELSE 0 END) AS leaves
    FROM nodes m JOIN path a ON a.c = m.conv_id AND a.d <= m.d LEFT JOIN kids ON kids.node = m.node GROUP BY a.node
)
SELECT nodes.conv_id, nodes.d::BIGINT AS depth, above.conv_id AS parent_conv_id, nodes.n AS n_convs, coalesce(kids, 0) AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(members, '')) AS ends_sha256
FROM nodes JOIN below USING (node) LEFT JOIN kids USING (node) LEFT JOIN ends USING (node) LEFT JOIN nodes above ON above.node = nodes.parent
""",
    "op2_license_scan": None,
}


def _license_sql() -> str:
    """Containment of every template in every window, from the operator's parameters."""
    values = ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in license.TEMPLATES.items())
    return rf"""
WITH t0(template, body) AS (VALUES {values}),
t AS (SELECT template, regexp_extract_all(lower(body), '[^\x20\x09-\x0D]+') AS tw FROM t0),
ts AS (SELECT template, len(tw) AS n, list_distinct(list_transform(range(1, len(tw) - 3), lambda i: array_to_string(list_slice(tw, i, i + 4), ' '))) AS ss FROM t),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d)),
p AS (SELECT template, n, len(ss) AS size, unnest(ss) AS s FROM ts),
hit AS (SELECT DISTINCT doc_id, template, n, size, i, s FROM g JOIN p USING (s)),
wins AS (
    SELECT doc_id, template, n, size, s, unnest([(i - 1) // n - 1, (i - 1) // n]) AS k, i FROM hit
),
inside AS (SELECT DISTINCT doc_id, template, n, size, k, s FROM wins WHERE k >= 0 AND i >= k * n + 1 AND i + 4 <= k * n + 2 * n),
share AS (SELECT doc_id, template, n, k, count(*) / size AS c FROM inside GROUP BY doc_id, template, n, k, size)
SELECT doc_id, template, count(*) AS windows, min(k) * min(n) AS first_word, max(c) AS containment
FROM share WHERE c >= 0.8 GROUP BY doc_id, template
"""


ORACLE["op2_license_scan"] = _license_sql()
