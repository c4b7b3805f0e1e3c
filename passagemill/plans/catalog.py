"""Registered queries: every operator and job over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from passagemill import values as V
from passagemill.functions import html as H
from passagemill.functions import ids
from passagemill.functions import predicates as P
from passagemill.functions import text as X
from passagemill.functions.vectors import l2_norm, normalize
from passagemill.operators import answers as A
from passagemill.operators import dedup, evaluation, feedback, filters, search, stats
from passagemill.operators import rerank as second_stage
from passagemill.operators.chunking import chunk_documents
from passagemill.operators.encoding import hash_encoder, signed_encoder
from passagemill.plans import ask
from passagemill.plans import fixtures as D
from passagemill.plans import ingest as I
from passagemill.session import materialize, scratch_path, spread
from passagemill.sources import corpus, jsonl
from passagemill.sources import schema as S
from passagemill.sources.snapshots import Store
from passagemill.streaming import messages as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


# Positions and counts are BIGINT in every registered result.
POSITIONS = ("part", "rank", "bullet", "k_max", "n", "hit_rank")


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = fn(spark, sf)
        wide = {c: F.col(c).cast("bigint") for c, t in df.dtypes if c in POSITIONS and t == "int"}
        return df.withColumns(wide) if wide else df

    QUERIES[fn.__name__] = run
    return run


def _documents(spark, sf) -> DataFrame:
    return spread(D.table(spark, sf, "documents"))


def _pages(spark, sf) -> DataFrame:
    return spread(D.table(spark, sf, "pages"))


def _numbers(c):
    return F.array_join(F.transform(c, lambda n: n.cast("string")), ",")


# --- Text and identity ------------------------------------------------------

@query
def normalize_ws(spark, sf):
    return _documents(spark, sf).select("doc_id", X.normalize_ws(F.col("text")).alias("text"))


@query
def flatten_text(spark, sf):
    return _documents(spark, sf).select("doc_id", X.flatten(F.col("text")).alias("text"))


@query
def snip(spark, sf):
    return _documents(spark, sf).select("doc_id", X.snip(F.col("text")).alias("text"))


@query
def short_summary(spark, sf):
    return _documents(spark, sf).select(
        "doc_id",
        X.short_summary(F.col("text"), 2).alias("two"),
        X.short_summary(F.col("text"), 1).alias("one"),
    )


@query
def query_keywords(spark, sf):
    b = D.table(spark, sf, "benchmark")
    return b.select("item_id", F.explode(X.keywords(F.col("text"))).alias("keyword"))


@query
def query_keywords_ordered(spark, sf):
    kws = X.keywords(F.col("text"), cap=V.MAX_ORDERED_KEYWORDS)
    return D.table(spark, sf, "benchmark").select("item_id", F.array_join(kws, " ").alias("keywords"))


@query
def doc_ids(spark, sf):
    d = D.docs(spark, sf).withColumn("_text", X.normalize_ws(F.col("raw_text")))
    return d.select(
        "row_id",
        ids.content_hash(F.col("_text")).alias("content_hash"),
        ids.doc_id(F.col("source_type"), F.col("url"), F.col("title"), F.col("_text")).alias("doc_id"),
    )


@query
def highlight(spark, sf):
    """Every conversation turn with the keywords of its conversation's first turn marked."""
    c = D.table(spark, sf, "conversations")
    first = c.where(F.col("turn") == 0).select("conv_id", F.col("text").alias("_query"))
    kws = X.keywords(F.col("_query"), cap=V.MAX_ORDERED_KEYWORDS)
    return c.join(first, "conv_id", "left").select(
        "conv_id", "turn", X.highlight(F.col("text"), kws).alias("text")
    )


@query
def channel_handle(spark, sf):
    m = D.messages(spark, sf)
    lines = F.concat("channel", F.lit("\n \n@extra/\r\n"), F.col("msg_id").cast("string"))
    return m.select(
        "msg_id", F.explode(X.channel_list(lines)).alias("line")
    ).select(
        "msg_id", "line", X.channel_handle(F.col("line")).alias("handle"),
        X.safe_int(F.col("line")).alias("number"),
    )


@query
def mask_secret(spark, sf):
    """Words of all documents as if they were secrets, masked and counted."""
    word = _documents(spark, sf).select(F.explode(X.words(F.col("text"), 1)).alias("word"))
    return word.groupBy(X.mask_secret(F.col("word")).alias("masked")).agg(F.count("*").alias("n"))


@query
def redact_logs(spark, sf):
    return _documents(spark, sf).select(
        "doc_id", X.redact(F.col("text")).alias("text"),
        (X.redact(F.col("text")) != F.col("text")).alias("changed"),
    )


@query
def ensure_sources(spark, sf):
    done = D.completed(spark, sf)
    return done.select(
        "query_id",
        X.ensure_sources(F.col("answer"), X.citations(F.col("answer"), F.lit(6))).alias("answer"),
    )


@query
def parse_citations(spark, sf):
    c = D.table(spark, sf, "conversations")
    text = F.concat(
        "text", F.lit(" ["), F.pmod("turn", F.lit(9)).cast("string"), F.lit("] [0"),
        F.pmod("conv_id", F.lit(9)).cast("string"), F.lit("] [333]"),
    )
    return c.select("conv_id", "turn", _numbers(X.citations(text, F.lit(6))).alias("used"))


# --- Pages ------------------------------------------------------------------

@query
def page_titles(spark, sf):
    return _pages(spark, sf).select("page_id", H.page_title(F.col("html"), F.col("url")).alias("title"))


@query
def page_text(spark, sf):
    return _pages(spark, sf).select("page_id", H.visible_text(F.col("html")).alias("text"))


@query
def page_main_text(spark, sf):
    return _pages(spark, sf).select("page_id", H.main_text(F.col("html")).alias("text"))


@query
def clean_lines(spark, sf):
    return _documents(spark, sf).select("doc_id", H.clean_lines(F.col("text")).alias("text"))


# --- Filters ----------------------------------------------------------------

@query
def keyword_filter(spark, sf):
    """Documents whose text or label has a keyword of a turn of the conversation with the
    same number, each turn asked for itself; documents without such a conversation stay."""
    turns = D.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("row_id"), "turn", X.keywords(F.col("text")).alias("_kws")
    )
    d = D.docs(spark, sf).join(turns, "row_id", "left")
    kws = F.coalesce("_kws", F.array().cast("array<string>"))
    return d.where(
        P.matches_keywords(F.col("raw_text"), F.col("title"), F.col("url"), kws)
    ).select("row_id", "turn")


@query
def noise_filter(spark, sf):
    return D.chunks(spark, sf).where(~P.is_noise(F.col("text"))).select("chunk_id", "part")


@query
def page_relevance(spark, sf):
    text = H.with_page_text(_pages(spark, sf)).withColumn("text", H.clean_lines(F.col("text")))
    return text.select(
        "page_id", P.is_relevant(F.col("text"), D.GOOD_MARKERS, D.BAD_MARKERS).alias("relevant")
    )


@query
def filter_results(spark, sf):
    found = _search(spark, sf)
    return filters.filter_results(found, types={"web", "Portal"}).select("query_id", "rank", "chunk_id")


@query
def filter_scope(spark, sf):
    """Results of two types within the labelled documents; a question may lose all results."""
    found = _search(spark, sf)
    scope = dedup.known_values(D.labelled_chunks(spark, sf))
    return filters.filter_results(found, {"web", "local"}, scope).select("query_id", "rank", "chunk_id")


@query
def filter_fallback(spark, sf):
    """Web documents where a question found any, then the labelled ones where any of these is."""
    found = _search(spark, sf)
    scope = dedup.known_values(D.labelled_chunks(spark, sf))
    return filters.filter_fallback(found, {"web"}, scope, True).select("query_id", "rank", "chunk_id")


# --- Corpus -----------------------------------------------------------------

@query
def chunk_docs(spark, sf):
    return D.chunks(spark, sf).select(
        "chunk_id", "part", "text", "title", "source_type", "url", "date",
        F.col("extra")["doc_id"].alias("doc_id"), F.col("extra")["source_type"].alias("extra_type"),
        F.col("extra")["file_name"].alias("file_name"),
    )


@query
def dedup_chunks(spark, sf):
    new = dedup.only_new(
        D.chunks(spark, sf, by_content=True), D.known_corpus(spark, sf),
        "chunk_id", [F.asc("row_id"), F.asc("part")], D.KNOWN_BUCKETS,
    )
    return new.select("chunk_id", "row_id", "part")


@query
def dedup_messages(spark, sf):
    m = D.messages(spark, sf).withColumn("channel", X.channel_handle(F.col("channel")))
    m = m.withColumn("message_key", ids.message_key(F.col("channel"), F.col("msg_id")))
    known = dedup.known_values(D.known_messages(spark, sf), "message_key")
    return dedup.only_new(m, known, "message_key", [F.desc_nulls_last("ts")]).select("message_key")


@query
def known_keys(spark, sf):
    return dedup.known_entries(D.chunks(spark, sf), ("doc_id", "file_name", "saved_as"))


@query
def stats_by_type(spark, sf):
    lines = D.corpus_lines(spark, sf)
    return stats.type_stats(lines)


@query
def stats_by_date(spark, sf):
    return stats.corpus_stats(D.chunks(spark, sf), "date")


@query
def doc_labels(spark, sf):
    return stats.doc_labels(D.chunks(spark, sf))


@query
def jsonl_scan(spark, sf):
    """Write all corpus lines, good and bad, and read the objects back."""
    path = scratch_path(spark, "lines")
    D.corpus_lines(spark, sf).write.text(path)
    rows = jsonl.read_objects(spark, path, S.CHUNK)
    return rows.select("chunk_id", "source_type", F.length("text").cast("bigint").alias("chars"))


@query
def chunk_scan_strict(spark, sf):
    rows = jsonl.parse_chunks(D.corpus_lines(spark, sf))
    return rows.select("chunk_id", "source_type", F.size("extra").cast("bigint").alias("n_extra"))


@query
def log_tail(spark, sf):
    last = jsonl.tail(D.labelled(spark, sf), [F.desc("ts"), F.desc("doc_id")], 50)
    return last.select("doc_id", "ts", "query", "verdict")


@query
def value_scan(spark, sf):
    """Every line that holds one JSON value, whatever its kind."""
    path = scratch_path(spark, "lines")
    D.corpus_lines(spark, sf).write.text(path)
    rows = jsonl.parse_values(jsonl.read_lines(spark, path))
    kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)

    def held(at: str):
        return F.try_variant_get("value", at, "string")

    plain = F.from_json("json", "chunk_id string")["chunk_id"]
    return rows.select(F.coalesce(held("$.chunk_id"), held("$[0].chunk_id"), plain).alias("chunk_id"), kind.alias("kind"))


@query
def overwrite_chunks(spark, sf):
    """A table of chunk lines replaced by one without a source, read back strictly."""
    path = scratch_path(spark, "table")
    chunks = D.chunks(spark, sf).select(*S.CHUNK_COLUMNS)
    jsonl.overwrite_objects(chunks, path)
    jsonl.overwrite_objects(chunks.where(F.col("source_type") != "portal"), path)
    rows = jsonl.read_chunks(spark, path)
    return rows.select(
        "chunk_id", F.sha1("text").alias("text_hash"), "title", "source_type", "url", "date",
        F.col("extra")["file_name"].alias("file_name"),
    )


def _shown(v):
    """Components in units of 1/100,000."""
    return F.array_join(F.transform(v, lambda x: F.floor(x.cast("double") * 100000 + 0.5).cast("string")), ",")


@query
def encode_hash(spark, sf):
    encoded = signed_encoder()(D.chunks(spark, sf))
    return encoded.select("chunk_id", _shown("embedding").alias("embedding"))


@query
def build_index(spark, sf):
    """Encode and write every chunk, read the index back and check the vectors."""
    index = corpus.build_index(D.chunks(spark, sf), signed_encoder(), scratch_path(spark, "index"))
    return index.select(
        "chunk_id", F.size("embedding").cast("bigint").alias("dim"),
        F.round(l2_norm(F.col("embedding")), 4).alias("norm"), F.sha1(_shown("embedding")).alias("vector_hash"),
    )


# --- Search -----------------------------------------------------------------

@query
def vector_normalize(spark, sf):
    e = D.table(spark, sf, "embeddings")
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    unit = e.select("vec_id", normalize(scaled).alias("v"))
    return unit.select(
        "vec_id", F.array_join(F.transform("v", lambda x: F.round(x, 5).cast("decimal(9,5)").cast("string")), ",").alias("unit")
    )


@query
def vector_search(spark, sf):
    found = search.search(
        D.vec_queries(spark, sf), D.vec_index(spark, sf), min_score=D.VECTOR_MIN_SCORE,
        chunks=D.vec_chunks(spark, sf),
    )
    return found.select("query_id", "rank", "chunk_id", "score", "title")


@query
def vector_search_blocks(spark, sf):
    """The same search with more questions than go into one pass over the index."""
    found = search.search(
        D.vec_queries(spark, sf), D.vec_index(spark, sf), min_score=D.VECTOR_MIN_SCORE,
        chunks=D.vec_chunks(spark, sf), block_rows=D.BLOCK_QUESTIONS,
    )
    return found.select("query_id", "rank", "chunk_id", "score", "title")


def _search(spark, sf, min_score: float = D.LEXICAL_MIN_SCORE) -> DataFrame:
    return search.search(
        D.queries(spark, sf), D.lexical_index(spark, sf), min_score=min_score, method="lexical"
    )


def _results(spark, sf) -> DataFrame:
    """The first five search results of each question, written once for their consumers."""
    return materialize(search.cut(_search(spark, sf), V.TOP_K), "results")


@query
def lexical_search(spark, sf):
    return _search(spark, sf).select("query_id", "rank", "chunk_id", "score")


@query
def rerank(spark, sf):
    ranked = second_stage.rerank(_search(spark, sf))
    return ranked.select("query_id", "rank", "chunk_id", "score")


@query
def retrieval_debug(spark, sf):
    k = V.internal_k()
    found = materialize(_search(spark, sf), "found")
    kept = filters.filter_fallback(found, {"web"})
    return stats.retrieval_debug(
        D.queries(spark, sf), found, kept, search.cut(kept, V.TOP_K), "index", k,
        D.LEXICAL_MIN_SCORE, True,
    )


# --- Answers ----------------------------------------------------------------

@query
def source_lines(spark, sf):
    return A.source_lines(_search(spark, sf))


@query
def answer_bullets(spark, sf):
    return A.answer_bullets(search.cut(_search(spark, sf), V.TOP_K))


@query
def answer_extractive(spark, sf):
    """Search, lenient type filter, second-stage scoring, answer: one row per question."""
    queries = D.queries(spark, sf)
    best = ask.retrieve(
        queries, D.lexical_index(spark, sf), min_score=D.LEXICAL_MIN_SCORE,
        types={"web", "local"}, scorer=second_stage.keyword_share, method="lexical",
    )
    made = A.extractive_answers(best, queries)
    return made.select(
        "query_id", "markdown", _numbers(F.col("used_sources")).alias("used_sources"),
        F.array_join("warnings", ",").alias("warnings"),
    )


@query
def context_pack(spark, sf):
    return A.pack_context(_search(spark, sf), max_chars=3000)


@query
def prompt_batch(spark, sf):
    return A.prompts(search.cut(_search(spark, sf), V.TOP_K), D.queries(spark, sf), max_chars=3000)


@query
def audit_answers(spark, sf):
    audited = A.audit_answers(
        D.completed(spark, sf), search.cut(_search(spark, sf), V.TOP_K), D.queries(spark, sf)
    )
    return audited.select(
        "query_id", "markdown", _numbers(F.col("used_sources")).alias("used_sources"),
        F.array_join("warnings", ",").alias("warnings"),
    )


@query
def citation_map(spark, sf):
    results = _results(spark, sf)
    return A.citation_map(A.extractive_answers(results, D.queries(spark, sf)), results)


@query
def source_table(spark, sf):
    results = _results(spark, sf)
    made = A.extractive_answers(results, D.queries(spark, sf))
    return A.source_table(results, made, used_only=True)


# --- Ingest -----------------------------------------------------------------

def _page_documents(spark, sf) -> DataFrame:
    """Extracted pages, written once for the corpus of before, the chunks and the log."""
    documents = I.page_documents(
        D.table(spark, sf, "pages"), D.GOOD_MARKERS, D.BAD_MARKERS, as_of=F.lit(D.PAGE_DAY)
    )
    return materialize(documents, "pages")


def _page_chunks(documents: DataFrame) -> DataFrame:
    """New chunks where the English pages had been ingested before."""
    before = chunk_documents(documents.where(F.col("url").contains("/en/")))
    return I.page_chunks(documents, before)


@query
def ingest_pages(spark, sf):
    new = _page_chunks(_page_documents(spark, sf))
    return new.select(
        "chunk_id", "part", "page_id", "text", "title", "url", "date",
        F.col("extra")["doc_id"].alias("doc_id"), F.col("extra")["origin"].alias("origin"),
    )


@query
def ingest_pages_log(spark, sf):
    documents = _page_documents(spark, sf)
    return I.page_log(documents, _page_chunks(documents))


@query
def ingest_pages_report(spark, sf):
    documents = _page_documents(spark, sf)
    return I.page_report(I.page_log(documents, _page_chunks(documents)))


def _ingest_messages(spark, sf):
    return I.ingest_messages(
        D.messages(spark, sf), D.known_messages(spark, sf),
        D.as_of(), D.CHANNEL_CAP, D.SINCE_DAYS,
    )


@query
def ingest_messages(spark, sf):
    new, _ = _ingest_messages(spark, sf)
    return new.select(
        "chunk_id", "part", "text", "title", "url", "date",
        F.col("extra")["message_key"].alias("message_key"), F.col("extra")["views"].alias("views"),
        F.col("extra")["has_media"].alias("has_media"),
    )


@query
def ingest_messages_report(spark, sf):
    new, classified = _ingest_messages(spark, sf)
    return I.message_report(classified, new)


@query
def sync_corpus(spark, sf):
    pages = _page_chunks(_page_documents(spark, sf))
    new, _ = _ingest_messages(spark, sf)
    both = I.union_chunks(pages, new)
    return both.select("chunk_id", "source_type", "url", F.sha1("text").alias("text_hash"))


@query
def sync_summary(spark, sf):
    documents = _page_documents(spark, sf)
    report = I.page_report(I.page_log(documents, _page_chunks(documents)))
    new, classified = _ingest_messages(spark, sf)
    return I.sync_summary(report, I.message_report(classified, new), index_ok=True)


@query
def sync_job(spark, sf):
    """The whole job three times on a store that already has a corpus: once with an
    encoder that fails after the new chunks are written, once to the end, once more."""
    store = Store(spark, scratch_path(spark, "store"))
    before = _page_documents(spark, sf).where(F.col("url").contains("/en/"))
    start = materialize(I.union_chunks(
        I.only_new(chunk_documents(before, keep=("page_id",)), D.no_chunks(spark), "chunk_id", [F.asc("page_id"), F.asc("part")]),
        I.only_new(D.known_messages(spark, sf), D.no_chunks(spark), "chunk_id", [F.asc("chunk_id")]),
    ), "start")
    encoder = hash_encoder()
    state = store.commit(store.latest(), [store.write_part(start, "corpus")], [store.write_part(encoder(start), "index")])

    def failing(df):
        raise RuntimeError("the encoder is out of order")

    def run(name, encode):
        done = I.sync_store(
            D.table(spark, sf, "pages"), D.messages(spark, sf), store, encode, D.GOOD_MARKERS, D.BAD_MARKERS,
            D.as_of(), D.CHANNEL_CAP, D.SINCE_DAYS,
        )
        return done.withColumn("run", F.lit(name)).withColumn("chunks", F.lit(store.corpus().count()))

    try:
        run("broken", failing)
    except RuntimeError:
        if store.latest() != state:
            raise
    return run("first", encoder).unionByName(run("again", encoder))


@query
def stream_messages(spark, sf):
    """Messages arriving as files, drained by the streaming job into a store: first those
    of the users, then, after a restart, all of them."""
    arrivals, store = scratch_path(spark, "arrivals"), Store(spark, scratch_path(spark, "store"))
    progress = scratch_path(spark, "progress")
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in D.MESSAGE_SCHEMA.fields]
    arriving = D.messages(spark, sf).select(*columns)
    store.add([store.write_part(D.known_messages(spark, sf).select(*S.CHUNK_COLUMNS), "corpus")])
    for some in (arriving.where(F.col("channel").startswith("https:")), arriving):
        some.write.mode("append").parquet(arrivals)
        source = stream.message_stream(spark, arrivals, D.MESSAGE_SCHEMA)
        stream.run_message_ingest(source, store, progress, D.as_of(), D.SINCE_DAYS)
    return store.corpus().select(
        "chunk_id", F.col("extra")["message_key"].alias("message_key"), F.sha1("text").alias("text_hash")
    )


# --- Evaluation and feedback ------------------------------------------------

def _eval_rows(spark, sf, cut: bool = True) -> DataFrame:
    return evaluation.eval_rows(D.rules(spark, sf), _search(spark, sf), cut=cut)


@query
def eval_rows(spark, sf):
    return _eval_rows(spark, sf).drop("query")


def _report(spark, sf) -> tuple[str, StructType]:
    """Rows and metrics as a written report, and the schema of its rows."""
    rows, path = materialize(_eval_rows(spark, sf), "eval"), scratch_path(spark, "report")
    evaluation.write_report(rows, evaluation.eval_metrics(rows), path)
    return path, rows.schema


@query
def eval_report_rows(spark, sf):
    """The rows of a written report, read back from CSV."""
    return evaluation.read_report_rows(spark, *_report(spark, sf)).drop("query")


@query
def eval_report_metrics(spark, sf):
    """The metrics of a written report, read back from JSON."""
    path, _ = _report(spark, sf)
    read = spark.read.json(f"{path}/metrics")
    return read.select("n", "recall_at_k", "mrr_at_k", "hit_at_1", "hit_at_3", "hit_at_5", "avg_precision_at_k")


@query
def eval_metrics(spark, sf):
    return evaluation.with_settings(
        evaluation.eval_metrics(_eval_rows(spark, sf)),
        mode="index", min_score=D.LEXICAL_MIN_SCORE, keyword_filter=True,
    )


@query
def eval_metrics_uncut(spark, sf):
    return evaluation.eval_metrics(_eval_rows(spark, sf, cut=False)).drop("avg_precision_at_k")


@query
def eval_hit_ratio(spark, sf):
    return evaluation.hit_ratio(_eval_rows(spark, sf))


@query
def eval_rank_hist(spark, sf):
    return evaluation.rank_histogram(_eval_rows(spark, sf, cut=False))


@query
def eval_score_hist(spark, sf):
    rows = materialize(_eval_rows(spark, sf), "eval")
    return evaluation.score_histogram(rows)


def _counts_of_parts(spark, sf) -> DataFrame:
    """Rules that arrive in two parts: counts of each are written, then merged."""
    rows = _eval_rows(spark, sf)
    odd = F.coalesce(F.xxhash64("query_id") % 2 != 0, F.lit(False))
    rows = materialize(rows, "eval")
    return evaluation.merged_counts(*(
        materialize(evaluation.score_counts(rows.where(part)), "counts") for part in (odd, ~odd)
    ))


@query
def eval_metrics_merged(spark, sf):
    return evaluation.metrics_of(_counts_of_parts(spark, sf))


@query
def eval_score_hist_merged(spark, sf):
    return evaluation.histogram_of(materialize(_counts_of_parts(spark, sf), "counts"))


@query
def feedback_payload(spark, sf):
    """A record per rating; ratings are dealt to the questions in turn."""
    results = materialize(_search(spark, sf), "found")
    made = A.extractive_answers(search.cut(results, V.TOP_K), D.queries(spark, sf))
    rated = D.labelled(spark, sf, with_query=False).withColumn("query_id", F.pmod("doc_id", F.lit(D.RATED_QUESTIONS))).drop("doc_id")
    records = feedback.feedback_records(
        rated, made, results, {"min_score": D.LEXICAL_MIN_SCORE, "keyword_filter": True}
    )
    listed = F.transform(
        "retrieval_sources", lambda s: F.concat(s["rank"].cast("string"), F.lit(":"), s["chunk_id"])
    )
    return records.select(
        "query_id", "ts", "rating", "comment", "answer_snippet",
        _numbers(F.col("used_sources")).alias("used_sources"),
        F.array_join(listed, ",").alias("retrieval_sources"), "min_score", "keyword_filter",
    )


@query
def bad_feedback(spark, sf):
    return feedback.bad_feedback(D.feedback_log(spark, sf)).select("ts", "query", "comment", "rating")


@query
def feedback_counts(spark, sf):
    return feedback.feedback_counts(D.feedback_log(spark, sf))
