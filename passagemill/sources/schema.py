"""Table schemas."""

from pyspark.sql import types as T

_S = T.StringType()

CHUNK = T.StructType([
    T.StructField("chunk_id", _S, False),
    T.StructField("text", _S),
    T.StructField("title", _S),
    T.StructField("source_type", _S),
    T.StructField("url", _S),
    T.StructField("date", _S),
    T.StructField("extra", T.MapType(_S, _S)),
])
CHUNK_COLUMNS = CHUNK.fieldNames()
CHUNK_REQUIRED = ("chunk_id", "text", "title", "source_type")

RULE = T.StructType([
    T.StructField("query", _S),
    T.StructField("must_contain_url", _S),
    T.StructField("must_contain_text", _S),
    T.StructField("must_contain_type", _S),
])

SOURCE_ITEM = T.StructType([
    T.StructField("rank", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("title", _S),
    T.StructField("url", _S),
    T.StructField("source_type", _S),
    T.StructField("date", _S),
    T.StructField("chunk_id", _S),
    T.StructField("doc_id", _S),
])

# Ratings and verdicts share one log; either kind leaves the other's fields null.
FEEDBACK = T.StructType([
    T.StructField("ts", _S),
    T.StructField("query", _S),
    T.StructField("comment", _S),
    T.StructField("rating", T.IntegerType()),
    T.StructField("answer_snippet", _S),
    T.StructField("used_sources", T.ArrayType(T.IntegerType())),
    T.StructField("warnings", T.ArrayType(_S)),
    T.StructField("retrieval_sources", T.ArrayType(SOURCE_ITEM)),
    T.StructField("online_mode", T.BooleanType()),
    T.StructField("llm_enabled", T.BooleanType()),
    T.StructField("llm_provider", _S),
    T.StructField("llm_model", _S),
    T.StructField("reranker_enabled", T.BooleanType()),
    T.StructField("min_score", T.DoubleType()),
    T.StructField("keyword_filter", T.BooleanType()),
    T.StructField("doc_scope_enabled", T.BooleanType()),
    T.StructField("doc_scope_ids", T.ArrayType(_S)),
    T.StructField("verdict", _S),
    T.StructField("top_urls", T.ArrayType(_S)),
    T.StructField("meta", T.MapType(_S, _S)),
])
