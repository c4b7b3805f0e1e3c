"""Retrieval quality: rule hits, metrics and plot data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from passagemill import values as V
from passagemill.functions.predicates import is_hit

HIST_BINS = 10


def eval_rows(
    rules: DataFrame, results: DataFrame, top_k: int = V.TOP_K, cut: bool = True,
    mode: str = "index",
) -> DataFrame:
    """One row per rule.  Rules without results stay as misses; with ``cut=False``
    every returned rank counts, not only the first ``top_k``."""
    found = results.where(F.col("rank") <= top_k) if cut else results
    found = found.select("query_id", "rank", "score", "url", "source_type", "title", "text")
    hit = is_hit(
        F.col("url"), F.col("source_type"), F.col("title"), F.col("text"),
        F.col("must_contain_url"), F.col("must_contain_type"), F.col("must_contain_text"),
    )
    first = F.col("rank") == 1
    judged = rules.join(found, "query_id", "left").withColumn(
        "_hit", F.col("rank").isNotNull() & hit
    )
    rows = judged.groupBy("query_id", "query").agg(
        F.min(F.when(F.col("_hit"), F.col("rank"))).alias("hit_rank"),
        F.count_if("_hit").alias("_relevant"),
        F.max(F.when(first, F.col("score"))).alias("top1_score"),
        F.max(F.when(first, F.col("url"))).alias("top1_url"),
        F.max(F.when(first, F.col("source_type"))).alias("top1_type"),
    )
    precision = F.round(F.col("_relevant") / F.lit(float(top_k)), 4) if top_k else F.lit(0.0)
    return rows.select(
        "query_id", "query", F.col("hit_rank").isNotNull().alias("hit"), "hit_rank",
        precision.alias("precision_at_k"), "top1_score", "top1_url", "top1_type",
        F.lit(mode).alias("mode"),
    )


COUNTS = ("n", "hits", "reciprocal", "precision", "hits_1", "hits_3", "hits_5")


def score_counts(rows: DataFrame) -> DataFrame:
    """What metrics and the score histogram need, per top score.

    Scores have a fixed number of digits, so this is a table of bounded size, however
    many rules there are; tables of several runs add up (``merged_counts``).
    """
    rank = F.col("hit_rank")
    return rows.groupBy("top1_score").agg(
        F.count("*").alias("n"),
        F.count_if("hit").alias("hits"),
        F.sum(F.when(rank.isNotNull(), 1.0 / rank).otherwise(0.0)).alias("reciprocal"),
        F.sum("precision_at_k").alias("precision"),
        *[F.count_if(F.coalesce(rank <= k, F.lit(False))).alias(f"hits_{k}") for k in (1, 3, 5)],
    )


def merged_counts(*parts: DataFrame) -> DataFrame:
    """Counts of all parts together, as if their rows had been counted at once."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("top1_score").agg(*(F.sum(c).alias(c) for c in COUNTS))


def eval_metrics(rows: DataFrame, top_k: int = V.TOP_K) -> DataFrame:
    """One row of quality metrics."""
    return metrics_of(score_counts(rows), top_k)


def metrics_of(counted: DataFrame, top_k: int = V.TOP_K) -> DataFrame:
    """One row of quality metrics from counts per score."""
    n = F.sum("n")

    def share(total):
        return F.round(F.coalesce(total / n, F.lit(0.0)), 6)

    scored = F.when(F.col("top1_score").isNotNull(), F.col("n"))
    return counted.agg(
        F.coalesce(n, F.lit(0)).alias("n"),
        F.lit(top_k).alias("top_k"),
        share(F.sum("hits")).alias("recall_at_k"),
        share(F.sum("reciprocal")).alias("mrr_at_k"),
        share(F.sum("precision")).alias("avg_precision_at_k"),
        *[share(F.sum(f"hits_{k}")).alias(f"hit_at_{k}") for k in (1, 3, 5)],
        F.round(F.sum(F.col("top1_score") * F.col("n")) / F.sum(scored), 6).alias("top1_score_mean"),
        F.round(F.percentile("top1_score", F.lit(0.5), F.col("n")), 8).alias("top1_score_median"),
    )


def with_settings(metrics: DataFrame, **settings) -> DataFrame:
    """Add the settings a measurement was made with."""
    return metrics.withColumns({name: F.lit(value) for name, value in settings.items()})


def hit_ratio(rows: DataFrame) -> DataFrame:
    return rows.groupBy("hit").agg(F.count("*").alias("n"))


def rank_histogram(rows: DataFrame) -> DataFrame:
    return rows.where("hit").groupBy("hit_rank").agg(F.count("*").alias("n"))


def score_histogram(rows: DataFrame, bins: int = HIST_BINS) -> DataFrame:
    """Equal-width bins over the range of top scores, empty bins included."""
    return histogram_of(rows.groupBy("top1_score").agg(F.count("*").alias("n")), bins)


def histogram_of(counted: DataFrame, bins: int = HIST_BINS) -> DataFrame:
    """The score histogram from counts per score."""
    scores = counted.where(F.col("top1_score").isNotNull()).select("top1_score", "n")
    span = scores.agg(
        F.min("top1_score").alias("lo"), F.max("top1_score").alias("hi")
    ).select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    place = F.floor((F.col("top1_score") - lo) / (hi - lo) * bins)
    counts = scores.groupBy(F.least(place, F.lit(bins - 1)).alias("bin")).agg(F.sum("n").alias("n"))
    every = counted.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(counts, "bin", "left").select(
        "bin",
        F.round(lo + (hi - lo) * F.col("bin") / bins, 8).alias("lower"),
        F.round(lo + (hi - lo) * (F.col("bin") + 1) / bins, 8).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def write_report(rows: DataFrame, metrics: DataFrame, path: str) -> None:
    """Rows as CSV with a header and doubled quotes, metrics as JSON."""
    rows.write.mode("overwrite").options(header=True, escape='"').csv(f"{path}/eval_results")
    metrics.write.mode("overwrite").json(f"{path}/metrics")


def read_report_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a report; questions may hold line breaks, so a file is read as a whole."""
    how = {"header": True, "escape": '"', "multiLine": True}
    return spark.read.options(**how).schema(schema).csv(f"{path}/eval_results")
