"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of all words by weight, at most ``LIMIT`` times
its own words, the excess going to the others by weight.  Within a source a
document's expected copies rise with the logarithm of its length, up to
``LIMIT``.  Whole expected copies are certain.  For what is left of the target
documents are ranked by random odds over inclusion odds, u/(1-u) / (p/(1-p)),
and taken in that order until the source's words are reached; the document at
the boundary gives the words still missing.  The random number is a hash of the
id, so reruns agree.

The boundary is found by a histogram of the order over bins, then among the rows
of one bin, so a source with a third of all rows is never sorted in one task.

Cases: a null text has size 0 and gives nothing; a null source is a source of
its own, last; rows that tie (repeated ids) share what is left at the boundary
evenly, fractions dropped; an empty table gives no rows; other columns are kept
by ``mixed`` and ignored by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.common import WORD
from passagemill.session import materialize

WEIGHTS = (5, 2, 1)
LIMIT = 3
BINS = 4096
SEED = 11


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(doc_id: Column) -> Column:
    top = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), doc_id), 11).cast("double")
    return (top + 0.5) / F.lit(float(1 << 53))


def sized(docs: DataFrame, *kept: str) -> DataFrame:
    """Size, length class and random number of each row, names prefixed to avoid clashes."""
    size = size_of(F.col("text"))
    return docs.select(
        *kept, F.col("source").cast("string").alias("_source"), size.alias("_size"), _uniform(F.col("doc_id")).alias("_u")
    ).withColumn("_class", F.lit(16) + F.length(F.bin("_size")))


def targets(classes: DataFrame) -> DataFrame:
    """``_source``, ``source_size``, ``target`` from words per source and class; one row a source."""
    sources = classes.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array([F.lit(float(w)) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    sources = materialize(sources.withColumn("_weight", weight), "mix_sources")
    total, all_weight = sources.agg(F.sum("source_size"), F.sum("_weight")).first()
    level, capped = (total or 0) / (all_weight or 1.0), 0
    while True:  # ends: each round caps more sources
        full = F.col("source_size") * LIMIT < F.col("_weight") * level
        number, words, weights = sources.agg(
            F.count_if(full), F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("_weight")))
        ).first()
        if not weights or number == capped:
            break
        level, capped = (total - LIMIT * (words or 0)) / weights, number
    target = F.least(F.col("source_size") * float(LIMIT), F.col("_weight") * level)
    return sources.select("_source", "source_size", target.alias("target"))


def _expected(classes: DataFrame, goal: DataFrame) -> DataFrame:
    """Expected copies ``_m`` per source and class, in proportion to the class up to the limit."""
    down = Window.partitionBy("_source").orderBy(F.col("_class").desc())
    upto = down.rowsBetween(Window.unboundedPreceding, -1)
    rest = down.rowsBetween(0, Window.unboundedFollowing)
    rows = classes.join(goal, classes._source.eqNullSafe(goal._source)).drop(goal._source)
    level = F.try_divide(
        F.col("target") - LIMIT * F.coalesce(F.sum("_words").over(upto), F.lit(0)),
        F.sum(F.col("_words") * F.col("_class")).over(rest),
    )
    rows = rows.withColumn("_level", F.when(level * F.col("_class") <= LIMIT + 1e-9, level))
    chosen = F.first("_level", ignorenulls=True).over(
        down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    share = F.least(F.lit(float(LIMIT)), F.col("_class") * F.coalesce(chosen, F.lit(float(LIMIT))))
    return rows.withColumn("_m", F.round(share, 9))


def plan(rows: DataFrame) -> DataFrame:
    """Per source and class: size and target of the source, certain copies and odds, and the boundary."""
    classes = materialize(
        rows.groupBy("_source", "_class").agg(F.sum("_size").alias("_words")), "mix_classes"
    )
    expected = _expected(classes, targets(classes))
    whole = expected.withColumn("_copies", F.floor("_m")).withColumn("_p", F.col("_m") - F.floor("_m"))
    left = F.col("target") - F.sum(F.col("_copies") * F.col("_words")).over(Window.partitionBy("_source"))
    whole = materialize(
        whole.select(
            F.col("_source").alias("_s"), F.col("_class").alias("_c"), "source_size", "target", "_copies", "_p",
            F.round(left).cast("long").alias("_left"),
        ), "mix_plan",
    )
    ranked = ordered(rows, whole).where("_order is not null and _size > 0")
    bins = ranked.groupBy("_s", "_left", "_bin").agg(F.sum("_size").alias("_w"))
    running = F.sum("_w").over(Window.partitionBy("_s").orderBy("_bin"))
    bins = bins.withColumn("_before", running - F.col("_w"))
    edge = bins.where("_before <= _left and _before + _w > _left").select(
        F.col("_s").alias("_es"), F.col("_bin").alias("_eb"), "_before"
    )
    near = ranked.join(edge, F.col("_s").eqNullSafe(F.col("_es")) & (F.col("_bin") == F.col("_eb")))
    ties = near.groupBy("_es", "_left", "_before", "_order").agg(F.sum("_size").alias("_w"), F.count("*").alias("_n"))
    running = F.sum("_w").over(Window.partitionBy("_es").orderBy("_order"))
    ties = ties.withColumn("_reach", F.col("_before") + running - F.col("_w"))
    cut = ties.where("_reach <= _left and _reach + _w > _left").select(
        "_es", F.col("_order").alias("_cut"), F.floor((F.col("_left") - F.col("_reach")) / F.col("_n")).alias("_share")
    )
    return materialize(
        whole.join(cut, F.col("_s").eqNullSafe(F.col("_es")), "left").drop("_es"), "mix_decisions"
    )


def ordered(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows with their source's plan and place in the Pareto order; null: no chance of a further copy."""
    joined = rows.join(decisions, rows._source.eqNullSafe(F.col("_s")) & (rows._class == F.col("_c")))
    odds = F.col("_u") / (1 - F.col("_u")) / (F.col("_p") / (1 - F.col("_p")))
    return joined.withColumn("_order", F.when(F.col("_p") > 0, odds)).withColumn(
        "_bin", F.floor(F.col("_order") / (1 + F.col("_order")) * BINS).cast("int")
    )


def taken(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Adds ``_copies`` (whole) and ``_part`` (words of one more, cut copy)."""
    placed = ordered(rows, decisions)
    further = F.col("_order").isNotNull() & (F.col("_cut").isNull() | (F.col("_order") < F.col("_cut")))
    further = further & (F.col("_left") > 0)
    part = F.when(F.col("_order") == F.col("_cut"), F.least(F.col("_share"), F.col("_size"))).otherwise(0)
    return placed.withColumn("_copies", F.col("_copies") + F.when(further, 1).otherwise(0)).withColumn(
        "_part", part.cast("long")
    )


def mix(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` (words the mix takes, copies counted)."""
    rows = materialize(sized(docs, "doc_id"), "mix_sizes")
    return taken(rows, plan(rows)).select(
        F.col("doc_id").cast("long"), F.col("_size").alias("size"), "source_size", "target",
        (F.col("_copies") * F.col("_size") + F.col("_part")).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as taken.

    A boundary document's cut copy ends after the words taken.
    """
    rows = sized(docs, F.struct(*docs.columns).alias("_given"), F.col("text").alias("_whole"))
    done = taken(rows, plan(materialize(sized(docs), "mix_sizes")))
    words = F.slice(F.regexp_extract_all("_whole", F.lit(WORD), 0), 1, F.col("_part").cast("int"))
    cut = F.when(F.col("_part") > 0, F.array_join(words, " "))
    texts = F.concat(
        F.array_repeat(F.col("_whole"), F.col("_copies").cast("int")),
        F.when(cut.isNotNull(), F.array(cut)).otherwise(F.array().cast("array<string>")),
    )
    return done.withColumn("_text", F.explode(texts)).select(
        *(F.col("_text").alias(c) if c == "text" else F.col("_given")[c].alias(c) for c in docs.columns)
    )
