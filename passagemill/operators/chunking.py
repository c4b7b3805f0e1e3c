"""Documents to overlapping passages with stable ids."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill import values as V
from passagemill.functions import ids
from passagemill.functions.text import normalize_ws, strip
from passagemill.sources.schema import CHUNK_COLUMNS


def check_window(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError(f"need 0 <= overlap < size, got size={size}, overlap={overlap}")


def windows(text: Column, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP) -> Column:
    """Stripped non-blank windows of a normalised text.

    The text is cut once into steps of ``size - overlap`` characters and each
    window is joined from neighbouring steps, so the work is linear in the
    length of the text (taking each window by position would rescan the text).
    """
    check_window(size, overlap)
    step = size - overlap
    reach = 1 + ceil(overlap / step)
    steps = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    # The last window is the first one that touches the end of the text.
    count = F.greatest(F.ceil((F.length(text) - overlap) / step), F.lit(1)).cast("int")
    cut = F.transform(
        F.array(steps),
        lambda s: F.transform(
            F.sequence(F.lit(1), count),
            lambda i: strip(F.left(F.array_join(F.slice(s, i, reach), ""), F.lit(size))),
        ),
    )[0]
    return F.when(F.length(text) > 0, F.filter(cut, lambda w: w != "")).otherwise(
        F.array().cast("array<string>")
    )


def chunk_array(c: Column, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP) -> Column:
    """Windows of any text, normalised first."""
    return windows(normalize_ws(c), size, overlap)


def chunk_documents(
    docs: DataFrame,
    size: int = V.CHUNK_SIZE,
    overlap: int = V.CHUNK_OVERLAP,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Explode documents into chunk rows.

    Needs ``source_type, url, title, raw_text, date``; ``extra`` (string map)
    and ``doc_id`` are optional.  A non-blank ``doc_id`` is used as it is,
    otherwise the id is derived from type, URL, title and text.  ``keep`` names
    columns carried through; the 0-based ``part`` number is always added.
    """
    check_window(size, overlap)
    no_extra = F.create_map().cast("map<string,string>")
    extra = F.coalesce("extra", no_extra) if "extra" in docs.columns else no_extra
    given = F.col("doc_id").cast("string") if "doc_id" in docs.columns else F.lit(None).cast("string")
    url = strip(F.coalesce("url", F.lit("")))
    title = strip(
        F.coalesce(F.nullif("title", F.lit("")), F.nullif(url, F.lit("")), F.lit(V.DEFAULT_TITLE))
    )
    text = docs.select(
        *keep,
        F.col("source_type").cast("string").alias("source_type"),
        url.alias("url"),
        title.alias("title"),
        normalize_ws(F.col("raw_text")).alias("_text"),
        F.col("date").cast("string").alias("date"),
        extra.alias("_extra"),
        given.alias("_given"),
    )
    derived = ids.doc_id(F.col("source_type"), F.col("url"), F.col("title"), F.col("_text"))
    named = text.withColumn(
        "_doc", F.when(strip(F.col("_given")) != "", F.col("_given")).otherwise(derived)
    )
    defaults = F.create_map(
        F.lit("doc_id"), F.col("_doc"), F.lit("source_type"), F.col("source_type")
    )
    # Keys already present in extra win over the defaults.
    merged = F.map_concat(
        F.map_filter(defaults, lambda k, v: ~F.map_contains_key("_extra", k)), F.col("_extra")
    )
    # Blank texts have no window.  They leave after the outer explode: a filter before
    # it, or the one Spark infers for an inner explode, would cut every text twice.
    exploded = named.withColumn("extra", merged).select(
        "*", F.posexplode_outer(windows(F.col("_text"), size, overlap)).alias("part", "text")
    ).where(F.col("part").isNotNull())
    return exploded.withColumn(
        "chunk_id", ids.chunk_id(F.col("source_type"), F.col("_doc"), F.col("part"))
    ).select(*CHUNK_COLUMNS, "part", *keep)
