"""Boolean filters on chunks, pages, messages and results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagemill import values as V
from passagemill.functions.text import count_of, strip


def has_keywords(text: Column, kws: Column, min_hits: int = 1) -> Column:
    """At least ``min_hits`` keywords occur in the text; true without keywords."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = F.size(F.filter(kws, lambda k: low.contains(k)))
    return (F.size(kws) == 0) | (hits >= min_hits)


def matches_keywords(text: Column, title: Column, url: Column, kws: Column) -> Column:
    """Keywords in the text, or else in title and URL."""
    label = F.concat(
        F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(url, F.lit(""))
    )
    return has_keywords(text, kws) | has_keywords(label, kws)


def is_noise(text: Column) -> Column:
    """Blank, very short or table-like text."""
    t = strip(F.coalesce(text, F.lit("")))
    return (
        (F.length(t) < V.NOISE_MIN_CHARS)
        | (count_of(t, "|") > V.NOISE_MAX_BARS)
        | (count_of(t, "+") > V.NOISE_MAX_PLUSES)
        | ((count_of(t, "| |") > V.NOISE_MAX_EMPTY_CELLS) & t.contains("+"))
    )


def _any_contained(low: Column, markers) -> Column:
    found = F.lit(False)
    for marker in markers:
        found = found | low.contains(marker.lower())
    return found


def is_relevant(text: Column, good, bad=(), min_len: int = V.PAGE_MIN_CHARS) -> Column:
    """Long enough, no bad marker and at least one good marker."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (F.length(low) >= min_len) & ~_any_contained(low, bad) & _any_contained(low, good)


def is_fresh(ts: Column, as_of: Column, since_days: int | None) -> Column:
    """Not older than ``since_days`` before ``as_of``; undated rows are kept."""
    if since_days is None or since_days <= 0:
        return F.lit(True)
    return ts.isNull() | (ts >= as_of - F.make_dt_interval(F.lit(since_days)))


def is_hit(
    url: Column, source_type: Column, title: Column, text: Column,
    must_url: Column, must_type: Column, must_text: Column,
) -> Column:
    """Every condition that the rule states holds (case-insensitive)."""

    def low(c: Column) -> Column:
        return F.lower(F.coalesce(c, F.lit("")))

    m_url, m_type, m_text = low(must_url), low(must_type), low(must_text)
    # An empty string is contained in every string, so only the type test needs a guard.
    return (
        low(url).contains(m_url)
        & ((m_type == "") | (low(source_type) == m_type))
        & (low(text).contains(m_text) | low(title).contains(m_text))
    )
