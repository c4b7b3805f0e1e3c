"""Text normalisation, summaries, keywords, masking and citation parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagemill import values as V


def strip(c: Column, chars: str = V.WHITESPACE) -> Column:
    """Python-style strip; linear, unlike an anchored ``[...]+$`` pattern."""
    return F.btrim(c, F.lit(chars))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(V.WHITESPACE))


def count_of(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    removed = F.length(F.replace(c, F.lit(needle), F.lit("")))
    return ((F.length(c) - removed) / len(needle)).cast("long")


def normalize_ws(c: Column) -> Column:
    """One space per space/tab/NBSP run, at most one blank line, stripped."""
    spaced = F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\x{a0}]+", " ")
    return strip(F.regexp_replace(spaced, r"\n{3,}", "\n\n"))


def flatten(c: Column) -> Column:
    """The text on one line: every whitespace run becomes one space."""
    return F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{V.WS}]+", " "))


def _cut(flat: Column, max_len: int) -> Column:
    return F.when(F.length(flat) <= max_len, flat).otherwise(
        F.concat(rstrip(F.substring(flat, 1, max_len)), F.lit(V.ELLIPSIS))
    )


def snip(c: Column, max_len: int = V.SNIP) -> Column:
    return _cut(flatten(c), max_len)


def table_snippet(c: Column, max_len: int = V.TABLE_SNIP) -> Column:
    """Raw prefix with an ellipsis if longer; neither flattened nor stripped."""
    return F.when(
        F.length(c) > max_len, F.concat(F.substring(c, 1, max_len), F.lit(V.ELLIPSIS))
    ).otherwise(c)


def short_summary(c: Column, n: int = 2) -> Column:
    """The first ``n`` sentences that are long enough, else a snippet."""
    flat = flatten(c)
    sentences = F.filter(
        F.split(flat, r"(?<=[.!?]) "), lambda s: F.length(s) > V.SUMMARY_MIN_SENTENCE
    )
    return F.when(
        F.size(sentences) > 0, F.array_join(F.slice(sentences, 1, n), " ")
    ).otherwise(_cut(flat, V.SUMMARY_SNIP))


def runs(c: Column, chars: str, min_len: int = 1) -> Column:
    """Maximal runs of characters of a class; much cheaper than splitting on the rest."""
    return F.regexp_extract_all(c, F.lit(f"[{chars}]{{{min_len},}}"), F.lit(0))


def words(c: Column, min_len: int = V.MIN_KEYWORD_LEN) -> Column:
    """Lower-cased words in text order, repeats kept."""
    return runs(F.lower(F.coalesce(c, F.lit(""))), V.WORD_CHARS, min_len)


def keywords(c: Column, min_len: int = V.MIN_KEYWORD_LEN, cap: int | None = None) -> Column:
    """Distinct words in first-occurrence order, optionally only the first ``cap``."""
    distinct = F.array_distinct(words(c, min_len))
    return distinct if cap is None else F.slice(distinct, 1, cap)


def highlight(text: Column, kws: Column) -> Column:
    """Wrap every case-insensitive keyword match in a mark tag, longest keyword first."""
    quoted = F.transform(
        F.filter(F.array_distinct(kws), lambda k: k != ""),
        lambda k: F.struct(
            (-F.length(k)).alias("rank"),
            k.alias("word"),
            F.regexp_replace(k, r"([^\p{L}\p{N}\s])", r"\\$1").alias("quoted"),
        ),
    )
    ordered = F.transform(F.array_sort(quoted), lambda s: s["quoted"])
    pattern = F.concat(F.lit("(?iu)("), F.array_join(ordered, "|"), F.lit(")"))
    return F.when(F.coalesce(F.size(ordered), F.lit(0)) <= 0, text).otherwise(
        F.regexp_replace(text, pattern, F.lit("<mark>$1</mark>"))
    )


def channel_handle(c: Column) -> Column:
    """Bare channel name from a link or @-form."""
    out = strip(F.coalesce(c, F.lit("")))
    for prefix in V.LINK_PREFIXES:
        out = F.replace(out, F.lit(prefix), F.lit(""))
    return strip(strip(strip(out, "@"), "/"))


def channel_list(c: Column) -> Column:
    """Array of non-blank lines, stripped."""
    lines = F.transform(text_lines(F.coalesce(c, F.lit(""))), lambda s: strip(s))
    return F.filter(lines, lambda s: s != "")


def text_lines(c: Column) -> Column:
    """Non-empty lines between Python's str.splitlines() boundaries."""
    return runs(c, r"^\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}")


def safe_int(c: Column) -> Column:
    """Integer value of a string, null if it is none."""
    return strip(c).try_cast("bigint")


def iso_day(ts: Column) -> Column:
    return ts.cast("date").cast("string")


def mask_secret(c: Column) -> Column:
    """Stars in the place of all but the first and last two characters."""
    n = F.length(c)
    return (
        F.when(c.isNull(), F.lit(""))
        .when(n <= 4, F.repeat(F.lit("*"), n))
        .otherwise(
            F.concat(
                F.left(c, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(c, F.lit(2))
            )
        )
    )


def redact(c: Column) -> Column:
    """Blank out values given after ``password=`` and ``token=``."""
    out = F.coalesce(c, F.lit(""))
    for key in ("password", "token"):
        out = F.regexp_replace(out, f"(?iu){key}[{V.WS}]*=[{V.WS}]*[^{V.WS}]+", f"{key}=***")
    return out


def citations(c: Column, k_max: Column) -> Column:
    """Sorted distinct citation numbers ``[n]`` that lie in 1..k_max."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[([0-9]{1,2})\]"), F.lit(1))
    numbers = F.transform(found, lambda s: s.cast("int"))
    return F.array_sort(
        F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= k_max)))
    )


def citation_list(used: Column) -> Column:
    return F.array_join(
        F.transform(used, lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ", "
    )


def ensure_sources(
    answer: Column,
    used: Column,
    label: str = V.SOURCES_LABEL,
    none_text: str = V.NO_SOURCES_TEXT,
) -> Column:
    """Append a sources line unless the answer already carries one."""
    body = strip(answer)
    listed = F.when(F.size(used) > 0, citation_list(used)).otherwise(F.lit(none_text))
    line = F.concat(body, F.lit(f"\n\n**{label.capitalize()}:** "), listed)
    return F.when(answer.rlike(rf"(?iuU)\b{label}\b[{V.WS}]*:"), body).otherwise(strip(line))


def says_no_data(c: Column, phrases=V.NO_DATA_PHRASES) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    found = F.lit(False)
    for phrase in phrases:
        found = found | low.contains(phrase.lower())
    return found
