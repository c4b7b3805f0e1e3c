"""Title, visible text and main text of HTML pages, as built-in expressions.

Element blocks are removed with lazy patterns that also accept a missing end
tag, so every pattern makes one pass over the page.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill import values as V
from passagemill.functions.text import count_of, flatten, runs, strip, text_lines

TAG = r"<[/a-zA-Z!?][^<>]*>"
HIDDEN = ("script", "style", "noscript")
FRAME = ("nav", "header", "footer", "aside", "form")
CONTENT = ("article", "main")
NODE_BREAK = "\x01"
REFERENCE = r"^&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);"
NAMED = {**{name: chr(n) for name, n in name2codepoint.items()}, "apos": "'"}

COMMENT = r"<!--.*?(?:-->|\z)"


def blocks(tags: tuple[str, ...]) -> str:
    """Pattern of elements with their bodies; the end tag is the one of the start tag."""
    return rf"<({'|'.join(tags)})\b[^<>]*>.*?(?:</\1\s*>|\z)"


def block_body(tag: str) -> str:
    return rf"(?is)<{tag}\b[^<>]*>(.*?)(?:</{tag}\s*>|\z)"


def page_title(html: Column, fallback: Column) -> Column:
    """Body of the first title element on one line, else the fallback."""
    raw = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title>(.*?)</title>", 1)
    title = flatten(raw)
    return F.when(title != "", title).otherwise(F.coalesce(fallback, F.lit("")))


def decode_entities(c: Column) -> Column:
    """Decode decimal, hexadecimal and named (HTML 4) character references, each once.

    The text is cut before every ampersand, so what a reference stands for is
    never read as part of another.  Surrogates, zero and numbers past the last
    code point become U+FFFD, other control characters nothing; unknown names
    and references without a semicolon stay as they are.
    """
    pieces = F.transform(
        F.split(c, r"(?=&)"), lambda p: F.struct(p.alias("all"), F.regexp_extract(p, REFERENCE, 1).alias("name"))
    )
    decoded = F.transform(
        pieces,
        lambda p: F.when(p["name"] == "", p["all"]).otherwise(
            F.coalesce(
                F.concat(_meaning(p["name"]), F.substring(p["all"], F.length(p["name"]) + 3, F.length(p["all"]))),
                p["all"],
            )
        ),
    )
    return F.when(c.contains("&"), F.array_join(decoded, "")).otherwise(c)


def _meaning(name: Column) -> Column:
    """What a reference stands for, null if its name is unknown."""
    named = F.create_map(*[F.lit(x) for pair in sorted(NAMED.items()) for x in pair])
    digits = F.regexp_extract(name, r"^#0*([0-9]{1,7})$", 1)
    hexed = F.regexp_extract(name, r"^#[xX]0*([0-9a-fA-F]{1,6})$", 1)
    number = F.when(digits != "", digits.try_cast("bigint")).when(
        hexed != "", F.conv(hexed, 16, 10).try_cast("bigint")
    )
    broken = number.isNull() | (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    control = (number < 32) & ~number.isin(9, 10, 13)
    point = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(
        name.startswith("#"),
        F.when(broken, F.lit("�")).when(control, F.lit("")).otherwise(point),
    ).when(name == "amp", F.lit("&")).otherwise(F.try_element_at(named, name))


def element_bodies(html: Column, tag: str) -> Column:
    """Bodies of all outermost elements of a tag, those nested in them included.

    The page is cut before each start and end tag; running depths tell the
    pieces inside.  An element without an end tag lasts to the end of the page.
    """
    pieces = F.split(html, rf"(?i)(?=</?{tag}\b[^<>]*>)")
    moves = F.transform(
        pieces,
        lambda p: F.when(p.rlike(rf"^(?i)<{tag}\b"), 1).when(p.rlike(rf"^(?i)</{tag}\b"), -1).otherwise(0),
    )
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<int>").alias("depths"))
    depths = F.aggregate(
        moves,
        start,
        lambda acc, move: F.struct(
            F.greatest(acc["depth"] + move, F.lit(0)).alias("depth"),
            F.array_append(acc["depths"], F.greatest(acc["depth"] + move, F.lit(0))).alias("depths"),
        ),
        lambda acc: acc["depths"],
    )
    inside = F.zip_with(pieces, depths, lambda p, d: F.when(d > 0, F.regexp_replace(p, r"^<[^<>]*>", "")))
    return F.array_join(F.filter(inside, lambda p: p.isNotNull() & (p != "")), NODE_BREAK)


def shown_html(html: Column) -> Column:
    """The page without comments, scripts and styles, removed in one pass."""
    return F.regexp_replace(
        F.coalesce(html, F.lit("")), f"(?is){COMMENT}|{blocks(HIDDEN)}", ""
    )


def text_nodes(html: Column) -> Column:
    """Non-blank text nodes, stripped, one per line; entities are decoded in one pass."""
    decoded = decode_entities(F.regexp_replace(html, TAG, NODE_BREAK))
    nodes = F.transform(runs(decoded, r"^\x01"), lambda n: strip(n))
    return F.array_join(F.filter(nodes, lambda n: n != ""), "\n")


def visible_of(shown: Column) -> Column:
    main = F.regexp_extract(shown, block_body("main"), 1)
    has_main = shown.rlike(r"(?i)<main\b[^<>]*>")
    return text_nodes(F.when(has_main, main).otherwise(shown))


def main_of(shown: Column) -> Column:
    content = F.regexp_replace(shown, f"(?is){blocks(FRAME)}", "")
    bodies = [element_bodies(content, t) for t in CONTENT]
    # Bound to a variable: as a plain CASE the article would be searched for twice.
    body = F.transform(F.array(bodies[0]), lambda b: F.when(b != "", b).otherwise(bodies[1]))[0]
    return text_nodes(body)


def visible_text(html: Column) -> Column:
    """Text nodes of the main element, or of the whole page, one per line."""
    return visible_of(shown_html(html))


def main_text(html: Column) -> Column:
    """Text of all outermost article (else main) elements without page furniture; "" if none."""
    return main_of(shown_html(html))


def with_page_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Main text, or the whole visible text where the main text is too short.

    Staged so that each pattern runs once per page.
    """
    return (
        pages.withColumn("_shown", shown_html(F.col(html)))
        .withColumn("_main", main_of(F.col("_shown")))
        .withColumn(
            out,
            F.when(F.length("_main") >= V.MAIN_TEXT_MIN_CHARS, F.col("_main")).otherwise(
                visible_of(F.col("_shown"))
            ),
        )
        .drop("_shown", "_main")
    )


def clean_lines(c: Column) -> Column:
    """Drop tiny and table-like lines, then normalise spaces."""
    lines = F.transform(text_lines(F.coalesce(c, F.lit(""))), lambda s: strip(s))
    kept = F.filter(
        lines,
        lambda s: (F.length(s) >= V.LINE_MIN_CHARS)
        & (~s.contains("+") | (count_of(s, "+") <= V.LINE_MAX_PLUSES))
        & (
            ~s.contains("|")
            | (
                (count_of(s, "|") <= V.LINE_MAX_BARS)
                & ~s.rlike(rf"\|[{V.WS}]*\|[{V.WS}]*\+")
            )
        ),
    )
    joined = F.regexp_replace(F.array_join(kept, "\n"), r"[ \t\x{a0}]+", " ")
    return strip(F.regexp_replace(joined, r"\n{3,}", "\n\n"))
