"""Text rules on hand-written values."""

import random

import pytest
from pyspark.sql import functions as F

from passagemill import values as V
from passagemill.functions import html as H
from passagemill.functions import ids
from passagemill.functions import predicates as P
from passagemill.functions import text as X
from passagemill.operators.chunking import chunk_array, check_window, chunk_documents


@pytest.fixture(scope="module")
def run(spark):
    def apply(fn, *values, types=None):
        """fn over one row of string (or typed) columns a, b, c..."""
        names = "abcdef"[: len(values)]
        types = types or ["string"] * len(values)
        schema = ", ".join(f"{n} {t}" for n, t in zip(names, types))
        df = spark.createDataFrame([tuple(values)], schema)
        return df.select(fn(*[F.col(n) for n in names]).alias("out")).first()["out"]

    return apply


def test_whitespace_class_is_pythons():
    expected = {chr(i) for i in range(0x3100) if chr(i).isspace()}
    assert set(V.WHITESPACE) == expected


def test_strip_and_normalize(run):
    assert run(X.strip, "\x1c\x85\xa0 a b \n") == "a b"
    assert run(X.normalize_ws, None) == ""
    assert run(X.normalize_ws, "a\xa0\t  b\n\n\n\nc \n \n d ") == "a b\n\nc \n \n d"
    assert run(X.normalize_ws, "a\r\nb") == "a\r\nb"
    assert run(X.flatten, " a\n b\xa0 c ") == "a b c"
    assert run(X.flatten, None) == ""


def test_snips(run):
    assert run(lambda c: X.snip(c, 5), "abcde") == "abcde"
    assert run(lambda c: X.snip(c, 5), "abcd efgh") == "abcd…"
    assert run(lambda c: X.table_snippet(c, 3), "ab  c") == "ab …"
    assert run(lambda c: X.snip(c, 2), "😀😀😀") == "😀😀…"


def test_short_summary(run):
    text = "Short one. This sentence is long enough! And so is this other one? Tail."
    assert run(lambda c: X.short_summary(c, 1), text) == "This sentence is long enough!"
    assert run(lambda c: X.short_summary(c, 2), text) == (
        "This sentence is long enough! And so is this other one?"
    )
    assert run(X.short_summary, "Tiny. Bits.") == "Tiny. Bits."
    assert run(X.short_summary, "  ") == ""


def test_keywords(run):
    assert run(X.keywords, "Die Straße, Café word ІНСТИТУТ data data 1234") == [
        "stra", "word", "інститут", "data", "1234",
    ]
    many = " ".join(f"word{i:02d}" for i in range(20))
    assert run(lambda c: X.keywords(c, cap=12), many) == [f"word{i:02d}" for i in range(12)]
    assert run(X.keywords, "a b c") == []


def test_highlight(run):
    kinds = ["string", "array<string>"]
    assert run(X.highlight, "Data and database", ["data", "database"], types=kinds) == (
        "<mark>Data</mark> and <mark>database</mark>"
    )
    assert run(X.highlight, "Кафедра КАФЕДРИ", ["кафедр"], types=kinds) == (
        "<mark>Кафедр</mark>а <mark>КАФЕДР</mark>И"
    )
    assert run(X.highlight, "c++ a.b axb", ["c++", "a.b"], types=kinds) == (
        "<mark>c++</mark> <mark>a.b</mark> axb"
    )
    assert run(X.highlight, "plain", [], types=kinds) == "plain"
    assert run(X.highlight, "plain", None, types=kinds) == "plain"


def test_channels(run):
    for raw in ("https://t.me/abc", "http://t.me/abc/", " t.me/abc ", "@abc", "abc"):
        assert run(X.channel_handle, raw) == "abc"
    assert run(X.channel_handle, None) == ""
    assert run(X.channel_list, "a\n\n  \r\n b ") == ["a", "b"]
    assert run(X.safe_int, " 12 ") == 12
    assert run(X.safe_int, "12x") is None


def test_secrets(run):
    assert run(X.mask_secret, None) == "" and run(X.mask_secret, "") == ""
    assert run(X.mask_secret, "abcd") == "****"
    assert run(X.mask_secret, "abcdef") == "ab**ef"
    assert run(X.redact, "x PassWord = s3cret, Token=abc y") == "x password=*** token=*** y"
    assert run(X.redact, None) == ""


def test_citations(run):
    kinds = ["string", "int"]
    assert run(X.citations, "[3] [02] [0] [7] [333] [3] [x]", 6, types=kinds) == [2, 3]
    assert run(X.citations, None, 6, types=kinds) == []


def test_ensure_sources(run):
    kinds = ["string", "array<int>"]
    assert run(X.ensure_sources, " a ", [1, 3], types=kinds) == "a\n\n**Sources:** [1], [3]"
    assert run(X.ensure_sources, "a", [], types=kinds) == f"a\n\n**Sources:** {V.NO_SOURCES_TEXT}"
    assert run(X.ensure_sources, "a\nSOURCES : [1] ", [1], types=kinds) == "a\nSOURCES : [1]"
    assert run(X.ensure_sources, "resources: x", [1], types=kinds).endswith("**Sources:** [1]")


def test_ids(run):
    import hashlib

    digest = hashlib.sha1("text".encode()).hexdigest()[:10]
    expected = hashlib.sha1(f"web|u|t|{digest}".encode()).hexdigest()[:16]
    assert run(ids.doc_id, "web", "u", "t", "text") == expected
    assert run(ids.content_hash, None) == hashlib.sha1(b"").hexdigest()
    kinds = ["string", "string", "int"]
    assert run(ids.chunk_id, "web", "d", 7, types=kinds) == "web_d_007"
    assert run(ids.chunk_id, "web", "d", 1234, types=kinds) == "web_d_1234"


def test_noise(run):
    good = "x" * 60
    assert not run(P.is_noise, good)
    assert run(P.is_noise, "x" * 59) and run(P.is_noise, " " + "x" * 59 + " ")
    assert run(P.is_noise, None) and run(P.is_noise, "  ")
    assert run(P.is_noise, good + "|" * 26) and not run(P.is_noise, good + "|" * 25)
    assert run(P.is_noise, good + "+" * 26)
    assert run(P.is_noise, good + "| |" * 11 + "+") and not run(P.is_noise, good + "| |" * 11)


def test_keyword_and_relevance_filters(run):
    kinds = ["string", "array<string>"]
    assert run(P.has_keywords, "some Text", ["text"], types=kinds)
    assert run(P.has_keywords, "some", [], types=kinds)
    assert not run(P.has_keywords, None, ["text"], types=kinds)
    long = "the " * 200
    assert run(lambda c: P.is_relevant(c, ["the"]), long)
    assert not run(lambda c: P.is_relevant(c, ["the"], ["he t"]), long)
    assert not run(lambda c: P.is_relevant(c, ["the"]), "the")
    assert not run(lambda c: P.is_relevant(c, []), long)


def test_rule_hits(run):
    def hit(*values):
        return run(lambda a, b, c, d, e, f: P.is_hit(a, b, c, d, e, f, F.lit(None).cast("string")), *values)

    assert hit("u/x", "web", "T", "text", None, None)
    assert hit("u/X", "Web", "T", "text", "U/x", "WEB")
    assert not hit(None, "web", "T", "text", "u", None)
    assert not hit("u", "webs", "T", "text", None, "web")


HTML = """<!DOCTYPE html><html><head><TITLE> A
 &amp; B </TITLE><style>p{}</style><script>var t="</p>";</script><!-- x <p>no</p> --></head>
<body><nav><a href="/">Home</a></nav><article><h1>Head</h1><p>One&nbsp;&#1076;<br>two &lt;b&gt;</p></article>
<footer>End</footer></body></html>"""


def test_html(run):
    assert run(lambda h: H.page_title(h, F.lit("f")), HTML) == "A &amp; B"
    assert run(lambda h: H.page_title(h, F.lit("f")), "<title> </title>") == "f"
    assert run(H.main_text, HTML) == "Head\nOne\xa0д\ntwo <b>"
    assert run(H.visible_text, HTML) == "A\n & B\nHome\nHead\nOne\xa0д\ntwo <b>\nEnd"
    assert run(H.visible_text, "<p>a</p><main>b<noscript>c</noscript></main>") == "b"
    assert run(H.visible_text, "<p>a</p><script>never closed") == "a"
    assert run(H.visible_text, None) == "" and run(H.main_text, "<p>a</p>") == ""
    assert run(H.visible_text, "1 < 2 &amp;lt; 3") == "1 < 2 &lt; 3"


def test_character_references(run):
    for raw, plain in {
        "AT&#38;T &#x26; &amp;": "AT&T & &", "caf&eacute; &euro;5 &#x27;x&#X27; &#039;": "café €5 'x' '",
        "&amp;lt; &#38;amp; &amp;#38;": "&lt; &amp; &#38;", "&#55357;&#xDE00; &#0;": "�� �",
        "&#128512;&#x1F600;": "😀😀", "&#99999999999999999999;&#x110000;": "��",
        "&unknown; & &amp &;": "&unknown; & &amp &;", "&Auml;&auml;&apos;": "Ää'", "a&#1;b&#10;c": "ab\nc", "": "",
    }.items():
        assert run(H.decode_entities, raw) == plain


def test_all_outermost_articles(run):
    page = (
        "<p>out</p><article>one<article class='x'>two</article>three</article><p>between</p>"
        "<ARTICLE>four</ARTICLE></article>out<article>five<main>six"
    )
    assert run(H.main_text, page) == "one\ntwo\nthree\nfour\nfive\nsix"
    assert run(H.main_text, "<article></article><article> </article><main>m</main>") == ""
    assert run(H.main_text, "<article></article><main>m<article></article></main>n") == "m"
    assert run(H.main_text, "<main>a</main>b<main>c</main>") == "a\nc"


def test_clean_lines(run):
    table = "|" * 11
    assert run(H.clean_lines, f" a b\nx\n\n{table}\n| | +\nkeep  this\x85and that\n") == (
        "a b\nkeep this\nand that"
    )
    assert run(H.clean_lines, None) == ""


def windows_by_hand(text, size, overlap):
    out, start = [], 0
    while text and start < len(text):
        piece = text[start:start + size].strip()
        if piece:
            out.append(piece)
        if start + size >= len(text):
            break
        start += size - overlap
    return out


@pytest.mark.parametrize("size,overlap", [(10, 3), (10, 0), (7, 6), (900, 120), (5, 4)])
def test_windows_match_a_plain_loop(spark, size, overlap):
    rnd = random.Random(size * 100 + overlap)
    step = size - overlap
    lengths = {0, 1, size - 1, size, size + 1, size + step, size + step + 1, 3 * size, 4 * step + overlap}
    texts = []
    for n in sorted(lengths):
        for _ in range(4):
            body = "".join(rnd.choice("ab \n😀é") for _ in range(max(0, n - 2)))
            texts.append(("x" + body + "y")[: max(0, n)])
    texts.append("x" + " " * (3 * size) + "y" if size > 100 else "x" + "\n \n" * size + "y")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: (r["t"], r["w"]) for r in df.select(
        "i", X.normalize_ws(F.col("t")).alias("t"), chunk_array(F.col("t"), size, overlap).alias("w")
    ).collect()}
    for text, made in got.values():
        assert made == windows_by_hand(text, size, overlap)


@pytest.mark.parametrize("size,overlap", [(10, 10), (10, 11), (0, 0), (10, -1)])
def test_bad_windows_raise(size, overlap):
    with pytest.raises(ValueError):
        check_window(size, overlap)


def test_chunk_documents_defaults(spark):
    rows = [
        ("web", " u ", "", "body", None, {"doc_id": "mine", "k": "v"}, None),
        ("web", None, None, "body", "2024-01-01", None, " given "),
        ("web", "u", "t", " \n ", None, None, None),
        ("web", "u", "t", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "source_type string, url string, title string, raw_text string, "
                                     "date string, extra map<string,string>, doc_id string")
    out = {r["title"]: r for r in chunk_documents(df).collect()}
    assert set(out) == {"u", "document"}
    assert out["u"]["extra"] == {"doc_id": "mine", "k": "v", "source_type": "web"}
    assert out["document"]["chunk_id"] == "web_ given _000"
    assert out["document"]["extra"] == {"doc_id": " given ", "source_type": "web"}
