"""Stable content-derived identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagemill import values as V


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def content_hash(c: Column) -> Column:
    return F.sha1(_text(c))


def doc_id(source_type: Column, url: Column, title: Column, text: Column) -> Column:
    bar = F.lit("|")
    key = F.concat(
        _text(source_type), bar, _text(url), bar, _text(title), bar,
        F.substring(content_hash(text), 1, V.CONTENT_HASH_LEN),
    )
    return F.substring(F.sha1(key), 1, V.DOC_ID_LEN)


def chunk_id(source_type: Column, doc: Column, part: Column) -> Column:
    return F.format_string("%s_%s_%03d", source_type, doc, part)


def message_key(channel: Column, msg_id: Column) -> Column:
    return F.concat(F.lit(V.MESSAGE_KEY_PREFIX), channel, F.lit(":"), msg_id.cast("string"))


def message_url(channel: Column, msg_id: Column) -> Column:
    return F.concat(F.lit(V.PERMALINK_PREFIX), channel, F.lit("/"), msg_id.cast("string"))


def message_title(channel: Column, msg_id: Column) -> Column:
    return F.concat(F.lit(V.MESSAGE_TITLE_PREFIX), channel, F.lit(" / "), msg_id.cast("string"))
