"""Substring dedup by relative Lempel-Ziv parsing against reference blocks.

Every window of ``WINDOW`` words has an anchor (its leftmost four-word gram of
least hash); only windows whose anchor occurs twice in the corpus can repeat.
The phrase around such an anchor - the windows that share it - goes to the block
of the anchor's hash.  A block indexes all its phrases by their windows, with
the least id that has each; every phrase is then factored greedily: a window
found in an earlier document opens a factor, which grows while the next words
continue in an earlier document, and the window starts at the factor's end are
checked one by one before the parse goes on.  As equal windows have equal
anchors, each phrase meets every phrase that can match it in one block.

Phrases that are equal within a task travel with their words once, with the least
id; the others are settled on the spot.  Settled ones are dealt evenly over blocks
of their own and pass through as Arrow columns, so a passage that a third of all
documents share does not gather in one block.  Around an anchor with more than
``HOT`` phrases, whose edges differ from document to document, every window is a
phrase of its own and goes to the block of its own hash.

Cases: null and blank texts have no words; a null id counts as later than all;
rows of one id do not remove each other; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import (
    MAX_ANCHOR_UNITS, PART_BYTES, among, anchor_runs, key_counts, merged, parts_of, repeated_keys, shipped_keys, text_bytes, text_key,
)

WINDOW = 13
GRAM = 4
BLOCK_PHRASES = 40_000  # phrases of a block, about
LAST = (1 << 63) - 1  # stands for a null id
HOT = 1_000  # phrases of an anchor beyond which its windows are dealt one by one
SEEN = 50_000  # phrases a task remembers with their least id

PHRASES = "block int, key long, doc long, text_key binary, first long, last long, phrase binary"


def _parts(batch: pa.RecordBatch, window: int):
    """(rows, words of each text, place of the first word), very long texts in overlapping pieces."""
    for part in parts_of(batch, "text", PART_BYTES):
        texts = [t.split() for t in part.column(part.schema.get_field_index("text")).to_pylist()]
        if len(texts) == 1 and len(texts[0]) > MAX_ANCHOR_UNITS:
            step = MAX_ANCHOR_UNITS - window + 1
            for low in range(0, max(1, len(texts[0]) - window + 1), step):
                yield part, [texts[0][low : low + MAX_ANCHOR_UNITS]], [low]
        else:
            yield part, texts, [0] * len(texts)


def _runs(texts: list[list[bytes]], window: int):
    from xxhash import xxh64_intdigest

    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    units = np.fromiter((xxh64_intdigest(w) for t in texts for w in t), np.uint64, int(lengths.sum()))
    return anchor_runs(units, lengths, GRAM, window)


def factor(words: list[bytes], first: int, last: int, doc: int, index: dict[bytes, int], window: int) -> list[tuple[int, int]]:
    """Greedy parse of one phrase: spans of words under windows of an earlier document."""
    spans = []
    at, starts = 0, last - first + 1
    while at < starts:
        if index[b" ".join(words[at : at + window])] >= doc:
            at += 1
            continue
        begin = at
        while at < starts and index[b" ".join(words[at : at + window])] < doc:
            at += 1  # the factor grows; at its end each window start is checked
        spans.append((first + begin, first + at - 1 + window))
    return spans


def dealt_phrases(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Phrases around repeated anchors with their block; settled ones have no words and blocks below zero."""
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), text_key().alias("text_key"),
        text_bytes().alias("text"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part, _ in _parts(batch, window):
                yield key_counts(_runs(part, window), lambda i: None)

    repeated = repeated_keys(texts.mapInArrow(count, "key long, n long, gram binary"))
    known = shipped_keys(repeated)
    often = repeated.where(F.col("n") > HOT).select("key").toArrow().column(0).to_numpy()  # one in HOT phrases at most
    hot = docs.sparkSession.sparkContext.broadcast(np.sort(often))
    total = repeated.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_PHRASES))

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        seen: dict[tuple[int, bytes], int] = {}
        turn = 0

        def deal(k: int, phrase: bytes, places: list, single: bool) -> Iterator[tuple]:
            nonlocal turn
            least = min(min(places)[0], seen.get((k, phrase), LAST))
            seen[k, phrase] = least
            for one in places:
                # the least id travels with the words; later ones are settled
                if one[0] > least:
                    turn += 1
                    yield -1 - turn % blocks, k, *one, None
                elif single:
                    words = phrase.split(b" ")
                    for n in range(len(words) - window + 1):
                        own = (one[0], one[1], one[2] + n, one[2] + n)
                        yield from deal(k, b" ".join(words[n : n + window]), [own], False)
                else:
                    yield (xxh64_intdigest(phrase) if k in own_hot else k) % blocks, k, *one, phrase

        for batch in batches:
            for rows, part, base in _parts(batch, window):
                text, first, end, _, keys = _runs(part, window)
                kept = np.flatnonzero(among(keys, known))
                if not len(kept):
                    continue
                docs_of, texts_of = rows.column(0).to_pylist(), rows.column(1).to_pylist()
                found: dict[tuple[int, bytes], list] = {}
                for k, t, a, e in zip(*(x[kept].tolist() for x in (keys.view(np.int64), text, first, end))):
                    phrase = b" ".join(part[t][a : e - 1 + window])
                    found.setdefault((k, phrase), []).append((docs_of[t], texts_of[t], base[t] + a, base[t] + e - 1))
                own_hot = set(keys.view(np.int64)[kept][among(keys[kept], hot)].tolist())
                out = [row for (k, phrase), places in found.items() for row in deal(k, phrase, places, k in own_hot)]
                if len(seen) > SEEN:
                    seen.clear()
                columns = list(zip(*out))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
                names = ["block", "key", "doc", "text_key", "first", "last", "phrase"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    found = texts.mapInArrow(phrases, PHRASES)
    if known is None:
        found = found.join(repeated.select("key"), "key", "left_semi").select(*found.columns)
    return found


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc, text_key, low, high``: words of each row under windows of an earlier document."""
    found = dealt_phrases(docs, window)
    spans = pa.schema([("doc", pa.int64()), ("text_key", pa.binary()), ("low", pa.int64()), ("high", pa.int64())])

    def parse(key: tuple, block: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            high = pa.compute.add(block.column("last"), window)
            return pa.table([block.column("doc"), block.column("text_key"), block.column("first"), high], schema=spans)
        rows = sorted(zip(*(block.column(c).to_pylist() for c in ("key", "doc", "text_key", "first", "last", "phrase"))), key=lambda r: r[:2])
        out, low = [], 0
        while low < len(rows):
            high = low
            while high < len(rows) and rows[high][0] == rows[low][0]:
                high += 1
            index: dict[bytes, int] = {}
            own = []
            for _, doc, tkey, first, last, phrase in rows[low:high]:
                words = phrase.split(b" ")
                own.append((words, doc, tkey, first, last))
                for i in range(last - first + 1):
                    index.setdefault(b" ".join(words[i : i + window]), doc)  # ids ascend
            if len(own) > 1:
                for words, doc, tkey, first, last in own:
                    out += [(doc, tkey, a, b) for a, b in factor(words, first, last, doc, index, window)]
            low = high
        columns = list(zip(*out)) if out else [(), (), (), ()]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, spans)], schema=spans)

    return found.groupBy("block").applyInArrow(parse, "doc long, text_key binary, low long, high long")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (words left, joined by one space, UTF-8) of every row."""
    spans = repeated_spans(docs, window).groupBy("doc", "text_key").agg(
        F.collect_list(F.struct("low", "high")).alias("spans")
    )
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), text_key().alias("_key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_doc"),
    )
    joined = rows.join(spans, (F.col("_doc") == F.col("doc")) & (F.col("_key") == F.col("text_key")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, removed, kept = [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = text.split()
                runs = merged([(s["low"], s["high"]) for s in found]) if found else []
                number.append(len(words))
                removed.append(sum(b - a for a, b in runs))
                edges = [0, *(x for run in runs for x in run), len(words)]
                left = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(number, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return joined.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary")
