"""Repeated substrings by a distributed merge sort of sampled suffixes.

Every window of ``LENGTH`` bytes has an anchor, the leftmost 64-byte gram of
least hash in it; equal windows have equal anchors at equal places.  So it is
enough to sort the suffixes that start at anchors, and only those whose gram
occurs twice in the corpus (about one in a thousand bytes of text).

Each task sorts its suffixes (equal ones become one with a count), cuts the run
at splitters sampled from the grams, and sends front-coded blocks: of each
suffix its common prefix with the one before, and the rest.  A range merges its
blocks with a loser tree that carries common prefixes with the last winner, so
that no known prefix is compared again.  Neighbours in the merged order give the
longest common prefix of every suffix.  A suffix whose whole reach (all windows
of its anchor) occurs twice is settled; the others are settled window by window
among the suffixes of the same gram, for the windows their neighbours can reach.

Cases: null and empty texts lose nothing; repeated rows lose everything if long
enough; ties need no rule, all copies go; an empty table gives no rows; other
columns are ignored, or kept by ``cut_documents``.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import (
    MAX_ANCHOR_UNITS, PART_BYTES, among, anchor_runs, key_counts, merged, parts_of, repeated_keys, shipped_keys, text_bytes, text_key,
)

LENGTH = 400
GRAM = 64
RANGE_SUFFIXES = 6_000  # suffixes of a range, about
SPLITTERS = 4_096  # grams sampled to choose ranges
RUN_BYTES = 24 << 20  # of suffixes sorted at once in a task
UNIT_HASHES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[int]]]:
    """Parts of a batch, very long texts cut into pieces that overlap by a window less one byte."""
    for part in parts_of(batch, "text", PART_BYTES):
        texts = part.column(part.schema.get_field_index("text")).to_pylist()
        if len(texts) == 1 and len(texts[0]) > MAX_ANCHOR_UNITS:
            step = MAX_ANCHOR_UNITS - LENGTH + 1
            for low in range(0, max(1, len(texts[0]) - LENGTH + 1), step):
                yield part, [texts[0][low : low + MAX_ANCHOR_UNITS]], [low]
        else:
            yield part, texts, [0] * len(texts)


def _runs(texts: list[bytes], length: int):
    joined = np.frombuffer(b"".join(texts), np.uint8)
    return anchor_runs(UNIT_HASHES[joined], np.fromiter(map(len, texts), np.int64, len(texts)), GRAM, length)


def common_prefix(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, known to be at least ``start``."""
    size = min(len(a), len(b))
    x, y = a[start:size], b[start:size]
    if x == y:
        return size
    difference = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return size - (difference.bit_length() + 7) // 8


class LoserTree:
    """Merges sorted runs of (common prefix with the one before, suffix, item)."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes, object]]]):
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.head: list[tuple[bytes, object] | None] = []
        self.prefix = [0] * self.size  # with the last winner
        for run in runs:
            first = next(run, None)
            self.head.append(first and (first[1], first[2]))
        self.head += [None] * (self.size - len(runs))
        self.loser = [0] * self.size
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        won, lost = self._play(self._build(2 * node), self._build(2 * node + 1))
        self.loser[node] = lost
        return won

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's prefix becomes that with the winner."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if self.prefix[a] != self.prefix[b]:
            return (a, b) if self.prefix[a] > self.prefix[b] else (b, a)
        known = common_prefix(x[0], y[0], self.prefix[a])
        if x[0][known:] <= y[0][known:]:
            self.prefix[b] = known
            return a, b
        self.prefix[a] = known
        return b, a

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        while self.head[self.winner] is not None:
            run = self.winner
            suffix, item = self.head[run]
            yield self.prefix[run], suffix, item
            following = next(self.runs[run], None)
            if following is None:
                self.head[run] = None
            else:
                self.prefix[run], self.head[run] = following[0], (following[1], following[2])
            node, contender = (run + self.size) // 2, run
            while node:
                contender, self.loser[node] = self._play(contender, self.loser[node])
                node //= 2
            self.winner = contender


def front_coded(entries: list[tuple[bytes, bytes, int, int, bytes]]) -> bytes:
    """A block of sorted (suffix, left part, least distance, count, members)."""
    out, before = [], b""
    for suffix, left, low, count, members in entries:
        prefix = common_prefix(before, suffix, 0)
        out.append(struct.pack("<HHHHII", prefix, len(suffix) - prefix, len(left), low, count, len(members)))
        out += [suffix[prefix:], left, members]
        before = suffix
    return b"".join(out)


def decoded(block: bytes) -> Iterator[tuple[int, bytes, tuple[bytes, int, int, bytes]]]:
    at, before = 0, b""
    while at < len(block):
        prefix, rest, left, low, count, members = struct.unpack_from("<HHHHII", block, at)
        at += 16
        before = before[:prefix] + block[at : at + rest]
        at += rest
        yield prefix, before, (block[at : at + left], low, count, block[at + left : at + left + members])
        at += left + members


class Class:
    """Suffixes with the same reach: all windows of an anchor, byte for byte."""

    __slots__ = ("suffix", "left", "low", "count", "members", "known")

    def __init__(self, suffix: bytes, left: bytes, low: int):
        self.suffix, self.left, self.low = suffix, left, low
        self.count, self.members, self.known = 0, [], 0

    def spans(self, distances: list[int] | None, length: int) -> Iterator[tuple[bytes, int, int]]:
        """Bytes covered by windows at the given distances before the anchor; None: at all."""
        if distances is None:
            runs = [(self.low, len(self.left))]
        else:
            runs, start = [], 0
            for i in range(1, len(distances) + 1):
                if i == len(distances) or distances[i] != distances[i - 1] + 1:
                    runs.append((distances[start], distances[i - 1]))
                    start = i
        for one in self.members:
            for key, anchor in struct.iter_unpack("<16sq", one):
                for near, far in runs:
                    yield key, anchor - far, anchor - near + length


def settle(group: list[Class], length: int) -> Iterator[tuple[bytes, int, int]]:
    """Repeated spans among all suffixes of one gram, in sorted order.

    ``known`` is each class's longest common prefix with any other class.  All
    members of one distance are compared at a time, so memory follows the group.
    """
    from xxhash import xxh3_128_digest

    repeated: dict[int, list[int]] = defaultdict(list)
    reach = [max(c.low, length - c.known) for c in group]
    if len(group) > 1:
        for d in range(min(reach), max(len(c.left) for c in group) + 1):
            seen: dict[bytes, int] = {}
            for n, c in enumerate(group):
                if reach[n] <= d <= len(c.left):
                    window = xxh3_128_digest(c.left[len(c.left) - d :] + c.suffix[: length - d])
                    other = seen.setdefault(window, n)
                    if other != n:
                        for m in (other, n):
                            if group[m].count == 1 and (not repeated[m] or repeated[m][-1] != d):
                                repeated[m].append(d)
    for n, c in enumerate(group):
        if c.count > 1:
            yield from c.spans(None, length)
        elif repeated[n]:
            yield from c.spans(repeated[n], length)


def merge_blocks(blocks: list[bytes], length: int) -> Iterator[tuple[bytes, int, int]]:
    """Repeated spans of one range: (text key, first byte, end)."""
    group: list[Class] = []
    by_reach: dict[tuple[bytes, bytes, int], Class] = {}
    last: Class | None = None
    for prefix, suffix, (left, low, count, members) in LoserTree([decoded(b) for b in blocks]):
        if prefix < GRAM and group:
            yield from settle(group, length)
            group, by_reach, last = [], {}, None
        own = by_reach.get((suffix, left, low))
        if own is None:
            own = by_reach[suffix, left, low] = Class(suffix, left, low)
            group.append(own)
        if last is not None and last is not own:
            last.known, own.known = max(last.known, prefix), max(own.known, prefix)
        own.count += count
        own.members.append(members)
        last = own
    if group:
        yield from settle(group, length)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``text_key, low, high``: bytes of each distinct text under a string that starts elsewhere too."""
    if length < 2 * GRAM:
        raise ValueError(f"strings of at least {2 * GRAM} bytes")
    texts = docs.select(text_key().alias("text_key"), text_bytes().alias("text")).where(F.octet_length("text") >= length)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part, _ in _parts(batch):
                runs = _runs(part, length)
                yield key_counts(runs, lambda i: part[runs[0][i]][runs[3][i] : runs[3][i] + GRAM])

    repeated = repeated_keys(texts.mapInArrow(count, "key long, n long, gram binary"))
    known = shipped_keys(repeated)
    total = repeated.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, -(-total // RANGE_SUFFIXES))
    sample = repeated.where("gram is not null").select("gram").orderBy(F.xxhash64("key")).limit(SPLITTERS).collect()
    sample = sorted(bytes(r[0]) for r in sample)
    splitters = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []

    def reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Suffixes of the anchors, cut to what windows of the anchor can see."""
        for batch in batches:
            for rows, part, base in _parts(batch):
                text, first, end, anchor, keys = _runs(part, length)
                kept = np.flatnonzero(among(keys, known))
                if not len(kept):
                    continue
                ids = rows.column(0).to_pylist()
                lists = [a[kept].tolist() for a in (text, first, end, anchor)]
                suffix, left, low, key, place = [], [], [], [], []
                for t, a, e, p in zip(*lists):
                    suffix.append(part[t][p : e - 1 + length])
                    left.append(part[t][a:p])
                    low.append(p - e + 1)
                    key.append(ids[t])
                    place.append(base[t] + p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[kept].view(np.int64)), pa.array(suffix, pa.binary()), pa.array(left, pa.binary()),
                     pa.array(low, pa.int32()), pa.array(key, pa.binary()), pa.array(place, pa.int64())],
                    names=["key", "suffix", "left", "low", "text_key", "place"],
                )

    def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        held: dict[tuple[bytes, bytes, int], list] = {}
        size = 0

        def run() -> pa.RecordBatch:
            blocks: dict[int, list] = defaultdict(list)
            for suffix, left, low in sorted(held):
                number, members = held[suffix, left, low]
                packed = b"".join(struct.pack("<16sq", k, p) for k, p in members)
                blocks[bisect_right(splitters, suffix[:GRAM])].append((suffix, left, low, number, packed))
            return pa.RecordBatch.from_arrays(
                [pa.array(list(blocks), pa.int32()), pa.array([front_coded(b) for b in blocks.values()], pa.binary())],
                names=["range", "block"],
            )

        for batch in batches:
            for suffix, left, low, key, place in zip(*(c.to_pylist() for c in batch.columns[1:])):
                one = held.setdefault((suffix, left, low), [0, set()])
                one[0] += 1
                one[1].add((key, place))
                size += len(suffix) + len(left) + 200
            if size > RUN_BYTES:
                yield run()
                held, size = {}, 0
        if held:
            yield run()

    def merge(key: tuple, blocks: pa.Table) -> pa.Table:
        spans = list(merge_blocks(blocks.column("block").to_pylist(), length))
        keys, lows, highs = zip(*spans) if spans else ((), (), ())
        return pa.table({
            "text_key": pa.array(keys, pa.binary()), "low": pa.array(lows, pa.int64()), "high": pa.array(highs, pa.int64())
        })

    if known is None:
        found = texts.mapInArrow(reaches, "key long, suffix binary, left binary, low int, text_key binary, place long")
        found = found.join(repeated.select("key"), "key", "left_semi")
        runs = found.mapInArrow(sorted_runs, "range int, block binary")
    else:
        runs = texts.mapInArrow(lambda batches: sorted_runs(reaches(batches)), "range int, block binary")
    return runs.groupBy("range").applyInArrow(merge, "text_key binary, low long, high long").distinct()


def cut_documents(docs: DataFrame, length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """The rows with ``n_removed``, ``n_spans`` and ``kept`` (the bytes left, or their whole characters) added, in place of columns of these names."""
    spans = repeated_spans(docs, length).groupBy("text_key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    kept_names = [c for c in docs.columns if c not in ("n_removed", "n_spans", "kept")]
    rows = docs.select(F.struct(*kept_names).alias("given"), text_key().alias("key"), text_bytes().alias("bytes"))
    pairs = rows.join(spans, F.col("key") == F.col("text_key"), "left").select("given", "spans", "bytes")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, "bytes", PART_BYTES):  # lists and copies of one part at a time
                removed, number, kept = [], [], []
                for found, text in zip(part.column("spans").to_pylist(), part.column("bytes").to_pylist()):
                    runs = merged([(s["low"], s["high"]) for s in found]) if found else []
                    edges = [0, *(x for run in runs for x in run), len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])) if runs else text)
                    removed.append(len(text) - len(kept[-1]))
                    number.append(len(runs))
                added = [pa.array(removed, pa.int64()), pa.array(number, pa.int64())]
                left = [k.decode("utf-8", "ignore") for k in kept] if as_text else kept
                added.append(pa.array(left, pa.string() if as_text else pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column("given"), *added], names=["given", "n_removed", "n_spans", "kept"])

    schema = pairs.select("given").schema.add("n_removed", "long").add("n_spans", "long")
    schema = schema.add("kept", "string" if as_text else "binary")
    return pairs.mapInArrow(cut, schema).select("given.*", "n_removed", "n_spans", "kept")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return cut_documents(rows, length).select("doc_id", F.octet_length(text_bytes()).cast("long").alias("n_bytes"), "n_removed", "n_spans", "kept")
