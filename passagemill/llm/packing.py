"""Packing by cutting-stock column generation.

Documents become token ids, each followed by an end id, and are cut into whole
pieces of the sequence length, one piece that is a multiple of ``GRID`` and one
shorter tail, so that few lengths occur.  Only their histogram reaches the
driver.  There a linear program over patterns is solved by column generation: a
knapsack dynamic program prices new patterns against the duals until the bound
is met.  Patterns are rounded down, what is left is packed best fit first, and
the copies of every pattern are dealt to the pieces by their rank within their
length.

Cases: a null or empty text is the end id alone; repeated rows and ids are
pieces of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.common import parts_of, ragged, text_bytes, worker_cache
from passagemill.session import materialize

SEQUENCE = 1024
GRID = 32  # what a document leaves after whole sequences is cut at a multiple of it
TOLERANCE = 0.002  # gap between the linear program and its bound at which to stop
CACHED_UNITS = 400_000  # of a worker's cache; beyond it starts anew
PART_TEXT = 2 << 20  # bytes of texts encoded together
RUN_UNITS = 1_000  # new units that stand in one run
RUNS = 32  # runs encoded together; the tokenizer keeps about 100 bytes for each id of them
RANK_ROWS = 50_000  # pieces ranked together
SPACE_RUN = re.compile(r"\s ")

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"


LETTER, DIGIT, MARK, BREAK, SPACE, ODD = range(6)


def byte_classes() -> np.ndarray:
    """Classes of bytes as the tokenizer's pattern takes them apart; Latin letters have lead bytes C3 to C9.

    Whatever else, the apostrophe included, which may begin a contraction, is odd.
    """
    out = np.full(256, ODD, np.uint8)
    out[33:127] = MARK
    out[ord("0") : ord("9") + 1] = DIGIT
    for low, high in ("AZ", "az"):
        out[ord(low) : ord(high) + 1] = LETTER
    out[0x80:0xC0] = out[0xC3:0xCA] = LETTER
    out[ord("'")], out[ord("\n")], out[ord(" ")] = ODD, BREAK, SPACE
    return out


def byte_letters() -> np.ndarray:
    """The letter (UTF-16) that stands for each byte in a byte-level vocabulary."""
    out = np.arange(256, dtype="<u2")
    shown = np.r_[33:127, 161:173, 174:256]
    rest = np.setdiff1d(np.arange(256), shown)
    out[rest] = 256 + np.arange(len(rest))
    return out


class Encoder:
    """Whole texts to ids of a byte-level tokenizer, units encoded once.

    Units are what the tokenizer's pattern takes apart and encodes one by one:
    runs of letters, digits or marks, with the space before them, and line breaks
    between such runs.  They are found for all texts at once by the classes of
    their bytes; Arrow tells them apart, so Python sees each once per call.  New
    ones go to the tokenizer's model in the letters that stand for their bytes,
    as runs of text, which the byte lengths of their ids cut again.  A word with
    anything else in it is one unit and goes through the whole tokenizer.
    Texts with white space before a space or at an end are encoded uncut, and so
    are texts with the literal of an added token, which the tokenizer takes out
    first, and all texts if the tokenizer has another pattern.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        split = self.tokenizer.pre_tokenizer
        self.cuts = (
            isinstance(split, ByteLevel) and split.use_regex and not split.add_prefix_space
            and self.tokenizer.normalizer is None and self.tokenizer.truncation is None and self.tokenizer.padding is None
        )
        self.units = Tokenizer(self.tokenizer.model)  # the same model, for units in the letters of their bytes
        self.units.pre_tokenizer = WhitespaceSplit()
        names = self.tokenizer.get_vocab()
        self.width = np.zeros(max(names.values()) + 1, np.int64)
        for name, number in names.items():
            self.width[number] = len(name)  # one letter stands for one byte
        self.kinds, self.letters = byte_classes(), byte_letters()
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint16)
        self.end = np.zeros(1 << 16, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, straight from the tokenizer."""
        return [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def keep(self, units: list[bytes], flat: np.ndarray, ends: np.ndarray) -> None:
        """Remembers the ids of units, given in a row."""
        if self.ids.dtype == np.uint16 and flat.max(initial=0) > 65535:
            self.ids = self.ids.astype(np.uint32)
        base = len(self.known)
        used = int(self.end[base])
        if used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (used + len(flat)))
        if base + len(units) >= len(self.end):
            self.end = np.resize(self.end, 2 * (base + len(units)))
        self.ids[used : used + len(flat)] = flat
        self.end[base + 1 : base + len(units) + 1] = used + ends
        self.known.update(zip(units, range(base, base + len(units))))

    def add(self, units: list[bytes]) -> None:
        """Encodes and remembers units of one class each."""
        for low in range(0, len(units), RUN_UNITS * RUNS):
            some = units[low : low + RUN_UNITS * RUNS]
            size = np.fromiter(map(len, some), np.int64, len(some))
            letters = np.insert(self.letters[np.frombuffer(b"".join(some), np.uint8)], np.cumsum(size) - size, ord(" "))
            cuts = np.r_[0, np.cumsum(size + 1)][[*range(0, len(some), RUN_UNITS), len(some)]]
            runs = [letters[a:b].tobytes().decode("utf-16-le") for a, b in zip(cuts[:-1], cuts[1:])]
            coded = self.units.encode_batch_fast(runs, add_special_tokens=False)
            flat = np.concatenate([np.array(e.ids, np.int64) for e in coded])
            self.keep(some, flat, np.searchsorted(np.cumsum(self.width[flat]), np.cumsum(size)) + 1)

    def starts(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where units start in texts that start at ``first``, and which starts are those of odd words."""
        kind = self.kinds[data]
        sign = (data[1:] == 0x97) | (data[1:] == 0xB7)  # the signs of multiplication and division, C3 97 and C3 B7
        sign &= data[:-1] == 0xC3
        kind[1:][sign] = ODD
        start = np.ones(len(data), bool)
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        after = kind[:-1] == SPACE  # stands with what follows it
        start[1:] &= ~after
        start[first] = True
        breaks = np.flatnonzero(kind == BREAK)  # neither first nor last in a text
        odd = np.r_[np.flatnonzero(kind == ODD), breaks[(kind[breaks - 1] >= BREAK) | (kind[breaks + 1] >= BREAK)]]
        if not len(odd):
            return np.flatnonzero(start), odd
        word = kind == SPACE
        word[first] = True
        word = np.r_[np.flatnonzero(word), len(data)]
        odd = np.unique(np.searchsorted(word, odd, side="right") - 1)
        start[ragged(word[odd] + 1, word[odd + 1] - word[odd] - 1)] = False
        return np.flatnonzero(start), word[odd]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each."""
        if len(self.known) > CACHED_UNITS:
            self.clear()
        uncut = [
            not self.cuts or t[:1].isspace() or t[-1:].isspace() or SPACE_RUN.search(t) is not None
            or (self.added and self.added.search(t)) is not None
            for t in texts
        ]
        heads = self.whole([t if whole else "" for t, whole in zip(texts, uncut)])
        rest = pa.array(["" if whole else t for t, whole in zip(texts, uncut)], pa.large_string())
        bounds = np.frombuffer(rest.buffers()[1], np.int64)[: len(rest) + 1]
        data = np.frombuffer(rest.buffers()[2] or b"", np.uint8)[: bounds[-1]]
        low, odd = self.starts(data, bounds[:-1][np.diff(bounds) > 0])
        parts = pa.Array.from_buffers(pa.large_binary(), len(low), [None, pa.py_buffer(np.r_[low, len(data)]), pa.py_buffer(data)])
        coded = parts.dictionary_encode()
        code, units, known = coded.indices.to_numpy(), coded.dictionary.to_pylist(), self.known
        words = {units[n] for n in np.unique(code[np.searchsorted(low, odd)]).tolist()}
        fresh = [w for w in words if w not in known]
        if fresh:
            own = self.whole([w.decode() for w in fresh])
            self.keep(fresh, np.concatenate(own), np.cumsum(np.fromiter(map(len, own), np.int64, len(own))))
        fresh = [u for u in units if u not in known]
        if fresh:
            self.add(fresh)
        at = np.fromiter(map(known.__getitem__, units), np.int64, len(units))
        begin, size = self.end[at], self.end[at + 1] - self.end[at]
        sizes = size[code]
        ends = np.r_[0, np.cumsum(sizes)][np.searchsorted(low, bounds)]
        tail = self.ids[ragged(begin[code], sizes)]
        first = np.fromiter(map(len, heads), np.int64, len(heads))
        ids = np.insert(tail.astype(np.uint32), np.repeat(ends[:-1], first), np.concatenate([np.zeros(0, np.int64), *heads]))
        return ids, first + np.diff(ends)


def token_pieces(docs: DataFrame, tokenizer: str, seq_len: int = SEQUENCE, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their ids (little-endian, four bytes each)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(f"encoder_{tokenizer}", lambda: Encoder(tokenizer))
        for whole in batches:
            for batch in parts_of(whole, "text", PART_TEXT):
                texts = batch.column(1).to_pylist()
                ids, counts = encoder.encode([t or "" for t in texts])
                ends = np.cumsum(counts)
                tokens = np.insert(ids.astype("<u4"), ends, end_id)
                totals = counts + 1
                whole_pieces, rest = np.divmod(totals, seq_len)
                grid, tail = rest - rest % GRID, rest % GRID
                number = whole_pieces + (grid > 0) + (tail > 0)
                doc = np.repeat(np.arange(len(totals)), number)
                start = ragged(np.zeros(len(totals), np.int64), number) * seq_len
                last = np.cumsum(number) - 1
                start[last[tail > 0]] = (totals - tail)[tail > 0]
                length = np.diff(np.r_[start, 0])
                length[last] = (totals - start[last])
                offsets = np.r_[0, np.cumsum(length * 4)]
                buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(tokens.tobytes())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length),
                        pa.Array.from_buffers(pa.binary(), len(doc), buffers), pa.array(totals[doc]),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def best_pattern(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the dearest pattern, as counts per length."""
    keep = np.flatnonzero(prices > 1e-12)
    sizes, values = lengths[keep], prices[keep]
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1, np.int64)
    order = np.argsort(sizes, kind="stable")
    keep, sizes, values = keep[order], sizes[order], values[order]
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if n := fits[room]:
            gain = values[:n] + best[room - sizes[:n]]
            top = int(gain.argmax())
            if gain[top] > best[room] + 1e-12:
                best[room], choice[room] = gain[top], top
    counts = np.zeros(len(lengths))
    room = capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[keep[choice[room]]] += 1
            room -= int(sizes[choice[room]])
    return float(best[capacity]), counts


def column_generation(
    lengths: np.ndarray, demand: np.ndarray, capacity: int, tolerance: float = TOLERANCE
) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (columns) and their fractional numbers, and the proven gap.

    Revised simplex with an explicit inverse; the first basis has one pattern
    for each length, filled with that length alone.
    """
    number = len(lengths)
    basis = np.diag((capacity // lengths).astype(float))
    inverse = np.diag(1.0 / (capacity // lengths))
    amount = inverse @ demand
    bound = max(float((lengths * demand).sum() / capacity), 1e-9)
    for step in range(60 * number + 200):
        prices = inverse.sum(axis=0)
        value, column = best_pattern(lengths, prices, capacity)
        bound = max(bound, float(prices @ demand) / max(value, 1.0))
        if value <= 1 + 1e-9 or amount.sum() <= bound * (1 + tolerance):
            break
        direction = inverse @ column
        positive = direction > 1e-9
        if not positive.any():
            break
        ratio = np.full(number, np.inf)
        ratio[positive] = amount[positive] / direction[positive]
        leave = int(ratio.argmin())
        basis[:, leave] = column
        pivot = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, pivot)
        inverse[leave] = pivot
        if step % 200 == 199:
            inverse = np.linalg.inv(basis)
        amount = np.maximum(inverse @ demand, 0.0)
    return basis, amount, float(amount.sum() / bound - 1)


def rest_patterns(rest: Counter, capacity: int) -> Counter:
    """Best fit, longest first, for the few pieces that rounding leaves."""
    room_of: dict[int, list[list[int]]] = {}
    bins: list[list[int]] = []
    for length in sorted(rest, reverse=True):
        for _ in range(rest[length]):
            room = next((r for r in range(length, capacity) if room_of.get(r)), None)
            if room is None:
                bins.append([])
                target, room = bins[-1], capacity
            else:
                target = room_of[room].pop()
            target.append(length)
            room_of.setdefault(room - length, []).append(target)
    return Counter(tuple(sorted(b, reverse=True)) for b in bins)


def patterns(histogram: dict[int, int], capacity: int = SEQUENCE, tolerance: float = TOLERANCE) -> Counter:
    """How often each pattern (lengths, longest first) is used; covers the histogram exactly."""
    out: Counter = Counter()
    rest = Counter({k: v for k, v in histogram.items() if v and k != capacity})
    if histogram.get(capacity):
        out[(capacity,)] = histogram[capacity]
    if rest:
        lengths = np.array(sorted(rest), np.int64)
        demand = np.array([rest[int(n)] for n in lengths], float)
        columns, amount, _ = column_generation(lengths, demand, capacity, tolerance)
        for j, number in enumerate(np.floor(amount + 1e-9).astype(int)):
            used = [(int(n), int(round(c))) for n, c in zip(lengths, columns[:, j]) if c > 0.5]
            number = min([int(number), *(rest[n] // c for n, c in used)])
            if number > 0:
                out[tuple(n for n, c in reversed(used) for _ in range(c))] += number
                for n, c in used:
                    rest[n] -= number * c
        out += rest_patterns(+rest, capacity)
    return out


def slots(plan: Counter) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end of ranks, first sequence, pieces per sequence, offset).

    Bounded by the sequence length alone: a basis has a pattern per length, and
    rounding leaves less than one copy of each for the rest.
    """
    rank: Counter = Counter()
    out, sequence = [], 0
    for pattern, number in sorted(plan.items(), reverse=True):
        offset = 0
        for length, per in sorted(Counter(pattern).items(), reverse=True):
            low = rank[length]
            rank[length] = low + per * number
            out.append((length, low, rank[length], sequence, per, offset))
            offset += length * per
        sequence += number
    return out


def assign(pieces: DataFrame, seq_len: int = SEQUENCE, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (``doc_id, start, length`` and any more).

    ``pieces`` is read three times: pass a stored table.  A length that a third
    of all pieces share is ranked in many buckets, not in one task.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    total = sum(histogram.values())
    plan = spark.createDataFrame(
        slots(patterns(histogram, seq_len, tolerance)),
        "_length long, _low long, _high long, _sequence long, _per long, _offset long",
    )
    buckets = max(16, -(-total // RANK_ROWS))
    bucket = F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int")
    marked = pieces.withColumn("_bucket", bucket)
    before = marked.groupBy("length", "_bucket").agg(F.count("*").alias("_n")).select(
        F.col("length").alias("_l"), F.col("_bucket").alias("_b"),
        (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"),
    )
    own = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "doc_tokens")
    ranked = marked.withColumn("_rank", F.row_number().over(own) - 1).join(
        before, (F.col("length") == F.col("_l")) & (F.col("_bucket") == F.col("_b"))
    ).withColumn("_rank", F.col("_rank") + F.col("_before"))
    placed = ranked.join(
        F.broadcast(plan),
        (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")),
    )
    turn = F.col("_rank") - F.col("_low")
    return placed.select(
        *pieces.columns,
        (F.col("_sequence") + F.floor(turn / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + turn % F.col("_per") * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, seq_len: int = SEQUENCE) -> DataFrame:
    """Pieces with their ids, sequence and offset; group by ``sequence_id`` for the sequences."""
    return assign(materialize(token_pieces(docs, tokenizer, seq_len), "pieces"), seq_len)


def pack_digest(docs: DataFrame, tokenizer: str, seq_len: int = SEQUENCE) -> DataFrame:
    """The same with a checksum in place of the ids, so that no ids are stored."""
    pieces = token_pieces(docs, tokenizer, seq_len).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return assign(materialize(pieces, "pieces"), seq_len).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
