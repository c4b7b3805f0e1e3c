"""Conversation prefix trie: adaptive radix trees over fixed-width big-endian turn ids.

A turn's id is a 128-bit digest of role and text, read as a big-endian number, so
a rebuilt conversation is one byte key of 16 bytes a turn and key order is turn
order.  Keys are range-partitioned and sorted, copies spread by conversation id;
each task cuts its sorted keys into blocks of bounded size and puts each block
into an adaptive radix tree: inner nodes grow from 4 to 16, 48 and 256 children,
runs of bytes without a branch are compressed.  Only byte depths that end a turn
become trie nodes.

Nodes that lie on neither the first nor the last key of a block are complete.
The others are open: their blocks' shares are added up by node digest, and what
an open node lends to its ancestors is counted in one block only.

Cases: rows without ``conv_id`` take no part; null role and text are empty; equal
turn numbers follow the turns' ids; ``%`` keeps the sign of the id, as in SQL; a
conversation may end up turnless and is a member of the root only; repeated rows
are turns of their own; an empty table has no nodes; other columns are ignored.
One conversation's ids (20 bytes a turn) must fit a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.session import materialize

WIDTH = 16  # bytes of a turn id
FAMILY = 100  # conversations that share the first turns of one
HEADS = 6  # a conversation takes over up to HEADS - 1 turns
BLOCK_BYTES = 4 << 20  # of keys in one tree
BLOCK_MEMBERS = 1 << 17
FLUSH = 50_000  # rows of a batch handed on
CAPACITY = (4, 16, 48, 256)

SEQUENCES = "key binary, lens binary, conv_id long"
PARTS = (
    "kind int, block long, node binary, parent binary, chain int, shared boolean, size long, conv_id long, depth long, "
    "parent_conv_id long, n_convs long, n_children long, n_leaves long, weight long, distinct_size long, "
    "has_child boolean, ends string"
)
CLOSED, OPEN, MEMBERS = 0, 1, 2


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Each conversation as its turn ids and the lengths of its texts, first turns of its family's head put first."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    conv = F.col("conv_id").cast("long")
    rows = conversations.where("conv_id is not null").select(
        (conv - conv % FAMILY).alias("family"), conv.alias("conv_id"), F.col("turn").alias("turn"),
        F.substring(F.unhex(F.sha2(named, 256)), 1, WIDTH).alias("id"), F.length(text).alias("chars"),
        (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("int").alias("taken"),
    )
    dealt = rows.repartition("family").sortWithinPartitions(
        "family", F.col("conv_id") != F.col("family"), "conv_id", F.asc_nulls_first("turn"), "id"
    )
    return dealt.select("family", "conv_id", "id", "chars", "taken").mapInArrow(assemble, SEQUENCES)


def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order, families together and their head first, to one key per conversation."""
    head, own, current = (None, b"", b""), [], None
    done: list[tuple] = []

    def finish():
        nonlocal head
        family, conv, taken = current
        key, lens = (b"".join(part) for part in zip(*own))
        if head[0] != family:
            head = (family, b"", b"")
        if conv == family:
            head = (family, key[: WIDTH * HEADS], lens[: 4 * HEADS])
        first = min(taken, len(head[1]) // WIDTH)
        done.append((
            head[1][: WIDTH * first] + key[WIDTH * taken :], head[2][: 4 * first] + lens[4 * taken :], conv
        ))

    for batch in batches:
        if not batch.num_rows:
            continue
        family, conv, chars, taken = (
            batch.column(n).to_numpy(zero_copy_only=False) for n in ("family", "conv_id", "chars", "taken")
        )
        ids = b"".join(batch.column("id").to_pylist())
        lens = chars.astype("<i4").tobytes()
        cuts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]]).tolist()
        for low, high in zip(cuts, [*cuts[1:], len(conv)]):
            name = (int(family[low]), int(conv[low]), int(taken[low]))
            if current is not None and name[1] != current[1]:
                finish()
                own = []
            current = name
            own.append((ids[WIDTH * low : WIDTH * high], lens[4 * low : 4 * high]))
        if len(done) >= FLUSH // 10:
            yield _sequences(done)
            done = []
    if current is not None:
        finish()
    yield _sequences(done)


def _sequences(rows: list[tuple]) -> pa.RecordBatch:
    key, lens, conv = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.binary()), pa.array(lens, pa.binary()), pa.array(conv, pa.int64())],
        names=["key", "lens", "conv_id"],
    )


def common(a: bytes, b: bytes, start: int, limit: int) -> int:
    """End of the common prefix of both keys, equal up to ``start``, looked for up to ``limit``."""
    if a[start:limit] == b[start:limit]:
        return limit
    while limit - start > 1:
        middle = (start + limit) // 2
        if a[start:middle] == b[start:middle]:
            start = middle
        else:
            limit = middle
    return start


class Inner:
    """A branching at byte ``depth``; ``of`` names a key below it, ``end`` the key that ends here."""

    __slots__ = ("depth", "of", "end", "layout", "slots", "kids")

    def __init__(self, depth: int, of: int):
        self.depth, self.of, self.end = depth, of, -1
        self.layout = 0
        self.slots = bytearray()  # sorted bytes; from 48 on a slot + 1 for each byte; unused at 256
        self.kids: list = []

    def find(self, byte: int) -> int:
        """Place of the child in ``kids``, or -1."""
        if self.layout < 2:
            return self.slots.find(byte)
        if self.layout == 2:
            return self.slots[byte] - 1
        return byte if self.kids[byte] is not None else -1

    def add(self, byte: int, kid) -> None:
        if self.layout < 3 and len(self.kids) == CAPACITY[self.layout]:
            self.grow()
        if self.layout < 2:
            at = len(self.slots)
            while at and self.slots[at - 1] > byte:
                at -= 1
            self.slots.insert(at, byte)
            self.kids.insert(at, kid)
        elif self.layout == 2:
            self.kids.append(kid)
            self.slots[byte] = len(self.kids)
        else:
            self.kids[byte] = kid

    def grow(self) -> None:
        old, kids = self.slots, self.kids
        self.layout += 1
        if self.layout == 2:
            self.slots = bytearray(256)
            for n, byte in enumerate(old, 1):
                self.slots[byte] = n
        elif self.layout == 3:
            self.slots = bytearray()
            self.kids = [kids[n - 1] if n else None for n in old]

    def children(self) -> list:
        if self.layout == 2:
            return [self.kids[n - 1] for n in self.slots if n]
        return [k for k in self.kids if k is not None]


class Tree:
    """Adaptive radix tree of distinct byte keys; leaves are key numbers."""

    def __init__(self):
        self.keys: list[bytes] = []
        self.root = Inner(0, 0)

    def insert(self, key: bytes) -> None:
        number = len(self.keys)
        self.keys.append(key)
        node = self.root
        while True:
            if len(key) == node.depth:
                node.end = number
                return
            at = node.find(key[node.depth])
            if at < 0:
                node.add(key[node.depth], number)
                return
            kid = node.kids[at]
            leaf = not isinstance(kid, Inner)
            other = self.keys[kid if leaf else kid.of]
            limit = len(other) if leaf else kid.depth
            split = common(key, other, node.depth + 1, min(limit, len(key)))
            if not leaf and split == limit:
                node = kid
                continue
            branch = Inner(split, number)
            if leaf and split == limit:
                branch.end = kid
            else:
                branch.add(other[split], kid)
            if split == len(key):
                branch.end = number
            else:
                branch.add(key[split], number)
            node.kids[at] = branch
            return

    def postorder(self) -> list[tuple]:
        """(node, byte depth its path starts from), children before parents; -1 above the root."""
        order, stack = [], [(self.root, -1)]
        while stack:
            node, start = stack.pop()
            order.append((node, start))
            if isinstance(node, Inner):
                stack.extend((kid, node.depth) for kid in node.children())
        order.reverse()
        return order


class Rows:
    """Output columns, handed on as record batches."""

    def __init__(self):
        self.schema = pa.schema([
            ("kind", pa.int32()), ("block", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()),
            ("chain", pa.int32()), ("shared", pa.bool_()), ("size", pa.int64()), ("conv_id", pa.int64()),
            ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
            ("n_leaves", pa.int64()), ("weight", pa.int64()), ("distinct_size", pa.int64()),
            ("has_child", pa.bool_()), ("ends", pa.string()),
        ])
        self.rows: list[tuple] = []

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [()] * len(self.schema)
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.rows = []
        return out


def digests(key: bytes) -> list[bytes]:
    """Of the first 0, 1, ... turns of a key."""
    running = hashlib.sha256()
    out = [running.digest()[:WIDTH]]
    for at in range(0, len(key), WIDTH):
        running.update(key[at : at + WIDTH])
        out.append(running.copy().digest()[:WIDTH])
    return out


def joined(members: list[int]) -> str:
    return ",".join(map(str, members))


NOBODY = hashlib.sha256().hexdigest()


def emit(block: int, runs: list[tuple[bytes, bytes, list[int]]], out: Rows) -> Iterator[pa.RecordBatch]:
    """Rows of the trie nodes of a block of sorted (key, lengths, member ids)."""
    tree = Tree()
    for key, _, _ in runs:
        tree.insert(key)
    keys = tree.keys
    first, last = keys[0], keys[-1]
    paths = (digests(first), digests(last))
    # turns that each key shares with the first and the last one: nodes up to there are open
    near = [common(k, first, 0, min(len(k), len(first))) // WIDTH for k in keys]
    far = [common(k, last, 0, min(len(k), len(last))) // WIDTH for k in keys]
    both = far[0]
    shares: dict[int, tuple] = {}
    for node, start in tree.postorder():
        convs, least, weight, size, leaves, tops, child, end = 0, None, 0, 0, 0, [], False, -1
        if isinstance(node, Inner):
            stop, of, end = node.depth, node.of, node.end
            for kid in node.children():
                one = shares.pop(id(kid) if isinstance(kid, Inner) else ~kid)
                convs, weight, size, leaves = convs + one[0], weight + one[2], size + one[3], leaves + one[4]
                least = one[1] if least is None else min(least, one[1])
                few, tops = sorted((tops, one[5]), key=len)
                tops.extend(few)
                child = child or one[6]
        else:
            stop, of, end = len(keys[node]), node, node
        if end >= 0:
            members = runs[end][2]
            convs += len(members)
            least = members[0] if least is None else min(least, members[0])
        lens = np.frombuffer(runs[of][1], "<i4")
        for depth in range(stop // WIDTH, start // WIDTH, -1):
            own = int(lens[depth - 1]) if depth else 0
            weight += convs * own
            ending = runs[end][2] if end >= 0 and depth * WIDTH == stop else None
            if depth > max(near[of], far[of]):
                size += own
                leaves += not tops
                for row in tops:
                    out.rows.append((CLOSED, block, None, None, None, None, None, *row[:2], least, *row[2:5], None, row[5], None, row[6]))
                ends = NOBODY if ending is None else hashlib.sha256(joined(ending).encode()).hexdigest()
                tops = [(least, depth, convs, len(tops), leaves, weight - size, ends)]
            else:
                chain = 0 if depth <= near[of] else 1
                name = paths[chain][depth]
                for row in tops:
                    out.rows.append((CLOSED, block, None, name, None, None, None, *row[:2], None, *row[2:5], None, row[5], None, row[6]))
                parent = paths[chain][depth - 1] if depth else None
                out.rows.append((
                    OPEN, block, name, parent, chain, depth <= both, own, least, depth, None, convs, len(tops), leaves,
                    weight, size, bool(tops) or child, None,
                ))
                if ending is not None:
                    out.rows.append((MEMBERS, block, name, *[None] * 4, ending[0], *[None] * 8, joined(ending)))
                tops, child = [], True
            if len(out.rows) >= FLUSH:
                yield out.take()
        shares[id(node) if isinstance(node, Inner) else ~node] = (convs, least, weight, size, leaves, tops, child)


def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted keys, block by block, to trie nodes."""
    block = TaskContext.get().partitionId() << 32
    runs: list[tuple[bytes, bytes, list[int]]] = []
    volume = members = 0
    out = Rows()
    for batch in batches:
        for key, lens, conv in zip(*(batch.column(n).to_pylist() for n in ("key", "lens", "conv_id"))):
            same = bool(runs) and runs[-1][0] == key
            if members >= BLOCK_MEMBERS or (not same and volume >= BLOCK_BYTES):
                yield from emit(block, runs, out)
                block, runs, volume, members, same = block + 1, [], 0, 0, False
            if same:
                runs[-1][2].append(conv)
            else:
                runs.append((key, lens, [conv]))
                volume += len(key) + WIDTH
            members += 1
    if runs:
        yield from emit(block, runs, out)
    yield out.take()


def hash_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the members of open nodes from their sorted lists, a group after another."""
    current, running = None, None
    done: list[tuple[bytes, str]] = []
    for batch in batches:
        for node, text in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
            if node != current:
                if current is not None:
                    done.append((current, running.hexdigest()))
                current, running = node, hashlib.sha256(text.encode())
            else:
                running.update(b"," + text.encode())
    if current is not None:
        done.append((current, running.hexdigest()))
    yield pa.RecordBatch.from_arrays(
        [pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["node", "ends"]
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations."""
    keys = materialize(rebuilt(conversations), "trie_keys")
    ordered = keys.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    parts = materialize(ordered.mapInArrow(build, PARTS), "trie_parts")
    closed, opened = parts.where(F.col("kind") == CLOSED), parts.where(F.col("kind") == OPEN)

    total = opened.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("size").alias("size"),
        F.first("parent").alias("parent"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("closed_children"),
        F.sum("n_leaves").alias("closed_leaves"), F.sum("weight").alias("weight"),
        F.sum("distinct_size").alias("closed_size"), F.max("has_child").alias("has_child"), F.min("block").alias("home"),
    )
    total = materialize(total, "trie_open")

    # an open node counts for its ancestors in its first block only
    here = opened.select("node", "block", "chain", "shared", "depth").join(
        total.select("node", "size", "has_child", "home", F.col("conv_id").alias("least")), "node"
    )
    at_home = F.col("block") == F.col("home")
    here = here.withColumn("one_size", F.when(at_home, F.col("size")).otherwise(0)).withColumn(
        "one_leaf", F.when(at_home & ~F.col("has_child"), 1).otherwise(0)
    )
    below = Window.orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def lent(name: str):
        whole = F.sum(name).over(below.partitionBy("block"))
        return F.when(F.col("shared"), whole).otherwise(F.sum(name).over(below.partitionBy("block", "chain")))

    lending = here.select("node", lent("one_size").alias("s"), lent("one_leaf").alias("l")).groupBy("node").agg(
        F.sum("s").alias("open_size"), F.sum("l").alias("open_leaves")
    )
    children = total.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("open_children"))
    lists = parts.where(F.col("kind") == MEMBERS).select("node", "conv_id", "ends").repartition("node").sortWithinPartitions("node", "conv_id")
    ends = lists.select("node", "ends").mapInArrow(hash_members, "node binary, ends string")
    above = total.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    of_open = (
        total.join(lending, "node").join(children, "node", "left").join(ends, "node", "left").join(above, "parent", "left")
    ).select(
        "conv_id", "depth", "parent_conv_id", "n_convs",
        (F.col("closed_children") + F.coalesce("open_children", F.lit(0))).alias("n_children"),
        (F.col("closed_leaves") + F.col("open_leaves")).alias("n_leaves"),
        (F.col("weight") - F.col("closed_size") - F.col("open_size")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"),
    )
    complete = closed.withColumn("saved_tokens", F.col("distinct_size")).withColumnRenamed("ends", "ends_sha256")
    columns = of_open.columns
    inner = complete.where("parent is null").select(*columns)
    # a block is bounded, so joining by it leaves no hot parent
    upper = complete.where("parent is not null").drop("parent_conv_id").join(
        here.select("block", F.col("node").alias("parent"), F.col("least").alias("parent_conv_id")), ["block", "parent"]
    ).select(*columns)
    return inner.unionByName(upper).unionByName(of_open)
