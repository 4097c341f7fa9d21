"""Conversation prefix trie, built as adaptive radix trees over sorted ranges of conversations.

**Turn ids.**  A turn is its role and text.  Its id has ``WIDTH`` bytes: the first 16 of the SHA-256 of both, then the
text's length in code points, big-endian.  Only ids leave the scan, so no text is shuffled, and the ids of a
conversation, end to end, are its key.

**Trees.**  Keys are sorted over the cluster with their conversation's number and cut into ranges of about
``PART_BYTES``.  Each task inserts its range into one adaptive radix tree: a node branches on one byte and holds its
children in a layout that grows with them (4, 16, 48 or 256 places), bytes without a branch are compressed into the
path of the node below, and a key may end at any node.  Only byte depths that are multiples of ``WIDTH`` are nodes of
the trie; an unaligned branch is not.

**Borders.**  A trie node that reaches into a neighbouring range (a prefix of the neighbour's nearest key too) is found
in several tasks; the root always is.  Each task gets the number of turns its first key shares with the key before it
and its last key with the key after it.  A node is counted by the first task that has it, a leaf by the last, so that
all sums add up: the few border nodes are merged by their path's digest.  A hot conversation or a hot first turn thus
spreads over as many tasks as its rows fill.  The digest of the numbers that end at a border node is one byte string
by its definition; it is streamed in pieces, never held whole.

Defined results: turns are in order of ``turn`` (null first), equal ones in order of their ids; a null role or text is
empty; rows without a conversation number are no conversation's and are left out; repeated rows are turns of their
own; an empty table has no node, not even the root; only the four named columns are read, so others may have any name.
A very long text costs its hash.  A very long conversation has as many nodes as turns; its ids (20 bytes a turn), not
its texts, must fit in one row.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tambo.llm.common import checkpointed

#: Bytes of a turn id: digest and length.
DIGEST, WIDTH = 16, 20
#: Key bytes (and 8 for each number) that one task's tree holds, about.
PART_BYTES = 8 << 20
#: Conversation numbers in one piece of a border node's list.
PIECE = 512
NO_ENDS = hashlib.sha256(b"").hexdigest()


# ------------------------------------------------------------------ keys
def turn_id(role: Column, text: Column) -> Column:
    """Fixed-width id of a turn; role and text are told apart by the role's length."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    length = F.lpad(F.hex(F.char_length(text).cast("long")), 2 * (WIDTH - DIGEST), "0")
    return F.unhex(F.concat(F.substring(digest, 1, 2 * DIGEST), length))


def turn_paths(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """(conv, ids): the turn ids of every conversation, in order."""
    turns = rows.select(F.col(conv_col).cast("long").alias("conv"), F.struct(
        F.col(turn_col).isNotNull().alias("numbered"), F.col(turn_col).alias("turn"),
        turn_id(F.col(role_col), F.col(text_col)).alias("id")).alias("turn")).filter("conv is not null")
    found = turns.groupBy("conv").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return found.select("conv", F.col("turns.id").alias("ids"))


def rebuilt(paths: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """(conv, ids) where conversation c starts with the first h turns of conversation c - c % ``every`` (none if there is
    no such conversation) and goes on with its own turns after its first h; h = crc32(c as text) % (``most`` + 1)."""
    own = paths.select("conv", "ids", (F.col("conv") - F.col("conv") % every).alias("base"),
                       (F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)).cast("int").alias("h"))
    bases = paths.filter(F.col("conv") % every == 0).select(F.col("conv").alias("base"), F.slice("ids", 1, most).alias("head"))
    head = F.when(F.col("head").isNull(), F.array().cast("array<binary>")).otherwise(F.slice("head", F.lit(1), F.col("h")))
    rest = F.slice("ids", F.col("h") + 1, F.greatest(F.size("ids") - F.col("h"), F.lit(0)))
    return own.join(bases, "base", "left").select("conv", F.concat(head, rest).alias("ids"))


# ------------------------------------------------------------------ adaptive radix tree
class Sorted:
    """Up to 4 or 16 children, beside their branch bytes in order."""

    __slots__ = ("room", "marks", "nodes")

    def __init__(self, room: int = 4):
        self.room, self.marks, self.nodes = room, bytearray(), []

    def get(self, mark: int) -> Node | None:
        at = self.marks.find(mark)
        return None if at < 0 else self.nodes[at]

    def put(self, mark: int, node: Node) -> Layout:
        at = bisect_left(self.marks, mark)
        if at < len(self.marks) and self.marks[at] == mark:
            self.nodes[at] = node
            return self
        if len(self.marks) == self.room:
            grown: Layout = Sorted(16) if self.room == 4 else Indexed()
            for m, child in self.items():
                grown.put(m, child)
            return grown.put(mark, node)
        self.marks.insert(at, mark)
        self.nodes.insert(at, node)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.marks, self.nodes)


class Indexed:
    """Up to 48 children in order of arrival, found through one index byte for each branch byte."""

    __slots__ = ("index", "nodes")
    room = 48

    def __init__(self):
        self.index, self.nodes = bytearray(256), []

    def get(self, mark: int) -> Node | None:
        at = self.index[mark]
        return self.nodes[at - 1] if at else None

    def put(self, mark: int, node: Node) -> Layout:
        if at := self.index[mark]:
            self.nodes[at - 1] = node
            return self
        if len(self.nodes) == self.room:
            grown = Direct()
            for m, child in self.items():
                grown.put(m, child)
            return grown.put(mark, node)
        self.nodes.append(node)
        self.index[mark] = len(self.nodes)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((mark, self.nodes[at - 1]) for mark, at in enumerate(self.index) if at)


class Direct:
    """A place for each of the 256 branch bytes."""

    __slots__ = ("nodes",)
    room = 256

    def __init__(self):
        self.nodes: list[Node | None] = [None] * 256

    def get(self, mark: int) -> Node | None:
        return self.nodes[mark]

    def put(self, mark: int, node: Node) -> Layout:
        self.nodes[mark] = node
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((mark, node) for mark, node in enumerate(self.nodes) if node is not None)


Layout = Sorted | Indexed | Direct


class Node:
    """A branch or the end of keys; its path is ``key[:end]``, of which the bytes since its parent's end are compressed."""

    __slots__ = ("key", "end", "kids", "convs")

    def __init__(self, key: bytes, end: int):
        self.key, self.end, self.kids, self.convs = key, end, Sorted(), None


def agree(a: bytes, b: bytes, lo: int, hi: int) -> int:
    """First place in lo..hi where a and b differ; hi if none."""
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def insert(root: Node, key: bytes, conv: int) -> Node:
    """Adds a conversation to the tree; the node at which its key ends."""
    node = root
    while node.end < len(key):
        mark = key[node.end]
        child = node.kids.get(mark)
        if child is None:
            child = Node(key, len(key))
            node.kids = node.kids.put(mark, child)
        else:
            shared = agree(key, child.key, node.end + 1, min(child.end, len(key)))
            if shared < child.end:          # the compressed path parts here
                branch = Node(child.key, shared)
                branch.kids = branch.kids.put(child.key[shared], child)
                node.kids = node.kids.put(mark, branch)
                child = branch
        node = child
    if node.convs is None:
        node.convs = array("q")
    node.convs.append(conv)
    return node


# ------------------------------------------------------------------ trie nodes of one range
OUT = ("part int, path binary, depth bigint, conv bigint, up binary, parent bigint, n_convs bigint, n_children bigint, "
       "n_leaves bigint, saved bigint, ends string, piece int")
ARROW = pa.schema([("part", pa.int32()), ("path", pa.binary()), ("depth", pa.int64()), ("conv", pa.int64()),
                   ("up", pa.binary()), ("parent", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
                   ("n_leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string()), ("piece", pa.int32())])


def prefix_digests(key: bytes, turns: int) -> list[bytes]:
    """Digests of the first 0, 1, ... ``turns`` turn ids."""
    so_far, out = hashlib.sha256(), []
    for d in range(turns + 1):
        if d:
            so_far.update(key[(d - 1) * WIDTH:d * WIDTH])
        out.append(so_far.digest()[:DIGEST])
    return out


def range_nodes(root: Node, part: int, first: bytes, last: bytes, before: int, after: int) -> Iterator[tuple]:
    """Rows of ``OUT`` for one range; ``before`` and ``after``: turns shared with the neighbouring keys (-1: none there)."""
    left, right = prefix_digests(first, before), prefix_digests(last, after)
    # Parents before children, children in byte order; the radix nodes on the path of the first and last key are known.
    order: list[tuple[Node, int, int, bool, bool]] = []
    stack = [(root, 0, -1, True, True)]
    while stack:
        node, start, above, on_first, on_last = entry = stack.pop()
        at = len(order)
        order.append(entry)
        stack += reversed([(kid, node.end, at, on_first and len(first) > node.end and first[node.end] == mark,
                            on_last and len(last) > node.end and last[node.end] == mark) for mark, kid in node.kids.items()])

    def depths(start: int, end: int) -> range:
        return range(start // WIDTH + 1, end // WIDTH + 1) if end else range(0, 1)

    def length(key: bytes, d: int) -> int:
        return int.from_bytes(key[d * WIDTH - WIDTH + DIGEST:d * WIDTH], "big") if d else 0

    count = len(order)
    n, least, saved, leaves, tops = [0] * count, [None] * count, [0] * count, [0] * count, [0] * count
    below = [(0, 0)] * count        # saved and children below a node's own path
    for at in range(count - 1, -1, -1):
        node, start, above, on_first, on_last = order[at]
        if node.convs is not None:
            n[at] += len(node.convs)
            own = min(node.convs)
            least[at] = own if least[at] is None else min(own, least[at])
            end = node.end // WIDTH
            if not node.kids.nodes and not (on_last and end <= after):
                leaves[at] += 1
        below[at] = saved[at], tops[at]
        mine = depths(start, node.end)
        for d in mine:
            saved[at] += (n[at] - (not (on_first and d <= before))) * length(node.key, d)
        if mine:
            tops[at] = int(not (on_first and mine[0] <= before))
        if above >= 0:
            n[above] += n[at]
            least[above] = least[at] if least[above] is None else min(least[above], least[at])
            saved[above] += saved[at]
            leaves[above] += leaves[at]
            tops[above] += tops[at]
    nearest: list[tuple[int | None, bytes | None]] = [(None, None)] * count     # the last trie node on a radix node's path
    for at, (node, start, above, on_first, on_last) in enumerate(order):
        parent, up = nearest[above] if above >= 0 else (None, None)
        mine = depths(start, node.end)
        rest, children = below[at]
        totals = []
        for d in reversed(mine):
            rest += (n[at] - (not (on_first and d <= before))) * length(node.key, d)
            totals.append((rest, children))
            children = int(not (on_first and d <= before))
        for d, (total, kids) in zip(mine, reversed(totals)):
            path = left[d] if on_first and d <= before else right[d] if on_last and d <= after else None
            convs = node.convs if d * WIDTH == node.end else None
            ends = None
            if path is None:
                ends = NO_ENDS if convs is None else hashlib.sha256(",".join(map(str, convs)).encode()).hexdigest()
            elif convs is not None:
                for lo in range(0, len(convs), PIECE):
                    yield part, path, None, None, None, None, None, None, None, None, ",".join(map(str, convs[lo:lo + PIECE])), lo // PIECE
            yield part, path, d, least[at], up, parent, n[at], kids, leaves[at], total, ends, None
            parent, up = (least[at], None) if path is None else (None, path)
        nearest[at] = parent, up


def _range_tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition of (ids, conv, part, before, after) in order of ids and conv -> rows of ``OUT``."""
    root, first, last, node, at = Node(b"", 0), None, b"", None, None
    for batch in batches:
        ids, convs, *where = (batch.column(i) for i in range(5))
        joined = b"".join(ids.flatten().to_pylist())
        ends = (np.cumsum(ids.value_lengths().to_numpy()) * WIDTH).tolist()
        for lo, hi, conv in zip([0, *ends], ends, convs.to_pylist()):
            key = joined[lo:hi]
            if node is not None and key == last:
                node.convs.append(conv)
                continue
            node = insert(root, key, conv)
            first, last = key if first is None else first, key
        if batch.num_rows:
            at = [c[0].as_py() for c in where]
    if first is None:
        return
    rows = []
    for row in range_nodes(root, at[0], first, last, at[1], at[2]):
        rows.append(row)
        if len(rows) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, piece of a list) in order -> (path, digest of the list); one digest state is all that is held."""
    now, so_far = None, None
    for batch in batches:
        paths, digests = [], []
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if path != now:
                if now is not None:
                    paths.append(now)
                    digests.append(so_far.hexdigest())
                now, so_far = path, hashlib.sha256(text.encode())
            else:
                so_far.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.binary()), pa.array(digests, pa.string())], ["path", "ends"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([so_far.hexdigest()])], ["path", "ends"])


# ------------------------------------------------------------------ the whole trie
def _shared(a: str, b: str) -> Column:
    """Leading elements that two arrays have in common."""
    short = f"least(size({a}), size({b}))"
    same = f"transform(sequence(1, {short}), i -> get({a}, i - 1) = get({b}, i - 1))"
    return F.expr(f"case when {short} = 0 then 0 when array_position({same}, false) = 0 then {short} "
                  f"else cast(array_position({same}, false) as int) - 1 end")


def trie(paths: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per node of the trie over (conv, ids): conv (smallest member), depth, parent (the parent's conv; null for
    the root), n_convs, n_children, n_leaves, saved (over the subtree, (n_convs - 1) times the last text's length) and
    ends (SHA-256 of the members that have no further turn)."""
    paths = checkpointed(paths.select("conv", "ids"))
    total = paths.agg(F.sum(F.size("ids").cast("long") * WIDTH + 8)).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    dealt = paths.repartitionByRange(parts, "ids", "conv").sortWithinPartitions("ids", "conv")
    dealt = checkpointed(dealt.select("ids", "conv", F.spark_partition_id().alias("part")))
    # One row for each task from here on: its first and last key beside its neighbours'.
    ends = dealt.groupBy("part").agg(F.min("ids").alias("first"), F.max("ids").alias("last"))
    by_part = Window.orderBy("part")
    ends = ends.withColumns({"gone": F.lag("last").over(by_part), "next": F.lead("first").over(by_part)})
    borders = ends.select("part", F.when(F.col("gone").isNull(), -1).otherwise(_shared("gone", "first")).alias("before"),
                          F.when(F.col("next").isNull(), -1).otherwise(_shared("last", "next")).alias("after"))
    placed = dealt.join(F.broadcast(borders), "part").select("ids", "conv", "part", "before", "after")
    found = checkpointed(placed.mapInArrow(_range_tree, OUT))
    nodes, pieces = found.filter("piece is null"), found.filter("piece is not null")
    border = nodes.filter("path is not null")
    merged = border.groupBy("path").agg(
        F.min("depth").alias("depth"), F.min("conv").alias("conv"), F.min(F.struct("part", "up")).alias("at"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")])
    listed = (pieces.select("path", "ends", "part", "piece").repartition("path").sortWithinPartitions("path", "part", "piece")
                    .select("path", "ends").mapInArrow(_hash_pieces, "path binary, ends string"))
    merged = merged.join(listed, "path", "left").withColumn("ends", F.coalesce("ends", F.lit(NO_ENDS)))
    # What a border node's smallest member is, for each task that has children of it.
    names = border.select("part", "path").join(merged.select("path", F.col("conv").alias("name")), "path")
    columns = ["conv", "depth", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    inner = nodes.filter("path is null")
    below = inner.filter("up is not null").select("part", "up", *columns).unionByName(
        merged.select("at.part", "at.up", *columns))
    below = below.join(names.withColumnRenamed("path", "up"), ["part", "up"], "left").select(*columns, F.col("name").alias("parent"))
    return inner.filter("up is null").select(*columns, "parent").unionByName(below)
