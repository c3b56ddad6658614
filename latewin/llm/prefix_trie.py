"""The prefix tree of conversations, gathered in z-fast tries.

A conversation is a sequence of turns; its first d turns are named by a digest chained over
their roles and texts, so equal digests mean equal prefixes. A task inserts its conversations
into a compacted trie (a node stands for an edge, its *extent* is the depth it reaches). Each
node is stored under one *handle*: the digest of its prefix at the two-fattest depth of its
edge, the depth divisible by the highest power of two. A conversation's exit node is found by
fat binary search, a logarithmic number of handle look-ups in its length, and batches are
inserted exit node by exit node. A trie that is full is written out and begun anew, so a task
holds a bounded number of turns.

Written out, edges are expanded to one row a prefix with what the task's conversations add to
it. Spark adds the rows of all tasks up by digest, in tasks first: a prefix that a third of all
conversations share is a few rows by then. What a prefix needs from below it is added up along
the path of each conversation that is the smallest of some prefix; such a conversation owns
the lower end of its path, so a prefix is counted once.

A conversation is the unit of work: the task that inserts it holds 16 bytes and a size for each
of its turns, never their texts.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latewin.session import stage

#: Turns a task's trie holds before it is written out.
HELD_TURNS = 200_000
#: Ids of one node's ends joined to one text before they are hashed in order.
PIECE = 4096
#: A prefix with more than this share of all conversations below it is looked up by broadcast;
#: there are fewer than 1,000 such prefixes.
HOT_SHARE = 1000
WIDTH = 16
ROOT = bytes(WIDTH)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def two_fattest(low: int, high: int) -> int:
    """The depth in (low, high] that the highest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class _Node:
    """The depths (low, high] of a path; ``chain`` and ``sizes`` hold one entry for each."""

    __slots__ = ("chain", "ends", "high", "least", "low", "parent", "sizes", "total")

    def __init__(self, low, high, chain, sizes, parent):
        self.low, self.high, self.chain, self.sizes, self.parent = low, high, chain, sizes, parent
        self.ends, self.total, self.least = 0, 0, None

    def handle(self) -> bytes:
        return self.chain[two_fattest(self.low, self.high) - self.low - 1]

    def matched(self, path: list[bytes]) -> int:
        """How deep ``path`` agrees with this node, whose first depth agrees."""
        low, high = self.low, min(self.high, len(path) - 1)
        while low < high:
            middle = (low + high + 1) // 2
            if self.chain[middle - self.low - 1] == path[middle]:
                low = middle
            else:
                high = middle - 1
        return low


class ZFastTrie:
    """Compacted trie over paths of prefix digests; ``path[0]`` is the root's digest."""

    def __init__(self):
        self.root = _Node(0, 0, [], [], None)
        self.nodes = [self.root]
        self.handles: dict[bytes, _Node] = {}
        self.names: dict[bytes, _Node] = {}
        self.turns = 0

    def exit_node(self, path: list[bytes]) -> tuple[_Node, int]:
        """(node where the path leaves the trie, depth to which it agrees)."""
        low, high, node = 0, len(path) - 1, self.root
        while low < high:
            at = two_fattest(low, high)
            found = self.handles.get(path[at])
            if found is None:
                high = at - 1
            else:
                node, low = found, found.high
        depth = node.matched(path)
        if depth == node.high and depth + 1 < len(path):
            below = self.names.get(path[depth + 1])
            if below is not None:
                node, depth = below, below.matched(path)
        return node, depth

    def insert(self, batch: list[tuple[int, list[bytes], list[int]]]) -> None:
        """Add (id, path, sizes of its turns) of many conversations.

        All exit nodes are located first. At each, paths that end on its extent only count;
        another one changes the trie there, so those after it are located again.
        """
        by_exit: dict[int, list] = defaultdict(list)
        for entry in batch:
            node, depth = self.exit_node(entry[1])
            by_exit[id(node)].append((node, depth, entry))
        for group in by_exit.values():
            changed = False
            for node, depth, (name, path, sizes) in group:
                if changed:
                    node, depth = self.exit_node(path)
                if depth < node.high or depth < len(path) - 1:
                    node = self._grow(node, depth, path, sizes)
                    changed = True
                node.ends += 1
                node.least = name if node.least is None else min(node.least, name)

    def _enter(self, node: _Node) -> None:
        self.handles[node.handle()] = node
        self.names[node.chain[0]] = node

    def _grow(self, node: _Node, depth: int, path: list[bytes], sizes: list[int]) -> _Node:
        """The node whose extent is the whole path, made by a split, a new leaf or both."""
        if depth < node.high:
            cut = depth - node.low
            upper = _Node(node.low, depth, node.chain[:cut], node.sizes[:cut], node.parent)
            del self.handles[node.handle()]
            node.low, node.parent = depth, upper
            node.chain, node.sizes = node.chain[cut:], node.sizes[cut:]
            self._enter(upper)
            self._enter(node)
            self.nodes.append(upper)
            node = upper
        if depth + 1 < len(path):
            leaf = _Node(depth, len(path) - 1, path[depth + 1 :], sizes[depth:], node)
            self._enter(leaf)
            self.nodes.append(leaf)
            self.turns += len(leaf.chain)
            node = leaf
        return node

    def prefixes(self) -> Iterator[tuple]:
        """(digest, depth, digest of its parent, bytes of its last turn, members, ends, least
        member) of every prefix."""
        ordered = sorted(self.nodes, key=lambda n: n.high, reverse=True)
        for node in ordered:
            node.total += node.ends
            up = node.parent
            if up is not None:
                up.total += node.total
                if up.least is None or node.least < up.least:
                    up.least = node.least
            above = up.chain[-1] if up is not None and up.chain else ROOT
            if up is None:
                yield ROOT, 0, None, 0, node.total, node.ends, node.least
            for place, digest in enumerate(node.chain):
                depth = node.low + place + 1
                ends = node.ends if depth == node.high else 0
                yield digest, depth, above, node.sizes[place], node.total, ends, node.least
                above = digest


def turns_of(conversations: DataFrame, group: int = 5, modulus: int = 9) -> DataFrame:
    """(conv_id, pos, digest, bytes) of the rebuilt conversations' turns.

    Conversation c has the first h turns of the first of its group, then its own after its
    first h, with h the CRC-32 of its number modulo ``modulus``. Every conversation also has a
    row at position -1; rows of a conversation without one belong to an id that does not exist.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = (
        conversations.where("conv_id is not null")
        .select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
        .withColumn("pos", F.row_number().over(order) - 1)
    )
    own, pos = F.col("conv_id"), F.col("pos")

    def taken(conv: Column) -> Column:
        return F.crc32(conv.cast("string").cast("binary")) % modulus

    def place(conv: Column, at: Column) -> Column:
        return F.struct(conv.alias("conv_id"), at.cast("int").alias("pos"))

    none = F.array().cast("array<struct<conv_id:bigint,pos:int>>")
    mates = F.transform(F.sequence(F.lit(0), F.lit(group - 1)), lambda j: place(own + j, pos))
    shared = F.filter(mates, lambda m: pos < taken(m["conv_id"]))
    first = (F.pmod(own, F.lit(group)) == 0) & (pos < modulus - 1)
    digest = F.unhex(F.sha2(F.concat(F.sha2("role", 256), F.sha2("text", 256)), 256))
    return turns.select(
        F.explode(
            F.concat(
                F.when(first, shared).otherwise(none),
                F.when(pos >= taken(own), F.array(place(own, pos))).otherwise(none),
                F.when(pos == 0, F.array(place(own, F.lit(-1)))).otherwise(none),
            )
        ).alias("at"),
        F.substring(digest, 1, WIDTH).alias("digest"),
        F.octet_length("text").cast("long").alias("bytes"),
    ).select("at.conv_id", "at.pos", "digest", "bytes")


_FOUND = (
    "node binary, depth int, parent binary, bytes long, n_convs long, n_ends long,"
    " conv_id long, path binary"
)
_FOUND_ARROW = pa.schema(
    [
        ("node", pa.binary()), ("depth", pa.int32()), ("parent", pa.binary()),
        ("bytes", pa.int64()), ("n_convs", pa.int64()), ("n_ends", pa.int64()),
        ("conv_id", pa.int64()), ("path", pa.binary()),
    ]
)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """For every Arrow batch the conversations that end in it; the last one after all."""
    name, path, sizes = None, [], []

    def finished():
        return [(name, path, sizes)] if path else []

    for batch in batches:
        done = []
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for conv, pos, digest, size in zip(*columns, strict=True):
            if conv != name:
                done += finished()
                name, path, sizes = conv, [ROOT] if pos < 0 else [], []
            if pos >= 0 and path:
                path.append(hashlib.blake2b(path[-1] + digest, digest_size=WIDTH).digest())
                sizes.append(size)
        yield done
    yield finished()


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(found), 10_000):
            columns = zip(*found[low : low + 10_000], strict=True)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, _FOUND_ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=_FOUND_ARROW)

    trie = ZFastTrie()
    for batch in _conversations(batches):
        if batch:
            trie.insert(batch)
            yield from rows(
                [(p[-1], len(s), None, None, None, None, n, b"".join(p[1:])) for n, p, s in batch]
            )
        if trie.turns > HELD_TURNS:
            yield from rows([(*p, None) for p in trie.prefixes()])
            trie = ZFastTrie()
    # A task that saw no conversation has no root to report.
    yield from rows([(*p, None) for p in trie.prefixes() if p[4]])


def gather(turns: DataFrame, group: int = 5) -> DataFrame:
    """Rows of two kinds: prefixes of the tasks' tries (path null), and one row a conversation
    with its last digest and, as ``path``, the digests of its turns in a row."""
    mates = F.col("conv_id") - F.pmod("conv_id", F.lit(group))
    placed = turns.repartition(mates).sortWithinPartitions("conv_id", "pos")
    return placed.mapInArrow(_gather, _FOUND)


def _ends(found: DataFrame) -> DataFrame:
    """(node, ends_sha256): the hash over the ids that end at a node, ascending.

    Ids are first joined to pieces in tasks that are cut by node *and* id, so that a node where
    a third of all conversations end is spread. A hash over a sequence has to run through it in
    order: what one task reads for such a node is its pieces, one row for PIECE ids.
    """

    def join(batches):
        node, ids = None, []

        def row():
            return [(node, ids[0], ",".join(map(str, ids)))] if ids else []

        for batch in batches:
            out = []
            for here, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if here != node or len(ids) == PIECE:
                    out += row()
                    node, ids = here, []
                ids.append(conv)
            yield batch_of(out)
        yield batch_of(row())

    def batch_of(rows):
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        kinds = (pa.binary(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["node", "first", "ids"]
        )

    def digest(batches):
        node, state = None, None
        for batch in batches:
            done = []
            for here, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if here == node:
                    state.update(b",")
                else:
                    if state is not None:
                        done.append((node, state.hexdigest()))
                    node, state = here, hashlib.sha256()
                state.update(ids.encode())
            yield digests_of(done)
        yield digests_of([(node, state.hexdigest())] if state is not None else [])

    def digests_of(rows):
        columns = list(zip(*rows, strict=True)) or [(), ()]
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string())],
            ["node", "ends_sha256"],
        )

    ids = found.where("path is not null").select("node", "conv_id")
    pieces = (
        ids.repartitionByRange("node", "conv_id")
        .sortWithinPartitions("node", "conv_id")
        .mapInArrow(join, "node binary, first long, ids string")
    )
    return (
        pieces.repartition("node")
        .sortWithinPartitions("node", "first")
        .mapInArrow(digest, "node binary, ends_sha256 string")
    )


def _parents(tops: DataFrame, owned: DataFrame) -> DataFrame:
    """(node, parent_conv_id) of prefixes whose parent another conversation owns.

    Parents of many are few, fewer than HOT_SHARE, and are broadcast; the rest meet by digest,
    none of them with more than a thousandth of the rows.
    """
    names = owned.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    children = tops.groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
    most = max(tops.count() // HOT_SHARE, 1)
    hot = stage(children.where(F.col("n") > most).select("parent").join(names, "parent"), "trie-hot")
    rows = tops.select("node", "parent")
    return (
        rows.join(F.broadcast(hot), "parent")
        .unionByName(
            rows.join(F.broadcast(hot.select("parent")), "parent", "left_anti").join(names, "parent")
        )
        .select("node", "parent_conv_id")
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for every distinct prefix of the rebuilt conversations, the root included.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. Turns are ordered by turn, null first, then role and text;
    repeated rows are turns of their own. Null roles and texts count as empty. Rows without a
    conv_id belong to no conversation and are ignored, as are other columns; an empty table has
    no nodes.
    """
    found = stage(gather(turns_of(conversations)), "trie")
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    running = below.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    leaf = (F.col("n_convs") == F.col("n_ends")).cast("long")
    owned = stage(
        found.where("path is null")
        .groupBy("node", F.col("depth").cast("long").alias("depth"), "parent", "bytes")
        .agg(
            F.sum("n_convs").alias("n_convs"),
            F.sum("n_ends").alias("n_ends"),
            F.min("conv_id").alias("conv_id"),
        )
        .select(
            "node", "depth", "parent", "conv_id", "n_convs",
            F.sum(leaf).over(running).alias("n_leaves"),
            F.sum((F.col("n_convs") - 1) * F.col("bytes")).over(running).alias("saved_tokens"),
            F.lead("depth").over(below).isNull().alias("top"),
        ),
        "trie-nodes",
    )
    tops = owned.where("top and depth > 0")
    paths = found.where("path is not null").select("conv_id", "path")
    at = F.when(F.col("up") > 0, F.substr("path", (F.col("up") - 1) * WIDTH + 1, F.lit(WIDTH)))
    above = (
        tops.join(paths, "conv_id")
        .select("n_leaves", "saved_tokens", "path",
                F.explode(F.sequence(F.lit(0), (F.col("depth") - 1).cast("int"))).alias("up"))
        .select(F.coalesce(at, F.lit(ROOT)).alias("node"), "n_leaves", "saved_tokens")
    )
    own = F.when(~F.col("top"), F.col("conv_id"))
    facts = owned.select(
        "node", "depth", "conv_id", "n_convs", "n_leaves", "saved_tokens",
        own.alias("parent_conv_id"),
    )
    parts = [
        above,
        owned.where("parent is not null").select(F.col("parent").alias("node"), F.lit(1).cast("long").alias("n_children")),
        _parents(tops, owned),
        _ends(found),
    ]
    for part in parts:
        facts = facts.unionByName(part, allowMissingColumns=True)
    return (
        facts.groupBy("node")
        .agg(
            F.max("conv_id").alias("conv_id"),
            F.max("depth").alias("depth"),
            F.max("parent_conv_id").alias("parent_conv_id"),
            F.max("n_convs").alias("n_convs"),
            F.coalesce(F.sum("n_children"), F.lit(0)).alias("n_children"),
            F.sum("n_leaves").alias("n_leaves"),
            F.sum("saved_tokens").alias("saved_tokens"),
            F.coalesce(F.max("ends_sha256"), F.lit(EMPTY_SHA)).alias("ends_sha256"),
        )
        .drop("node")
    )
