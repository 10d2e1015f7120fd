"""Prefix trie of conversations by truncation peeling, deepest level first.

A conversation is its path: a hash pair and a word count for each turn. Equal paths become one row; the rows, dealt in
ranges of the paths' order, are peeled in tasks. From the deepest level up, paths that end at a level meet the nodes that
have survived from the level below; equal ones are one node, which is settled with all that its subtree adds up to, loses
its last turn and goes on as a part of its parent. Only prefixes of a range's first and last path can have members in
another range, so these are left open: each task hands them on as two chains, which are peeled in the next round together
with those of the neighbouring ranges, until one round settles all. The number of rounds grows with the logarithm of the
table and not with the turns of a conversation, and a node that very many conversations share is open in many tasks, each of
which adds up its own part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import whole, words, written

GROUP = 20
MOST_SHARED = 4
#: Turns of different paths that one task peels, and chains that it takes of others in a later round.
TURNS_A_TASK = 20_000
CHAINS_A_TASK = 128
#: Bytes of open nodes' names that may be broadcast to name their children's parents.
BROADCAST_BYTES = 64 << 20
#: Characters of joined ids in one row, where the ids of a node go through several tasks.
PIECE = 1 << 13
_NOTHING = hashlib.sha256(b"").hexdigest()


def _own_turns(df: DataFrame) -> DataFrame:
    """conv_id and its turns in order, each as struct<a, b, w>: two hashes of role and text, and the words of the text."""
    role, text = whole("role"), whole("text")
    turns = df.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").isNotNull().alias("numbered"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
            F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), role, text).alias("b"),
            F.size(words(text)).cast("long").alias("w"),
        ).alias("t"),
    )
    ordered = F.array_sort(F.collect_list("t"))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["a"], t["b"], t["w"])).alias("turns"))


def rebuilt(df: DataFrame) -> DataFrame:
    """conv_id and path: the first h turns of the group's first conversation, then the own turns after the first h."""
    own = written(_own_turns(df), "turns")
    first = own.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("lender"), F.slice("turns", 1, MOST_SHARED - 1).alias("lent"))
    h = (F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED).cast("int")
    none = F.slice("turns", 1, 0)
    return (
        own.withColumns({"lender": F.col("conv_id") - F.col("conv_id") % GROUP, "h": h})
        .join(first, "lender", "left")
        .select(
            "conv_id",
            F.concat(F.coalesce(F.slice("lent", F.lit(1), F.col("h")), none), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("path"),
        )
    )


def _key(path: Column) -> list[Column]:
    """128 bits that stand for a path in joins."""
    return [F.xxhash64(path), F.xxhash64(F.lit(1), path)]


def _node_rows(batches: Iterator[pa.RecordBatch], value: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("a", "b", value)))


_PIECES = "a long, b long, first long, ids string, digest string"


def _as_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    names = ["a", "b", "first", "ids", "digest"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def _digests_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ids sorted by node: digests of the nodes that lie within the task, and pieces of joined ids of those that may
    go on in another task (the first and the last node) or take more than one piece."""

    def rows() -> Iterator[tuple]:
        whole_node = None  # the last node, while it is one piece
        for place, ((a, b), own) in enumerate(groupby(_node_rows(batches, "conv_id"), key=lambda r: r[:2])):
            if whole_node:
                yield (*whole_node[:2], None, None, hashlib.sha256(whole_node[3].encode()).hexdigest())
            ids, length, start, pieces = [], 0, None, 0
            for _, _, c in own:
                if length >= PIECE:
                    yield a, b, start, ",".join(ids), None
                    ids, length, start, pieces = [], 0, None, pieces + 1
                start = c if start is None else start
                ids.append(str(c))
                length += len(ids[-1]) + 1
            whole_node = (a, b, start, ",".join(ids), None)
            if pieces or not place:
                yield whole_node
                whole_node = None
        if whole_node:
            yield whole_node

    return _as_batches(rows())


def _digests_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces sorted by node and first id: the digest of each node, one piece after the other."""

    def rows() -> Iterator[tuple]:
        for (a, b), own in groupby(_node_rows(batches, "ids"), key=lambda r: r[:2]):
            state = hashlib.sha256()
            for place, (_, _, ids) in enumerate(own):
                state.update(("," if place else "").encode() + ids.encode())
            yield a, b, None, None, state.hexdigest()

    return _as_batches(rows())


def _ends(paths: DataFrame) -> DataFrame:
    """a, b, ends_sha256 of each node at which conversations end.

    Ids are dealt by node and id, so the ids of one node may lie in many tasks. Joined, they pass through a single task
    piece by piece, since a digest can only be taken in order; it holds one piece at a time.
    """
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = _key(F.col("path"))
    sorted_ids = paths.select(a.alias("a"), b.alias("b"), "conv_id").repartitionByRange(n, "a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
    found = written(sorted_ids.mapInArrow(_digests_within, _PIECES), "ends")
    cut = found.filter("digest IS NULL").repartition("a", "b").sortWithinPartitions("a", "b", "first")
    done = found.filter("digest IS NOT NULL").unionByName(cut.mapInArrow(_digests_across, _PIECES))
    return done.select("a", "b", F.col("digest").alias("ends_sha256"))


_STATS = "array<struct<depth:int,n:bigint,conv:bigint,children:bigint,leaves:bigint,saved:bigint,ends:string>>"
_VALUES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_PEELED = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    f"node binary, parent binary, path array<struct<a:bigint,b:bigint,w:bigint>>, stats {_STATS}"
)


class _Node:
    """What is known of a node: members and what its settled children add up to. ``via`` is a path that passes it."""

    __slots__ = ("n", "conv", "children", "leaves", "saved", "ends", "via")

    def __init__(self, via: int):
        self.n = self.children = self.leaves = self.saved = 0
        self.conv, self.ends, self.via = None, None, via

    def add(self, n: int, conv: int, children: int, leaves: int, saved: int) -> None:
        self.n += n
        self.conv = conv if self.conv is None else min(conv, self.conv)
        self.children += children
        self.leaves += leaves
        self.saved += saved


def _keys(path: list[tuple]) -> list[bytes]:
    """128 bits for every prefix of a path, from the root on."""
    state = hashlib.blake2b(digest_size=16)
    out = [state.digest()]
    for a, b, _ in path:
        state.update(a.to_bytes(8, "big", signed=True) + b.to_bytes(8, "big", signed=True))
        out.append(state.copy().digest())
    return out


def _peel(last_round: bool):
    """Peel the paths of a task; all but the last round leave the prefixes of the first and the last path open."""

    def peeled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: list[list[tuple]] = []
        keys: list[list[bytes]] = []
        levels: list[dict[bytes, _Node]] = []
        for batch in batches:
            turns = batch.column("path")
            flat = turns.flatten()
            every = list(zip(*(flat.field(i).to_pylist() for i in range(3))))
            offsets = turns.offsets.to_numpy()
            for row, stats in enumerate(batch.column("stats").to_pylist()):
                path = every[offsets[row] - offsets[0] : offsets[row + 1] - offsets[0]]
                via = len(paths)
                paths.append(path)
                keys.append(_keys(path))
                levels += [{} for _ in range(len(path) + 1 - len(levels))]
                for s in stats:
                    level, key = levels[s["depth"]], keys[via][s["depth"]]
                    node = level.get(key) or level.setdefault(key, _Node(via))
                    node.add(s["n"], s["conv"], s["children"], s["leaves"], s["saved"])
                    node.ends = node.ends or s["ends"]
        if not paths:
            return
        order = range(len(paths))
        ends = [] if last_round else [min(order, key=paths.__getitem__), max(order, key=paths.__getitem__)]
        open_ = {k for e in ends for k in keys[e]}
        for depth in range(len(levels) - 1, -1, -1):
            for key, node in levels[depth].items():
                if key in open_:
                    continue
                node.leaves = node.leaves if node.children else 1
                if depth:
                    node.saved += (node.n - 1) * paths[node.via][depth - 1][2]
                    above = keys[node.via][depth - 1]
                    parent = levels[depth - 1].get(above) or levels[depth - 1].setdefault(above, _Node(node.via))
                    parent.add(node.n, node.conv, 1, node.leaves, node.saved)
        yield from _peeled_batches(_settled(levels, keys, open_))
        yield from _peeled_batches(_chains(paths, keys, levels, ends))

    return peeled


def _settled(levels: list[dict], keys: list, open_: set) -> Iterator[tuple]:
    for depth, level in enumerate(levels):
        for key, x in level.items():
            if key not in open_:
                above = keys[x.via][depth - 1] if depth else None
                known = levels[depth - 1][above].conv if depth and above not in open_ else None
                yield (
                    x.conv, depth, known, x.n, x.children, x.leaves, x.saved, x.ends or _NOTHING, key,
                    above if above in open_ else None, None, None,
                )


def _chains(paths: list, keys: list, levels: list[dict], ends: list[int]) -> Iterator[tuple]:
    """The open nodes as chains along the first and the last path, each node once."""
    seen: set[bytes] = set()
    for e in ends:
        stats = []
        for depth, key in enumerate(keys[e]):
            if key not in seen and key in levels[depth]:
                x = levels[depth][key]
                stats.append({"depth": depth, "n": x.n, "conv": x.conv, "children": x.children, "leaves": x.leaves, "saved": x.saved, "ends": x.ends})
            seen.add(key)
        if stats:
            path = [{"a": a, "b": b, "w": w} for a, b, w in paths[e]]
            yield (*[None] * 10, path, stats)


_TURN = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("w", pa.int64())])
_STAT = pa.struct([("depth", pa.int32()), *[(c, pa.int64()) for c in ("n", "conv", "children", "leaves", "saved")], ("ends", pa.string())])
_PEELED_ARROW = pa.schema([
    *[(c, pa.int64()) for c in _VALUES[:-1]], ("ends_sha256", pa.string()), ("node", pa.binary()), ("parent", pa.binary()),
    ("path", pa.list_(_TURN)), ("stats", pa.list_(_STAT)),
])


def _peeled_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, 4_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _PEELED_ARROW)], schema=_PEELED_ARROW)


def trie(df: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations, one row each, as the columns of the query `op12_prefix_trie`.

    Turns without a number come first; turns of one number are ordered by a hash of their content, so reruns agree, and
    repeated rows are turns of their own. A null role or text is empty. Rows without a conv_id belong to no conversation.
    The remainder of a negative conv_id has its sign, as in SQL. Conversations that keep no turn are members of the root;
    an empty table has no root. Other columns are not read. A path takes 24 bytes a turn and must fit one row.
    """
    paths = written(rebuilt(df), "paths")
    a, b = _key(F.col("path"))
    different = paths.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv")).withColumns({"a": a, "b": b})
    zero = F.lit(0).cast("long")
    stat = F.struct(
        F.size("path").alias("depth"), "n", "conv", zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), F.col("ends_sha256").alias("ends")
    )
    rows = written(different.join(_ends(paths), ["a", "b"], "left").select("path", F.array(stat).alias("stats")), "different-paths")
    turns = rows.agg(F.sum(F.size("path"))).first()[0] or 0
    tasks = -(-turns // TURNS_A_TASK)
    rounds: list[DataFrame] = []
    chains = 2 * tasks
    while tasks > 1:
        peeled = written(rows.repartitionByRange(tasks, "path").mapInArrow(_peel(False), _PEELED), "peeled")
        rounds.append(peeled.filter("path IS NULL"))
        rows = peeled.filter("path IS NOT NULL").select("path", "stats")
        before, chains = chains, rows.count()
        # fewer tasks in every round; a cluster that deals out more than asked for ends with a few chains all the same
        tasks = -(-chains // CHAINS_A_TASK) if chains > 2 * CHAINS_A_TASK and chains < before else 1
    rounds.append(written(rows.select("path", "stats").coalesce(1).mapInArrow(_peel(True), _PEELED), "peeled"))
    return _with_parents(rounds)


def _with_parents(rounds: list[DataFrame]) -> DataFrame:
    """All settled nodes. Those below a node that was open in their round get its name from the later rounds' nodes,
    whose number depends on the tasks and the depth and not on the table's rows."""
    nodes = rounds[0]
    for r in rounds[1:]:
        nodes = nodes.unionByName(r)
    known = nodes.filter("parent IS NULL").select(*_VALUES)
    if len(rounds) == 1:
        return known
    later = rounds[1]
    for r in rounds[2:]:
        later = later.unionByName(r)
    names = later.select(F.col("node").alias("parent"), F.col("conv_id").alias("named"))
    if names.count() * 64 <= BROADCAST_BYTES:
        names = F.broadcast(names)
    below = nodes.filter("parent IS NOT NULL").drop("node").join(names, "parent").withColumn("parent_conv_id", F.col("named"))
    return known.unionByName(below.select(*_VALUES))
