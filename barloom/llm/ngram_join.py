"""Jaccard self-join of shingle sets: prefixes under several global token orders, then exact overlap of candidates."""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.components import components
from barloom.llm.shingles import SIZE, long_batch, mixed, rows, set_id, shingle_sets, with_ids
from barloom.llm.text import scratch, small_side, written

THRESHOLD = 75
#: Token orders: each puts frequent tokens last and scrambles the rest, the first as they are hashed, the others by their
#: own seed. The first makes candidates.
ORDERS = (1, 2, 3)
#: Tokens of the first order that two similar sets are asked to share; their prefixes are longer by as many less one.
SHARED = 2
#: Tokens gathered in a task before they are sorted and sent on.
CHUNK = 1_000_000
#: A token counts as frequent from so many sets of one chunk and of all chunks; only that many are sent to last place.
#: Any choice gives the same links; it spares candidates that share nothing but a common passage.
LOCAL_FREQUENT, FREQUENT, MOST_FREQUENT = 4, 32, 500_000
#: Prefix tokens that one reducing group holds.
GROUP = 250_000
#: Sets with one token from which their sketches are compared inside a task, block by block, before a pair is a row.
MANY, BLOCK = 64, 2000
#: In such a block: sets held against all others at once, tokens in a table of who holds them, sketch cells at once.
STRIP, VALUES, SKETCH_CELLS = 256, 4096, 4_000_000


def prefix_length(n: int, threshold: int = THRESHOLD) -> int:
    """Two sets at or above the threshold share a token within this many first tokens of each, in any order."""
    return n - math.ceil(n * threshold / 100) + 1


def shared_tokens(threshold: int = THRESHOLD) -> int:
    """SHARED, or less where different sets at or above the threshold may have fewer tokens in common."""
    return max(1, min(SHARED, math.ceil(threshold / max(1, 100 - threshold))))


class _Known:
    """Which of many tokens belong to a sorted set: a table of leading bits is asked first, as nearly none do."""

    BITS = 22

    def __init__(self, tokens: np.ndarray):
        self.tokens, self.lead = tokens, np.zeros(1 << self.BITS, bool)
        self.lead[tokens >> np.uint64(64 - self.BITS)] = True

    def among(self, tokens: np.ndarray) -> np.ndarray:
        found = self.lead[tokens >> np.uint64(64 - self.BITS)]
        at = np.flatnonzero(found)
        if len(at):
            t = tokens[at]
            found[at] = self.tokens[np.minimum(np.searchsorted(self.tokens, t), len(self.tokens) - 1)] == t
        return found


def _prefix(tokens: np.ndarray, common: np.ndarray, seed: int, threshold: int, more: int = 0) -> np.ndarray:
    """The first of sorted tokens under (``common`` or not, scrambled by the seed), ``more`` than two similar sets need
    to share one: then they share as many more."""
    k = prefix_length(len(tokens), threshold) + more
    if k >= len(tokens):
        return tokens
    if seed == ORDERS[0]:  # tokens are hashes: their own order is one more scramble, and they are sorted by it
        rare = tokens[~common]
        return rare[:k] if len(rare) >= k else np.r_[rare, tokens[common][: k - len(rare)]]
    keys = (mixed(tokens, seed) >> np.uint64(1)) | (common.astype(np.uint64) << np.uint64(63))
    # equal keys cannot tell tokens apart, so all tokens up to the k-th key belong to the prefix
    return tokens[keys <= np.partition(keys, k - 1)[k - 1]]


def sketch(tokens: np.ndarray) -> bytes:
    """Tokens counted by their leading bits, one or two to a bucket. The sum of the lesser counts of two sketches is
    never below the overlap of their sets. Empty where a count does not fit a byte: then nothing is known."""
    bits = max(4, math.ceil(math.log2(max(1, len(tokens) / 2))))
    counts = np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    if counts.max(initial=0) >= 256:
        return b""
    # the counts are nearly all 0 to 4: codes of few bits each, which the codec of a shuffle would not find
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15, 8, zlib.Z_HUFFMAN_ONLY)
    return deflate.compress(counts.astype(np.uint8).tobytes()) + deflate.flush()


def _counts(s: bytes | None) -> np.ndarray:
    """The counts of a sketch, none where nothing is known."""
    return np.frombuffer(zlib.decompress(s, -15) if s else b"", np.uint8)


def most_shared(s: bytes, t: bytes, n: int) -> int:
    """Bound of the overlap of two sets from their sketches, ``n`` where there is none."""
    if not s or not t:
        return n
    a, b = _counts(s).astype(np.int64), _counts(t).astype(np.int64)
    if len(a) > len(b):
        a = a.reshape(len(b), -1).sum(axis=1)
    elif len(b) > len(a):
        b = b.reshape(len(a), -1).sum(axis=1)
    return int(np.minimum(a, b).sum())


def _sets(size: int):
    """doc_id, n, node, sketch for every document; token, count for tokens that many sets of a chunk hold."""
    names = ["doc_id", "n", "node", "sketch", "token", "count"]
    schema = pa.schema([(c, pa.binary() if c == "sketch" else pa.int64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, total = [], set(), 0

        def frequent() -> pa.RecordBatch | None:
            if not held:
                return None
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts >= LOCAL_FREQUENT
            none = pa.nulls(int(many.sum()), pa.int64())
            empty = pa.nulls(len(none), pa.binary())
            return pa.RecordBatch.from_arrays([none, none, none, empty, pa.array(tokens[many].view(np.int64)), pa.array(counts[many])], schema=schema)

        for batch in batches:
            ids, sizes, nodes, sketches = batch.column(0), [], [], []
            for tokens in shingle_sets(batch.column(1), size):
                node = set_id(tokens)
                sizes.append(len(tokens))
                nodes.append(node)
                new = len(tokens) > 0 and node not in seen
                sketches.append(sketch(tokens) if new else None)
                if new:
                    seen.add(node)
                    held.append(tokens)
                    total += len(tokens)
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary()), none, none], schema=schema)
            if total >= CHUNK:
                yield frequent()
                held, seen, total = [], set(), 0
        if held:
            yield frequent()

    return run, ", ".join(f"{c} {'binary' if c == 'sketch' else 'long'}" for c in names)


def _posts(size: int, threshold: int, frequent, groups: int):
    """Prefix tokens by reducing group, each with the leading set of the chunk that has it; sets of one chunk that
    share a token are linked to that leader at once, so a common token costs one entry per chunk.

    A set leads before others if more of its tokens are frequent ones (``ranks`` from 0 on): of many copies of a text
    the one nearest to all of them. Within its group (about GROUP tokens) a token goes by 32 bits: two that share them
    become one, which costs a vain comparison and loses nothing, as a set with two such tokens gives one more.
    """
    asked = shared_tokens(threshold)
    schema = pa.schema([("part", pa.int64()), ("kind", pa.int64()), ("tokens", pa.binary()), ("nodes", pa.binary()), ("others", pa.binary())])

    def part_of(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (t % np.uint64(groups)).astype(np.int64), (t // np.uint64(groups)).astype(np.uint32)

    def first_of(found: np.ndarray, common: np.ndarray) -> np.ndarray:
        lost = 0
        while True:
            first = _prefix(found, common, ORDERS[0], threshold, asked - 1 + lost)
            names = np.sort(_named(*part_of(first)))
            twice = np.count_nonzero(names[1:] == names[:-1])
            if twice <= lost:
                return first
            lost = twice

    def packed(tokens: np.ndarray, nodes: np.ndarray, ranks: np.ndarray) -> Iterator[tuple]:
        order = np.lexsort((nodes, ranks, tokens))
        tokens, nodes, ranks = tokens[order], nodes[order], ranks[order]
        first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        counts = np.diff(np.r_[first, len(tokens)])
        leaders = np.repeat(nodes[first], counts)
        shared = np.repeat(counts > 1, counts)
        t, n, lead = tokens[shared], nodes[shared], leaders[shared]
        for i in range(0, len(t), 50_000):
            cut = slice(i, i + 50_000)
            part, low = part_of(t[cut])
            # these need no group of their token: dealt by a set, so that many copies of one text do not meet
            yield -1 - int(n[i] % groups), 1, _named(part, low).tobytes(), n[cut].tobytes(), lead[cut].tobytes()
        t, n, r = tokens[first], nodes[first], ranks[first]
        part, t = part_of(t)
        order = np.argsort(part, kind="stable")
        part, t, n, r = part[order], t[order], n[order], r[order]
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(t)], strict=True):
            yield int(part[a]), 0, t[a:b].tobytes(), n[a:b].tobytes(), r[a:b].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(frequent.value)
        tokens, nodes, ranks, seen, total = [], [], [], set(), 0

        def flush() -> pa.RecordBatch:
            sizes = [len(t) for t in tokens]
            of_all = np.repeat(np.array(nodes, np.int64), sizes), np.repeat(np.array(ranks, np.uint8), sizes)
            columns = zip(*packed(np.concatenate(tokens), *of_all), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for found in itertools.chain.from_iterable(shingle_sets(batch.column(0), size) for batch in batches):
            node = set_id(found)
            if not len(found) or node in seen:
                continue
            seen.add(node)
            common = known.among(found)
            first = first_of(found, common)
            tokens.append(first)
            ranks.append(round(255 * (1 - np.count_nonzero(common) / len(common))))
            nodes.append(node)
            total += len(first)
            if total >= CHUNK:
                yield flush()
                tokens, nodes, ranks, seen, total = [], [], [], set(), 0
        if tokens:
            yield flush()

    return run, "part long, kind long, tokens binary, nodes binary, others binary"


def _named(part: np.ndarray | int, low: np.ndarray) -> np.ndarray:
    return part << 32 | low.astype(np.int64)


def _shared(table: pa.Table) -> pa.Table:
    """Of one reducing group: token, node, leader for tokens that more than one set has. Links made in a chunk come in
    groups of their own and pass."""
    out = [[], [], []]
    tokens, nodes, ranks, part = [], [], [], table.column("part")[0].as_py()
    for kind, t, n, other in rows(table.select(["kind", "tokens", "nodes", "others"]).to_batches()):
        if kind:
            for into, blob in zip(out, (t, n, other), strict=True):
                into.append(np.frombuffer(blob, np.int64))
        else:
            tokens.append(_named(part, np.frombuffer(t, np.uint32)))
            nodes.append(np.frombuffer(n, np.int64))
            ranks.append(np.frombuffer(other, np.uint8))
    if tokens:
        t, n = np.concatenate(tokens), np.concatenate(nodes)
        order = np.lexsort((n, np.concatenate(ranks), t))
        t, n = t[order], n[order]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        counts = np.diff(np.r_[first, len(t)])
        lead, several = np.repeat(n[first], counts), np.repeat(n[first] != n[first + counts - 1], counts)
        for into, values in zip(out, (t[several], n[several], lead[several]), strict=True):
            into.append(values)
    names = ["token", "node", "leader"]
    return pa.table({c: np.concatenate(v) if v else np.empty(0, np.int64) for c, v in zip(names, out, strict=True)})


def _node_sets(size: int):
    schema = pa.schema([("node", pa.int64()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(batch.column(0), size))
            yield pa.RecordBatch.from_arrays([pa.array([set_id(t) for t in found], pa.int64()), pa.array([t.tobytes() for t in found], pa.binary())], schema=schema)

    return run, "node long, tokens binary"


def _folded(sketches: np.ndarray, width: int) -> np.ndarray:
    return sketches.reshape(len(sketches), width, -1).sum(axis=2, dtype=np.uint16)


class _Sketches:
    """The sketches of a block's sets, by width."""

    def __init__(self, column: pa.ChunkedArray, n: np.ndarray):
        found = [_counts(x) for x in column.to_pylist()]
        self.n, self.width = n, np.array([len(x) for x in found])
        self.row, self.of_width, self.folded = np.zeros(len(found), np.int64), {}, {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.row[at] = np.arange(len(at))
            self.of_width[w] = np.array([found[i] for i in at]) if w else None

    def _at(self, width: int, own: int) -> np.ndarray:
        if own == width:
            return self.of_width[own]
        if (own, width) not in self.folded:
            self.folded[own, width] = _folded(self.of_width[own], width)
        return self.folded[own, width]

    def most_shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bound of the overlap of the sets a[i] and b[i]."""
        most = np.minimum(self.n[a], self.n[b])
        for wa in np.unique(self.width[a]).tolist():
            for wb in np.unique(self.width[b]).tolist():
                w = min(wa, wb)
                pairs = np.flatnonzero((self.width[a] == wa) & (self.width[b] == wb)) if w else ()
                for i in range(0, len(pairs), step := max(1, SKETCH_CELLS // max(1, w))):
                    cut = pairs[i : i + step]
                    x, y = self._at(w, wa)[self.row[a[cut]]], self._at(w, wb)[self.row[b[cut]]]
                    most[cut] = np.minimum(x, y).sum(axis=1, dtype=np.int64)
        return most


def _memberships(lists: pa.ChunkedArray) -> Iterator[np.ndarray]:
    """Which lists hold which of the values that several of them hold, as matrices of 0 and 1 of some values each."""
    lists = lists.combine_chunks()
    owner, values = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).to_numpy()
    _, code, count = np.unique(values, return_inverse=True, return_counts=True)
    several = count[code] > 1
    owner, code = owner[several], (np.cumsum(count > 1) - 1)[code[several]]
    for i in range(0, int(code.max(initial=-1)) + 1, VALUES):
        cut = (code >= i) & (code < i + VALUES)
        out = np.zeros((len(lists), int(code[cut].max()) - i + 1), np.float32)
        out[owner[cut], code[cut] - i] = 1
        yield out


def _block_pairs(threshold: int):
    """Of one block of a token's sets, or of two, the pairs of different labels that sizes and sketches leave possible.

    The sets of the label with most sets are not held against each other: they have the same label. A pair that shares
    a smaller token, too (``smaller``: of those that many sets have), is left to that one, so it is given once in all
    and its sketches are compared once.
    """

    def run(table: pa.Table) -> pa.Table:
        node, label, n, block = (table.column(c).to_numpy() for c in ("node", "label", "n", "block"))
        labels, counts = np.unique(label, return_counts=True)
        few = label != labels[counts.argmax()]
        at = np.flatnonzero(few)
        two = block.min() != block.max()
        sketches, holds = None, None
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in range(0, len(at), STRIP):
            f = at[i : i + STRIP]
            ok = (label[f][:, None] != label) & (~few | (node[f][:, None] > node))
            ok &= 100 * np.minimum(n[f][:, None], n) >= threshold * np.maximum(n[f][:, None], n)
            if two:
                ok &= block[f][:, None] != block
            if not ok.any():
                continue
            holds = list(_memberships(table.column("smaller"))) if holds is None else holds
            for m in holds:
                ok &= m[f] @ m.T == 0
            x, y = np.nonzero(ok)
            if not len(x):
                continue
            sketches = _Sketches(table.column("sketch"), n) if sketches is None else sketches
            x = f[x]
            most = sketches.most_shared(x, y)
            near = 100 * most >= threshold * (n[x] + n[y] - most)
            a.append(node[x[near]])
            b.append(node[y[near]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _possible(threshold: int):
    """The pairs that the sizes and sketches of both sets leave possible."""
    names = ["a", "b", "rep_a", "rep_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for a, b, rep_a, rep_b, n, m, s, t in rows([batch]):
                most = most_shared(s, t, min(n, m))
                if 100 * most >= threshold * (n + m - most):
                    kept.append((a, b, rep_a, rep_b))
            yield long_batch(names, *np.array(kept, np.int64).reshape(-1, 4).T)

    return run, ", ".join(f"{c} long" for c in names)


def _verified(threshold: int, frequent):
    """a, b for pairs that pass the prefix filter of every further order and then the exact overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(frequent.value)
        for batch in batches:
            a, b = [], []
            for x, y, s, t in rows([batch]):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                cs, ct = known.among(s), known.among(t)
                if any(not len(np.intersect1d(_prefix(s, cs, k, threshold), _prefix(t, ct, k, threshold), assume_unique=True)) for k in ORDERS[1:]):
                    continue
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= threshold * (len(s) + len(t) - both):
                    a.append(x)
                    b.append(y)
            yield long_batch(["a", "b"], np.array(a, np.int64), np.array(b, np.int64))

    return run, "a long, b long"


class _Join:
    """One run of the join; tables between its steps are written."""

    def __init__(self, docs: DataFrame, size: int, threshold: int):
        self.spark, self.size, self.threshold = docs.sparkSession, size, threshold
        self.docs = with_ids(docs)
        run, schema = _sets(size)
        found = written(self.docs.mapInArrow(run, schema), "shingle-sets")
        self.members = written(found.filter("n is not null").select("doc_id", "n", "node"), "members")
        many = (
            found.filter("token is not null").groupBy("token").agg(F.sum("count").alias("sets"))
            .filter(F.col("sets") >= FREQUENT).orderBy(F.desc("sets"), "token").limit(MOST_FREQUENT)
        )
        # at most MOST_FREQUENT numbers, whatever the input
        tokens = np.array([r[0] for r in many.select("token").collect()], np.int64)
        self.frequent = self.spark.sparkContext.broadcast(np.sort(tokens.view(np.uint64)))
        # one row per different set: its size, its sketch and a document that has it
        own = found.filter("n > 0 and doc_id is not null")
        self.nodes = written(own.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.max("sketch").alias("sketch")), "nodes")

    def posts(self) -> DataFrame:
        tokens = self.nodes.agg(F.sum("n")).first()[0] or 0
        groups = max(64, tokens * (100 - self.threshold) // 100 // GROUP)
        run, schema = _posts(self.size, self.threshold, self.frequent, groups)
        spread = self.docs.filter("doc_id is not null").select("t").mapInArrow(run, schema)
        return written(spread.groupBy("part").applyInArrow(_shared, "token long, node long, leader long"), "posts")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, checked) whose sets are similar enough. Sizes and then sketches (where ``checked`` does not
        say that they were held against each other) leave few others for the exact overlap, for which the texts of those
        documents alone are read again."""
        for side in ("a", "b"):
            pairs = pairs.join(self.nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("rep").alias(f"rep_{side}")), side)
        near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.threshold
        sized = written(pairs.filter(near), "sized-pairs")
        unseen = sized.filter("not checked")
        for side in ("a", "b"):
            unseen = unseen.join(self.nodes.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}")), side)
        unseen = unseen.select("a", "b", "rep_a", "rep_b", "n_a", "n_b", "sketch_a", "sketch_b")
        passed = unseen.mapInArrow(*_possible(self.threshold)).union(sized.filter("checked").select("a", "b", "rep_a", "rep_b"))
        pairs = written(passed, "pairs")
        used = written(pairs.select(F.col("rep_a").alias("doc_id")).union(pairs.select(F.col("rep_b").alias("doc_id"))).distinct(), "pair-docs")
        n = used.count()
        texts = self.docs.join(small_side(used, n), "doc_id", "left_semi")
        sets = texts.select("t").mapInArrow(*_node_sets(self.size))
        if self.members.join(used, "doc_id", "left_semi").count() > n:  # a doc_id that stands in several rows
            sets = sets.dropDuplicates(["node"])
        pairs = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("s")), "a")
        pairs = pairs.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("t")), "b").select("a", "b", "s", "t")
        return written(pairs.mapInArrow(*_verified(self.threshold, self.frequent)), "links")

    def across(self, posts: DataFrame) -> DataFrame:
        """a, b, checked: different sets of different labels that share enough tokens of ``posts`` (token, node, label,
        sets), or one that many sets have; checked where such a token had their sketches compared."""
        near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.threshold
        few = posts.filter(F.col("sets") <= MANY).join(self.nodes.select("node", "n"), "node")
        x = few.select("token", F.col("node").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"))
        y = few.select("token", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"))
        pairs = x.join(y, "token").filter((F.col("la") < F.col("lb")) & near).select("a", "b")
        many = posts.filter(F.col("sets") > MANY)
        own = many.groupBy("node").agg(F.collect_list("token").alias("common"))  # within a set's own prefix
        many = many.join(own, "node").join(self.nodes.select("node", "n", "sketch"), "node")
        many = many.withColumn("smaller", F.filter("common", lambda t: t < F.col("token")))
        blocks = F.ceil(F.col("sets") / BLOCK)
        many = many.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        many = many.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
        found = many.select("token", "lo", "hi", "node", "label", "n", "sketch", "smaller", "block").groupBy("token", "lo", "hi").applyInArrow(_block_pairs(self.threshold), "a long, b long")
        pairs = pairs.withColumn("checked", F.lit(False)).union(found.withColumn("checked", F.lit(True)))
        pairs = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("checked").alias("checked"), F.count(F.lit(1)).alias("tokens"))
        return pairs.filter(F.col("checked") | (F.col("tokens") >= shared_tokens(self.threshold))).select("a", "b", "checked")

    def labels(self) -> DataFrame:
        """node, label. First every set is compared with the leading set that shares enough tokens; then, where a token still
        joins sets of different labels, those sets with each other. Sets already joined need no further look."""
        posts = self.posts()
        stars = posts.filter("node != leader").groupBy(F.col("node").alias("a"), F.col("leader").alias("b")).agg(F.count(F.lit(1)).alias("tokens"))
        stars = stars.filter(F.col("tokens") >= shared_tokens(self.threshold)).select("a", "b")
        links = self.links(stars.withColumn("checked", F.lit(False)))
        first = components(links)
        named = posts.select("token", "node").join(first, "node", "left").withColumn("label", F.coalesce("label", "node"))
        named = written(named, "named-posts")
        sums = F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("sets")
        live = named.groupBy("token").agg(*sums).filter("lo != hi").select("token", "sets")
        rest = written(named.join(live, "token").distinct(), "live-posts")
        if rest.isEmpty():
            return first
        cross = written(self.across(rest), "cross-pairs")
        done = stars.union(stars.select("b", "a"))
        more = self.links(cross.join(done, ["a", "b"], "left_anti"))
        if more.isEmpty():
            return first
        return components(links.union(more))


def near_copies(docs: DataFrame, size: int = SIZE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text, any others).

    Texts link when 100 * |A and B| >= threshold * |A or B| over their sets of ``size``-word shingles; the component is
    the smallest doc_id that links reach. Null, empty and blank texts have no shingles and are their own component; a
    text of fewer words is one shingle. Equal sets are one set throughout, so copies cost nothing after the first step.
    Rows without a doc_id have a null component; rows repeated with one doc_id are all returned.
    """
    with scratch() as drop_all_but:
        join = _Join(docs, size, threshold)
        labels = join.labels()
        nodes = join.nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select("node", "rep", "label")
        smallest = nodes.groupBy("label").agg(F.min("rep").alias("least"))
        nodes = written(nodes.join(smallest, "label").select("node", "least"), "node-components")
        drop_all_but(join.members, nodes)
    full = join.members.join(nodes, "node", "left")
    own = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return full.select("doc_id", F.col("n").alias("n_shingles"), F.when(own, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each component the one with the smallest doc_id, once.

    Documents without words or without a doc_id all stay.
    """
    found = written(near_copies(docs.select("doc_id", "text")), "components")
    lost = written(found.filter("component_id != doc_id").select("doc_id").distinct(), "lost")
    kept = docs.join(small_side(lost), "doc_id", "left_anti").select(docs.columns)
    # rows that repeat a doc_id with words: only ids travel to find them
    twice = written(found.filter("n_shingles > 0 and component_id = doc_id").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    n = twice.count()
    if n == 0:
        return kept
    again = kept.join(small_side(twice, n), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return kept.join(small_side(twice, n), "doc_id", "left_anti").select(docs.columns).unionByName(again)
