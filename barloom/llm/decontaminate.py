"""Benchmark passages in documents: latent semantic search over TF-IDF windows, then word order and answer checks."""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shingles import long_batch, rows, small_batches, with_ids
from barloom.llm.text import scratch, small_side, written

#: Items of one pass over the texts, and their parts of one latent space. Larger benchmarks are done in such blocks.
PASS_ITEMS, SPACE_ITEMS = 4096, 256
#: Dimensions of a latent space, and random directions drawn beyond them.
RANK, OVERSAMPLE = 256, 32
#: Words of a passage and between the beginnings of two. Items of more words are searched for in parts.
WINDOW, STRIDE = 48, 24
#: A term in more than this share of the items (and in more than three) says nothing about one of them.
COMMON_SHARE, COMMON_ITEMS = 0.05, 3
#: Terms that a passage must hold to be looked at; the cosine from which it is a candidate for a part of an item, if it
#: also covers so much of the part's length along its direction. It is one at any cosine if it holds as many of the
#: part's terms as a copy or a paraphrase must (``least_shared``).
LEAST_TERMS, COSINE, COVER = 3, 0.4, 0.2
#: Share of an item's words found in order: a leak, or with the item's answer in place a paraphrase.
COPY, PARAPHRASE, ANSWER = 0.5, 0.35, 0.8
#: Items of fewer words must be found whole.
SHORT = 8
_PARTS = 64
#: Numbers of the latent spaces (terms by dimensions and by parts) that are sent to the tasks at one time; the spaces of
#: a larger benchmark are looked up in several passes over the texts, which stay where they are read.
SENT_SPOTS = 16_000_000
AT_ONCE = 2048  # passages that are dense vectors in a task at one time
#: Pairs of terms counted at one time, and distinct pairs that a task holds.
PAIRS_AT_ONCE, PAIRS_HELD = 1 << 21, 1 << 22
_PLAIN = bytes.maketrans((string.ascii_uppercase + string.punctuation).encode(), (string.ascii_lowercase + " " * len(string.punctuation)).encode())


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case (A to Z), ASCII punctuation parting them."""
    return text.translate(_PLAIN).split()


def in_order(masks: dict[bytes, int], n: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence, one integer operation per word: bits of ``v`` turn 0 where a word of
    the item is matched. ``masks`` has the places of each word of the item, ``n`` its length."""
    v = full = (1 << n) - 1
    for w in words:
        m = masks.get(w)
        if m is not None:
            v = ((v + (v & m)) | (v & ~m)) & full
    return n - v.bit_count()


class Item:
    """An item's words, their places, and its answer: telling words of its last sentences, at least three of them."""

    def __init__(self, text: bytes):
        self.words = tokens(text)
        self.masks: dict[bytes, int] = {}
        for i, w in enumerate(self.words):
            self.masks[w] = self.masks.get(w, 0) | 1 << i
        self.sentences = [tokens(s) for s in re.split(rb"(?<=[.!?])\s+", text)]
        self.answer: set[bytes] = set()
        self.answer_span = 0

    def know(self, telling) -> None:
        """Take the answer from the words that tell items apart, and note over how many words it stands."""
        for sentence in reversed(self.sentences):
            if len(self.answer) >= LEAST_TERMS:
                break
            self.answer.update(w for w in sentence if w in telling)
            self.answer_span += len(sentence)

    def found(self, words: list[bytes]) -> tuple[int, str | None]:
        """Words in order, and what that makes of the passage."""
        n = len(self.words)
        both = in_order(self.masks, n, words)
        if both >= max(math.ceil(COPY * n), min(n, SHORT)):
            return both, "copy"
        if n >= SHORT and self.answer and both >= PARAPHRASE * n and len(self.answer & set(words)) >= ANSWER * len(self.answer):
            return both, "paraphrase"
        return both, None


def vocabulary(items: list[Item]) -> dict[bytes, int]:
    """Terms that few items hold, numbered; those that most hold too where an item would have no others."""
    shared: dict[bytes, int] = {}
    for item in items:
        for w in item.masks:
            shared[w] = shared.get(w, 0) + 1
    limit = max(COMMON_ITEMS, COMMON_SHARE * len(items))
    keep = {w for item in items for w in item.masks if shared[w] <= limit or sum(shared[x] <= limit for x in item.masks) < 2 * LEAST_TERMS}
    return {w: i for i, w in enumerate(sorted(keep))}


def parts(item: Item) -> list[list[bytes]]:
    """The item's words in even parts of at most WINDOW words: one of them is copied in the share that the item is."""
    n = len(item.words)
    k = math.ceil(n / WINDOW)
    return [item.words[n * i // k : n * (i + 1) // k] for i in range(k)]


def least_shared(item: Item, part: list[bytes], telling) -> tuple[int, int]:
    """Distinct terms of a part, and distinct answer words, of which some passage of a copy (or of a paraphrase) holds
    one or the other number, whatever words were replaced: those words in order that cannot all be common ones.

    A stretch of STRIDE words lies in one passage. A longer copy stands in two that overlap by STRIDE words: the better
    one holds half of its terms, and lacks at most half of what exceeds STRIDE.
    """
    n = len(part)
    lacking = max(math.ceil(COPY * n), min(len(item.words), SHORT)) - sum(w not in telling for w in part)
    copy = 0
    for times in sorted(Counter(w for w in part if w in telling).values(), reverse=True):
        if lacking <= 0:
            break
        lacking, copy = lacking - times, copy + 1
    copy = max(math.ceil(copy / 2), copy - max(0, n - STRIDE) // 2)
    answer = math.ceil(math.ceil(ANSWER * len(item.answer)) / max(1, math.ceil(item.answer_span / STRIDE)))
    return max(LEAST_TERMS, copy), answer


def _held(known: dict[bytes, int], words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a document's terms, and the terms."""
    ids = np.fromiter(map(known.get, words, repeat(-1)), np.int32, len(words))
    at = np.flatnonzero(ids >= 0).astype(np.int32)
    return at, ids[at]


def _hits(terms):
    """doc_id, positions, terms: where a document holds terms, if one passage may hold enough of them; and with a null
    doc_id the number of documents of each term that this task saw."""
    schema = pa.schema([("doc_id", pa.int64()), ("positions", pa.binary()), ("terms", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        seen = np.zeros(len(known), np.int64)
        for batch in batches:
            out = []
            for doc_id, text in rows([batch]):
                at, ids = _held(known, tokens(text))
                if not len(at):
                    continue
                seen[np.unique(ids)] += 1
                if doc_id is not None and len(at) >= LEAST_TERMS and (at[LEAST_TERMS - 1 :] - at[: 1 - LEAST_TERMS or None]).min() < WINDOW:
                    out.append((doc_id, at.tobytes(), ids.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen.tobytes()], pa.binary())], schema=schema)

    return run, "doc_id long, positions binary, terms binary"


def _passages(held: list[tuple[np.ndarray, np.ndarray]], of_block: np.ndarray) -> tuple[np.ndarray, ...]:
    """doc (place in the list), first word, and by passage boundary the distinct terms of passages with enough terms."""
    nothing = (np.empty(0, np.int64),) * 4
    if not held:
        return nothing
    doc = np.repeat(np.arange(len(held)), [len(at) for at, _ in held])
    at, term = (np.concatenate(c).astype(np.int64) for c in zip(*held, strict=True))
    term = of_block[term].astype(np.int64)
    doc, at, term = doc[term >= 0], at[term >= 0], term[term >= 0]
    if not len(at):
        return nothing
    w = at // STRIDE
    starts, terms = int(w.max()) + 1, int(term.max()) + 1
    codes = []
    # a word lies in the passage that begins at its stride and in those before that reach it
    for back in range(math.ceil(WINDOW / STRIDE)):
        ok = (w >= back) & (at < (w - back) * STRIDE + WINDOW)
        codes.append(((doc[ok] * starts + w[ok] - back) * terms) + term[ok])
    codes = np.sort(np.concatenate(codes))
    place, term = np.divmod(codes[np.r_[True, codes[1:] != codes[:-1]]], terms)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    counts = np.diff(np.r_[first, len(place)])
    enough = counts >= LEAST_TERMS
    doc, start = np.divmod(place[first[enough]], starts)
    return doc, start * STRIDE, np.r_[0, np.cumsum(counts[enough])][:-1], term[np.repeat(enough, counts)]


def _summed(values: np.ndarray, bounds: np.ndarray, term: np.ndarray) -> np.ndarray:
    """The sum of the terms' rows for each passage: the first term of all passages, then the second of those that have
    one, and so on; a passage has WINDOW terms at most."""
    counts = np.diff(np.r_[bounds, len(term)])
    order = np.argsort(-counts, kind="stable")
    first, counts = bounds[order], -counts[order]
    total = values[term[first]]
    for d in range(1, -int(counts[0])):
        k = int(np.searchsorted(counts, -d))
        total[:k] += values[term[first[:k] + d]]
    out = np.empty_like(total)
    out[order] = total
    return out


def _pairs(bounds: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    """One number for every pair of terms of a passage, the smaller first, and for every term with itself."""
    passage = np.repeat(np.arange(len(bounds)), np.diff(np.r_[bounds, len(term)]))
    codes = [term * n + term]
    for d in range(1, WINDOW):
        same = passage[d:] == passage[:-d]
        if not same.any():
            break
        codes.append((term[:-d] * n + term[d:])[same])
    return np.concatenate(codes)


class _PairCounts:
    """Distinct pairs in order and how many passages hold each."""

    def __init__(self):
        self.new: list[np.ndarray] = []
        self.waiting = 0
        self.codes = self.counts = np.empty(0, np.int64)

    def add(self, codes: np.ndarray) -> None:
        self.new.append(codes)
        self.waiting += len(codes)
        if self.waiting >= PAIRS_AT_ONCE:
            self.count()

    def count(self) -> None:
        if not self.waiting:
            return
        codes, counts = np.unique(np.concatenate(self.new), return_counts=True)
        self.new, self.waiting = [], 0
        at = np.searchsorted(self.codes, codes)
        known = np.zeros(len(codes), bool)
        known[at < len(self.codes)] = self.codes[at[at < len(self.codes)]] == codes[at < len(self.codes)]
        self.counts[at[known]] += counts[known]
        self.codes, self.counts = np.insert(self.codes, at[~known], codes[~known]), np.insert(self.counts, at[~known], counts[~known])

    def times(self, weights: np.ndarray, r: np.ndarray, cross: np.ndarray) -> float:
        """Add A'A R of the counted passages to ``cross``, and return the sum of A's squares; the counts begin anew."""
        self.count()
        if not len(self.codes):
            return 0.0
        n, step = len(weights), 256
        a, b = np.divmod(self.codes, n)
        values = self.counts * weights[a] * weights[b]
        for low in range(0, n, step):
            at = slice(*np.searchsorted(a, [low, low + step]))
            block = np.zeros((min(step, n - low), n))
            block[a[at] - low, b[at]] = values[at]
            cross[low : low + step] += block @ r
            block[a[at] - low, a[at]] = 0.0  # a term with itself counts once
            cross += block.T @ r[low : low + step]
        energy = float(values[a == b].sum())
        self.codes = self.counts = np.empty(0, np.int64)
        return energy


def _random(n: int, k: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((n, k)).astype(np.float32)


def latent_space(hits: DataFrame, of_block: np.ndarray, weights: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Terms by dimensions: the leading right singular vectors of the TF-IDF matrix of all passages and of the items.

    Randomised: Y = A R for random R; every task adds its share of Y'Y and Y'A, which Spark sums by blocks of terms.
    A'A is how often two terms meet, so a task counts pairs of terms, and Y'A = R'(A'A) and Y'Y = (Y'A) R are taken
    once for all its passages and not for each. The driver gets those two (bounded by the block's terms and RANK +
    OVERSAMPLE, not by the input), makes Y's basis orthonormal and takes the small decomposition. The items' rows weigh
    as much as all passages together, so that an item seen once is in the space too.
    """
    n = len(weights)
    k = min(n, RANK + OVERSAMPLE)
    spark = hits.sparkSession
    shared = spark.sparkContext.broadcast((of_block, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, w = shared.value
        w, r = w.astype(np.float64), _random(n, k).astype(np.float64)
        cross, energy, met = np.zeros((n, k)), 0.0, _PairCounts()
        for batch in batches:
            *_, bounds, term = _passages([(np.frombuffer(at, np.int32), np.frombuffer(ids, np.int32)) for at, ids in rows([batch])], block)
            if not len(bounds):
                continue
            for low in range(0, len(bounds), AT_ONCE):
                own = bounds[low : low + AT_ONCE]
                met.add(_pairs(own - own[0], term[own[0] : bounds[low + AT_ONCE] if low + AT_ONCE < len(bounds) else None], n))
            if len(met.codes) > PAIRS_HELD:
                energy += met.times(w, r, cross)
        energy += met.times(w, r, cross)
        gram = r.T @ cross
        gram, cross = (gram + gram.T) / 2, cross.astype(np.float32)
        used = np.flatnonzero(cross.any(axis=1))
        parts = [(int(p), used[used % _PARTS == p].astype(np.int64)) for p in range(_PARTS)]
        out = [(p, ids.tobytes(), cross[ids].tobytes()) for p, ids in parts if len(ids)]
        if len(used):
            out.append((_PARTS, b"", np.r_[gram.ravel(), energy].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], names=["part", "ids", "sums"])

    def added(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part == _PARTS:
            total = sum(np.frombuffer(s, np.float64) for (s,) in rows(table.select(["sums"]).to_batches()))
            return pa.table({"part": [part], "ids": [b""], "sums": [total.tobytes()]})
        total = np.zeros((n, k))
        for ids, sums in rows(table.select(["ids", "sums"]).to_batches()):
            total[np.frombuffer(ids, np.int64)] += np.frombuffer(sums, np.float32).reshape(-1, k)
        ids = np.flatnonzero(total.any(axis=1))
        return pa.table({"part": [part], "ids": [ids.tobytes()], "sums": [total[ids].tobytes()]})

    kinds = "part long, ids binary, sums binary"
    gram, cross, energy = np.zeros((k, k)), np.zeros((n, k)), 0.0
    for part, ids, sums in hits.select("positions", "terms").mapInArrow(run, kinds).groupBy("part").applyInArrow(added, kinds).collect():
        if part == _PARTS:
            sums = np.frombuffer(sums, np.float64)
            gram, energy = sums[:-1].reshape(k, k).copy(), float(sums[-1])
        else:
            cross[np.frombuffer(ids, np.int64)] = np.frombuffer(sums, np.float64).reshape(-1, k)
    own = float((items**2).sum())
    share = max(1.0, energy / own) if own else 1.0
    y = items @ _random(n, k)
    gram += share * y.T @ y
    cross += share * items.T @ y
    values, vectors = np.linalg.eigh(gram)
    good = values > values.max(initial=0.0) * 1e-10
    basis = (cross @ vectors[:, good]) / np.sqrt(values[good])  # A' Q
    left, size, _ = np.linalg.svd(basis, full_matrices=False)
    return left[:, : min(RANK, int((size > 0).sum()))]


@dataclass
class Block:
    """Parts of items, the terms they use, and what a passage is compared with: the latent space, and the parts' terms.

    ``matrix`` has a row per part, ``of_item`` the item of each. ``held`` (terms by parts) has 1 for a part's term and
    256 more for a word of the answer, ``least`` what is asked of both: a passage has WINDOW terms at most, so that one
    sum of 16 bits counts them.
    """

    of_block: np.ndarray
    vectors: np.ndarray
    near: np.ndarray
    lengths: np.ndarray
    held: np.ndarray
    least: np.ndarray
    of_item: np.ndarray

    @classmethod
    def of(cls, of_block: np.ndarray, weights: np.ndarray, space: np.ndarray, matrix: np.ndarray, held: np.ndarray, least: np.ndarray, of_item: np.ndarray) -> Block:
        z = matrix @ space
        size = np.maximum(np.linalg.norm(z, axis=1), 1e-12)
        near = (z / size[:, None]).astype(np.float32)
        return cls(of_block, (space * weights[:, None]).astype(np.float32), near, size.astype(np.float32), held, least, of_item)

    def numbers(self) -> int:
        return self.vectors.size + self.held.size

    def candidates(self, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, int, float]]:
        """doc (place in the list), item, start, cosine of passages near a part of an item in the latent space, or with
        its terms."""
        doc, start, every, terms = _passages(held, self.of_block)
        copy, answer = self.least
        for low in range(0, len(every), AT_ONCE):
            bounds = every[low : low + AT_ONCE]
            term = terms[bounds[0] : every[low + AT_ONCE] if low + AT_ONCE < len(every) else None]
            bounds = bounds - bounds[0]
            x = _summed(self.vectors, bounds, term)
            along = x @ self.near.T
            cosine = along / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            same = _summed(self.held, bounds, term)
            own = same & 255
            told = (own >= LEAST_TERMS) & (same >> 8 >= answer)
            p, part = np.nonzero((cosine >= COSINE) & (along >= COVER * self.lengths) | (own >= copy) | told)
            yield from zip(doc[low + p].tolist(), self.of_item[part].tolist(), start[low + p].tolist(), cosine[p, part].tolist(), strict=True)


def _places(spots: Iterable[tuple[int, int]], items: list[Item]) -> Iterator[tuple[int, int, int]]:
    """item, first and last start of its candidates within a quarter of its length, which are looked at together: the
    many passages of a long copy, not those of an item of up to four strides."""
    at = None
    for i, start in sorted(spots):
        if at and at[0] == i and start - at[1] < len(items[i].words) // 4:
            at = i, at[1], start
            continue
        if at:
            yield at
        at = i, start, start
    if at:
        yield at


def _found(known, items: list[Item], arrays):
    """doc_id, item, words_in_order, kind, cosine: a text's candidates that the word order (and the answer) confirms.

    The word order is looked at where the candidates are found, so that no text and no candidate is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, blocks = known.value, [Block(**a) for a in arrays.value]
        for batch in batches:
            texts = [(doc_id, tokens(text)) for doc_id, text in rows([batch]) if doc_id is not None]
            held = [_held(terms, words) for _, words in texts]
            spots: dict[int, set[tuple[int, int]]] = {}
            near: dict[tuple[int, int], float] = {}
            for block in blocks:
                for d, i, start, cosine in block.candidates(held):
                    spots.setdefault(d, set()).add((i, start))
                    near[d, i] = max(cosine, near.get((d, i), -1.0))
            out = []
            for d, places in spots.items():
                (doc_id, words), best = texts[d], {}
                for i, first, last in _places(places, items):
                    item, reach = items[i], len(items[i].words)
                    both, kind = item.found(words[max(0, first - reach) : last + WINDOW + reach])
                    if kind and both > best.get(i, (0,))[0]:
                        best[i] = both, kind
                out += [(doc_id, i, both, kind, near[d, i]) for i, (both, kind) in best.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["doc_id", "item", "words_in_order", "kind", "cosine"])

    return run, "doc_id long, item long, words_in_order long, kind string, cosine double"


def _blocks(pieces: list[tuple[int, list[bytes], bool]]) -> Iterator[list[tuple[int, list[bytes], bool]]]:
    """Parts of one latent space each: whole items, but for an item of more than SPACE_ITEMS parts."""
    block: list[tuple[int, list[bytes], bool]] = []
    for _, own in groupby(pieces, key=lambda piece: piece[0]):
        own = list(own)
        if block and len(block) + len(own) > SPACE_ITEMS:
            yield block
            block = []
        block += own
        while len(block) > SPACE_ITEMS:
            yield block[:SPACE_ITEMS]
            block = block[SPACE_ITEMS:]
    if block:
        yield block


def _sent_together(blocks: Iterable[Block]) -> Iterator[list[Block]]:
    """Blocks of SENT_SPOTS numbers or so; those that share an item stay together."""
    group: list[Block] = []
    for block in blocks:
        if group and sum(b.numbers() for b in group) + block.numbers() > SENT_SPOTS and group[-1].of_item[-1] != block.of_item[0]:
            yield group
            group = []
        group.append(block)
    if group:
        yield group


def _one_pass(docs: DataFrame, found: list[tuple[int, bytes]], n_docs: int) -> DataFrame:
    spark = docs.sparkSession
    items = [Item(text) for _, text in found]
    terms = vocabulary(items)
    sent = spark.sparkContext.broadcast(terms)
    hits = written(docs.mapInArrow(*_hits(sent)), "term-hits")
    # numbers of documents: one number per term from each task, added by Spark, bounded by the items' words
    seen = hits.filter("doc_id is null").select(F.col("terms").alias("blob"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for (blob,) in rows(batches):
            total += np.frombuffer(blob, np.int64)
        yield long_batch(["term", "n"], np.flatnonzero(total), total[np.flatnonzero(total)])

    df = np.zeros(len(terms))
    for term, n in seen.mapInArrow(tally, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        df[term] = n
    idf = np.log((n_docs + 1) / (df + 0.5)).clip(0.1)
    hits = hits.filter("doc_id is not null")
    known = terms
    for item in items:
        item.know(known)
    terms = {w: t for w, t in known.items() if df[t]}
    pieces = [(i, part, k == 1) for i, item in enumerate(items) for k, part in zip(range(len(parts(item)), 0, -1), parts(item))]

    def made(block: list[tuple[int, list[bytes], bool]]) -> Block:
        asked = [{terms[w] for w in items[i].answer if last and w in terms} for i, _, last in block]
        own = [sorted({terms[w] for w in part if w in terms}) for _, part, _ in block]
        mine = sorted(set().union(*own, *asked))
        of_block = np.full(len(df), -1, np.int32)
        of_block[mine] = np.arange(len(mine), dtype=np.int32)
        weights = idf[mine].astype(np.float32)
        matrix, holds = np.zeros((len(block), len(mine))), np.zeros((len(mine), len(block)), np.uint16)
        for k in range(len(block)):
            matrix[k, of_block[own[k]]] = weights[of_block[own[k]]]
            holds[of_block[own[k]], k] = 1
            # the answer is looked for with the last part; its words before that count for both
            holds[of_block[list(asked[k])], k] = 257
        least = np.array([least_shared(items[i], part, known) for i, part, _ in block], np.uint16).T
        least[1][[not last for *_, last in block]] = WINDOW + 1
        return Block.of(of_block, weights, latent_space(hits, of_block, weights, matrix), matrix, holds, least, np.array([i for i, *_ in block]))

    leaks = None
    for group in _sent_together(map(made, _blocks(pieces))):
        part = docs.mapInArrow(*_found(sent, items, spark.sparkContext.broadcast([vars(block) for block in group])))
        leaks = part if leaks is None else leaks.unionByName(part)
    leaks = leaks.groupBy("doc_id", "item").agg(F.max("words_in_order").alias("words_in_order"), F.min("kind").alias("kind"), F.max("cosine").alias("cosine"))
    leaks = written(leaks, "leaks")
    names = spark.createDataFrame([(i, item_id, len(items[i].words)) for i, (item_id, _) in enumerate(found)], "item long, item_id long, item_words long")
    return leaks.join(F.broadcast(names), "item").select("doc_id", "item_id", "kind", "words_in_order", "item_words", "cosine")  # names: PASS_ITEMS rows at most


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, kind (copy or paraphrase), words_in_order, item_words, cosine: items that documents hold.

    ``benchmark`` (item_id, text) is the query set, searched in blocks against every passage of every document. A copy
    has at least half of the item's words in order near a candidate passage; a paraphrase has a third of them and the
    telling words of the item's last sentences. Null, empty and blank texts hold nothing and are in nothing; a short item must
    be there whole. Rows without doc_id are not searched; equal rows give one result; items that are equal are all
    named. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    docs = with_ids(docs)
    benchmark = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    benchmark = written(benchmark.dropDuplicates(["item_id", "text"]), "benchmark")
    n_docs = docs.count()
    out, last = None, None
    while True:
        block = benchmark if last is None else benchmark.filter(F.struct("item_id", "text") > F.struct(F.lit(last[0]).alias("item_id"), F.lit(last[1]).alias("text")))
        block = block.orderBy("item_id", "text").limit(PASS_ITEMS).collect()
        if not block:
            break
        last = block[-1]
        found = [(r.item_id, r.text.encode()) for r in block if tokens(r.text.encode())]
        if found:
            part = _one_pass(docs, found, n_docs)
            out = part if out is None else out.unionByName(part)
        if len(block) < PASS_ITEMS:
            break
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, kind string, words_in_order long, item_words long, cosine double")
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; rows without doc_id stay."""
    with scratch() as drop_all_but:
        found = written(leaks(docs.select("doc_id", "text"), benchmark).select("doc_id").distinct(), "leaking")
        drop_all_but(found)
    return docs.join(small_side(found), "doc_id", "left_anti").select(docs.columns)
