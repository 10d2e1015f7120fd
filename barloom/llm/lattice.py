"""Likelihood of texts under a subword vocabulary: all segmentations of a word count, weighted by piece scores."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.pieces import SPACE, load_pieces
from barloom.llm.shingles import long_batch, rows, with_ids
from barloom.llm.text import written

LN10 = math.log(10)
SUMS = ("base", "score", "whole_word")  # what is summed over a text's tokens
END = b""  # the token after the last word; no word is empty
#: Documents whose crc32 of the id leaves this remainder are held out.
FOLDS, HELD_OUT = 10, 0
SMOOTH = 0.1
#: Distinct words a task holds before it hands its counts on.
HELD_WORDS = 300_000
#: Most frequent words sent to every task, and the longest of them in bytes: bounds the table to some tens of MB.
HOT_WORDS, HOT_BYTES = 200_000, 64
#: Taken from every counted word and left to the segmentations (absolute discounting).
DISCOUNT = 0.75
#: Weight of the vocabulary's own scores, in pieces, against the expected counts.
PRIOR_PIECES = 1000.0


def held_out(doc_id: int | None) -> bool:
    """Rows without an id are never held out."""
    return doc_id is not None and crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


class Lattice:
    """Forward and backward sums over the segmentations of a word, with its leading space mark, in log space.

    A trie of the pieces gives the edges from each byte; a character that is no piece by itself has one more edge, its
    bytes. Pieces never cross words, so a text's probability is the product over its words and the end.
    """

    def __init__(self, pieces: list[tuple[str, float, str]], log_p: list[float] | None = None):
        self.log_p = rank_prior(pieces) if log_p is None else log_p
        self.trie: dict = {}
        self.byte = {}
        self.single = set()
        for i, (piece, _, kind) in enumerate(pieces):
            if kind == "byte":
                self.byte[int(piece[3:-1], 16)] = i
            elif kind == "piece" and SPACE not in piece[1:]:
                node = self.trie
                for b in piece.replace(SPACE, " ").encode():
                    node = node.setdefault(b, {})
                node[-1] = i
                if len(piece) == 1:
                    self.single.add(piece.replace(SPACE, " ").encode())

    def edges(self, data: bytes) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each byte the (end, log probability, pieces) of what may begin there."""
        log_p, trie, n = self.log_p, self.trie, len(data)
        out: list[list] = [[] for _ in range(n)]
        for i in range(n):
            if data[i] & 0xC0 == 0x80:
                continue  # inside a character
            node, j, here = trie, i, out[i]
            while j < n:
                node = node.get(data[j])
                if node is None:
                    break
                j += 1
                piece = node.get(-1)
                if piece is not None:
                    here.append((j, log_p[piece], (piece,)))
            j = i + 1
            while j < n and data[j] & 0xC0 == 0x80:
                j += 1
            if data[i:j] not in self.single:
                spelled = tuple(self.byte[b] for b in data[i:j])
                here.append((j, sum(log_p[p] for p in spelled), spelled))
        return out

    def forward(self, word: bytes) -> float:
        """Log probability of the word: the sum over all segmentations."""
        data, log_p, trie, single, exp, log1p = b" " + word, self.log_p, self.trie, self.single, math.exp, math.log1p
        n = len(data)
        alpha: list[float | None] = [None] * (n + 1)
        alpha[0] = 0.0
        for i in range(n):
            a = alpha[i]
            if a is None:
                continue
            node, j = trie, i
            while j < n:
                node = node.get(data[j])
                if node is None:
                    break
                j += 1
                piece = node.get(-1)
                if piece is not None:
                    now, old = a + log_p[piece], alpha[j]
                    if old is None:
                        alpha[j] = now
                    elif now > old:
                        alpha[j] = now + log1p(exp(old - now))
                    else:
                        alpha[j] = old + log1p(exp(now - old))
            j = i + 1
            while j < n and data[j] & 0xC0 == 0x80:
                j += 1
            if data[i:j] not in single:
                now, old = a + sum(log_p[self.byte[b]] for b in data[i:j]), alpha[j]
                alpha[j] = now if old is None else max(now, old) + log1p(exp(-abs(now - old)))
        return alpha[n]

    def expect(self, word: bytes, weight: float, into: list[float]) -> None:
        """Add the expected number of each piece over the word's segmentations, ``weight`` times."""
        data = b" " + word
        edges, n = self.edges(data), len(data) + 0
        alpha, beta = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        alpha[0] = beta[n] = 0.0
        exp, log1p = math.exp, math.log1p
        for i in range(n):
            a = alpha[i]
            if a == -math.inf:
                continue
            for j, p, _ in edges[i]:
                now, old = a + p, alpha[j]
                alpha[j] = now if old == -math.inf else max(now, old) + log1p(exp(-abs(now - old)))
        for i in range(n - 1, -1, -1):
            b = -math.inf
            for j, p, _ in edges[i]:
                now = beta[j] + p
                if now != -math.inf:
                    b = now if b == -math.inf else max(now, b) + log1p(exp(-abs(now - b)))
            beta[i] = b
        total = alpha[n]
        for i in range(n):
            a = alpha[i] - total
            if a == -math.inf:
                continue
            for j, p, spelled in edges[i]:
                share = weight * exp(a + p + beta[j])
                for piece in spelled:
                    into[piece] += share


def rank_prior(pieces: list[tuple[str, float, str]]) -> list[float]:
    """Log probabilities from the file's scores. A merge vocabulary scores a piece by minus its rank, which Zipf's law
    turns into a share 1 / (rank + 10); byte pieces get the share of the last rank. Control pieces have none."""
    ranks = [max(0.0, -score) for _, score, kind in pieces if kind == "piece" and score > -1e8]
    last = max(ranks, default=1.0)
    share = [0.0 if kind == "control" else 1 / ((last if kind == "byte" or score <= -1e8 else max(0.0, -score)) + 10) for _, score, kind in pieces]
    total = sum(share)
    return [math.log(s / total) if s else -math.inf for s in share]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, count in training documents (0 for words seen in held-out documents only)."""
    counts: Counter[bytes] = Counter()
    others: set[bytes] = set()

    def out() -> pa.RecordBatch:
        unseen = list(others - counts.keys())
        n = np.r_[np.fromiter(counts.values(), np.int64, len(counts)), np.zeros(len(unseen), np.int64)]
        return pa.RecordBatch.from_arrays([pa.array([*counts, *unseen], pa.binary()), pa.array(n)], names=["word", "c"])

    for doc_id, text in rows(batches):
        words = text.lower().split()
        if held_out(doc_id):
            others.update(words)
            others.add(END)
        else:
            counts.update(words)
            counts[END] += 1
        if len(counts) + len(others) >= HELD_WORDS:
            yield out()
            counts, others = Counter(), set()
    if counts or others:
        yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (lower-cased A to Z, bytes), c: summed in each task before the shuffle, then over all of them; written."""
    return written(docs.mapInArrow(_word_counts, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


def fitted(counts: DataFrame, pieces: list[tuple[str, float, str]]) -> list[float]:
    """Log probabilities of the pieces: one expectation step over every counted word from the file's own scores.

    Every task sums over its words; the driver gets one number per piece. No piece is left without a share, and the
    last entry is the end of a text.
    """
    prior = rank_prior(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, into = Lattice(pieces, prior), [0.0] * len(pieces)
        for word, c in rows(batches):
            lattice.expect(word, c, into)
        used = [i for i, x in enumerate(into) if x]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([into[i] for i in used], pa.float64())], names=["piece", "n"])

    words = counts.filter((F.col("c") > 0) & (F.octet_length("word") > 0))
    found = words.mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    ends = counts.filter(F.octet_length("word") == 0).agg(F.sum("c")).first()[0] or 0
    n = np.array([PRIOR_PIECES * math.exp(p) for p in prior])
    for piece, expected in found:
        n[piece] += expected
    total = n.sum() + ends + 1
    with np.errstate(divide="ignore"):
        return [*np.log(n / total).tolist(), math.log((ends + 1) / total)]


def hot_count(table: DataFrame) -> int:
    """The count from which at most HOT_WORDS words on have it, from the numbers of words by steps of the count."""
    step = F.floor(F.log2("c") * 16)
    sums = table.filter((F.col("c") > 0) & (F.octet_length("word") <= HOT_BYTES)).groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"))
    bound, total = 2**62, 0
    for row in sorted(sums.collect(), key=lambda r: -r.s):  # a few hundred steps
        total += row.n
        if total > HOT_WORDS:
            break
        bound = row.least
    return bound


def scored(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, whole_word_score for every row of ``docs``.

    score is the log10 probability of the text's words and its end, each word summed over all segmentations into
    pieces. whole_word_score adds one edge to a counted word's lattice, the whole word: (c - DISCOUNT) / N, and the mass
    so freed weighs the segmentations, so a word never seen still has its subword probability. base_score is that of
    the smoothed word counts. Only rows that are not held out teach either model. Null and empty
    texts have the end alone; rows without an id teach; equal rows are scored each. Frequent words are looked up in a
    table of bounded size inside the task and leave one sum per document; the others meet the full word table by a
    shuffle, where no word is frequent any more.
    """
    spark = docs.sparkSession
    pieces = load_pieces(model_file)
    docs = with_ids(docs)
    counts = word_counts(docs)
    total, distinct = counts.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    total, distinct = total or 0, distinct or 0
    *log_p, log_end = fitted(counts, pieces)
    below = math.log10(total + SMOOTH * (distinct + 1))

    left = math.log(DISCOUNT * distinct / total) if total else 0.0

    def word_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, log_p)
        for batch in batches:
            c = batch.column(1).to_numpy()
            base = np.log10(c + SMOOTH) - below
            score = np.array([lattice.forward(w) if w else log_end for w in batch.column(0).to_pylist()], np.float64)
            with np.errstate(divide="ignore"):
                edge = np.log(np.maximum(c - DISCOUNT, 0) / max(total, 1))
            whole_word = np.logaddexp(edge, left + score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base), pa.array(score / LN10), pa.array(whole_word / LN10)], names=["word", "c", *SUMS])

    table = written(counts.mapInArrow(word_scores, "word binary, c long, base double, score double, whole_word double"), "word-scores")
    top = table.filter((F.octet_length("word") <= HOT_BYTES) & (F.col("c") >= hot_count(table))).collect()
    hot = spark.sparkContext.broadcast({bytes(r[0]): (int(r[1] > 0), r[2], r[3], r[4]) for r in top})
    kinds = [("rid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), *[(c, pa.float64()) for c in SUMS], ("word", pa.binary()), ("times", pa.int64())]
    schema = pa.schema(kinds)
    own = len(kinds) - 2  # columns of a document's row

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per document with the sums over its frequent words, and a row per rare word of it."""
        table_, rid = hot.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            found, rare = [], ([], [], [])
            for doc_id, text in rows([batch]):
                words = Counter(text.lower().split())
                words[END] += 1
                known, base, score, whole_word = 0, 0.0, 0.0, 0.0
                for word, n in words.items():
                    hit = table_.get(word)
                    if hit is None:
                        for into, value in zip(rare, (rid, word, n)):
                            into.append(value)
                    else:
                        known += n * hit[0]
                        base += n * hit[1]
                        score += n * hit[2]
                        whole_word += n * hit[3]
                found.append((rid, doc_id, words.total(), known, base, score, whole_word))
                rid += 1
            n, m = len(found), len(rare[0])
            columns = list(zip(*found, strict=True)) if n else [()] * own
            full = [pa.concat_arrays([pa.array(c, k), pa.nulls(m, k)]) for c, (_, k) in zip(columns, kinds)]
            full[0] = pa.concat_arrays([pa.array(columns[0], pa.int64()), pa.array(rare[0], pa.int64())])
            full += [pa.concat_arrays([pa.nulls(n, k), pa.array(c, k)]) for c, (_, k) in zip(rare[1:], kinds[own:])]
            yield pa.RecordBatch.from_arrays(full, schema=schema)

    both = written(docs.mapInArrow(looked_up, "rid long, doc_id long, n_tokens long, known long, base double, score double, whole_word double, word binary, times long"), "text-scores")
    rare = both.filter("word is not null").select("rid", "word", "times").join(table.select("word", "c", *[F.col(x).alias(f"{x}_w") for x in SUMS]), "word")
    rare = rare.groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known_r"),
        *[F.sum(F.col("times") * F.col(f"{x}_w")).alias(f"{x}_r") for x in SUMS],
    )
    full = both.filter("word is null").select("rid", "doc_id", "n_tokens", "known", *SUMS).join(rare, "rid", "left")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT
    return full.select(
        "doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("known_r", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        *[(F.col(x) + F.coalesce(f"{x}_r", F.lit(0.0))).alias("score" if x == "score" else f"{x}_score") for x in SUMS],
    )
