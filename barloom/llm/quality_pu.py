"""Quality from trusted positives and unlabelled text: non-negative unbiased risk with an estimated class prior."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from barloom.llm.shingles import rows, with_ids
from barloom.llm.text import written

FOLDS, HELD_OUT = 4, 2
#: Rows that the fit reads on the driver at most: trusted positives, and unlabelled documents. Both are chosen by a
#: hash of the id, so the draw is the same every time.
MOST_TRUSTED, MOST_UNLABELLED = 20_000, 40_000
#: Scores from which a document is predicted good.
CUT = 0.7
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 40, 512, 3e-3, 1e-4
BINS = 200
#: Chance with which the bound of the class prior may fail.
DELTA = 0.1
_MARKS = [bytes([c]) for c in b"#*$%&|<>!?.,;:"]
FEATURES = 30


def features(text: bytes) -> list[float]:
    """Shares and logarithms that do not grow with the text, from its words, lines and characters only."""
    words = text.split()
    n, size = len(words), len(text)
    low = [w.lower() for w in words]
    counts = Counter(low)
    lines = [x for x in text.split(b"\n") if x.strip()]
    grams = [xxh3_64_intdigest(b" ".join(low[i : i + 4])) for i in range(n - 3)]
    upper = sum(map(bytes.isupper, words))
    lengths = np.fromiter(map(len, words), np.int64, n)
    per = 1 / max(n, 1)
    return [
        np.log1p(n), np.log1p(size), float(n < 5), float(n < 20), float(n < 50),
        float(lengths.mean()) if n else 0.0, float(lengths.std()) if n else 0.0, float((lengths <= 3).mean()) if n else 0.0, float((lengths > 12).mean()) if n else 0.0,
        len(counts) * per, counts.most_common(1)[0][1] * per if n else 0.0,
        len(set(grams)) / max(len(grams), 1) if grams else 1.0,
        np.log1p(len(lines)), len(set(lines)) / max(len(lines), 1) if lines else 1.0, np.log1p(n / max(len(lines), 1)),
        upper * per, *[min(text.count(m) * per, 2.0) for m in _MARKS],
    ]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([features(t) for t in batch.column(1).to_pylist()], np.float32).reshape(-1, FEATURES)
        values = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), FEATURES).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["doc_id", "x"])


@dataclass
class Model:
    """Standardised features through one hidden layer; ``logits`` is the log odds of good."""

    mean: np.ndarray
    spread: np.ndarray
    w: list[np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(self.scaled(x) @ self.w[0] + self.w[1], 0)
        return hidden @ self.w[2] + self.w[3]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -5, 5)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -50, 50)))


def _slope(z: np.ndarray, sign: float) -> np.ndarray:
    """Derivative of log(1 + exp(-sign * z))."""
    return -sign / (1 + np.exp(np.clip(sign * z, -50, 50)))


def _loss(z: np.ndarray, sign: float) -> float:
    return float(np.logaddexp(0, -sign * z).mean())


def fit(trusted: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = 11) -> Model:
    """Adam on the non-negative risk prior*E_p[l(+)] + max(0, E_u[l(-)] - prior*E_p[l(-)]); where the part in the
    maximum falls below zero, the step only raises it again. Without a prior, plain trusted against unlabelled."""
    rng = np.random.default_rng(seed)
    mean, spread = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    model = Model(mean, spread, [])
    p, u = model.scaled(trusted), model.scaled(unlabelled)
    d = p.shape[1]
    w = [rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0

    def gradient(x: np.ndarray, slope) -> tuple[list[np.ndarray], np.ndarray]:
        inner = x @ w[0] + w[1]
        hidden = np.maximum(inner, 0)
        z = hidden @ w[2] + w[3]
        dz = slope(z) / len(x)
        back = np.outer(dz, w[2]) * (inner > 0)
        return [x.T @ back, back.sum(axis=0), hidden.T @ dz, dz.sum(keepdims=True)], z

    for _ in range(EPOCHS):
        order = rng.permutation(len(u))
        for i in range(0, len(u), BATCH):
            xu = u[order[i : i + BATCH]]
            xp = p[rng.integers(0, len(p), min(BATCH, len(p)))]
            up, zp = gradient(xp, lambda z: _slope(z, 1.0))
            down_u, zu = gradient(xu, lambda z: _slope(z, -1.0))
            if prior is None:
                total = [0.5 * (a + b) for a, b in zip(up, down_u)]
            else:
                down_p, _ = gradient(xp, lambda z: _slope(z, -1.0))
                negative = _loss(zu, -1.0) - prior * _loss(zp, -1.0)
                unbiased = [b - prior * c for b, c in zip(down_u, down_p)]
                total = [prior * a + b for a, b in zip(up, unbiased)] if negative >= 0 else [-b for b in unbiased]
            step += 1
            for k, g in enumerate(total):
                g = g + DECAY * w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model.w = w
    return model


def class_prior(trusted: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from histograms of scores (counts per bin, best bin last).

    For every cut the share of unlabelled above it, over that of trusted above it, bounds the prior from above if the
    top is pure; of the least bound, half of what it allows for the error of both counts is kept.
    """
    p, u = trusted[::-1].cumsum(), unlabelled[::-1].cumsum()
    if not p[-1] or not u[-1]:
        return 0.5
    qp, qu = p / p[-1], u / u[-1]
    error = np.sqrt(np.log(4 / DELTA) / 2) * (p[-1] ** -0.5 + u[-1] ** -0.5)
    ok = qp > 2 * error if (qp > 2 * error).any() else qp > 0
    bound = (qu[ok] + error) / qp[ok]
    best = int(np.argmin(bound))
    return float(np.clip((bound[best] + qu[ok][best] / qp[ok][best]) / 2, 0.01, 0.99))


def _histogram(x: DataFrame, model: Model) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            values = batch.column(0).flatten().to_numpy().reshape(-1, FEATURES)
            total += np.bincount(np.minimum((model.scores(values) * BINS).astype(int), BINS - 1), minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(total)], names=["bin", "n"])

    out = np.zeros(BINS)
    for b, n in x.select("x").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n")).collect():
        out[b] = n
    return out


def _drawn(x: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` rows: those below a cut of the id's hash that leaves a few less, so that no task sends more."""
    n, space = x.count(), 1 << 30
    if n > most:
        x = x.filter(F.pmod(F.xxhash64("doc_id"), F.lit(space)) < int(space * 0.95 * most / n))
    drawn = x.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("x").collect()
    return np.array([r[0] for r in drawn], np.float64).reshape(-1, FEATURES)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text); ``labels`` has doc_id, quality.

    Trusted positives are the rows labelled 1 outside the held-out fold (a doc_id labelled both ways is not trusted);
    everything else outside that fold is unlabelled, whatever its label says. The network is fitted on bounded draws
    of both on the driver; the class prior comes from the scores of all rows of both. Null and empty texts are scored
    as texts without words; equal rows are scored each; rows without doc_id are scored and teach nothing. With no
    trusted or no unlabelled row every score is 0.5.
    """
    docs = with_ids(docs)
    table = written(docs.mapInArrow(_featured, "doc_id long, x array<float>"), "quality-features")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    trusted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q"))
    trusted = trusted.filter("doc_id is not null").groupBy("doc_id").agg(F.min("q").alias("q")).filter("q = 1").select("doc_id")
    seen = table.filter(~out & F.col("doc_id").isNotNull())
    good = written(seen.join(trusted, "doc_id", "left_semi"), "trusted")
    rest = written(seen.join(trusted, "doc_id", "left_anti"), "unlabelled")
    p, u = _drawn(good, MOST_TRUSTED), _drawn(rest, MOST_UNLABELLED)
    if len(p) and len(u):
        # odd rows of the draw are kept from the first fit, so that the histogram of the trusted is not its own
        rough = fit(p[::2], u[::2], None)
        prior = class_prior(_histogram(good, rough), _histogram(rest, rough))
        model = fit(p, u, prior)
    else:
        model = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy().reshape(-1, FEATURES).astype(np.float64)
            score = np.full(batch.num_rows, 0.5) if model is None else model.scores(values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    found = table.mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
