"""Centroid clustering against a loop in whole numbers, and the bounds of the simplex projection."""

from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import numpy as np

from barloom.llm import centroids
from barloom.llm.centroids import DIMENSIONS, Nearest, Simplex, clustered

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, apex int, v double"


def loop(rows: list[tuple], rounds: int = 10) -> list[tuple]:
    """vec_id, cluster, distance, cluster_inertia, inertia, digest: no projection, no numpy."""
    kept = []
    for vec_id, vector, *_ in rows:
        if vector is not None and len(vector) == 64 and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, [math.floor(Fraction(x) * 1024) for x in vector]))
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:8]
    centres = [v for _, v in start]

    def near(v: list[int]) -> tuple[int, int]:
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        groups: dict[int, list] = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [[sum(c) // len(groups[i]) for c in zip(*groups[i])] if i in groups else old for i, old in enumerate(centres)]
    found = [(vec_id, *near(v)[::-1]) for vec_id, v in kept]
    fits = lambda x: x if x < 2**63 else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [
        (vec_id, c, fits(d), fits(sum(x for _, k, x in found if k == c)), fits(sum(x for *_, x in found)), digests[c])
        for vec_id, c, d in found
    ]


def held(spark, rows: list[tuple]) -> None:
    wide = [(i, v, 0, "x", 1, 2.0) for i, v in rows]
    got = [tuple(r)[:6] for r in clustered(spark.createDataFrame(wide, SCHEMA).repartition(5)).collect()]
    order = lambda r: (str(r[0]), r[1], str(r[2]))
    assert sorted(got, key=order) == sorted(loop(rows), key=order)


def groups(n: int, seed: int, spread: float = 0.1) -> list[tuple]:
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(DIMENSIONS)] for _ in range(6)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(middles)]) for i in range(n)]


def test_clusters_of_random_and_grouped_vectors(spark):
    rng = random.Random(1)
    held(spark, groups(150, 2))
    held(spark, [(i, [rng.gauss(0, 0.2) for _ in range(DIMENSIONS)]) for i in range(120)])


def test_kept_vectors_repeated_rows_ties_and_null_ids(spark):
    base = groups(40, 3)
    bad = [
        (900, None), (901, []), (902, [0.1] * 63), (903, [0.1] * 65), (904, [None] + [0.1] * 63), (905, [float("nan")] + [0.1] * 63),
        (906, [float("inf")] + [0.1] * 63), (907, [-float("inf")] + [0.1] * 63),
    ]
    same = [0.25] * DIMENSIONS
    held(spark, base + bad + [(None, same), (None, same), (5, same)] + [(100 + i, same) for i in range(30)] + base[:10])


def test_a_few_vectors_and_none(spark):
    held(spark, groups(3, 4))
    held(spark, [(1, [0.0] * DIMENSIONS)] * 4)
    assert clustered(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_beyond_64_bits(spark):
    rows = groups(30, 5)
    rows += [(100 + i, [(-1) ** i * 10.0 ** (4 + 12 * i)] + [0.5] * 63) for i in range(8)]
    held(spark, rows)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(7)
    points = np.floor(rng.normal(0, 300, (400, DIMENSIONS)))
    others = np.floor(rng.normal(0, 300, (20, DIMENSIONS)))
    simplex = Simplex(np.vstack([others[:8], others[:2], (others[0] + others[1])[None] / 2]))
    assert simplex.size == 8  # repeated pivots and one in the plane of the others are left out
    low, high = simplex.bounds(*simplex.apexes(points), *simplex.apexes(others))
    true = ((points[:, None] - others[None]) ** 2).sum(axis=2)
    assert (low <= true).all() and (true <= high).all()
    assert (high - low)[:, :8].max() < 1e-3 * true.max() and (high > low).all()
    near = Nearest(simplex, [[int(x) for x in c] for c in others[:8] + np.floor(rng.normal(0, 3, (8, DIMENSIONS)))])
    cluster, distance, compared = near.of(points, *simplex.apexes(points))
    exact = ((points[:, None] - near.whole[None]) ** 2).sum(axis=2)
    assert (cluster == exact.argmin(axis=1)).all() and distance == exact.min(axis=1).tolist()
    assert compared.mean() < 4  # of eight: without bounds all of them


def test_pivots_do_not_change_results(spark, monkeypatch):
    rows = spark.createDataFrame([(i, v, 0, "x", 1, 2.0) for i, v in groups(100, 8)], SCHEMA)
    some = sorted(tuple(r)[:6] for r in clustered(rows).collect())
    monkeypatch.setattr(centroids, "RENEWED", ())
    assert sorted(tuple(r)[:6] for r in clustered(rows).collect()) == some
