"""Centroid clustering of integer vectors; an n-simplex projection says which centroids need an exact comparison.

The distances of a vector to a few pivots fix its place over the simplex that the pivots span: coordinates within its
plane, and the height above it. For two such apexes the Euclidean distance with heights on the same side is a lower bound
of the true distance, and with one height mirrored an upper bound. Apexes of the vectors are computed once and stored;
a round only places the centroids, drops those whose lower bound exceeds the least upper bound, and compares the rest in
exact integers. Bounds are tight where centroids lie low over the pivots' plane, so the pivots are centroids of an
earlier round. As centroids slow down, each set of pivots serves twice as many rounds as the one before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import written

DIMENSIONS = 64
CENTROIDS = 8
ROUNDS = 10
SEED = 3
SCALE = 1024
#: Rounds after which the centroids become the pivots. They decide speed, never results.
RENEWED = (1, 2, 4, 8, 16, 32, 64)
#: A pivot whose height over the earlier ones is below this part of the widest distance adds little and is left out.
FLAT = 0.05
#: Components up to this size have squared distances within 64 bits; larger ones are compared as Python integers.
NARROW = 2**27
_LONG = 2**63 - 1
_BATCH = 4096


def _valid(v: Column) -> Column:
    sound = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & (F.abs(x * SCALE) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(v) == DIMENSIONS) & sound, F.lit(False))


class Simplex:
    """The base simplex of some pivots: places points by their distances to them alone."""

    def __init__(self, sample: np.ndarray):
        chosen = [0] if len(sample) else []
        squares = self._squares(sample, sample[:1]).ravel() if chosen else np.zeros(0)
        widest = float(squares.max()) if chosen else 0.0
        lower = np.zeros((0, 0))
        least = squares.copy()
        while chosen and least.max(initial=0) > 0:
            # farthest first; a candidate that lies nearly in the plane of the others is passed over
            at = int(least.argmax())
            least[at] = 0
            edges = self._squares(sample[at : at + 1], sample[chosen]).ravel()
            row, height = self._place(lower, self._own(lower), edges[None, :])
            if height[0] > FLAT * np.sqrt(widest):
                n = len(chosen) - 1
                grown = np.zeros((n + 1, n + 1))
                grown[:n, :n] = lower
                grown[n, :n], grown[n, n] = row[0], height[0]
                lower = grown
                chosen.append(at)
                least = np.minimum(least, self._squares(sample, sample[at : at + 1]).ravel())
        self.pivots = sample[chosen]
        self.lower = lower
        inverse = np.linalg.inv(lower) if len(lower) else np.zeros((0, 0))
        # what rounding may do to a coordinate, for distances of 1: see `slack`
        self.rounding = 16 * np.finfo(float).eps * max(1, len(lower)) * (np.linalg.norm(inverse, 2) if len(lower) else 0.0)

    @property
    def size(self) -> int:
        """Numbers in an apex: the coordinates in the plane and the height."""
        return len(self.pivots)

    @staticmethod
    def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)

    @staticmethod
    def _own(lower: np.ndarray) -> np.ndarray:
        return (lower**2).sum(axis=1)

    @staticmethod
    def _place(lower: np.ndarray, own: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates and height of points from their squared distances to the pivots."""
        sides = (squares[:, :1] + own[None, :] - squares[:, 1:]) / 2
        flat = np.linalg.solve(lower, sides.T).T if len(lower) else sides
        return flat, np.sqrt(np.maximum(0.0, squares[:, 0] - (flat**2).sum(axis=1)))

    def apexes(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Apex of each point, and its greatest squared distance to a pivot, which scales the slack of its bounds."""
        if not self.size:
            return np.zeros((len(points), 0)), np.zeros(len(points))
        squares = np.empty((len(points), self.size))
        for j, p in enumerate(self.pivots):
            squares[:, j] = ((points - p) ** 2).sum(axis=1)
        flat, height = self._place(self.lower, self._own(self.lower), squares)
        return np.hstack([flat, height[:, None]]), squares.max(axis=1)

    def slack(self, reach: np.ndarray) -> np.ndarray:
        """More than rounding can add to a squared bound: the height is a root, so the root of the relative error counts."""
        relative = self.rounding * np.sqrt(reach) + 64 * np.finfo(float).eps
        return 8 * reach * (relative + np.sqrt(relative))

    def bounds(self, a: np.ndarray, a_reach: np.ndarray, b: np.ndarray, b_reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared lower and upper bounds of the distances between the points of two lists of apexes."""
        if not self.size:
            return np.zeros((len(a), len(b))), np.full((len(a), len(b)), np.inf)
        flat = self._squares(a[:, :-1], b[:, :-1])
        slack = self.slack(np.maximum(a_reach[:, None], b_reach[None, :]))
        low = flat + (a[:, None, -1] - b[None, :, -1]) ** 2 - slack
        return low, flat + (a[:, None, -1] + b[None, :, -1]) ** 2 + slack


def _whole_numbers(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width or 1, dtype=np.int32) if width else np.zeros(n + 1, np.int32)), pa.array(rows.ravel()))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _BATCH):
            yield batch.slice(at, _BATCH)


def _with_apexes(simplex: Simplex):
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            v = _whole_numbers(batch)
            with np.errstate(over="ignore", invalid="ignore"):
                apex, reach = simplex.apexes(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), _lists(apex), pa.array(reach)],
                names=["vec_id", "v", "apex", "reach"],
            )

    return placed


class Nearest:
    """The nearest centroid of vectors, exactly; ``compared`` tells how many centroids the bounds left for each."""

    def __init__(self, simplex: Simplex, centroids: list[list[int]]):
        self.simplex = simplex
        self.centroids = centroids
        self.narrow = all(abs(x) <= NARROW for c in centroids for x in c)
        if self.narrow:
            self.whole = np.array(centroids, np.int64).reshape(-1, DIMENSIONS)
            self.apex, self.reach = simplex.apexes(self.whole.astype(float))

    def of(self, v: np.ndarray, apex: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
        """Cluster, squared distance and number of exact comparisons of each vector."""
        cluster = np.zeros(len(v), np.int64)
        distance = np.zeros(len(v), np.int64)
        compared = np.zeros(len(v), np.int64)
        small = (np.abs(v).max(axis=1, initial=0) <= NARROW) if self.narrow else np.zeros(len(v), bool)
        if small.any():
            w = v[small].astype(np.int64)
            low, high = self.simplex.bounds(apex[small], reach[small], self.apex, self.reach)
            open_ = low <= high.min(axis=1)[:, None]
            best = np.full(len(w), _LONG)
            which = np.zeros(len(w), np.int64)
            for c in range(len(self.centroids)):  # in ascending order: of equal distances the smaller number stays
                rows = np.flatnonzero(open_[:, c])
                d = ((w[rows] - self.whole[c]) ** 2).sum(axis=1)
                closer = d < best[rows]
                best[rows[closer]], which[rows[closer]] = d[closer], c
            cluster[small], distance[small], compared[small] = which, best, open_.sum(axis=1)
        exact = distance.tolist()
        for i in np.flatnonzero(~small):  # beyond 64 bits: every centroid, in Python integers
            own = [int(x) for x in v[i]]
            each = [sum((a - b) ** 2 for a, b in zip(own, c)) for c in self.centroids]
            exact[i] = min(each)
            cluster[i], compared[i] = each.index(exact[i]), len(each)
        return cluster, exact, compared

    def of_batch(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
        v = _whole_numbers(batch)
        apex = batch.column("apex").flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
        return v, *self.of(v, apex, batch.column("reach").to_numpy(zero_copy_only=False))


_SUMS = "cluster long, part long, n string, inertia string, sums array<string>"
_SUMS_ARROW = pa.schema([("cluster", pa.int64()), ("part", pa.int64()), ("n", pa.string()), ("inertia", pa.string()), ("sums", pa.list_(pa.string()))])


def _row(totals: dict[int, tuple[int, int, list[int]]], part: int) -> pa.RecordBatch:
    keys = sorted(totals)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array([part] * len(keys), pa.int64()), pa.array([str(totals[k][0]) for k in keys], pa.string()),
         pa.array([str(totals[k][1]) for k in keys], pa.string()), pa.array([[str(x) for x in totals[k][2]] for k in keys], pa.list_(pa.string()))],
        schema=_SUMS_ARROW,
    )


def _summed(nearest: Nearest):
    """One row per cluster of a task: count, distances and component sums, as exact decimal numbers."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        totals: dict[int, tuple[int, int, list[int]]] = {}
        for batch in _pieces(batches):
            v, cluster, distance, _ = nearest.of_batch(batch)
            for c in np.unique(cluster):
                rows = np.flatnonzero(cluster == c)
                w = v[rows]
                if np.abs(w).max() <= NARROW:
                    added = w.astype(np.int64).sum(axis=0).tolist()
                else:
                    added = [sum(int(x) for x in column) for column in w.T]
                n, inertia, old = totals.get(int(c), (0, 0, [0] * DIMENSIONS))
                totals[int(c)] = (n + len(rows), inertia + sum(distance[i] for i in rows), [a + b for a, b in zip(old, added)])
        yield _row(totals, TaskContext.get().partitionId() % 64)

    return sums


def _added(table: pa.Table) -> pa.Table:
    n, inertia, sums = 0, 0, [0] * DIMENSIONS
    for r in table.to_pylist():
        n, inertia = n + int(r["n"]), inertia + int(r["inertia"])
        sums = [a + int(b) for a, b in zip(sums, r["sums"])]
    return pa.Table.from_batches([_row({table["cluster"][0].as_py(): (n, inertia, sums)}, table["part"][0].as_py())])


def _totals(placed: DataFrame, nearest: Nearest) -> dict[int, tuple[int, int, list[int]]]:
    """Count, inertia and sums of each cluster. Tasks' sums meet in 64 groups first, so no group has a row of each task."""
    parts = placed.mapInArrow(_summed(nearest), _SUMS).groupBy("cluster", "part").applyInArrow(_added, _SUMS)
    rows = parts.groupBy("cluster").applyInArrow(_added, _SUMS).collect()  # one row per cluster
    return {r["cluster"]: (int(r["n"]), int(r["inertia"]), [int(x) for x in r["sums"]]) for r in rows}


_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, compared long"


def _result(nearest: Nearest, totals: dict[int, tuple[int, int, list[int]]]):
    def fits(x: int) -> int | None:
        return x if x <= _LONG else None

    all_ = fits(sum(t[1] for t in totals.values()))
    within = {c: fits(t[1]) for c, t in totals.items()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in nearest.centroids]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            _, cluster, distance, compared = nearest.of_batch(batch)
            of = cluster.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array([fits(d) for d in distance], pa.int64()),
                 pa.array([within[c] for c in of], pa.int64()), pa.array([all_] * len(of), pa.int64()),
                 pa.array([digests[c] for c in of], pa.string()), pa.array(compared)],
                names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared"],
            )

    return rows


def _placed(whole: DataFrame, centroids: list[list[int]]) -> tuple[DataFrame, Simplex]:
    """The vectors with their apexes over the simplex of some centroids, stored for the rounds to come."""
    sound = [c for c in centroids if all(abs(x) <= NARROW for x in c)]
    simplex = Simplex(np.array(sound, float).reshape(-1, DIMENSIONS))
    apexes = whole.select("vec_id", "v").mapInArrow(_with_apexes(simplex), "vec_id long, v array<double>, apex array<double>, reach double")
    return written(apexes, "apexes"), simplex


def clustered(df: DataFrame, vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Cluster, squared distance, inertias and digest of the final centroid of every kept vector.

    Kept are vectors of exactly 64 components, none null, NaN or infinite (or so large that 1024 times it is infinite);
    others have no row. Components become floor(1024 * x). Centroids start as the ``k`` kept vectors with the smallest
    sha256 of ``seed:vec_id``, in that order; a null vec_id comes last, and rows of one id follow by their components.
    Fewer kept vectors mean fewer centroids, an empty table no rows. Repeated rows count as often as they stand there.
    A distance or inertia beyond 64 bits is null. Columns other than vec_id and the vector are not read. ``compared`` is
    the number of centroids that the bounds left for the exact comparison of the last assignment.
    """
    spark = df.sparkSession
    x = F.col(f"`{vector}`").cast("array<double>")
    kept = df.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v")).filter(_valid(F.col("v")))

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            v = np.floor(_whole_numbers(batch) * SCALE) + 0.0  # no negative zero
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _lists(v)], names=["vec_id", "v"])

    whole = written(kept.mapInArrow(floored, "vec_id long, v array<double>"), "whole-vectors")
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), F.col("v")]
    centroids = [[int(c) for c in r["v"]] for r in whole.orderBy(*order).limit(k).select("v").collect()]
    if not centroids:
        return spark.createDataFrame([], _RESULT)
    placed, simplex = _placed(whole, centroids)
    for done in range(1, rounds + 1):
        totals = _totals(placed, Nearest(simplex, centroids))
        moved = [[s // totals[c][0] for s in totals[c][2]] if c in totals else old for c, old in enumerate(centroids)]
        if moved == centroids:  # further rounds would change nothing
            break
        centroids = moved
        if done in RENEWED:
            placed, simplex = _placed(whole, centroids)
    nearest = Nearest(simplex, centroids)
    return placed.mapInArrow(_result(nearest, _totals(placed, nearest)), _RESULT)
