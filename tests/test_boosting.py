"""Trees of all symbols at once against a loop over symbols, nodes, features and bins."""

import math
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators.boosting import Boosting, fit_all, score_all

SCHEMA = "symbol string, a double, b double, c double, y int, status string"
NAMES = ["a", "b", "c"]
P = Boosting(rounds=3, depth=2, bins=8, least_rows=4)


def table(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for symbol, n in sizes.items():
        for _ in range(n):
            a, b, c = rng.gauss(0, 1), rng.choice([None, float("nan"), 1.0, 2.0, 3.0]), float(rng.randint(0, 4))
            chance = 1 / (1 + math.exp(-2 * a - (b == 2.0)))
            rows.append((symbol, round(a, 3), b, c, int(rng.random() < chance), "x"))
    return rows


def quantile(values, share):
    return sorted(values)[max(math.ceil(share * len(values)), 1) - 1]


def loop(rows, p):
    """Base, cuts and trees of one symbol."""
    missing = lambda v: v is None or math.isnan(v)
    cuts = []
    for f in range(3):
        known = [r[1 + f] for r in rows if not missing(r[1 + f])]
        cuts.append(sorted({quantile(known, i / p.bins) for i in range(1, p.bins)}))
    codes = [[0 if missing(r[1 + f]) else 1 + sum(c < r[1 + f] for c in cuts[f]) for f in range(3)] for r in rows]
    y = [r[4] for r in rows]
    base = math.log(sum(y) / (len(y) - sum(y)))
    margin, trees = [base] * len(rows), []
    for _ in range(p.rounds):
        q = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a - b for a, b in zip(q, y)], [a * (1 - a) for a in q]
        node, tree = [0] * len(rows), []
        for level in range(p.depth):
            for at in range(2**level - 1, 2 ** (level + 1) - 1):
                own = [i for i in range(len(rows)) if node[i] == at]
                best = None
                score = lambda some: sum(g[i] for i in some) ** 2 / (sum(h[i] for i in some) + p.l2)
                for f in range(3):
                    for b in range(p.bins + 1):
                        left, right = [i for i in own if codes[i][f] <= b], [i for i in own if codes[i][f] > b]
                        if min(len(left), len(right)) < p.least_rows or not any(codes[i][f] == b for i in own):
                            continue
                        gain = round(score(left) + score(right) - score(own), 9)
                        if gain > p.least_gain and (best is None or gain > best[2]):
                            best = (f, b, gain)
                tree.append(best)
            for i in range(len(rows)):
                if node[i] < len(tree) and node[i] >= 2**level - 1 and tree[node[i]]:
                    f, b, _ = tree[node[i]]
                    node[i] = 2 * node[i] + 1 + (codes[i][f] > b)
        leaf = {at: -p.rate * sum(g[i] for i in range(len(rows)) if node[i] == at) / (sum(h[i] for i in range(len(rows)) if node[i] == at) + p.l2) for at in set(node)}
        margin = [m + leaf[n] for m, n in zip(margin, node)]
        trees.append(tree)
    return base, trees, [1 / (1 + math.exp(-m)) for m in margin]


@pytest.fixture(scope="module")
def rows():
    few = [("few", float(i), 1.0, 1.0, i % 2, "x") for i in range(6)]
    one = [("one", float(i), 1.0, 1.0, 1, "x") for i in range(40)]
    return table(3, {"hot": 400, "b": 90, "c": 40}) + few + one + [(None, 1.0, 1.0, 1.0, 1, "x"), ("hot", 1.0, 1.0, 1.0, None, "x")]


def test_trees_equal_a_loop_over_symbols(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    models = fit_all(df, NAMES, "y", P)
    got = {r["symbol"]: r for r in models.collect()}
    assert {s: r["status"] for s, r in got.items()} == {"hot": "ok", "b": "ok", "c": "ok", "few": "too few rows", "one": "one class"}
    scored = score_all(df.select("symbol", *NAMES, "y"), models, NAMES, P.depth).collect()
    assert len(scored) == len(rows) and {r["status"] for r in scored if r["symbol"] is None} == {"no model"}
    for symbol in ("hot", "b", "c"):
        base, trees, chances = loop([r for r in rows if r[0] == symbol and r[4] is not None], P)
        assert got[symbol]["base"] == pytest.approx(base)
        found = [[(s["feature"], s["bin"], s["gain"]) if s else None for s in t["tree"]] for t in got[symbol]["trees"]]
        assert [[s and s[:2] for s in t] for t in found] == [[s and s[:2] for s in t] for t in trees]
        for some, want in zip(found, trees):
            assert [s and s[2] for s in some] == pytest.approx([s and s[2] for s in want], abs=2e-9)
        assert sorted(r["probability"] for r in scored if r["symbol"] == symbol and r["y"] is not None) == pytest.approx(sorted(chances))
    assert all(r["probability"] is None for r in scored if r["status"] != "ok")


def test_jobs_do_not_grow_with_symbols(spark):
    """The same number of jobs for three and for sixty symbols."""
    tracker, used = spark.sparkContext.statusTracker(), []
    for n in (3, 60):
        group = f"boosting-{n}"
        spark.sparkContext.setJobGroup(group, group)
        df = spark.createDataFrame(table(5, {f"s{i}": 30 for i in range(n)}), SCHEMA)
        fit_all(df, NAMES, "y", Boosting(rounds=1, depth=1)).write.format("noop").mode("overwrite").save()
        used.append(len(tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(used[1] - used[0]) <= 2, used


def test_nothing_to_fit(spark):
    assert fit_all(spark.createDataFrame([], SCHEMA), NAMES, "y", Boosting(rounds=1, depth=1)).filter(F.col("trees").isNotNull()).count() == 0


def test_bins_of_a_scored_row_are_made_once(spark):
    """Not again inside the fold over trees, for every level of each."""
    rows = spark.createDataFrame(table(3, {"m": 60}), SCHEMA)
    models = fit_all(rows, NAMES, "y", Boosting(rounds=1, depth=1, bins=4))
    plan = score_all(rows.drop("status"), models, NAMES, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "filter(" in line]
    assert not [line for line in plan.splitlines() if "aggregate(" in line and "filter(" in line]
