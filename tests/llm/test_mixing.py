"""Mixing: targets, budgets met over lengths, and the choice of documents."""

from __future__ import annotations

import random
from collections import Counter
from itertools import product

from barloom.llm import mixing
from barloom.llm.mixing import closest_sum, mixed, take_counts

SCHEMA = "doc_id long, text string, source string, n_chars long, size string, target int, h double, part string"


def table(spark, rows: list[tuple]):
    return spark.createDataFrame([(i, t, s, 0, "x", 1, 2.0, "y") for i, t, s in rows], SCHEMA)


def targets(sizes: dict) -> dict:
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    capped: dict = {}
    while True:
        open_ = [s for s in order if s not in capped]
        if not open_:
            return capped
        left = 1.5 * sum(sizes.values()) - sum(capped.values())
        now = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if now[s] > 2 * sizes[s]]
        if not over:
            return capped | now
        capped |= {s: 2 * sizes[s] for s in over}


def checked(rows: list[tuple], found: list, near: int = 1) -> None:
    """Sizes, targets and passes are as stated, and every source's words come within ``near`` of its target."""
    n_words = lambda t: len((t or "").split())
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += n_words(t)
    goal = targets(dict(sizes))
    assert sorted((repr(r["doc_id"]), r["size"]) for r in found) == sorted((repr(i), n_words(t)) for i, t, _ in rows)
    of = {}
    for i, _, s in rows:
        of.setdefault(i, s)
    taken = Counter()
    for r in found:
        s = of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - goal[s]) <= 1e-9 * max(1, goal[s])
        assert 0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= near, (s, taken[s], goal[s])


def sized_rows(rng: random.Random, sources: list, n: int, most: int = 60) -> list[tuple]:
    return [(i, " ".join(["w"] * rng.randint(1, most)), rng.choice(sources)) for i in range(n)]


def test_closest_sum_against_every_choice():
    rng = random.Random(4)
    for _ in range(200):
        lengths = rng.sample(range(1, 30), rng.randint(1, 4))
        counts = [rng.randint(0, 3) for _ in lengths]
        budget = rng.randint(0, 60)
        best = min(abs(sum(a * b for a, b in zip(lengths, k)) - budget) for k in product(*[range(c + 1) for c in counts]))
        took = closest_sum(lengths, counts, budget)
        assert all(0 <= k <= c for k, c in zip(took, counts))
        assert abs(sum(a * b for a, b in zip(lengths, took)) - budget) == best


def test_large_budgets_take_a_like_share_of_every_length():
    rng = random.Random(5)
    lengths = list(range(1, 400))
    counts = [rng.randint(50, 500) for _ in lengths]
    total = sum(a * b for a, b in zip(lengths, counts))
    took = take_counts(lengths, counts, total // 3)
    assert sum(a * b for a, b in zip(lengths, took)) == total // 3
    for some in (slice(0, 130), slice(130, 260), slice(260, 399)):
        assert abs(sum(took[some]) / sum(counts[some]) - 1 / 3) < 0.02
    alone = take_counts(list(range(1, 2000)), [1] * 1999, 600_000)  # every length once
    assert sum(a * b for a, b in zip(range(1, 2000), alone)) == 600_000 and max(alone) == 1


def test_sources_meet_their_targets(spark):
    rng = random.Random(6)
    rows = sized_rows(rng, ["b", "a", "ü", "Z", None, "c", "d"] + ["hot"] * 6, 800)
    checked(rows, mixed(table(spark, rows)).collect())


def test_reruns_agree_and_seeds_differ(spark):
    rows = sized_rows(random.Random(7), ["a", "b", "c"], 300)
    key = lambda f: sorted(map(tuple, f.collect()))
    first = key(mixed(table(spark, rows)))
    assert key(mixed(table(spark, rows[::-1]).repartition(7))) == first
    assert key(mixed(table(spark, rows), seed=14)) != first


def test_large_groups_are_ranked_in_parts(spark, monkeypatch):
    """A third of all documents have one length; parts of ten documents give the same counts as one ranking."""
    rng = random.Random(8)
    rows = sized_rows(rng, ["a", "b", "c"], 300) + [(1000 + i, "same five words in all", "c") for i in range(400)]
    whole = sorted(map(tuple, mixed(table(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "RANKED_TOGETHER", 10)
    parts = mixed(table(spark, rows)).collect()
    checked(rows, parts)
    assert sorted(map(tuple, parts)) == whole  # hash ranges keep the order of the hashes


def test_plans_too_large_to_broadcast(spark, monkeypatch):
    rows = sized_rows(random.Random(9), ["a", "b", None], 200)
    whole = sorted(map(tuple, mixed(table(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, mixed(table(spark, rows)).collect())) == whole


def test_awkward_documents(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one two three", ""), (5, "w " * 50_000, "long"), (None, "a b c d", "n"), (None, "a b c d", "n")]
    rows += [(10 + i, "ten words are in here and they are all good", "n") for i in range(4)] + [(6, "x y", "rep")] * 3
    found = mixed(table(spark, rows)).collect()
    checked(rows, found, near=50_000)
    assert all(r["target"] == 0 and r["taken"] == 0 for r in found if r["doc_id"] in (1, 2, 3))


def test_no_words_and_no_documents(spark):
    rows = [(1, None, "a"), (2, "", None)]
    assert sorted(map(tuple, mixed(table(spark, rows)).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mixed(table(spark, [])).collect() == []
