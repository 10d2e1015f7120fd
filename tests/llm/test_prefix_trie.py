"""The prefix trie against prefixes counted in a dictionary."""

from __future__ import annotations

import hashlib
import random
import zlib

from barloom.llm import prefix_trie
from barloom.llm.prefix_trie import trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, depth int, a double"
SPACES = " \t\n\x0b\x0c\r"


def n_words(text: str) -> int:
    for s in SPACES:
        text = text.replace(s, " ")
    return len([w for w in text.split(" ") if w])


def loop(rows: list[tuple]) -> list[tuple]:
    own: dict[int, list] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    path = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        path[c] = tuple(turns.get(c - c % 20, [])[:h] + ts[h:])
    members: dict[tuple, list] = {}
    for c, p in path.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    kids: dict[tuple, list] = {n: [] for n in members}
    for n in members:
        if n:
            kids[n[:-1]].append(n)

    def below(n: tuple):
        todo = [n]
        while todo:
            m = todo.pop()
            yield m
            todo += kids[m]

    out = []
    for n, cs in members.items():
        ends = sorted(c for c in cs if len(path[c]) == len(n))
        out.append((
            min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), len(kids[n]), sum(not kids[m] for m in below(n)),
            sum((len(members[m]) - 1) * n_words(m[-1][1]) for m in below(n) if m), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


def held(spark, rows: list[tuple]) -> None:
    got = [tuple(r) for r in trie(spark.createDataFrame([(*r, "x", 3, 1.0) for r in rows], SCHEMA).repartition(6)).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(loop(rows), key=key)


def random_rows(n: int, seed: int, longest: int = 7) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]), " ".join(rng.choice("ab") for _ in range(rng.randint(0, 2)))))
    return rows


def test_random_conversations(spark):
    held(spark, random_rows(150, 1))
    held(spark, random_rows(20, 2, 30))


def test_many_ranges_and_rounds(spark, monkeypatch):
    """Nodes that several tasks share are left open and settled in a later round, whatever the ranges."""
    monkeypatch.setattr(prefix_trie, "TURNS_A_TASK", 25)
    monkeypatch.setattr(prefix_trie, "CHAINS_A_TASK", 3)
    held(spark, random_rows(120, 4))
    held(spark, [(20 * c, t, "user", f"t{t}" if t < 12 else f"{c} {t}") for c in range(30) for t in range(14)])  # a long common beginning
    held(spark, [(20 * c, t, "user", f"t{t}") for c in range(40) for t in range(c)])  # every prefix is a conversation


def test_a_conversation_of_many_turns(spark):
    rows = [(20, t, "user", f"turn {t}") for t in range(3_000)] + [(40, t, "user", f"turn {t}") for t in range(2_000)] + random_rows(20, 5)
    found = trie(spark.createDataFrame([(*r, "x", 3, 1.0) for r in rows], SCHEMA)).filter("depth >= 30")
    assert found.count() == 2_971
    assert [tuple(r) for r in found.filter("depth IN (2000, 2001)").select("conv_id", "parent_conv_id", "n_convs", "saved_tokens").collect()] == [(20, 20, 2, 2), (20, 20, 1, 0)]


def test_null_empty_long_and_repeated_turns(spark):
    rows = [
        (20, None, "user", "first of all"), (20, 0, None, None), (20, 5, "", ""), (21, 1, "user", "x " * 20_000), (22, 9, "user", "one\ttwo\n"),
        (None, 0, "user", "no conversation"), (47, 0, "a", "b"), (45, 0, "a", "b"), (45, 1, "a", "b"), (43, 1, "s", "same"), (43, 1, "s", "same"),
        (44, 1, "s", "same"), (44, 1, "s", "same"), (10**15, 3, "ß", "漢字 \U0001f600"), (0, 1, "ab", "c"), (1, 1, "a", "bc"),
    ]
    held(spark, rows)


def test_conversations_that_keep_no_turn_end_at_the_root(spark):
    """Conversations shorter than what they would borrow, from a conversation that is not there."""
    lost = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3]
    rows = [(c, t, "user", f"turn {t}") for c in lost for t in range(2)]
    held(spark, rows)
    assert len(lost) > 1
    (root,) = trie(spark.createDataFrame([(*r, "x", 3, 1.0) for r in rows], SCHEMA)).collect()
    assert (root["depth"], root["n_convs"], root["n_leaves"]) == (0, len(lost), 1)


def test_one_conversation_copied_many_times(spark, monkeypatch):
    """The ids of a hot node go through several tasks and pieces, and its digest stays that of their whole list."""
    monkeypatch.setattr(prefix_trie, "PIECE", 40)
    rows = [(20 * c, t, "user", "hello there") for c in range(600) for t in range(3)] + random_rows(60, 3)
    held(spark, rows)


def test_no_conversations(spark):
    assert trie(spark.createDataFrame([], SCHEMA)).collect() == []
