"""WARC archives, lattice likelihood, secrets, the n-gram join, the classifier, pieces and decontamination."""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.llm import automaton, decontaminate, lattice, ngram_join, pieces, quality_pu, secret_scan, shingles, warc
from barloom.llm.components import components
from barloom.llm.queries import piece_model
from barloom.llm.shingles import shingle_set, shingle_sets
from tests.llm.conftest import rows_of

# --- WARC ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pages(spark):
    html = [(1, "u1", "<p>é</p>"), (2, "u2", "same"), (3, None, "same"), (4, "a\r\nb", "same"), (5, "u5", None), (6, "u6", ""), (None, "n", "same"), (7, "u7", "x\r\n\r\nWARC/1.1\r\n" * 9), (8, "u8", "long " * 90_000)]
    return spark.createDataFrame([(*r, "x") for r in html], "page_id long, url string, html string, content string")


def test_archives_give_every_page_back(pages):
    html = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    found = {r.page_id: r for r in warc.archived(pages).collect()}
    assert found.keys() == html.keys()
    for i, payload in html.items():
        assert found[i].payload_bytes == len(payload) and found[i].payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert bytes(found[i].payload or payload) == payload
    assert {i: r.refers_to for i, r in found.items()} == {1: None, 2: 4, 3: 4, 4: None, None: 4, 5: 6, 6: None, 7: None, 8: None}
    assert found[4].url == "a%0D%0Ab" and found[3].url is None and found[2].record_type == "revisit"


def test_small_payloads_are_kept_and_ties_share(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (3, "u", "abcdef"), (2, "u", "abcdef")], "page_id long, url string, html string")
    found = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.archived(df, least_bytes=3).collect())
    assert found == Counter({(1, "response", None): 1, (2, "response", None): 1, (3, "response", None): 2, (2, "revisit", 3): 1})
    assert warc.archived(df.limit(0)).count() == 0


def test_inflating_goes_in_bounded_steps():
    data = bytes(5 * warc.STEP) + b"end"
    for packed in (warc.member(data), warc.member(data) + warc.member(b"") + warc.member(data)):
        pieces = list(warc.inflated(packed))
        assert b"".join(pieces) == data * (2 if len(packed) > len(warc.member(data)) else 1)
        assert max(map(len, pieces)) <= warc.STEP


def test_archives_leave_the_session_as_it_was(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "150")
    try:
        assert warc.archived(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")).count() == 1
        assert spark.conf.get(key) == "150"
    finally:
        spark.conf.set(key, before)



def test_any_gzip_layout_is_normalised(spark, pages):
    records = [warc.record(i, "u", f"page {i}".encode() * i, None, False) for i in range(1, 30)]
    layouts = {"one": gzip.compress(b"".join(records)), "each": b"".join(map(gzip.compress, records)), "mixed": gzip.compress(b"".join(records[:7])) + gzip.compress(b"".join(records[7:])), "none": gzip.compress(b"")}
    members = warc.normalise(spark.createDataFrame(list(layouts.items()), "archive string, content binary"))
    index = warc.offsets(members)
    assert {r.archive: r["count"] for r in index.groupBy("archive").count().collect()} == {"one": 29, "each": 29, "mixed": 29}
    content = {r.archive: bytes(r.content) for r in members.collect()}
    for r in index.collect():
        assert zlib.decompress(content[r.archive][r.offset : r.offset + r.length], 31) in records
    assert gzip.decompress(content["one"]) == b"".join(records)


def test_streams_hold_one_member_each(pages):
    streams = warc.write_streams(warc.marked(pages), archive_bytes=300).collect()
    assert len(streams) > 1
    for r in streams:
        unpack = zlib.decompressobj(31)
        unpack.decompress(bytes(r.content))
        assert unpack.eof and not unpack.unused_data


# --- lattice ---------------------------------------------------------------------------------------------------------

TOY = [("<unk>", 0.0, "control"), *[(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)], ("▁", -1.0, "piece"), ("a", -2.0, "piece"), ("b", -3.0, "piece"), ("ab", -4.0, "piece"), ("▁a", -5.0, "piece"), ("▁ab", -6.0, "piece"), ("ba", -7.0, "piece"), ("é", -8.0, "piece")]


def every_split(data: str, log_p: dict[str, float], spelled) -> float:
    """Sum over all segmentations, by listing them."""
    total = 0.0
    for cuts in itertools.product([False, True], repeat=max(0, len(data) - 1)):
        parts, last = [], 0
        for i, cut in enumerate(cuts, 1):
            if cut:
                parts.append(data[last:i])
                last = i
        parts.append(data[last:])
        value = 0.0
        for p in parts:
            if p in log_p:
                value += log_p[p]
            elif len(p) == 1:
                value += spelled(p)
            else:
                break
        else:
            total += math.exp(value)
    return math.log(total)


@settings(max_examples=40, deadline=None)
@given(st.text("abé漢c", max_size=7))
def test_forward_sums_all_segmentations(word):
    prior = lattice.rank_prior(TOY)
    log_p = {p.replace("▁", " "): prior[i] for i, (p, _, kind) in enumerate(TOY) if kind == "piece"}
    grid = lattice.Lattice(TOY)
    expected = every_split(" " + word, log_p, lambda c: sum(prior[1 + b] for b in c.encode()))
    assert grid.forward(word.encode()) == pytest.approx(expected, rel=1e-9)


def test_expected_pieces_spell_the_word():
    grid, into = lattice.Lattice(TOY), [0.0] * len(TOY)
    grid.expect(b"abab", 3.0, into)
    letters = sum(n * len(p.replace("▁", " ")) for n, (p, _, kind) in zip(into, TOY, strict=True) if kind == "piece")
    assert letters == pytest.approx(3 * 5)


def test_scores(spark, awkward, nothing, prose_docs, monkeypatch):
    monkeypatch.setattr(lattice, "HOT_WORDS", 30)  # both ways to a word's score
    out = {r.doc_id: r for r in lattice.scored(prose_docs, piece_model()).collect()}
    texts = dict(rows_of(prose_docs.select("doc_id", "text")))
    fold = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = Counter()
    for i, t in texts.items():
        if not fold[i]:
            c.update([*t.encode().lower().split(), b""])
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        words = [*t.encode().lower().split(), b""]
        assert (out[i].held_out, out[i].n_tokens, out[i].n_known, out[i].train_tokens) == (fold[i], len(words), sum(c[w] > 0 for w in words), n)
        assert out[i].base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words))
        assert out[i].whole_word_score <= 0
    # the score is the sum over segmentations under the fitted pieces, word by word, and nothing else
    pieces = lattice.load_pieces(piece_model())
    *log_p, log_end = lattice.fitted(lattice.word_counts(lattice.with_ids(prose_docs)), pieces)
    grid = lattice.Lattice(pieces, log_p)
    for i, t in texts.items():
        alone = sum(grid.forward(w) for w in t.encode().lower().split()) + log_end
        assert out[i].score == pytest.approx(alone / math.log(10))
    odd = lattice.scored(awkward, piece_model())
    assert odd.count() == awkward.count()
    assert {r.doc_id: r.n_tokens for r in odd.collect() if r.doc_id in (1, 2, 3, 4)} == {1: 1, 2: 1, 3: 1, 4: 3}
    assert lattice.scored(nothing, piece_model()).count() == 0


def test_word_probabilities_stay_below_one():
    """A counted word's edge and the mass left to segmentations are shares of one."""
    counts, total = [5, 3, 1, 1], 10
    edges = sum((c - lattice.DISCOUNT) / total for c in counts)
    assert edges + lattice.DISCOUNT * len(counts) / total == pytest.approx(1.0)


# --- secrets ---------------------------------------------------------------------------------------------------------

TOKENS = ["password", "api_key", "apikey", "secret", "token", " ", "=", ":", '"', "'", "AKIA", "ABCDEF123", "0123456789abcdef", "eyJ", "ab.eyJ", "c.d", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "ghp_", "a" * 36, "xoxb-", "é", "\n", "TOKEN", "x"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(TOKENS), max_size=16).map("".join))
def test_one_pass_equals_regex_search(text):
    data = text.encode()
    expected = sorted(
        (m.start(), k, m.end()) for k, r in enumerate(secret_scan.RULES)
        for m in re.finditer(r.pattern.encode(), data, re.IGNORECASE if r.fold else 0) if r.keep is None or r.keep(m.group())
    )
    found = secret_scan.scanner().spans(data)
    assert found == expected
    assert secret_scan.in_code_points(data, found) == [(len(data[:s].decode()), r, len(data[:e].decode())) for s, r, e in expected]


@pytest.mark.parametrize("pattern", ["a(b|cd)*e", "x{2,4}y?", "[^a-c]z+", "(ab|a)(c|bcd)", "a.c", "(a|b)*abb"])
def test_automata_accept_what_the_regex_does(pattern):
    a, size = automaton.compile_rules([(pattern, False)]), 5
    for word in map(bytes, itertools.product(b"abcdxyz", repeat=size)):
        state = a.start
        for b in word:
            state = a.moves[state + a.classes[b]]
        assert (state >= a.accepting) == bool(re.fullmatch(pattern.encode(), word))


def test_automata_are_minimal():
    # (a|b)*abb has four states, and the dead one for other bytes
    assert len(automaton.compile_rules([("(a|b)*abb", False)]).rules) == 5


def test_secrets_awkward(awkward, nothing):
    out = {r.row.doc_id: r for r in secret_scan.find_secrets(awkward).collect()}
    assert [(s.kind, s.start, s.end) for s in out[6].spans] == [("access", 14, 34)] and not out[1].spans
    assert secret_scan.find_secrets(awkward).count() == awkward.count() and secret_scan.find_secrets(nothing).count() == 0


# --- n-gram join -----------------------------------------------------------------------------------------------------


def brute_components(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in texts}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in texts}


def family(rng: random.Random, size: int) -> list[str]:
    """Copies of one text, each with some of its words changed: many pairs lie near the threshold."""
    words = [f"w{rng.randrange(10**6)}" for _ in range(110)]
    out = []
    for _ in range(size):
        copy = list(words)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = f"c{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "MANY", 8 if seed == 2 else 64)  # with and without the comparison in blocks
    monkeypatch.setattr(ngram_join, "BLOCK", 10)
    monkeypatch.setattr(ngram_join, "CHUNK", 3000)
    rng = random.Random(seed)
    texts = dict(enumerate([*family(rng, 45), *family(rng, 30), *["common words that many texts share here " + f"own{i} tail{i}" for i in range(20)], *["x y z"] * 3, "", "one"]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_copies(docs).collect()}
    assert found == brute_components(texts)


def test_bounds_never_fall_below_the_overlap():
    rng = np.random.default_rng(3)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 400).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, int(rng.integers(1, 300)))) for _ in range(2))
        both = len(np.intersect1d(a, b))
        assert ngram_join.most_shared(ngram_join.sketch(a), ngram_join.sketch(b), min(len(a), len(b))) >= both
        if 100 * both >= 75 * (len(a) + len(b) - both):
            for seed in ngram_join.ORDERS:
                first = [ngram_join._prefix(x, np.zeros(len(x), bool), seed, 75) for x in (a, b)]
                assert len(np.intersect1d(*first))


def test_block_compares_a_pair_once_by_its_smallest_token(monkeypatch):
    """Sketches of a pair are compared for one of its tokens alone, however many they share: a group of copies costs no
    more for having many common tokens."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 120).astype(np.uint64)
    sets = [np.unique(np.r_[base[rng.random(120) < keep], rng.integers(0, 2**63, int(120 * (1 - keep)) + 1).astype(np.uint64)]) for keep in rng.uniform(0.7, 1, 70)]
    sets += [np.unique(np.r_[base, rng.integers(0, 2**63, 900).astype(np.uint64)])]  # another width of sketch
    compared, bound = [], ngram_join._Sketches.most_shared
    monkeypatch.setattr(ngram_join._Sketches, "most_shared", lambda self, a, b: compared.extend(zip(a.tolist(), b.tolist(), strict=True)) or bound(self, a, b))
    monkeypatch.setattr(ngram_join, "STRIP", 16)
    monkeypatch.setattr(ngram_join, "VALUES", 3)
    monkeypatch.setattr(ngram_join, "SKETCH_CELLS", 1000)
    label = [0 if i % 3 else i + 1 for i in range(len(sets))]
    found = []
    hot = [int(t) for t in base[:10]]
    for token in sorted(hot):
        own = [i for i, x in enumerate(sets) if token in x.tolist()]
        columns = {"node": own, "label": [label[i] for i in own], "n": [len(sets[i]) for i in own], "block": [0] * len(own)}
        smaller = [[t for t in hot if t < token and t in sets[i].tolist()] for i in own]
        before = len(compared)
        table = pa.table({**columns, "sketch": [ngram_join.sketch(sets[i]) for i in own], "smaller": pa.array(smaller, pa.list_(pa.int64()))})
        out = ngram_join._block_pairs(75)(table)
        compared[before:] = [tuple(sorted((own[x], own[y]))) for x, y in compared[before:]]
        found += [tuple(sorted(x)) for x in zip(*(out.column(c).to_pylist() for c in "ab"), strict=True)]
    assert len(compared) == len(set(compared)) and len(found) == len(set(found))
    for i, j in itertools.combinations(range(len(sets)), 2):
        both, n = len(np.intersect1d(sets[i], sets[j])), len(sets[i]) + len(sets[j])
        most = ngram_join.most_shared(ngram_join.sketch(sets[i]), ngram_join.sketch(sets[j]), min(len(sets[i]), len(sets[j])))
        shares = any(t in sets[i].tolist() and t in sets[j].tolist() for t in hot)
        assert ((i, j) in found) == (shares and label[i] != label[j] and 100 * most >= 75 * (n - most)), (i, j, both)


def test_similar_sets_share_as_many_tokens_as_are_asked():
    rng = np.random.default_rng(7)
    assert [ngram_join.shared_tokens(t) for t in (50, 66, 75, 100)] == [1, 2, 2, 2]
    for _ in range(300):
        n = int(rng.integers(3, 60))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.9], rng.integers(0, 2**64, int(rng.integers(0, n // 8 + 2)), dtype=np.uint64)])
        both = len(np.intersect1d(a, b))
        if np.array_equal(a, b) or 100 * both < 75 * (len(a) + len(b) - both):
            continue
        frequent = np.sort(rng.choice(a, len(a) // 2, replace=False))
        known = ngram_join._Known(frequent)
        assert np.array_equal(known.among(b), np.isin(b, frequent)) and not ngram_join._Known(frequent[:0]).among(b).any()
        first = [ngram_join._prefix(x, known.among(x), ngram_join.ORDERS[0], 75, ngram_join.SHARED - 1) for x in (a, b)]
        assert len(np.intersect1d(*first)) >= ngram_join.SHARED


def test_shingles_of_texts_at_once_equal_those_of_each(monkeypatch):
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"aAbBz \t\n\x0b\x0c\r\x00\x1c\xa0\xc3") for _ in range(rng.randrange(90))) for _ in range(400)]
    texts += [b"", b" " * 300, b"x" * 65, b"y" * 700 + b" a b c d e", b"a b c d " + b"Z" * 300, " ".join(f"w\u00e9{i}" for i in range(200)).encode()]
    rng.shuffle(texts)
    sizes = [len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if (w := t.lower().split()) else 0 for t in texts]
    column = pa.array([b"left out", *texts], pa.binary()).slice(1)
    found = list(shingle_sets(column))
    assert [len(x) for x in found] == sizes
    monkeypatch.setattr(shingles, "PIECE", 128)  # texts and words longer than a piece
    shingles._made.clear()
    for one in (list(shingle_sets(column)), list(map(shingle_set, texts)), list(shingle_sets(pa.array([t.swapcase() for t in texts], pa.binary())))):
        assert all(map(np.array_equal, one, found))
    shingles._made.clear()


def test_join_awkward(spark, awkward, nothing):
    out = ngram_join.near_copies(awkward)
    assert out.count() == awkward.count()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}
    assert found[1] == (0, 1) and found[2] == (0, 2) and found[4] == (1, 4) and found[8] == (1, 7) and found[None][1] is None
    kept = ngram_join.one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 5, 6, None, 7])
    assert ngram_join.near_copies(nothing).count() == 0 and ngram_join.one_of_each(nothing).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = dict(rows_of(components(spark.createDataFrame(edges, "a long, b long"))))
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


# --- quality classifier ----------------------------------------------------------------------------------------------


def test_classifier_learns_from_trusted_and_unlabelled(spark, nothing):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)]

    def text(good: bool) -> str:
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        return " ".join(words) + "." if good else " | ".join(w.upper() + "!!" for w in words)

    quality = {i: int(rng.random() < 0.7) for i in range(1600)}
    docs = spark.createDataFrame([(i, text(bool(q))) for i, q in quality.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, q in quality.items() if i % 3 == 0], "doc_id long, quality int, toxic int")
    found = quality_pu.scored(docs, labels).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == len(quality) and {r.doc_id for r in held} == {i for i in quality if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.predicted == quality[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)


def test_held_out_labels_teach_nothing(spark, prose_docs):
    labels = [(i, 1) for i in range(60)]
    out = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2]
    kept = spark.createDataFrame([(i, q) for i, q in labels if i not in out and i % 2], "doc_id long, quality int")
    more = kept.union(spark.createDataFrame([(i, 0) for i in out], "doc_id long, quality int"))
    assert sorted(rows_of(quality_pu.scored(prose_docs, kept))) == sorted(rows_of(quality_pu.scored(prose_docs, more)))


def test_class_prior_of_a_known_mixture():
    rng = np.random.default_rng(1)
    top, bottom = rng.binomial(200, 0.85, 200_000), rng.binomial(200, 0.2, 200_000)
    hist = lambda x: np.bincount(np.minimum(x, 199), minlength=200)
    assert quality_pu.class_prior(hist(top[:100_000]), hist(np.r_[top[100_000:160_000], bottom[:40_000]])) == pytest.approx(0.6, abs=0.02)


def test_classifier_awkward(spark, awkward, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_pu.scored(awkward, none).collect()} == {0.5}
    labels = spark.createDataFrame([(4, 1), (7, None), (None, 1), (8, 1), (8, 0)], "doc_id long, quality int")
    assert quality_pu.scored(awkward, labels).count() == awkward.count()
    assert quality_pu.scored(nothing, labels).count() == 0


# --- pieces ----------------------------------------------------------------------------------------------------------


def best_by_trial(codec: pieces.Codec, scores: dict[str, float], chunk: str) -> float:
    best = {0: 0.0}
    for j in range(1, len(chunk) + 1):
        options = [best[i] + scores[chunk[i:j]] for i in range(j) if chunk[i:j] in scores]
        if chunk[j - 1] not in scores:
            options.append(best[j - 1] + codec.unknown)
        best[j] = max(options)
    return best[len(chunk)]


@settings(max_examples=150, deadline=None)
@given(st.text("ab é漢▁", max_size=12))
def test_best_path_has_the_best_sum(text):
    codec = pieces.Codec(TOY)
    scores = {p: s for p, s, kind in TOY if kind == "piece"}
    for chunk in codec.chunks(text):
        ids = codec.best(chunk)
        raw = [TOY[i] for i in ids]
        spelled = sum(kind == "byte" for _, _, kind in raw)
        unknown = sum(c not in scores for c in chunk)
        assert sum(s for _, s, kind in raw if kind == "piece") + unknown * codec.unknown == pytest.approx(best_by_trial(codec, scores, chunk))
        assert spelled == sum(len(c.encode()) for c in chunk if c not in scores)
    if "▁" not in text:
        assert codec.decode([i for c in codec.chunks(text) for i in codec.best(c)]) == text


def test_encoding_equals_the_library(spark, prose_docs):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(piece_model(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for p in proto.pieces:
        p.score = max(p.score, -40_000.0)  # runs of spaces; single precision has no room for -1e9
    model = sentencepiece.SentencePieceProcessor()
    model.LoadFromSerializedProto(proto.SerializeToString())
    for r in pieces.encoded(prose_docs.select("text", F.col("text").alias("copy")), piece_model()).collect():
        assert list(r.ids) == model.encode(r.row["copy"]) and r.exact and r.n_tokens == len(r.ids)


def test_pieces_awkward(awkward, nothing):
    out = {r.row.doc_id: r for r in pieces.encoded(awkward, piece_model()).collect()}
    assert out[1].n_tokens == 0 and out[2].n_tokens == 0 and all(r.exact for r in out.values())
    assert pieces.encoded(awkward, piece_model()).count() == awkward.count() and pieces.encoded(nothing, piece_model()).count() == 0


# --- decontamination -------------------------------------------------------------------------------------------------


def common_subsequence(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=80), st.text("abcde", max_size=120))
def test_bit_parallel_subsequence(a, b):
    item = decontaminate.Item(" ".join(a).encode())
    assert decontaminate.in_order(item.masks, len(item.words), decontaminate.tokens(" ".join(b).encode())) == common_subsequence(list(a), list(b))


@pytest.fixture(scope="module")
def leaky(spark):
    rng = random.Random(4)
    common = ["the", "of", "and", "to", "in", "is", "was", "that"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefghijklm") for _ in range(5))
    items = {i: " ".join(word() for _ in range(40)) + ". And the answer is " + " ".join(word() for _ in range(6)) + "." for i in range(30)}
    docs, truth = {}, defaultdict(set)
    for i in range(200):
        words = [word() for _ in range(rng.randint(20, 400))]
        if i < 60:  # whole, in another case and with other punctuation
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() + "," for w in items[i % 30].split()]
            truth[i].add(i % 30)
        elif i < 80:  # a quarter of the words replaced
            own = [w if rng.random() > 0.25 else word() for w in items[i % 30].split()]
            words[0:0] = own
            truth[i].add(i % 30)
        docs[i] = " ".join(words)
    for i in range(200, 300):  # one item in a third of all documents
        docs[i] = " ".join(word() for _ in range(60)) + " " + items[0]
        truth[i].add(0)
    return docs, items, truth


def test_planted_items_are_found(spark, leaky):
    docs, items, truth = leaky
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("item_id", F.lit(5))
    b = spark.createDataFrame(list(items.items()), "item_id long, text string").withColumn("doc_id", F.lit(1))
    found = defaultdict(set)
    for r in decontaminate.leaks(d, b).collect():
        found[r.doc_id].add(r.item_id)
    assert found == truth
    kept = {r.doc_id for r in decontaminate.without_leaks(d, b).collect()}
    assert kept == set(docs) - set(truth)


def test_blocks_of_items_give_the_same(spark, leaky, monkeypatch):
    docs, items, truth = leaky
    monkeypatch.setattr(decontaminate, "PASS_ITEMS", 13)
    monkeypatch.setattr(decontaminate, "SPACE_ITEMS", 5)
    monkeypatch.setattr(decontaminate, "SENT_SPOTS", 0)
    few = {i: t for i, t in docs.items() if i < 70}
    out = decontaminate.leaks(spark.createDataFrame(list(few.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in out.collect()} == {(i, x) for i in few for x in truth[i]}


def test_texts_are_not_shuffled_to_candidates(spark, leaky, monkeypatch):
    """Whatever the number of candidates: a table of them that is sent or not made disk and shuffle jump with size."""
    docs, items, truth = leaky
    plans, write = [], decontaminate.written

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(decontaminate, "written", noted)
    monkeypatch.setattr(decontaminate, "SENT_SPOTS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = decontaminate.leaks(
            spark.createDataFrame([(i, docs[i]) for i in range(70)], "doc_id long, text string"),
            spark.createDataFrame(list(items.items()), "item_id long, text string"),
        )
        plans.append(out._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not [p for p in plans if "SortMergeJoin" in p or "ShuffledHashJoin" in p]
    assert {(r.doc_id, r.item_id) for r in out.collect()} == {(i, x) for i in range(70) for x in truth[i]}


def test_pairs_of_terms_are_counted_in_parts(monkeypatch):
    """A'A R from counts, with counts that are taken over many times."""
    monkeypatch.setattr(decontaminate, "PAIRS_AT_ONCE", 7)
    rng = np.random.default_rng(5)
    matrix, weights, r = (rng.random((60, 300)) < 0.05) * 1.0, rng.random(300), rng.standard_normal((300, 9))
    met, cross, energy = decontaminate._PairCounts(), np.zeros((300, 9)), 0.0
    for low in range(0, 60, 10):
        passage, term = np.nonzero(matrix[low : low + 10])
        met.add(decontaminate._pairs(np.searchsorted(passage, np.unique(passage)), term, 300))
        if low == 30:
            energy += met.times(weights, r, cross)
    energy += met.times(weights, r, cross)
    weighted = matrix * weights
    assert np.allclose(cross, weighted.T @ weighted @ r) and np.isclose(energy, (weighted**2).sum())


def test_altered_item_in_a_third_of_all_documents(spark):
    """Its replaced words are rare, and those that the hot copies hold are frequent."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    items = {i: [word() for _ in range(50)] for i in range(30)}
    altered = items[0][:]
    for at in rng.sample(range(50), 12):
        altered[at] = word()
    docs = {i: [word() for _ in range(rng.randint(60, 300))] for i in range(300)}
    for i in range(100):
        at = rng.randrange(len(docs[i]))
        docs[i][at:at] = altered
    for i in range(100, 103):  # a few whole copies make the replaced words known
        docs[i][9:9] = items[0]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.kind) for r in decontaminate.leaks(d, b).collect()} == {(i, 0, "copy") for i in range(103)}


def test_long_items_are_found(spark):
    """Verbatim, with a third of the words replaced, and without the last third; a quarter of an item is no copy."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    word = lambda: rng.choice(vocabulary[:20] if rng.random() < 0.3 else vocabulary)
    items = {n: [word() + "." * (k % 12 == 11) for k in range(n)] for n in (40, 60, 100, 200, 300, 400, 600, 1000, 2000)}
    docs, truth = {i: [word() for _ in range(rng.randint(20, 400))] for i in range(100)}, set()
    for i, n in enumerate(items):
        docs[i][7:7] = items[n]
        docs[20 + i][11:11] = [w if rng.random() > 0.33 else word() for w in items[n]]
        docs[40 + i][13:13] = items[n][: n // 4]
        docs[60 + i][15:15] = items[n][: n * 2 // 3]
        truth |= {(i, n), (20 + i, n), (60 + i, n)}
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).filter("kind = 'copy'").collect()}
    assert found == truth


def test_latent_space_is_the_leading_one(spark):
    """On a small matrix the randomised space spans what the exact decomposition gives."""
    rng = np.random.default_rng(2)
    terms = 40
    hits = []
    for doc in range(30):
        ids = np.sort(rng.choice(terms, 12, replace=False)).astype(np.int32)
        hits.append((doc, np.arange(12, dtype=np.int32).tobytes(), ids.tobytes()))
    df = spark.createDataFrame(hits, "doc_id long, positions binary, terms binary")
    weights = rng.random(terms).astype(np.float32) + 0.5
    items = np.zeros((3, terms))
    items[0, :5] = weights[:5]
    space = decontaminate.latent_space(df, np.arange(terms, dtype=np.int32), weights, items)
    matrix = np.zeros((30, terms))
    for doc, _, ids in hits:
        ids = np.frombuffer(ids, np.int32)
        matrix[doc, ids] = weights[ids]
    assert np.allclose(space.T @ space, np.eye(space.shape[1]), atol=1e-6)
    assert np.allclose(matrix @ space @ space.T, matrix, atol=1e-3)


def test_decontamination_awkward(spark, awkward, nothing):
    bench = spark.createDataFrame([(1, "short text"), (2, None), (3, ""), (None, "word word"), (4, "! ?"), (1, "short text")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(awkward, bench).collect()}
    assert found <= {(4, 1)}
    assert decontaminate.leaks(nothing, bench).count() == 0 and decontaminate.leaks(awkward, bench.limit(0)).count() == 0
    kept = decontaminate.without_leaks(awkward, bench)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} >= {None, 1, 2, 3, 5, 6, 7, 8}


# --- shingles --------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "b", "é", "\x1c"]), max_size=30))
def test_shingle_sets_have_the_right_size(words):
    w = " ".join(words).encode().lower().split()
    expected = len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else int(bool(w))
    assert len(shingle_set(" ".join(words).encode())) == expected
