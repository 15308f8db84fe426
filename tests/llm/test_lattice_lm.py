import math
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from parcelforge.llm import lattice_lm as lm
from parcelforge.llm.common import table

MODEL = P.path("piece_bpe_32k.model")


def all_cuts(word: bytes, p: dict[bytes, float]) -> float:
    """Sum over every cut, one by one."""
    if not word:
        return 1.0
    return sum(p[word[:k]] * all_cuts(word[k:], p) for k in range(1, len(word) + 1) if word[:k] in p)


def uses_of(word: bytes, p: dict[bytes, float]) -> Counter:
    """Expected uses of pieces by listing every cut."""
    out: Counter = Counter()

    def walk(rest, used, q):
        if not rest:
            for u in used:
                out[u] += q
        for k in range(1, len(rest) + 1):
            if rest[:k] in p:
                walk(rest[k:], [*used, rest[:k]], q * p[rest[:k]])

    walk(word, [], 1.0)
    total = all_cuts(word, p)
    return Counter({k: v / total for k, v in out.items()})


def test_forward_and_expected_against_all_cuts():
    surfaces, start = lm.read_pieces(MODEL)
    lattice, p = lm.Lattice(surfaces), dict(zip(surfaces, start))
    batch = ["the", "reading", "école", "x", "ñandú", "日本", "zzz!?", "a" * 9].copy()
    batch = [w.encode() for w in batch]
    got = lattice.log_probability(batch, lm._log(start))
    for w, g in zip(batch, got):
        assert g == pytest.approx(math.log(all_cuts(b" " + w, p)), rel=1e-9)
    counts = np.arange(1, len(batch) + 1)
    want: Counter = Counter()
    for w, c in zip(batch, counts):
        for piece, n in uses_of(b" " + w, p).items():
            want[piece] += n * c
    got = lattice.expected(batch, counts, lm._log(start))
    assert {surfaces[i] for i in np.flatnonzero(got > 1e-12)} <= set(want)
    for piece, n in want.items():
        assert got[surfaces.index(piece)] == pytest.approx(n, rel=1e-6, abs=1e-9)


def test_probabilities_of_all_words_sum_to_at_most_one():
    surfaces = [b" ", b"a", b"b", b"ab", b" a", b"ba"]
    weights = np.array([0.2, 0.2, 0.2, 0.1, 0.2, 0.1])
    lattice = lm.Lattice(surfaces)
    every = [bytes(w) for n in range(0, 10) for w in __import__("itertools").product(b"ab", repeat=n)]
    assert np.exp(lattice.log_probability(every, lm._log(weights))).sum() <= 1 + 1e-9


def test_long_words_equal_short_ones_and_take_linear_time(monkeypatch):
    surfaces, start = lm.read_pieces(MODEL)
    lattice, log_p = lm.Lattice(surfaces), lm._log(start)
    rng = np.random.default_rng(6)
    batch = [bytes(rng.choice(list(b"etaoinshr-/.x9"), n).tolist()) for n in (600, 1, 777, 40)] + ["é日本x".encode() * 90]
    counts = np.arange(1, len(batch) + 1)
    monkeypatch.setattr(lm, "BLOCK", 100)
    got = lattice.log_probability(batch, log_p), lattice.expected(batch, counts, log_p)
    monkeypatch.setattr(lm, "LONG", 1 << 30)
    want = lattice.log_probability(batch, log_p), lattice.expected(batch, counts, log_p)
    np.testing.assert_allclose(got[0], want[0], rtol=1e-10)
    np.testing.assert_allclose(got[1], want[1], rtol=1e-6, atol=1e-9)
    monkeypatch.undo()
    took = []
    for n in (250_000, 1_000_000):
        word = bytes(rng.integers(97, 123, n, dtype=np.uint8))
        began = time.process_time()
        lattice.expected([word], np.ones(1), log_p)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 1 and took[1] < 40, took


def plain_score(rows, surfaces, p):
    """The unfitted score by its definition, word by word."""
    def split(t):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    learn = [split(t) for i, t in rows if not (i is not None and zlib.crc32(str(i).encode()) % 5 == 1)]
    total, ends = sum(map(len, learn)), len(learn)
    stop = (ends + 1) / (total + ends + 2)
    widest = max(map(len, p))

    def log_p(word):
        alpha = [1.0] + [0.0] * len(word)  # short words: no need for logarithms
        for end in range(1, len(word) + 1):
            alpha[end] = sum(alpha[s] * p.get(word[s:end], 0.0) for s in range(max(0, end - widest), end))
        return math.log10(alpha[-1])

    return {i: sum(log_p(b" " + w) + math.log10(1 - stop) for w in split(t)) + math.log10(stop) for i, t in rows}


def test_unfitted_score_by_its_definition(spark):
    surfaces, start = lm.read_pieces(MODEL)
    docs = table(spark, "/root/testdata/sf0.001", "documents").filter("length(text) < 3000")
    want = plain_score([(r.doc_id, r.text) for r in docs.collect()], surfaces, dict(zip(surfaces, start)))
    got = {r.doc_id: r.score for r in lm.score(docs, MODEL, rounds=0).collect()}
    assert len(got) == len(want) > 100
    for i, w in want.items():
        assert got[i] == pytest.approx(w, rel=1e-9)


def plain_base(rows):
    """The base columns by their definition."""
    def split(t):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    out_fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts: Counter = Counter()
    for i, t in rows:
        if not out_fold(i):
            counts.update(split(t))
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    res = []
    for i, t in rows:
        tokens = [*split(t), None]
        res.append((i, out_fold(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)))
    return res


@pytest.mark.parametrize("frequent", [100_000, 500, 0])
def test_corpus(spark, frequent):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = lm.score(docs, MODEL, frequent=frequent)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = {r.doc_id: r for r in got.collect()}
    assert len(got) == len(rows)
    for want in plain_base(rows):
        r = got[want[0]]
        assert tuple(r)[:5] == want[:5]
        assert r.base_score == pytest.approx(want[5], rel=1e-9)
        assert -1e9 < r.score < 0


def test_fitting_raises_held_out_likelihood(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    total = lambda rounds: lm.score(docs, MODEL, rounds=rounds).filter("held_out").groupBy().sum("score").first()[0]
    none, two = total(0), total(2)
    assert two > none * 0.75  # both negative: clearly more likely


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (None, "the end"), (3, "twice the"), (3, "twice the"), (7, "Ünï 日本 \x00 ퟿"), (8, "=" * 30_000), (11, "x " * 100_000)]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n int, token string")
    got = sorted(((*tuple(r)[:5], round(r.base_score, 6)) for r in lm.score(docs, MODEL).collect()), key=str)
    assert got == sorted(((*w[:5], round(w[5], 6)) for w in plain_base(rows)), key=str)
    assert lm.score(docs.limit(0), MODEL).count() == 0
