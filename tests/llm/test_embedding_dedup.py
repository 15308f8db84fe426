import numpy as np
import pytest

from parcelforge.llm import embedding_dedup as ed
from parcelforge.llm.common import table


def plainly(rows, threshold=0.95):
    """All pairs: links and components."""
    good = [(i, np.array(v, np.float64)) for i, (_, v) in enumerate(rows) if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)]
    parent = list(range(len(rows)))
    links = [0] * len(rows)
    pairs = set()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for d in {len(v) for _, v in good}:
        own = [(i, v / np.linalg.norm(v)) for i, v in good if len(v) == d]
        u = np.stack([v for _, v in own])
        for a, b in zip(*np.nonzero(np.triu(u @ u.T >= threshold, 1))):
            x, y = own[a][0], own[b][0]
            links[x] += 1
            links[y] += 1
            pairs.add((x, y))
            parent[root(x)] = root(y)
    least = {}
    for i, (vec_id, _) in enumerate(rows):
        if vec_id is not None:
            least[root(i)] = min(least.get(root(i), vec_id), vec_id)
    return [(vec_id, links[i], least.get(root(i), vec_id)) for i, (vec_id, _) in enumerate(rows)]


def test_recall_and_precision_on_the_corpus(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    want = {v: (n, c) for v, n, c in plainly(rows)}
    got = ed.op6_embedding_dedup(spark, "/root/testdata/sf0.1")
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = got.collect()
    assert len(got) == len(rows)
    assert all(r.n_links <= want[r.vec_id][0] for r in got)
    assert sum(r.n_links for r in got) >= 0.97 * sum(n for n, _ in want.values())
    assert np.mean([r.component_id == want[r.vec_id][1] for r in got]) >= 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("noise", [0.01, 0.03])
def test_hot_groups_and_large_leaves(spark, noise):
    """A tight group is counted as a ball; a looser one is compared in chunks; equal vectors count by weight."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    base /= np.linalg.norm(base)
    near = [base + noise * rng.normal(size=16) for _ in range(1500)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate([*near, *near[:50], *rng.normal(size=(800, 16))])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = plainly(rows)
    got = {r.vec_id: r for r in ed.near_duplicates(df).collect()}
    assert all(got[v].n_links <= n for v, n, _ in want)
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(n for _, n, _ in want)
    assert np.mean([got[v].component_id == c for v, _, c in want]) >= 0.99


def test_deep_trees_do_not_cut_hot_groups():
    """A third of a million rows, all within the linking angle: nearly every pair shares a leaf."""
    rng = np.random.default_rng(1)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    base = unit(rng.normal(size=(1, 64)))
    hot = lambda n: unit(base + 0.02 * rng.normal(size=(n, 64)))
    sample = np.concatenate([hot(1300), unit(rng.normal(size=(2700, 64)))])
    members = hot(300)
    together = np.zeros((300, 300), bool)
    for _ in range(5):
        for rows, leaf in ed.grow(sample, 8, rng, 0.08, 0.95).walk(members):
            together[np.ix_(rows, rows)] |= leaf[0] >= 0 if len(leaf) else False
    links = np.triu(members @ members.T >= 0.95, 1)
    assert together[links].mean() >= 0.99


@pytest.mark.parametrize("groups", [1, 3])
def test_unsplit_leaves_of_many_chunks(spark, monkeypatch, groups):
    """Links of chunks that meet in several trees count once."""
    monkeypatch.setattr(ed, "CHUNK", 150)
    rng = np.random.default_rng(4)
    rows = [b + 0.02 * rng.normal(size=64) for b in unit_rows(rng, groups) for _ in range(900 // groups)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate([*rows, *unit_rows(rng, 500)])]
    want = plainly(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in ed.near_duplicates(df, leaf_rows=60).collect()}
    assert all(got[v].n_links <= n for v, n, _ in want)
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(n for _, n, _ in want)
    assert all(got[v].component_id == c for v, _, c in want)


def test_a_vector_between_two_tight_groups(spark):
    """It is nearer to one centre than to the other, yet links with members of both."""
    angle = np.arccos(0.95)
    at = lambda turn, tilt: [float(np.cos(turn * angle) * np.cos(tilt)), float(np.sin(turn * angle) * np.cos(tilt)), float(np.sin(tilt))]
    first = [at(0.001 * i, 0.001 * (i % 3)) for i in range(40)]
    second = [at(1.51 + 0.001 * i, 0.001 * (i % 3)) for i in range(40)] + [at(1.1, 0.0)]
    rows = list(enumerate([*first, *second, at(0.7, 0.0)]))
    unit = np.array([v for _, v in rows])
    _, near = ed._ball_of(unit, np.array([first[0], second[0]]), 0.95)
    assert list(near[-1]) == [0, 1]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in ed.near_duplicates(df).collect())
    assert got == sorted(plainly(rows))


def unit_rows(rng, n):
    rows = rng.normal(size=(n, 64))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, None), (6, []), (7, [0.0, 0.0]), (8, [1.0, None]), (9, [nan, 1.0]), (10, [inf, 1.0]), (4, [1.0, 2.0]), (3, [2.0, 4.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0]), (11, [1.0, 2.0, 0.0]), (None, [-5.0, 1.0]), (12, [-0.0, 1.0]), (13, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, node int, label int")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in ed.near_duplicates(df).collect()), key=str)
    assert got == sorted(plainly(rows), key=str)
    assert ed.near_duplicates(df.limit(0)).count() == 0


def test_very_large_and_very_small_vectors(spark):
    """Squares of such components overflow or vanish; cosines don't."""
    rows = [(1, [1e200, 1e200, 0.0]), (2, [1e200, 1.01e200, 0.0]), (3, [1e-200, 1e-200, 0.0]), (4, [1e-200, 1.01e-200, 0.0]), (5, [0.0, 0.0, 1e308]), (6, [0.0, 1e300, 1.7e308]), (7, [0.0, 0.0, 5e-324])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in ed.near_duplicates(df).collect())
    assert got == [(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 3, 1), (5, 2, 5), (6, 2, 5), (7, 2, 5)]


def test_sample_is_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(ed, "SAMPLE_BYTES", 8 * 64 * 50)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.repeat(unit_rows(np.random.default_rng(8), 100), 3, axis=0) + np.random.default_rng(9).normal(size=(300, 64)) * 1e-3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in ed.near_duplicates(df).collect()) == sorted(plainly(rows))
