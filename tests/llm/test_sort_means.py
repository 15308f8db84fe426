import hashlib
import math

import numpy as np
import pytest

from parcelforge.llm import sort_means

MOST = (1 << 63) - 1


def plainly(rows, k, rounds, size, scale=1024, seed=3):
    """Every vector against every centroid, in Python's whole numbers."""
    ok = lambda v: v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    whole = lambda x: math.floor(max(-(2.0**62), min(2.0**62, scale * x)))
    kept = [(i, [whole(x) for x in v]) for i, v in rows if ok(v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, name(r[0]), r[1]))[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((apart(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            members = [v for (_, v), c in zip(kept, own) if c == j]
            if members:
                cents[j] = [sum(x) // len(members) for x in zip(*members)]
    last = [near(v) for _, v in kept]
    inertia = [sum(min(d, MOST) for d, c in last if c == j) for j in range(len(cents))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, min(d, MOST), min(inertia[c], MOST), min(sum(inertia), MOST), digest[c]) for (i, _), (d, c) in zip(kept, last)), key=str)


def run(spark, rows, k=8, rounds=10, size=3, kind="double"):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster string, distance int")
    return sorted(map(tuple, sort_means.summary(*sort_means.cluster(df, k, rounds, size)).collect()), key=str)


def test_ties_repeats_and_what_is_left_out(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3) / 1024]) for i in range(120)]  # a grid of 125 points: ties everywhere
    rows += [(7, rows[7][1]), (7, [0.0, -0.0, 0.5]), (None, [1.0, 1.0, 1.0]), (200, None), (201, []), (202, [1.0, 2.0]), (203, [1.0, None, 2.0]), (204, [1.0, float("nan"), 0.0]), (205, [float("inf"), 0.0, 0.0]), (206, [-0.0001, 0.0, 0.9999])]
    assert run(spark, rows) == plainly(rows, 8, 10, 3)


@pytest.mark.parametrize("size", [1.0, 1e6, 1e12, 1e300])
def test_sizes_of_components(spark, size):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=3) * size]) for i in range(60)] + [(100 + i, [float(x) for x in rng.normal(size=3)]) for i in range(20)]
    assert run(spark, rows, k=5, rounds=4) == plainly(rows, 5, 4, 3)


def test_far_from_zero_but_near_each_other(spark):
    """Components too large to square, differences small: distances stay exact."""
    rows = [(i, [1e15 + i % 7, -1e15 + i % 5, float(i % 3)]) for i in range(60)]
    assert run(spark, rows, k=4, rounds=6) == plainly(rows, 4, 6, 3)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(i, [float(i), 0.0, 1.0]) for i in range(3)]
    assert run(spark, rows) == plainly(rows, 8, 10, 3)
    assert run(spark, [(1, None), (2, [1.0])]) == []
    assert run(spark, []) == []


def test_one_vector_in_a_third_of_all_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [0.25, 0.5, 0.75] if i % 3 == 0 else [float(x) for x in rng.normal(size=3)]) for i in range(300)]
    assert run(spark, rows, kind="float") == plainly([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 8, 10, 3)


def test_scan_stops_strictly_beyond_twice_the_distance():
    """At just twice the distance the other centroid is as near, and its number may be smaller."""
    cents = [[4, 0], [0, 0], [100, 0]]
    order = sort_means.neighbours(cents)
    vectors = np.array([[2, 0], [1, 0], [50, 0], [52, 0]])
    found, distance = sort_means.assign(vectors, np.array([1, 1, 1, 2]), cents, order)
    assert found.tolist() == [0, 1, 0, 0] and distance.tolist() == [4, 1, 2116, 2304]


def test_earlier_tables_are_deleted(spark, tmp_path):
    from pathlib import Path

    from parcelforge.session import shared_dir

    rows = spark.createDataFrame([(i, [float(i % 9), 1.0, float(i % 4)]) for i in range(50)], "vec_id long, embedding array<double>")
    folder = Path(shared_dir(spark).removeprefix("file:")) / "tables"
    before = set(folder.glob("means-*")) if folder.exists() else set()
    sort_means.cluster(rows, 4, 6, 3)
    assert len(set(folder.glob("means-*")) - before) == 1
