import random
from heapq import heappop, heappush

import pytest

from parcelforge.graph import components, roads
from parcelforge.graph.components import connected_components


@pytest.mark.parametrize("task_edges", [components.TASK_EDGES, 0, 150])
def test_components(spark, monkeypatch, task_edges):
    """In one task, by shuffles, and from one to the other as edges get fewer."""
    monkeypatch.setattr(components, "TASK_EDGES", task_edges)
    rng = random.Random(4)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shortest_paths(spark):
    rng = random.Random(2)
    pts = {(i, j): (53.5 + i * 0.003 + rng.random() * 0.001, -113.5 + j * 0.004) for i in range(6) for j in range(6)}
    segments = [(f"{i}{j}{d}", [pts[i, j], pts[i + d, j + 1 - d]]) for i in range(6) for j in range(6) for d in (0, 1) if (i + d, j + 1 - d) in pts and rng.random() < 0.85]
    df = spark.createDataFrame([(k, [{"lat": a, "lon": b} for a, b in p]) for k, p in segments], "segment_id string, points array<struct<lat:double,lon:double>>")
    graph = roads.edges(df)
    to = {}
    for r in graph.collect():
        to.setdefault(r.src, []).append((r.dst, r.metres))
    starts = sorted(to)[:5]
    origins = spark.createDataFrame([(s,) for s in starts], "node string")
    want = {}
    for s in starts:
        heap, done = [(0.0, s)], {}
        while heap:
            d, n = heappop(heap)
            if n not in done:
                done[n] = d
                for m, w in to[n]:
                    if d + w <= 1500:
                        heappush(heap, (d + w, m))
        want |= {(s, n): d for n, d in done.items()}
    for how in (roads.distances, roads.distances_in_tiles):
        got = {(r.origin, r.node): r.metres for r in how(graph, origins, 1500.0).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_snap_and_enrich(spark):
    df = spark.createDataFrame([("s", [{"lat": 53.5, "lon": -113.5}, {"lat": 53.51, "lon": -113.5}])], "segment_id string, points array<struct<lat:double,lon:double>>")
    snapped = roads.snap(spark.createDataFrame([("p", 53.5001, -113.5001)], "point_id string, lat double, lon double"), roads.edges(df)).first()
    assert snapped.node == "53.5,-113.5" and 10 < snapped.offset < 20
    segments = spark.createDataFrame([("s1", "52 AVE", 53.5, -113.5, 100.0), ("s2", "52 AVE", 53.5001, -113.5, 90.0)], "segment_id string, name string, lat double, lon double, length double")
    records = spark.createDataFrame([("r1", "52 AVE", 53.5, -113.5, 95.0), ("r2", "52 AVE", 53.50002, -113.5, 95.0), ("r3", "53 AVE", 53.5, -113.5, 95.0)], "record_id string, name string, lat double, lon double, length double")
    assert [(r.segment_id, r.record_id) for r in roads.road_enrichment(segments, records).collect()] == [("s1", "r1")]


def test_far_points_snap_to_the_nearest_node(spark):
    df = spark.createDataFrame([("s", [(53.5, -113.5), (53.52, -113.5)])], "segment_id string, points array<struct<lat:double,lon:double>>")
    points = [("near", 53.5001, -113.5001), ("far", 53.9, -112.0), ("abroad", -33.0, 151.0), ("none", None, 1.0)]
    got = {r.point_id: r.node for r in roads.snap(spark.createDataFrame(points, "point_id string, lat double, lon double"), roads.edges(df)).collect()}
    assert got.keys() == {"near", "far", "abroad"}
    assert got["near"].startswith("53.5,") and got["far"].startswith("53.52,")
