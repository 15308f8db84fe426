import json
import random

from parcelforge.operators import folds


def merged(old, new):
    """One level deeper than a plain update."""
    out = dict(old)
    for k, v in new.items():
        out[k] = {**out[k], **v} if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def objects(rng, n):
    value = lambda deep: rng.choice([1, 2.5, "x", None, True, [1, {"a": 2}], {}] + ([{rng.choice("pq"): rng.choice([1, "y", {"deep": 1}])} for _ in range(6)] if deep else []))
    for i in range(n):
        kind = rng.random()
        yield i, "broken {" if kind < 0.05 else "[1, 2]" if kind < 0.1 else None if kind < 0.15 else json.dumps({rng.choice(["a", "b", "sources", 'odd "name"']): value(True) for _ in range(rng.randrange(3))})


def loaded(text):
    try:
        found = json.loads(text) if text else {}
    except json.JSONDecodeError:
        return {}
    return found if isinstance(found, dict) else {}


def test_nested_objects_against_a_sequential_merge(spark):
    rng = random.Random(4)
    rows = [(f"k{rng.randrange(12)}", i, text) for i, text in objects(rng, 400)]
    want = {}
    for key, _, text in rows:
        if loaded(text):
            want[key] = merged(want.get(key, {}), loaded(text))
    got = {r.k: json.loads(r.m) for r in folds.merged_objects(spark.createDataFrame(rows, "k string, ordinal long, m string"), "k", "m").collect()}
    assert got == want


def test_points_of_interest_against_a_sequential_fold(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for i, text in objects(rng, 300):
        key, name, lists = f"p{rng.randrange(9)}", rng.choice([None, "", " ", "Park", "Pool"]), [rng.choice([None, ["a", "b"], ["c", "a"], []]) for _ in range(2)]
        lat, at = rng.choice([None, 0.0, 53.5]), rng.choice([None, f"2026-01-{i % 28 + 1:02}"])
        rows.append((key, i, name, lat, *lists, text, at))
        old = want.setdefault(key, {"name": None, "lat": None, "s": [], "e": [], "meta": {}, "sources": {}, "at": None})
        old["name"] = old["name"] or ((name or "").strip() and name) or None
        old["lat"] = lat if old["lat"] is None else old["lat"]
        for n, items in (("s", lists[0]), ("e", lists[1])):
            old[n] += [x for x in items or [] if x not in old[n]]
        new = loaded(text)
        old["sources"] |= new["sources"] if isinstance(new.get("sources"), dict) else {}
        old["meta"] |= {k: v for k, v in new.items() if k != "sources"}
        old["at"] = max(filter(None, (old["at"], at)), default=None)
    df = spark.createDataFrame(rows, "poi_id string, ordinal long, name string, lat double, source_ids array<string>, source_entity_ids array<string>, metadata string, updated_at string")
    got = {r.poi_id: r for r in folds.fold_pois(df).collect()}
    assert got.keys() == want.keys()
    for key, w in want.items():
        r = got[key]
        assert (r.name, r.lat, r.source_ids, r.source_entity_ids, r.updated_at) == (w["name"], w["lat"], w["s"], w["e"], w["at"])
        assert json.loads(r.metadata) == {**w["meta"], "sources": w["sources"]}


def test_properties_against_a_sequential_fold(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for i in range(300):
        new = dict(suite=rng.choice([None, "", "1"]), lot_size=rng.choice([None, 0.0, 5.0]), assessment_year=rng.choice([None, 2024, 2025]), assessment_value=rng.choice([None, 1.0 * i]), link_method=rng.choice("xyz"), confidence=rng.choice([None, 0.0, 0.5]), source_ids=rng.choice([["a"], ["b", "a"], None]), record_ids=[f"r{rng.randrange(30)}"], updated_at=rng.choice([None, f"2026-{i % 12 + 1:02}"]))
        key = f"l{rng.randrange(25)}"
        rows.append((key, i, *new.values()))
        if key not in want:
            want[key] = new | {"source_ids": list(dict.fromkeys(new["source_ids"] or []))}
            want[key]["suite"] = new["suite"] or None
            continue
        old = want[key]
        for c in ("suite", "lot_size"):
            old[c] = new[c] if old[c] in (None, "") and new[c] not in (None, "") else old[c]
        if new["assessment_value"] is not None and (old["assessment_value"] is None or (new["assessment_year"] or 0) >= (old["assessment_year"] or 0)):
            old["assessment_year"], old["assessment_value"] = new["assessment_year"], new["assessment_value"]
        if (new["confidence"] or 0.0) >= (old["confidence"] or 0.0):
            old["link_method"], old["confidence"] = new["link_method"], new["confidence"]
        for c in ("source_ids", "record_ids"):
            old[c] = old[c] + [x for x in new[c] or [] if x not in old[c]]
        old["updated_at"] = max(filter(None, (old["updated_at"], new["updated_at"])), default=None)
    df = spark.createDataFrame(rows, "location_id string, ordinal long, suite string, lot_size double, assessment_year int, assessment_value double, link_method string, confidence double, source_ids array<string>, record_ids array<string>, updated_at string")
    got = {r.location_id: r.asDict() for r in folds.fold_properties(df).collect()}
    assert {k: {c: v[c] for c in want[k]} for k, v in got.items()} == want
