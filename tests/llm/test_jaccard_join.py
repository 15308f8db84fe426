import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from parcelforge.llm import jaccard_join
from parcelforge.llm.common import table


def shingles(text, size=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def plainly(rows):
    """Compare every two distinct sets."""
    sets = {}
    for _, text in rows:
        sets.setdefault(shingles(text), len(sets))
    nodes = [s for s in sets if s]
    parent = list(range(len(nodes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            a, b = nodes[i], nodes[j]
            if 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * (o := len(a & b)) >= 75 * (len(a) + len(b) - o):
                parent[root(i)] = root(j)
    at = {s: k for k, s in enumerate(nodes)}
    least = {}
    for doc_id, text in rows:
        if (s := shingles(text)) and doc_id is not None:
            r = root(at[s])
            least[r] = min(least.get(r, doc_id), doc_id)
    out = [(d, len(s := shingles(t)), least.get(root(at[s]), d) if s else d) for d, t in rows]
    return sorted(out, key=str)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_corpus_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").union(table(spark, "/root/testdata/sf0.01", "documents").limit(700))
    got = jaccard_join.jaccard_components(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    want = plainly(rows_of(docs))
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert any(c != d for d, _, c in want)


def test_near_copies_of_one_text_in_every_round(spark):
    """Variants of one text at all degrees: stars don't connect them all, so every round has work."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(120):
        words = list(base)
        for i in rng.integers(0, 60, rng.integers(0, 7)):
            words[i] = f"x{rng.integers(0, 30)}"
        rows.append((k + 100, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plainly(rows)
    for rounds in (0, 1, 2):
        assert sorted(map(tuple, jaccard_join.jaccard_components(docs, pivot_rounds=rounds).collect()), key=str) == want


def test_rows_without_an_id_link_and_bridge(spark):
    base = [f"w{i}" for i in range(60)]
    text = lambda changed: " ".join(f"x{i}" if i in changed else w for i, w in enumerate(base))
    apart = " ".join(f"q{i}" for i in range(40))
    # 9 and 30 are too far from each other, the row without an id is near to both
    rows = [(5, apart), (None, apart + " tail"), (9, text({0})), (None, text({0, 59})), (30, text({59})), (31, text({0, 1, 2, 57, 58, 59})), (None, "not near to anything here at all"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plainly(rows)
    assert (None, 37, 5) in want and (30, 56, 9) in want
    assert sorted(map(tuple, jaccard_join.jaccard_components(docs).collect()), key=str) == want
    only = spark.createDataFrame([(None, apart), (None, apart + " tail")], "doc_id long, text string")
    assert [r.component_id for r in jaccard_join.jaccard_components(only).collect()] == [None, None]


def test_hot_shingles_are_dealt_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_SETS", 3)
    monkeypatch.setattr(jaccard_join, "HOT_SHARE", 0)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(50)]
    rows = []
    for k in range(150):
        words = list(base) if k % 3 else [f"u{i}" for i in range(40)] + [f"own{k}" for _ in range(2)]
        for i in rng.integers(0, len(words), rng.integers(0, 6)):
            words[i] = f"x{rng.integers(0, 20)}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plainly(rows)
    for rounds in (1, 3):
        assert sorted(map(tuple, jaccard_join.jaccard_components(docs, pivot_rounds=rounds).collect()), key=str) == want


def test_one_passage_in_all_texts_forms_no_pairs(spark, monkeypatch):
    """Texts that share a passage but aren't similar: nobody leads in its buckets, so none is joined with itself."""
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(k, " ".join(f"o{k}_{i}" for i in range(20)) + " " + passage) for k in range(60)]
    left = []
    own = jaccard_join._pairs_left
    monkeypatch.setattr(jaccard_join, "_pairs_left", lambda b: left.append(b.count()) or own(b))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(r.doc_id == r.component_id for r in got.collect())
    assert not left


def test_edge_rows(spark):
    long = " ".join(f"v{i % 9001}" for i in range(60_000))
    rows = [(5, None), (6, ""), (7, " \n"), (3, "one two"), (2, "ONE  two"), (4, "two one"), (None, "one two"), (9, long), (1, long + " tail"), (2, "one two"), (None, "alone here"), (8, "É a b c d e"), (10, "é a b c d e")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, node int, n string")
    assert sorted(map(tuple, jaccard_join.jaccard_components(docs).collect()), key=str) == plainly(rows)
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_counting_holds_one_table():
    class Documents:
        mapInArrow = lambda self, each, schema: each

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b c d e f", "a b c d e f g"])], ["doc_id", "text"])
    tracemalloc.start()
    *rows, counts = jaccard_join._sets(Documents(), 5)(iter([batch, batch]))
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert [r.column(2).to_pylist() for r in rows] == [[2, 3], [2, 3]]
    found = np.concatenate([np.frombuffer(jaccard_join.zlib.decompress(c), np.uint32) for c in counts.column(4).to_pylist()])
    assert sorted(found[found > 0].tolist()) == [2, 4, 4]
    assert most < 1.5 * 4 * jaccard_join.CELLS, most


def test_the_driver_holds_a_byte_a_cell(spark):
    counts = np.array([0, 1, 2, 127, 128, 160, 5000, 10**9], np.uint64)
    levels = jaccard_join._levels(counts, 2.0**62).tolist()
    assert levels[:4] == [0, 1, 2, 127] and levels == sorted(levels) and max(levels) < jaccard_join.HOT_LEVEL
    assert (jaccard_join._levels(counts, 128) == jaccard_join.HOT_LEVEL).tolist() == (counts >= 128).tolist()
    rows = [(k, f"a b c d e x{k}") for k in range(9)]
    sketch = jaccard_join._sketch(jaccard_join._sets(spark.createDataFrame(rows, "doc_id long, text string"), 5), 8)
    assert sketch.nbytes == jaccard_join.CELLS and sorted(sketch[sketch > 0].tolist()) == [1] * 9 + [9]

    class Documents:
        select = lambda self, *columns: self
        mapInArrow = lambda self, each, schema: each

    assert len(cloudpickle.dumps(jaccard_join._prefixes(Documents(), 5, sketch, 8))) < 1.1 * jaccard_join.CELLS
