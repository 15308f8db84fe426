import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from parcelforge.llm import decontaminate
from parcelforge.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plainly(docs, items, size=10):
    """By the definition: every window of every item against every position."""
    windows = {}
    for item, text in items:
        if item is None:
            continue
        w = plain_words(text)
        n = min(size, len(w))
        for at in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[at : at + n]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w = plain_words(text)
        hit, found = set(), set()
        for n in lengths:
            for at in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[at : at + n])):
                    hit.update(range(at, at + n))
                    found |= owners
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_words():
    text = "It's A-1 ÉCOLE école x\ty_z{q}"
    assert [w.decode() for w in decontaminate.words(text)] == plain_words(text)


def test_against_brute_force_on_the_corpus(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    want = plainly(docs, items)
    got = decontaminate.op2_decontaminate(spark, SF)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum(r[5] for r in want) > 0
    blocks = decontaminate.find(table(spark, SF, "documents"), table(spark, SF, "benchmark"), block_windows=300).drop("items")
    assert sorted(map(tuple, blocks.collect()), key=str) == want


@settings(max_examples=15, deadline=None)
@given(
    docs=st.lists(st.lists(st.sampled_from("a b c d".split()), max_size=30), min_size=1, max_size=6),
    items=st.lists(st.lists(st.sampled_from("a b c d".split()), max_size=8), max_size=5),
)
def test_small_alphabet(spark, docs, items):
    docs = [(i, " ".join(d)) for i, d in enumerate(docs)]
    items = [(i, " ".join(d)) for i, d in enumerate(items)]
    got = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), size=4).drop("items")
    assert sorted(map(tuple, got.collect()), key=str) == plainly(docs, items, 4)


def test_edge_rows(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [(1, None), (2, ""), (None, passage), (3, "x " * 100_000 + passage), (3, "x " * 100_000 + passage), (4, "TINY item!")]
    items = [(10, passage), (10, passage), (9, "tiny item"), (None, passage), (8, None), (7, "")]
    d = spark.createDataFrame([(*r, 1, "z") for r in docs], "doc_id long, text string, n_hit int, items string")
    b = spark.createDataFrame([(*r, "q") for r in items], "item_id long, text string, n_words string")
    assert sorted(map(tuple, decontaminate.find(d, b).drop("items").collect()), key=str) == plainly(docs, items)
    assert decontaminate.find(d.limit(0), b).count() == 0
    assert decontaminate.find(d, b.limit(0)).filter("contaminated").count() == 0
