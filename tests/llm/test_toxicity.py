import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelforge.llm import toxicity
from parcelforge.llm.common import table

SF = "/root/testdata/sf0.01"


def kernel(a: np.ndarray, b: np.ndarray) -> float:
    """The kernel by its definition, on two windows."""
    total = 0.0
    for i in range(toxicity.WINDOW):
        for j in range(toxicity.WINDOW):
            for (p, q), v in zip(toxicity.STEPS, toxicity.WEIGHTS):
                for (r, s), w in zip(toxicity.STEPS, toxicity.WEIGHTS):
                    total += v * w * (a[i] == b[j] and a[i + p] == b[j + r] and a[i + p + q] == b[j + r + s])
    return total


def test_nystrom_features_give_the_kernel_and_fold_without_loss():
    codes = toxicity.symbols("you absolute w-o-r-t-h-l-e-s-s idiot, be gone")
    windows = toxicity._windows(codes, np.arange(0, 24, 2))
    marks = toxicity.Landmarks(windows[::2])
    mapped = marks.features(windows)
    for i in (0, 2, 4):
        for j in range(len(windows)):  # a landmark against any window: the map is exact there
            assert mapped[i] @ mapped[j] == pytest.approx(kernel(windows[i], windows[j]), rel=1e-3, abs=1e-3)
    line = np.random.default_rng(0).normal(size=mapped.shape[1])
    assert np.allclose(toxicity.window_scores(codes, marks.fold(line))[np.arange(0, 24, 2)], mapped @ line, atol=1e-3)


def made(n: int, insults: list[str], seed: int) -> list[str]:
    rng = np.random.default_rng(seed)
    parts = "the of ing and re on er st he tion ly ea th ou in an ha nd".split()
    word = lambda: "".join(rng.choice(parts, rng.integers(1, 4)))
    out = []
    for _ in range(n):
        words = [word() for _ in range(60)]
        if insults:
            words[rng.integers(5, 50)] = str(rng.choice(insults))
        out.append(" ".join(words))
    return out


def test_gapped_and_inserted_insults():
    insults = ["zibgom", "kwuppaj", "vexxul"]
    texts = made(150, insults, 1) + made(600, [], 2)
    model = toxicity.fit(texts, np.r_[np.ones(150), np.zeros(600)])
    assert (model.score(made(60, insults, 3)) >= 0.5).mean() >= 0.95
    assert (model.score(made(100, [], 4)) < 0.5).mean() >= 0.98
    assert (model.score(made(30, ["zi.bgom", "kwu-ppaj", "kwupp_aj", "VEXXUL!", "vex*xul"], 5)) >= 0.5).mean() > 0.9
    for between in ("\u200b", "\u2060"):
        assert (model.score(made(30, [between.join(w) for w in insults], 6)) >= 0.5).mean() >= 0.95
    assert (model.score(made(30, ["zi\u2022bgom", "kwu\u20ac\u20acppaj", "ve--xxul"], 7)) >= 0.5).mean() > 0.9


def test_symbols_are_code_points_that_show():
    own = lambda t: toxicity.symbols(t)[toxicity.WINDOW : -toxicity.WINDOW - toxicity.REACH].tolist()
    assert own("aZ9\u200b.\U0001f600") == [1, 26, 36, 0, 0]
    assert own("\u00e9") == own("\u00e9\ufeff") and own("\u00e9")[0] >= 37
    assert own(None) == []


def test_held_out_on_the_corpus(spark):
    got = toxicity.op3_toxicity_kernel(spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got.count() == table(spark, SF, "documents").count()
    rows = got.join(table(spark, SF, "labels"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) / len(held) >= 0.92
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) >= 0.97
    assert got.filter((F.col("predicted") == 1) != (F.col("score") >= 0.5)).count() == 0


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "calm", 5), (1, None, 5), (3, "word " * 300_000 + "zibgom", 5), (4, "zibgom you", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(2, 0, 0), (4, None, 1), (None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0))).first().score < 0.01
