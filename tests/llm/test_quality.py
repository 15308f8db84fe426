import numpy as np
from pyspark.sql import functions as F

from parcelforge.llm import quality
from parcelforge.llm.common import fold, table

SF = "/root/testdata/sf0.01"


def test_tables_add_up_to_the_score():
    rng = np.random.default_rng(1)
    rows = rng.random((600, len(quality.FEATURES)))
    y = ((rows[:, 0] > 0.5) ^ (rows[:, 1] > 0.5)).astype(float)  # only a pair can say this
    model = quality.fit(rows, y)
    assert (0, 1) in model.pairs
    by_hand = []
    for row in rows[:50]:
        total = model.intercept + sum(t[np.searchsorted(c, v, side="right")] for c, t, v in zip(model.cuts, model.tables, row))
        for (f, g), t in model.pairs.items():
            total += t[np.searchsorted(model.coarse[f], row[f], side="right"), np.searchsorted(model.coarse[g], row[g], side="right")]
        by_hand.append(1 / (1 + np.exp(-total)))
    assert np.allclose(model.score(rows[:50]), by_hand)
    assert ((model.score(rows) > 0.5) == (y == 1)).mean() > 0.9


def test_one_class_or_none():
    assert np.allclose(quality.fit(np.zeros((0, 16)), np.zeros(0)).score(np.zeros((1, 16))), 0.5)
    assert quality.fit(np.zeros((3, 16)), np.ones(3)).score(np.zeros((1, 16)))[0] > 0.99


def test_held_out_accuracy_on_the_corpus(spark):
    got = quality.op1_quality_gam(spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got.count() == table(spark, SF, "documents").count()
    rows = got.filter("held_out").join(table(spark, SF, "labels"), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.95
    assert got.filter((F.col("predicted") == 1) != (F.col("score") >= 0.3)).count() == 0
    assert got.filter(F.col("held_out") != (fold(F.col("doc_id")) == 0)).count() == 0


def test_repeated_ids_are_one_row_of_the_fit(spark):
    docs = table(spark, SF, "documents").limit(300)
    labels = table(spark, SF, "labels")
    rows = np.random.default_rng(0).random((20, 16)) * 10
    once, thrice = quality.train(docs, labels), quality.train(docs.union(docs).union(docs), labels)
    assert np.array_equal(once.score(rows), thrice.score(rows))


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "A quiet line.", 5), (1, None, 5), (3, "word " * 200_000, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(2, 0, None), (3, 1, 0), (None, 1, 1), (2, 0, None)], "doc_id long, quality int, toxic int")
    out = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    empty = docs.limit(0)
    assert quality.score(empty, quality.train(empty, labels)).count() == 0
    assert quality.score(docs, quality.train(docs, labels.limit(0))).first().score == 0.5
