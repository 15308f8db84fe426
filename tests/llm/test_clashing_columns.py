"""Whatever the caller's columns are called, they come back as they were."""

import pytest
from pyspark.sql import functions as F

from parcelforge.llm import decontaminate, exact_dedup, jaccard_join, secrets, toxicity

TEXTS = ["plain words here and nothing else at all", "password = abcdefghijklmnop end", "the benchmark passage of just a few words", "you utter dreck", "plain words here and nothing else at all", None]
NAMES = [
    "_text", "_key", "_added", "_spans", "_clean", "_assign", "_access", "_hex", "_gone", "gone", "row", "key", "added", "spans", "base", "weak", "id", "n", "node", "score", "predicted", "contaminated",
    "component_id", "n_words", "items", "bin", "role", "s", "own_id", "own_sha", "times", "sha", "best", "a.b", "with space", "Doc", "struct",
]


def toxic(spark, df):
    bad, good = ["you utter dreck", "utter dreck you are", "such dreck, utter dreck"] * 5, ["plain words here", "a kind letter to all", "nothing else at all"] * 5
    return toxicity.keep_clean(df, toxicity.fit(bad + good, __import__("numpy").array([1.0] * 15 + [0.0] * 15)))


OPERATORS = {
    "redact": (lambda spark, df: secrets.redact(df), {0, 1, 2, 3, 4, 5}),
    "decontaminate": (lambda spark, df: decontaminate.keep_clean(df, spark.createDataFrame([("b", "the benchmark passage of just a few words")], "item_id string, text string")), {0, 1, 3, 4, 5}),
    "near copies": (lambda spark, df: jaccard_join.keep_one(df), {0, 1, 2, 3, 5}),
    "exact copies": (lambda spark, df: exact_dedup.keep_one(df), {0, 1, 2, 3, 5}),
    "toxicity": (toxic, {0, 1, 2, 4, 5}),
}


@pytest.mark.parametrize("operator", OPERATORS)
def test_columns_come_back(spark, operator):
    step, ids = OPERATORS[operator]
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").select(*[F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in NAMES], "doc_id", F.lit(99).alias("n_chars"), "text")
    got = step(spark, df)
    assert got.columns == df.columns
    rows = {r.doc_id: r for r in got.collect()}
    assert set(rows) == ids
    assert all(r[n] == f"{n} of {i}" for i, r in rows.items() for n in NAMES)
    assert all(rows[i].text == ("[secret] end" if operator == "redact" and i == 1 else TEXTS[i]) for i in ids)
    if operator == "redact":
        assert "abcdefghijklmnop" not in str(rows[1]) and rows[1].n_chars == 12 and rows[0].n_chars == 99
