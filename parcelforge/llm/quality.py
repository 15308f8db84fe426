"""Quality classifier: a generalised additive model with pairwise interactions.

score = sigmoid(intercept + sum of table_f[bin of f] + sum of table_fg[bin of f, bin of g]).
The tables are learned by cyclic boosting: round after round, each feature in turn (then
each chosen pair) gets a shallow tree on the current gradient, whose leaf values are added,
shrunk, to its table. So the model is a set of lookup tables, and scoring is a vectorised
sum of table entries.

The features of a text come from one pass over its bytes and words and never from label,
language, source or id. The model is fitted on a bounded sample of labelled rows
(``max_rows``, by hash order of the id); everything else reads every whole text.

Defined results: null and empty texts get the all-zero feature row and so a valid score;
very long texts count whole; repeated rows score alike; without labelled rows of both
classes the score is the training share of label 1 (0.5 without any); extra columns are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.llm.common import fold, map_arrow, table

FEATURES = (
    "log_words", "mean_word", "upper_share", "symbol_share", "bang_share", "bar_share", "digit_share",
    "stop_share", "comma_share", "space_share", "high_byte_share", "distinct_share", "stutter_share",
    "line_repeat_share", "words_per_line", "capital_share",
)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = True


def describe(text: str | None) -> list[float]:
    """The feature row of one whole text, in the order of FEATURES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(raw)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1, int(count[_UPPER].sum() + count[_LOWER].sum()))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    # in lower case, as a shouted text repeats words no more than a quiet one
    small = raw.lower().split()
    return [
        float(np.log1p(n)),
        (size - int(count[[32, 9, 10, 11, 12, 13]].sum())) / n,
        float(count[_UPPER].sum() / letters),
        float(count[_SYMBOL].sum() / n),
        float(count[33] / n),
        float(count[124] / n),
        float(count[_DIGIT].sum() / size),
        float(count[46] / n),
        float(count[44] / n),
        float(count[32] / size),
        float((count[128:].sum()) / size),
        len(set(small)) / n,
        sum(map(bytes.__eq__, small, small[1:])) / n,
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        sum(map(bytes.istitle, words)) / n,
    ]


@dataclass
class Gam:
    """Cut points by feature, a table by feature, a table by pair of features."""

    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    coarse: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.intercept)
        for f, (cuts, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += values[np.searchsorted(cuts, rows[:, f], side="right")]
        if self.pairs:
            bins = [np.searchsorted(c, rows[:, f], side="right") for f, c in enumerate(self.coarse)]
            for (f, g), values in self.pairs.items():
                total += values[bins[f], bins[g]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _cut_points(column: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)))
    return (values[1:] + values[:-1]) / 2


def _shallow_tree(grad: np.ndarray, hess: np.ndarray, depth: int, least: float = 4.0, ridge: float = 1.0) -> np.ndarray:
    """Leaf value of each bin: a tree that splits the ordered bins at most ``depth`` levels deep."""
    out = np.zeros(len(grad))

    def grow(lo: int, hi: int, left: int) -> None:
        g, h = np.cumsum(grad[lo:hi]), np.cumsum(hess[lo:hi])
        if left and hi - lo > 1:
            gain = g[:-1] ** 2 / (h[:-1] + ridge) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + ridge)
            gain[(h[:-1] < least) | (h[-1] - h[:-1] < least)] = -1
            at = int(np.argmax(gain))
            if gain[at] > g[-1] ** 2 / (h[-1] + ridge) + 1e-9:
                grow(lo, lo + at + 1, left - 1)
                grow(lo + at + 1, hi, left - 1)
                return
        out[lo:hi] = g[-1] / (h[-1] + ridge)

    grow(0, len(grad), depth)
    return out


def _pair_leaves(grad: np.ndarray, hess: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """The best quartering of a two-way table: one cut of each axis; leaf values and gain."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    best, cut = -1.0, (0, 0)
    whole = g[-1, -1] ** 2 / (h[-1, -1] + ridge)

    def quarters(m: np.ndarray, i: int, j: int) -> np.ndarray:
        return np.array([m[i, j], m[i, -1] - m[i, j], m[-1, j] - m[i, j], m[-1, -1] - m[i, -1] - m[-1, j] + m[i, j]])

    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            gain = float((quarters(g, i, j) ** 2 / (quarters(h, i, j) + ridge)).sum()) - whole
            if gain > best:
                best, cut = gain, (i, j)
    out = np.zeros_like(grad)
    if best > 0:
        i, j = cut
        leaf = quarters(g, i, j) / (quarters(h, i, j) + ridge)
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return out, best


def fit(rows: np.ndarray, labels: np.ndarray, rounds: int = 120, rate: float = 0.1, depth: int = 2, bins: int = 64, pair_bins: int = 8, n_pairs: int = 6, pair_rounds: int = 40) -> Gam:
    """Cyclic boosting on the log loss: main effects first, then the pairs with the largest gain."""
    share = float(labels.mean()) if len(labels) else 0.5
    width = len(FEATURES)
    if len(labels) == 0 or share in (0.0, 1.0):
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Gam([np.zeros(0)] * width, [np.zeros(1)] * width, {}, [], float(np.log(share / (1 - share))))
    cuts = [_cut_points(rows[:, f], bins) for f in range(width)]
    model = Gam(cuts, [np.zeros(len(c) + 1) for c in cuts], {}, [_cut_points(rows[:, f], pair_bins) for f in range(width)], float(np.log(share / (1 - share))))
    where = [np.searchsorted(c, rows[:, f], side="right") for f, c in enumerate(cuts)]
    total = np.full(len(labels), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
        return labels - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(width):
            grad, hess = slopes()
            k = len(model.tables[f])
            leaf = rate * _shallow_tree(np.bincount(where[f], grad, k), np.bincount(where[f], hess, k), depth)
            model.tables[f] += leaf
            total += leaf[where[f]]
    rough = [np.searchsorted(c, rows[:, f], side="right") for f, c in enumerate(model.coarse)]
    shape = [len(c) + 1 for c in model.coarse]

    def two_way(f: int, g: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(rough[f] * shape[g] + rough[g], values, shape[f] * shape[g]).reshape(shape[f], shape[g])

    grad, hess = slopes()
    gains = {(f, g): _pair_leaves(two_way(f, g, grad), two_way(f, g, hess))[1] for f, g in combinations(range(width), 2)}
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs]
    model.pairs = {p: np.zeros((shape[p[0]], shape[p[1]])) for p in chosen}
    for _ in range(pair_rounds):
        for f, g in chosen:
            grad, hess = slopes()
            leaf = rate * _pair_leaves(two_way(f, g, grad), two_way(f, g, hess))[0]
            model.pairs[f, g] += leaf
            total += leaf[rough[f], rough[g]]
    return model


def features(documents: DataFrame) -> DataFrame:
    """(doc_id, features array<double>) of every whole text."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [describe(t.as_py()) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "features"])

    return map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), step, "doc_id long, features array<double>")


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 12_000, **how) -> Gam:
    """Fit on at most ``max_rows`` labelled ids, taken by hash order from all of them.

    Where rows share an id the one with the least features stands for it, so what comes to
    the driver is at most ``max_rows`` rows.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).dropna()
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    some = texts.join(F.broadcast(known.select("doc_id")), "doc_id")  # at most max_rows ids
    one = features(some).groupBy("doc_id").agg(F.min("features").alias("features"))
    got = one.join(F.broadcast(known), "doc_id").toPandas().sort_values("doc_id")
    if not len(got):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.stack(got.features.to_numpy()), got.y.to_numpy(), **how)


def score(documents: DataFrame, model: Gam, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every document, where Spark read it."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([describe(t.as_py()) for t in batch.column(1)]).reshape(-1, len(FEATURES))
        values = model.score(rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values), pa.array((values >= threshold).astype("int32"))], ["doc_id", "score", "predicted"])

    return map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), step, "doc_id long, score double, predicted int")


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = train(documents, labels.filter(fold(F.col("doc_id")) != 0))
    return score(documents, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
