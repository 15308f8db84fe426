"""Toxicity: a support vector machine on a gapped-subsequence string kernel, with Nyström landmarks.

The kernel compares two windows of text by their shared subsequences of three symbols;
a subsequence that spans s symbols counts decay**s, so inserted characters weaken a match
but don't break it, up to two of them between neighbours; beyond that a subsequence isn't
counted. A word with a sign after every letter keeps two thirds of each subsequence but
fewer of them fit in a window, so it can go unseen. A symbol is a code point; those without a width aren't symbols at all. A window is a run of start positions; sentences are covered by all
their windows, and a text is as toxic as its worst window.

Training has labelled texts only, so windows are learned by turns: start from windows on
words that occur in toxic texts and never in clean ones, fit, then take the worst windows
of toxic texts as positive and the worst of clean ones as negative, and fit again.

The machine is linear in the kernel's values at the landmarks, and each of those is linear
in the window's subsequences. So the fitted machine folds, without loss, into one table
with a weight for every three symbols (64**3 numbers): a text is scored in one vectorised
pass over its symbols, at a cost that doesn't depend on the number of landmarks.

Bounds: at most ``max_texts`` labelled texts per class of at most ``max_chars`` characters
each are fitted on, by hash order of the id; scoring reads every whole text.

Defined results: null and empty texts score like a text of blanks; repeated rows score
alike; without labelled texts of both classes every score is the training share of label 1
(0 without any); extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.llm.common import fold, map_arrow, table, without

DECAY = 0.8
#: Distances from the first to the second and from the second to the third symbol.
STEPS = [(a, b) for a in (1, 2, 3) for b in (1, 2, 3)]
WEIGHTS = np.array([DECAY ** (a + b + 1) for a, b in STEPS], np.float32)
REACH = max(a + b for a, b in STEPS)
#: Start positions of a window.
WINDOW = 8
SYMBOLS = 64
#: Symbols that are scored at once: keeps the work arrays small.
CHUNK = 1 << 19


#: Code points that take no room in a line.
WIDTHLESS = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufe0e\ufe0f\ufeff"
_NONE = 255


def _symbol(code: int) -> int:
    """0 blank or sign, 1-26 letters in either case, 27-36 digits, 37-63 other letters; _NONE without a width."""
    c = chr(code)
    if code < 128:
        return ord(c.lower()) - 96 if c.isalpha() else 27 + code - 48 if c.isdigit() else 0
    return _NONE if c in WIDTHLESS else 37 + code % 27 if c.isalpha() else 0


#: By code point; all from the last on count as signs.
_TABLE = np.array([_symbol(c) for c in range(0x10000)], np.uint8)


def visible(text: str | None) -> str:
    """The text without the code points that have no width."""
    return (text or "").translate(dict.fromkeys(map(ord, WIDTHLESS)))


def symbols(text: str | None) -> np.ndarray:
    """One symbol a code point, with blanks before and after."""
    raw = _TABLE[np.minimum(np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)]
    return np.concatenate([np.zeros(WINDOW, np.uint8), raw[raw != _NONE], np.zeros(WINDOW + REACH, np.uint8)]).astype(np.int32)


def _triples(codes: np.ndarray) -> np.ndarray:
    """Subsequences by start position and step: (positions, steps)."""
    n = len(codes) - REACH
    return np.stack([(codes[:n] << 12) + (codes[a : n + a] << 6) + codes[a + b : n + a + b] for a, b in STEPS], 1)


def window_scores(codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum of the weights of the subsequences that start in each window."""
    n = len(codes) - REACH
    each = np.zeros(n, np.float32)
    first = codes[:n] << 12
    second = codes << 6
    for (a, b), w in zip(STEPS, WEIGHTS, strict=True):
        each += w * weight[first + second[a : n + a] + codes[a + b : n + a + b]]
    run = np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)])
    return run[WINDOW:] - run[:-WINDOW]


@dataclass
class Machine:
    """Weight of every three symbols, and the line that turns the worst window into a probability."""

    weight: np.ndarray
    slope: float
    offset: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        out, start = np.empty(len(texts)), 0
        while start < len(texts):
            parts, size, end = [], 0, start
            while end < len(texts) and (not parts or size < CHUNK):
                parts.append(symbols(texts[end]))
                size += len(parts[-1])
                end += 1
            at = np.cumsum([0] + [len(p) for p in parts])[:-1]
            scores = window_scores(np.concatenate(parts), self.weight)
            out[start:end] = np.maximum.reduceat(scores, at)
            start = end
        return self.probability(out)

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.offset, -40, 40)))


def _windows(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.stack([codes[s : s + WINDOW + REACH] for s in starts])


def _features(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subsequences and their values for each window: two arrays (windows, positions x steps)."""
    ids = np.stack([(windows[:, :WINDOW] << 12) + (windows[:, a : WINDOW + a] << 6) + windows[:, a + b : WINDOW + a + b] for a, b in STEPS], 2)
    return ids.reshape(len(windows), -1), np.tile(WEIGHTS, WINDOW)


#: Rows of a landmark table that are turned into doubles at once.
PIECE = 4096


class Landmarks:
    """Kernel values against chosen windows, and the Nyström map from them."""

    def __init__(self, windows: np.ndarray):
        ids, values = _features(windows)
        self.columns = np.unique(ids)
        self.rows = np.zeros((len(self.columns) + 1, len(windows)), np.float32)  # the last row: subsequences of no landmark
        for k, own in enumerate(ids):
            np.add.at(self.rows[:, k], np.searchsorted(self.columns, own), values)
        kernel = np.zeros((len(windows), len(windows)))
        for lo in range(0, len(self.rows), PIECE):  # in pieces, so that no copy of all rows in doubles is made
            part = self.rows[lo : lo + PIECE].astype(np.float64)
            kernel += part.T @ part
        values, vectors = np.linalg.eigh(kernel)
        keep = values > 1e-6 * values.max()
        self.map = vectors[:, keep] / np.sqrt(values[keep])

    def features(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), self.map.shape[1]), np.float32)  # the largest table of a fit
        for lo in range(0, len(windows), 50):
            ids, values = _features(windows[lo : lo + 50])
            at = np.searchsorted(self.columns, ids)
            at[self.columns[np.minimum(at, len(self.columns) - 1)] != ids] = len(self.columns)
            out[lo : lo + 50] = np.einsum("nij,i->nj", self.rows[at], values) @ self.map
        return out

    def fold(self, line: np.ndarray) -> np.ndarray:
        """The weight table of the machine that is ``line`` in the mapped space."""
        weight = np.zeros(SYMBOLS**3, np.float32)
        along = self.map @ line
        for lo in range(0, len(self.columns), PIECE):
            weight[self.columns[lo : lo + PIECE]] = self.rows[lo : lo + PIECE][: len(self.columns) - lo] @ along
        return weight


def _squared_hinge(rows: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss by Newton steps on the active rows."""
    width = rows.shape[1]
    keep = ridge * np.eye(width + 1)
    keep[-1, -1] = 1e-6
    line, offset = np.zeros(width), 0.0
    active = np.ones(len(y), bool)
    for _ in range(steps):
        left, right = keep.copy(), np.zeros(width + 1)
        for lo in range(0, len(rows), 2048):  # in pieces, so that no second copy of all rows is made
            some = active[lo : lo + 2048]
            part = np.hstack([rows[lo : lo + 2048][some].astype(np.float64), np.ones((some.sum(), 1))])
            weighted = part * cost[lo : lo + 2048][some, None]
            left += weighted.T @ part
            right += weighted.T @ y[lo : lo + 2048][some]
        solved = np.linalg.solve(left, right)
        line, offset = solved[:-1], float(solved[-1])
        along = np.concatenate([rows[lo : lo + 2048].astype(np.float64) @ line for lo in range(0, len(rows), 2048)])
        now = y * (along + offset) < 1
        if (now == active).all():
            break
        active = now
    return line, offset


def _words(text: str) -> set[str]:
    return {w.strip(".,;:!?\"'()") for w in text.lower().split()}


def _seeds(toxic: list[str], clean: list[str]) -> dict[str, float]:
    """Words of toxic texts that no clean text has, by the number of texts that have them."""
    there: Counter = Counter()
    for t in toxic:
        there.update(_words(t))
    found = {w: n for w, n in there.items() if n >= 2 and len(w) >= 3}
    for t in clean:
        for w in _words(t) & found.keys():
            del found[w]
    return found


def fit(texts: list[str], labels: np.ndarray, turns: int = 4, landmarks: int = 400, seed: int = 7) -> Machine:
    """Learn from whole labelled texts; the texts are given in a fixed order, so the result is fixed too."""
    share = float(labels.mean()) if len(labels) else 0.0
    blank = Machine(np.zeros(SYMBOLS**3, np.float32), 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    if share in (0.0, 1.0):
        return blank
    rng = np.random.default_rng(seed)
    toxic = [visible(t) for t, y in zip(texts, labels, strict=True) if y]
    clean = [visible(t) for t, y in zip(texts, labels, strict=True) if not y]
    codes = {1: [symbols(t).astype(np.uint8) for t in toxic], 0: [symbols(t).astype(np.uint8) for t in clean]}
    seeds = _seeds(toxic, clean)
    positive = []
    for text, own in zip(toxic, codes[1], strict=True):
        words = sorted(_words(text) & seeds.keys(), key=lambda w: (-seeds[w], w))[:3]
        words = [w for w in words if 2 * seeds[w] > seeds[words[0]]]
        raw = "\0" * WINDOW + "".join(c.lower() if c.isascii() else c for c in text)
        starts = [at for w in words if (at := raw.find(w)) >= 0]
        positive += list(_windows(own, np.array(starts))) if starts else []
    spread = 3 + 12_000 // len(clean)
    del toxic, clean
    negative = [w for own in codes[0] for w in _windows(own, rng.integers(0, len(own) - WINDOW - REACH + 1, spread))]
    if not positive:
        positive = [w for own in codes[1] for w in _windows(own, rng.integers(0, len(own) - WINDOW - REACH + 1, 3))]
    weight, offset = blank.weight, 0.0
    for turn in range(turns):
        p, n = (np.unique(np.array(w, np.int32), axis=0) for w in (positive, negative))
        chosen = np.concatenate([p[rng.permutation(len(p))[: landmarks * 3 // 4]], n[rng.permutation(len(n))[: landmarks // 4]]])
        marks = Landmarks(np.unique(chosen, axis=0))
        both = np.concatenate([p, n])
        y = np.concatenate([np.ones(len(p)), -np.ones(len(n))])
        cost = np.where(y > 0, len(y) / (2 * len(p)), len(y) / (2 * len(n)))
        line, offset = _squared_hinge(marks.features(both), y, cost)
        weight = marks.fold(line)
        del marks, both  # the next turn's table is as large
        if turn == turns - 1:
            break
        positive = []
        for kind, into in ((1, positive), (0, negative)):
            for own in codes[kind]:
                scores = window_scores(own.astype(np.int32), weight) + offset
                taken = 0
                for _ in range(3 if kind else 6):
                    at = int(np.argmax(scores))
                    # of a toxic text the worst window counts in any case, others only if they are far on its side
                    if scores[at] < (0.8 if taken else -np.inf if kind else -0.5):
                        break
                    taken = kind
                    into.append(own[at : at + WINDOW + REACH])
                    scores[max(0, at - WINDOW) : at + WINDOW] = -np.inf
    worst = np.array([window_scores(symbols(t), weight).max() for t in texts])
    slope, line = _platt(worst, labels)
    return Machine(weight, slope, line)


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic line through the worst windows, by Newton steps, both classes weighing the same."""
    mean, spread = x.mean(), x.std() or 1.0
    rows = np.stack([(x - mean) / spread, np.ones(len(x))], 1)
    cost = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum())) * len(y)
    line = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ line, -30, 30)))
        hess = (rows * (cost * p * (1 - p))[:, None]).T @ rows + 0.05 * np.eye(2)
        step = np.linalg.solve(hess, rows.T @ (cost * (y - p)) - 0.05 * line)
        line = line + step
        if abs(step).max() < 1e-9:
            break
    return float(line[0] / spread), float(line[1] - line[0] * mean / spread)


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", max_texts: int = 1500, max_chars: int = 50_000, **how) -> Machine:
    """Fit on at most ``max_texts`` labelled ids of each class (twice as many clean ones); of rows that share an id, on the least text."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna()
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = known.filter("y = 1").orderBy(*order).limit(max_texts).union(known.filter("y = 0").orderBy(*order).limit(2 * max_texts))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text") <= max_chars)
    one = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    got = one.toPandas().sort_values("doc_id")  # at most 3 * max_texts rows
    return fit(got.text.tolist(), got.y.to_numpy(float), **how)


def score(documents: DataFrame, model: Machine, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted) of every document, where Spark read it."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = model.score(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values), pa.array((values >= threshold).astype("int32"))], ["doc_id", "score", "predicted"])

    return map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), step, "doc_id long, score double, predicted int")


def keep_clean(documents: DataFrame, model: Machine, threshold: float = 0.5) -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns; rows that share an id stay or go together."""
    return without(documents, score(documents, model, threshold).filter("predicted = 1"))


def op3_toxicity_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = train(documents, labels.filter(fold(F.col("doc_id")) != 0))
    return score(documents, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
