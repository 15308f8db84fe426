"""Subword lattice likelihood: the probability of a text over all its segmentations.

The pieces and their scores come from an existing subword vocabulary file; a piece of rank
r starts with weight 1 / (r + 10). The weights are then fitted by expectation maximisation
over the counts of all distinct training words, so what is gathered grows with the corpus.
The probability of a word sums over all its cuts into pieces, by the forward recursion in
log space; a text's is the product over its words and one end.

Work on the cluster:

1. each task counts its words; counts are summed by word: one shuffle of distinct words;
2. every round of fitting maps the table of counts to expected piece counts, at most one
   row for each piece and task, summed to one row for each piece;
3. each distinct word is scored once and stored with its count;
4. texts look up the words with the highest counts, at most ``frequent`` of them, in a table
   that is broadcast; all other words are joined by shuffle. So a word that occurs in every
   text never meets in one task, and the broadcast doesn't grow with the corpus.

Defined results: null and empty texts are one end; a null id counts as training text and
isn't held out; repeated rows are counted and scored each for itself; words of any length
are scored whole, the long ones in blocks of places, with 16 bytes a place held throughout; without training texts all counts are zero and the weights stay as the
vocabulary gives them; extra columns are not read.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import exp, inf, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.llm.common import bounded_batches, fold, table
from parcelforge.session import materialize

#: Distinct words a task holds before it hands its counts on.
HELD_WORDS = 300_000
#: Substrings of words that are looked up at once.
CELLS = 1_500_000
#: Words of this many bytes are walked place by place, their arcs looked up for BLOCK places at once.
LONG, BLOCK = 512, 8192
_BYTE = np.random.default_rng(41).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = 0xD6E8FEB86659FD93
_SLOTS = 1 << 18


def words(text: str | None) -> list[bytes]:
    """Words between ASCII blanks with A-Z lowered."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def read_pieces(model_file: str) -> tuple[list[bytes], np.ndarray]:
    """Surfaces of the vocabulary (a word begins with a blank) and the weight each starts with."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = model.get_piece_size()
    weights: dict[bytes, float] = {}
    for i in range(size):
        if model.is_control(i) or model.is_unknown(i):
            continue
        if model.is_byte(i):
            surface, rank = bytes([int(model.id_to_piece(i)[1:-1], 16)]), float(size)
        else:
            surface, rank = model.id_to_piece(i).replace("▁", " ").encode(), min(float(size), -model.get_score(i))
        if b" " in surface[1:]:
            continue  # never inside one word
        weights[surface] = weights.get(surface, 0.0) + 1 / (rank + 10)
    every = np.array(list(weights.values()))
    return list(weights), every / every.sum()


def _pooled(batches: Iterator[pa.RecordBatch], rows: int = 60_000) -> Iterator[pa.Table]:
    """Batches of words put together, so that words of like length fill whole chunks."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


class Lattice:
    """Looks substrings up in the vocabulary, for many words at once."""

    def __init__(self, surfaces: list[bytes]):
        self.widest = max(map(len, surfaces))
        self.up = self.down = np.ones(1, np.uint64)
        self._powers(1 << 12)
        keys = np.array([int((_BYTE[np.frombuffer(s, np.uint8)] * self.up[: len(s)]).sum(dtype=np.uint64)) for s in surfaces], np.uint64)
        self.key, self.piece = np.zeros(_SLOTS, np.uint64), np.full(_SLOTS, -1, np.int32)
        self.probes = 1
        for i, k in enumerate(keys.tolist()):
            at, n = self._slot(k), 1
            while self.piece[at] >= 0:
                at, n = (at + 1) % _SLOTS, n + 1
            self.key[at], self.piece[at] = k, i
            self.probes = max(self.probes, n)

    @staticmethod
    def _slot(key):
        if isinstance(key, int):
            return (key ^ (key >> 29)) % (1 << 64) * 0xBF58476D1CE4E5B9 % (1 << 64) >> 46
        return (((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(46)).astype(np.int64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            up, down = np.full(n, np.uint64(_STEP)), np.full(n, np.uint64(pow(_STEP, -1, 1 << 64)))
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of the piece of each key, -1 where there is none."""
        at = self._slot(keys)
        out = np.where(self.key[at] == keys, self.piece[at], -1)
        open_ = np.nonzero((out < 0) & (self.piece[at] >= 0))
        for step in range(1, self.probes):
            if not len(open_[0]):
                break
            rest = (at[open_] + step) % _SLOTS
            out[open_] = np.where(self.key[rest] == keys[open_], self.piece[rest], -1)
            going = (out[open_] < 0) & (self.piece[rest] >= 0)
            open_ = tuple(x[going] for x in open_)
        return out

    def chunks(self, batch: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers in the batch, sizes, padded bytes) of words of like size, all but the long ones; each word gets its blank."""
        sizes = np.fromiter(map(len, batch), np.int64, len(batch)) + 1
        order = np.argsort(sizes, kind="stable")
        order = order[: np.searchsorted(sizes[order], LONG)]
        at = 0
        while at < len(order):
            end = min(len(order), at + 4096)
            # words that are much longer than the first would pad all others
            end = at + int(np.searchsorted(sizes[order[at:end]], sizes[order[at]] * 5 // 4 + 1, side="right"))
            while end - at > 1 and (end - at) * sizes[order[end - 1]] * min(self.widest, sizes[order[end - 1]]) > CELLS:
                end = at + (end - at + 1) // 2
            own = order[at:end]
            width = int(sizes[own[-1]])
            raw = b"".join((b" " + batch[i]).ljust(width, b"\0") for i in own.tolist())
            yield own, sizes[own], np.frombuffer(raw, np.uint8).reshape(len(own), width)
            at = end

    def arcs(self, raw: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(end, first start, piece numbers by word and start) for every end, left to right."""
        width = raw.shape[1]
        self._powers(width + 1)
        run = np.zeros((len(raw), width + 1), np.uint64)
        np.cumsum(_BYTE[raw] * self.up[:width], axis=1, out=run[:, 1:])
        for end in range(1, width + 1):
            start = max(0, end - self.widest)
            yield end, start, self.find((run[:, end : end + 1] - run[:, start:end]) * self.down[start:end])

    @staticmethod
    def _sum(values: np.ndarray) -> np.ndarray:
        top = values.max(1)
        safe = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            return safe + np.log(np.exp(values - safe[:, None]).sum(1))

    def forward(self, raw: np.ndarray, log_p: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Log probability of every prefix; ``log_p`` ends with the value of no piece."""
        alpha = np.full((len(raw), raw.shape[1] + 1), -np.inf)
        alpha[:, 0] = 0
        for end, start, piece in self.arcs(raw):
            if keep is not None:
                keep.append((end, start, piece))
            alpha[:, end] = self._sum(alpha[:, start:end] + log_p[piece])
        return alpha

    def _arcs_of(self, raw: np.ndarray, lo: int, hi: int, by_end: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, pieces) of one word's arcs that end in (lo, hi], or start in [lo, hi), in that order."""
        base, top = (max(0, lo - self.widest), hi) if by_end else (lo, min(len(raw), hi + self.widest))
        self._powers(top - base + 1)
        run = np.zeros(top - base + 1, np.uint64)
        np.cumsum(_BYTE[raw[base:top]] * self.up[: top - base], out=run[1:])
        sizes = np.arange(1, self.widest + 1)
        here = np.arange(lo, hi)[:, None]
        start, end = np.broadcast_arrays(*((here + 1 - sizes, here + 1) if by_end else (here, here + sizes)))
        fits = (start >= 0) & (end <= len(raw))
        s, e = np.where(fits, start - base, 0), np.where(fits, end - base, 0)
        piece = np.where(fits, self.find((run[e] - run[s]) * self.down[s]), -1)
        found = np.nonzero(piece >= 0)
        return start[found], end[found], piece[found]

    @staticmethod
    def _walk(value: array, at: list[int], arcs: list[int], others: list[int], lp: list[float]) -> None:
        """Log sums into ``value`` at the places ``at``, each over its next ``arcs`` arcs from ``others``."""
        k = 0
        for place, n in zip(at, arcs, strict=True):
            if n == 1:
                value[place] = value[others[k]] + lp[k]
            elif n:
                terms = [value[others[j]] + lp[j] for j in range(k, k + n)]
                top = max(terms)
                value[place] = top + log(sum([exp(t - top) for t in terms])) if top > -inf else -inf
            k += n

    def forward_long(self, raw: np.ndarray, log_p: np.ndarray) -> array:
        """``forward`` for one word of any length."""
        alpha = array("d", bytes(8)) + array("d", [-inf]) * len(raw)
        for lo in range(0, len(raw), BLOCK):
            hi = min(len(raw), lo + BLOCK)
            start, end, piece = self._arcs_of(raw, lo, hi, by_end=True)
            arcs = np.bincount(end - lo - 1, minlength=hi - lo).tolist()
            self._walk(alpha, range(lo + 1, hi + 1), arcs, start.tolist(), log_p[piece].tolist())
        return alpha

    def expected_long(self, raw: np.ndarray, count: float, log_p: np.ndarray, total: np.ndarray) -> None:
        """Adds one long word's expected uses to ``total``, arcs looked up again from the end to the start."""
        alpha = self.forward_long(raw, log_p)
        whole = alpha[-1]
        if whole == -inf:
            return
        beta = array("d", [-inf]) * len(raw) + array("d", bytes(8))
        a, b = np.frombuffer(alpha), np.frombuffer(beta)
        for lo in reversed(range(0, len(raw), BLOCK)):
            hi = min(len(raw), lo + BLOCK)
            start, end, piece = (x[::-1] for x in self._arcs_of(raw, lo, hi, by_end=False))
            arcs = np.bincount(start - lo, minlength=hi - lo)[::-1].tolist()
            lp = log_p[piece]
            self._walk(beta, range(hi - 1, lo - 1, -1), arcs, end.tolist(), lp.tolist())
            total += np.bincount(piece, np.exp(a[start] + lp + b[end] - whole) * count, len(log_p))

    def log_probability(self, batch: list[bytes], log_p: np.ndarray) -> np.ndarray:
        out = np.zeros(len(batch))
        for own, sizes, raw in self.chunks(batch):
            out[own] = self.forward(raw, log_p)[np.arange(len(own)), sizes]
        for i, raw in self._long(batch):
            out[i] = self.forward_long(raw, log_p)[-1]
        return out

    @staticmethod
    def _long(batch: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        return ((i, np.frombuffer(b" " + w, np.uint8)) for i, w in enumerate(batch) if len(w) + 1 >= LONG)

    def expected(self, batch: list[bytes], counts: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """Expected uses of every piece in the words, each weighing its count."""
        total = np.zeros(len(log_p))
        for own, sizes, raw in self.chunks(batch):
            arcs: list = []
            alpha = self.forward(raw, log_p, arcs)
            every = np.arange(len(own))
            whole = alpha[every, sizes]
            beta = np.full_like(alpha, -np.inf)
            beta[every, sizes] = 0
            weight = counts[own].astype(np.float64)[:, None]
            for end, start, piece in reversed(arcs):
                through = log_p[piece] + beta[:, end : end + 1]
                with np.errstate(invalid="ignore"):
                    use = np.exp(alpha[:, start:end] + through - whole[:, None]) * weight
                total += np.bincount(piece.ravel() % len(log_p), np.nan_to_num(use).ravel(), len(log_p))
                beta[:, start:end] = np.logaddexp(beta[:, start:end], through)
        for i, raw in self._long(batch):
            self.expected_long(raw, float(counts[i]), log_p, total)
        return total[:-1]


@lru_cache(maxsize=2)
def _lattice(surfaces: bytes) -> Lattice:
    return Lattice(surfaces.split(b"\n\0"))


def _log(weights: np.ndarray) -> np.ndarray:
    return np.append(np.log(weights), -np.inf)


def count_words(documents: DataFrame) -> DataFrame:
    """(token, n): counts of the words of training rows; words of other rows are listed with 0."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter(), Counter()]

        def out() -> pa.RecordBatch:
            tokens = [*seen[1], *(w for w in seen[0] if w not in seen[1])]
            n = list(seen[1].values()) + [0] * (len(tokens) - len(seen[1]))
            seen[0].clear()
            seen[1].clear()
            return pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()), pa.array(n, pa.int64())], ["token", "n"])

        for batch in batches:
            for text, learn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[learn].update(words(text))
            if len(seen[0]) + len(seen[1]) > HELD_WORDS:
                yield out()
        yield out()

    return documents.select("text", "learn").mapInArrow(each, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def fit_pieces(counts: DataFrame, surfaces: list[bytes], start: np.ndarray, rounds: int = 2, prior: float = 100.0) -> np.ndarray:
    """Weights of the pieces after ``rounds`` of expectation maximisation over all counted words."""
    packed, weights = b"\n\0".join(surfaces), start
    for _ in range(rounds):
        log_p = _log(weights)

        def each(batches: Iterator[pa.RecordBatch], log_p=log_p) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(log_p) - 1)
            for pool in _pooled(batches):
                total += _lattice(packed).expected(pool.column(0).to_pylist(), pool.column(1).to_numpy(), log_p)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["piece", "n"])

        summed = counts.filter("n > 0").select("token", "n").mapInArrow(each, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        got = summed.toArrow()  # a row for each piece of the vocabulary at most
        uses = np.zeros(len(start))
        uses[got["piece"].to_numpy()] = got["n"].to_numpy()
        weights = (uses + prior * start) / (uses.sum() + prior)
    return weights


def score(documents: DataFrame, model_file: str, held_out_fold: int = 1, rounds: int = 2, frequent: int = 100_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; logarithms to base 10."""
    bounded_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("held_out", fold(F.col("doc_id")) == held_out_fold)
    counts = materialize(count_words(docs.withColumn("learn", (~F.col("held_out")).cast("int"))), "words")
    ends = docs.filter("not held_out").count()
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    n, v = totals[0] + ends, totals[1] + (ends > 0)
    floor = float(np.log10(n + 0.5 * (v + 1)))

    surfaces, start = read_pieces(model_file)
    weights = fit_pieces(counts, surfaces, start, rounds)
    packed, log_p = b"\n\0".join(surfaces), _log(weights)
    # a text ends with this probability before each word: one end for each training text
    stop = (ends + 1) / (totals[0] + ends + 2)
    go_on, the_end = float(np.log10(1 - stop)), float(np.log10(stop))

    def words_scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pool in _pooled(batches):
            values = _lattice(packed).log_probability(pool.column(0).to_pylist(), log_p) / np.log(10) + go_on
            yield from pool.append_column("lp", pa.array(values)).to_batches()

    scored = materialize(counts.mapInArrow(words_scored, "token binary, n long, lp double"), "scored")
    steps = scored.filter("n > 0").groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("size")).orderBy(F.col("step").desc()).collect()  # some hundred rows
    least, size = float("inf"), 0
    for row in steps:
        if (size := size + row.size) > frequent:
            break
        least = row.step
    top = scored.filter((F.col("n") > 0) & (F.floor(F.log2("n") * 8) >= least)).toArrow()  # at most ``frequent`` rows
    top_words, top_n, top_lp = top["token"].to_pylist(), top["n"].to_numpy(), top["lp"].to_numpy()
    top_base = np.log10(top_n + 0.5) - floor
    end_base = float(np.log10(ends + 0.5)) - floor
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "token", "times"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {w: i for i, w in enumerate(top_words)}
        get = at.get
        for batch in batches:
            whole, rare = [], []
            for row, doc_id, text, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = words(text)
                found = np.fromiter((get(w, -1) for w in own), np.int64, len(own))
                hit = found[found >= 0]
                whole.append((row, doc_id, held, len(own) + 1, len(hit) + (ends > 0), top_base[hit].sum() + end_base, top_lp[hit].sum() + the_end, b" %d" % row, 0))
                if len(hit) < len(own):
                    others = Counter(own[i] for i in np.flatnonzero(found < 0).tolist())
                    rare.extend((row, w, k) for w, k in others.items())
            out = [*zip(*whole, strict=True)] if whole else [()] * 9
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
            if rare:
                row, token, times = zip(*rare, strict=True)
                empty = [pa.nulls(len(rare), k) for k in kinds[1:7]]
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), *empty, pa.array(token, pa.binary()), pa.array(times, pa.int64())], names)

    # a text's own row has a token with a blank, which no word has: it joins with nothing
    parts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "held_out").mapInArrow(
        look_up, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, token binary, times long")
    joined = parts.join(scored, "token", "left")
    known = F.when(F.col("n") > 0, F.col("times")).otherwise(0)
    base = F.when(F.col("times") > 0, F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 0.5) - F.lit(floor))).otherwise(0.0)
    summed = joined.select(
        "row", "doc_id", "held_out", "n_tokens", (F.coalesce("n_known", F.lit(0)) + known).alias("n_known"),
        (F.coalesce("base", F.lit(0.0)) + base).alias("base"), (F.coalesce("score", F.lit(0.0)) + F.coalesce(F.col("times") * F.col("lp"), F.lit(0.0))).alias("score"),
    ).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
