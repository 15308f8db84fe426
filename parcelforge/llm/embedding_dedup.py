"""Near-duplicate vectors by a forest of random projection trees.

A tree splits a sample again and again by a random direction between two of its points, at
the median; points close to the cut go to both sides (spill). The spill is as wide as the
links among the sample rows need (a split parts at most LOSS of them), and a node which no
cut makes cheaper to compare stays one leaf, so a hot group isn't cut through. Every vector then walks down
all trees, so near vectors meet in some leaf. Inside leaves all vectors are compared by
cosine in double precision; only pairs that are verified count, each once, in the first
leaf that both share. Union of the links gives the components.

Hot groups: equal vectors are one row with a weight. Tight groups of many different vectors
are found on the sample: members within half the linking angle of a centre link with each
other for certain (triangle inequality), so they are counted, not compared. Where no vector
outside comes near enough to link with a member (each names all balls within one and a half
linking angles), the group never enters a tree. Leaves that
are still large are dealt out in chunks, compared chunk against chunk, each a group of its
own; a block returns sums and a spanning forest, never its pairs. Rows that met in an unsplit
leaf are not dealt to each other again in later trees.

Bounds: trees are fitted on one vector of fifty, but no fewer than ``sample_rows`` and no more
than ``most_sample_rows`` and SAMPLE_BYTES, by hash order (centres on the first 8,000 of them); all vectors are
indexed. The forest (a direction for each split) and the centres are broadcast; their size is
bounded by the sample's. Leaves hold about ``leaf_rows`` vectors up to 10 million rows, and
total / 25,000 beyond. As a link may be parted at every split, the number of trees grows with
the depth: one more for each three levels beyond the seventh.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component
link with nothing, nor do vectors of different lengths; rows with equal vectors are linked
with each other whatever their ids; a null id is never a component's name; extra columns
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.graph.components import connected_components
from parcelforge.llm.common import map_arrow, table
from parcelforge.session import materialize

#: Rows of a chunk of a leaf; a block compares two chunks.
CHUNK = 2048
#: A split parts at most this share of the links among this many of its sample rows.
LOSS, PROBES = 0.03, 1000


@dataclass
class Tree:
    """Splits by number: direction, cut and spill, and the two children (a leaf is ~number); and the large leaves left whole."""

    direction: np.ndarray
    cut: np.ndarray
    spill: np.ndarray
    child: np.ndarray
    leaves: int
    whole: np.ndarray

    def walk(self, unit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, leaf) for all leaves that each row reaches."""
        out, todo = [], [(0 if len(self.cut) else ~0, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out.append((rows, np.full(len(rows), ~node)))
                continue
            if len(rows):
                side = unit[rows] @ self.direction[node] - self.cut[node]
                todo.append((int(self.child[node, 0]), rows[side <= self.spill[node]]))
                todo.append((int(self.child[node, 1]), rows[side >= -self.spill[node]]))
        return out


def _linked(unit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that link, and of each pair its share of all links and, the second row, of all linked rows."""
    a, b = np.nonzero(np.triu(unit @ unit.T >= threshold, 1))
    degree = np.bincount(np.concatenate([a, b]), minlength=len(unit))
    if len(a) > 20 * PROBES:
        a, b = a[:: len(a) // (20 * PROBES) + 1], b[:: len(b) // (20 * PROBES) + 1]
    weight = np.stack([np.ones(len(a)), 1 / np.maximum(degree[a], 1) + 1 / np.maximum(degree[b], 1)])
    return a, b, weight / np.maximum(weight.sum(1, keepdims=True), 1e-300)


def _wide_enough(side: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray, loss: float) -> float:
    """The least spill that parts at most ``loss`` of the pairs, by either weight."""
    apart = np.flatnonzero(side[a] * side[b] < 0)
    need = np.minimum(np.abs(side[a[apart]]), np.abs(side[b[apart]]))
    order = np.argsort(-need)
    lost = np.cumsum(weight[:, apart[order]], axis=1).max(0) if len(apart) else np.zeros(0)
    at = int(np.searchsorted(lost, loss, side="right"))
    return float(need[order[at]]) if at < len(order) else 0.0


def grow(sample: np.ndarray, leaf: int, rng: np.random.Generator, spill: float, threshold: float, loss: float = LOSS) -> Tree:
    """A node is split only where few of its links are parted and less is left to compare; else it is one leaf."""
    directions, cuts, spills, children = [], [], [], []
    leaves, whole = 0, []

    def split(rows: np.ndarray, depth: int) -> int:
        nonlocal leaves
        if len(rows) > leaf and depth < 40:
            some = rows if len(rows) <= PROBES else rng.choice(rows, PROBES, replace=False)
            a_, b_, weight = _linked(sample[some], threshold)
            best = None
            for _ in range(6):
                if best and best[0] < 0.7:
                    break
                a, b = sample[rng.choice(rows, 2, replace=False)]
                line = a - b
                side = sample[rows] @ line
                cut = float(np.median(side))
                width = max(float(np.quantile(np.abs(side - cut), spill)), _wide_enough(sample[some] @ line - cut, a_, b_, weight, loss))
                low, high = rows[side - cut <= width], rows[side - cut >= -width]
                work = (len(low) ** 2 + len(high) ** 2) / len(rows) ** 2
                if work < 0.85 and max(len(low), len(high)) < 0.9 * len(rows) and (best is None or work < best[0]):
                    best = work, line, cut, width, low, high
            if best:
                _, line, cut, width, low, high = best
                node = len(cuts)
                directions.append(line)
                cuts.append(cut)
                spills.append(width)
                children.append((0, 0))
                children[node] = (split(low, depth + 1), split(high, depth + 1))
                return node
            whole.append(leaves)
        leaves += 1
        return ~(leaves - 1)

    split(np.arange(len(sample)), 0)
    width = sample.shape[1] if sample.ndim == 2 else 0
    return Tree(np.array(directions).reshape(-1, width), np.array(cuts), np.array(spills), np.array(children).reshape(-1, 2), leaves, np.array(whole, int))


#: Doubles of the driver's sample, in bytes.
SAMPLE_BYTES = 128 << 20


def dense_centres(sample: np.ndarray, threshold: float, least: int, most: int) -> np.ndarray:
    """Sample points with ``least`` or more others within half the linking angle, no two near each other."""
    half = np.cos(np.arccos(threshold) / 2)
    apart = np.cos(np.arccos(threshold) * 1.5)
    found: list[int] = []
    if len(sample):
        around = np.concatenate([(sample[i : i + 500] @ sample.T >= half).sum(1) for i in range(0, len(sample), 500)])
        for i in np.argsort(-around, kind="stable"):
            if around[i] <= least or len(found) == most:
                break
            if not found or (sample[found] @ sample[i]).max() < apart:
                found.append(int(i))
    return sample[found].reshape(len(found), sample.shape[1] if sample.ndim == 2 else 0)


def _unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; each is divided by its largest component first, so that no square overflows or vanishes."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _units(column: pa.Array) -> np.ndarray:
    return _unit_rows(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def _ball_of(unit: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, list[list[int]]]:
    """The ball that each row is in (-1: none) and all other balls that it comes near to."""
    ball = np.full(len(unit), -1)
    near: list[list[int]] = [[] for _ in range(len(unit))]
    if len(centres):
        angle = np.arccos(threshold)
        cosine = unit @ centres.T
        best = np.argmax(cosine, axis=1)
        inside = cosine[np.arange(len(unit)), best] >= np.cos(angle / 2) + 1e-9
        ball[inside] = best[inside]
        close = cosine >= np.cos(angle * 1.5) - 1e-9
        close[np.arange(len(unit))[inside], best[inside]] = False
        for row, other in zip(*(x.tolist() for x in np.nonzero(close)), strict=True):
            near[row].append(other)
    return ball, near


def _compare(threshold: float):
    """One block: rows of one leaf in one chunk, or in two different ones."""

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf, i, j = int(pdf.leaf.iloc[0]), int(pdf.i.iloc[0]), int(pdf.j.iloc[0])
        unit = _unit_rows(np.stack(pdf.embedding.to_numpy()).astype(np.float64))
        width = max(map(len, pdf.leaves))
        own = np.full((len(pdf), width), -1, np.int64)
        for k, x in enumerate(pdf.leaves):
            own[k, : len(x)] = x
        chunk, node, weight, ball = (pdf[c].to_numpy() for c in ("chunk", "node", "weight", "ball"))
        lower = np.where(own < leaf, own, -1)
        common, times = np.unique(lower, return_counts=True)
        common = common[(common >= 0) & (times > 1)]  # leaves before this one in which rows can meet
        hit = np.zeros((len(pdf), len(pdf)), bool)
        for lo in range(0, len(pdf), 256):
            strip = unit[lo : lo + 256] @ unit.T >= threshold
            strip &= np.arange(lo, lo + len(strip))[:, None] < np.arange(len(pdf))
            strip &= (ball[lo : lo + 256, None] < 0) | (ball[lo : lo + 256, None] != ball)
            if i != j:
                strip &= chunk[lo : lo + 256, None] != chunk
            x, y = np.nonzero(strip)
            if len(x) <= 20_000:
                met = ((lower[x + lo][:, :, None] == lower[y][:, None, :]) & (lower[x + lo][:, :, None] >= 0)).any((1, 2))
                strip[x[met], y[met]] = False
            else:
                for at in range(0, len(common), 256):
                    some = common[at : at + 256]
                    place = np.searchsorted(some, lower).clip(0, len(some) - 1)
                    r, c = np.nonzero(some[place] == lower)
                    inside = np.zeros((len(pdf), len(some)), np.float32)
                    inside[r, place[r, c]] = 1
                    strip &= inside[lo : lo + 256] @ inside.T == 0
            hit[lo : lo + 256] = strip
        count = hit @ weight + hit.T @ weight
        hit |= hit.T
        some, label = count > 0, node.copy()
        left = some.copy()
        for first in np.flatnonzero(some):
            front = np.array([first]) if left[first] else np.zeros(0, int)
            while len(front):
                left[front] = False
                label[front] = node[first]
                front = np.flatnonzero(hit[front].any(0) & left)
        return pd.DataFrame({"node": node[some], "n": count[some], "label": label[some]})

    return block


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, trees: int = 5, spill: float = 0.08, leaf_rows: int = 400, sample_rows: int = 20_000, most_sample_rows: int = 200_000, least: int = 12, most_centres: int = 512, seed: int = 5,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce((F.size("embedding") > 0) & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # adding zero makes -0.0 plain: equal vectors get equal keys
    plain = F.transform("embedding", lambda x: x + F.lit(0).cast(vectors.schema["embedding"].dataType.elementType))
    rows = rows.withColumn("node", F.when(usable, F.xxhash64(plain)))
    whole = materialize(rows.filter("node is not null").groupBy("node").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least_id"), F.first("embedding").alias("embedding")), "vectors")
    lengths = sorted(r[0] for r in whole.select(F.size("embedding").alias("d")).distinct().collect())
    parts = [_same_length(whole.filter(F.size("embedding") == d), threshold, trees, spill, leaf_rows, (sample_rows, most_sample_rows), least, most_centres, seed) for d in lengths]
    result = rows.select("vec_id", "node")
    if not parts:
        return result.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    joined = result.join(found, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _same_length(whole: DataFrame, threshold: float, trees: int, spill: float, leaf_rows: int, sample_rows: tuple[int, int], least: int, most_centres: int, seed: int) -> DataFrame:
    """(node, n_links, component_id) of distinct vectors of one length."""
    total = whole.count()
    most = min(sample_rows[1], SAMPLE_BYTES // (8 * max(1, len(whole.first().embedding))))
    sample = whole.orderBy(F.xxhash64("node")).limit(min(most, max(sample_rows[0], total // 50))).select("embedding").toArrow()  # at most ``most`` vectors
    unit = _units(sample["embedding"].combine_chunks())
    rng = np.random.default_rng(seed)
    centres = dense_centres(unit[: min(len(unit), 8000)], threshold, least, most_centres)
    leaf = max(8, leaf_rows * len(unit) // max(1, total))
    trees += max(0, int(np.log2(max(1, len(unit) / leaf))) - 7) // 3
    forest = [grow(unit, leaf, rng, spill, threshold) for _ in range(trees)]
    bases = np.cumsum([0] + [t.leaves for t in forest])
    unsplit = {int(base) + int(x) for base, t in zip(bases, forest, strict=False) for x in t.whole}

    def balls(batch: pa.RecordBatch) -> pa.RecordBatch:
        ball, near = _ball_of(_units(batch.column("embedding")), centres, threshold)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(ball, pa.int32()), pa.array(near, pa.list_(pa.int32()))], [*batch.schema.names, "ball", "near"])

    dealt = materialize(map_arrow(whole, balls, whole._jdf.schema().toDDL() + ", ball int, near array<int>"), "balls")
    touched = dealt.select(F.explode("near").alias("ball")).distinct()
    sizes = dealt.filter("ball >= 0").groupBy("ball").agg(F.sum("weight").alias("size"), F.min("node").alias("first"))
    sizes = F.broadcast(sizes)  # a row for each centre at most
    alone = F.broadcast(sizes.join(touched, "ball", "left_anti").select("ball", F.lit(True).alias("alone")))
    indexed = dealt.join(alone, "ball", "left").filter("alone is null")

    def leaves(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors_ = _units(batch.column("embedding"))
        where: list[list[int]] = [[] for _ in range(len(vectors_))]
        for base, tree in zip(bases, forest, strict=False):
            for rows, leaf in tree.walk(vectors_):
                for r, at in zip(rows.tolist(), leaf.tolist(), strict=True):
                    where[r].append(int(base) + at)
        hot = [min((x for x in own if x in unsplit), default=-1) for own in where]
        return pa.RecordBatch.from_arrays([batch.column("node"), batch.column("weight"), batch.column("ball"), batch.column("embedding"), pa.array(where, pa.list_(pa.int32())), pa.array(hot, pa.int32())], ["node", "weight", "ball", "embedding", "leaves", "hot"])

    kind = whole.schema["embedding"].dataType.simpleString()
    placed = map_arrow(indexed, leaves, f"node long, weight long, ball int, embedding {kind}, leaves array<int>, hot int")
    # rows that share an unsplit leaf before this one have been compared there: where they are many, they get chunks of their own that don't meet each other
    rows = placed.select("node", "weight", "ball", "embedding", "leaves", "hot", F.explode("leaves").alias("leaf")).withColumn("hot", F.when(F.col("hot") < F.col("leaf"), F.col("hot")).otherwise(-1))
    counted = rows.groupBy("leaf", "hot").agg(F.count("*").alias("n")).withColumn("hot", F.when(F.col("n") > CHUNK, F.col("hot")).otherwise(-1)).groupBy("leaf", "hot").agg(F.sum("n").alias("n"))
    deal: dict[int, list[tuple[int, int, int]]] = {}
    for r in counted.orderBy("leaf", "hot").collect():  # a row for each leaf of the forest, and for CHUNK rows of a leaf at most one more
        own = deal.setdefault(r.leaf, [])
        own.append((r.hot, sum(x[2] for x in own), -(-r.n // CHUNK)))
    large = [(leaf, hot, at, n, sum(x[2] for x in own)) for leaf, own in deal.items() for hot, at, n in own if len(own) > 1 or hot >= 0 or n > 1]
    plan = rows.sparkSession.createDataFrame(large, "leaf int, hot int, first int, chunks int, total int")
    apart = plan.filter("hot >= 0").select("leaf", "hot", F.col("first").alias("own_first"), F.col("chunks").alias("own_chunks"), F.col("total").alias("own_total"))
    rows = rows.join(F.broadcast(apart), ["leaf", "hot"], "left").join(F.broadcast(plan.filter("hot < 0").drop("hot")), "leaf", "left")
    part = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    rows = rows.withColumn("chunk", F.coalesce(F.col("own_first") + part(F.col("own_chunks")), F.col("first") + part(F.col("chunks")), F.lit(0)))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("own_total", "total", F.lit(1)) - 1)))
    rows = rows.filter("own_first is null or other < own_first or other >= own_first + own_chunks")
    rows = rows.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
    found = materialize(rows.select("node", "weight", "ball", "embedding", "leaves", "leaf", "chunk", "i", "j").groupBy("leaf", "i", "j").applyInPandas(_compare(threshold), "node long, n long, label long"), "links")

    in_ball = dealt.filter("ball >= 0").join(sizes, "ball")
    edges = found.select(F.col("node").alias("a"), F.col("label").alias("b")).union(in_ball.select(F.col("node").alias("a"), F.col("first").alias("b")))
    components = connected_components(edges)
    outside = found.groupBy("node").agg(F.sum("n").alias("n"))
    inside = in_ball.select("node", (F.col("size") - F.col("weight")).alias("ball_links"))
    named = components.join(whole.select(F.col("node").alias("id"), "least_id"), "id")
    least_ids = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_node = named.join(least_ids, "component").select(F.col("id").alias("node"), "component_id")
    out = whole.select("node", "weight", "least_id").join(outside, "node", "left").join(inside, "node", "left").join(of_node, "node", "left")
    n_links = F.col("weight") - 1 + F.coalesce("n", F.lit(0)) + F.coalesce("ball_links", F.lit(0))
    return out.select("node", n_links.alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
