"""Centroid clustering of vectors in whole numbers, by sort-means.

Every round orders, for each centroid, the others by their distance from it. A vector starts
at the centroid that it had before, at distance d, and looks at the others in that order; it
stops at the first one that is strictly further than 2 d from the centroid it started at, for
no further one can be as near (at just 2 d one can be equally near and have the smaller
number). A round is one pass over the vectors: tasks return the sums of their own clusters,
Spark adds them up, and the driver holds the centroids and nothing else.

Everything is exact: components are whole numbers, distances are squared, sums are decimals.
So results don't depend on partitions, and no tolerance is needed. A round that leaves all
centroids in place ends the work, as all later ones would do the same.

The vectors are written once a round, with their assignment; the table of the round before
is deleted then. No shuffle carries vectors, so hot clusters and repeated vectors cost
nothing more than others.

Defined results: vectors that are null, have another number of components, or hold null or
non-finite components are left out; rows with equal ids are clustered each for itself, and
as starting centroids they come in the order of their components; a null id sorts behind all
others as a start; with fewer vectors than centroids there are as many centroids as vectors;
an empty table gives no rows; extra columns are not read. Components beyond 2^62 in size
after scaling count as 2^62, and distances and sums beyond the largest long are that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.llm.common import table
from parcelforge.session import discard, materialize

LIMIT = 1 << 62
LARGEST = (1 << 63) - 1


def squares(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances of rows from one centre, exact: in longs where they fit, else in Python's whole numbers."""
    widest = max(int(vectors.max(initial=-LIMIT)) - int(centre.min()), int(centre.max()) - int(vectors.min(initial=LIMIT)), 0)
    if widest * widest * len(centre) <= LARGEST:
        gap = vectors - centre
        return np.einsum("ij,ij->i", gap, gap)
    gap = vectors.astype(object) - centre.astype(object)
    return (gap * gap).sum(1)


def neighbours(centroids: list[list[int]]) -> list[list[tuple[int, int]]]:
    """For each centroid the others as (least squared distance d with 2 d reaching there, number), nearest first."""
    rows = np.array(centroids, dtype=object)
    between = [[int(x) for x in ((rows - r) ** 2).sum(1)] for r in rows]
    return [sorted((-(-d // 4), j) for j, d in enumerate(own) if j != i) for i, own in enumerate(between)]


def assign(vectors: np.ndarray, before: np.ndarray, centroids: list[list[int]], order: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (ties: smaller number) and its squared distance, scanning from ``before``."""
    centres = np.array(centroids, dtype=np.int64)
    found, distance = before.copy(), np.zeros(len(vectors), np.int64)
    for start in np.unique(before).tolist():
        rows = np.flatnonzero(before == start)
        current = squares(vectors[rows], centres[start])
        best, where = current.copy(), np.full(len(rows), start)
        at = np.arange(len(rows))
        for reach, number in order[start]:
            at = at[current[at] >= reach]
            if not len(at):
                break
            other = squares(vectors[rows[at]], centres[number])
            nearer = (other < best[at]) | ((other == best[at]) & (number < where[at]))
            best = best.astype(object) if other.dtype == object else best
            best[at[nearer]], where[at[nearer]] = other[nearer], number
        found[rows], distance[rows] = where, np.minimum(best, LARGEST).astype(np.int64)
    return found, distance


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _round(centroids: list[list[int]], size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row with its new cluster and distance."""
    order = neighbours(centroids)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, distance = assign(_vectors(batch.column("v"), size), batch.column("cluster").to_numpy(), centroids, order)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(found, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "v", "cluster", "distance"])

    return each


def _sums(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each cluster of a task: number of vectors and sums of the components, as decimals."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            vectors, cluster = _vectors(batch.column("v"), size), batch.column("cluster").to_numpy()
            if len(vectors) and max(abs(int(vectors.min())), abs(int(vectors.max()))) * len(vectors) > LARGEST:
                vectors = vectors.astype(object)
            for c in np.unique(cluster).tolist():
                some = vectors[cluster == c]
                n, old = total.get(c, (0, [0] * size))
                total[c] = n + len(some), [a + int(b) for a, b in zip(old, some.sum(0), strict=True)]
        sums = pa.array([[Decimal(x) for x in s] for _, s in total.values()], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), sums], ["cluster", "n", "sums"])

    return each


def _moved(rows: DataFrame, centroids: list[list[int]], size: int) -> list[list[int]]:
    """The floored means of the clusters; empty ones stay."""
    parts = rows.select("v", "cluster").mapInArrow(_sums(size), "cluster int, n long, sums array<decimal(38,0)>")
    sums = parts.select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = [list(c) for c in centroids]
    for r in sums.collect():  # one row for each component of each centroid
        out[r.cluster][r.at] = int(r.s) // r.n
    return out


def scaled(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors that count, as longs."""
    one = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("long")
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    kept = vectors.filter(F.coalesce((F.size("embedding") == size) & F.forall("embedding", finite), F.lit(False)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", one).alias("v"))


def start_order(vec_id: Column, seed: int) -> list[Column]:
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(vec_id.cast("string"), F.lit("")))
    return [vec_id.isNull(), F.sha2(name, 256)]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3) -> tuple[DataFrame, list[list[int]]]:
    """Rows (vec_id, v, cluster, distance) of the vectors that count, and the final centroids.

    The ``k`` starting centroids are those with the smallest hash of seed and id.
    """
    rows = materialize(scaled(vectors, size, scale).withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")}), "means")
    first = rows.orderBy(*start_order(F.col("vec_id"), seed), "v").limit(k).select("v").collect()
    centroids = [list(r.v) for r in first]
    if not centroids:
        return rows, centroids
    for turn in range(rounds + 1):
        old, rows = rows, materialize(rows.mapInArrow(_round(centroids, size), rows.schema), "means")
        discard(old)
        if turn == rounds:
            break
        moved = _moved(rows, centroids, size)
        if moved == centroids:
            break
        centroids = moved
    return rows, centroids


def summary(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Each vector's cluster with the cluster's and the whole inertia and the digest of its centroid."""
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row for each centroid at most
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    whole = min(sum(sums.values()), LARGEST)
    named = [(c, min(sums.get(c, 0), LARGEST), whole, digest[c]) for c in range(len(centroids))]
    table_ = rows.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table_), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(*cluster(table(spark, sf_dir, "embeddings")))


def _op12_sql(k: int = 8, rounds: int = 10) -> str:
    """The same rounds one after another, each comparing every vector with every centroid."""
    steps = []
    for t in range(rounds + 1):
        steps.append(
            f"""a{t} as materialized (select vec_id, v, struct_extract(b, 'd') as d, struct_extract(b, 'num') as num from (
  select vec_id, any_value(v.v) as v, min({{'d': list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'num': num}}) as b from kept v cross join c{t} c group by vec_id))"""
        )
        if t < rounds:
            steps.append(
                f"""m{t} as materialized (select num, list(floored order by i) as v from (
  select num, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as floored from (select num, unnest(v) as x, unnest(range(64)) as i from a{t}) group by num, i) group by num),
c{t + 1} as materialized (select c.num, coalesce(m.v, c.v) as v from c{t} c left join m{t} m on m.num = c.num)"""
            )
    return f"""
with kept as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as hugeint)) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select num, v from (select row_number() over (order by sha256('3:' || vec_id)) - 1 as num, v from kept) where num < {k}),
{", ".join(steps)}
select a.vec_id, cast(a.num as integer) as cluster, cast(a.d as bigint) as distance, cast(sum(a.d) over (partition by a.num) as bigint) as cluster_inertia, cast(sum(a.d) over () as bigint) as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c on c.num = a.num
"""


OP12_SQL = _op12_sql()
