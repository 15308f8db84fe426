"""N-gram Jaccard join: rare-first prefix filtering, then every candidate verified once.

Texts with the same shingle set are one node, so exact copies never form pairs. Work:

1. one pass gives each text's node and set size, and counts shingles in a fixed table of
   2**22 cells (a count sketch over all texts); the global order of shingles is
   (level of the cell's count, key), rare first: a level is a byte, exact below 128;
2. a second pass gives each set's prefix in that order: a set of n shingles shares with any
   partner a shingle among its first n - ceil(3n/4) + 1;
3. prefixes meet on the shingle. Shingles of one node only drop out. In every other bucket,
   the pivot (the member with the fewest rarer shingles) is paired with all others: a number
   of pairs in proportion to the bucket, whatever its size. A shingle that alone may fill a
   quarter of a shuffle partition, by the count table, is dealt over all partitions, each part
   with a pivot of its own, so no task gets all its rows. Pairs pass the length filter and
   the positional filter, must share as much of their prefixes as similar sets do, and are
   made distinct;
4. the pairs are verified: the suffix filter compares counts by key range, then the sets are
   intersected;
5. links give components; buckets whose members are all in one component are done, and in
   the others the next pivot, one for the whole bucket, is paired with the members of other
   components only, for ``pivot_rounds`` rounds. Of two similar sets at least one has the
   shared shingle among its first seventh (see ``_leads``), so pivots are taken from such
   members only, and a bucket without any is done;
6. what is left after that is joined: leading members with all members of other components,
   on shingle and size band. Nothing is capped.

So no link between components is lost, and pairs inside a component that is already known
are not formed. Set keys and shingle keys have 64 bits.

Defined results: null, empty and blank texts have no shingles and link with nothing; rows
with equal text are one node whatever their ids, null ids included; a null id never is a
component's name, but links like any other row and gets its component's least id; if none
in its component has an id, its component is null; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelforge.graph.components import connected_components
from parcelforge.llm.common import BROADCAST_BYTES, bounded_batches, by_size, map_arrow, table, without
from parcelforge.llm.shingles import set_key, shingle_keys
from parcelforge.session import materialize

CELLS = 1 << 22
_BLOCK = 1 << 14
#: A shingle is dealt where its cell counts this many sets or more, and HOT_SHARE of the prefix rows of a mean shuffle partition.
HOT_SETS, HOT_SHARE = 1024, 0.25
HOT_LEVEL = 255


def _sets(documents: DataFrame, size: int) -> DataFrame:
    """(doc_id, node, n) of each text and, with null n, (block, cells) of each task's shingle counts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "node", "n", "block", "cells"]
        total = np.zeros(CELLS, np.uint32)
        for batch in batches:
            nodes, sizes, seen = [], [], []
            for text in batch.column(1).to_pylist():
                keys = shingle_keys(text, size)
                nodes.append(set_key(keys))
                sizes.append(len(keys))
                seen.append(keys)
            every = np.concatenate(seen) if seen else np.zeros(0, np.uint64)
            np.add.at(total, (every & np.uint64(CELLS - 1)).astype(np.int64), np.uint32(1))  # in place: a bincount would be a second and third table
            rows = len(nodes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        blocks = [k for k in range(CELLS // _BLOCK) if total[k * _BLOCK : (k + 1) * _BLOCK].any()]
        data = [zlib.compress(total[k * _BLOCK : (k + 1) * _BLOCK].tobytes(), 1) for k in blocks]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(blocks), pa.int64()), pa.nulls(len(blocks), pa.int64()), pa.nulls(len(blocks), pa.int64()), pa.array(blocks, pa.int32()), pa.array(data, pa.binary())], names)

    return documents.mapInArrow(each, "doc_id long, node long, n long, block int, cells binary")


def _levels(counts: np.ndarray, hot: float) -> np.ndarray:
    """A byte for each count that rises with it: counts below 128 as they are, larger ones by eighths of an octave, HOT_LEVEL from ``hot`` on."""
    steps = np.where(counts < 128, counts, 128 + np.floor(8 * np.log2(np.maximum(counts, 128) / 128)))
    return np.where(counts >= hot, HOT_LEVEL, np.minimum(steps, HOT_LEVEL - 1)).astype(np.uint8)


def _sketch(sets: DataFrame, parts: int) -> np.ndarray:
    """The table of all counts as levels: 2**22 bytes, whatever the input. A prefix is about a quarter of a set, which says from which count on a shingle is hot."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(cells), np.uint32).astype(np.uint64)
                total[block] = total[block] + own if block in total else own
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([int(v.sum()) for v in total.values()], pa.int64()), pa.array([zlib.compress(v.tobytes(), 1) for v in total.values()], pa.binary())], ["block", "total", "cells"])

    counts = materialize(sets.filter("block is not null").select("block", "cells").repartition(16, "block").mapInArrow(add, "block int, total long, cells binary"), "counts")
    hot = max(HOT_SETS, HOT_SHARE * counts.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0] / 4 / parts)

    def level(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [_levels(np.frombuffer(zlib.decompress(c), np.uint64), hot).tobytes() for c in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["block", "levels"])

    out = np.zeros(CELLS, np.uint8)
    for row in map_arrow(counts.select("block", "cells"), level, "block int, levels binary").collect():  # at most 256 rows of 16 KB
        out[row.block * _BLOCK : (row.block + 1) * _BLOCK] = np.frombuffer(row.levels, np.uint8)
    return out


def _prefixes(documents: DataFrame, size: int, sketch: np.ndarray, parts: int) -> DataFrame:
    """(shingle, salt, node, at): a task gives each set once; ``at`` packs set size and position.

    The salt deals the rows of hot shingles over ``parts`` by their node; it is 0 for others.
    """
    cells = sketch.tobytes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(cells, np.uint8)
        given: set[int] = set()
        for batch in batches:
            shingles, salts, nodes, places, lengths = [], [], [], [], []
            for text in batch.column(0).to_pylist():
                keys = shingle_keys(text, size)
                node = set_key(keys)
                if node is None or node in given:
                    continue
                given.add(node)
                n = len(keys)
                count = n - (3 * n + 3) // 4 + 1
                often = rank[(keys & np.uint64(CELLS - 1)).astype(np.int64)]
                order = np.lexsort((keys, often))[:count]
                shingles.append(keys[order].view(np.int64))
                salts.append(np.where(often[order] == HOT_LEVEL, 1 + (node >> 8) % parts, 0).astype(np.int32))
                places.append((np.int64(n) << np.int64(32)) + np.arange(count, dtype=np.int64))
                nodes.append(node)
                lengths.append(count)
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingles)), pa.array(np.concatenate(salts)), pa.array(np.repeat(np.array(nodes, np.int64), lengths)), pa.array(np.concatenate(places))], ["shingle", "salt", "node", "at"])

    return documents.select("text").mapInArrow(each, "shingle long, salt int, node long, at long")


def _plausible(at_a: Column, at_b: Column) -> Column:
    """Length filter and positional filter of two sets that share the shingle at these places.

    Of the shingles that two similar sets share, the first in the order leaves as many after
    it, itself included, in either set as the whole overlap must count. So at least one
    shingle of such a pair passes, and the pair isn't lost.
    """
    n_a, n_b = F.shiftright(at_a, 32), F.shiftright(at_b, 32)
    after = F.least(n_a - at_a.bitwiseAND(0xFFFFFFFF), n_b - at_b.bitwiseAND(0xFFFFFFFF))
    return (4 * F.least(n_a, n_b) >= 3 * F.greatest(n_a, n_b)) & (7 * after >= 3 * (n_a + n_b))


def _leads(at: Column) -> Column:
    """The shingle's place is within the first seventh of the set.

    Beyond it ``_plausible`` admits smaller partners only: with n the size and p the place,
    7(n - p) >= 3(n + m) and 7p > n give m < n. Of two members that are both beyond it each
    would have to be smaller than the other, so at least one of a similar pair leads.
    """
    return 7 * at.bitwiseAND(0xFFFFFFFF) <= F.shiftright(at, 32)


def _verify(pairs: DataFrame, documents: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a Jaccard similarity of 0.75 or more.

    Texts are fetched by the least id of their node, those without an id by shingling them.
    """
    wanted = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(reps, "node"), "candidates")
    named, nameless = wanted.agg(F.count("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    short = (named + nameless) * 8 <= BROADCAST_BYTES
    ids = wanted.select("doc_id").dropna()
    ids = F.broadcast(ids) if short else ids

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = [shingle_keys(t, size) for t in batch.column(0).to_pylist()]
        ranges = [np.minimum(np.bincount((k >> np.uint64(58)).astype(np.int64), minlength=64), 255).astype(np.uint8).tolist() for k in keys]
        return pa.RecordBatch.from_arrays([pa.array(map(set_key, keys), pa.int64()), pa.array([k.view(np.int64) for k in keys], pa.list_(pa.int64())), pa.array(ranges, pa.list_(pa.int16()))], ["node", "keys", "ranges"])

    texts = documents.join(ids, "doc_id", "left_semi").select("text")
    if nameless:
        texts = texts.union(documents.filter("doc_id is null").select("text"))
    sets = map_arrow(texts, step, "node long, keys array<long>, ranges array<smallint>")
    if nameless:  # only what pairs name goes on
        nodes = wanted.select("node")
        sets = sets.join(F.broadcast(nodes) if short else nodes, "node", "left_semi")
    sets = sets.dropDuplicates(["node"])
    first = sets.select(F.col("node").alias("a"), F.col("keys").alias("keys_a"), F.col("ranges").alias("ranges_a"))
    second = sets.select(F.col("node").alias("b"), F.col("keys").alias("keys_b"), F.col("ranges").alias("ranges_b"))
    both = pairs.join(first, "a").join(second, "b")
    total = F.size("keys_a") + F.size("keys_b")
    # suffix filter: in each range of keys no more can be shared than the poorer side has; 255 stands for any number
    most = F.aggregate(F.zip_with("ranges_a", "ranges_b", lambda x, y: F.when((x == 255) & (y == 255), 1 << 28).otherwise(F.least(x, y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    shared = F.size(F.array_intersect("keys_a", "keys_b"))
    return both.filter((7 * most >= 3 * total) & (7 * shared >= 3 * total)).select("a", "b")


def _pair(df: DataFrame) -> DataFrame:
    """Distinct (a, b), smaller node first, of rows (node, at, other, other_at) that pass the filters."""
    kept = df.filter((F.col("node") != F.col("other")) & _plausible(F.col("at"), F.col("other_at")))
    return kept.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _first_pairs(buckets: DataFrame) -> DataFrame:
    """Distinct (a, b) of pivots and members that pass the filters and share enough of their prefixes.

    Two similar sets share not one shingle but several within their prefixes: with overlap o
    the i-th shared one has o - i shared ones after it, so it lies within a prefix of length L
    of n as long as i <= L - n + o. The rows of a pair count what they share in buckets of
    which one of them is the pivot; what they may share in others is bounded by the number of
    such buckets that either is in.
    """
    rows = buckets.filter("node != other").withColumns({"n": F.shiftright("at", 32), "other_n": F.shiftright("other_at", 32)}).filter(4 * F.least("n", "other_n") >= 3 * F.greatest("n", "other_n"))
    first = F.col("node") < F.col("other")
    grouped = rows.groupBy(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).agg(
        F.count("*").alias("rows"), F.max(_plausible(F.col("at"), F.col("other_at"))).alias("fits"),
        F.max(F.when(first, F.col("n")).otherwise(F.col("other_n"))).alias("n_a"), F.max(F.when(first, F.col("other_n")).otherwise(F.col("n"))).alias("n_b")).filter("fits")
    hidden = buckets.filter("members > 2 or salt > 0").groupBy("node").agg(F.count("*").alias("hidden"))
    both = grouped.join(hidden.select(F.col("node").alias("a"), F.col("hidden").alias("h_a")), "a", "left").join(hidden.select(F.col("node").alias("b"), F.col("hidden").alias("h_b")), "b", "left")
    ceil = lambda x, y: F.floor((x + (y - 1)) / y)
    within = F.least(1 - ceil(3 * F.col("n_a"), 4), 1 - ceil(3 * F.col("n_b"), 4)) + ceil(3 * (F.col("n_a") + F.col("n_b")), 7)
    shared = F.col("rows") + F.least(F.coalesce("h_a", F.lit(0)), F.coalesce("h_b", F.lit(0)))
    return both.filter(shared >= within).select("a", "b")


def _pairs_left(buckets: DataFrame) -> DataFrame:
    """Distinct (a, b) of all leading members with all members of other components, by shingle and size band.

    A band is as wide as the length filter allows, so partners are in the same or the next
    band either way.
    """
    band = F.floor(F.log(F.shiftright("at", 32).cast("double")) / F.log(F.lit(4 / 3)) + 1e-9).cast("int")
    rows = buckets.withColumn("band", band)
    leading = rows.filter(_leads(F.col("at"))).withColumn("band", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])))
    leading = leading.select("shingle", "band", F.col("node").alias("other"), F.col("at").alias("other_at"), F.col("comp").alias("other_comp"))
    return _pair(rows.join(leading, ["shingle", "band"]).filter(F.col("comp") != F.col("other_comp")))


def jaccard_components(documents: DataFrame, size: int = 5, pivot_rounds: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document, at similarity 0.75 of ``size``-word shingles."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounded_batches(spark)
    written = materialize(_sets(docs, size), "sets")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sketch = _sketch(written, parts)
    sets = written.filter("n is not null").select("doc_id", "node", "n")
    reps = sets.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    key = ["shingle", "salt"]
    dealt = _prefixes(docs, size, sketch, parts).repartition(parts, *key)
    # the test on ``at`` is always true: with it both uses of ``dealt`` need all its columns, and so share one exchange
    shared = dealt.groupBy(*key).agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("members"), F.min("at").alias("least")).filter("(lo != hi or salt > 0) and least >= 0").select(*key, "members")
    # the rows of a part are together already, so the pivot is told to each of them without another exchange
    in_order = Window.partitionBy(*key).orderBy(F.col("at").bitwiseAND(0xFFFFFFFF), "node")
    told = dealt.join(shared.hint("shuffle_hash"), key).withColumns({"other": F.first("node").over(in_order), "other_at": F.first("at").over(in_order)})
    # a part's pivot has met all other rows only where the part is the whole bucket
    buckets = materialize(told.filter("node != other or salt > 0"), "buckets")

    comps = None
    # parts of a dealt bucket are joined with each other from the second round on only
    last = max(1, pivot_rounds) + bool((sketch == HOT_LEVEL).any())
    for turn in range(last + 1):
        if turn == 0:
            pairs = _first_pairs(buckets)
        elif turn < last:
            place = F.struct(F.col("at").bitwiseAND(0xFFFFFFFF).alias("place"), "node", "at", "comp")
            # one row a bucket, from partial minima; while these are few the buckets' rows stay where they are
            pivots = materialize(buckets.groupBy("shingle").agg(F.min(F.when(_leads(F.col("at")), place)).alias("p")).select("shingle", F.col("p.node").alias("other"), F.col("p.at").alias("other_at"), F.col("p.comp").alias("other_comp")), "pivots")
            pivots = by_size(pivots, 32)
            pairs = _pair(buckets.join(pivots, "shingle").filter(F.col("comp") != F.col("other_comp")))
        else:
            pairs = _pairs_left(buckets)
        pairs = materialize(pairs, "pairs")
        links = materialize(_verify(pairs, docs, reps, size), "links")
        if comps is None:
            comps = materialize(connected_components(links), "comps")
        elif not links.isEmpty():  # the components so far, each a star, and what now ties them
            comps = materialize(connected_components(links.unionByName(comps.select(F.col("id").alias("a"), F.col("component").alias("b")))), "comps")
        if turn == last:
            break
        # go on with the members that are not yet compared with all others of their bucket
        if turn == 0:
            rest = buckets.filter("members > 2 or salt > 0").select("shingle", "node", "at").distinct()
        else:
            rest = buckets.join(pivots.select("shingle", "other"), "shingle").filter("node != other").select("shingle", "node", "at")
        rest = rest.join(comps.select(F.col("id").alias("node"), "component"), "node", "left").select("shingle", "node", "at", F.coalesce("component", "node").alias("comp"))
        open_ = materialize(rest.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(_leads(F.col("at"))).alias("leads")).filter("lo != hi and leads").select("shingle"), "open")
        buckets = materialize(rest.join(by_size(open_), "shingle"), "buckets")
        if buckets.isEmpty():
            break

    named = comps.select(F.col("id").alias("node"), "component").join(reps, "node")
    names = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = named.join(names, "component").select("node", "component_id")
    own = reps.select("node", F.col("doc_id").alias("rep")).join(linked, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    return sets.join(own, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(documents: DataFrame, size: int = 5) -> DataFrame:
    """The documents, of each component only the one with the smallest id.

    A document is its id: rows that share an id stay or go together, and rows without an
    id stay. All columns stay as they are.
    """
    found = jaccard_components(documents, size)
    return without(documents, found.filter("component_id != doc_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


#: The same rows from all pairs that share a shingle.
OP10_SQL = r"""
with recursive dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
du as (select doc_id, w, least(5, len(w)) as n, unnest(range(1, len(w) - least(5, len(w)) + 2)) as i from dw where len(w) > 0),
sh as (select distinct doc_id, array_to_string(w[i:i+n-1], ' ') as s from du),
size as (select doc_id, count(*) as n from sh group by 1),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as o from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join size x on x.doc_id = a join size y on y.doc_id = b where 100 * o >= 75 * (x.n + y.n - o)),
both_ways as (select a, b from links union select b, a from links),
reach as (select a as n, a as m from both_ways union select r.n, e.b from reach r join both_ways e on r.m = e.a)
select dw.doc_id, cast(coalesce(size.n, 0) as bigint) as n_shingles, coalesce(c.m, dw.doc_id) as component_id
from dw left join size on size.doc_id = dw.doc_id left join (select n, min(m) as m from reach group by 1) c on c.n = dw.doc_id
"""
