"""Prefix trie of conversations: which turns could be shared, and what that saves.

Every distinct beginning of a conversation is a node. A node's key is its depth and a hash
of the turns down to it that can be continued from any point (a polynomial over content
hashes in four primes' lanes, 124 bits), so no task needs a whole conversation:

1. Texts are read once and become narrow rows (content hash, bytes).
2. Rows are dealt by range of (conversation, place). Each partition hashes its slices of
   conversations from their own start; a conversation that began in an earlier partition is
   completed by what those left behind, one state for each partition.
3. Partial tries: rows combine by key inside each task (Spark's partial aggregation), and
   these node tables merge by hash of the key. A node's smallest member owns it; each
   conversation owns one stretch of its path, from some depth to its end, or nothing.
4. Bottom-up roll-up: every conversation hands the bytes and the leaf of its own stretch, and
   the bytes of its whole path, to the nodes above, combined and merged the same way. From
   these three sums follow the leaves and the saved bytes of each subtree, for tries of any
   depth in one round: no pass for each level.
5. Lists of the conversations that end at a node are sorted by range, joined piece by piece
   in the tasks that hold them, and pieces that belong together are digested as a stream.

Skew: a hot conversation is dealt over partitions by place, a hot node combines before it is
shuffled, rows of hot keys are joined where they are (``dealt_join``), and a hot list of ends
travels as pieces of PIECE bytes. The driver holds one row for each partition.

Defined results: turns come by number, null first, turns of one number by content hash;
repeated rows are turns of their own; null roles and texts are empty; rows without a conv_id
are no conversation's; conversations that have no turn left are members of the root; very
long texts count whole; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelforge.llm.common import bounded_batches, by_size, dealt_join, table
from parcelforge.session import materialize

PRIME = (1 << 31) - 1
#: One base for each lane of a key: any numbers below PRIME do.
BASES = (1_103_515_245, 1_664_525_013, 1_812_433_253, 2_067_261_119)
KEY = ["depth", "k0", "k1"]
#: Bytes of a piece of a list of ends.
PIECE = 1 << 18


def _packed(lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return lanes[0] << 31 | lanes[1], lanes[2] << 31 | lanes[3]


def _powers(n: int) -> np.ndarray:
    """(4, n): the powers 0 to n - 1 of each base."""
    out = np.ones((4, n), np.int64)
    bases, done = np.array(BASES), 1
    step = bases.copy()  # base to the power of ``done``
    while done < n:
        more = min(done, n - done)
        out[:, done : done + more] = out[:, :more] * step[:, None] % PRIME
        step = step * step % PRIME
        done *= 2
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition, sorted: place, hash and bytes of each beginning, counted from the first row of its conversation here."""
    part = TaskContext.get().partitionId()
    last, n, lanes, size = None, 0, np.zeros(4, np.int64), 0  # state of the conversation that the batch before ended in
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy()
        length = batch.column("bytes").to_numpy()
        values = np.frombuffer(b"".join(batch.column("digest").to_pylist()), "<u4").reshape(-1, 4).T.astype(np.int64) % PRIME
        rows = np.arange(len(conv))
        new = np.r_[True, conv[1:] != conv[:-1]]
        first = np.maximum.accumulate(np.where(new, rows, 0))
        goes_on = (first == 0) & (last is not None and conv[0] == last)
        powers = _powers(len(conv))
        terms = values * powers[:, rows - first] % PRIME
        if goes_on[0]:
            carried = np.array([pow(b, n, PRIME) for b in BASES], np.int64)
            terms[:, goes_on] = terms[:, goes_on] * carried[:, None] % PRIME
        add = lambda x: np.cumsum(x, axis=-1) - (np.cumsum(x, axis=-1) - x)[..., first]
        here = add(terms)
        total = add(length)
        place = rows - first + 1
        if goes_on[0]:
            here[:, goes_on] += lanes[:, None]
            total[goes_on] += size
            place[goes_on] += n
        here %= PRIME
        before = np.where(first == rows, np.where(goes_on, lanes[:, None], 0), np.roll(here, 1, axis=1))
        last, n, lanes, size = conv[-1], int(place[-1]), here[:, -1].copy(), int(total[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), part)), batch.column("conv_id"), pa.array(place), *map(pa.array, _packed(here)), *map(pa.array, _packed(before)), batch.column("bytes"), pa.array(total)], ["part", "conv_id", "depth", "k0", "k1", "p0", "p1", "bytes", "total"])


def _lanes(k0: int, k1: int) -> list[int]:
    return [k0 >> 31, k0 & PRIME, k1 >> 31, k1 & PRIME]


def _carried(slices: DataFrame) -> list[tuple]:
    """For each partition whose first conversation began before it: what to put in front of its rows."""
    ends = slices.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "depth", "k0", "k1", "total")).alias("last")).orderBy("part").collect()  # one row for each partition
    out, conv, n, lanes, size = [], None, 0, [0] * 4, 0
    for r in ends:
        on = conv is not None and r.first == conv
        if on:
            out.append((r.part, conv, n, *lanes, *[pow(b, n, PRIME) for b in BASES], size))
        own = _lanes(r.last.k0, r.last.k1)
        if on and r.last.conv_id == conv:
            own = [(a + pow(b, n, PRIME) * x) % PRIME for a, b, x in zip(lanes, BASES, own, strict=True)]
            n, size = n + r.last.depth, size + r.last.total
        else:
            n, size = r.last.depth, r.last.total
        conv, lanes = r.last.conv_id, own
    return out


def paths(turns: DataFrame, order: list[str]) -> DataFrame:
    """(conv_id, depth, k0, k1, p0, p1, bytes, total): each beginning of each conversation.

    ``turns`` are rows (conv_id, digest, bytes) with the columns of ``order`` as places in
    the conversation. p0 and p1 are the key of the beginning that is one turn shorter.
    """
    spark = turns.sparkSession
    dealt = turns.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order).select("conv_id", "digest", "bytes")
    slices = materialize(dealt.mapInArrow(_slices, "part long, conv_id long, depth long, k0 long, k1 long, p0 long, p1 long, bytes long, total long"), "trie-paths")
    names = [f"{x}{i}" for x in "cw" for i in range(4)]
    carried = spark.createDataFrame(_carried(slices), "part long, conv_id long, n long, " + ", ".join(f"{x} long" for x in names) + ", size long")
    rows = slices.join(F.broadcast(carried), ["part", "conv_id"], "left")

    def whole(a: str, b: str) -> list[Column]:
        lanes = [F.shiftright(a, 31), F.col(a).bitwiseAND(F.lit(PRIME)), F.shiftright(b, 31), F.col(b).bitwiseAND(F.lit(PRIME))]
        done = [(F.col(f"c{i}") + F.col(f"w{i}") * x) % PRIME for i, x in enumerate(lanes)]
        return [F.when(F.col("n").isNull(), F.col(c)).otherwise(F.shiftleft(done[i], 31).bitwiseOR(done[i + 1])).alias(c) for c, i in ((a, 0), (b, 2))]

    more = lambda c, by: (F.col(c) + F.coalesce(by, F.lit(0))).alias(c)
    return rows.select("conv_id", more("depth", "n"), *whole("k0", "k1"), *whole("p0", "p1"), "bytes", more("total", "size"))


def _pieces(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted (key, conv_id) rows of one partition as pieces of joined ids; a list that lies wholly inside is digested at once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        key, ids, size, piece, opened = None, [], 0, 0, True

        def close(whole: bool) -> None:
            text = ",".join(ids)
            out.append((*key, part, piece, hashlib.sha256(text.encode()).hexdigest() if whole else text, whole))

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64()] * 5 + [pa.string(), pa.bool_()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [*KEY, "part", "piece", "ids", "whole"])
            out.clear()
            return made

        for rows in batches:
            for *now, conv in zip(*(rows.column(c).to_pylist() for c in [*KEY, "conv_id"]), strict=True):
                if now != key:
                    if key is not None:
                        close(not opened and piece == 0)
                        opened = False
                    key, ids, size, piece = now, [], 0, 0
                elif size >= most:
                    close(False)
                    ids, size, piece = [], 0, piece + 1
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if out:
                yield batch()
        if key is not None:
            close(False)
            yield batch()

    return each


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of lists whose pieces come one after another."""
    key, digest = None, None
    for rows in batches:
        done = []
        for *now, ids in zip(*(rows.column(c).to_pylist() for c in [*KEY, "ids"]), strict=True):
            if now != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = now, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield _digests(done)
    if key is not None:
        yield _digests([(*key, digest.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)], [*KEY, "ends_sha256"])


def list_digests(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """(key, ends_sha256): digest of the ascending, comma-joined conv_ids of each key, in pieces of about ``piece`` bytes."""
    bounded_batches(ends.sparkSession)
    schema = "depth long, k0 long, k1 long"
    dealt = ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    pieces = materialize(dealt.mapInArrow(_pieces(piece), f"{schema}, part long, piece long, ids string, whole boolean"), "trie-ends")
    rest = pieces.filter("not whole").repartition(*KEY).sortWithinPartitions(*KEY, "part", "piece").select(*KEY, "ids")
    return pieces.filter("whole").select(*KEY, F.col("ids").alias("ends_sha256")).unionByName(rest.mapInArrow(_streamed, f"{schema}, ends_sha256 string"))


def trie(convs: DataFrame, turns: DataFrame, order: list[str]) -> DataFrame:
    """One row for each node of the trie of the conversations ``convs`` (conv_id, distinct) with these ``turns``."""
    beginnings = paths(turns, order)
    root = [F.lit(0).cast("long").alias(c) for c in [*KEY, "p0", "p1", "bytes", "total"]]
    last = beginnings.groupBy("conv_id").agg(F.max("depth").alias("depth"), *[F.max_by(c, "depth").alias(c) for c in ("k0", "k1", "total")])
    ends = materialize(convs.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in [*KEY, "total"]]), "trie-last")

    # the merged tries: members and owner of each node, then its children
    rows = beginnings.unionByName(convs.select("conv_id", *root))
    same = [F.min(c).alias(c) for c in ("p0", "p1", "bytes", "total")]
    merged = materialize(rows.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), *same), "trie-merged")
    children = merged.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p0").alias("k0"), F.col("p1").alias("k1")).agg(F.count("*").alias("n_children"))
    nodes = materialize(merged.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")

    # what each conversation owns: a stretch from ``top`` to its end
    above = F.col("total") - F.col("bytes")
    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("top"), F.min_by(above, "depth").alias("above"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    facts = ends.join(owned, "conv_id", "left").select("conv_id", F.col("depth").alias("turns"), F.col("total").alias("whole"), "top", (F.col("total") - F.col("above")).alias("own"), "leaf")
    facts = materialize(facts, "trie-facts")
    climbing = dealt_join(beginnings.select("conv_id", *KEY), facts, ["conv_id"], "turns").unionByName(facts.select("*", *root[:3]))
    below = lambda c: F.coalesce(F.sum(F.when(F.col("top") > F.col("depth"), F.col(c))), F.lit(0))
    rolled = climbing.groupBy(*KEY).agg(
        F.sum("whole").alias("members_bytes"), below("own").alias("own_below"), below("leaf").alias("leaves_below"), *[F.min_by(c, "conv_id").alias(f"owner_{c}") for c in ("whole", "leaf", "top")]
    )
    joined = nodes.join(rolled, KEY).join(list_digests(ends), KEY, "left")
    saved = (F.col("members_bytes") - F.col("n_convs") * above) - (F.col("own_below") + F.col("owner_whole") - above)
    out = joined.select(
        *KEY, "p0", "p1", F.col("owner").alias("conv_id"), "n_convs", "n_children", (F.col("leaves_below") + F.col("owner_leaf")).alias("n_leaves"), saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "owner_top",
    )
    out = materialize(out, "trie-out")

    # below the top of a stretch the parent is the owner's too; for tops it is looked up
    parents = out.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("weight"))
    tops = out.filter((F.col("depth") > 0) & (F.col("depth") == F.col("owner_top")))
    found = dealt_join(tops, parents, ["depth", "p0", "p1"], "weight")
    rest = out.filter((F.col("depth") == 0) | (F.col("depth") > F.col("owner_top"))).withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return found.select(*columns).unionByName(rest.select(*columns))


def narrow(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, bytes, row): a written row for each turn of a conversation, without its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "trie-turns")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    turns = narrow(conversations)
    return trie(turns.select("conv_id").distinct(), turns, ["turn", "digest", "row"])


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) in which the first h turns of c are those of conversation c - c % 5, h = crc32(c) % 9."""
    turns = narrow(conversations)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "digest", "row"))
    heads = materialize(turns.withColumn("place", place).filter("place <= 8"), "trie-heads")
    convs = materialize(heads.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id"), "trie-convs")
    takers = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("source"), h.alias("h"))
    given = heads.select(F.col("conv_id").alias("source"), "place", "digest", "bytes", "row")
    taken = takers.join(given, "source").filter("place <= h").select("conv_id", F.lit(0).alias("part"), F.col("place").cast("long").alias("turn"), "digest", "bytes", "row")
    replaced = materialize(heads.filter(F.col("place") <= h).select("row"), "trie-replaced")
    own = turns.join(by_size(replaced, 16), "row", "left_anti").select("conv_id", F.lit(1).alias("part"), "turn", "digest", "bytes", "row")
    return convs, taken.unionByName(own)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(table(spark, sf_dir, "conversations")), ["part", "turn", "digest", "row"])


OP11_SQL = r"""
with t as (select conv_id, coalesce(text, '') as x, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as d, turn from conversations where conv_id is not null),
p as (select conv_id, x, d, row_number() over (partition by conv_id order by turn nulls first, d) as pos from t),
h as (select conv_id, conv_id - conv_id % 5 as base, xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(conv_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), cast([0, 0, 0, 0, 0, 0, 0, 0] as bigint[])), lambda y, z: case when y & 1 = 1 then xor(y >> 1, cast(3988292384 as bigint)) else y >> 1 end)), cast(4294967295 as bigint)) % 9 as h
  from (select distinct conv_id from p)),
built as (select h.conv_id, 0 as part, pos, x, d from h join p on p.conv_id = h.base where pos <= h union all select p.conv_id, 1, pos, x, d from p join h on h.conv_id = p.conv_id where pos > h),
placed as (select conv_id, row_number() over (partition by conv_id order by part, pos) as depth, strlen(x) as b, d from built),
path as (select conv_id, depth, b, string_agg(d, '/') over (partition by conv_id order by depth) as k from placed union all select conv_id, 0, 0, '' from h),
node as (select k, depth, any_value(b) as b, case when depth > 1 then left(k, length(k) - 33) else '' end as pk, min(conv_id) as conv_id, count(*) as n from path group by k, depth),
kids as (select pk, count(*) as n from node where depth > 0 group by pk),
ends as (select k, string_agg(cast(conv_id as varchar), ',' order by conv_id) as ids from (select conv_id, max_by(k, depth) as k from path group by conv_id) group by k),
under as (select a.k, cast(sum((w.n - 1) * w.b) as bigint) as saved, cast(count(*) filter (kids.n is null) as bigint) as leaves
  from node a join node w on a.depth = 0 or w.k = a.k or starts_with(w.k, a.k || '/') left join kids on kids.pk = w.k group by a.k)
select node.conv_id, cast(node.depth as bigint) as depth, up.conv_id as parent_conv_id, node.n as n_convs, coalesce(kids.n, 0) as n_children, leaves as n_leaves, saved as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from node join under on under.k = node.k left join node up on node.depth > 0 and up.k = node.pk left join kids on kids.pk = node.k left join ends on ends.k = node.k
"""
