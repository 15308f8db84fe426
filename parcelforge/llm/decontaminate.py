"""Benchmark decontamination: a prefix-filtered join of item-sized windows against documents.

An item's windows are its runs of ``size`` words (an item with fewer words is one window).
A window is contained in a document exactly where all its shingles occur in place, so any
one of them is a necessary prefix; the join uses its rarest. Order of work:

1. the shingles of all windows get ids; one pass over all documents counts in how many
   documents each occurs (rarity), summed per task before the shuffle;
2. each distinct window is indexed under its rarest shingle and that shingle's offset;
3. a second pass looks the documents' shingles up in that index (prefix join), drops
   candidates whose window would begin before or end after the document (length and
   positional bound), and compares all words of the remaining ones (exact verification).

Documents never move: no shuffle of texts and so no hot document or hot passage. Windows are
cut from the items on the cluster, made distinct and written; only they travel, in blocks of
about ``block_windows`` rows (window, item), some 200 bytes each, dealt by hash so that
neither a long item nor a window of many items makes a block larger. The driver holds one
block at a time. With more than one block, each gives the hits of the documents it hits; they
are put together by key (id and text) at the end.

Defined results: null or empty texts have no words, no hits and digest of the empty string;
null or empty items have no windows; repeated items count one by one under their ids, and
items with equal id are one item; null item ids are left out; repeated documents are judged
each for itself; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.llm.common import bounded_batches, map_arrow, table, without
from parcelforge.llm.spans import row_key
from parcelforge.session import materialize

#: Bytes of words as they are, A-Z lowered, all else a blank.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SHINGLE = 3
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


@dataclass
class Windows:
    """Distinct windows of one length, their shingles and items."""

    length: int
    width: int
    ids: np.ndarray  # (windows, length) word ids
    items: list[list[str]]
    vocabulary: dict[bytes, int]
    shingles: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted keys of all shingles
    rarity: np.ndarray | None = None

    def keys(self, ids: np.ndarray) -> np.ndarray:
        """A key for each run of ``width`` word ids along the last axis."""
        n = ids.shape[-1] - self.width + 1
        out = np.zeros((*ids.shape[:-1], max(n, 0)), np.uint64)
        for k in range(self.width):
            out = (out + ids[..., k : n + k].astype(np.uint64) + np.uint64(1)) * _MIX
        return out

    def word_ids(self, text_words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in text_words), np.int64, len(text_words))

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in a document whose shingle is one of the benchmark's, and which one."""
        keys = self.keys(ids)
        known = ids >= 0
        whole = np.ones(len(keys), bool)
        for k in range(self.width):
            whole &= known[k : len(keys) + k]
        at = np.flatnonzero(whole)
        if not len(at):
            return at, at
        found = np.minimum(np.searchsorted(self.shingles, keys[at]), len(self.shingles) - 1)
        hit = self.shingles[found] == keys[at]
        return at[hit], found[hit]


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Distinct (length, words, item): every window of every item, its words joined by blanks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = words(text)
                length = min(size, len(own))
                starts = range(len(own) - length + 1 if own else 0)
                for at in range(0, len(starts), 10_000):
                    part = [b" ".join(own[i : i + length]) for i in starts[at : at + 10_000]]
                    yield pa.RecordBatch.from_arrays([pa.array([length] * len(part), pa.int32()), pa.array(part, pa.binary()), pa.array([item] * len(part))], ["length", "words", "item"])

    bounded_batches(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).dropna()
    return items.mapInArrow(each, "length int, words binary, item string").distinct()


def windows_of(rows: pa.Table) -> list[Windows]:
    """The windows of one block by length."""
    vocabulary: dict[bytes, int] = {}
    groups: dict[int, dict[bytes, list[str]]] = defaultdict(lambda: defaultdict(list))
    for length, window, item in zip(*(c.to_pylist() for c in rows.columns), strict=True):
        groups[length][window].append(item)
    out = []
    for length, found in sorted(groups.items()):
        ids = np.array([[vocabulary.setdefault(w, len(vocabulary)) for w in window.split(b" ")] for window in found], np.int64)
        own = Windows(length, min(SHINGLE, length), ids, list(found.values()), vocabulary)
        own.shingles = np.unique(own.keys(own.ids))
        out.append(own)
    return out


def _prefix_index(own: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows sorted by their rarest shingle: shingle, offset and window number, and where each shingle's run begins."""
    at = np.searchsorted(own.shingles, own.keys(own.ids))
    offset = np.argmin(own.rarity[at], axis=1)
    prefix = at[np.arange(len(at)), offset]
    order = np.argsort(prefix, kind="stable")
    begins = np.searchsorted(prefix[order], np.arange(len(own.shingles) + 1))
    return prefix[order], offset[order], order, begins


def _matches(own: Windows, index: tuple, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and window number of every occurrence in one document."""
    _, offset, order, begins = index
    at, shingle = own.places(ids)
    lo, n = begins[shingle], begins[shingle + 1] - begins[shingle]
    at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
    if not len(at):
        return at, at
    entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start, window = np.repeat(at, n) - offset[entry], order[entry]
    inside = (start >= 0) & (start + own.length <= len(ids))
    start, window = start[inside], window[inside]
    same = np.ones(len(start), bool)
    for k in range(own.length):
        same &= ids[start + k] == own.ids[window, k]
    return start[same], window[same]


def _rarity(documents: DataFrame, groups: list[Windows]) -> None:
    """Count in how many documents each shingle occurs; fills ``rarity``."""
    bounds = np.cumsum([0] + [len(g.shingles) for g in groups])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = np.zeros(bounds[-1], np.int64)
        for text in batch.column(0).to_pylist():
            ids = groups[0].word_ids(words(text))
            for own, base in zip(groups, bounds, strict=False):
                total[base + np.unique(own.places(ids)[1])] += 1
        seen = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["shingle", "n"])

    counted = map_arrow(documents.select("text"), step, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    total = np.zeros(bounds[-1], np.int64)
    for row in counted.toLocalIterator():  # one row at most for each shingle of the block
        total[row.shingle] = row.n
    for k, own in enumerate(groups):
        own.rarity = total[bounds[k] : bounds[k + 1]]


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


_FOUND = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
_PART = "key string, size int, hit binary, items array<string>"


def find(documents: DataFrame, benchmark: DataFrame, size: int = 10, block_windows: int = 500_000) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items) of every document.

    ``n_hit``: words inside an occurrence of some window; ``items``: ids of the items with
    an occurring window, sorted as strings.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    windows = materialize(item_windows(benchmark, size), "windows")
    blocks = max(1, -(-windows.count() // block_windows))
    if blocks == 1:
        return _scan(docs, windows_of(windows.toArrow()))  # at most ``block_windows`` rows
    keyed = docs.select("doc_id", row_key(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"), "text")
    block = F.pmod(F.xxhash64("words", "item"), F.lit(blocks))
    parts = [materialize(_scan(keyed, windows_of(windows.filter(block == k).toArrow()), part=True), "block-hits") for k in range(blocks)]
    hits = reduce(DataFrame.union, parts).dropDuplicates(["key", "hit", "items"]).groupBy("key").agg(F.max("size").alias("size"), F.collect_list("hit").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def merged(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_hit = []
        for n, bits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            n_hit.append(int(np.unpackbits(np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in bits]), count=n).sum()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_hit, pa.int64()), batch.column(3)], ["key", "n_hit", "items"])

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(words(t)) for t in batch.column(2).to_pylist()], pa.int64())], ["doc_id", "key", "n_words"])

    every = map_arrow(keyed, counted, "doc_id long, key string, n_words long").join(map_arrow(hits, merged, "key string, n_hit long, items array<string>"), "key", "left")
    items, n_hit = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0).cast("long"))
    return every.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), items.alias("items"))


def _scan(docs: DataFrame, groups: list[Windows], part: bool = False) -> DataFrame:
    """Pass the documents through one block: the result's rows, or with ``part`` the hits of the documents that have some."""
    if groups:
        _rarity(docs, groups)
    indexes = [_prefix_index(g) for g in groups]

    def look(text: str | None) -> tuple[np.ndarray, list[str]]:
        own_words = words(text)
        hit, items = np.zeros(len(own_words) + 1, np.int64), set()
        ids = groups[0].word_ids(own_words) if groups else np.zeros(0, np.int64)
        for own, index in zip(groups, indexes, strict=True):
            start, window = _matches(own, index, ids)
            np.add.at(hit, start, 1)
            np.add.at(hit, start + own.length, -1)
            for w in set(window.tolist()):
                items.update(own.items[w])
        return np.cumsum(hit[:-1]) > 0, sorted(items)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [look(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        if part:
            some = [i for i, (covered, _) in enumerate(found) if covered.any()]
            return pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(some, pa.int32())), pa.array([len(found[i][0]) for i in some], pa.int32()), pa.array([np.packbits(found[i][0]).tobytes() for i in some], pa.binary()), pa.array([found[i][1] for i in some], pa.list_(pa.string()))],
                ["key", "size", "hit", "items"],
            )
        n_hit = [int(covered.sum()) for covered, _ in found]
        items = [names for _, names in found]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([len(covered) for covered, _ in found], pa.int64()), pa.array(n_hit, pa.int64()), pa.array(map(len, items), pa.int64()),
                pa.array(map(_digest, items), pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_()), pa.array(items, pa.list_(pa.string())),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
        )

    return map_arrow(docs, step, _PART if part else _FOUND)


def keep_clean(documents: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The documents without any occurrence of a benchmark window, with all their columns; rows that share an id stay or go together."""
    return without(documents, find(documents, benchmark, size).filter("contaminated"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


#: The same rows by comparing every window of every document.
OP2_SQL = r"""
with iw as (select cast(item_id as varchar) as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null and text is not null),
iu as (select item, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from iw where len(w) > 0),
win as (select distinct item, n, array_to_string(w[i:i+n-1], ' ') as k from iu),
dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
lens as (select distinct n from win),
pos as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw cross join lens),
hits as (select p.doc_id, p.i, p.n, win.item from (select doc_id, i, n, array_to_string(w[i:i+n-1], ' ') as k from pos) p join win on p.n = win.n and p.k = win.k),
covered as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from hits) group by 1),
found as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hits) group by 1)
select dw.doc_id, cast(len(dw.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join covered on covered.doc_id = dw.doc_id left join found on found.doc_id = dw.doc_id
"""
