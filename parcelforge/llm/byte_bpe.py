"""Byte-level BPE: exact merges by backtracking over the longest matches, and decoding.

A sequence of tokens is the merge result of its bytes exactly if every two neighbours
are the merge result of their own bytes. So a piece of text is encoded left to right:
take the longest token that starts here and may follow the last one; where none leads
on, drop the last token and try its next shorter prefix. A position from which no
token leads to the end is marked and never tried again, so the work is linear in the
length of the piece. Which prefix of a token may follow another one is remembered.

Defined results: null text encodes as empty text (no ids); very long pieces need memory
in proportion to their length; repeated rows are encoded each for itself; other columns
of the input, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.llm.common import bounded_batches, table

#: Pieces in a generation (a worker remembers two) and pairs of tokens that a worker remembers; what is forgotten costs time but no result.
CACHE_ENTRIES = 100_000
#: The same where a worker remembers from task to task.
KEPT_ENTRIES = 400_000
PAIR_ENTRIES = 400_000


def merge_plainly(ids: dict[str, int], text: str) -> list[int]:
    """The merge rule itself: join the neighbours of least rank, leftmost first."""
    parts = list(text)
    while len(parts) > 1:
        ranks = [ids.get(parts[i] + parts[i + 1]) for i in range(len(parts) - 1)]
        known = [r for r in ranks if r is not None]
        if not known:
            break
        at = ranks.index(min(known))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ids[p] for p in parts]


class Codec:
    """Encoder and decoder for one table of ranks. Texts are held as Latin-1 of their UTF-8 bytes."""

    def __init__(self, ranks: bytes, pattern: str):
        table_ = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.ids = {token.decode("latin-1"): i for token, i in table_.items()}
        self.raw = {i: token for token, i in table_.items()}
        self.size = {i: len(token) for token, i in table_.items()}
        self.packed = {i: pack("<I", i) for i in self.raw}
        #: tokens by id as one Arrow column, empty where no token has the id
        self.column = pa.array([self.raw.get(i, b"") for i in range(max(self.raw, default=-1) + 1)], pa.large_binary())
        self.widest = max(map(len, table_), default=1)
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.automaton.add_word(token, i)
        self.automaton.make_automaton()
        #: the longest token at every node of the automaton's tree
        self.node: dict[str, int | None] = {}
        for token in self.ids:
            for n in range(1, len(token) + 1):
                if (prefix := token[:n]) not in self.node:
                    own = self.ids.get(prefix)
                    self.node[prefix] = self.node.get(prefix[:-1]) if own is None else own
        self.shorter: dict[int, int | None] = {i: self.node.get(token[:-1]) for token, i in self.ids.items()}
        #: both parts of every token's last merge (none for one byte), and the token that two parts make; both empty where the ranks aren't in the order of merges
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self._split_tokens()
        self.pattern = regex.compile(pattern)
        #: 1 + id, one object for each token however often it is remembered
        self.plus = {i: i + 1 for i in self.size}
        #: what ``_follow`` gave, by both tokens in one number: pairs would take more than twice the memory
        self.shift = max(self.size, default=0).bit_length()
        self.first: dict[int, int] = {}
        self.cache = _Pieces(self)

    def _split_tokens(self) -> None:
        """Fill ``parts`` and ``joined``, by rank: the parts of a token are the two older tokens of its bytes that may stand side by side."""
        for i, token in sorted((i, token) for token, i in self.ids.items()):
            self.parts[i] = None
            left = self.shorter[i] if len(token) > 1 else None
            while left is not None:
                right = self.ids.get(token[self.size[left] :], i)
                if left < i and right < i and self._side_by_side(left, right):
                    self.parts[i], self.joined[left, right] = (left, right), i
                    break
                left = self.shorter[left]
            if len(token) > 1 and left is None:  # the merge rule never makes this token, or only of younger ones
                self.parts.clear()
                self.joined.clear()
                return

    def _side_by_side(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before the merges that made both tokens.

        From the last merge back: of the parts at the border the younger one is taken apart,
        of equal ones the right one, as the left comes first; until then both stood side by side,
        so a token that they make and that is older than what was taken apart would have come first.
        """
        joined, parts, limit = self.joined, self.parts, 1 << 62
        while True:
            if joined.get((left, right), limit) < limit:
                return False
            a, b = parts[left], parts[right]
            if a is not None and (b is None or left > right):
                limit, left = left, a[1]
            elif b is not None:
                limit, right = right + 1, b[0]
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        if self.parts:
            return self._side_by_side(left, right)
        return merge_plainly(self.ids, (self.raw[left] + self.raw[right]).decode("latin-1")) == [left, right]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one match of the pattern, given as Latin-1 of its bytes."""
        if (whole := self.ids.get(piece)) is not None:
            return [whole]
        end, size, first, shift = len(piece), self.size, self.first, self.shift
        out: list[int] = []
        last = -1
        dead = bytearray(end + 1)
        at, token = 0, self._longest(piece, 0)
        while True:
            # the longest token of the chain that may follow the last one and isn't known to lead nowhere
            found = first.get(last << shift | token) or self._follow(last, token)
            while found > 0 and dead[at + size[found - 1]]:
                less = self.shorter[found - 1]
                found = 0 if less is None else first.get(last << shift | less) or self._follow(last, less)
            if found > 0:
                last = found - 1
                out.append(last)
                at += size[last]
                if at == end:
                    return out
                token = self._longest(piece, at)
                continue
            less = None
            while less is None:  # nothing leads on from here
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                less = self.shorter[token]
            last, token = out[-1] if out else -1, less

    def _follow(self, last: int, token: int) -> int:
        """1 + the longest prefix of ``token``, itself included, that may follow ``last``; -1: none. Remembered for every prefix tried."""
        first, high = self.first, last << self.shift
        if len(first) >= PAIR_ENTRIES:
            first.clear()
        tried, i, found = [], token, 0
        while not found:
            tried.append(i)
            if last < 0 or self.compatible(last, i):
                found = self.plus[i]
            elif (less := self.shorter[i]) is None:
                found = -1
            else:
                i, found = less, first.get(high | less, 0)
        for i in tried:
            first[high | i] = found
        return found

    def _longest(self, piece: str, at: int) -> int:
        """The longest token that starts at ``at``."""
        part = piece[at : at + self.widest]
        found = self.node.get(part[: self.automaton.longest_prefix(part)])
        if found is None:
            raise ValueError("the ranks lack a byte of this text")
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.cache.__getitem__, self.pattern.findall(text)))

    def forget(self) -> None:
        """Empty what is remembered; the tables of the ranks stay."""
        self.first.clear()
        self.cache.clear()
        self.cache.older.clear()

    def decode(self, ids: bytes) -> bytes:
        tokens = self.column.take(pa.array(np.frombuffer(ids, "<u4")))
        _, ends, data = tokens.buffers()
        return data.to_pybytes()[: np.frombuffer(ends, np.int64)[len(tokens)]] if len(tokens) else b""


class _Pieces(dict):
    """Packed ids by piece, encoded when first asked for; what the older generation has and is asked for again moves to this one."""

    def __init__(self, owner: Codec):
        super().__init__()
        self.owner = owner
        self.most = CACHE_ENTRIES
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        got = self.older.get(piece)
        if got is None:
            raw = piece if piece.isascii() else piece.encode().decode("latin-1")
            got = b"".join(map(self.owner.packed.__getitem__, self.owner.encode_piece(raw)))
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.older = self.copy()
                self.clear()
            self[piece] = got
        return got


@lru_cache(maxsize=2)
def codec(ranks: bytes, pattern: str) -> Codec:
    """One codec a worker, however many tasks it runs."""
    return Codec(ranks, pattern)


def _map_texts(documents: DataFrame, rank_file: str, pattern: str, step: Callable[[Codec, pa.RecordBatch], pa.RecordBatch], schema: str, keep: bool = False) -> DataFrame:
    """``step`` with a codec on each batch of (doc_id, text).

    The rank file is read on the driver, tens of thousands of lines, and travels with the
    task. Workers live on: a task's end empties what its codec remembers, so that a later
    stage in the same worker gets that memory; with ``keep`` the worker's next task starts
    with it, and finds half of its new pieces there.
    """
    with open(rank_file, "rb") as f:
        ranks = f.read()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        own.cache.most = KEPT_ENTRIES if keep else CACHE_ENTRIES
        try:
            for batch in batches:
                yield step(own, batch)
        finally:
            if not keep:
                own.forget()

    bounded_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, schema)


def round_trip(documents: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text; texts stay where Spark read them: no shuffle."""

    def step(own: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, decoded = [], [], []
        for text in batch.column(1):
            ids = own.encode(text.as_py() or "")
            counts.append(len(ids) // 4)
            digests.append(hashlib.sha256(ids).hexdigest())
            decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _map_texts(documents, rank_file, pattern, step, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", keep=True)


def encode_documents(documents: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids themselves, as an array."""

    def step(own: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.frombuffer(own.encode(t.as_py() or ""), "<u4").astype("int32") for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _map_texts(documents, rank_file, pattern, step, "doc_id long, ids array<int>")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
