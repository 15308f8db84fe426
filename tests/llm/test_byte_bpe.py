import base64
import hashlib
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelforge.llm import byte_bpe
from parcelforge.llm.byte_bpe import Codec, codec, encode_documents, round_trip

RANK_FILE = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return Codec(open(RANK_FILE, "rb").read(), P.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANK_FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library_on_the_corpus(own, theirs):
    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist():
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=60))
def test_same_ids_on_any_text(own, theirs, text):
    assert np.frombuffer(own.encode(text), "<u4").tolist() == theirs.encode_ordinary(text)


def test_long_runs(own, theirs):
    for text in ("a" * 3000, " " * 2000 + "x", "ab" * 1500, "=" * 999, "é" * 700):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == theirs.encode_ordinary(text)


def test_one_long_piece_takes_linear_time(own):
    rng = np.random.default_rng(2)
    took = []
    for n in (250_000, 1_000_000):
        piece = bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
        began = time.process_time()
        ids = own.encode_piece(piece)
        took.append(time.process_time() - began)
        assert own.decode(np.array(ids, "<u4").tobytes()) == piece.encode()
    assert took[1] < 8 * took[0] + 1 and took[1] < 20, took


def test_rows(spark, theirs):
    rows = [(1, "Hello wörld", "x"), (2, None, "x"), (3, "", None), (1, "Hello wörld", "y"), (None, "z", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in round_trip(docs, RANK_FILE, P.PATTERN).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    n = len(theirs.encode_ordinary("Hello wörld"))
    assert got == {(1, n, sha("Hello wörld".encode())), (2, 0, sha(b"")), (3, 0, sha(b"")), (None, 1, sha(b"z"))}
    assert round_trip(docs, RANK_FILE, P.PATTERN).count() == 5
    assert round_trip(docs.limit(0), RANK_FILE, P.PATTERN).count() == 0
    assert encode_documents(docs.limit(1), RANK_FILE, P.PATTERN).first().ids == theirs.encode_ordinary("Hello wörld")


def test_memory_of_many_pairs():
    own = Codec(open(RANK_FILE, "rb").read(), P.PATTERN)
    tracemalloc.start()
    for left in range(300, 400):
        for right in range(700, 900):
            own._follow(left, right)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(own.first) >= 20_000 and most < 150 * 20_000, most


def test_forgotten_pieces(theirs, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 10)
    own = Codec(open(RANK_FILE, "rb").read(), P.PATTERN)
    for text in [f"q{k % 25:x}w" for k in range(100)] + ["q0w", "q0w"]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == theirs.encode_ordinary(text)
    assert len(own.cache) <= 10 and len(own.cache.older) <= 10


def test_a_task_leaves_nothing_remembered(spark, theirs):
    class Documents:
        sparkSession = spark
        select = lambda self, *columns: self
        mapInArrow = lambda self, each, schema: each

    texts = ["Hello wörld", "qwfpgj zxcvbkm", None]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(texts)], ["doc_id", "text"])
    (out,) = list(encode_documents(Documents(), RANK_FILE, P.PATTERN)(iter([batch])))
    assert out.column(1).to_pylist() == [theirs.encode_ordinary(t or "") for t in texts]
    own = codec(open(RANK_FILE, "rb").read(), P.PATTERN)
    assert not own.cache and not own.first


def test_pairs_by_parts_are_those_of_the_merge_rule(own):
    rng = np.random.default_rng(5)
    assert len(own.parts) == len(own.ids) and len(own.joined) == len(own.ids) - 256
    for high in (300, 3000, len(own.ids)):
        for left, right in rng.integers(0, high, (4000, 2)).tolist():
            assert own.compatible(left, right) == (byte_bpe.merge_plainly(own.ids, (own.raw[left] + own.raw[right]).decode("latin-1")) == [left, right])


def test_ranks_out_of_the_order_of_merges():
    # "abc" is older than "ab", which it is made of
    lines = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"ca": 258, b"xyzw": 259}
    own = Codec(b"\n".join(base64.b64encode(k) + b" " + str(v).encode() for k, v in lines.items()), P.PATTERN)
    ids = {k.decode("latin-1"): v for k, v in lines.items()}
    assert not own.parts
    for left in ids.values():
        for right in (97, 98, 99, 256, 257, 258, 259):
            assert own.compatible(left, right) == (byte_bpe.merge_plainly(ids, (own.raw[left] + own.raw[right]).decode("latin-1")) == [left, right])


def test_the_next_task_of_a_round_trip_starts_with_what_was_encoded(spark, monkeypatch):
    class Documents:
        sparkSession = spark
        select = lambda self, *columns: self
        mapInArrow = lambda self, each, schema: each

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["qwfpgj zxcvbkm"])], ["doc_id", "text"])
    codec(open(RANK_FILE, "rb").read(), P.PATTERN).forget()
    made, plain = [], Codec.encode_piece
    monkeypatch.setattr(Codec, "encode_piece", lambda self, piece: made.append(piece) or plain(self, piece))
    task = round_trip(Documents(), RANK_FILE, P.PATTERN)
    first, again = list(task(iter([batch]))), list(task(iter([batch])))
    assert first == again and made == ["qwfpgj", " zxcvbkm"]
    list(encode_documents(Documents(), RANK_FILE, P.PATTERN)(iter([batch])))
    own = codec(open(RANK_FILE, "rb").read(), P.PATTERN)
    assert not own.cache and not own.cache.older and not own.first
