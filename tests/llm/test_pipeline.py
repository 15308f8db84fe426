import base64

import public_tokenizers as P
import pytest
import tiktoken
from test_decontaminate import plainly as plain_hits
from test_jaccard_join import plainly as plain_components
from test_secrets import plainly as plain_secrets

import corpus_pipeline
from parcelforge.llm import toxicity
from parcelforge.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        out.append((name, docs, after))
        docs = after
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_and_order(outputs, spark):
    assert [n for n, _, _ in outputs] == ["toxicity", "near_copies", "decontamination", "secrets", "tokens"]
    for _, before, after in outputs[:-1]:
        assert after.dtypes == before.dtypes
        assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}


def test_toxicity(outputs, spark):
    _, before, after = outputs[0]
    labels = table(spark, SF, "labels").filter("crc32(cast(doc_id as string)) % 5 != 0")
    model = toxicity.train(before, labels)
    rows = pairs(before)
    scores = model.score([t for _, t in rows])
    assert sorted(pairs(after)) == sorted(r for r, s in zip(rows, scores) if s < 0.5)


def test_near_copies(outputs):
    _, before, after = outputs[1]
    keep = {d for d, _, c in plain_components(pairs(before)) if c == d}
    assert sorted(pairs(after)) == sorted(r for r in pairs(before) if r[0] in keep)


def test_decontamination(outputs, spark):
    _, before, after = outputs[2]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = {r[0] for r in plain_hits(pairs(before), items) if r[5]}
    assert bad and sorted(pairs(after)) == sorted(r for r in pairs(before) if r[0] not in bad)


def test_secrets(outputs):
    _, before, after = outputs[3]
    got = dict(pairs(after))
    changed = 0
    for doc_id, text in pairs(before):
        out, at = "", 0
        for start, _, end, _ in plain_secrets(text):
            if start >= at:
                out += text[at:start] + "[secret]"
            at = max(at, end)
        assert got[doc_id] == out + text[at:]
        changed += at > 0
    assert changed
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_tokens(outputs):
    _, before, after = outputs[4]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r.doc_id: r.ids for r in after.collect()} == {d: theirs.encode_ordinary(t) for d, t in pairs(before)}


def test_empty(spark, tmp_path):
    import shutil

    for name in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    table(spark, SF, "documents").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
