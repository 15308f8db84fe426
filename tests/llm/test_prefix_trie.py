import hashlib
import zlib

import pytest

from parcelforge.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string"


def content(role, text):
    return bytes.fromhex(hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest())


def ordered(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, content(role or "", text or ""), role or "", text or ""))
    return {c: [x[3:] for x in sorted(t)] for c, t in convs.items()}


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        source = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = convs.get(source, [])[:h] + own[h:]
    return out


def plainly(convs):
    """Every beginning as a tuple, every subtree by comparing beginnings."""
    members, ends = {(): []}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    if not convs:
        return []
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[k] for k in kids.get(node, []))
        leaves[node] = sum(leaves[k] for k in kids.get(node, [])) or 1
    out = []
    for node, who in members.items():
        ids = ",".join(map(str, sorted(ends.get(node, []))))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids.get(node, [])), leaves[node], saved[node], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(params=[1, 7])
def parts(spark, request):
    """Partitions as they are: with seven, conversations and lists of ends go on from one to the next."""
    keys = {"spark.sql.shuffle.partitions": str(request.param), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def run(spark, rows, again):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted(map(tuple, (prefix_trie.trie(*prefix_trie.rebuilt(df), ["part", "turn", "digest", "row"]) if again else prefix_trie.conversation_trie(df)).collect()), key=str)


def odd_rows():
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t} {'same' if c % 3 else c}") for c in range(20) for t in range(c % 12)]
    rows += [(c, t, "user", f"copy {t}") for c in range(100, 160) for t in range(4)]  # copies: hot nodes, a long list of ends
    rows += [(300, t, "user", f"long {t}") for t in range(150)] + [(301, t, "user", f"long {t}") for t in range(90)]  # a third of all rows in one
    rows += [(41, None, None, None), (41, None, "user", None), (41, 0, None, "ö 😀"), (41, 0, "user", ""), (41, 0, "user", "")]
    rows += [(None, 0, "user", "lost"), (-7, 0, "user", "minus"), (-5, 0, "user", "base of -7"), (-3, 1, "a", "b"), (0, 5, "user", "x" * 100_000)]
    rows += [(44, 1, "ab", "c"), (49, 1, "a", "bc")]  # not the same turn
    return rows


@pytest.mark.parametrize("again", [False, True])
def test_against_all_beginnings(spark, parts, again):
    rows = odd_rows()
    convs = ordered(rows)
    want = plainly(rebuild(convs) if again else convs)
    assert run(spark, rows, again) == want
    assert any(n == 0 for n in map(len, rebuild(convs).values()))  # some conversations lose all their turns


def test_lists_of_ends_in_pieces(spark, parts):
    rows = [(2, 5, 7, c) for c in range(900)] + [(d, 0, 0, d) for d in range(20)] + [(2, 5, 8, 10**15)]
    df = spark.createDataFrame(rows, "depth long, k0 long, k1 long, conv_id long")
    lists = {}
    for *key, c in rows:
        lists.setdefault(tuple(key), []).append(c)
    want = sorted((*k, hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest()) for k, v in lists.items())
    for piece in (1, 100, 1 << 18):
        assert sorted(map(tuple, prefix_trie.list_digests(df, piece).collect())) == want


def test_empty_table_and_rows_of_no_conversation(spark):
    assert run(spark, [], True) == []
    assert run(spark, [(None, 1, "user", "x")], True) == []
    assert run(spark, [(7, 1, "user", "x")], False) == plainly({7: [("user", "x")]})
