"""The prefix trie against plain dictionaries."""

import hashlib
import random
import zlib

import pytest

from quillspark.llm import prefix_trie


def ordered(rows):
    """{conv: [(role, text)]} with turns in order, null first."""
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            out.setdefault(c, []).append(((turn is not None, turn or 0, digest), role, text))
    return {c: [x[1:] for x in sorted(v)] for c, v in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    below = {}
    for p in sorted(nodes, key=len, reverse=True):
        mine = (len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        under = [below[k] for k in kids.get(p, [])]
        below[p] = (sum(x for x, _ in under) or 1, mine + sum(x for _, x in under))
    out = set()
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(convs[c]) == len(p)))
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, [])), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn int, role string, text string, records int, block string"


def result(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def conversations(seed):
    rng = random.Random(seed)
    pool = [(rng.choice(["user", "assistant", None, ""]), "".join(rng.choice("aé\n,") for _ in range(rng.randrange(5)))) for _ in range(4)]
    rows = []
    for c in range(160):
        depth = rng.choice([1, 2, 3, 5, 9])
        rows += [(c * 3, t, *rng.choice(pool[: 1 + t % 4])) for t in range(depth)]
    # a third of all conversations are copies of one, and one is long
    rows += [(1000 + c, t, "user", f"copy {t}") for c in range(90) for t in range(4)]
    rows += [(2000 + c, t, "user", f"copy {t}" if t < 300 else str(c)) for c in range(3) for t in range(310)]
    rows += [(-7, t, "user", "copy 0") for t in range(2)] + [(None, 0, "user", "no id"), (5001, None, "user", None), (5001, 0, None, "x"), (5001, 0, None, "x"), (5002, 1, "user", "later")]
    return [(*r, 1, "b") for r in rows]


@pytest.mark.parametrize("blocks,seed", [(1, 1), (3, 2), (17, 3), (60, 4)])
def test_matches_dictionaries(spark, frame, blocks, seed):
    rows = conversations(seed)
    df = frame(rows, SCHEMA)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", blocks)
    try:
        convs = ordered([r[:4] for r in rows])
        assert result(prefix_trie.prefix_trie(df)) == brute(convs)
        assert result(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(df)))) == brute(rebuilt(convs))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_packed_ids_of_a_large_group(spark, frame, monkeypatch):
    """Ids of copies come in many pieces over many blocks, in numerical order."""
    monkeypatch.setattr(prefix_trie, "PIECE", 64)
    rows = [(c, 0, "user", "same", 0, "") for c in range(-20, 200)]
    assert result(prefix_trie.prefix_trie(frame(rows, SCHEMA))) == brute(ordered([r[:4] for r in rows]))


def test_turnless_and_empty(frame):
    assert prefix_trie.prefix_trie(frame([], SCHEMA)).count() == 0
    assert prefix_trie.prefix_trie(frame([(None, 0, "user", "x", 0, "")], SCHEMA)).count() == 0
    # 3 takes its head from 0, which is absent, and has no turn beyond it
    rows = [(c, 0, "user", "x", 0, "") for c in range(1, 60) if c % 5]
    convs = rebuilt(ordered([r[:4] for r in rows]))
    assert any(not t for t in convs.values())
    assert result(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(frame(rows, SCHEMA))))) == brute(convs)


def test_common_prefixes():
    import numpy as np

    seqs = [b"", b"a" * 20, b"a" * 20 + b"b" * 40, b"a" * 20 + b"b" * 20 + b"c" * 20, b"a" * 20 + b"b" * 20 + b"c" * 20, b"d" * 20]
    words, sizes = prefix_trie._decode(seqs)
    assert prefix_trie.common_prefixes(words, sizes).tolist() == [0, 0, 1, 2, 3, 0]
    assert prefix_trie.common_prefixes(words[:0], np.zeros(1, np.int64)).tolist() == [0]
