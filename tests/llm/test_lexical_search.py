"""Block-Max WAND against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import lexical_search as ls

from .conftest import prose


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    bags = [(d, Counter(words(t))) for d, t in docs if d is not None and words(t)]
    n, total = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        asked = Counter(words(text))
        scores = []
        for d, c in bags:
            m = 25 + (75 * sum(c.values()) * n) // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scores.append((-s, d))
        out += [(item, i, d, -s) for i, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def corpus(rng, n):
    rows = [(i * 7 % 1009 + 2000 * (i // 1009), prose(rng, rng.choice([1, 5, 30, 200]))) for i in range(n)]
    rows += [(50_000 + i, "same text of all copies, Ünïcode 42") for i in range(40)] + [(5, "repeated id"), (5, "repeated id"), (None, "no id here"), (90_000, None), (90_001, ""), (90_002, " .,!")]
    rows += [(90_003, "often " * 70_000 + prose(rng, 3000)), (90_004, "x" * 300_000), (-3, rows[3][1])]
    return rows


def items(rng, rows):
    some = [(i, " ".join((rows[rng.randrange(300)][1] or "x").split()[:12])) for i in range(25)]
    return some + [(100, None), (101, ""), (102, "unknownword"), (103, "SAME text, same TEXT"), (103, "a second text of one id: ünïcode"), (104, "often often x"), (None, "repeated"), (105, "42-42_42")] + some[:2]


@pytest.mark.parametrize("segment,priming,block", [(1 << 15, 1000, 200_000), (40, 4, 200_000), (23, 2, 60)])
def test_matches_all_scores(frame, rng, monkeypatch, segment, priming, block):
    monkeypatch.setattr(ls, "SEGMENT_DOCS", segment)
    monkeypatch.setattr(ls, "PRIMING", priming)
    monkeypatch.setattr(ls, "MAX_TERMS", block)
    rows = corpus(rng, 600)
    asked = items(rng, rows)
    index = ls.build(frame([(*r, 1) for r in rows], "doc_id long, text string, score int"))
    got = ls.search(index, frame([(*r, "b") for r in asked], "item_id int, text string, rank string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, asked)


def test_added_segments_and_text_ids(spark, frame, rng, tmp_path):
    rows, path = corpus(rng, 200), f"file://{tmp_path}/index"
    ls.build(frame(rows[:90], "doc_id long, text string"), path)
    index = ls.build(frame(rows[90:], "doc_id long, text string"), path, "append")
    asked = [(f"q-{i}", t) for i, t in items(rng, rows[:90] + rows) if i is not None]
    got = ls.search(index, frame(asked, "name string, body string"), 3, "name", "body").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, asked, 3)


def test_empty_tables(frame):
    none = frame([], "doc_id long, text string")
    some = frame([(1, "a b")], "doc_id long, text string")
    asked, nobody = frame([(1, "a")], "item_id long, text string"), frame([], "item_id long, text string")
    assert ls.search(ls.build(none), asked).count() == 0
    assert ls.search(ls.build(some), nobody).count() == 0
    assert [r.doc_id for r in ls.search(ls.build(some), asked).collect()] == [1]


def segment_of(n_docs, vocabulary, seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=rng.randrange(1, 60))) for _ in range(n_docs)]
    found = [ls.terms(t) for t in texts]
    corpus = ls.Corpus(n_docs, sum(int(c.sum()) for _, c in found))
    return texts, found, corpus, ls.segment(list(range(n_docs)), found)


def test_round_trip_of_postings():
    texts, found, corpus, row = segment_of(3000, [f"w{i}" for i in range(400)], 5)
    wanted = np.unique(np.concatenate([h for h, _ in found]))
    seg = ls.Segment(row, wanted, corpus)
    for i, h in enumerate(wanted.tolist()):
        x, docs, impacts = seg.lists[i], [], []
        for b in range(len(x.last)):
            d, s = x.block(b)
            assert len(d) <= ls.BLOCK and d[0] == x.first[b] and d[-1] == x.last[b] and s.max() == x.most[b]
            docs += d.tolist()
            impacts += s.tolist()
        truth = [(d, int(c[np.searchsorted(t, np.uint64(h))])) for d, (t, c) in enumerate(found) if h in t]
        assert docs == [d for d, _ in truth]
        assert impacts == ls.impact(np.array([c for _, c in truth]), seg.m[docs]).tolist()


def test_blocks_below_the_threshold_stay_compressed():
    """Rare terms decide: most blocks of frequent terms are never decompressed, and results don't change."""
    texts, found, corpus, row = segment_of(20_000, [f"w{i}" for i in range(3000)], 6)
    query = ["w1", "w2", "w5", "w2999"]
    wanted = np.unique(np.concatenate([ls.terms(t)[0] for t in query]))
    df = {i: sum(1 for t, _ in found if h in t) for i, h in enumerate(wanted.tolist())}
    weighed = [(i, corpus.weight(n)) for i, n in df.items() if n]
    seg, best = ls.Segment(row, wanted, corpus), ls.Best(10)
    ls.search_segment(seg, weighed, best)
    everything = brute(list(enumerate(texts)), [(0, " ".join(query))])
    assert [(d, s) for _, _, d, s in sorted(everything, key=lambda r: r[1])] == list(zip(best.docs.tolist(), best.scores.tolist()))
    total = sum(len(x.last) for x in seg.lists.values())
    assert seg.blocks_read < 0.5 * total
    primed, again = ls.Segment(row, wanted, corpus), ls.Best(10, int(best.scores[-1]))
    ls.search_segment(primed, weighed, again)
    assert again.docs.tolist() == best.docs.tolist() and primed.blocks_read <= seg.blocks_read


def test_lengths_beyond_64_bits():
    big = ls.Corpus(10**12, 10**15)
    assert big.m(np.array([10**7])).tolist() == [25 + 75 * 10**7 * 10**12 // 10**15]
