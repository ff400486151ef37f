"""Near-duplicate operators against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import embedding_neardup, minhash_neardup, paragraph_dedup, suffix_dedup
from quillspark.llm.common import LOWER, Forest, word_hashes
from quillspark.llm.components import components

from .conftest import edited, prose


def shingles(text, n):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def groups(corpus, n, percent):
    f, sets = Forest(), [(d, shingles(t, n)) for d, t in corpus]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                f.join(a, b)
    return {d: (len(s), f.root(d)) for d, s in sets}


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_minhash_matches_brute_force(frame, corpus, n, percent):
    df = frame([(d, t, 1, "s") for d, t in corpus], "doc_id long, text string, component_id int, set_key string")
    got = minhash_neardup.near_duplicates(df, n, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == groups(corpus, n, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(corpus)


def test_minhash_large_near_group(frame, rng):
    base = prose(rng, 90)
    rows = [(i, edited(rng, base, 1 + i % 3)) for i in range(400)] + [(1000 + i, prose(rng, 30)) for i in range(50)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_neardup.near_duplicates(frame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == groups(rows, 3, 85)


@pytest.mark.parametrize("hot", [3, 60])
def test_minhash_hot_lists(frame, rng, monkeypatch, hot):
    """A notice that stands in all documents, and a large near group: frequent coordinates come last in the order and lose no link."""
    monkeypatch.setattr(minhash_neardup, "HOT_LIST", hot)
    monkeypatch.setattr(minhash_neardup, "HOT_CELL", 16)
    notice, base = prose(rng, 60), prose(rng, 70)
    rows = [(i, f"{notice} {prose(rng, 1 + i % 40)}") for i in range(250)] + [(1000 + i, edited(rng, f"{notice} {base}", i % 4)) for i in range(150)]
    rows += [(2000 + i, rows[i][1] + " x") for i in range(0, 250, 9)]
    sigs = minhash_neardup.signatures(frame(rows, "doc_id long, text string"), 3, 24)
    assert len(minhash_neardup.hot_pairs(sigs, 24)) > 0
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_neardup.near_duplicates(frame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == groups(rows, 3, 85)


@pytest.mark.parametrize("near", [False, True])
def test_minhash_long_lists_go_over_cells(frame, rng, monkeypatch, near):
    """A list beyond one task's share, of unlike and of near members, is compared over cells, and no task gets a longer one."""
    monkeypatch.setattr(minhash_neardup, "HOT_LIST", 10_000)
    monkeypatch.setattr(minhash_neardup, "LONG_LIST", 20)
    monkeypatch.setattr(minhash_neardup, "HOT_CELL", 16)
    notice, base = prose(rng, 60), prose(rng, 70)
    rows = [(i, f"{notice} {edited(rng, base, i % 3) if near else prose(rng, 10 + i % 40)}") for i in range(120)] + [(1000 + i, prose(rng, 40)) for i in range(30)]
    rows += [(2000 + i, rows[i][1] + " x") for i in range(0, 120, 9)]
    seen, plain = [], minhash_neardup.linked
    monkeypatch.setattr(minhash_neardup, "linked", lambda members, what, *more: seen.append((what, members.count())) or plain(members, what, *more))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_neardup.near_duplicates(frame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == groups(rows, 3, 85)
    assert dict(seen)["sig"] > 20


def test_minhash_repeated_rows_and_empty(frame):
    text = "a b c d e f g"
    got = minhash_neardup.near_duplicates(frame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 1)]
    assert minhash_neardup.near_duplicates(frame([], "doc_id long, text string")).count() == 0
    kept = minhash_neardup.deduplicate(frame([(1, text, 5), (2, text, 6), (3, None, 7)], "doc_id long, text string, kept int")).collect()
    assert sorted(tuple(r) for r in kept) == [(1, text, 5), (3, None, 7)]


def test_match_threshold_misses_little():
    t = minhash_neardup.match_threshold(24, 0.85)
    assert sum(math.comb(24, i) * 0.85**i * 0.15 ** (24 - i) for i in range(t)) <= 1e-4 < sum(math.comb(24, i) * 0.85**i * 0.15 ** (24 - i) for i in range(t + 1))


def test_components(frame):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(5, 5), (None, 3), (1000, 1001), (1001, 1000)] + [(2000 + i, 2001 + i) for i in range(60)]
    f = Forest()
    for a, b in edges:
        if a is not None:
            f.join(a, b)
    nodes = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = components(frame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == {x: f.root(x) for x in nodes} and len(got) == len(nodes)
    assert components(frame([], "a long, b long")).count() == 0


def brute_vectors(rows):
    ok = {}
    for i, v, label in rows:
        if v and label is not None and i is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i] = (np.array(v, float), label)
    links, f = {i: 0 for i, _, _ in rows}, Forest()
    for a in ok:
        for b in ok:
            if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]):
                x, y = ok[a][0], ok[b][0]
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    links[a] += 1
                    links[b] += 1
                    f.join(a, b)
    return {i: (links[i], f.root(i)) for i, _, _ in rows}


def test_embeddings_match_brute_force(frame):
    g = np.random.default_rng(3)
    base = g.normal(size=(30, 16))
    rows = []
    for i in range(260):
        v = base[i % 30] + g.normal(size=16) * (0.02, 0.2, 0.4)[i % 3]
        rows.append((i, [float(np.float32(x)) for x in v], i % 4))
    rows += [(300 + i, rows[7][1], 3) for i in range(40)] + [(400, None, 1), (401, [0.0] * 16, 1), (402, [1.0, None] * 8, 1), (403, [float("nan")] * 16, 1), (404, rows[0][1], None), (405, [], 1), (406, [1.0, 2.0, 3.0], 1), (407, [1.0, 2.0, 3.0], 1), (408, [3e30, -2e30], 2), (409, [3.0, -2.0], 2)]
    got = embedding_neardup.near_duplicates(frame([(i, v, y, 0) for i, v, y in rows], "vec_id long, embedding array<float>, label int, kept int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_vectors(rows)
    assert embedding_neardup.near_duplicates(frame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_embeddings_deal_a_large_bucket_over_cells(frame):
    g = np.random.default_rng(4)
    rows = [(i, (np.ones(8) + g.normal(size=8) * 0.05).tolist(), 1) for i in range(1300)]
    got = embedding_neardup.near_duplicates(frame(rows, "vec_id long, embedding array<double>, label int")).collect()
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = ((x @ x.T >= 0.93).sum(1) - 1).tolist()
    assert [r.n_links for r in sorted(got, key=lambda r: r.vec_id)] == want


def test_cross_polytope_recall():
    g = np.random.default_rng(0)
    x, z = g.normal(size=(2, 1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    salt = np.zeros(1500, np.uint64)
    for n in (1000, 10**6, 10**8):
        tables, k = embedding_neardup.plan(n, 64, 0.93)
        a, b = embedding_neardup.bucket_keys(x, salt, tables, k), embedding_neardup.bucket_keys(y, salt, tables, k)
        assert (a[:, :, None] == b[:, None, :]).any((1, 2)).mean() > 0.998


def test_cross_polytope_strangers_stay_few():
    """However many vectors a group has, an unrelated one is met by few; measured on random vectors too."""
    for d in (8, 64, 768):
        for n in (10**3, 10**5, 10**7, 10**9):
            tables, k = embedding_neardup.plan(n, d, 0.93)
            assert embedding_neardup.strangers(n, d, k, tables) <= embedding_neardup.STRANGERS or k == 8
    g = np.random.default_rng(6)
    for n in (4000, 16_000, 64_000):
        x = embedding_neardup.units(g.normal(size=(n, 64)))
        tables, k = embedding_neardup.plan(n, 64, 0.93)
        keys = embedding_neardup.bucket_keys(x, np.zeros(n, np.uint64), tables, k)
        _, size = np.unique(keys, return_counts=True)
        assert (size.astype(float) * (size - 1)).sum() / n <= 1.5 * embedding_neardup.STRANGERS


def brute_repeats(corpus, window=100):
    seen, out = set(), {}
    for d, t in sorted(corpus):
        raw = (t or "").encode()
        cover = bytearray(len(raw))
        for s in range(len(raw) - window + 1):
            w = raw[s : s + window]
            if w in seen:
                cover[s : s + window] = b"\1" * window
            seen.add(w)
        kept = bytes(x for x, c in zip(raw, cover) if not c)
        spans = sum(1 for j in range(len(cover)) if cover[j] and (not j or not cover[j - 1]))
        out[d] = (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_dedup_matches_brute_force(frame, corpus, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    corpus = corpus + [(5000 + i, "é" * 70 + str(i % 2) * 60 + "日本" * 30) for i in range(4)]
    df = frame([(d, t, "x") for d, t in corpus], "doc_id long, text string, n_bytes string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == brute_repeats(corpus)
    assert suffix_dedup.remove_repeats(frame([], "doc_id long, text string")).count() == 0


def test_suffix_dedup_rows_without_or_with_repeated_ids(frame, rng):
    text = prose(rng, 60)
    got = suffix_dedup.remove_repeats(frame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed > 0) for r in got) == [(0, False), (1, False), (1, False), (2, True)]


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_suffix_dedup_repeated_rows_in_any_partitions(frame, corpus, parts):
    """Rows that occur twice or three times give the document's own result as often, wherever they stand."""
    rows = [r for r in corpus if r[1] is None or len(r[1]) < 2000] + [(7000, "ab" * 150 + "c"), (7001, "x" + "ab" * 80)]
    df = frame(rows + rows[::2] + rows[::4], "doc_id long, text string")
    df = df.coalesce(1) if parts == 1 else df.repartition(parts)
    want = brute_repeats(rows)
    got = [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix_dedup.remove_repeats(df).collect()]
    assert sorted(got) == sorted((d, want[d]) for d, _ in rows + rows[::2] + rows[::4])


def test_two_stage_suffix_array():
    g = np.random.default_rng(2)
    for trial in range(60):
        t = g.integers(0, int(g.integers(1, 5)), int(g.integers(1, 200))).astype(np.uint8)
        raw = t.tobytes()
        assert suffix_dedup.suffix_array(t, 400).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:]), trial


def test_paragraphs_catch_inner_passages_and_leave_the_rest(frame, rng):
    passage = prose(rng, 80)
    clean = [(i, prose(rng, 150) + "\nAll rights reserved.") for i in range(40)]
    planted = [(100 + i, f"{prose(rng, 25 + i)} {passage} {prose(rng, 30)}\nAll rights reserved.") for i in range(6)]
    rows = clean + planted + [(200, clean[0][1]), (201, None), (202, ""), (203, "the " * 5000)]
    got = {r.doc_id: r for r in paragraph_dedup.remove_repeats(frame([(*r, 1) for r in rows], "doc_id long, text string, n_removed int")).collect()}
    assert len(got) == len(rows)
    assert all(got[100 + i].n_removed > 0 and got[100 + i].source_docs == [100] for i in range(1, 6)) and got[100].n_removed == 0 and got[100].n_shared > 0
    assert all(got[i].n_removed == 0 for i in range(40)) and got[200].source_docs == [0]
    assert got[201].text is None and got[202].text == "" and got[100].text == planted[0][1]
    assert "All rights reserved." in got[103].text
    assert paragraph_dedup.remove_repeats(frame([], "doc_id long, text string")).count() == 0


def test_paragraphs_of_exact_copies_go_whole(frame, rng):
    """Copied documents of lines of any length, copied lines, and the words of passages inside other text."""
    widths, rows, want = (3, 6, 12, 20, 25, 60, 300), [], {}
    for i, w in enumerate(widths):
        text = "\n".join(prose(rng, w) for _ in range(10))
        rows += [(i, text), (100 + i, text)]
    lines = [prose(rng, n) for n in (5, 9, 15, 20, 20, 20, 20, 30)]
    rows += [(20 + i, f"{prose(rng, 40)}\n{line}\n{prose(rng, 40)}") for i, line in enumerate(lines)]
    around = [(prose(rng, 40), prose(rng, 40)) for _ in lines]
    rows += [(120 + i, f"{a}\n{line}\n{b}") for i, (line, (a, b)) in enumerate(zip(lines, around))]
    passages = [prose(rng, rng.randrange(51, 81)) for _ in range(60)]
    rows += [(300 + i, f"{prose(rng, 30)} {p} {prose(rng, 30)}") for i, p in enumerate(passages)]
    rows += [(400 + i, f"{prose(rng, 30)} {p} {prose(rng, 30)}") for i, p in enumerate(passages)]
    rows += [(500, "of it"), (501, "of it")]
    got = {r.doc_id: r for r in paragraph_dedup.remove_repeats(frame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].text == t for i, t in rows if i < 100 or 300 <= i < 400)
    assert [got[100 + i].text.split() for i in range(len(widths))] == [[]] * len(widths) and got[501].text == ""
    for i, (line, (a, b)) in enumerate(zip(lines, around)):
        kept = got[120 + i].text.split("\n")
        assert len(kept) == 2 and a.startswith(kept[0]) and b.endswith(kept[1]) and len(" ".join(kept).split()) >= 76
    gone = [(len(t.split()) - len(got[i].text.split())) / len(passages[i - 400].split()) for i, t in rows if 400 <= i < 500]
    assert sum(x >= 1 for x in gone) >= 0.98 * len(gone) and max(gone) < 1.1
    near = [(600 + i, f"{prose(rng, 30)} {' '.join(w[:k] + ['edit'] + w[k + 1:])} {prose(rng, 30)}") for i, w in enumerate(p.split() for p in passages) for k in [rng.randrange(30, 40)]]
    rows += near
    got = {r.doc_id: r.text for r in paragraph_dedup.remove_repeats(frame(rows, "doc_id long, text string")).collect()}
    left = [len(got[i].split()) for i, _ in near]
    assert all("edit" in got[i] for i, _ in near) and sum(x <= 61 for x in left) >= 0.75 * len(left)


def test_paragraphs_near_copies_of_whole_lines(frame, rng):
    line = " ".join(f"word{i}" for i in range(24))
    assert len(paragraph_dedup.Paragraphs(line).compared) >= 1
    got = paragraph_dedup.repeated_paragraphs(frame([(1, line), (2, line.upper()), (3, prose(rng, 40))], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.first_doc) for r in got} == {(1, 1), (2, 1)}


def test_paragraphs_edited_lines_against_brute_force(frame, rng):
    """Lines with a few changed words, of whole-line Jaccard 0.8 to 0.9, are removed whole, and no line below 0.8 is."""
    pairs = [(line := prose(rng, n), edited(rng, line, k)) for n, k in ((60, 1), (60, 2), (100, 2), (120, 2), (200, 4), (200, 3), (80, 6)) for _ in range(25)]
    rows = [(i, prose(rng, 20) + "\n" + a) for i, (a, _) in enumerate(pairs)] + [(1000 + i, prose(rng, 20) + "\n" + b) for i, (_, b) in enumerate(pairs)]
    got = {r.doc_id: r.text for r in paragraph_dedup.remove_repeats(frame(rows, "doc_id long, text string")).collect()}
    alike = []
    for i, (a, b) in enumerate(pairs):
        x, y = shingles(a, 5), shingles(b, 5)
        whole = "\n" not in got[1000 + i]
        if len(x & y) >= 0.8 * len(x | y):
            alike.append(whole)
        else:
            assert not whole
    assert len(alike) > 60 and sum(alike) >= 0.99 * len(alike) and len(alike) < len(pairs)


def test_paragraph_components_match_brute_force(frame, rng):
    """Lines with Jaccard 0.8 or more share a component, also over chains; short and repeated lines and repeated rows too."""
    lines = [prose(rng, n) for n in (5, 6, 8, 15, 15, 30, 60, 60, 90, 120)]
    lines += [lines[3], lines[0], lines[6]]
    for i in (5, 6, 7, 8, 9):
        x = lines[i]
        for _ in range(4):  # chains of edits
            x = edited(rng, x, 1)
            lines.append(x)
    rows = [(i, x) for i, x in enumerate(lines)]
    got = paragraph_dedup.repeated_paragraphs(frame(rows + rows[:4], "doc_id long, text string")).where("at % 2 = 1").collect()
    forest, sets = Forest(), [shingles(x, 5) for x in lines]
    linked = set()
    for i in range(len(lines)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j]):
                forest.join(j, i)
                linked |= {i, j}
    want = {i: forest.root(i) for i in linked}
    found = {r.doc_id: r.first_doc for r in got if r.doc_id in linked}
    assert sum(found.get(i) == f for i, f in want.items()) >= 0.95 * len(want)
    assert all(forest.root(r.doc_id) == forest.root(r.first_doc) for r in got)


def test_paragraph_recall_is_asserted(frame, rng):
    """Of single pairs of lines at Jaccard 0.8 to 0.85 at least 98 % meet in a band."""
    bands, rows = paragraph_dedup.tune_bands(0.8)
    mul, add = minhash_neardup.multipliers(bands * rows)
    met = n = 0
    while n < 400:
        a = prose(rng, 60)
        b = edited(rng, a, 1)
        x, y = shingles(a, 5), shingles(b, 5)
        if 0.8 <= len(x & y) / len(x | y) <= 0.85:
            n += 1
            sig = [np.array([[xxhash.xxh3_64_intdigest(b' '.join(s)) for s in sorted(z)]], np.uint64).T * mul + add for z in (x, y)]
            u, v = (s.min(0).reshape(bands, rows) for s in sig)
            met += bool((u == v).all(1).any())
    assert met >= 0.98 * n


def test_paragraphs_long_texts_ties_and_repeated_rows(frame, rng):
    """A very long text, lines that repeat inside one text, and rows that occur twice."""
    line, long = prose(rng, 30), "\n".join(prose(rng, 40) for _ in range(6000))
    rows = [(1, f"{line}\n{prose(rng, 30)}\n{line}"), (2, long), (2, long), (3, prose(rng, 25) + "\n" + long.split("\n")[3000]), (4, line)]
    got = {}
    for r in paragraph_dedup.remove_repeats(frame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[2]) == 2 and got[2][0] == got[2][1] and got[2][0].text == long and got[2][0].n_lines == 6000
    assert got[1][0].text == rows[0][1].rsplit("\n", 1)[0] and got[4][0].text == "" and got[4][0].source_docs == [1]
    assert got[3][0].text == rows[3][1].split("\n")[0] and got[3][0].source_docs == [2]


def test_embeddings_repeated_rows_and_extra_columns(frame):
    v = [[1.0, 0.0, 0.5], [1.0, 0.01, 0.5], [0.0, 1.0, 0.0]]
    rows = [(1, v[0], 1), (1, v[0], 1), (2, v[1], 1), (3, v[2], 1), (4, v[0], 2)]
    got = embedding_neardup.near_duplicates(frame([(*r, "x", 9) for r in rows], "vec_id long, embedding array<double>, label int, keys string, same int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_word_hashes_do_not_depend_on_place_or_blocks(rng):
    text = "  " + prose(rng, 3000).replace(" a", "\n\ta") + "é\x1fz  "
    raw = text.encode()
    whole, parts = word_hashes(raw), word_hashes(raw, 64)
    assert all((a == b).all() for a, b in zip(whole, parts))
    assert [raw[s:e] for s, e in zip(whole[1], whole[2])] == raw.split()
    by_word = {}
    for w, h in zip(raw.split(), whole[0].tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word) and len(word_hashes(b" \n")[0]) == 0


def test_bands_are_tuned():
    bands, rows = paragraph_dedup.tune_bands(0.8, 0.99)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99


def test_results_do_not_depend_on_partitioning(frame, corpus):
    df = frame(corpus, "doc_id long, text string")
    for op in (lambda d: minhash_neardup.near_duplicates(d, 3, 85), lambda d: suffix_dedup.remove_repeats(d).drop("text"), lambda d: paragraph_dedup.remove_repeats(d).drop("text")):
        a, b = ({tuple(map(str, r)) for r in op(d).collect()} for d in (df.coalesce(1), df.repartition(7, F.col("doc_id"))))
        assert a == b
