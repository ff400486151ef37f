"""Row-wise operators, models, mixing, sharding and the pipeline."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontamination, html_extraction, language_id, mixing, quality, registry, sharding
from quillspark.llm.common import held_out

from .conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_hits(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        n = min(10, len(x))
        windows = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if x else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found |= {item} - {None}
    return len(w), len(hit), sorted(found)


@pytest.fixture
def contaminated(rng):
    items = [(i, prose(rng, 5 + 4 * i)) for i in range(8)] + [(90, "Éa-b"), (91, None), (92, "..."), (93, "")]
    items += [items[5], (94, items[6][1]), (None, prose(rng, 12)), (None, items[3][1])]
    docs = [(i, prose(rng, 60)) for i in range(20)]
    docs += [(100 + i, f"{prose(rng, 9)}. {t.upper()}! {prose(rng, 9)}") for i, (_, t) in enumerate(items[:9])]
    docs += [(200, items[5][1]), (201, None), (202, ""), (203, "?!"), (204, "word " * 30_000), (205, " ".join(items[6][1].split()[4:17]))]
    docs += [(206, "x " + items[14][1]), (207, prose(rng, 400_000) + " " + items[7][1] + " " + prose(rng, 10)), docs[3], docs[25]]
    return docs, items


@pytest.mark.parametrize("block", [10, 10**6])
def test_decontamination_matches_brute_force(frame, contaminated, block):
    docs, items = contaminated
    df = frame([(d, t, 1) for d, t in docs], "doc_id long, text string, n_words int")
    got = decontamination.scan(df, frame(items, "item_id long, text string"), block_windows=block).collect()
    assert {r.doc_id: (r.n_words, sum(e - s for s, e in r.hit_runs), r.hit_items) for r in got} == {d: brute_hits(t, items) for d, t in docs}


def test_decontamination_holds_one_block_at_a_time(frame, contaminated, monkeypatch):
    docs, items = contaminated
    alive, most = set(), []

    class Counted(decontamination.WindowIndex):
        def __init__(self, *a):
            super().__init__(*a)
            alive.add(id(self))
            most.append(len(alive))

        def __del__(self):
            alive.discard(id(self))

    monkeypatch.setattr(decontamination, "WindowIndex", Counted)
    df = frame(docs[:20], "doc_id long, text string")
    decontamination.scan(df, frame(items, "item_id long, text string"), block_windows=10)
    assert len(most) >= 8 and max(most) <= 2  # the one that is shipped, and the next while it is made


def test_decontamination_removes_documents_or_spans(frame, contaminated):
    docs, items = contaminated
    df, b = frame([d for d in docs if d[0] != 207], "doc_id long, text string"), frame(items, "item_id long, text string")
    docs = [d for d in docs if d[0] != 207]
    bad = {d for d, t in docs if brute_hits(t, items)[1]}
    kept = decontamination.decontaminate(df, b).collect()
    assert {r.doc_id for r in kept} == {d for d, _ in docs} - bad and kept[0].__fields__ == ["doc_id", "text"]
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(df, b, "spans").collect()}
    assert all(cut[d] == t for d, t in docs if d not in bad) and all(words(cut[d]) == [w for w in words(t)] or d in bad for d, t in docs)
    assert all(len(words(cut[d])) == brute_hits(t, items)[0] - brute_hits(t, items)[1] for d, t in docs)
    assert decontamination.scan(df, frame([], "item_id long, text string")).where(F.size("hit_runs") > 0).count() == 0
    assert decontamination.decontaminate(frame([], "doc_id long, text string"), b).count() == 0


def test_held_out_rule(spark):
    got = spark.range(50).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


LANGS = {"aa": "the and of ing tion with".split(), "bb": "der die und ung sch keit".split(), "cc": "ção que não ões uma".split()}


def test_language_id(frame, rng):
    rows = [(i, " ".join(rng.choice(LANGS[x]) + rng.choice("xyz") for _ in range(30)), x) for i in range(240) for x in [rng.choice("abc") * 2]]
    model = language_id.train(frame(rows, "doc_id long, text string, lang string"))
    extra = [(1000, None), (1001, ""), (1002, "12 ½ !! ² 3"), (1003, "X" * 300_000), (1004, rows[0][1])]
    got = {r.doc_id: r for r in language_id.identify(frame([(d, t, 7, "keep") for d, t in [(r[0], r[1]) for r in rows] + extra], "doc_id long, text string, score int, other string"), model).collect()}
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[d].lang_pred == x for d, _, x in test) / len(test) > 0.97
    assert all(0 <= r.score <= 1 and r.other == "keep" for r in got.values())
    assert [(got[d].lang_pred, got[d].score) for d in (1000, 1001, 1002)] == [("und", 0.0)] * 3 and got[1003].lang_pred in LANGS
    none = language_id.train(frame([(1, "a", None), (2, None, "aa")], "doc_id long, text string, lang string"))
    assert [r.lang_pred for r in language_id.identify(frame([(1, "abc")], "doc_id long, text string"), none).collect()] == ["und"]
    assert language_id.identify(frame([], "doc_id long, text string"), model).count() == 0


def test_language_kernel_is_the_set_kernel():
    s = language_id.Spectrum()
    a, b = s.of("Hello there"), s.of("hello where")
    model = language_id.KernelModel([a, b], ["x", "y"], 2)
    assert model.kernel([a])[0, 1] == pytest.approx(len(set(a) & set(b)) / (len(a) * len(b)) ** 0.5, rel=1e-5)


def test_language_batches_match_text_by_text(rng, monkeypatch):
    """The block product gives the kernel of plain sets, and predictions do not depend on the batch, also with ties and repeated texts."""
    s = language_id.Spectrum()
    texts = [" ".join(rng.choice(LANGS[x]) for _ in range(rng.randrange(1, 40))) for x in ("aa", "bb", "cc") for _ in range(25)] + ["q"] * 3
    spectra = [s.of(t) for t in texts]
    model = language_id.KernelModel(spectra, ["aa"] * 25 + ["bb"] * 25 + ["cc"] * 28, 12)
    sets, marks = [set(x.tolist()) for x in spectra], []
    for wide in (7, 4096):
        monkeypatch.setattr(language_id, "WIDE", wide)
        got = model.kernel(spectra)
        marks = marks or [next(i for i, t in enumerate(sets) if abs(len(t) ** 0.5 * float(model.presence[:, j].max()) - 1) < 1e-5 and {int(model.place[g]) for g in t} == set(model.presence[:, j].nonzero()[0].tolist())) for j in range(12)]
        for i, x in enumerate(sets):
            for j, m in enumerate(marks):
                assert got[i, j] == pytest.approx(len(x & sets[m]) / (len(x) * len(sets[m])) ** 0.5, rel=1e-5)
    whole = model.predict(spectra)
    for i, x in enumerate(spectra):
        one = model.predict([x])
        assert one[0][0] == whole[0][i] and one[1][0] == pytest.approx(whole[1][i], abs=1e-8)


def test_language_n_grams_cross_block_borders():
    s = language_id.Spectrum()
    text = "ab" * (1 << 19) + "cdefgh" * 10
    t = " " + text + " "
    grams = {t[i : i + n] for n in (1, 2, 3, 4) for i in range(len(t) - n + 1)}
    assert abs(len(s.of(text)) - len(grams)) <= 1


def junk(rng, n):
    return " ".join(rng.choice(("xx###", "yy%%%", "ZZ!!", "| q |")) for _ in range(n))


def test_quality_field(frame, rng):
    docs, labels = [], []
    for i in range(240):
        good = rng.random() < 0.6
        lines = [(prose(rng, 12) + "." if good else junk(rng, 12)) for _ in range(rng.randrange(1, 7))] + ["Licensed under the licence."]
        docs.append((i, "\n".join(lines)))
        labels.append((i, int(good), 0))
    labels += [(5, None, 0), (None, 1, 0), (10_000, 1, 0)]
    field = quality.train(frame(docs, "doc_id long, text string"), frame(labels, "doc_id long, quality int, toxic int"))
    extra = [(900, None), (901, ""), (902, "\n\n\n"), (903, "a " * 100_000), (904, "x\n" * 5000), (905, docs[0][1])]
    got = {r.doc_id: r.score for r in quality.score(frame([(d, t, "s") for d, t in docs + extra], "doc_id long, text string, score string"), field).collect()}
    test = [(d, y) for d, y, _ in labels[:240] if zlib.crc32(str(d).encode()) % 4 == 2]
    assert sum((got[d] >= 0.7) == bool(y) for d, y in test) / len(test) > 0.95
    assert all(0 <= x <= 1 for x in got.values()) and len(got) == 246 and got[905] == pytest.approx(got[0])
    nothing = quality.train(frame(docs, "doc_id long, text string"), frame([], "doc_id long, quality int"))
    assert quality.score(frame(docs[:3], "doc_id long, text string"), nothing).where("score >= 0.7").count() == 3
    assert quality.score(frame([], "doc_id long, text string"), field).count() == 0


def test_chain_marginals_match_enumeration():
    import itertools

    import numpy as np

    g = np.random.default_rng(5)
    sizes = np.array([1, 4, 2, 4])
    unary, trans = g.normal(size=sizes.sum()), g.normal(size=(2, 2))
    p, pairs, z = quality.Chains(sizes).marginals(unary, trans)
    want, want_pairs, want_z, at = [], np.zeros((2, 2)), 0.0, 0
    for n in sizes:
        total, one, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(unary[at + i] for i in range(n) if y[i]) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            one += w * np.array(y)
            for i in range(n - 1):
                two[y[i], y[i + 1]] += w
        want += (one / total).tolist()
        want_pairs += two / total
        want_z += np.log(total)
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs) and z == pytest.approx(want_z)


def brute_score(field, text):
    """A document's score by sums over all label sequences of its lines."""
    import itertools
    import math

    x, length = quality.text_features(text)
    rows = [list(x[i]) + (list(x[i - 1]) if i else [0.0] * len(x[0])) + (list(x[i + 1]) if i + 1 < len(x) else [0.0] * len(x[0])) for i in range(len(x))]
    unary = [sum(a * b for a, b in zip(r, field.w)) for r in rows]
    total, good = 0.0, [0.0] * len(x)
    for y in itertools.product((0, 1), repeat=len(x)):
        w = math.exp(sum(u for u, k in zip(unary, y) if k) + sum(field.trans[a][b] for a, b in zip(y, y[1:])))
        total += w
        good = [g + w * k for g, k in zip(good, y)]
    q = sum(g / total * n for g, n in zip(good, length)) / sum(length)
    q = min(max(q, 1e-4), 1 - 1e-4)
    return 1 / (1 + math.exp(-(field.a * math.log(q / (1 - q)) + field.b)))


def test_quality_query_matches_brute_force(frame, rng):
    """Scores of the whole table are those of plain sums, also with ties, repeated rows and rows without text."""
    docs = [(i, "\n".join((prose(rng, 9) + ".") if rng.random() < (0.8 if i % 3 else 0.2) else junk(rng, 9) for _ in range(rng.randrange(1, 8)))) for i in range(150)]
    field = quality.train(frame(docs, "doc_id long, text string"), frame([(i, int(bool(i % 3))) for i in range(150)], "doc_id long, quality int"))
    rows = docs + docs[:7] + [(500, None), (501, ""), (502, docs[0][1]), (503, "\n\n")]
    got = quality.score(frame(rows, "doc_id long, text string"), field).collect()
    assert len(got) == len(rows)
    want = {d: brute_score(field, t) for d, t in rows}
    assert all(r.score == pytest.approx(want[r.doc_id], abs=1e-5) for r in got)


def test_language_query_matches_brute_force(frame, rng):
    """Predictions of the whole table are those of the kernel expansion over plain sets, also for repeated rows."""
    rows = [(i, " ".join(rng.choice(LANGS[x]) + rng.choice("xyz") for _ in range(12)), x) for i in range(90) for x in [("aa", "bb", "cc")[i % 3]]]
    df = frame(rows + rows[:9], "doc_id long, text string, lang string")
    model = language_id.train(df)
    s = language_id.Spectrum()
    marks = [{int(g) for g in model.presence[:, j].nonzero()[0]} for j in range(model.presence.shape[1])]
    sizes = [1 / float(model.presence[:, j].max()) ** 2 for j in range(len(marks))]
    want = {}
    for d, t, _ in rows:
        mine = s.of(t)
        places = {int(p) for p in model.place[mine] if p >= 0}
        kernel = [len(places & m) / (len(mine) * n) ** 0.5 for m, n in zip(marks, sizes)]
        f = [sum(k * w for k, w in zip(kernel, model.weights[:, c])) for c in range(len(model.labels))]
        want[d] = (model.labels[max(range(len(f)), key=lambda c: f[c])], min(1.0, max(0.0, max(f))))
    got = language_id.identify(df, model).collect()
    assert len(got) == 99
    for r in got:
        assert r.lang_pred == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1], abs=1e-5)


def test_mixing_long_texts_ties_and_repeated_rows(frame, rng):
    long = "word | " * 200_000
    rows = [(1, "a", "en", long), (1, "a", "en", long), (2, "a", "en", "x " * 799), (3, "b", "en", "x " * 800), (4, "b", None, "x " * 149), (5, None, "en", "x " * 150)]
    got = mixing.mix(frame(rows, "doc_id long, source string, lang string, text string"), keep=0.5).collect()
    assert sorted((r.doc_id, r.n_tokens, r.topic) for r in got) == [(1, 400_000, "table"), (1, 400_000, "table"), (2, 799, "medium"), (3, 800, "long"), (4, 149, "short"), (5, 150, "medium")]
    assert len({(r.probability, r.sampled) for r in got if r.doc_id == 1}) == 1


def page(title, body, n):
    return f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul>' + "".join(f"<li><a href='/{i}'>menu{i}</a></li>" for i in range(n)) + f'</ul></nav><!-- x --><div class="ad">buy</div>{body}<aside>more</aside><div class="comments"><p>first!</p></div><footer>&copy; host</footer></body></html>'


def test_decontamination_takes_text_ids(frame):
    items = [("q-1", "one two three"), ("q-10", "two three four five six seven eight nine ten eleven"), (None, "six seven"), ("q-2", None)]
    docs = [(1, "One, two: THREE four five six seven eight nine ten eleven"), (2, "six seven"), (3, None)]
    for block in (1, 1_000_000):
        got = decontamination.scan(frame(docs, "doc_id long, text string"), frame(items, "item_id string, text string"), block_windows=block).collect()
        assert {r.doc_id: (r.hit_items, r.hit_runs) for r in got} == {1: (["q-1", "q-10"], [[0, 11]]), 2: ([], [[0, 2]]), 3: ([], [])}
    assert [r.doc_id for r in decontamination.decontaminate(frame(docs, "doc_id long, text string"), frame(items, "item_id string, text string")).collect()] == [3]


def test_html_extraction(frame):
    rows, want = [], {}
    for i in range(12):
        rows.append((i, f"https://www.a.example/{i}", page("T", f"<article><h1>Head {i}</h1>" + "".join(f"<p>Text  {i}.{k} &amp;\n<b>bold</b></p>" for k in range(i % 4)) + "</article>", 3 + i)))
        want[i] = "\n".join([f"Head {i}"] + [f"Text {i}.{k} & bold" for k in range(i % 4)])
    for i in range(20, 28):
        rows.append((i, f"http://b.example:80/{i}", page("T", f'<div id="main"><div class="post"><p>{"Long differing text " * 5}{i}<p>Second {i}</div><div class="sidebar">side {i}</div></div><p>Terms apply.</p>', 2)))
        want[i] = f"{'Long differing text ' * 5}{i}\nSecond {i}"
    rows += [(40, "http://c.example/", None), (41, None, ""), (42, "nonsense", "<p>Only text"), (43, "http://a.example/x", "plain < words &lt;b&gt;")]
    df = frame([(*r, 5) for r in rows], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_extraction.extract(df).collect()}
    assert {i: got[i].text for i in want} == want
    assert got[40].text == got[41].text == "" and got[42].text == "Only text" and all(r.n_chars == len(r.text) for r in got.values())
    assert html_extraction.extract(frame([], "page_id long, url string, html string")).count() == 0


def test_every_language_is_learned(frame):
    """More languages than 200 and than landmarks: each is learned, and its texts are told from the others'."""
    rows = [(d, " ".join(chr(0x4E00 + 40 * k + (7 * d + j) % 40) * 2 for j in range(30)), f"l{k:03}") for k in range(210) for d in range(k * 12, k * 12 + 12)]
    df = frame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df)
    assert len(model.labels) == 210
    got = language_id.identify(df, model).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.99 * len(got)


def texts_of(frame, rows):
    return {r.page_id: r.text for r in html_extraction.extract(frame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")).collect()}


def test_html_mixed_templates_of_a_host(frame):
    """Pages of every template of a host have their text, without the host's menus and notices."""
    bodies = [lambda i: f"<article><p>Story {i}</p></article>", lambda i: f"<main><p>Main {i}</p></main>", lambda i: f'<div id="text"><p>Division {i} and more</p></div>', lambda i: f"Plain {i}"]
    got = texts_of(frame, [("http://m.example/", page("T", bodies[i % 4](i), 2)) for i in range(24)])
    assert got == {i: (f"Story {i}", f"Main {i}", f"Division {i} and more", f"Plain {i}")[i % 4] for i in range(24)}
    two = lambda i: f'<div class="old"><p>{"many old words " * 9}{i}</p></div>' if i % 3 else f'<section><p>{"few new words " * 4}{i}</p></section>'
    got = texts_of(frame, [("http://n.example/", page("T", two(i), 2)) for i in range(12)])
    assert got == {i: ("many old words " * 9 if i % 3 else "few new words " * 4) + str(i) for i in range(12)}


def test_html_marks_are_whole_tokens_and_spare_the_article(frame):
    """No class word empties an article; boilerplate inside and beside it still goes."""
    rows = []
    for k, around in enumerate((
        '<body class="no-sidebar"><article>{}</article>', '<article class="post comments-open share">{}</article>', '<div id="main-with-sidebar">{}</div>',
        '<div class="legal">{}</div>', '<div class="related"><article>{}</article></div>', '<body class="social"><div class="notice">{}</div>', '<div class="header-fixed tags">{}</div>',
    )):
        rows += [(f"http://h{k}.example/", around.format(f'<p>Long text number {i} of the page</p><div class="share">Tell all</div>') + '<div class="sidebar">side</div><footer>f</footer>') for i in range(4)]
    assert texts_of(frame, rows) == {i: f"Long text number {i % 4} of the page" for i in range(len(rows))}
    inline = '<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <object data="a">object text</object> <canvas>canvas text</canvas>.</p><figure><img src="a"><figcaption>A caption</figcaption></figure></article>'
    assert texts_of(frame, [("http://i.example/", inline)]) == {0: "So x=2 and object text canvas text.\nA caption"}


def test_html_slots_are_matched_by_place(frame):
    """A notice that all pages share stays out though the article has paragraphs of the same path; optional and repeated groups are matched in order."""
    body = lambda i: "<div>" + "".join(f"<p>Paragraph {k} of page {i} with some words</p>" for k in range(1 + i % 3)) + ("<h2>Optional %d</h2><p>Further text %d</p>" % (i, i) if i % 2 else "") + "<ul><li>Links</li></ul><p>All rights are reserved here.</p></div>"
    got = texts_of(frame, [("http://p.example/", body(i)) for i in range(12)])
    assert got == {i: "\n".join([f"Paragraph {k} of page {i} with some words" for k in range(1 + i % 3)] + ([f"Optional {i}", f"Further text {i}"] if i % 2 else [])) for i in range(12)}


def test_html_reproduced_losses(frame):
    """One page with an article empties no other; what all pages share is no article, under the same path or inside the article."""
    rows = [("http://q.example/", "<html><body><div class='content'>" + "".join(f"<p>Words {i} of part {k} stand here</p>" for k in range(3)) + "</div></body></html>") for i in range(5)]
    rows.append(("http://q.example/", "<html><body><article><p>Other words</p></article></body></html>"))
    want = {i: "\n".join(f"Words {i} of part {k} stand here" for k in range(3)) for i in range(5)} | {5: "Other words"}
    assert texts_of(frame, rows) == want
    notice = "<p>This site requires registration to view.</p>"
    rows = [("http://r.example/", f"<html><body><div>{notice if i % 2 else ''}<p>Story {i} begins</p>{'' if i % 2 else notice}<p>Story {i} ends</p></div></body></html>") for i in range(6)]
    assert texts_of(frame, rows) == {i: f"Story {i} begins\nStory {i} ends" for i in range(6)}
    rows = [("http://s.example/", f"<html><body><article><h1>Title {i}</h1><div>Subscribe now to our paper</div><p>Body {i} of it</p></article></body></html>") for i in range(5)]
    assert texts_of(frame, rows) == {i: f"Title {i}\nBody {i} of it" for i in range(5)}


def test_html_copies_keep_their_text(frame):
    """Copies and near copies of a page that hold most of a host are no template text."""
    body = lambda i: "<article>" + "".join(f"<p>Paragraph {k} {'edited ' + str(i) if k == i % 9 else 'as it was'} and more words</p>" for k in range(9)) + "</article>"
    rows = [("http://t.example/", page("T", body(40), 2))] * 30 + [("http://t.example/", page("T", f"<article><p>Own text {i} of a page</p></article>", 2)) for i in range(4)]
    got = texts_of(frame, rows)
    assert all(len(got[i].split("\n")) == 9 for i in range(30)) and all(got[30 + i] == f"Own text {i} of a page" for i in range(4))
    got = texts_of(frame, [("http://u.example/", page("T", body(i), 2)) for i in range(30)])
    assert all(len(t.split("\n")) == 9 for t in got.values())


def test_html_compound_marks(frame):
    rows = [("http://v.example/", f'<div class="page-with-sidebar"><div data-id="ad"><p>Text {i} of the article here</p></div><div class="cookie-banner">We use {i} cookies</div><ul id="related_posts"><li>See {i}</li></ul></div><div class="comment-list"><p>Reader {i} says</p></div>') for i in range(4)]
    assert texts_of(frame, rows) == {i: f"Text {i} of the article here" for i in range(4)}


def story(i: int, k: int = 3) -> str:
    return "".join(f"<p>Story {i} goes on in part {j} with a sentence of {i * 7 + j} words.</p>" for j in range(k))


def story_text(i: int, k: int = 3) -> str:
    return "\n".join(f"Story {i} goes on in part {j} with a sentence of {i * 7 + j} words." for j in range(k))


def test_html_class_words_drop_no_prose_below_an_article(frame):
    """Compounds and sections that only sound like something beside the article stay; what the wrapper bears out as beside it goes."""
    kept = [("share-price", "p"), ("legal-analysis", "section"), ("menu-prices", "div"), ("comment-period", "div"), ("search-results-study", "div"), ("legal", "section")]
    rows, want = [], []
    for k, (word, name) in enumerate(kept):
        for i in range(6):
            own = f"The {word} of case {i} is told at such length that no reader takes it for an aside, number {i}."
            rows.append((f"http://k{k}.example/", f'<article>{story(i)}<{name} class="{word}">{own}</{name}></article>'))
            want.append(f"{story_text(i)}\n{own}")
    for i in range(6):
        beside = "".join(f'<div class="post"><b>Reader {i * j}</b><p>Says {i + j}.</p></div>' for j in range(i + 1))
        rows.append(("http://posts.example/", f'<article>{story(i)}<section class="discussion">{beside}</section><div class="ad">Buy {i} now</div></article>'))
        want.append(story_text(i))
        own = f"We discuss {i} results here. " * 4
        rows.append(("http://paper.example/", f'<article>{story(i)}<section class="discussion"><h2>Discussion {i}</h2><p>{own}</p><p>And {i} more.</p></section></article>'))
        want.append(f"{story_text(i)}\nDiscussion {i}\n{own.strip()}\nAnd {i} more.")
    assert texts_of(frame, rows) == dict(enumerate(want))


def test_html_inline_adverts(frame):
    """An inline advert goes out of its paragraph, with what it nests; one that doesn't end takes nothing along."""
    cases = [
        ('Before <span class="ad">Buy <span>two</span> now</span> and after.', "Before and after."),
        ('Before <span class="ad">never closed', "Before never closed"),
        ('A <a class="sponsored" href="x">shop</a>, <b class="added">bold</b> <span class="ad"/>end.', "A , bold end."),
    ]
    rows = [(f"http://i{k}.example/", f"<article><p>{n} {h}</p><p>{n} closes.</p></article>") for k, (h, _) in enumerate(cases) for n in range(3)]
    assert texts_of(frame, rows) == {3 * k + n: f"{n} {t}\n{n} closes." for k, (_, t) in enumerate(cases) for n in range(3)}


def test_html_small_hosts_and_shared_paragraphs(frame):
    """Two pages tell what a host repeats; a long paragraph that half of the articles share is theirs, a short one or one on all pages isn't."""
    notice = "<div>Subscribe to our newsletter today.</div>"
    rows = [("http://two.example/", f"<article><h1>Title {i}</h1>{notice}{story(i)}</article>") for i in range(2)]
    assert texts_of(frame, rows) == {i: f"Title {i}\n{story_text(i)}" for i in range(2)}
    shared = "The committee has published the same long statement on this matter, and many papers have printed it in full."
    rows = [("http://half.example/", f"<article>{story(i)}{f'<p>{shared}</p>' if i % 2 else ''}<p>Read on.</p></article>") for i in range(8)]
    assert texts_of(frame, rows) == {i: story_text(i) + (f"\n{shared}" if i % 2 else "") for i in range(8)}


def test_html_tables_of_copies_long_pages_and_ties(frame):
    """A long page of any structure keeps each of its blocks once and in order; repeated rows get equal texts; odd markup does no harm."""
    r = random.Random(3)
    parts = [f"<{t}>block {i}</{t}>" for i in range(4000) for t in [r.choice(["p", "h2", "h3", "blockquote", "section"])]]
    long = "<article>" + "".join(parts) + "</article>"
    odd = ["<p", "<<>>&#xZZ;&", "<div><div><div>", "</p></p>text</b>", "<!-- open", "<a=b>x", "\x00\x01" + "y"]
    rows = [("http://w.example/", long)] * 2 + [("http://w.example/1", f"<article><p>short {i}</p><h3>x{i}</h3></article>") for i in range(3)] + [("http://x.example/", o) for o in odd] + [(None, "<p>no host")] * 2
    got = texts_of(frame, rows)
    assert got[0] == got[1] == "\n".join(f"block {i}" for i in range(4000)) and got[2] == "short 0\nx0"
    assert got[len(rows) - 1] == got[len(rows) - 2] == "no host"


def brute_pairs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def test_alignment_is_a_longest_one():
    r = random.Random(5)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(0, 90))] for _ in range(2))
        got = html_extraction.pairs(a, b)
        assert [i for i, _ in got if i is not None] == list(range(len(a))) and [j for _, j in got if j is not None] == list(range(len(b)))
        both = [(i, j) for i, j in got if i is not None and j is not None]
        assert all(a[i] == b[j] for i, j in both) and len(both) == brute_pairs(a, b)


def test_wrapper_alignment_makes_slots_optionals_and_repeats():
    a, b = (html_extraction.fold(html_extraction.blocks(t)) for t in ("<div><h1>A</h1><p>x<p>y</div><p>same", "<div><h1>B</h1><h2>new</h2><p>z</div><p>same"))
    assert [n[:3] for n in html_extraction.align(a, b)] == [["div/h1", 1, 2], ["div/h2", 1, 1], ["div/p", 2, 2], ["p", 1, 2]]
    wide = html_extraction.fold(html_extraction.blocks("".join(f"<h{k}>t</h{k}>" for k in (1, 2, 3, 4, 5, 6)) * 4 + "<p>z"))
    wide8 = html_extraction.fold(html_extraction.blocks("".join(f"<{k}>t</{k}>" for k in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "div")) * 5))
    assert [(n[0], n[1], len(n[4])) for n in wide] == [(f"h{k}", 2, 4) for k in range(1, 7)] + [("p", 1, 1)] and [len(n[4]) for n in wide8] == [5] * 8


def test_html_joined_wrappers_give_the_same(frame, monkeypatch):
    df = frame([(i, f"http://h{i % 3}.example/", page("T", f"<article><p>Body {i}</p></article>", 2)) for i in range(30)], "page_id long, url string, html string")
    want = {tuple(r) for r in html_extraction.extract(df).collect()}
    monkeypatch.setattr(html_extraction, "MAX_BROADCAST", -1)
    monkeypatch.setattr(html_extraction, "MAX_CONSTANTS", -1)
    assert {tuple(r) for r in html_extraction.extract(df).collect()} == want


def mixed(rng, n=600):
    return [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.choice(["en", "en", "de"]), prose(rng, rng.choice([5, 200, 900])) if i % 50 else rng.choice([None, ""])) for i in range(n)]


def test_mixing_meets_the_margins(frame, rng):
    df = frame([(*r, 1) for r in mixed(rng)], "doc_id long, source string, lang string, text string, weight int")
    targets = {"source": {"a": 1.0, "b": 1.0, "c": 1.0, "(none)": 1.0}, "lang": 1.0, "topic": 1.0}
    got = mixing.mix(df, targets, keep=0.5).collect()
    total = sum(r.n_tokens for r in got)
    raked, kept = collections.Counter(), 0.0
    for r in got:
        raked[r.source] += r.n_tokens * r.weight
        kept += r.n_tokens * r.probability
    assert all(v == pytest.approx(total / 4, rel=1e-3) for v in raked.values())
    assert kept == pytest.approx(0.5 * total, rel=1e-6) and all(0 <= r.probability <= 1 for r in got) and len(got) == 600
    again = {r.doc_id: r.sampled for r in mixing.mix(df.repartition(5), targets, keep=0.5).collect()}
    assert {r.doc_id: r.sampled for r in got} == again
    assert mixing.mix(df.limit(0), targets).count() == 0
    assert mixing.sample(df, targets=targets).columns == df.columns


def test_mixing_unknown_targets_get_nothing(frame, rng):
    df = frame(mixed(rng, 100), "doc_id long, source string, lang string, text string")
    got = mixing.mix(df, {"source": {"a": 2.0, "zz": 5.0}, "lang": 1.0}).collect()
    assert all((r.probability == 0) == (r.source != "a" or not r.n_tokens) or r.n_tokens == 0 for r in got)


def brute_mix(rows, targets, keep):
    """(probability, weight) of each document by loops over cells."""
    cells = collections.defaultdict(float)
    for _, source, lang, text in rows:
        cells[source or "(none)", lang or "(none)"] += len((text or "").split())
    weight = dict(cells)
    total = sum(cells.values())
    aims = []
    for k, target in enumerate(targets):
        values = {c[k] for c in cells}
        aim = {v: target.get(v, 0.0) if isinstance(target, dict) else sum(x for c, x in cells.items() if c[k] == v) ** target for v in values}
        aims.append({v: a / sum(aim.values()) * total for v, a in aim.items()})
    for _ in range(mixing.ROUNDS):
        for k, aim in enumerate(aims):
            sums = collections.defaultdict(float)
            for c, w in weight.items():
                sums[c[k]] += w
            weight = {c: w * aim[c[k]] / sums[c[k]] if sums[c[k]] else 0.0 for c, w in weight.items()}
    ratio = {c: weight[c] / cells[c] if cells[c] else 0.0 for c in cells}
    scale = keep
    for _ in range(mixing.CALIBRATIONS):
        full = {c for c in cells if ratio[c] * scale >= 1}
        rest = sum(weight[c] for c in cells if c not in full)
        if rest:
            scale = max(scale, (keep * total - sum(cells[c] for c in full)) / rest)
    return {c: (min(1.0, ratio[c] * scale), ratio[c]) for c in cells}


@pytest.mark.parametrize("apart", [False, True])
def test_mixing_matches_brute_force(frame, rng, monkeypatch, apart):
    """Both ways of raking give the margins and probabilities of plain loops, also for ties, repeated rows and rows without text."""
    rows = mixed(rng, 120) + mixed(rng, 20)[:5]
    df = frame(rows, "doc_id long, source string, lang string, text string")
    if apart:
        monkeypatch.setattr(mixing, "MAX_CELLS", 0)
        monkeypatch.setattr(mixing, "ROUNDS", 4)
        monkeypatch.setattr(mixing.rake, "__defaults__", (4, mixing.KEEP, mixing.CALIBRATIONS))
    for targets in ({"source": 0.5, "lang": 1.0}, {"source": {"a": 2.0, "b": 1.0, "(none)": 1.0}, "lang": {"en": 1.0, "de": 1.0}}):
        want = brute_mix(rows, list(targets.values()), 0.6)
        got = mixing.mix(df, targets, keep=0.6).collect()
        assert len(got) == len(rows)
        for r in got:
            p, w = want[r.source or "(none)", r.lang or "(none)"]
            assert r.probability == pytest.approx(p, rel=1e-9, abs=1e-12) and r.weight == pytest.approx(w, rel=1e-9, abs=1e-12)
            assert r.sampled == (int(hashlib.md5(f"{r.doc_id}|{mixing.SEED}".encode()).hexdigest()[:13], 16) / 2**52 < r.probability)


def brute_table(shards, slots):
    def perm(name):
        d = hashlib.md5(name.encode()).digest()
        at, skip = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:], "big") % (slots - 1) + 1
        return iter([(at + j * skip) % slots for j in range(slots)])

    turns, table = [perm(f"shard-{i:05d}") for i in range(shards)], [-1] * slots
    while -1 in table:
        for i, p in enumerate(turns):
            for s in p:
                if table[s] < 0:
                    table[s] = i
                    break
    return table


def test_sharding_table():
    assert sharding.lookup_table(7, 211) == brute_table(7, 211)
    t = sharding.lookup_table(16, 4099)
    counts = collections.Counter(t)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table([f"shard-{i:05d}" for i in range(15)], 4099)
    assert sum(a != b for a, b in zip(t, fewer) if a != 15) / 4099 < 0.1
    for bad in ((3, 210), (0, 211), (300, 211)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_sharding_rows(frame, tmp_path):
    df = frame([(i, "x", "y", "z") for i in [*range(200), 7, None]], "doc_id long, shard string, slot string, _slot string")
    got = sharding.shard(df, 8, 1009).collect()
    table = sharding.lookup_table(8, 1009)
    for r in got:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:8], 16) % 1009
        assert (r.slot, r.shard, r["_slot"]) == (slot, table[slot], "z")
    assert len(got) == 202
    assert sharding.shard(df.limit(0), 8, 1009).count() == 0
    sharding.write_shards(df.select("doc_id"), str(tmp_path / "out"), 4, 211, files=2)
    assert df.sparkSession.read.parquet(str(tmp_path / "out")).count() == 202


@pytest.mark.parametrize("name", ["op2_decontamination", "op6_mixing", "op7_embedding_neardup", "op8_suffix_dedup", "op9_minhash_neardup", "op10_sharding"])
def test_queries_match_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    want = con.execute(registry.oracle_sql()[name]).df()
    got = registry.QUERIES[name](spark, d).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda x: sorted(tuple(map(str, r)) for r in x[sorted(got.columns)].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def test_made_columns_of_the_caller_stay(frame, rng):
    """Operators that promise the caller's columns keep them, whatever they are called."""
    names = ["n_words", "hit_runs", "hit_items", "topic", "n_tokens", "weight", "probability", "sampled", "score", "kept", "component_id", "n_shingles", "n_docs", "lang_pred", "quality"]
    df = frame([(i, prose(rng, 40), "s", "en", *[f"{n}{i}" for n in names]) for i in range(6)], "doc_id long, text string, source string, lang string, " + ", ".join(f"{n} string" for n in names))
    labels, items = frame([(i, i % 2) for i in range(6)], "doc_id long, quality int"), frame([(1, "a b")], "item_id long, text string")
    from quillspark.llm import minhash_neardup

    for out in (mixing.sample(df, keep=1.0), decontamination.decontaminate(df, items), decontamination.decontaminate(df, items, "spans"), quality.keep_good(df, labels, 0.0), minhash_neardup.deduplicate(df)):
        rows = out.collect()
        assert out.columns == df.columns and len(rows) == 6
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)


def test_mixing_takes_the_callers_topic(frame, rng):
    df = frame([(i, "s", "en", prose(rng, 50), "sport" if i % 3 else "news") for i in range(300)], "doc_id long, source string, lang string, text string, topic string")
    got = mixing.mix(df, {"source": 1.0, "topic": {"sport": 1.0, "news": 1.0}}, topic=F.col("topic")).collect()
    total = sum(r.n_tokens for r in got)
    assert {r.topic for r in got} == {"sport", "news"}
    for name in ("sport", "news"):
        assert sum(r.n_tokens * r.weight for r in got if r.topic == name) == pytest.approx(total / 2, rel=1e-6)
    assert mixing.sample(df, topic=F.upper("topic")).where("topic not in ('sport', 'news')").count() == 0


def test_helper_columns_leave_others_alone(frame, rng):
    """Columns of the caller with the names of helpers stay as they are."""
    from quillspark.llm import paragraph_dedup, suffix_dedup

    text = prose(rng, 90)
    names = ["_doc", "_spans", "_host", "_quality", "_shard", "_gone", "cluster", "size", "block", "id", "component", "rep"]
    df = frame([(i, text, "http://h.example/", "en", *["k"] * len(names)) for i in (1, 2)], "doc_id long, text string, source string, lang string, " + ", ".join(f"{n} string" for n in names))
    labels, items = frame([(1, 1), (2, 0)], "doc_id long, quality int"), frame([(1, "a b")], "item_id long, text string")
    from quillspark.llm import minhash_neardup

    for out in (
        suffix_dedup.remove_repeats(df),
        paragraph_dedup.remove_repeats(df),
        minhash_neardup.deduplicate(df),
        sharding.shard(df),
        quality.score(df, quality.train(df, labels)),
        decontamination.scan(df, items),
        html_extraction.extract(df.withColumnRenamed("text", "html"), "source"),
        mixing.mix(df),
        language_id.identify(df, language_id.train(df)),
    ):
        assert all(r[n] == "k" for r in out.collect() for n in names)
