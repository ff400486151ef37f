"""Line-first quality rules against plain Python."""

import re
from collections import Counter

from quillspark.llm import line_rules

from .conftest import prose

W = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    w = re.findall(W, text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {p for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    seen, dup, lost = set(), 0, 0
    for line in text.split("\n"):
        words = re.findall(W, line)
        if not words:
            continue
        dup += line in seen
        bad = line in seen or not (re.search(line_rules.ENDS, line) or re.search(line_rules.SENTENCE, line))
        bad |= 3 * len(re.findall(line_rules.SYMBOL_WORD, line)) > len(words) or bool(re.search(line_rules.SEPARATORS, line))
        bad |= len(words) <= 30 and any(p in re.sub("[A-Z]", lambda m: m[0].lower(), line) for p in line_rules.STOCK)
        bad |= len(words) >= 10 and 3 * len(set(words)) < len(words)
        lost += bad * len(words)
        seen.add(line)
    base = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), lost, base, not base and 2 * lost <= len(w)


def texts(rng):
    good = ["".join(prose(rng, rng.randrange(3, 15)).capitalize() + ". " for _ in range(4)) for _ in range(12)]
    menu = "Home | About | Contact us | More."
    return [
        None, "", " \n\t\x0b", "one", *good, "\n".join(good[:3]), "\n".join([menu] * 9 + good[:1]), "\n".join(["A stock line here."] * 12 + good[2:5]),
        " ".join(w + "$$$" for w in good[3].split()), prose(rng, 80), "Read more about Cookies.\n" + good[4] + "\nAll Rights Reserved.", "x. " * 50, good[5] + " " + good[5], "äöü “so it ends.”\n" * 2 + good[6],
        "ends here…)\n" + good[7] + "\n日本語の文。\n» a »\n| |\n| x |\nwhy?? who!! so ??", prose(rng, 30_000) + ".", "".join(prose(rng, 9).capitalize() + ".\n" for _ in range(3000)), good[8] + "\r\nA   B C\x00 D.\n", "Ä" * 5000 + ".",
    ]


def test_matches_plain_python(frame, rng):
    rows = [(i, t, "x") for i, t in enumerate(texts(rng))] * 2
    got = line_rules.assess(frame(rows, "doc_id long, text string, kept string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (*(r[m] for m in line_rules.MEASURES), r.base_failed, r.kept) == brute(r.text), r.text and r.text[:80]
    assert {r.kept for r in got} == {True, False}


def test_clean_removes_lines_and_documents(frame, rng):
    good = " ".join(prose(rng, 8).capitalize() + "." for _ in range(5))
    rows = [(1, f"Home | About | Contact\n{good}\n\nClick here.", 7), (2, "Home | About | Contact\n" * 30, 8), (3, None, 9)]
    assert [tuple(r) for r in line_rules.clean(frame(rows, "id int, text string, n_words int")).collect()] == [(1, f"{good}\n", 7)]
    named = line_rules.assess(frame(rows, "id int, body string, m0 int"), "body", "body2").collect()
    assert [r.body2 for r in named] == [f"{good}\n", "", None] and [r.m0 for r in named] == [7, 8, 9]


def test_empty_table(frame):
    assert line_rules.assess(frame([], "doc_id long, text string")).count() == 0
    assert line_rules.clean(frame([], "doc_id long, text string")).columns == ["doc_id", "text"]
