"""Main-text extraction with wrappers inferred as union-free regular expressions.

The pages of a host that share a skeleton, the outer elements of their texts, are written as token streams: the
elements around each text block, and the text itself where the host repeats it. Neighbouring repetitions inside a
page fold into repeated groups. The streams are aligned one after another with the wrapper of their template; a
mismatch becomes a text slot, where texts differ, or an optional group, where tokens are missing on one side.
Wrappers of parts of the pages are aligned with one another in the same way, so a host of any size is inferred from
all of its pages. The wrapper decides which of its slots belong to the article; a page's text is what it has there.

A text is constant if at least `COMMON_PAGES` pages of the host whose longest other texts differ have it below the same
elements, and at least half of those that have any text there. Constant texts are tokens of their
own, so they are no article, unless they make up nearly all of a template's text, or are long and stand among the
article's own slots on fewer than `EVERYWHERE` of the pages.

Class words alone drop nothing below an article: what they mark goes where the wrapper bears them out, because it
is missing on some pages, holds far less text than the article, or is a repeated group of containers.
"""

from __future__ import annotations

import heapq
import html as _html
import json
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, partitions, save

# Element names by their role in a page.
INLINE = frozenset("a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i img ins kbd label mark math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover object q rp rt ruby s samp semantics small span strike strong sub sup time tt u var video wbr".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe textarea title annotation annotation-xml".split())
BOILERPLATE = frozenset("nav header footer aside form button select menu dialog head fieldset".split())
MAIN = ("article", "main")
#: Elements that no class, id or role marks.
UNMARKED = frozenset(("html", "body", *MAIN))
#: Tokens of class, id or role of an element that is not part of the article, unless it holds the article; also in a compound with others of them or with NEUTRAL parts.
MARKS = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disqus footer header legal login masthead menu nav navbar navigation newsletter notice overlay pager pagination popup promo promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split())
#: Parts of a compound token that say nothing of what the element is.
NEUTRAL = frozenset("area bar block bottom box container global group inner item items link links list panel section site slot top unit widget wrap".split())
#: Tokens of an element that can be a part of an article too, and counts as none only where it is a repeated group of containers, such as the posts of readers.
WEAK = frozenset("discussion discussions feedback forum guestbook posts responses reviews talkback thread".split())
#: Tokens of an inline element whose text is no part of its paragraph.
ADVERTS = frozenset("ad ads advert advertisement advertising promo sponsor sponsored".split())
#: Elements that a new block closes implicitly, by the new element's name.
_CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w:.-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_BARE = re.compile(r"[^.!?~]*")
_NAME = re.compile(r"[a-z]+")
_PART = re.compile(r"[-_]+")
_SPACE = re.compile(r"\s+")


class Block:
    """One text block of a page: the path of its elements and its text."""

    __slots__ = ("path", "text")

    def __init__(self, path: tuple[str, ...], text: str):
        self.path, self.text = path, text


def _bare(element: str) -> str:
    """The name of an element."""
    return _BARE.match(element)[0]


def _marks(token: str) -> bool:
    """Whether a class, id or role tells of something beside the article."""
    parts = set(_PART.split(token))
    return token in MARKS or (parts <= MARKS | NEUTRAL and not MARKS.isdisjoint(parts - {"widget"}))


def _element(name: str, attributes: str) -> str:
    """An element as the wrapper sees it: its name, ! if it is hidden, ? if its class, id or role marks it as no article, ~ if a weak token does, and its class words."""
    if not attributes or attributes.isspace():
        return name
    words, hidden, marked, weak = [], False, False, False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "role"):
            marked |= name not in UNMARKED and any(map(_marks, value.split()))
            weak |= name not in UNMARKED and not WEAK.isdisjoint(value.split())
            if key == "class" and name not in ("html", "body"):
                words += _NAME.findall(value)
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            hidden = True
    return name + "!" * hidden + "?" * marked + "~" * weak + "".join(f".{w}" for w in words)


def _advert(attributes: str) -> bool:
    """Whether an inline element is an advert."""
    return "class" in attributes.lower() and any(k.lower() == "class" and not ADVERTS.isdisjoint(v.strip("\"'").lower().split()) for k, v in _ATTRIBUTE.findall(attributes))


def blocks(page: str | None) -> list[Block]:
    """The non-empty text blocks of a page, in order; scripts, styles, comments, markup and inline adverts are gone."""
    page = page or ""
    out: list[Block] = []
    stack: list[str] = []
    text: list[str] = []

    def flush():
        if text:
            joined = _SPACE.sub(" ", _html.unescape("".join(text))).strip()
            if joined:
                out.append(Block(tuple(stack), joined))
            text.clear()

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            text.append(page[at:lt])
        if lt == end:
            break
        m = _TOKEN.match(page, lt)
        if not m:
            text.append("<")
            at = lt + 1
            continue
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                text.append(_html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name = m[2].lower()
        if m[1]:
            if name in INLINE or name in VOID and name != "br":
                continue
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if _bare(stack[i]) == name:
                    del stack[i:]
                    break
            continue
        if name in RAW:
            if not m[3].rstrip().endswith("/"):
                close = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(page, at)
                at = close.end() if close else end
            if name not in INLINE:
                text.append(" ")
            continue
        if name in INLINE:
            if name not in VOID and m[3] and _advert(m[3]):
                at = _beyond(page, name, at)
            continue
        flush()
        if name in VOID or m[3].rstrip().endswith("/"):
            continue
        closes, stops = _CLOSES.get(name, {"p"}), _STOPS.get(name, frozenset())
        for i in range(len(stack) - 1, -1, -1):
            bare = _bare(stack[i])
            if bare in stops:
                break
            if bare in closes:
                del stack[i:]
                break
            if bare not in ("p",) and not stops:
                break
        stack.append(_element(name, m[3]))
    flush()
    return out


def _beyond(page: str, name: str, at: int) -> int:
    """Where an inline element ends that has begun before `at`; `at` itself if it doesn't end before the next block."""
    depth, here = 1, at
    while m := _TOKEN.search(page, here):
        here = m.end()
        if not m[2]:
            continue
        other = m[2].lower()
        if other not in INLINE and other not in VOID and other not in RAW:
            return at
        if other == name and not m[3].rstrip().endswith("/"):
            depth += -1 if m[1] else 1
            if not depth:
                return here
    return at


#: Pages with different main blocks that must have a text before it counts as constant.
COMMON_PAGES = 2
#: A text on so large a share of a template's pages is no part of an article even among its slots; shorter texts than this many characters need not be so frequent.
EVERYWHERE, NOTICE_CHARS = 0.9, 80
#: What is marked below an article and holds less than this share of its text per page is no part of it.
BESIDE = 0.25
#: So many of a page's longest other texts tell whether two pages that share a text are copies.
MAIN_TEXTS = 3
#: Constant texts that hold more than this share of a template's text are its article: its pages are near copies.
COPIES = 0.8
#: Between the path and the hash in the token of a constant text.
_CONSTANT = "\x01"
#: Outer elements of a path that tell templates of a host apart.
_OUTER = 3


def _hash(*parts: str) -> int:
    """A signed 64-bit hash."""
    h = xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"))
    return h - (h >> 63 << 64)


def _place(host: str, block: Block) -> str:
    """The host and the bare elements of a block, as constant texts see them."""
    return "\0".join((host, *map(_bare, block.path)))


def tokens(page: list[Block], host: str, constant) -> list[str]:
    """The token of each block: its path, and of texts whose hash is in `constant` the hash too."""
    out = []
    for b in page:
        path = "/".join(b.path)
        h = _hash(_place(host, b), b.text) if constant else 0
        out.append(f"{path}{_CONSTANT}{h}" if constant and h in constant else path)
    return out


def skeleton(page: list[Block]) -> int:
    """What tells the templates of a host apart: the set of the outer elements of the blocks' paths, but for lists of links."""
    return _hash(*sorted({"/".join(b.path[:_OUTER]) for b in page}))


# A wrapper is a list of nodes [token, count, pages, chars]: the token of a slot or constant text, whether it is
# repeated (2) or single (1), the number of pages that have it and their mean characters. A node that fewer pages
# have than the wrapper is optional.

_BASE, _RING = 1_000_003, (1 << 61) - 1


def fold(page: list[Block], names: list[str] | None = None) -> list[list]:
    """A page as a wrapper of its own: neighbouring repetitions of one or any number of slots become repeated groups.

    A fifth item of each node has the numbers of its blocks.
    """
    out: list[list] = []
    number: dict[str, int] = {}
    where: dict[str, list[int]] = {}
    sums, powers = [0], [1]  # hashes of the first tokens of `out`, so that ranges compare at once
    for i, name in enumerate(names if names is not None else tokens(page, "", ())):
        at = where.setdefault(name, [])
        out.append([name, 1, 1, len(page[i].text), [i]])
        sums.append((sums[-1] * _BASE + number.setdefault(name, len(number) + 1)) % _RING)
        if len(powers) < len(sums):
            powers.append(powers[-1] * _BASE % _RING)
        end = len(out)
        width = 0
        for q in reversed(at):
            w = end - 1 - q
            if 2 * w > end:
                break
            if not (sums[end] - sums[end - w] * powers[w] - sums[end - w] + sums[end - 2 * w] * powers[w]) % _RING:
                width = w
                break
        at.append(end - 1)
        if width:
            for a, b in zip(out[end - 2 * width : end - width], out[end - width :]):
                a[1], a[3] = 2, a[3] + b[3]
                a[4] += b[4]
                where[b[0]].pop()
            del out[end - width :], sums[end - width + 1 :]
    return out


def pairs(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """Places of two token lists in one order, equal tokens together, as many as possible; None where one has no partner.

    A longest common subsequence with the rows of its table as bits of whole numbers, so long pages cost little.
    Of a long table every k-th row is kept, and the rows between are made again when the way back reaches them.
    """
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    x, y = a[low : len(a) - high], b[low : len(b) - high]
    have: dict[str, int] = {}
    for i, name in enumerate(x):
        have[name] = have.get(name, 0) | 1 << i
    full = (1 << len(x)) - 1
    step = max(64, int(len(y) ** 0.5) + 1)

    def rows(v: int, names: list[str]) -> list[int]:
        made = []
        for name in names:
            u = v & have.get(name, 0)
            v = ((v + u) | (v - u)) & full
            made.append(v)
        return made

    starts, v = [], full
    for c in range(0, len(y), step):
        starts.append(v)
        v = rows(v, y[c : c + step])[-1]
    middle: list[tuple[int | None, int | None]] = []
    i, j, block, table = len(x), len(y), -1, []
    while i and j:
        if (j - 1) // step != block:
            block = (j - 1) // step
            table = [starts[block], *rows(starts[block], y[block * step : block * step + step])]
        k = j - block * step
        if table[k] >> (i - 1) & 1:
            i -= 1
            middle.append((low + i, None))
        else:
            j -= 1
            if table[k - 1] >> (i - 1) & 1:
                i -= 1
                middle.append((low + i, low + j))
            else:
                middle.append((None, low + j))
    middle += [(low + k, None) for k in range(i - 1, -1, -1)] + [(None, low + k) for k in range(j - 1, -1, -1)]
    return [(k, k) for k in range(low)] + middle[::-1] + [(len(a) - k, len(b) - k) for k in range(high, 0, -1)]


def align(a: list[list], b: list[list]) -> list[list]:
    """The wrapper of two wrappers: equal tokens are matched in order, as many as possible; a node without partner is an optional one."""
    out: list[list] = []
    for i, j in pairs([n[0] for n in a], [n[0] for n in b]):
        if i is None or j is None:
            out.append((b[j] if i is None else a[i])[:4])
            continue
        p, q = a[i], b[j]
        count = p[2] + q[2]
        out.append([p[0], max(p[1], q[1]), count, (p[3] * p[2] + q[3] * q[2]) / count])
    return out


class Wrapper:
    """The wrapper of a template, and how many pages it has seen."""

    def __init__(self, nodes: list[list] | None = None, pages: int = 0):
        self.nodes, self.pages = nodes or [], pages

    def add(self, other: "Wrapper") -> None:
        self.nodes = align(self.nodes, other.nodes) if self.pages else [n[:4] for n in other.nodes]
        self.pages += other.pages

    def dump(self) -> str:
        return json.dumps([self.pages, self.nodes], ensure_ascii=False)

    @classmethod
    def load(cls, text: str) -> "Wrapper":
        pages, nodes = json.loads(text)
        return cls(nodes, pages)

    def article(self) -> list[bool]:
        """Which nodes belong to the article.

        Never those below a boilerplate element. Of the rest, those below an article or main element if the
        template has one; else those below the deepest element that holds most of the differing text. A marked
        element counts as boilerplate, but not if it is around an article or main element or holds most of that
        text. Constant texts are left out, unless they are nearly all that there is.
        """
        paths = [n[0].split(_CONSTANT)[0].split("/") for n in self.nodes]
        fixed = [_CONSTANT in n[0] for n in self.nodes]
        size = [n[3] * n[2] for n in self.nodes]
        posts = self._posts(paths)
        seen = [not any("!" in e or _bare(e) in BOILERPLATE for e in p) and not any(tuple(p[: i + 1]) in posts for i in range(len(p))) for p in paths]
        marked = [[tuple(p[: i + 1]) for i, e in enumerate(p) if "?" in e and not any(_bare(x) in MAIN for x in p[i + 1 :])] for p in paths]
        open_ = [o and not m for o, m in zip(seen, marked)]

        def without_constants(inside: list[bool]) -> list[bool]:
            slots = sum(s for s, k, f in zip(size, inside, fixed) if k and not f)
            if slots < (1 - COPIES) * sum(s for s, k in zip(size, inside) if k) and self.pages >= COMMON_PAGES:
                return inside
            return [k and not f for k, f in zip(inside, fixed)]

        for name in MAIN:
            below = [o and any(_bare(e) == name for e in p) for o, p in zip(seen, paths)]
            aside = self._aside(below, marked, size, fixed)
            inside = [k and not any(e in aside for e in ms) for k, ms in zip(below, marked)]
            own = {tuple(p) for p, k, f in zip(paths, inside, fixed) if k and not f}
            prose = [f and k and tuple(p) in own and n[2] < EVERYWHERE * self.pages and n[3] >= NOTICE_CHARS for f, k, p, n in zip(fixed, inside, paths, self.nodes)]
            inside = [a or b for a, b in zip(without_constants(inside), prose)]
            if any(inside):
                return inside
        mass = [s * (o and not f) for s, o, f in zip(size, seen, fixed)]
        held: dict[tuple, float] = {}
        for ms, m in zip(marked, mass):
            for e in ms:
                held[e] = held.get(e, 0) + m
        open_ = [o and all(held[e] and held[e] >= 0.6 * sum(mass) for e in ms) for o, ms in zip(seen, marked)]
        mass = [m * o for m, o in zip(mass, open_)]
        if not sum(mass):  # constants alone
            mass = [s * o for s, o in zip(size, open_)]
        total = sum(mass)
        best: tuple[str, ...] = ()
        while total:
            below: dict[tuple, float] = {}
            for p, m in zip(paths, mass):
                if len(p) > len(best) + 1 and tuple(p[: len(best)]) == best:
                    below[tuple(p[: len(best) + 1])] = below.get(tuple(p[: len(best) + 1]), 0) + m
            top = max(below, key=below.get, default=None)
            if top is None or below[top] < 0.6 * total:
                break
            best = top
        return without_constants([o and tuple(p[: len(best)]) == best for o, p in zip(open_, paths)])


    def _posts(self, paths: list[list[str]]) -> set[tuple]:
        """Weakly marked elements that are a repeated group of containers."""
        return {tuple(p[: i + 1]) for n, p in zip(self.nodes, paths) if n[1] == 2 for i, e in enumerate(p[:-1]) if "~" in e and i + 2 <= len(p) - 1}

    def _aside(self, below: list[bool], marked: list[list[tuple]], size: list[float], fixed: list[bool]) -> set[tuple]:
        """Marked elements below an article that the wrapper bears out as no part of it."""
        plain = sum(s for s, k, ms, f in zip(size, below, marked, fixed) if k and not ms and not f)
        out = set()
        for e in {e for k, ms in zip(below, marked) if k for e in ms}:
            at = [i for i, (k, ms) in enumerate(zip(below, marked)) if k and e in ms]
            missing = max(self.nodes[i][2] for i in at) < EVERYWHERE * self.pages
            group = any(self.nodes[i][1] == 2 and len(self.nodes[i][0].split(_CONSTANT)[0].split("/")) >= len(e) + 2 for i in at)
            if missing or group or sum(size[i] for i in at if not fixed[i]) < BESIDE * plain:
                out.add(e)
        return out


class Extractor:
    """Matches pages with the wrapper of their template; pages of one shape are aligned once."""

    def __init__(self, wrapper: Wrapper, host: str):
        self.wrapper, self.host, self.inside = wrapper, host, wrapper.article()
        self.names = [n[0] for n in wrapper.nodes]
        self.constant = frozenset(int(n.split(_CONSTANT)[1]) for n in self.names if _CONSTANT in n)
        self.shapes: dict[tuple, list] = {}

    def text(self, page: list[Block]) -> str:
        """What the page has in the slots of the article, by their places in the wrapper.

        Every page has a place for each of its nodes, as its wrapper was made from it too; where an alignment of
        many pages took another way, so that a node has none, it is decided as its page alone would. A page with
        nothing there has its own article, main or densest element, without the constant texts of its host.
        """
        nodes = fold(page, tokens(page, self.host, self.constant))
        shape = tuple(n[0] for n in nodes)
        places = self.shapes.get(shape)
        if places is None:
            if len(self.shapes) > 1000:
                self.shapes.clear()
            places = self.shapes[shape] = [i for i, j in pairs(self.names, list(shape)) if j is not None]
        keep = [i is not None and self.inside[i] for i in places]
        if None in places or not any(keep):
            own = [n for n in nodes if _CONSTANT not in n[0]]
            inside = iter(Wrapper(own, 1).article())
            alone = [_CONSTANT not in n[0] and next(inside) for n in nodes]
            nothing = not any(keep)
            keep = [a if nothing or i is None else k for k, a, i in zip(keep, alone, places)]
        return "\n".join(page[b].text for b in sorted(b for n, k in zip(nodes, keep) if k for b in n[4]))


#: Pages that are held as Python objects at once.
PAGES = 250


def _some(batches):
    """The rows of the batches, a few at a time."""
    for b in batches:
        for at in range(0, b.num_rows, PAGES):
            yield b.slice(at, PAGES)


def _count(batches):
    """(text, place, main): hashes of each block's text with its path, of the path, and of the page's longest other texts; text is null where the page's path alone counts."""
    for b in _some(batches):
        seen: set[tuple[int | None, int, int]] = set()
        for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
            page = blocks(html)
            longest = heapq.nlargest(MAIN_TEXTS + 1, {x.text for x in page}, key=lambda t: (len(t), t))
            mains = {t: _hash(*[x for x in longest if x != t][:MAIN_TEXTS]) for t in (*longest, "")}
            for x in page:
                place = _place(host, x)
                seen.add((_hash(place, x.text), _hash(place), mains.get(x.text, mains[""])))
                seen.add((None, _hash(place), mains[""]))
        yield pa.record_batch([pa.array([s[k] for s in seen], pa.int64()) for k in range(3)], names=["text", "place", "main"])


def constant_texts(pages: DataFrame) -> DataFrame:
    """(text): the hashes of the constant texts of all hosts, counted over all pages (host, html)."""
    rows = pages.select("host", "html").mapInArrow(_count, "text long, place long, main long")
    counts = save(rows.distinct().groupBy("text", "place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON_PAGES), "often")
    often, around = counts.where("text is not null"), counts.where("text is null").select("place", F.col("n").alias("of"))
    return often.join(around, "place").where("2 * n >= of").select("text", "place")


def _infer(known):
    """Wrappers of the pages of one task, one for each template of a host."""

    def run(batches):
        found: dict[tuple[str, int], Wrapper] = {}
        constant = known() if known else None

        def made():
            keys = list(found)
            return pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([found[k].dump() for k in keys], pa.string())], names=["host", "template", "wrapper"])

        for b in _some(batches):
            lists = b.column("constant").to_pylist() if constant is None else [constant] * b.num_rows
            for host, html, c in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), lists):
                page = blocks(html)
                names = tokens(page, host, c if constant is not None else frozenset(c or ()))
                found.setdefault((host, skeleton(page)), Wrapper()).add(Wrapper(fold(page, names), 1))
            if len(found) > 1000:
                yield made()
                found.clear()
        yield made()

    return run


def _merge(batches):
    """Wrappers of a template, aligned with one another; the rows come sorted by host and template."""
    key, whole = None, None

    def made(done):
        return pa.record_batch([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], names=["host", "template", "wrapper"])

    for b in batches:
        done = []
        for h, t, w in zip(*(b.column(k).to_pylist() for k in ("host", "template", "wrapper"))):
            if whole is None or (h, t) != key:
                if whole is not None:
                    done.append((*key, whole.dump()))
                key, whole = (h, t), Wrapper()
            whole.add(Wrapper.load(w))
        yield made(done)
    yield made([(*key, whole.dump())] if whole is not None else [])


#: Constant texts of up to so many are broadcast; beyond that pages are joined with those of their host.
MAX_CONSTANTS = 1_000_000


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, template, wrapper) from all pages (host, html): each task infers its part, then the parts are aligned in two steps, so that a hot host is dealt over many tasks first."""
    spark = pages.sparkSession
    n, schema = partitions(spark), "host string, template long, wrapper string"
    source = pages.select("host", "html")
    constant = constant_texts(source)
    known = constant.select("text").distinct().limit(max(0, MAX_CONSTANTS) + 1).toPandas()["text"]
    if len(known) <= MAX_CONSTANTS:
        shared = Shared(spark, known.to_numpy(np.int64))
        parts = source.mapInArrow(_infer(lambda: frozenset(shared.load().tolist())), schema)
    else:
        places = source.mapInArrow(_places, "host string, template long, place long").distinct()
        of_template = places.join(constant, "place").groupBy("host", "template").agg(F.collect_set("text").alias("constant"))
        parts = with_template(source).join(of_template, ["host", "template"], "left").select("host", "html", "constant").mapInArrow(_infer(None), schema)
    dealt = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(n)))
    once = dealt.repartition(n, "host", "template", "salt").sortWithinPartitions("host", "template", "salt", "wrapper").select("host", "template", "wrapper").mapInArrow(_merge, schema)
    return once.repartition(n, "host", "template").sortWithinPartitions("host", "template", "wrapper").mapInArrow(_merge, schema)


def _places(batches):
    """(host, template, place) of each path that a page has."""
    for b in _some(batches):
        seen = set()
        for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
            page = blocks(html)
            seen |= {(host, skeleton(page), _hash(_place(host, x))) for x in page}
        yield pa.record_batch([pa.array([s[k] for s in seen], (pa.string(), pa.int64(), pa.int64())[k]) for k in range(3)], names=["host", "template", "place"])


def with_template(pages: DataFrame, html: str = "html", name: str = "template") -> DataFrame:
    """`pages` with the number of each page's template."""
    at = pages.columns.index(html)

    def run(batches):
        for b in _some(batches):
            yield pa.record_batch([*b.columns, pa.array([skeleton(blocks(t)) for t in b.column(at).to_pylist()], pa.int64())], names=[*b.schema.names, name])

    return pages.mapInArrow(run, pages.withColumn(name, F.lit(None).cast("long")).schema)


#: Wrappers of up to so many characters in all are broadcast; beyond that pages are joined with theirs.
MAX_BROADCAST = 64_000_000


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """`pages` with text and n_chars: the article of each page, its blocks joined by line breaks.

    A null or empty page gives an empty text; pages without a host are taken as one host. Character references
    are decoded and white space inside a block is one space. Columns of these names are replaced, all others
    stay. Repeated rows have equal texts; an empty table stays empty.
    """
    source = pages.drop("text", "n_chars")
    hosts = F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", ""), F.lit(""))
    wrappers = save(infer_wrappers(pages.select(hosts.alias("host"), F.col(html).cast("string").alias("html"))), "wrappers")
    size = wrappers.agg(F.sum(F.length("host") + F.length("wrapper"))).first()[0] or 0
    schema = source.withColumns({"text": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")}).schema
    tagged = source.withColumn("_quill_host", hosts)

    def rows(b, extractor):
        texts, html_at = [], b.schema.names.index(html)
        for i, (host, p) in enumerate(zip(b.column("_quill_host").to_pylist(), b.column(html_at).to_pylist())):
            page = blocks(p)
            texts.append(extractor(host, skeleton(page), i).text(page) if page else "")
        keep = [b.column(i) for i in range(len(schema.names) - 2)]
        return pa.record_batch([*keep, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    if size <= MAX_BROADCAST:
        shared = Shared(pages.sparkSession, {(r["host"], r["template"]): r["wrapper"] for r in wrappers.toLocalIterator()})

        def run(batches):
            known, made = shared.load(), {}

            def extractor(host, template, _):
                if (host, template) not in made:
                    if len(made) > 1000:
                        made.clear()
                    made[host, template] = Extractor(Wrapper.load(known[host, template]), host)
                return made[host, template]

            for b in _some(batches):
                yield rows(b, extractor)

        return tagged.mapInArrow(run, schema)

    def run_joined(batches):
        for b in _some(batches):
            wrapper, made = b.column("_quill_wrapper"), {}

            def extractor(host, template, i):
                if (host, template) not in made:
                    made[host, template] = Extractor(Wrapper.load(wrapper[i].as_py()), host)
                return made[host, template]

            yield rows(b, extractor)

    named = wrappers.select(F.col("host").alias("_quill_host"), F.col("template").alias("_quill_template"), F.col("wrapper").alias("_quill_wrapper"))
    joined = with_template(tagged, html, "_quill_template").join(named, ["_quill_host", "_quill_template"])
    return joined.select(*source.columns, "_quill_host", "_quill_wrapper").mapInArrow(run_joined, schema)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
