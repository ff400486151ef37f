"""Benchmark decontamination with a broadcast hash set of the test windows.

Test items become windows of ten normalised words; a document's windows are looked up by hash, verified word by
word, and the words of every hit are marked. Documents or only their marked spans can be removed. A benchmark of
more than `BLOCK_WINDOWS` windows is scanned block by block, with what was found so far in a table in between, so
that driver and workers never hold more than one block.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Shared, drop, save

WINDOW = 10
#: Windows in one broadcast block, about 30 bytes each besides the word list; a larger benchmark is scanned in several blocks.
BLOCK_WINDOWS = 1_000_000
#: Bytes of a text whose words are looked up at once.
BLOCK_BYTES = 1 << 20
#: Lower-cases A-Z and turns every ASCII character but digits and letters into a space.
_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in LOWER)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of digits, letters and non-ASCII characters; none for a null text."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


def _fold(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(at), np.uint64(n))
    for j in range(n):
        h = (h ^ ids[at + j].astype(np.uint64)) * _MUL
        h ^= h >> np.uint64(29)
    return h


class WindowIndex:
    """Windows of some test items: a word list, the items' words in a row, and for each length the sorted hashes, the places and the items of the windows; ids are numbers or texts."""

    def __init__(self, items: list[tuple[int | str | None, list[bytes]]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.window = window
        self.names = sorted({i for i, _ in items if i is not None})
        number = {name: i for i, name in enumerate(self.names)}
        flat, found = [], {}
        at = 0
        for item, words in items:
            if words:
                flat.append(np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words), np.int32, len(words)))
                found.setdefault(min(window, len(words)), []).append((number.get(item), at, len(words)))
                at += len(words)
        self.words = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        self.by_length = {n: self._windows(n, of) for n, of in sorted(found.items())}

    def _windows(self, n: int, of: list[tuple[int | None, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows by hash: hashes, places in the words, and bounds in the list of their items, which is the last."""
        sizes = np.array([k - n + 1 for _, _, k in of])
        place = np.concatenate([np.arange(at, at + k - n + 1) for _, at, k in of])
        item = np.repeat([0 if i is None else i for i, _, _ in of], sizes)
        named = np.repeat([i is not None for i, _, _ in of], sizes)
        h = _fold(self.words.astype(np.int64), place, n)
        rows = np.stack([self.words[place + j] for j in range(n)])
        order = np.lexsort((item, *rows, h))
        h, place, item, named, rows = h[order], place[order], item[order], named[order], rows[:, order]
        new = np.r_[True, (h[1:] != h[:-1]) | (rows[:, 1:] != rows[:, :-1]).any(0)]
        window = np.cumsum(new) - 1
        once = named & (np.r_[True, item[1:] != item[:-1]] | new | np.r_[True, ~named[:-1]])
        bounds = np.r_[0, np.cumsum(np.bincount(window[once], minlength=int(new.sum())))]
        return h[new], place[new], bounds, item[once]

    def ids(self, text: str | None) -> np.ndarray:
        """The words of a text by their numbers, -1 for those of no item; long texts are cut in blocks between words."""
        raw, out, at = text.encode("utf-8", "surrogatepass").translate(_WORDS) if text else b"", [], 0
        while at < len(raw):
            end = raw.find(b" ", at + BLOCK_BYTES) if at + BLOCK_BYTES < len(raw) else -1
            words = raw[at : end if end >= 0 else len(raw)].split()
            out.append(np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words)))
            at = end if end >= 0 else len(raw)
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def scan(self, ids: np.ndarray) -> tuple[list[list[int]], list[int | str]]:
        """Maximal hit runs [start, end) in words, and the sorted items with a hit window."""
        if not len(ids) or not self.by_length:
            return [], []
        unknown = np.r_[0, np.cumsum(ids < 0)]
        starts, ends, items = [], [], set()
        for n, (hashes, place, bounds, of) in self.by_length.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(unknown[n:] == unknown[:-n])
            if not len(at):
                continue
            h = _fold(ids, at, n)
            low = np.searchsorted(hashes, h)
            left = np.arange(len(at))
            while len(left):  # again only for windows whose hash another window has too
                left = left[low[left] < len(hashes)]
                left = left[hashes[low[left]] == h[left]]
                p, q = at[left], place[low[left]]
                same = np.ones(len(left), bool)
                for j in range(n):
                    same &= ids[p + j] == self.words[q + j]
                starts.append(p[same])
                ends.append(p[same] + n)
                for w in np.unique(low[left[same]]):
                    items.update(of[bounds[w] : bounds[w + 1]].tolist())
                left = left[~same]
                low[left] += 1
        s, e = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))
        return _merged(np.stack([s, e], 1).tolist()), [self.names[i] for i in sorted(items)]


def _kind(benchmark: DataFrame) -> str:
    """The kind in which item ids travel: long for whole numbers, else text."""
    return "long" if isinstance(benchmark.schema["item_id"].dataType, T.IntegralType) else "string"


def indexes(benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS):
    """Indexes of the benchmark, block by block; the driver holds one block at a time. Of an item with more windows a block has a part."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast(_kind(benchmark)), F.col("text").cast("string")).toLocalIterator():
        words = words_of(row[1])
        for at in range(0, max(1, len(words) - window + 1), block_windows):
            part = words[at : at + block_windows + window - 1]
            block.append((row[0], part))
            size += max(1, len(part) - window + 1)
            if size >= block_windows:
                yield WindowIndex(block, window)
                block, size = [], 0
    if block:
        yield WindowIndex(block, window)


def _scan(docs: DataFrame, benchmark: DataFrame, names: tuple[str, str, str], window: int, text: str, block_windows: int) -> DataFrame:
    """`docs` with three further columns of the given names, as scan() describes them."""
    kind = _kind(benchmark)
    out = docs.withColumns({names[0]: F.lit(0).cast("long"), names[1]: F.lit(None).cast("array<array<int>>"), names[2]: F.lit(None).cast(f"array<{kind}>")})
    at = out.columns.index(text)
    schema = out.schema
    blocks = indexes(benchmark, window, block_windows)
    index, first = next(blocks, WindowIndex([])), True
    while index is not None:
        shared, index = Shared(docs.sparkSession, index), None

        def run(batches, shared=shared, first=first):
            index = shared.load()
            for b in batches:
                counts, runs, items = [], [], []
                before = repeat(([], [])) if first else zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist())
                for t, (r, i) in zip(b.column(at), before):
                    ids = index.ids(t.as_py())
                    new, found = index.scan(ids)
                    counts.append(len(ids))
                    runs.append(_merged(r + new) if r else new)
                    items.append(sorted({*i, *found}) if i else found)
                made = [pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.int64() if kind == "long" else pa.string()))]
                yield pa.record_batch([*b.columns[:-3], *made], names=b.schema.names)

        scanned = out.mapInArrow(run, schema)
        index = next(blocks, None)
        if index is None:
            return scanned
        before, out, first = out, save(scanned, "scanned"), False
        shared.close()
        drop(before)
    return out


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """`docs` with n_words long, hit_runs array<array<int>> and hit_items, an array of long, or of string where item ids are no whole numbers.

    hit_runs are the maximal runs [start, end) of words inside occurrences of windows; hit_items the sorted ids of
    the items that have a window in the text. An item without an id marks words too, but names none. A null text
    has no words. Columns of these names are replaced; all other columns stay. Repeated rows have equal results,
    and repeated items count once. An empty benchmark hits nothing, an empty table stays empty.
    """
    return _scan(docs.drop("n_words", "hit_runs", "hit_items"), benchmark, ("n_words", "hit_runs", "hit_items"), window, text, block_windows)


def _merged(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(map(list, runs)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def cut(text: str, runs: list[list[int]]) -> str:
    """`text` without the given runs of words; what stands between the words of a run goes too."""
    raw = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in _WORD.finditer(raw.translate(LOWER))]
    kept, at = [], 0
    for s, e in runs:
        kept.append(raw[at : spans[s][0]])
        at = spans[e - 1][1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW, text: str = "text") -> DataFrame:
    """`docs` without contaminated documents, or with remove="spans" without the hit words; the columns stay as they were.

    A null text is never contaminated; a text made of hits alone becomes empty. Columns of any name stay, but for those that begin with _quill_.
    """
    names = ("_quill_n_words", "_quill_hit_runs", "_quill_hit_items")
    marked = _scan(docs.drop(*names), benchmark, names, window, text, BLOCK_WINDOWS)
    if remove == "documents":
        return marked.where(F.size(names[1]) == 0).select(*docs.columns)
    if remove != "spans":
        raise ValueError("remove: documents or spans")
    at = marked.columns.index(text)

    def run(batches):
        for b in batches:
            runs = b.column(b.num_columns - 2).to_pylist()
            new = [cut(t, r) if r else t for t, r in zip(b.column(at).to_pylist(), runs)]
            yield pa.record_batch([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return marked.mapInArrow(run, marked.schema).select(*docs.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    items = F.array_join(F.array_sort(F.transform("hit_items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP2_SQL = r"""
WITH dw AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iat AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM iat),
lengths AS (SELECT DISTINCT n FROM item_windows),
dat AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lengths WHERE len(w) >= n),
doc_windows AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM dat),
hits AS (SELECT d.doc_id, d.i, d.n, t.item_id FROM doc_windows d JOIN item_windows t ON d.n = t.n AND d.win = t.win),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(s) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items t USING (doc_id)
"""
