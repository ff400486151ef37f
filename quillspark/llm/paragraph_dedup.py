"""Substring dedup by paragraph MinHash banding.

Paragraphs are of two kinds. Lines are posted whole by the bands of their MinHash signature; those that collide are
verified by the exact Jaccard similarity of their five-word shingles. For passages inside lines, or over several
lines, the text is also cut into parts where the content itself says so, whatever the lines: before a word whose
three-word hash is the least within `REACH` words either way. A passage that is repeated inside different texts is
therefore cut in the same places, and equal parts meet by their hash. Every word is in a part. Of each component of
links only the first paragraph stays. What is removed then grows over the words before and after it as long as they
are those around the first paragraph, so that a passage goes to its ends, or up to an edited word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, mix, partitions, runs, save, shingle_hashes, word_hashes
from .components import components
from .minhash_neardup import _confirm, _similar, multipliers

SHINGLE = 5
PERCENT = 80
REACH = 5
#: A part of fewer words takes words of the next part in, up to so many; a line of fewer words is compared in parts alone.
PART_WORDS = 8
LINE_WORDS = SHINGLE
#: Paragraphs in one block of a band's list.
CELL = 512
_M = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_TOP = np.uint64(2**64 - 1)


def tune_bands(similarity: float, recall: float = 0.99, rows: int = 4, bands: int = 64) -> tuple[int, int]:
    """(bands, rows) with the fewest postings for which pairs of this similarity collide with at least this probability."""
    fits = [(b, r) for r in range(1, rows + 1) for b in range(1, bands + 1) if 1 - (1 - similarity**r) ** b >= recall]
    if not fits:
        raise ValueError("no banding is that sure")
    return min(fits)


class Paragraphs:
    """The paragraphs of a text: the words' hashes, and word ranges of what is compared.

    `compared` has an even number for each part and an odd one for each line, so neighbours of a kind are 2 apart.
    """

    def __init__(self, text: str | None):
        self.raw = (text or "").encode("utf-8", "surrogatepass")
        self.ids, self.at, self.to = word_hashes(self.raw.translate(LOWER))
        ids, n = self.ids, len(self.ids)
        if not n:
            self.cuts = self.starts = self.ends = self.compared = np.zeros(0, np.int64)
            return
        breaks = np.flatnonzero(np.frombuffer(self.raw, np.uint8) == 10)
        line = np.searchsorted(breaks, self.at)
        lines = np.flatnonzero(np.r_[True, line[1:] != line[:-1], True])
        cut = np.zeros(n, bool)
        cut[0] = True
        if n > 2 * REACH:
            h = np.full(n + 2 * REACH, _TOP)
            h[REACH : REACH + n - 2] = mix(mix(mix(ids[:-2]) * _M + ids[1:-1]) * _M + ids[2:])
            part, width = h, 1  # the least of the next REACH values
            while 2 * width <= REACH:
                part = np.minimum(part[:-width], part[width:])
                width *= 2
            if width < REACH:
                part = np.minimum(part[: width - REACH], part[REACH - width :])
            own = h[REACH : REACH + n]
            cut |= (own < part[:n]) & (own < part[REACH + 1 : REACH + 1 + n])
        self.cuts = np.r_[np.flatnonzero(cut), n]
        ends = np.minimum(np.maximum(self.cuts[1:], self.cuts[:-1] + PART_WORDS), n)
        starts = np.maximum(np.minimum(self.cuts[:-1], ends - PART_WORDS), 0)
        long = np.flatnonzero(lines[1:] - lines[:-1] >= LINE_WORDS)
        self.starts, self.ends = np.r_[starts, lines[long]], np.r_[ends, lines[long + 1]]
        self.compared = np.r_[2 * np.arange(len(starts)), 2 * long + 1]

    def __len__(self):
        return len(self.starts)

    def where(self) -> dict[int, int]:
        """Places in `starts` and `ends` by the numbers in `compared`."""
        return {c: k for k, c in enumerate(self.compared.tolist())}

    def around(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words before, in and after a paragraph; those around it over two parts and three; a passage that went on further would share the part beside it."""
        s, e = self.starts[k], self.ends[k]
        left = self.cuts[max(0, np.searchsorted(self.cuts, s) - 2)]
        right = self.cuts[min(len(self.cuts) - 1, np.searchsorted(self.cuts, e, "right") + 2)]
        return self.ids[left:s], self.ids[s:e], self.ids[e:right]

    def shingles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all five-word windows of the text, and the range of them in each paragraph; those of a line are its own."""
        h = shingle_hashes(self.ids, SHINGLE)
        return h, self.starts, np.maximum(self.ends - SHINGLE + 1, self.starts + 1)


def _ranges(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Bounds for reduceat; only every second of its results is a range's."""
    return np.stack([s, e], 1).ravel()


_ENTRY = np.dtype([("key", "<u4"), ("text", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("band", "<u1"), ("many", "<u1")])
_PLACE = np.dtype([("doc", "<i8"), ("at", "<u4"), ("text", "<u8")])
_POSTED = "bucket int, blob binary, places binary"
_OUT = "doc_id long, at int, node long, key long"


def _post(bands: int, rows: int, buckets: int):
    """Paragraphs by band keys; within a batch a text is posted once, for its first place, and its other places by text alone."""

    def run(batches):
        mul, add = multipliers(bands * rows)
        for b in batches:
            texts, docs, ats, mins = [], [], [], []
            order = sorted((d, i) for i, d in enumerate(b.column("doc_id").to_pylist()) if d is not None)
            column = b.column("text")
            for d, i in order:
                p = Paragraphs(column[i].as_py())
                if not len(p):
                    continue
                h, s, e = p.shingles()
                whole = np.flatnonzero(p.compared & 1)
                low = np.zeros((len(p), bands * rows), np.uint64)
                if len(whole):
                    cuts = _ranges(h, s[whole], e[whole])
                    h = np.r_[h, _TOP]
                    for k in range(bands * rows):
                        low[whole, k] = np.minimum.reduceat(h * mul[k] + add[k], cuts)[::2]
                mins.append(low)
                texts.append(_digest(p))
                docs.append(np.full(len(p), d, np.int64))
                ats.append(p.compared)
            if not texts:
                continue
            text, doc, at, low = (np.concatenate(x) for x in (texts, docs, ats, mins))
            _, first, number = np.unique(text, return_index=True, return_counts=True)
            once = np.zeros(len(text), bool)
            once[first] = True
            many = np.zeros(len(text), np.uint8)
            many[first] = number > 1
            again = np.empty(int((~once).sum()), _PLACE)
            again["doc"], again["at"], again["text"] = doc[~once], at[~once], text[~once]
            parts = []
            line = (at & 1).astype(bool)
            for band in range(bands + 1):  # parts have a band of their own, with the hash of the words for its key
                own = np.flatnonzero(once & (line if band < bands else ~line))
                key = np.full(len(own), np.uint64(band + 1))
                for r in range(rows):
                    key = mix(key * _M + (low[own, band * rows + r] >> np.uint64(16))) if band < bands else mix(text[own])
                part = np.empty(len(own), _ENTRY)
                part["key"], part["text"], part["doc"], part["at"], part["band"], part["many"] = key & np.uint64(0xFFFFFFFF), text[own], doc[own], at[own], band, many[own]
                parts.append((part, ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)))
            entry, bucket = np.concatenate([p for p, _ in parts]), np.concatenate([k for _, k in parts])
            order = np.argsort(bucket, kind="stable")
            entry, bucket = entry[order], bucket[order]
            s, e = runs(bucket)
            buckets_, blobs = bucket[s].tolist(), [entry[i:j].tobytes() for i, j in zip(s, e)]
            places = [again[i : i + 50_000].tobytes() for i in range(0, len(again), 50_000)]
            spread = [int(again["text"][0] + np.uint64(k)) % buckets for k in range(len(places))]
            yield pa.record_batch([pa.array(buckets_ + spread, pa.int32()), pa.array(blobs + [None] * len(places), pa.binary()), pa.array([None] * len(blobs) + places, pa.binary())], names=["bucket", "blob", "places"])

    return run


def _digest(p: Paragraphs) -> np.ndarray:
    """A 64-bit hash of each paragraph's words, in order, and its kind; from one running sum, as paragraphs overlap."""
    n = len(p.ids)
    power, back = (np.cumprod(np.r_[np.uint64(1), np.full(n, x, np.uint64)]) for x in (_M, _BACK))
    total = np.r_[np.uint64(0), np.cumsum(p.ids * power[:n])]
    sums = (total[p.ends] - total[p.starts]) * back[p.starts]
    return mix(mix(sums + (p.ends - p.starts).astype(np.uint64)) + (p.compared & 1).astype(np.uint64))


def _meet(bands: int):
    """Places of texts that occur more than once (key null), and texts that share a band with another text."""

    def batch(doc, at, node, keys):
        return pa.record_batch([pa.array(doc, pa.int64()), pa.array(at.astype(np.int32), pa.int32()), pa.array(node.view("<i8"), pa.int64()), pa.array(keys, pa.int64())], names=["doc_id", "at", "node", "key"])

    def run(batches):
        parts: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for bucket, blob, places in zip(*(b.column(i).to_pylist() for i in range(3))):
                if blob is not None:
                    parts.setdefault(bucket, []).append(np.frombuffer(blob, _ENTRY))
                else:
                    p = np.frombuffer(places, _PLACE)
                    yield batch(np.ascontiguousarray(p["doc"]), p["at"], np.ascontiguousarray(p["text"]), [None] * len(p))
        for bucket in sorted(parts):
            r = np.concatenate(parts.pop(bucket))
            r = r[np.lexsort((r["at"], r["doc"], r["text"], r["key"], r["band"]))]
            band, key, text = r["band"], r["key"], r["text"]
            new_key = np.r_[True, (band[1:] != band[:-1]) | (key[1:] != key[:-1])]
            new_text = new_key | np.r_[True, text[1:] != text[:-1]]
            of = np.cumsum(new_text) - 1
            several = ((np.bincount(of)[of] > 1) | (np.bincount(of, r["many"])[of] > 0)) & (band % bands == 0)
            heads = np.flatnonzero(new_text & (band < bands))
            lists = (np.cumsum(new_key) - 1)[heads]
            mixed = heads[np.bincount(lists)[lists] > 1]
            places = np.flatnonzero(several)
            rows = np.r_[places, mixed]
            name = mix(key[mixed].astype(np.uint64) + (np.uint64(bucket) << np.uint64(40)) + (band[mixed].astype(np.uint64) << np.uint64(32)))
            yield batch(np.ascontiguousarray(r["doc"][rows]), r["at"][rows], np.ascontiguousarray(r["text"][rows]), [None] * len(places) + name.view(np.int64).tolist())

    return run


def _sets(batches):
    """The shingle sets of the wanted paragraphs, one row for each list they are in."""
    for b in batches:
        out: list[list] = [[] for _ in range(7)]
        for d, t, wanted in zip(*(b.column(i).to_pylist() for i in range(3))):
            p = Paragraphs(t)
            h, s, e = p.shingles()
            where = p.where()
            for w in wanted:
                k = where.get(w["at"])
                if k is not None:
                    for c, x in zip(out, (w["key"], w["block"], w["blocks"], w["node"], np.unique(h[s[k] : e[k]]).tobytes())):
                        c.append(x)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["key", "block", "blocks", "node", "shingles"])


def repeated_paragraphs(docs: DataFrame, percent: int = PERCENT, recall: float = 0.99) -> DataFrame:
    """(doc_id, at, first_doc, first_at) of every paragraph that has a near duplicate, and the place of the first of its component.

    Lists of a band are dealt over cells, one for each pair of blocks of about 512 texts.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    bands, rows = tune_bands(percent / 100, recall)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    met = save(source.mapInArrow(_post(bands, rows, 4 * n), _POSTED).repartitionById(n, F.col("bucket")).mapInArrow(_meet(bands), _OUT), "met")
    shared = met.where("key is not null")
    sizes = shared.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("blocks"))
    wanted = shared.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("at", "key", "block", "blocks", "node")).alias("wanted"))
    sets = source.join(wanted.hint("merge"), "doc_id").select("doc_id", "text", "wanted").mapInArrow(_sets, "key long, block int, blocks int, node long, shingles binary")
    cells = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    cells = cells.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), side.alias("side"), "node", "shingles")
    links = cells.repartition(n, "key", "x", "y").sortWithinPartitions("key", "x", "y", "node").mapInArrow(_confirm(_similar(percent), CELL), "a long, b long")
    labels = save(components(links), "labels")
    places = met.where("key is null").select("doc_id", "at", "node").unionByName(shared.join(labels, shared.node == labels.id, "left_semi").select("doc_id", "at", "node")).distinct()
    named = places.join(labels, places.node == labels.id, "left").select("doc_id", "at", F.coalesce("component", "node").alias("class"))
    named = save(named, "places")
    first = named.groupBy("class").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    return named.join(first, "class").select("doc_id", "at", F.col("first.doc_id").alias("first_doc"), F.col("first.at").alias("first_at"))


def _contexts(batches):
    """The words before, in and after the wanted paragraphs; parts are exact copies, so theirs are left out."""
    for b in batches:
        out: list[list] = [[] for _ in range(5)]
        for d, t, wanted in zip(*(b.column(i).to_pylist() for i in range(3))):
            p = Paragraphs(t)
            where = p.where()
            for w in wanted:
                k = where.get(w)
                if k is not None:
                    for c, x in zip(out, (d, w, *(x.tobytes() if i != 1 or w & 1 else b"" for i, x in enumerate(p.around(k))))):
                        c.append(x)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["first_doc", "first_at", "before", "inside", "after"])


def with_contexts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """`found` with the words before, in and after the first paragraph, those around it null where the paragraph beside one has its first beside that first."""
    whole = Window.partitionBy("doc_id", F.col("at") % 2).orderBy("at", "first_doc", "first_at")
    here = F.struct(F.col("at"), F.col("first_doc"), F.col("first_at"))
    beside = lambda other, step: F.coalesce(other["at"] == F.col("at") + step, F.lit(False)) & (other["first_doc"] == F.col("first_doc")) & (other["first_at"] == F.col("first_at") + step)
    later = (F.col("doc_id") != F.col("first_doc")) | (F.col("at") != F.col("first_at"))
    ends = found.withColumn("prior", F.lag(here).over(whole)).withColumn("next", F.lead(here).over(whole))
    ends = ends.select("*", later.alias("later"), (later & ~F.coalesce(beside(F.col("prior"), -2), F.lit(False))).alias("left"), (later & ~F.coalesce(beside(F.col("next"), 2), F.lit(False))).alias("right")).drop("prior", "next")
    ends = save(ends, "ends")
    grown = ends.where("left or right")
    wanted = grown.groupBy(F.col("first_doc").alias("_first")).agg(F.collect_set("first_at").alias("wanted"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    contexts = source.join(wanted.hint("merge"), source.doc_id == F.col("_first")).select("doc_id", "text", "wanted").mapInArrow(_contexts, "first_doc long, first_at int, before binary, inside binary, after binary")
    # rows that repeat a doc_id are one document, so one of their contexts will do
    contexts = contexts.groupBy("first_doc", "first_at").agg(F.min(F.struct("before", "inside", "after")).alias("c"))
    grown = grown.join(contexts, ["first_doc", "first_at"], "left").select(*ends.columns, F.when(F.col("left"), F.col("c.before")).alias("before"), F.col("c.inside").alias("inside"), F.when(F.col("right"), F.col("c.after")).alias("after"))
    rest = ends.where("not (left or right)").select("*", F.lit(None).cast("binary").alias("before"), F.lit(None).cast("binary").alias("inside"), F.lit(None).cast("binary").alias("after"))
    return grown.unionByName(rest).drop("left", "right")


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many first items two arrays share."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    return n if same.all() else int(same.argmin())


def _more(ids: np.ndarray, at: int, first: np.ndarray, there: int) -> int:
    """How many words before `at` are those of the first text before the place where that one has the five words that begin at `at`.

    Of several such places the one nearest to `there` counts: the ends of near copies may be off by some words.
    """
    head = ids[at : at + SHINGLE]
    where = [q for q in np.flatnonzero(first == head[0]).tolist() if np.array_equal(first[q : q + SHINGLE], head)]
    q = min(where, key=lambda x: abs(x - there), default=0)
    return _equal(ids[:at][::-1], first[:q][::-1])


def doomed(p: Paragraphs, gone: list[dict]) -> np.ndarray:
    """Which words go: those of the paragraphs `gone` and equal words around them and their first ones."""
    drop, where = np.zeros(len(p.ids), bool), p.where()
    for g in gone:
        k = where.get(g["at"])
        if k is None:
            continue
        s, e = p.starts[k], p.ends[k]
        before, inside, after = (None if g[x] is None else np.frombuffer(g[x], np.uint64) for x in ("before", "inside", "after"))
        low, high = s, e
        if before is not None:
            low -= _more(p.ids, s, np.r_[before, inside], len(before)) if len(inside) else _equal(p.ids[:s][::-1], before[::-1])
        if after is not None:
            if g["own"] is not None and len(inside):  # words are held against earlier ones alone
                first = where.get(g["own"])
                after = after[: max(0, s - p.ends[first])] if first is not None else after[:0]
            high += _more(p.ids[::-1], len(p.ids) - e, np.r_[inside, after][::-1], len(after)) if len(inside) else _equal(p.ids[e:], after)
        drop[low:high] = True
    return drop


def cut(paragraphs: Paragraphs, drop: np.ndarray) -> str:
    """The text without some words; a line that loses all its words goes with its line break."""
    p, raw = paragraphs, paragraphs.raw
    out, at = [], 0
    for line in raw.split(b"\n"):
        lo, hi = np.searchsorted(p.at, (at, at + len(line)))
        lost = drop[lo:hi]
        if not lost.any():
            out.append(line)
        elif not lost.all():
            out.append(b" ".join(raw[p.at[k] : p.to[k]] for k in range(lo, hi) if not drop[k]))
        at += len(line) + 1
    return b"\n".join(out).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """`docs` with text cut, and n_lines, n_shared, n_removed, source_docs and kept_sha256.

    n_lines counts the lines of the input, n_shared the paragraphs (lines and parts) that have a near duplicate, n_removed those of them that are not the first of
    their component by (doc_id, place); source_docs are the sorted documents where the first ones stand. A null
    text has no lines and stays null. Rows without doc_id share nothing. Rows that repeat a doc_id are taken
    as the same document. Columns of the new names are replaced, all others stay.
    """
    made = {"n_lines": "long", "n_shared": "long", "n_removed": "long", "source_docs": "array<bigint>", "kept_sha256": "string"}
    source = docs.drop(*made)
    found = with_contexts(source, repeated_paragraphs(source, percent))
    later = F.col("later")
    gone = F.struct("at", F.when(F.col("doc_id") == F.col("first_doc"), F.col("first_at")).alias("own"), "before", "inside", "after")
    by_doc = found.groupBy(F.col("doc_id").alias("_quill_doc")).agg(F.count(F.lit(1)).alias("_quill_shared"), F.collect_list(F.when(later, gone)).alias("_quill_gone"), F.array_sort(F.collect_set(F.when(later, F.col("first_doc")))).alias("_quill_sources"))
    joined = source.join(by_doc.hint("merge"), source["doc_id"].cast("long") == by_doc["_quill_doc"], "left").drop("_quill_doc")
    at = joined.columns.index("text")
    schema = source.withColumns({k: F.lit(None).cast(t) for k, t in made.items()}).schema

    def run(batches):
        for b in batches:
            texts, cols = [], [[] for _ in made]
            extra = (b.column(b.num_columns - k).to_pylist() for k in (3, 2, 1))
            for t, shared, gone, sources in zip(b.column(at).to_pylist(), *extra):
                new = t
                if gone and t:
                    p = Paragraphs(t)
                    new = cut(p, doomed(p, gone))
                texts.append(new)
                for c, x in zip(cols, (t.count("\n") + 1 if t else 0, shared or 0, len(gone or []), sources or [], hashlib.sha256((new or "").encode("utf-8", "surrogatepass")).hexdigest())):
                    c.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string())
            old = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns[:-3])]
            yield pa.record_batch([*old, *(pa.array(c, t) for c, t in zip(cols, types))], names=schema.names)

    return joined.mapInArrow(run, schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_lines", "n_shared", "n_removed", "source_docs", "kept_sha256")
