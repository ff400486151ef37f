"""Removal of repeated 100-byte strings with two-stage suffix sorting.

Every window of `WINDOW` bytes has an anchor: the `GRAM`-byte string in it with the least hash, the leftmost of
equals. Equal windows have equal anchors, so windows are compared only among the segments that share one. A
segment is the run of windows that one anchor occurrence governs. Segments with equal bytes are settled by
their hash (64 bits, next to over 32 of their anchor's); where segments of one anchor differ, their bytes are gathered and a suffix array is built in two
stages: suffixes smaller than their successors are sorted directly, the others are induced by scanning the
buckets of first bytes. Adjacent common prefixes of at least `WINDOW` bytes give the remaining repeats.

An anchor of more than `HOT` different segments, such as a phrase of a notice that stands in countless documents,
is not gathered in one task: the windows of its segments are aggregated by a 128-bit hash of their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, partitions, runs, save

WINDOW = 100
GRAM = 32
#: Windows handled at once; anchors never span such blocks, which changes segments but no result.
BLOCK = 1 << 22
#: Different segments of one anchor that are still gathered in one task.
HOT = 20_000

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_MUL = np.uint64(0x9E3779B97F4A7C15)
_POS = np.uint64((1 << 26) - 1)
#: Never part of UTF-8.
_SEPARATOR = 0xFF


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of each GRAM bytes, by doubling."""
    h, n, power = _BYTE[b], 1, int(_MUL)
    while n < GRAM:
        h = h[:-n] * np.uint64(power) + h[n:]
        n, power = 2 * n, power * power % 2**64
    return mix(h)


def segments(b: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hashes, first window starts and byte lengths of the segments of a text, in order."""
    out = []
    for at in range(0, max(0, len(b) - window + 1), BLOCK):
        part = b[at : at + BLOCK + window - 1]
        h = gram_hashes(part)
        m = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
        width, grams = 1, window - GRAM + 1
        while 2 * width <= grams:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < grams:
            m = np.minimum(m[: -(grams - width)], m[grams - width :])
        where = (m & _POS).astype(np.int64)
        starts, ends = runs(where)
        out.append((h[where[starts]], starts + at, ends - starts + window - 1))
    if not out:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z
    return tuple(np.concatenate(x) for x in zip(*out))


def suffix_array(t: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Suffixes of `t` in the order of their first `depth` bytes; those that agree there may stand in any order.

    A shorter suffix that is a prefix of a longer one comes first.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    changes = np.flatnonzero(t[:-1] != t[1:])
    at = np.searchsorted(changes, np.arange(n))
    inside = at < len(changes)
    smaller = np.zeros(n, bool)  # than the successor; the last suffix's successor is the empty one
    c = changes[at[inside]]
    smaller[inside] = t[c] < t[c + 1]
    direct = _sort_directly(t, np.flatnonzero(smaller), depth)
    cuts = np.searchsorted(t[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[t[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        parts = induced[c]
        new = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        bucket = [new]
        while len(new):  # runs of the byte itself
            new = new[new > 0] - 1
            new = new[t[new] == c]
            bucket.append(new)
        bucket.append(direct[cuts[c] : cuts[c + 1]])
        bucket = np.concatenate(bucket)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[t[before] > c]
        if len(before):
            first = t[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            for s, e in zip(*runs(first)):
                induced[first[s]].append(before[s:e])
    return np.concatenate(out)


def _words(t: np.ndarray, depth: int) -> np.ndarray:
    """The 8 bytes from each position as one number, padded at the end."""
    w = np.pad(t, (0, depth + 16)).astype(np.uint64)
    for k in (1, 2, 4):
        w = w[:-k] << np.uint64(8 * k) | w[k:]
    return w


def _sort_directly(t: np.ndarray, pos: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by 8 bytes at a time; from the second pass on only those still tied."""
    if not len(pos):
        return pos
    w = _words(t, depth)
    n = len(t)
    out = pos[np.argsort(w[pos], kind="stable")]
    key = w[out]
    group = np.cumsum(np.r_[False, key[1:] != key[:-1]])
    where = np.arange(len(out))
    for d in range(8, depth, 8):
        size = np.bincount(group)
        tied = size[group] > 1
        where, group = where[tied], group[tied]
        if not len(where):
            break
        p = out[where]
        key = w[np.minimum(p + d, n)]
        order = np.lexsort((key, group))
        out[where] = p[order]
        key, group = key[order], group[order]
        group = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
    return out


def repeated_windows(texts: list[bytes], docs: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of the windows of some segments that also start earlier in one of them.

    texts: the segments' bytes; docs and starts: where each stands. Earlier: in a smaller document, or sooner in
    the same one.
    """
    t = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    size = np.array([len(x) for x in texts])
    begin = np.cumsum(size + 1) - size - 1
    segment = np.repeat(np.arange(len(texts)), size + 1)
    offset = np.arange(len(t)) - begin[segment]
    sa = suffix_array(t, window)
    sa = sa[offset[sa] <= size[segment[sa]] - window]
    if len(sa) < 2:
        z = np.zeros(0, np.int64)
        return z, z
    w = _words(t, window)
    same = np.arange(1, len(sa))  # entries whose common prefix with the one before reaches the window
    for d in [*range(0, window - 7, 8), *([window - 8] if window % 8 else [])]:
        same = same[w[sa[same] + d] == w[sa[same - 1] + d]]
    new = np.ones(len(sa), bool)
    new[same] = False
    group = np.cumsum(new)
    where = np.flatnonzero(~new)
    where = np.union1d(where, where - 1)
    sa, group = sa[where], group[where]
    doc, start = docs[segment[sa]], starts[segment[sa]] + offset[sa]
    order = np.lexsort((start, doc, group))
    doc, start, group = doc[order], start[order], group[order]
    first, ends = runs(group)
    head = np.repeat(first, ends - first)
    later = (doc != doc[head]) | (start != start[head])
    return doc[later], start[later]


_SPANS = "bucket int, blob binary, doc_id long, spans binary"
_FOUND = "doc_id long, spans binary, wanted binary, hot binary"
_ANCHOR = np.dtype([("h", "<u4"), ("seg", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("len", "<u2")])
_WANTED = np.dtype([("at", "<u4"), ("len", "<u2"), ("h", "<u8")])
_WIDTH = 2 * WINDOW - GRAM
_SEGMENT = np.dtype([("doc", "<i8"), ("at", "<u4"), ("len", "<u2"), ("text", "u1", (_WIDTH,))])


def _by_doc(doc: np.ndarray, values: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Values grouped by document, as bytes."""
    order = np.argsort(doc, kind="stable")
    doc, values = doc[order], values[order]
    s, e = runs(doc)
    return doc[s].tolist(), [values[i:j].tobytes() for i, j in zip(s, e)]


def _spans(at: np.ndarray, size) -> np.ndarray:
    """(n, 2) starts and ends as 32-bit numbers."""
    return np.stack([at, at + size], 1).astype("<u4")


def _anchor(buckets: int):
    """Anchors of a batch of documents; repeats of a whole segment within the batch are settled at once."""

    def run(batches):
        for b in batches:
            hs, segs, docs, ats, lens = [], [], [], [], []
            rows = sorted((d, i) for i, d in enumerate(b.column("doc_id").to_pylist()) if d is not None)
            texts = b.column("text")
            for d, i in rows:
                raw = texts[i].as_py()
                raw = raw.encode("utf-8", "surrogatepass") if raw else b""
                if len(raw) < WINDOW:
                    continue
                h, at, size = segments(np.frombuffer(raw, np.uint8))
                view = memoryview(raw)
                digest = xxhash.xxh3_64_intdigest
                segs.append(np.fromiter((digest(view[s:e]) for s, e in zip(at.tolist(), (at + size).tolist())), np.uint64, len(at)))
                hs.append(h)
                ats.append(at)
                lens.append(size)
                docs.append(np.full(len(at), d, np.int64))
            if not hs:
                continue
            h, seg, doc, at, size = (np.concatenate(x) for x in (hs, segs, docs, ats, lens))
            order = np.argsort(mix(h + mix(seg)), kind="stable")
            h, seg, doc, at, size = (x[order] for x in (h, seg, doc, at, size))
            first, ends = runs(np.cumsum(np.r_[True, (h[1:] != h[:-1]) | (seg[1:] != seg[:-1])]))
            head = np.repeat(first, ends - first)  # the earliest, as documents and starts came in order
            again = (doc != doc[head]) | (at != at[head])  # rows that repeat a document are no repeats in it
            ids, blobs = _by_doc(doc[again], _spans(at[again], size[again]))
            h, seg, doc, at, size = (x[first] for x in (h, seg, doc, at, size))
            bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            r = np.empty(len(h), _ANCHOR)
            r["h"], r["seg"], r["doc"], r["at"], r["len"] = h & np.uint64(0xFFFFFFFF), seg, doc, at, size
            order = np.argsort(bucket, kind="stable")
            bucket, r = bucket[order], r[order]
            s, e = runs(bucket)
            n, m = len(s), len(ids)
            yield pa.record_batch(
                [
                    pa.array(bucket[s].tolist() + [x % buckets for x in ids], pa.int32()),
                    pa.array([r[i:j].tobytes() for i, j in zip(s, e)] + [None] * m, pa.binary()),
                    pa.array([None] * n + ids, pa.int64()),
                    pa.array([None] * n + blobs, pa.binary()),
                ],
                names=["bucket", "blob", "doc_id", "spans"],
            )

    return run


def _settle(batches, most: int):
    """Repeats of whole segments, and the segments that must be compared by their bytes, those of hot anchors apart."""
    parts: dict[int, list[np.ndarray]] = {}

    def batch(*rows):
        """rows: lists of (ids, values), one for each kind."""
        ids = [i for kind in rows for i in kind[0]]
        values = [[v if k == at else None for at, kind in enumerate(rows) for v in kind[1]] for k in range(3)]
        return pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(v, pa.binary()) for v in values)], names=["doc_id", "spans", "wanted", "hot"])

    for b in batches:
        ids, spans = [], []
        for bucket, blob, d, s in zip(*(b.column(i).to_pylist() for i in range(4))):
            if blob is not None:
                parts.setdefault(bucket, []).append(np.frombuffer(blob, _ANCHOR))
            else:
                ids.append(d)
                spans.append(s)
        yield batch((ids, spans), ([], []), ([], []))
    for bucket in sorted(parts):
        r = np.concatenate(parts.pop(bucket))
        r = r[np.lexsort((r["at"], r["doc"], r["seg"], r["h"]))]
        anchor = np.r_[True, r["h"][1:] != r["h"][:-1]]
        first = anchor | np.r_[True, r["seg"][1:] != r["seg"][:-1]]
        start, end = runs(np.cumsum(first))
        head = np.repeat(start, end - start)
        again = (r["doc"] != r["doc"][head]) | (r["at"] != r["at"][head])
        heads, of = r[first], np.cumsum(anchor)[first]
        count = np.bincount(of)[of]
        w = np.empty(len(heads), _WANTED)
        w["at"], w["len"], w["h"] = heads["at"], heads["len"], mix(heads["h"].astype(np.uint64) + np.uint64(bucket << 32))
        few, many = (count > 1) & (count <= most), count > most
        yield batch(_by_doc(r["doc"][again], _spans(r["at"][again].astype(np.int64), r["len"][again])), *(_by_doc(heads["doc"][x], w[x]) for x in (few, many)))


def _packed_windows(batches):
    """(doc_id, at) of repeated windows as packed spans."""
    for b in batches:
        ids, blobs = _window_spans(b.column("doc_id").to_numpy(zero_copy_only=False), b.column("at").to_numpy(zero_copy_only=False))
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "spans"])


def _window_spans(doc: np.ndarray, start: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Windows that touch, joined, by document."""
    if not len(doc):
        return [], []
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    near = np.r_[False, (doc[1:] == doc[:-1]) & (start[1:] <= start[:-1] + WINDOW)]
    s, e = runs(np.cumsum(~near))
    return _by_doc(doc[s], np.stack([start[s], start[e - 1] + WINDOW], 1).astype("<u4"))


_GATHERED = "bucket int, blob binary, h binary, doc_id long, at long"


def _gather(buckets: int):
    """The bytes of the wanted segments, packed by anchor; of hot anchors' segments the hash of each window."""

    def run(batches):
        for b in batches:
            got, keys, hashes, docs, ats = [], [], [], [], []
            for d, t, wanted, hot in zip(*(b.column(i).to_pylist() for i in range(4))):
                raw = t.encode("utf-8", "surrogatepass")
                for x in (x for blob in hot for x in np.frombuffer(blob, _WANTED)):
                    at = range(int(x["at"]), min(int(x["at"]) + int(x["len"]), len(raw)) - WINDOW + 1)
                    hashes += [xxhash.xxh3_128_digest(raw[s : s + WINDOW]) for s in at]
                    docs += [d] * len(at)
                    ats += at
                if not wanted:
                    continue
                w = np.concatenate([np.frombuffer(x, _WANTED) for x in wanted])
                w = w[w["at"].astype(np.int64) + w["len"] <= len(raw)]
                r = np.zeros(len(w), _SEGMENT)
                r["doc"], r["at"], r["len"] = d, w["at"], w["len"]
                source = np.pad(np.frombuffer(raw, np.uint8), (0, _WIDTH))
                r["text"] = source[w["at"].astype(np.int64)[:, None] + np.arange(_WIDTH)]
                got.append(r)
                keys.append(w["h"])
            s, blobs = [], []
            if got:
                r, key = np.concatenate(got), np.concatenate(keys)
                bucket = (key % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                bucket, r = bucket[order], r[order]
                first, last = runs(bucket)
                s, blobs = bucket[first].tolist(), [r[i:j].tobytes() for i, j in zip(first, last)]
            n, m = len(s), len(hashes)
            yield pa.record_batch(
                [pa.array(s + [None] * m, pa.int32()), pa.array(blobs + [None] * m, pa.binary()), pa.array([None] * n + hashes, pa.binary()), pa.array([None] * n + docs, pa.int64()), pa.array([None] * n + ats, pa.int64())],
                names=["bucket", "blob", "h", "doc_id", "at"],
            )

    return run


def _compare(batches):
    """Repeats within the gathered segments, bucket by bucket."""
    parts: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("blob").to_pylist()):
            parts.setdefault(bucket, []).append(np.frombuffer(blob, _SEGMENT))
    for bucket in sorted(parts):
        r = np.concatenate(parts.pop(bucket))
        texts = [x[:n].tobytes() for x, n in zip(r["text"], r["len"])]
        doc, start = repeated_windows(texts, r["doc"].astype(np.int64), r["at"].astype(np.int64))
        ids, blobs = _window_spans(doc, start)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "spans"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): for each document with repeated bytes a list of packed spans, which may overlap."""
    n, most = partitions(docs.sparkSession), HOT
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    found = source.mapInArrow(_anchor(4 * n), _SPANS).repartitionById(n, F.col("bucket")).mapInArrow(lambda batches: _settle(batches, most), _FOUND)
    found = save(found, "found")

    lists = found.where("wanted is not null or hot is not null").groupBy("doc_id").agg(F.collect_list("wanted").alias("wanted"), F.collect_list("hot").alias("hot"))
    texts = source.where("text is not null").join(lists.hint("merge"), "doc_id").select("doc_id", "text", "wanted", "hot")
    gathered = save(texts.mapInArrow(_gather(4 * n), _GATHERED), "gathered")
    rest = gathered.where("blob is not null").select("bucket", "blob").repartitionById(n, F.col("bucket")).mapInArrow(_compare, "doc_id long, spans binary")
    windows = gathered.where("h is not null").select("h", "doc_id", "at")
    first = windows.groupBy("h").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = windows.join(first, "h").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("at") != F.col("first.at")))
    both = found.where("spans is not null").select("doc_id", "spans").unionByName(rest).unionByName(later.select("doc_id", "at").mapInArrow(_packed_windows, "doc_id long, spans binary"))
    return both.groupBy("doc_id").agg(F.collect_list("spans").alias("spans"))


def merged(blobs: list[bytes] | None, size: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    if not blobs:
        return []
    s = np.concatenate([np.frombuffer(x, "<u4").reshape(-1, 2) for x in blobs]).astype(np.int64)
    s = s[s[:, 1] <= size]
    if not len(s):
        return []
    s = s[np.argsort(s[:, 0], kind="stable")]
    reach = np.maximum.accumulate(s[:, 1])
    new = np.r_[True, s[1:, 0] > reach[:-1]]
    starts = s[new, 0]
    return list(zip(starts.tolist(), reach[np.r_[np.flatnonzero(new)[1:] - 1, len(s) - 1]].tolist()))


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with text cut, and n_bytes, n_removed, n_spans and kept_sha256 of its UTF-8 bytes.

    Each byte goes that a WINDOW-byte string covers which also starts earlier: in a smaller doc_id, or sooner in
    the same document. All strings are judged on the input. A null text counts as empty and stays null. Where a
    cut splits a character, its remaining bytes are left out of the text, though they count in the digest. Rows
    without doc_id match nothing. doc_id names a document: rows that repeat one with the same text share its
    result, however they are dealt over partitions; rows that repeat one with another text count as further
    versions of it, and what goes from one version goes from the same places of the others. Columns of the new
    names are replaced, all others stay.
    """
    made = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    source = docs.drop(*made)
    spans = repeated_spans(source).select(F.col("doc_id").alias("_quill_doc"), F.col("spans").alias("_quill_spans"))
    joined = source.join(spans.hint("merge"), source["doc_id"].cast("long") == spans["_quill_doc"], "left").drop("_quill_doc")
    at = joined.columns.index("text")
    schema = source.withColumns({k: F.lit(None).cast("string" if k == "kept_sha256" else "long") for k in made}).schema

    def run(batches):
        for b in batches:
            texts, cols = [], [[], [], [], []]
            for t, blobs in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                raw = t.encode("utf-8", "surrogatepass") if t else b""
                found = merged(blobs, len(raw))
                kept = _kept(raw, found)
                texts.append(t if not found else kept.decode("utf-8", "ignore"))
                for c, x in zip(cols, (len(raw), len(raw) - len(kept), len(found), hashlib.sha256(kept).hexdigest())):
                    c.append(x)
            new = [pa.array(c, pa.int64() if i < 3 else pa.string()) for i, c in enumerate(cols)]
            old = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns[:-1])]
            yield pa.record_batch([*old, *new], names=schema.names)

    return joined.mapInArrow(run, schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Every 100-byte window as hexadecimal digits, its first place, and the runs that later ones cover.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 99)) AS i, h FROM d WHERE length(h) >= 200),
x AS MATERIALIZED (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM w),
f AS (SELECT k, min((doc_id, i)) AS first FROM x GROUP BY k HAVING count(*) > 1),
r AS (SELECT x.doc_id, i FROM x JOIN f USING (k) WHERE (x.doc_id, x.i) <> f.first),
o AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, -1) AS fresh FROM r),
g AS (SELECT doc_id, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM o),
spans AS (SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM g GROUP BY doc_id, run),
gaps AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS next FROM spans),
kept AS (SELECT doc_id, sum(e - s) AS removed, count(*) AS n, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
