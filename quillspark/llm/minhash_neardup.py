"""MinHash near-dedup by a signature-coordinate inverted join.

Documents are posted under coordinate-value pairs of their MinHash signature. In one order of all pairs, two
documents that agree on at least `t` of `k` coordinates have one of their first k - t + 1 pairs in common (the
prefix), so only those are posted. Pairs that stand in very many documents, such as those of a shared notice, come
last in that order, so that only documents that hardly have others are posted under them. A list counts the agreeing
coordinates of its members; two documents are merged at the first list in which they meet and skipped in later ones.
Those above the match threshold tie their documents into clusters; inside a cluster every pair is confirmed on the
full shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, PACKED, Forest, Shared, WordHashes, mix, pack, partitions, runs, save, shingle_hashes, unpack
from .components import components

#: Documents in one block of a cluster.
CELL = 256
#: Members of a list from which on its coordinate-value pair comes last in the order; more where a corpus would have more than MAX_HOT such pairs.
HOT_LIST = 8192
MAX_HOT = 1_000_000
#: Members of a list that are still compared in one task; longer ones that are not hot are compared over cells too.
LONG_LIST = 8192


def match_threshold(k: int, similarity: float, miss: float = 1e-4) -> int:
    """The largest t for which a pair of this similarity has fewer than t of k equal coordinates with probability at most `miss`."""
    below, t = 0.0, 0
    while True:
        below += math.comb(k, t) * similarity**t * (1 - similarity) ** (k - t)
        if below > miss:
            return max(1, t)
        t += 1


def multipliers(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of k hash functions, from a fixed rule."""
    x = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:k] | np.uint64(1), x[k:]


def word_set(text: str | None, n: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text, lower-cased for A-Z; words are runs without ASCII white space."""
    if not text:
        return np.zeros(0, np.uint64)
    return np.unique(shingle_hashes(words.of(text.encode("utf-8", "surrogatepass").translate(LOWER).split()), n))


def signature(s: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The upper half of the least value of each hash function over a set."""
    out = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 8192):
        np.minimum(out, (s[i : i + 8192, None] * mul + add).min(0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, n: int, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_key, sig) of every document; set_key and sig are null for an empty set."""

    def run(batches):
        words, (mul, add) = WordHashes(), multipliers(k)
        for b in batches:
            sizes, keys, sigs = [], [], []
            for t in b.column("text"):
                s = word_set(t.as_py(), n, words)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s, mul, add).tobytes() if len(s) else None)
            yield pa.record_batch([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sig"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary")


def _pair_keys(sig: np.ndarray) -> np.ndarray:
    """(documents, coordinates) 64-bit keys of coordinate-value pairs."""
    return mix(sig.astype(np.uint64) * np.uint64(256) + np.arange(sig.shape[1], dtype=np.uint64))


def _signatures_of(batch, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u4").reshape(-1, k), batch.column("doc_id").to_numpy(zero_copy_only=False)


def hot_pairs(sigs: DataFrame, k: int) -> np.ndarray:
    """Sorted keys of the coordinate-value pairs of more than about HOT_LIST documents.

    Each batch counts all of its pairs and passes on those that are frequent in it; a pair that is missed only makes
    a list longer. At most MAX_HOT keys reach the driver.
    """
    n = sigs.count()
    most = max(HOT_LIST, k * n // MAX_HOT)
    share = most / max(1, n) / 2

    def count(batches):
        for b in batches:
            if b.num_rows:
                key, size = np.unique(_pair_keys(_signatures_of(b, k)[0]), return_counts=True)
                often = size >= max(2, share * b.num_rows)
                yield pa.record_batch([pa.array(key[often].view(np.int64), pa.int64()), pa.array(size[often], pa.int64())], names=["key", "n"])

    if n <= most:
        return np.zeros(0, np.uint64)
    rows = sigs.select("doc_id", "sig").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    return np.sort(np.array([r["key"] for r in rows.select("key").toLocalIterator()], np.int64).view(np.uint64))


def _prefix(sig: np.ndarray, prefix: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, coordinates of the prefix, and which coordinates are hot, of each document."""
    keys = _pair_keys(sig)
    is_hot = hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys if len(hot) else np.zeros(keys.shape, bool)
    return keys, np.argsort(is_hot, 1, kind="stable")[:, :prefix], is_hot


def _post(k: int, prefix: int, buckets: int, hot):
    record = np.dtype([("key", "<u8"), ("doc", "<i8"), ("sig", "<u4", (k,)), ("at", "<u1"), ("hot", "?", (k,))])

    def post(batches):
        known = hot.load()
        for b in batches:
            if not b.num_rows:
                continue
            sig, doc = _signatures_of(b, k)
            keys, first, is_hot = _prefix(sig, prefix, known)
            rows, at = np.repeat(np.arange(len(doc)), prefix), first.ravel()
            cold = ~is_hot[rows, at]
            rows, at = rows[cold], at[cold]
            out = np.empty(len(rows), record)
            out["key"], out["doc"], out["sig"], out["at"], out["hot"] = keys[rows, at], doc[rows], sig[rows], at, is_hot[rows]
            yield pack(out, out["key"], buckets)

    def post_hot(batches):
        known = hot.load()
        for b in batches:
            if not b.num_rows:
                continue
            sig, doc = _signatures_of(b, k)
            keys, first, is_hot = _prefix(sig, prefix, known)
            rows, at = np.repeat(np.arange(len(doc)), prefix), first.ravel()
            warm = is_hot[rows, at]
            rows, at = rows[warm], at[warm]
            yield pa.record_batch([pa.array(keys[rows, at].view(np.int64), pa.int64()), pa.array(doc[rows], pa.int64()), pa.array([sig[r].tobytes() for r in rows], pa.binary())], names=["cluster", "doc_id", "sig"])

    return post, post_hot, record


def _merge(k: int, t: int, record):
    """Pairs of the lists of a partition, as the edges of a spanning forest of each list; the members of long lists come back as (key, document, signature)."""
    longest = LONG_LIST

    def edges(r: np.ndarray):
        starts, ends = runs(r["key"])
        size = ends - starts
        # coordinates that come before a record's own in the order; only lists of pairs that are not hot are here
        before = ~r["hot"] & (np.arange(k)[None] < r["at"][:, None])
        for m in np.unique(size[(size > 1) & (size <= 24)]):  # all lists of one size together
            s = starts[size == m]
            p, q = np.triu_indices(int(m), 1)
            step = max(1, 200_000 // len(p))
            for c in range(0, len(s), step):
                at = s[c : c + step, None]
                i, j = (at + p).ravel(), (at + q).ravel()
                same = r["sig"][i] == r["sig"][j]
                ok = (same.sum(1) >= t) & ~(same & before[i]).any(1)
                yield from zip(r["doc"][i[ok]].tolist(), r["doc"][j[ok]].tolist())
        for s, e in zip(starts[size > 24], ends[size > 24]):
            sig, doc, early_at = r["sig"][s:e], r["doc"][s:e].tolist(), before[s:e]
            tree = np.arange(len(doc))
            for i in range(len(doc) - 1):  # members of one tree needn't be compared any more
                j = np.flatnonzero(tree[i + 1 :] != tree[i]) + i + 1
                if not len(j):
                    continue
                same = sig[j] == sig[i]
                near = same.sum(1) >= t
                if near.any():
                    early = (same[near] & early_at[i]).any(1)
                    j = j[near]
                    yield from ((doc[i], doc[x]) for x in j[~early])
                    tree[np.isin(tree, tree[j])] = tree[i]

    def merge(batches):
        r = unpack(batches, record)
        r = r[np.argsort(r["key"], kind="stable")]
        starts, ends = runs(r["key"])
        long = np.repeat(ends - starts > longest, ends - starts)
        for at in np.split(np.flatnonzero(long), np.arange(20_000, int(long.sum()), 20_000)):
            some = r[at]
            yield pa.record_batch([pa.array(some["key"].view(np.int64)), pa.array(some["doc"].astype(np.int64)), pa.array([s.tobytes() for s in some["sig"]], pa.binary())], names=["a", "b", "sig"])
        a, b, seen = [], [], Forest()
        for x, y in edges(r[~long]):
            if x != y and seen.join(x, y):
                a.append(x)
                b.append(y)
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.binary())], names=["a", "b", "sig"])

    return merge


def candidates(sigs: DataFrame, k: int, t: int) -> DataFrame:
    """Links (a, b) that connect whatever pairs agree on at least t of k coordinates."""
    spark = sigs.sparkSession
    n = partitions(spark)
    found = hot_pairs(sigs, k)
    hot = Shared(spark, found)
    post, post_hot, record = _post(k, k - t + 1, 4 * n, hot)
    source = sigs.select("doc_id", "sig")
    merged = save(source.mapInArrow(post, PACKED).repartitionById(n, F.col("bucket")).mapInArrow(_merge(k, t, record), "a long, b long, sig binary"), "merged")
    out, long = merged.where("sig is null").select("a", "b"), merged.where("sig is not null").select(F.col("a").alias("cluster"), F.col("b").alias("doc_id"), "sig")
    if not len(found) and long.isEmpty():
        return out
    posted = save(source.mapInArrow(post_hot, "cluster long, doc_id long, sig binary").unionByName(long), "hot")
    sizes = posted.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("first"))
    return out.unionByName(linked(save(posted.join(sizes, "cluster"), "hotlists"), "sig", _agreeing(t), HOT_CELL))


#: Signatures in one block of a hot list.
HOT_CELL = 2048


def _agreeing(t: int):
    """Which pairs of two lists of signatures, or of one with itself, agree on at least t coordinates."""

    def ok(left: list[bytes], right: list[bytes] | None) -> np.ndarray:
        a = np.array([np.frombuffer(s, "<u4") for s in left])
        b = a if right is None else np.array([np.frombuffer(s, "<u4") for s in right])
        both = np.zeros((len(a), len(b)), np.uint8)
        for i in range(a.shape[1]):
            both += a[:, i, None] == b[None, :, i]
        return both >= t

    return ok


def _pairs(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None) -> np.ndarray:
    """Intersection sizes of all pairs of two blocks of sets, or of one block with itself."""
    both = sets_a + (sets_b or [])
    size = [len(s) for s in both]
    flat = np.concatenate(both)
    row = np.repeat(np.arange(len(both)), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    starts, ends = runs(flat)
    keep = ends - starts > 1  # others are in no intersection
    column = np.repeat(np.cumsum(keep) - 1, ends - starts)
    of = np.repeat(keep, ends - starts)
    row, column = row[of], column[of]
    na = len(sets_a)
    out = np.zeros((na, len(sets_b) if sets_b else na), np.float64)
    wide = 4096
    cut = np.searchsorted(column, np.arange(0, int(keep.sum()) + wide, wide))
    for c, (lo, hi) in enumerate(zip(cut[:-1], cut[1:])):
        if hi > lo:
            x = np.zeros((len(both), wide), np.float32)
            x[row[lo:hi], column[lo:hi] - c * wide] = 1
            out += x[:na] @ (x[na:] if sets_b else x[:na]).T
    return out


def _similar(percent: int):
    """Which pairs of two lists of shingle sets, or of one with itself, have 100 * intersection >= percent * union."""

    def ok(left: list[bytes], right: list[bytes] | None) -> np.ndarray:
        sets = [np.frombuffer(s, "<u8") for s in left]
        others = sets if right is None else [np.frombuffer(s, "<u8") for s in right]
        na, nb = (np.array([len(s) for s in x]) for x in (sets, others))
        if len(sets) * len(others) == 1 or (right is None and len(sets) == 2):
            both = np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in others] for x in sets])
        else:
            both = _pairs(sets, None if right is None else others)
        return 100 * both >= percent * (na[:, None] + nb[None] - both)

    return ok


def _confirm(similar, most: int):
    """Links of the block pairs of clusters, as edges of a spanning forest; the last column but one is what is compared. most: rows compared at once."""

    def edges(ok: np.ndarray, a: list, b: list, forest: Forest):
        for i, j in zip(*np.nonzero(ok)):
            if a[i] != b[j] and forest.join(a[i], b[j]):
                yield a[i], b[j]

    def links(cell: list[tuple]):
        left = [(d, s) for d, side, s in cell if side != 1]
        right = [(d, s) for d, side, s in cell if side == 1]
        if not left or (cell[0][1] != 2 and not right):
            return
        forest = Forest()
        if not right and len(left) <= most:
            names = [d for d, _ in left]
            yield from edges(np.triu(similar([s for _, s in left], None), 1), names, names, forest)
            return
        for i in range(0, len(left), most):
            for j in range(0 if right else i, len(right or left), most):
                p, q = left[i : i + most], (right or left)[j : j + most]
                yield from edges(similar([s for _, s in p], [s for _, s in q]), [d for d, _ in p], [d for d, _ in q], forest)

    def confirm(batches):
        key, cell, a, b = None, [], [], []
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(6))
            for cluster, x, y, side, doc, s in zip(*columns):
                if (cluster, x, y) != key:
                    for p, q in links(cell):
                        a.append(p)
                        b.append(q)
                    key, cell = (cluster, x, y), []
                cell.append((doc, side, s))
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
        for p, q in links(cell):
            a.append(p)
            b.append(q)
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return confirm


def _with_hub(similar):
    """Links of documents with the hub of their cluster."""

    def run(batches):
        for batch in batches:
            hub, h, doc, s, cluster = (batch.column(i).to_pylist() for i in range(5))
            near = [i for i in range(len(doc)) if hub[i] != doc[i] and similar([h[i]], [s[i]])[0, 0]]
            yield pa.record_batch([pa.array([c[i] for i in near], pa.int64()) for c in (hub, doc, cluster)], names=["a", "b", "cluster"])

    return run


def linked(members: DataFrame, what: str, similar, cell: int) -> DataFrame:
    """Links (a, b) that connect all similar pairs of each cluster of `members` (cluster, doc_id, size, first, what).

    size and first: how many members the cluster has, and the smallest doc_id of them.

    In a cluster of more than one block of about `cell` documents, each is first compared with the cluster's hub,
    its smallest id. Documents that link with the hub are of one component and need no comparison among
    themselves; the others are compared with one another and with those. These comparisons are dealt over cells,
    one for each pair of blocks, so no task holds more than two blocks.
    """
    parts = partitions(members.sparkSession)
    blocks = F.ceil(F.col("size") / cell)
    large = members.where(F.col("size") > cell).withColumn("salt", F.pmod(F.xxhash64("doc_id"), blocks))
    hubs = members.where((F.col("size") > cell) & (F.col("doc_id") == F.col("first"))).select("cluster", F.col(what).alias("hub"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("salt"))
    pairs = large.join(hubs.dropDuplicates(["cluster", "salt"]), ["cluster", "salt"]).select("first", "hub", "doc_id", what, "cluster")
    found = save(pairs.mapInArrow(_with_hub(similar), "a long, b long, cluster long"), "hublinks")
    settled = found.select("cluster", F.col("b").alias("doc_id"), F.lit(True).alias("settled")).distinct()
    marked = members.join(settled, ["cluster", "doc_id"], "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    shares = marked.groupBy("cluster").agg(F.ceil(F.count_if(~F.col("settled")) / cell).cast("int").alias("open"), F.ceil(F.count_if("settled") / cell).cast("int").alias("shut"))
    placed = marked.join(shares, "cluster")
    block = F.when(F.col("settled"), F.col("open") + F.pmod(F.xxhash64("doc_id"), F.col("shut"))).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("open"))).cast("int")
    # open blocks meet all blocks, settled ones only the open blocks
    others = F.when(F.col("settled"), F.sequence(F.lit(0), F.col("open") - 1)).otherwise(F.sequence(F.lit(0), F.col("open") + F.col("shut") - 1))
    cells = placed.where("open > 0").withColumn("block", block).select("doc_id", what, "cluster", "block", F.explode(others).alias("other"))
    cells = cells.select(
        "cluster",
        F.least("block", "other").alias("x"),
        F.greatest("block", "other").alias("y"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"),
        "doc_id",
        what,
    )
    rest = cells.repartition(parts, "cluster", "x", "y").sortWithinPartitions("cluster", "x", "y", "side", "doc_id").mapInArrow(_confirm(similar, 2 * cell), "a long, b long")
    return found.select("a", "b").unionByName(rest)


def confirmed(docs: DataFrame, clusters: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) that connect all pairs of a cluster whose full shingle sets are similar enough.

    docs: doc_id, text. clusters: id, component.
    """

    def sets(batches):
        words = WordHashes()
        for b in batches:
            got = [word_set(t.as_py(), n, words).tobytes() for t in b.column("text")]
            yield pa.record_batch([*b.columns[:4], pa.array(got, pa.binary())], names=["cluster", "doc_id", "size", "first", "shingles"])

    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"))
    named = clusters.join(sizes, "component").select(F.col("id").alias("doc_id"), F.col("component").alias("cluster"), "size", "first")
    # merge: the same plan at every size, whatever the number of clusters
    got = docs.join(named.hint("merge"), "doc_id").select("cluster", "doc_id", "size", "first", "text")
    got = save(got.mapInArrow(sets, "cluster long, doc_id long, size long, first long, shingles binary"), "shingles")
    return linked(got, "shingles", _similar(percent), CELL)


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, k: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Documents link when 100 * intersection >= percent * union of their n-word shingle sets. component_id is the
    smallest doc_id reachable by links, itself included; kept is doc_id = component_id. A null, empty or
    wordless text has an empty set and links with nothing. Documents with equal sets are one node from the
    start, so a group of copies of any size costs one signature. A doc_id that occurs in several rows gives as
    many result rows. A row without doc_id shows the group of an equal set, but names and links none; its kept is
    null. Extra columns of `docs` are ignored.
    """
    t = match_threshold(k, percent / 100)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sigs = save(signatures(source, n, k), "signatures")
    sets = save(sigs.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "sets")
    clusters = save(components(candidates(sets.select(F.col("rep").alias("doc_id"), "sig"), k, t)), "clusters")
    links = confirmed(source.where("doc_id is not null"), clusters, n, percent)
    labels = components(links)
    named = sets.join(labels, sets.rep == labels.id, "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    out = sigs.drop("sig").join(named, "set_key", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def deduplicate(docs: DataFrame, n: int = 5, percent: int = 80, k: int = 24) -> DataFrame:
    """`docs` without the documents that are not the first of their group; all columns stay.

    Rows without doc_id stay, as do all rows that repeat a kept doc_id.
    """
    gone = near_duplicates(docs, n, percent, k).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti")


def op9_minhash_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=85)


#: Shared shingles of different sets, and components by following links.
OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM w),
sets AS MATERIALIZED (SELECT list_sort(s) AS s, len(s) AS n, min(doc_id) AS rep FROM s WHERE len(s) > 0 GROUP BY s),
t AS MATERIALIZED (SELECT rep, n, unnest(s) AS g FROM sets),
links AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.g = b.g AND a.rep <> b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT rep, rep AS id FROM sets UNION SELECT r.rep, l.b FROM reach r JOIN links l ON r.id = l.a),
named AS (SELECT sets.s, min(reach.id) AS component_id FROM sets JOIN reach USING (rep) GROUP BY sets.s)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id, coalesce(c.component_id, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN named c ON len(s.s) > 0 AND list_sort(s.s) = c.s
"""
