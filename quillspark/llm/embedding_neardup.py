"""Embedding near-dedup by cross-polytope hashing.

A vector is rotated by fast Hadamard transforms with random signs; the coordinate of largest magnitude, with its
sign, is its nearest corner of the cross-polytope. `k` corners make a bucket of a table. Besides its own bucket a
vector is posted to the buckets that the next best corner of each rotation gives (multiprobe). Pairs that meet in a
bucket are verified by their exact cosine. The number of corners follows the largest group of vectors that may
link, so that unrelated vectors seldom meet however many there are, and the number of tables follows the corners
and the dimension, so that pairs at the threshold still meet.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, partitions, runs, save
from .components import components

COSINE = 0.93
#: A pair at the threshold meets in no bucket with about this probability.
MISS = 1e-4
#: Unrelated vectors that a vector may meet on average, over all tables; more corners make them fewer.
STRANGERS = 256
#: Vectors in one block of a bucket.
CELL = 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the number of columns is a power of two."""
    d = x.shape[1]
    h = 1
    while h < d:
        x = x.reshape(-1, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2)
        h *= 2
    return x.reshape(-1, d) / np.sqrt(d)


def padded(d: int) -> int:
    """The number of columns that a vector of d components is padded to."""
    return max(4, 1 << (d - 1).bit_length())


@lru_cache(4096)
def meeting(d: int, k: int, cosine: float) -> float:
    """The share of pairs of this cosine in d dimensions that meet in a table of k corners, from a fixed sample."""
    n = max(250, min(1500, 100_000 // d))
    g = np.random.default_rng([7, d, k])
    x, z = g.normal(size=(2, n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = cosine * x + math.sqrt(max(0.0, 1 - cosine**2)) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    met = 0
    for table in (1000, 1001):
        a, b = (bucket_keys(v, np.zeros(n, np.uint64), [table], k) for v in (x, y))
        met += (a[:, :, None] == b[:, None, :]).any((1, 2)).sum()
    return float(met) / (2 * n)


@lru_cache(4096)
def plan(n: int, d: int, cosine: float) -> tuple[int, int]:
    """(tables, corners) for groups of up to n vectors of d components: the fewest corners for which a vector meets at most about STRANGERS unrelated ones."""
    for k in range(2, 9):
        p = min(meeting(d, k, cosine), 0.999)
        tables = max(2, math.ceil(math.log(MISS) / math.log(1 - p))) if p > 0 else 512
        if strangers(n, d, k, tables) <= STRANGERS:
            break
    return tables, k


def strangers(n: int, d: int, k: int, tables: int) -> float:
    """Unrelated vectors of n that a vector meets on average: each has a bucket and k probes in a table."""
    return n * tables * (k + 1) ** 2 / (2 * padded(d)) ** k


def bucket_keys(x: np.ndarray, salt: np.ndarray, tables, k: int) -> np.ndarray:
    """(rows, tables * (k + 1)) sorted 64-bit bucket keys of some unit vectors; salt keeps groups apart. tables: their number, or a list of some."""
    d = padded(x.shape[1])
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    tables = range(tables) if isinstance(tables, int) else tables
    keys = np.empty((len(x), len(tables) * (k + 1)), np.uint64)
    rows = np.arange(len(x))
    for at, t in enumerate(tables):
        corner, second = [], []
        for j in range(k):
            signs = np.random.default_rng([20, t, j, d]).choice([-1.0, 1.0], (3, d))
            y = x
            for s in signs:
                y = hadamard(y * s)
            size = np.abs(y)
            best = size.argmax(1)
            size[rows, best] = -1
            nxt = size.argmax(1)
            corner.append(best * 2 + (y[rows, best] < 0))
            second.append(nxt * 2 + (y[rows, nxt] < 0))
        for p in range(k + 1):  # the bucket itself, then each corner replaced by the next best
            h = salt + np.uint64(t * 1_000_003 + 1)
            for j in range(k):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + (second if j == p - 1 else corner)[j].astype(np.uint64))
            keys[:, at * (k + 1) + p] = h
    keys.sort(1)
    return keys


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow of squares."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _prepare(dtype: str):
    """Usable vectors with a hash of label and components, and their raw components in the input's own precision."""

    def run(batches):
        for b in batches:
            ids, labels = b.column("vec_id").to_pylist(), b.column("label").to_pylist()
            same, raw = [None] * len(ids), [None] * len(ids)
            for i, v in enumerate(b.column("embedding")):
                values = v.values if v.is_valid else None
                if labels[i] is None or ids[i] is None or values is None or not len(values) or values.null_count:
                    continue
                x = values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                if np.isfinite(x).all() and x.any():
                    same[i], raw[i] = xxhash.xxh3_128_digest(f"{labels[i]}|".encode() + x.tobytes()), x.astype(dtype).tobytes()
            salt = [None if y is None else xxhash.xxh3_64_intdigest(str(y)) >> 1 for y in labels]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(same, pa.binary()), pa.array(raw, pa.binary()), pa.array(salt, pa.int64())], names=["vec_id", "same", "raw", "salt"])

    return run


def _keys(dtype: str, largest: int, cosine: float):
    """Bucket keys of vectors, by length."""

    def run(batches):
        for b in batches:
            size = pc.binary_length(b.column("raw")).to_numpy(zero_copy_only=False)
            salt = b.column("salt").to_numpy(zero_copy_only=False).astype(np.uint64)
            keys: list = [None] * b.num_rows
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                x = units(np.array([np.frombuffer(b.column("raw")[i].as_py(), dtype) for i in at.tolist()], np.float64))
                tables, k = plan(largest, x.shape[1], cosine)
                found = bucket_keys(x, mix(salt[at] * np.uint64(2) + np.uint64(n)), tables, k).view(np.int64)
                for r, i in enumerate(at.tolist()):
                    keys[i] = found[r]
            yield pa.record_batch([b.column("rep"), b.column("copies"), b.column("raw"), pa.array(keys, pa.list_(pa.int64()))], names=["rep", "copies", "raw", "keys"])

    return run


def _rows(column, lo: int, hi: int, dtype) -> np.ndarray:
    """Rows lo to hi of a binary or list column as a matrix, straight from its buffer; they are of one length."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_list(column.type) else np.int32)
    s, e = (int(offsets[column.offset + i]) for i in (lo, hi))
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return column.values.slice(s, e - s).to_numpy(zero_copy_only=False).view(dtype).reshape(hi - lo, -1)
    return np.frombuffer(column.buffers()[2], np.uint8)[s:e].copy().view(dtype).reshape(hi - lo, -1)


def _earlier(ka: np.ndarray, kb: np.ndarray, key: np.uint64) -> np.ndarray:
    """Which pairs of rows share a bucket key below `key`, by a product of the rows' memberships."""
    both = np.concatenate([ka, kb])
    row, column = np.nonzero(both < key)
    value = both[row, column]
    order = np.argsort(value, kind="stable")
    row, value = row[order], value[order]
    s, e = runs(value)
    kept = (row[s] < len(ka)) & (row[e - 1] >= len(ka)) if len(s) else np.zeros(0, bool)  # only keys that both sides have; rows are in order within a key
    out = np.zeros((len(ka), len(kb)), bool)
    s, e = s[kept], e[kept]
    for c in range(0, len(s), 2048):
        size = e[c : c + 2048] - s[c : c + 2048]
        x = np.zeros((len(both), len(size)), np.float32)
        at = np.repeat(s[c : c + 2048] - np.cumsum(size) + size, size) + np.arange(size.sum())
        x[row[at], np.repeat(np.arange(len(size)), size)] = 1
        out |= x[: len(ka)] @ x[len(ka) :].T > 0
    return out


def _stars(ok: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs (first, other) that connect what the links ok[i, j] between a[i] and b[j] connect."""
    left, right = ok.any(1), ok.any(0)
    heads, others = [], []
    while left.any():
        i = int(left.argmax())
        rows, columns = np.zeros(len(a), bool), np.zeros(len(b), bool)
        rows[i] = True
        new = rows.copy()
        while new.any():
            found = ok[new].any(0) & ~columns
            columns |= found
            new = ok[:, found].any(1) & ~rows
            rows |= new
        reached = np.unique(np.concatenate([a[rows], b[columns]]))
        heads += [int(reached[0])] * (len(reached) - 1)
        others += reached[1:].tolist()
        left &= ~rows
    return heads, others


def _verify(dtype: str, cosine: float):
    """Counts of links by vector (b null) and connecting pairs of each cell; a pair is counted in the first bucket that it shares."""

    def links(key: int, rows: list[tuple]):
        """rows: (side, ids, copies, raw, keys) of one length."""
        side, ids, copies = (np.concatenate([r[k] for r in rows]) for k in range(3))
        x, keys = units(np.concatenate([r[3] for r in rows]).astype(np.float64)), np.concatenate([r[4] for r in rows])
        a = np.flatnonzero(side != 1)
        b = a if (side == 2).any() else np.flatnonzero(side == 1)
        ok = x[a] @ x[b].T >= cosine
        if b is a:
            ok = np.triu(ok, 1)
        if not ok.any():
            return [], [], []
        ok &= ~_earlier(keys[a], keys[b], np.int64(key).astype(np.uint64))
        na, nb = (ok * copies[b]).sum(1), (ok * copies[a][:, None]).sum(0)
        heads, others = _stars(ok, ids[a], ids[b])
        count_a, count_b = np.flatnonzero(na), np.flatnonzero(nb)
        named = ids[a][count_a].tolist() + ids[b][count_b].tolist()
        return named + heads, [None] * len(named) + others, na[count_a].tolist() + nb[count_b].tolist() + [0] * len(heads)

    def run(batches):
        at, cell = None, {}

        def close():
            parts = [links(at[0], rows) for rows in cell.values()]
            return tuple(sum((p[k] for p in parts), []) for k in range(3))

        def batch(parts):
            a, b, n = (sum((p[k] for p in parts), []) for k in range(3))
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

        for b in batches:
            done = []
            if not b.num_rows:
                continue
            key, x, y, side, ids, copies = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "x", "y", "side", "vec_id", "copies"))
            size = pc.binary_length(b.column("raw")).to_numpy(zero_copy_only=False)
            new = np.r_[True, (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (size[1:] != size[:-1])]
            for s, e in zip(*runs(np.cumsum(new))):
                s, e = int(s), int(e)
                if (key[s], x[s], y[s]) != at:
                    done.append(close())
                    at, cell = (key[s], x[s], y[s]), {}
                cell.setdefault(int(size[s]), []).append((side[s:e], ids[s:e], copies[s:e], _rows(b.column("raw"), s, e, dtype), _rows(b.column("keys"), s, e, np.uint64)))
            yield batch(done)
        yield batch([close()])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `vectors` (vec_id, embedding, label).

    Vectors with equal non-null labels and equal lengths link if their cosine, in double precision, is at least
    `cosine`. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do
    rows without label or id. Equal vectors are one node from the start and count as links of one another; so do
    rows that repeat an id. A bucket is dealt over cells, one for each pair of its blocks of about 512 vectors; a
    pair is counted in the first bucket that it shares. Extra columns are ignored; an empty table gives an empty
    table.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType
    dtype = "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    made = save(source.mapInArrow(_prepare(dtype), "vec_id long, same binary, raw binary, salt long"), "vectors")
    distinct = save(made.where("same is not null").groupBy("same").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("raw").alias("raw"), F.first("salt").alias("salt")), "distinct")
    largest = distinct.groupBy("salt", F.length("raw")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    largest = 1 << (largest - 1).bit_length()  # few different plans
    groups = save(distinct.select("rep", "copies", "raw", "salt").mapInArrow(_keys(dtype, largest, cosine), "rep long, copies long, raw binary, keys array<long>"), "groups")
    posts = groups.select("rep", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = posts.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key", F.ceil(F.col("size") / CELL).cast("int").alias("blocks"))
    dealt = posts.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cells = dealt.select("rep", "key", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("rep", "key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"))
    filled = cells.join(groups, "rep").select("key", "x", "y", "side", F.col("rep").alias("vec_id"), "raw", "keys", "copies")
    found = filled.repartition(partitions(spark), "key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(_verify(dtype, cosine), "a long, b long, n long")
    found = save(found, "found")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    labels = components(found.where("b is not null"))
    named = distinct.select("same", "rep", "copies").join(counts, "rep", "left").join(labels, F.col("rep") == F.col("id"), "left")
    named = named.select("same", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = made.select("vec_id", "same").join(named, "same", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op7_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of a label, and components by following links.
OP7_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id, vec_id AS id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.id = l.a),
named AS (SELECT vec_id, min(id) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT n.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, n.component_id, n.vec_id = n.component_id AS kept FROM named n LEFT JOIN counts c ON n.vec_id = c.a
"""
