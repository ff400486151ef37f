"""Shared plumbing of the training-data operators: scratch tables, packed exchanges, word hashing."""

from __future__ import annotations

import atexit
import pickle
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A folder below spark.checkpoint.dir that driver and executors share; removed when the driver ends.

    Where spark.checkpoint.dir is unset, a temporary folder stands in on a local master, as in tests; on a cluster
    executors could not see it, so an error is raised.
    """
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        path = f"{root.rstrip('/')}/scratch-{uuid.uuid4().hex}"
        _SCRATCH[app] = path

        def clean() -> None:
            try:
                hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
            except Exception:  # the session may be gone already
                pass

        atexit.register(clean)
    return _SCRATCH[app]


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` as a table in the shared scratch folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table written by save() that nothing reads any more."""
    path = getattr(df, "_quill_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


class Shared:
    """A broadcast object of this package's own classes, for workers that have no copy of the package."""

    def __init__(self, spark: SparkSession, value):
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def load(self):
        return pickle.loads(self._bytes.value)

    def close(self) -> None:
        """Free it on driver and executors, once nothing reads it any more."""
        self._bytes.destroy()


def partitions(spark: SparkSession) -> int:
    """The configured number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held_out(doc_id: str = "doc_id"):
    """True for rows that no model may learn from: crc32 of the id as text has remainder 2 by 4."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


PACKED = "bucket int, blob binary"
_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])


def pack(records: np.ndarray, keys: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Group fixed-width records by a hash of their key, one binary row for each bucket that has any.

    One row carries thousands of records, so an exchange moves memory blocks in place of rows.
    """
    b = ((keys >> np.uint64(17)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(b, kind="stable")
    b, records = b[order], records[order]
    starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(b)] if len(b) else starts
    return pa.record_batch([pa.array(b[starts], pa.int32()), pa.array([records[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary())], schema=_PACKED_ARROW)


def unpack(batches, dtype) -> np.ndarray:
    """All records of a partition's packed rows."""
    parts = [np.frombuffer(x, dtype) for b in batches for x in b.column("blob").to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


#: Bytes A-Z to a-z, all others unchanged.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept between calls up to `most` words."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_STEP = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def word_hashes(raw: bytes, block: int = 1 << 20, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, starts and ends of the words of a text, which are runs without ASCII white space (or the bytes marked in `space`).

    The hashes come from one running sum over the bytes, so no word becomes an object of its own. Long texts are
    taken in blocks that end at white space.
    """
    b = np.frombuffer(raw, np.uint8)
    out, at = [], 0
    while at < len(b):
        end = min(len(b), at + block)
        while end < len(b) and not space[b[end]]:
            more = np.flatnonzero(space[b[end : end + block]])
            end = end + int(more[0]) if len(more) else min(len(b), end + block)
        part = b[at:end]
        if len(part) >= len(_powers[0]):
            n = 2 * len(part) + 1
            for i, x in enumerate((_STEP, pow(_STEP, -1, 2**64))):
                _powers[i] = np.cumprod(np.r_[np.uint64(1), np.full(n, x, np.uint64)])
        between = np.r_[True, space[part], True]
        edge = np.flatnonzero(between[1:] != between[:-1])
        s, e = edge[::2], edge[1::2]
        total = np.r_[np.uint64(0), np.cumsum(_BYTES[part] * _powers[0][: len(part)])]
        out.append((mix((total[e] - total[s]) * _powers[1][s] + (e - s).astype(np.uint64)), s + at, e + at))
        at = end
    if not out:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z
    return tuple(np.concatenate(x) for x in zip(*out)) if len(out) > 1 else out[0]


def shingle_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n-word window, in order; of the whole sequence where there are fewer words."""
    if not len(ids):
        return np.zeros(0, np.uint64)
    n = min(n, len(ids))
    h = np.full(len(ids) - n + 1, np.uint64(n))
    for j in range(n):
        h = mix(h * _M1 + ids[j : len(ids) - n + 1 + j])
    return h


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys."""
    if not len(sorted_keys):
        z = np.zeros(0, np.int64)
        return z, z
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return starts, np.r_[starts[1:], len(sorted_keys)]


class Forest:
    """Union-find over hashable nodes; join() is true if the edge connects two trees."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        r = x
        while (n := up.get(r, r)) != r:
            r = n
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True
