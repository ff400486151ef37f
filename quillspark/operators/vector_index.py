"""A stored vector index with keys of any kind: an inverted file of coarse lists, filled once and searched often (TOP2, UD1, SNK6).

`path` holds the centroids and one table of entries, partitioned by batch and list. An entry has its key, its
vector, and a code: the residual of the unit vector to its centroid in bytes, with the length of what the bytes
miss. A search reads the codes of the lists next to its queries alone. The code's error is known, so every entry
has a lower and an upper bound of its cosine; only entries that can be among the best k are read in full and
scored exactly. Within the probed lists nothing is lost; which lists are probed decides about recall.

There is one writer at a time. A batch is inserted in one write and counts from the moment its marker file is there. Keys that are inserted again
replace their old entries, which a table of dead entries hides until `compact()` writes the live ones anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lexicon import DEFAULT, Lexicon
from ..functions.text import tokenize
from ..plans.session import stored
from ..sources.files import committed, commit, remove
from .retrieval import DIMENSION, TfidfIndex, _matrices, _query_blocks, _small, hash_embedding, plain_key

#: Vectors up to so many lie in one list, so that a search is exact.
ONE_LIST = 2_000
MAX_LISTS = 4_096
#: Vectors that the centroids are learned from, at most about, and rounds over them.
TRAIN = 50_000
ROUNDS = 10
#: Lists that a query looks into: this many, or this share of all where that is more.
MIN_PROBES, PROBE_SHARE = 8, 1 / 8
#: Scores are rounded to four places before they are ranked.
_HALF = 1e-4


def centroids(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means; fewer where the sample has fewer different vectors."""
    different = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    c = different[rng.permutation(len(different))[:lists]]
    for _ in range(ROUNDS if len(different) > lists else 0):
        at = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, at, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, sums / np.where(norm > 1e-12, norm, 1), c)
    return c


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(unit: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lists, byte codes of the residuals, their scales, and the lengths of what the codes miss."""
    at = (unit @ centers.T).argmax(1)
    residual = unit - centers[at]
    scale = np.abs(residual).max(1) / 127
    code = np.rint(residual / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
    return at, code, scale, np.linalg.norm(residual - code * scale[:, None], axis=1) + 1e-9


class VectorIndex:
    """An opened index; see create() and open()."""

    def __init__(self, spark: SparkSession, path: str, lexicon: Lexicon = DEFAULT):
        self.spark, self.path, self.lexicon = spark, path.rstrip("/"), lexicon
        self.centers = np.array([r["center"] for r in spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()])
        self.dimension = self.centers.shape[1]

    @classmethod
    def create(cls, vectors: DataFrame, path: str, key: str = "id", vector: str = "embedding", lists: int | None = None, lexicon: Lexicon = DEFAULT) -> VectorIndex:
        """An index at `path`, which must be new, with centroids learned from (key, vector) rows, and these rows in it.

        As many lists as the root of the rows, MAX_LISTS at most, and one for up to ONE_LIST rows. The dimension is
        that of the most rows. What insert() leaves out isn't learned from either.
        """
        spark = vectors.sparkSession
        if committed(spark, path):
            raise ValueError(f"there is an index at {path}")
        sizes = vectors.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
        n, d = (sizes["count"], sizes["d"]) if sizes else (0, DIMENSION)
        lists = lists or (1 if n <= ONE_LIST else min(MAX_LISTS, int(n**0.5)))
        draw = F.pmod(F.xxhash64(F.lit(5), key, vector), F.lit(1 << 30)) / float(1 << 30)
        some = vectors.where((F.size(vector) == d) & F.col(key).isNotNull() & (draw < min(1.0, TRAIN / max(1, n)))).select(F.col(vector).cast("array<double>").alias("v"))
        rows = [r["v"] for r in some.limit(2 * TRAIN).collect()]
        x = np.array([v for v in rows if None not in v], np.float64).reshape(-1, d)
        x = x[np.isfinite(x).all(1) & x.any(1)]
        found = centroids(_unit(x), lists) if len(x) else np.eye(1, d)
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(found)], "list int, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/centroids")
        made = cls(spark, path, lexicon)
        made.insert(vectors, key, vector)
        return made

    @classmethod
    def of_texts(cls, docs: DataFrame, path: str, key: str = "id", text: str = "text", lists: int | None = None, lexicon: Lexicon = DEFAULT, dimension: int = DIMENSION) -> VectorIndex:
        """An index of hashed embeddings of (key, text) rows, with their tokens for matched terms; see insert_texts()."""
        return cls.create(_embedded(docs, key, text, lexicon, dimension), path, key, "embedding", lists, lexicon)

    # -- filling -------------------------------------------------------------------------------------------------

    def insert(self, vectors: DataFrame, key: str = "id", vector: str = "embedding") -> None:
        """One more batch of (key, vector) rows, in one pass; a column `tokens` is kept for matched terms.

        Keys that are there already get the new vector. Of rows that repeat a key in the batch the one with the
        greatest vector counts. Rows without key, and vectors that are null, zero, of another dimension or hold
        null or non-finite numbers, are left out; a key whose new vector is such keeps its old one.
        """
        kind = plain_key(vectors, key)
        tokens = F.col("tokens") if "tokens" in vectors.columns else F.lit(None).cast("array<string>")
        source = vectors.where(F.col(key).isNotNull() & (F.size(vector) == self.dimension)).select(F.col(key).cast(kind).alias("key"), F.struct(F.col(vector).cast("array<double>").alias("v"), tokens.alias("t")).alias("x"))
        one = source.groupBy("key").agg(F.max("x").alias("x")).select("key", F.col("x.v").alias("vector"), F.col("x.t").alias("tokens"))
        centers = self.centers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, 2000):
                    part = b.slice(i, 2000)
                    index = pa.array(np.arange(part.num_rows))
                    for at, x in _matrices(pa.record_batch([index, part.column("vector")], names=["i", "v"])):
                        lists, code, scale, error = encode(_unit(x), centers)
                        columns = [part.column(c).take(pa.array(at)) for c in ("key", "vector", "tokens")]
                        yield pa.record_batch([*columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(error), pa.array(lists.astype(np.int32))], names=["key", "vector", "tokens", "code", "scale", "error", "list"])

        coded = one.mapInArrow(run, f"key {kind}, vector array<double>, tokens array<string>, code binary, scale double, error double, list int")
        batches = committed(self.spark, self.path)
        number = batches[-1] + 1 if batches else 1
        here = f"{self.path}/entries/batch={number}"
        # a long list is dealt over several tasks and files
        dealt = coded.repartition("list", F.pmod(F.xxhash64("key"), F.lit(8))).withColumn("rid", F.monotonically_increasing_id())
        dealt.write.mode("overwrite").partitionBy("list").parquet(here)
        if batches:
            new = self.spark.read.parquet(here) if _has_rows(self.spark, here) else None
            old = self._live(self._entries()).select("key", "batch", "list", "rid")
            if new is not None:
                old.join(new.select("key"), "key", "left_semi").select("batch", "list", "rid").write.mode("overwrite").parquet(f"{self.path}/dead/at={number}")
        commit(self.spark, self.path, number)

    def insert_texts(self, docs: DataFrame, key: str = "id", text: str = "text") -> None:
        self.insert(_embedded(docs, key, text, self.lexicon, self.dimension), key)

    def compact(self) -> None:
        """The live entries as one new batch; the batches before go. Searches that still read them must be over."""
        batches = committed(self.spark, self.path)
        number = batches[-1] + 1
        live = self._live(self._entries()).drop("batch")
        live.repartition("list", F.pmod(F.xxhash64("key"), F.lit(8))).withColumn("rid", F.monotonically_increasing_id()).write.mode("overwrite").partitionBy("list").parquet(f"{self.path}/entries/batch={number}")
        commit(self.spark, self.path, number, whole=True)
        for n in batches:
            remove(self.spark, f"{self.path}/entries/batch={n}", f"{self.path}/dead/at={n}")

    # -- reading -------------------------------------------------------------------------------------------------

    def _entries(self) -> DataFrame:
        batches = committed(self.spark, self.path)
        # where a batch is empty its folder has no list below it
        whole = [n for n in batches if _has_rows(self.spark, f"{self.path}/entries/batch={n}")]
        if not whole:
            empty = "key string, vector array<double>, tokens array<string>, code binary, scale double, error double, rid long, batch int, list int"
            return self.spark.createDataFrame([], empty)
        return self.spark.read.option("basePath", f"{self.path}/entries").parquet(*[f"{self.path}/entries/batch={n}" for n in whole])

    def _live(self, entries: DataFrame) -> DataFrame:
        dead = [f"{self.path}/dead/at={n}" for n in committed(self.spark, self.path) if _has_rows(self.spark, f"{self.path}/dead/at={n}")]
        return entries.join(self.spark.read.parquet(*dead), ["batch", "list", "rid"], "left_anti") if dead else entries

    def count(self) -> int:
        return self._live(self._entries()).count()

    def search_vectors(self, queries: DataFrame, k: int = 10, vector: str = "embedding", probes: int | None = None) -> DataFrame:
        """TOP2: (query, key, score, rank, tokens) by cosine in double precision, clamped to 0 and 1, rounded to four places; ties go to the smaller key.

        Queries of another dimension and unusable ones find nothing. Queries come in blocks of a checked size.
        """
        kind = plain_key(queries, "query")
        source = queries.where(F.col("query").isNotNull() & (F.size(vector) == self.dimension)).select(F.col("query").cast(kind).alias("query"), F.col(vector).cast("array<double>").alias(vector))
        out = None
        for block in _query_blocks(source):
            names, q = block[self.dimension]
            found = self._block(names, q, k, probes, kind)
            found = stored(found, "hits") if out is not None else found
            out = found if out is None else out.unionByName(found)
        if out is None:
            key = dict(self._entries().dtypes)["key"]
            out = self.spark.createDataFrame([], f"query {kind}, key {key}, score double, rank int, tokens array<string>")
        return out

    def probed(self, q: np.ndarray, probes: int | None = None) -> np.ndarray:
        """The lists that each unit query looks into, the nearest first."""
        lists = len(self.centers)
        n = min(lists, probes or max(MIN_PROBES, int(np.ceil(lists * PROBE_SHARE))))
        return np.argsort(-(q @ self.centers.T), axis=1, kind="stable")[:, :n]

    def _block(self, names: np.ndarray, q: np.ndarray, k: int, probes: int | None, kind: str) -> DataFrame:
        near = self.probed(q, probes)
        asked = {int(x): np.flatnonzero((near == x).any(1)) for x in np.unique(near)}
        shared = self.spark.sparkContext.broadcast((q, asked, self.centers))

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, asked, centers = shared.value
            lows = np.full((len(q), k), -np.inf)  # the best k lower bounds of each query so far
            for b in batches:
                lists = b.column("list").to_numpy()
                for x in np.unique(lists):
                    at, who = np.flatnonzero(lists == x), asked[int(x)]
                    for i in range(0, len(at), 4000):
                        part = b.take(pa.array(at[i : i + 4000]))
                        code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.int8).reshape(part.num_rows, -1)
                        guess = (q[who] @ centers[x])[:, None] + (q[who] @ code.T.astype(np.float64)) * part.column("scale").to_numpy()
                        error = part.column("error").to_numpy()
                        low, high = np.maximum(guess - error, 0), np.maximum(guess + error, 0)  # scores are clamped
                        lows[who] = -np.partition(np.c_[-lows[who], -low], k - 1, axis=1)[:, :k]
                        r, c = np.nonzero(high >= lows[who].min(1)[:, None] - _HALF)
                        rows = part.take(pa.array(c))
                        yield pa.record_batch([pa.array(who[r].astype(np.int32)), rows.column("batch"), rows.column("list"), rows.column("rid"), pa.array(low[r, c]), pa.array(high[r, c])], names=["q", "batch", "list", "rid", "low", "high"])

        entries = self._live(self._entries().where(F.col("list").isin([int(x) for x in asked])))
        found = entries.select("batch", "list", "rid", "code", "scale", "error").mapInArrow(bounds, "q int, batch int, list int, rid long, low double, high double")
        kth = F.nth_value("low", k).over(W.partitionBy("q").orderBy(F.desc("low")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        close = stored(found.withColumn("kth", kth).where(F.col("kth").isNull() | (F.col("high") >= F.col("kth") - _HALF)).select("q", "batch", "list", "rid"), "close")
        full = self._entries().where(F.col("list").isin([int(x) for x in asked])).select("batch", "list", "rid", "key", "vector", "tokens")
        pairs = full.join(_small(close), ["batch", "list", "rid"]).select("q", "key", "vector", "tokens")
        key = dict(pairs.dtypes)["key"]

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = shared.value[0]
            for b in batches:
                for i in range(0, b.num_rows, 2000):
                    part = b.slice(i, 2000)
                    x = _unit(part.column("vector").flatten().to_numpy().reshape(part.num_rows, -1))
                    s = np.round(np.clip((q[part.column("q").to_numpy()] * x).sum(1), 0, 1), 4)
                    yield pa.record_batch([part.column("q"), part.column("key"), pa.array(s), part.column("tokens")], names=["q", "key", "score", "tokens"])

        scored = pairs.mapInArrow(exact, f"q int, key {key}, score double, tokens array<string>")
        ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= k)
        ids = self.spark.createDataFrame([(i, n) for i, n in enumerate(names.tolist())], f"q int, query {kind}")
        return ranked.join(ids, "q").select("query", "key", "score", "rank", "tokens")

    def search(self, queries: DataFrame, k: int = 10, query: str = "query", text: str = "text", probes: int | None = None) -> DataFrame:
        """UD1: (query, id, score, rank, matched_terms) of the best k entries of each text, as TfidfIndex.search() gives them.

        A text without tokens finds nothing; the matched terms of entries inserted as bare vectors are null.
        """
        tokens = tokenize(F.col(text), self.lexicon)
        asked = queries.where(F.col(query).isNotNull()).select(F.col(query).alias("query"), tokens.alias("asked"), hash_embedding(tokens, self.dimension).alias("embedding"))
        hits = self.search_vectors(asked.select("query", "embedding"), k, probes=probes)
        terms = F.array_join(F.array_sort(F.array_intersect("asked", "tokens")), " ")
        return hits.join(_small(asked.select("query", "asked").dropDuplicates(["query"])), "query").select("query", F.col("key").alias("id"), "score", "rank", terms.alias("matched_terms"))


def _embedded(docs: DataFrame, key: str, text: str, lexicon: Lexicon, dimension: int) -> DataFrame:
    tokens = docs.select(key, tokenize(F.col(text), lexicon).alias("tokens"))
    return tokens.withColumn("embedding", hash_embedding("tokens", dimension))


def _has_rows(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hadoop) and any(not s.getPath().getName().startswith("_") for s in fs.listStatus(hadoop))


def choose_index(chunks: DataFrame, path: str | None = None, key: str = "id", text: str = "text", lexicon: Lexicon = DEFAULT) -> tuple[VectorIndex | TfidfIndex, str, str | None]:
    """The stored index at `path`, or TF-IDF over the chunks where there is none that can be opened: (index, backend, reason of the fallback)."""
    spark = chunks.sparkSession
    if path is None:
        return TfidfIndex(chunks, key, text, lexicon), "tfidf", None
    try:
        if not committed(spark, path):
            raise ValueError(f"no index at {path}")
        return VectorIndex(spark, path, lexicon), "vectors", None
    except (ValueError, PySparkException) as error:
        return TfidfIndex(chunks, key, text, lexicon), "tfidf", str(error).splitlines()[0]
