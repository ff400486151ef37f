"""Ranked lexical search by Block-Max WAND over a segmented index.

The index is a table with one row for each segment of some thousand documents, as large a group as SEGMENT_BYTES of
text. A segment holds its documents' ids and lengths and, in STRIPES columns by the first bits of a term's hash, a
dictionary and compressed postings. Postings come in blocks of BLOCK documents: gaps and counts in as few bytes as
the block's largest needs. The dictionary has the first and last document of each block and its impacts: the pairs
of count and length that no other pair of the block dominates. As scores rise with the count and fall with the
length, these give a block's exact maximal score under any corpus statistics, so segments can be added at any time.

A search broadcasts the terms of a block of queries and passes once over the segments. For a query, the block
ends of its terms' lists, and the documents of rare terms, cut a segment into intervals; each list's pointer moves over its block ends alone (shallow
moves) and adds the block's maximum to the interval's bound. Only intervals whose bound reaches the threshold, the
k-th best score so far, have their blocks decompressed and scored in full. The threshold starts at the k-th score
over a bounded sample of segments, is never above the true one, and ties stay in, so no result is lost.

Terms are known by a 64-bit hash: a query of 100 terms meets a foreign word among 10⁹ with probability 5·10⁻⁹.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, Shared, runs, save, scratch_dir, word_hashes

BLOCK = 128
SEGMENT_BYTES = 8 << 20
SEGMENT_DOCS = 1 << 15
STRIPES = 16
#: Segments that give the first thresholds, about.
PRIMING = 32
#: Terms of the queries that are broadcast at once.
MAX_TERMS = 200_000
#: A list of at most this many documents in a segment is decoded first, so that each of its documents is an interval of its own.
SPARSE = 32
#: Intervals that are scored before the threshold is looked at again, at first; then twice as many each time.
WAVE = 16

#: Bytes that end a term: ASCII other than letters and digits.
_BETWEEN = np.zeros(256, bool)
_BETWEEN[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

_DICTIONARY = (np.uint64, np.uint32, np.uint32, np.uint32, np.uint8, np.uint8, np.uint8, np.uint32, np.uint32)


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct terms of a text, sorted, and their counts."""
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, counts = np.unique(word_hashes(text.encode().translate(LOWER), space=_BETWEEN)[0], return_counts=True)
    return h, counts.astype(np.int64)


def _join(arrays) -> bytes:
    return np.array([len(a) for a in arrays], np.uint32).tobytes() + b"".join(a.tobytes() for a in arrays)


def _split(raw: bytes, kinds) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(raw, np.uint32, len(kinds)), 4 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _widths(most: np.ndarray) -> np.ndarray:
    return np.select([most < 1 << 8, most < 1 << 16, most < 1 << 32], [1, 2, 4], 8).astype(np.uint8)


def _blocks(docs: np.ndarray, counts: np.ndarray, lengths: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple:
    """Block table, impacts and bytes of postings whose lists begin and end at the given places."""
    df = ends - starts
    at = np.arange(len(docs)) - np.repeat(starts - starts[:1], df)
    first = np.flatnonzero(at % BLOCK == 0)
    block = np.cumsum(at % BLOCK == 0) - 1
    size = np.diff(np.r_[first, len(docs)])
    gaps = np.r_[0, np.diff(docs)]
    gaps[first] = 0
    gap_width = np.where(size == 1, 0, _widths(np.maximum.reduceat(gaps, first))).astype(np.uint8)
    count_width = _widths(np.maximum.reduceat(counts, first))
    offset = np.r_[0, np.cumsum(size * (gap_width.astype(np.int64) + count_width))]
    blob = np.zeros(offset[-1], np.uint8)
    inside = np.arange(len(docs)) - first[block]
    for values, width, base in ((gaps, gap_width, offset[:-1]), (counts, count_width, offset[:-1] + size * gap_width)):
        w = width[block].astype(np.int64)
        place = base[block] + inside * w
        for k in range(int(width.max())):
            has = w > k
            blob[place[has] + k] = (values[has] >> (8 * k)) & 255
    # of each block, the pairs of count and length that no other pair dominates
    n = lengths[docs]
    order = np.lexsort((n, -counts, block))
    b, fall = block[order], n[order] - block[order] * (int(lengths.max()) + 1)
    least = np.minimum.accumulate(fall)
    best = order[np.r_[True, (b[1:] != b[:-1]) | (fall[1:] < least[:-1])]]
    impacts = np.bincount(block[best], minlength=len(first)).astype(np.uint8)
    return docs[first], docs[first + size - 1], gap_width, count_width, impacts, counts[best], n[best], blob


def segment(ids: list[int], found: list[tuple[np.ndarray, np.ndarray]]) -> dict:
    """The row of a segment from document ids and their terms."""
    lengths = np.array([int(c.sum()) for _, c in found], np.int64)
    h, counts = np.concatenate([h for h, _ in found]), np.concatenate([c for _, c in found])
    docs = np.repeat(np.arange(len(found)), [len(h) for h, _ in found])
    order = np.argsort(h, kind="stable")
    h, counts, docs = h[order], counts[order], docs[order]
    row = {"n_docs": len(ids), "n_terms": int(lengths.sum()), "doc_ids": np.array(ids, np.int64).tobytes(), "lengths": lengths.tobytes()}
    cut = np.searchsorted(h >> np.uint64(60), np.arange(STRIPES + 1))
    for i in range(STRIPES):
        part = slice(cut[i], cut[i + 1])
        if cut[i] == cut[i + 1]:
            row[f"d{i:02}"] = row[f"p{i:02}"] = None
            continue
        starts, ends = runs(h[part])
        first, last, gap_width, count_width, impacts, top_counts, top_lengths, blob = _blocks(docs[part], counts[part], lengths, starts, ends)
        table = (h[part][starts], ends - starts, first, last, gap_width, count_width, impacts, top_counts, top_lengths)
        row[f"d{i:02}"] = _join([np.asarray(a).astype(k) for a, k in zip(table, _DICTIONARY)])
        row[f"p{i:02}"] = blob.tobytes()
    return row


SEGMENT = "n_docs long, n_terms long, doc_ids binary, lengths binary, " + ", ".join(f"d{i:02} binary, p{i:02} binary" for i in range(STRIPES))


def build(docs: DataFrame, path: str | None = None, mode: str = "errorifexists") -> DataFrame:
    """The index of (doc_id, text) as a table at `path`, or in the shared scratch folder; mode append adds to an index.

    Every row with a doc_id is a document of its own, also where ids repeat; rows without id, and documents without
    any term, are not in it. No row leaves its task: a segment is made of neighbouring documents.
    """
    kinds = [(n, pa.int64() if t == "long" else pa.binary()) for n, t in (x.split() for x in SEGMENT.split(", "))]

    def run(batches):
        def row():
            made = segment(ids, found)
            return pa.record_batch([pa.array([made[n]], t) for n, t in kinds], names=[n for n, _ in kinds])

        ids, found, size = [], [], 0
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                text = text.as_py()
                t = terms(text)
                if len(t[0]):
                    ids.append(doc)
                    found.append(t)
                    size += len(text)
                if size >= SEGMENT_BYTES or len(ids) >= SEGMENT_DOCS:
                    yield row()
                    ids, found, size = [], [], 0
        if ids:
            yield row()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    made = source.mapInArrow(run, SEGMENT)
    path = path or f"{scratch_dir(docs.sparkSession)}/search-index-{uuid.uuid4().hex}"
    # a row is some megabytes, so the size of a row group is looked at after each row
    made.write.mode(mode).option("parquet.block.size", 16 << 20).option("parquet.page.size.row.check.min", 1).option("parquet.page.size.row.check.max", 1).parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


class _List:
    """A term's postings in a segment: block ends and maxima at hand, blocks decoded when asked for."""

    __slots__ = ("first", "last", "most", "top", "_where", "_raw", "_seg", "_done")

    def __init__(self, first, last, most, where, raw, seg):
        self.first, self.last, self.most, self.top = first, last, most, int(most.max())
        self._where, self._raw, self._seg, self._done = where, raw, seg, {}

    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last document and maximal impact of each step of the list's pointer: a block, or a document of a sparse list."""
        if len(self.last) == 1 and self._where[1][0] <= SPARSE:
            docs, impacts = self.block(0)
            return docs, docs, impacts
        return self.first, self.last, self.most

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of block i and their impacts."""
        if i not in self._done:
            offset, size, gap_width, count_width = (int(x[i]) for x in self._where)
            if gap_width:
                docs = np.cumsum(np.frombuffer(self._raw, f"<u{gap_width}", size, offset), dtype=np.int64) + int(self.first[i])
            else:
                docs = np.full(size, int(self.first[i]), np.int64)
            counts = np.frombuffer(self._raw, f"<u{count_width}", size, offset + size * gap_width)
            self._done[i] = docs, impact(counts.astype(np.int64), self._seg.m[docs])
        return self._done[i]


def impact(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * count) // (1000 * count + 8 * m)


class Corpus:
    """Documents with terms, and their terms."""

    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * df + 1)))

    def m(self, lengths: np.ndarray) -> np.ndarray:
        if len(lengths) and 75 * int(lengths.max()) * self.n_docs < 1 << 63:
            return 25 + (75 * lengths.astype(np.int64) * self.n_docs) // self.n_terms
        return np.array([25 + 75 * int(n) * self.n_docs // self.n_terms for n in lengths], np.int64)


class Segment:
    """A row of the index, opened for a set of sorted term hashes; blocks_read counts the blocks decompressed."""

    def __init__(self, row: dict, wanted: np.ndarray, corpus: Corpus):
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        self.m = corpus.m(np.frombuffer(row["lengths"], np.int64))
        self.lists: dict[int, _List] = {}
        cut = np.searchsorted(wanted >> np.uint64(60), np.arange(STRIPES + 1))
        for i in range(STRIPES):
            if cut[i] == cut[i + 1] or not (raw := row.get(f"d{i:02}")):
                continue
            h, df, first, last, gap_width, count_width, impacts, counts, lengths = _split(raw, _DICTIONARY)
            at = np.searchsorted(h, wanted[cut[i] : cut[i + 1]])
            hit = np.flatnonzero((at < len(h)) & (h[np.minimum(at, len(h) - 1)] == wanted[cut[i] : cut[i + 1]]))
            blocks = -(-df.astype(np.int64) // BLOCK)
            to = np.cumsum(blocks)
            size = np.full(len(first), BLOCK, np.int64)
            size[to - 1] = df - (blocks - 1) * BLOCK
            offset = np.cumsum(size * (gap_width.astype(np.int64) + count_width))
            offset = np.r_[0, offset[:-1]]
            tops = np.r_[0, np.cumsum(impacts, dtype=np.int64)]
            for j in hit.tolist():
                t = int(at[j])
                part = slice(int(to[t] - blocks[t]), int(to[t]))
                tip = slice(int(tops[part.start]), int(tops[part.stop]))
                most = np.maximum.reduceat(impact(counts[tip].astype(np.int64), corpus.m(lengths[tip])), tops[part] - tip.start)
                self.lists[int(cut[i]) + j] = _List(first[part], last[part], most, (offset[part], size[part], gap_width[part], count_width[part]), row[f"p{i:02}"], self)

    @property
    def blocks_read(self) -> int:
        return sum(len(x._done) for x in self.lists.values())


class Best:
    """The k best (score, doc_id) so far; scores below the threshold can't enter any more."""

    def __init__(self, k: int, threshold: int = 1):
        self.k, self.threshold = k, max(1, threshold)
        self.scores, self.docs = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, scores: np.ndarray, docs: np.ndarray) -> None:
        enough = scores >= self.threshold
        scores, docs = np.r_[self.scores, scores[enough]], np.r_[self.docs, docs[enough]]
        order = np.lexsort((docs, -scores))[: self.k]
        self.scores, self.docs = scores[order], docs[order]
        if len(order) == self.k:
            self.threshold = max(self.threshold, int(self.scores[-1]))


def search_segment(seg: Segment, query: list[tuple[int, int]], best: Best) -> None:
    """Offer `best` the documents of a segment; query: (term's place, weight times repeats) pairs."""
    lists = [(seg.lists[t], w) for t, w in query if w and t in seg.lists]
    if sum(x.top * w for x, w in lists) < best.threshold:
        return
    steps = [x.steps() for x, _ in lists]
    ends = np.concatenate([last for _, last, _ in steps] + [first.astype(np.int64) - 1 for first, last, _ in steps if first is last])
    ends = np.unique(ends[ends >= 0])
    bound = np.zeros(len(ends), np.int64)
    moves = []
    for (x, w), (first, last, most) in zip(lists, steps):  # shallow moves
        at = np.searchsorted(last, ends)
        on = np.flatnonzero(at < len(last))
        on = on[first[at[on]] <= ends[on]]
        bound[on] += w * most[at[on]]
        moves.append((on, at[on] if len(x.last) > 1 else np.zeros(len(on), np.int64)))
    order = np.argsort(-bound, kind="stable")
    done, size = 0, WAVE
    while done < len(order) and bound[order[done]] >= best.threshold:
        wave = order[done : done + size]
        done, size = done + size, 2 * size
        live = np.zeros(len(ends), bool)
        live[wave[bound[wave] >= best.threshold]] = True
        score = np.zeros(len(seg.ids), np.int64)
        for (x, w), (on, at) in zip(lists, moves):
            for i in np.unique(at[live[on]]).tolist():
                docs, impacts = x.block(i)
                score[docs] += w * impacts
        hit = np.flatnonzero(score >= best.threshold)
        hit = hit[live[np.searchsorted(ends, hit)]] if len(hit) else hit
        best.offer(score[hit], seg.ids[hit])


def _search(index: DataFrame, wanted: np.ndarray, queries: list[list[tuple[int, int]]], corpus: Corpus, k: int, thresholds: list[int]) -> DataFrame:
    """(q, doc_id, score): the k best of each query in each task's segments."""
    shared = Shared(index.sparkSession, (wanted, queries, corpus, thresholds))
    names = _columns(wanted)

    def run(batches):
        wanted, queries, corpus, thresholds = shared.load()
        best = [Best(k, t) for t in thresholds]
        for b in batches:
            for i in range(b.num_rows):
                seg = Segment({n: b.column(n)[i].as_py() for n in b.schema.names}, wanted, corpus)
                for query, top in zip(queries, best):
                    search_segment(seg, query, top)
        rows = [(np.full(len(x.docs), q, np.int32), x.docs, x.scores) for q, x in enumerate(best) if len(x.docs)]
        if rows:
            q, docs, scores = (np.concatenate(c) for c in zip(*rows))
            yield pa.record_batch([pa.array(q), pa.array(docs), pa.array(scores)], names=["q", "doc_id", "score"])

    each = index.select("doc_ids", "lengths", *names).mapInArrow(run, "q int, doc_id long, score long")
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "doc_id")))
    return ranked.where(F.col("rank") <= k)


def _columns(wanted: np.ndarray, kinds: str = "dp") -> list[str]:
    """The columns that hold the wanted terms."""
    return [f"{c}{i:02}" for i in sorted({int(x) for x in wanted >> np.uint64(60)}) for c in kinds]


def document_frequencies(index: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """Documents that hold a term, by the wanted term's place; only dictionaries are read."""
    shared = Shared(index.sparkSession, wanted)

    def run(batches):
        wanted = shared.load()
        total = np.zeros(len(wanted), np.int64)
        for b in batches:
            for name in b.schema.names:
                for raw in b.column(name):
                    if raw.is_valid:
                        h, df = _split(raw.as_py(), _DICTIONARY)[:2]
                        at = np.minimum(np.searchsorted(h, wanted), len(h) - 1)
                        total += np.where(h[at] == wanted, df[at], 0)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "df"])

    each = index.select(*_columns(wanted, "d")).mapInArrow(run, "term int, df long")
    return {r["term"]: r["df"] for r in each.groupBy("term").agg(F.sum("df").alias("df")).collect()}


def _query_terms(queries: DataFrame, id: str, text: str) -> DataFrame:
    def run(batches):
        for b in batches:
            found = [terms(t.as_py()) for t in b.column("text")]
            yield pa.record_batch([b.column("id"), pa.array([h.tobytes() for h, _ in found], pa.binary()), pa.array([c.tobytes() for _, c in found], pa.binary()), pa.array([len(h) for h, _ in found], pa.int64())], names=["id", "h", "counts", "n"])

    source = queries.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).distinct()
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, h binary, counts binary, n long").where("n > 0")


def search(index: DataFrame, queries: DataFrame, k: int = 10, id: str = "item_id", text: str = "text") -> DataFrame:
    """(id, rank, doc_id, score): the k documents of the index with the highest scores above 0 for each query.

    Equal scores rank by doc_id. Repeated query rows count once; texts of one id are queries of their own. A null
    text, and a text without known terms, finds nothing; so does an empty index. Queries beyond MAX_TERMS are taken
    in blocks, each with a pass over the columns of the index that hold its terms.
    """
    spark = index.sparkSession
    total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0)), F.count(F.lit(1))).first()
    corpus, segments = Corpus(total[0], total[1]), total[2]
    asked = save(_query_terms(queries, id, text), "search-queries")
    blocks = max(1, -(-(asked.agg(F.sum("n")).first()[0] or 0) // MAX_TERMS))
    kind = asked.schema["id"].dataType.simpleString()
    out = None
    for i in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("id", "h"), F.lit(blocks)) == i).collect() if corpus.n_docs else []
        lists = [(np.frombuffer(r["h"], np.uint64), np.frombuffer(r["counts"], np.int64)) for r in block]
        wanted = np.unique(np.concatenate([h for h, _ in lists])) if lists else np.zeros(0, np.uint64)
        df = document_frequencies(index, wanted) if len(wanted) else {}
        weights = np.array([corpus.weight(df[j]) if j in df else 0 for j in range(len(wanted))], np.int64)
        weighed = [list(zip((at := np.searchsorted(wanted, h)).tolist(), (weights[at] * c).tolist())) for h, c in lists]
        thresholds = [1] * len(block)
        if segments > PRIMING and len(wanted):
            few = index.where(F.pmod(F.xxhash64("doc_ids"), F.lit(-(-segments // PRIMING))) == 0)
            for r in _search(few, wanted, weighed, corpus, k, thresholds).where(F.col("rank") == k).collect():
                thresholds[r["q"]] = r["score"]
        ids = spark.createDataFrame([(q, r["id"]) for q, r in enumerate(block)], f"q int, id {kind}")
        if len(wanted):
            found = _search(index, wanted, weighed, corpus, k, thresholds).join(ids, "q").select(F.col("id").alias(id), "rank", "doc_id", "score")
        else:
            found = ids.select(F.col("id").alias(id), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
        found = save(found, "search-results") if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents WHERE doc_id IS NOT NULL),
size AS MATERIALIZED (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM size),
posting AS MATERIALIZED (SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(t) AS t FROM d) GROUP BY r, t),
weight AS MATERIALIZED (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM posting GROUP BY t), total),
i AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT q, t, CAST(count(*) AS BIGINT) AS qn FROM (SELECT q, unnest(t) AS t FROM i) GROUP BY q, t),
scored AS (SELECT q, r, CAST(sum(qn * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // n_terms))))) AS BIGINT) AS score FROM asked JOIN weight USING (t) JOIN posting USING (t) JOIN size USING (r), total GROUP BY q, r)
SELECT i.item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored JOIN size USING (r) WHERE score > 0) JOIN i USING (q) WHERE rank <= 10
"""
