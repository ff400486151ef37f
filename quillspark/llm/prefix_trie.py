"""The prefix trie of conversations, from a Cartesian tree over their sorted order.

Every turn becomes a record of RECORD bytes: a digest of role and text, then the text's length. Conversations are
sorted by their records over range partitions, the blocks. The longest common prefixes (LCP, in turns) of
neighbours form an array whose Cartesian tree has one node for each branching prefix: its interval ends at the
nearest smaller values on both sides. A task finds those of its block with a stack, where equal LCPs fall into one
node, and expands the depths that no LCP names. A node that crosses a block's edge is open: its fragments take the
block in which it starts as their key, which is the nearest block to the left whose minimum is smaller than the
node's depth. Block minima and edges are two integers a block. Open fragments are summed by key; what
lies below an open node is a range of the open nodes' order, so prefix sums give its leaves and savings.

A conversation's records are one row of 20 bytes a turn; a block is as many conversations as one partition holds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, partitions, save

RECORD = 20
#: Bytes of conversation ids in one row of an open node.
PIECE = 1 << 20
#: Leading turns that a rebuilt conversation takes from another one stay below this.
HEADS = 9

_NOTHING = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, records): the turns of each conversation in order, null turns first.

    Rows of one conversation with equal turns are ordered by digest. Null role or text count as empty, rows without
    conv_id are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    record = F.concat(digest, F.lpad(F.hex(F.octet_length(text).cast("long")), 8, "0"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("t"), record.alias("r")).alias("turn")).where("conv_id IS NOT NULL")
    # dealt by family, so that the conversations that rebuilt() puts together lie together already
    family = turns.withColumn("family", F.col("conv_id") - F.col("conv_id") % 5).repartition("family")
    ordered = family.groupBy("family", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return ordered.select("family", "conv_id", F.unhex(F.array_join(F.col("turns")["r"], "")).alias("records"))


def rebuilt(seqs: DataFrame) -> DataFrame:
    """(conv_id, records) where the first crc32(conv_id) % HEADS turns come from conversation conv_id - conv_id % 5, if there is one."""
    n = RECORD * (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    first = F.max(F.when(F.col("conv_id") == F.col("family"), F.hex(F.substring("records", 1, RECORD * (HEADS - 1))))).over(W.partitionBy("family"))
    both = seqs.withColumn("first", F.unhex(F.coalesce(first, F.lit("")))).withColumn("n", n)
    return both.select("conv_id", F.concat(F.expr("substring(first, 1, n)"), F.expr("substring(records, n + 1, 2147483647)")).alias("records"))


def common_prefixes(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """LCP in records of each sequence with the one before (0 for the first); words: the records of all sequences, one row each."""
    out = np.zeros(len(sizes), np.int64)
    if len(sizes) < 2:
        return out
    m = np.minimum(sizes[1:], sizes[:-1])
    at = np.cumsum(sizes) - sizes
    starts = np.cumsum(m) - m
    j = np.arange(int(m.sum())) - np.repeat(starts, m)
    differs = (words[np.repeat(at[1:], m) + j] != words[np.repeat(at[:-1], m) + j]).any(1)
    out[1:] = m
    bad = np.flatnonzero(differs)
    np.minimum.at(out, np.repeat(np.arange(1, len(sizes)), m)[bad], j[bad])
    return out


def _decode(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(raws), ">u4").reshape(-1, RECORD // 4), np.array([len(r) // RECORD for r in raws], np.int64)


def block_minima(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(block, LCP with the block before or -1, least LCP inside) of every block that has rows, in order."""

    def ends(batches):
        for b in batches:
            found: dict = {}
            for block, r in zip(b.column("block").to_pylist(), b.column("records").to_pylist()):
                low, high = found.get(block, (r, r))
                found[block] = (min(low, r), max(high, r))
            yield pa.record_batch([pa.array(list(found), pa.int32()), pa.array([x for x, _ in found.values()], pa.binary()), pa.array([x for _, x in found.values()], pa.binary())], names=["block", "low", "high"])

    def minima(batches):
        last = None
        for b in batches:
            out = []
            for low, high in zip(b.column("low").to_pylist(), b.column("high").to_pylist()):
                words, sizes = _decode([low if last is None else last, low, high])
                lcp = common_prefixes(words, sizes)
                out.append((-1 if last is None else int(lcp[1]), int(lcp[2])))
                last = high
            yield pa.record_batch([b.column("block"), pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["block", "edge", "least"])

    found = rows.mapInArrow(ends, "block int, low binary, high binary").groupBy("block").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    # as many rows as there are partitions
    ordered = found.repartition(1).sortWithinPartitions("block")
    return sorted(tuple(r) for r in ordered.mapInArrow(minima, "block int, edge long, least long").collect())


class _Node:
    """A node on the stack: the deepest prefix of its interval so far."""

    __slots__ = ("depth", "start", "n", "least", "children", "leaves", "saved", "ends", "bytes", "waiting")

    def __init__(self, depth: int, start: int, bytes_):
        self.depth, self.start, self.bytes = depth, start, bytes_
        self.n = self.children = self.leaves = self.saved = 0
        self.least = None
        self.ends: list[int] = []
        self.waiting: list[list] = []


PARTS = (
    "block int, open boolean, start int, depth long, conv_id long, parent_conv_id long, parent_start int, n_convs long, n_children long, n_leaves long, saved_tokens long, bytes long, ends_sha256 string, piece int, ends binary"
)
_PARTS_ARROW = pa.schema(
    [
        ("block", pa.int32()), ("open", pa.bool_()), ("start", pa.int32()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_start", pa.int32()), ("n_convs", pa.int64()),
        ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("bytes", pa.int64()), ("ends_sha256", pa.string()), ("piece", pa.int32()), ("ends", pa.binary()),
    ]
)
_PARENT_CONV, _PARENT_START = 5, 6


class BlockTree:
    """The part of the Cartesian tree in one block; rows come in order, finished parts are taken with flush()."""

    def __init__(self, at: int, edges: np.ndarray, least: np.ndarray):
        self.at, self.left = at, int(edges[at])
        self.right = int(edges[at + 1]) if at + 1 < len(edges) else -1
        # nearest smaller values to the left, by block minima
        lows = np.minimum(edges[:at], least[:at])[::-1]
        self.before = -np.minimum.accumulate(lows) if at else lows
        self.out: list[list] = []
        self.waiting = 0
        self.row = 0
        bottom = _Node(-1, -1, None)
        root = _Node(0, 0, ())
        self.stack = [bottom, root]

    def _is_left(self, start: int, depth: int) -> bool:
        return start == 0 and depth <= self.left

    def _key(self, start: int, depth: int) -> int:
        """The block in which an open node starts."""
        if not self._is_left(start, depth):
            return self.at
        return self.at - 1 - int(np.searchsorted(self.before, -depth, side="right"))

    def add(self, conv: int, size: int, lcp: int, bytes_) -> None:
        if self.row == 0:
            lcp = max(0, self.left)
            if lcp:
                self.stack.append(_Node(lcp, 0, bytes_))
        else:
            self._close(lcp, False)
        top = self.stack[-1]
        if size > lcp:
            top = _Node(size, self.row, bytes_)
            self.stack.append(top)
        top.n += 1
        top.least = conv if top.least is None else min(top.least, conv)
        top.ends.append(conv)
        self.row += 1

    def finish(self) -> None:
        if self.row:
            self._close(-1, True)

    def _close(self, lcp: int, last: bool) -> None:
        stack = self.stack
        while stack[-1].depth > lcp:
            e = stack.pop()
            if stack[-1].depth < lcp:
                stack.append(_Node(lcp, e.start, e.bytes))
            parent = stack[-1]
            leaves, saved, children = e.leaves, e.saved, e.children
            for depth in range(e.depth, parent.depth, -1):
                left = self._is_left(e.start, depth)
                is_open = left or (last and depth <= self.right)
                size = int(e.bytes[depth - 1]) if depth else 0
                ends = e.ends if depth == e.depth else ()
                if is_open:
                    key, digest = self._key(e.start, depth), None
                else:
                    key = self.at
                    leaves = leaves if children else 1
                    saved += (e.n - 1) * size
                    digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest() if ends else _NOTHING
                row = [self.at, is_open, key, depth, e.least, None, None, e.n, children, leaves, saved, size, digest, 0, None]
                above = e if depth - 1 > parent.depth else parent
                if depth == e.depth and e.waiting:
                    for r in e.waiting:
                        r[_PARENT_START if is_open else _PARENT_CONV] = key if is_open else e.least
                    self.waiting -= len(e.waiting)
                if depth == 0:
                    pass
                elif self._is_left(above.start, depth - 1) or (last and depth - 1 <= self.right):
                    row[_PARENT_START] = self._key(above.start, depth - 1)
                elif above is e:
                    row[_PARENT_CONV] = e.least
                else:
                    parent.waiting.append(row)
                    self.waiting += 1
                self.out.append(row)
                if is_open and ends:
                    self._pieces(row, ends)
                children = 0 if left else 1
            parent.n += e.n
            parent.least = e.least if parent.least is None else min(parent.least, e.least)
            parent.children += children
            parent.leaves += leaves
            parent.saved += saved

    def _pieces(self, row: list, ends: list[int]) -> None:
        """The ids that end at an open node, PIECE bytes to a row."""
        step = PIECE // 21
        for i in range(0, len(ends), step):
            self.out.append([row[0], True, row[2], row[3], None, None, None, 0, 0, 0, 0, 0, None, i // step + 1, ",".join(map(str, ends[i : i + step])).encode()])

    def flush(self, most: int = 0) -> pa.RecordBatch | None:
        """The parts so far as a batch, if none waits for its parent and there are over `most`."""
        if self.waiting or len(self.out) <= most:
            return None
        batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*self.out), _PARTS_ARROW.types)], schema=_PARTS_ARROW)
        self.out = []
        return batch


def parts(rows: DataFrame, minima: list[tuple[int, int, int]], n: int) -> DataFrame:
    """Nodes of every block, and the fragments of open ones."""
    at = {block: i for i, (block, _, _) in enumerate(minima)}
    edges, least = np.array([e for _, e, _ in minima], np.int64), np.array([m for _, _, m in minima], np.int64)

    def run(batches):
        tree, last = None, b""
        for b in batches:
            raws = [last, *b.column("records").to_pylist()]
            words, sizes = _decode(raws)
            lcps = common_prefixes(words, sizes)
            if tree is None and b.num_rows:
                tree = BlockTree(at[b.column("block")[0].as_py()], edges, least)
            to, lengths = np.cumsum(sizes), words[:, -1]
            for i, conv in enumerate(b.column("conv_id").to_pylist(), 1):
                tree.add(conv, int(sizes[i]), int(lcps[i]), lengths[to[i] - sizes[i] : to[i]])
                if len(tree.out) > 20_000 and (done := tree.flush(20_000)):
                    yield done
            last = raws[-1]
        if tree:
            tree.finish()
            if done := tree.flush():
                yield done

    return rows.repartitionById(n, F.col("block")).sortWithinPartitions("records", "conv_id").mapInArrow(run, PARTS)


def open_nodes(found: DataFrame, blocks: int) -> DataFrame:
    """Open nodes with all their fragments: start, depth, conv_id, parent_start, counts, and what lies below them."""
    fragments = found.where("open")
    merged = fragments.groupBy("start", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.min("parent_start").alias("parent_start"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("bytes").alias("bytes"), F.max("block").alias("last"),
    )
    own = merged.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saves", (F.col("n_convs") - 1) * F.col("bytes"))
    deeper = W.partitionBy("start").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    inside = own.withColumns({"leaf_in": F.sum("leaf").over(deeper), "saves_in": F.sum("saves").over(deeper)})
    # one row a block: sums of the open nodes that start before it
    each = own.groupBy(F.col("start").alias("block")).agg(F.sum("leaf").alias("l"), F.sum("saves").alias("s"))
    dense = found.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block")).join(each, "block", "left")
    upto = W.orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    sums = dense.select("block", F.sum(F.coalesce("l", F.lit(0))).over(upto).alias("l"), F.sum(F.coalesce("s", F.lit(0))).over(upto).alias("s"))
    low = sums.select(F.col("block").alias("start"), F.col("l").alias("l0"), F.col("s").alias("s0"))
    high = sums.select((F.col("block") + 1).alias("last"), F.col("l").alias("l1"), F.col("s").alias("s1"))
    between = inside.join(low, "start").join(high, "last")
    return between.select("start", "depth", "conv_id", "parent_start", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf_in") + F.col("l1") - F.col("l0")).alias("n_leaves"), (F.col("saved_tokens") + F.col("saves_in") + F.col("s1") - F.col("s0")).alias("saved_tokens"))


def open_digests(found: DataFrame) -> DataFrame:
    """start, depth and the SHA-256 of the ids that end at an open node; a task reads the packed ids of a node as a stream."""

    def run(batches):
        key, sha = None, None
        for b in batches:
            done = []
            for start, depth, ends in zip(b.column("start").to_pylist(), b.column("depth").to_pylist(), b.column("ends").to_pylist()):
                if (start, depth) != key:
                    if key:
                        done.append((*key, sha.hexdigest()))
                    key, sha = (start, depth), hashlib.sha256(ends)
                else:
                    sha.update(b"," + ends)
            yield batch(done)
        if key:
            yield batch([(*key, sha.hexdigest())])

    def batch(rows):
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["start", "depth", "ends_sha256"])

    pieces = found.where("open AND piece > 0").select("start", "depth", "block", "piece", "ends")
    return pieces.repartition("start", "depth").sortWithinPartitions("start", "depth", "block", "piece").mapInArrow(run, "start int, depth long, ends_sha256 string")


def trie(seqs: DataFrame) -> DataFrame:
    """One row for each distinct prefix of (conv_id, records) rows with different conv_ids, the empty one included.

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. Copies meet in one node; without conversations there is no node, not even a root.
    """
    n = partitions(seqs.sparkSession)
    dealt = seqs.select("conv_id", "records").repartitionByRange(n, "records", "conv_id").withColumn("block", F.spark_partition_id())
    rows = save(dealt, "trie-rows")
    minima = block_minima(rows)
    found = save(parts(rows, minima, 1 + max((b for b, _, _ in minima), default=0)), "trie-parts")
    drop(rows)
    opened = save(open_nodes(found, len(minima)), "trie-open")
    values = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    # of each block, the open nodes that reach it: nodes inside look up their parents among these, not among one root
    reach = found.where("open AND piece = 0").select("block", "start", "depth")
    ids = opened.select("start", "depth", F.col("conv_id").alias("parent"))
    parents = reach.join(ids, ["start", "depth"]).select("block", F.col("start").alias("parent_start"), F.col("depth").alias("above"), "parent")
    closed = found.where("NOT open")
    settled = closed.where("parent_start IS NULL").select("conv_id", "depth", "parent_conv_id", *values, "ends_sha256")
    below = closed.where("parent_start IS NOT NULL").withColumn("above", F.col("depth") - 1).join(parents, ["block", "parent_start", "above"])
    below = below.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), *values, "ends_sha256")
    above = ids.select(F.col("start").alias("parent_start"), (F.col("depth") + 1).alias("depth"), "parent")
    top = opened.join(above, ["parent_start", "depth"], "left").join(open_digests(found), ["start", "depth"], "left")
    top = top.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), *values, F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"))
    return settled.unionByName(below).unionByName(top)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of (conv_id, turn, role, text) rows; further columns play no part. See sequences() and trie()."""
    return trie(sequences(conversations))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return trie(rebuilt(sequences(conversations)))


#: CRC-32 of the decimal id bit by bit; paths as digests of turn digests; sums below a node over its members' paths.
OP12_SQL = r"""
WITH t AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, strlen(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, g, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS p FROM t),
h AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0]))),
    lambda x, y: CASE WHEN y > 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END), 4294967295::BIGINT) % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT h.conv_id, 0 AS part, o.p, o.g, o.n FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 5 AND o.p <= h.h UNION ALL SELECT h.conv_id, 1, o.p, o.g, o.n FROM h JOIN o USING (conv_id) WHERE o.p > h.h),
d AS (SELECT conv_id, g, n, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS depth FROM r),
path AS MATERIALIZED (SELECT conv_id, depth, md5(string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k, n FROM d UNION ALL SELECT conv_id, 0, '', 0 FROM h),
size AS (SELECT conv_id, max(depth) AS size FROM path GROUP BY conv_id),
node AS MATERIALIZED (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth), '') AS ends FROM path JOIN size USING (conv_id) GROUP BY depth, k),
up AS MATERIALIZED (SELECT node.depth, node.k, parent.k AS pk, pn.conv_id AS parent_conv_id FROM node JOIN path parent ON parent.conv_id = node.conv_id AND parent.depth = node.depth - 1 JOIN node pn ON pn.depth = parent.depth AND pn.k = parent.k),
kids AS (SELECT depth - 1 AS depth, pk AS k, count(*) AS n_children FROM up GROUP BY depth, pk),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (depth, k)),
below AS (SELECT p.depth, p.k, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.n) AS saved_tokens FROM full_node x JOIN path p ON p.conv_id = x.conv_id AND p.depth <= x.depth GROUP BY p.depth, p.k)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, up.parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_node f JOIN below b USING (depth, k) LEFT JOIN up USING (depth, k)
"""
