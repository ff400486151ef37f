"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table. The shards take turns, each claiming
the first slot of its permutation that is still free, until the table is full. A document's slot is a hash of
its key; the broadcast table turns the slot into a shard in constant time. When a shard is added or removed,
most slots keep their owner.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the production table, a prime; at most this many rows are broadcast.
SLOTS = 65537
SHARDS = 64
MAX_SLOTS = 1_000_003


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: int | list[str], slots: int = SLOTS) -> list[int]:
    """The number of the owning shard for every slot. shards: a count or the shards' names."""
    names = [f"shard-{i:05d}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    if not names or len(set(names)) < len(names):
        raise ValueError("shards must be named, once each")
    if not _prime(slots) or slots > MAX_SLOTS or slots < len(names):
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    state = []
    for name in names:
        d = hashlib.md5(name.encode()).digest()
        state.append([int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:], "big") % (slots - 1) + 1])
    table = [-1] * slots
    free = slots
    while True:
        for i, turn in enumerate(state):
            at, skip = turn
            while table[at] >= 0:
                at = (at + skip) % slots
            table[at] = i
            turn[0] = (at + skip) % slots
            free -= 1
            if not free:
                return table


def slot_of(key: str, slots: int = SLOTS):
    """The slot of a key column: the first 32 bits of the MD5 of its text, modulo the table's size. A null key counts as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % slots


def shard(docs: DataFrame, shards: int | list[str] = SHARDS, slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """`docs` with columns slot and shard; columns of these names are replaced, all others stay.

    Rows with equal keys share a shard, a null key counts as an empty text, an empty table stays empty.
    """
    table = docs.sparkSession.createDataFrame(list(enumerate(lookup_table(shards, slots))), "_quill_slot long, _quill_shard int")
    placed = docs.drop("slot", "shard").withColumn("slot", slot_of(key, slots))
    return placed.join(F.broadcast(table), placed["slot"] == table["_quill_slot"]).drop("_quill_slot").withColumnRenamed("_quill_shard", "shard")


def write_shards(docs: DataFrame, path: str, shards: int | list[str] = SHARDS, slots: int = SLOTS, key: str = "doc_id", files: int = 8) -> None:
    """One folder for each shard. A shard's rows are dealt over `files` tasks, so no task holds a whole shard."""
    n = shards if isinstance(shards, int) else len(shards)
    placed = shard(docs, shards, slots, key).withColumn("_quill_file", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(files)))
    placed.repartition(n * files, "shard", "_quill_file").drop("_quill_file").write.partitionBy("shard").parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"))


def op10_sql() -> str:
    table = ",".join(map(str, lookup_table(SHARDS, SLOTS)))
    return f"""
    WITH s AS (SELECT doc_id, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % {SLOTS} AS slot FROM documents),
    t AS (SELECT unnest(range({SLOTS})) AS slot, CAST(unnest([{table}]) AS INTEGER) AS shard)
    SELECT s.doc_id, s.slot, t.shard FROM s JOIN t ON s.slot = t.slot
    """
