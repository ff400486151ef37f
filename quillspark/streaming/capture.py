"""Structured Streaming: turn capture and session state (ST1, ST4-ST6, SNK1)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import normalize
from ..plans.session import ENDS, settings, work_folder

TURNS = "conv_id bigint, turn bigint, role string, text string"


def turn_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Turns from Parquet files as they arrive in a folder; a path of one file streams this file of its folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop)
    reader = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", files)
    if status.isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def capture_turns(turns: DataFrame, out: str, checkpoint: str):
    """ST5, SNK1: appends every turn, and a pending enrichment row for each assistant turn, from one batch.

    A batch that is run again after a failure writes to the same folders, so nothing is captured twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("normalized", normalize("text"))
        rows.write.mode("overwrite").parquet(f"{out}/turns/batch={number}")
        pending = batch.where("role = 'assistant'").select("conv_id", "turn", F.lit("pending_curation").alias("status"))
        pending.write.mode("overwrite").parquet(f"{out}/enrichment/batch={number}")

    return turns.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def captured(spark: SparkSession, path: str) -> DataFrame:
    """Captures all turns of a folder, then counts turns and pending rows of each conversation."""
    work = work_folder(spark, "stream")
    capture_turns(turn_stream(spark, path), f"{work}/out", f"{work}/checkpoint").awaitTermination()
    turns, pending = spark.read.parquet(f"{work}/out/turns"), spark.read.parquet(f"{work}/out/enrichment")
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("normalized")).alias("characters"))
    waiting = pending.groupBy("conv_id").agg(F.count(F.lit(1)).alias("pending"))
    return counts.join(waiting, "conv_id", "left").na.fill(0, ["pending"])


#: Milliseconds after which the state of an idle session goes.
IDLE_MS = 6 * 3600 * 1000
_STATE = "turns bigint, questions bigint, users bigint"
_OUT = "conv_id bigint, turns bigint, questions bigint, users bigint, completed boolean"


def _session(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    turns, questions, users = state.get if state.exists else (0, 0, 0)
    for f in frames:
        turns += len(f)
        users += int((f["role"] == "user").sum())
        questions += int(((f["role"] == "assistant") & f["text"].fillna("").str.strip().str.endswith("?")).sum())
    state.update((turns, questions, users))
    state.setTimeoutDuration(IDLE_MS)
    yield pd.DataFrame([(key[0], turns, questions, users, min(questions, 3) >= 3)], columns=["conv_id", "turns", "questions", "users", "completed"])


def session_states(turns: DataFrame) -> DataFrame:
    """ST1, ST4: a snapshot of the counts of a session for each batch that has turns of it; the state of a session without turns for IDLE_MS goes."""
    return turns.groupBy("conv_id").applyInPandasWithState(_session, _OUT, _STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def session_counts(spark: SparkSession, path: str) -> DataFrame:
    """The last snapshot of every session after all files of a folder."""
    work = work_folder(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{work}/out/batch={number}")

    with settings(spark, ENDS):
        q = session_states(turn_stream(spark, path)).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{work}/out")
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct("turns", "questions", "users", "completed"), "number").alias("s"))
    return last.select("conv_id", "s.turns", "s.questions", "s.users", "s.completed")
