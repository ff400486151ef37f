"""Session settings and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_FOLDERS: dict[str, str] = {}


def session(app: str = "quillspark", master: str | None = None, **conf) -> SparkSession:
    """A session in UTC with adaptive execution; a master and further settings are the caller's."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | {k.replace("__", "."): str(v) for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings for what is started inside, put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


#: A query that ends when all has been read must not go on with batches that fire timers only.
ENDS = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary folder on a local master; on a cluster executors could not see one, so an error is raised."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="quillspark-")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; what is written there goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{shared_root(spark)}/work-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _FOLDERS[app])
    return f"{_FOLDERS[app]}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone already
        pass


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """`df` as a table in the shared folder: its lineage is cut, and several uses compute it once."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def unstored(df: DataFrame) -> None:
    """Deletes a table of stored() that nothing reads any more."""
    _remove(df.sparkSession, df._quill_path)


def row_numbers(rows: DataFrame, order: list, name: str, buckets: int = 512) -> DataFrame:
    """`rows` with their numbers, from 1, in the order of some columns.

    Rows are range-partitioned, numbered inside their partition and moved up by the counts of the partitions
    before, so no task sorts all rows.
    """
    keyed = rows.withColumn("_k", F.struct(*order))
    # stored: range bounds come from a sample, and a second evaluation could draw others
    dealt = stored(keyed.repartitionByRange(buckets, "_k").withColumn("_p", F.spark_partition_id()), "dealt")
    inside = dealt.withColumn("_n", F.row_number().over(W.partitionBy("_p").orderBy("_k")))
    counts = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    return inside.join(F.broadcast(before), "_p").withColumn(name, F.col("_n") + F.col("_b")).drop("_k", "_p", "_n", "_b")
