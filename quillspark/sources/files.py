"""Marker files of tables that grow by whole batches."""

from __future__ import annotations

from pyspark.sql import SparkSession


def files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _markers(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    fs, at = files(spark, f"{path.rstrip('/')}/batch-*.done")
    names = [s.getPath().getName()[6:-5] for s in fs.globStatus(at) or []]
    return sorted((int(n.removesuffix("-whole")), n.endswith("-whole")) for n in names)


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that count: those from the last one on that holds the whole table."""
    found = _markers(spark, path)
    start = max((n for n, whole in found if whole), default=0)
    return [n for n, _ in found if n >= start]


def commit(spark: SparkSession, path: str, number: int, whole: bool = False) -> None:
    """Marks a batch; fails where another writer has marked its number already. whole: the batches before no longer count."""
    for suffix in ("", "-whole"):
        fs, at = files(spark, f"{path.rstrip('/')}/batch-{number}{suffix}.done")
        if fs.exists(at):
            raise FileExistsError(f"another writer has committed batch {number} of {path}")
    fs, at = files(spark, f"{path.rstrip('/')}/batch-{number}{'-whole' if whole else ''}.done")
    fs.create(at, False).close()


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, at = files(spark, path)
        fs.delete(at, True)
