"""Session helpers: tables by name, and cutting of lineage in the shared folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Read from spark.checkpoint.dir; only where that is unset
    (tests, a single machine) a temporary folder is taken and remembered in the session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lattica.shared.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("lattica.shared.dir", found)
    return found.rstrip("/")


#: Spark's setting by which the shuffle files of a statement are deleted when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as a table in the shared folder and read it back: the plan that follows is short, and
    a lost executor costs one read, not the whole history. The shuffle files that made it are deleted with the write. The table lives until discard(), sweep(), or as long as the folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica-{name}-{uuid.uuid4().hex}"
    with _shuffles_end(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lattica_path = path
    _kept.append(path)
    return out


#: Tables of this driver that are still there.
_kept: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _kept:
        _kept.remove(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by cut() that nothing reads any more."""
    if path := getattr(df, "_lattica_path", None):
        _delete(df.sparkSession, path)


def sweep(spark: SparkSession) -> int:
    """Delete all tables that cut() made and nobody discarded; for when the results of all queries so far are written. How many there were."""
    n = len(_kept)
    for path in list(_kept):
        _delete(spark, path)
    return n
