"""Helpers that keep plans safe at scale: cutting lineage through a shared folder, checked broadcasts, salted joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only after its rows were counted and their estimated bytes stay below this.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Only a session on one machine (tests)
    may go without: it gets a temporary one. On a cluster a folder of the driver's machine would be of no use to the
    executors, so an unset one is an error there."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lanternq.local.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lanternq-")
        spark.conf.set("lanternq.local.dir", path)
    return path.rstrip("/")


def _app_dir(spark: SparkSession) -> str:
    """Where this application's tables lie; what is there is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/lanternq/{spark.sparkContext.applicationId}"
    if path not in _TO_DELETE:
        _TO_DELETE.add(path)
        atexit.register(delete_tables, spark, path)
    return path


_TO_DELETE: set[str] = set()


def delete_tables(spark: SparkSession, path: str | None = None) -> None:
    """Deletes the tables :func:`cut` wrote in this application. Frames that still read them can't be used after."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path or _app_dir(spark))
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001, S110 - the session may be gone already
        if (path or "").startswith("file://"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` once as a table in the shared folder and returns a scan of it. What follows no longer depends on
    the executors that computed it, and nothing upstream is computed twice."""
    spark = df.sparkSession
    path = f"{_app_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table that lies in fewer pieces than half the tasks that could read it (one small file), spread over them all
    by its key; any other as it is. Tables of many files are never shuffled for it."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks, key) if 2 * df.rdd.getNumPartitions() <= tasks else df


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """``df`` (a cheap scan, e.g. from :func:`cut`) with a broadcast hint if its counted size is below ``limit``."""
    small = df.count() * row_bytes <= limit
    return (F.broadcast(df) if small else df), small


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: str, how: str = "inner", salts: int = 16, row_bytes: int = 64) -> DataFrame:
    """Equi-join of a large, possibly skewed ``left`` with an aggregated ``right`` (a :func:`cut` table, unique in
    ``on``). Small right sides are broadcast; else the right side is copied to ``salts`` salts and the left side picks
    one by the hash of its column ``spread``, so that no key, however hot, falls into one task."""
    right, small = broadcast_if_small(right, row_bytes)
    if small:
        return left.join(right, on, how)
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread)), F.lit(salts)).cast("int")).join(salted, [*on, "_salt"], how).drop("_salt")


def digest(*cols: Column) -> tuple[Column, Column]:
    """A 128-bit fingerprint of the columns as two bigints."""
    return F.xxhash64(*cols), F.xxhash64(F.lit("lanternq"), *cols)
