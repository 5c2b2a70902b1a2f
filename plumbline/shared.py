"""Where a job may put files that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one the cluster names, or a new one of a local session that names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="plumbline-checkpoint-"))
    return sc.getCheckpointDir()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that Spark reads exists."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Rows that one task of a shuffle takes, about.
ROWS_PER_TASK = 1_000_000


def dealt(df: DataFrame, rows: int, *cols: str) -> DataFrame:
    """``df`` dealt by ``cols`` over so many tasks that none takes many more than ``ROWS_PER_TASK`` of its ``rows``; as it is if the usual number of tasks does."""
    tasks = -(-rows // ROWS_PER_TASK)
    return df.repartition(tasks, *cols) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def settled(df: DataFrame) -> DataFrame:
    """The rows of ``df`` in a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def point_to(spark: SparkSession, folder: str, name: str) -> None:
    """Makes ``name`` the current version of a folder, at once for every reader: one file of that name comes into being by a rename."""
    old = _pointers(spark, folder)
    number = old[-1][0] + 1 if old else 1
    paths = spark._jvm.org.apache.hadoop.fs.Path
    made, final = paths(f"{folder}/_current/.{uuid.uuid4().hex}"), paths(f"{folder}/_current/{number:012d}-{name}")
    fs = made.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.create(made, False).close()
    if not fs.rename(made, final):
        raise FileExistsError(str(final))
    for n, gone in old[:-1]:                                     # a reader may just have read the last one
        remove(spark, f"{folder}/_current/{n:012d}-{gone}")


def pointed_at(spark: SparkSession, folder: str) -> str | None:
    """The current version of a folder."""
    known = _pointers(spark, folder)
    return known[-1][1] if known else None


def _pointers(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    names = [n.partition("-") for n in children(spark, f"{folder}/_current") if not n.startswith(".")]
    return sorted((int(n), name) for n, _, name in names)
