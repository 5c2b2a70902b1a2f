"""The append-only log as a stream: current rows by key, kept in a folder by micro-batches and compacted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from plumbline.shared import children, point_to, pointed_at, remove

#: Micro-batches between two snapshots.
COMPACT_EVERY = 16


def _numbered(spark: SparkSession, folder: str, kind: str) -> list[int]:
    return sorted(int(n.partition("=")[2]) for n in children(spark, folder) if n.startswith(f"{kind}="))


def current_rows(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """key and status of every key that a stream has kept in ``folder``.

    Read are the snapshot that the folder points at and the batches after it,
    at most one round of them, however many batches have been written.
    """
    named = pointed_at(spark, folder)
    last = int(named) if named else -1
    parts = [spark.read.schema(schema).parquet(f"{folder}/snapshot={last}").withColumn("batch", F.lit(last).cast("bigint"))] if named else []
    parts += [spark.read.schema(schema).parquet(f"{folder}/batch={n}").withColumn("batch", F.lit(n).cast("bigint")) for n in _numbered(spark, folder, "batch") if n > last]
    if not parts:
        return spark.createDataFrame([], schema)
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("key").agg(F.max_by("status", "batch").alias("status"))


def compact(spark: SparkSession, folder: str, schema: T.StructType, batch: int) -> None:
    """Writes all current rows as a new snapshot, points the folder at it, and removes what no reader needs.

    Files of the snapshot before stay, for readers that have already begun. A
    failure before the pointer moves leaves the old state, and the snapshot is
    written again.
    """
    before = pointed_at(spark, folder)
    current_rows(spark, folder, schema).write.mode("overwrite").parquet(f"{folder}/snapshot={batch}")
    point_to(spark, folder, str(batch))
    least = int(before) if before else -1
    for n in _numbered(spark, folder, "snapshot"):
        if n < least:
            remove(spark, f"{folder}/snapshot={n}")
    for n in _numbered(spark, folder, "batch"):
        if n <= least:
            remove(spark, f"{folder}/batch={n}")


def stream_status_counts(log: DataFrame, key: str, status: str, order_cols: Sequence[str], checkpoint: str, table: str,
                         compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Starts a query that keeps the current status of every key seen; the view ``table`` shows key and status.

    The state is one row per key: the row with the greatest order columns. Each
    micro-batch writes the keys that it changed to a Parquet folder beside the
    checkpoint, one subfolder a batch, so a batch that is run again replaces
    what it wrote. Every ``compact_every`` batches all rows become one snapshot,
    which a pointer names; the view reads that and the batches after it. Nothing
    is collected.
    """
    spark, folder = log.sparkSession, f"{checkpoint}-rows"
    current = log.groupBy(F.col(key).alias("key")).agg(F.max_by(F.col(status), F.struct(*order_cols)).alias("status"))

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/batch={batch}")
        if batch % compact_every == compact_every - 1:
            compact(spark, folder, current.schema, batch)
        current_rows(spark, folder, current.schema).createOrReplaceTempView(table)

    current_rows(spark, folder, current.schema).createOrReplaceTempView(table)
    return (current.writeStream.outputMode("update").foreachBatch(keep)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
