"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.shared import shared_folder


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a
    local session without that setting (tests) gets a folder of its own; on a
    cluster a missing setting is an error, since a machine-local folder would
    not survive the loss of an executor.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id, m: int):
    """crc32 of the id written as text, modulo ``m``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(m)


def give_back() -> None:
    """Gives memory that has been freed back to the system, which the allocators of this process would else keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)           # glibc only
    if trim:
        trim(0)


#: Batches after which a worker gives back what it has freed.
TIDY_EVERY = 8


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function of batches, which on its way and at the end gives the memory it has freed back to the system.

    Python workers outlive their tasks, and what one operator has freed would
    else stay with the idle worker while another runs.
    """
    def tidied(batches: Iterator) -> Iterator:
        for n, batch in enumerate(run(batches), 1):
            yield batch
            if n % TIDY_EVERY == 0:
                give_back()
        gc.collect()
        give_back()

    return tidied


#: Keys of a few bytes that may be broadcast; of more of them a filter is.
MAX_BROADCAST_KEYS = 1_000_000
#: Bits of a filter for each key, and binary digits of the least and the most bits of all (4 kB, 32 MB).
FILTER_BITS, LEAST_DIGITS, MOST_DIGITS = 64, 15, 28


def with_filter(rows: DataFrame, keys: DataFrame, on: list[str], n_keys: int) -> DataFrame:
    """``rows`` with a column ``_may``: false only where no row of ``keys`` has the same ``on``, columns of equal types.

    A broadcast bitmap of hashes. While it has 64 bits a key, at most about one
    row in 64 is true by chance; it stops growing at four million keys.
    """
    bits = 1 << max(LEAST_DIGITS, min(MOST_DIGITS, (FILTER_BITS * n_keys).bit_length()))
    slot = F.pmod(F.xxhash64(*on), F.lit(bits))
    word, place = F.shiftright(slot, 15), slot.bitwiseAND(F.lit((1 << 15) - 1))
    maps = keys.select(word.alias("_word"), place.alias("_place")).groupBy("_word").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    return rows.withColumn("_word", word).join(F.broadcast(maps), "_word", "left").withColumn("_may", may).drop("_word", "_bits")


def keyed_by(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """left_semi or left_anti join of wide rows with keys (columns ``on``), without a shuffle of most rows that match none.

    Few keys are broadcast; of many a filter is, and only rows that pass it are
    shuffled. ``keys`` is counted, so it should be materialised.
    """
    n = keys.count()
    if n <= MAX_BROADCAST_KEYS:
        return rows.join(F.broadcast(keys), on, how)
    told = with_filter(rows, keys, on, n)
    met = told.filter("_may").drop("_may").join(keys, on, how)
    return met if how == "left_semi" else met.unionByName(told.filter(~F.col("_may")).drop("_may"))


#: A key counts as hot when it has more than this share of all rows, so there are fewer than 1 / HOT_SHARE hot keys.
HOT_SHARE = 1e-3


def join_by_hot_key(big: DataFrame, keyed: DataFrame, on: list[str], count_col: str, total: int, how: str = "inner") -> DataFrame:
    """big JOIN keyed, where ``keyed`` has one row per key and its number of rows in ``big``.

    Keys with more than ``HOT_SHARE`` of ``total`` rows are broadcast: their
    number is below 1 / HOT_SHARE whatever the data. All others are shuffled,
    and the hot rows are not part of that shuffle. ``how``: inner or left.
    """
    limit = total * HOT_SHARE
    hot = keyed.filter(F.col(count_col) > limit)
    cold = keyed.filter(F.col(count_col) <= limit)
    added = [c for c in keyed.columns if c not in on]
    tagged = big.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), on, "left")
    done = tagged.filter(F.col("_hot")).drop("_hot")
    rest = tagged.filter(F.col("_hot").isNull()).drop("_hot", *added)
    return done.unionByName(rest.join(cold, on, how).select(done.columns))
