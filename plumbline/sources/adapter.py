"""Raw pairwise judgments to preference, verdict and held-out records."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plumbline.shared import children, exists, point_to, pointed_at, remove

#: Winner values of raw judgments that become labels; fixed values.
WINNERS = {"model_a": "A", "model_b": "B", "tie": "tie", "tie (bothbad)": "tie"}
#: Winner value of a judge that contradicted itself in the two slot orders; a fixed value.
INCONSISTENT = "tie (inconsistent)"


def winner_label(winner: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for raw, label in WINNERS.items():
        out = out.when(winner == raw, F.lit(label))
    return out


def canonical_slots(judgments: DataFrame) -> DataFrame:
    """Puts the systems in order of their names; where that swaps them, conversations and winner go along."""
    swap = F.col("model_a") > F.col("model_b")
    flipped = F.when(F.col("winner") == "model_a", F.lit("model_b")).when(F.col("winner") == "model_b", F.lit("model_a")).otherwise(F.col("winner"))
    changes = {"model_a": F.least("model_a", "model_b"), "model_b": F.greatest("model_a", "model_b"),
               "winner": F.when(swap, flipped).otherwise(F.col("winner"))}
    if "conversation_a" in judgments.columns:
        changes |= {"conversation_a": F.when(swap, F.col("conversation_b")).otherwise(F.col("conversation_a")),
                    "conversation_b": F.when(swap, F.col("conversation_a")).otherwise(F.col("conversation_b"))}
    return judgments.withColumns(changes)


def item_id() -> Column:
    return F.concat(F.lit("q"), F.col("question_id").cast("string"), F.lit("-t"), F.col("turn").cast("string"), F.lit("-"),
                    F.col("model_a"), F.lit("-vs-"), F.col("model_b"))


def with_items(judgments: DataFrame) -> DataFrame:
    """Canonical judgments with id and cluster_id (the question)."""
    return with_ids(canonical_slots(judgments))


def with_ids(canonical: DataFrame) -> DataFrame:
    return canonical.withColumns({"id": item_id(), "cluster_id": F.concat(F.lit("q"), F.col("question_id").cast("string"))})


def is_pair(pair: tuple[str, str]) -> Column:
    first, second = sorted(pair)
    return F.array_sort(F.array("model_a", "model_b")) == F.array(F.lit(first), F.lit(second))


def turn_slice(conversation: Column, turn: Column) -> Column:
    """struct(prompt, response, context) of the given turn (from 1) of a whole transcript."""
    return F.struct(
        F.get(conversation, 2 * turn - 2)["content"].alias("prompt"), F.get(conversation, 2 * turn - 1)["content"].alias("response"),
        F.transform(F.slice(conversation, F.lit(1), 2 * (turn - 1)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("text"))).alias("context"))


def _texts(items: DataFrame) -> DataFrame:
    if "conversation_a" not in items.columns:
        return items
    return items.withColumns({"_a": turn_slice(F.col("conversation_a"), F.col("turn")), "_b": turn_slice(F.col("conversation_b"), F.col("turn"))})


def _text_columns(items: DataFrame) -> list[Column]:
    if "_a" not in items.columns:
        return []
    return [F.col("_a.prompt").alias("prompt"), F.col("_a.response").alias("response_a"), F.col("_b.response").alias("response_b"),
            F.col("_a.context").alias("context_a"), F.col("_b.context").alias("context_b")]


def preference_records(items: DataFrame, held_out: tuple[str, str], judge_col: str = "judge") -> DataFrame:
    """One labelled record per judgment outside the held-out pair; winners without a label are dropped."""
    rows = _texts(items).filter(~is_pair(held_out)).withColumn("preferred", winner_label(F.col("winner"))).filter("preferred is not null")
    return rows.select("id", "cluster_id", F.col("model_a").alias("system_a"), F.col("model_b").alias("system_b"), "preferred",
                       F.col(judge_col).alias("annotator_id"), *_text_columns(rows))


def verdict_records(items: DataFrame) -> DataFrame:
    """A judge's recorded verdicts, all pairs: inconsistent ones are unstable ties, unknown winners are dropped."""
    unstable = F.col("winner") == INCONSISTENT
    rows = items.withColumns({"position_unstable": unstable, "label": F.when(unstable, F.lit("tie")).otherwise(winner_label(F.col("winner")))})
    return rows.filter("label is not null").select("id", F.col("label").alias("winner"), "position_unstable")


def held_out_records(items: DataFrame, held_out: tuple[str, str], ord_col: str) -> DataFrame:
    """The first seen row of every held-out item, without labels; its winner does not matter."""
    rows = _texts(items).filter(is_pair(held_out))
    kept = rows.select("id", F.col(ord_col).alias("_ord"), F.struct(
        "cluster_id", F.col("model_a").alias("system_a"), F.col("model_b").alias("system_b"), *_text_columns(rows)).alias("r"))
    return kept.groupBy("id").agg(F.min_by("r", "_ord").alias("r")).select("id", "r.*")


def write_datasets(items: DataFrame, path: str, held_out: tuple[str, str], ord_col: str, overwrite: bool = False,
                   keep_finished: bool = False) -> dict[str, int]:
    """Writes preferences, verdicts and held-out records as JSON Lines folders; rows written of each.

    Without ``overwrite`` an existing folder is an error, found before anything
    is written. With ``keep_finished`` nothing is written if all three folders
    are there and finished, and the result is empty; else all are written anew.
    """
    spark = items.sparkSession
    there = [name for name in ("preferences", "verdicts", "held_out") if exists(spark, f"{path}/{name}")]
    if keep_finished and not overwrite:
        if all(exists(spark, f"{path}/{name}/_SUCCESS") for name in there) and len(there) == 3:
            return {}
        overwrite = True
    if there and not overwrite:
        raise FileExistsError(f"already exists: {', '.join(there)} in {path}")
    parts = datasets(items, held_out, ord_col)
    return {name: _counted_json(df, f"{path}/{name}", "overwrite" if overwrite else "errorifexists", "none") for name, df in parts.items()}


def datasets(items: DataFrame, held_out: tuple[str, str], ord_col: str) -> dict[str, DataFrame]:
    return {"preferences": preference_records(items, held_out), "verdicts": verdict_records(items), "held_out": held_out_records(items, held_out, ord_col)}


def _counted_write(df: DataFrame, path: str, mode: str) -> int:
    """A part of a published set, gzipped."""
    return _counted_json(df, path, mode, "gzip")


def _counted_json(df: DataFrame, path: str, mode: str, compression: str) -> int:
    rows = Observation(path.rpartition("/")[2])
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path, compression=compression)
    return rows.get["n"]


def publish_datasets(items: DataFrame, path: str, held_out: tuple[str, str], ord_col: str) -> dict[str, int]:
    """Writes the three datasets as one set of gzipped JSON Lines and makes it the current one; rows written of each.

    A set is a folder of its own; a pointer names the current one and moves once
    all three are whole. A reader sees the set before or the new one, never
    parts of both; a job that dies leaves the old set. The set before stays for
    readers that have begun, older ones go.
    """
    spark, name = items.sparkSession, f"set-{uuid.uuid4().hex}"
    written = {part: _counted_write(df, f"{path}/{name}/{part}", "errorifexists") for part, df in datasets(items, held_out, ord_col).items()}
    before = pointed_at(spark, path)
    point_to(spark, path, name)
    for old in children(spark, path):
        if old.startswith("set-") and old not in (name, before):
            remove(spark, f"{path}/{old}")
    return written


def published(spark: SparkSession, path: str) -> dict[str, str]:
    """Folders of the current set: preferences, verdicts and held_out. An error if there is none."""
    name = pointed_at(spark, path)
    if name is None:
        raise FileNotFoundError(f"no published datasets in {path}")
    return {part: f"{path}/{name}/{part}" for part in ("preferences", "verdicts", "held_out")}


def leaked_items(preferences: DataFrame, held_out: DataFrame) -> DataFrame:
    """Ids that are both in the calibration data and held out; should be empty."""
    return preferences.select("id").intersect(held_out.select("id"))


def text_key(text: Column) -> Column:
    """Digest of a text without regard to case and white space."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), 256)


def leaked_texts(calibration: DataFrame, held_out: DataFrame, text_cols: Sequence[str], id_col: str = "row_id") -> DataFrame:
    """Texts that stand in both splits, whatever their ids: text_key, n_calibration, n_held_out, first ids of both.

    Only digests move, and each side is reduced to one row per digest before
    they meet, so copies cost nothing; nulls and blank texts do not count.
    """
    def keyed(rows: DataFrame, name: str) -> DataFrame:
        texts = rows.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.col(c) for c in text_cols])).alias("text")).filter(F.length(F.trim("text")) > 0)
        return texts.select("id", text_key(F.col("text")).alias("text_key")).groupBy("text_key").agg(
            F.count(F.lit(1)).alias(f"n_{name}"), F.min("id").alias(f"first_{name}"))

    return keyed(calibration, "calibration").join(keyed(held_out, "held_out"), "text_key")
