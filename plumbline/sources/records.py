"""Comparison and verdict records: reading, normalising and merging them into one row per item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.shared import settled

RECORD_SCHEMA = (
    "id string, prompt string, response_a string, response_b string, preferred string, annotator_id string, "
    "annotations array<struct<preferred:string,annotator_id:string>>, cluster_id string, system_a string, system_b string, "
    "context_a array<array<string>>, context_b array<array<string>>")
VERDICT_SCHEMA = "id string, winner string, position_unstable boolean"
JUDGMENT_SCHEMA = (
    "question_id bigint, model_a string, model_b string, winner string, judge string, turn int, "
    "conversation_a array<struct<role:string,content:string>>, conversation_b array<struct<role:string,content:string>>")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines with an explicit schema; blank lines are skipped, a malformed line raises. Ids are read as text.

    ``ord`` keeps the order of the input: file, then block, then line.
    """
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.withColumn("ord", F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line")))


def read_comparison_records(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, RECORD_SCHEMA)


def read_verdict_records(spark: SparkSession, path: str) -> DataFrame:
    rows = read_json_lines(spark, path, VERDICT_SCHEMA)
    return rows.withColumn("position_unstable", F.coalesce("position_unstable", F.lit(False)))


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, JUDGMENT_SCHEMA)


def annotations_column() -> Column:
    """``annotations`` where not null (even if empty), else the single label, else an empty list."""
    empty = F.array().cast("array<struct<preferred:string,annotator_id:string>>")
    return (F.when(F.col("annotations").isNotNull(), F.col("annotations"))
            .when(F.col("preferred").isNotNull(), F.array(F.struct("preferred", "annotator_id")))
            .otherwise(empty))


def context_column(name: str) -> Column:
    """(role, text) pairs as structs; null is an empty list."""
    return F.transform(F.coalesce(name, F.array().cast("array<array<string>>")),
                       lambda p: F.struct(F.get(p, F.lit(0)).alias("role"), F.get(p, F.lit(1)).alias("text")))


def content_key() -> Column:
    """Stands for an id where there is none: the three texts, joined by a separator that marks their ends."""
    return F.concat(F.lit("__"), F.concat_ws("\x1f", "prompt", "response_a", "response_b"))


def merge_records(records: DataFrame, ord_col: str = "ord") -> DataFrame:
    """One row per item: scalar fields of the first record, labels of all records in input order.

    Records with an id are one item per id, the others one item per content;
    the key says which, so an id never meets a content. Only a hash of the
    content is grouped on, and the labels are aggregated apart from the texts.
    """
    records = _with_optional(records)
    keyed = records.select(
        _item_key().alias("key"),
        F.col(ord_col).alias("ord"), annotations_column().alias("labels"),
        F.struct(F.coalesce("id", content_key()).alias("row_id"), "prompt", "response_a", "response_b", "cluster_id", "system_a",
                 "system_b", context_column("context_a").alias("context_a"), context_column("context_b").alias("context_b")).alias("base"))
    merged = keyed.groupBy("key").agg(
        F.min_by("base", "ord").alias("base"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "labels"))), lambda x: x["labels"])).alias("annotations"))
    return merged.select(
        "base.row_id", "base.prompt", "base.response_a", "base.response_b", "annotations",
        F.coalesce(F.nullif(F.col("base.cluster_id"), F.lit("")), F.col("base.row_id")).alias("cluster_id"),
        "base.system_a", "base.system_b", "base.context_a", "base.context_b")


def _item_key() -> Column:
    return (F.when(F.col("id").isNotNull(), F.struct(F.lit("id").alias("kind"), F.col("id").alias("value")))
            .otherwise(F.struct(F.lit("content").alias("kind"), F.sha2(content_key(), 256).alias("value"))))


def merged_labels(records: DataFrame, ord_col: str = "ord") -> DataFrame:
    """The labels of ``merge_records`` as rows: row_id, ann_ord (from 1), preferred, annotator_id.

    No item's labels are ever one array or one task's work: records are ranged
    by item and order, labels are numbered inside each range, and what the
    ranges before hold of the same item is added. An item with a third of all
    labels is many ranges. Records of equal order in one item keep no set order.
    """
    keyed = _with_optional(records).select(_item_key().alias("key"), F.col(ord_col).alias("ord"), F.coalesce("id", content_key()).alias("row_id"), annotations_column().alias("labels"))
    narrow = keyed.filter(F.size("labels") > 0).select("key", "ord", F.when(F.col("key.kind") == "id", F.col("row_id")).alias("row_id"), "labels")
    ranged = settled(narrow.repartitionByRange("key", "ord").withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("key", "range").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranged.groupBy("key", "range").agg(F.sum(F.size("labels")).alias("n")).select("key", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    placed = ranged.withColumn("done", F.coalesce(F.sum(F.size("labels")).over(inside), F.lit(0))).join(shifts, ["key", "range"])
    rows = placed.select("key", "row_id", (F.col("shift") + F.col("done")).alias("start"), F.posexplode("labels").alias("i", "label"))
    named = rows.filter("row_id is not null").select("row_id", "start", "i", "label")
    # Items without an id are named by their content, which comes back once per item.
    contents = keyed.filter("key.kind = 'content'").groupBy("key").agg(F.min("row_id").alias("name"))
    others = rows.filter("row_id is null").join(contents, "key").select(F.col("name").alias("row_id"), "start", "i", "label")
    return named.unionByName(others).select("row_id", (F.col("start") + F.col("i") + 1).alias("ann_ord"), "label.preferred", "label.annotator_id")


def _with_optional(records: DataFrame) -> DataFrame:
    kinds = {"preferred": "string", "annotator_id": "string", "annotations": "array<struct<preferred:string,annotator_id:string>>",
             "cluster_id": "string", "system_a": "string", "system_b": "string", "context_a": "array<array<string>>",
             "context_b": "array<array<string>>", "id": "string"}
    return records.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in records.columns}).withColumn(
        "id", F.col("id").cast("string"))


def load_report(comparisons: DataFrame) -> DataFrame:
    """n_rows, n_annotations, n_repeat_labelled and their share of merged comparisons."""
    k = F.size("annotations")
    counts = comparisons.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(k), F.lit(0)).cast("bigint").alias("n_annotations"),
                             F.count_if(k >= 2).alias("n_repeat_labelled"))
    return counts.withColumn("repeat_share", F.coalesce(F.try_divide(F.col("n_repeat_labelled").cast("double"), F.col("n_rows").cast("double")), F.lit(0.0)))


def exploded_labels(comparisons: DataFrame) -> DataFrame:
    """row_id, cluster_id, ann_ord (from 1), preferred, annotator_id."""
    return comparisons.select("row_id", "cluster_id", F.posexplode("annotations").alias("p", "a")).select(
        "row_id", "cluster_id", (F.col("p") + 1).alias("ann_ord"), "a.preferred", "a.annotator_id")
