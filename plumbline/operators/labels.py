"""Human labels: majorities, disagreement, the human ceiling, samples.

``labels`` is one row per label: row_id, preferred, and ann_ord, the place of
the label in its item from 1 on, where order matters. Pairs of labels are never formed; their numbers follow from counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import kappa_column, ratio

#: Items with two or more labels that a ceiling needs at least.
LEAST_REPEATED = 5


def _pairs_of(n: Column) -> Column:
    """n (n - 1) / 2; always whole."""
    return F.floor(n * (n - 1) / 2).cast("bigint")


def item_statistics(labels: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Per item: k labels, pairs, agreeing pairs, number of distinct labels, ties, majority."""
    counted = labels.groupBy(*group_cols, "row_id", "preferred").agg(F.count(F.lit(1)).alias("n"))
    per_item = counted.groupBy(*group_cols, "row_id").agg(
        F.sum("n").alias("k"), F.sum(_pairs_of(F.col("n"))).alias("agreeing"), F.count(F.lit(1)).alias("n_distinct"),
        F.sum(F.when(F.col("preferred") == "tie", F.col("n")).otherwise(0)).alias("n_ties"),
        F.max("n").alias("most"), F.max_by("preferred", F.struct("n", "preferred")).alias("top"), F.sort_array(F.collect_list("n")).alias("counts"))
    tied = F.size(F.filter("counts", lambda c: c == F.col("most"))) > 1
    return per_item.select(*group_cols, "row_id", "k", _pairs_of(F.col("k")).alias("pairs"), "agreeing", "n_distinct", "n_ties",
                           F.when(tied, F.lit("split")).otherwise(F.col("top")).alias("majority"))


def majority_labels(items: DataFrame, labels: DataFrame) -> DataFrame:
    """row_id and majority of every item: the most frequent label, ``split`` on a tied maximum, NULL without labels."""
    return items.select("row_id").join(item_statistics(labels).select("row_id", "majority"), "row_id", "left")


def contested_items(labels: DataFrame) -> DataFrame:
    """Items with two or more labels that are not all the same."""
    return item_statistics(labels).filter("n_distinct > 1").select("row_id", F.col("k").alias("n_labels"))


def label_quality(items: DataFrame, labels: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Counts of items, labels, ties, repeats and disagreement; tie rate (0 without labels); human agreement (NULL under LEAST_REPEATED)."""
    zero = F.lit(0).cast("bigint")
    per_item = items.select(*group_cols, "row_id").join(item_statistics(labels, group_cols), [*group_cols, "row_id"], "left")
    contested = F.col("n_distinct") > 1
    sums = per_item.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_items"), F.coalesce(F.sum("k"), zero).alias("n_annotations"),
        F.coalesce(F.sum("n_ties"), zero).alias("n_ties"), F.count_if(F.col("k") >= 2).alias("n_repeat_labelled"),
        F.count_if(contested).alias("n_contested_items"), F.coalesce(F.sum(F.when(contested, F.col("k"))), zero).alias("n_contested_annotations"),
        F.coalesce(F.sum("agreeing"), zero).alias("n_agreeing_pairs"), F.coalesce(F.sum("pairs"), zero).alias("n_compared_pairs"))
    return sums.withColumns({
        "tie_rate": F.coalesce(ratio(F.col("n_ties"), F.col("n_annotations")), F.lit(0.0)),
        "human_agreement": F.when(F.col("n_repeat_labelled") >= LEAST_REPEATED, ratio(F.col("n_agreeing_pairs"), F.col("n_compared_pairs")))})


def human_kappa(labels: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Kappa of all (earlier, later) label pairs inside items; NULL where the human ceiling is.

    The label at place i of k is the earlier one of k - i pairs and the later
    one of i - 1, so both marginals are sums over labels: per item and label,
    its number and the sum of its places say all.
    """
    by_label = labels.groupBy(*group_cols, "row_id", "preferred").agg(F.count(F.lit(1)).alias("n"), F.sum("ann_ord").cast("bigint").alias("places"))
    per_item = by_label.groupBy(*group_cols, "row_id").agg(F.sum("n").alias("k"), F.collect_list(F.struct("preferred", "n", "places")).alias("of"))
    marginals = per_item.select(*group_cols, "k", F.explode("of").alias("x")).groupBy(*group_cols, F.col("x.preferred").alias("preferred")).agg(
        F.sum(F.col("k") * F.col("x.n") - F.col("x.places")).alias("first"), F.sum(F.col("x.places") - F.col("x.n")).alias("second"))
    product = F.col("first").cast("decimal(19,0)") * F.col("second").cast("decimal(19,0)")
    products = marginals.groupBy(*group_cols).agg(F.sum(product).alias("products"))
    counts = item_statistics(labels, group_cols).groupBy(*group_cols).agg(
        F.sum("pairs").alias("n_pairs"), F.sum("agreeing").alias("n_agree"), F.count_if(F.col("k") >= 2).alias("n_repeat"))
    joined = counts.join(products, list(group_cols)) if group_cols else counts.join(F.broadcast(products))  # one row each
    return joined.select(*group_cols, "n_pairs", "n_agree", F.when(
        F.col("n_repeat") >= LEAST_REPEATED, kappa_column(F.col("n_pairs"), F.col("n_agree"), F.col("products"))).alias("human_kappa"))


#: Rows that one task may put in order for a sample.
TOP_ROWS = 10_000
#: Hexadecimal digits of the hash that the counts of a large sample are made by.
PREFIX_DIGITS = 4


def sample_comparisons(comparisons: DataFrame, n: int, seed: int = 7, top_rows: int = TOP_ROWS) -> DataFrame:
    """Exactly ``n`` comparisons by a seeded hash of the id; all of them if n <= 0 or there are no more.

    A large sample is a filter: counts by the first digits of the hash (at most
    65,536 rows) tell up to which digits all rows belong to it, and only the
    rows of the one prefix in which the n-th hash lies are put in order.
    """
    if n <= 0:
        return comparisons
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col("row_id")))
    if n <= top_rows:
        return comparisons.orderBy(order, "row_id").limit(n)
    prefix = F.substring(order, 1, PREFIX_DIGITS)
    below = 0
    for r in comparisons.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n")).orderBy("prefix").collect():
        if below + r["n"] > n:
            edge = comparisons.filter(prefix == r["prefix"]).orderBy(order, "row_id").limit(n - below)
            return comparisons.filter(prefix < r["prefix"]).unionByName(edge) if below < n else comparisons.filter(prefix < r["prefix"])
        below += r["n"]
    return comparisons
