"""Quality rules with thresholds that adapt to language and source.

Native DataFrame code: no Python runs on the executors. The measures of one
document are computed inside its row with array functions, so the only rows
that move are a few numbers per document. A mergeable quantile sketch (KLL) of
every measure is kept per (lang, source); sketches are built map-side, merged
across tasks, and their quantiles become thresholds that are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = r"[\x20\x09-\x0D]+"
WINDOW = 8

#: Measures with an upper fence, and those with a lower one.
UPPER = ("symbol_rate", "dup_line_rate", "repeat_rate", "mean_word")
LOWER = ("mean_word",)


def window_hashes(words: Column, window: int = WINDOW) -> Column:
    """(hash, position) of every window of ``words``; null for texts shorter than a window."""
    n = F.size(words)
    return F.when(n >= window, F.transform(
        F.sequence(F.lit(0), n - window),
        lambda i: F.struct(F.xxhash64(F.slice(words, i + 1, window)).alias("h"), i.alias("p")),
    ))


def with_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per document: id, group columns, n_words and the four base counts.

    A null text has no words; so has an empty or blank one. Rows that repeat an
    id are measured separately.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        *[F.col(c).cast("string").alias(f"group_{i}") for i, c in enumerate(group_cols)],
        text.alias("_text"),
        F.filter(F.split(text, SEPARATORS), lambda w: w != "").alias("_words"),
    )
    lines = F.filter(F.split("_text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    one = base.select(
        "doc_id", *[f"group_{i}" for i in range(len(group_cols))],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        window_hashes(F.col("_words")).alias("_hashes"),
    )
    # Each array below is a column of its own, so that a lambda reads it instead of computing it again.
    # Only texts in which a hash repeats are sorted: n log n however often it repeats.
    two = one.withColumn("_sorted", F.when(
        F.size(F.array_distinct(F.transform("_hashes", lambda x: x["h"]))) < F.size("_hashes"),
        F.array_sort("_hashes")))
    three = two.withColumn("_repeated", F.filter("_sorted", lambda x, i: (
        F.coalesce(F.get(F.col("_sorted"), i - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get(F.col("_sorted"), i + 1)["h"] == x["h"], F.lit(False)))))
    four = three.withColumn("_positions", F.array_sort(F.transform("_repeated", lambda x: x["p"])))
    spans = F.transform("_positions", lambda p, i: F.least(
        F.lit(WINDOW), F.coalesce(F.get(F.col("_positions"), i + 1) - p, F.lit(WINDOW))))
    return four.select(
        "doc_id", *[f"group_{i}" for i in range(len(group_cols))], "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(spans, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.greatest(F.size("_lines"), F.lit(1)).cast("long").alias("n_lines"),
    )


def _rates(measures: DataFrame) -> DataFrame:
    """The measures that get fences. Rates count one case in advance (a symbol, a repeated line, a window of words).

    Most texts hold no case, and plain rates of theirs are all 0, whose
    quantiles say nothing. With one case in advance such a text has the rate
    that its length leaves possible, so the quantiles of a group tell what one
    case weighs in its texts.
    """
    n = F.col("n_words").cast("double")
    return measures.withColumns({
        "symbol_rate": (F.col("n_symbols") + 1) / (n + 1),
        "dup_line_rate": (F.col("n_dup_lines") + 1) / (F.col("n_lines").cast("double") + 1),
        "repeat_rate": (F.col("n_repeat_words") + WINDOW) / (n + WINDOW),
        "mean_word": F.col("word_chars") / F.greatest(n, F.lit(1.0)),
    })


def group_sketches(measures: DataFrame, group_cols: list[str], k: int = 400) -> DataFrame:
    """Rows and one KLL sketch per measure for every group; ``merged_sketches`` merges them further."""
    return measures.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.kll_sketch_agg_double(m, F.lit(k)).alias(f"sketch_{m}") for m in UPPER])


def merged_sketches(sketches: DataFrame, group_cols: list[str]) -> DataFrame:
    """The same over coarser groups, from the sketches alone."""
    return sketches.groupBy(*group_cols).agg(
        F.sum("n_rows").alias("n_rows"),
        *[F.kll_merge_agg_double(f"sketch_{m}").alias(f"sketch_{m}") for m in UPPER])


def quantiles(sketches: DataFrame, tail: float) -> DataFrame:
    """Three quantiles of every measure in place of its sketch: low, middle, high."""
    return sketches.select(*[c for c in sketches.columns if not c.startswith("sketch_")], *[
        F.kll_sketch_get_quantile_double(F.col(f"sketch_{m}"), F.lit(at)).alias(f"{name}_{m}")
        for m in UPPER for name, at in (("low", tail), ("middle", 0.5), ("high", 1 - tail))])


def thresholds(sketches: DataFrame, group_cols: list[str], spread: float = 2.5, tail: float = 0.1, prior_rows: int = 20) -> DataFrame:
    """Upper fence high + spread * (high - median) with high the 1 - tail quantile; lower fence mirrored.

    The quantiles of a group are drawn towards those of its first group column
    (the language), whose merged sketches count as ``prior_rows`` more rows: a
    group of few rows has nearly the fences of its language, one of many its
    own, without a step between. A group's fence holds as long as junk is less
    than ``tail`` of it.
    """
    own = quantiles(sketches, tail)
    wide = quantiles(merged_sketches(sketches, group_cols[:1]), tail).drop("n_rows")
    weight = F.col("o.n_rows") / (F.col("o.n_rows") + F.lit(float(prior_rows)))
    names = [c for c in wide.columns if c not in group_cols]
    # Equal values stay equal to the last bit.
    drawn = own.alias("o").join(wide.alias("w"), F.col(f"o.{group_cols[0]}").eqNullSafe(F.col(f"w.{group_cols[0]}"))).select(
        *[f"o.{c}" for c in group_cols], *[(F.col(f"w.{c}") + (F.col(f"o.{c}") - F.col(f"w.{c}")) * weight).alias(c) for c in names])
    upper = [(F.col(f"high_{m}") + spread * (F.col(f"high_{m}") - F.col(f"middle_{m}"))).alias(f"max_{m}") for m in UPPER]
    lower = [(F.col(f"low_{m}") - spread * (F.col(f"middle_{m}") - F.col(f"low_{m}"))).alias(f"min_{m}") for m in LOWER]
    return drawn.select(*group_cols, *upper, *lower)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  group_cols: tuple[str, ...] = ("lang", "source"), spread: float = 2.5, k: int = 400,
                  prior_rows: int = 20) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept, and the thresholds that applied.

    Every input row gives one row. Null group values form groups of their own.
    Documents that fail the base rule do not enter the sketches, so a source
    full of junk does not raise its own fences. Where a group has no other
    documents there are no fences. ``prior_rows``: see ``thresholds``. An empty
    table gives no rows.
    """
    keys = [f"group_{i}" for i in range(len(group_cols))]
    measured = _rates(with_measures(docs, id_col, text_col, group_cols)).withColumn(
        "base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    measured = materialize(measured)
    sketches = group_sketches(measured.filter(~F.col("base_failed")), keys, k)
    fenced = thresholds(sketches, keys, spread, prior_rows=prior_rows)
    fences = [f"max_{m}" for m in UPPER] + [f"min_{m}" for m in LOWER]
    on = F.lit(True)
    for c in keys:
        on = on & F.col(f"m.{c}").eqNullSafe(F.col(f"f.{c}"))
    joined = measured.alias("m").join(fenced.alias("f"), on, "left").select("m.*", *[f"f.{c}" for c in fences])
    ok = ~F.col("base_failed")
    for m in UPPER:
        ok = ok & (F.col(m) <= F.coalesce(F.col(f"max_{m}"), F.lit(float("inf"))))
    for m in LOWER:
        ok = ok & (F.col(m) >= F.coalesce(F.col(f"min_{m}"), F.lit(float("-inf"))))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        ok.alias("kept"), *fences)
