"""License scan by diagonal voting.

Native DataFrame code. Every rolling k-gram of words of every text is hashed
and joined to the positions of the same k-gram in the license templates. A
match votes for a diagonal (word position minus template position); votes are
counted by diagonal and a diagonal is merged with those next to it, so a
changed, lost or added word does not split a copy. Each merged span is verified
by the longest common subsequence of its words and the template's. Of spans
that overlap, the best stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that is not part of a word, after A-Z have been lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and the label of each.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Template texts and the label of each; fixed values.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software "
            "and associated documentation files"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mit", "licensed under the mit license"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0"),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nd-4.0", "licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("bsd", "released under the bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0"),
    ("bsl-1.0", "distributed under the boost software license version 1 0"),
    ("cc0-1.0", "dedicated to the public domain under the cc0 1 0 universal dedication"),
]
#: Words that tell a license from others of nearly the same wording, by the start of its templates: a span without all of them gets no label.
DISTINCTIVE = {
    "licensed under the apache license": "apache",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "released under the bsd license": "bsd",
    "this work is licensed under the gnu general public license version 3": "general 3",
    "licensed under the gnu general public license version 3": "gnu 3",
    "licensed under the gnu general public license version 2": "gnu 2",
    "licensed under the gnu affero": "affero",
    "licensed under the gnu lesser": "lesser",
    "licensed under cc by 4 0": "cc 4",
    "licensed under cc by nc 4 0": "cc nc 4",
    "licensed under cc by sa 4 0": "cc sa 4",
    "licensed under cc by nd 4 0": "cc nd 4",
    "licensed under cc by nc sa 4 0": "cc nc sa 4",
    "licensed under cc by nc nd 4 0": "cc nc nd 4",
    "licensed under a creative commons attribution 4 0": "creative commons 4",
    "licensed under a creative commons attribution sharealike": "sharealike 4",
    "licensed under a creative commons attribution noncommercial": "noncommercial 4",
    "licensed under a creative commons attribution noderivatives": "noderivatives 4",
    "this source code form is subject to the terms of the mozilla": "mozilla",
    "made available under the terms of the eclipse": "eclipse",
    "distributed under the boost software license": "boost",
    "dedicated to the public domain under the cc0": "cc0",
}

#: Template k-grams of one broadcast; a larger template set is joined in several.
MAX_BROADCAST_GRAMS = 100_000


def normalised_words(text: Column) -> Column:
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD, " ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def template_grams(spark: SparkSession, rows: list[tuple[int, str, list[str], list[str]]], k: int) -> DataFrame:
    """One row per template k-gram: template, label, its words, those that a span needs, position, hash."""
    base = spark.createDataFrame(rows, "template int, label string, t_words array<string>, t_need array<string>")
    return base.select(
        "template", "label", "t_words", "t_need",
        F.posexplode(F.transform(
            F.sequence(F.lit(0), F.size("t_words") - k),
            lambda i: F.xxhash64(F.slice("t_words", i + 1, k)))).alias("t_pos", "gram"))


def _phrase_starts(words: Column, phrases: list[str]) -> Column:
    """Starts of all places where the words of any of ``phrases`` stand."""
    def here(i: Column) -> Column:
        hit = F.lit(False)
        for p in phrases:
            hit = hit | F.coalesce(
                F.slice(words, i + 1, len(p.split())) == F.array(*[F.lit(w) for w in p.split()]), F.lit(False))
        return hit

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def _same(words: Column, at: Column, word: Column) -> Column:
    """Whether ``word`` stands at position ``at``; false outside of the text."""
    return F.coalesce(F.get(words, at) == word, F.lit(False))


def _common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two short arrays, row by row of the usual table."""
    def row(above: Column, x: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(b)), F.array(F.lit(0)),
            lambda left, j: F.concat(left, F.array(F.when(F.get(b, j - 1) == x, F.get(above, j - 1) + 1).otherwise(
                F.greatest(F.get(above, j), F.get(left, j - 1))))))

    return F.element_at(F.aggregate(a, F.array_repeat(F.lit(0), F.size(b) + 1), row), -1)


def needed_words(text: str) -> list[str]:
    """The distinctive words of a template."""
    return [w for start, words in DISTINCTIVE.items() if f"{text} ".startswith(f"{start} ") for w in words.split()]


def _blocks_of(templates: list[tuple[str, str]], k: int) -> list[list[tuple[int, str, list[str], list[str]]]]:
    """Numbered templates with their words, in blocks of at most ``MAX_BROADCAST_GRAMS`` grams; one block at least."""
    out: list[list[tuple[int, str, list[str], list[str]]]] = [[]]
    grams = 0
    for number, (label, text) in enumerate(templates):
        words, need = text.split(), needed_words(text)
        grams += max(1, len(words) - k + 1)
        if grams > MAX_BROADCAST_GRAMS and out[-1]:
            out.append([])
            grams = max(1, len(words) - k + 1)
        out[-1].append((number, label, words, need))
    return out


def _votes(rolled: DataFrame, grams: DataFrame, drift: int, min_score: float) -> DataFrame:
    """Text, template and diagonal of every k-gram match, and the words around, if enough of the template's words stand in the band.

    A span within ``drift`` of the diagonal can't have more words in common
    with the template than stand in the band at all, so no span is lost.
    """
    own, size = F.col("template") == -1, F.size("t_words")
    band = rolled.join(F.broadcast(grams), "gram").filter(own == (F.col("slot") == 0)).withColumn(
        "diagonal", F.when(own, F.lit(0)).otherwise(F.col("slot") - 1 - F.col("t_pos"))).withColumn(
        "first", F.greatest(F.col("diagonal") - drift, F.lit(0)))
    here = band.select(
        "doc_id", "text_key", F.when(own, F.struct(
            F.size("words").cast("long").alias("n_words"),
            F.coalesce(F.size("starts"), F.lit(0)).cast("long").alias("n_base"),
            F.array_min("starts").cast("long").alias("first_word"),
            F.array_max("starts").cast("long").alias("last_word"),
            F.col("base_list"))).alias("base"), "template", "label", "t_words", "t_need", "diagonal", "first", F.when(~own, F.slice(
            "words", F.col("first") + 1, F.greatest(F.lit(0), F.least(F.col("diagonal") + size + drift, F.size("words")) - F.col("first")))).alias("around"))
    in_band = F.size(F.filter("t_words", lambda t, i: F.exists(
        F.sequence(F.lit(-drift), F.lit(drift)), lambda d: _same(F.col("around"), F.col("diagonal") - F.col("first") + i + d, t))))
    # The whole part of rand() is 0; it keeps this test above the join: pushed into it, it would take the join, and all rows of grams, out of generated code.
    return here.filter((F.col("template") == -1) | (in_band + F.floor(F.rand(1)) >= min_score * F.size("t_words")))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 templates: list[tuple[str, str]] | None = None, k: int = 2, drift: int = 2,
                 min_score: float = 0.8) -> DataFrame:
    """One row per input row: the base counts, ``base_labels``, ``labels``, ``score`` and the verified ``spans``.

    A span's score is the number of words that text and template have in common
    in order, over the greater of the span's and the template's length, so
    changed, lost, added and swapped words all count. ``min_score``: what a span
    needs for its label, beside the words of ``DISTINCTIVE`` for its template, so
    the name of another license or version is not taken for this one.
    ``drift``: diagonals at most so far from each other are one span. Of overlapping spans only those with the greatest score stay.
    ``score`` is 1 where a base phrase stands, else that of the best span. A
    null or empty text has no words, no labels and score 0. Rows that repeat an
    id and its text give equal rows; other columns are ignored.
    """
    spark = docs.sparkSession
    chosen = TEMPLATES if templates is None else templates
    if any(len(text.split()) < k for _, text in chosen):
        raise ValueError(f"a template needs at least {k} words")
    by_text = ["doc_id", "text_key"]

    words = docs.select(F.col(id_col).alias("doc_id"), normalised_words(F.col(text_col)).alias("words"))
    padded = words.withColumn("padded", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    found = [F.col("padded").contains(f" {p} ") for p in BASE_PHRASES]
    any_found = found[0]
    for f in found[1:]:
        any_found = any_found | f
    # The places of the base phrases are worked out only for texts that hold one.
    based = padded.select(
        "doc_id", "words", F.xxhash64("words").alias("text_key"),
        F.when(any_found, _phrase_starts(F.col("words"), list(BASE_PHRASES))).alias("starts"),
        F.array_compact(F.array(*[
            F.when(f, F.lit(label)) for f, label in zip(found, BASE_PHRASES.values(), strict=True)])).alias("base_list"),
        F.when(F.size("words") >= k, F.transform(
            F.sequence(F.lit(0), F.size("words") - k),
            lambda i: F.xxhash64(F.slice("words", i + 1, k)))).alias("grams"))
    # The array is a column of its own: so the rows of grams come from generated code, and no text is copied for each.
    rolled = based.select(
        *by_text, "words", "starts", "base_list",
        F.posexplode(F.concat(F.array(F.lit(-1).cast("bigint")), F.coalesce("grams", F.array().cast("array<bigint>")))).alias("slot", "gram"))
    # The gram -1 is what every text sends for itself.
    votes = None
    for block in _blocks_of(chosen, k):
        grams = template_grams(spark, block, k)
        if votes is None:
            grams = grams.unionByName(spark.createDataFrame(
                [(-1, None, None, None, 0, -1)], "template int, label string, t_words array<string>, t_need array<string>, t_pos int, gram bigint"))
        part = _votes(rolled, grams, drift, min_score)
        votes = part if votes is None else votes.unionByName(part)

    # One shuffle: everything below groups by columns that begin with the text.
    by_diagonal = votes.repartition(*[F.col(c) for c in by_text]).groupBy(*by_text, "template", "diagonal").agg(
        F.count(F.lit(1)).alias("n_votes"), F.first("base").alias("base"), F.first("label").alias("label"),
        F.first("t_words").alias("t_words"), F.first("t_need").alias("t_need"), F.first("first").alias("first"), F.first("around").alias("around"))
    near = Window.partitionBy(*by_text, "template").orderBy("diagonal").rangeBetween(-drift, drift)
    merged = by_diagonal.withColumn("most", F.max("n_votes").over(near)).filter(F.col("n_votes") == F.col("most"))
    # Places of ``around`` that match the template somewhere in the band; the span lies between the outer ones.
    shift = F.col("first") - F.col("diagonal")
    placed = merged.withColumn("places", F.when(F.col("template") >= 0, F.filter(
        F.sequence(F.lit(0), F.size("around") - 1), lambda j: F.exists(
            F.sequence(F.lit(-drift), F.lit(drift)), lambda d: _same(F.col("t_words"), shift + j + d, F.get("around", j))))))
    outer = placed.withColumn("from", F.array_min("places")).withColumn(
        "copy", F.slice("around", F.col("from") + 1, F.array_max("places") - F.col("from") + 1))

    def cut(a: Column, b: Column) -> Column:
        """Score, length (negative) and start of the copy without its first ``a`` and last ``b`` words."""
        part = F.slice("copy", a + 1, F.greatest(F.size("copy") - a - b, F.lit(0)))
        whole = F.forall("t_need", lambda w: F.array_contains(part, w))
        value = F.when((F.size(part) > 0) & whole, _common_length(F.col("t_words"), part) / F.greatest(F.size("t_words"), F.size(part))).otherwise(0.0)
        return F.struct(value.alias("value"), (-F.size(part)).alias("shorter"), a.alias("skipped"))

    # A word beside the copy may match the template by chance, so the ends are tried up to the width of the band.
    ends = F.sequence(F.lit(0), F.lit(2 * drift))
    scored = outer.withColumn("best", F.when(F.size("copy") > 0, F.array_max(F.flatten(
        F.transform(ends, lambda a: F.transform(ends, lambda b: cut(a, b)))))))
    start = (F.col("first") + F.col("from") + F.col("best.skipped")).cast("long")
    span = F.when(F.col("best.value") >= min_score, F.struct(
        start.alias("start"), (start - F.col("best.shorter")).alias("end"), "label", F.col("best.value").alias("value")))
    per_text = scored.groupBy(*by_text).agg(
        F.max("base").alias("base"), F.max(F.when(F.col("template") == -1, F.col("n_votes"))).alias("n_rows"),
        F.array_sort(F.collect_set(span)).alias("every"))
    best = per_text.withColumn("spans", F.filter("every", lambda x: ~F.exists("every", lambda y: (
        (y["start"] < x["end"]) & (x["start"] < y["end"]) & (y["value"] > x["value"])))))
    labels = F.array_sort(F.array_distinct(F.concat("base.base_list", F.transform("spans", lambda x: x["label"]))))
    return best.select(
        "doc_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_rows"))).alias("_copy"),
        "base.n_words", "base.n_base", "base.first_word", "base.last_word",
        F.array_join(F.array_sort("base.base_list"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("base.n_base") > 0, F.lit(1.0)).otherwise(
            F.coalesce(F.array_max(F.transform("spans", lambda x: x["value"])), F.lit(0.0))).alias("score"),
        "spans").drop("_copy")
