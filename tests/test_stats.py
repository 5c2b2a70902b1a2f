import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions.stats import kappa, minimum_detectable_effect, percent
from plumbline.operators.bootstrap import bootstrap_ci, bootstrap_hash_ci

PAIRS = "a string, b string"


def _kappa(spark, pairs):
    return kappa(spark.createDataFrame(pairs, PAIRS), "a", "b").first()


@pytest.mark.parametrize(("pairs", "expected"), [
    ([("A", "A")] * 3 + [("tie", "tie")] * 5, 1.0),
    ([("A", "A")] * 4 + [("A", "B")] * 2 + [("B", "A")] * 2 + [("B", "B")], 0.0),
    ([("A", "tie")] * 6 + [("tie", "A")] * 6, -1.0),
])
def test_kappa_values(spark, pairs, expected):
    assert _kappa(spark, pairs)["kappa"] == pytest.approx(expected)


def test_kappa_is_low_where_raw_agreement_is_chance(spark):
    pairs = [("B", "B")] * 64 + [("B", "tie")] * 8 + [("tie", "B")] * 6 + [("tie", "tie")] * 2
    row = _kappa(spark, pairs)
    assert row["agreement"] == pytest.approx(0.825)
    assert row["kappa"] < 0.15


def test_kappa_undefined(spark):
    assert _kappa(spark, [("tie", "tie")] * 3)["kappa"] is None
    row = _kappa(spark, [])
    assert (row["n_pairs"], row["kappa"], row["agreement"]) == (0, None, None)


def test_kappa_of_counts_in_groups(spark):
    cells = spark.createDataFrame([("x", "A", "A", 384), ("x", "A", "B", 150), ("y", "A", "A", 1)], "g string, a string, b string, n int")
    rows = {r["g"]: r for r in kappa(cells, "a", "b", "n", ["g"]).collect()}
    assert rows["x"]["n_pairs"] == 534
    assert rows["x"]["agreement"] == pytest.approx(0.7191, abs=1e-4)
    assert rows["y"]["kappa"] is None


def test_detectable_effect_and_percent(spark):
    row = spark.range(1).select(
        minimum_detectable_effect(F.lit(100)).alias("a"), minimum_detectable_effect(F.lit(0)).alias("b"),
        percent(F.lit(None).cast("double")).alias("c"), percent(F.lit(0.7191)).alias("d")).first()
    assert row["a"] == pytest.approx(0.1400792609)
    assert row["b"] == 0.5
    assert (row["c"], row["d"]) == ("n/a", "71.9%")
    with pytest.raises(ValueError, match="unsupported"):
        minimum_detectable_effect(F.lit(1), alpha=0.5)


def test_percentile_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (5.0,)], "v double")
    assert df.agg(F.percentile("v", 0.5)).first()[0] == 3
    assert spark.createDataFrame([(0.0,), (10.0,)], "v double").agg(F.percentile("v", 0.5)).first()[0] == 5


def _sums(spark, values, per):
    """Clusters of ``per`` rows."""
    rows = [(f"c{i // per}", float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "cluster string, v double").groupBy("cluster").agg(F.sum("v").alias("num"), F.count("*").cast("double").alias("den"))


def test_bootstrap_degenerate_empty_and_widths(spark):
    one = bootstrap_ci(_sums(spark, [1] * 20, 1), n_resamples=100).first()
    assert (one["ci_lower"], one["ci_upper"]) == (1.0, 1.0)
    empty = bootstrap_ci(_sums(spark, [], 1).limit(0), n_resamples=10).collect()
    assert [(r["ci_lower"], r["ci_upper"]) for r in empty] == [(None, None)]
    few = bootstrap_ci(_sums(spark, [1] * 50 + [0] * 50, 50), n_resamples=300).first()
    many = bootstrap_ci(_sums(spark, [i % 2 for i in range(100)], 1), n_resamples=300).first()
    assert few["ci_upper"] - few["ci_lower"] > many["ci_upper"] - many["ci_lower"]


def test_bootstrap_does_not_depend_on_partitions_and_forms_agree(spark):
    sums = _sums(spark, [math.sin(i) > 0 for i in range(400)], 2)
    a = bootstrap_ci(sums.repartition(1), n_resamples=400).first()
    b = bootstrap_ci(sums.repartition(7), n_resamples=400).first()
    assert a == b
    h = bootstrap_hash_ci(sums, n_resamples=400).first()
    assert h["ci_upper"] - h["ci_lower"] == pytest.approx(a["ci_upper"] - a["ci_lower"], rel=0.2)
    grouped = bootstrap_ci(sums.withColumn("g", F.lit("x")), ["g"], n_resamples=50).collect()
    assert [r["g"] for r in grouped] == ["x"]


def test_numbers_by_hash_are_places_in_md5_order(spark):
    import hashlib

    from plumbline.operators.bootstrap import numbered_by_hash

    names = [f"c{n}" for n in range(9000)]
    rows = spark.createDataFrame([(c, 1.0, 1.0) for c in names], "cluster string, num double, den double").repartition(7)
    got = {r["cluster"]: r["i"] for r in numbered_by_hash(rows).collect()}
    assert got == {c: i for i, c in enumerate(sorted(names, key=lambda c: hashlib.md5(c.encode()).hexdigest()))}
    assert numbered_by_hash(rows.limit(0)).count() == 0


def test_more_buckets_give_the_same_interval_but_for_chance(spark):
    sums = _sums(spark, [i % 2 for i in range(400)], 1)
    a, b = bootstrap_ci(sums, n_resamples=2000).first(), bootstrap_ci(sums, n_resamples=2000, buckets=7).first()
    assert abs(a["ci_lower"] - b["ci_lower"]) < 0.01
    assert abs(a["ci_upper"] - b["ci_upper"]) < 0.01


def test_binomial_draws_have_the_binomial_distribution(spark):
    """Chi-square against exact probabilities, for means on both sides of the two methods and probabilities on both sides of one half."""
    from plumbline.functions.draws import DUCKDB, SPARK, binomial

    rows = 20_000
    for t, p in ((3, 0.9), (12, 0.25), (60, 0.1), (40, 0.4), (200, 0.85), (2000, 0.005)):
        key = f"'k' || CAST(id AS VARCHAR(20)) || '|{t}'"
        sql = f"SELECT {{}} AS k, count(*) AS n FROM ({{}}) GROUP BY 1"
        drawn = binomial(f"CAST({t} AS BIGINT)", f"{p}E0", key, SPARK)
        got = {r["k"]: r["n"] for r in spark.range(rows).selectExpr(f"{drawn} AS k").groupBy("k").agg(F.count("*").alias("n")).collect()}
        import duckdb

        same = dict(duckdb.sql(sql.format(binomial(f"CAST({t} AS BIGINT)", f"{p}::DOUBLE", key, DUCKDB), f"SELECT unnest(range({rows})) AS id")).fetchall())
        assert got == same
        expected = {k: rows * math.exp(math.lgamma(t + 1) - math.lgamma(k + 1) - math.lgamma(t - k + 1) + k * math.log(p) + (t - k) * math.log(1 - p)) for k in range(t + 1)}
        cells = [k for k, e in expected.items() if e >= 5]
        rest = rows - sum(expected[k] for k in cells), rows - sum(got.get(k, 0) for k in cells)
        chi = sum((got.get(k, 0) - expected[k]) ** 2 / expected[k] for k in cells) + ((rest[0] - rest[1]) ** 2 / rest[0] if rest[0] >= 5 else 0)
        assert chi < len(cells) + 4.5 * math.sqrt(2 * len(cells)) + 5, (t, p, chi, len(cells))


def test_every_resample_draws_as_many_clusters_as_there_are(spark):
    from plumbline.operators.bootstrap import resample

    sums = spark.createDataFrame([(g, f"{g}{i}", float(i % 9), 1.0) for g, n in (("x", 137), ("y", 1), ("z", 40)) for i in range(n)], "g string, cluster string, num double, den double")
    out = resample(sums, ["num", "den"], ["g"], n_resamples=200)
    assert {(r["g"], r["den"], r["n"]) for r in out.groupBy("g", "den").agg(F.count("*").alias("n")).collect()} == {("x", 137.0, 200), ("y", 1.0, 200), ("z", 40.0, 200)}
    mean = out.groupBy("g").agg(F.avg("num").alias("m"), F.var_pop("num").alias("v")).collect()
    for r in mean:                                             # mean and variance of a sum of n draws
        values = [i % 9 for i in range({"x": 137, "y": 1, "z": 40}[r["g"]])]
        n, mu = len(values), sum(values) / len(values)
        var = sum((v - mu) ** 2 for v in values)
        assert abs(r["m"] - n * mu) <= 4 * math.sqrt(var / 200) + 1e-9
        assert 0.6 * var <= r["v"] <= 1.5 * var or var == 0


def test_kappa_interval_holds_kappa_and_takes_any_label(spark):
    from plumbline.operators.calibration import cluster_cells, kappa_interval, kappa_of_cells

    items = spark.createDataFrame([(f"r{i}", f"c{i // 3}") for i in range(150)], "row_id string, cluster_id string")
    labels = spark.createDataFrame([(f"r{i}", j + 1, "ABtie"[i % 2] if j == 0 else ["A", "B", "tie", "odd"][(i + j) % 4]) for i in range(150) for j in range(2)], "row_id string, ann_ord int, preferred string")
    judged = spark.createDataFrame([(f"r{i}", "AB"[i % 2], False, i % 50 == 0) for i in range(150)], "row_id string, winner string, position_unstable boolean, parse_failed boolean")
    whole = cluster_cells(items, labels, judged).agg(*[F.sum(f"c_{i}_{j}").alias(f"c_{i}_{j}") for i in range(4) for j in range(4)]).selectExpr(f"{kappa_of_cells(4)} AS kappa").first()[0]
    pairs = labels.join(judged.filter("not parse_failed"), "row_id")
    assert whole == pytest.approx(kappa(pairs, "preferred", "winner").first()["kappa"])
    row = kappa_interval(items, labels, judged, n_resamples=200).first()
    assert row["ci_lower"] < whole < row["ci_upper"]
    none = kappa_interval(items, labels, judged.withColumn("parse_failed", F.lit(True)), n_resamples=20).first()
    assert tuple(none) == (None, None)


def test_draws_of_arrays_are_those_of_sql():
    import hashlib

    import duckdb
    import numpy as np

    from plumbline.functions.draws import DUCKDB, binomial, binomials, uniforms

    for t, p in ((3, 0.9), (12, 0.25), (60, 0.1), (40, 0.4), (200, 0.85), (20_000, 0.3)):
        got = binomials(np.full(3000, t), p, lambda places, number, t=t: uniforms([f"k{i}|{t}".encode() for i in places], number, hashlib.md5))
        drawn = binomial(f"CAST({t} AS BIGINT)", f"{p}::DOUBLE", f"'k' || CAST(id AS VARCHAR) || '|{t}'", DUCKDB)
        assert got.tolist() == [k for k, in duckdb.sql(f"SELECT {drawn} FROM (SELECT unnest(range(3000)) AS id) ORDER BY id").fetchall()]


def test_many_states_are_drawn_in_few_stages_as_by_sql(spark, monkeypatch):
    """All states different, dealt out two levels down the tree; a task sees a part of the states and shuffles no draw."""
    import duckdb

    from plumbline.operators import bootstrap

    monkeypatch.setattr(bootstrap, "UNIT_STATES", 4)
    n = 700
    sums = spark.range(n).selectExpr("'c' || id AS cluster", "CAST(id AS DOUBLE) AS num", "CAST(id % 7 + 1 AS DOUBLE) AS den")
    resampled = bootstrap.resample(sums, ["num", "den"], n_resamples=30)
    assert "Generate" not in resampled._jdf.queryExecution().optimizedPlan().toString()      # draws are no rows
    sql = bootstrap.tree_sql("cl", ["num", "den"], "rp", n_resamples=30)
    expected = duckdb.sql(f"WITH RECURSIVE cl AS (SELECT i::DOUBLE AS num, (i % 7 + 1)::DOUBLE AS den FROM range({n}) r(i)) {sql} SELECT r, num, den FROM rp").fetchall()
    assert sorted(tuple(r) for r in resampled.select("replicate", "num", "den").collect()) == sorted(expected)


def test_draws_by_hash_are_counted_in_tasks_and_are_those_of_the_definition(spark):
    import hashlib
    import statistics

    sums = spark.createDataFrame([(f"c{n}", float(n % 5), 1.0 + n % 3) for n in range(150)], "cluster string, num double, den double")
    rows = sorted(sums.collect(), key=lambda r: hashlib.md5(r["cluster"].encode()).hexdigest())
    rates = []
    for r in range(40):
        drawn = [rows[int(int(hashlib.md5(f"7|{r}|{slot}".encode()).hexdigest()[:8], 16) / 4294967296.0 * 150)] for slot in range(150)]
        rates.append(sum(x["num"] for x in drawn) / sum(x["den"] for x in drawn))
    cuts = statistics.quantiles(rates, n=40, method="inclusive")
    for sizes in ({}, {"block": 64, "chunk": 40}, {"block": 8, "chunk": 1000}):                 # one block; several, with places; several, with counts
        found = bootstrap_hash_ci(sums, n_resamples=40, **sizes)
        assert "xplode" not in found._jdf.queryExecution().toString()                           # no row per draw
        got = found.first()
        assert (got["ci_lower"], got["ci_upper"]) == (pytest.approx(cuts[0]), pytest.approx(cuts[-1]))
    none = bootstrap_hash_ci(sums.limit(0), n_resamples=5).first()
    assert (none["ci_lower"], none["ci_upper"]) == (None, None)
