"""Registered queries of the preference and calibration operators, each with its SQL."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.fixtures import HELD_OUT_PAIR, n_lines, view, with_views
from plumbline.functions.prompts import MULTI_TURN_SYSTEM_PROMPT, SYSTEM_PROMPT
from plumbline.functions.stats import Z_SCORES, minimum_detectable_effect
from plumbline.functions.text import PADDING, RESTATEMENT, length_cap, length_note, pad_response, truncate_at_word
from plumbline.functions.verdicts import parse_verdict
from plumbline.operators import bootstrap, calibration, judging, labels, replies, robustness, scoring, verdicts
from plumbline.plans.report import confusion_table, report_lines, write_report
from plumbline.plans.sections import in_sql, report_sections, section_lines
from plumbline.shared import dealt, remove, settled, shared_folder
from plumbline.sources import adapter, records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles to so many digits, which both engines print alike."""
    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema if f.dataType.simpleString() == "double"})


def _calibration_items(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_item").filter("not held_out")


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_item").select("row_id", "cluster_id", "winner", "position_unstable", "parse_failed", "held_out")


# --- records and labels -------------------------------------------------------------------------------------------------

@query(with_views(["fx_record"], """
, k AS (SELECT *, coalesce(id, '__' || prompt || chr(31) || response_a || chr(31) || response_b) AS row_id,
               CASE WHEN id IS NULL THEN 'content' ELSE 'id' END AS kind FROM fx_record)
SELECT row_id, arg_min(prompt, ord) AS prompt,
       coalesce(nullif(arg_min(cluster_id, ord), ''), row_id) AS cluster_id,
       count(*) AS n_annotations, string_agg(preferred, ',' ORDER BY ord) AS labels
FROM k GROUP BY kind, row_id"""))
def ingest_merge(spark: SparkSession, sf: str) -> DataFrame:
    merged = records.merge_records(view(spark, sf, "fx_record"))
    return merged.select("row_id", "prompt", "cluster_id", F.size("annotations").cast("bigint").alias("n_annotations"),
                         F.array_join(F.transform("annotations", lambda a: a["preferred"]), ",").alias("labels"))


@query(with_views(["fx_record"], """
, k AS (SELECT count(*) AS k FROM fx_record
        GROUP BY CASE WHEN id IS NULL THEN 'content' ELSE 'id' END, coalesce(id, prompt || chr(31) || response_a || chr(31) || response_b))
SELECT count(*) AS n_rows, CAST(sum(k) AS BIGINT) AS n_annotations, count(*) FILTER (k >= 2) AS n_repeat_labelled,
       round(CAST(count(*) FILTER (k >= 2) AS DOUBLE) / count(*), 9) AS repeat_share FROM k"""))
def load_report(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(records.load_report(records.merge_records(view(spark, sf, "fx_record"))))


_ITEM_COUNTS = """
, c AS (SELECT row_id, preferred, count(*) AS n FROM fx_ann GROUP BY ALL)
, m AS (SELECT row_id, CAST(sum(n) AS BIGINT) AS k, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS agreeing, count(*) AS d, max(n) AS most,
               count(*) FILTER (preferred = 'tie') AS has_tie, coalesce(CAST(sum(n) FILTER (preferred = 'tie') AS BIGINT), 0) AS ties
        FROM c GROUP BY row_id)"""


@query(with_views(["fx_item", "fx_ann"], _ITEM_COUNTS + """
, t AS (SELECT c.row_id, CASE WHEN count(*) > 1 THEN 'split' ELSE min(preferred) END AS majority
        FROM c JOIN m ON c.row_id = m.row_id AND c.n = m.most GROUP BY c.row_id)
SELECT i.row_id, t.majority FROM fx_item i LEFT JOIN t ON i.row_id = t.row_id"""))
def majority_labels(spark: SparkSession, sf: str) -> DataFrame:
    return labels.majority_labels(view(spark, sf, "fx_item"), view(spark, sf, "fx_ann"))


@query(with_views(["fx_ann"], _ITEM_COUNTS + "SELECT row_id, k AS n_labels FROM m WHERE d > 1"))
def contested_items(spark: SparkSession, sf: str) -> DataFrame:
    return labels.contested_items(view(spark, sf, "fx_ann"))


_QUALITY = _ITEM_COUNTS + """
, q AS (SELECT count(*) AS n_items, coalesce(CAST(sum(k) AS BIGINT), 0) AS n_annotations, coalesce(CAST(sum(ties) AS BIGINT), 0) AS n_ties,
               count(*) FILTER (k >= 2) AS n_repeat_labelled, count(*) FILTER (d > 1) AS n_contested_items,
               coalesce(CAST(sum(k) FILTER (d > 1) AS BIGINT), 0) AS n_contested_annotations,
               coalesce(CAST(sum(agreeing) AS BIGINT), 0) AS n_agreeing_pairs, coalesce(CAST(sum(k * (k - 1) // 2) AS BIGINT), 0) AS n_compared_pairs
        FROM (SELECT row_id FROM fx_item WHERE NOT held_out) i LEFT JOIN m ON i.row_id = m.row_id)
, lq AS (SELECT *, coalesce(CAST(n_ties AS DOUBLE) / nullif(n_annotations, 0), 0.0::DOUBLE) AS tie_rate,
                CASE WHEN n_repeat_labelled >= 5 THEN CAST(n_agreeing_pairs AS DOUBLE) / nullif(n_compared_pairs, 0) END AS human_agreement FROM q)"""


@query(with_views(["fx_item", "fx_ann"], _QUALITY + "SELECT * REPLACE (round(tie_rate, 9) AS tie_rate, round(human_agreement, 9) AS human_agreement) FROM lq"))
def label_quality(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(labels.label_quality(_calibration_items(spark, sf), view(spark, sf, "fx_ann")))


def _kappa_sql(pairs: str, name: str) -> str:
    """CTE ``name`` (n, n_agree, kappa) over rows (r1, r2, n) of the CTE ``pairs``."""
    return f"""
, {name}_m AS (SELECT c, sum(f) AS f, sum(s) AS s FROM (SELECT r1 AS c, n AS f, 0 AS s FROM {pairs} UNION ALL SELECT r2, 0, n FROM {pairs}) GROUP BY c)
, {name}_e AS (SELECT sum(CAST(f AS DOUBLE) * CAST(s AS DOUBLE)) AS p FROM {name}_m)
, {name} AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (r1 = r2), 0) AS BIGINT) AS n_agree,
                    CASE WHEN any_value(p) < CAST(sum(n) AS DOUBLE) * sum(n)
                         THEN (CAST(coalesce(sum(n) FILTER (r1 = r2), 0) AS DOUBLE) / sum(n) - any_value(p) / (CAST(sum(n) AS DOUBLE) * sum(n)))
                              / (1 - any_value(p) / (CAST(sum(n) AS DOUBLE) * sum(n))) END AS kappa
             FROM {pairs}, {name}_e)"""


_HUMAN_PAIRS = """
, hp AS (SELECT a.preferred AS r1, b.preferred AS r2, count(*) AS n
         FROM fx_ann a JOIN fx_ann b ON a.row_id = b.row_id AND a.ann_ord < b.ann_ord GROUP BY ALL)"""


@query(with_views(["fx_ann"], _HUMAN_PAIRS + _kappa_sql("hp", "hk") + "SELECT n AS n_pairs, n_agree, round(kappa, 9) AS human_kappa FROM hk"))
def human_pairs_kappa(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(labels.human_kappa(view(spark, sf, "fx_ann")))


@query(with_views(["fx_item"], "SELECT row_id, cluster_id FROM fx_item WHERE NOT held_out ORDER BY md5('7|' || row_id), row_id LIMIT 300"))
def sample_comparisons(spark: SparkSession, sf: str) -> DataFrame:
    return labels.sample_comparisons(_calibration_items(spark, sf).select("row_id", "cluster_id"), 300)


def _folder(spark: SparkSession, name: str) -> str:
    """A new shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _through_json(df: DataFrame, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """Rows written as JSON Lines and read back; the files go."""
    path = _folder(df.sparkSession, "json")
    df.write.json(path)
    out = settled(read(df.sparkSession, path))
    remove(df.sparkSession, path)
    return out


@query(with_views(["fx_item"], """
, o AS (SELECT row_id, row_number() OVER (ORDER BY md5('7|' || row_id), row_id) AS r, count(*) OVER () AS n FROM fx_item)
SELECT row_id FROM o WHERE r <= n // 2"""))
def sample_half(spark: SparkSession, sf: str) -> DataFrame:
    """Half of all items, exactly, without putting them in order."""
    items = view(spark, sf, "fx_item").select("row_id")
    return labels.sample_comparisons(items, items.count() // 2, top_rows=0)


@query(with_views(["fx_record"], """
, k AS (SELECT *, coalesce(id, '__' || prompt || chr(31) || response_a || chr(31) || response_b) AS row_id, CASE WHEN id IS NULL THEN 'content' ELSE 'id' END AS kind FROM fx_record)
SELECT row_id, CAST(row_number() OVER (PARTITION BY kind, row_id ORDER BY ord) AS BIGINT) AS ann_ord, preferred, annotator_id FROM k WHERE preferred IS NOT NULL"""))
def merged_labels(spark: SparkSession, sf: str) -> DataFrame:
    return records.merged_labels(view(spark, sf, "fx_record"))


_JSON_RECORD = """SELECT ord, id, prompt, response_a, response_b, cluster_id, CASE WHEN ord % 2 = 0 THEN preferred END AS preferred,
       CASE WHEN ord % 2 = 0 THEN annotator_id END AS annotator_id, CASE WHEN ord % 2 = 1 THEN array(named_struct('preferred', preferred, 'annotator_id', annotator_id)) END AS annotations,
       CASE WHEN ord % 3 = 0 THEN array(array('user', prompt), array('assistant', response_a)) END AS context_a FROM {fx_record}"""


@query(with_views(["fx_record"], """
, k AS (SELECT *, coalesce(id, '__' || prompt || chr(31) || response_a || chr(31) || response_b) AS row_id,
               CASE WHEN id IS NULL THEN 'content' ELSE 'id' END AS kind FROM fx_record)
SELECT row_id, coalesce(nullif(arg_min(cluster_id, ord), ''), row_id) AS cluster_id, string_agg(preferred || ':' || annotator_id, ',' ORDER BY preferred, annotator_id) AS labels,
       bool_or(ord % 3 = 0) AS has_context, count(*) AS n_records
FROM k GROUP BY kind, row_id"""))
def read_records(spark: SparkSession, sf: str) -> DataFrame:
    """Single-label and list-label records with and without contexts, written as JSON Lines in their order, read back and merged."""
    written = spark.sql(_JSON_RECORD, fx_record=view(spark, sf, "fx_record")).orderBy("ord")   # the order of the lines says which record of an item is first
    read = _through_json(written, records.read_comparison_records)
    merged = records.merge_records(read)
    rendered = F.expr("array_join(array_sort(transform(annotations, a -> a.preferred || ':' || a.annotator_id)), ',')")
    context = records.merge_records(read.filter("context_a is not null"))
    shown = context.select("row_id", "cluster_id", (F.element_at("context_a", 1)["role"] == "user").alias("has_context"))
    return merged.select("row_id", "cluster_id", rendered.alias("labels"), F.size("annotations").cast("bigint").alias("n_records")).join(
        shown.select("row_id", "has_context"), "row_id", "left").withColumn("has_context", F.coalesce("has_context", F.lit(False)))


@query(with_views(["fx_item"], "SELECT row_id AS id, winner, coalesce(CASE WHEN item_no % 2 = 0 THEN position_unstable END, false) AS position_unstable FROM fx_item"))
def read_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict records as JSON Lines; a missing flag is false."""
    written = view(spark, sf, "fx_item").select(F.col("row_id").alias("id"), "winner", F.expr("CASE WHEN item_no % 2 = 0 THEN position_unstable END").alias("position_unstable"))
    return _through_json(written, records.read_verdict_records).drop("ord")


# --- verdicts and calibration -------------------------------------------------------------------------------------------

_CANONICAL = """
, can AS (SELECT question_id, turn, least(model_a, model_b) AS model_a, greatest(model_a, model_b) AS model_b, judge,
                 CASE WHEN model_a > model_b AND winner = 'model_a' THEN 'model_b' WHEN model_a > model_b AND winner = 'model_b' THEN 'model_a' ELSE winner END AS winner
          FROM fx_raw)
, it AS (SELECT *, 'q' || question_id || '-t' || turn || '-' || model_a || '-vs-' || model_b AS id, 'q' || question_id AS cluster_id FROM can)"""
_LABEL = "CASE winner WHEN 'model_a' THEN 'A' WHEN 'model_b' THEN 'B' WHEN 'tie' THEN 'tie' WHEN 'tie (bothbad)' THEN 'tie' END"
_VERDICTS = _CANONICAL + f"""
, vr AS (SELECT id, CASE WHEN winner = 'tie (inconsistent)' THEN 'tie' ELSE {_LABEL} END AS winner, winner = 'tie (inconsistent)' AS position_unstable FROM it)"""


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return adapter.with_items(view(spark, sf, "fx_raw"))


@query(with_views(["fx_raw"], _VERDICTS + """
, d AS (SELECT id, count(DISTINCT winner || CASE WHEN position_unstable THEN '1' ELSE '0' END) AS n, min(winner) AS w, bool_or(position_unstable) AS u
        FROM vr WHERE winner IS NOT NULL GROUP BY id)
SELECT id AS row_id, CASE WHEN n > 1 THEN 'tie' ELSE w END AS winner, n > 1 OR u AS position_unstable, false AS parse_failed, n > 1 AS conflict FROM d"""))
def verdict_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.resolve_conflicts(dealt(adapter.verdict_records(_items(spark, sf)), n_lines(spark, sf), "id"))


@query(with_views(["fx_item"], "SELECT row_id FROM fx_item WHERE item_no % 11 = 0"))
def missing_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    items = view(spark, sf, "fx_item")
    return verdicts.missing_verdicts(items, items.filter("item_no % 11 <> 0"))


_CONFUSION = """
, cf AS (SELECT a.preferred AS r1, i.winner AS r2, count(*) AS n FROM fx_ann a JOIN fx_item i ON a.row_id = i.row_id WHERE NOT i.parse_failed GROUP BY ALL)"""


@query(with_views(["fx_item", "fx_ann"], _CONFUSION + _kappa_sql("cf", "jk") + "SELECT n, round(CAST(n_agree AS DOUBLE) / n, 9) AS agreement, round(kappa, 9) AS kappa FROM jk"))
def judge_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(calibration.judge_agreement(view(spark, sf, "fx_ann"), _judged(spark, sf)))


@query(with_views(["fx_item", "fx_ann"], _CONFUSION + "SELECT r1 AS human, r2 AS judge, n FROM cf"))
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return calibration.confusion(view(spark, sf, "fx_ann"), _judged(spark, sf))


@query(with_views(["fx_item", "fx_ann"], _CONFUSION + """
SELECT r1 AS human, CAST(coalesce(sum(n) FILTER (r2 = 'A'), 0) AS BIGINT) AS "A", CAST(coalesce(sum(n) FILTER (r2 = 'B'), 0) AS BIGINT) AS "B",
       CAST(coalesce(sum(n) FILTER (r2 = 'tie'), 0) AS BIGINT) AS tie, CAST(sum(n) AS BIGINT) AS total FROM cf GROUP BY r1"""))
def confusion_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return confusion_table(confusion(spark, sf))


@query(with_views(["fx_item"], """
SELECT count(*) FILTER (NOT parse_failed) AS n_parsed, count(*) FILTER (parse_failed) AS n_parse_failures,
       round(CAST(count(*) FILTER (position_unstable AND NOT parse_failed) AS DOUBLE) / count(*) FILTER (NOT parse_failed), 9) AS position_flip_rate
FROM fx_item WHERE NOT held_out"""))
def flip_rate(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(calibration.flip_rate(_judged(spark, sf).filter("not held_out")))


_CALIBRATION = _QUALITY + _HUMAN_PAIRS + _kappa_sql("hp", "hk") + _CONFUSION + _kappa_sql("cf", "jk") + """
, fr AS (SELECT count(*) FILTER (NOT parse_failed) AS n_comparisons, count(*) FILTER (parse_failed) AS n_parse_failures,
                CAST(count(*) FILTER (position_unstable AND NOT parse_failed) AS DOUBLE) / nullif(count(*) FILTER (NOT parse_failed), 0) AS position_flip_rate
         FROM fx_item WHERE NOT held_out)
, cal AS (SELECT fr.*, jk.n, CAST(jk.n_agree AS DOUBLE) / jk.n AS agreement, jk.kappa, lq.*, hk.kappa AS human_kappa,
                 (CAST(jk.n_agree AS DOUBLE) / jk.n) / lq.human_agreement AS share_of_human_agreement, jk.kappa / hk.kappa AS share_of_human_kappa
          FROM fr, jk, lq, hk)"""
_ROUND = ("agreement", "kappa", "human_agreement", "human_kappa", "tie_rate", "position_flip_rate", "share_of_human_agreement", "share_of_human_kappa")
_ROUNDED = ", ".join(f"round({c}, 9) AS {c}" for c in _ROUND)


def _calibration(spark: SparkSession, sf: str, with_ci: bool = False) -> DataFrame:
    return calibration.calibration_report(_calibration_items(spark, sf), view(spark, sf, "fx_ann"), _judged(spark, sf), with_ci=with_ci)


@query(with_views(["fx_item", "fx_ann"], _CALIBRATION + f"SELECT * REPLACE ({_ROUNDED}) FROM cal"))
def calibration_report(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_calibration(spark, sf))


_GATE = """
, gate AS (SELECT *, CASE WHEN kappa IS NULL THEN 'kappa undefined' WHEN human_kappa IS NULL THEN 'no human ceiling'
                          WHEN human_kappa <= 0 THEN 'human kappa not above chance' WHEN kappa / human_kappa < 0.5 THEN 'share of human kappa too low' END AS gate_reason FROM cal)"""


@query(with_views(["fx_item", "fx_ann"], _CALIBRATION + _GATE + "SELECT round(kappa, 9) AS kappa, round(human_kappa, 9) AS human_kappa, gate_reason, gate_reason IS NULL AS gate_passed FROM gate"))
def trust_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(calibration.trust_gate(_calibration(spark, sf)).select("kappa", "human_kappa", "gate_reason", "gate_passed"))


_CLUSTER_HITS = """
, ih AS (SELECT a.row_id, count(*) FILTER (a.preferred = i.winner) AS hit, count(*) AS k FROM fx_ann a JOIN fx_item i ON a.row_id = i.row_id WHERE NOT i.parse_failed GROUP BY a.row_id)
, hc AS (SELECT i.cluster_id, coalesce(sum(ih.hit), 0)::DOUBLE AS num, coalesce(sum(ih.k), 0)::DOUBLE AS den
         FROM fx_item i LEFT JOIN ih ON i.row_id = ih.row_id WHERE NOT i.held_out AND NOT i.parse_failed GROUP BY i.cluster_id)"""
_RATIO_CI = "quantile_cont(num / den, 0.025) AS ci_lower, quantile_cont(num / den, 0.975) AS ci_upper"


@query(with_views(["fx_item", "fx_ann"], _CALIBRATION + _GATE + _CLUSTER_HITS + bootstrap.tree_sql("hc", ["num", "den"], "hr") + f"""
, hi AS (SELECT {_RATIO_CI} FROM hr WHERE den > 0)
SELECT n, round(agreement, 9) AS agreement, round(ci_lower, 9) AS agreement_ci_lower, round(ci_upper, 9) AS agreement_ci_upper, round(kappa, 9) AS kappa,
       round(human_kappa, 9) AS human_kappa, gate_reason IS NULL AS gate_passed FROM gate, hi"""))
def calibration_interval(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(calibration.trust_gate(_calibration(spark, sf, with_ci=True)).select(
        "n", "agreement", "agreement_ci_lower", "agreement_ci_upper", "kappa", "human_kappa", "gate_passed"))


_CELLS = [f"c_{i}_{j}" for i in range(4) for j in range(4)]
_PLACE = "CASE {0} WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'tie' THEN 2 ELSE 3 END"


@query(with_views(["fx_item", "fx_ann"], """
, kc AS (SELECT i.cluster_id, """ + ", ".join(f"count(*) FILTER ({_PLACE.format('a.preferred')} = {i} AND {_PLACE.format('i.winner')} = {j} AND a.row_id IS NOT NULL)::DOUBLE AS c_{i}_{j}"
                                              for i in range(4) for j in range(4)) + """
         FROM fx_item i LEFT JOIN fx_ann a ON a.row_id = i.row_id WHERE NOT i.held_out AND NOT i.parse_failed GROUP BY i.cluster_id)
""" + bootstrap.tree_sql("kc", _CELLS, "kr") + f"""
, ks AS (SELECT {calibration.kappa_of_cells(4)} AS kappa FROM kr)
SELECT round(quantile_cont(kappa, 0.025), 9) AS ci_lower, round(quantile_cont(kappa, 0.975), 9) AS ci_upper FROM ks WHERE kappa IS NOT NULL"""))
def kappa_interval(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(calibration.kappa_interval(_calibration_items(spark, sf), view(spark, sf, "fx_ann"), _judged(spark, sf)))


# --- scoring ------------------------------------------------------------------------------------------------------------

_Z = sum(Z_SCORES[0.05, 0.80])
_SCORE = f"""
, u AS (SELECT *, NOT position_unstable AND NOT parse_failed AS usable FROM fx_item WHERE held_out)
, sc0 AS (SELECT count(*) AS n, count(*) FILTER (usable) AS n_scored, count(*) FILTER (usable AND winner = 'A') AS n_wins_1,
                 count(*) FILTER (usable AND winner = 'B') AS n_wins_2, count(*) FILTER (usable AND winner = 'tie') AS n_ties,
                 count(*) FILTER (position_unstable AND NOT parse_failed) AS n_position_unstable, count(*) FILTER (parse_failed) AS n_parse_failures FROM u)
, sc1 AS (SELECT *, (n_wins_1 + n_ties * 0.5::DOUBLE) / nullif(n_scored, 0) AS win_rate,
                 CASE WHEN n_scored > 0 THEN {_Z!r}::DOUBLE * 0.5::DOUBLE / sqrt(CAST(n_scored AS DOUBLE)) ELSE 0.5 END AS minimum_detectable_effect,
                 CAST(n_wins_1 + n_wins_2 AS DOUBLE) / nullif(n_scored, 0) AS decisive_rate, CAST(n_position_unstable AS DOUBLE) / n AS instability_rate,
                 CAST(n_parse_failures AS DOUBLE) / n AS parse_failure_rate FROM sc0)
, sc AS (SELECT *, win_rate IS NULL OR abs(win_rate - 0.5) < minimum_detectable_effect AS underpowered FROM sc1)"""
_SCORE_ROUNDED = ", ".join(f"round({c}, 9) AS {c}" for c in ("win_rate", "minimum_detectable_effect", "decisive_rate", "instability_rate", "parse_failure_rate"))


def _held_out(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).filter("held_out")


@query(with_views(["fx_item"], _SCORE + f"SELECT * REPLACE ({_SCORE_ROUNDED}) FROM sc"))
def policy_score(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(scoring.policy_score(_held_out(spark, sf)))


@query(with_views(["fx_item"], "SELECT row_id FROM fx_item WHERE held_out AND NOT position_unstable AND NOT parse_failed"))
def scored_rows(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.scored_rows(_held_out(spark, sf))


_WIN_SUMS = """
, cs AS (SELECT cluster_id AS cluster, sum(CASE WHEN NOT usable THEN 0.0 WHEN winner = 'A' THEN 1.0 WHEN winner = 'tie' THEN 0.5 ELSE 0.0 END::DOUBLE) AS num,
                sum(CASE WHEN usable THEN 1.0 ELSE 0.0 END::DOUBLE) AS den FROM u GROUP BY cluster_id)"""
_TREE = _WIN_SUMS + bootstrap.tree_sql("cs", ["num", "den"], "rp") + f"""
, ci AS (SELECT {_RATIO_CI} FROM rp WHERE den > 0)"""
_BOOTSTRAP = _WIN_SUMS + """
, nb AS (SELECT *, row_number() OVER (ORDER BY md5(cluster), cluster) - 1 AS i, count(*) OVER () AS n FROM cs)
, dr AS (SELECT r.replicate, CAST(floor(('0x' || substr(md5('7|' || r.replicate || '|' || nb.i), 1, 8))::BIGINT / 4294967296.0::DOUBLE * nb.n) AS BIGINT) AS i
         FROM nb, (SELECT unnest(range(2000)) AS replicate) r)
, rp AS (SELECT dr.replicate, sum(nb.num) AS num, sum(nb.den) AS den FROM dr JOIN nb ON dr.i = nb.i GROUP BY dr.replicate)
, ci AS (SELECT quantile_cont(num / den, 0.025) AS ci_lower, quantile_cont(num / den, 0.975) AS ci_upper FROM rp WHERE den > 0)"""


@query(with_views(["fx_item"], _SCORE + _BOOTSTRAP + "SELECT round(ci_lower, 9) AS ci_lower, round(ci_upper, 9) AS ci_upper FROM ci"))
def bootstrap_hash_ci(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(bootstrap.bootstrap_hash_ci(scoring.win_sums(_held_out(spark, sf)), n_resamples=bootstrap.N_RESAMPLES))


@query(with_views(["fx_item"], _SCORE + _TREE + "SELECT round(ci_lower, 9) AS ci_lower, round(ci_upper, 9) AS ci_upper FROM ci"))
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(bootstrap.bootstrap_ci(scoring.win_sums(_held_out(spark, sf))))


def _decided(spark: SparkSession, sf: str, **options: object) -> DataFrame:
    gate = calibration.trust_gate(_calibration(spark, sf))
    score = scoring.policy_report(_held_out(spark, sf), **options).withColumnRenamed("n", "n_heldout").drop("n_parse_failures")
    gate = gate.withColumnRenamed("n_ties", "n_tie_labels")
    return gate.join(F.broadcast(score))                                                          # one row each


@query(with_views(["fx_item", "fx_ann"], _CALIBRATION + _GATE + _SCORE + _TREE + """
SELECT gate_reason IS NULL AS gate_passed, underpowered, round(win_rate, 9) AS win_rate, round(ci_lower, 9) AS ci_lower, round(ci_upper, 9) AS ci_upper,
       CASE WHEN gate_reason IS NOT NULL THEN 'no conclusion' WHEN underpowered THEN 'not enough data' WHEN ci_lower > 0.5 THEN 'first preferred'
            WHEN ci_upper < 0.5 THEN 'second preferred' ELSE 'no reliable difference' END AS decision,
       CASE WHEN position_flip_rate IS NOT NULL THEN CASE WHEN instability_rate > 1.5 * position_flip_rate THEN 'less stable than in calibration' END
            WHEN n_position_unstable > 0 THEN 'no calibration rate to compare with' END AS caveat
FROM gate, sc, ci"""))
def policy_decision(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_decided(spark, sf).select(
        "gate_passed", "underpowered", "win_rate", "ci_lower", "ci_upper", scoring.decision().alias("decision"), scoring.drift_caveat().alias("caveat")))


@query(with_views(["fx_item"], """
, g AS (SELECT position_unstable, parse_failed, winner, row_id, cluster_id FROM fx_item WHERE held_out)
, n AS (SELECT cluster_id, count(*) FILTER (NOT position_unstable AND NOT parse_failed) AS n_scored FROM g GROUP BY cluster_id)
""" + f"SELECT cluster_id, n_scored, round(CASE WHEN n_scored > 0 THEN {_Z!r}::DOUBLE * 0.5::DOUBLE / sqrt(CAST(n_scored AS DOUBLE)) ELSE 0.5 END, 9) AS mde FROM n"))
def mde_table(spark: SparkSession, sf: str) -> DataFrame:
    counts = scoring.policy_score(_held_out(spark, sf), ["cluster_id"])
    return _rounded(counts.select("cluster_id", "n_scored", minimum_detectable_effect(F.col("n_scored")).alias("mde")))


@query()
def report(spark: SparkSession, sf: str) -> DataFrame:
    return report_lines(_decided(spark, sf))


def _section_results(spark: SparkSession, sf: str) -> DataFrame:
    gate = calibration.trust_gate(_calibration(spark, sf))
    score = scoring.policy_report(_held_out(spark, sf))
    return gate.drop("n_ties").join(F.broadcast(score.withColumnsRenamed({"n": "n_heldout", "n_parse_failures": "n_unparsed", "n_ties": "n_wins_0"})))  # one row each


def _sections_sql(first: str, second: str, counted: str = "") -> str:
    parts = [f"SELECT {section} AS section, {n} AS line_no, {in_sql(line, 'printf')} AS line FROM rs WHERE {condition}"
             for n, (section, condition, line) in enumerate(section_lines(first, second))]
    counts = " || ' | ' || ".join(f"CAST({c} AS VARCHAR)" for c in ("sum(n) FILTER (r2 = 'A')", "sum(n) FILTER (r2 = 'B')", "sum(n) FILTER (r2 = 'tie')", "sum(n)"))
    head, tail = (f", al AS (", f") SELECT {counted} FROM al GROUP BY line") if counted else ("", "")
    return (_CALIBRATION + _GATE + _SCORE + _TREE + """
, rs AS (SELECT gate.* EXCLUDE (n_ties), sc.* EXCLUDE (n, n_parse_failures, n_ties), sc.n AS n_heldout, sc.n_parse_failures AS n_unparsed, sc.n_ties AS n_wins_0, ci.* FROM gate, sc, ci)
""" + head + "\nUNION ALL ".join(parts) + f"""
UNION ALL SELECT 2, CASE r1 WHEN 'A' THEN 1 WHEN 'B' THEN 2 ELSE 3 END, r1 || ' | ' || {counts} FROM cf GROUP BY r1
UNION ALL SELECT 2, 0, 'human / judge | A | B | tie | total'""" + tail)


@query(with_views(["fx_item", "fx_ann"], _sections_sql("sys-c", "sys-v")))
def report_in_sections(spark: SparkSession, sf: str) -> DataFrame:
    return report_sections(_section_results(spark, sf), confusion_pivot(spark, sf), "sys-c", "sys-v")


@query(with_views(["fx_item", "fx_ann"], _sections_sql("sys-c", "sys-v", "line, count(*) AS n")))
def written_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report in sections as a text file, read back: its lines and how often each stands there."""
    path = _folder(spark, "report")
    lines = report_in_sections(spark, sf).select((F.col("section") * 1000 + F.col("line_no")).alias("line_no"), "line")
    write_report(lines, path)
    out = settled(spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n")))
    remove(spark, path)
    return out


# --- raw judgments ------------------------------------------------------------------------------------------------------

@query(with_views(["fx_raw"], "SELECT question_id, model_a, model_b, winner, judge, turn, count(*) AS n FROM fx_raw GROUP BY ALL"))
def read_judgments(spark: SparkSession, sf: str) -> DataFrame:
    """Raw judgments as JSON Lines and back."""
    read = _through_json(view(spark, sf, "fx_raw"), records.read_judgments)
    return read.groupBy("question_id", "model_a", "model_b", "winner", "judge", "turn").agg(F.count(F.lit(1)).alias("n"))


@query(with_views(["fx_raw"], _CANONICAL + "SELECT id, cluster_id, model_a, model_b, winner, judge, count(*) AS n FROM it GROUP BY ALL"))
def canonical_judgments(spark: SparkSession, sf: str) -> DataFrame:
    """Rows are counted by what ids are made of, and named afterwards."""
    named = ["question_id", "turn", "model_a", "model_b", "winner", "judge"]
    turn = F.when(F.col("question_id").isNotNull(), F.col("turn"))                              # without a question there is no id
    rows = adapter.canonical_slots(view(spark, sf, "fx_raw")).withColumn("turn", turn).select(named)
    counted = dealt(rows, n_lines(spark, sf), *named).groupBy(named).agg(F.count(F.lit(1)).alias("n"))
    return adapter.with_ids(counted).select("id", "cluster_id", "model_a", "model_b", "winner", "judge", "n")


@query(with_views(["fx_raw"], _CANONICAL + f"""
SELECT id, cluster_id, model_a AS system_a, model_b AS system_b, {_LABEL} AS preferred, judge AS annotator_id FROM it
WHERE NOT (model_a = 'sys-c' AND model_b = 'sys-v') AND {_LABEL} IS NOT NULL"""))
def preference_records(spark: SparkSession, sf: str) -> DataFrame:
    return adapter.preference_records(_items(spark, sf), HELD_OUT_PAIR)


@query(with_views(["fx_raw"], _VERDICTS + "SELECT id, winner, position_unstable FROM vr WHERE winner IS NOT NULL"))
def verdict_records(spark: SparkSession, sf: str) -> DataFrame:
    return adapter.verdict_records(_items(spark, sf))


@query(with_views(["fx_raw"], _CANONICAL + """
SELECT DISTINCT id, cluster_id, model_a AS system_a, model_b AS system_b FROM it WHERE model_a = 'sys-c' AND model_b = 'sys-v'"""))
def heldout_records(spark: SparkSession, sf: str) -> DataFrame:
    return adapter.held_out_records(_items(spark, sf), HELD_OUT_PAIR, "judge")


@query(with_views(["fx_raw"], _CANONICAL + f"""
SELECT DISTINCT id FROM it WHERE NOT (model_a = 'sys-c' AND model_b = 'sys-v') AND {_LABEL} IS NOT NULL
INTERSECT SELECT id FROM it WHERE model_a = 'sys-c' AND model_b = 'sys-v'"""))
def leaked_items(spark: SparkSession, sf: str) -> DataFrame:
    return adapter.leaked_items(preference_records(spark, sf), heldout_records(spark, sf))


def _key_sql(text: str) -> str:
    return f"sha256(trim(regexp_replace(lower({text}), '\\s+', ' ', 'g')))"


@query(with_views(["fx_pair"], f"""
, tx AS (SELECT row_id, {_key_sql('response_a')} AS text_key, row_id LIKE '%0' AS held_out FROM fx_pair WHERE length(trim(response_a)) > 0
         UNION ALL SELECT row_id, {_key_sql('response_b')}, row_id LIKE '%0' FROM fx_pair WHERE length(trim(response_b)) > 0)
, lt AS (SELECT text_key, count(*) FILTER (NOT held_out) AS n_calibration, min(row_id) FILTER (NOT held_out) AS first_calibration,
                count(*) FILTER (held_out) AS n_held_out, min(row_id) FILTER (held_out) AS first_held_out FROM tx GROUP BY text_key)
SELECT * FROM lt WHERE n_calibration > 0 AND n_held_out > 0"""))
def leaked_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that stand in pairs of both splits, under whatever ids."""
    pairs, held_out = view(spark, sf, "fx_pair"), F.col("row_id").like("%0")
    return adapter.leaked_texts(pairs.filter(~held_out), pairs.filter(held_out), ["response_a", "response_b"])


@query(with_views(["fx_raw"], _VERDICTS + f"""
SELECT 'preferences' AS dataset, count(*) AS n FROM it WHERE NOT (model_a = 'sys-c' AND model_b = 'sys-v') AND {_LABEL} IS NOT NULL
UNION ALL SELECT 'verdicts', count(*) FROM vr WHERE winner IS NOT NULL
UNION ALL SELECT 'held_out', count(DISTINCT id) FROM it WHERE model_a = 'sys-c' AND model_b = 'sys-v'"""))
def published_datasets(spark: SparkSession, sf: str) -> DataFrame:
    """The three datasets, published twice as a set; rows of the current one."""
    path, items = _folder(spark, "datasets"), _items(spark, sf)
    for _ in range(2):
        adapter.publish_datasets(items, path, HELD_OUT_PAIR, "judge")
    parts = [spark.read.schema("id string").json(folder).select(F.lit(name).alias("dataset")) for name, folder in adapter.published(spark, path).items()]
    out = settled(parts[0].union(parts[1]).union(parts[2]).groupBy("dataset").agg(F.count(F.lit(1)).alias("n")))
    remove(spark, path)
    return out


@query(with_views(["fx_message"], """
SELECT a.conv_id, CAST((a.n + 1) // 2 AS INTEGER) AS turn, a.text AS prompt, b.text AS response, CAST(a.n - 1 AS INTEGER) AS n_context,
       (SELECT string_agg(c.role || ': ' || c.text, chr(10) ORDER BY c.n) FROM fx_message c WHERE c.conv_id = a.conv_id AND c.n < a.n) AS context
FROM fx_message a JOIN fx_message b ON a.conv_id = b.conv_id AND b.n = a.n + 1 WHERE a.n % 2 = 1"""))
def turn_slices(spark: SparkSession, sf: str) -> DataFrame:
    message = F.struct("n", F.col("role").alias("role"), F.col("text").alias("content"))
    talks = view(spark, sf, "fx_message").groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("m"))
    turns = talks.filter(F.size("m") >= 2).select("conv_id", "m", F.explode(F.sequence(F.lit(1), F.floor(F.size("m") / 2).cast("int"))).alias("turn"))
    sliced = turns.select("conv_id", "turn", adapter.turn_slice(F.col("m"), F.col("turn")).alias("s"))
    joined = F.array_join(F.transform("s.context", lambda c: F.concat(c["role"], F.lit(": "), c["text"])), "\n")
    return sliced.select("conv_id", "turn", "s.prompt", "s.response", F.size("s.context").alias("n_context"), F.nullif(joined, F.lit("")).alias("context"))


# --- replies, prompts and judging ---------------------------------------------------------------------------------------

def _parse_sql(c: str) -> str:
    tag = rf"list_last(regexp_extract_all({c}, '\[\[\s*([ABC])\s*\]\]', 1))"
    return f"CASE WHEN {tag} = 'C' THEN 'tie' ELSE {tag} END"


@query(with_views(["fx_reply"], f"SELECT row_id, {_parse_sql('reply')} AS verdict, {_parse_sql('reply_swapped')} AS verdict_swapped FROM fx_reply"))
def parse_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_reply").select("row_id", parse_verdict(F.col("reply")).alias("verdict"), parse_verdict(F.col("reply_swapped")).alias("verdict_swapped"))


@query(with_views(["fx_reply"], f"""
, pv AS (SELECT row_id, {_parse_sql('reply')} AS f, CASE {_parse_sql('reply_swapped')} WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE {_parse_sql('reply_swapped')} END AS s FROM fx_reply)
SELECT row_id, CASE WHEN f = s THEN f ELSE 'tie' END AS winner, coalesce(f <> s, false) AS position_unstable, f IS NULL OR s IS NULL AS parse_failed FROM pv"""))
def position_check(spark: SparkSession, sf: str) -> DataFrame:
    return judging.position_check(view(spark, sf, "fx_reply"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SINGLE_SQL = """'[User Question]' || chr(10) || prompt || chr(10) || chr(10) || '[The Start of Assistant A''s Answer]' || chr(10) || response_a || chr(10)
 || '[The End of Assistant A''s Answer]' || chr(10) || chr(10) || '[The Start of Assistant B''s Answer]' || chr(10) || response_b || chr(10) || '[The End of Assistant B''s Answer]'"""


def _contexts(rows: DataFrame, messages: Column | None = None) -> DataFrame:
    empty = F.array().cast("array<struct<role:string,text:string>>")
    return rows.withColumns({c: empty if messages is None else messages for c in ("context_a", "context_b")})


@query(with_views(["fx_pair"], f"SELECT row_id, md5({_quoted(SYSTEM_PROMPT)}) AS system_md5, md5({_SINGLE_SQL}) AS user_md5, length({_SINGLE_SQL}) AS n_chars FROM fx_pair"))
def render_single(spark: SparkSession, sf: str) -> DataFrame:
    shown = judging.with_prompts(_contexts(view(spark, sf, "fx_pair")))
    return shown.select("row_id", F.md5("system").alias("system_md5"), F.md5("user").alias("user_md5"), F.length("user").cast("bigint").alias("n_chars"))


def _side_sql(x: str, response: str) -> str:
    nl = "chr(10)"
    return (f"'<|The Start of Assistant {x}''s Conversation with User|>' || {nl} || {nl} || '### User:' || {nl} || cluster_id || {nl} || {nl} || "
            f"'### Assistant {x}:' || {nl} || lang || {nl} || {nl} || '### User:' || {nl} || prompt || {nl} || {nl} || '### Assistant {x}:' || {nl} || {response} || {nl} || {nl} || "
            f"'<|The End of Assistant {x}''s Conversation with User|>'")


_MULTI_SQL = _side_sql("A", "response_a") + " || chr(10) || chr(10) || chr(10) || " + _side_sql("B", "response_b")


@query(with_views(["fx_pair"], f"SELECT row_id, md5({_quoted(MULTI_TURN_SYSTEM_PROMPT)}) AS system_md5, md5({_MULTI_SQL}) AS user_md5, length({_MULTI_SQL}) AS n_chars FROM fx_pair"))
def render_multi(spark: SparkSession, sf: str) -> DataFrame:
    turns = F.array(F.struct(F.lit("user").alias("role"), F.col("cluster_id").alias("text")), F.struct(F.lit("assistant").alias("role"), F.col("lang").alias("text")))
    shown = judging.with_prompts(_contexts(view(spark, sf, "fx_pair"), turns))
    return shown.select("row_id", F.md5("system").alias("system_md5"), F.md5("user").alias("user_md5"), F.length("user").cast("bigint").alias("n_chars"))


_KEYS = f"""
, rk AS (SELECT row_id, sha256('model-x' || chr(10) || {_quoted(SYSTEM_PROMPT)} || chr(10) || {_SINGLE_SQL}) AS key FROM fx_pair)"""


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    shown = judging.with_prompts(_contexts(view(spark, sf, "fx_pair")))
    return shown.select("row_id", replies.request_key(F.lit("model-x"), F.col("system"), F.col("user")).alias("key"))


@query(with_views(["fx_pair"], _KEYS + "SELECT row_id, key FROM rk"))
def request_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _requests(spark, sf)


@query(with_views(["fx_pair"], _KEYS + "SELECT DISTINCT key FROM rk WHERE NOT (key LIKE '0%' OR key LIKE '5%' OR key LIKE 'a%')"))
def pending_requests(spark: SparkSession, sf: str) -> DataFrame:
    requests = _requests(spark, sf)
    cached = requests.filter(F.substring("key", 1, 1).isin("0", "5", "a"))
    return replies.pending_requests(requests, cached).select("key")


@query(with_views(["fx_pair"], _KEYS + "SELECT row_id, key, 'r' || row_id AS response FROM rk WHERE key LIKE '0%'"))
def cached_replies(spark: SparkSession, sf: str) -> DataFrame:
    requests = _requests(spark, sf)
    cache = requests.filter("key like '0%'").select("key", F.concat(F.lit("r"), "row_id").alias("response"))
    return replies.cached_replies(requests, cache)


@query(with_views(["fx_pair"], _KEYS + """
, sp AS (SELECT rk.key, CASE WHEN p.lang = 'en' THEN 'held_out' ELSE 'calibration' END AS split FROM rk JOIN fx_pair p ON rk.row_id = p.row_id)
SELECT key, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM sp GROUP BY key"""))
def request_set(spark: SparkSession, sf: str) -> DataFrame:
    keyed = _requests(spark, sf).join(view(spark, sf, "fx_pair").select("row_id", "lang"), "row_id")
    found = replies.request_set(calibration=keyed.filter("lang <> 'en'"), held_out=keyed.filter("lang = 'en'"))
    return found.select("key", F.array_join("splits", ",").alias("splits"))


@query(with_views(["fx_pair"], "SELECT row_id, cluster_id, prompt, md5(response_b) AS a_md5, md5(response_a) AS b_md5 FROM fx_pair"))
def swapped_slots(spark: SparkSession, sf: str) -> DataFrame:
    return judging.swap_slots(view(spark, sf, "fx_pair")).select(
        "row_id", "cluster_id", "prompt", F.md5("response_a").alias("a_md5"), F.md5("response_b").alias("b_md5"))


_PAIR_REPLY = """CASE WHEN substr(key, 2, 1) < '4' THEN '[[A]]' WHEN substr(key, 2, 1) < '8' THEN '[[B]]' WHEN substr(key, 2, 1) < 'c' THEN 'so [[C]]' ELSE 'none' END"""


@query(with_views(["fx_pair"], _KEYS + f"""
, an AS (SELECT row_id, key, key LIKE '0%' OR key LIKE '5%' OR key LIKE 'a%' AS cached, CASE WHEN key LIKE '1%' THEN 'max_tokens' ELSE 'end' END AS stop, {_PAIR_REPLY} AS reply FROM rk)
SELECT row_id, cached, CASE WHEN cached THEN 'tie' WHEN reply LIKE '%[[A]]%' THEN 'A' WHEN reply LIKE '%[[B]]%' THEN 'B' WHEN reply LIKE '%[[C]]%' THEN 'tie' END AS verdict,
       NOT cached AND stop <> 'max_tokens' AS logged FROM an"""))
def cached_judging(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of all pairs, a part of them with cached replies; the others are asked once each, and a reply cut off by the token limit is not kept."""
    requests = judging.request_rows(_contexts(view(spark, sf, "fx_pair")), "model-x")
    cache = requests.filter(F.substring("key", 1, 1).isin("0", "5", "a")).select("key", F.lit("kept [[C]]").alias("response")).distinct()
    answers = replies.answer_requests(requests, cache, lambda pending: pending.select(
        "key", F.expr(_PAIR_REPLY).alias("response"), F.expr("CASE WHEN key LIKE '1%' THEN 'max_tokens' ELSE 'end' END").alias("stop_reason")))
    told = judging.verdicts_of(requests, answers).join(requests.select("row_id", "key"), "row_id")
    return told.join(answers.select("key", "cached", (~F.col("cached") & replies.cacheable(F.col("stop_reason"))).alias("logged")), "key").drop("key")


def _pair_backend(system: str, user: str) -> tuple[str, str]:
    """Replies by the digits of the request's key, as _PAIR_REPLY."""
    digit = hashlib.sha256(f"model-x\n{system}\n{user}".encode()).hexdigest()[1]
    return "[[A]]" if digit < "4" else "[[B]]" if digit < "8" else "so [[C]]" if digit < "c" else "none", "end"


@query(with_views(["fx_pair"], _KEYS + f"""
, an AS (SELECT row_id, {_PAIR_REPLY} AS reply FROM rk)
SELECT row_id, CASE WHEN reply LIKE '%[[A]]%' THEN 'A' WHEN reply LIKE '%[[B]]%' THEN 'B' WHEN reply LIKE '%[[C]]%' THEN 'tie' END AS verdict FROM an"""))
def logged_judging(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs judged through a log, half of them in a run before: replies come in committed rounds, and only what the log lacks is asked."""
    log, pairs = _folder(spark, "replies"), _contexts(view(spark, sf, "fx_pair"))
    judge = judging.logged_judge("logged", "model-x", _pair_backend, log, round_size=8192)
    judge.verdicts(pairs.filter("lang = 'en'"))
    out = settled(judge.verdicts(pairs))
    remove(spark, log)
    remove(spark, f"{log}-runs")
    return out


@query(with_views(["fx_reply"], "SELECT row_id AS key, CASE WHEN lang = 'de' THEN reply_swapped ELSE reply END AS response FROM fx_reply"))
def appended_log(spark: SparkSession, sf: str) -> DataFrame:
    """Replies appended to a log in two parts, the second of which answers some requests anew; the latest of each."""
    path, rows = _folder(spark, "log"), view(spark, sf, "fx_reply")
    for seq, part in enumerate((rows.select(F.col("row_id").alias("key"), F.col("reply").alias("response")),
                                rows.filter("lang = 'de'").select(F.col("row_id").alias("key"), F.col("reply_swapped").alias("response")))):
        replies.append_replies(part.withColumn("seq", F.lit(seq)), path)
    out = settled(replies.latest_by_key(spark.read.parquet(path), "key", ["seq"]).select("key", "response"))
    remove(spark, path)
    return out


_LATEST = "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS ts FROM events GROUP BY user_id"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


@query(_LATEST)
def latest_by_key(spark: SparkSession, sf: str) -> DataFrame:
    log = _events(spark, sf).select("user_id", "ts", "event_id", F.col("event_type").alias("status"))
    return replies.latest_by_key(log, "user_id", ["ts", "event_id"]).select("user_id", "status", "ts")


@query(f"SELECT status AS event_type, count(*) AS n FROM ({_LATEST}) GROUP BY status")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return replies.status_counts(_events(spark, sf).select("user_id", "ts", "event_id", "event_type"), "user_id", "event_type", ["ts", "event_id"])


_PRICES = [("small", 1.0, 5.0, 1200), ("medium", 2.0, 10.0, 200), ("large", 5.0, 25.0, 200), ("unlisted", None, None, None)]


@query(with_views(["fx_pair"], """
, b AS (SELECT 2 * count(*) AS n_calls, CAST(floor(CAST(sum(length(prompt) + length(response_a) + length(response_b)) AS DOUBLE) / count(*) / 4) AS BIGINT) + 300 AS t FROM fx_pair)
, p(model, i, o, k) AS (VALUES ('small', 1.0::DOUBLE, 5.0::DOUBLE, 1200), ('medium', 2.0, 10.0, 200), ('large', 5.0, 25.0, 200), ('unlisted', 5.0, 25.0, 200))
SELECT model, n_calls, t AS input_tokens, round(n_calls * t * i / 1e6 + n_calls * k * o / 1e6, 6) AS cost FROM p, b"""))
def judging_cost(spark: SparkSession, sf: str) -> DataFrame:
    prices = spark.createDataFrame(_PRICES, "model string, input_price double, output_price double, output_tokens int")
    return _rounded(replies.judging_cost(view(spark, sf, "fx_pair"), 2 * F.col("n"), prices), 6)


# --- robustness ---------------------------------------------------------------------------------------------------------

_PAD = f"{_quoted(PADDING)} || response_a || {_quoted(RESTATEMENT)}"


@query(with_views(["fx_pair"], f"SELECT row_id, md5({_PAD}) AS padded_md5, length({_PAD}) AS n_chars FROM fx_pair"))
def pad_responses(spark: SparkSession, sf: str) -> DataFrame:
    padded = pad_response(F.col("response_a"))
    return view(spark, sf, "fx_pair").select("row_id", F.md5(padded).alias("padded_md5"), F.length(padded).cast("bigint").alias("n_chars"))


def _cut_sql(text: str, cap: str) -> str:
    head = f"substr({text}, 1, {cap})"
    last = f"(length({head}) - strpos(reverse({head}), ' '))"
    return (f"CASE WHEN length({text}) <= {cap} THEN {text} ELSE regexp_replace(CASE WHEN strpos({head}, ' ') > 0 AND {last} > 0 THEN substr({head}, 1, {last}) ELSE {head} END, "
            f"'\\s+$', '') || '...' END")


def _cap_sql(a: str, b: str) -> str:
    return f"CAST(floor(CAST(least(length({a}), length({b})) AS DOUBLE) * 1.15::DOUBLE) AS BIGINT)"


@query(with_views(["fx_pair"], f"""
, cp AS (SELECT *, {_cap_sql('response_a', 'response_b')} AS cap FROM fx_pair)
SELECT row_id, CAST(cap AS INTEGER) AS cap, md5({_cut_sql('response_a', 'cap')}) AS a_md5, md5({_cut_sql('response_b', 'cap')}) AS b_md5 FROM cp"""))
def truncate_pair(spark: SparkSession, sf: str) -> DataFrame:
    pairs = view(spark, sf, "fx_pair").withColumn("cap", length_cap(F.col("response_a"), F.col("response_b")))
    return pairs.select("row_id", "cap", F.md5(truncate_at_word(F.col("response_a"), F.col("cap"))).alias("a_md5"),
                        F.md5(truncate_at_word(F.col("response_b"), F.col("cap"))).alias("b_md5"))


_NOTE = """CASE WHEN least(length(response_a), length(response_b)) > 0
 AND CAST(greatest(length(response_a), length(response_b)) AS DOUBLE) / least(length(response_a), length(response_b)) > 1.15::DOUBLE
 THEN 'Note: Assistant A''s answer is ' || length(response_a) || ' characters and Assistant B''s answer is ' || length(response_b)
 || ' characters — a substantial length difference. Judge strictly on substance; a longer answer that says the same thing is not better for being longer.' || chr(10) || chr(10)
 ELSE '' END"""


@query(with_views(["fx_pair"], f"SELECT row_id, {_NOTE} AS note FROM fx_pair"))
def length_notes(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_pair").select("row_id", length_note(F.col("response_a"), F.col("response_b")).alias("note"))


@query(with_views(["fx_pair"], f"""
, pp AS (SELECT lang, response_a AS a, response_b AS b, {_PAD} AS pa FROM fx_pair)
SELECT lang, count(*) AS n, round(avg(CASE WHEN greatest(length(a), length(b)) > {_cap_sql('a', 'b')} THEN 1.0 ELSE 0.0 END::DOUBLE), 9) AS baseline_cut_rate,
       round(avg(CASE WHEN greatest(length(pa), length(b)) > {_cap_sql('pa', 'b')} THEN 1.0 ELSE 0.0 END::DOUBLE), 9) AS padded_cut_rate FROM pp GROUP BY lang"""))
def truncation_rates(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(robustness.truncation_rates(view(spark, sf, "fx_pair"), ["lang"]))


def _gaming_sql(verdict: Callable[[str, str], str]) -> str:
    """verdict: SQL of the verdict on two answers; swapping them is done here."""
    def both(a: str, b: str) -> tuple[str, str]:
        first, second = verdict(a, b), verdict(b, a)
        flipped = f"CASE {second} WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE 'tie' END"
        return f"CASE WHEN {first} = {flipped} THEN {first} ELSE 'tie' END", f"{first} <> {flipped}"

    (bw, bu), (pw, pu) = both("response_a", "response_b"), both("pa", "response_b")
    return f"""
, pp AS (SELECT *, {_PAD} AS pa FROM fx_pair)
, g AS (SELECT {bw} AS bw, {bu} AS bu, {pw} AS pw, {pu} AS pu FROM pp)
, s AS (SELECT count(*) AS n, count(*) FILTER (NOT bu AND NOT pu) AS m, count(*) FILTER (NOT bu AND NOT pu AND bw = 'A') AS a,
               count(*) FILTER (NOT bu AND NOT pu AND pw = 'A') AS pa, count(*) FILTER (NOT bu AND NOT pu AND bw <> 'A') AS o,
               count(*) FILTER (NOT bu AND NOT pu AND bw <> 'A' AND pw = 'A') AS f FROM g)
SELECT n, m AS n_usable, round(CAST(a AS DOUBLE) / nullif(m, 0), 9) AS baseline_a_rate, round(CAST(pa AS DOUBLE) / nullif(m, 0), 9) AS padded_a_rate,
       round(CAST(pa AS DOUBLE) / nullif(m, 0) - CAST(a AS DOUBLE) / nullif(m, 0), 9) AS padding_effect, round(CAST(f AS DOUBLE) / nullif(o, 0), 9) AS flip_rate FROM s"""


def _longer(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) > length({b}) THEN 'A' WHEN length({b}) > length({a}) THEN 'B' ELSE 'tie' END"


def _longer_cut(a: str, b: str) -> str:
    cap = _cap_sql(a, b)
    return _longer(f"({_cut_sql(a, cap)})", f"({_cut_sql(b, cap)})")


#: A marker that some texts hold and others don't.
_MARKER = "the "


def _marked(a: str, b: str) -> str:
    return f"CASE WHEN contains({a}, '{_MARKER}') AND NOT contains({b}, '{_MARKER}') THEN 'A' WHEN contains({b}, '{_MARKER}') AND NOT contains({a}, '{_MARKER}') THEN 'B' ELSE 'tie' END"


def _gaming(spark: SparkSession, sf: str, judge: judging.Judge) -> DataFrame:
    return _rounded(robustness.gaming_summary(robustness.gaming_outcomes(judge, view(spark, sf, "fx_pair"))))


@query(with_views(["fx_pair"], _gaming_sql(_longer)))
def gaming_naive(spark: SparkSession, sf: str) -> DataFrame:
    return _gaming(spark, sf, judging.length_judge())


@query(with_views(["fx_pair"], _gaming_sql(_longer_cut)))
def gaming_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return _gaming(spark, sf, judging.length_normalized(judging.length_judge()))


@query(with_views(["fx_pair"], _gaming_sql(_marked)))
def gaming_disclosed(spark: SparkSession, sf: str) -> DataFrame:
    return _gaming(spark, sf, judging.length_disclosed(judging.marker_judge(_MARKER)))
