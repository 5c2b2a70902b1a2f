import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import labels, verdicts
from plumbline.sources import adapter, records

RECORD = "ord int, id string, prompt string, response_a string, response_b string, preferred string, annotator_id string, cluster_id string"


def _merged(spark, rows):
    return {r["row_id"]: r for r in records.merge_records(spark.createDataFrame(rows, RECORD)).collect()}


def test_merge_by_id_and_by_content(spark):
    out = _merged(spark, [
        (1, "c0", "p", "a", "b", "A", "e1", None), (2, None, "p", "a", "b", "B", None, ""), (3, "c0", "late", "a", "b", "tie", "e2", "q"),
        (4, None, "p", "a", "b", "A", None, "z"), (5, "c1", "p", "a", "b", None, None, "q")])
    assert set(out) == {"c0", "c1", "__p\x1fa\x1fb"}
    assert [a["preferred"] for a in out["c0"]["annotations"]] == ["A", "tie"]
    assert (out["c0"]["prompt"], out["c0"]["cluster_id"]) == ("p", "c0")
    assert [a["preferred"] for a in out["__p\x1fa\x1fb"]["annotations"]] == ["B", "A"]
    assert out["__p\x1fa\x1fb"]["cluster_id"] == "__p\x1fa\x1fb"
    assert out["c1"]["annotations"] == []


def test_id_never_meets_content(spark):
    out = records.merge_records(spark.createDataFrame([
        (1, "__p\x1fa\x1fb", "p", "a", "b", "A", None, None), (2, None, "p", "a", "b", "B", None, None)], RECORD))
    assert out.count() == 2


def test_json_lines(spark, tmp_path):
    lines = [{"id": 7, "prompt": "p", "response_a": "a", "response_b": "b", "annotations": [{"preferred": "A"}, {"preferred": "B", "annotator_id": "x"}],
              "context_a": [["user", "hi"]]}, {"id": None, "prompt": "p", "response_a": "a", "response_b": "b", "preferred": "tie"}]
    (tmp_path / "r.jsonl").write_text("\n\n".join(map(json.dumps, lines)) + "\n")
    read = records.read_comparison_records(spark, str(tmp_path / "r.jsonl"))
    out = {r["row_id"]: r for r in records.merge_records(read).collect()}
    assert [a["preferred"] for a in out["7"]["annotations"]] == ["A", "B"]
    assert out["7"]["context_a"][0]["text"] == "hi"
    report = records.load_report(records.merge_records(read)).first()
    assert tuple(report) == (2, 3, 1, 0.5)
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        records.read_comparison_records(spark, str(tmp_path / "bad.jsonl")).collect()


def test_verdict_file_defaults_to_stable(spark, tmp_path):
    (tmp_path / "v.jsonl").write_text('{"id": "c0", "winner": "A"}\n{"id": "c1", "winner": "tie", "position_unstable": true}\n')
    assert {r["id"]: r["position_unstable"] for r in records.read_verdict_records(spark, str(tmp_path / "v.jsonl")).collect()} == {"c0": False, "c1": True}


LABELS = "row_id string, ann_ord int, preferred string"


def _labels(spark, items):
    rows = [(k, i + 1, p) for k, ps in items.items() for i, p in enumerate(ps)]
    return spark.createDataFrame([(k,) for k in items], "row_id string"), spark.createDataFrame(rows, LABELS)


def test_majority(spark):
    items, lab = _labels(spark, {"c0": ["tie", "tie"], "c1": ["A", "B"], "c2": ["A", "A", "B"], "c3": []})
    got = {r["row_id"]: r["majority"] for r in labels.majority_labels(items, lab).collect()}
    assert got == {"c0": "tie", "c1": "split", "c2": "A", "c3": None}


def test_label_quality(spark):
    row = labels.label_quality(*_labels(spark, {"c0": ["A", "A", "B"], "c1": ["tie", "tie"], "c2": ["A"]})).first()
    assert (row["n_repeat_labelled"], row["n_contested_items"], row["n_contested_annotations"], row["n_ties"]) == (2, 1, 3, 2)
    assert row["human_agreement"] is None
    row = labels.label_quality(*_labels(spark, {f"c{i}": ["A", "A"] for i in range(4)} | {"d": ["A", "A", "B"]})).first()
    assert (row["n_agreeing_pairs"], row["n_compared_pairs"]) == (5, 7)
    row = labels.label_quality(*_labels(spark, {f"c{i}": ["A", "A"] for i in range(4)} | {"d": ["A", "B"]})).first()
    assert row["human_agreement"] == pytest.approx(0.8)


def test_closed_form_equals_pairs(spark):
    items = {f"i{n}": ["A", "B", "tie", "A", "B"][: 2 + n % 4] if n % 3 else ["tie", "A", "A"] for n in range(12)}
    row = labels.human_kappa(_labels(spark, items)[1]).first()
    from itertools import combinations
    pairs = [p for ps in items.values() for p in combinations(ps, 2)]
    n = len(pairs)
    o = sum(a == b for a, b in pairs) / n
    e = sum(sum(a == c for a, _ in pairs) * sum(b == c for _, b in pairs) for c in ("A", "B", "tie")) / n**2
    assert row["n_pairs"] == n
    assert row["human_kappa"] == pytest.approx((o - e) / (1 - e))


def test_sample_is_exact_and_stable(spark):
    df = spark.range(50).selectExpr("cast(id as string) row_id")
    a = {r[0] for r in labels.sample_comparisons(df, 10).collect()}
    assert len(a) == 10
    assert a == {r[0] for r in labels.sample_comparisons(df.repartition(5), 10).collect()}
    assert labels.sample_comparisons(df, 0).count() == 50
    assert labels.sample_comparisons(df, 500).count() == 50


def test_verdict_conflicts_and_missing(spark):
    v = spark.createDataFrame([("c0", "A", False), ("c0", "B", False), ("c1", "A", False), ("c1", "A", False)], "id string, winner string, position_unstable boolean")
    got = {r["row_id"]: (r["winner"], r["position_unstable"], r["conflict"]) for r in verdicts.resolve_conflicts(v).collect()}
    assert got == {"c0": ("tie", True, True), "c1": ("A", False, False)}
    with pytest.raises(verdicts.VerdictError, match="without a verdict: 1"):
        verdicts.replay(spark.createDataFrame([("c1",), ("c9",)], "row_id string"), v)
    with pytest.raises(verdicts.VerdictError, match="contradictory"):
        verdicts.replay(spark.createDataFrame([("c1",)], "row_id string"), v, strict=True)


def _judgment(a, b, winner, turn=1, q=81):
    def talk(s):
        return [("user", "q1"), ("assistant", f"{s}1"), ("user", "q2"), ("assistant", f"{s}2")]

    return (q, a, b, winner, "author", turn, talk(a), talk(b))


def test_slots_merge_in_either_order(spark):
    rows = spark.createDataFrame([_judgment("x", "m", "model_a"), _judgment("m", "x", "model_b"), _judgment("m", "x", "tie (inconsistent)"),
                                  _judgment("m", "z", "tie (bothbad)", 2), _judgment("m", "z", "odd", 2)], records.JUDGMENT_SCHEMA)
    items = adapter.with_items(rows)
    prefs = adapter.preference_records(items, ("z", "m")).collect()
    assert {(r["id"], r["preferred"], r["response_a"], r["response_b"]) for r in prefs} == {("q81-t1-m-vs-x", "B", "m1", "x1")}
    assert len(prefs) == 2
    v = adapter.verdict_records(items).collect()
    assert sorted((r["winner"], r["position_unstable"]) for r in v) == [("B", False), ("B", False), ("tie", False), ("tie", True)]
    held = adapter.held_out_records(items, ("z", "m"), "winner").collect()
    assert [(r["id"], r["prompt"], r["response_a"], len(r["context_a"])) for r in held] == [("q81-t2-m-vs-z", "q2", "m2", 2)]


def test_write_datasets(spark, tmp_path):
    items = adapter.with_items(spark.createDataFrame([_judgment("x", "m", "model_a"), _judgment("m", "z", "tie")], records.JUDGMENT_SCHEMA))
    counts = adapter.write_datasets(items, str(tmp_path), ("m", "z"), "winner")
    assert counts == {"preferences": 1, "verdicts": 2, "held_out": 1}
    with pytest.raises(Exception, match="(?i)exists"):
        adapter.write_datasets(items, str(tmp_path), ("m", "z"), "winner")
    assert adapter.write_datasets(items, str(tmp_path), ("m", "z"), "winner", overwrite=True) == counts


def test_finished_datasets_are_kept_and_half_written_ones_are_not(spark, tmp_path):
    items = adapter.with_items(spark.createDataFrame([_judgment("x", "m", "model_a"), _judgment("m", "z", "tie")], records.JUDGMENT_SCHEMA))
    counts = adapter.write_datasets(items, str(tmp_path), ("m", "z"), "winner", keep_finished=True)
    assert counts == {"preferences": 1, "verdicts": 2, "held_out": 1}
    assert adapter.write_datasets(items, str(tmp_path), ("m", "z"), "winner", keep_finished=True) == {}
    (tmp_path / "verdicts" / "_SUCCESS").unlink()
    assert adapter.write_datasets(items, str(tmp_path), ("m", "z"), "winner", keep_finished=True) == counts
    only = tmp_path / "only"
    spark.range(1).write.json(str(only / "verdicts"))
    with pytest.raises(FileExistsError):
        adapter.write_datasets(items, str(only), ("m", "z"), "winner")
    assert not (only / "preferences").exists()


def test_read_judgments(spark, tmp_path):
    rows = spark.createDataFrame([_judgment("x", "m", "model_a"), _judgment("m", "x", "model_b", 2)], records.JUDGMENT_SCHEMA)
    rows.write.json(str(tmp_path / "raw"))
    read = records.read_judgments(spark, str(tmp_path / "raw"))
    assert sorted(map(repr, read.drop("ord").collect())) == sorted(map(repr, rows.collect()))
    held = adapter.held_out_records(adapter.with_items(read), ("m", "x"), "ord").collect()
    assert {r["id"]: len(r["context_a"]) for r in held} == {"q81-t1-m-vs-x": 0, "q81-t2-m-vs-x": 2}


def test_large_samples_are_the_small_ones(spark):
    df = spark.range(3000).selectExpr("cast(id as string) row_id", "id as extra")
    for n in (1, 7, 1500, 2999, 3000, 5000):
        small = {r["row_id"] for r in labels.sample_comparisons(df, n, top_rows=10_000).collect()}
        assert {r["row_id"] for r in labels.sample_comparisons(df, n, top_rows=0).collect()} == small
        assert len(small) == min(n, 3000)
    assert labels.sample_comparisons(df.limit(0), 5, top_rows=0).count() == 0


def test_labels_as_rows_equal_merged_labels(spark):
    """Also where one item has most labels: it lies in many ranges, and none holds them all."""
    rows = [(i, "hot" if i % 4 else f"c{i % 7}" if i % 8 else None, "p", "a", f"b{i % 3}", ["A", "B", None][i % 3], f"e{i}", None) for i in range(4000)]
    df = spark.createDataFrame(rows, RECORD).repartition(7)
    want = records.exploded_labels(records.merge_records(df)).select("row_id", F.col("ann_ord").cast("bigint").alias("ann_ord"), "preferred", "annotator_id")
    got = records.merged_labels(df)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert records.merged_labels(df.limit(0)).count() == 0


def test_a_set_of_datasets_is_published_at_once(spark, tmp_path, monkeypatch):
    def build(winner):
        return adapter.with_items(spark.createDataFrame([_judgment("x", "m", winner), _judgment("m", "z", "tie")], records.JUDGMENT_SCHEMA))

    def winners():
        found = adapter.published(spark, str(tmp_path))
        assert len({folder.rpartition("/")[0] for folder in found.values()}) == 1
        return sorted(r["winner"] for r in spark.read.json(found["verdicts"]).collect())

    with pytest.raises(FileNotFoundError):
        adapter.published(spark, str(tmp_path))
    assert adapter.publish_datasets(build("model_a"), str(tmp_path), ("m", "z"), "winner") == {"preferences": 1, "verdicts": 2, "held_out": 1}
    assert winners() == ["B", "tie"]
    write, done = adapter._counted_write, []

    def dies(df, path, mode):
        if done:
            raise KeyboardInterrupt
        done.append(path)
        return write(df, path, mode)

    monkeypatch.setattr(adapter, "_counted_write", dies)
    with pytest.raises(KeyboardInterrupt):                      # between two folders
        adapter.publish_datasets(build("model_b"), str(tmp_path), ("m", "z"), "winner")
    assert winners() == ["B", "tie"]
    monkeypatch.setattr(adapter, "_counted_write", write)
    for _ in range(3):
        adapter.publish_datasets(build("model_b"), str(tmp_path), ("m", "z"), "winner")
    assert winners() == ["A", "tie"]
    assert sum(p.name.startswith("set-") for p in tmp_path.iterdir()) == 2    # the current one and the one before


def test_leaked_texts_have_other_ids(spark):
    kind = "row_id string, a string, b string"
    calibration = spark.createDataFrame([("c1", "Some  text", "x"), ("c2", None, " "), ("c3", "some TEXT\n", "y")], kind)
    held_out = spark.createDataFrame([("h1", "y", " some text"), ("h2", "", None)], kind)
    got = {(r["n_calibration"], r["first_calibration"], r["n_held_out"], r["first_held_out"]) for r in adapter.leaked_texts(calibration, held_out, ["a", "b"]).collect()}
    assert got == {(2, "c1", 1, "h1"), (1, "c3", 1, "h1")}


def test_published_sets_are_written_compressed(spark, sf, tmp_path):
    import pathlib

    from plumbline.fixtures import HELD_OUT_PAIR, view
    from plumbline.sources import adapter

    items = adapter.with_items(view(spark, sf, "fx_raw"))
    written = adapter.publish_datasets(items, str(tmp_path), HELD_OUT_PAIR, "judge")
    for name, folder in adapter.published(spark, str(tmp_path)).items():
        rows = spark.read.json(folder)
        assert rows.count() == written[name]
        plain = sum(len(r["value"]) + 1 for r in rows.selectExpr("to_json(struct(*)) AS value").collect())
        assert sum(f.stat().st_size for f in pathlib.Path(folder).glob("part-*")) < plain / 4
