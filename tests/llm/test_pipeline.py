import zlib

import duckdb
import pytest

import corpus_pipeline
from plumbline.llm import decontam, line_dedup, packing, quality_cnn
from plumbline.llm.queries import ORACLES, QUERIES
from tests.llm.test_documents import RANKS, brute_links, check_cuts


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}

    # 1: what is kept is what the classifier accepts.
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    learn = [r["doc_id"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    net = quality_cnn.fit(docs, labels.filter(labels["doc_id"].isin(learn)))
    accepted = {r["doc_id"] for r in quality_cnn.score(docs, net).collect() if r["score"] >= 0.5}
    one = corpus_pipeline.quality(spark, docs, sf).cache()
    assert one.columns == columns
    assert {r["doc_id"] for r in one.collect()} == accepted

    # 2: the least document of each group.
    texts = {k: before[k]["text"] for k in accepted}
    two = corpus_pipeline.near_duplicates(spark, one, sf).cache()
    assert two.columns == columns
    kept = {r["doc_id"] for r in two.collect()}
    assert kept == {c for c, _ in brute_links(texts).values()}

    # 3: runs of 50 words that an earlier document holds are cut, nothing else.
    three = corpus_pipeline.substring_dedup(spark, two, sf).cache()
    assert three.columns == columns
    expected = {r["doc_id"]: r["text"] for r in three.collect()}
    cut = {k: texts[k] for k in kept}
    spans = {r["doc_id"]: r["removed"] for r in line_dedup.without_repeats(two).collect()}
    check_cuts(cut, {k: [(x["start"], x["start"] + x["length"]) for x in v or ()] for k, v in spans.items()}, least=0)
    left = {k: line_dedup.cut_text(cut[k], [(x["start"], x["length"]) for x in v or ()]) for k, v in spans.items()}
    assert expected == {k: t for k, t in left.items() if not spans[k] or t.strip(" \t\n\x0b\x0c\r")}
    assert all(r["n_chars"] == len(r["text"]) for r in three.collect())

    # 4: no document holds an item any more, the others stay.
    items = [decontam.normalised_bytes(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    holds = {k for k, t in expected.items() if any(x in decontam.normalised_bytes(t) for x in items)}
    four = corpus_pipeline.decontamination(spark, three, sf).cache()
    assert four.columns == columns
    assert {r["doc_id"] for r in four.collect()} == set(expected) - holds

    # 5: every id of every document is packed.
    encode = packing.load_encoder(RANKS)
    packed = corpus_pipeline.best_fit_packing(spark, four, sf).collect()
    total = {}
    for r in packed:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {k: len(encode(expected[k])) + 1 for k in set(expected) - holds}


def test_run_equals_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select(names).collect())) == sorted(map(tuple, docs.select(names).collect()))


def test_stages_on_odd_rows(spark, sf):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b", None, None, 3), (2, "a b", None, None, 3)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, sf)
        frame.collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_its_sql(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    expected = con.execute(ORACLES[name])
    columns = [c[0] for c in expected.description]
    got = QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, expected.fetchall()))
