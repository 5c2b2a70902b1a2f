import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import common, decontam, jaccard_join, license_scan, line_dedup, packing, quality_rules, warc, words
from plumbline.llm.queries import QUERIES, TOKENIZERS
from tests.llm.test_classifiers import EDGE, edge_docs

RANKS, JSON = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", f"{TOKENIZERS}/byte_bpe_50k.json"


def texts_of(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# --- packing

def test_both_tokenizers_agree():
    fast, slow = packing.load_encoder(RANKS), packing.load_encoder(JSON)
    for t in ["", " ", "\n\n  a\tb  ", "don't 'REd 12½ ² Ⅷ", "漢字 😀👩‍👩‍👧 x​<|endoftext|> end", "İı ǅ ͅ", "٣٤٥ ①②", "x" * 3000, " " * 900, "\r\n \x1c\x85 q", "\x00 "]:
        assert fast(t) == slow(t)


def test_ids_are_those_of_the_plain_library_call():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(JSON)
    for path in (RANKS, JSON):
        encode = packing.load_encoder(path)
        for t in ["<|endoftext|>", "a <|endoftext|>  b<|endoftext|><|endoftext|>\n", "x<|endoftext", "<|ENDOFTEXT|> é\ud7ff"]:
            assert list(encode(t)) == plain.encode(t, add_special_tokens=False).ids, t
    assert list(packing.load_encoder(RANKS)("<|endoftext|>")) == [50256]


@pytest.mark.parametrize("order", ["given", "sorted"])
def test_sum_of_squares_is_valid_and_tight(order):
    rng = random.Random(4)
    sizes = np.array([rng.choice([100, 100, 36, 1, 64, rng.randrange(1, 101)]) for _ in range(800)])
    if order == "sorted":
        sizes = np.sort(sizes)[::-1]
    where, offset = packing.sum_of_squares(sizes, 100)
    fill = Counter()
    for b, o, s in zip(where.tolist(), offset.tolist(), sizes.tolist(), strict=True):
        assert o == fill[b]
        fill[b] += s
    assert max(fill.values()) <= 100
    assert len(fill) <= -(-sizes.sum() // 100) * 1.05 + 2


def test_sum_of_squares_choice_equals_brute_force():
    rng, capacity = random.Random(5), 12
    sizes = np.array([rng.randrange(1, 12) for _ in range(60)])
    where, _ = packing.sum_of_squares(sizes, capacity)
    gaps: dict[int, int] = {}

    def squares(g):
        return sum(n * n for x, n in Counter(g.values()).items() if x > 0)

    for b, s in zip(where.tolist(), sizes.tolist(), strict=True):
        after = {}
        for x in {g for g in gaps.values() if g >= s} | {capacity}:
            bin_ = next((k for k, g in gaps.items() if g == x), None) if x != capacity else "new"
            after[x] = squares(gaps | {bin_: x - s})
        gaps[b] = gaps.get(b, capacity) - s
        assert squares(gaps) == min(after.values())


def test_packing_round_trip(spark):
    docs = spark.createDataFrame(EDGE + [(n, "some words here " * n) for n in range(10, 120)], "doc_id bigint, text string")
    out = packing.pack_documents(docs, RANKS).collect()
    encode = packing.load_encoder(JSON)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == __import__("zlib").crc32(struct.pack(f"<{r['length']}I", *r["ids"]))
    for doc, text in EDGE + [(n, "some words here " * n) for n in range(10, 120)]:
        if doc != 5:
            parts = sorted(by_doc[doc], key=lambda r: r["piece"])
            assert [i for r in parts for i in r["ids"]] == [*encode(text or ""), 0]
            assert [r["start"] for r in parts] == list(np.cumsum([0] + [r["length"] for r in parts[:-1]]))
            assert all(r["length"] == 2048 for r in parts[1:])
    assert len(by_doc[5]) == 2
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert packing.pack_documents(docs.limit(0), RANKS, with_ids=False).count() == 0


# --- archives

def test_archives(spark, tmp_path):
    pages = spark.createDataFrame(
        [(3, "u\r\nX: y", "a" * 200), (1, None, "a" * 200), (2, "http://z", None), (4, None, ""), (5, "q", "é" * 60), (6, "q", "é" * 60),
         (None, "n", "a" * 200), (7, "s", "short"), (8, "s", "short"), (9, "big", "z" * 600_000), (9, "big", "z" * 600_000)], "page_id bigint, url string, html string")
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path, frame_bytes=1 << 12)
    rows = warc.read_archives(spark, path).collect()
    assert len(rows) == 11
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in rows}
    assert got == {1: ("response", None), 3: ("revisit", 1), None: ("revisit", 1), 2: ("response", None), 4: ("response", None), 5: ("response", None),
                   6: ("revisit", 5), 7: ("response", None), 8: ("response", None), 9: ("response", None)}
    expected = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    for r in rows:
        assert r["payload_bytes"] == len(expected[r["page_id"]])
        assert r["payload_digest"] == hashlib.sha256(expected[r["page_id"]]).hexdigest()
        assert r["record_type"] == "revisit" or r["payload"] == expected[r["page_id"]]
    assert sorted(r["page_id"] for r in warc.read_archives(spark, path, [5, 9]).collect()) == [5, 9, 9]
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_only_pages_that_pass_the_filter_move(spark, tmp_path):
    """Many digests repeat twice, one is hot, most are unique: record types as by hand, and the unique ones are told apart before the join."""
    rng = random.Random(5)
    bodies = [f"{i:06d}" * 20 for i in range(3000)]
    html = bodies + bodies[:700] + [bodies[0]] * 900 + ["tiny"] * 40 + [None] * 3
    ids = list(range(len(html)))
    rng.shuffle(ids)
    pages = spark.createDataFrame(list(zip(ids, ["u"] * len(ids), html, strict=True)), "page_id bigint, url string, html string")
    first = {}
    for i, h in sorted(zip(ids, html, strict=True)):
        first.setdefault(h, i)
    expected = {i: first[h] if h and len(h) >= 100 and first[h] != i else None for i, h in zip(ids, html, strict=True)}
    typed = warc.with_record_types(pages)
    assert {r["page_id"]: r["refers_to"] for r in typed.select("page_id", "refers_to").collect()} == expected
    assert typed.count() == len(html)


def test_word_hashes_do_not_depend_on_portions():
    rng = random.Random(8)
    text = " ".join("x" * rng.randrange(1, 40) + str(rng.randrange(99)) for _ in range(3000)).encode()
    data = np.frombuffer(text, np.uint8)
    start, end, _ = words.word_bounds(data, np.array([0, len(data)]), jaccard_join._words_table())
    whole = words.Hasher(data)(start, end)
    for limit in (1, 50, 1000, 1 << 19):
        assert (words.word_hashes(data, start, end, limit) == whole).all()
    assert [int(whole[i]) for i in (0, 1, 2999)] == [words.hash_bytes(text.split()[i]) for i in (0, 1, 2999)]
    long = np.full(words.KEPT_POWERS[-1] + 9, ord("a"), np.uint8)
    assert words.Hasher(long)(np.array([len(long) - 3]), np.array([len(long)]))[0] == words.hash_bytes(b"aaa")


def test_filter_loses_no_key(spark, monkeypatch):
    rows = spark.range(20_000).select("id", (F.col("id") % 5000).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("s"))
    keys = rows.filter("id % 11 = 0").select("k", "s").distinct()
    told = common.with_filter(rows, keys, ["k", "s"], keys.count())
    assert told.columns == ["id", "k", "s", "_may"] and told.count() == 20_000
    assert told.filter("id % 11 = 0 and not _may").count() == 0
    assert told.filter("id % 11 > 0 and _may").count() < 20_000 / 30
    assert common.with_filter(rows, keys.limit(0), ["k", "s"], 0).filter("_may").count() == 0
    plain = {how: sorted(r["id"] for r in common.keyed_by(rows, keys, ["k", "s"], how).collect()) for how in ("left_semi", "left_anti")}
    monkeypatch.setattr(common, "MAX_BROADCAST_KEYS", 100)
    for how, ids in plain.items():
        got = common.keyed_by(rows, keys, ["k", "s"], how)
        assert got.columns == ["k", "s", "id"]
        assert sorted(r["id"] for r in got.collect()) == ids


def test_bundle_is_plain_zstandard_and_seekable():
    import zstandard

    writer = warc.BundleWriter(100, 3)
    records = [warc.record(i, "u", b"x" * i, hashlib.sha256(b"x" * i).hexdigest(), i, None, "2020-01-01T00:00:00Z") for i in range(50)]
    for i, r in enumerate(records):
        writer.add(i, r)
    raw = writer.close() + struct.pack("<I", warc.SEEK_END)
    assert b"".join(records) == zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    reader = warc.BundleReader(raw)
    assert len(reader.frames) > 10
    assert [r for _, r in reader.records({7, 31})] == [records[7], records[31]]
    with pytest.raises(ValueError, match="seek table"):
        warc.BundleReader(raw[:-1])


# --- repeated passages

def brute_words(text):
    """(start, end, word) by character, independent of the operator's bytes."""
    return [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\u00A0-\u00BF\u2000-\u207F\u3000-\u303F]+", text or "")]


def seen_before(texts, n):
    """Of every text, taken in the order of ids, which words stand in a run of ``n`` words that an earlier place holds."""
    first, out = set(), {}
    for doc in sorted(texts):
        w = [x[2] for x in brute_words(texts[doc])]
        covered = np.zeros(len(w), bool)
        for i in range(len(w) - n + 1):
            run = tuple(w[i:i + n])
            if run in first:
                covered[i:i + n] = True
            first.add(run)
        out[doc] = covered
    return out


def check_cuts(texts, cuts, least=1000):
    """cuts: by id, spans of characters. All long repeats are cut but for a few words at their ends; nothing is cut that no earlier text holds."""
    want, allowed = seen_before(texts, 50), seen_before(texts, 16)
    missed = total = 0
    for doc, text in texts.items():
        gone = np.array([any(a <= x[0] and x[1] <= b for a, b in cuts.get(doc, ())) for x in brute_words(text)], bool)
        assert not (gone & ~allowed[doc]).any(), doc
        assert gone.any() or not want[doc].any(), doc
        missed, total = missed + (want[doc] & ~gone).sum(), total + want[doc].sum()
    assert total >= least
    assert missed <= 0.002 * total


def test_repeats_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts, cuts = texts_of(spark, sf), defaultdict(list)
    for r in QUERIES["op7_line_dedup"](spark, sf).collect():
        span = texts[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(brute_words(span)) == r["n_words"] >= 50
        assert [x[2] for x in brute_words(texts[r["kept_doc_id"]][r["kept_start"]:])[:16]] == [x[2] for x in brute_words(span)[:16]]
        assert (r["kept_doc_id"], r["kept_start"]) < (r["doc_id"], r["start"])
        cuts[r["doc_id"]].append((r["start"], r["start"] + r["length"]))
    check_cuts(texts, cuts)


def test_repeated_rows_are_cut_alike(spark):
    """Rows that repeat id and text have the spans that one such row has, each of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    once = [tuple(r) for r in line_dedup.removed_spans(docs).collect()]
    assert sorted(map(repr, once * 2)) == sorted(repr(tuple(r)) for r in line_dedup.removed_spans(docs.union(docs)).collect())


def test_repeats_inside_lines_and_edges(spark):
    rng = random.Random(21)

    def prose(n, seed):
        return " ".join(random.Random(seed + i).choice("abcdefgh") + str(rng.randrange(10 ** 6)) for i in range(n))

    shared, almost, boiler = prose(51, 1), prose(49, 2), prose(12, 3)
    marked = " ".join(f"{w.upper()}," if i % 3 else w for i, w in enumerate(shared.split()))
    rows = [(20, f"{prose(30, 4)} start {shared} end. {prose(9, 5)}\n{boiler}"), (21, f"{prose(7, 6)}\nX ({marked}) Y\n{boiler}\nZ"), (22, f"{almost}\n{boiler}"), (23, f"Q {almost} R {boiler}"),
            (24, marked), (24, marked), (24, f"other {boiler}"), (None, f"keep {prose(9, 7)} {shared}")]
    docs = edge_docs(spark).union(spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], edge_docs(spark).schema))
    out = line_dedup.without_repeats(docs)
    assert out.columns == [*docs.columns, "removed"]
    got = defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]].append(r["text"])
    assert sum(map(len, got.values())) == len(EDGE) + len(rows)
    assert got[None] == [rows[-1][1]]                                         # a null id ranks first
    assert got[20] == [rows[0][1].replace(f"{shared} ", "")]
    assert got[21] == [rows[1][1].replace(f"({marked}) ", "")]
    assert got[22] == [rows[2][1]]                                            # runs of 49 and of 12 words stay
    assert got[23] == [rows[3][1]]
    assert sorted(got[24]) == ["", "", f"other {boiler}"]
    assert len(got[6][0].split()) < 60                                        # one word over and over
    assert {k: v for k, v in got.items() if k in (1, 2, 3, 4, 5, 7, 8)} == {k: [t for i, t in EDGE if i == k] for k in (1, 2, 3, 4, 5, 7, 8)}
    spans = [r for r in line_dedup.removed_spans(docs).collect() if r["doc_id"] == 21]
    assert [(rows[1][1][r["start"]:r["start"] + r["length"]], r["n_words"], r["kept_doc_id"]) for r in spans] == [(f"({marked})", 51, None)]
    assert line_dedup.removed_spans(docs.limit(0)).count() == 0
    assert line_dedup.without_repeats(docs.limit(0)).count() == 0


def test_a_few_words_over_and_over_are_few_units(spark):
    """Texts that repeat a phrase hundreds of times send no unit for each time, and are cut as whole spans."""
    rng = random.Random(23)
    prose = lambda n: [str(rng.randrange(10 ** 7)) for _ in range(n)]
    texts = {}
    for n in (1, 2, 3, 8, 16, 17):
        phrase, after = prose(n), prose(40)
        run = lambda m: [phrase[i % n] for i in range(m)]  # noqa: B023, E731
        for words in (prose(40) + run(17 + n) + after, prose(9) + run(900) + after, run(300) + prose(30) + run(900)):
            texts[len(texts)] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    per_text = {r["doc_id"]: r["count"] for r in line_dedup.units(docs).groupBy("doc_id").count().collect()}
    assert max(per_text.values()) <= 100 and sum(per_text.values()) <= 500     # 1,174 and 4,349 if each time is a unit
    cuts = defaultdict(list)
    for r in line_dedup.removed_spans(docs).collect():
        cuts[r["doc_id"]].append((r["start"], r["start"] + r["length"]))
    check_cuts(texts, cuts)
    assert max(map(len, cuts.values())) <= 2


def test_repeats_in_scripts_without_spaces(spark):
    shared = "所有权利均由作者保留未经许可不得转载" "すべての権利は著者に帰属します" "สงวนลิขสิทธิ์ทุกประการ"
    docs = spark.createDataFrame([(1, f"前{shared}。后"), (2, f"İ漢字{shared}とภาษ"), (3, shared[:30])], "doc_id bigint, text string")
    got = [(r["doc_id"], r["start"], r["length"], r["kept_doc_id"], r["kept_start"]) for r in line_dedup.removed_spans(docs).collect()]
    assert got == [(2, 3, len(shared), 1, 1)]


def test_repeats_across_blocks_of_a_long_text(spark):
    rng = random.Random(22)
    size = line_dedup.BLOCK_BYTES
    shared = [" ".join(str(rng.randrange(10 ** 7)) for _ in range(60)) for _ in range(4)]
    text = ""
    for n, border in enumerate((size, 2 * size, 2 * size + 1000)):
        while len(text) < border - 300:
            text += f"{rng.randrange(10 ** 9)} é "
        text += shared[n] + " "
    text += "x" * (3 * size) + " " + shared[3]
    docs = spark.createDataFrame([(1, " | ".join(shared)), (2, text)], "doc_id bigint, text string")
    rows = line_dedup.removed_spans(docs).collect()
    assert [text[r["start"]:r["start"] + r["length"]] for r in sorted(rows, key=lambda r: r["start"])] == shared


# --- quality rules

def _brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    counts = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {p for i in range(len(words) - 7) if counts[tuple(words[i:i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules_against_brute_force(spark):
    cases = dict(EDGE) | {30: "a b c d e f g h " * 2, 31: "a b c d e f g h", 32: "l\nl\n \nl\n", 33: "q w e r t y u i o p " + "x y z " * 30, 34: "é ü # * < >| $%&\x0b\x0c\r"}
    texts = texts_of(spark, "/root/testdata/sf0.001") | {1000 + k: v for k, v in cases.items()}
    docs = spark.createDataFrame([(k, v, None if k % 3 else "en", "s", "x") for k, v in texts.items()], "doc_id bigint, text string, lang string, source string, kept string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert len(got) == len(texts)
    for k, t in texts.items():
        r = got[k]
        n = _brute_rules(t or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n, k
        assert r["base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_thresholds_follow_their_group(spark):
    plain = " ".join(f"w{i}" for i in range(40))
    marked = " ".join(f"w{i}{'#' if i % 2 else ''}" for i in range(40))
    rows = [(i, plain, "en", "a") for i in range(100)] + [(100 + i, marked, "en", "b") for i in range(100)] + [(300, marked, "en", "a"), (301, plain, "en", "thin"), (302, plain, None, None)]
    out = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not out[300]
    assert all(v for k, v in out.items() if k != 300)


def test_thresholds_of_given_groups_differ(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("source in ('src1', 'src7', 'src11', 'src13')")
    group = {r["doc_id"]: (r["lang"], r["source"]) for r in docs.select("doc_id", "lang", "source").collect()}
    rows = quality_rules.quality_rules(docs).filter("not base_failed").collect()
    fences = {group[r["doc_id"]]: (r["min_mean_word"], r["max_mean_word"]) for r in rows}
    assert len({r["max_symbol_rate"] for r in rows}) > 1
    assert len(set(fences.values())) > 4
    # the same value is rejected in one group and kept in another
    mean = {r["doc_id"]: r["word_chars"] / max(r["n_words"], 1) for r in rows}
    out = [(group[r["doc_id"]], mean[r["doc_id"]]) for r in rows if not r["min_mean_word"] <= mean[r["doc_id"]] <= r["max_mean_word"]]
    inside = {g: [mean[r["doc_id"]] for r in rows if group[r["doc_id"]] == g and r["kept"]] for g in fences}
    assert any(g != h and min(inside[h]) <= v <= max(inside[h]) for g, v in out for h in fences)


def test_verdicts_against_exact_quantiles(spark):
    """Fences from exact quantiles a rank error below and above, in all groups: what lies beyond both is rejected, what lies within both is kept."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("source in ('src2', 'src5', 'src9') or doc_id % 10 = 3").select("doc_id", "text", "lang", "source")
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    measures, groups, wide, group = {}, defaultdict(list), defaultdict(list), {}
    for r in docs.collect():
        n_words, chars, symbols, dup, repeat = _brute_rules(r["text"] or "")
        lines = max(1, sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (r["text"] or "").split("\n")))
        measures[r["doc_id"]] = {"symbol_rate": (symbols + 1) / (n_words + 1), "dup_line_rate": (dup + 1) / (lines + 1),
                                 "repeat_rate": (repeat + 8) / (n_words + 8), "mean_word": chars / max(n_words, 1)}
        group[r["doc_id"]] = r["lang"], r["source"]
        if not rows[r["doc_id"]]["base_failed"]:
            groups[r["lang"], r["source"]].append(r["doc_id"])
            wide[r["lang"]].append(r["doc_id"])
    values = {(at, m): sorted(measures[i][m] for i in ids) for at, ids in [*groups.items(), *wide.items()] for m in quality_rules.UPPER}

    def q(at, m, p):
        x = values[at, m]
        return x[min(len(x), max(1, math.ceil(round(p * len(x), 6)))) - 1]

    def drawn(g, m, p, e):
        """Quantile of a group drawn to its language; only large sketches have an error."""
        n = len(values[g, m])
        a, b = q(g, m, p), q(g[0], m, p + (e if len(values[g[0], m]) > 300 else 0))
        return b + (a - b) * n / (n + 20)

    def high_fence(g, m, e):
        high = drawn(g, m, 0.9, e)
        return high + 2.5 * (high - drawn(g, m, 0.5, -e))

    def low_fence(g, m, e):
        low = drawn(g, m, 0.1, -e)
        return low - 2.5 * (drawn(g, m, 0.5, e) - low)

    error, checked, total, rejected, small = 0.02, 0, 0, 0, 0
    for g, ids in groups.items():
        for i in ids:
            x = measures[i]
            sure_out = any(x[m] > high_fence(g, m, error) + 1e-9 for m in quality_rules.UPPER) or x["mean_word"] < low_fence(g, "mean_word", error) - 1e-9
            sure_in = all(x[m] <= high_fence(g, m, -error) - 1e-9 for m in quality_rules.UPPER) and x["mean_word"] >= low_fence(g, "mean_word", -error) + 1e-9
            total += 1
            if sure_out or sure_in:
                checked += 1
                rejected += sure_out
                small += sure_out and len(ids) < 50
                assert rows[i]["kept"] == sure_in, (i, g, x)
    assert total > 1000
    assert checked > 0.95 * total
    assert rejected > 20
    assert small > 5


def test_every_fence_varies(spark):
    """No measure has one cutoff for all groups, few rows or many."""
    for sf in ("sf0.01", "sf0.1"):
        rows = quality_rules.quality_rules(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"))
        fences = rows.filter("not base_failed").select("max_symbol_rate", "max_dup_line_rate", "max_repeat_rate", "max_mean_word", "min_mean_word").distinct().toPandas()
        assert fences.nunique().min() > 20, sf



# --- license scan

def _brute_phrases(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = [(i, label) for p, label in license_scan.BASE_PHRASES.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_license_base_against_brute_force(spark):
    texts = texts_of(spark, "/root/testdata/sf0.001") | {1000 + k: v for k, v in EDGE} | {
        2000: "CC BY cc by-sa CC  by all rights reserved", 2001: "ccby", 2002: "cc", 2003: "the general public license. General Public LICENSE"}
    docs = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id bigint, text string, labels string")
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs).collect()}
    assert len(got) == len(texts)
    for k, t in texts.items():
        r = got[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == _brute_phrases(t or ""), k
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert license_scan.license_scan(docs.limit(0)).count() == 0


def test_license_templates(spark):
    mit = license_scan.TEMPLATES[2][1].split()
    dropped = " ".join(w for i, w in enumerate(mit) if i != 9)
    docs = spark.createDataFrame([(1, "Intro. Licensed under the Apache License, Version 2.0. More"), (2, " ".join(mit).upper()), (3, dropped), (4, "licensed under the moon"),
                                  (5, "x Released under the MIT License."), (5, "x Released under the MIT License.")], "doc_id bigint, text string")
    rows = license_scan.license_scan(docs).collect()
    got = {r["doc_id"]: r for r in rows}
    assert {k: r["labels"] for k, r in got.items()} == {1: "apache-2.0", 2: "mit", 3: "mit", 4: "", 5: "mit"}
    assert (got[1]["spans"][0]["start"], got[1]["spans"][0]["end"]) == (1, 9)
    assert got[4]["score"] == 0.0
    assert sum(r["doc_id"] == 5 for r in rows) == 2


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_one_edit_of_every_template_keeps_its_label(spark):
    rows, expected = [], {}
    for n, (label, text) in enumerate(license_scan.TEMPLATES):
        w = text.split()
        at = len(w) // 2
        variants = [w, [*w[:at], "foo", *w[at + 1:]], [*w[:at], *w[at + 1:]], [*w[:at], "foo", *w[at:]], [*w[:at - 1], w[at], w[at - 1], *w[at + 1:]]]
        for v, words in enumerate(variants):
            rows.append((100 * n + v, "Some text. " + " ".join(words).upper() + ", then more"))
            expected[100 * n + v] = (label, _common(w, words) / max(len(w), len(words)))
    out = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for k, (label, score) in expected.items():
        assert label in out[k]["labels"].split(","), rows
        assert max(x["value"] for x in out[k]["spans"]) >= score - 1e-12, k
    for n, (label, text) in enumerate(license_scan.TEMPLATES):
        assert out[100 * n]["labels"] == ",".join(sorted({label} | set(filter(None, out[100 * n]["base_labels"].split(","))))), n      # no other template's label
        assert out[100 * n]["spans"][0][:2] == (2, 2 + len(text.split()))


@pytest.mark.parametrize(("text", "labels"), [
    ("released under the apache license", ""), ("released under the gpl license version 2", ""), ("released under the beer license", ""),
    ("licensed under the gnu general public license version 3", "gpl,gpl-3.0"), ("licensed under the gnu general public license version 4", "gpl"),
    ("licensed under the gnu affero general public license version 3", "agpl-3.0,gpl"), ("licensed under cc by nd 4 0", "cc-by,cc-by-nd-4.0"), ("licensed under cc by nc sa 4 0", "cc-by,cc-by-nc-sa-4.0"),
    ("licensed under cc by sa 3 0", "cc-by"), ("released under a mit license", "mit")])
def test_names_of_other_licenses_are_not_taken(spark, text, labels):
    row = license_scan.license_scan(spark.createDataFrame([(1, f"Some words. {text}, and more.")], "doc_id bigint, text string")).first()
    assert row["labels"] == labels


def test_needed_words_are_words_of_their_templates():
    for start in license_scan.DISTINCTIVE:
        assert any(f"{text} ".startswith(f"{start} ") for _, text in license_scan.TEMPLATES), start
    for _, text in license_scan.TEMPLATES:
        assert set(license_scan.needed_words(text)) <= set(text.split())


def test_license_spans_against_brute_force(spark):
    """Every span's score is that of the words it covers; no placement of a template with one edit or none is missed."""
    rng, rows = random.Random(41), []
    filler = "of the a in license under gnu version public alpha beta".split()
    for n in range(150):
        words = [rng.choice(filler) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            copy = list(rng.choice(license_scan.TEMPLATES)[1].split())
            for _ in range(rng.randrange(4)):
                j = rng.randrange(len(copy))
                copy[j:j + rng.randrange(2)] = rng.choice([[], ["foo"]])
            j = rng.randrange(len(words) + 1)
            words[j:j] = copy
        rows.append((n, " ".join(words)))
    by_label = defaultdict(list)
    for label, text in license_scan.TEMPLATES:
        by_label[label].append(text.split())
    for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        words = rows[r["doc_id"]][1].split()
        for start, end, label, value in r["spans"]:
            assert any(value == pytest.approx(_common(t, words[start:end]) / max(len(t), end - start)) for t in by_label[label])
            assert value >= 0.8
        for label, texts in by_label.items():
            for t in texts:
                for at in range(len(words) - len(t) + 1):
                    told = set(license_scan.needed_words(" ".join(t))) <= set(words[at:at + len(t)])
                    if told and sum(x == y for x, y in zip(t, words[at:at + len(t)], strict=True)) >= len(t) - 1:
                        assert any(s < at + len(t) and at < e for s, e, _, _ in r["spans"]), (label, rows[r["doc_id"]])
    with pytest.raises(ValueError, match="words"):
        license_scan.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string"), templates=[("x", "one")])


# --- near duplicates

def _shingles(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_links(texts, threshold=0.8):
    """Component of every document and its number of links, by comparing all pairs that share a shingle."""
    sets, by_shingle = {k: _shingles(t) for k, t in texts.items()}, defaultdict(list)
    for k, s in sets.items():
        for x in s:
            by_shingle[x].append(k)
    common = Counter((a, b) for v in by_shingle.values() for i, a in enumerate(v) for b in v[i + 1:])
    links, parent = Counter(), {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), c in common.items():
        if c >= threshold * (len(sets[a]) + len(sets[b]) - c) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {k: (find(k), links[k]) for k in sets}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(6)
    texts = texts_of(spark, "/root/testdata/sf0.001")
    base = [rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randrange(40)) for _ in range(120)]
    for n in range(330):                                  # one group larger than two blocks
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(999)}"
        texts[5000 + n] = " ".join(w)
    texts |= {9000: "one two", 9001: "One, two!", 9002: "", 9003: "...", 9004: "one two three"}
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id bigint, text string, class_id string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == brute_links(texts)
    kept = jaccard_join.one_per_class(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c, _ in brute_links(texts).values()})


def test_near_duplicates_leave_a_small_plan(spark):
    """Classes are told once, not in every branch of the last plan."""
    docs = spark.createDataFrame([(n, f"one two three four five six {n % 3}") for n in range(9)], "doc_id bigint, text string")
    plan = jaccard_join.near_duplicates(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 3


def test_near_duplicate_edges(spark):
    docs = edge_docs(spark)
    out = jaccard_join.near_duplicates(docs).collect()
    assert len(out) == len(EDGE)
    assert {r["n_links"] for r in out if r["doc_id"] in (1, 2, 3)} == {0}
    assert {(r["class_id"], r["n_links"]) for r in out if r["doc_id"] in (4, 5)} == {(4, 2)}
    assert jaccard_join.near_duplicates(docs.limit(0)).count() == 0
    assert jaccard_join.one_per_class(docs).count() == len(EDGE) - 2


def test_pruning_bound_keeps_similar_pairs():
    need = jaccard_join.least_matches(0.8, 1e-5)
    rng = np.random.Generator(np.random.PCG64(1))
    matches = np.cumsum(rng.random((200_000, jaccard_join.HASHES)) < 0.8, 1)
    lost = np.zeros(len(matches), bool)
    for n, m in need.items():
        lost |= matches[:, n - 1] < m
    assert lost.mean() < 1e-3
    assert (np.cumsum(rng.random((1000, 16)) < 0.1, 1)[:, -1] < need[16]).mean() > 0.9


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 102), (102, 101), (7, 7), (200, 200)]
    out = {r["node"]: r["component"] for r in jaccard_join.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert out == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 104)}


# --- benchmark decontamination

def _infix(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_infix_distance():
    rng = random.Random(7)
    for _ in range(300):
        item, text = (bytes(rng.choices(b"abc ", k=rng.randrange(a, 30))) for a in (1, 0))
        d, end = decontam.infix_distance(item, text)
        assert d == _infix(item, text)
        assert _infix(item, text[:end]) == d


def test_leaks_exact_and_edited(spark):
    sf, rng = "/root/testdata/sf0.01", random.Random(8)
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    texts = texts_of(spark, sf)
    expected = {(d, i) for d, t in texts.items() for i, x in items.items() if decontam.normalised_bytes(x) in decontam.normalised_bytes(t)}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op10_decontamination"](spark, sf).filter("edits = 0").collect()}
    assert got == expected
    rows = []
    clean = [t for t in texts.values() if len(t) > 400][:50]
    for n in range(200):
        i = rng.choice(list(items))
        s = list(items[i].lower())
        for _ in range(int(0.05 * len(s))):
            j = rng.randrange(len(s))
            s[j:j + rng.randrange(2)] = rng.choice(["", "q", "ab"])
        t = rng.choice(clean)
        rows.append((n, f"{t[:200]} {''.join(s)} {t[200:]}", i))
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(spark.createDataFrame(rows, "doc_id bigint, text string, item bigint"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    near = [(n, i) for n, t, i in rows if _infix(decontam.normalised_bytes(items[i]), decontam.normalised_bytes(t)) <= int(0.1 * len(decontam.normalised_bytes(items[i])))]
    assert np.mean([x in found for x in near]) > 0.9


def test_distances_of_many_texts_at_once():
    rng = random.Random(17)
    items = [bytes(rng.choices(b"abc ", k=n)) for n in (1, 5, 63, 64, 65, 127, 128, 130, 200)]
    texts = [bytes(rng.choices(b"abc d", k=rng.randrange(200))) for _ in range(60)]
    which = np.array([rng.randrange(len(items)) for _ in texts])
    best, end = decontam.infix_distances(items, which, texts)
    for i, t in enumerate(texts):
        assert best[i] == _infix(items[which[i]], t) == _infix(items[which[i]], t[:end[i]])


@pytest.mark.parametrize("edits", [0.02, 0.05, 0.08])
def test_recall_of_edited_items(spark, edits):
    sf, rng = "/root/testdata/sf0.01", random.Random(int(1000 * edits))
    items = {r["item_id"]: r["text"].lower() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    clean = [t for t in texts_of(spark, sf).values() if len(t) > 400][:50]
    rows = []
    for n in range(200):
        i, t = rng.choice(list(items)), rng.choice(clean)
        s = list(items[i])
        for _ in range(int(edits * len(s))):
            j = rng.randrange(len(s))
            s[j:j + rng.randrange(2)] = rng.choice(["", "q", "a"])
        rows.append((n, f"{t[:200]} {''.join(s)} {t[200:]}", i))
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(spark.createDataFrame(rows, "doc_id bigint, text string, item bigint"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert np.mean([(n, i) in found for n, _, i in rows]) >= {0.02: 0.99, 0.05: 0.98, 0.08: 0.95}[edits]


def test_short_items_and_repeated_ids(spark):
    item = "the quick brown fox jumps over the lazy dog and runs far away"
    docs = spark.createDataFrame([(1, f"x {item} y"), (1, "a clean text with the same id"), (2, "Say: OPEN sesame!"), (3, "reopen sesame"), (4, "open sesames"), (5, "open, sesame"), (6, None), (7, "q")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, item), (2, "Open Sesame"), (3, "q"), (4, "…"), (5, "!?")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    assert got == {(1, 1), (2, 2), (5, 2), (7, 3)}
    kept = sorted((r["doc_id"], r["text"]) for r in decontam.clean(docs, bench).filter("text is not null").collect())
    assert kept == [(1, "a clean text with the same id"), (3, "reopen sesame"), (4, "open sesames")]
    assert decontam.clean(docs, bench).filter("text is null").count() == 1


def test_leak_edges(spark):
    item = "the quick brown fox jumps over the lazy dog and runs far away"
    docs = edge_docs(spark).union(spark.createDataFrame([(20, f"Start. {item.upper()}!", None, None, 0), (21, item[:30], None, None, 0), (None, item, None, None, 0)], edge_docs(spark).schema))
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (None, item), (4, "short"), (5, "z " * 3000)], "item_id bigint, text string")
    out = decontam.leaks(docs, bench).collect()
    assert sorted((str(r["doc_id"]), r["item_id"], r["edits"]) for r in out) == [("20", 1, 0), ("None", 1, 0)]
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted([str(i) for i, _ in EDGE] + ["21", "None"])
    assert decontam.leaks(docs, bench.limit(0)).count() == 0
    assert decontam.leaks(docs.limit(0), bench).count() == 0


def test_leaks_across_blocks_of_a_long_text(spark):
    rng, size = random.Random(9), decontam.blocks.__defaults__[0]
    items = {i: " ".join(rng.choice("abcdefgh") + str(rng.randrange(10_000)) for _ in range(30)) for i in range(4)}
    text, filler = "", "plain filler, words\n"
    for i, border in ((0, size), (1, 2 * size), (2, 2 * size + 300_000)):
        sought = items[i] if i != 1 else items[i].replace(" ", " " * 4000)       # normalisation drops most of it
        text += filler * ((border - len(sought) // 2 - len(text)) // len(filler)) + sought + "\n"
    text += filler * 100 + items[3]
    docs = spark.createDataFrame([(1, text), (2, "x " + items[2]), (2, items[2][5:] + " y" * 60), (3, filler)], "doc_id bigint, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): (r["edits"], r["start"], r["end"]) for r in decontam.leaks(docs, bench).collect()}
    plain = decontam.normalised_bytes(text)
    expected = {(1, i): (0, plain.find(x.encode()), plain.find(x.encode()) + len(x)) for i, x in items.items()}
    assert got == expected | {(2, 2): (0, 2, 2 + len(items[2]))}


def test_blocks_of_a_long_text_join_to_its_normal_form():
    rng = np.random.Generator(np.random.PCG64(3))
    data = rng.choice(np.frombuffer(b"ab9 ,-\n", np.uint8), 5 << 20)
    offsets = np.array([0, 10, len(data) - 7, len(data)])
    parts = [x for x in decontam.plain_blocks(data, offsets, 1000, 100) if x[0] == 1]
    whole = decontam.normalise(data[10:-7], np.array([0, len(data) - 17]))[0]
    assert len(parts) == 3
    at = 0
    for _, plain, _, before, own, end in parts:
        assert before + own == at
        assert (whole[before:before + len(plain)] == plain).all()
        assert before == 0 or own >= 200
        at = before + end
    assert at == len(whole) + 1
