import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import langid, quality_cnn, toxicity, words
from plumbline.llm.common import crc_mod
from plumbline.llm.queries import QUERIES, TOKENIZERS

VOCAB = f"{TOKENIZERS}/piece_bpe_32k.model"
EDGE = [(1, None), (2, ""), (3, "  \n\t "), (4, "word"), (5, "word"), (5, "word"), (6, "lang " * 60000), (7, "x" * 200_000), (8, "漢字 😀 é")]


def edge_docs(spark):
    """Nulls, empty, blank, very long and repeated rows, and columns whose names clash with inner ones."""
    rows = [(i, t, "en" if i % 2 else None, None, i) for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double, text_key int")


LABELS = "doc_id bigint, quality int, toxic int"


def ranks(held):
    """Area under the curve."""
    pos = [s for s, y in held if y == 1]
    neg = [s for s, y in held if y == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


@pytest.mark.parametrize(("name", "label", "mod", "held", "sf"), [
    ("op1_quality_cnn", "quality", 3, 1, "/root/testdata/sf0.01"), ("op2_toxicity", "toxic", 5, 0, "/root/testdata/sf0.1")])
def test_held_out_quality(spark, name, label, mod, held, sf):
    out = QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == held) for r in out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert ranks([(r["score"], r[label]) for r in out if r["held_out"]]) > 0.9


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op3_langid"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.97


def test_words_and_blocks():
    rng = random.Random(1)
    texts = ["", "a", "abc déf", "-- x", "x" * 50 + " y", *("".join(rng.choice("ab é-") for _ in range(40)) for _ in range(50))]
    import re

    import pyarrow as pa

    data, offsets = words.text_bytes(pa.array(texts))
    got = [[] for _ in texts]
    for first, block, at in words.blocks(data, offsets, 32):
        start, end, row = words.word_bounds(block, at)
        h = words.Hasher(block)(start, end)
        for s, e, r, x in zip(start, end, row, h, strict=True):
            w = block[s:e].tobytes()
            assert int(x) == words.hash_bytes(w)
            got[first + r].append(w.decode())
    assert got == [re.findall(r"[A-Za-z\x80-\U0010ffff]+", t.lower()) for t in texts]


def _all_segmentations(word, prob):
    if not word:
        return 1.0
    return sum(prob.get(word[:n], 0.0) * _all_segmentations(word[n:], prob) for n in range(1, len(word) + 1))


def test_forward_sums_all_segmentations():
    pieces = [b"a", b"b", b"c", b"ab", b"bc", b"abc", b"ca"]
    prob = np.array([[0.1, 0.2], [0.05, 0.1], [0.1, 0.1], [0.3, 0.1], [0.2, 0.1], [0.05, 0.2], [0.2, 0.2]])
    tests = [b"abc", b"cab", b"bca", b"abcabc", b"c"]
    block = np.frombuffer(b" ".join(tests), np.uint8)
    start, end, _ = words.word_bounds(block, np.array([0, len(block)]))
    lattice = langid._Lattice(langid.PieceTable(pieces), words.Hasher(block), start, end - start)
    a = lattice.forward(prob)
    for i, w in enumerate(tests):
        for k in range(2):
            assert a[i, len(w), k] == pytest.approx(_all_segmentations(w, {p: prob[j, k] for j, p in enumerate(pieces)}))
    counts = lattice.counts(prob[:, 0], end - start, np.ones((len(tests), 1)), len(pieces))
    assert (counts[:, 0] @ np.array([len(p) for p in pieces])) == pytest.approx(sum(map(len, tests)))


def test_language_edges(spark):
    docs = edge_docs(spark)
    model = langid.fit(docs.filter(crc_mod("doc_id", 5) != 0), VOCAB)
    out = langid.predict(docs, model).collect()
    assert len(out) == len(EDGE)
    assert {r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 3)} == {"und"}
    none = langid.fit(docs.limit(0), VOCAB)
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0
    digits = spark.createDataFrame([(1, "12 34 !?"), (2, "…—")], "doc_id bigint, text string")
    assert {r["lang_pred"] for r in langid.predict(digits, model).collect()} == {"und"}


def test_quality_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (7, 0, 0), (8, 1, 1), (None, 1, 1), (6, None, None)], LABELS)
    net = quality_cnn.fit(docs, labels)
    out = quality_cnn.score(docs, net).collect()
    assert len(out) == len(EDGE)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert quality_cnn.fit(docs, labels.limit(0)) == 0.5
    assert quality_cnn.score(docs.limit(0), 0.5).count() == 0
    kept = quality_cnn.accepted(docs, 0.7)
    assert kept.columns == docs.columns
    assert kept.count() == len(EDGE)
    assert quality_cnn.accepted(docs, 0.2).count() == 0


def test_chunks_cover_every_byte():
    offsets = np.array([0, 0, 1, 384, 769, 5000])
    start, row = quality_cnn.chunk_starts(offsets)
    for r in range(5):
        seen = np.zeros(offsets[r + 1] - offsets[r], bool)
        for s in start[row == r] - offsets[r]:
            seen[s:s + quality_cnn.CHUNK] = True
        assert seen.all()
        assert (row == r).any()


def test_gradient_learns_a_late_signal():
    rng = np.random.Generator(np.random.PCG64(0))
    chunks = rng.integers(97, 123, (300, quality_cnn.CHUNK), dtype=np.uint8)
    row, label = np.repeat(np.arange(100), 3), np.arange(100) % 2
    for d in np.flatnonzero(label == 0):
        chunks[3 * d + 2, 300:306] = np.frombuffer(b"###!!!", np.uint8)
    net = quality_cnn.train(chunks, row, label.astype(np.float32), epochs=30)
    tables = net.tables()
    pooled = np.maximum(np.concatenate([net.responses(tables, c[None]).max(1) for c in chunks]) + net.bias, 0)
    assert ((net.probabilities(pooled, row) >= 0.5) == label).mean() > 0.95


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    rng, terms = random.Random(2), [*toxicity.SEED_TERMS, "schmähwortgebilde", "bad*"]
    tests = {"badly", "bad", "bat"}
    for _ in range(800):
        w = list(rng.choice(terms[:-1]))
        for _ in range(rng.randrange(4)):
            j = rng.randrange(len(w))
            w[j:j + rng.randrange(2)] = rng.choice(["", "e", "st"])
            w = w or ["x"]
        tests.add("".join(w))
    tests = sorted(tests)
    block = np.frombuffer(" ".join(tests).encode(), np.uint8)
    start, end, _ = words.word_bounds(block, np.array([0, len(block)]), toxicity._word_table())
    found = toxicity._Matcher(terms)._test(block, words.Hasher(block), start, end)
    for s, e, f in zip(start, end, found, strict=True):
        w = block[s:e].tobytes()
        near = [(_distance(w, t.encode()), n) for n, t in enumerate(terms[:-1]) if _distance(w, t.encode()) <= toxicity.allowed_edits(t)]
        if w.startswith(b"bad"):
            near.append((0, len(terms) - 1))
        assert f == (1 + 4 * min(near)[1] + min(near)[0] if near else 0), w


def test_context_tells_quotation_from_abuse():
    plain, _ = toxicity.hit_score("you are an ", " and more", 0, 0)
    quoted, is_quoted = toxicity.hit_score('he said "you ', '" to me', 0, 0)
    assert is_quoted
    assert quoted < plain
    assert toxicity.hit_score("a ", " b", 1, 0)[0] < toxicity.hit_score("a ", " b", 0, 0)[0]


def test_toxicity_edges(spark):
    docs = edge_docs(spark).union(spark.createDataFrame([(9, "you stupid idiiot, you m0ron", None, None, 0)], edge_docs(spark).schema))
    none = spark.createDataFrame([], LABELS)
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, none).collect()}
    assert out[9]["n_hits"] == 3
    assert out[9]["score"] > 0.5 > out[1]["score"] == out[2]["score"]
    assert toxicity.toxicity(docs, none).count() == len(EDGE) + 1
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def test_lexicon_learns_stems(spark):
    rows = [(f"{w} glorp{s} {n}", 1) for n, (w, s) in enumerate([("x", "er"), ("y", "ung"), ("z", "isch"), ("x", "en")] * 6)]
    rows += [(f"plain words {'abcdefghij'[n % 10] * (n + 1)}", 0) for n in range(24)]
    terms = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert "glorp*" in terms
    assert not any(t.startswith("plain") for t in terms)


def test_every_learned_word_is_matched_with_edits(spark):
    rng = random.Random(12)
    learned = ["".join(rng.choices("bcdfgklmnprstvz", k=7)) for _ in range(120)]
    rows = [(f"{' '.join(rng.sample(learned, 90))} {''.join(rng.choices('aeiou', k=12))}", 1) for _ in range(40)]
    rows += [(f"plain words {''.join(rng.choices('aeiou', k=12))}", 0) for _ in range(40)]
    terms = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert set(learned) <= set(terms)
    docs = spark.createDataFrame([(i, f"some q{w[1:]} here") for i, w in enumerate(learned)], "doc_id bigint, text string")   # no stem is left intact
    assert all(r["n_hits"] == 1 and r["fuzzy"] > 0 for r in toxicity.hit_features(docs, terms).collect())


def test_sample_is_bounded(spark):
    labels = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("label"))
    assert toxicity.sample_per_class(labels, "label", 7).count() == 14


def test_edits_and_context_earn_their_place(spark, monkeypatch):
    """Ablation on planted misspellings and quotations in held-out clean texts."""
    sf, rng = "/root/testdata/sf0.01", random.Random(31)
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    clean = [r["text"] for r in docs.join(labels.filter("toxic = 0 and quality = 1"), "doc_id").filter((crc_mod("doc_id", 5) == 0) & (F.length("text") > 300)).select("text").limit(20).collect()]
    bent = {"idiot": "idiiot", "stupid": "stuppid", "worthless": "worthles", "pathetic": "pathetik", "disgusting": "disgustng"}
    rows = []
    for text in clean:
        words, (term, near) = text.split(" "), rng.choice(list(bent.items()))
        for kind, x in (("clean", "a word"), ("abuse", f"you are a {term}"), ("bent", f"you are a {near}"), ("quoted", f'he said "{term}" and')):
            rows.append((10 ** 6 + len(rows), kind, " ".join([*words[:len(words) // 2], x, *words[len(words) // 2:]])))
    planted = spark.createDataFrame(rows, "doc_id bigint, kind string, text string")
    both = docs.unionByName(planted.drop("kind"))

    def run():
        out = toxicity.toxicity(both, labels.filter(crc_mod("doc_id", 5) != 0)).join(planted.select("doc_id", "kind"), "doc_id").collect()
        return {k: [r["score"] for r in out if r["kind"] == k] for k in ("clean", "abuse", "bent", "quoted")}

    def apart(high, low):
        return ranks([(x, 1) for x in high] + [(x, 0) for x in low])

    full = run()
    with monkeypatch.context() as m:
        m.setattr(toxicity, "learn_edits", lambda sample, terms: ([0] * len(terms), []))
        exact = run()
    with monkeypatch.context() as m:
        m.setattr(toxicity, "hit_score", lambda before, after, edits, others: (1.0, False))
        flat = run()
    assert apart(full["bent"], full["clean"]) > 0.95 > 0.7 > apart(exact["bent"], exact["clean"])
    assert apart(full["abuse"], full["quoted"]) > 0.95 > 0.7 > apart(flat["abuse"], flat["quoted"])
    assert np.mean(full["abuse"]) > np.mean(full["quoted"]) + 0.1


def test_learned_terms_keep_their_edits(spark):
    """Of the terms that the labels of sf0.1 teach, half at least may be misspelt, and a misspelling scores more than without edits."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    known = labels.filter(crc_mod("doc_id", 5) != 0).select("doc_id", F.col("toxic").cast("int").alias("label"))
    sample = docs.join(toxicity.sample_per_class(known, "label", 4000), "doc_id").cache()
    lexicon = toxicity.learn_lexicon(sample, label_col="label")
    terms = list(lexicon)
    edits, ordinary = toxicity.learn_edits(sample, terms)
    learned = [n for n, t in enumerate(terms) if t not in toxicity.SEED_TERMS]
    open_terms = [n for n in learned if edits[n]]
    assert learned
    assert 2 * len(open_terms) >= len(learned), [(t, k) for t, k in zip(terms, edits, strict=True)]
    rng, rows = random.Random(5), []
    for n in open_terms:
        t, forms = terms[n].removesuffix("*"), set()
        while len(forms) < 5:
            at = rng.choice([i for i in range(1, len(t)) if t[i].isascii()])     # edits are counted in bytes
            bent = t[:at] + rng.choice("qxyzvk") + t[at + 1:]
            if bent != t:
                forms.add(bent)
        rows += [(len(rows) + i, f"you are {x}{'en' if terms[n].endswith('*') else ''} indeed") for i, x in enumerate(sorted(forms))]
    planted = spark.createDataFrame(rows, "doc_id bigint, text string")

    def hit(k):
        return sum(r["fuzzy"] > 0 for r in toxicity.hit_features(planted, terms, edits=k, ordinary=ordinary).collect())

    assert hit(edits) > 0.8 * len(rows)
    assert hit([0] * len(terms)) == 0


def test_ordinary_words_are_no_misspellings(spark):
    texts = [(0, "the badge word stupor")] * 3 + [(0, f"plain {i}") for i in range(997)] + [(1, "badgex")]
    sample = spark.createDataFrame(texts, "label int, text string")
    edits, ordinary = toxicity.learn_edits(sample, ["badger", "stupir", "plaun"], near_share=0.01)
    assert edits == [1, 1, 1]
    assert ordinary == [b"badge", b"plain", b"stupor"]          # "plain" is common, and known
    many = sample.filter("label = 1 or text not like 'plain%'").unionByName(
        spark.createDataFrame([(0, f"pla{chr(97 + i)}n plain{chr(97 + i)}") for i in range(26)], "label int, text string"))
    assert toxicity.learn_edits(many, ["badger", "stupir", "plaun"], near_share=0.05)[0] == [1, 1, 0]   # 24 forms seen once
    docs = spark.createDataFrame([(1, "badge badgex"), (2, "stupir stupor"), (3, "plain")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_hits"] for r in toxicity.hit_features(docs, ["badger", "stupir", "plaun"], edits=edits, ordinary=ordinary).collect()}
    assert got == {1: 1, 2: 1, 3: 0}


def test_stems_match_with_edits():
    trie = toxicity.TermTrie(["abcdefgh*", "zz*"])
    assert trie.match(b"abcdefghij") == (0, 0)
    assert trie.match(b"abcdxefghij") == (1, 0)
    assert trie.match(b"abcefghij") == (1, 0)
    assert trie.match(b"abxxefghij") is None
    assert trie.match(b"zzz") == (0, 1)
    matcher = toxicity._Matcher(["abcdefgh*"])
    tests = [b"abcdefghij", b"abcdxefghij", b"abcefghij", b"xabcdefgh", b"abcdefg", b"bcdefghabc", b"abxxefghij", b"abcdefxh"]
    block = np.frombuffer(b" ".join(tests), np.uint8)
    start, end, _ = words.word_bounds(block, np.array([0, len(block)]), toxicity._word_table())
    found = matcher._test(block, words.Hasher(block), start, end)
    for w, f in zip(tests, found, strict=True):
        least = min(_distance(w[:n], b"abcdefgh") for n in range(len(w) + 1))
        assert f == (1 + least if least <= 1 else 0), w


def test_long_words_are_summed_over_all_segmentations():
    rng = random.Random(5)
    pieces = [b"a", b"b", b"ab", b"aab", b"bbba", b"x" * 20]
    prob = np.array([[0.1, 0.2], [0.05, 0.1], [0.3, 0.1], [0.2, 0.1], [0.05, 0.2], [0.01, 0.02]])
    tests = ["".join(rng.choice("ab") for _ in range(n)).encode() for n in (5, 31, 32, 33, 64, 400, 5000)]
    block = np.frombuffer(b" ".join(tests), np.uint8)
    start, end, _ = words.word_bounds(block, np.array([0, len(block)]))
    table, hasher = langid.PieceTable(pieces), words.Hasher(block)
    got = langid.log_probabilities(table, hasher, start, end - start, prob)
    for i, w in enumerate(tests):
        for k in range(2):
            from fractions import Fraction

            a = [Fraction(1)]
            for e in range(1, len(w) + 1):
                a.append(sum((a[e - len(p)] * Fraction(prob[n, k]) for n, p in enumerate(pieces) if e >= len(p) and w[e - len(p):e] == p), Fraction(0)))
                if len(w) > 1000 and e > 300:
                    break
            if len(w) <= 1000:
                import math

                assert got[i, k] == pytest.approx(math.log(a[-1].numerator) - math.log(a[-1].denominator))
    long = langid._LongWord(table, hasher, int(start[1]), 31).counts(np.log(prob[:, 0]), len(pieces))
    short = langid._Lattice(table, hasher, start[1:2], (end - start)[1:2]).counts(prob[:, 0], (end - start)[1:2], np.ones((1, 1)), len(pieces))[:, 0]
    assert long == pytest.approx(short)
    assert np.isfinite(got).all()


def test_forward_pass_equals_a_plain_convolution():
    rng = np.random.Generator(np.random.PCG64(3))
    net = quality_cnn.ByteCNN(rng.normal(size=(256, quality_cnn.DEPTH)).astype(np.float32), rng.normal(size=(quality_cnn.WIDTH, quality_cnn.DEPTH, quality_cnn.FILTERS)).astype(np.float32),
                              rng.normal(size=quality_cnn.FILTERS).astype(np.float32), rng.normal(size=3 * quality_cnn.FILTERS).astype(np.float32) * 0.1, 0.3)
    data = rng.integers(0, 256, 2000, dtype=np.uint8)
    offsets = np.array([0, 0, 10, 700, 2000])
    start, row = quality_cnn.chunk_starts(offsets)
    got = net.probabilities(net.pooled(data, start, offsets[1:][row], net.tables()), row)
    for r in range(4):
        pooled = []
        for s in start[row == r]:
            chunk = np.zeros(quality_cnn.CHUNK, np.uint8)
            part = data[s:min(s + quality_cnn.CHUNK, offsets[r + 1])]
            chunk[:len(part)] = part
            x = net.embed[chunk]
            response = [sum((x[at + w] @ net.filters[w]) for w in range(quality_cnn.WIDTH)) for at in range(0, quality_cnn.CHUNK - quality_cnn.WIDTH + 1, 2)]
            pooled.append(np.maximum(np.max(response, 0) + net.bias, 0))
        joint = np.concatenate([np.max(pooled, 0), np.mean(pooled, 0), np.min(pooled, 0)])
        assert got[r] == pytest.approx(1 / (1 + np.exp(-(joint @ net.out + net.shift))), abs=1e-4)
    chunks = quality_cnn.chunk_bytes(data, start, offsets[1:][row])
    where, most = net.peaks(net.tables(), chunks)
    raw = net.responses(net.tables(), chunks)
    assert (where == raw.argmax(1)).all()
    assert np.allclose(most, raw.max(1))


def test_training_reads_whole_texts_within_its_bound(spark, monkeypatch):
    texts = [(i, f"{i} clean text here. " * 400, 1 - i % 2) for i in range(6)] + [(6, None, 1), (7, "", 0)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, quality int")
    seen = []
    monkeypatch.setattr(quality_cnn, "train", lambda chunks, row, label: seen.append((chunks, row, label)) or 0.5)
    quality_cnn.fit(docs, docs.select("doc_id", "quality"))
    chunks, row, label = seen[0]
    step = quality_cnn.CHUNK - quality_cnn.OVERLAP
    whole = sorted(b"".join(c[:step].tobytes() for c in chunks[row == r]).rstrip(b"\0")[:len(texts[0][1]) // step * step] for r in range(8))
    assert whole == sorted((t or "").encode()[:len(texts[0][1]) // step * step] for _, t, _ in texts)
    assert sorted(label.tolist()) == [0, 0, 0, 0, 1, 1, 1, 1]
    assert isinstance(quality_cnn.fit(docs.filter("doc_id < 6"), docs.select("doc_id", "quality"), sample_bytes=len(texts[0][1]) + 10), float)   # room for one text
    assert len(seen) == 1
