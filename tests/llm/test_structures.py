"""Prefix tries, personal data and whitening against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import pii, prefix_trie, whitening
from plumbline.llm.queries import QUERIES

# --- prefix trie --------------------------------------------------------------------------------------------------------

TALK = "conv_id bigint, turn bigint, role string, text string"


def rebuilt(rows):
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            talks[c].append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [(role, text) for _, _, role, text in sorted(turns, key=lambda x: x[:2])] for c, turns in talks.items()}
    out = {}
    for c, turns in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = talks.get(c - c % 20, [])[:h] + turns[h:]
    return out


def brute_trie(talks):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(talks):
        turns = tuple(talks[c])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[:d - 1]].add(turns[:d])
        ends[turns].append(c)
    below, out = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below[node] = sum(below[x][0] for x in children[node]) or 1, sum(below[x][1] for x in children[node]) + (len(members[node]) - 1) * words
        out[members[node][0], len(node)] = (members[node[:-1]][0] if node else None, len(members[node]), len(children[node]), *below[node],
                                           hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest())
    return out


def as_dict(df):
    rows = df.collect()
    out = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("shard_turns", [prefix_trie.SHARD_TURNS, 40, 1])
def test_trie_against_brute_force(spark, shard_turns):
    """From one shard to shards so small that all nodes are shared ones."""
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    turns = prefix_trie.materialize(prefix_trie.ordered_turns(df))
    got = as_dict(prefix_trie.trie_nodes(*prefix_trie.with_lent_prefixes(turns, 20, 3), shard_turns=shard_turns))
    assert got == brute_trie(rebuilt(map(tuple, df.select("conv_id", "turn", "role", "text").collect())))


def test_trie_of_copies_chains_and_branches(spark, monkeypatch):
    """A hot first turn, many copies of one conversation, one long chain, prefixes that are whole conversations, blocks of few turns."""
    monkeypatch.setattr(prefix_trie, "LONG_TURNS", 16)
    rows = []
    for c in range(60):
        n = 90 if c == 7 else 20 if c % 3 else 5
        rows += [(c, t, "user" if t % 2 else "assistant", f"word {t} " * (t % 4) if c % 3 or t < 4 else f"own {c}") for t in range(n)]
    df = spark.createDataFrame(rows, TALK)
    turns = prefix_trie.materialize(prefix_trie.ordered_turns(df))
    talks = defaultdict(list)
    for c, _, role, text in rows:
        talks[c].append((role, text))
    for shard_turns in (5, 60, 10_000):
        assert as_dict(prefix_trie.trie_nodes(turns, prefix_trie.members_of(turns), shard_turns=shard_turns)) == brute_trie(talks)


def test_trie_edges(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a b"), (2, None, "", ""), (2, 0, "user", "a b"), (3, 5, "user", "x " * 200_000), (3, 2, None, "y"), (None, 0, "user", "lost"),
            (-21, 0, "user", "a b"), (40, 0, "user", "a"), (41, 0, "user", "b"), (41, 1, "user", "c"), (43, 0, "u", "v"), (4, 1, "same", "row"), (4, 1, "same", "row")]
    df = spark.createDataFrame(rows, TALK).selectExpr("*", "1 AS depth", "'z' AS n_convs", "2 AS place", "3 AS k1")
    assert as_dict(prefix_trie.lent_prefix_trie(df, 20, 3)) == brute_trie(rebuilt(rows))
    plain = as_dict(prefix_trie.prefix_trie(df))
    assert plain[1, 2][1] == 2                                  # null role and text are empty ones, null turns come first
    assert plain[4, 2][:3] == (4, 1, 0)                         # repeated rows are repeated turns
    assert prefix_trie.lent_prefix_trie(df.limit(0), 20, 3).count() == 0


def test_double_array_holds_what_is_added():
    rng = np.random.default_rng(3)
    trie, known, level = prefix_trie.DoubleArray(), {}, np.zeros(1, np.int64)
    for _ in range(6):
        pairs = sorted({(int(p), int(c)) for p in level for c in rng.choice(500, rng.integers(1, 40), replace=False)})[:3000]
        parents, labels = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        slots = trie.add(parents, labels)
        assert len(set(slots.tolist()) | set(known.values())) == len(slots) + len(known)
        known |= {pair: int(s) for pair, s in zip(pairs, slots, strict=True)}
        level = rng.choice(slots, min(60, len(slots)), replace=False)
    for (p, c), s in known.items():
        assert trie.step(np.array([p]), np.array([c])).tolist() == [s]
    absent = next((p, c) for p in {p for p, _ in known} for c in range(500) if (p, c) not in known)
    with pytest.raises(LookupError):
        trie.step(np.array([absent[0]]), np.array([absent[1]]))


# --- personal data ------------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, word):
    d = re.sub("[^0-9]", "", word)
    if kind == "card":
        worth = [int(x) * (1 + i % 2) for i, x in enumerate(reversed(d))]
        return 16 <= len(d) <= 19 and sum(v - 9 * (v > 9) for v in worth) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in word.split(".")), "phone": 8 <= len(d) <= 15}[kind]


def brute_spans(text):
    return [(kind, m.start(), m.end()) for kind, pattern in PATTERNS.items() for m in re.finditer(pattern, text or "") if holds(kind, m.group(0))]


def digest(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def check_base(rows, got):
    for key, text in rows:
        spans, r = brute_spans(text), got[key]
        assert [r[f"n_{kind}"] for kind in pii.KINDS] == [sum(k == kind for k, _, _ in spans) for kind in pii.KINDS], text
        assert r["base_sha256"] == hashlib.sha256(digest(spans).encode()).hexdigest(), text
        every = [tuple(x.split(":")) for x in r["spans"].split(",") if x]
        assert {tuple(map(str, s)) for s in spans} <= set(every)
        assert [(pii.KINDS.index(k), int(a)) for k, a, _ in every] == sorted((pii.KINDS.index(k), int(a)) for k, a, _ in every)
        assert len(every) == len(spans) + r["n_more"]


def test_base_spans_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check_base(rows, {r["doc_id"]: r for r in QUERIES["op12_pii"](spark, sf).collect()})


TRICKY = ["a@b.c_d@e.f", "x@y", "a@b.c.d@e.f.", "..@..", "a.b@c.d-e.f@g.h", "1.2.3.4.5.6.7.8", "256.1.1.1 1.256.1.1 01.002.3.255", "1.2.3", "é@é.é ü a@b.ü",
          "4111 1111 1111 1111 4111-1111-1111-1111", "4111111111111112", "4111 1111  1111 1111", "+1 (988) 555-2485 +49", "+1+2 (3) 4567890", "+12345678) +1 2345678-", "𝔸😀 a@b.co 😀 +4915112345678",
          "0 " * 400 + "5", "1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6-7", "a" * 3000 + "@b.c", "a" * 5000, "9" * 5000, "1." * 3000, "a@b." * 2000, "+1" * 3000, "1.1.1.1 " * 700, ""]


def test_tricky_texts_against_brute_force(spark):
    """Also long runs, on which naive patterns take the square of their length or recurse, and more matches than one block of prefix sums."""
    rng = np.random.default_rng(5)
    noise = ["".join(rng.choice(list("ab1.@+- ()é"), 40)) for _ in range(600)]
    rows = list(enumerate(TRICKY + noise))
    check_base(rows, {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()})


def test_long_runs_are_read_once(spark):
    """Texts on which the plain patterns take minutes: what they would find is known."""
    rows = [(0, "a" * 400_000), (1, "1" * 400_000), (2, "a." * 200_000), (3, "ab " * 200_000 + "x@y.zz"), (4, "1.1.1.1 " * 20_000), (5, "12 " * 100_000)]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {k: tuple(r[f"n_{kind}"] for kind in pii.KINDS) for k, r in got.items()} == {
        0: (0, 0, 0, 0), 1: (0, 0, 0, 0), 2: (0, 0, 0, 0), 3: (1, 0, 0, 0), 4: (0, 20_000, 0, 0), 5: (0, 0, 0, 0)}
    assert got[3]["spans"] == "email:600000:600006"
    assert got[4]["base_sha256"] == hashlib.sha256(digest([("ip", 8 * i, 8 * i + 7) for i in range(20_000)]).encode()).hexdigest()


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.mark.parametrize(("text", "found"), [
    ("Call us: tel (988) 555-2485 today", [("phone", "(988) 555-2485")]),
    ("mail me: john.doe [at] mail [dot] example [dot] com please", [("email", "john.doe [at] mail [dot] example [dot] com")]),
    ("amex card 3782 822463 10005 was charged", [("card", "3782 822463 10005")]),
    ("host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 is up", [("ip", "2001:0db8:85a3:0000:0000:8a2e:0370:7334")]),
    ("order 4111 1111 1111 1112 shipped", []), ("from 12:30:45 to 13:00:00", []), ("ISBN 978 3161 48410 0", []), ("look at this dot com thing", []), ("see 123.4567.890 or a::b", []),
    ("class foo::bar::baz and 10/12/2024", [])])
def test_further_forms(spark, model, text, found):
    row = pii.spans(spark.createDataFrame([(text,)], "text string"), model).first()
    assert [(s["kind"], text[s["start"]:s["end"]]) for s in row["more"]] == found


def test_label_model_finds_reliable_labelers():
    """Votes of labelers of known accuracy: their reliabilities and the truth come out without labels."""
    rng = np.random.default_rng(1)
    right = dict(zip(pii.LABELERS, (0.95, 0.9, 0.85, 0.6, 0.7, 0.55), strict=True))
    truth = rng.random(20_000) < 0.3
    counts, truths = defaultdict(int), defaultdict(list)
    for y in truth:
        told = tuple(int((1 if y else -1) * (1 if rng.random() < right[name] else -1)) if rng.random() < 0.8 else 0 for name in pii.LABELERS)
        counts[told] += 1
        truths[told].append(y)
    patterns = [{"kind": "email", "shape": "b00", "n": n, **dict(zip(pii.LABELERS, told, strict=True))} for told, n in counts.items()]
    reliability, prior = pii.expectation_maximisation(patterns)
    assert prior["email", "b"] == pytest.approx(0.3, abs=0.03)
    for name, p in right.items():
        assert reliability["email", name, 1, 1] == pytest.approx(p, abs=0.05)
    judged = [(pii.truth(x, reliability, prior) >= 0.5, y) for x, told in zip(patterns, counts, strict=True) for y in truths[told]]
    vote = np.mean([(sum(told) > 0) == y for told in counts for y in truths[told]])
    assert np.mean([a == b for a, b in judged]) > max(0.93, vote)


def test_classifier_equals_gradient_descent():
    rng = np.random.default_rng(2)
    patterns = [{"kind": pii.KINDS[i % 4], "shape": f"b{i % 3}0", **{name: int(rng.integers(-1, 2)) for name in pii.LABELERS}} for i in range(80)]
    n, p = rng.random(80) * 5, rng.random(80)
    w = pii.train(patterns, n.tolist(), p.tolist())
    for f in w:                                                 # the gradient of the penalised likelihood is zero
        total = sum(k * (q - 1 / (1 + np.exp(-sum(w[g] for g in pii.features(x))))) for x, k, q in zip(patterns, n, p, strict=True) if f in pii.features(x))
        assert total == pytest.approx(pii.RIDGE * w[f], abs=1e-6)


def test_column_score_equals_the_model(spark, model):
    text = "tel (988) 555-2485 and (12) 345 6789, x [at] y [dot] com, 3782 822463 10005"
    for kind in pii.KINDS:
        df = spark.createDataFrame([(text,)], "text string").select(pii.found(pii.F.col("text"), pii.WIDE[kind], pii.F.lit(True)).alias("c")).select(pii.F.explode("c").alias("s"))
        s = pii.F.col("s")
        for r in df.select(pii.probability(model, kind, s).alias("p"), pii.shape_of("w", s).alias("shape"), *[v.alias(f"v_{k}") for k, v in pii.votes(kind, s).items()]).collect():
            x = {"kind": kind, "shape": r["shape"], **{k: r[f"v_{k}"] for k in pii.LABELERS}}
            assert r["p"] == pytest.approx(1 / (1 + np.exp(-sum(model.weights.get(f, 0.0) for f in pii.features(x)))))


def test_personal_data_edges(spark):
    rows = [(None, "a@b.cc"), (1, None), (1, "a@b.cc"), (1, "a@b.cc"), (2, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS n_email", "'x' AS spans", "2 AS _pii", "3 AS c")
    got = sorted(((r["doc_id"], r["n_email"], r["spans"]) for r in pii.personal_data(df).collect()), key=repr)
    assert got == [(1, 0, ""), (1, 1, "email:0:6"), (1, 1, "email:0:6"), (2, 0, ""), (None, 1, "email:0:6")]
    assert pii.personal_data(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="base"):
        pii.spans(df.withColumn("base", pii.F.lit(1)), pii.fit(df.limit(0)))


# --- whitening ----------------------------------------------------------------------------------------------------------

def brute_whitening(rows):
    good = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(256 * np.array([v for _, v in good], np.float64)).astype(np.int64)
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    a = distinct - sums / n
    e, w = np.linalg.eigh(a.T @ a / n)
    e, w = e[::-1], w[:, ::-1]
    return [i for i, _ in good], n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ w[:, :4] / np.sqrt(e[:4]), e[:4] / e.sum()


def test_whitening_against_eigenvectors(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    ids, n, deviation, white, explained = brute_whitening(rows)
    got = {(r["vec_id"], r["component"]): r for r in QUERIES["op13_whitening"](spark, sf).collect()}
    assert len(got) == 4 * len(ids)
    table = np.array([[got[i, c]["whitened"] for c in range(1, 5)] for i in ids])
    sign = np.sign((table * white).sum(axis=0))
    assert np.abs(table - white * sign).max() < 1e-9
    for i, d in zip(ids, deviation.tolist(), strict=True):
        assert {got[i, c]["deviation"] for c in range(1, 5)} == {d}
    first = [got[ids[0], c] for c in range(1, 5)]
    assert [r["explained"] for r in first] == pytest.approx(explained.tolist(), rel=1e-10)
    assert {r["n"] for r in first} == {n}
    assert first[0]["identity_error"] < 1e-10


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")


def test_ill_conditioned_and_dependent_columns(spark):
    """Columns that differ by one part in many thousand, and columns that depend on others: the shift carries the first pass, more passes the rest."""
    rng = np.random.default_rng(8)
    base = rng.integers(-4000, 4000, (400, 3))
    near = np.c_[base, base[:, 0] + rng.integers(-1, 2, 400), base[:, 1] - base[:, 2], np.full(400, 7), 1000 * base[:, 2]] / 256
    rows = [(i, v.tolist()) for i, v in enumerate(near)]
    df = _vectors(spark, rows)
    _, model = whitening.fit(df)
    ids, n, _, white, explained = brute_whitening(rows)
    got = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whiten(df).collect()}
    table = np.array([[got[i, c] for c in range(1, 5)] for i in ids])
    assert model.passes >= 3
    assert model.identity_error < 1e-8
    cov = table.T @ table / n
    assert np.abs(cov - np.eye(4)).max() < 1e-8
    assert np.abs(table[:, :3] - white[:, :3] * np.sign((table[:, :3] * white[:, :3]).sum(axis=0))).max() < 1e-6
    assert (model.variances / model.trace)[:3] == pytest.approx(explained[:3], rel=1e-9)
    _, flat = whitening.fit(_vectors(spark, [(i, [i / 256, 2 * i / 256, 5.0]) for i in range(50)]))
    assert len(flat.variances) == 1                             # one dimension is spanned
    assert flat.variances[0] == pytest.approx(5 * np.var(np.arange(50)))


def test_triangular_solve():
    rng = np.random.default_rng(4)
    r = np.triu(rng.normal(size=(150, 150))) + 12 * np.eye(150)
    a = rng.normal(size=(20, 150))
    assert np.abs(whitening.solve_upper(a, r) @ r - a).max() < 1e-10


def test_deviations_of_any_size():
    x = np.array([[3, -5], [1 << 40, 2]])
    assert whitening.deviations(x[:1], 7, [1, 2]) == [(21 - 1) ** 2 + (-35 - 2) ** 2]
    assert whitening.deviations(x, 7, [1, 2]) == [(21 - 1) ** 2 + (-35 - 2) ** 2, None]


def test_whitening_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, 1.0]), (2, [0.25, -1.0]), (2, [0.25, -1.0]), (None, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1.0, -inf]), (7, []), (8, [1.0]), (9, [0.5, 1.0])]
    df = _vectors(spark, rows).selectExpr("*", "array(1L) AS x", "1 AS component", "2 AS n")
    out = whitening.whiten(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in out) == sorted((i, c) for i in (1, 2, 2, 0, 9) for c in (1, 2))
    assert {r["n"] for r in out} == {3}                         # each distinct vector counts once
    one = {r["vec_id"]: r["whitened"] for r in out if r["component"] == 1}
    assert one[1] == one[9]
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(_vectors(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0])])).count() == 0
    assert whitening.whiten(_vectors(spark, [(1, [1e300, 1.0]), (2, [-1e300, 2.0])])).filter("deviation is not null").count() == 0
