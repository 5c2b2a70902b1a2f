"""Personal data by weak supervision, in DataFrame functions alone.

Patterns propose candidate spans. Labelers vote on each (for, against, or
nothing): strict and structural regular expressions, gazetteers, and the words
and characters beside the span. Expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is and how likely each pattern is
personal data; with those probabilities as soft labels a logistic span
classifier is trained on votes and on the form of the span. Counts of patterns
are all that reaches the driver: their number is bounded by the votes and forms,
not by the corpus. Spans that fit the base rules always stay; the classifier
decides on the others. A text is handled where it lies: nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import product
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _NAME = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The base patterns. They match what the plain forms match, leftmost first, but never look at a place twice: a run that has failed from its
#: start is not tried again from its middle (unless an earlier match ended there), and repeated groups do not recurse.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_NAME}++(?:\.{_NAME}++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"\x20?(?:\[at\]|\(at\)|\{at\}|<at>)\x20?", r"\x20?(?:\[dot\]|\(dot\)|\{dot\}|<dot>|\.)\x20?"
#: Further forms that may be personal data. Their first part is bounded, so a long run costs no more than its length.
WIDE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+(?:{_AT}{_NAME}{{1,63}}+(?:{_DOT}{_NAME}{{1,63}}+){{1,5}}|\x20at\x20{_NAME}{{1,63}}+(?:\x20dot\x20{_NAME}{{1,63}}+){{1,5}})",
    "ip": r"(?=[0-9A-Fa-f])(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+|[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){0,5}::[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){1,5})(?![0-9A-Za-z:])",
    "card": r"(?=[3-6])(?<![0-9+.,-])(?<![0-9+]\x20)(?:3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}|[3-6][0-9]{12,14})(?![\x20.,-]?[0-9])",
    "phone": r"(?=[0-9(])(?<![0-9+.,/:-])(?<![0-9+][\x20(])(?:\([0-9]{2,5}\)\x20?[0-9]{3,4}[\x20.-]?[0-9]{3,5}|[0-9]{2,5}[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,5}|00[1-9][0-9]{0,2}\x20[0-9]{2,5}[\x20-][0-9]{3,8})(?![\x20.,/-]?[0-9])",
}
_DIGIT = "[0-9]"


def _may_hold(text: Column, has_digit: Column) -> dict[tuple[str, str], Column]:
    """By kind and family of forms: a cheap test that every text with a match passes."""
    marked = text.contains(" dot ")
    for mark in ("[at]", "(at)", "{at}", "<at>"):
        marked |= text.contains(mark)
    return {("email", "b"): text.contains("@"), ("email", "w"): marked, ("ip", "b"): has_digit, ("ip", "w"): text.contains(":"), ("card", "b"): has_digit,
            ("card", "w"): has_digit, ("phone", "b"): text.contains("+"), ("phone", "w"): has_digit}


_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: Words beside a span that speak for its kind, or against it; in English, German, French and Spanish. Fixed values.
FOR = {
    "email": "e-?mails?|mail|contact|kontakt|courriel|correo|write|schreib\\w*|reply|address|adresse",
    "ip": "ip|ipv[46]|host|server|address|adresse|client|login|logged",
    "card": "card|karte|kreditkarte|carte|tarjeta|visa|mastercard|amex|credit|payment|paid|zahlung|paiement|pago",
    "phone": "tel|telephone|téléphone|telefon|telefono|teléfono|phone|mobile|mobil|handy|cell|fax|call|anruf\\w*|appel\\w*|llam\\w*|whatsapp|sms|contact",
}
AGAINST = {
    "email": "npm|package|import|class|git|ssh|version",
    "ip": "v|version|release|section|chapter|figure|kapitel|firmware|build|rfc",
    "card": "isbn|issn|ean|order|invoice|tracking|serial|id|doi|reference|number of|bestellung|commande|pedido",
    "phone": "isbn|issn|order|invoice|version|serial|id|doi|page|pages|lines|section|reference|total",
}
#: Endings of names of hosts; fixed values, the commonest ones. A two-letter ending counts as a country's.
ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev|cloud|online|shop|site|store|tech|xyz|me|io|example|test"
#: First digits of card numbers by issuer; fixed values.
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|3[068]|35|6011|65|64[4-9]|62"
#: Calling codes of countries; fixed values.
CALLING = ("1|7|20|27|3[0-4]|36|39|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-6][0-9]|29[0-9]|35[0-9]|37[0-9]|38[0-9]|42[013]|50[0-9]|59[0-9]|67[0-9]|68[0-9]|69[0-9]|"
           "85[0-9]|88[0-9]|96[0-8]|97[0-9]|99[2-8]")
LABELERS = ("strict", "form", "gazetteer", "words", "edges", "digits")
LEFT_CHARS, RIGHT_CHARS = 40, 24
#: A candidate that is no base span becomes one of the spans at this probability.
THRESHOLD = 0.5
#: Rounds of expectation-maximisation, and the votes that the prior counts as: this share of a labeler's votes is right before any data.
ROUNDS, PRIOR_VOTES, PRIOR_RIGHT = 60, 20.0, 0.8
#: Weight decay of the classifier, and the weight of each pattern of votes on a further form that it is shown beside those that occur.
RIDGE, UNSEEN_WEIGHT = 0.1, 0.05
#: Lengths at which a prefix sum goes on in blocks.
SUM_BLOCK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sums_before(lengths: Column) -> Column:
    """Sum of all elements before each, in two levels, so that long arrays do not cost the square of their length."""
    def plain(xs: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(xs, start, lambda s, x: F.struct((s["total"] + x).alias("total"), F.concat(s["out"], F.array(s["total"])).alias("out")), lambda s: s["out"])

    def deep(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / SUM_BLOCK).cast("int")), lambda b: F.slice(xs, b * SUM_BLOCK + 1, F.lit(SUM_BLOCK)))
        total = lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a + x)
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, plain(F.transform(bs, total)), lambda b, t: F.transform(plain(b), lambda x: x + t))))

    return F.when(F.size(lengths) <= SUM_BLOCK, plain(lengths)).otherwise(deep(lengths))


_FOUND = "array<struct<start:bigint,end:bigint,word:string,left:string,right:string>>"


def found(text: Column, pattern: str, may_hold: Column) -> Column:
    """All leftmost matches in turn: start, end (in characters), word, and some characters of what lies before and behind, up to the next match.

    Matches and the pieces between them together are the text, so their lengths give the places.
    """
    def placed(s: Column) -> Column:
        n = F.size(s["m"])
        before = F.slice(s["p"], F.lit(1), n)
        lengths = F.zip_with(before, s["m"], lambda a, b: (F.length(a) + F.length(b)).cast("bigint"))
        rows = F.arrays_zip(s["m"].alias("m"), before.alias("a"), F.slice(s["p"], F.lit(2), n).alias("b"), let(lengths, sums_before).alias("t"))
        return F.transform(rows, lambda r: F.struct(
            (r["t"] + F.length(r["a"])).alias("start"), (r["t"] + F.length(r["a"]) + F.length(r["m"])).alias("end"), r["m"].alias("word"),
            F.right(r["a"], F.lit(LEFT_CHARS)).alias("left"), F.left(r["b"], F.lit(RIGHT_CHARS)).alias("right")))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    return F.when(may_hold & text.rlike(pattern), let(both, placed)).otherwise(F.array().cast(_FOUND))


def digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    n = F.length(number)
    worth = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(number, i, F.lit(1)).cast("int") * (1 + (n - i) % 2))
    return F.aggregate(worth, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def valid(kind: str, word: Column) -> Column:
    """Whether a match of the base pattern is one of the base spans."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return word.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    n = F.length(digits(word))
    return let(digits(word), lambda d: F.when(n.between(16, 19), luhn(d)).otherwise(False)) if kind == "card" else n.between(8, 15)


def _vote(*cases: tuple[Column, int]) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for condition, vote in cases:
        out = out.when(condition, F.lit(vote))
    return out.otherwise(F.lit(0))


def _plain(kind: str) -> str:
    return f"^(?:{BASE[kind]})$"


def votes(kind: str, s: Column) -> dict[str, Column]:
    """Of every labeler: 1 for personal data of this kind, -1 against it, 0 for nothing."""
    word, d = s["word"], digits(s["word"])
    n, plain = F.length(d), word.rlike(_plain(kind))
    form = {
        "email": word.rlike("[A-Za-z]{2,}$") & ~word.rlike(r"\.\.|^\.") & ~word.rlike(r"\x20at\x20"),
        "ip": word.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$") & ~word.rlike(r"(?:^|\.)0[0-9]") | word.rlike("^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$") | word.rlike("^[0-9A-Fa-f:]*::[0-9A-Fa-f:]*[0-9A-Fa-f]$") & ~word.rlike("::.*::"),
        "card": n.between(13, 19) & F.when(n.between(13, 19), luhn(d)).otherwise(False),
        "phone": word.rlike(r"^\+") & n.between(8, 15) | word.rlike(r"^\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}$") | word.rlike("^00[1-9]") & n.between(10, 17) | word.rlike(r"^\(?0[1-9][0-9]{1,4}\)?[\x20/.-][0-9]{3,4}[\x20.-]?[0-9]{3,5}$"),
    }[kind]
    known = {
        "email": _vote((word.rlike(r"\x20at\x20"), 0), (word.rlike(rf"(?i)[^A-Za-z](?:{ENDINGS}|[a-z]{{2}})$"), 1), (word.rlike(r"(?i)\.(?:png|jpe?g|gif|svg|js|css|py|java|exe|zip|html?)$"), -1)),
        "ip": _vote((word.rlike(r"^(?:0|127)\.|^(?:[0-9]\.){3}[0-9]$|^255\."), -1), (word.rlike("^[0-9]"), 1)),
        "card": _vote((d.rlike(f"^(?:{ISSUERS})"), 1), (n > 0, -1)),
        "phone": _vote((word.rlike(rf"^(?:\+|00)\x20?(?:{CALLING})"), 1), (word.rlike(r"^(?:\+|00)"), -1)),
    }[kind]
    near = F.concat_ws(" ", s["left"], s["right"])
    return {
        "strict": _vote((plain & valid(kind, word), 1), (plain, -1)),
        "form": _vote((form, 1), (F.lit(True), -1)),
        "gazetteer": known,
        "words": _vote((near.rlike(rf"(?i)(?<![\p{{L}}])(?:{AGAINST[kind]})(?![\p{{L}}])"), -1), (near.rlike(rf"(?i)(?<![\p{{L}}])(?:{FOR[kind]})(?![\p{{L}}])"), 1)),
        "edges": _vote((s["left"].rlike(r"[\p{L}\p{N}_@/=#.]$") | s["right"].rlike(r"^[\p{L}\p{N}_@/=]"), -1), (F.lit(True), 1)),
        "digits": _vote((d.rlike(r"([0-9])\1{5}|01234567|12345678|98765432"), -1), (n > 0, 1)),
    }


def shape_of(family: str, s: Column) -> Column:
    """The shape of a span, one of a few: the family of forms that it was found by (b: base, w: wide), its length and its separators in classes."""
    size, signs = F.length(s["word"]), F.length(F.regexp_replace(s["word"], "[A-Za-z0-9]", ""))
    size_class = F.when(size <= 9, "0").when(size <= 14, "1").when(size <= 19, "2").when(size <= 30, "3").otherwise("4")
    return F.concat(F.lit(family), size_class, F.least(signs, F.lit(5)).cast("string"))


def candidates(text: Column, has_digit: Column, kind: str) -> Column:
    """``plain``: matches of the base pattern; ``wide``: matches of further forms that touch none of those that are valid."""
    may_hold = _may_hold(text, has_digit)
    both = F.struct(found(text, BASE[kind], may_hold[kind, "b"]).alias("plain"), found(text, WIDE[kind], may_hold[kind, "w"]).alias("wide"))
    sound = lambda x: F.filter(x["plain"], lambda s: valid(kind, s["word"]))
    return let(both, lambda x: F.struct(x["plain"].alias("plain"), F.when(F.size(x["wide"]) == 0, x["wide"]).otherwise(let(sound(x), lambda sure: F.filter(
        x["wide"], lambda w: ~F.exists(sure, lambda b: (w["start"] < b["end"]) & (b["start"] < w["end"]))))).alias("wide")))


class SpanModel(NamedTuple):
    """``reliability``: (kind, labeler, vote, truth) -> probability of the vote; ``prior``: of each kind, in base and in further forms; ``weights``: of the classifier's features."""

    reliability: dict[tuple[str, str, int, int], float]
    prior: dict[tuple[str, str], float]
    weights: dict[tuple, float]


def pattern_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """kind, one column of votes per labeler, shape, and the number n of candidates in all texts."""
    rows, text = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), F.col("text")

    def told(kind: str, has_digit: Column) -> Column:
        def of(family: str, found_spans: Column) -> Column:
            return F.transform(found_spans, lambda s: F.struct(F.lit(kind).alias("kind"), *[v.alias(name) for name, v in votes(kind, s).items()], shape_of(family, s).alias("shape")))

        return let(candidates(text, has_digit, kind), lambda c: F.concat(of("b", c["plain"]), of("w", c["wide"])))

    return rows.select(F.explode(let(text.rlike(_DIGIT), lambda d: F.concat(*[told(kind, d) for kind in KINDS]))).alias("c")).select("c.*").groupBy("kind", *LABELERS, "shape").agg(F.count(F.lit(1)).alias("n"))


def truth(x: dict, reliability: dict, prior: dict) -> float:
    """Probability that candidates of a pattern are personal data. Labelers err independently of each other given the truth, as the model has it."""
    share = prior[x["kind"], x["shape"][0]]
    odds = math.log(share / (1 - share)) + sum(math.log(reliability[x["kind"], name, x[name], 1] / reliability[x["kind"], name, x[name], 0]) for name in LABELERS if x[name])
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def expectation_maximisation(patterns: list[dict]) -> tuple[dict, dict]:
    """Reliabilities and priors."""
    reliability = {(kind, name, v, y): PRIOR_RIGHT if v == (1 if y else -1) else 1 - PRIOR_RIGHT for kind in KINDS for name in LABELERS for v in (1, -1) for y in (0, 1)}
    start, prior = dict(reliability), {(kind, family): 0.5 for kind in KINDS for family in "bw"}
    for _ in range(ROUNDS):
        p = [truth(x, reliability, prior) for x in patterns]
        for kind in KINDS:
            own = [(x, q) for x, q in zip(patterns, p, strict=True) if x["kind"] == kind]
            for family in "bw":
                of_it = [(x["n"], q) for x, q in own if x["shape"][0] == family]
                prior[kind, family] = (sum(n * q for n, q in of_it) + PRIOR_VOTES / 2) / (sum(n for n, _ in of_it) + PRIOR_VOTES)
            for name in LABELERS:
                for y in (0, 1):
                    weight = {v: sum(x["n"] * (q if y else 1 - q) for x, q in own if x[name] == v) for v in (1, -1)}
                    for v in (1, -1):
                        reliability[kind, name, v, y] = (weight[v] + PRIOR_VOTES * start[kind, name, v, y]) / (weight[1] + weight[-1] + PRIOR_VOTES)
    return reliability, prior


def features(x: dict) -> list[tuple]:
    return [("family", x["kind"], x["shape"][0]), ("shape", x["kind"], x["shape"]), *[(x["kind"], name, x[name]) for name in LABELERS if x[name]]]


def train(patterns: list[dict], n: list[float], p: list[float]) -> dict[tuple, float]:
    """Logistic regression on soft labels ``p`` of weight ``n``, with weight decay; Newton's method."""
    names = sorted({f for x in patterns for f in features(x)}, key=repr)
    at = {f: i for i, f in enumerate(names)}
    m = np.zeros((len(patterns), len(names)))
    for i, x in enumerate(patterns):
        m[i, [at[f] for f in features(x)]] = 1.0
    n, y, w = np.array(n), np.array(p), np.zeros(len(names))
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        gradient = m.T @ (n * (y - q)) - RIDGE * w
        step = np.linalg.solve((m.T * (n * q * (1 - q))) @ m + RIDGE * np.eye(len(w)), gradient)
        w += step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if float(np.abs(step).max()) < 1e-9:
            break
    return dict(zip(names, w.tolist(), strict=True))


def fit(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """From all texts of ``docs``.

    Numbers of patterns weigh by their logarithm, so a common one does not
    drown a rare one. Where the corpus has few further forms or none, the
    classifier would know nothing of them; so it is also shown every pattern of
    votes on them once, at a small weight, with what the label model says.
    """
    patterns = [r.asDict() for r in pattern_counts(docs, text_col).orderBy("kind", *LABELERS, "shape").collect()]
    reliability, prior = expectation_maximisation(patterns)
    unseen = [{"kind": kind, "shape": "w", **dict(zip(LABELERS, told, strict=True))} for kind in KINDS for told in product((-1, 0, 1), repeat=len(LABELERS))]
    every = patterns + unseen
    return SpanModel(reliability, prior, train(every, [1 + math.log(x["n"]) for x in patterns] + [UNSEEN_WEIGHT] * len(unseen), [truth(x, reliability, prior) for x in every]))


def probability(model: SpanModel, kind: str, s: Column) -> Column:
    """What the classifier says on a candidate of a further form."""
    total = F.lit(model.weights.get(("family", kind, "w"), 0.0))
    for name, vote in votes(kind, s).items():
        total += F.element_at(F.array(*[F.lit(model.weights.get((kind, name, v), 0.0)) for v in (-1, 0, 1)]), vote + 2)
    known = {f[2]: w for f, w in model.weights.items() if f[:2] == ("shape", kind)}
    if known:
        table = F.create_map(*[F.lit(v) for pair in sorted(known.items()) for v in pair])
        total += F.coalesce(F.try_element_at(table, shape_of("w", s)), F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def spans(docs: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``more``: arrays of (kind, start, end), by kind as in KINDS and then by start.

    ``more`` holds the candidates that the classifier takes and that touch no base span.
    """
    for c in ("base", "more"):
        if c in docs.columns:
            raise ValueError(f"docs already has a column named {c}")
    text = F.coalesce(F.col(text_col), F.lit(""))

    def named(kind: str, found_spans: Column) -> Column:
        return F.transform(found_spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    def of(kind: str, has_digit: Column) -> Column:
        return let(candidates(text, has_digit, kind), lambda c: F.struct(
            named(kind, F.filter(c["plain"], lambda s: valid(kind, s["word"]))).alias("base"),
            named(kind, F.filter(c["wide"], lambda s: probability(model, kind, s) >= THRESHOLD)).alias("more")))

    kinds = let(text.rlike(_DIGIT), lambda d: F.struct(*[of(kind, d).alias(kind) for kind in KINDS]))
    both = let(kinds, lambda x: F.struct(*[F.concat(*[x[kind][part] for kind in KINDS]).alias(part) for part in ("base", "more")]))
    apart = let(both, lambda x: F.struct(x["base"].alias("base"), F.filter(
        x["more"], lambda t: ~F.exists(x["base"], lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"]))).alias("more")))
    # One row from one row: spans are computed once here, however often they are used above.
    return docs.select("*", F.explode(F.array(apart)).alias("_pii")).select(*docs.columns, "_pii.base", "_pii.more")


def _rendered(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_more of every row of ``docs``.

    Places count characters, ends are exclusive. A null text is empty and has no
    spans; rows that repeat an id, also a null one, are rows of their own; other
    columns are ignored. An empty table gives an empty result.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = spans(named, fit(named))

    def of(kind: str, column: str) -> Column:
        return F.filter(column, lambda s: s["kind"] == kind)

    every = F.flatten(F.array(*[F.array_sort(F.concat(of(kind, "base"), of(kind, "more"))) for kind in KINDS]))
    return out.select("doc_id", *[F.size(of(kind, "base")).cast("bigint").alias(f"n_{kind}") for kind in KINDS],
                      F.sha2(_rendered(F.col("base")), 256).alias("base_sha256"), _rendered(every).alias("spans"), F.size("more").cast("bigint").alias("n_more"))
