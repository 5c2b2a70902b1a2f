"""Toxicity from misspelling-tolerant lexicon hits and the context they stand in.

The lexicon is learned from labelled texts. Every distinct word of a block is
tested once: a length and letter-set filter that never loses a match, then a
Levenshtein automaton run over the lexicon's trie (both advance byte by byte;
a branch ends when no state is alive). A form that stands in clean texts is no
misspelling, and a term with near forms that a sample of clean texts cannot
list is matched as it stands. Each hit is scored by its window of words: quotation marks and words of
reporting lower it, address and further hits raise it. A logistic model over
the sums per text gives the score; its weights start from a prior, so that what
the labelled texts hold no case of (a quotation, say) still counts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, tidy
from plumbline.llm.words import Hasher, blocks, hash_bytes, text_bytes, word_bounds

#: Terms used whatever the labels say; fixed values.
SEED_TERMS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown")
#: Words by which others' speech is reported; fixed values.
REPORTING = frozenset("said says wrote writes quoted quote called term word phrase reported alleged sagte schrieb wort "
                      "zitat dit mot écrit cité dijo escribió palabra cita".split())
#: Words that address the reader; fixed values.
ADDRESS = frozenset("you your yourself you're du dich dein ihr tu toi vous votre tú usted ustedes eres".split())
QUOTES = re.compile("[\"“”„«»‘’]|(?<!\\w)'|'(?!\\w)")
FEATURES = ("abuse", "strongest", "fuzzy", "quoted", "density")
#: Weights before any label is seen: intercept, then FEATURES.
PRIOR = (-3.0, 2.0, 2.0, 1.0, -1.0, 1.0)
#: Odds (share of toxic texts with a term over that of clean ones) from which on a term has its full strength.
FULL_ODDS = 500.0
MEMO_WORDS = 400_000
WINDOW = 8


def allowed_edits(term: str) -> int:
    """Edits (of UTF-8 bytes) allowed for a term: none up to 4 bytes, 1 up to 11, then 2."""
    n = len(term.encode())
    return 0 if n <= 4 else 1 if n <= 11 else 2


def default_edits(terms: list[str]) -> list[int]:
    return [allowed_edits(t.removesuffix("*")) for t in terms]


class TermTrie:
    """Trie of terms, walked together with a word's Levenshtein automaton.

    A term that ends in ``*`` is a stem: it matches words that begin with it. ``edits``: what is allowed to each term.
    """

    def __init__(self, terms: list[str], edits: list[int] | None = None):
        self.root: dict = {"most": 0}
        for number, (term, edits) in enumerate(zip(terms, default_edits(terms) if edits is None else edits, strict=True)):
            node = self.root
            node["most"] = max(node["most"], edits)
            for byte in term.removesuffix("*").encode():
                node = node.setdefault(byte, {"most": 0})
                node["most"] = max(node["most"], edits)
            node["stem" if term.endswith("*") else "end"] = (number, edits)

    def match(self, word: bytes) -> tuple[int, int] | None:
        """(edits, term) of the nearest term within its allowed edits; ties go to the first term."""
        found = self.nearest(word)
        return found and found[:2]

    def nearest(self, word: bytes) -> tuple[int, int, int] | None:
        """The same and how many bytes of the word stand for the term: all, or for a stem the shortest nearest beginning.

        A state of the automaton holds the edit distances between the path in
        the trie and the prefixes of the word whose length differs from the
        path's by at most ``k``; a branch ends when all exceed what its terms
        allow.
        """
        k, n = self.root["most"], len(word)
        dead = k + 1
        best: tuple[int, int, int] | None = None
        stack = [(self.root, 0, [dead] * k + list(range(k + 1)))]    # node, depth, distance at prefix length depth + d - k
        while stack:
            node, depth, state = stack.pop()
            end = node.get("end")
            if end and -k <= n - depth <= k:
                edits = state[n - depth + k]
                if edits <= end[1] and (best is None or (edits, end[0]) < best[:2]):
                    best = (edits, end[0], n)
            stem = node.get("stem")
            if stem:
                edits, size = min((v, depth + d - k) for d, v in enumerate(state) if 0 <= depth + d - k <= n) if depth - k <= n else (dead, 0)
                if edits <= stem[1] and (best is None or (edits, stem[0]) < best[:2]):
                    best = (edits, stem[0], size)
            for byte, child in node.items():
                if isinstance(byte, str):
                    continue
                row, last = [], dead
                for d in range(2 * k + 1):
                    j = depth + 1 + d - k
                    if j < 0 or j > n:
                        last = dead
                    else:
                        v = state[d] + (word[j - 1] != byte) if j else depth + 1
                        if d < 2 * k and state[d + 1] + 1 < v:
                            v = state[d + 1] + 1
                        if last + 1 < v:
                            v = last + 1
                        last = v
                    row.append(last)
                if min(row) <= child["most"]:
                    stack.append((child, depth + 1, row))
        return best


def _word_table() -> np.ndarray:
    out = np.zeros(256, bool)
    out[ord("a"):ord("z") + 1] = out[ord("0"):ord("9") + 1] = True
    out[ord("@")] = True
    out[128:] = True
    return out


def _plain_bytes() -> np.ndarray:
    """Digits and signs that stand for letters, as those letters; fixed values."""
    out = np.arange(256, dtype=np.uint8)
    for sign, letter in {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}.items():
        out[ord(sign)] = ord(letter)
    return out


class _Term(NamedTuple):
    length: int
    mask: np.uint32                      # letters that occur, as bits
    edits: int
    parts: list[tuple[int, int, int]]    # start, length and hash of edits + 1 parts
    stem: bool


def _term(term: str, k: int) -> _Term:
    raw = term.removesuffix("*").encode()
    cuts = [len(raw) * i // (k + 1) for i in range(k + 2)]
    bits = np.uint32(1) << (np.frombuffer(raw, np.uint8) & 31).astype(np.uint32)
    parts = [(a, b - a, hash_bytes(raw[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
    return _Term(len(raw), np.bitwise_or.reduce(bits), k, parts, term.endswith("*"))


class _Matcher:
    """Term and edits of each distinct word, remembered between blocks. ``ordinary``: forms that count as no misspelling."""

    def __init__(self, terms: list[str], edits: list[int] | None = None, ordinary: Iterable[bytes] = ()):
        edits = default_edits(terms) if edits is None else edits
        self.trie = TermTrie(terms, edits)
        self.terms = [_term(t, k) for t, k in zip(terms, edits, strict=True) if k]
        self.ordinary = frozenset(ordinary)
        self.whole = self._numbered({n: t.encode() for n, t in enumerate(terms) if not t.endswith("*")})
        stems = {n: t[:-1].encode() for n, t in enumerate(terms) if t.endswith("*")}
        self.stems = {size: self._numbered({n: t for n, t in stems.items() if len(t) == size}) for size in {len(t) for t in stems.values()}}
        self.known, self.found = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    @staticmethod
    def _numbered(terms: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes and the number of each term."""
        hashes, numbers = np.array([hash_bytes(t) for t in terms.values()], np.uint64), np.array(list(terms), np.int32)
        order = np.argsort(hashes, kind="stable")
        return hashes[order], numbers[order]

    @staticmethod
    def _lookup(known: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` that hold a term, and its number."""
        if not len(known[0]):
            return np.zeros(0, np.int64), known[1]
        at = np.minimum(np.searchsorted(known[0], hashes), len(known[0]) - 1)
        hit = np.flatnonzero(known[0][at] == hashes)
        return hit, known[1][at[hit]]

    def _test(self, block: np.ndarray, hasher: Hasher, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """0, or 1 + 4 * term + edits.

        Words without edits are looked up. Another word goes to the automaton if its length and letters allow a match
        and one of the term's parts stands in it unchanged: with as many edits
        as are allowed, one of ``edits + 1`` parts is always left whole, the
        first at the start, the last at the end (not that of a stem), the
        others at most ``edits`` off.
        """
        out = np.zeros(len(start), np.int32)
        bits = np.append(np.uint32(1) << (block & 31).astype(np.uint32), np.uint32(0))
        order = np.argsort(start)
        pairs = np.stack([start[order], end[order]], 1).ravel()
        masks = np.empty(len(start), np.uint32)
        masks[order] = np.bitwise_or.reduceat(bits, pairs)[::2] if len(pairs) else 0
        by_length = np.argsort(end - start, kind="stable")
        start, end, masks = start[by_length], end[by_length], masks[by_length]
        length = end - start
        maybe = np.zeros(len(start), bool)
        for t in self.terms:
            lo, hi = np.searchsorted(length, [t.length - t.edits, t.length + t.edits + 1])
            if t.stem:                                   # what follows a stem is free
                hi = len(length)
                near = lo + np.flatnonzero(np.bitwise_count(t.mask & ~masks[lo:hi]) <= t.edits)
            else:
                near = lo + np.flatnonzero(np.bitwise_count(masks[lo:hi] ^ t.mask) <= 2 * t.edits)
            for i, (at, n, code) in enumerate(t.parts):
                if i == len(t.parts) - 1 and not t.stem:
                    begins = [end[near] - n]
                else:
                    begins = [start[near] + at + d for d in ((0,) if i == 0 else range(-t.edits, t.edits + 1))]
                for begin in begins:
                    fits = (begin >= start[near]) & (begin + n <= end[near])
                    maybe[near[fits]] |= hasher(begin[fits], begin[fits] + n) == np.uint64(code)
        found = np.zeros(len(start), np.int32)
        for n, stems in sorted(self.stems.items(), reverse=True):
            lo = np.searchsorted(length, n)
            hit, number = self._lookup(stems, hasher(start[lo:], start[lo:] + n))
            found[lo + hit] = np.where(found[lo + hit] > 0, np.minimum(found[lo + hit], 1 + 4 * number), 1 + 4 * number)
        hit, number = self._lookup(self.whole, hasher(start, end))
        found[hit] = np.where(found[hit] > 0, np.minimum(found[hit], 1 + 4 * number), 1 + 4 * number)
        maybe &= found == 0
        for i in np.flatnonzero(maybe):
            word = block[start[i]:end[i]].tobytes()
            match = self.trie.nearest(word)
            if match and word[:match[2]] not in self.ordinary:
                found[i] = 1 + 4 * match[1] + match[0]
        out[by_length] = found
        return out

    def __call__(self, hashes: np.ndarray, block: np.ndarray, hasher: Hasher, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """hashes: distinct and sorted."""
        where = np.searchsorted(self.known, hashes)
        new = np.flatnonzero(self.known[np.minimum(where, len(self.known) - 1)] != hashes) if len(self.known) else np.arange(len(hashes))
        if len(new):
            got = self._test(block, hasher, start[new], end[new])
            if len(self.known) + len(new) > MEMO_WORDS:
                kept = np.setdiff1d(np.arange(len(hashes)), new)
                self.found, self.known = np.concatenate([self.found[where[kept]], got]), np.concatenate([hashes[kept], hashes[new]])
            else:
                self.found, self.known = np.concatenate([self.found, got]), np.concatenate([self.known, hashes[new]])
            order = np.argsort(self.known)
            self.known, self.found = self.known[order], self.found[order]
        return self.found[np.searchsorted(self.known, hashes)]


def hit_score(before: str, after: str, edits: int, others: int) -> tuple[float, bool]:
    """Score of one hit in its context window, and whether it reads as quotation."""
    words = re.findall(r"\w[\w']*", f"{before} {after}")
    opened = len(QUOTES.findall(before)) % 2 == 1 and QUOTES.search(after) is not None
    quoted = opened or any(w in REPORTING for w in words)
    score = 1.0 if edits == 0 else 0.9
    if quoted:
        score *= 0.25
    if any(w in ADDRESS for w in words):
        score *= 1.25
    return score * (1 + 0.1 * min(others, 5)), quoted


def near_forms(texts: DataFrame, terms: list[str], text_col: str = "text") -> DataFrame:
    """term (its number), edits and form for every distinct form in every text that matches a term with edits.

    A form is the word, or for a stem the beginning of the word that stands for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, inside, plain = _Matcher(terms), _word_table(), _plain_bytes()
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            seen: set[tuple[int, int, int, bytes]] = set()
            for first, block, at in blocks(data, offsets):
                start, end, row = word_bounds(block, at, inside)
                if not len(start):
                    continue
                mapped = plain[block]
                hasher = Hasher(mapped)
                hashes, one, inverse = np.unique(hasher(start, end), return_index=True, return_inverse=True)
                found = matcher(hashes, mapped, hasher, start[one], end[one])
                forms = {}
                for i in np.flatnonzero((found > 0) & ((found - 1) % 4 > 0)):
                    word = mapped[start[one[i]]:end[one[i]]].tobytes()
                    edits, term, size = matcher.trie.nearest(word)
                    forms[int(i)] = (term, edits, word[:size])
                for i in np.flatnonzero(np.isin(inverse, list(forms))):
                    seen.add((first + int(row[i]), *forms[int(inverse[i])]))
            _, term, edits, form = zip(*sorted(seen), strict=True) if seen else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(edits, pa.int32()), pa.array(form, pa.binary())], ["term", "edits", "form"])

    return texts.select(F.col(text_col).alias("text")).mapInArrow(tidy(run), "term int, edits int, form binary")


def learn_edits(sample: DataFrame, terms: list[str], near_share: float = 0.002) -> tuple[list[int], list[bytes]]:
    """Edits allowed to each term, and the ordinary forms near the terms.

    ``sample``: a bounded sample of texts with ``label``. Forms that stand in
    clean texts are no misspellings, however common they are. What is left to
    fear is an ordinary form that the sample does not show: a further clean
    text holds one with a chance of about the number of forms that stand in one
    clean text only over the number of clean texts (Good and Turing's
    estimate). A term gets the most edits with which that chance is at most
    ``near_share``. Texts that are equal count once.
    """
    edits = default_edits(terms)
    clean = sample.filter("label = 0").select("text").distinct()
    size = clean.count()
    counts = near_forms(clean, terms).groupBy("term", "edits", "form").count().collect()      # forms of a bounded sample
    for number, most in enumerate(edits):
        own = [r for r in counts if r["term"] == number]
        while most and sum(r["count"] == 1 for r in own if r["edits"] <= most) > near_share * size:
            most -= 1
        edits[number] = most
    return edits, sorted({bytes(r["form"]) for r in counts if r["edits"] <= edits[r["term"]]})


def hit_features(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text", edits: list[int] | None = None,
                 ordinary: list[bytes] | None = None, strength: list[float] | None = None) -> DataFrame:
    """doc_id, n_hits and the columns of ``FEATURES`` for every input row; zeros for null and empty texts."""
    terms = list(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, inside, plain = _Matcher(terms, edits, ordinary or ()), _word_table(), _plain_bytes()
        for batch in batches:
            rows = batch.num_rows
            sums = np.zeros((rows, 6))
            data, offsets = text_bytes(batch.column("text"))
            for first, block, at in blocks(data, offsets):
                start, end, row = word_bounds(block, at, inside)
                if not len(start):
                    continue
                np.add.at(sums[:, 5], first + row, 1)
                mapped = plain[block]
                hasher = Hasher(mapped)
                hashes, one, inverse = np.unique(hasher(start, end), return_index=True, return_inverse=True)
                found = matcher(hashes, mapped, hasher, start[one], end[one])[inverse]
                hits = np.flatnonzero(found)
                near = np.searchsorted(hits, hits + WINDOW, "right") - np.searchsorted(hits, hits - WINDOW)
                for i, others in zip(hits, near - 1, strict=True):
                    r = row[i]
                    lo, hi = max(0, i - WINDOW), min(len(start) - 1, i + WINDOW)
                    left, right = max(int(start[lo]), int(at[r])), min(int(end[hi]), int(at[r + 1]))
                    near_by = int(found[i] - 1) % 4
                    score, quoted = hit_score(
                        block[max(left - 2, int(at[r])):start[i]].tobytes().decode(errors="replace"),
                        block[end[i]:min(right + 2, int(at[r + 1]))].tobytes().decode(errors="replace"), near_by, int(others))
                    score *= strength[int(found[i] - 1) // 4] if strength else 1.0
                    own = sums[first + r]
                    own[0] += score
                    own[1] = max(own[1], score)
                    own[2] += near_by > 0
                    own[3] += quoted
                    own[4] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sums[:, 4].astype(np.int64)), pa.array(np.log1p(sums[:, 0])), pa.array(sums[:, 1]),
                 pa.array(np.log1p(sums[:, 2])), pa.array(np.log1p(sums[:, 3])),
                 pa.array(np.minimum(1.0, 10 * sums[:, 0] / np.maximum(sums[:, 5], 1)))], ["doc_id", "n_hits", *FEATURES])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, n_hits bigint, " + ", ".join(f"{c} double" for c in FEATURES))


def sample_per_class(labels: DataFrame, label_col: str, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled ids of each class, chosen by a hash of the id."""
    order = [F.xxhash64(F.col("doc_id"), F.lit(17)), F.col("doc_id")]
    parts = [labels.filter(F.col(label_col) == v).orderBy(*order).limit(per_class) for v in (0, 1)]
    return parts[0].unionByName(parts[1])


def learn_lexicon(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", n_candidates: float = 1e5,
                  min_odds: float = 12.0, stem: tuple[int, int] = (5, 10)) -> dict[str, float]:
    """Words and stems far likelier in toxic texts, and the strength of each (up to 1, at odds of ``FULL_ODDS``); stems end in ``*``.

    ``labelled`` should be a bounded sample, which bounds the lexicon; copies
    count once. Every word votes with itself and with its beginnings of
    ``stem`` letters; a stem must begin several words, and stands for those
    that begin with it. A term must stand in so many toxic texts that chance
    would put none of ``n_candidates`` terms into them alone.
    """
    words = labelled.select(label_col, F.xxhash64(text_col).alias("text_key"), F.array_distinct(
        F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"[^\p{L}]+")).alias("words"))
    # Copies of a text would make all of its words look toxic: texts that agree in a MinHash value of their longer words count once.
    longer = F.filter("words", lambda w: F.length(w) >= 8)

    def least(seed: int) -> Column:
        return F.coalesce(F.array_min(F.transform(longer, lambda w: F.xxhash64(w, F.lit(seed)))), "text_key")

    words = words.withColumns({f"key{i}": least(i) for i in range(3)})
    for i in range(3):
        words = words.dropDuplicates([f"key{i}"])
    words = words.select(label_col, "words")
    words = materialize(words)
    size = {r[0]: r[1] for r in words.groupBy(label_col).count().collect()}
    if not size.get(0) or not size.get(1):
        return dict.fromkeys(sorted(SEED_TERMS), 1.0)
    stems = F.flatten(F.transform("words", lambda w: F.transform(
        F.sequence(F.lit(stem[0]), F.greatest(F.lit(stem[0]), F.least(F.length(w), F.lit(stem[1])))),
        lambda n: F.when(F.length(w) >= n, F.struct(F.concat(F.substr(w, F.lit(1), n), F.lit("*")).alias("term"), w.alias("word"))))))
    whole = F.transform(F.filter("words", lambda w: F.length(w) >= 4), lambda w: F.struct(w.alias("term"), w.alias("word")))
    by_text = words.select(label_col, F.monotonically_increasing_id().alias("text"), F.explode(F.array_compact(F.concat(whole, stems))).alias("t")).groupBy(
        label_col, "text", "t.term").agg(F.min("t.word").alias("least"), F.max("t.word").alias("most"))
    counted = by_text.groupBy("term").agg(
        F.sum(label_col).alias("bad"), F.sum(1 - F.col(label_col)).alias("good"), F.min("least").alias("least"), F.max("most").alias("most"))
    min_texts = max(3, math.ceil(math.log(n_candidates) / -math.log(size[1] / (size[0] + size[1]))))
    odds = ((F.col("bad") + 0.5) / size[1]) / ((F.col("good") + 0.5) / size[0])
    sure = counted.withColumn("odds", odds).filter((F.col("bad") >= min_texts) & (F.col("odds") >= min_odds))
    whole = {r["term"]: r["odds"] for r in sure.filter(~F.col("term").endswith("*")).collect()}
    begun = {r["term"][:-1]: r["odds"] for r in sure.filter(F.col("term").endswith("*") & (F.col("least") != F.col("most"))).collect()}
    shortest: set[str] = set()
    for t in sorted(begun, key=lambda t: (len(t), t)):
        if not any(t[:n] in shortest for n in range(stem[0], len(t))):
            shortest.add(t)
    left = {t for t in whole if not any(t[:n] in shortest for n in range(stem[0], len(t) + 1))}
    return ({t: _strength(whole.get(t, FULL_ODDS)) for t in sorted(left | set(SEED_TERMS))}
            | {f"{t}*": _strength(begun[t]) for t in sorted(shortest)})


def _strength(odds: float) -> float:
    return min(1.0, math.log(odds) / math.log(FULL_ODDS))


class ToxicityModel(NamedTuple):
    terms: list[str]
    weights: list[float]  # intercept, then FEATURES

    def score(self) -> Column:
        z = F.lit(self.weights[0])
        for w, c in zip(self.weights[1:], FEATURES, strict=True):
            z = z + F.lit(w) * F.col(c)
        return 1 / (1 + F.exp(-z))


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray | None = None, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Newton steps; intercept first. ``prior``: weights that hold where the rows say nothing (zeros if None)."""
    x = np.c_[np.ones(len(x)), x]
    prior = np.zeros(x.shape[1]) if prior is None else np.asarray(prior, float)
    w, penalty = prior.copy(), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(h, x.T @ (p - y) + penalty @ (w - prior)), -5, 5)
    return w


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
             per_class: int = 4000) -> DataFrame:
    """doc_id, n_hits, the features and ``score`` of every input row; equal texts score alike, also in rows that repeat.

    ``labels``: doc_id and 0/1 labels that may be learned from. Lexicon and
    weights are fitted on at most ``per_class`` labelled texts of each class;
    labels that contradict each other for one id count as their greatest. With
    no labels of one class the seed terms and the weights ``PRIOR`` are used. Null and
    empty texts get the score of a text without hits.
    """
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = F.broadcast(materialize(sample_per_class(known, "label", per_class)))  # at most 2 * per_class ids
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample = materialize(texts.join(chosen, "doc_id"))
    lexicon = learn_lexicon(sample, label_col="label")
    terms = list(lexicon)
    edits, ordinary = learn_edits(sample, terms)
    scored = materialize(hit_features(docs, terms, id_col, text_col, edits, ordinary, list(lexicon.values())))
    weights = [*PRIOR]
    # Rows that share an id count once, so there are at most 2 * per_class.
    rows = scored.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.max(F.struct(*FEATURES)).alias("f")).select("label", "f.*").toPandas()
    if rows["label"].nunique() == 2:
        rows = rows.sort_values(["label", *FEATURES])
        weights = [float(v) for v in fit_logistic(rows[list(FEATURES)].to_numpy(), rows["label"].to_numpy(), np.array(PRIOR))]
    return scored.withColumn("score", ToxicityModel(terms, weights).score())
