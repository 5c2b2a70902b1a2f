"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a word is the sum over all its segmentations into pieces,
computed by the forward algorithm; a text is scored by the product over its
words. Piece probabilities come from one expectation step over all labelled
texts: forward-backward spreads each word over the pieces of all its
segmentations under a rank-based prior, and Spark sums these counts by
(language, piece), so only a table of languages x vocabulary reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import tidy
from plumbline.llm.words import Hasher, blocks, hash_bytes, text_bytes, word_bounds

#: Longer words are summed one by one in logarithms, since their probabilities may leave double range; the sum is the same.
PLAIN_BYTES = 32
#: Places of a long word whose pieces are looked up at once.
AT_ONCE = 1 << 16
#: Words whose scores a task remembers; beyond that it starts afresh (this changes time, not results).
MEMO_WORDS = 300_000


def load_pieces(path: str) -> list[bytes]:
    """Distinct lower-case letter pieces of a sentencepiece vocabulary, in order of rank, then all single bytes.

    The mark of a word's start is dropped: words are split beforehand. Single
    bytes stand for byte fallback, so every word has a segmentation.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, None] = {}
    for i in range(model.vocab_size()):
        if model.is_unknown(i) or model.is_control(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", "").lower()
        raw = piece.encode()
        if piece and all(c.isalpha() for c in piece):
            found.setdefault(raw)
    for b in range(256):
        found.setdefault(bytes([b]))
    return list(found)


class PieceTable:
    """Piece number of a substring hash, by two direct-address tables."""

    def __init__(self, pieces: list[bytes]):
        hashes = np.array([hash_bytes(p) for p in pieces], np.uint64)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.bits = np.uint64(64 - 22)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(hashes * np.uint64(0xD6E8FEB86659FD93)) >> self.bits] = True
        self.sizes = sorted({len(p) for p in pieces})

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """-1 where there is no such piece."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.seen[(hashes * np.uint64(0xD6E8FEB86659FD93)) >> self.bits])
        at = np.minimum(np.searchsorted(self.sorted, hashes[maybe]), len(self.sorted) - 1)
        good = self.sorted[at] == hashes[maybe]
        out[maybe[good]] = self.order[at[good]]
        return out


class _Lattice:
    """Pieces at every place of a set of words: lists of (start, end, word, piece) sorted by end."""

    def __init__(self, table: PieceTable, hasher: Hasher, start: np.ndarray, length: np.ndarray):
        self.n, self.longest = len(start), int(length.max(initial=0))
        self.edges: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(self.longest + 1)]
        for end in range(1, self.longest + 1):
            alive = np.flatnonzero(length >= end)
            for begin in (end - size for size in table.sizes if size <= end):
                piece = table(hasher(start[alive] + begin, start[alive] + end))
                hit = piece >= 0
                if hit.any():
                    self.edges[end].append((begin, alive[hit], piece[hit]))

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """prob: pieces x languages -> words x places x languages."""
        a = np.zeros((self.n, self.longest + 1, prob.shape[1]))
        a[:, 0] = 1
        for end in range(1, self.longest + 1):
            for begin, words, piece in self.edges[end]:
                a[words, end] += a[words, begin] * prob[piece]
        return a

    def counts(self, prob: np.ndarray, length: np.ndarray, weight: np.ndarray, n_pieces: int) -> np.ndarray:
        """Expected piece counts under one prior, times each word's weights (words x languages)."""
        a = self.forward(prob[:, None])[:, :, 0]
        b = np.zeros((self.n, self.longest + 1))
        total = a[np.arange(self.n), length]
        b[np.arange(self.n), length] = 1
        out = np.zeros((n_pieces, weight.shape[1]))
        for end in range(self.longest, 0, -1):
            for begin, words, piece in self.edges[end]:
                use = prob[piece] * b[words, end]
                b[words, begin] += use
                share = a[words, begin] * use / total[words]
                for k in range(weight.shape[1]):
                    out[:, k] += np.bincount(piece, share * weight[words, k], n_pieces)
        return out


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(0)
    return top + np.log(np.exp(x - top).sum(0))


class _LongWord:
    """The same sums for one long word, in logarithms; pieces are looked up stretch by stretch."""

    def __init__(self, table: PieceTable, hasher: Hasher, start: int, length: int):
        self.table, self.hasher, self.start, self.length = table, hasher, start, length

    def _edges(self, lo: int, hi: int, by_end: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and piece of all edges that end (or begin) in [lo, hi), sorted by it, and where each place's edges lie."""
        parts = []
        for size in self.table.sizes:
            place = np.arange(max(lo, size), hi) - size if by_end else np.arange(lo, min(hi, self.length - size + 1))
            if len(place):
                piece = self.table(self.hasher(self.start + place, self.start + place + size))
                hit = np.flatnonzero(piece >= 0)
                parts.append((place[hit], place[hit] + size, piece[hit]))
        begin, end, piece = (np.concatenate(x) for x in zip(*parts, strict=True))
        key = end if by_end else begin
        order = np.argsort(key, kind="stable")
        return begin[order], end[order], piece[order], np.searchsorted(key[order], np.arange(lo, hi + 1))

    def forward(self, log_prob: np.ndarray) -> np.ndarray:
        """log_prob: pieces x languages -> places x languages."""
        a = np.zeros((self.length + 1, log_prob.shape[1]))
        for lo in range(1, self.length + 1, AT_ONCE):
            hi = min(lo + AT_ONCE, self.length + 1)
            begin, _, piece, at = self._edges(lo, hi, by_end=True)
            for i in range(hi - lo):
                own = slice(at[i], at[i + 1])
                a[lo + i] = _log_sum(a[begin[own]] + log_prob[piece[own]])
        return a

    def counts(self, log_prob: np.ndarray, n_pieces: int) -> np.ndarray:
        """Expected count of every piece under one prior."""
        a, b, out = self.forward(log_prob[:, None])[:, 0], np.zeros(self.length + 1), np.zeros(n_pieces)
        for hi in range(self.length, 0, -AT_ONCE):
            lo = max(0, hi - AT_ONCE)
            begin, end, piece, at = self._edges(lo, hi, by_end=False)
            for i in range(hi - lo - 1, -1, -1):
                own = slice(at[i], at[i + 1])
                use = log_prob[piece[own]] + b[end[own]]
                b[lo + i] = _log_sum(use)
                np.add.at(out, piece[own], np.exp(a[begin[own]] + use - a[self.length]))
        return out


def log_probabilities(table: PieceTable, hasher: Hasher, start: np.ndarray, length: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """words x languages: logarithm of each word's probability, summed over all its segmentations."""
    out = np.empty((len(start), prob.shape[1]))
    plain = np.flatnonzero(length <= PLAIN_BYTES)
    a = _Lattice(table, hasher, start[plain], length[plain]).forward(prob)
    out[plain] = np.log(a[np.arange(len(plain)), length[plain]])
    for i in np.flatnonzero(length > PLAIN_BYTES):
        out[i] = _LongWord(table, hasher, int(start[i]), int(length[i])).forward(np.log(prob))[-1]
    return out


def _prior(pieces: list[bytes]) -> np.ndarray:
    rank = np.arange(len(pieces), dtype=float)
    p = 1 / (rank + 100)
    return p / p.sum()


class LanguageModel(NamedTuple):
    langs: list[str]
    pieces: list[bytes]
    prob: np.ndarray  # pieces x languages


def fit(labelled: DataFrame, vocab_path: str, text_col: str = "text", lang_col: str = "lang",
        smoothing: float = 0.5) -> LanguageModel:
    """Piece probabilities per language from all rows of ``labelled`` with a language.

    Rows without text add nothing. With no labelled row the model has no languages.
    """
    pieces = load_pieces(vocab_path)
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())
    n = len(langs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, prior = PieceTable(pieces), _prior(pieces)
        number = {lang: i for i, lang in enumerate(langs)}
        sums = np.zeros((len(pieces), n))
        for batch in batches:
            of_row = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            data, offsets = text_bytes(batch.column("text"))
            for first, block, at in blocks(data, offsets):
                start, end, row = word_bounds(block, at)
                if not len(start):
                    continue
                hasher, length = Hasher(block), end - start
                _, one, inverse = np.unique(hasher(start, end), return_index=True, return_inverse=True)
                weight = np.bincount(inverse * n + of_row[first + row], minlength=len(one) * n).reshape(-1, n).astype(float)
                plain = length[one] <= PLAIN_BYTES
                sums += _Lattice(table, hasher, start[one[plain]], length[one[plain]]).counts(
                    prior, length[one[plain]], weight[plain], len(pieces))
                for i in np.flatnonzero(~plain):
                    sums += np.outer(_LongWord(table, hasher, start[one[i]], length[one[i]]).counts(np.log(prior), len(pieces)), weight[i])
        piece, lang = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.int32()), pa.array(piece, pa.int32()), pa.array(sums[piece, lang])], ["lang", "piece", "n"])

    if not n:
        return LanguageModel([], pieces, np.zeros((len(pieces), 0)))
    summed = rows.mapInArrow(tidy(count), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    got = summed.toPandas()  # at most languages x vocabulary
    counts = np.full((len(pieces), n), smoothing)
    counts[got["piece"], got["lang"]] += got["n"]
    return LanguageModel(langs, pieces, counts / counts.sum(0))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: the language of highest likelihood and its posterior under equal priors.

    ``und`` with score 0 for null texts, texts without a letter, and models
    without languages. Ties go to the language that sorts first. Every input
    row gives one row.
    """
    langs, pieces, prob = model

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = PieceTable(pieces), len(langs)
        known, logs = np.zeros(0, np.uint64), np.zeros((0, n))
        for batch in batches:
            rows = batch.num_rows
            total, words = np.zeros((rows, n)), np.zeros(rows, np.int64)
            data, offsets = text_bytes(batch.column("text"))
            for first, block, at in blocks(data, offsets) if n else ():
                start, end, row = word_bounds(block, at)
                if not len(start):
                    continue
                hasher, length = Hasher(block), end - start
                hashes, one, inverse = np.unique(hasher(start, end), return_index=True, return_inverse=True)
                where = np.searchsorted(known, hashes)
                new = np.flatnonzero(known[np.minimum(where, len(known) - 1)] != hashes) if len(known) else np.arange(len(hashes))
                if len(new):
                    found = log_probabilities(table, hasher, start[one[new]], length[one[new]], prob)
                    if len(known) + len(new) > MEMO_WORDS:
                        kept = np.setdiff1d(np.arange(len(hashes)), new)
                        logs, known = np.concatenate([logs[where[kept]], found]), np.concatenate([hashes[kept], hashes[new]])
                    else:
                        logs, known = np.concatenate([logs, found]), np.concatenate([known, hashes[new]])
                    order = np.argsort(known)
                    known, logs = known[order], logs[order]
                value = logs[np.searchsorted(known, hashes)][inverse]
                begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                total[first + row[begins]] += np.add.reduceat(value, begins)
                words += np.bincount(first + row, minlength=rows)
            best = total.argmax(1) if n else np.zeros(rows, np.int64)
            share = np.exp(total - total.max(1, keepdims=True)) if n else np.zeros((rows, 1))
            letters = np.array([any(map(str.isalpha, t)) if t else False for t in batch.column("text").to_pylist()]) if rows else np.zeros(0, bool)
            sure = (words > 0) & letters
            posterior = np.where(sure, 1 / np.maximum(share.sum(1), 1), 0.0)
            pred = [langs[b] if s else "und" for b, s in zip(best, sure, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(posterior)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(score), f"doc_id {kind}, lang_pred string, score double")
