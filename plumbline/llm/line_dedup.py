"""Global removal of repeated passages by hashing pieces of lines and paragraphs.

Whole lines or sentences are no fit units: a passage often begins and ends
inside a line, where no line digest can be equal. So the units are pieces of
``k`` normalised words that begin where the text itself says: at the least
piece hash among ``w`` neighbours. Two texts that share ``w + k - 1`` words
share a unit, wherever in a line those words stand. Digests are grouped
globally, the earliest ranked occurrence stays, and the others are joined with
their neighbours to spans: each unit also carries a hash of all words up to the
next unit, so what lies between two units is compared too. The last words at a
span's ends are compared with those of the kept occurrence, one by one. Only
digests and the words at span ends move; offsets are those of the original text.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.llm.common import MAX_BROADCAST_KEYS, join_by_hot_key, keyed_by, materialize, tidy
from plumbline.llm.words import SMALL_BLOCK as BLOCK_BYTES
from plumbline.llm.words import Hasher, blocks, text_bytes

MIN_WORDS = 50
#: Words of a unit at most.
UNIT_WORDS = 16
LEFT, RIGHT = 1, 2
#: Texts that are folded at once.
ROWS_AT_ONCE = 1024


def unit_shape(min_words: int) -> tuple[int, int]:
    """(k, w) such that a run of ``min_words`` words always holds a common unit: w + k - 1 <= min_words."""
    k = max(1, min(UNIT_WORDS, (min_words + 2) // 3))
    return k, max(1, min_words - k + 1)


@lru_cache(maxsize=1)
def _inside() -> np.ndarray:
    out = np.zeros(256, bool)
    out[ord("a"):ord("z") + 1] = out[ord("0"):ord("9") + 1] = out[ord("A"):ord("Z") + 1] = True
    out[128:] = True
    return out


def folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes in the layout of the original, and offsets. A text whose layout changes in lower case is folded in A-Z only."""
    raw, at = text_bytes(column, lower=False)
    raw, at = raw[at[0]:at[-1]], at - at[0]
    low, low_at = text_bytes(column)
    low = low[low_at[0]:low_at[-1]]
    if (at == low_at - low_at[0]).all() and ((raw & 0xC0 == 0x80) == (low & 0xC0 == 0x80)).all():
        return low, at
    out = np.where((raw >= 65) & (raw <= 90), raw | 32, raw).astype(np.uint8)
    low_at = low_at - low_at[0]
    for i in np.flatnonzero(np.diff(at) == np.diff(low_at)):
        a, b = raw[at[i]:at[i + 1]], low[low_at[i]:low_at[i + 1]]
        if ((a & 0xC0 == 0x80) == (b & 0xC0 == 0x80)).all():
            out[at[i]:at[i + 1]] = b
    return out, at


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all words, and which bytes belong to words.

    Words are runs of ASCII letters, digits and other characters but for common
    Unicode punctuation. In scripts that put no spaces between words (Thai, Lao,
    Burmese, Khmer, kana, Han) each character is a word.
    """
    inside = _inside()[data]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, none, inside
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    lead = np.flatnonzero(data >= 0xC2)
    lead = lead[lead + 1 < len(data)]
    if len(lead):
        a, b = data[lead], data[lead + 1]
        size = np.where(a >= 0xF0, 4, np.where(a >= 0xE0, 3, 2))
        sign = ((a == 0xC2) & (b >= 0xA0)) | ((a == 0xE2) & (b <= 0x81)) | ((a == 0xE3) & (b == 0x80))
        for d in range(3):
            at = lead[sign & (size > d)] + d
            inside[at[at < len(data)]] = False
        own = (((a == 0xE0) & (b >= 0xB8) & (b <= 0xBB)) | ((a == 0xE1) & ((b <= 0x82) | (b == 0x9E) | (b == 0x9F)))
               | ((a == 0xE3) & ((b >= 0x90) | (b >= 0x81) & (b <= 0x83))) | ((a >= 0xE4) & (a <= 0xE9))
               | ((a == 0xEF) & (b >= 0xA4) & (b <= 0xAB)) | ((a == 0xF0) & (b >= 0xA0)))
        cut[lead[own]] = True
        cut[np.minimum(lead[own] + size[own], len(data))] = True
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (cut[:-1] | ~before))
    ends = np.flatnonzero(inside & (cut[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1, inside


def _slide(x: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """f over all windows of w values."""
    done = 1
    while 2 * done <= w:
        x, done = f(x[:-done], x[done:]), 2 * done
    return f(x[:len(x) - (w - done)], x[w - done:]) if done < w else x


def _chosen(data: np.ndarray, offsets: np.ndarray, k: int, w: int) -> tuple[np.ndarray, ...]:
    """Of all units: row, word place in this block, words to the next unit (0: none), hash up to it; then plain bytes, where each unit lies in them."""
    starts, ends, row, inside = bounds(data, offsets)
    n = len(starts)
    if n < w + k - 1:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), data[:0], none, none, starts
    plain = data[inside]                                 # words without what separates them
    stop = np.cumsum(ends - starts)
    begin = stop - (ends - starts)
    hasher = Hasher(plain)
    h = hasher(begin[:n - k + 1], stop[k - 1:])
    h = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
    least = _slide(h, w, np.minimum)
    least[row[:len(least)] != row[w + k - 2:]] = 0       # windows over the end of a text
    pad = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), w, np.maximum) == h)
    step = np.zeros(len(at), np.int64)
    step[:-1] = np.where(row[at[1:]] == row[at[:-1]], np.diff(at), 0)
    link = np.where(step > 0, hasher(begin[at], stop[np.minimum(at + step + k - 1, n - 1)]), np.uint64(0))
    first = np.searchsorted(row, np.arange(len(offsets)))
    return row[at], at - first[row[at]], step, link, plain, begin[at], stop[at + k - 1], starts


def _inner(row: np.ndarray, place: np.ndarray, step: np.ndarray, link: np.ndarray, digest: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Which units stay, and whether the equal units up to the next one that stays are left out, where a few words repeat over and over.

    There each repetition is a unit with equal words on both sides, so all of
    them are joined or none is, and as they touch, their spans are one span in
    both cases. Those within ``w`` words of the run's end stay: further ones
    can't reach beyond it. The first and last unit of a run are no inner ones.
    """
    n = len(row)
    inner = np.zeros(n, bool)
    if n > 2:
        alike = (row[1:] == row[:-1]) & (digest[1:] == digest[:-1]).all(1) & (step[:-1] <= k)
        inner[1:-1] = alike[:-1] & alike[1:] & (step[:-2] == step[1:-1]) & (link[:-2] == link[1:-1])
    stay, goes_on = np.ones(n, bool), np.zeros(n, bool)
    if inner.any():
        last = np.minimum.accumulate(np.where(inner, n, np.arange(n))[::-1])[::-1]
        stay[1:] = ~(inner[1:] & inner[:-1] & (place[last[1:]] - place[1:] >= w))
        goes_on[:-1] = stay[:-1] & ~stay[1:]
    return stay, goes_on


def _units_of(data: np.ndarray, offsets: np.ndarray, k: int, w: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of row, place, hashes of the words on both sides, digest (high, low) and goes_on of the units of a batch of texts, block by block.

    A text over one block is read in blocks that overlap by more than the words
    that decide on a unit and its neighbours, so the cuts leave no trace.
    """
    margin = 2 * (w + k)

    def emit(first: int, block: np.ndarray, at: np.ndarray, base: int = 0, own: int = 0, end: float = float("inf")):
        row, place, step, link, plain, begin, stop, _ = _chosen(block, at, k, w)
        back, half = np.zeros_like(link), np.uint64(32)
        back[1:] = link[:-1]                             # 0 at the first unit of a text
        beside = back >> half << half | link >> half
        place = place + base
        mine, raw = np.flatnonzero((place >= own) & (place < end)), plain.tobytes()
        digest = b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(begin[mine].tolist(), stop[mine].tolist(), strict=True))
        both = np.frombuffer(digest, ">i8").astype(np.int64).reshape(-1, 2)
        stay, goes_on = _inner(row[mine], place[mine], step[mine], link[mine], both, k, w)
        mine, both = mine[stay], both[stay]
        yield first + row[mine], place[mine], beside[mine].view(np.int64), both[:, 0], both[:, 1], goes_on[stay]

    row = 0
    while row < len(offsets) - 1:
        last = min(max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1), len(offsets) - 1)
        lo, hi = int(offsets[row]), int(offsets[last])
        if hi - lo <= BLOCK_BYTES:
            yield from emit(row, data[lo:hi], offsets[row:last + 1] - lo)
        else:
            base, own, size, table = 0, 0, BLOCK_BYTES, _inside()
            while True:
                to = min(hi, lo + size)
                while to < hi and table[data[to]]:
                    to += 1
                block, at = data[lo:to], np.array([0, to - lo])
                if to == hi:
                    yield from emit(row, block, at, base, own)
                    break
                starts = bounds(block, at)[0]
                end = base + len(starts) - margin
                if end <= own:                           # huge words: read on until enough of them are seen
                    size *= 2
                    continue
                yield from emit(row, block, at, base, own, end)
                skip = max(0, end - margin - base)
                lo, base, own, size = lo + int(starts[skip]), base + skip, end, BLOCK_BYTES
        row = last


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and row_key: the hash of both by which a row is known."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.withColumn("row_key", F.xxhash64("doc_id", "text"))


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, row_key, place (in words), beside, the 128-bit digest (high, low) and goes_on of every unit but inner ones of long runs.

    ``beside`` holds two 32-bit hashes, of all words back to the unit before and on to the next one; 0 without such a unit.
    ``goes_on``: units equal to this one, each touching the one before, are left out up to the next unit.
    """
    k, w = unit_shape(min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            portions = ((lo + row, *columns) for lo in range(0, len(texts), ROWS_AT_ONCE)
                        for row, *columns in _units_of(*folded(texts.slice(lo, ROWS_AT_ONCE)), k, w))
            for row, *columns in portions:
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(take), batch.column("row_key").take(take), *(pa.array(np.ascontiguousarray(c)) for c in columns)],
                    ["doc_id", "row_key", "place", "beside", "high", "low", "goes_on"])

    rows = _keyed(docs, id_col, text_col).filter(F.col("text").isNotNull())
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "row_key", "text").mapInArrow(
        tidy(run), f"doc_id {kind}, row_key bigint, place bigint, beside bigint, high bigint, low bigint, goes_on boolean")


class _Text:
    """Words of one text, by place."""

    def __init__(self, data: np.ndarray):
        self.data, starts, ends, done = data, [], [], 0
        for _, block, at in blocks(data, np.array([0, len(data)]), table=_inside()):
            a, b, _, _ = bounds(block, at)
            starts.append(a + done)
            ends.append(b + done)
            done += len(block)
        self.starts, self.ends = np.concatenate([*starts, np.zeros(0, np.int64)]), np.concatenate([*ends, np.zeros(0, np.int64)])
        self.chars: np.ndarray | None = None

    def word(self, i: int) -> int:
        return xxhash.xxh3_64_intdigest(self.data[self.starts[i]:self.ends[i]].tobytes()) - (1 << 63)

    def char(self, byte: int) -> int:
        """Characters before a byte."""
        if self.chars is None:
            self.chars = np.concatenate([np.zeros(1, np.int32), np.cumsum(self.data & 0xC0 != 0x80, dtype=np.int32)])
        return int(self.chars[byte])


def _spans(text: _Text, ends: list[dict], k: int, min_words: int) -> list[tuple[int, int, object, int | None]]:
    """(first word, word after the last, kept id, kept start) of the repeated spans of at least ``min_words`` words, from their ends.

    Ends come in turns, left and right; what lies between two of a pair is repeated.
    """
    runs: list[list] = []
    is_open, n = False, len(text.starts)
    for p in sorted(ends, key=lambda p: (p["place"], p["side"])):
        at, words, m = p["place"], p["words"], 0
        if p["side"] == LEFT:
            while m < len(words) and at - 1 - m >= 0 and text.word(at - 1 - m) == words[m]:
                m += 1
            runs.append([at - m, at + k, p["kept"], p["kept_starts"][m]])
            is_open = True
        else:
            while m < len(words) and at + k + m < n and text.word(at + k + m) == words[m]:
                m += 1
            if not is_open:                              # only if two short hashes were equal by chance
                runs.append([at, at + k, None, None])
            runs[-1][1] = at + k + m
            is_open = False
    out: list[list] = []
    for a, b, kept, kept_start in runs:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b, kept, kept_start])
    return [tuple(r) for r in out if r[1] - r[0] >= min_words]


_SIGNS = frozenset(string.punctuation)


def _cuts(column: pa.Array, i: int, ends: list[dict], k: int, min_words: int) -> list[tuple[int, int, int, object, int | None]]:
    """(start, length, words, kept id, kept start) of each span in characters; signs at a span's two ends belong to it."""
    raw, text, out, done = column[i].as_py(), _Text(folded(column.slice(i, 1))[0]), [], 0
    for a, b, kept, kept_start in _spans(text, ends, k, min_words):
        start, end = text.char(int(text.starts[a])), text.char(int(text.ends[b - 1]))
        while start > done and raw[start - 1] in _SIGNS:
            start -= 1
        while end < len(raw) and raw[end] in _SIGNS:
            end += 1
        out.append((start, end - start, b - a, kept, kept_start))
        done = end
    return out


def _ends(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """row_key and ``ends`` of every text that repeats an earlier ranked one: where its spans begin and end, and the words beside the kept occurrence."""
    k, w = unit_shape(min_words)
    every = materialize(units(docs, id_col, text_col, min_words))
    rank = F.struct("doc_id", "row_key", "place", "beside")
    groups = materialize(every.groupBy("high", "low").agg(
        F.min(rank).alias("first"), F.max(rank).alias("last"), F.count(F.lit(1)).alias("n_equal")
    ).filter(F.col("first") != F.col("last")).drop("last"))
    total = groups.agg(F.sum("n_equal")).first()[0] or 0

    def same(half: int) -> Column:
        """Whether the words on one side agree with those beside the kept occurrence; 0: there is no unit on that side."""
        own, kept = (F.shiftrightunsigned(c, half).bitwiseAND(0xFFFFFFFF) for c in ("beside", "first.beside"))
        return (own != 0) & (own == kept)

    found = join_by_hot_key(every, groups, ["high", "low"], "n_equal", total).filter(
        (F.col("row_key") != F.col("first.row_key")) | (F.col("place") != F.col("first.place")))
    # Equal rows have equal units, of which one is looked at; the window below needs no further shuffle.
    found = found.repartition("row_key").dropDuplicates(["row_key", "place"])
    # A span goes on from a unit to the next one if the words between them are those beside the kept occurrence of either, or units left out.
    in_text = Window.partitionBy("row_key").orderBy("place")
    linked = found.select("row_key", "place", "first", same(32).alias("to_left"), (F.col("goes_on") | same(0)).alias("to_right")).select(
        "row_key", "place", F.col("first.doc_id").alias("kept"), F.col("first.row_key").alias("kept_row"), F.col("first.place").alias("kept_place"),
        (F.col("to_left") | F.lag("to_right", 1, False).over(in_text)).alias("joined_left"),
        (F.col("to_right") | F.lead("to_left", 1, False).over(in_text)).alias("joined_right"))
    ends = materialize(linked.select("row_key", "place", "kept", "kept_row", "kept_place", F.explode(F.array_compact(F.array(
        F.when(~F.col("joined_left"), F.lit(LEFT)), F.when(~F.col("joined_right"), F.lit(RIGHT))))).alias("side")))
    on = ["kept_row", "kept_place", "side"]
    asked = ends.groupBy(*on).agg(F.count(F.lit(1)).alias("n_asked"))
    by_text = materialize(asked.groupBy(F.col("kept_row").alias("row_key")).agg(F.collect_list(F.struct("kept_place", "side", "n_asked")).alias("asked")))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for i, asked in enumerate(batch.column("asked").to_pylist()):
                text = _Text(folded(batch.column("text").slice(i, 1))[0])
                for x in asked:
                    p = x["kept_place"]
                    if x["side"] == LEFT:
                        words = range(p - 1, max(-1, p - 1 - w), -1)
                        starts = [text.char(int(text.starts[j])) for j in (p, *words)]
                    else:
                        words, starts = range(p + k, min(len(text.starts), p + k + w)), []
                    for col, v in zip(out, (i, p, x["side"], x["n_asked"], [text.word(j) for j in words], starts), strict=True):
                        col.append(v)
            take = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key").take(take), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
                 pa.array(out[3], pa.int64()), pa.array(out[4], pa.list_(pa.int64())), pa.array(out[5], pa.list_(pa.int64()))],
                [*on, "n_asked", "words", "kept_starts"])

    # Equal rows give equal answers; one of each is used.
    answers = materialize(keyed_by(_keyed(docs, id_col, text_col), by_text.select("row_key"), ["row_key"], "left_semi").join(by_text, "row_key").select("row_key", "text", "asked").mapInArrow(
        tidy(answer), "kept_row bigint, kept_place bigint, side int, n_asked bigint, words array<bigint>, kept_starts array<bigint>").dropDuplicates(on))
    n_ends = answers.agg(F.sum("n_asked")).first()[0] or 0
    return materialize(join_by_hot_key(ends, answers, on, "n_asked", n_ends).groupBy("row_key").agg(
        F.collect_set(F.struct("place", "side", "words", "kept_starts", "kept")).alias("ends")))


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per removed span: doc_id, row_key, unit (number of the span in its text), start, length, n_words, kept_doc_id, kept_start.

    A span is a run of at least ``min_words`` normalised words that an earlier
    ranked text, or an earlier place of the same text, holds too. Places are
    ranked by (doc_id, a hash of the row, place). ``start`` and ``length``
    count characters of the original text. Rows that repeat both id and text
    rank alike, so they are kept or cut alike; a null id ranks first. Null and
    empty texts, and those of fewer words, have no spans; other columns are
    ignored.
    """
    k, _ = unit_shape(min_words)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, u, *c) for i, ends in enumerate(batch.column("ends"))
                    for u, c in enumerate(_cuts(batch.column("text"), i, ends.as_py(), k, min_words))]
            row, unit, start, length, n_words, kept, kept_start = zip(*rows, strict=True) if rows else ((),) * 7
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("row_key").take(take), pa.array(unit, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(n_words, pa.int64()), pa.array(kept, batch.schema.field("doc_id").type), pa.array(kept_start, pa.int64())],
                ["doc_id", "row_key", "unit", "start", "length", "n_words", "kept_doc_id", "kept_start"])

    ends = _ends(docs, id_col, text_col, min_words)
    return keyed_by(_keyed(docs, id_col, text_col), ends.select("row_key"), ["row_key"], "left_semi").join(ends, "row_key").select(
        "doc_id", "row_key", "text", "ends").mapInArrow(
        tidy(run), f"doc_id {kind}, row_key bigint, unit int, start bigint, length bigint, n_words bigint, kept_doc_id {kind}, kept_start bigint")


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its spans; of the white space on a span's two sides the part before it stays, a line feed wins."""
    kept, at = [], 0
    for start, length in spans:
        kept.append(text[at:start])
        at = start + length
        before = text[start - 1] if start else "\n"
        if before.isspace() and at < len(text) and text[at].isspace():
            if text[at] == "\n" and before != "\n" and kept[-1]:
                kept[-1] = kept[-1][:-1]
            else:
                at += 1
    return "".join([*kept, text[at:]])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` with repeated spans cut from the text column and ``removed``: start and length of each in the original text.

    A text of which nothing is left becomes empty; no row is dropped here.
    """
    if "removed" in docs.columns:
        raise ValueError("docs already has a column named removed")
    names, (k, _) = docs.columns, unit_shape(min_words)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    where = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    keyed, ends = plain.withColumn("row_key", F.xxhash64(*where)), _ends(docs, id_col, text_col, min_words)
    if ends.count() <= MAX_BROADCAST_KEYS:               # texts without repeats need not be shuffled
        tagged = keyed.join(F.broadcast(ends.select("row_key", F.lit(True).alias("hit"))), "row_key", "left")
        none = F.lit(None).cast(ends.schema["ends"].dataType).alias("ends")
        joined = tagged.filter("hit").drop("hit").join(ends, "row_key").unionByName(tagged.filter("hit is null").drop("hit").withColumn("ends", none))
    else:
        joined = keyed.join(ends, "row_key", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(where[1])
            texts, column = batch.column(at), batch.column("ends")
            removed, changed = [None] * batch.num_rows, {}
            for i in np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False)).tolist():
                spans = [c[:2] for c in _cuts(texts, i, column[i].as_py(), k, min_words)]
                if spans:
                    removed[i] = [{"start": a, "length": b} for a, b in spans]
                    changed[i] = cut_text(texts[i].as_py(), spans)
            if changed:
                texts = pa.array([changed.get(i, t) for i, t in enumerate(texts.to_pylist())], texts.type)
            batch = batch.drop_columns(["ends"]).set_column(at, where[1], texts)
            yield batch.append_column("removed", pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))))

    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
    out = joined.select(*plain.columns, "ends").mapInArrow(tidy(cut), T.StructType([*plain.schema.fields, T.StructField("removed", spans)]))
    return out.toDF(*names, "removed")
