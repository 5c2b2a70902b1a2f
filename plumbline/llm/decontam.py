"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and items are normalised to lower-case words with single spaces. A
window of an item's length is looked at wherever the text holds one of the
item's ``k + 1`` disjoint pieces unchanged and most of its short runs: an
occurrence with at most ``k`` edits leaves one piece and so many runs whole, so
neither test loses one. Each window is
embedded by several CGK random walks, under which windows a few edits apart
agree in most places; bit-sampling tables of the embeddings are joined to those
of the items on Spark, and each candidate is verified by its exact edit
distance. Items are taken in blocks of bounded size against all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import MAX_BROADCAST_KEYS, materialize, tidy
from plumbline.llm.words import BLOCK_BYTES, blocks, text_bytes

#: Longer items are sought as consecutive passages of so many normalised bytes.
PASSAGE_BYTES = 1000
#: Passages of one block, on average; with PASSAGE_BYTES this bounds what travels to the tasks.
BLOCK_PASSAGES = 10_000
WALKS, TABLES_PER_WALK, SAMPLES = 4, 10, 4
#: Windows embedded at once, and candidates verified at once.
AT_ONCE, ABREAST = 8192, 2048
GRAM = 9
#: Length of the short runs that are counted before a window is embedded, and bits of their hashes.
SHORT, MEMBER_BITS = 4, 13


def _kept() -> np.ndarray:
    out = np.zeros(256, bool)
    out[ord("a"):ord("z") + 1] = out[ord("0"):ord("9") + 1] = True
    out[128:] = True
    return out


def _codes() -> np.ndarray:
    """Seven-bit codes: 0 for the space; bytes of other characters share codes, which only adds candidates."""
    out = np.zeros(256, np.uint64)
    out[ord("a"):ord("z") + 1] = np.arange(1, 27)
    out[ord("0"):ord("9") + 1] = np.arange(27, 37)
    out[128:] = 37 + np.arange(128) % 64
    return out


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, new offsets, and the old place of every byte."""
    keep = _kept()[data]
    take = keep.copy()
    if len(data):
        take[1:] |= keep[:-1]                       # the first separator after a word
        first = offsets[:-1][offsets[:-1] < len(data)]
        take[first] = keep[first]                   # none at the start of a text
    at = np.flatnonzero(take)
    return np.where(keep[at], data[at], np.uint8(32)), np.searchsorted(at, offsets), at


def plain_blocks(data: np.ndarray, offsets: np.ndarray, longest: int, slack: int, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int, int]]:
    """(first row, normalised bytes, offsets, normalised bytes of the text before them, first and end of the starts that are its own).

    A text over one block gives several that overlap by ``longest + 4 * slack``
    normalised bytes, so every window lies in one of them with ``slack`` bytes
    on both sides, and each start belongs to exactly one.
    """
    lead, before, own, read = np.zeros(0, np.uint8), 0, 0, 0
    for first, block, at in blocks(data, offsets, limit):
        total = int(offsets[first + len(at) - 1] - offsets[first])
        if len(block) == total:
            plain, bounds, _ = normalise(block, at)
            yield first, plain, bounds, 0, 0, len(plain) + 1
            continue
        begin, skip = int(offsets[first]) + read, int(read > 0)      # the byte before tells whether a separator counts
        plain = normalise(data[begin - skip:begin + len(block)], np.array([0, len(block) + skip]))[0]
        plain = np.concatenate([lead, plain[1:] if skip and _kept()[data[begin - 1]] else plain])
        read += len(block)
        end = len(plain) + 1 if read == total else max(own, len(plain) - longest - 2 * slack)
        yield first, plain, np.array([0, len(plain)]), before, own, end
        if read == total:
            lead, before, own, read = np.zeros(0, np.uint8), 0, 0, 0
        else:
            drop = max(0, end - 2 * slack)
            lead, before, own = plain[drop:], before + drop, end - drop


def normalised_bytes(text: str) -> bytes:
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    return normalise(data, np.array([0, len(data)]))[0].tobytes().strip()


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """All runs of ``q`` seven-bit codes as one number each (q up to 9), from runs of half the length."""
    if q == 1:
        return codes
    half = grams(codes, q // 2)
    n, h = len(codes) - q + 1, q // 2
    out = (half[:n] << np.uint64(7 * h)) | half[h:h + n]
    return (out << np.uint64(7)) | codes[q - 1:] if q % 2 else out


class Passage(NamedTuple):
    item_id: int
    part: int
    raw: bytes


def passages_of(item_id: int, text: str | None) -> list[Passage]:
    """An item's passages; none if its normalised text is empty."""
    raw = normalised_bytes(text or "")
    n = max(1, -(-len(raw) // PASSAGE_BYTES))
    cuts = [len(raw) * i // n for i in range(n + 1)]
    return [Passage(item_id, i, raw[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]


def allowed(size: int, rate: float, least_bytes: int) -> int:
    """Edits allowed to a passage of ``size`` bytes; none to short ones, whose near forms are other words."""
    return int(rate * size) if size >= least_bytes else 0


class Seeds:
    """The pieces of a block of passages, by gram length."""

    def __init__(self, raws: list[bytes], rate: float, least_bytes: int):
        self.edits = np.array([allowed(len(r), rate, least_bytes) for r in raws])
        self.length = np.array([len(r) for r in raws])
        by_q: dict[int, list[tuple[int, int, int]]] = {}
        codes = _codes()
        for number, (raw, k) in enumerate(zip(raws, self.edits, strict=True)):
            size = len(raw) // (k + 1)
            q = min(GRAM, size)
            own = codes[np.frombuffer(raw, np.uint8)]
            g = grams(own, q)
            by_q.setdefault(q, []).extend((int(g[j * size]), number, j * size) for j in range(k + 1))
        self.member = np.zeros((len(raws), 1 << MEMBER_BITS - 3), np.uint8)      # one bit for each hash
        for number, raw in enumerate(raws):
            if len(raw) >= SHORT:
                bits = np.zeros(1 << MEMBER_BITS, np.uint8)
                bits[self.short(codes[np.frombuffer(raw, np.uint8)])] = 1
                self.member[number] = np.packbits(bits, bitorder="little")
        self.tables = {}
        for q, rows in by_q.items():
            gram = np.array([r[0] for r in rows], np.uint64)
            order = np.argsort(gram, kind="stable")
            seen = np.zeros(1 << 22, bool)
            seen[self.slot(gram)] = True
            self.tables[q] = (gram[order], np.array([r[1] for r in rows])[order], np.array([r[2] for r in rows])[order], seen)

    @staticmethod
    def slot(gram: np.ndarray) -> np.ndarray:
        return (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)

    @staticmethod
    def short(codes: np.ndarray) -> np.ndarray:
        """Hashes of all runs of SHORT codes."""
        return (grams(codes, SHORT) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - MEMBER_BITS)

    def likely(self, short: np.ndarray, passage: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether [low, high) can hold the passage: each edit spoils at most SHORT of its short runs, so the others must be there."""
        least = self.length[passage] - SHORT + 1 - SHORT * self.edits[passage]
        out, order = np.zeros(len(passage), bool), np.argsort(high - low, kind="stable")
        for i in range(0, len(order), AT_ONCE // 16):
            part = order[i:i + AT_ONCE // 16]
            at = low[part, None] + np.arange(int((high - low)[part].max()))
            inside = at < (high[part] - SHORT + 1)[:, None]
            run = short[np.where(inside, at, 0)]
            hit = (self.member[passage[part, None], run >> 3] >> (run & 7).astype(np.uint8)) & inside
            out[part] = hit.sum(1) >= least[part]
        return out

    def windows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and passage length of every distinct window that a piece points to."""
        codes, found = _codes()[data], []
        short = self.short(codes).astype(np.uint16) if len(codes) >= SHORT else np.zeros(1, np.uint16)
        for q, (gram, number, shift, seen) in self.tables.items():
            if len(codes) < q:
                continue
            text = grams(codes, q)
            place = np.flatnonzero(seen[self.slot(text)])
            lo, hi = np.searchsorted(gram, text[place]), np.searchsorted(gram, text[place], "right")
            n = hi - lo
            place, which = np.repeat(place, n), np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row = np.searchsorted(offsets, place, "right") - 1
            p = number[which]
            start, size, k = place - shift[which], self.length[p], self.edits[p]
            good = (place + q <= offsets[row + 1]) & (start >= offsets[row] - k) & (start + size <= offsets[row + 1] + k)
            found.append(np.stack([row[good], start[good], p[good]], 1))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        row, start, p = np.concatenate(found).T
        k = self.edits[p]
        good = self.likely(short, p, np.maximum(start - k, offsets[row]), np.minimum(start + self.length[p] + k, offsets[row + 1]))
        stop = start + self.length[p]
        whole = (k > 0) | (((start == offsets[row]) | (data[start - 1] == 32)) & ((stop >= offsets[row + 1]) | (data[np.minimum(stop, len(data) - 1)] == 32)))
        good &= whole                                    # a passage without edits stands between word borders
        every = np.unique(np.stack([row, np.maximum(start, offsets[row]), self.length[p]], 1)[good], axis=0)
        return every[:, 0], every[:, 1], every[:, 2]


def _walk_bits(longest: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(23)).integers(0, 2, (WALKS, 2 * longest, 256), dtype=np.int64)


def _sample_places() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(29)).random((WALKS, TABLES_PER_WALK, SAMPLES))


def lsh_keys(data: np.ndarray, start: np.ndarray, size: np.ndarray, end: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """windows x tables: keys of the sampled places of each window's CGK embeddings.

    A walk reads one byte a step and moves on by 0 or 1, as a random bit for
    (step, byte) says; after twice the window's length it has mostly left it,
    and reads zeros from there on. The length is part of every key.
    """
    out = np.empty((len(start), WALKS * TABLES_PER_WALK), np.int64)
    places, padded = _sample_places(), np.append(data, np.uint8(0))
    for lo in range(0, len(start), AT_ONCE):
        s, n = start[lo:lo + AT_ONCE], size[lo:lo + AT_ONCE]
        stop = np.minimum(s + n, end[lo:lo + AT_ONCE])
        steps = 2 * int(n.max())
        for w in range(WALKS):
            at, read = s.copy(), np.empty((steps, len(s)), np.uint8)
            for j in range(steps):
                byte = padded[np.where(at < stop, at, len(data))]
                read[j] = byte
                at += bits[w, j][byte]
            step = (places[w][:, :, None] * (2 * n)).astype(np.int64)     # tables x samples x windows
            sampled = read[step, np.arange(len(s))].astype(np.int64)
            key = np.broadcast_to(n, sampled[:, 0].shape).astype(np.int64)
            for m in range(SAMPLES):
                key = key * 257 + sampled[:, m]
            out[lo:lo + AT_ONCE, w * TABLES_PER_WALK:(w + 1) * TABLES_PER_WALK] = key.T
    return out


def infix_distances(items: list[bytes], which: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(edits, end) for each text: least edit distance of ``items[which]`` to a substring of it, and where the first such one ends.

    Bit-parallel dynamic programming in words of 64 rows, many texts at once; a step per byte of text.
    """
    best, end = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    size = np.array([len(items[p]) for p in which], np.int64)
    length = np.array([len(t) for t in texts], np.int64)
    words = -(-size // 64)
    order = np.lexsort((length, words))
    for lo in range(0, len(order), ABREAST):
        part = order[lo:lo + ABREAST]
        for n_words in np.unique(words[part]):
            own = part[words[part] == n_words]
            best[own], end[own] = _infix_block(items, which[own], [texts[i] for i in own], size[own], length[own], int(n_words))
    return best, end


def _infix_block(items: list[bytes], which: np.ndarray, texts: list[bytes], size: np.ndarray, length: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    one, full, n = np.uint64(1), np.uint64((1 << 64) - 1), len(texts)
    used, item = np.unique(which, return_inverse=True)
    slot = np.zeros((len(used), 256), np.intp)           # which row of ``masks`` a byte has; 0: none of the item's
    rows = [np.zeros((1, n_words), np.uint64)]
    total = 1
    for d, p in enumerate(used):
        raw = np.frombuffer(items[p], np.uint8)
        letters, place = np.unique(raw, return_inverse=True)
        bits = np.zeros((len(letters), n_words * 64), np.uint8)
        bits[place, np.arange(len(raw))] = 1
        rows.append(np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(len(letters), n_words).astype(np.uint64))
        slot[d, letters] = total + np.arange(len(letters))
        total += len(letters)
    masks = np.ascontiguousarray(np.concatenate(rows).T)
    columns = np.zeros((int(length.max(initial=0)), n), np.uint8)
    for i, t in enumerate(texts):
        columns[:len(t), i] = np.frombuffer(t, np.uint8)
    top = ((size - 1) % 64).astype(np.uint64)
    up, down = np.full((n_words, n), full), np.zeros((n_words, n), np.uint64)
    score = size.copy()
    best, end = size.copy(), np.zeros(n, np.int64)
    for j in range(len(columns)):
        at = slot[item, columns[j]]
        more = less = np.zeros(n, np.uint64)             # whether the row above grows or shrinks from this byte to the next
        for w in range(n_words):
            eq, u, d = masks[w][at], up[w], down[w]
            reach = eq | d
            eq = eq | less
            diag = (((eq & u) + u) ^ u) | eq
            plus, minus = d | ~(diag | u), u & diag
            shift = top if w == n_words - 1 else np.uint64(63)
            grows, shrinks = (plus >> shift) & one, (minus >> shift) & one
            plus, minus = (plus << one) | more, (minus << one) | less
            up[w], down[w] = minus | ~(reach | plus), plus & reach
            more, less = grows, shrinks
        score += more.astype(np.int64) - less.astype(np.int64)
        better = (score < best) & (j < length)
        best[better], end[better] = score[better], j + 1
    return best, end


def infix_distance(item: bytes, text: bytes) -> tuple[int, int]:
    """The same for one text."""
    best, end = infix_distances([item], np.zeros(1, np.intp), [text])
    return int(best[0]), int(end[0])


def _occurrence(raw: bytes, region: bytes, bordered: bool) -> int:
    """Start of the first exact occurrence, or -1; ``bordered``: it must stand between word borders."""
    at = region.find(raw)
    while bordered and at >= 0 and not ((at == 0 or region[at - 1] == 32) and region[at + len(raw):at + len(raw) + 1] in (b"", b" ")):
        at = region.find(raw, at + 1)
    return at


def _block_leaks(docs: DataFrame, passages: list[Passage], rate: float, least_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    raws = [p.raw for p in passages]
    longest = max(map(len, raws))
    bits = _walk_bits(longest)
    joined = np.frombuffer(b"".join(raws), np.uint8)
    size = np.array([len(r) for r in raws])
    begin = np.cumsum(size) - size
    item_keys = lsh_keys(joined, begin, size, begin + size, bits)
    tables = [np.unique(item_keys[:, t]) for t in range(item_keys.shape[1])]

    def portions(texts: pa.Array, slack: int) -> Iterator[tuple]:
        for lo in range(0, len(texts), AT_ONCE // 8):
            data, offsets = text_bytes(texts.slice(lo, AT_ONCE // 8))
            for first, *rest in plain_blocks(data, offsets, longest, slack, AT_ONCE * 64) if len(data) else ():
                yield lo + first, *rest

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, slack = Seeds(raws, rate, least_bytes), max(1, *(allowed(len(r), rate, least_bytes) for r in raws))
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for first, plain, bounds, before, own, end in portions(batch.column("text"), slack):
                row, start, length = seeds.windows(plain, bounds)
                mine = (start >= own) & (start < end)
                row, start, length = row[mine], start[mine], length[mine]
                if not len(row):
                    continue
                keys = lsh_keys(plain, start, length, bounds[row + 1], bits)
                hit = np.stack([np.isin(keys[:, t], tables[t]) for t in range(len(tables))], 1)
                for i in np.flatnonzero(hit.any(1)):
                    lo = max(int(bounds[row[i]]), int(start[i]) - slack)
                    hi = min(int(bounds[row[i] + 1]), int(start[i] + length[i]) + slack)
                    t = np.flatnonzero(hit[i])
                    for col, v in zip(out, (first + row[i], before + lo - int(bounds[row[i]]), plain[lo:hi].tobytes(), t, keys[i, t]), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(out[0], pa.int64())) for c in ("doc_id", "text_key")), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()),
                 pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.list_(pa.int64()))],
                ["doc_id", "text_key", "place", "region", "tables", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text_key", "text").mapInArrow(
        tidy(windows), f"doc_id {kind}, text_key bigint, place bigint, region binary, tables array<int>, keys array<bigint>")
    row = ["doc_id", "text_key"]
    sampled = found.select(*row, "place", "region", F.explode(F.arrays_zip("tables", "keys")).alias("k")).select(
        *row, "place", "region", F.col("k.tables").alias("table"), F.col("k.keys").alias("key"))
    of_items = spark.createDataFrame(
        [(int(n), int(t), int(item_keys[n, t])) for n in range(len(passages)) for t in range(item_keys.shape[1])],
        "passage int, table int, key bigint")
    candidates = sampled.join(F.broadcast(of_items), ["table", "key"]).select(*row, "place", "passage", "region").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = np.array([allowed(len(r), rate, least_bytes) for r in raws], np.int64)
        back = [r[::-1] for r in raws]
        for batch in batches:
            which, place, regions = batch.column("passage").to_numpy(), batch.column("place").to_numpy(), batch.column("region").to_pylist()
            begin = np.array([_occurrence(raws[p], region, k[p] == 0) for p, region in zip(which, regions, strict=True)], np.int64)
            end, edits = begin + np.array([len(raws[p]) for p in which], np.int64), np.zeros(len(which), np.int64)
            near = np.flatnonzero((begin < 0) & (k[which] > 0))
            edits[near], end[near] = infix_distances(raws, which[near], [regions[i] for i in near])
            near = near[edits[near] <= k[which[near]]]
            begin[near] = end[near] - infix_distances(back, which[near], [regions[i][:end[i]][::-1] for i in near])[1]
            keep = np.flatnonzero(begin >= 0)
            take = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(take) for c in row), pa.array([passages[p].item_id for p in which[keep]], pa.int64()),
                 pa.array([passages[p].part for p in which[keep]], pa.int32()), pa.array(edits[keep], pa.int32()), pa.array((place + begin)[keep], pa.int64()),
                 pa.array((place + end)[keep], pa.int64())], [*row, "item_id", "part", "edits", "start", "end"])

    return candidates.mapInArrow(
        tidy(verify), f"doc_id {kind}, text_key bigint, item_id bigint, part int, edits int, start bigint, end bigint")


def _found(docs: DataFrame, benchmark: DataFrame, rate: float, least_bytes: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame | None:
    """doc_id, text_key (a hash of the text), item_id, part, edits, start and end of every verified window; None without items."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).withColumn("text_key", F.xxhash64("text"))
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("text")).dropna().distinct()
    total = items.agg(F.sum(F.ceil(F.octet_length("text") / PASSAGE_BYTES))).first()[0] or 0
    n_blocks = max(1, -(-int(total) // BLOCK_PASSAGES))
    found = None
    for b in range(n_blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).orderBy("item_id", "text").collect()
        passages = [p for r in block for p in passages_of(r["item_id"], r["text"])]
        if passages:
            part = _block_leaks(rows, passages, rate, least_bytes)
            found = part if found is None else found.unionByName(part)
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, least_bytes: int = 32, id_col: str = "doc_id",
          text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, edits, start, end: the closest occurrence of every benchmark item in every document that holds it.

    An item occurs where a substring of the normalised text is within
    ``rate`` edits per byte of it; ``start`` and ``end`` count normalised bytes
    of the text. An item of fewer than ``least_bytes`` bytes occurs only
    unchanged and between word borders; one longer than ``PASSAGE_BYTES`` occurs
    where one of its passages does. Null and empty texts or items match
    nothing; equal rows give one result, and of rows that share an id the
    closest occurrence counts.
    """
    found = _found(docs, benchmark, rate, least_bytes, id_col, text_col, item_col, item_text_col)
    if found is None:
        kind = docs.schema[id_col].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id bigint, edits int, start bigint, end bigint")
    return found.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "start", "end")).alias("best")).select(
        "doc_id", "item_id", "best.edits", "best.start", "best.end")


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, least_bytes: int = 32, id_col: str = "doc_id",
          text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose own text holds no benchmark item. Rows without an id or text stay."""
    found = _found(docs, benchmark, rate, least_bytes, id_col, text_col, item_col, item_text_col)
    if found is None:
        return docs
    leaked = materialize(found.select(F.col("doc_id").alias("_leaked"), F.col("text_key").alias("_leaked_text")).distinct())
    if leaked.count() <= MAX_BROADCAST_KEYS:
        leaked = F.broadcast(leaked)
    return docs.join(leaked, (docs[id_col] == leaked["_leaked"]) & (F.xxhash64(docs[text_col]) == leaked["_leaked_text"]), "left_anti")
