"""Near-duplicate join on word shingles: MinHash buckets, Bayesian pruning, exact verification.

Texts with equal shingles form one class, and only class representatives are
compared. Representatives that share a MinHash band meet in blocks of bounded
size; inside a block their MinHash values are compared a few at a time, and a
pair is dropped once the posterior probability that its similarity reaches the
threshold is below the tolerance. What is left is verified exactly from the
texts. A pair belongs to the first band in which it agrees, so it is counted
once; a block gives its link counts and a spanning forest instead of its pairs,
so rows stay linear in the size of a group however many links it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import join_by_hot_key, keyed_by, materialize, tidy
from plumbline.llm.words import SMALL_BLOCK, blocks, text_bytes, word_bounds, word_hashes

BANDS, ROWS, SHINGLE = 20, 4, 5
HASHES = BANDS * ROWS
#: Representatives of one bucket that are compared in one block.
BLOCK = 256
#: Hash values compared between two looks at the posterior.
STEP = 16


def _words_table() -> np.ndarray:
    out = np.zeros(256, bool)
    out[ord("a"):ord("z") + 1] = out[ord("0"):ord("9") + 1] = True
    out[128:] = True
    return out


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(41))
    return (rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of SHINGLE words and the row of each, in order of rows.

    A row of one to SHINGLE - 1 words has one shingle, of all its words.
    """
    start, end, row = word_bounds(data, offsets, _words_table())
    if not len(start):
        return np.zeros(0, np.uint64), row
    word, (weights, _) = word_hashes(data, start, end), _constants()
    n = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(n) - n
    size = np.minimum(SHINGLE, n[row])
    is_start = (np.arange(len(row)) - first[row]) <= n[row] - size
    at = np.flatnonzero(is_start)
    total = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        use = size[at] > j
        total += np.where(use, word[np.minimum(at + j, len(word) - 1)] * weights[j], np.uint64(0))
    return _mix(total + size[at].astype(np.uint64)), row[at]


def signatures(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, row_key, text_key. Adds digest (two longs), n_shingles and the MinHash values; drops the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, multiply = _constants()
        for batch in batches:
            rows = batch.num_rows
            least = np.full((rows, HASHES), 0xFFFFFFFF, np.uint32)
            one, two, count = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64), np.zeros(rows, np.int64)
            texts = batch.column("text")
            portions = ((lo + first, h, row) for lo in range(0, rows, 1024) for first, h, row in row_shingles(*text_bytes(texts.slice(lo, 1024))))
            for first, h, row in portions:
                begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                to = first + row[begins]
                for i in range(HASHES):
                    values = ((h * multiply[i]) >> np.uint64(32)).astype(np.uint32)
                    least[to, i] = np.minimum(least[to, i], np.minimum.reduceat(values, begins))
                one[to] += np.add.reduceat(h, begins)
                two[to] += np.add.reduceat(_mix(h + np.uint64(77)), begins)
                count[to] += np.diff(np.r_[begins, len(row)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), batch.column("text_key"), pa.array(one.view(np.int64)),
                 pa.array(two.view(np.int64)), pa.array(count), pa.array([x.tobytes() for x in least], pa.binary())],
                ["doc_id", "row_key", "text_key", "high", "low", "n_shingles", "minhash"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "row_key", "text_key", "text").mapInArrow(
        tidy(run), f"doc_id {kind}, row_key bigint, text_key bigint, high bigint, low bigint, n_shingles bigint, minhash binary")


def row_shingles(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shingles in pieces of bounded size. A text over the piece size stays whole, since its shingles cross any cut."""
    whole = np.diff(offsets)
    limit = max(SMALL_BLOCK, int(whole.max(initial=0)))
    for first, block, at in blocks(data, offsets, limit):
        h, row = shingles(block, at)
        if len(h):
            yield first, h, row


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For 16, 32, ... compared values: the fewest matches at which P(similarity >= threshold) is at least ``tolerance``.

    The prior is uniform, so after m matches of n the posterior is
    Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """
    def tail(m: int, n: int) -> float:
        return sum(comb(n + 1, j) * threshold**j * (1 - threshold)**(n + 1 - j) for j in range(m + 1))

    return {n: next(m for m in range(n + 1) if tail(m, n) >= tolerance) for n in range(STEP, HASHES + 1, STEP)}


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of a stream sorted by ``keys``: tables, and the bounds of the groups in each."""
    rest: pa.Table | None = None

    def bounds(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), t.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        b = bounds(t)
        rest = t.slice(b[-2])
        if len(b) > 2:
            yield t.slice(0, b[-2]).combine_chunks(), b[:-1]
    if rest is not None:
        yield rest.combine_chunks(), bounds(rest)


def _fixed(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _pairs(bounds: np.ndarray, side: np.ndarray, within: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Group, left and right row of all pairs to compare, in portions of bounded size.

    Within one block all pairs, between two blocks those across them.
    """
    size = np.diff(bounds)
    for s in np.unique(size[within & (size > 1)]):
        g = np.flatnonzero(within & (size == s))
        i, j = np.triu_indices(s, 1)
        step = max(1, 200_000 // len(i))
        for lo in range(0, len(g), step):
            part = g[lo:lo + step]
            base = bounds[part][:, None]
            yield np.repeat(part, len(i)), (base + i).ravel(), (base + j).ravel()
    for g in np.flatnonzero(~within):
        rows = np.arange(bounds[g], bounds[g + 1])
        left, right = rows[side[rows]], rows[~side[rows]]
        if len(left) and len(right):
            yield (np.full(len(left) * len(right), g), np.repeat(left, len(right)), np.tile(right, len(left)))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole blocks as rows of their members."""
    for batch in batches:
        lists = batch.column("members")
        of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        inner, take = lists.flatten(), pa.array(of)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(take) for c in ("key", "p", "q", "block", "band")), inner.field("rep"), inner.field("minhash")],
            ["key", "p", "q", "block", "band", "rep", "minhash"])


def pruned_candidates(pairs_of_blocks: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """key, p, q, block, band and the block's members (rep, minhash), sorted by key, p, q, block.

    One row per member that has a partner left in the other block (or in its
    own, where p is q): key, p, q, rep, partners.
    """
    need = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in _groups(_members(batches), ["key", "p", "q"]):
            sig = _fixed(t.column("minhash"), 4 * HASHES).view(np.uint32)
            rep, band = t.column("rep").to_numpy(), t.column("band").to_numpy()
            p, q, key = (t.column(c).to_numpy() for c in ("p", "q", "key"))
            found = []
            for g, i, j in _pairs(bounds, t.column("block").to_numpy() == p, (p == q)[bounds[:-1]]):
                matches = np.zeros(len(i), np.int64)
                for n in range(STEP, HASHES + 1, STEP):
                    matches += (sig[i, n - STEP:n] == sig[j, n - STEP:n]).sum(1)
                    good = matches >= need[n]
                    g, i, j, matches = g[good], i[good], j[good], matches[good]
                equal = (sig[i] == sig[j]).reshape(-1, BANDS, ROWS).all(2)
                good = equal.argmax(1) == band[i]
                found.append(np.stack([i[good], j[good]]))
            if not found:
                continue
            i, j = np.concatenate(found, 1)
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            rows = np.union1d(i, j)
            partners = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(i, rows), len(j)).astype(np.int32)), pa.array(rep[j]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[rows]), pa.array(p[rows]), pa.array(q[rows]), pa.array(rep[rows]), partners],
                ["key", "p", "q", "rep", "partners"])

    return pairs_of_blocks.mapInArrow(tidy(run), "key bigint, p int, q int, rep bigint, partners array<bigint>")


def _intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs of sets."""
    if len(i) <= 2:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = uses[column] > 1
    owner, column = owner[shared], (np.cumsum(uses > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        a, b = np.searchsorted(column, [lo, lo + 8192])
        m = np.zeros((len(sets), 8192), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        total += m @ m.T
    return total[i, j].astype(np.int64)


def verified_links(candidates: DataFrame, threshold: float) -> DataFrame:
    """candidates: key, p, q, rep, size, partners, text. rep, root, n_links: links to rows of other classes, and a tree edge.

    All pairs of a block with a similarity of at least ``threshold`` are
    counted; ``root`` is the least representative that links reach in the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in _groups(batches, ["key", "p", "q"]):
            rep, size = t.column("rep").to_numpy(), t.column("size").to_numpy()
            out: list[list] = [[], [], []]
            for a, b in zip(bounds, bounds[1:], strict=False):
                part = t.slice(a, b - a)
                data, offsets = text_bytes(part.column("text").combine_chunks())
                h, row = shingles(data, offsets)
                cuts = np.searchsorted(row, np.arange(b - a + 1))
                sets = [np.unique(h[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
                place = {r: n for n, r in enumerate(rep[a:b].tolist())}
                lists = part.column("partners").to_pylist()
                i = np.repeat(np.arange(b - a), [len(x) for x in lists])
                j = np.array([place[r] for x in lists for r in x], np.int64)
                if not len(i):
                    continue
                common = _intersections(sets, i, j)
                n = np.array([len(s) for s in sets])
                good = common >= threshold * (n[i] + n[j] - common) - 1e-9
                i, j = i[good], j[good]
                links = np.bincount(i, size[a + j], b - a) + np.bincount(j, size[a + i], b - a)
                root = rep[a:b].copy()
                while True:                                         # least root over the links of the block
                    new = root.copy()
                    np.minimum.at(new, i, root[j])
                    np.minimum.at(new, j, root[i])
                    if (new == root).all():
                        break
                    root = new
                hit = np.flatnonzero(links)
                out[0] += rep[a:b][hit].tolist()
                out[1] += root[hit].tolist()
                out[2] += links[hit].astype(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["rep", "root", "n_links"])

    return candidates.mapInArrow(tidy(run), "rep bigint, root bigint, n_links bigint")


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b. One row (node, component) per node of an edge; a component is named by its least node.

    Rounds of large-star and small-star steps, each an aggregation and a join,
    until the edges are stars around the least nodes. Nodes with very many edges
    are broadcast with their least neighbour, so no task holds all edges of one.
    """
    def contract(e: DataFrame, large: bool, most: int) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n_edges")).withColumn("m", F.least("a", "m"))
        told = join_by_hot_key(both, least, ["a"], "n_edges", most)
        if large:
            return told.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        own = least.select("a", F.col("m").alias("b"))
        return told.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).filter("a != b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    before = mark(now)
    while True:                                                 # each round shortens the longest chain, so this ends
        most = 2 * before[0]                                    # no step has more edges to look at
        now = materialize(contract(materialize(contract(now, True, most)), False, most))
        after = mark(now)
        if after == before:
            break
        before = after
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def near_duplicates(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-5, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links, row_key, text_key, is_first of every row.

    Similarity is the Jaccard index of the sets of five-word shingles (lower
    case, punctuation ignored). ``class_id``: least doc_id that a chain of
    links of at least ``threshold`` reaches. ``n_links``: other rows with at
    least that similarity, copies included. ``is_first``: the row that stands
    for its class. Rows without a word have no links and classes of their own.
    ``row_key`` and ``text_key`` identify the row by its id and text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text")).withColumn("row_key", F.xxhash64("doc_id", "text_key"))
    signed = materialize(signatures(rows).withColumn("uid", F.monotonically_increasing_id()))
    digest = ["high", "low", "n_shingles"]
    classes = materialize(signed.filter("n_shingles > 0").groupBy(*digest).agg(
        F.min("uid").alias("rep"), F.min(F.struct("doc_id", "row_key", "text_key")).alias("head"),
        F.count(F.lit(1)).alias("size"), F.first("minhash").alias("minhash")))

    # Buckets: only keys that at least two representatives share go on.
    banded = classes.select("rep", F.posexplode(F.array(*[
        F.xxhash64(F.lit(b), F.substring("minhash", 4 * ROWS * b + 1, 4 * ROWS)) for b in range(BANDS)])).alias("band", "key"))
    buckets = materialize(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n_bucket")).filter("n_bucket > 1"))
    total = buckets.agg(F.sum("n_bucket")).first()[0] or 0
    shared = join_by_hot_key(banded, buckets, ["key"], "n_bucket", total)
    n_blocks = F.ceil(F.col("n_bucket") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("rep", "key"), n_blocks).cast("int")
    # A block travels as one row to each block of its bucket, so rows do not grow with the square of a bucket.
    members = shared.select("key", "band", "rep", n_blocks.alias("n_blocks"), block.alias("block")).join(classes.select("rep", "minhash"), "rep")
    per_block = members.groupBy("key", "band", "n_blocks", "block").agg(F.collect_list(F.struct("rep", "minhash")).alias("members"))
    pairs = per_block.select("*", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")).select(
        "key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "band", "members")
    by_block = ["key", "p", "q"]
    pruned = materialize(pruned_candidates(
        pairs.repartition(*[F.col(c) for c in by_block]).sortWithinPartitions(*by_block, "block"), threshold, tolerance))

    # Exact verification from the texts of those that are left.
    wanted = materialize(pruned.select("rep").distinct().join(
        classes.select("rep", "size", F.col("head.row_key").alias("row_key"), F.col("head.text_key").alias("text_key")), "rep"))
    sought = keyed_by(rows, wanted.select("row_key", "text_key"), ["row_key", "text_key"], "left_semi")
    texts = sought.join(wanted, ["row_key", "text_key"]).groupBy("row_key", "text_key", "rep", "size").agg(F.first("text").alias("text"))
    links = materialize(verified_links(
        pruned.join(texts.select("rep", "size", "text"), "rep").repartition(*[F.col(c) for c in by_block])
        .sortWithinPartitions(*by_block, "rep"), threshold))

    components = connected_components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("rep").agg(F.sum("n_links").alias("n_far"))
    # Least head of every component, for single classes the class itself. Both steps are used twice below; a plan that held
    # all their copies would be planned anew and told to the driver's listeners after each of its many stages.
    told = materialize(classes.select("rep", "size", "head", *digest).join(components.withColumnRenamed("node", "rep"), "rep", "left").join(
        counts, "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    heads = told.groupBy("component").agg(F.min("head").alias("class_head"))
    told = materialize(told.join(heads, "component").select(*digest, "size", "class_head", F.coalesce("n_far", F.lit(0)).alias("n_far")))
    slim = signed.select("doc_id", "row_key", "text_key", *digest)
    known = join_by_hot_key(slim.filter("n_shingles > 0"), told, digest, "size", signed.count()).select(
        "doc_id", F.col("class_head.doc_id").alias("class_id"), (F.col("n_far") + F.col("size") - 1).alias("n_links"), "row_key", "text_key",
        (F.struct("doc_id", "row_key", "text_key") == F.col("class_head")).alias("is_first"))
    return known.unionByName(slim.filter("n_shingles = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), "row_key", "text_key", F.lit(True).alias("is_first")))


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stand for their class: one of each near-duplicate group, and all rows without a word."""
    near = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    names = docs.columns
    keyed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = F.coalesce(F.col(f"c{names.index(text_col)}"), F.lit(""))
    keyed = keyed.withColumn("text_key", F.xxhash64(text)).withColumn("row_key", F.xxhash64(F.col(f"c{names.index(id_col)}"), "text_key"))
    on = ["row_key", "text_key"]
    worded = text.rlike(r"[A-Za-z0-9]|[^\x00-\x7F]")
    rest = materialize(near.groupBy(*on).agg(F.max("is_first").alias("is_first"), F.count(F.lit(1)).alias("n")).filter("n > 1 or not is_first"))
    # Texts that stand alone for their class are never shuffled; of rows that repeat id and text one stays.
    alone = keyed_by(keyed.filter(worded), rest.select(*on), on, "left_anti")
    repeated = keyed_by(keyed.filter(worded), rest.filter("is_first").select(*on), on, "left_semi").dropDuplicates(on)
    return alone.unionByName(repeated).unionByName(keyed.filter(~worded)).drop(*on).toDF(*names)
