"""Prefix trie of conversations, packed as double arrays in prefix shards.

Texts are read once and become 128-bit digests and word counts; only those move.
Each prefix has a key of its own, the exclusive or of hashes of (place, turn),
which running totals give without looking at whole conversations. Equal
conversations are one path with a weight. Paths are dealt to shards by the
shortest prefix, of one, two, four, ... turns, that few enough turns hang from:
all below such a prefix is one task's double array (BASE and CHECK over turn ids
that are dense in the shard), and its nodes come from walking the paths through
the arrays. Nodes above those prefixes are shared by shards; their numbers are
merged globally by prefix key, and sums over their subtrees by giving each shared
node to one path that goes through it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import MAX_BROADCAST_KEYS, join_by_hot_key, materialize

#: Turns below one prefix at most that one shard takes, and turns of a shard on average.
SHARD_TURNS = 16_384
#: A conversation of more turns is put in order and keyed in blocks of so many turns or turn numbers.
LONG_TURNS = 65_536
#: Conversation ids of one segment of a list of members.
SEGMENT_IDS = 256
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "k1", "k2"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _small(rows: DataFrame) -> DataFrame:
    """Marked for a broadcast if there are few of them; ``rows`` should be materialised."""
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST_KEYS else rows


def _cumulated(rows: DataFrame, order: list[Column], totals: dict[str, tuple[Column, str]], descending: bool = False) -> DataFrame:
    """``rows`` (conv_id, is_long, block) with running totals inside each conversation. ``totals``: name -> (value, sum or xor).

    Only rows of one block are sorted together; what the blocks before a block
    of a long conversation hold is added afterwards.
    """
    of = {"sum": F.sum, "xor": F.bit_xor}
    window = Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumns({name: of[kind](value).over(window) for name, (value, kind) in totals.items()})
    blocks = rows.filter("is_long").groupBy("conv_id", "block").agg(*[of[kind](value).alias(f"_{name}") for name, (value, kind) in totals.items()])
    before = Window.partitionBy("conv_id").orderBy(F.col("block").desc() if descending else F.col("block")).rowsBetween(Window.unboundedPreceding, -1)
    shifts = blocks.select("conv_id", "block", *[F.coalesce(of[kind](f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name, (_, kind) in totals.items()])
    moved = inside.filter("is_long").join(shifts, ["conv_id", "block"])
    moved = moved.withColumns({name: F.col(name) + F.col(f"_{name}") if kind == "sum" else F.col(name).bitwiseXOR(F.col(f"_{name}")) for name, (_, kind) in totals.items()})
    return inside.filter("not is_long").unionByName(moved.select(inside.columns))


def _with_blocks(rows: DataFrame, long: DataFrame, place: Column) -> DataFrame:
    marked = rows.join(_small(long).withColumn("is_long", F.lit(True)), "conv_id", "left").withColumn("is_long", F.coalesce("is_long", F.lit(False)))
    return marked.withColumn("block", F.when(F.col("is_long"), F.coalesce(F.floor(place / LONG_TURNS), F.lit(-(1 << 62)))).otherwise(F.lit(0)).cast("bigint"))


def ordered_turns(talks: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, place (from 0), d1, d2 (digest of role and text) and words of every turn.

    Turns are ordered by number, null first; equal numbers by role and then by
    the digest, so repeated rows are repeated turns and the order does not
    depend on partitions. Null roles and texts are empty; rows without a
    conversation are left out.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(talks.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.xxhash64(role).alias("r"),
        F.xxhash64(F.lit(1), role, text).alias("d1"), F.xxhash64(F.lit(2), role, text).alias("d2"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words")))
    long = materialize(rows.groupBy("conv_id").count().filter(F.col("count") > LONG_TURNS).select("conv_id"))
    order = [F.col("turn").asc_nulls_first(), *map(F.col, ("r", "d1", "d2"))]
    return _cumulated(_with_blocks(rows, long, F.col("turn")), order, {"place": (F.lit(1).cast("bigint"), "sum")}).select(
        "conv_id", (F.col("place") - 1).alias("place"), "d1", "d2", "words")


def members_of(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns."""
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))


def with_lent_prefixes(turns: DataFrame, every: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Turns and members where conversation c begins with turns of conversation c - c % ``every`` instead of its own.

    They are the first h of that one (all if it has fewer, none if it does not
    exist), and c's own turns after its first h follow; h is crc32 of c in
    decimal, modulo ``most`` + 1. A conversation may lose all its turns.
    """
    lenders = turns.filter((F.col("conv_id") % every == 0) & (F.col("place") < most)).groupBy(F.col("conv_id").alias("lender")).agg(
        F.array_sort(F.collect_list(F.struct("place", "d1", "d2", "words"))).alias("head"))     # ``most`` turns at most
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    empty = F.array().cast(lenders.schema["head"].dataType)
    plan = members_of(turns).withColumns({"h": h, "lender": F.col("conv_id") - F.col("conv_id") % every}).join(lenders, "lender", "left").select(
        "conv_id", "n_turns", "h", F.slice(F.coalesce("head", empty), F.lit(1), F.col("h")).alias("head"))
    plan = materialize(plan)
    own = turns.join(plan.select("conv_id", "h", F.size("head").alias("lent")), "conv_id").filter(F.col("place") >= F.col("h")).select(
        "conv_id", (F.col("place") - F.col("h") + F.col("lent")).alias("place"), "d1", "d2", "words")
    lent = plan.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    members = plan.select("conv_id", (F.size("head") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))).cast("bigint").alias("n_turns"))
    return own.unionByName(lent), members


def _keyed(turns: DataFrame, members: DataFrame) -> DataFrame:
    """The turns with depth (from 1), x1, x2 (hashes of place and turn) and k1, k2, the key of the prefix that ends there."""
    long = materialize(members.filter(F.col("n_turns") > LONG_TURNS).select("conv_id"))
    hashed = turns.withColumns({"depth": F.col("place") + 1, "x1": F.xxhash64(F.lit(1), "place", "d1", "d2"), "x2": F.xxhash64(F.lit(2), "place", "d1", "d2")})
    out = _cumulated(_with_blocks(hashed, long, F.col("place")), [F.col("place")], {"k1": (F.col("x1"), "xor"), "k2": (F.col("x2"), "xor")})
    return out.select("conv_id", "depth", "d1", "d2", "words", "x1", "x2", "k1", "k2")


def _sequences(keyed: DataFrame, members: DataFrame) -> DataFrame:
    """One row per different conversation: rep (the least id), n_turns, n (conversations that are equal) and sha (SHA-256 of their ids).

    Ids are joined to segments of bounded size in parallel; only the segments
    of one list stream through one hash, which has no other way.
    """
    ends = members.join(keyed.groupBy("conv_id").agg(F.bit_xor("x1").alias("k1"), F.bit_xor("x2").alias("k2")), "conv_id", "left").select(
        "conv_id", F.col("n_turns").alias("depth"), F.coalesce("k1", F.lit(0)).alias("k1"), F.coalesce("k2", F.lit(0)).alias("k2"))
    segments = ends.groupBy(*KEY, F.floor(F.col("conv_id") / SEGMENT_IDS).alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("rep"), F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, rep, sha = None, 0, 0, None
        for batch in batches:
            out = []
            for key, m, r, ids in zip(zip(*[batch.column(c).to_pylist() for c in KEY], strict=True), *[batch.column(c).to_pylist() for c in ("n", "rep", "ids")], strict=True):
                if key == last:
                    n += m
                    sha.update(b"," + ids.encode())
                else:
                    if last is not None:
                        out.append((rep, last[0], n, sha.hexdigest()))
                    last, n, rep, sha = key, m, r, hashlib.sha256(ids.encode())
            yield _batch(out)
        if last is not None:
            yield _batch([(rep, last[0], n, sha.hexdigest())])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        kinds = pa.int64(), pa.int64(), pa.int64(), pa.string()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["rep", "n_turns", "n", "sha"])

    return segments.repartition(*KEY).sortWithinPartitions(*KEY, "segment").mapInArrow(run, "rep bigint, n_turns bigint, n bigint, sha string")


class DoubleArray:
    """A trie: the child of state s by label c is slot BASE[s] + c, if CHECK[slot] is s. Slot 0 is the root."""

    def __init__(self) -> None:
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
        self.tail, self.holes = 1, []

    def _reserve(self, n: int) -> None:
        if n > len(self.check):
            more = max(n, 2 * len(self.check)) - len(self.check)
            self.base, self.check = np.concatenate([self.base, np.zeros(more, np.int64)]), np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _first_fit(self, labels: np.ndarray) -> int:
        """BASE for sorted labels whose slots are all free: the first hole that fits, else behind the last slot."""
        holes = self.holes = [h for h in self.holes if self.check[h] < 0]
        for lo in range(0, len(holes), 256):
            start = np.array(holes[lo:lo + 256], np.int64) - labels[0]
            slots = start[:, None] + labels
            free = (self.check[np.minimum(slots, len(self.check) - 1)] < 0) | (slots >= len(self.check))
            fits = np.flatnonzero(free.all(axis=1))
            if len(fits):
                return int(start[fits[0]])
        return self.tail - int(labels[0])

    def add(self, parents: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Slots of new children; pairs are sorted, and all children of a parent come at once."""
        first = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        many = np.diff(np.r_[first, len(parents)])
        slots = np.empty(len(parents), np.int64)
        for i in first[many > 1][np.argsort(-many[many > 1], kind="stable")].tolist():
            own = labels[i:i + int(many[np.searchsorted(first, i)])]
            base = self._first_fit(own)
            at = base + own
            end = int(at[-1]) + 1
            self._reserve(end)
            self.base[parents[i]], self.check[at] = base, parents[i]
            if end > self.tail:
                gaps = np.arange(self.tail, end)
                self.holes += gaps[self.check[gaps] < 0].tolist()
                self.tail = end
            slots[i:i + len(own)] = at
        alone = first[many == 1]
        taken: list[int] = []
        while self.holes and len(taken) < len(alone):
            hole = self.holes.pop()
            if self.check[hole] < 0:
                taken.append(hole)
        rest = len(alone) - len(taken)
        at = np.r_[np.array(taken, np.int64), np.arange(self.tail, self.tail + rest)]
        self.tail += rest
        self._reserve(self.tail)
        self.base[parents[alone]], self.check[at] = at - labels[alone], parents[alone]
        slots[alone] = at
        return slots

    def step(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The children by the labels; an error where there is none."""
        slots = self.base[states] + labels
        if (self.check[slots] != states).any():
            raise LookupError("no such path")
        return slots


def _dense(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """Ids from 0 of the rows, in the order in which they first come."""
    rows = np.rec.fromarrays(columns)
    _, first, inverse = np.unique(rows, return_index=True, return_inverse=True)
    ids = np.empty(len(first), np.int64)
    ids[np.argsort(first)] = np.arange(len(first))
    return ids[inverse.ravel()], len(first)


_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, sha string, is_top boolean, p1 bigint, p2 bigint"


def shard_nodes(table: pa.Table) -> pa.Table:
    """The nodes of one shard. Its rows: turns from the top node of their path on (depth >= cut), with the key (g1, g2) of that node."""
    table = table.take(pc.sort_indices(table, [("depth", "ascending"), ("rep", "ascending")]))
    c = {n: table.column(n).to_numpy() for n in ("rep", "depth", "cut", "g1", "g2", "d1", "d2", "words", "n", "x1", "x2")}
    level = c["depth"] - c["cut"]
    by_level = np.argsort(level, kind="stable")
    c, level, sha = {k: v[by_level] for k, v in c.items()}, level[by_level], table.column("sha").take(pa.array(by_level)).to_pylist()
    path, n_paths = _dense(c["rep"])
    turn, n_turns = _dense(c["d1"], c["d2"])
    top, n_tops = _dense(c["g1"], c["g2"])
    label, width = np.where(level == 0, n_turns + top, turn), n_turns + n_tops
    bounds = np.flatnonzero(np.r_[True, level[1:] != level[:-1], True])
    trie, state, levels = DoubleArray(), np.zeros(n_paths, np.int64), []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        pairs, inverse = np.unique(state[path[lo:hi]] * width + label[lo:hi], return_inverse=True)
        slots = trie.add(pairs // width, pairs % width)
        state[path[lo:hi]] = slots[inverse.ravel()]
        levels.append(slots)
    # Every path is walked through the arrays; a node is the slot where a walk stands.
    size, state = trie.tail, np.zeros(n_paths, np.int64)
    count, least, words, depth, row = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    end: dict[int, str] = {}
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        at = trie.step(state[path[lo:hi]], label[lo:hi])
        state[path[lo:hi]] = at
        np.add.at(count, at, c["n"][lo:hi])
        np.minimum.at(least, at, c["rep"][lo:hi])
        words[at], depth[at], row[at] = c["words"][lo:hi], c["depth"][lo:hi], np.arange(lo, hi)
        end.update((slot, s) for slot, s in zip(at.tolist(), sha[lo:hi], strict=True) if s is not None)
    nodes = np.concatenate(levels)
    children = np.bincount(trie.check[nodes], minlength=size)
    leaves, saved = (children[:size] == 0).astype(np.int64), (count - 1) * words
    for slots in levels[:0:-1]:
        np.add.at(leaves, trie.check[slots], leaves[slots])
        np.add.at(saved, trie.check[slots], saved[slots])
    is_top = trie.check[nodes] == 0
    first = row[nodes]
    columns = [least[nodes], depth[nodes], pa.array(least[trie.check[nodes]], mask=is_top), count[nodes], children[nodes], leaves[nodes], saved[nodes],
               [end.get(s) for s in nodes.tolist()], is_top, pa.array(c["g1"][first] ^ c["x1"][first], mask=~is_top), pa.array(c["g2"][first] ^ c["x2"][first], mask=~is_top)]
    names = [x.split()[0] for x in _NODE.split(", ")]
    return pa.table([x if isinstance(x, pa.Array) else pa.array(x, pa.string() if n == "sha" else None) for x, n in zip(columns, names, strict=True)], names=names)


def trie_nodes(turns: DataFrame, members: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: as of ``ordered_turns``; ``members``: conv_id, n_turns of every
    conversation, also those without turns. A node is a distinct sequence of
    first turns; ``conv_id`` is its smallest member, so (conv_id, depth) names it.
    Without conversations there is no node, not even the root.
    """
    keyed = materialize(_keyed(turns, members))
    reps = materialize(_sequences(keyed, members))
    zero = F.lit(0).cast("bigint")
    below = keyed.withColumnRenamed("conv_id", "rep").join(reps, "rep")
    above = reps.select("rep", *[zero.alias(c) for c in ("depth", "d1", "d2", "words", "x1", "x2", "k1", "k2")], "n_turns", "n", "sha")
    paths = materialize(below.unionByName(above).withColumn("sha", F.when(F.col("depth") == F.col("n_turns"), F.col("sha"))))

    # The prefix that each path is sharded by.
    steps = paths.filter((F.col("depth") > 0) & (F.col("depth").bitwiseAND(F.col("depth") - 1) == 0))
    heavy = materialize(steps.groupBy(*KEY).agg(F.sum(F.col("n_turns") - F.col("depth") + 1).alias("below")).filter(F.col("below") > shard_turns).select(*KEY))
    fit = steps.join(_small(heavy).withColumn("heavy", F.lit(True)), KEY, "left").filter("heavy is null")
    cuts = materialize(fit.groupBy("rep").agg(F.min(F.struct(*KEY)).alias("c")).select("rep", F.col("c.depth").alias("cut"), F.col("c.k1").alias("g1"), F.col("c.k2").alias("g2")))
    shards = -(-paths.count() // shard_turns) or 1
    own = paths.join(cuts, "rep").filter(F.col("depth") >= F.col("cut")).withColumn("shard", F.pmod(F.xxhash64("g1", "g2"), F.lit(shards)))
    local = materialize(own.select("shard", "rep", "depth", "cut", "g1", "g2", "d1", "d2", "words", "n", "x1", "x2", "sha").groupBy("shard").applyInArrow(shard_nodes, _NODE))

    # Shared nodes: one path for each top node of a shard, and the paths that no shard took.
    tops = local.filter("is_top")
    way = ["rep", "depth", "words", "x1", "x2", "k1", "k2", "sha", "n_turns"]
    carried = paths.drop("n").join(tops.select(F.col("conv_id").alias("rep"), F.col("depth").alias("top"), F.col("n_convs").alias("n"), "n_leaves", "saved_tokens"), "rep").filter(
        F.col("depth") < F.col("top")).select(*way, "n", "n_leaves", "saved_tokens")
    alone = paths.join(cuts.select("rep"), "rep", "left_anti").select(*way, "n", zero.alias("n_leaves"), zero.alias("saved_tokens"))
    upper = materialize(carried.unionByName(alone))
    merged = upper.groupBy(*KEY).agg(
        F.min("rep").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.max("words").alias("words"), F.max("sha").alias("sha"), F.max(F.col("k1").bitwiseXOR(F.col("x1"))).alias("p1"), F.max(F.col("k2").bitwiseXOR(F.col("x2"))).alias("p2"))
    merged = materialize(merged)
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    n_children = merged.filter("depth > 0").select(*parent).unionByName(tops.select(*parent)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    counted = materialize(merged.join(n_children, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)))
    # Each shared node's own share goes to its conv_id's path, once, and from there to all nodes above it on that path.
    given = counted.select(F.col("conv_id").alias("rep"), "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("save"), (F.col("n_children") == 0).cast("bigint").alias("leaf"))
    walked = upper.select("rep", *KEY, "n_turns").join(given, ["rep", "depth"], "left").withColumnRenamed("rep", "conv_id").withColumn("is_long", F.col("n_turns") > LONG_TURNS)
    walked = walked.withColumn("block", F.when(F.col("is_long"), F.floor(F.col("depth") / LONG_TURNS)).otherwise(zero))
    sums = _cumulated(walked, [F.col("depth").desc()], {"saves": (F.coalesce("save", zero), "sum"), "leaves": (F.coalesce("leaf", zero), "sum")}, descending=True)
    whole = counted.join(sums.groupBy(*KEY).agg(F.sum("saves").alias("saves"), F.sum("leaves").alias("leaves")), KEY).select(
        "conv_id", "depth", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaves")).alias("n_leaves"), (F.col("saved_tokens") + F.col("saves")).alias("saved_tokens"), "sha", "p1", "p2")

    # Names of the parents of shared and of top nodes.
    fields = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "sha"]
    nodes = whole.filter("depth > 0").unionByName(tops.select(whole.columns)).select(F.struct(*fields).alias("node"), *parent)
    total = nodes.count()
    named = join_by_hot_key(nodes, counted.select(*KEY, "n_children", F.col("conv_id").alias("parent_conv_id")), KEY, "n_children", total).select("node.*", "parent_conv_id")
    root = whole.filter("depth = 0").select(*fields, F.lit(None).cast("bigint").alias("parent_conv_id"))
    every = named.unionByName(root).unionByName(local.filter("not is_top").select(*fields, "parent_conv_id"))
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def prefix_trie(talks: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The nodes of all conversations of ``talks``, as of ``trie_nodes``. Other columns are ignored."""
    turns = materialize(ordered_turns(talks, id_col, turn_col, role_col, text_col))
    return trie_nodes(turns, members_of(turns))


def lent_prefix_trie(talks: DataFrame, every: int, most: int) -> DataFrame:
    """The same after ``with_lent_prefixes``."""
    return trie_nodes(*with_lent_prefixes(materialize(ordered_turns(talks)), every, most))
