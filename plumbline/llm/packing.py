"""Sum-of-squares packing of tokenised documents into fixed-length sequences.

Documents are tokenised where they lie; only (id, start, length, checksum) of
each piece moves. Pieces are dealt into groups of bounded size by a hash, and
each group is packed on its own: a piece goes where the sum of the squared
numbers of open bins per residual gap becomes least.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import materialize, tidy

#: Pieces of one group on average; a group is one task's work.
GROUP_PIECES = 40_000
#: Pattern by which the public byte-level vocabulary splits text before merging; a fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Tokens that the vocabulary's JSON file adds to its ranks; texts that hold one literally get its id.
SPECIAL = {"<|endoftext|>": 50256}


def load_encoder(vocab_path: str):
    """text -> list of ids. ``.json``: the tokenizers library; ``.tiktoken``: the same vocabulary as ranks, several times faster."""
    if vocab_path.endswith(".json"):
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(vocab_path)
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(vocab_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return lambda text: fast.encode(text, allowed_special="all")


def tokenised_pieces(docs: DataFrame, vocab_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
                     text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, copy, piece, start, length, ids_crc32 (and ids) of every piece of every row.

    A document is its ids and then ``end_id``; only one longer than ``capacity``
    is cut. The first piece takes the remainder, the others are full. A null
    text is empty and has one piece, the end id. ``copy`` tells rows with the
    same id apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(vocab_path)
        for batch in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                first = len(ids) % capacity or capacity if len(ids) > capacity else len(ids)
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    if with_ids:
                        kept.append(ids[a:b])
            cols = [batch.column("doc_id").take(pa.array(row, pa.int64())), batch.column("copy").take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "copy", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(kept, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("copy"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, copy bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return rows.mapInArrow(tidy(run), out)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, items taken in the given order.

    With N(g) open bins of residual gap g, putting an item of size s into a bin
    of gap g changes the sum of squares by 2 + 2 (N(g-s) - N(g)), filling it
    by 1 - 2 N(g), and a new bin by 1 + 2 N(capacity-s), since full bins count
    for nothing. Ties go to the tightest gap.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    n = np.zeros(capacity + 1, np.int64)
    used: list[int] = []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        if s < capacity:
            left = n[s:]
            change = 2 * (n[:capacity + 1 - s] - left) + 2
            change[0] = 1 - 2 * left[0]        # it fills the bin
            change[left == 0] = never
            g = int(change.argmin())
            fresh = 2 * int(n[capacity - s]) + 1
            reuse = change[g] != never and change[g] <= fresh
        else:
            reuse = False
        if reuse:
            gap = g + s
            b = open_bins[gap].pop()
            n[gap] -= 1
        else:
            b, gap = len(used), capacity
            used.append(0)
        where[i], offset[i] = b, used[b]
        used[b] += s
        if gap > s:
            open_bins[gap - s].append(b)
            n[gap - s] += 1
    return where, offset


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset. Longer pieces first, so that short ones fill the gaps.

    The number of groups follows the number of pieces; which group a piece lies
    in depends on its id alone, so a lost task is redone alike. Sequence ids
    are unique over groups. No piece gives no sequence.
    """
    pieces = materialize(pieces)
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    key = F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(groups))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "copy", "piece"], ascending=[False, True, True, True])
        b, offset = sum_of_squares(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=group["group"].to_numpy() * (1 << 40) + b, offset=offset).drop(columns="group")

    return pieces.withColumn("group", key).groupBy("group").applyInPandas(run, out)


def pack_documents(docs: DataFrame, vocab_path: str, capacity: int = 2048, with_ids: bool = True, **cols: str) -> DataFrame:
    """Pieces of all documents with their place; with_ids: and their ids, which stay out of the packing itself."""
    pieces = tokenised_pieces(docs, vocab_path, capacity, with_ids=with_ids, **cols)
    if not with_ids:
        return pack(pieces, capacity).drop("copy")
    pieces = materialize(pieces)
    placed = pack(pieces.drop("ids"), capacity).select("doc_id", "copy", "piece", "sequence_id", "offset")
    return pieces.join(placed, ["doc_id", "copy", "piece"]).drop("copy")
