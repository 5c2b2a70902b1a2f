"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of bytes that cover all of it. Learned
filters slide over each chunk, each keeps its largest response (max pooling),
and the pooled responses of all chunks are combined into one probability. The
network is fitted on the driver with a bounded sample of labelled texts and
applied by Spark to every text; the fitted network is a few thousand numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import give_back, materialize, tidy
from plumbline.llm.toxicity import sample_per_class
from plumbline.llm.words import text_bytes

CHUNK, OVERLAP, WIDTH, FILTERS, DEPTH = 384, 48, 6, 24, 6
#: Chunks that the convolution works on at once.
AT_ONCE = 32


def chunk_starts(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every chunk and the row it belongs to; an empty row has one empty chunk."""
    length = np.diff(offsets)
    step = CHUNK - OVERLAP
    n = np.maximum(1, -(-(length - OVERLAP) // step))
    row = np.repeat(np.arange(len(length)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return offsets[:-1][row] + nth * step, row


def chunk_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Chunks as rows of bytes, zeros after the end of their text."""
    at = start[:, None] + np.arange(CHUNK)
    inside = at < end[:, None]
    return np.where(inside, data[np.where(inside, at, 0)] if len(data) else np.uint8(0), np.uint8(0)).astype(np.uint8)


class ByteCNN(NamedTuple):
    embed: np.ndarray    # 256 x DEPTH
    filters: np.ndarray  # WIDTH x DEPTH x FILTERS
    bias: np.ndarray     # FILTERS
    out: np.ndarray      # 3 * FILTERS: weights of the largest, the mean and the least pooled response
    shift: float

    def tables(self) -> np.ndarray:
        """Response of each pair of neighbouring bytes (as one number) at each pair of taps: WIDTH / 2 x 65536 x FILTERS."""
        single = np.einsum("bd,wdf->wbf", self.embed, self.filters).astype(np.float32)
        return (single[0::2, None, :, :] + single[1::2, :, None, :]).reshape(WIDTH // 2, 65536, FILTERS)

    @staticmethod
    def responses(tables: np.ndarray, chunks: np.ndarray) -> np.ndarray:
        """chunks x places x FILTERS, before pooling; a filter moves two bytes at a time."""
        pairs = np.ascontiguousarray(chunks).view("<u2").astype(np.intp)
        places = pairs.shape[1] - WIDTH // 2 + 1
        total = np.take(tables[0], pairs[:, :places], axis=0)
        for w in range(1, WIDTH // 2):
            total += np.take(tables[w], pairs[:, w:w + places], axis=0)
        return total

    def peaks(self, tables: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each filter's largest response in each chunk lies, and that response."""
        where, most = np.empty((len(chunks), FILTERS), np.intp), np.empty((len(chunks), FILTERS), np.float32)
        for i in range(0, len(chunks), 16 * AT_ONCE):
            raw = self.responses(tables, chunks[i:i + 16 * AT_ONCE])
            at = raw.argmax(1)
            where[i:i + len(at)], most[i:i + len(at)] = at, np.take_along_axis(raw, at[:, None], 1)[:, 0]
        return where, most

    def pooled(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, tables: np.ndarray) -> np.ndarray:
        out = np.empty((len(start), FILTERS), np.float32)
        for i in range(0, len(start), AT_ONCE):
            part = slice(i, i + AT_ONCE)
            out[part] = np.maximum(self.responses(tables, chunk_bytes(data, start[part], end[part])).max(1) + self.bias, 0)
        return out

    def probabilities(self, pooled: np.ndarray, row: np.ndarray) -> np.ndarray:
        """One probability per row; ``row`` is sorted and has every row at least once."""
        begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        count = np.diff(np.r_[begins, len(row)])[:, None]
        joint = np.c_[np.maximum.reduceat(pooled, begins), np.add.reduceat(pooled, begins) / count, np.minimum.reduceat(pooled, begins)]
        return 1 / (1 + np.exp(-np.clip(joint @ self.out + self.shift, -30, 30)))


def _first(mask: np.ndarray, begins: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Only the first True of every column within each run of rows."""
    seen = np.cumsum(mask, 0)
    return mask & (seen - (seen[begins] - mask[begins])[of] == 1)


def train(chunks: np.ndarray, row: np.ndarray, label: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.01,
          decay: float = 1e-4, seed: int = 5) -> ByteCNN:
    """Adam on the log loss. ``chunks`` sorted by ``row``; ``label`` has one value per row."""
    rng = np.random.Generator(np.random.PCG64(seed))
    p = {"embed": rng.normal(0, 0.5, (256, DEPTH)), "filters": rng.normal(0, 0.3, (WIDTH, DEPTH, FILTERS)),
         "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.1, 3 * FILTERS),
         "shift": np.array(np.log((label.mean() + 1e-3) / (1 - label.mean() + 1e-3)))}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    first = np.searchsorted(row, np.arange(len(label) + 1))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(label))
        for lo in range(0, len(order), batch):
            docs = np.sort(order[lo:lo + batch])
            at = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            of = np.repeat(np.arange(len(docs)), [first[d + 1] - first[d] for d in docs])
            x, y = chunks[at], label[docs]
            net = ByteCNN(p["embed"], p["filters"], p["bias"], p["out"], float(p["shift"]))
            peak, value = net.peaks(net.tables(), x)
            pre = value + p["bias"]
            pooled = np.maximum(pre, 0)
            begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            count = np.diff(np.r_[begins, len(of)])
            top = np.maximum.reduceat(pooled, begins)
            low = np.minimum.reduceat(pooled, begins)
            joint = np.c_[top, np.add.reduceat(pooled, begins) / count[:, None], low]
            prob = 1 / (1 + np.exp(-np.clip(joint @ p["out"] + p["shift"], -30, 30)))
            error = (prob - y) / len(y)
            back = np.outer(error, p["out"])
            to_pool = (back[of, FILTERS:2 * FILTERS] / count[of, None] + back[of, :FILTERS] * _first(pooled == top[of], begins, of)
                       + back[of, 2 * FILTERS:] * _first(pooled == low[of], begins, of)) * (pre > 0)
            g = {"out": joint.T @ error, "shift": np.array(error.sum()), "bias": to_pool.sum(0)}
            g["filters"], g["embed"] = np.zeros_like(p["filters"]), np.zeros_like(p["embed"])
            for w in range(WIDTH):
                seen = np.take_along_axis(x, 2 * peak + w, 1)       # chunks x FILTERS bytes
                g["filters"][w] = np.einsum("cfd,cf->df", p["embed"][seen], to_pool)
                np.add.at(g["embed"], seen, to_pool[:, :, None] * p["filters"][w].T[None])
            step += 1
            now = rate * (1 - epoch / epochs) + 1e-4
            for k in p:
                grad = g[k] + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                p[k] = (p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return ByteCNN(p["embed"], p["filters"], p["bias"], p["out"], float(p["shift"]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        per_class: int = 2000, sample_bytes: int = 16 << 20) -> ByteCNN | float:
    """A network from a bounded sample of labelled rows: at most ``per_class`` of each class and ``sample_bytes`` of text.

    Rows are taken whole, in the order of a hash of their ids; one that would
    pass the bound is left out. Only these texts reach the driver. Without
    labels of both classes the result is a constant: the share of label 1, or
    0.5 with no label at all. Rows that share an id all count.
    """
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = F.broadcast(materialize(sample_per_class(known, "label", per_class)))  # at most 2 * per_class ids
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(chosen, "doc_id").select("doc_id", "label", "text")

    keyed = materialize(texts.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")).withColumn("text_key", F.xxhash64("text")))
    order = keyed.select("doc_id", "text_key", "size").distinct().orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id", "text_key").limit(4 * per_class).collect()
    room, taken = sample_bytes, []
    for r in order:
        if r["size"] <= room:
            room -= r["size"]
            taken.append((r["doc_id"], r["text_key"]))
    wanted = docs.sparkSession.createDataFrame(taken, T.StructType([keyed.schema["doc_id"], keyed.schema["text_key"]]))
    got = keyed.join(F.broadcast(wanted), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select("label", "text").orderBy(
        F.xxhash64("doc_id", F.lit(17)), "doc_id", "text_key").toPandas()
    y = got["label"].to_numpy(np.float32) if len(got) else np.zeros(0, np.float32)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    data, offsets = text_bytes(pa.array(got["text"], pa.string()), lower=False)
    start, row = chunk_starts(offsets)
    end = offsets[1:][row]
    chunks = np.concatenate([chunk_bytes(data, start[i:i + 4096], end[i:i + 4096]) for i in range(0, len(start), 4096)])
    del got, data
    net = train(chunks, row, y)
    del chunks
    give_back()
    return net


def _scores(batch: pa.RecordBatch, column: str, net: ByteCNN | float, tables: np.ndarray | None) -> np.ndarray:
    if isinstance(net, float) or not batch.num_rows:
        return np.full(batch.num_rows, net if isinstance(net, float) else 0.0)
    data, offsets = text_bytes(batch.column(column), lower=False)
    start, row = chunk_starts(offsets)
    return net.probabilities(net.pooled(data, start, offsets[1:][row], tables), row).astype(float)


def score(docs: DataFrame, net: ByteCNN | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every input row; a null text counts as empty and has a score too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None if isinstance(net, float) else net.tables()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(batch, "text", net, tables))], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, net: ByteCNN | float, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose text scores at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None if isinstance(net, float) else net.tables()
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch, text, net, tables) >= least))

    # Names may clash only outside: inside, columns go by their place.
    names, plain = docs.columns, docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{names.index(text_col)}"
    return plain.mapInArrow(tidy(run), plain.schema).toDF(*names)
