"""Reply reuse, append-only logs and the cost of judging."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import ratio

#: Rough numbers of the cost estimate; fixed values. Characters per token, tokens of the fixed prompt part.
CHARS_PER_TOKEN, PROMPT_TOKENS = 4, 300
#: Price of input and output per million tokens for a model that the price table lacks, and its output tokens per call.
DEFAULT_PRICE = (5.0, 25.0, 200)


def request_key(model: Column, system: Column, user: Column) -> Column:
    return F.sha2(F.concat(model, F.lit("\n"), system, F.lit("\n"), user), 256)


def cacheable(stop_reason: Column) -> Column:
    """A reply that was cut off by the token limit is not an answer to keep."""
    return ~stop_reason.eqNullSafe(F.lit("max_tokens"))


def pending_requests(requests: DataFrame, cached_keys: DataFrame) -> DataFrame:
    """Distinct requests that no cached reply answers. Only keys meet in the join's other side."""
    return requests.dropDuplicates(["key"]).join(cached_keys.select("key").distinct(), "key", "left_anti")


def request_set(**splits: DataFrame) -> DataFrame:
    """key and the sorted names of the splits that ask for it: one row per distinct request of all splits."""
    every = None
    for name, requests in splits.items():
        part = requests.select("key", F.lit(name).alias("split"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("key").agg(F.sort_array(F.collect_set("split")).alias("splits"))


def cached_replies(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache.select("key", "response"), "key")


def answer_requests(requests: DataFrame, cache: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """key, response, stop_reason and cached of every distinct request (key, system, user); only those without a cached reply are asked.

    ``cache``: key and response, one row per key. ``ask``: distinct requests ->
    key, response, stop_reason. Several rows of one request are asked once.
    """
    hits = requests.select("key").distinct().join(cache.select("key", "response"), "key").select(
        "key", "response", F.lit(None).cast("string").alias("stop_reason"), F.lit(True).alias("cached"))
    fresh = ask(pending_requests(requests, cache)).select("key", "response", "stop_reason", F.lit(False).alias("cached"))
    return hits.unionByName(fresh)


def append_replies(replies: DataFrame, path: str) -> None:
    """Appends key, response and order columns to a log; ``latest_by_key`` reads it."""
    replies.write.mode("append").parquet(path)


def latest_by_key(log: DataFrame, key: str, order_cols: Sequence[str]) -> DataFrame:
    """The last written row of each key of an append-only log: one aggregation, no window."""
    latest = log.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*log.columns), F.struct(*order_cols)).alias("row"))
    return latest.select("row.*")


def status_counts(log: DataFrame, key: str, status: str, order_cols: Sequence[str]) -> DataFrame:
    """Number of keys by their current status."""
    return latest_by_key(log, key, order_cols).groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def judging_cost(comparisons: DataFrame, n_calls: Column, prices: DataFrame) -> DataFrame:
    """n_calls, tokens per call and cost per model of the price table (model, input_price, output_price, output_tokens).

    Tokens per call: whole part of the mean characters / 4, plus a fixed part.
    NULL prices fall back to the default ones.
    """
    chars = F.length("prompt") + F.length("response_a") + F.length("response_b")
    size = comparisons.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(chars), F.lit(0)).cast("bigint").alias("chars"))
    base = size.select(n_calls.alias("n_calls"), (F.floor(F.coalesce(ratio(F.col("chars"), F.col("n")), F.lit(0.0)) / CHARS_PER_TOKEN).cast("bigint")
                                                  + PROMPT_TOKENS).alias("input_tokens"))
    priced = prices.join(F.broadcast(base))                                                     # base is one row
    into, out, tokens = (F.coalesce(c, F.lit(v)) for c, v in zip(("input_price", "output_price", "output_tokens"), DEFAULT_PRICE, strict=True))
    cost = F.col("n_calls") * F.col("input_tokens") * into / 1e6 + F.col("n_calls") * tokens * out / 1e6
    return priced.select("model", "n_calls", "input_tokens", cost.alias("cost"))
