"""Judges as DataFrame functions, asked in both slot orders.

A judge takes comparisons (row_id, prompt, responses, contexts and any other
columns) and returns one row per comparison: row_id and ``verdict``, which is
A, B, tie, or NULL where the reply had none. Partitions are the concurrency;
the result does not depend on their number.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.prompts import system_prompt, user_prompt
from plumbline.functions.text import length_cap, length_note, truncate_at_word
from plumbline.functions.verdicts import parse_verdict, reconcile
from plumbline.operators.replies import answer_requests, append_replies, cacheable, latest_by_key, request_key
from plumbline.shared import children, exists, point_to, remove, settled

SWAPPED = {"response_a": "response_b", "response_b": "response_a", "system_a": "system_b", "system_b": "system_a",
           "context_a": "context_b", "context_b": "context_a"}


class Judge(NamedTuple):
    """``verdicts``: comparisons -> (row_id, verdict), in the given slot order."""

    name: str
    verdicts: Callable[[DataFrame], DataFrame]
    order_invariant: bool = False


def expression_judge(name: str, verdict: Column, order_invariant: bool = False) -> Judge:
    return Judge(name, lambda rows: rows.select("row_id", verdict.alias("verdict")), order_invariant)


def length_judge() -> Judge:
    """Prefers the longer answer."""
    a, b = F.length("response_a"), F.length("response_b")
    return expression_judge("longer answer", F.when(a > b, "A").when(b > a, "B").otherwise("tie"))


def marker_judge(marker: str) -> Judge:
    """Prefers the one answer that holds the marker."""
    a, b = F.col("response_a").contains(marker), F.col("response_b").contains(marker)
    return expression_judge("marker", F.when(a & ~b, "A").when(b & ~a, "B").otherwise("tie"))


def swap_slots(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(SWAPPED[c] if SWAPPED.get(c) in rows.columns else c).alias(c) for c in rows.columns])


def judge_many(judge: Judge, rows: DataFrame, strict: bool = False) -> DataFrame:
    """row_id, winner, position_unstable, parse_failed. An order-invariant judge is asked once, others in both orders at once.

    ``strict``: a reply without a verdict is an error.
    """
    if judge.order_invariant:
        asked = judge.verdicts(rows).select("row_id", F.struct(
            F.coalesce("verdict", F.lit("tie")).alias("winner"), F.lit(False).alias("position_unstable"), F.col("verdict").isNull().alias("parse_failed")).alias("v"))
        out = asked.select("row_id", "v.*")
    else:
        tagged = rows.withColumn("_row", F.col("row_id"))
        both = tagged.withColumn("row_id", F.concat(F.lit("0"), "_row")).unionByName(swap_slots(tagged).withColumn("row_id", F.concat(F.lit("1"), "_row"))).drop("_row")
        asked = judge.verdicts(both)
        first = F.substring("row_id", 1, 1) == "0"
        pairs = asked.groupBy(F.expr("substring(row_id, 2)").alias("row_id")).agg(
            F.max(F.when(first, F.col("verdict"))).alias("first"), F.max(F.when(~first, F.col("verdict"))).alias("swapped"))
        out = pairs.select("row_id", reconcile(F.col("first"), F.col("swapped")).alias("v")).select("row_id", "v.*")
    if strict:
        few = [r["row_id"] for r in out.filter("parse_failed").select("row_id").limit(5).collect()]
        if few:
            raise ValueError(f"replies without a verdict: {out.filter('parse_failed').count()} items, among them {sorted(few)}")
    return out


def position_check(replies: DataFrame, reply: str = "reply", swapped: str = "reply_swapped") -> DataFrame:
    """The same from recorded replies in both orders."""
    return replies.select("row_id", reconcile(parse_verdict(F.col(reply)), parse_verdict(F.col(swapped))).alias("v")).select("row_id", "v.*")


def length_normalized(inner: Judge, tolerance: float = 1.15) -> Judge:
    """Cuts the longer answer to ``tolerance`` times the shorter before the inner judge sees them."""
    def verdicts(rows: DataFrame) -> DataFrame:
        cap = length_cap(F.col("response_a"), F.col("response_b"), tolerance)
        return inner.verdicts(rows.withColumns({c: truncate_at_word(F.col(c), cap) for c in ("response_a", "response_b")}))

    return Judge(f"{inner.name} (length-normalized)", verdicts, inner.order_invariant)


def length_disclosed(inner: Judge, threshold: float = 1.15) -> Judge:
    """Puts a note on both lengths before the prompt; the note names slots, so it is made after any swap."""
    def verdicts(rows: DataFrame) -> DataFrame:
        return inner.verdicts(rows.withColumn("prompt", F.concat(length_note(F.col("response_a"), F.col("response_b"), threshold), "prompt")))

    return Judge(f"{inner.name} (length-disclosed)", verdicts, inner.order_invariant)


def with_prompts(rows: DataFrame) -> DataFrame:
    """Adds system and user prompt."""
    return rows.withColumns({
        "system": system_prompt(F.col("context_a"), F.col("context_b")),
        "user": user_prompt(F.col("prompt"), F.col("response_a"), F.col("response_b"), F.col("context_a"), F.col("context_b"))})


def request_rows(rows: DataFrame, model: str) -> DataFrame:
    """row_id, system, user and the key of the request that each comparison makes."""
    return with_prompts(rows).select("row_id", "system", "user").withColumn("key", request_key(F.lit(model), F.col("system"), F.col("user")))


def verdicts_of(requests: DataFrame, answers: DataFrame) -> DataFrame:
    return requests.select("row_id", "key").join(answers.select("key", "response"), "key").select("row_id", parse_verdict(F.col("response")).alias("verdict"))


class BackendError(RuntimeError):
    """Some requests got no reply; holds their number and a few messages. All other replies are in the log."""


_ASKED = "key string, response string, stop_reason string, error string"


def _ask_in_rounds(pending: DataFrame, backend: Callable[[str, str], tuple[str, str | None]], log: str, run: str, in_flight: int, round_size: int) -> None:
    """Asks every pending request (key, system, user), a round of at most ``round_size`` after the other, as a stream over a queue of files.

    A round's replies are written before the next round begins: all of them
    beside the log, and to the log what may be kept. A round that is run again
    finds what it has written. A backend that raises costs its own request alone.
    A round takes up to ``in_flight`` files, each of them asked in one task, so
    prompts are shuffled neither into the queue nor out of it.
    """
    spark = pending.sparkSession

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, system, user in zip(pdf["key"], pdf["system"], pdf["user"], strict=True):
                try:
                    rows.append((key, *backend(system, user), None))
                except Exception as e:                          # the other replies of the round are paid for
                    rows.append((key, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["key", "response", "stop_reason", "error"])

    def one_round(batch: DataFrame, number: int) -> None:
        here = f"{run}/asked/round={number}"
        if not exists(spark, f"{here}/_SUCCESS"):
            batch.mapInPandas(call, _ASKED).write.mode("overwrite").parquet(here)
        if not exists(spark, f"{run}/kept/{number}"):
            keep_replies(spark.read.schema(_ASKED).parquet(here), log)
            point_to(spark, f"{run}/kept/{number}", "log")

    queue = f"{run}/queue"
    waiting = settled(pending.select("key", "system", "user"))
    asked = waiting.count()
    if not asked:
        return
    rounds, files = -(-asked // round_size), min(in_flight, round_size)
    rows = min(round_size // files, -(-asked // (rounds * files)))
    waiting.coalesce(rounds).write.option("maxRecordsPerFile", rows).parquet(queue)
    stream = spark.readStream.schema(waiting.schema).option("maxFilesPerTrigger", files).parquet(queue)
    stream.writeStream.foreachBatch(one_round).option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    remove(spark, queue)
    remove(spark, f"{run}/checkpoint")


def keep_replies(asked: DataFrame, log: str) -> None:
    """Appends the replies of a round that may be kept, as one file."""
    fresh = asked.filter(cacheable(F.col("stop_reason")) & F.col("error").isNull() & F.col("response").isNotNull()).drop("error")
    append_replies(fresh.withColumn("seq", F.current_timestamp()).coalesce(1), log)


def recover_replies(spark: SparkSession, log: str) -> None:
    """Brings rounds into the log that an earlier run has written beside it but, being killed, not appended."""
    for run in (f"{log}-runs/{name}" for name in children(spark, f"{log}-runs")):
        for name in [] if exists(spark, f"{run}/_done") else children(spark, f"{run}/asked"):
            number = name.partition("=")[2]
            if exists(spark, f"{run}/asked/{name}/_SUCCESS") and not exists(spark, f"{run}/kept/{number}"):
                keep_replies(spark.read.schema(_ASKED).parquet(f"{run}/asked/{name}"), log)
                point_to(spark, f"{run}/kept/{number}", "log")


def logged_judge(name: str, model: str, backend: Callable[[str, str], tuple[str, str | None]], log: str, in_flight: int = 8, round_size: int = 256) -> Judge:
    """A judge behind a Python function (system, user) -> (reply, stop reason) that pays for no reply twice.

    ``log``: folder of an append-only log of replies (key, response,
    stop_reason, seq). Requests that it answers are not asked, equal requests
    are asked once, and replies are committed round by round, before they are
    used: a job that dies loses at most the round that was under way, and the
    next one goes on behind it. With ``round_size`` 1 every reply is committed
    by itself. Requests on which the backend raised are named in one
    BackendError at the end.
    """
    def ask(pending: DataFrame) -> DataFrame:
        """Asks now, so that a second look at the result asks nobody again."""
        spark, run = pending.sparkSession, f"{log}-runs/{uuid.uuid4().hex}"
        _ask_in_rounds(pending, backend, log, run, in_flight, round_size)
        point_to(spark, f"{run}/_done", "run")
        if not exists(spark, f"{run}/asked"):
            return spark.createDataFrame([], _ASKED)
        fresh = spark.read.schema(_ASKED).parquet(*[f"{run}/asked/{r}" for r in children(spark, f"{run}/asked")])
        failed = fresh.filter("error is not null")
        few = [r["error"] for r in failed.select("error").limit(3).collect()]
        if few:
            raise BackendError(f"{failed.count()} requests without a reply, among them {few}")
        return fresh

    def verdicts(rows: DataFrame) -> DataFrame:
        spark, requests = rows.sparkSession, request_rows(rows, model)
        recover_replies(spark, log)
        kept = latest_by_key(spark.read.parquet(log), "key", ["seq"]) if exists(spark, log) else spark.createDataFrame([], "key string, response string")
        return verdicts_of(requests, answer_requests(requests, settled(kept.select("key", "response")), ask))

    return Judge(name, verdicts)


def reply_judge(name: str, backend: Callable[[str, str], str], in_flight: int = 8) -> Judge:
    """A judge behind a Python function (system, user) -> reply; ``in_flight`` partitions call it at once."""
    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"row_id": pdf["row_id"], "reply": [backend(s, u) for s, u in zip(pdf["system"], pdf["user"], strict=True)]})

    def verdicts(rows: DataFrame) -> DataFrame:
        asked = with_prompts(rows).select("row_id", "system", "user").repartition(in_flight, "row_id")
        return asked.mapInPandas(call, "row_id string, reply string").select("row_id", parse_verdict(F.col("reply")).alias("verdict"))

    return Judge(name, verdicts)
