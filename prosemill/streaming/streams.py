"""Streams of paragraphs, feedback and calls; each gives what the batch operator gives over the same rows.

stream_budgets, stream_verdicts and stream_rescore have timers. Under a trigger by time, these are looked at in every batch. A run over
what has arrived (availableNow) needs spark.sql.streaming.noDataMicroBatches.enabled=false to end, and looks at them with its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from prosemill.functions import features
from prosemill.operators import corpus, feedback, scoring


def stream_score(stream: DataFrame, model: scoring.Network, text: str = "text", tau: float = 0.9, tau_machine: float = 0.97) -> DataFrame:
    """Features, logits, probabilities and decision of each row as it arrives; stateless."""
    scored = scoring.score_mlp(features.extract_features(stream, text), model)
    return scoring.decide(scored.withColumn("probs", scoring.softmax(F.col("logits"))), tau, tau_machine)


def _others(spark: SparkSession, path: str, batch: int) -> DataFrame | None:
    """What other batches have written to path; None before the first."""
    try:
        return spark.read.parquet(path).filter(F.col("batch") != batch).drop("batch")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND" and e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return None


def _put(df: DataFrame, path: str, batch: int) -> None:
    df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def score_batch(rows: DataFrame, batch: int, compute: Callable[[DataFrame], DataFrame], store: str, out: str, text: str = "text") -> None:
    """One batch of a stream: texts that no earlier batch has scored go to the store (key, and compute's columns), all rows with their
    results to out, both under the batch's number. A batch that is run again replaces what it wrote, so nothing changes.

    compute takes distinct texts (key, text) and gives a row for each. An empty batch writes nothing.
    """
    spark = rows.sparkSession
    rows = rows.persist()
    try:
        if rows.isEmpty():
            return
        wanted, known = corpus.distinct_texts(rows, text), _others(spark, store, batch)
        fresh = wanted if known is None else wanted.join(known.select("key"), "key", "left_anti")
        _put(compute(fresh), store, batch)
        scored = spark.read.parquet(store).drop("batch").dropDuplicates(["key"])
        _put(corpus.score_back(rows, scored.join(wanted.select("key"), "key", "left_semi"), text), out, batch)
    finally:
        rows.unpersist()


def stream_score_once(stream: DataFrame, model: scoring.Network, store: str, out: str, text: str = "text", tau: float = 0.9, tau_machine: float = 0.97) -> DataStreamWriter:
    """The writer of a stream whose texts are scored once each, however often and in whatever batches they come (see score_batch).

    Start it with a checkpoint of its own. The store may be read by others; its folders by batch can be compacted between runs.
    """

    def compute(texts: DataFrame) -> DataFrame:
        scored = scoring.score_mlp(features.extract_features(texts, "text"), model)
        decided = scoring.decide(scored.withColumn("probs", scoring.softmax(F.col("logits"))), tau, tau_machine)
        return decided.select("key", "probs", "p", "n_words", "english", "decision")

    def each(rows: DataFrame, batch: int) -> None:
        score_batch(rows, batch, compute, store, out, text)

    return stream.writeStream.foreachBatch(each)


def stream_feedback(stream: DataFrame, dim: int, delay: str = "2 days") -> DataFrame:
    """week (its Monday), n, unsure_rate of valid corrections, repeats of an id within the delay dropped."""
    good = feedback.valid_correction(stream, dim).filter("reason is null").withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["id"])
    week = F.window("created_at", "7 days", startTime="4 days")  # the epoch was a Thursday
    return good.groupBy(week).agg(F.count("*").alias("n"), F.avg((F.col("predicted") == "unsure").cast("double")).alias("unsure_rate")).select(F.to_date("window.start").alias("week"), "n", "unsure_rate")


def stream_usage(stream: DataFrame) -> DataFrame:
    """Running counters of each (scope, key, period), for update mode."""
    return stream.groupBy("scope", "key", "period").agg(F.sum("amount").alias("n"))


class _Budget(StatefulProcessor):
    """Running usage of one budget; each of its calls is told whether the budget allows it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "n long", ttlDurationMs=2 * 86_400_000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values(["ts", "call_id"])
        before = self.used.get()[0] if self.used.exists() else 0
        running = got["amount"].cumsum() + before
        self.used.update((int(running.iloc[-1]),))
        within = (running <= got["limit"]) | got["limit"].isna()
        yield pd.DataFrame({"call_id": got["call_id"], "budgets": got["budgets"], "scope": key[0], "key": key[1], "period": key[2], "running": running, "within": within})

    def close(self) -> None:
        pass


#: Groups in which calls wait for their verdicts, and for how long a call is remembered after its last answer. Checkpoints depend on them.
GROUPS = 512
REMEMBERED_MS = 2 * 86_400_000
#: What a group remembers of a call: its answers, whether one refused it, whether it has its verdict, and when it and its last answer came.
CALL = np.dtype([("call_id", "<i8"), ("answers", "<i4"), ("refused", "?"), ("done", "?"), ("since", "<i8"), ("last", "<i8")])


class _Verdict(StatefulProcessor):
    """Calls' budgets as they answer: refused by the first that is used up, allowed when all have said so, refused when their time is up.

    A key is a group of calls, all worked out together, since a key costs milliseconds of its own. Its state is one value, the
    remembered calls in order of their ids. Group -1 holds calls without an id, which are one call.
    """

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getValueState("calls", "packed binary", ttlDurationMs=REMEMBERED_MS)

    def _known(self, now_ms: int) -> np.ndarray:
        calls = np.frombuffer(bytes(self.calls.get()[0]), CALL).copy() if self.calls.exists() else np.empty(0, CALL)
        return calls[calls["last"] > now_ms - REMEMBERED_MS]

    def _verdicts(self, key, told: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"call_id": [None] * len(told) if key[0] < 0 else told["call_id"], "allowed": ~told["refused"], "answers": told["answers"]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentProcessingTimeInMs()
        known, parts = self._known(now_ms), []
        for got in rows:  # each part is summed by call at once, so a group's rows are never held together
            ids, first, at = np.unique(got["call_id"].to_numpy("int64", na_value=0), return_index=True, return_inverse=True)
            parts.append((ids, np.bincount(at), np.bincount(at, ~got["within"].to_numpy(bool)), got["budgets"].to_numpy()[first]))
        given, counts, refusals, budgets = (np.concatenate(x) for x in zip(*parts))
        ids, first, at = np.unique(given, return_index=True, return_inverse=True)
        calls = np.zeros(len(np.union1d(known["call_id"], ids)), CALL)
        calls["call_id"], calls["since"] = np.union1d(known["call_id"], ids), now_ms
        calls[np.searchsorted(calls["call_id"], known["call_id"])] = known
        here = calls[place := np.searchsorted(calls["call_id"], ids)]
        new = here["answers"] == 0
        here["answers"] += np.bincount(at, counts).astype("int32")
        here["refused"] |= np.bincount(at, refusals) > 0
        here["last"] = now_ms
        told = ~here["done"] & (here["refused"] | (here["answers"] >= budgets[first]))
        here["done"] |= told
        calls[place] = here
        self.calls.update((calls.tobytes(),))
        if (new & ~told).any():
            self.handle.registerTimer(now_ms + self.wait_ms)
        if told.any():
            yield self._verdicts(key, here[told])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentProcessingTimeInMs()
        calls = self._known(now_ms)
        late = ~calls["done"] & (calls["since"] + self.wait_ms <= expiredTimerInfo.getExpiryTimeInMs())
        if late.any():
            for field, value in (("refused", True), ("done", True), ("last", now_ms)):
                calls[field][late] = value
            self.calls.update((calls.tobytes(),))
            yield self._verdicts(key, calls[late])

    def close(self) -> None:
        pass


def stream_budgets(stream: DataFrame) -> DataFrame:
    """call_id, budgets, scope, key, period, running, within of calls (call_id, budgets, ts, scope, key, period, amount, limit), one row for
    each budget that a call draws on; refused calls still count. State is forgotten two days after a budget's last call."""
    out = "call_id long, budgets int, scope string, key string, period string, running long, within boolean"
    rows = stream.select("call_id", F.col("budgets").cast("int").alias("budgets"), "ts", "scope", "key", "period", "amount", "limit")
    return rows.groupBy("scope", "key", "period").transformWithStateInPandas(_Budget(), outputStructType=out, outputMode="Append", timeMode="ProcessingTime")


def stream_verdicts(stream: DataFrame, wait_ms: int = 60_000) -> DataFrame:
    """call_id, allowed, answers: one verdict a call. budgets says on how many a call draws; one that waits for answers longer than wait_ms is
    refused. A call allowed by all its budgets is allowed as spend() allows it, if calls arrive in their order."""
    out = "call_id long, allowed boolean, answers int"
    group = F.when(F.col("call_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("call_id"), F.lit(GROUPS))).cast("int")
    answers = stream_budgets(stream).select(group.alias("group"), "call_id", "budgets", "within")
    return answers.groupBy("group").transformWithStateInPandas(_Verdict(wait_ms), outputStructType=out, outputMode="Append", timeMode="ProcessingTime")


def stream_rescore(stream: DataFrame, keys: list[str], schema: str, idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """keys and text of blocks (keys, ts, text) whose text is new or has changed since the last of their key; schema: DDL of the keys.

    A key without rows for idle_ms is forgotten; its next text counts as new.
    """

    def changed(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(batches)).sort_values("ts").itertuples():
            if row.sha != last:
                out.append(row.text)
                last = row.sha
        state.update((last,))
        state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame({**{k: [v] * len(out) for k, v in zip(keys, key)}, "text": out})

    rows = stream.select(*keys, "ts", "text", F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("sha"))
    return rows.groupBy(*keys).applyInPandasWithState(changed, f"{schema}, text string", "sha string", "append", GroupStateTimeout.ProcessingTimeTimeout)
