"""Incremental operators over streams. Each works on batch tables too, where that makes sense."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.urls import content_hash, fingerprint

#: The stages of a claim check and their percentages.
STAGES = (("queued", 1), ("starting", 4), ("searching", 12), ("fetching", 25), ("translating", 70), ("selecting", 80), ("nli", 90), ("done", 100))
TASK_TTL = 600
#: The session's setting for operators with timers.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def unseen_urls(stream: DataFrame, *, url_col: str = "url", time_col: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each URL once: within the watermark if there is a time column, which bounds the state; without one
    for the whole stream, whose state grows with the number of URLs, as a set of seen URLs must.
    """
    marked = stream.withColumn("fingerprint", fingerprint(F.col(url_col)))
    if time_col is None:
        return marked.dropDuplicates(["fingerprint"])
    return marked.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["fingerprint"])


def new_contents(stream: DataFrame, *, url_col: str = "url", text_col: str = "text") -> DataFrame:
    """Rows whose (URL, content) comes for the first time."""
    return stream.withColumn("content_hash", content_hash(F.coalesce(F.col(text_col), F.lit("")))).dropDuplicates([url_col, "content_hash"])


def index_batches(stream: DataFrame, chunk: Callable[[DataFrame], DataFrame], add: Callable[[DataFrame], None], *, checkpoint: str):
    """Runs a stream of pages into an index until what is there has been read: chunk() makes rows of a batch, add() upserts them by id."""

    def one(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            add(chunk(batch))

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def task_states(updates: DataFrame, as_of: float) -> DataFrame:
    """(task_id, stage, pct, done, started) of the tasks that aren't expired at as_of, from updates (task_id, ts, stage): the last update of each."""
    known = F.create_map(*[x for name, pct in STAGES for x in (F.lit(name), F.lit(pct))])
    last = updates.groupBy("task_id").agg(F.min("ts").alias("started"), F.max_by("stage", F.struct("ts", "stage")).alias("stage"), F.max("ts").alias("updated"))
    return last.where(F.lit(as_of) - F.col("updated") < TASK_TTL).select("task_id", "stage", F.try_element_at(known, F.col("stage")).alias("pct"), (F.col("stage") == "done").alias("done"), "started")


def fetch_progress(done: DataFrame, total: int) -> DataFrame:
    """done (task_id, n fetched) with the percentage shown while fetching: 25 to 65."""
    return done.withColumn("pct", F.lit(25) + F.floor(40 * F.col("n") / F.lit(max(total, 1))).cast("int"))


class _Lasting(StatefulProcessor):
    """One number a key, and a timer at the event time from which the number means no more than none: it falls then."""

    #: The output column: what step() gives for each time of a key, beside the number that it leaves.
    column = ""

    def __init__(self, key: str, span: float):
        self.key, self.span = key, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.number = handle, handle.getValueState("number", "x double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = np.sort(np.concatenate([pdf["ts"].to_numpy(dtype=np.float64) for pdf in rows]))
        held = self.number.get()[0] if self.number.exists() else -math.inf
        out, held = self.step(times, held)
        self.number.update((held,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(self._falls(held))
        yield pd.DataFrame({self.key: [key[0]] * len(times), "ts": times, self.column: out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.number.clear()
        return iter(())

    def _falls(self, held: float) -> int:
        return math.ceil((held + self.span) * 1000)


class _Gaps(_Lasting):
    column = "allowed_at"

    def step(self, times: np.ndarray, free: float) -> tuple[list, float]:
        out = []
        for t in times.tolist():
            out.append(max(t, free))
            free = out[-1] + self.span
        return out, free

    def _falls(self, held: float) -> int:
        return math.ceil(held * 1000)


class _Entries(_Lasting):
    column = "hit"

    def step(self, times: np.ndarray, written: float) -> tuple[list, float]:
        out = []
        for t in times.tolist():
            out.append(t - written < self.span)
            written = written if out[-1] else t
        return out, written


def _timed(stream: DataFrame, key: str, delay: str, processor: StatefulProcessor, kind: str) -> DataFrame:
    name = stream.schema[key].dataType.simpleString()
    rows = stream.select(F.col(key), F.col("ts").cast("double").alias("ts"), F.timestamp_micros((F.col("ts") * 1e6).cast("long")).alias("__at")).where("ts is not null").withWatermark("__at", delay)
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=f"`{key}` {name}, ts double, {processor.column} {kind}", outputMode="Append", timeMode="EventTime")


def rate_limited(stream: DataFrame, *, key: str = "domain", gap: float = 1.0, delay: str = "1 hour") -> DataFrame:
    """Events (key, ts as epoch seconds) with ``allowed_at``: no two of a key closer than ``gap`` seconds.

    The state is one number a key. A timer drops it when the watermark, ``delay`` behind the latest event, has passed the
    time from which the key is free: no event that still counts could tell the difference. So the state grows with the
    keys of the last ``delay``, not with all that ever came. Events later than the watermark and those without a time are
    left out; events of a batch are taken in order of time. Needs the RocksDB state store (STATE_STORE).
    """
    return _timed(stream, key, delay, _Gaps(key, gap), "double")


def live_entries(stream: DataFrame, *, key: str = "key", ttl: float = 3600.0, delay: str = "1 hour") -> DataFrame:
    """(key, ts, hit) for lookups (key, ts as epoch seconds): hit if an entry of the key is younger than ttl; a miss writes one.

    An entry falls when the watermark passes its end, as rate_limited() says; lookups later than the watermark are left out.
    """
    return _timed(stream, key, delay, _Entries(key, ttl), "boolean")


def windowed_counts(stream: DataFrame, *, time_col: str = "ts", key: str = "event_type", window: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(start, end, key, n, total) in event-time windows behind a watermark: beyond the reference's own operators."""
    w = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    return stream.withWatermark(time_col, delay).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def session_counts(stream: DataFrame, *, time_col: str = "ts", key: str = "user_id", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) of sessions that a gap ends: beyond the reference's own operators."""
    return stream.withWatermark(time_col, delay).groupBy(F.session_window(time_col, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
