"""Streams over the same rules as the batch folds: posts upserted by capture, alerts at most once a window, source silence, topic volume.

Keyed state lives in the state store (RocksDB; see configure), so it grows with keys, not with rows, and moves with its
partition when an executor is lost. Rows of a micro-batch are folded in order of time within their key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from postmill.functions.text import comparable
from postmill.functions.times import local_start
from postmill.operators.lifecycle import step_of

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UPSERTS = "key string, at timestamp, outcome string, text string, rank int, edits int, posted_at timestamp, author_id string"
ALERTS = "key string, at timestamp"
SILENCE = "key string, at timestamp, verdict string"


def configure(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(by, kind="stable")


class Upserts(StatefulProcessor):
    """The stored row of a post; every capture gives its outcome and the row after it, as state.capture_outcomes says."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", "same string, text string, rank int, edits int, posted_at timestamp, author_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.row.get() if self.row.exists() else None
        out = []
        same, text, rank, edits, posted, author = held or (None, None, 0, 0, None, None)
        for r in _ordered(rows, ["at", "seq"]).itertuples():
            if rank == 0:
                outcome, same, text, rank = "accepted", r.same, r.text, int(r.rank)
            elif r.rank < rank or r.same == same:
                outcome, rank = "duplicate", max(rank, int(r.rank))
            else:
                outcome = "edited" if r.rank == rank else "upgraded"
                edits, same, text, rank = edits + (outcome == "edited"), r.same, r.text, int(r.rank)
            posted = posted if posted is not None and not pd.isna(posted) else (None if pd.isna(r.posted_at) else r.posted_at)
            author = author if author is not None else r.author_id
            out.append((key[0], r.at, outcome, text, rank, edits, posted, author))
        self.row.update((same, text, rank, edits, None if posted is None else pd.Timestamp(posted).to_pydatetime(), author))
        yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in UPSERTS.split(",")])

    def close(self) -> None:
        pass


class Alerts(StatefulProcessor):
    """Passes an event only if the key's last alert is at least a window old."""

    def __init__(self, window_s: int):
        self.window_s = window_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(self.last.get()[0]) if self.last.exists() else None
        out = []
        for at in _ordered(rows, ["at"])["at"]:
            if last is None or (at - last).total_seconds() >= self.window_s:
                last = at
                out.append((key[0], at))
        if out:
            self.last.update((last.to_pydatetime(),))
        yield pd.DataFrame(out, columns=["key", "at"])

    def close(self) -> None:
        pass


class Silence(StatefulProcessor):
    """Tells once when a source has had no ok visit for longer than the limit, by a timer, and once when it recovers."""

    def __init__(self, limit_s: int):
        self.limit_s = limit_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", "last timestamp, open boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = pd.concat(list(rows))["at"].max()
        last, open_ = self.row.get() if self.row.exists() else (None, False)
        if last is not None and pd.Timestamp(last) >= newest:
            yield pd.DataFrame([], columns=["key", "at", "verdict"])
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(newest.timestamp() * 1000) + self.limit_s * 1000)
        self.row.update((newest.to_pydatetime(), False))
        # a batch's rows come before its timers: a gap that this row ends is told here
        missed = last is not None and not open_ and (newest - pd.Timestamp(last)).total_seconds() > self.limit_s
        told = [(key[0], pd.Timestamp(last) + pd.Timedelta(seconds=self.limit_s), "alert")] if missed else []
        yield pd.DataFrame(told + ([(key[0], newest, "recovered")] if open_ or missed else []), columns=["key", "at", "verdict"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, _ = self.row.get()
        self.row.update((last, True))
        yield pd.DataFrame([(key[0], pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"), "alert")], columns=["key", "at", "verdict"])

    def close(self) -> None:
        pass


def upserts(captures: DataFrame) -> DataFrame:
    """Outcomes of a stream of captures: key, at, seq, rank, text, posted_at, author_id."""
    rows = captures.withColumn("same", comparable(F.col("text"))).withColumn("rank", F.col("rank").cast("int"))
    return rows.groupBy("key").transformWithStateInPandas(Upserts(), UPSERTS, "Update", "None")


def alerts(events: DataFrame, window_s: int) -> DataFrame:
    """The events (key, at) that raise an alert."""
    return events.select("key", "at").groupBy("key").transformWithStateInPandas(Alerts(window_s), ALERTS, "Append", "None")


def silence(visits: DataFrame, limit_s: int, late: str = "10 minutes") -> DataFrame:
    """alert and recovered verdicts from a stream of ok visits (key, at), in event time."""
    return visits.select("key", "at").withWatermark("at", late).groupBy("key").transformWithStateInPandas(Silence(limit_s), SILENCE, "Append", "EventTime")


def topic_volume(posts: DataFrame, zone: str, late: str = "24 hours") -> DataFrame:
    """Posts by topic, hour and tone, updated as they come; hours older than the watermark are closed. The local day comes from the hour."""
    counted = posts.withWatermark("at", late).groupBy("topic", F.window("at", "1 hour").alias("w")).agg(F.count("*").alias("posts"), *[F.count_if(F.col("sentiment") == s).alias(s) for s in ("neg", "neu", "pos")])
    hour = F.col("w.start")
    return counted.select("topic", hour.alias("hour"), local_start("day", hour, zone).alias("day"), "posts", "neg", "neu", "pos")


def feed_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Posts of feed bodies as files arrive in a folder."""
    from postmill.sources.feeds import feed_connector

    bodies = spark.readStream.format("text").option("wholetext", True).load(folder)
    return feed_connector(bodies.select(F.col("_metadata.file_path").alias("feed_url"), F.col("value").alias("body")))


TOLD = "notifier_id string, watch_id string, id bigint, at timestamp, status string, batch_kind string"


class Batches(StatefulProcessor):
    """What a notifier, watch and kind of batch waits with: at the first due time all of it goes together; what comes later begins anew.

    Rows without a kind come with the status that the schedule gave them: sent or suppressed at once, or held until they are due.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at timestamp")
        self.held = handle.getMapState("held", "id bigint", "at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        told = []
        for r in _ordered(rows, ["at", "id"]).itertuples():
            if r.status != "pending":
                told.append((*key[:2], r.id, r.at, r.status, None))
                continue
            self.held.updateValue((r.id,), (r.due.to_pydatetime(),))
            if key[2] == "":  # each on its own
                self.handle.registerTimer(int(r.due.timestamp() * 1000))
            elif not self.due.exists() or pd.Timestamp(self.due.get()[0]) > r.due:  # the earliest of the batch counts
                self.due.update((r.due.to_pydatetime(),))
                self.handle.registerTimer(int(r.due.timestamp() * 1000))
        yield pd.DataFrame(told, columns=_names(TOLD))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        if key[2] != "" and (not self.due.exists() or pd.Timestamp(self.due.get()[0]) > now):
            yield pd.DataFrame([], columns=_names(TOLD))  # an earlier row of the batch has taken all along
            return
        going = [i for (i,), (at,) in self.held.iterator() if key[2] != "" or pd.Timestamp(at) <= now]
        for i in going:
            self.held.removeKey((i,))
        if self.due.exists():
            self.due.clear()
        yield pd.DataFrame([(*key[:2], i, now, "sent", key[2] or None) for i in sorted(going)], columns=_names(TOLD))

    def close(self) -> None:
        pass


def _names(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(",")]


def notifications(rows: DataFrame, zone: str, default_every_min: int, late: str = "1 minute") -> DataFrame:
    """Notifications of a stream as they go out: TOLD rows. Each is scheduled when it comes, as lifecycle.schedule says, and fanned out to its notifiers.

    rows: id, at (event time), notifiers (array), watch_id, watches, mode, every_min, next_attempt_at, matched_at. Times of batches, ends of quiet
    hours and retries are timers in event time, so they fire once the watermark passes them, also after a restart.
    """
    planned = step_of(F.col("at").cast("timestamp_ntz"), zone, default_every_min)
    ready = rows.select("id", "at", "notifiers", "watch_id", planned.alias("s")).withWatermark("at", late).select("id", "at", F.explode("notifiers").alias("notifier_id"), "watch_id", "s")
    status = F.when(F.col("s.status") == "send", "sent").otherwise(F.col("s.status"))
    ready = ready.select("id", "at", "notifier_id", "watch_id", status.alias("status"), F.col("s.next_attempt_at").cast("timestamp").alias("due"), F.coalesce("s.batch_kind", F.lit("")).alias("batch_kind"))
    return ready.groupBy("notifier_id", "watch_id", "batch_kind").transformWithStateInPandas(Batches(), TOLD, "Append", "EventTime")
