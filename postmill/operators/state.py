"""Upserts, notifications, health and retention as folds over ordered rows. postmill.streaming keeps the same state for streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.functions.text import comparable
from postmill.functions.times import seconds


def capture_outcomes(captures: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """captures with outcome: accepted (the first of its key), upgraded or edited (another comparable text of higher or equal rank), or duplicate.

    A capture of lower rank than the best so far changes no text. Texts that differ in case, blanks, emoji or characters of
    no width are the same.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    best = F.max("rank").over(w.rowsBetween(W.unboundedPreceding, 0))
    counted = captures.withColumn("same", comparable(F.col("text"))).withColumn("counts", F.col("rank") >= best)
    shown = counted.withColumn("old", F.last(F.when(F.col("counts"), F.struct("same", "rank")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    changed = F.col("counts") & ~F.col("old.same").eqNullSafe(F.col("same"))
    outcome = F.when(F.col("old").isNull(), "accepted").when(changed & (F.col("old.rank") == F.col("rank")), "edited").when(changed, "upgraded").otherwise("duplicate")
    return shown.withColumn("outcome", outcome).drop("same", "counts", "old")


def upsert(captures: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The stored row of each key after all captures in order: rank, text, edits, posted_at, author_id, number of captures.

    The text is that of the last capture that was accepted, upgraded or edited; only edits are counted. posted_at and
    author_id are the first that were given.
    """
    at = F.struct(*order)
    wrote = F.col("outcome") != "duplicate"
    return capture_outcomes(captures, keys, order).groupBy(*keys).agg(
        F.max("rank").alias("rank"),
        F.max_by(F.when(wrote, F.col("text")), F.when(wrote, at)).alias("text"),
        F.count_if(F.col("outcome") == "edited").alias("edits"),
        F.min_by("posted_at", F.when(F.col("posted_at").isNotNull(), at)).alias("posted_at"),
        F.min_by("author_id", F.when(F.col("author_id").isNotNull(), at)).alias("author_id"),
        F.count("*").alias("captures"),
    )


def revisions(captures: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The texts that an edit superseded, with their number: keys, revision, text."""
    wrote = capture_outcomes(captures, keys, order).where("outcome <> 'duplicate'")
    w = W.partitionBy(*keys).orderBy(*order)
    edited = wrote.withColumn("before", F.lag("text").over(w)).where("outcome = 'edited'")
    return edited.withColumn("revision", F.row_number().over(w)).select(*keys, "revision", F.col("before").alias("text"))


def ingest_counters(outcomes: DataFrame, batch: str) -> DataFrame:
    """Per batch how many captures were accepted, updated and duplicates."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return outcomes.groupBy(batch).agg(n("accepted").alias("accepted"), n("edited", "upgraded").alias("updated"), n("duplicate").alias("duplicates"))


def merge_visits(reports: DataFrame) -> DataFrame:
    """One row per visit from its reports: the least start, of the others the last that is given."""
    order = F.struct("reported_at", "line")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return reports.groupBy("id").agg(F.min("started_at").alias("started_at"), last("outcome"), last("posts_new"))


def primary_notifications(rows: DataFrame) -> DataFrame:
    """Of notifications for one post and user one is primary: a sent one first, then the least line; the others are merged into it."""
    w = W.partitionBy("post_id", "user_id").orderBy(F.when(F.col("status") == "sent", 0).otherwise(1), "line")
    return rows.withColumn("primary_line", F.first("line").over(w)).withColumn("merged", F.col("line") != F.col("primary_line"))


def status_of_match(notifications: DataFrame) -> DataFrame:
    """By match: sent if all are, failed if all are, pending if all are, else partial."""
    n = F.count("*")
    is_ = lambda s: F.count_if(F.col("status") == s)
    return notifications.groupBy("match_id").agg(F.when(is_("sent") == n, "sent").when(is_("failed") == n, "failed").when(is_("pending") == n, "pending").otherwise("partial").alias("status"), n.alias("n"))


#: Fixed: seconds before each next attempt.
DELAYS = (5, 30, 120, 600, 1800)


def retry(attempts: Column, retryable: Column, now: Column) -> Column:
    """What a failed attempt becomes: failed for good, or pending with the next time. attempts counts the one that failed."""
    delay = F.element_at(F.array(*map(F.lit, DELAYS)), attempts.cast("int"))
    more = retryable & (attempts <= len(DELAYS))
    return F.struct(F.when(more, "pending").otherwise("failed").alias("status"), F.when(more, F.timestamp_add("SECOND", delay, now)).alias("next_attempt_at"))


def gaps(visits: DataFrame, interval_s: int, factor: float, grace_s: int) -> DataFrame:
    """Ok visits of a source that came later after the one before than factor times the interval and the grace: gap and its start."""
    ok = visits.where("outcome = 'ok'")
    w = W.partitionBy("source_id").orderBy("started_at", "id")
    out = ok.select("id", "source_id", F.lag("started_at").over(w).alias("from_at"), F.col("started_at").alias("to_at"))
    return out.withColumn("gap_s", seconds("to_at") - seconds("from_at")).where(F.col("gap_s") > factor * interval_s + grace_s)


def backoff(failures: Column, base_s: int, most_s: int, retry_after_s: Column) -> Column:
    """Seconds until the next try: base doubled by each failure, at least what the server asked for, at most the limit."""
    return F.least(F.greatest(base_s * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(30))), F.coalesce(retry_after_s, F.lit(0))), F.lit(most_s)).cast("bigint")


def reconcile(posts: DataFrame, live: DataFrame, now: Column, stale_s: int, attempts: int) -> DataFrame:
    """Posts in a pending state for longer than stale_s and without a live job: requeue, or failed once attempts are used up."""
    old = posts.where((F.col("state") == "pending") & (seconds(now) - seconds("updated_at") > stale_s))
    return old.join(live.select("id").distinct(), "id", "left_anti").select("id", F.when(F.col("attempts") >= attempts, "fail").otherwise("requeue").alias("action"))


def retained(rows: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows not older than so many days."""
    return rows.where(F.col(ts) >= now - F.expr(f"interval {days} days"))


def sustained(depths: DataFrame, over: int, for_s: int) -> DataFrame:
    """Samples (key, ts, depth) at which the depth has been above a limit without a break for at least for_s seconds."""
    w = W.partitionBy("key").orderBy("ts")
    runs = depths.withColumn("high", F.col("depth") > over).withColumn("run", F.count_if(~F.col("high")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    own = W.partitionBy("key", "run", "high").orderBy("ts")
    return runs.where("high").withColumn("held_s", seconds("ts") - seconds(F.min("ts").over(own))).where(F.col("held_s") >= for_s).select("key", "ts", "depth", "held_s")
