"""Coverage of expected visits, service levels, states of sources and their tree; alerts that repeat at most once a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.times import hour_of, in_hours, seconds

#: Fixed: the share of expected visits below which a source is degraded, and the age in seconds at which a failure is stale.
COVERAGE_TARGET = 0.98
STALE_AFTER_S = 12 * 3600
STATES = ("ok", "degraded", "down", "paused", "unknown", "stale")


def active_seconds(hour: Column, now: Column, start: str, end: str, zone: str) -> Column:
    """Seconds of an hour up to ``now`` whose minute lies in the active hours of the zone's wall clock."""
    minutes = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda m: F.timestamp_add("MINUTE", m, hour))
    return 60 * F.size(F.filter(minutes, lambda t: (t < now) & in_hours(t, start, end, zone)))


def coverage(sources: DataFrame, visits: DataFrame, posts: DataFrame, hours: DataFrame, now: Column, start: str, end: str, zone: str, fallback_s: int) -> DataFrame:
    """One row per source and hour: visits_expected (active seconds over the source's interval, two decimals; 0 if paused), visits_ok, visits_complete, posts_new.

    sources: source_id, status, interval_s (null: ``fallback_s``); visits: source_id, started_at, outcome, complete;
    posts: source_id, first_seen_at; hours: ts. Sources without visits have rows too.
    """
    done = visits.where("outcome = 'ok'").groupBy("source_id", hour_of("started_at").alias("ts")).agg(F.count("*").alias("visits_ok"), F.count_if("complete").alias("visits_complete"))
    new = posts.groupBy("source_id", hour_of("first_seen_at").alias("ts")).agg(F.count("*").alias("posts_new"))
    every = F.broadcast(hours.select("ts", active_seconds(F.col("ts"), now, start, end, zone).alias("active")))  # the trailing hours of one run
    expected = F.when(F.col("status") == "paused", 0.0).otherwise(F.floor(100 * F.col("active") / F.coalesce("interval_s", F.lit(fallback_s)) + 0.5) / 100)
    spine = sources.crossJoin(every).select("source_id", "ts", expected.alias("visits_expected"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return spine.join(done, ["source_id", "ts"], "left").join(new, ["source_id", "ts"], "left").select("source_id", "ts", "visits_expected", zero("visits_ok"), zero("visits_complete"), zero("posts_new"))


def service_levels(sources: DataFrame, covered: DataFrame, visits: DataFrame, now: Column) -> DataFrame:
    """Per source: ok and complete visits of the last 24 hours over those expected (at most 1, null if none was), seconds since the last ok visit, and visits by outcome as JSON."""
    since = F.date_trunc("hour", now).cast("timestamp_ntz") - F.expr("interval 23 hours")
    sums = covered.where(F.col("ts") >= since).groupBy("source_id").agg(*[F.sum(c).alias(c) for c in ("visits_expected", "visits_ok", "visits_complete")])
    ratio = lambda c: F.when(F.col("visits_expected") > 0, F.round(F.least(F.lit(1.0), F.col(c) / F.col("visits_expected")), 6))
    outcomes = visits.where(F.col("started_at") > now - F.expr("interval 24 hours")).groupBy("source_id", F.coalesce("outcome", F.lit("in_flight")).alias("outcome")).agg(F.count("*").alias("n"))
    by_outcome = outcomes.groupBy("source_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n"))))).alias("visits_24h"))
    last = visits.where("outcome = 'ok'").groupBy("source_id").agg(F.max("started_at").alias("last_ok"))
    return sources.join(sums, "source_id", "left").join(by_outcome, "source_id", "left").join(last, "source_id", "left").select(
        "source_id", "status", ratio("visits_ok").alias("coverage_ok"), ratio("visits_complete").alias("coverage_complete"), (seconds(now) - seconds("last_ok")).alias("seconds_since_ok"), F.coalesce("visits_24h", F.lit("{}")).alias("visits_24h")
    )


def health_state(status: Column, health_ok: Column, coverage_ok: Column, age_s: Column) -> Column:
    """paused, down, stale, unknown, degraded or ok; a failure counts as down while it is recent, else as stale."""
    return (
        F.when(status == "paused", "paused")
        .when(status == "paused_by_health", "down")
        .when(~health_ok, F.when(age_s <= STALE_AFTER_S, "down").otherwise("stale"))
        .when(coverage_ok.isNull(), "unknown")
        .when(coverage_ok < COVERAGE_TARGET, "degraded")
        .otherwise("ok")
    )


def tree_rollup(leaves: DataFrame) -> DataFrame:
    """Every node of platform, topic and region: numbers of sources by state, the state of the node, means without nulls, the longest wait, 7-day posts.

    leaves: platform, topic, region, state, coverage_ok, coverage_complete, seconds_since_ok, posts7d, matched7d. A node is down
    if at least half of its live sources are, or all that were ever visited wait too long; degraded if any is down or degraded.
    """
    n = lambda s: F.count_if(F.col("state") == s)
    live = F.count_if(F.col("state") != "paused")
    visited = (F.col("state") != "paused") & F.col("seconds_since_ok").isNotNull()
    late = F.count_if(visited & (F.col("seconds_since_ok") > STALE_AFTER_S))
    worst = (
        F.when(live == 0, F.when(F.count("*") > 0, "paused").otherwise("unknown"))
        .when(2 * n("down") >= live, "down")
        .when((F.count_if(visited) > 0) & (late == F.count_if(visited)), "down")
        .when(n("down") + n("degraded") > 0, "degraded")
        .when(n("ok") > 0, "ok")
        .otherwise("unknown")
    )
    out = leaves.rollup("platform", "topic", "region").agg(
        F.grouping_id().cast("bigint").alias("gid"), F.count("*").alias("sources"), worst.alias("worst"), *[n(s).alias(f"n_{s}") for s in STATES],
        F.round(F.avg("coverage_ok"), 9).alias("coverage_ok"), F.round(F.avg("coverage_complete"), 9).alias("coverage_complete"), F.max("seconds_since_ok").alias("max_seconds_since_ok"),
        F.sum("posts7d").alias("posts7d"), F.sum("matched7d").alias("matched7d"),
    )
    return out.withColumn("relevance7d", F.when(F.col("posts7d") > 0, F.round(F.col("matched7d") / F.col("posts7d"), 6)))


def alerts(events: DataFrame, key: str, ts: str, window_s: int, tie: str = "id") -> DataFrame:
    """Events that raise an alert: at least ``window_s`` seconds after the key's last alert, not after its last event.

    An event that far from the event before raises one in any case, so the runs between such events are folded apart,
    as an array of times and ids: what a task holds is the longest run without a pause of a window.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(ts, tie)
    far = seconds(ts) - seconds(F.lag(ts).over(w)) >= window_s
    runs = events.withColumn("run", F.count_if(F.coalesce(far, F.lit(True))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    held = runs.groupBy(key, "run").agg(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("at"), F.col(tie).alias("id")))).alias("held"))
    none = F.filter("held", lambda e: F.lit(False))
    kept = F.aggregate("held", none, lambda a, e: F.when((F.size(a) == 0) | (seconds(e["at"]) - seconds(F.element_at(a, -1)["at"]) >= window_s), F.array_append(a, e)).otherwise(a))
    return held.select(key, F.explode(kept).alias("e")).select(key, F.col("e.at").alias(ts), F.col("e.id").alias(tie))
