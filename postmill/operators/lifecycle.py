"""What jobs do to posts, notifications and sources between runs: pipeline states, schedules, sweeps, health transitions, backfills, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.functions.times import seconds

#: Fixed: days that rows of each table are kept.
RETENTION_DAYS = {"post_revision": 90, "notification": 180, "match": 180, "visit": 30, "thumb": 90}
BLOCK_PAIR_S = 30 * 60


def quiet_until(start: Column, end: Column, now: Column, zone: str) -> Column:
    """When the quiet hours end that ``now`` (UTC) lies in, by the zone's wall clock (HH:mm; equal ends: never quiet); null outside them."""
    local = F.from_utc_timestamp(now, zone)
    clock = F.date_format(local, "HH:mm")
    quiet = F.when(start == end, False).when(start < end, (clock >= start) & (clock < end)).otherwise((clock >= start) | (clock < end))
    day = F.date_trunc("day", local)
    minutes = F.substring(end, 1, 2).cast("int") * 60 + F.substring(end, 4, 2).cast("int")
    at = F.timestamp_add("MINUTE", minutes, day)
    return F.when(quiet, F.to_utc_timestamp(F.when(at > local, at).otherwise(F.timestamp_add("DAY", F.lit(1), at)), zone).cast("timestamp_ntz"))


def step_of(now: Column, zone: str, default_every_min: int) -> Column:
    """(status, next_attempt_at, batch_kind) of a pending notification at ``now``; see schedule."""
    muted = (F.size("watches") > 0) & F.forall("watches", lambda w: F.coalesce(w["muted_until"] > now, F.lit(False)))
    until = F.array_max(F.transform("watches", lambda w: quiet_until(w["quiet_start"], w["quiet_end"], now, zone)))
    later = F.timestamp_add("MINUTE", F.coalesce("every_min", F.lit(default_every_min)), F.coalesce("matched_at", now))
    waits = F.col("next_attempt_at").isNotNull()
    made = lambda status, at, kind: F.named_struct(F.lit("status"), F.lit(status), F.lit("next_attempt_at"), at.cast("timestamp_ntz"), F.lit("batch_kind"), F.lit(kind).cast("string"))
    return (
        F.when(muted, made("suppressed", F.col("next_attempt_at"), None))
        .when(until.isNotNull(), made("pending", until, "quiet"))
        .when((F.col("mode") == "digest") & ~waits, made("pending", later, "accumulate"))
        .when((F.col("mode") == "digest") | (F.col("next_attempt_at") > now), made("pending", F.col("next_attempt_at"), None))
        .otherwise(made("send", F.col("next_attempt_at"), None))
    )


def schedule(rows: DataFrame, now: Column, zone: str, default_every_min: int) -> DataFrame:
    """What becomes of pending notifications: suppressed (all feeding watches muted), deferred to the latest end of quiet hours, batched for a digest once, held until due, or sent.

    rows: id, watches (array of structs muted_until, quiet_start, quiet_end), mode, every_min, next_attempt_at, matched_at.
    """
    return rows.select("id", step_of(now, zone, default_every_min).alias("s")).select("id", "s.*")


def digest_flush(rows: DataFrame, now: Column) -> DataFrame:
    """The pending rows that go out now. rows: id, notifier_id, watch_id, batch_kind (null: on its own), attempts, next_attempt_at.

    A batch of a notifier, watch and kind goes once the earliest of its never-tried rows is due, all of these together, with
    retried rows that are due; else only due retried rows. Rows on their own go when due.
    """
    due = F.col("next_attempt_at") <= now
    w = W.partitionBy("notifier_id", "watch_id", "batch_kind")
    first = F.min(F.when(F.col("attempts") == 0, F.col("next_attempt_at"))).over(w)
    batch = rows.where("batch_kind is not null").withColumn("first", first).where(F.when((F.col("first") <= now) & (F.col("attempts") == 0), True).otherwise(due & (F.col("attempts") > 0))).drop("first")
    return batch.unionByName(rows.where("batch_kind is null").where(due)).select("id", "notifier_id", "watch_id", "batch_kind")


def stuck_claims(matches: DataFrame, notifications: DataFrame, now: Column, stale_min: int, max_days: int) -> DataFrame:
    """Ids of matches that were taken up too long ago and have no notification yet."""
    old = (F.col("claimed_at") < now - F.expr(f"interval {stale_min} minutes")) & (F.col("created_at") > now - F.expr(f"interval {max_days} days"))
    return matches.where(old).join(notifications.select(F.col("match_id").alias("id")), "id", "left_anti").select("id")


def reset_sending(rows: DataFrame, now: Column, stale_min: int) -> DataFrame:
    """Notifications; those in sending for too long become pending and due now."""
    stuck = (F.col("status") == "sending") & F.coalesce(F.col("sending_at") < now - F.expr(f"interval {stale_min} minutes"), F.lit(False))
    return rows.withColumns({"next_attempt_at": F.when(stuck, now).otherwise(F.col("next_attempt_at")), "status": F.when(stuck, "pending").otherwise(F.col("status"))})


def advance(posts: DataFrame, events: DataFrame) -> DataFrame:
    """Posts after the events of their pipeline: enrich pending, then done or failed; match pending once enriched, then done. An event of an older version of the post does nothing.

    posts: id, version; events: id, version, stage (enrich, match), result (done, failed). A failed enrichment is still matched.
    """
    own = events.join(posts, ["id", "version"])
    of = lambda stage: F.max(F.when(F.col("stage") == stage, F.when(F.col("result") == "done", 2).otherwise(1)))
    sums = own.groupBy("id").agg(of("enrich").alias("e"), of("match").alias("m"))
    name = lambda c: F.when(F.col(c) == 2, "done").when(F.col(c) == 1, "failed").otherwise("pending")
    return posts.join(sums, "id", "left").select("id", "version", name("e").alias("enrich_state"), F.when(F.col("e").isNull(), "waiting").otherwise(name("m")).alias("match_state"))


def health_transitions(visits: DataFrame) -> DataFrame:
    """Per finished visit in order of time what it does to its source: paused (blocked right after a blocked one within BLOCK_PAIR_S, if active), resumed (ok, if paused), else null; and the state after it.

    visits: id, source_id, finished_at, outcome; skipped ones and those without outcome count for nothing.
    """
    w = W.partitionBy("source_id").orderBy("finished_at", "id")
    done = visits.where("outcome is not null and outcome <> 'skipped'")
    pair = (F.col("outcome") == "blocked") & (F.lag("outcome").over(w) == "blocked") & (seconds("finished_at") - seconds(F.lag("finished_at").over(w)) <= BLOCK_PAIR_S)
    marked = done.withColumn("sets", F.when(F.coalesce(pair, F.lit(False)), "paused").when(F.col("outcome") == "ok", "active"))
    state = F.coalesce(F.last("sets", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit("active"))
    before = F.coalesce(F.last("sets", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit("active"))
    both = marked.withColumn("state", state).withColumn("was", before)
    return both.select("id", "source_id", "outcome", F.when(F.col("state") != F.col("was"), F.when(F.col("state") == "paused", "paused").otherwise("resumed")).alias("action"), "state")


def watchdog(sources: DataFrame, now: Column, start: str, end: str, zone: str, grace_s: int, fallback_s: int) -> DataFrame:
    """Per watched source: alert, recovered or null. sources: source_id, status, interval_s, last_ok, created_at, alert_at (of the open gap).

    The gap runs from the last ok visit (or creation), but not from before today's active hours; alert at 1.5 intervals and the
    grace, once per open gap; recovered by a later ok visit, or once the gap is short again. Outside active hours nothing is new.
    """
    from postmill.functions.times import in_hours

    local = F.from_utc_timestamp(now, zone)
    opened = F.to_utc_timestamp(F.timestamp_add("MINUTE", F.lit(int(start[:2]) * 60 + int(start[3:])), F.date_trunc("day", local)), zone).cast("timestamp_ntz")
    since = F.greatest(F.coalesce("last_ok", "created_at"), opened)
    gap, limit = seconds(now) - seconds(since), 1.5 * F.coalesce("interval_s", F.lit(fallback_s)) + grace_s
    active = in_hours(now, start, end, zone)
    recovered = F.col("alert_at").isNotNull() & (F.coalesce(F.col("last_ok") > F.col("alert_at"), F.lit(False)) | (active & (gap < limit)))
    verdict = F.when(recovered, "recovered").when(active & F.col("alert_at").isNull() & (gap >= limit), "alert")
    return sources.where(F.col("status").isin("active", "paused_by_health")).select("source_id", gap.alias("gap_s"), verdict.alias("verdict"))


def backfill_due(enrichments: DataFrame, version: int) -> DataFrame:
    """Rows whose attribute version is not the current one, none included."""
    return enrichments.where(~F.col("attr_version").eqNullSafe(F.lit(version)))


def expired(rows: DataFrame, table: str, ts: str, now: Column) -> DataFrame:
    """Rows of a table past its period in RETENTION_DAYS."""
    return rows.where(F.col(ts) < now - F.expr(f"interval {RETENTION_DAYS[table]} days"))


def curation_candidates(trend: DataFrame, aliases: DataFrame, size: int) -> DataFrame:
    """The newest terms without a verdict, greatest lift first."""
    return trend.join(aliases.select("term"), "term", "left_anti").orderBy(F.desc_nulls_last("lift"), F.desc("n"), "term").limit(size)


def plan_aliases(groups: list[dict], drop: list[str], terms: dict[str, str], blocked: frozenset[str] = frozenset()) -> list[tuple[str, str, str | None]]:
    """(key, merge|drop|keep, canonical key) from a curator's verdicts over a bounded list of terms (key to display).

    Unknown keys are ignored. A group is skipped if its canonical term shares no word with its members, is dropped or blocked,
    or is merged away by another group. Every term without a verdict is kept.
    """
    import re

    words = lambda s: {w for w in re.split(r"[^a-z0-9]+", s.lower()) if w}
    dropped, merged = {k for k in drop if k in terms}, {k for g in groups for k in g["keys"] if k in terms}
    out: dict[str, tuple[str, str | None]] = {}
    for g in groups:
        key = "".join(sorted(words(g["canonical"]), key=g["canonical"].lower().find))
        members = [k for k in g["keys"] if k in terms and k not in out]
        fits = any(k == key or words(terms[k]) & words(g["canonical"]) for k in members)
        if not members or not fits or key in dropped or key in blocked or (key in merged and key not in g["keys"]):
            continue
        out |= {k: ("merge", key) for k in members if k != key}
        out.setdefault(key, ("keep", None))
    out |= {k: ("drop", None) for k in dropped if out.get(k, ("",))[0] != "merge"}
    return [(k, *v) for k, v in (out | {k: ("keep", None) for k in terms if k not in out}).items()]
