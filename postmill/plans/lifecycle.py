"""Queries on state between runs: captures, pipeline, schedules, sweeps, health, retention, each beside its SQL or its known answers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from postmill.operators import lifecycle as L
from postmill.operators import state
from postmill.plans.catalog import query
from postmill.plans.texts import golden
from postmill.sources import bridge as B
from postmill.sources.bridge import ZONE

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
CAPTURES = """with c as (select l_orderkey % 500 as key, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_linenumber % 4 as batch, case when l_quantity > 25 then 2 else 1 end as rank, case when l_tax > 0.04 then upper(l_returnflag || l_linestatus) else lower(l_returnflag || l_linestatus) end as text,
    row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as seq from lineitem),
b as (select *, rank >= max(rank) over (partition by key order by seq rows unbounded preceding) as counts from c),
k as (select *, last_value(case when counts then lower(text) || rank end ignore nulls) over (partition by key order by seq rows between unbounded preceding and 1 preceding) as old from b),
o as (select *, case when old is null then 'accepted' when not counts or left(old, 2) = lower(text) then 'duplicate' when right(old, 1) = cast(rank as varchar) then 'edited' else 'upgraded' end as outcome from k)"""


def _captures(spark, d):
    text = F.concat("l_returnflag", "l_linestatus")
    return B.table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("key"), *ORDER, (F.col("l_linenumber") % 4).alias("batch"), F.when(F.col("l_quantity") > 25, 2).otherwise(1).alias("rank"), F.when(F.col("l_tax") > 0.04, F.upper(text)).otherwise(F.lower(text)).alias("text"))


@query(CAPTURES + " select cast(batch as integer) as batch, count(*) filter (outcome = 'accepted') as accepted, count(*) filter (outcome in ('edited', 'upgraded')) as updated, count(*) filter (outcome = 'duplicate') as duplicates from o group by 1")
def ingest_counters(spark, d):
    return state.ingest_counters(state.capture_outcomes(_captures(spark, d), ["key"], ORDER), "batch")


@query(CAPTURES + ", w as (select *, lag(text) over (partition by key order by seq) as before from o where outcome <> 'duplicate') select key, cast(row_number() over (partition by key order by seq) as integer) as revision, before as text from w where outcome = 'edited'")
def post_revisions(spark, d):
    return state.revisions(_captures(spark, d), ["key"], ORDER)


@golden("quiet_hours_end", "start string, finish string, at timestamp_ntz", "until string", [
    (("22:00", "07:00", dt.datetime(2026, 1, 1, 16, 30)), ("2026-01-02 00:00",)), (("22:00", "07:00", dt.datetime(2026, 1, 1, 23, 0)), ("2026-01-02 00:00",)), (("12:00", "13:30", dt.datetime(2026, 1, 1, 5, 15)), ("2026-01-01 06:30",)),
    (("12:00", "13:30", dt.datetime(2026, 1, 1, 6, 30)), (None,)), (("08:00", "08:00", dt.datetime(2026, 1, 1, 1, 0)), (None,)),
])
def _quiet(df):
    return df.withColumn("until", F.date_format(L.quiet_until(F.col("start"), F.col("finish"), F.col("at"), ZONE), "yyyy-MM-dd HH:mm"))


NIGHT = dt.datetime(2026, 1, 1, 16, 30)  # 23:30 in the zone


@golden("notify_schedule", "muted timestamp_ntz, quiet_start string, quiet_end string, mode string, every_min int, next_attempt_at timestamp_ntz", "status string, next_at string, batch_kind string", [
    ((dt.datetime(2030, 1, 1), None, None, "instant", None, None), ("suppressed", None, None)), ((None, "22:00", "07:00", "instant", None, None), ("pending", "2026-01-02 00:00", "quiet")), ((None, None, None, "digest", 30, None), ("pending", "2026-01-01 16:50", "accumulate")),
    ((None, None, None, "digest", 30, dt.datetime(2026, 1, 1, 18)), ("pending", "2026-01-01 18:00", None)), ((None, None, None, "instant", None, dt.datetime(2026, 1, 1, 18)), ("pending", "2026-01-01 18:00", None)), ((None, None, None, "instant", None, dt.datetime(2026, 1, 1, 16)), ("send", "2026-01-01 16:00", None)), ((None, None, None, "instant", None, None), ("send", None, None)),
])
def _schedule(df):
    rows = df.withColumn("watches", F.array(F.struct(F.col("muted").alias("muted_until"), "quiet_start", "quiet_end"))).withColumn("matched_at", F.lit(dt.datetime(2026, 1, 1, 16, 20)).cast("timestamp_ntz"))
    return L.schedule(rows, F.lit(NIGHT).cast("timestamp_ntz"), ZONE, 60).withColumn("next_at", F.date_format("next_attempt_at", "yyyy-MM-dd HH:mm"))


@query("""with n as (select l_orderkey * 10 + l_linenumber as id, l_suppkey % 20 as notifier_id, l_partkey % 5 as watch_id, case l_returnflag when 'A' then 'quiet' when 'R' then 'accumulate' end as batch_kind, case when l_quantity > 30 then 1 else 0 end as attempts, l_shipdate as due_at, l_extendedprice as price from lineitem),
w as (select *, min(due_at) filter (attempts = 0) over (partition by notifier_id, watch_id, batch_kind) as first from n where batch_kind is not null)
select id, notifier_id, watch_id, batch_kind, price from w where (first <= timestamp '1998-01-01' and attempts = 0) or (due_at <= timestamp '1998-01-01' and attempts > 0) union all select id, notifier_id, watch_id, batch_kind, price from n where batch_kind is null and due_at <= timestamp '1998-01-01'""")
def digest_flush(spark, d):
    rows = B.table(spark, d, "lineitem").select(F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("price")).alias("id"), (F.col("l_suppkey") % 20).alias("notifier_id"), (F.col("l_partkey") % 5).alias("watch_id"), F.when(F.col("l_returnflag") == "A", "quiet").when(F.col("l_returnflag") == "R", "accumulate").alias("batch_kind"), F.when(F.col("l_quantity") > 30, 1).otherwise(0).alias("attempts"), F.col("l_shipdate").alias("next_attempt_at"))
    return L.digest_flush(rows, F.lit("1998-01-01").cast("timestamp_ntz")).select("id.id", "notifier_id", "watch_id", "batch_kind", "id.price")


@query("select o_orderkey as id from orders where o_custkey % 4 <> 0 and o_orderdate < timestamp '1998-01-01' - interval 5 minutes and o_orderdate > timestamp '1998-01-01' - interval 300 days and o_orderkey not in (select l_orderkey from lineitem)")
def stuck_claims(spark, d):
    m = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_orderdate")).alias("claimed_at"))
    return L.stuck_claims(m, B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("match_id")), F.lit("1998-01-01").cast("timestamp_ntz"), 5, 300)


@query("select status, count(*) as n, count(*) filter (due) as due from (select case when l_returnflag = 'R' and l_shipdate < timestamp '1998-01-01' - interval 2 minutes then 'pending' when l_returnflag = 'R' then 'sending' else 'sent' end as status, l_returnflag = 'R' and l_shipdate < timestamp '1998-01-01' - interval 2 minutes as due from lineitem) group by 1")
def stuck_sending(spark, d):
    now = F.lit("1998-01-01").cast("timestamp_ntz")
    rows = B.table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", "sending").otherwise("sent").alias("status"), F.col("l_shipdate").alias("sending_at"), F.lit(None).cast("timestamp_ntz").alias("next_attempt_at"))
    return L.reset_sending(rows, now, 2).groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("next_attempt_at").isNotNull()).alias("due"))


@query("""with p as (select o_orderkey as id, o_custkey % 3 as version from orders),
e as (select l_orderkey as id, l_suppkey % 3 as version, case when l_linenumber % 2 = 0 then 'match' else 'enrich' end as stage, case when l_returnflag = 'R' then 'failed' else 'done' end as result from lineitem),
s as (select id, max(case when stage = 'enrich' then case result when 'done' then 2 else 1 end end) as e, max(case when stage = 'match' then case result when 'done' then 2 else 1 end end) as m from e join p using (id, version) group by 1)
select id, version, case e when 2 then 'done' when 1 then 'failed' else 'pending' end as enrich_state, case when e is null then 'waiting' when m = 2 then 'done' when m = 1 then 'failed' else 'pending' end as match_state from p left join s using (id)""")
def pipeline_states(spark, d):
    posts = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 3).alias("version"))
    events = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 3).alias("version"), F.when(F.col("l_linenumber") % 2 == 0, "match").otherwise("enrich").alias("stage"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("done").alias("result"))
    return L.advance(posts, events)


@query("""with v as (select event_id as id, user_id % 40 as source_id, ts as finished_at, case event_type when 'view' then 'blocked' when 'click' then 'blocked' when 'error' then 'skipped' when 'signup' then 'ok' else 'no_slots' end as outcome from events),
d as (select *, lag(outcome) over w as before, floor(epoch(finished_at)) - floor(epoch(lag(finished_at) over w)) as gap from v where outcome <> 'skipped' window w as (partition by source_id order by finished_at, id)),
m as (select *, case when outcome = 'blocked' and before = 'blocked' and gap <= 1800 then 'paused' when outcome = 'ok' then 'active' end as sets from d),
s as (select *, coalesce(last_value(sets ignore nulls) over (partition by source_id order by finished_at, id rows unbounded preceding), 'active') as state, coalesce(last_value(sets ignore nulls) over (partition by source_id order by finished_at, id rows between unbounded preceding and 1 preceding), 'active') as was from m)
select id, source_id, outcome, case when state <> was then case state when 'paused' then 'paused' else 'resumed' end end as action, state from s""")
def health_transitions(spark, d):
    outcome = F.when(F.col("event_type").isin("view", "click"), "blocked").when(F.col("event_type") == "error", "skipped").when(F.col("event_type") == "signup", "ok").otherwise("no_slots")
    return L.health_transitions(B.table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 40).alias("source_id"), F.col("ts").alias("finished_at"), outcome.alias("outcome")))


OPEN = dt.datetime(2026, 1, 1, 3, 0)  # 10:00 in the zone


@golden("watchdog_verdicts", "status string, interval_s int, last_ok timestamp_ntz, alert_at timestamp_ntz", "gap_s bigint, verdict string", [
    (("active", 600, dt.datetime(2026, 1, 1, 2, 55), None), (300, None)), (("active", 600, dt.datetime(2026, 1, 1, 2, 0), None), (3600, "alert")), (("active", 600, dt.datetime(2025, 12, 31), None), (10800, "alert")), (("active", 600, dt.datetime(2026, 1, 1, 2, 0), dt.datetime(2026, 1, 1, 2, 30)), (3600, None)),
    (("paused_by_health", 600, dt.datetime(2026, 1, 1, 2, 40), dt.datetime(2026, 1, 1, 2, 30)), (1200, "recovered")), (("active", None, dt.datetime(2026, 1, 1, 2, 45), None), (900, None)),
])
def _watchdog(df):
    rows = df.withColumn("source_id", F.col("id")).withColumn("created_at", F.lit(dt.datetime(2025, 1, 1)).cast("timestamp_ntz"))
    return L.watchdog(rows, F.lit(OPEN).cast("timestamp_ntz"), "07:00", "23:00", ZONE, 60, 900).withColumnRenamed("source_id", "id")


@query("select event_id from events where (case when user_id % 3 <> 0 then user_id % 4 end) is distinct from 2")
def attributes_backfill(spark, d):
    rows = B.table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 4).alias("attr_version"))
    return L.backfill_due(rows, 2).select("event_id")


@query("select 'match' as name, count(*) as n from orders where o_orderdate < timestamp '2001-08-01' - interval 180 days union all select 'visit', count(*) from orders where o_orderdate < timestamp '2001-08-01' - interval 30 days union all select 'post_revision', count(*) from orders where o_orderdate < timestamp '2001-08-01' - interval 90 days")
def retention_periods(spark, d):
    o, now = B.table(spark, d, "orders"), F.lit("2001-08-01").cast("timestamp_ntz")
    counts = [L.expired(o, t, "o_orderdate", now).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("match", "visit", "post_revision")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])
