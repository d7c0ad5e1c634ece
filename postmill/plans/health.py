"""Queries on visits, coverage and the states of sources, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators import health, peers, prices
from postmill.plans.catalog import query
from postmill.sources import bridge as B
from postmill.sources.bridge import POSTS, SOURCES, VISITS_HOURLY, ZONE, views

NOW = "2024-01-22 10:20:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def _hours(spark: SparkSession) -> DataFrame:
    return spark.sql("select explode(sequence(timestamp_ntz'2024-01-20 00:00:00', timestamp_ntz'2024-01-22 10:00:00', interval 1 hour)) as ts")


COVERAGE = f""", hours as (select unnest(generate_series(timestamp '2024-01-20', timestamp '2024-01-22 10:00:00', interval 1 hour)) as ts),
minutes as (select ts, ts + to_minutes(m) as t from hours, range(0, 60) r(m)),
active as (select ts, 60 * count(*) filter (t < timestamp '{NOW}' and strftime(t + interval 7 hours, '%H:%M') >= '07:00' and strftime(t + interval 7 hours, '%H:%M') < '23:00') as s from minutes group by 1),
spine as (select source_id, ts, case when status = 'paused' then 0.0::double else floor(100 * s / coalesce(interval_s, 900)::double + 0.5) / 100 end as visits_expected from sources, active),
done as (select source_id, date_trunc('hour', started_at) as ts, count(*) as visits_ok, count(*) filter (complete) as visits_complete from visits where outcome = 'ok' group by all),
new as (select source_id, date_trunc('hour', first_seen_at) as ts, count(*) as posts_new from posts group by all),
covered as (select source_id, ts, visits_expected, coalesce(visits_ok, 0) as visits_ok, coalesce(visits_complete, 0) as visits_complete, coalesce(posts_new, 0) as posts_new
  from spine left join done using (source_id, ts) left join new using (source_id, ts))"""


def _covered(spark, d) -> DataFrame:
    return health.coverage(B.sources(spark, d), B.visits_hourly(spark, d), B.posts(spark, d), _hours(spark), now(), "07:00", "23:00", ZONE, 900)


@query(views(SOURCES, VISITS_HOURLY, POSTS) + COVERAGE + " select * from covered")
def coverage_hourly(spark, d):
    return _covered(spark, d)


LEVELS = f""", sums as (select source_id, sum(visits_expected) as e, sum(visits_ok) as o, sum(visits_complete) as c from covered where ts >= date_trunc('hour', timestamp '{NOW}') - interval 23 hours group by 1),
outs as (select source_id, coalesce(outcome, 'in_flight') as outcome, count(*) as n from visits where started_at > timestamp '{NOW}' - interval 24 hours group by all),
js as (select source_id, '{{' || string_agg('"' || outcome || '":' || n, ',' order by outcome) || '}}' as visits_24h from outs group by 1),
last as (select source_id, max(started_at) as last_ok from visits where outcome = 'ok' group by 1),
levels as (select source_id, status, case when e > 0 then round(least(1.0::double, o / e), 6) end as coverage_ok, case when e > 0 then round(least(1.0::double, c / e), 6) end as coverage_complete,
  cast(floor(epoch(timestamp '{NOW}')) - floor(epoch(last_ok)) as bigint) as seconds_since_ok, coalesce(visits_24h, '{{}}') as visits_24h
  from sources left join sums using (source_id) left join js using (source_id) left join last using (source_id))"""


@query(views(SOURCES, VISITS_HOURLY, POSTS) + COVERAGE + LEVELS + " select * from levels")
def slo_ratio(spark, d):
    return health.service_levels(B.sources(spark, d), _covered(spark, d), B.visits_hourly(spark, d), now())


STATE = """case when status = 'paused' then 'paused' when status = 'paused_by_health' then 'down' when health_ok = false then case when age_s <= 43200 then 'down' else 'stale' end
  when coverage_ok is null then 'unknown' when coverage_ok < 0.98 then 'degraded' else 'ok' end as state"""


@query(views(SOURCES) + f"select source_id, {STATE} from sources")
def source_health(spark, d):
    return B.sources(spark, d).select("source_id", health.health_state(F.col("status"), F.col("health_ok"), F.col("coverage_ok"), F.col("age_s")).alias("state"))


@query(views(SOURCES) + f""", leaves as (select *, {STATE} from sources),
u as (select platform, topic, region, grouping(platform, topic, region) as gid, count(*) as sources, count(*) filter (state = 'ok') as n_ok, count(*) filter (state = 'degraded') as n_degraded, count(*) filter (state = 'down') as n_down,
  count(*) filter (state = 'paused') as n_paused, count(*) filter (state = 'unknown') as n_unknown, count(*) filter (state = 'stale') as n_stale, count(*) filter (state <> 'paused') as live,
  count(*) filter (state <> 'paused' and seconds_since_ok is not null) as visited, count(*) filter (state <> 'paused' and seconds_since_ok > 43200) as late,
  round(avg(coverage_ok), 9) as coverage_ok, round(avg(coverage_complete), 9) as coverage_complete, max(seconds_since_ok) as max_seconds_since_ok, cast(sum(posts7d) as bigint) as posts7d, cast(sum(matched7d) as bigint) as matched7d
  from leaves group by rollup (platform, topic, region))
select * exclude (live, visited, late), case when live = 0 then 'paused' when 2 * n_down >= live then 'down' when visited > 0 and late = visited then 'down' when n_down + n_degraded > 0 then 'degraded' when n_ok > 0 then 'ok' else 'unknown' end as worst,
  case when posts7d > 0 then round(matched7d / posts7d, 6) end as relevance7d from u""")
def source_tree_rollup(spark, d):
    s = B.sources(spark, d)
    return health.tree_rollup(s.withColumn("state", health.health_state(F.col("status"), F.col("health_ok"), F.col("coverage_ok"), F.col("age_s"))))


@query("with recursive " + POSTS + """, e as (select author_id, first_seen_at, id, cast(floor(epoch(first_seen_at)) as bigint) as sec from posts where kind = 'error'),
first as (select author_id, min((first_seen_at, id)) as k from e group by 1),
a as (select author_id, k[1] as seen, k[2] as id, cast(floor(epoch(k[1])) as bigint) as sec from first
  union all
  select author_id, k[1], k[2], cast(floor(epoch(k[1])) as bigint) from (select e.author_id, min((e.first_seen_at, e.id)) as k from a join e on e.author_id = a.author_id and e.sec >= a.sec + 21600 group by e.author_id))
select author_id, seen as first_seen_at, id from a""")
def alert_dedupe(spark, d):
    return health.alerts(B.posts(spark, d).where("kind = 'error'"), "author_id", "first_seen_at", 21_600)


DEAL = """, r as (select *, cast(floor(epoch(first_seen_at)) as bigint) as sec from posts where enriched and price > 0),
pairs as (select a.id, a.item_id, a.price as own, b.price, row_number() over (partition by a.id order by b.sec desc, b.id desc) as back from r a join r b on a.item_id = b.item_id and b.sec >= a.sec - 2592000 and b.sec < a.sec),
peers as (select * from pairs where back <= 50),
q as (select id, item_id, own, count(*) as raw, quantile_cont(price, 0.25) as q1, quantile_cont(price, 0.75) as q3 from peers group by all having count(*) >= 5),
s as (select q.id, q.item_id, q.own as price, count(*) as n, floor(quantile_cont(p.price, 0.5) + 0.5) as median from q join peers p on p.id = q.id
  where q3 = q1 or p.price between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) group by all)
select id, item_id, price, n, cast(median as bigint) as median, floor(round(1000 * (price - median) / median, 6) + 0.5) / 10 as pct from s where n >= 5 and median > 0"""


@query(views(POSTS) + DEAL)
def deal_score(spark, d):
    return prices.deal_scores(B.posts(spark, d), 30, 5, 50)


SCOPED = """, s as (select id, epoch(first_seen_at) as sec, price, case when id % 2 = 1 then item_id end as item, category_id as cat, source_id as src, team, case when id % 7 <> 0 then author_id % 6 end as size, id % 11 <> 0 as ok from posts where intent = 'sell' and price is not null),
pairs as (select a.id, a.price as own, case when a.item is not null then 'i:' || a.item when a.cat = 3 then 'c:3' else 'c:r' end as scope, b.price, row_number() over (partition by a.id order by b.sec desc, b.price desc) as back
  from s a join s b on b.ok and b.price > 0 and b.sec >= a.sec - 2592000 and b.sec < a.sec and case when a.item is not null then b.item = a.item when a.cat = 3 then b.cat = 3 else true end
    and b.src = a.src and (a.cat <> 3 or b.team = a.team) and (a.size is null or abs(b.size - a.size) <= 1)),
peers as (select * from pairs where back <= 40),
q as (select id, own, scope, quantile_cont(price, 0.25) as q1, quantile_cont(price, 0.75) as q3 from peers group by all having count(*) >= 5),
m as (select q.id, q.scope, q.own as price, count(*) as n, floor(quantile_cont(p.price, 0.5) + 0.5) as median from q join peers p on p.id = q.id where q3 = q1 or p.price between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) group by all)
select id, scope, price, n, cast(median as bigint) as median, floor(round(1000 * (price - median) / median, 6) + 0.5) / 10 as pct from m where n >= 5 and median > 0"""


@query(views(POSTS) + SCOPED)
def deal_score_by_scope(spark, d):
    """Peers by item or by the subtree of the category that declares the schema, with equal attributes and one within a tolerance."""
    text = lambda c: F.col(c).cast("string")
    held = F.map_from_arrays(F.array(F.lit("src"), F.lit("team"), F.lit("size")), F.array(text("source_id"), text("team"), F.when(F.col("id") % 7 != 0, (F.col("author_id") % 6).cast("string"))))
    posts = B.posts(spark, d).select(
        "id", F.col("first_seen_at").alias("at"), F.when(F.col("id") % 2 == 1, F.col("item_id")).alias("item_id"), text("category_id").alias("category_id"), "intent", "price", (F.col("id") % 11 != 0).alias("comparable"), F.map_filter(held, lambda k, v: v.isNotNull()).alias("attributes")
    )
    categories = spark.createDataFrame([("r", "r")] + [(str(i), f"r.{i}") for i in range(10)], "category_id string, path string")
    declared = spark.createDataFrame([("r", "src", True, False, None), ("r", "size", True, True, 1.0), ("3", "team", True, False, None)], "category_id string, key string, key_attr boolean, optional boolean, tolerance double")
    return peers.scored_by_scope(posts, categories, declared, 30, 5, 40)
