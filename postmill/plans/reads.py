"""Queries of the read endpoints, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.times import hour_of
from postmill.operators import reads, trends
from postmill.plans import catalog as C
from postmill.plans.catalog import query
from postmill.sources import bridge as B
from postmill.sources.bridge import MATCHES, NOTIFICATIONS, POSTS, SOURCES, VISITS, views

NOW = "2024-01-25 00:00:00"
ENRICHED = "enrichments as (select id, intent, price, category_id, item_id from posts where enriched)"
ITEMS = "items as (select p_partkey as item_id, p_name as item_name, p_brand as brand from part)"
WATCHES = "watches as (select c_custkey as watch_id, c_name as watch_name, c_mktsegment as segment from customer)"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def _enriched(posts: DataFrame) -> DataFrame:
    return posts.where("enriched").select("id", "intent", "price", "category_id", "item_id")


def _watches(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "customer").select(F.col("c_custkey").alias("watch_id"), F.col("c_name").alias("watch_name"), F.col("c_mktsegment").alias("segment"))


@query(views(POSTS, SOURCES, ENRICHED, ITEMS) + "select p.id, p.source_id, s.name as source_name, p.kind, e.intent, e.price, e.category_id, e.item_id, item_name, brand from posts p join sources s using (source_id) left join enrichments e on e.id = p.id left join items i on i.item_id = e.item_id")
def post_details(spark, d):
    p = B.posts(spark, d)
    items = B.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("item_name"), F.col("p_brand").alias("brand"))
    return reads.post_details(p.select("id", "source_id", "kind"), B.sources(spark, d), _enriched(p), items)


@query(views(POSTS, SOURCES, MATCHES, ENRICHED, WATCHES) + "select m.post_id, m.watch_id, m.created_at, m.score, watch_name, segment, p.kind, p.source_id, s.name as source_name, e.intent, e.price, e.category_id, e.item_id from matches m join watches using (watch_id) join posts p on p.id = m.post_id join sources s using (source_id) left join enrichments e on e.id = m.post_id")
def inbox_star(spark, d):
    p = B.posts(spark, d)
    return reads.inbox_star(B.matches(spark, d), _watches(spark, d), p.select("id", "kind", "source_id"), B.sources(spark, d), _enriched(p))


@query(views(POSTS, MATCHES, NOTIFICATIONS, WATCHES) + "select n.match_id, n.line, n.status, n.created_at, n.amount, m.watch_id, p.kind, watch_name, segment from notifications n left join matches m on m.post_id = n.match_id left join posts p on p.id = n.match_id left join watches w on w.watch_id = m.watch_id")
def notification_log(spark, d):
    return reads.notification_log(B.notifications(spark, d), B.matches(spark, d), B.posts(spark, d), _watches(spark, d))


@query(views(POSTS, SOURCES) + "select id, source_id, team from posts where source_id in (select source_id from sources where team = 1)")
def source_scope(spark, d):
    return reads.in_scope(B.posts(spark, d), B.sources(spark, d), 1).select("id", "source_id", "team")


@query(views(POSTS, ENRICHED) + "select id, intent, case when category_id is null or id % 3 = 0 then case when intent in ('sell', 'buy') then intent else '' end else 'old' end as tags from enrichments")
def tags_backfill(spark, d):
    e = _enriched(B.posts(spark, d)).select("id", "intent", "category_id", F.array(F.lit("old")).alias("tags"))
    return reads.with_rule_tags(e, e.where("category_id is null or id % 3 = 0")).select("id", "intent", F.array_join("tags", ",").alias("tags"))


@query(views(POSTS) + """, r as (select id, fingerprint, case when price is not null then author_id || '|' || cast(round(price * 100) as bigint) end as repost_key from posts),
o as (select id, min(id) over (partition by fingerprint) as other from r where fingerprint is not null union select id, min(id) over (partition by repost_key) from r where repost_key is not null)
select distinct id, other from o where id <> other""")
def duplicates_either(spark, d):
    key = F.when(F.col("price").isNotNull(), F.concat(F.col("author_id").cast("string"), F.lit("|"), F.round(F.col("price") * 100).cast("bigint").cast("string")))
    return reads.duplicates(B.posts(spark, d).select("id", "fingerprint", key.alias("repost_key")))


@query(views(POSTS) + f""", b as (select * from posts where price is not null and first_seen_at <= timestamp '{NOW}'),
s as (select category_id, count(*) filter (a) as n7, quantile_cont(price, 0.5) filter (a) as m7, count(*) filter (b) as nprev, quantile_cont(price, 0.5) filter (b) as mprev, count(*) filter (c) as nprior, min(price) filter (c) as low
  from (select *, first_seen_at > timestamp '{NOW}' - interval 7 days as a, first_seen_at > timestamp '{NOW}' - interval 14 days and first_seen_at <= timestamp '{NOW}' - interval 7 days as b,
    first_seen_at < timestamp '{NOW}' - interval 1 day and first_seen_at >= timestamp '{NOW}' - interval 31 days as c from b) group by 1)
select category_id, n7, case when n7 >= 3 then round(m7, 6) end as median7d, nprev, case when nprev >= 3 then round(mprev, 6) end as median_prev7d, nprior, case when nprior >= 5 then round(low, 6) end as prior_min from s""")
def topic_overview(spark, d):
    return reads.overview(B.posts(spark, d), "category_id", now(), 3, 5)


CUBE = C.SQL["volume_cube_hour"].replace(
    "select * from cube where",
    "select ts, cube.team, coalesce(s.name, cast(cube.source_id as varchar)) as label, posts, unique_posts, sell, buy, other from cube left join sources s on s.source_id = cube.source_id where gid = 3 and ts between timestamp '2024-01-10' and timestamp '2024-01-12' -- ",
)


@query(CUBE.replace("with ", "with " + SOURCES + ", ", 1))
def volume_by_source(spark, d):
    names = B.sources(spark, d).select(F.col("source_id").cast("string").alias("key"), "name")
    return reads.volume_series(C.volume_cube_hour(spark, d), ["source_id"], "source_id", names, F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz"))


TREND = C.SQL["trend_24h_lift"].replace("select * from l where", "top as (select * from l where").strip()


@query(TREND.replace(" top as (", ", top as (", 1) + f""" order by lift desc, z desc, term limit 8),
slots as (select t.term, s.i, coalesce(sum(h.n), 0) as n from top t, range(0, 24) s(i) left join hist h on h.term = t.term and h.category_id is null and h.ts = timestamp '{C.HOUR}' - to_hours(23 - s.i) group by all),
j as (select term, string_agg(cast(n as varchar), ',' order by i) as sparkline from slots group by 1)
select top.*, sparkline from top join j using (term)""")
def trending_page(spark, d):
    hist, hour = C._hist(spark, d), F.lit(C.HOUR).cast("timestamp_ntz")
    return reads.trending_page(trends.day_trend(hist, hour, 3, 1.2), hist, hour, 8)


ACTIVITY = """, act as (select date_trunc('hour', first_seen_at) as ts, team, author_id, cast(null as bigint) as category_id, count(*) as posts, count(*) filter (intent = 'sell') as sell, arg_max(author_name, (first_seen_at, id)) as newest_name from posts group by all
  union all select date_trunc('hour', first_seen_at), team, author_id, category_id, count(*), count(*) filter (intent = 'sell'), arg_max(author_name, (first_seen_at, id)) from posts where category_id is not null group by all)"""


@query(views(POSTS) + ACTIVITY + " select * from act")
def author_activity_category(spark, d):
    return reads.activity_by_category(B.posts(spark, d), hour_of("first_seen_at"))


@query(views(POSTS) + ACTIVITY + """, s as (select team, author_id, cast(sum(posts) as bigint) as posts, arg_max(newest_name, ts) as newest_name from act where category_id is null group by all),
t as (select *, cast(row_number() over (partition by team order by posts desc, author_id) as integer) as place from s),
c as (select team, author_id, category_id, cast(sum(posts) as bigint) as n from act where category_id is not null group by all),
j as (select team, author_id, '{' || string_agg('"' || category_id || '":' || n, ',' order by category_id) || '}' as categories from c group by all)
select t.*, coalesce(categories, '{}') as categories from t left join j using (team, author_id) where place <= 5""")
def author_breakdown(spark, d):
    return reads.author_breakdown(reads.activity_by_category(B.posts(spark, d), hour_of("first_seen_at")), 5)


CAPTURE = "case kind when 'view' then 'api' when 'click' then 'push' when 'signup' then 'feed' end"


@query(views(POSTS) + f"select coalesce({CAPTURE}, 'unknown') as capture, count(*) as posts from posts where first_seen_at > timestamp '{NOW}' - interval 24 hours group by 1")
def posts_by_capture(spark, d):
    return reads.by_capture(B.posts(spark, d).withColumn("capture", F.expr(CAPTURE)), now())


DEALS = "deals as (select id as post_id, case when price is not null then floor(price) - 15 end as deal_pct from posts)"


@query(views(POSTS, MATCHES, WATCHES, DEALS) + """, recent as (select *, date_diff('day', cast(created_at as date), date '2001-08-01') as back from matches),
days as (select watch_id, r.i, (select count(*) from recent m where m.watch_id = w.watch_id and m.back = r.i) as n from watches w, range(0, 7) r(i)),
s as (select watch_id, string_agg(cast(n as varchar), ',' order by i desc) as daily, max(n) filter (i = 0) as today, cast(sum(n) as bigint) as total from days group by 1),
l as (select watch_id, max(created_at) as last_hit from matches group by 1),
b as (select watch_id, post_id, deal_pct, row_number() over (partition by watch_id order by deal_pct, created_at desc, post_id) as place from recent join deals using (post_id) where back between 0 and 6 and deal_pct < 0)
select s.*, last_hit, post_id as best_post_id, deal_pct as best_deal_pct from s left join l using (watch_id) left join (select * from b where place = 1) using (watch_id)""")
def watch_stats(spark, d):
    deals = B.posts(spark, d).select(F.col("id").alias("post_id"), F.when(F.col("price").isNotNull(), F.floor("price") - 15.0).alias("deal_pct"))
    return reads.watch_stats(_watches(spark, d), B.matches(spark, d), deals, F.lit("2001-08-01").cast("date"), 7)


@query(views(POSTS) + f"select team, count(*) filter (first_seen_at > timestamp '{NOW}' - interval 7 days) as recent, max(first_seen_at) as last_seen from posts group by 1")
def team_volume_7d(spark, d):
    return reads.team_volume(B.posts(spark, d), now(), 7)


@query("select count(*) filter (o_orderstatus = 'P' and epoch(timestamp '2001-08-01') - epoch(o_orderdate) > 864000) as stranded, count(*) filter (o_orderstatus = 'F') as failed, count(*) filter (o_orderstatus = 'P') as pending from orders")
def pipeline_stranded(spark, d):
    names = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "failed").otherwise("done")
    return reads.pipeline_counts(B.table(spark, d, "orders").select(names.alias("state"), F.col("o_orderdate").alias("updated_at")), F.lit("2001-08-01").cast("timestamp_ntz"), 864_000)


@query(views(NOTIFICATIONS) + "select status, line, count(*) as value from notifications group by all")
def notification_gauges(spark, d):
    return reads.gauges(B.notifications(spark, d), "status", "line")


@query(views(NOTIFICATIONS) + """select 'notifications{status="' || status || '",line="' || line || '"} ' || count(*) as line from notifications group by status, notifications.line""")
def metrics_text(spark, d):
    return reads.exposition(reads.gauges(B.notifications(spark, d), "status", "line"), "notifications", ["status", "line"], ("status", "line"))


@query(views(NOTIFICATIONS) + """, r as (select count(*) filter (status = 'sent') as sent, count(*) filter (status = 'failed') as failed from notifications where created_at >= timestamp '2000-01-01' - interval 43200 minutes)
select sent, failed, round(100 * failed / (sent + failed), 6) as rate_pct, sent + failed >= 10 and 100 * failed / (sent + failed) > 10 as alert from r""")
def notify_failure_rate(spark, d):
    return reads.failure_rate(B.notifications(spark, d), F.lit("2000-01-01").cast("timestamp_ntz"), 43_200, 10, 10.0)


DAILY = f", v as (select 'item ' || item_id as topic, cast(first_seen_at as date) as day, count(*) as posts, count(*) filter (sentiment = 'neg') as neg, count(*) filter (sentiment = 'pos') as pos from (select *, {C.SENTIMENT} from posts) group by all)"


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return reads.daily_counts(C._with_sentiment(B.posts(spark, d)), F.concat(F.lit("item "), F.col("item_id").cast("string")))


@query(views(POSTS) + DAILY + ", t as (select distinct topic from v) select topic, cast(coalesce((select sum(posts) from v where v.topic = t.topic and date_diff('day', day, date '2024-01-25') between 0 and 6), 0) as bigint) as posts7d, (select max(day) from v where v.topic = t.topic and posts >= 8) as last_spike from t")
def topic_list(spark, d):
    v = _daily(spark, d)
    return reads.topic_list(v.select("topic").distinct(), v, v.where("posts >= 8"), F.lit("2024-01-25").cast("date"))


@query(views(POSTS) + DAILY + """, b as (select *, date_diff('day', day, date '2024-01-25') as back from v),
s as (select topic, cast(coalesce(sum(posts) filter (back = 0), 0) as bigint) as posts, cast(coalesce(sum(neg) filter (back = 0), 0) as bigint) as neg, cast(coalesce(sum(pos) filter (back = 0), 0) as bigint) as pos, round(coalesce(sum(posts) filter (back > 0), 0) / 7, 6) as mean from b where back between 0 and 7 group by 1),
t as (select *, cast(row_number() over (order by posts desc, topic) as integer) as place from s where posts > 0)
select place, topic, posts, mean, neg, pos, format('{}. {}: {} posts ({}{:.1f} vs 7-day avg {:.1f}), neg {} / pos {}', place, topic, posts, case when posts - mean >= 0 then '+' else '' end, round(posts - mean, 1), round(mean, 1), neg, pos) as line from t where place <= 5""")
def digest_topics(spark, d):
    return reads.digest_topics(_daily(spark, d), F.lit("2024-01-25").cast("date"), 7, 5)


@query(views(POSTS) + """, n as (select *, case when price > 50 then 1 else 0 end + case when source_id = 3 then 1 else 0 end as topics, coalesce(kind = 'error', false) as complaint from posts where first_seen_at >= timestamp '2024-01-20' and first_seen_at < timestamp '2024-01-21')
select id, complaint, topics from n where topics > 0 order by complaint desc, topics desc, first_seen_at desc, id desc limit 20""")
def notable_posts(spark, d):
    day = B.posts(spark, d).where("first_seen_at >= timestamp_ntz'2024-01-20' and first_seen_at < timestamp_ntz'2024-01-21'")
    return reads.notable(day, {"dear": F.col("price") > 50, "third": F.col("source_id") == 3}, F.col("kind") == "error", 20)


@query(views(POSTS) + C.TRIM.replace("from posts where price > 0", f"from posts where price > 0 and first_seen_at >= timestamp '{NOW}' - interval 14 days and first_seen_at < timestamp '{NOW}'"))
def price_suggestion(spark, d):
    return reads.price_suggestion(B.posts(spark, d), now(), 14)


@query(views(MATCHES) + "select watch_id, count(*) filter (watch_id % 3 = 0 or created_at > timestamp '1999-01-01' + to_days(cast(watch_id as integer))) as unseen from matches group by 1")
def unseen_matches(spark, d):
    marks = _watches(spark, d).where("watch_id % 3 <> 0").select("watch_id", F.expr("timestamp_ntz'1999-01-01' + make_dt_interval(cast(watch_id as int))").alias("seen_until"))
    return reads.unseen(B.matches(spark, d), marks, "watch_id", "created_at")


@query(views(VISITS) + "select id, started_at, outcome, (select count(*) from lineitem where l_orderkey = id) as posts from visits where source_id = 3 and (started_at, id) < (timestamp '2000-01-01', 0) order by started_at desc, id desc limit 30")
def visit_listing(spark, d):
    import datetime as dt

    return reads.visit_listing(B.visits(spark, d), B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("visit_id")), 3, (dt.datetime(2000, 1, 1), 0), 30)


@query(views(VISITS) + ", n as (select *, lag(outcome) over (partition by source_id order by started_at, id) as before from visits where outcome is not null) select id, source_id from n where outcome = 'ok' and before = 'ok'")
def consecutive_visits(spark, d):
    return reads.consecutive(B.visits(spark, d), "ok")


@query(views(POSTS) + ", r as (select id, item_id, floor(price) as price, rank() over (partition by item_id order by floor(price)) as place from posts where price is not null) select id, item_id, price from r where place = 1")
def best_with_ties(spark, d):
    return reads.best_of(B.posts(spark, d).select("id", "item_id", F.floor("price").cast("double").alias("price")), "item_id", "price")


@query(views(POSTS) + "select id, year, odo, seen_at from (select id, 2000 + item_id % 25 as year, case when item_id % 3 <> 0 then id * 37 % 1000 end as odo, first_seen_at as seen_at from posts) order by abs(year - 2012), abs(odo - 500) nulls last, seen_at desc, id limit 20")
def comparables(spark, d):
    rows = B.posts(spark, d).select("id", (2000 + F.col("item_id") % 25).alias("year"), F.when(F.col("item_id") % 3 != 0, F.col("id") * 37 % 1000).alias("odo"), F.col("first_seen_at").alias("seen_at"))
    return reads.comparables(rows, 2012, 500, 20)


@query(views(POSTS, MATCHES) + "select m.post_id, m.watch_id, m.created_at, m.score, p.price from matches m join posts p on p.id = m.post_id order by price nulls last, created_at desc, post_id desc, watch_id desc offset 40 limit 20")
def inbox_page_offset(spark, d):
    rows = B.matches(spark, d).join(B.posts(spark, d).select(F.col("id").alias("post_id"), "price"), "post_id")
    return reads.inbox_page(rows, "price", 40, 20)


@query("select l_shipmode as queue, count(*) as n, min(l_shipdate) as oldest, arg_max(l_linestatus || l_returnflag, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) as last_error from (select *, 'q' || l_linenumber % 4 as l_shipmode from lineitem) where l_returnflag = 'R' group by 1")
def dead_letters(spark, d):
    jobs = B.table(spark, d, "lineitem").select(F.concat(F.lit("q"), (F.col("l_linenumber") % 4).cast("string")).alias("queue"), F.when(F.col("l_returnflag") == "R", "dead").otherwise("done").alias("state"), F.col("l_shipdate").alias("at"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("id"), F.concat("l_linestatus", "l_returnflag").alias("error"))
    return reads.dead_letters(jobs)


@query(views(POSTS) + "select id, strftime(first_seen_at, '%Y-%m-%dT%H:%M:%S.') || lpad(cast(extract(millisecond from first_seen_at) % 1000 as varchar), 3, '0') || 'Z' as at, md5(kind || '|' || author_id) as guard, cast(json_extract_string(doc, '$.n') as bigint) as n from (select *, '{\"n\": ' || item_id || '}' as doc from posts)")
def guards_and_times(spark, d):
    p = B.posts(spark, d)
    doc = F.from_json(F.concat(F.lit('[{"n": '), F.col("item_id").cast("string"), F.lit("}]")), "array<struct<n:bigint>>")
    return p.select("id", reads.iso_millis(F.col("first_seen_at")).alias("at"), F.md5(F.concat("kind", F.lit("|"), F.col("author_id").cast("string"))).alias("guard"), F.explode(doc).alias("e")).select("id", "at", "guard", "e.n")
