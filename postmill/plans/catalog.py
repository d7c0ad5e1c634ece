"""The registered queries of the library over the driver's tables, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.functions.times import day_of, hour_of, local_start
from postmill.operators import matching, postings, prices, relations, rollups, search, state, trends
from postmill.sources import bridge as B
from postmill.sources.bridge import CORPUS, MATCHES, NOTIFICATIONS, POSTS, VISITS, ZONE, views
from postmill.sources.store import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


FLAGS = """flagged as (
  select p.*, coalesce(fingerprint, cast(id as varchar)) as who,
    id in (select post_id from matches) as matched,
    id in (select post_id from matches) and id in (select match_id from notifications where status = 'sent') as notified from posts p)"""
METRICS = """count(*) as posts, count(distinct who) as unique_posts, count(*) filter (intent = 'sell') as sell, count(*) filter (intent = 'buy') as buy,
    count(*) filter (intent = 'other') as other, count(*) filter (enriched) as enriched_posts, count(*) filter (matched) as matched_posts, count(*) filter (notified) as notified_posts"""


def _cube_sql(bucket: str) -> str:
    return views(POSTS, MATCHES, NOTIFICATIONS, FLAGS) + f""", cube as (
  select {bucket} as ts, team, source_id, intent, category_id, {METRICS}, grouping(source_id, intent, category_id) as gid
  from flagged group by grouping sets ((ts, team), (ts, team, source_id), (ts, team, intent), (ts, team, category_id), (ts, team, source_id, category_id), (ts, team, category_id, intent)))
select * from cube where gid & 1 = 1 or category_id is not null"""


LOCAL_DAY = "date_trunc('day', first_seen_at + interval 7 hours) - interval 7 hours"


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    return rollups.with_match_flags(B.posts(spark, d), B.matches(spark, d), B.notifications(spark, d))


@query(_cube_sql("date_trunc('hour', first_seen_at)"))
def volume_cube_hour(spark, d):
    return _as_set(rollups.volume_cube(_flagged(spark, d), hour_of("first_seen_at")))


@query(_cube_sql(LOCAL_DAY))
def volume_cube_day_local(spark, d):
    return _as_set(rollups.volume_cube(_flagged(spark, d), local_start("day", "first_seen_at", ZONE)))


def _as_set(cube: DataFrame) -> DataFrame:
    """gid over source, intent and category alone."""
    return cube.withColumn("gid", F.col("gid").bitwiseAND(7))


@query(views(POSTS) + "select date_trunc('day', first_seen_at) as ts, team, author_id, count(*) as posts, count(*) filter (intent = 'sell') as sell, arg_max(author_name, (first_seen_at, id)) as newest_name from posts group by all")
def author_activity(spark, d):
    return rollups.author_activity(B.posts(spark, d), day_of("first_seen_at"))


@query(views(POSTS) + """, t as (select team, author_id, count(*) as posts, count(*) filter (intent = 'sell') as sell, arg_max(author_name, (first_seen_at, id)) as newest_name from posts group by all)
select * from (select *, cast(row_number() over (partition by team order by posts desc, author_id) as integer) as place from t) where place <= 10""")
def top_authors(spark, d):
    return rollups.top_authors(rollups.author_activity(B.posts(spark, d), day_of("first_seen_at")), 10)


@query(views(POSTS, MATCHES, NOTIFICATIONS, FLAGS) + "select date_trunc('day', first_seen_at) as day, count(*) as collected, count(*) filter (enriched) as enriched, count(*) filter (matched) as matched, count(*) filter (notified) as notified from flagged group by 1")
def funnel_daily(spark, d):
    return rollups.funnel(_flagged(spark, d))


SENTIMENT = "case kind when 'click' then 'pos' when 'error' then 'neg' else 'neu' end as sentiment"


def _with_sentiment(posts: DataFrame) -> DataFrame:
    return posts.withColumn("sentiment", F.when(F.col("kind") == "click", "pos").when(F.col("kind") == "error", "neg").otherwise("neu"))


@query(views(POSTS) + f""", t as (select *, {SENTIMENT} from posts where price > 20),
f as (select 'hour' as bucket, date_trunc('hour', first_seen_at) as ts, sentiment from t union all select 'day', {LOCAL_DAY}, sentiment from t)
select bucket, ts, count(*) as posts, count(*) filter (sentiment = 'neg') as neg, count(*) filter (sentiment = 'neu') as neu, count(*) filter (sentiment = 'pos') as pos from f group by all""")
def topic_volume(spark, d):
    return rollups.topic_volume(_with_sentiment(B.posts(spark, d)), F.col("price") > 20, ZONE)


@query(views(POSTS) + "select id, kind, price, n as topics from (select *, (case when price > 50 then 1 else 0 end + case when kind = 'error' then 1 else 0 end + case when source_id = 3 then 1 else 0 end) as n from posts) where n > 0")
def topics_matched(spark, d):
    predicates = {"dear": F.col("price") > 50, "error": F.col("kind") == "error", "third": F.col("source_id") == 3}
    return rollups.topics_matched(B.posts(spark, d), predicates).select("id", "kind", "price", "topics")


@query(views(POSTS, MATCHES) + "select source_id, count(*) as posts, count(*) filter (m) as matched, round(count(*) filter (m) / count(*), 6) as share from (select source_id, id in (select post_id from matches) as m from posts) group by 1")
def relevance_share(spark, d):
    return rollups.relevance(B.posts(spark, d), B.matches(spark, d))


@query(views(POSTS) + """, c as (select source_id, date_trunc('hour', first_seen_at) as ts, count(*) as n from posts group by all),
s as (select source_id, unnest(generate_series(min(ts), max(ts), interval 1 hour)) as ts from c group by 1)
select source_id, ts, coalesce(n, 0) as n from s left join c using (source_id, ts)""")
def hourly_dense(spark, d):
    counts = B.posts(spark, d).groupBy("source_id", hour_of("first_seen_at").alias("ts")).agg(F.count("*").alias("n"))
    return rollups.densify(counts, "ts", "1 hour", ["source_id"], "n")


@query(views(VISITS) + "select coalesce(outcome, 'in_flight') as outcome, count(*) as visits from visits group by 1")
def visit_outcomes(spark, d):
    return rollups.outcomes(B.visits(spark, d))


@query(views(POSTS) + """, c as (select author_id, category_id, count(*) as n from posts where category_id is not null group by all),
b as (select author_id, cast(sum(n) as bigint) as total, max(n) as top, arg_min(category_id, (-n, category_id)) as best from c group by 1)
select author_id, case when top >= 0.15 * total then cast(best as varchar) else 'mixed' end as topic, top, total from b""")
def source_classify(spark, d):
    return rollups.classify_sources(B.posts(spark, d), "author_id", "category_id", 0.15)


TRIM = """, s as (select * from posts where price > 0),
q as (select item_id, count(*) as n_raw, quantile_cont(price, 0.25) as lo, quantile_cont(price, 0.75) as hi from s group by 1)
select item_id, n_raw, count(*) as n, cast(floor(quantile_cont(price, 0.5) + 0.5) as bigint) as median, cast(floor(quantile_cont(price, 0.25) + 0.5) as bigint) as p25, cast(floor(quantile_cont(price, 0.75) + 0.5) as bigint) as p75
from s join q using (item_id) where n_raw < 4 or hi = lo or price between lo - 1.5 * (hi - lo) and hi + 1.5 * (hi - lo) group by item_id, n_raw"""


@query(views(POSTS) + TRIM)
def price_stats_iqr(spark, d):
    return prices.trimmed_stats(B.posts(spark, d), ["item_id"])


@query("""with l as (select p_brand, l_extendedprice as price from lineitem join part on l_partkey = p_partkey)
select p_brand, count(*) as n, round(quantile_cont(price, 0.1), 4) as p10, round(quantile_cont(price, 0.25), 4) as p25, round(quantile_cont(price, 0.5), 4) as p50, round(quantile_cont(price, 0.75), 4) as p75, round(quantile_cont(price, 0.9), 4) as p90
from l where price > 0 group by 1 having count(*) >= 5""")
def price_distribution(spark, d):
    lines = B.table(spark, d, "lineitem").select("l_partkey", F.col("l_extendedprice").alias("price"))
    parts = B.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return prices.distribution(lines.join(parts, "l_partkey"), ["p_brand"], 5)


DAILY = ", daily as (select item_id, cast(first_seen_at as date) as day, count(*) as n, round(quantile_cont(price, 0.5), 4) as median from posts where enriched and price > 0 group by all)"


@query(views(POSTS) + DAILY + """, b as (select *, sum(n * median) over w7 / sum(n) over w7 as b7, sum(n * median) over w30 / sum(n) over w30 as b30 from daily
  window w7 as (partition by item_id order by day range between interval 7 days preceding and interval 1 day preceding), w30 as (partition by item_id order by day range between interval 30 days preceding and interval 1 day preceding))
select item_id, day, n, median, round(100 * (median - b7) / b7, 2) as vs7d, round(100 * (median - b30) / b30, 2) as vs30d from b""")
def price_series_vs7d(spark, d):
    return prices.against_before(prices.daily_medians(B.posts(spark, d)))


@query(views(POSTS) + "select category_id, date_trunc('week', first_seen_at + interval 7 hours) - interval 7 hours as week, count(*) as n, round(case when count(*) >= 3 then quantile_cont(price, 0.5) end, 4) as median from posts where category_id is not null and price > 0 group by all")
def weekly_median(spark, d):
    return prices.weekly_medians(B.posts(spark, d), 3, ZONE)


@query(views(POSTS) + """, r as (select * from posts where enriched and price > 0), m as (select item_id, min(price) as prior_min from r where first_seen_at < timestamp '2024-01-25' group by 1)
select id, item_id, price, prior_min from r join m using (item_id) where first_seen_at >= timestamp '2024-01-25' and price < prior_min order by price / prior_min, id limit 5""")
def new_lows(spark, d):
    return prices.new_lows(B.posts(spark, d), F.lit("2024-01-25").cast("timestamp_ntz"), 5)


@query(views(POSTS) + "select id, item_id, price, round(100.0::double * (rank() over (partition by item_id order by price) - 1) / count(*) over (partition by item_id), 4) as rank_pct from posts where price > 0")
def percentile_rank(spark, d):
    return prices.percentile_ranks(B.posts(spark, d).where("price > 0"), "item_id")


TERMS = """, terms as (select id, first_seen_at, category_id, unnest(['kind ' || kind, 'item ' || item_id, 'source ' || source_id]) as term from posts),
aliases(term, into_) as (values ('kind signup', 'kind join'), ('kind purchase', 'kind join'), ('kind view', null)),
once as (select distinct id, date_trunc('hour', first_seen_at) as ts, category_id, coalesce(into_, t.term) as term from terms t left join aliases a on t.term = a.term where a.term is null or into_ is not null),
hist as (select ts, term, cast(null as bigint) as category_id, count(*) as n from once group by 1, 2 union all select ts, term, category_id, count(*) from once where category_id is not null group by 1, 2, 3)"""


def _hist(spark: SparkSession, d: str, when: Column | None = None) -> DataFrame:
    p = B.posts(spark, d) if when is None else B.posts(spark, d).where(when)
    terms = p.select("id", "first_seen_at", "category_id", F.explode(F.array(F.concat(F.lit("kind "), "kind"), F.concat(F.lit("item "), F.col("item_id").cast("string")), F.concat(F.lit("source "), F.col("source_id").cast("string")))).alias("term"))
    aliases = spark.createDataFrame([("kind signup", "kind join"), ("kind purchase", "kind join"), ("kind view", None)], "term string, into string")
    return trends.term_counts(terms, aliases)


@query(views(POSTS) + TERMS + " select * from hist")
def trend_hist(spark, d):
    return _hist(spark, d)


HOUR = "2024-01-20 10:00:00"


@query(views(POSTS) + TERMS + f""", s as (select term, sum(n) filter (ts = timestamp '{HOUR}') as n, coalesce(sum(n) filter (ts < timestamp '{HOUR}'), 0) / 168.0::double as m, coalesce(sum(n * n) filter (ts < timestamp '{HOUR}'), 0) / 168.0::double as q
  from hist where category_id is null and ts between timestamp '{HOUR}' - interval 168 hours and timestamp '{HOUR}' group by 1),
z as (select term, cast(n as bigint) as n, round((n - m) / greatest(sqrt(greatest(q - m * m, 0.0::double)), sqrt(m), 1.0::double), 6) as z from s where n >= 2) select * from z where z >= 0.5""")
def trend_1h_z(spark, d):
    return trends.hour_trend(_hist(spark, d), F.lit(HOUR).cast("timestamp_ntz"), 2, 0.5)


@query(views(POSTS) + TERMS + f""", b as (select *, date_diff('hour', ts, timestamp '{HOUR}') as back from hist where category_id is null),
s as (select term, cast(coalesce(sum(n) filter (back < 24), 0) as bigint) as n, 24 * coalesce(sum(n) filter (back > 24), 0) / 168.0::double as base, coalesce(sum(n * n) filter (back > 24), 0) / 168.0::double as q from b where back between 0 and 192 and back <> 24 group by 1),
l as (select term, n, round(base, 6) as baseline, round((n + 1) / (base + 1), 6) as lift, base < 0.5 as is_new, case when base >= 0.5 then cast(floor(round(100 * (n / base - 1), 6) + 0.5) as bigint) end as delta_pct,
  round((n - base) / greatest(sqrt(24 * greatest(q - (base / 24) * (base / 24), 0.0::double)), sqrt(base), 1.0::double), 6) as z from s where n >= 3) select * from l where lift >= 1.2 or is_new""")
def trend_24h_lift(spark, d):
    return trends.day_trend(_hist(spark, d), F.lit(HOUR).cast("timestamp_ntz"), 3, 1.2)


@query(views(POSTS) + """, c as (select author_id, kind, count(*) as n from posts group by all) select author_id, arg_min(kind, (-n, kind)) as display, max(n) as votes from c group by 1""")
def display_vote(spark, d):
    return trends.display_vote(B.posts(spark, d), "author_id", "kind")


@query(views(POSTS) + """, c as (select item_id, cast(first_seen_at as date) as day, count(*) as n from posts group by all),
b as (select *, coalesce(sum(n) over w, 0) / 7.0::double as s, coalesce(sum(n * n) over w, 0) / 7.0::double as q from c window w as (partition by item_id order by day range between interval 7 days preceding and interval 1 day preceding)),
z as (select item_id, day, n, round(n / greatest(s, 1.0::double), 6) as ratio, round((n - s) / greatest(sqrt(greatest(q - s * s, 0.0::double)), 1.0::double), 6) as z from b) select * from z where n >= 3 and ratio >= 1.5 and z >= 1.0""")
def spike_daily(spark, d):
    daily = B.posts(spark, d).groupBy("item_id", F.to_date("first_seen_at").alias("day")).agg(F.count("*").alias("n"))
    return trends.daily_spikes(daily, ["item_id"], 7, 3, 1.5, 1.0)


@query(views(POSTS, MATCHES) + "select post_id, watch_id, created_at, score, c_name as name, c_mktsegment as segment, first_seen_at, intent, category_id from matches join customer on watch_id = c_custkey join posts on posts.id = post_id")
def inbox_join(spark, d):
    watches = B.table(spark, d, "customer").select(F.col("c_custkey").alias("watch_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return relations.inbox(B.matches(spark, d), watches, B.posts(spark, d).select("id", "first_seen_at", "intent", "category_id"))


@query(views(POSTS) + "select id, fingerprint from posts where id not in (select o_orderkey from orders where o_orderstatus = 'O') and fingerprint not in (select o_custkey || '-error' from orders)")
def hidden_antijoin(spark, d):
    o = B.table(spark, d, "orders")
    hidden = o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("post_id"), F.lit(None).cast("string").alias("fingerprint")).unionByName(o.select(F.lit(None).cast("bigint").alias("post_id"), F.concat(F.col("o_custkey").cast("string"), F.lit("-error")).alias("fingerprint")))
    return relations.without_hidden(B.posts(spark, d).select("id", "fingerprint"), hidden)


@query("select conv_id, max(turn) as turn, arg_max(role, turn) as role, arg_max(text, turn) as text from conversations group by 1")
def latest_revision(spark, d):
    return relations.latest(B.table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn"]).select("conv_id", "turn", "role", "text")


@query("select conv_id, turn, role, back from (select *, cast(row_number() over (partition by conv_id order by turn desc) as integer) as back from conversations) where back <= 2")
def keep_n_versions(spark, d):
    return relations.newest_versions(B.table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", 2)


NEXT = """, n as (select id, source_id, outcome, lag(outcome) over w as before, lead(outcome) over w as after, cast(epoch(started_at) - epoch(lag(started_at) over w) as bigint) as gap_s
  from visits where outcome is not null window w as (partition by source_id order by started_at, id))"""


@query(views(VISITS) + NEXT + " select * from n")
def neighbour_visits(spark, d):
    return relations.neighbours(B.visits(spark, d))


@query(views(VISITS) + NEXT + " select * from n where outcome = 'blocked' and before = 'blocked' and gap_s <= 86400")
def block_pairs(spark, d):
    return relations.block_pairs(B.visits(spark, d), 86_400)


@query(views(POSTS) + """, r as (select fingerprint, id, row_number() over (partition by fingerprint order by first_seen_at desc, id desc) as place, count(*) over (partition by fingerprint) - 1 as others from posts)
select fingerprint, min(id) filter (place = 1) as id, any_value(others) as others, coalesce(string_agg(cast(id as varchar), ',' order by place) filter (place between 2 and 6), '') as next_ids from r group by 1""")
def repost_fold(spark, d):
    return relations.fold_reposts(B.posts(spark, d))


@query(views(POSTS) + """, a as (select 'fingerprint' as "by", fingerprint as key, id from posts union all select 'price', author_id || '|' || cast(round(price * 100) as bigint), id from posts where price is not null)
select "by", key, count(*) as n, min(id) as first_id from a group by 1, 2 having count(*) > 1""")
def duplicate_groups(spark, d):
    return relations.duplicate_groups(B.posts(spark, d))


TREE = "with tree as (select 'r' || n_regionkey || '.n' || n_nationkey || '.c' || c_custkey as path from customer join nation on c_nationkey = n_nationkey)"


def _tree(spark: SparkSession, d: str) -> DataFrame:
    j = B.table(spark, d, "customer").join(F.broadcast(B.table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select(F.concat(F.lit("r"), F.col("n_regionkey"), F.lit(".n"), F.col("n_nationkey"), F.lit(".c"), F.col("c_custkey")).alias("path"))


@query(TREE + " select path from tree where path = 'r1.n1' or starts_with(path, 'r1.n1.')")
def category_subtree(spark, d):
    return relations.subtree(_tree(spark, d), "r1.n1")


@query(TREE + """, p as (select path, unnest([split_part(path, '.', 1), split_part(path, '.', 1) || '.' || split_part(path, '.', 2), path]) as ancestor from tree) select ancestor, count(*) as nodes from p group by 1""")
def category_ancestors(spark, d):
    return relations.ancestors(_tree(spark, d)).groupBy("ancestor").agg(F.count("*").alias("nodes"))


@query(views(MATCHES) + "select watch_id, post_id, score from (select *, row_number() over (partition by watch_id order by score desc, post_id) as place from matches) where place = 1")
def best_match_per_watch(spark, d):
    return relations.best_by(B.matches(spark, d), ["watch_id"], [F.desc("score"), F.col("post_id")]).select("watch_id", "post_id", "score")


@query(views(MATCHES) + "select distinct o_orderkey as post_id, o_custkey as watch_id from orders where o_custkey % 3 = 0 and (o_orderkey, o_custkey) not in (select post_id, watch_id from matches)")
def insert_if_absent(spark, d):
    new = B.table(spark, d, "orders").where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("post_id"), F.col("o_custkey").alias("watch_id"))
    return relations.missing(new, B.matches(spark, d), ["post_id", "watch_id"])


@query(views(POSTS) + "select id, first_seen_at, price from posts where (first_seen_at, id) < (timestamp '2024-01-15', 0) order by first_seen_at desc, id desc limit 25")
def keyset_page_newest(spark, d):
    import datetime as dt

    return relations.after(B.posts(spark, d).select("id", "first_seen_at", "price"), [("first_seen_at", True), ("id", True)], {"first_seen_at": dt.datetime(2024, 1, 15), "id": 0}, 25)


@query(views(POSTS) + "select id, price from posts where price > 20 or (price = 20 and id > 100) or price is null order by price asc nulls last, id limit 25")
def keyset_page_price(spark, d):
    return relations.after(B.posts(spark, d).select("id", "price"), [("price", False), ("id", False)], {"price": 20.0, "id": 100}, 25)


@query(views(POSTS) + "select least(count(*), 1000) as total, count(*) > 1000 as more from posts where kind = 'click'")
def capped_total(spark, d):
    return relations.capped_count(B.posts(spark, d).where("kind = 'click'"), 1000)


@query(views(POSTS) + "select id, category_id, price from posts where category_id is null or price < 1")
def unclassified(spark, d):
    return B.posts(spark, d).where("category_id is null or price < 1").select("id", "category_id", "price")


@query(views(NOTIFICATIONS) + "select match_id, case when count(*) filter (status = 'sent') = count(*) then 'sent' when count(*) filter (status = 'failed') = count(*) then 'failed' when count(*) filter (status = 'pending') = count(*) then 'pending' else 'partial' end as status, count(*) as n from notifications group by 1")
def notif_status_agg(spark, d):
    return state.status_of_match(B.notifications(spark, d))


@query(views(NOTIFICATIONS) + """, u as (select match_id as post_id, amount > 30000 as user_id, line, status, amount from notifications),
p as (select post_id, user_id, line, status, first_value(line) over (partition by post_id, user_id order by status <> 'sent', line, amount) as primary_line from u)
select *, line <> primary_line as merged from p""")
def notify_merge(spark, d):
    rows = B.notifications(spark, d).select(F.col("match_id").alias("post_id"), (F.col("amount") > 30_000).alias("user_id"), "line", "status")
    return state.primary_notifications(rows)


@query("""with c as (select l_orderkey % 500 as key, l_suppkey as source, l_linenumber, l_orderkey, case when l_quantity > 25 then 2 else 1 end as rank, l_returnflag || l_linestatus as text,
    case when l_tax > 0.04 then l_shipdate end as posted_at, case when l_discount > 0.05 then l_partkey end as author_id, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as seq from lineitem),
b as (select *, rank >= max(rank) over (partition by key order by seq rows unbounded preceding) as counts from c),
k as (select *, lag(text) over w as old_text, lag(rank) over w as old_rank, row_number() over w as i from b where counts window w as (partition by key order by seq))
select key, max(rank) as rank, any_value(t) as text, any_value(e) as edits, arg_min(posted_at, seq) filter (posted_at is not null) as posted_at, arg_min(author_id, seq) filter (author_id is not null) as author_id, count(*) as captures
from c join (select key as k2, arg_max(text, seq) as t, count(*) filter (i > 1 and text <> old_text and rank = old_rank) as e from k group by 1) on key = k2 group by key""")
def upsert_fold(spark, d):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    captures = B.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 500).alias("key"), *order, F.when(F.col("l_quantity") > 25, 2).otherwise(1).alias("rank"), F.concat("l_returnflag", "l_linestatus").alias("text"),
        F.when(F.col("l_tax") > 0.04, F.col("l_shipdate")).alias("posted_at"), F.when(F.col("l_discount") > 0.05, F.col("l_partkey")).alias("author_id"),
    )
    return state.upsert(captures, ["key"], order)


@query("""with r as (select l_orderkey as id, l_shipdate as started_at, l_linenumber as line, l_extendedprice as amount, case l_returnflag when 'A' then 'ok' when 'R' then 'blocked' end as outcome, case when l_tax > 0.02 then l_partkey end as posts_new from lineitem)
select id, min(started_at) as started_at, arg_max(outcome, (started_at, line, amount)) filter (outcome is not null) as outcome, arg_max(posts_new, (started_at, line, amount)) filter (posts_new is not null) as posts_new from r group by 1""")
def visit_upsert(spark, d):
    r = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("started_at"), F.col("l_shipdate").alias("reported_at"), F.struct("l_linenumber", "l_extendedprice").alias("line"), F.when(F.col("l_returnflag") == "A", "ok").when(F.col("l_returnflag") == "R", "blocked").alias("outcome"), F.when(F.col("l_tax") > 0.02, F.col("l_partkey")).alias("posts_new"))
    return state.merge_visits(r)


@query(views(VISITS) + """, g as (select id, source_id, lag(started_at) over (partition by source_id order by started_at, id) as from_at, started_at as to_at from visits where outcome = 'ok')
select *, cast(epoch(to_at) - epoch(from_at) as bigint) as gap_s from g where epoch(to_at) - epoch(from_at) > 1.5 * 864000 + 3600""")
def watchdog_gap(spark, d):
    return state.gaps(B.visits(spark, d), 864_000, 1.5, 3600)


@query(views(VISITS) + "select id, started_at from visits where started_at >= timestamp '2001-08-01' - interval 90 days")
def retention_cut(spark, d):
    return state.retained(B.visits(spark, d), "started_at", F.lit("2001-08-01").cast("timestamp_ntz"), 90).select("id", "started_at")


@query("""select l_orderkey, l_linenumber, l_extendedprice, case when l_returnflag <> 'R' and l_linenumber <= 5 then 'pending' else 'failed' end as status,
  case when l_returnflag <> 'R' and l_linenumber <= 5 then l_shipdate + to_seconds([5, 30, 120, 600, 1800][l_linenumber]) end as next_attempt_at from lineitem where l_linenumber > 0""")
def retry_ladder(spark, d):
    ls = B.table(spark, d, "lineitem").where("l_linenumber > 0")
    step = state.retry(F.least(F.col("l_linenumber"), F.lit(6)), F.col("l_returnflag") != "R", F.col("l_shipdate"))
    safe = F.when(F.col("l_linenumber") <= 5, step).otherwise(F.struct(F.lit("failed").alias("status"), F.lit(None).cast("timestamp_ntz").alias("next_attempt_at")))
    return ls.select("l_orderkey", "l_linenumber", "l_extendedprice", safe.alias("s")).select("l_orderkey", "l_linenumber", "l_extendedprice", "s.*")


@query("""select o_orderkey as id, case when o_custkey % 5 >= 3 then 'fail' else 'requeue' end as action from orders where o_orderstatus = 'P' and epoch(timestamp '2001-08-01' - o_orderdate) > 600 and o_orderkey not in (select l_orderkey from lineitem where l_linestatus = 'O')""")
def reconcile(spark, d):
    posts = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("state"), F.col("o_orderdate").alias("updated_at"), (F.col("o_custkey") % 5).alias("attempts"))
    live = B.table(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("id"))
    return state.reconcile(posts, live, F.lit("2001-08-01").cast("timestamp_ntz"), 600, 3)


@query(views(POSTS) + """, s as (select source_id as key, date_trunc('hour', first_seen_at) as ts, count(*) as depth from posts group by all),
r as (select *, depth > 1 as high, sum(case when depth > 1 then 0 else 1 end) over (partition by key order by ts rows unbounded preceding) as run from s),
h as (select key, ts, depth, cast(epoch(ts) - epoch(min(ts) over (partition by key, run)) as bigint) as held_s from r where high) select * from h where held_s >= 7200""")
def sustained_backlog(spark, d):
    depths = B.posts(spark, d).groupBy(F.col("source_id").alias("key"), hour_of("first_seen_at").alias("ts")).agg(F.count("*").alias("depth"))
    return state.sustained(depths, 1, 7200)


@query(views(CORPUS) + """, l as (select id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') as lines from corpus)
select id, case when length(f) > 120 then substr(f, 1, 119) || '…' else f end as snippet from (select id, lines[1] as f from l)""")
def snippet_title(spark, d):
    return B.corpus(spark, d).select("id", T.snippet(F.col("text")).alias("snippet"))


@query(views(CORPUS) + """, f as (select id, source, substr(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 500) as body from corpus)
select fingerprint, count(*) as n, min(id) as first_id from (select id, sha256(source || chr(31) || '' || chr(31) || body) as fingerprint from f where body <> '') group by 1""")
def fingerprint_dedup(spark, d):
    prints = B.corpus(spark, d).select("id", T.fingerprint(F.col("source"), F.lit(""), F.col("text")).alias("fingerprint"))
    return prints.where("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


LINES = """, folded as (select *, lower(strip_accents(replace(replace(text, 'đ', 'd'), 'Đ', 'd'))) as low from corpus),
lines as (select *, ' ' || regexp_replace(low, '[^a-z0-9]+', ' ', 'g') || ' ' as line, regexp_replace(low, '[^a-z0-9]+', '', 'g') as packed from folded)"""


_indexes: dict[tuple[str, str], postings.Index] = {}


def search_index(spark: SparkSession, d: str) -> postings.Index:
    """The stored index of a folder's corpus, written once in an application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _indexes:
        _indexes[key] = postings.build(B.corpus(spark, d), shared_folder(spark, "search"))
    return _indexes[key]


@query(views(CORPUS) + LINES + ", words as (select id, unnest(string_split(trim(line), ' ')) as word from lines) select word, count(distinct id) as posts, count(*) as times from words where word <> '' group by word")
def lexeme_counts(spark, d):
    """Words of the stored index with their posts; times are counted from the lines, so lists and lines must agree."""
    index = search_index(spark, d)
    lists = index.table("words").groupBy("word").agg(F.sum(F.size("ids").cast("bigint")).alias("posts"))
    lines = index.table("lines").select(F.explode(F.split(F.trim("line"), " ")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("times"))
    return lists.join(lines, "word")


@query(views(CORPUS) + LINES + " select id from lines where (contains(line, ' the') or contains(packed, 'the')) and (contains(line, ' license') or contains(packed, 'license'))")
def search_terms(spark, d):
    return postings.hits(search_index(spark, d), search.parse("the license")).select("id")


@query(views(CORPUS) + LINES + " select id from lines where contains(line, ' all rights reserved ') and not contains(line, ' und ')")
def search_phrase_exclude(spark, d):
    return postings.hits(search_index(spark, d), search.parse('"all rights reserved" -und')).select("id")


SCORED = LINES + """, found as (select id, text, effective_at, line from lines where (contains(line, ' the') or contains(packed, 'the')) and (contains(line, ' license') or contains(packed, 'license'))),
words as (select id, unnest(string_split(trim(line), ' ')) as w, generate_subscripts(string_split(trim(line), ' '), 1) as pos from found),
entries as (select id, pos, starts_with(w, 'the') as first from words where starts_with(w, 'the') or starts_with(w, 'license')),
pairs as (select id, pos, first, lag(pos) over v as before, lag(first) over v as was from entries window v as (partition by id order by pos)),
covers as (select id, sum(0.1::double / (pos - before)) as x from pairs where was <> first group by 1),
names as (select id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')[1] as f from found)
select id, effective_at, round(coalesce(x, 0) / (coalesce(x, 0) + 1) + 0.5 * exp(-greatest(epoch(timestamp '2024-03-01') - epoch(effective_at), 0) / 3600.0::double / 168), 6) as rank,
  case when length(f) > 120 then substr(f, 1, 119) || '…' else f end as snippet from found left join covers using (id) join names using (id) order by rank desc, effective_at desc, id desc limit 25"""


@query(views(CORPUS) + SCORED)
def search_relevance_page(spark, d):
    return postings.top(search_index(spark, d), "the license", F.lit("2024-03-01").cast("timestamp_ntz")).rows


@query("""select doc_id, case when regexp_matches(s, '[",\\r\\n]') then '"' || replace(s, '"', '""') || '"' else s end as cell from (select doc_id, case when regexp_matches(text, '^[=+\\-@\\t\\r]') then '''' || text else coalesce(text, '') end as s from documents)""")
def csv_cells(spark, d):
    return B.table(spark, d, "documents").select("doc_id", T.csv_cell(F.col("text")).alias("cell"))


WATCHES = [(1, ["the", "license"], ["rights"], ["und"], None, None), (2, ["gpl", "apache"], [], [], 100.0, None), (3, ["mit"], ["license"], ["der"], None, 5000.0), (4, ["la", "les"], ["des"], ["the"], 500.0, 900.0)]


def _watches(spark: SparkSession) -> DataFrame:
    rows = [(w, 0, True, *lists, lo, hi, None) for w, *lists, lo, hi in WATCHES]
    return spark.createDataFrame(rows, "watch_id bigint, team bigint, enabled boolean, include array<string>, include_all array<string>, exclude array<string>, price_min double, price_max double, intents array<string>")


def _watch_sql() -> str:
    arms = []
    for w, any_of, every, none, lo, hi in WATCHES:
        where = [f"({' or '.join(f"list_contains(words, '{t}')" for t in any_of)})", *[f"list_contains(words, '{t}')" for t in every], *[f"not list_contains(words, '{t}')" for t in none]]
        where += [f"price >= {lo}"] * (lo is not None) + [f"price <= {hi}"] * (hi is not None)
        hits = "list_filter([" + ", ".join(f"'{t}'" for t in sorted({*any_of, *every})) + "], lambda t: list_contains(words, t))"
        arms.append(f"select id as post_id, {w}::bigint as watch_id, len({hits}) + {0.5 if lo is not None or hi is not None else 0.0}::double as score, array_to_string({hits}, ',') as terms from w where {' and '.join(where)}")
    return views(CORPUS) + LINES + ", w as (select id, cast(length(text) as double) as price, string_split(trim(line), ' ') as words from lines) " + " union all ".join(arms)


@query(_watch_sql())
def match_watches(spark, d):
    posts = B.corpus(spark, d).select("id", F.lit(0).cast("bigint").alias("team"), "text", F.length("text").cast("double").alias("price"), F.lit(None).cast("string").alias("intent"))
    return matching.match(posts, _watches(spark))


@query(_watch_sql())
def watch_dry_run(spark, d):
    posts = B.corpus(spark, d).select("id", F.lit(1).cast("bigint").alias("team"), "text", F.length("text").cast("double").alias("price"), F.lit(None).cast("string").alias("intent"))
    return matching.match(posts, _watches(spark), dry_run=True)
