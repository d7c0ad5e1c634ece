"""The driver's star schema and event table read as posts, matches, notifications, visits and catalogue; the same views in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "Asia/Ho_Chi_Minh"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, first_seen_at, author_id, author_name, source_id, team, fingerprint, kind, intent, item_id, category_id, price, enriched."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    enriched = F.col("value").isNotNull() & (k % 10 != 0)
    intent = F.when(F.col("event_type") == "purchase", "sell").when(F.col("event_type") == "signup", "buy").otherwise("other")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("first_seen_at"),
        F.col("user_id").alias("author_id"),
        F.concat(F.lit("user "), F.col("user_id"), F.lit("/"), F.col("event_type")).alias("author_name"),
        (F.col("user_id") % 5).alias("source_id"),
        (F.col("user_id") % 2).alias("team"),
        F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("fingerprint"),
        F.col("event_type").alias("kind"),
        F.when(enriched, intent).alias("intent"),
        k.alias("item_id"),
        F.when(enriched, F.floor(k / 10)).alias("category_id"),
        F.col("value").alias("price"),
        enriched.alias("enriched"),
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id, watch_id, created_at, score of orders that are not open."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'")
    return o.select(F.col("o_orderkey").alias("post_id"), F.col("o_custkey").alias("watch_id"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("score"))


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id (of the post), line, status, created_at."""
    status = F.when(F.col("l_returnflag") == "A", "sent").when(F.col("l_returnflag") == "R", "failed").otherwise("pending")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.col("l_linenumber").alias("line"), status.alias("status"), F.col("l_shipdate").alias("created_at"), F.col("l_extendedprice").alias("amount"))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source_id, started_at, outcome (null: in flight), posts_new."""
    outcome = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "P", "blocked")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("source_id"), F.col("o_orderdate").alias("started_at"), outcome.alias("outcome"), (F.col("o_orderkey") % 7).alias("posts_new")
    )


def visits_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source_id, started_at, outcome (null: in flight), complete: one visit an event, for measures by the hour."""
    outcome = F.when(F.col("event_type") == "view", "blocked").when(F.col("event_type") != "error", "ok")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("source_id"), F.col("ts").alias("started_at"), outcome.alias("outcome"), F.coalesce(F.col("value") > 10, F.lit(False)).alias("complete"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sources: source_id, name, team, kind, status, interval_s, health_ok, coverage, waits, 7-day posts and a place in the tree."""
    k, n, bal = F.col("s_suppkey"), F.col("s_nationkey"), F.col("s_acctbal")
    share = F.round((bal + 1000) / 11000, 6)
    return table(spark, sf_dir, "supplier").select(
        k.alias("source_id"), F.col("s_name").alias("name"), (k % 2).alias("team"),
        F.element_at(F.array(*map(F.lit, ("web", "telegram", "push"))), (k % 3 + 1).cast("int")).alias("platform"),
        F.concat(F.lit("topic"), (n % 4).cast("string")).alias("topic"), F.concat(F.lit("region"), (n % 3).cast("string")).alias("region"),
        F.when(k % 11 == 7, "paused").when(k % 13 == 5, "paused_by_health").otherwise("active").alias("status"),
        F.when(k % 4 != 0, 300 * (k % 5 + 1)).alias("interval_s"),
        F.when(bal < 0, False).when(bal > 1500, True).alias("health_ok"),
        F.when(k % 7 != 0, F.when(bal > 5000, 1.0).otherwise(share)).alias("coverage_ok"), F.when(k % 7 != 0, share).alias("coverage_complete"),
        (k * 977 % 90_000).alias("age_s"), F.when(k % 9 != 0, k * 613 % 80_000).alias("seconds_since_ok"), (k % 50).alias("posts7d"), (k % 50 % 7).alias("matched7d"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text, source, lang and effective_at: one document an hour."""
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, doc_id)")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang", at.alias("effective_at"))


#: The same views for DuckDB, as common table expressions.
POSTS = """posts as (
  select event_id as id, ts as first_seen_at, user_id as author_id, 'user ' || user_id || '/' || event_type as author_name,
    user_id % 5 as source_id, user_id % 2 as team, user_id || '-' || event_type as fingerprint, event_type as kind,
    case when enriched then case event_type when 'purchase' then 'sell' when 'signup' then 'buy' else 'other' end end as intent,
    k as item_id, case when enriched then k // 10 end as category_id, value as price, enriched
  from (select *, value is not null and k % 10 <> 0 as enriched
        from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events)))"""
MATCHES = "matches as (select o_orderkey as post_id, o_custkey as watch_id, o_orderdate as created_at, o_totalprice as score from orders where o_orderstatus <> 'O')"
NOTIFICATIONS = """notifications as (
  select l_orderkey as match_id, l_linenumber as line, case l_returnflag when 'A' then 'sent' when 'R' then 'failed' else 'pending' end as status,
    l_shipdate as created_at, l_extendedprice as amount from lineitem)"""
VISITS = """visits as (
  select o_orderkey as id, o_custkey % 20 as source_id, o_orderdate as started_at,
    case o_orderstatus when 'F' then 'ok' when 'P' then 'blocked' end as outcome, o_orderkey % 7 as posts_new from orders)"""
VISITS_HOURLY = """visits as (
  select event_id as id, user_id % 5 as source_id, ts as started_at, case when event_type = 'view' then 'blocked' when event_type <> 'error' then 'ok' end as outcome, coalesce(value > 10, false) as complete from events)"""
SOURCES = """sources as (
  select s_suppkey as source_id, s_name as name, s_suppkey % 2 as team, ['web', 'telegram', 'push'][s_suppkey % 3 + 1] as platform, 'topic' || s_nationkey % 4 as topic, 'region' || s_nationkey % 3 as region,
    case when s_suppkey % 11 = 7 then 'paused' when s_suppkey % 13 = 5 then 'paused_by_health' else 'active' end as status, case when s_suppkey % 4 <> 0 then 300 * (s_suppkey % 5 + 1) end as interval_s,
    case when s_acctbal < 0 then false when s_acctbal > 1500 then true end as health_ok,
    case when s_suppkey % 7 <> 0 then case when s_acctbal > 5000 then 1.0::double else round((s_acctbal + 1000) / 11000, 6) end end as coverage_ok, case when s_suppkey % 7 <> 0 then round((s_acctbal + 1000) / 11000, 6) end as coverage_complete,
    s_suppkey * 977 % 90000 as age_s, case when s_suppkey % 9 <> 0 then s_suppkey * 613 % 80000 end as seconds_since_ok, s_suppkey % 50 as posts7d, s_suppkey % 50 % 7 as matched7d from supplier)"""
CORPUS = "corpus as (select doc_id as id, text, source, lang, timestamp '2024-01-01' + to_hours(doc_id) as effective_at from documents)"


def views(*names: str) -> str:
    return "with " + ",\n".join(names)
