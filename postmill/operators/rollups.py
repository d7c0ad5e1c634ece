"""Cubes and counts over time buckets: volume, authors, funnel, topics, visits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.times import day_of, hour_of, local_start


def flag(df: DataFrame, keys: DataFrame, on: str, name: str) -> DataFrame:
    """Adds whether a row's key is among the keys; rows are neither dropped nor repeated."""
    return df.join(keys.select(F.col(on)).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def with_match_flags(posts: DataFrame, matches: DataFrame, notifications: DataFrame) -> DataFrame:
    """Adds matched and notified. A notification counts only through a match of its post."""
    keys = matches.select(F.col("post_id").alias("id"))
    told = notifications.where("status = 'sent'").select(F.col("match_id").alias("id")).join(keys, "id", "left_semi")
    return flag(flag(posts, keys, "id", "matched"), told, "id", "notified")


def volume_cube(flagged: DataFrame, bucket: Column) -> DataFrame:
    """Post metrics by bucket and team over six grouping sets. Sets with a category leave out rows without one."""
    rows = flagged.withColumn("ts", bucket).withColumn("who", F.coalesce("fingerprint", F.col("id").cast("string")))
    metrics = [
        F.count("*").alias("posts"),
        F.count_distinct("who").alias("unique_posts"),
        F.count_if(F.col("intent") == "sell").alias("sell"),
        F.count_if(F.col("intent") == "buy").alias("buy"),
        F.count_if(F.col("intent") == "other").alias("other"),
        F.count_if("enriched").alias("enriched_posts"),
        F.count_if("matched").alias("matched_posts"),
        F.count_if("notified").alias("notified_posts"),
        F.grouping_id().alias("gid"),
    ]
    apex = [F.col("ts"), F.col("team")]
    sets = [apex, [*apex, "source_id"], [*apex, "intent"], [*apex, "category_id"], [*apex, "source_id", "category_id"], [*apex, "category_id", "intent"]]
    cube = rows.groupingSets([[F.col(c) if isinstance(c, str) else c for c in s] for s in sets], "ts", "team", "source_id", "intent", "category_id").agg(*metrics)
    # bits of gid: source 4, intent 2, category 1; a set bit means that the column is not in the set
    return cube.where((F.col("gid").bitwiseAND(1) == 1) | F.col("category_id").isNotNull()).withColumn("gid", F.col("gid").cast("bigint"))


def author_activity(posts: DataFrame, bucket: Column) -> DataFrame:
    """By day and author: posts, sell posts, and the newest name (of equal times the greater id)."""
    return posts.withColumn("ts", bucket).groupBy("ts", "team", "author_id").agg(F.count("*").alias("posts"), F.count_if(F.col("intent") == "sell").alias("sell"), F.max_by("author_name", F.struct("first_seen_at", "id")).alias("newest_name"))


def top_authors(activity: DataFrame, k: int) -> DataFrame:
    """The k authors of a team with the most posts; ties by id."""
    from pyspark.sql import Window as W

    total = activity.groupBy("team", "author_id").agg(F.sum("posts").alias("posts"), F.sum("sell").alias("sell"), F.max_by("newest_name", "ts").alias("newest_name"))
    return total.withColumn("place", F.row_number().over(W.partitionBy("team").orderBy(F.desc("posts"), "author_id"))).where(F.col("place") <= k)


def funnel(flagged: DataFrame) -> DataFrame:
    """By day: collected, enriched, matched, notified."""
    return flagged.groupBy(day_of("first_seen_at").alias("day")).agg(F.count("*").alias("collected"), F.count_if("enriched").alias("enriched"), F.count_if("matched").alias("matched"), F.count_if("notified").alias("notified"))


def topic_volume(posts: DataFrame, predicate: Column, zone: str) -> DataFrame:
    """Hour (UTC) and local-day rows of posts under a predicate, with sentiment counts. Each post is fanned out to both buckets in one pass."""
    buckets = F.array(F.struct(F.lit("hour").alias("bucket"), hour_of("first_seen_at").alias("ts")), F.struct(F.lit("day").alias("bucket"), local_start("day", "first_seen_at", zone).alias("ts")))
    rows = posts.where(predicate).select("sentiment", F.explode(buckets).alias("b")).select("b.*", "sentiment")
    return rows.groupBy("bucket", "ts").agg(F.count("*").alias("posts"), *[F.count_if(F.col("sentiment") == s).alias(s) for s in ("neg", "neu", "pos")])


def topics_matched(posts: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """Posts under any predicate with the number of those that hold."""
    hits = [F.when(p, 1).otherwise(0) for p in predicates.values()]
    return posts.withColumn("topics", reduce(lambda a, b: a + b, hits)).where("topics > 0")


def relevance(posts: DataFrame, matches: DataFrame) -> DataFrame:
    """By source: posts and the share that any watch matched."""
    flagged = flag(posts, matches.select(F.col("post_id").alias("id")), "id", "matched")
    return flagged.groupBy("source_id").agg(F.count("*").alias("posts"), F.count_if("matched").alias("matched"), F.round(F.count_if("matched") / F.count("*"), 6).alias("share"))


def spine(df: DataFrame, ts: str, step: str, keys: list[str]) -> DataFrame:
    """Every step between the first and last time of each key: a dense time axis."""
    ends = df.groupBy(*keys).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    return ends.select(*keys, F.explode(F.expr(f"sequence(lo, hi, interval {step})")).alias(ts))


def densify(df: DataFrame, ts: str, step: str, keys: list[str], value: str) -> DataFrame:
    """Adds the missing steps of each key with 0."""
    return spine(df, ts, step, keys).join(df, [*keys, ts], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def outcomes(visits: DataFrame) -> DataFrame:
    """Visits by outcome; none yet is in flight."""
    return visits.groupBy(F.coalesce("outcome", F.lit("in_flight")).alias("outcome")).agg(F.count("*").alias("visits"))


def classify_sources(labelled: DataFrame, key: str, label: str, share: float) -> DataFrame:
    """The plurality label of each key if it has at least the share, else mixed; ties by label."""
    counts = labelled.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("minus"), F.col(label).alias("label"))).alias("best"))
    return best.select(key, F.when(-F.col("best.minus") >= share * F.col("total"), F.col("best.label").cast("string")).otherwise("mixed").alias("topic"), (-F.col("best.minus")).alias("top"), "total")

