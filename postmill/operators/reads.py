"""What the read endpoints show: posts with their dimensions, series from cubes, gauges, digests, listings, neighbours in price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.functions.times import day_of
from postmill.operators.prices import trimmed_stats


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def post_details(posts: DataFrame, sources: DataFrame, enrichments: DataFrame, items: DataFrame) -> DataFrame:
    """Each post of a known source, with its enrichment and that one's item where there are any."""
    with_source = posts.join(sources.select("source_id", F.col("name").alias("source_name")), "source_id")
    return with_source.join(enrichments, "id", "left").join(items, "item_id", "left")


def inbox_star(matches: DataFrame, watches: DataFrame, posts: DataFrame, sources: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Matches with watch, post and source, and the enrichment where there is one."""
    found = matches.join(watches, "watch_id").join(posts, matches["post_id"] == posts["id"]).drop("id")
    return found.join(sources.select("source_id", F.col("name").alias("source_name")), "source_id").join(enrichments.withColumnRenamed("id", "post_id"), "post_id", "left")


def notification_log(notifications: DataFrame, matches: DataFrame, posts: DataFrame, watches: DataFrame) -> DataFrame:
    """Every notification, with match, post and watch where they are still there."""
    return notifications.join(matches.select(F.col("post_id").alias("match_id"), "watch_id"), "match_id", "left").join(posts.select(F.col("id").alias("match_id"), "kind"), "match_id", "left").join(watches, "watch_id", "left")


def in_scope(posts: DataFrame, sources: DataFrame, team: int) -> DataFrame:
    """Posts of the team's sources."""
    return posts.join(sources.where(F.col("team") == team).select("source_id"), "source_id", "left_semi")


def with_rule_tags(enrichments: DataFrame, missing: DataFrame) -> DataFrame:
    """Enrichments whose ids are listed as lacking tags get those of their intent; the others stay."""
    keys = missing.select("id").distinct().withColumn("lacks", F.lit(True))
    tags = F.when(F.col("intent").isin("sell", "buy"), F.array("intent")).otherwise(F.array().cast("array<string>"))
    joined = enrichments.join(keys, "id", "left")
    return joined.withColumn("tags", F.when(F.coalesce("lacks", F.lit(False)), tags).otherwise(F.col("tags"))).drop("lacks")


def duplicates(posts: DataFrame) -> DataFrame:
    """(id, other): posts that share a fingerprint or a repost key, once each; two equi-joins instead of one on either.

    Within a group every post is paired with its first one only, which names the group; the pairs grow with the posts.
    """
    first = lambda key: F.min("id").over(W.partitionBy(key))
    arms = [posts.where(F.col(k).isNotNull()).select("id", first(k).alias("other")) for k in ("fingerprint", "repost_key")]
    return arms[0].unionByName(arms[1]).where("id <> other").distinct()


def overview(posts: DataFrame, key: str, at: Column, least: int, least_prior: int) -> DataFrame:
    """By key in one pass: numbers and medians of the last 7 days and the 7 before, null below ``least``; the lowest price before yesterday, null below ``least_prior``."""
    ts, day = F.col("first_seen_at"), lambda n: at - F.expr(f"interval {n} days")
    now, before, prior = ts > day(7), (ts > day(14)) & (ts <= day(7)), (ts < day(1)) & (ts >= day(31))
    med = lambda when: F.percentile(F.when(when, F.col("price")), 0.5)
    sums = posts.where("price is not null").where(ts <= at).groupBy(key).agg(
        F.count_if(now).alias("n7"), med(now).alias("m7"), F.count_if(before).alias("nprev"), med(before).alias("mprev"), F.count_if(prior).alias("nprior"), F.min(F.when(prior, F.col("price"))).alias("low")
    )
    some = lambda c, n, k: F.when(F.col(n) >= k, F.round(c, 6))
    return sums.select(key, "n7", some("m7", "n7", least).alias("median7d"), "nprev", some("mprev", "nprev", least).alias("median_prev7d"), "nprior", some("low", "nprior", least_prior).alias("prior_min"))


def volume_series(cube: DataFrame, keys: list[str], group: str | None, names: DataFrame | None, start: Column, end: Column) -> DataFrame:
    """The rows of a cube's set with just these keys, from start to end: ts, label (name of the group where known, else its key; All without a group), metrics."""
    bits = {"source_id": 4, "intent": 2, "category_id": 1}
    rows = cube.where((F.col("gid") == sum(b for k, b in bits.items() if k not in keys)) & F.col("ts").between(start, end))
    if group is None:
        labelled = rows.withColumn("label", F.lit("All"))
    else:
        labelled = rows.withColumn("key", F.col(group).cast("string"))
        labelled = labelled.join(names, "key", "left") if names is not None else labelled.withColumn("name", F.lit(None).cast("string"))
        labelled = labelled.withColumn("label", F.coalesce("name", "key"))
    return labelled.select("ts", "team", "label", "posts", "unique_posts", "sell", "buy", "other")


def trending_page(trend: DataFrame, hist: DataFrame, hour: Column, size: int) -> DataFrame:
    """The trend's terms, greatest lift first (then z, then term; nulls last), each with its counts of the 24 hours up to ``hour`` as a dense array."""
    top = trend.orderBy(F.desc_nulls_last("lift"), F.desc_nulls_last("z"), "term").limit(size)
    back = ((F.unix_seconds(hour.cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))) / 3600).cast("int")
    slots = hist.where("category_id is null").withColumn("back", back).where("back between 0 and 23").groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct((23 - F.col("back")).alias("slot"), "n"))).alias("held"))
    none = F.create_map().cast("map<int,bigint>")
    spark = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.coalesce(F.try_element_at(F.coalesce("held", none), i), F.lit(0)))
    return top.join(slots, "term", "left").withColumn("sparkline", F.array_join(spark.cast("array<string>"), ",")).drop("held")


def author_breakdown(activity: DataFrame, k: int) -> DataFrame:
    """Of each team's k busiest authors: place, posts, newest name, and posts by category as JSON. activity: team, author_id, category_id, ts, posts, newest_name; a row without a category holds the author's sum."""
    sums = activity.where("category_id is null").groupBy("team", "author_id").agg(F.sum("posts").alias("posts"), F.max_by("newest_name", "ts").alias("newest_name"))
    top = sums.withColumn("place", F.row_number().over(W.partitionBy("team").orderBy(F.desc("posts"), "author_id"))).where(F.col("place") <= k)
    parts = activity.where("category_id is not null").groupBy("team", "author_id", "category_id").agg(F.sum("posts").alias("n"))
    held = parts.join(top.select("team", "author_id"), ["team", "author_id"]).groupBy("team", "author_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category_id", "n"))))).alias("categories"))
    return top.join(held, ["team", "author_id"], "left").withColumn("categories", F.coalesce("categories", F.lit("{}")))


def activity_by_category(posts: DataFrame, bucket: Column) -> DataFrame:
    """Per bucket and author, and per bucket, author and category: posts, sell, newest name. Rows over all categories have null for it."""
    rows = posts.withColumn("ts", bucket)
    metrics = [F.count("*").alias("posts"), F.count_if(F.col("intent") == "sell").alias("sell"), F.max_by("author_name", F.struct("first_seen_at", "id")).alias("newest_name")]
    keys = ["ts", "team", "author_id"]
    by_category = rows.where("category_id is not null").groupBy(*keys, "category_id").agg(*metrics)
    return rows.groupBy(*keys).agg(*metrics).withColumn("category_id", F.lit(None).cast(dict(by_category.dtypes)["category_id"])).unionByName(by_category)


def by_capture(posts: DataFrame, at: Column) -> DataFrame:
    """Posts of the last 24 hours by way of capture; none is unknown."""
    return posts.where(F.col("first_seen_at") > at - F.expr("interval 24 hours")).groupBy(F.coalesce("capture", F.lit("unknown")).alias("capture")).agg(F.count("*").alias("posts"))


def watch_stats(watches: DataFrame, matches: DataFrame, deals: DataFrame, today: Column, days: int) -> DataFrame:
    """Per watch: matches of each of the last ``days`` days (oldest first, comma-joined), of today and of all of them, the last hit, and the best deal.

    matches: post_id, watch_id, created_at (local); deals: post_id, deal_pct. The best deal is the lowest negative one of these days, the newer of equals.
    """
    recent = matches.withColumn("back", F.datediff(today, F.to_date("created_at"))).where(F.col("back").between(0, days - 1))
    counts = recent.groupBy("watch_id", "back").agg(F.count("*").alias("n")).groupBy("watch_id").agg(F.map_from_entries(F.collect_list(F.struct("back", "n"))).alias("held"))
    last = matches.groupBy("watch_id").agg(F.max("created_at").alias("last_hit"))
    good = recent.join(deals.where("deal_pct < 0"), "post_id").groupBy("watch_id").agg(F.min_by(F.struct("post_id", "deal_pct"), F.struct("deal_pct", (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("late"), "post_id")).alias("best"))
    held = F.coalesce("held", F.create_map().cast("map<int,bigint>"))
    daily = F.transform(F.sequence(F.lit(days - 1), F.lit(0), F.lit(-1)), lambda i: F.coalesce(F.try_element_at(held, i), F.lit(0)))
    out = watches.select("watch_id").join(counts, "watch_id", "left").join(last, "watch_id", "left").join(good, "watch_id", "left").withColumn("daily", daily)
    return out.select("watch_id", F.array_join(F.col("daily").cast("array<string>"), ",").alias("daily"), F.element_at("daily", -1).alias("today"), F.aggregate("daily", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), "last_hit", F.col("best.post_id").alias("best_post_id"), F.col("best.deal_pct").alias("best_deal_pct"))


def team_volume(posts: DataFrame, at: Column, days: int) -> DataFrame:
    """Per team: posts of the last days, and when the last one came."""
    return posts.groupBy("team").agg(F.count_if(F.col("first_seen_at") > at - F.expr(f"interval {days} days")).alias("recent"), F.max("first_seen_at").alias("last_seen"))


def pipeline_counts(posts: DataFrame, at: Column, stale_s: int) -> DataFrame:
    """One row: posts stranded in a pending state for longer than stale_s, and failed ones."""
    old = F.unix_seconds(at.cast("timestamp")) - F.unix_seconds(F.col("updated_at").cast("timestamp")) > stale_s
    return posts.agg(F.count_if((F.col("state") == "pending") & old).alias("stranded"), F.count_if(F.col("state") == "failed").alias("failed"), F.count_if(F.col("state") == "pending").alias("pending"))


def gauges(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("value"))


def exposition(metrics: DataFrame, name: str, labels: list[str], allowed: tuple[str, ...]) -> DataFrame:
    """One text line per row for a scraper: name{label="value",…} value. Labels that are not allowed raise."""
    if bad := [x for x in labels if x not in allowed]:
        raise ValueError(f"labels not allowed: {bad}")
    quoted = lambda c: F.concat(F.lit(f'{c}="'), F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return metrics.select(F.concat(F.lit(name + "{"), F.concat_ws(",", *map(quoted, labels)), F.lit("} "), F.col("value").cast("string")).alias("line"))


def failure_rate(notifications: DataFrame, at: Column, minutes: int, least: int, over_pct: float) -> DataFrame:
    """One row: sent and failed of the last minutes, the rate in per cent, and whether it alerts (enough samples and above the limit)."""
    recent = notifications.where(F.col("status").isin("sent", "failed") & (F.col("created_at") >= at - F.expr(f"interval {minutes} minutes")))
    total = F.col("sent") + F.col("failed")
    sums = recent.agg(F.count_if(F.col("status") == "sent").alias("sent"), F.count_if(F.col("status") == "failed").alias("failed"))
    rate = F.when(total > 0, F.round(100 * F.col("failed") / total, 6))
    return sums.select("sent", "failed", rate.alias("rate_pct"), ((total >= least) & F.coalesce(rate > over_pct, F.lit(False))).alias("alert"))


def topic_list(topics: DataFrame, volume: DataFrame, spikes: DataFrame, today: Column) -> DataFrame:
    """Per topic: posts of the last 7 days, and the last day with a spike."""
    recent = volume.where(F.datediff(today, F.col("day")).between(0, 6)).groupBy("topic").agg(F.sum("posts").alias("posts7d"))
    return topics.select("topic").join(recent, "topic", "left").join(spikes.groupBy("topic").agg(F.max("day").alias("last_spike")), "topic", "left").withColumn("posts7d", F.coalesce("posts7d", F.lit(0)))


def digest_topics(volume: DataFrame, day: Column, baseline_days: int, size: int) -> DataFrame:
    """A day's topics with most posts (ties by name): posts, mean of the days before, difference, neg and pos, and the line that a digest shows."""
    back = F.datediff(day, F.col("day"))
    sums = volume.where(back.between(0, baseline_days)).groupBy("topic").agg(
        F.coalesce(F.sum(F.when(back == 0, F.col("posts"))), F.lit(0)).alias("posts"), *[F.coalesce(F.sum(F.when(back == 0, F.col(c))), F.lit(0)).alias(c) for c in ("neg", "pos")],
        F.round(F.coalesce(F.sum(F.when(back > 0, F.col("posts"))), F.lit(0)) / baseline_days, 6).alias("mean"),
    )
    top = sums.where("posts > 0").withColumn("place", F.row_number().over(W.orderBy(F.desc("posts"), "topic"))).where(F.col("place") <= size)
    delta = F.col("posts") - F.col("mean")
    line = F.format_string(f"%d. %s: %d posts (%s%.1f vs {baseline_days}-day avg %.1f), neg %d / pos %d", F.col("place"), F.col("topic"), F.col("posts"), F.when(delta >= 0, "+").otherwise(""), F.round(delta, 1), F.round("mean", 1), F.col("neg"), F.col("pos"))
    return top.select("place", "topic", "posts", "mean", "neg", "pos", line.alias("line"))


def notable(posts: DataFrame, predicates: dict[str, Column], complaint: Column, size: int) -> DataFrame:
    """Posts of any topic: complaints first, then those of more topics, then the newest."""
    from functools import reduce

    hits = reduce(lambda a, b: a + b, [F.when(p, 1).otherwise(0) for p in predicates.values()])
    rows = posts.withColumn("topics", hits).where("topics > 0").withColumn("complaint", F.coalesce(complaint, F.lit(False)))
    return rows.orderBy(F.desc("complaint"), F.desc("topics"), F.desc("first_seen_at"), F.desc("id")).limit(size).select("id", "complaint", "topics")


def price_suggestion(posts: DataFrame, at: Column, days: int) -> DataFrame:
    """Trimmed price statistics of each item's posts of the last days."""
    return trimmed_stats(posts.where((F.col("first_seen_at") >= at - F.expr(f"interval {days} days")) & (F.col("first_seen_at") < at)), ["item_id"])


def unseen(rows: DataFrame, marks: DataFrame, owner: str, ts: str) -> DataFrame:
    """Per owner the rows after their watermark (all without one)."""
    joined = rows.join(marks, owner, "left")
    return joined.groupBy(owner).agg(F.count_if(F.col("seen_until").isNull() | (F.col(ts) > F.col("seen_until"))).alias("unseen"))


def visit_listing(visits: DataFrame, posts: DataFrame, source: int, before: tuple | None, size: int) -> DataFrame:
    """A page of one source's visits, newest first, each with the number of posts that it brought. before: (started_at, id) of the row before the page."""
    own = visits.where(F.col("source_id") == source)
    if before is not None:
        own = own.where(F.struct("started_at", "id") < F.struct(F.lit(before[0]).cast(dict(visits.dtypes)["started_at"]).alias("started_at"), F.lit(before[1]).cast("bigint").alias("id")))
    page = own.orderBy(F.desc("started_at"), F.desc("id")).limit(size)
    brought = posts.join(page.select(F.col("id").alias("visit_id")), "visit_id").groupBy("visit_id").agg(F.count("*").alias("posts"))
    return page.join(brought, page["id"] == brought["visit_id"], "left").select("id", "started_at", "outcome", F.coalesce("posts", F.lit(0)).alias("posts"))


def consecutive(visits: DataFrame, outcome: str) -> DataFrame:
    """Finished visits of a source with an outcome, right after another one with it."""
    w = W.partitionBy("source_id").orderBy("started_at", "id")
    return visits.where("outcome is not null").withColumn("before", F.lag("outcome").over(w)).where((F.col("outcome") == outcome) & (F.col("before") == outcome)).select("id", "source_id")


def best_of(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The rows with the least value of their group, all of them where several have it; rows without a value never."""
    return rows.where(F.col(value).isNotNull()).withColumn("place", F.rank().over(W.partitionBy(group).orderBy(value))).where("place = 1").drop("place")


def comparables(rows: DataFrame, year: float | None, odo: float | None, size: int) -> DataFrame:
    """The nearest listings: by gap of years, then of kilometres (unknown last), then the newest."""
    gap = lambda c, x: F.abs(F.col(c) - F.lit(x)) if x is not None else F.lit(None).cast("double")
    return rows.orderBy(F.asc_nulls_last(gap("year", year)), F.asc_nulls_last(gap("odo", odo)), F.desc("seen_at"), "id").limit(size)


def inbox_page(rows: DataFrame, order: str, offset: int, size: int) -> DataFrame:
    """A page of the inbox by offset: deal, price or score first, rows without a value last, ties by the newer match."""
    first = {"deal": F.asc_nulls_last("deal_pct"), "price": F.asc_nulls_last("price"), "score": F.desc_nulls_last("score")}[order]
    return rows.orderBy(first, F.desc("created_at"), F.desc("post_id"), F.desc("watch_id")).offset(offset).limit(size)


def dead_letters(jobs: DataFrame) -> DataFrame:
    """By queue: how many jobs failed for good, the oldest, and the error of the newest."""
    return jobs.where("state = 'dead'").groupBy("queue").agg(F.count("*").alias("n"), F.min("at").alias("oldest"), F.max_by("error", F.struct("at", "id")).alias("last_error"))


def overwrite_buckets(rows: DataFrame, path: str, bucket: str) -> None:
    """Replaces whole buckets: those that ``rows`` hold are written anew, others stay. A rerun gives the same table."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(bucket).parquet(path)


def daily_counts(posts: DataFrame, topic: Column) -> DataFrame:
    """Posts by topic and day, with those of bad and good tone."""
    return posts.groupBy(topic.alias("topic"), F.to_date(day_of("first_seen_at")).alias("day")).agg(F.count("*").alias("posts"), *[F.count_if(F.col("sentiment") == s).alias(s) for s in ("neg", "pos")])
