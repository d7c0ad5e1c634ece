"""Term counts and what is unusual about them: z-scores, lifts, spikes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.functions.times import hour_of


def term_counts(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """By hour, term and category (null for all): posts with the term, each once, after merging by alias and dropping.

    terms: id, first_seen_at, category_id, term. aliases: term, into (null: the term is dropped); a small dimension.
    Counts for all categories are added up from those of each; a filter by ts reaches the posts.
    """
    merged = terms.join(aliases.withColumn("known", F.lit(True)), "term", "left").where("known is null or into is not null").withColumn("term", F.coalesce("into", "term"))
    once = merged.select("id", hour_of("first_seen_at").alias("ts"), "category_id", "term").distinct()
    each = once.groupBy("ts", "term", "category_id").agg(F.count("*").alias("n"))
    return with_totals(each)


def with_totals(each: DataFrame) -> DataFrame:
    """Counts (ts, term, category_id, n) and those for all categories."""
    own, every = F.col("category_id"), F.when(F.lit(False), F.col("category_id"))
    sets = each.select("ts", "term", "n", F.explode(F.when(own.isNull(), F.array(every)).otherwise(F.array(every, own))).alias("category_id"))
    return sets.groupBy("ts", "term", "category_id").agg(F.sum("n").alias("n"))


def zscore(x: Column, mean: Column, sd: Column) -> Column:
    return (x - mean) / F.greatest(sd, F.sqrt(mean), F.lit(1.0))


def hour_trend(hist: DataFrame, hour: Column, least: int, least_z: float, hours: int = 168) -> DataFrame:
    """Terms of one hour against the hours before it, of which missing ones count 0, by sums and sums of squares."""
    rows = hist.where("category_id is null")
    span = rows.where((F.col("ts") <= hour) & (F.col("ts") >= hour - F.expr(f"interval {hours} hours")))
    now, before = F.col("ts") == hour, F.col("ts") < hour
    sums = span.groupBy("term").agg(F.sum(F.when(now, F.col("n"))).alias("n"), F.coalesce(F.sum(F.when(before, F.col("n"))), F.lit(0)).alias("s"), F.coalesce(F.sum(F.when(before, F.col("n") * F.col("n"))), F.lit(0)).alias("q"))
    mean = F.col("s") / hours
    sd = F.sqrt(F.greatest(F.col("q") / hours - mean * mean, F.lit(0.0)))
    return sums.where(F.col("n") >= least).withColumn("z", F.round(zscore(F.col("n"), mean, sd), 6)).where(F.col("z") >= least_z).select("term", "n", "z")


def day_trend(hist: DataFrame, hour: Column, least: int, least_lift: float) -> DataFrame:
    """Terms of the 24 hours up to one against 24 times the mean of the 168 hours that end before the hour 24 back: lift, newness, change in per cent (null if new), z with the root of 24 hours' deviations."""
    rows = hist.where("category_id is null")
    back = F.expr("1") * ((F.unix_seconds(hour.cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))) / 3600).cast("bigint")
    spans = rows.withColumn("back", back).where("back between 0 and 192 and back <> 24")
    now, before = F.col("back") < 24, F.col("back") > 24
    total = lambda when, x: F.coalesce(F.sum(F.when(when, x)), F.lit(0))
    n = F.col("n")
    sums = spans.groupBy("term").agg(total(now, n).alias("n"), total(before, n).alias("s"), total(before, n * n).alias("q"))
    base, mean = 24 * F.col("s") / 168, F.col("s") / 168
    sd = F.sqrt(24 * F.greatest(F.col("q") / 168 - mean * mean, F.lit(0.0)))
    change = F.when(base >= 0.5, F.floor(F.round(100 * (n / base - 1), 6) + 0.5).cast("bigint"))
    out = sums.where(n >= least).select("term", "n", F.round(base, 6).alias("baseline"), F.round((n + 1) / (base + 1), 6).alias("lift"), (base < 0.5).alias("is_new"), change.alias("delta_pct"), F.round(zscore(n, base, sd), 6).alias("z"))
    return out.where((F.col("lift") >= least_lift) | F.col("is_new"))


def display_vote(names: DataFrame, key: str, name: str) -> DataFrame:
    """The most frequent spelling of each key; of equals the smallest."""
    counts = names.groupBy(key, name).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("minus"), F.col(name).alias("name"))).alias("b"))
    return best.select(key, F.col("b.name").alias("display"), (-F.col("b.minus")).alias("votes"))


def daily_spikes(daily: DataFrame, keys: list[str], days: int, least: int, ratio: float, least_z: float) -> DataFrame:
    """Days of a series (keys, day, n; absent days are 0) that exceed the days before by ratio and z-score; mean and deviation are at least 1."""
    at = daily.withColumn("d", F.datediff("day", F.lit("1970-01-01").cast("date")))
    w = W.partitionBy(*keys).orderBy("d").rangeBetween(-days, -1)
    s, q = F.coalesce(F.sum("n").over(w), F.lit(0)) / days, F.coalesce(F.sum(F.col("n") * F.col("n")).over(w), F.lit(0)) / days
    sd = F.greatest(F.sqrt(F.greatest(q - s * s, F.lit(0.0))), F.lit(1.0))
    out = at.select(*keys, "day", "n", F.round(F.col("n") / F.greatest(s, F.lit(1.0)), 6).alias("ratio"), F.round((F.col("n") - s) / sd, 6).alias("z"))
    return out.where((F.col("n") >= least) & (F.col("ratio") >= ratio) & (F.col("z") >= least_z))
