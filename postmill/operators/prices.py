"""Robust price statistics, deal scores and price series. Quantiles interpolate linearly between order statistics."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.functions.times import local_start
from postmill.operators.quantiles import SMALL, percentiles, shares_below


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + 0.5).cast("bigint")


def trimmed_stats(rows: DataFrame, keys: list[str], price: str = "price", small: int = SMALL) -> DataFrame:
    """By key over positive prices: n_raw, and n, median, p25, p75 of those within 1.5 interquartile ranges (from four prices on, and if the range is not 0). Keys with more than ``small`` prices are ranked by selection."""
    some = rows.where(F.col(price) > 0)
    quarters = percentiles(some, keys, price, [0.25, 0.75], small).withColumnsRenamed({"n": "n_raw", "p": "q"})
    lo, hi = F.col("q")[0], F.col("q")[1]
    inside = (F.col("n_raw") < 4) | (hi == lo) | F.col(price).between(lo - 1.5 * (hi - lo), hi + 1.5 * (hi - lo))
    kept = some.join(quarters, keys).where(inside)
    out = percentiles(kept, keys, price, [0.5, 0.25, 0.75], small).join(quarters.select(*keys, "n_raw"), keys)
    return out.select(*keys, "n_raw", "n", *[half_up(F.col("p")[i]).alias(name) for i, name in enumerate(("median", "p25", "p75"))])


def distribution(rows: DataFrame, keys: list[str], least: int, price: str = "price", small: int = SMALL) -> DataFrame:
    """Deciles 10, 25, 50, 75, 90 by key, not trimmed; keys with fewer than ``least`` prices are left out."""
    shares = [0.1, 0.25, 0.5, 0.75, 0.9]
    out = percentiles(rows.where(F.col(price) > 0), keys, price, shares, small).where(F.col("n") >= least)
    return out.select(*keys, "n", *[F.round(F.col("p")[i], 4).alias(f"p{round(100 * s)}") for i, s in enumerate(shares)])


def _between(held: list[float], start: int, n: int, share: float) -> float:
    """A quantile of n sorted values from start on."""
    pos = (n - 1) * share
    k = int(pos)
    a = held[start + k]
    return a + (pos - k) * (held[start + min(k + 1, n - 1)] - a)


def trimmed_median(held: list[float], least: int) -> tuple[int, int] | None:
    """(n, median) of sorted prices within 1.5 interquartile ranges, by places alone; None for fewer than ``least`` before or after, or a median of 0."""
    n, start = len(held), 0
    if n < least:
        return None
    q1, q3 = _between(held, 0, n, 0.25), _between(held, 0, n, 0.75)
    if q3 > q1 and n >= 4:
        start = bisect_left(held, q1 - 1.5 * (q3 - q1))
        n = bisect_right(held, q3 + 1.5 * (q3 - q1)) - start
    median = math.floor(_between(held, start, n, 0.5) + 0.5) if n else 0
    return (n, median) if n >= least and median > 0 else None


def sliding_stats(sec: list[int], price: list[float], own: list[bool], span: int, least: int, most: int) -> Iterator[tuple[int, int] | None]:
    """trimmed_median of the newest ``most`` rows of [sec - span, sec) for each own row; rows come by time. The frame's prices stay sorted: rows enter and leave it, none is sorted anew."""
    held: list[float] = []
    lo = hi = first = 0  # rows lo to hi are in the frame; first is the first of this time
    for i, at in enumerate(sec):
        if sec[first] != at:
            first = i
        while hi < first:
            insort(held, price[hi])
            hi += 1
        while lo < hi and (sec[lo] < at - span or hi - lo > most):
            del held[bisect_left(held, price[lo])]
            lo += 1
        yield trimmed_median(held, least) if own[i] else None


def deal_scores(posts: DataFrame, days: int, least: int, most: int = 500) -> DataFrame:
    """Per enriched post: n and median (rounded) of its peers' prices, and how far it lies from the median in per cent (one decimal).

    Peers are the newest ``most`` enriched posts of the same item of the ``days`` before. They are trimmed as in
    trimmed_stats; fewer than ``least`` before or after that, or a median of 0: no row. Rows are dealt out by item and span
    of ``days``, with the newest ``most`` of the span before, so a task holds one span of one item.
    """
    span = days * 86_400
    rows = posts.where("enriched and price > 0").select("id", "item_id", "price", F.unix_seconds(F.col("first_seen_at").cast("timestamp")).alias("sec"))
    rows = rows.withColumn("span", F.floor(F.col("sec") / span))
    newest = W.partitionBy("item_id", "span").orderBy(F.desc("sec"), F.desc("id"))
    context = rows.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= most).drop("back").withColumn("span", F.col("span") + 1)
    both = rows.withColumn("own", F.lit(True)).unionByName(context.withColumn("own", F.lit(False)))
    item = dict(posts.dtypes)["item_id"]

    def score(group):
        import pandas as pd

        group = group.sort_values(["sec", "id"])
        sec, price, own = group["sec"].tolist(), group["price"].tolist(), group["own"].tolist()
        found = [(i, *stats) for i, stats in enumerate(sliding_stats(sec, price, own, span, least, most)) if stats]
        rows = [i for i, _, _ in found]
        return pd.DataFrame({"id": group["id"].to_numpy()[rows], "item_id": group["item_id"].to_numpy()[rows], "price": group["price"].to_numpy()[rows], "n": [n for _, n, _ in found], "median": [m for _, _, m in found]})

    scored = both.groupBy("item_id", "span").applyInPandas(score, f"id bigint, item_id {item}, price double, n bigint, median bigint")
    return scored.withColumn("pct", F.floor(F.round(1000 * (F.col("price") - F.col("median")) / F.col("median"), 6) + 0.5) / 10)


def daily_medians(posts: DataFrame) -> DataFrame:
    return posts.where("enriched and price > 0").groupBy("item_id", F.to_date("first_seen_at").alias("day")).agg(F.count("*").alias("n"), F.round(F.percentile("price", 0.5), 4).alias("median"))


def against_before(daily: DataFrame, spans: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Each day's median against the mean of the medians of the days before, weighted by their numbers, in per cent."""
    at = daily.withColumn("d", F.datediff("day", F.lit("1970-01-01").cast("date")))
    out = at
    for s in spans:
        w = W.partitionBy("item_id").orderBy("d").rangeBetween(-s, -1)
        base = F.sum(F.col("n") * F.col("median")).over(w) / F.sum("n").over(w)
        out = out.withColumn(f"vs{s}d", F.round(100 * (F.col("median") - base) / base, 2))
    return out.drop("d")


def weekly_medians(posts: DataFrame, least: int, zone: str) -> DataFrame:
    """Median of asking prices by category and week of a zone (as the UTC time of its start); null for fewer than ``least``."""
    rows = posts.where("category_id is not null and price > 0")
    return rows.groupBy("category_id", local_start("week", "first_seen_at", zone).alias("week")).agg(F.count("*").alias("n"), F.round(F.when(F.count("*") >= least, F.percentile("price", 0.5)), 4).alias("median"))


def new_lows(posts: DataFrame, since: Column, k: int) -> DataFrame:
    """Posts since a time that are cheaper than all of their item before it, at most k, cheapest relative to it first."""
    rows = posts.where("enriched and price > 0")
    prior = rows.where(F.col("first_seen_at") < since).groupBy("item_id").agg(F.min("price").alias("prior_min"))
    found = rows.where(F.col("first_seen_at") >= since).join(prior, "item_id").where("price < prior_min")
    return found.select("id", "item_id", "price", "prior_min").orderBy(F.col("price") / F.col("prior_min"), "id").limit(k)


def percentile_ranks(rows: DataFrame, key: str) -> DataFrame:
    """The share of the key's prices strictly below, 0 to 100."""
    found = shares_below(rows.where("price > 0").select("id", key, "price"), key, "price")
    return found.select("id", key, "price", F.round(100.0 * F.col("share_below"), 4).alias("rank_pct"))
