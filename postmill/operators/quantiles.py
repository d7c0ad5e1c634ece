"""Exact quantiles and ranks of groups of any size. A group too large for one task is never brought together.

A sketch (mergeable, of bounded size) tells between which two prices a rank must lie. One aggregate counts what is below,
and only the few prices in between are looked at. Quantiles interpolate linearly between order statistics.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Groups of at most so many rows are one task's work; the sketch of larger ones tells ranks to one part in ACCURACY.
SMALL, ACCURACY = 1_000_000, 2_000


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.equal_null(F.col(f"{a}.{k}"), F.col(f"{b}.{k}")) for k in keys])


def percentiles(rows: DataFrame, keys: list[str], price: str, shares: list[float], small: int = SMALL, accuracy: int = ACCURACY) -> DataFrame:
    """keys, n and p (the quantiles in the order of ``shares``) of rows with a price. Null keys are a group."""
    rows = rows.where(F.col(price).isNotNull()).select(*keys, F.col(price).cast("double").alias("_x"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    # one pass tells the large groups (of n rows there are fewer than n / small, so they go to the driver) and whether there are others
    found = sizes.groupBy(F.when(F.col("n") > small, F.struct(*keys)).alias("k")).agg(F.count("*")).select("k").collect()
    large = [tuple(r["k"]) for r in found if r["k"] is not None]
    plain = lambda df: df.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("_x", shares).alias("p"))
    if not large:
        return plain(rows)
    a, b = rows.alias("a"), F.broadcast(rows.sparkSession.createDataFrame(large, rows.select(*keys).schema)).alias("b")
    many = selected(rows if len(large) == len(found) else a.join(b, _same("a", "b", keys), "left_semi"), keys, shares, accuracy)
    return many if len(large) == len(found) else plain(a.join(b, _same("a", "b", keys), "left_anti")).unionByName(many)


def selected(rows: DataFrame, keys: list[str], shares: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """percentiles() of rows (keys, _x) by selection: bounds from a sketch, counts below, and the prices between the bounds."""
    low, high = [max(0.0, s - 2 / accuracy) for s in shares], [min(1.0, s + 2 / accuracy) for s in shares]
    edge = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("_x", low, accuracy).alias("lo"), F.percentile_approx("_x", high, accuracy).alias("hi"), F.min("_x").alias("least"), F.max("_x").alias("most"))
    # the ends are known exactly
    edge = edge.withColumn("lo", F.array(*[F.col("least") if x == 0 else F.get("lo", F.lit(i)) for i, x in enumerate(low)])).withColumn("hi", F.array(*[F.col("most") if x == 1 else F.get("hi", F.lit(i)) for i, x in enumerate(high)]))
    # a row a group, and groups are large
    edge = F.broadcast(rows.sparkSession.createDataFrame(edge.collect(), edge.schema))
    each = range(len(shares))
    lo, hi = lambda i: F.get("lo", F.lit(i)), lambda i: F.get("hi", F.lit(i))
    within = reduce(lambda x, y: x | y, [F.col("_x").between(lo(i), hi(i)) for i in each])
    cell = reduce(lambda x, y: x + y, [(F.col("_x") > e(i)).cast("int") for e in (lo, hi) for i in each])
    met = rows.alias("a").join(edge.select(*keys, "lo", "hi").alias("b"), _same("a", "b", keys)).select(*[f"a.{k}" for k in keys], "_x", cell.alias("cell"), F.when(within, F.col("_x")).alias("v"))
    # one aggregate holds both: prices between bounds, each with its number, and one row for all prices between two intervals, on the same side of each bound
    cells = met.groupBy(*keys, "cell", "v").agg(F.count("*").alias("c"), F.min("_x").alias("_x"))
    bounded = cells.alias("a").join(edge.select(*keys, "lo", "hi").alias("b"), _same("a", "b", keys)).select("a.*", "lo", "hi")
    below = bounded.groupBy(*keys).agg(F.array(*[F.coalesce(F.sum(F.when(F.col("_x") < lo(i), F.col("c"))), F.lit(0)) for i in each]).alias("below"))
    inside = F.array_compact(F.array(*[F.when(F.col("v").between(lo(i), hi(i)), i) for i in each]))
    values = bounded.where(F.col("v").isNotNull()).select(*keys, F.col("v").alias("_x"), "c", F.explode(inside).alias("i"))
    upto = F.sum("c").over(W.partitionBy(*keys, "i").orderBy("_x").rowsBetween(W.unboundedPreceding, 0))
    ranked = values.withColumn("upto", upto).alias("a").join(below.alias("b"), _same("a", "b", keys)).join(edge.select(*keys, "n").alias("c"), _same("a", "c", keys))
    # a price stands at the ranks [first, last]; the quantile lies at pos, between whole ranks
    share = F.element_at(F.array(*map(F.lit, shares)), F.col("i") + 1)
    pos, last = share * (F.col("n") - 1), F.get("below", F.col("i")) + F.col("upto") - 1
    first = last - F.col("c") + 1
    at = lambda r: F.max(F.when((first <= r) & (r <= last), F.col("_x")))
    one = ranked.groupBy(*[f"a.{k}" for k in keys], "n", "i").agg(at(F.floor(pos)).alias("x"), at(F.ceil(pos)).alias("y"), F.max(pos - F.floor(pos)).alias("f"))
    checked = F.when(F.col("x").isNull() | F.col("y").isNull(), F.raise_error(F.lit("a rank lies outside of the sketch's bounds"))).otherwise(F.col("x") + F.col("f") * (F.col("y") - F.col("x")))
    return one.withColumn("q", checked).groupBy(*keys, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]).alias("p"))


def shares_below(rows: DataFrame, key: str, price: str, parts: int = 256) -> DataFrame:
    """rows with share_below: which part of the key's rows has a lower price. Rows are ranked within one of many ranges of their key, and counts of ranges make up the rest."""
    some = rows.where(F.col(price).isNotNull())
    cuts = some.groupBy(key).agg(F.percentile_approx(price, [i / parts for i in range(1, parts)], 4 * parts).alias("cuts"))
    placed = some.alias("a").join(cuts.alias("b"), F.equal_null(F.col(f"a.{key}"), F.col(f"b.{key}"))).select("a.*", F.size(F.filter("cuts", lambda c: c < F.col(f"a.{price}"))).alias("_part"))
    counts = placed.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy(key).orderBy("_part")
    counts = counts.withColumns({"_below": F.sum("_n").over(before.rowsBetween(W.unboundedPreceding, -1)), "_all": F.sum("_n").over(W.partitionBy(key))})
    own = placed.withColumn("_rank", F.rank().over(W.partitionBy(key, "_part").orderBy(price)) - 1)
    same = F.equal_null(F.col(f"a.{key}"), F.col(f"b.{key}")) & (F.col("a._part") == F.col("b._part"))
    return own.alias("a").join(counts.alias("b"), same).select(*[f"a.{c}" for c in rows.columns], ((F.coalesce("b._below", F.lit(0)) + F.col("a._rank")) / F.col("b._all")).alias("share_below"))
