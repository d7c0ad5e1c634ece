"""Deal scores against peers by scope: the same item, or else the subtree of the category that declares the schema; with equal key attributes, and others within a tolerance.

A post is the target of one scope and a peer in several: its item's, and that of each category above it that declares a schema. Both
sides carry the scope and the key attributes as one text, so peers are found by equality; tolerances and times are looked at within a group.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.operators.enrich import ancestors, resolved_schemas
from postmill.operators.prices import trimmed_median


def key_definitions(categories: DataFrame, declared: DataFrame) -> DataFrame:
    """(category_id, owner, defs): the nearest category at or above that declares a schema, and the key attributes as (key, optional, tolerance), sorted. Categories without key attributes are left out.

    declared: category_id, key, key_attr, optional, tolerance (null: values must be equal).
    """
    owners = ancestors(categories).join(declared.select(F.col("category_id").alias("above")).distinct(), "above").groupBy("category_id").agg(F.max_by("above", "depth").alias("owner"))
    own = resolved_schemas(categories, declared).where("key_attr").groupBy("category_id").agg(F.array_sort(F.collect_list(F.struct("key", F.coalesce("optional", F.lit(False)).alias("optional"), "tolerance"))).alias("defs"))
    return owners.join(own, "category_id")


def _exact(keys, attributes):
    """key=value of some keys, end to end; null if one is absent."""
    pairs = F.transform(keys, lambda k: F.concat(k, F.lit("="), F.try_element_at(attributes, k)))
    return F.when(~F.exists(pairs, lambda p: p.isNull()), F.array_join(pairs, "\u001f"))


def _near(ranges, attributes):
    """The numbers of some keys; null if one is none."""
    numbers = F.transform(ranges, lambda r: F.try_element_at(attributes, r["key"]).try_cast("double"))
    return F.when(~F.exists(numbers, lambda n: n.isNull()), numbers)


def targets(posts: DataFrame, definitions: DataFrame) -> DataFrame:
    """Posts that can be scored, with their scope, the keys that must be equal (and their values) and those that must be near.

    Scored are priced sell posts of a category with key attributes that have all but the optional ones.
    """
    rows = posts.where("intent = 'sell' and price is not null").join(definitions, "category_id")
    has = lambda d: F.try_element_at("attributes", d["key"]).isNotNull()
    rows = rows.where(F.forall("defs", lambda d: d["optional"] | has(d))).withColumn("held", F.filter("defs", has))
    scope = F.coalesce(F.concat(F.lit("i:"), F.col("item_id").cast("string")), F.concat(F.lit("c:"), F.col("owner").cast("string")))
    rows = rows.withColumns({"scope": scope, "keys": F.transform(F.filter("held", lambda d: d["tolerance"].isNull()), lambda d: d["key"]), "ranges": F.transform(F.filter("held", lambda d: d["tolerance"].isNotNull()), lambda d: F.struct(d["key"].alias("key"), d["tolerance"].cast("double").alias("tolerance")))})
    return rows.withColumns({"exact": _exact(F.col("keys"), F.col("attributes")), "near": _near(F.col("ranges"), F.col("attributes"))}).where("near is not null")


def scored_by_scope(posts: DataFrame, categories: DataFrame, declared: DataFrame, days: int, least: int, most: int = 500) -> DataFrame:
    """(id, scope, price, n, median, pct) of posts with at least ``least`` peers before and after trimming (see prices.trimmed_median).

    posts: id, at, item_id, category_id, intent, price, comparable, attributes (a map of texts). Peers of a target are the newest
    ``most`` (of equal times the dearest) comparable sell posts of [at - days, at) of its scope, with its exact attributes and the others within tolerance.
    Groups are dealt out by scope, attributes and span of ``days``. A task holds one span of a group, and of the span before the newest
    ``most`` of each combination of near values, since no frame reaches further.
    """
    span = days * 86_400_000_000
    # whole microseconds: posts of one second are still in order
    rows = posts.withColumn("time", F.unix_micros(F.col("at").cast("timestamp")))
    definitions = key_definitions(categories, declared)
    wanted = targets(rows, definitions)
    shapes = wanted.select("scope", "keys", "ranges").distinct()
    # a peer's scopes: its item, and every owner at or above its category
    owners = definitions.select(F.col("owner").alias("above")).distinct()
    above = ancestors(categories).join(owners, "above").groupBy("category_id").agg(F.collect_set("above").alias("aboves"))
    sold = rows.where("intent = 'sell' and price > 0 and comparable").join(above, "category_id", "left")
    scopes = F.concat(F.array_compact(F.array(F.concat(F.lit("i:"), F.col("item_id").cast("string")))), F.transform(F.coalesce("aboves", F.array().cast("array<string>")), lambda a: F.concat(F.lit("c:"), a.cast("string"))))
    peers = sold.select("id", "time", "price", "attributes", F.explode(scopes).alias("scope")).join(shapes, "scope")
    peers = peers.withColumns({"exact": _exact(F.col("keys"), F.col("attributes")), "near": _near(F.col("ranges"), F.col("attributes"))}).where("exact is not null and near is not null")
    columns = ["scope", "shape", "exact", "near", "time", "id", "price"]
    slim = lambda df: df.withColumn("shape", F.to_json(F.struct("keys", "ranges"))).withColumn("span", F.floor(F.col("time") / span))
    wide, peers = slim(wanted), slim(peers)
    place = W.partitionBy("scope", "shape", "exact", "near", "span").orderBy(F.desc("time"), F.desc("price"), F.desc("id"))
    before = peers.withColumn("back", F.row_number().over(place)).where(F.col("back") <= most).withColumn("span", F.col("span") + 1)
    part = lambda df, kind: df.select(*columns, "span", F.lit(kind).alias("kind"))
    both = part(wide, 0).unionByName(part(peers, 1)).unionByName(part(before, 1))

    def score(group):
        import json

        import numpy as np
        import pandas as pd

        tolerance = np.array([r["tolerance"] for r in json.loads(group["shape"].iloc[0])["ranges"]], float)
        group = group.sort_values(["time", "price", "id"])
        lists: dict[tuple, tuple[list, list]] = {}
        for key, time, price, kind in zip(map(tuple, group["near"]), group["time"], group["price"], group["kind"], strict=True):
            if kind:
                times, values = lists.setdefault(key, ([], []))
                times.append(time)
                values.append(price)
        keys = np.array(list(lists), float).reshape(len(lists), len(tolerance))
        held, found = list(lists.values()), []
        for near, time, key, price, kind in zip(group["near"], group["time"], group["id"], group["price"], group["kind"], strict=True):
            if kind or not held:
                continue
            frame = []
            for k in np.flatnonzero((np.abs(keys - np.asarray(near, float)) <= tolerance).all(axis=1)).tolist():
                times, values = held[k]
                hi = bisect_left(times, time)
                lo = max(bisect_left(times, time - span), hi - most)
                frame += zip(times[lo:hi], values[lo:hi], strict=True)
            if len(frame) > most:
                frame.sort()
                frame = frame[-most:]
            stats = trimmed_median(sorted(p for _, p in frame), least)
            if stats:
                found.append((key, price, *stats))
        return pd.DataFrame({"id": [f[0] for f in found], "scope": group["scope"].iloc[0], "price": [f[1] for f in found], "n": [f[2] for f in found], "median": [f[3] for f in found]})

    id_type = dict(posts.dtypes)["id"]
    scored = both.groupBy("scope", "shape", "exact", "span").applyInPandas(score, f"id {id_type}, scope string, price double, n bigint, median bigint")
    return scored.withColumn("pct", F.floor(F.round(1000 * (F.col("price") - F.col("median")) / F.col("median"), 6) + 0.5) / 10)
