"""Joins, latest rows, neighbours, folding and paging over posts, matches and visits."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.functions.times import seconds


def inbox(matches: DataFrame, watches: DataFrame, posts: DataFrame) -> DataFrame:
    """Matches with their watch and post; posts without enrichment stay."""
    return matches.join(watches, "watch_id").join(posts.withColumnRenamed("id", "post_id"), "post_id")


def without_hidden(posts: DataFrame, hidden: DataFrame) -> DataFrame:
    """Posts that are hidden neither by id nor by fingerprint; two anti joins, as one on either key would compare all pairs."""
    by_id = hidden.where("post_id is not null").select(F.col("post_id").alias("id"))
    by_print = hidden.where("fingerprint is not null").select("fingerprint")
    return posts.join(by_id, "id", "left_anti").join(by_print, "fingerprint", "left_anti")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key as a whole, by a map-side combined maximum instead of a window."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("r")).select(*keys, "r.*")


def newest_versions(rows: DataFrame, keys: list[str], order: str, keep: int) -> DataFrame:
    """The ``keep`` newest versions of each key."""
    return rows.withColumn("back", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("back") <= keep)


def neighbours(visits: DataFrame) -> DataFrame:
    """Each finished visit with the one before and after of its source: outcomes, and seconds between."""
    w = W.partitionBy("source_id").orderBy("started_at", "id")
    at = visits.where("outcome is not null")
    return at.select(
        "id", "source_id", "outcome",
        F.lag("outcome").over(w).alias("before"),
        F.lead("outcome").over(w).alias("after"),
        (seconds("started_at") - seconds(F.lag("started_at").over(w))).alias("gap_s"),
    )


def block_pairs(visits: DataFrame, within_s: int) -> DataFrame:
    """Visits blocked right after a blocked one, at most so many seconds apart."""
    return neighbours(visits).where((F.col("outcome") == "blocked") & (F.col("before") == "blocked") & (F.col("gap_s") <= within_s))


def fold_reposts(posts: DataFrame, keep: int = 5) -> DataFrame:
    """The newest post of each fingerprint with the number of the others and the ids of the ``keep`` next newest ones."""
    order = W.partitionBy("fingerprint").orderBy(F.desc("first_seen_at"), F.desc("id"))
    ranked = posts.select("fingerprint", "id", "first_seen_at", F.row_number().over(order).alias("place")).where(F.col("place") <= keep + 1)
    sizes = posts.groupBy("fingerprint").agg((F.count("*") - 1).alias("others"))
    folded = ranked.groupBy("fingerprint").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("r"))
    return folded.join(sizes, "fingerprint").select("fingerprint", F.col("r")[0]["id"].alias("id"), "others", F.array_join(F.transform(F.slice("r", 2, keep), lambda x: x["id"].cast("string")), ",").alias("next_ids"))


def duplicate_groups(posts: DataFrame) -> DataFrame:
    """Groups of posts with one fingerprint, or one author and price: (by, key, n, first_id), without listing pairs."""
    first = posts.groupBy(F.lit("fingerprint").alias("by"), F.col("fingerprint").alias("key"))
    second = posts.where("price is not null").groupBy(F.lit("price").alias("by"), F.concat_ws("|", F.col("author_id").cast("string"), F.round(F.col("price") * 100).cast("bigint").cast("string")).alias("key"))
    both = [g.agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1") for g in (first, second)]
    return both[0].unionByName(both[1])


def subtree(nodes: DataFrame, path: str) -> DataFrame:
    """Nodes at or below a path. A prefix counts only up to a dot."""
    return nodes.where((F.col("path") == path) | F.col("path").startswith(path + "."))


def ancestors(nodes: DataFrame) -> DataFrame:
    """(path, ancestor) for each node and each prefix of its path, itself included: the tree join as an equi join."""
    parts = F.split("path", "\\.")
    return nodes.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("ancestor"))


def best_by(rows: DataFrame, keys: list[str], order: list[Column], keep: int = 1) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= keep)


def missing(candidates: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose key is not there yet; repeated ones count once."""
    return candidates.dropDuplicates(keys).join(present.select(*keys).distinct(), keys, "left_anti")


def after(rows: DataFrame, order: list[tuple[str, bool]], last: dict | None, size: int) -> DataFrame:
    """One page. order: columns and whether each descends (nulls last); last: values of the row before the page."""
    if last is not None:
        later, equal = F.lit(False), F.lit(True)
        for name, down in order:
            c, v = F.col(name), last[name]
            past = (c.isNull() if v is not None else F.lit(False)) | ((c < F.lit(v)) if down else (c > F.lit(v)) if v is not None else F.lit(False))
            later = later | (equal & F.coalesce(past, F.lit(False)))
            equal = equal & c.eqNullSafe(F.lit(v))
        rows = rows.where(later)
    return rows.orderBy(*[F.desc_nulls_last(n) if down else F.asc_nulls_last(n) for n, down in order]).limit(size)


def params_hash(params: dict) -> str:
    return hashlib.sha256(json.dumps(params, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:16]


def encode_cursor(params: dict, last: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps({"p": params_hash(params), "k": last}, default=str).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, params: dict) -> dict:
    """The key values of a cursor; one of other parameters is an error."""
    got = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    if got["p"] != params_hash(params):
        raise ValueError("the cursor belongs to another query")
    return got["k"]


def capped_count(rows: DataFrame, cap: int) -> DataFrame:
    """The exact number of rows up to a cap, and whether there are more."""
    return rows.limit(cap + 1).agg(F.least(F.count("*"), F.lit(cap)).alias("total"), (F.count("*") > cap).alias("more"))
