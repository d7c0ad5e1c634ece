"""Tables that are kept by buckets: partial, late and replayed batches, and a rewrite of what has changed."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType, TimestampNTZType

from postmill.plans import catalog as C
from postmill.plans.catalog import query
from postmill.sources import bridge as B
from postmill.sources.bridge import POSTS, views
from postmill.sources.store import BucketTable, shared_folder

VOLUME = StructType().add("ts", TimestampNTZType()).add("kind", StringType()).add("posts", LongType()).add("sell", LongType())
HIST = StructType().add("ts", TimestampNTZType()).add("term", StringType()).add("category_id", LongType()).add("n", LongType())


@query(views(POSTS) + " select date_trunc('day', first_seen_at) as ts, kind, count(*) as posts, count(*) filter (intent = 'sell') as sell from posts group by all")
def bucket_sink_replayed(spark, d):
    """Volume by day and kind from three batches in update mode: each holds only the kinds that it changed, with their totals so far; the second is applied twice, the third brings late posts."""
    posts = B.posts(spark, d).withColumn("ts", F.date_trunc("day", "first_seen_at").cast("timestamp_ntz"))
    table = BucketTable(spark, shared_folder(spark, "volume"), VOLUME, "ts", ["kind"])
    batch = F.when(F.col("kind").isin("view", "error"), 0).when(F.col("id") % 3 != 0, 1).otherwise(2)
    rows = posts.withColumn("batch", batch)
    for n in (0, 1, 1, 2):
        seen = rows.where(F.col("batch") <= n).groupBy("ts", "kind").agg(F.count("*").alias("posts"), F.count_if(F.col("intent") == "sell").alias("sell"), F.max("batch").alias("last"))
        table.apply(seen.where(F.col("last") == n).drop("last"), f"volume-{n}")
    return table.read()


WINDOW = f"ts > timestamp '{C.HOUR}' - interval 23 hours and ts <= timestamp '{C.HOUR}'"


@query(views(POSTS, C.TERMS.removeprefix(", ")) + f""", early as (select ts, term, cast(null as bigint) as category_id, count(*) as n from once where id % 10 <> 0 or ts < timestamp '{C.HOUR}' - interval 5 hours group by 1, 2
    union all select ts, term, category_id, count(*) from once where category_id is not null and (id % 10 <> 0 or ts < timestamp '{C.HOUR}' - interval 5 hours) group by 1, 2, 3),
differ as ((select * from early except select * from hist) union all (select * from hist except select * from early)),
hours as (select distinct ts from differ where {WINDOW}),
kept as (select * from hist where {WINDOW} union all select * from early where not ({WINDOW}))
select kept.*, kept.ts in (select ts from hours) as rewritten from kept""")
def hist_trailing_rewrite(spark, d):
    """Term counts stored before every tenth post of the last hours had come, then the 23 trailing hours made right: only hours that differ are written."""
    hist, late = C._hist(spark, d), (F.col("id") % 10 != 0) | (F.col("first_seen_at") < F.lit(C.HOUR).cast("timestamp_ntz") - F.expr("interval 5 hours"))
    table = BucketTable(spark, shared_folder(spark, "hist"), HIST, "ts", ["term", "category_id"])
    hour = F.lit(C.HOUR).cast("timestamp_ntz")
    table.apply(C._hist(spark, d, late), "first")
    trailing = (F.col("ts") > hour - F.expr("interval 23 hours")) & (F.col("ts") <= hour)
    changed = table.replace(hist, trailing, "trailing").withColumn("rewritten", F.lit(True))
    return table.read(slot=True).join(changed, "slot", "left").withColumn("rewritten", F.coalesce("rewritten", F.lit(False))).drop("slot")
