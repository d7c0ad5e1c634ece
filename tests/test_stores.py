"""Tables of buckets: what a batch costs, and term counts that a filter by hour narrows to its posts."""

import os
import random
import re
from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from postmill.operators import trends
from postmill.sources.store import BucketTable, shared_folder


def a_table(spark):
    return BucketTable(spark, shared_folder(spark, "t"), spark.createDataFrame([], "ts int, k string, n bigint").schema, "ts", ["k"])


def test_files_do_not_grow_with_buckets(spark):
    table = a_table(spark)
    rows = spark.range(600).select(F.col("id").cast("int").alias("ts"), F.lit("a").alias("k"), "id")
    table.apply(rows.withColumnRenamed("id", "n"), "0")
    folder = f"{table.path}/data".removeprefix("file:")
    assert 0 < len([f for _, _, files in os.walk(folder) for f in files if f.endswith(".parquet")]) <= 128
    changed = table.replace(rows.select("ts", "k", (F.col("id") + (F.col("ts") == 7).cast("int")).alias("n")), F.col("ts") < 100, "1")
    assert [r["slot"] for r in changed.collect()] == ["7"]
    assert sorted(map(tuple, table.read().collect())) == [(i, "a", i + (i == 7)) for i in range(600)]


def test_a_batch_is_computed_once(spark):
    """Rows that would come out otherwise a second time: what is logged, merged and compared is what was written."""
    draw = F.udf(lambda i: random.randrange(10**9), LongType()).asNondeterministic()
    rows = spark.range(100).select(draw("id").cast("int").alias("ts"), F.lit("a").alias("k"), F.col("id").alias("n"))
    table = a_table(spark)
    table.apply(rows, "0")
    assert sorted(r["n"] for r in table.read().collect()) == list(range(100))
    table = a_table(spark)
    assert table.replace(rows, F.lit(True), "0").count() == 100
    assert sorted(r["n"] for r in table.read().collect()) == list(range(100))


def test_buckets_of_similar_names_stay_apart(spark):
    table = BucketTable(spark, shared_folder(spark, "t"), spark.createDataFrame([], "ts string, n bigint").schema, "ts", [])
    table.apply(spark.createDataFrame([("a b", 1), ("a-b", 2), ("é", 3)], "ts string, n bigint"), "0")
    changed = table.replace(spark.createDataFrame([("a b", 1), ("a-b", 5), ("é", 3)], "ts string, n bigint"), F.lit(True), "1")
    assert [r["slot"] for r in changed.collect()] == ["a-b"]
    assert sorted(map(tuple, table.read().collect())) == [("a b", 1), ("a-b", 5), ("é", 3)]


def test_term_counts(spark):
    """Against plain Python: repeated ids, null categories, terms that are merged or dropped."""
    rng = random.Random(4)
    rows = [(rng.randrange(40), rng.randrange(5), rng.choice([None, 0, 1]), rng.choice("abcde")) for _ in range(500)]
    posts = spark.createDataFrame(rows, "id bigint, h int, category_id bigint, term string")
    terms = posts.select("id", F.expr("timestamp_ntz'2024-01-01 00:20:00' + make_dt_interval(0, h)").alias("first_seen_at"), "category_id", "term")
    counts = trends.term_counts(terms, spark.createDataFrame([("a", "b"), ("c", None)], "term string, into string"))
    once = {(i, h, c, {"a": "b"}.get(t, t)) for i, h, c, t in rows if t != "c"}
    want = Counter((h, t, None) for _, h, _, t in once) + Counter((h, t, c) for _, h, c, t in once if c is not None)
    got = [((r["ts"].hour, r["term"], r["category_id"]), r["n"]) for r in counts.collect()]
    assert dict(got) == dict(want) and len(got) == len(want)
    assert counts.schema["n"].dataType == LongType() and counts.schema["category_id"].dataType == LongType()


def test_a_filter_by_hour_reaches_the_posts(spark):
    posts = spark.range(1000).select("id", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int))").alias("first_seen_at"), (F.col("id") % 3).alias("category_id"), (F.col("id") % 7).cast("string").alias("term"))
    counts = trends.term_counts(posts, spark.createDataFrame([("1", "2")], "term string, into string"))
    plan = counts.where(F.col("ts") > F.lit("2024-01-01 05:00:00").cast("timestamp_ntz"))._jdf.queryExecution().optimizedPlan().toString()
    depth = {m.start() for m in re.finditer(r"Filter .*trunc", plan)}
    assert depth and min(depth) > plan.rindex("Aggregate"), plan
