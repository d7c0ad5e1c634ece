"""The stored index against the search without one, and what its plans read."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from postmill.operators import postings, search
from postmill.sources.store import shared_folder

NOW = dt.datetime(2026, 3, 1)
WORDS = "the theme license mit gpl x ab abc hello world 12 1234 0912345678 reserved rights all".split()
QUERIES = ["the license", "hel", "lowor", '"all rights" -mit', "12", "1234", "123", "0912345678", "x ab", "-the", "", "zzz", "abc theme", '"hello world" the', "2345678901", "ense"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng, rows = random.Random(4), []
    for i in range(700):
        text = rng.choice([" ", "-", ", "]).join(rng.choices(WORDS, k=rng.randrange(0, 12))) if i % 50 else None
        rows.append((i, text, NOW - dt.timedelta(hours=rng.randrange(3000))))
    return spark.createDataFrame(rows, "id bigint, text string, effective_at timestamp_ntz").cache()


@pytest.fixture(scope="module")
def index(spark, corpus):
    return postings.build(corpus, shared_folder(spark, "search"), block=40)


@pytest.mark.parametrize("q", QUERIES)
def test_hits_equal_scan(corpus, index, q):
    got = sorted(r["id"] for r in postings.hits(index, search.parse(q)).select("id").collect())
    assert got == sorted(r["id"] for r in corpus.where(search.predicate(search.parse(q))).select("id").collect())


@pytest.mark.parametrize("q", ["the license", "hel", '"all rights" reserved', "mit", "-the"])
@pytest.mark.parametrize("newest", [20_000, 60])
def test_page_equals_full_ranking(corpus, index, q, newest):
    now = F.lit(NOW)
    page = postings.top(index, q, now, size=7, newest=newest)
    assert [tuple(r) for r in page.rows.collect()] == [tuple(r) for r in search.search(corpus, q, now, 7, newest).collect()]


def test_blocks_below_the_page_are_not_ranked(spark):
    """The newest texts hold the terms as often as the old ones, so the old blocks' bounds are too low."""
    rows = [(i, "the license text", NOW - dt.timedelta(hours=i)) for i in range(2000)]
    corpus = spark.createDataFrame(rows, "id bigint, text string, effective_at timestamp_ntz")
    index = postings.build(corpus, shared_folder(spark, "search"), block=50)
    page = postings.top(index, "the license", F.lit(NOW), size=5)
    assert page.ranked_blocks < page.hit_blocks / 4
    assert [r["id"] for r in page.rows.collect()] == [0, 1, 2, 3, 4]


def test_only_the_terms_buckets_are_read(index):
    """The scan of a term's list names its bucket as a partition filter, and few files lie there."""
    word = index.table("words").where(postings._in_buckets(["mit"])).where("word = 'mit'")
    plan = index.spark._jvm.PythonSQLUtils.explainString(word._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    for q in ("the license", '"all rights"', "1234"):
        plan = index.spark._jvm.PythonSQLUtils.explainString(postings.candidates(index, search.parse(q))._jdf.queryExecution(), "formatted")
        assert plan.count("Location:") == plan.count("PartitionFilters: [")


def test_empty_corpus(spark):
    index = postings.build(spark.createDataFrame([], "id bigint, text string, effective_at timestamp_ntz"), shared_folder(spark, "search"))
    assert postings.hits(index, search.parse("the")).count() == 0
    assert postings.top(index, "the", F.lit(NOW)).rows.count() == 0


def test_lists_of_blocks_equal_rows_of_words(corpus, index):
    """Ids and most times of every word and run, made block by block, against one row for each word and run of a text."""
    lines = index.table("lines")
    words = lines.select("block", "id", F.explode(F.split(F.trim("line"), " ")).alias("word")).where("word <> ''").groupBy("block", "id", "word").agg(F.count("*").alias("times"))
    packed = F.replace("line", F.lit(" "), F.lit(""))
    runs = lines.select("block", "id", F.explode(F.array_distinct(F.regexp_extract_all(packed, F.lit("(?=(...))"), F.lit(1)))).alias("word")).withColumn("times", F.lit(1).cast("bigint"))
    for kind, each in (("words", words), ("grams", runs)):
        want = each.groupBy("block", "word").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.max("times").alias("most"))
        got = index.table(kind).select("block", "word", F.array_sort("ids").alias("ids"), "most")
        assert got.count() == want.count() > 50
        assert not got.exceptAll(want).count()


def test_the_best_hit_is_found_behind_many_newer_ones(spark):
    """More hits than a fixed number of the newest: the oldest of them is the densest."""
    n = 20_050
    text = F.when(F.col("id") == n - 1, "the license " * 20).otherwise("the other license")
    corpus = spark.range(n).select("id", text.alias("text"), (F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(secs=F.col("id") % n)).alias("effective_at"))
    want = [n - 1, 0, 1, 2]
    page = postings.top(postings.build(corpus, shared_folder(spark, "search")), "the license", F.lit(NOW), size=4)
    assert [r["id"] for r in page.rows.collect()] == want
    assert [r["id"] for r in search.search(corpus, "the license", F.lit(NOW), 4).collect()] == want


def test_many_blocks_that_may_reach_the_page_are_joined(corpus, index, monkeypatch):
    monkeypatch.setattr(postings, "LISTED", 1)
    q = '"all rights" reserved'
    page = postings.top(index, q, F.lit(NOW), size=7)
    assert page.ranked_blocks > 1
    assert [tuple(r) for r in page.rows.collect()] == [tuple(r) for r in search.search(corpus, q, F.lit(NOW), 7).collect()]
