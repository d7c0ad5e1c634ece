"""Trend terms of whole texts."""

from pyspark.sql import functions as F

from postmill.functions import terms as K


def test_terms_of_the_end_of_a_long_text(spark):
    """The words behind the first 300 make terms as well."""
    text = " ".join(f"w{i}" for i in range(1000)) + " last"
    got = K.with_terms(spark.createDataFrame([(1, text)], "id int, text string")).select(F.size("terms").alias("n"), F.array_contains("terms", "w998 w999 last").alias("found")).first()
    assert (got["n"], got["found"]) == (1001 + 1000 + 999, True)


ALIASES = [("mit license", "mit"), ("license", None), ("red", "big red car of all"), ("b c d", "license x"), ("d d d d", None)]


def test_frequent_counts_equal_plain_counts(spark):
    """Counts by packed hashes and strings against one row for each post and term, with repeated ids, nulls, line breaks and aliases."""
    import datetime as dt
    import random

    from postmill.operators import text_terms, trends

    rng, rows = random.Random(7), []
    pool = ["a", "b1", "mit", "license", "red", "c", "b", "d", "xe", "the", "7", "Ⅷ", "12345678", "http://x.y/z", "www.a.b", "đẹp", "été", "x" * 40, "\n", "\r\n", " ", "ip15", "bc", "cd", "de"]
    for i in range(600):
        text = rng.choice([" ", " ", ", "]).join(rng.choices(pool, k=rng.randrange(0, 400 if i % 50 == 0 else 15)))
        rows.append((i if i % 40 else i - 1, None if i % 60 == 7 else text, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=35 * (i % 3 if i % 40 else (i - 1) % 3)), None if (i - (i % 40 == 0)) % 4 == 3 else (i - (i % 40 == 0)) % 4))
    posts = spark.createDataFrame(rows, "id bigint, text string, first_seen_at timestamp_ntz, category_id bigint").repartition(5)
    aliases = spark.createDataFrame(ALIASES, "term string, into string")
    terms = K.with_terms(posts).select("id", "first_seen_at", "category_id", F.explode_outer("terms").alias("term")).where("term is not null")
    want = trends.term_counts(terms, aliases)
    for least in (1, 4):
        got = text_terms.frequent_counts(posts, aliases, least)
        expected = want.where(F.col("n") >= least).select(got.columns)
        assert expected.count() > 100
        assert not got.exceptAll(expected).count() and not expected.exceptAll(got).count()
    assert text_terms.frequent_counts(posts.limit(0), aliases, 4).count() == 0


def test_terms_of_documents_travel_packed(spark):
    """Rare terms never go through a shuffle as strings: the rows that are summed are few more than the frequent ones."""
    from postmill.plans import registry

    plan = registry.QUERIES["trend_hist_documents"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(" not in plan.split("MapInArrow")[1] and plan.count("MapInArrow") == 1
