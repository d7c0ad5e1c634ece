"""References in a feed's HTML."""

from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.sources import feeds

#: A text and what it is decoded to.
CASES = [
    ("&LT;b&gT; &Quot;x&quot; &nbsp;&hellip;", '<b> "x"  ...'), ("&amp;lt; &AMP;amp; &#38;gt;", "&lt; &amp; &gt;"), ("&l&#116;; &copy;&reg; &unknown; &lt", "< (c)(r) &unknown; &lt"),
    ("&laquo;a&raquo; &ndash;&mdash; &lsquo;b&rsquo; &ldquo;c&rdquo; &apos;", "<<a>> -- 'b' \"c\" '"), ("&&lt;gt; &lt;&lt;;", "&<gt; <<;"), ("", ""), (None, None),
]


def test_references_of_any_spelling(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "id int, x string").select("id", T.decode_references(F.col("x")).alias("y"))
    assert [r["y"] for r in rows.orderBy("id").collect()] == [b for _, b in CASES]


def test_names_are_looked_for_once(spark):
    """A pattern for all names, not one pass of the text for each."""
    plan = spark.createDataFrame([("x",)], "x string").select(T.decode_references(F.col("x")).alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("(?i)&") == 2


def test_a_body_is_parsed_once(spark):
    bodies = spark.createDataFrame([("https://x.example.com/", "<rss><channel><item><title>a</title></item></channel></rss>"), ("https://x.example.com/", "none")], "feed_url string, body string")
    posts = feeds.feed_connector(bodies)
    assert posts._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == 1
    assert [r["text"] for r in posts.collect()] == ["a"]


def test_terms_of_documents_are_made_once(spark):
    from postmill.plans import registry

    plan = registry.QUERIES["trend_hist_documents"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    assert "(size(" not in "".join(line for line in plan.toString().splitlines() if line.strip(" :+-").startswith("Filter"))


def test_readings_are_made_once(spark):
    from postmill.plans import registry

    plan = registry.QUERIES["extract_attributes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if line.strip(" :+-").startswith("Filter") and "size(" in line and "transform" in line]


def test_enrichment_is_told_within_the_row(spark):
    """Only dimensions are joined, and these are sent: the posts are neither shuffled nor unfolded. A text is cut at its numbers once."""
    from postmill.plans import registry

    made = registry.QUERIES["finalize_enrichment"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    wide = [line for line in made.executedPlan().toString().splitlines() if "SortMergeJoin" in line or "ShuffledHashJoin" in line]
    # those of the dimensions with themselves have no id of a post
    assert "SortMergeJoin [id#" not in "".join(wide) and "Generate posexplode" not in made.optimizedPlan().toString()
    assert made.optimizedPlan().toString().count(r"split(coalesce(translate") + made.optimizedPlan().toString().count("split(translate") <= 1
