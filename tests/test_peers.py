"""Deal scores by scope: which posts are peers."""

import datetime as dt

from postmill.operators import peers

AT = dt.datetime(2026, 1, 1, 12)
POST = "id bigint, at timestamp_ntz, item_id bigint, category_id string, intent string, price double, comparable boolean, attributes map<string,string>"


def _scored(spark, times, most):
    """Scores of posts of one item at AT plus microseconds, the price of each a tenth of a million more than its id."""
    posts = spark.createDataFrame([(i, AT + dt.timedelta(microseconds=t), 1, "c", "sell", 1e6 + 1e5 * i, True, {"src": "a"}) for i, t in enumerate(times)], POST)
    categories = spark.createDataFrame([("c", "c")], "category_id string, path string")
    declared = spark.createDataFrame([("c", "src", True, False, None)], "category_id string, key string, key_attr boolean, optional boolean, tolerance double")
    return {r["id"]: (r["n"], r["median"]) for r in peers.scored_by_scope(posts, categories, declared, 30, 2, most).collect()}


def test_posts_of_one_second_are_in_order(spark):
    """The two posts before are the peers, though all are of one second and the oldest is not the cheapest."""
    assert _scored(spark, [300, 200, 100, 400], 2) == {0: (2, 1_150_000), 3: (2, 1_050_000)}


def test_thirty_days_to_the_microsecond(spark):
    span = 30 * 86_400_000_000
    assert _scored(spark, [0, 1, 2, span + 1], 9) == {2: (2, 1_050_000), 3: (2, 1_150_000)}
