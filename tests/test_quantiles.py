"""Selection in large groups against plain percentiles; frames that slide against frames that are sorted anew."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.operators import prices
from postmill.operators.quantiles import percentiles, shares_below

SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    out = [("hot", rng.choice([rng.random() * 1e6, 500.0, 7.0])) for _ in range(5000)] + [("ties", 3.0)] * 900 + [(None, float(i)) for i in range(800)]
    out += [("few", 1.0), ("few", 2.0), ("one", 9.0), ("none", None), ("edge", -5.0), ("skew", 0.0)] + [("skew", 1e12 * rng.random() ** 9) for _ in range(1500)]
    return spark.createDataFrame(out, "k string, x double").repartition(7)


@pytest.mark.parametrize("accuracy", [20, 2000])
def test_selection_equals_percentile(rows, accuracy):
    got = {r["k"]: (r["n"], r["p"]) for r in percentiles(rows, ["k"], "x", SHARES, small=100, accuracy=accuracy).collect()}
    want = {r["k"]: (r["n"], r["p"]) for r in rows.where("x is not null").groupBy("k").agg(F.count("*").alias("n"), F.percentile("x", SHARES).alias("p")).collect()}
    assert got.keys() == want.keys()
    for k, (n, p) in want.items():
        assert got[k][0] == n and np.allclose(got[k][1], p, rtol=1e-12), k


def test_shares_below(rows):
    got = sorted(((r["k"], r["x"], r["share_below"]) for r in shares_below(rows, "k", "x", parts=16).collect()), key=str)
    held = {}
    for r in rows.where("x is not null").collect():
        held.setdefault(r["k"], []).append(r["x"])
    want = sorted(((k, x, sum(y < x for y in v) / len(v)) for k, v in held.items() for x in v), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-12


def test_trimmed_stats_of_hot_keys(rows):
    some = rows.where("x > 0").withColumnRenamed("x", "price")
    assert sorted(map(tuple, prices.trimmed_stats(some, ["k"], small=50).where("k is not null").collect())) == sorted(map(tuple, prices.trimmed_stats(some, ["k"]).where("k is not null").collect()))


def test_sliding_frame_equals_sorting(spark):
    rng = random.Random(3)
    sec = sorted(rng.randrange(0, 3000) for _ in range(600))
    price, own = [float(rng.choice([5, 5, 8, 100, rng.randrange(1, 60)])) for _ in sec], [rng.random() < 0.8 for _ in sec]
    for span, least, most in ((200, 3, 1000), (500, 5, 20), (1, 1, 5), (5000, 4, 60)):
        got = list(prices.sliding_stats(sec, price, own, span, least, most))
        for i, at in enumerate(sec):
            peers = sorted([p for s, p in zip(sec, price, strict=True) if at - span <= s < at][-most:])
            assert got[i] == (prices.trimmed_median(peers, least) if own[i] else None)
            if own[i] and len(peers) >= max(least, 4):
                q1, q3 = np.percentile(peers, [25, 75])
                kept = [p for p in peers if q3 == q1 or q1 - 1.5 * (q3 - q1) <= p <= q3 + 1.5 * (q3 - q1)]
                want = (len(kept), int(np.floor(np.median(kept) + 0.5))) if len(kept) >= least else None
                assert got[i] == want


def test_selection_reads_large_groups_once(rows):
    """One scan counts below the bounds and brings the prices between them; the bounds come with one aggregate before."""
    found = percentiles(rows, ["k"], "x", SHARES, small=100)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("percentile_approx") == 0 and plan.count("count_if") == 0
