"""Poisson counts against the plain sum, at means far above one part, and columns with clashing names."""

import hashlib
import math
import statistics

from postmill.llm import mixing


def unit(s):
    return (int(hashlib.md5(s.encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def poisson_count(rate, key):
    """The count of one document by the definition."""
    parts, n = max(math.ceil(rate / 32), 1), 0
    for j in range(1, parts + 1):
        u, k, term = unit(f"mix:{j}:{key}"), 0, math.exp(-rate / parts)
        upto = term
        while upto <= u:
            k += 1
            term *= rate / parts / k
            upto += term
        n += k
    return n


def counts(spark, rate, rows=1500):
    docs = spark.createDataFrame([(i, "x", "a") for i in range(rows)], "doc_id int, text string, source string")
    return dict(mixing.mix_sources(docs, weights={"a": 1.0}, budget=float(rows * rate)).groupBy("doc_id").count().collect())


def test_counts_are_poisson_at_every_mean(spark):
    for rate in (0.5, 20, 33, 200):
        got = counts(spark, rate)
        assert {i: got.get(i, 0) for i in range(1500)} == {i: poisson_count(rate, i) for i in range(1500)}
        values = [got.get(i, 0) for i in range(1500)]
        assert abs(statistics.mean(values) / rate - 1) < 0.1 and abs(statistics.variance(values) / rate - 1) < 0.15


def test_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "x y", "a" if i % 3 else None) for i in range(50)], "doc_id int, text string, source string")
    names = ["row", "name", "ident", "rate", "parts", "sums", "n", "replica", "order", "salt", "size", "target", "_u", "_whole", "_sums", "_source", "_rate"]
    clash = docs.selectExpr("*", *[f"doc_id * 10 + {k} as {n}" for k, n in enumerate(names)])
    for bound in (10_000, 0):
        got = mixing.mix_sources(clash, max_broadcast=bound).collect()
        assert len(got) == mixing.mix_sources(docs).count() > 0
        assert all(r[n] == r["doc_id"] * 10 + k for r in got for k, n in enumerate(names) if n != "_rate")
        assert mixing.mix_sources(clash.where("false"), max_broadcast=bound).count() == 0
