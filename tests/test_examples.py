"""Functions on examples with known answers."""

import math

import pytest

from postmill.plans import registry  # noqa: F401  fills the examples
from postmill.plans.texts import EXAMPLES


def same(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.parametrize("name", sorted(EXAMPLES))
def test_example(spark, name):
    f, given, answer, rows = EXAMPLES[name]
    columns = [c.strip().split(" ")[0] for c in answer.split(",")]
    df = spark.createDataFrame([(i, *x) for i, (x, _) in enumerate(rows)], given)
    got = {r["id"]: r for r in f(df).select(*columns).collect()}
    assert len(got) == len(rows)
    for i, (x, want) in enumerate(rows):
        assert all(same(got[i][c], w) for c, w in zip(columns[1:], want, strict=True)), (x, got[i])
