"""Rules: what is read within a row equals what joins find, and no text is read twice."""

from pyspark.sql import functions as F

from postmill.functions import price as P
from postmill.functions import terms as K
from postmill.operators import enrich as E
from postmill.operators import matching as M
from postmill.plans.enrich import _dims

TEXTS = ["bán iPhone 15 Pro Max 256gb giá 20tr like new", "ip15 đẹp ip15", "phones and laptops", "MACBOOK-PRO macbook pro, 5-10 tr", "cần mua laptops 5x.000.000", "lh 0912 345 678 giá 1.500.000đ", "", None, "c++ và c++ iphone-15"]


def _posts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string")


def test_rules_within_the_row_equal_joins(spark, monkeypatch):
    categories, items, *_ = _dims(spark)
    aliases = E.alias_table(categories, items)
    near = E.run_rules(_posts(spark), aliases)
    plan = spark._jvm.PythonSQLUtils.explainString(near._jdf.queryExecution(), "formatted")
    assert "Join" not in plan and "Exchange" not in plan
    found = sorted(map(str, near.collect()))
    monkeypatch.setattr(M, "MAX_BROADCAST_WATCHES", 1)
    far = E.run_rules(_posts(spark), aliases)
    assert "Join" in spark._jvm.PythonSQLUtils.explainString(far._jdf.queryExecution(), "formatted")
    assert sorted(map(str, far.collect())) == found


def test_held_terms_within_the_row_equal_joins(spark, monkeypatch):
    terms = spark.createDataFrame([(t,) for t in ("iphone 15", "iphone", "iphone 15 pro max", "c++", "macbook pro", "ip15", "va c")], "term string")
    for positions in (False, True):
        monkeypatch.setattr(M, "MAX_BROADCAST_WATCHES", 10_000)
        near = sorted(map(tuple, M.held_terms(_posts(spark), terms, positions).collect()))
        monkeypatch.setattr(M, "MAX_BROADCAST_WATCHES", 1)
        assert near == sorted(map(tuple, M.held_terms(_posts(spark), terms, positions).collect())) and len(near) == 8


def test_marks_in_a_text_are_no_hits(spark):
    rows = P.with_prices(spark.createDataFrame([(0, "a\u0001b giá 5tr \u0001 bán 7tr"), (1, "a b giá 5tr   bán 7tr")], "id bigint, text string"))
    found = [r["c"] for r in rows.select("id", F.transform("candidates", lambda c: F.struct(c["raw"], c["index"], c["role"])).alias("c")).orderBy("id").collect()]
    assert found[0] == found[1] and len(found[0]) == 2


def test_attribute_terms_are_made_once(spark):
    rows = spark.createDataFrame([("kia_x", "morning", "2016")], "make string, model string, year string")
    made = rows.select(K.attribute_terms(F.col("make"), F.col("model"), F.col("year"), F.lit(None).cast("string")).alias("t"))
    assert made.first()["t"] == ["Kia X Morning 2016", "Kia X Morning", "Kia X"]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("[\\s_]+") == 2
