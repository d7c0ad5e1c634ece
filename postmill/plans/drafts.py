"""Watches under validation, and export lines, on examples with known answers and over whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from postmill.operators import drafts as D
from postmill.operators.matching import FILTER
from postmill.plans.catalog import query
from postmill.plans.enrich import _dims
from postmill.plans.texts import golden
from postmill.sources import bridge as B


def _lists(df, *names):
    return df.withColumns({n: F.filter(F.split(n, ","), lambda x: x != "") for n in names})


@golden("watch_validation", "name string, include string, include_all string, exclude string, regex string, category_ids string, price_min double, price_max double, muted_until timestamp_ntz", "terms string, problems string", [
    (("a", "Đẹp,dep", "DEP,pro", "", None, "", 1.0, 2.0, None), ("Đẹp|pro", "")), (("a", "x", "", "X", None, "", 5.0, 2.0, None), ("x|", "priceMax must be >= priceMin;in both include and exclude: x")), (("", "", "", "", None, "", None, None, None), ("|", "name;nothing to match by")),
    (("a", "", "", "", "ab+", "", None, None, dt.datetime(2020, 1, 1)), ("|", "mutedUntil must be a future date")), (("a", "", "", "", None, "c", None, None, None), ("|", "")),
])
def _validation(df):
    rows = _lists(df, "include", "include_all", "exclude", "category_ids").withColumns({"item_ids": F.array().cast("array<string>"), "intents": F.array().cast("array<string>"), "attribute_filters": F.lit(None).cast(f"array<{FILTER}>")})
    out = D.problems(rows, F.lit("2026-01-01").cast("timestamp_ntz"))
    return out.select("id", F.concat_ws("|", F.array_join("include", ","), F.array_join("include_all", ",")).alias("terms"), F.array_join("problems", ";").alias("problems"))


@golden("watch_references", "category string, item string, key string, op string, value string, vals string", "told string", [
    (("c", "i15", "year", "gte", "2016", None), ("",)), (("zz", "i99", "year", "eq", "2016", None), ("unknown attribute: year;unknown category: zz;unknown item: i99",)), (("c", "i15", "make", "gte", "kia", None), ("gte is not for text",)), (("c", "i15", "year", "in", None, "2016,2017"), ("in is not for number",)),
    (("p", "i15", "market", "in", None, "vn,xx"), ("invalid value for market",)), (("p", "i15", "market", "in", None, "vn,za"), ("",)), (("c", "i15", "year", "eq", None, None), ("eq needs a value",)),
])
def _references(df):
    categories, items, schemas, *_ = _dims(df.sparkSession)
    f = F.struct("key", "op", "value", F.split("vals", ",").alias("values"))
    watches = df.select(F.col("id").alias("watch_id"), F.array("category").alias("category_ids"), F.array("item").alias("item_ids"), F.array(f).alias("attribute_filters"))
    told = D.reference_problems(watches, categories, items, schemas, 2026).groupBy("watch_id").agg(F.array_join(F.array_sort(F.collect_list("problem")), ";").alias("told"))
    return df.join(told.withColumnRenamed("watch_id", "id"), "id", "left").withColumn("told", F.coalesce("told", F.lit("")))


CELL = "case when regexp_matches(s, '[\",\\r\\n]') then '\"' || replace(s, '\"', '\"\"') || '\"' else s end"


@query(f"""select doc_id as id, doc_id || ',,' || source || ',Member #' || substr(sha256('pepper' || chr(31) || 'id:' || source), 1, 8) || ',,,,,' || n_chars || ',,,,0,,' || {CELL} || ',' as line
from (select *, case when regexp_matches(t, '^[=+\\-@\\t\\r]') then '''' || t else t end as s from (select *, lang || ', ' || doc_id as t from documents where lang is not null))""")
def csv_export(spark, d):
    rows = B.table(spark, d, "documents").where("lang is not null").select(F.col("doc_id").alias("id"), "source", F.col("source").alias("author_id"), F.lit("x").alias("author_name"), F.col("n_chars").alias("priceVnd"), F.lit(0).alias("editCount"), F.concat("lang", F.lit(", "), F.col("doc_id").cast("string")).alias("title"), F.lit(None).cast("string").alias("text"))
    return D.csv_lines(rows, "pepper")
