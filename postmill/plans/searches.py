"""Searches narrowed by everything that they can be, and what lists show of them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.operators import search as S
from postmill.plans import catalog as C
from postmill.plans.catalog import query
from postmill.plans.texts import golden
from postmill.sources import bridge as B
from postmill.sources.bridge import CORPUS, MATCHES, SOURCES, views

POSTS = """p as (select id, text, effective_at, id % 100 as source_id, id % 7 as category_no, case when id % 10 <> 0 then case id % 3 when 0 then 'sell' when 1 then 'buy' else 'other' end end as intent,
  case when id % 10 <> 0 then cast(id % 50 as double) end as price, id % 20 as author_id, 'y' || 2000 + id % 30 as odd from corpus)"""
PATHS = "c as (select * from (values (0, 'a'), (1, 'a.b'), (2, 'a.b.c'), (3, 'ab'), (4, 'd'), (5, 'a.e'), (6, 'd.a')) t(category_no, path))"


def _posts(spark, d):
    i = F.col("id")
    some = i % 10 != 0
    return B.corpus(spark, d).select(
        "id", "text", "effective_at", (i % 100).alias("source_id"), (i % 7).alias("category_id"), F.when(some, F.when(i % 3 == 0, "sell").when(i % 3 == 1, "buy").otherwise("other")).alias("intent"), F.when(some, (i % 50).cast("double")).alias("price"),
        (i % 20).alias("author_id"), F.lit("x").alias("author_name"), (i % 5).alias("item_id"),
        F.map_from_arrays(F.array(F.lit("year"), F.lit("odo_km"), F.lit("region"), F.lit("make")), F.array((2000 + i % 30).cast("string"), F.when(i % 4 == 0, "many").otherwise((i * 10).cast("string")), F.when(i % 2 == 0, "Hanoi").otherwise("Hue"), F.when(i % 3 == 0, "Kia").otherwise("Ford"))).alias("attributes"), (i % 6 == 0).alias("saved"),
    )


def _categories(spark):
    return spark.createDataFrame([(0, "a"), (1, "a.b"), (2, "a.b.c"), (3, "ab"), (4, "d"), (5, "a.e"), (6, "d.a")], "category_id bigint, path string")


@query(views(CORPUS, SOURCES, POSTS, PATHS) + C.LINES + """ select p.id, price from p join lines using (id) join c using (category_no) where source_id in (select source_id from sources where team = 1) and contains(line, ' the ') and (path = 'a' or starts_with(path, 'a.'))
  and intent in ('sell', 'buy') and price between 5 and 40 and p.effective_at >= timestamp '2024-01-03' and p.effective_at < timestamp '2024-02-20'""")
def search_narrowed(spark, d):
    params = S.Params(q='"the"', category_paths=["a"], intents=["sell", "buy"], price_min=5, price_max=40, from_at=dt.datetime(2024, 1, 3), to_at=dt.datetime(2024, 2, 20))
    return S.narrow(_posts(spark, d), B.sources(spark, d), 1, params, _categories(spark)).select("id", "price")


@query(views(CORPUS, SOURCES, POSTS) + " select id from p where source_id in (select source_id from sources where team = 0) and substr(sha256('salt' || chr(31) || 'id:' || author_id), 1, 8) = substr(sha256('salt' || chr(31) || 'id:8'), 1, 8) and price is not null")
def search_by_author(spark, d):
    import hashlib

    ref = hashlib.sha256("salt\u001fid:8".encode()).hexdigest()[:8]
    return S.narrow(_posts(spark, d), B.sources(spark, d), 0, S.Params(author=ref, sort="price_asc"), salt="salt").select("id")


@query(views(CORPUS) + " select id from corpus where id % 4 <> 0 and id * 10 <= 6000 and 2000 + id % 30 between 2005 and 2020 and id % 2 = 0 and id % 10 <> 0 and id % 50 >= 3 and id % 6 = 0")
def dashboard_filters(spark, d):
    return S.dashboard(_posts(spark, d), year=(2005, 2020), odo=(None, 6000), region="HANOI", price=(3, None), saved=True).select("id")


@query(views(CORPUS, MATCHES) + " select id from corpus where id % 3 = 0 and (id % 10 = 0 or id % 3 <> 2) and id in (select post_id from matches) and id in (select l_orderkey from lineitem)")
def feed_filters(spark, d):
    flags = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("post_id"))
    return S.feed(_posts(spark, d), B.matches(spark, d), flags, make="kia", hide_other=True, matched=True, saved=True).select("id")


@golden("headlines", "text string", "shown string", [
    (("Bán <b>iPhone</b> 15 đẹp",), ("Bán &lt;b&gt;iPhone&lt;/b&gt; 15 đẹp",)), (("x " * 40 + "ĐẸP iphone cũ",), ("<mark>ĐẸP</mark> iphone cũ",)), (("dep 1 2 3 4 dep dep",), ("<mark>dep</mark> 1 2 3 4 <mark>dep</mark> <mark>dep</mark>",)), (("",), ("",)),
])
def _headlines(df):
    return df.withColumn("shown", F.when(F.col("id") == 0, S.headline(F.col("text"), [])).otherwise(S.headline(F.col("text"), ["dep"])))


@golden("cover_density", "text string", "score double", [(("a b",), (0.0,)), (("aa bb",), (0.090909,)), (("aa x bb",), (0.047619,)), (("aa bb aa",), (0.166667,)), (("aa aa bb",), (0.090909,)), (("bb x aab",), (0.047619,))])
def _density(df):
    return df.withColumn("score", F.round(S.cover_density(T.word_line(F.col("text")), ["aa", "bb"]), 6)).withColumn("score", F.when(F.col("id") == 5, F.round(S.cover_density(T.word_line(F.col("text")), ["aab", "bb"]), 6)).otherwise(F.col("score")))
