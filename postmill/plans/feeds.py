"""Feed and push sources over bodies made from the documents, so that SQL can say what must come out again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.operators import state
from postmill.plans.catalog import query
from postmill.sources import bridge as B
from postmill.sources import feeds
from postmill.sources.bridge import SOURCES, views


def _at() -> Column:
    return F.expr("timestamp'2026-01-01 00:00:00' + make_dt_interval(0, 0, doc_id)")


def _escaped(c: Column) -> Column:
    return T.escape_html(c)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "documents").where("text is not null").withColumn("html", F.concat(F.lit("<p>"), F.replace(_escaped(F.col("text")), F.lit("\n"), F.lit("<br/>")), F.lit("</p>")))


def _flat(posts: DataFrame) -> DataFrame:
    return posts.select("platform_post_id", "url", "text", F.array_join(F.transform("media", lambda m: F.concat_ws(" ", m["type"], m["url"])), ",").alias("media"), "posted_at", "author_name")


#: What the posts of the bodies below must be.
BODY = """with lines as (select doc_id, source, list_aggregate(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t' || chr(160) || ']+', ' ', 'g'))), 'string_agg', chr(10)) as raw from documents where text is not null),
body as (select doc_id, source, trim(regexp_replace(raw, chr(10) || '{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) as body from lines),
made as (select doc_id, source, substr('News & more ' || doc_id || case when body <> '' then chr(10) || body else '' end, 1, 20000) as text, timestamp '2026-01-01' + to_minutes(doc_id) as posted_at from body)
"""


@query(BODY + "select 'post-' || doc_id as platform_post_id, 'https://x.example.com/d/' || doc_id as url, text, 'image https://x.example.com/i/' || doc_id || '.jpg' as media, posted_at, case when doc_id % 2 = 0 then 'Ann Lee' end as author_name from made")
def feed_rss(spark, d):
    i = F.col("doc_id").cast("string")
    item = F.concat(
        F.lit("<item><title>News &amp;amp; more "), i, F.lit("</title><link>/d/"), i, F.lit('</link><guid isPermaLink="false">post-'), i, F.lit("</guid><pubDate>"), F.date_format(_at() + F.expr("interval 7 hours"), "d MMM yyyy HH:mm:ss"), F.lit(" +0700</pubDate><author>"),
        F.when(F.col("doc_id") % 2 == 0, "a@example.com (Ann Lee)").otherwise("a@example.com"), F.lit('</author><enclosure url="/i/'), i, F.lit('.jpg" type="image/jpeg"/><description>'), _escaped(F.col("html")), F.lit("</description></item><item></item>"),
    )
    body = F.concat(F.lit("﻿<?xml version=\"1.0\"?><rss version=\"2.0\"><channel><title>x</title>"), item, F.lit("</channel></rss>"))
    return _flat(feeds.feed_connector(_docs(spark, d).select(F.lit("https://X.example.com:443/feed.xml#top").alias("feed_url"), body.alias("body"))))


@query(BODY + "select 'tag:' || doc_id as platform_post_id, 'https://x.example.com/a/d/' || doc_id as url, text, '' as media, posted_at, source as author_name from made")
def feed_atom(spark, d):
    i = F.col("doc_id").cast("string")
    entry = F.concat(
        F.lit('<entry><title type="html">News &amp;amp; more '), i, F.lit('</title><link rel="self" href="/no"/><link href="d/'), i, F.lit('"/><id>tag:'), i, F.lit("</id><updated>"), F.date_format(_at(), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("</updated><author><name>"), F.col("source"), F.lit('</name></author><content type="html"><![CDATA['), F.col("html"), F.lit("]]></content></entry>"),
    )
    body = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>x</title>'), entry, F.lit("</feed>"))
    return _flat(feeds.feed_connector(_docs(spark, d).select(F.lit("https://x.example.com/a/atom.xml").alias("feed_url"), body.alias("body"))))


@query(BODY + "select cast(doc_id as varchar) as platform_post_id, 'https://y.example.com/' || doc_id as url, text, 'image https://x.example.com/b/p.png,audio https://x.example.com/s.mp3' as media, posted_at, cast(null as varchar) as author_name from made")
def feed_json(spark, d):
    item = F.struct(
        F.col("doc_id").alias("id"), F.concat(F.lit("https://y.example.com/"), F.col("doc_id").cast("string")).alias("url"), F.concat(F.lit("News &amp; more "), F.col("doc_id").cast("string")).alias("title"), F.col("html").alias("content_html"), F.lit("p.png").alias("image"),
        F.date_format(_at(), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("date_published"), F.array(F.struct(F.lit("/s.mp3").alias("url"), F.lit("audio/mpeg").alias("mime_type"))).alias("attachments"),
    )
    body = F.concat(F.lit('{"title": "x", "items": [7, '), F.to_json(item), F.lit("]}"))
    return _flat(feeds.feed_connector(_docs(spark, d).select(F.lit("https://x.example.com/b/feed.json").alias("feed_url"), body.alias("body"))))


@query("select format, title, count(*) as feeds, cast(sum(items) as bigint) as items, cast(sum(malformed) as bigint) as malformed from (select case doc_id % 5 when 0 then 'rss' when 1 then 'json' when 2 then 'html' when 3 then 'unknown' else 'empty' end as format, case when doc_id % 5 < 2 then 'x' else '' end as title, case when doc_id % 5 < 2 then 1 else 0 end as items, case when doc_id % 5 < 2 then 1 else 0 end as malformed from documents) group by 1, 2")
def feed_formats(spark, d):
    body = F.element_at(F.array(F.lit("<rss><channel><title>x</title><item><title>a</title></item><item/></channel></rss>"), F.lit('{"title": "x", "items": ["b", {"id": 3}]}'), F.lit("<!DOCTYPE html><html><title>no feed</title></html>"), F.lit("plain"), F.lit("  ")), (F.col("doc_id") % 5 + 1).cast("int"))
    parsed = feeds.parse_feeds(B.table(spark, d, "documents").select(F.lit("https://x.example.com/").alias("feed_url"), body.alias("body")))
    return parsed.groupBy("format", "title").agg(F.count("*").alias("feeds"), F.sum(F.size("items")).cast("bigint").alias("items"), F.sum("malformed").cast("bigint").alias("malformed"))


@query("""select doc_id, case doc_id % 6 when 0 then 'https://example.com/d' || doc_id when 1 then 'http://example.com/?q=' || doc_id when 5 then 'https://example.com/' end as url from documents""")
def feed_urls(spark, d):
    i = F.col("doc_id").cast("string")
    raw = F.element_at(F.array(F.concat(F.lit(" HTTPS://Example.com:443/d"), i, F.lit("#x")), F.concat(F.lit("http://example.com:80?q="), i), F.lit("ftp://example.com/"), F.lit("https://me:pw@example.com/"), F.concat(F.lit("https://example.com/"), F.repeat(F.lit("a"), F.lit(2048))), F.lit("https://example.com")), (F.col("doc_id") % 6 + 1).cast("int"))
    return B.table(spark, d, "documents").select("doc_id", feeds.canonical_url(raw).alias("url"))


@query("""select doc_id, case when doc_id % 7 = 0 then 'no id' when doc_id % 7 = 1 then 'no url' when length(text) > 20000 then 'too long' when doc_id % 7 = 2 then 'capture not allowed' end as refused, length(text) as n from documents where text is not null""")
def push_ingest(spark, d):
    i = F.col("doc_id")
    post = F.struct(F.when(i % 7 != 0, i.cast("string")).alias("platformPostId"), F.when(i % 7 != 1, "https://x.example.com/").alias("url"), F.col("text").alias("text"), F.lit("2026-01-01T00:00:00Z").alias("capturedAt"), F.when(i % 7 == 2, "api").otherwise("push").alias("capture"))
    batches = B.table(spark, d, "documents").where("text is not null").select(i.alias("batch_id"), F.to_json(F.struct(F.lit("s").alias("sourceId"), F.array(post).alias("posts"))).alias("body"))
    return feeds.checked_batches(batches).select(F.col("batch_id").alias("doc_id"), "refused", F.length("text").alias("n"))


@query(views(SOURCES) + """, s as (select *, case when source_id % 6 <> 0 then timestamp '2024-01-25' - to_seconds(age_s) end as last_ok, case when source_id % 5 = 0 then timestamp '2024-01-25' + interval 1 hour end as backoff_until from sources)
select source_id, last_ok from s where status = 'active' and backoff_until is null and (last_ok is null or age_s >= coalesce(interval_s, 900)) order by last_ok nulls first, source_id limit 20""")
def due_sources(spark, d):
    s = B.sources(spark, d)
    at = F.lit("2024-01-25").cast("timestamp_ntz")
    rows = s.withColumn("last_ok", F.when(F.col("source_id") % 6 != 0, F.expr("timestamp_ntz'2024-01-25' - make_dt_interval(0, 0, 0, age_s)"))).withColumn("backoff_until", F.when(F.col("source_id") % 5 == 0, F.expr("timestamp_ntz'2024-01-25 01:00:00'")))
    return feeds.due_sources(rows, at, 900, 20).select("source_id", "last_ok")


@query(views(SOURCES) + "select source_id, cast(least(greatest(60 * pow(2, least(source_id % 40 - 1, 30)), case when source_id % 3 = 0 then 500 else 0 end), 21600) as bigint) as wait_s from sources where source_id % 40 > 0")
def source_backoff(spark, d):
    s = B.sources(spark, d).where("source_id % 40 > 0")
    return s.select("source_id", state.backoff(F.col("source_id") % 40, 60, 21_600, F.when(F.col("source_id") % 3 == 0, 500)).alias("wait_s"))


@query("select 'i' || doc_id as platform_post_id, 'https://l.example.com/item/i' || doc_id as url, substr('T ' || doc_id || chr(10) || trim(text), 1, 20000) as text, 'image https://l.example.com/1.jpg' as media, timestamp '2026-01-01' + to_seconds(doc_id) as posted_at, source as author_name from documents where trim(text) <> ''")
def feed_list_connector(spark, d):
    item = F.struct(F.concat(F.lit("i"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("T "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("body"), F.col("source").alias("author_name"), (F.lit(1767225600000) + 1000 * F.col("doc_id")).alias("posted_at"), F.array(F.lit("https://l.example.com/1.jpg")).alias("images"))
    bodies = B.table(spark, d, "documents").where("trim(text) <> ''").select(F.lit("https://l.example.com/list").alias("feed_url"), F.to_json(F.struct(F.lit(1).alias("total"), F.array(item).alias("items"))).alias("body"))
    return _flat(feeds.CONNECTORS["list"](bodies))
