"""Feeds as tables: RSS 2.0 and 1.0, Atom and JSON Feed bodies become posts; pushed batches are checked; connectors by name.

Bodies are columns of text, however they were fetched. XML is read by from_xml and JSON by from_json under declared schemas.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import text as T

#: Fixed limits of the original: characters of an address, an id and a text, items of a feed, media of a post, posts of a batch.
MAX_URL, MAX_ID, MAX_TEXT, MAX_ITEMS, MAX_MEDIA, MAX_BATCH = 2048, 300, 20_000, 200, 50, 200

_TEXT = "struct<_VALUE:string,_type:string,_isPermaLink:string>"
_LINK = "struct<_VALUE:string,_href:string,_rel:string,_type:string>"
_MEDIA = "array<struct<_url:string,_type:string,_medium:string>>"
_ITEM = (
    f"struct<title:{_TEXT},link:array<{_LINK}>,guid:{_TEXT},`dc:identifier`:string,description:{_TEXT},`content:encoded`:{_TEXT},pubDate:string,`dc:date`:string,published:string,"
    f"updated:string,`dc:creator`:string,author:struct<_VALUE:string,name:string>,id:string,summary:{_TEXT},content:{_TEXT},enclosure:{_MEDIA},`media:thumbnail`:{_MEDIA},`media:content`:{_MEDIA}>"
)
XML = f"struct<channel:struct<title:{_TEXT},item:array<{_ITEM}>>,item:array<{_ITEM}>,title:{_TEXT},entry:array<{_ITEM}>>"
JSON = "struct<title:string,items:array<string>>"


def some(c: Column) -> Column:
    """The trimmed text, null if blank."""
    return F.nullif(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))


def canonical_url(url: Column) -> Column:
    """An http(s) address without fragment, with scheme and host in lower case and a path; null if it is none, has credentials or is too long."""
    u = F.trim(url)
    ok = u.rlike(r"(?i)^https?://[^\s/?#@]+(?:[/?#]\S*)?$") & (F.length(u) <= MAX_URL)
    plain = F.regexp_replace(u, "#.*$", "")
    head = F.lower(F.regexp_extract(plain, "(?i)^(https?://[^/?]+)", 1))
    port = F.regexp_replace(F.regexp_replace(head, "^(http://.*):80$", "$1"), "^(https://.*):443$", "$1")
    rest = F.regexp_replace(plain, "(?i)^https?://[^/?]+", "")
    return F.when(ok, F.concat(port, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def resolve_url(link: Column, base: Column) -> Column:
    """A link against the address that it was found at; null if that gives no http(s) address."""
    at, x = canonical_url(base), F.trim(link)
    origin, folder = F.regexp_extract(at, "^(https?://[^/]+)", 1), F.regexp_extract(at, "^(https?://[^?]*/)", 1)
    made = (
        F.when(x.rlike("(?i)^https?://"), x)
        .when(x.startswith("//"), F.concat(F.regexp_extract(at, "^(https?:)", 1), x))
        .when(x.startswith("/"), F.concat(origin, x))
        .when(x.startswith("?"), F.concat(F.regexp_extract(at, "^([^?]*)", 1), x))
        .when(~x.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.concat(folder, x))
    )
    return canonical_url(made)


def parse_date(raw: Column) -> Column:
    """A timestamp from an ISO 8601 or RFC 822 date with any offset; null if it is none."""
    mail = F.regexp_replace(F.regexp_replace(F.trim(raw), "^[A-Za-z]{3},? +", ""), "(?:GMT|UTC|UT|Z)$", "+0000")
    return F.coalesce(*[F.try_to_timestamp(mail, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm xx")], F.when(raw.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), F.trim(raw).try_cast("timestamp")))


def _media_type(mime: Column, medium: Column, fallback: str) -> Column:
    m = F.lower(F.coalesce(medium, mime, F.lit("")))
    return F.when(m.startswith("image"), "image").when(m.startswith("video"), "video").when(m.startswith("audio"), "audio").otherwise(fallback)


def _media(type_: Column, url: Column) -> Column:
    return F.struct(type_.alias("type"), url.alias("url"))


def _clean_author(raw: Column) -> Column:
    """A name without an address: of "a@b (Name)" the name; an address alone is none."""
    paren = F.regexp_extract(raw, r"\(([^)]+)\)", 1)
    plain = F.trim(F.regexp_replace(raw, "<[^>]*>", ""))
    return F.when((paren != "") & raw.contains("@"), some(paren)).when(plain.contains("@") & ~plain.contains(" "), None).otherwise(some(plain))


def _xml_item(item: Column, atom: bool) -> Column:
    text = lambda name: some(item[name]["_VALUE"])
    links = F.coalesce(item["link"], F.array().cast(f"array<{_LINK}>"))
    if atom:
        link = F.coalesce(F.get(F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0)), F.get(links, F.lit(0)))
        fields = [some(item["id"]), F.coalesce(some(link["_href"]), some(link["_VALUE"])), F.coalesce(text("summary"), text("content")), F.coalesce(some(item["updated"]), some(item["published"])), F.coalesce(some(item["author"]["name"]), some(item["author"]["_VALUE"]))]
    else:
        dates = [some(item[c]) for c in ("pubDate", "dc:date", "published", "updated")]
        fields = [F.coalesce(text("guid"), some(item["dc:identifier"])), some(F.get(links, F.lit(0))["_VALUE"]), F.coalesce(text("description"), text("content:encoded")), F.coalesce(*dates), _clean_author(F.coalesce(some(item["dc:creator"]), some(item["author"]["_VALUE"])))]
    none = F.array().cast(_MEDIA)
    media = F.concat(
        F.transform(F.coalesce(item["enclosure"], none), lambda e: _media(_media_type(e["_type"], F.lit(None), "file"), e["_url"])),
        F.transform(F.coalesce(item["media:thumbnail"], none), lambda e: _media(F.lit("image"), e["_url"])),
        F.transform(F.coalesce(item["media:content"], none), lambda e: _media(_media_type(e["_type"], e["_medium"], "file"), e["_url"])),
    )
    return _item(fields[0], F.coalesce(text("title"), F.lit("")), fields[1], F.coalesce(fields[2], F.lit("")), fields[3], fields[4], media)


def _item(id_: Column, title: Column, link: Column, summary: Column, published: Column, author: Column, media: Column) -> Column:
    named = {"item_id": id_, "title": title, "link": link, "summary": summary, "published": published, "author": author, "media": F.filter(media, lambda m: m["url"].isNotNull())}
    return F.struct(*[c.cast("string").alias(n) if n != "media" else c.alias(n) for n, c in named.items()])


def _json_item(raw: Column) -> Column:
    get = lambda path: some(F.get_json_object(raw, path))
    files = F.coalesce(F.from_json(F.get_json_object(raw, "$.attachments"), "array<struct<url:string,mime_type:string>>"), F.array().cast("array<struct<url:string,mime_type:string>>"))
    media = F.concat(F.transform(F.array(get("$.image"), get("$.banner_image")), lambda u: _media(F.lit("image"), u)), F.transform(files, lambda a: _media(_media_type(a["mime_type"], F.lit(None), "file"), a["url"])))
    return _item(get("$.id"), F.coalesce(get("$.title"), F.lit("")), F.coalesce(get("$.url"), get("$.external_url")), F.coalesce(get("$.summary"), get("$.content_text"), get("$.content_html"), F.lit("")), F.coalesce(get("$.date_published"), get("$.date_modified")), F.coalesce(get("$.authors[0].name"), get("$.author.name")), media)


def sniff(body: Column) -> Column:
    """json, rss (also RSS 1.0), atom, html, or unknown, by content; empty for none."""
    b = F.regexp_replace(body, r"^﻿?\s+|^﻿", "")
    head = F.substring(b, 1, 2000)
    return (
        F.when(F.coalesce(F.trim(b), F.lit("")) == "", "empty")
        .when(b.startswith("{"), "json")
        .when(~b.startswith("<"), "unknown")
        .when(head.rlike(r"(?i)<html[\s>]|^<!doctype\s+html"), "html")
        .when(head.rlike(r"<(?:rss|rdf:RDF)[\s>]"), "rss")
        .when(head.rlike(r"<feed[\s>]"), "atom")
        .otherwise("unknown")
    )


def parse_feeds(bodies: DataFrame) -> DataFrame:
    """Feeds (feed_url, body) with format, title, items (at most MAX_ITEMS, empty ones left out) and malformed (how many were).

    A body that is no feed has no items and its format says what it is; one that can't be read has none either.
    """
    clean = bodies.withColumn("format", sniff(F.col("body"))).withColumn("b", F.regexp_replace("body", r"^﻿?\s+|^﻿", ""))
    xml, js = F.from_xml(F.when(F.col("format").isin("rss", "atom"), F.col("b")), XML), F.from_json(F.when(F.col("format") == "json", F.col("b")), JSON)
    read = clean.withColumn("x", xml).withColumn("j", js)
    rss = F.coalesce(F.col("x.channel.item"), F.col("x.item"))
    cut = lambda c: F.slice(c, 1, MAX_ITEMS)
    is_object = lambda r: F.coalesce(F.trim(r).startswith("{"), F.lit(False))
    items = (
        F.when(F.col("format") == "rss", F.transform(cut(rss), lambda i: _xml_item(i, False)))
        .when(F.col("format") == "atom", F.transform(cut(F.col("x.entry")), lambda i: _xml_item(i, True)))
        .when(F.col("format") == "json", F.transform(F.filter(cut(F.col("j.items")), is_object), _json_item))
    )
    seen = F.size(F.coalesce(cut(rss), cut(F.col("x.entry")), F.array().cast(f"array<{_ITEM}>"))) + F.size(F.coalesce(cut(F.col("j.items")), F.array().cast("array<string>")))
    kept = F.filter("all_items", lambda i: (i["title"] != "") | i["link"].isNotNull() | i["item_id"].isNotNull() | (i["summary"] != ""))
    title = F.coalesce(some(F.col("x.channel.title._VALUE")), some(F.col("x.title._VALUE")), some(F.col("j.title")), F.lit(""))
    out = read.select("feed_url", "format", title.alias("title"), F.coalesce(items, F.array().cast(items_type())).alias("all_items"), seen.alias("seen"))
    return out.select("feed_url", "format", "title", kept.alias("items"), (F.col("seen") - F.size(kept)).alias("malformed"))


def items_type() -> str:
    return "array<struct<item_id:string,title:string,link:string,summary:string,published:string,author:string,media:array<struct<type:string,url:string>>>>"


def posts_of(feeds: DataFrame) -> DataFrame:
    """One post per item that has an address (its own, or the feed's): platform_post_id, url, text (title and body), media, posted_at, author_name."""
    # a plain explode would make Spark filter by the size of the items, and read every body once more for that
    rows = feeds.select("feed_url", F.explode_outer("items").alias("i")).where("i is not null").select("feed_url", "i.*")
    marked = F.col("title").rlike("(?i)<[a-z/!]|&[#a-z0-9]+;")
    title = F.trim(F.regexp_replace(F.when(marked, T.html_text(F.col("title"))).otherwise(F.col("title")), r"\s+", " "))
    url = F.coalesce(resolve_url(F.col("link"), F.col("feed_url")), canonical_url(F.col("feed_url")))
    key = F.coalesce("item_id", "link")
    media = F.transform("media", lambda m: F.struct(m["type"].alias("type"), resolve_url(m["url"], F.col("feed_url")).alias("url")))
    first = F.filter(media, lambda m, i: m["url"].isNotNull() & (F.array_position(F.transform(media, lambda x: x["url"]), m["url"]) == i + 1))
    return rows.where(url.isNotNull()).select(
        "feed_url",
        F.when(F.length(key) <= MAX_ID, key).otherwise(F.sha1(F.coalesce(key, F.concat_ws("\n", "title", F.coalesce("link", F.lit("")))))).alias("platform_post_id"),
        url.alias("url"),
        F.substring(F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(T.html_text(F.col("summary")), F.lit(""))), 1, MAX_TEXT).alias("text"),
        F.slice(first, 1, MAX_MEDIA).alias("media"),
        parse_date(F.col("published")).cast("timestamp_ntz").alias("posted_at"),
        F.substring("author", 1, MAX_ID).alias("author_name"),
    )


RAW_POST = "struct<platformPostId:string,url:string,authorName:string,authorId:string,text:string,media:array<struct<type:string,url:string>>,capturedAt:string,capture:string,postedAt:string>"


def checked_batches(batches: DataFrame) -> DataFrame:
    """Pushed batches (batch_id, body of JSON) as posts with a reason why one is not taken (null: it is). Batches above MAX_BATCH are refused whole."""
    read = batches.select("batch_id", F.from_json("body", f"struct<sourceId:string,visitId:string,posts:array<{RAW_POST}>>").alias("b"))
    rows = read.select("batch_id", F.col("b.sourceId").alias("source_id"), F.size("b.posts").alias("n"), F.posexplode_outer("b.posts").alias("pos", "p"))
    over = lambda c, most: F.coalesce(F.length(F.col(c)) > most, F.lit(False))
    reason = (
        F.when(F.col("p").isNull(), "unreadable")
        .when(F.col("n") > MAX_BATCH, "batch too large")
        .when(F.coalesce(F.col("p.platformPostId"), F.lit("")) == "", "no id")
        .when(F.coalesce(F.col("p.url"), F.lit("")) == "", "no url")
        .when(F.col("p.text").isNull() | F.col("p.capturedAt").isNull(), "missing field")
        .when(over("p.platformPostId", MAX_ID) | over("p.url", MAX_URL) | over("p.text", MAX_TEXT) | over("p.authorName", MAX_ID) | over("p.authorId", MAX_ID), "too long")
        .when(F.size("p.media") > MAX_MEDIA, "too many media")
        .when(F.coalesce(F.col("p.capture") == "api", F.lit(False)), "capture not allowed")
    )
    return rows.select("batch_id", "source_id", "pos", "p.*", reason.alias("refused"))


def due_sources(sources: DataFrame, now: Column, fallback_s: int, size: int) -> DataFrame:
    """Active sources whose backoff has passed and whose last good visit is older than their interval; never visited first, then the oldest."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_ok").cast("timestamp"))
    due = (F.col("status") == "active") & (F.col("backoff_until").isNull() | (F.col("backoff_until") <= now)) & (F.col("last_ok").isNull() | (age >= F.coalesce("interval_s", F.lit(fallback_s))))
    return sources.where(due).orderBy(F.asc_nulls_first("last_ok"), "source_id").limit(size)


#: Connectors by name: from a table (feed_url, body) to posts. A site with a list format of its own registers here.
CONNECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def connector(name: str):
    def register(f):
        CONNECTORS[name] = f
        return f

    return register


@connector("feed")
def feed_connector(bodies: DataFrame) -> DataFrame:
    return posts_of(parse_feeds(bodies))


@connector("list")
def list_connector(bodies: DataFrame) -> DataFrame:
    """Pages of a listing site: {items: [{id, title, body, price, author_id, author_name, posted_at (ms), images}]}."""
    item = "struct<id:string,title:string,body:string,price:double,author_id:string,author_name:string,posted_at:bigint,images:array<string>>"
    rows = bodies.select("feed_url", F.explode(F.from_json("body", f"struct<total:bigint,items:array<{item}>>")["items"]).alias("i")).select("feed_url", "i.*").where("id is not null")
    return rows.select(
        "feed_url", F.col("id").alias("platform_post_id"), resolve_url(F.concat(F.lit("/item/"), "id"), F.col("feed_url")).alias("url"), F.substring(F.concat_ws("\n", F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim("body"), F.lit(""))), 1, MAX_TEXT).alias("text"),
        F.transform(F.slice("images", 1, MAX_MEDIA), lambda u: _media(F.lit("image"), u)).alias("media"), F.timestamp_millis("posted_at").cast("timestamp_ntz").alias("posted_at"), F.substring("author_name", 1, MAX_ID).alias("author_name"),
    )


def read_bodies(spark, path: str) -> DataFrame:
    """Files of bodies as (feed_url, body): whole files, the path standing for the address where no better one is known."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("feed_url"), F.col("value").alias("body"))
