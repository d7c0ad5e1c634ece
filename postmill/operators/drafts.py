"""Watches before they are stored: validation, references, filters against schemas; searches turned into watches and topics; the CSV export."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.operators.enrich import canon_value
from postmill.operators.search import Params, parse

#: Fixed: the columns of an export, in order.
CSV_COLUMNS = ("id", "url", "source", "author", "postedAt", "firstSeenAt", "capture", "intent", "priceVnd", "category", "item", "confidence", "editCount", "matchCount", "title", "text")


def _once(terms: Column) -> Column:
    """Terms whose folded form no earlier one has."""
    keys = F.transform(terms, T.fold)
    return F.filter(terms, lambda t, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def tidy(watches: DataFrame) -> DataFrame:
    """Watches with each term once, by folded form: in include, then in include_all if not in include, and in exclude."""
    none = F.array().cast("array<string>")
    out = watches.withColumns({c: F.coalesce(F.col(c), none) for c in ("include", "include_all", "exclude", "category_ids", "item_ids", "intents")})
    out = out.withColumns({c: _once(F.col(c)) for c in ("include", "include_all", "exclude")}).withColumn("_own", F.transform("include", T.fold))
    return out.withColumn("include_all", F.filter("include_all", lambda t: ~F.array_contains("_own", T.fold(t)))).drop("_own")


def problems(watches: DataFrame, now: Column) -> DataFrame:
    """Tidy watches with problems: what keeps each from being stored, none for a good one."""
    rows = tidy(watches)
    folded = lambda c: F.transform(c, T.fold)
    clash = F.array_sort(F.array_intersect(folded(F.col("include")), folded(F.col("exclude"))))
    empty = (F.size("include") + F.size("include_all") + F.size("category_ids") + F.size("item_ids") == 0) & (F.coalesce("regex", F.lit("")) == "")
    only_region = F.forall(F.coalesce("attribute_filters", F.array().cast("array<struct<key:string,op:string,value:string,values:array<string>>>")), lambda f: f["key"] == "region")
    found = F.array_compact(
        F.array(
            F.when(~F.length("name").between(1, 120), "name"),
            F.when(F.col("price_max") < F.col("price_min"), "priceMax must be >= priceMin"),
            F.when(F.col("muted_until") <= now, "mutedUntil must be a future date"),
            F.when(F.size(clash) > 0, F.concat(F.lit("in both include and exclude: "), F.array_join(clash, ", "))),
            F.when(~only_region & (F.size("category_ids") == 0), "attributeFilters need at least one category"),
            F.when(empty, "nothing to match by"),
        )
    )
    return rows.withColumn("problems", found)


def reference_problems(watches: DataFrame, categories: DataFrame, items: DataFrame, schemas: DataFrame, year_now: int) -> DataFrame:
    """(watch_id, problem): unknown categories and items, and attribute filters that the watch's schemas don't allow.

    A filter's key must be in a schema of a category of the watch (region: of any); gte and lte need ordered or number, in
    anything but number, and every value must be valid.
    """
    unknown = lambda ids, known, key, what: watches.select("watch_id", F.explode(ids).alias(key)).join(known.select(key).distinct(), key, "left_anti").select("watch_id", F.concat(F.lit(f"unknown {what}: "), F.col(key)).alias("problem"))
    filters = watches.select("watch_id", "category_ids", F.posexplode("attribute_filters").alias("pos", "f")).select("watch_id", "pos", "category_ids", "f.*")
    schemas = schemas.drop("pos")
    own = filters.select("watch_id", "pos", F.explode("category_ids").alias("category_id"), "key").join(schemas, ["category_id", "key"])
    region = filters.where("key = 'region'").select("watch_id", "pos", "key").join(schemas.where("key = 'region'"), "key")
    columns = ["watch_id", "pos", "kind", "values", "low", "high", "unit", "max_len"]
    defs = own.select(*columns, F.lit(0).alias("rank")).unionByName(region.select(*columns, F.lit(1).alias("rank")))
    first = defs.groupBy("watch_id", "pos").agg(F.min_by(F.struct("kind", F.col("values").alias("allowed"), "low", "high", "unit", "max_len"), "rank").alias("d"))
    given = filters.join(first, ["watch_id", "pos"], "left").withColumn("vals", F.when(F.col("op") == "in", F.coalesce("values", F.array().cast("array<string>"))).otherwise(F.array_compact(F.array("value"))))
    kind = F.col("d.kind")
    valid = F.forall("vals", lambda v: canon_value(v, F.col("d.kind"), F.col("d.allowed"), F.col("d.low"), F.col("d.high"), F.col("d.unit"), F.col("d.max_len"), F.lit(year_now)).isNotNull())
    wrong = (
        F.when(F.col("d").isNull(), F.concat(F.lit("unknown attribute: "), F.col("key")))
        .when(F.col("op").isin("gte", "lte") & ~kind.isin("ordered", "number"), F.concat_ws(" ", "op", F.lit("is not for"), kind))
        .when((F.col("op") == "in") & (kind == "number"), "in is not for number")
        .when(F.size("vals") == 0, F.concat_ws(" ", "op", F.lit("needs a value")))
        .when(~valid, F.concat(F.lit("invalid value for "), F.col("key")))
    )
    told = given.select("watch_id", wrong.alias("problem")).where("problem is not null")
    return unknown("category_ids", categories, "category_id", "category").unionByName(unknown("item_ids", items, "item_id", "item")).unionByName(told)


def watch_of_search(p: Params) -> tuple[dict | None, list[str]]:
    """A watch with the search's terms and filters (None if nothing is left to match by), and what a watch can't hold."""
    q = parse(p.q)
    watch = {"include_all": [*q.terms, *map(" ".join, q.phrases)], "exclude": list(map(" ".join, q.without)), "category_paths": p.category_paths, "item_ids": p.item_ids, "intents": p.intents, "source_ids": p.source_ids, "price_min": p.price_min, "price_max": p.price_max}
    dropped = [name for name, v in (("author", p.author), ("from", p.from_at), ("to", p.to_at), ("sort", p.sort if p.sort != "relevance" else None)) if v]
    return (watch if watch["include_all"] or p.category_paths or p.item_ids else None), dropped


def topic_of_search(p: Params) -> tuple[Params, list[str]]:
    """The search without what a topic can't hold, and the names of that."""
    dropped = [name for name, v in (("sourceIds", p.source_ids), ("author", p.author), ("from", p.from_at), ("to", p.to_at), ("sort", p.sort if p.sort != "relevance" else None)) if v]
    return replace(p, source_ids=[], author=None, from_at=None, to_at=None, sort="relevance"), dropped


def csv_lines(rows: DataFrame, salt: str) -> DataFrame:
    """(id, line) of rows with CSV_COLUMNS and author_id, author_name: safe cells, the author as a pseudonym, contacts in title and text masked."""
    author = T.author_label(T.pseudonym(salt, T.author_key(F.col("author_id"), F.col("author_name"))))
    shown = {"author": author, "title": T.mask(F.col("title")), "text": T.mask(F.col("text"))}
    return rows.select("id", F.concat_ws(",", *[T.csv_cell((shown.get(c, F.col(c) if c in rows.columns else F.lit(None))).cast("string")) for c in CSV_COLUMNS]).alias("line"))


def write_csv(rows: DataFrame, salt: str, path: str, most: int) -> None:
    """The first ``most`` rows by id as one file of CRLF lines, with a mark of byte order and a header. most bounds what its one task holds."""
    lines = csv_lines(rows.orderBy("id").limit(most), salt).select(F.lit(1).alias("part"), "id", "line")
    head = rows.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(None).cast(dict(lines.dtypes)["id"]).alias("id"), F.lit("\ufeff" + ",".join(CSV_COLUMNS)).alias("line"))
    lines.unionByName(head).coalesce(1).sortWithinPartitions("part", "id").select("line").write.option("lineSep", "\r\n").text(path)
