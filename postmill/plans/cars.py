"""Enrichment of listings made of orders: attributes, schemas by the nation's tree, prices under bounds, titles, verdicts, watches. The SQL knows an order's numbers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions import price as P
from postmill.functions import text as T
from postmill.operators import drafts as D
from postmill.operators import enrich as E
from postmill.operators import lifecycle as L
from postmill.operators.matching import FILTER
from postmill.plans.catalog import query
from postmill.plans.enrich import _csv, _dims
from postmill.plans.listings import LISTINGS, fill, listings, written
from postmill.sources import bridge as B
from postmill.sources.bridge import ZONE

YEAR = 2026
#: Texts of attributes by form, and the category of each.
ATTRIBUTE_FORMS = ("Kia Morning {y} số tự động odo {d},{e} vạn {d} chỗ", "mercedes màu đen sx {y}, đăng kiểm 12/2027, đi {d}v{e}", "iphone {g}gb pin {q}% VN/A", "macbook m{h} pro {d}/{g} 14\"", "ram {d} ssd {g}gb m{h}", "xe odo {n}.000 km, xe 12 {y}")
ATTRIBUTE_SQL = """case form % 6 when 0 then concat_ws(',', 'make=kia', 'model=morning', 'odo_km=' || (d * 10000 + e * 1000), case when d >= 2 then 'seats=' || d end, 'transmission=auto', case when y between 1990 and 2027 then 'year=' || y end)
  when 1 then concat_ws(',', 'colour=black', 'make=mercedes_benz', 'odo_km=' || (d * 10000 + e * 1000), case when y between 1990 and 2027 then 'year=' || y end) when 2 then concat_ws(',', case when q between 50 and 99 then 'battery_pct=' || q end, 'market=vn', 'storage_gb=' || g)
  when 3 then concat_ws(',', case when h = 3 then 'chip=m3_pro' else 'chip=m' || h end, case when d >= 4 then 'ram_gb=' || d end, 'screen_in=14', 'ssd_gb=' || g) when 4 then concat_ws(',', 'chip=m' || h, case when d >= 4 then 'ram_gb=' || d end, 'ssd_gb=' || g)
  else 'odo_km=' || n * 1000 end"""
NUMBERS = LISTINGS + ", numbers as (select *, n % 10 as e, 40 + c % 60 as q, [128, 256, 512][c % 3 + 1] as g, 1 + c % 3 as h from listings)"


def _numbers(spark, d) -> DataFrame:
    c = F.col("c")
    return listings(spark, d).withColumns({"e": F.col("n") % 10, "q": 40 + c % 60, "g": F.element_at(F.array(*map(F.lit, (128, 256, 512))), (c % 3 + 1).cast("int")), "h": 1 + c % 3})


def _category(*ids: str):
    return F.element_at(F.array(*map(F.lit, ids)), (F.col("form") % len(ids) + 1).cast("int"))


@query(f"with {NUMBERS} select id, {ATTRIBUTE_SQL} as found from numbers")
def extract_attributes(spark, d):
    _, _, schemas, aliases, _ = _dims(spark)
    posts = _numbers(spark, d).select("id", written(*ATTRIBUTE_FORMS).alias("text"), _category("c", "c", "p", "l", "l", "c").alias("category_id"))
    return E.extract_attributes(posts, schemas, aliases, YEAR).select("id", _csv("attributes").alias("found"))


@query(f"""with {NUMBERS} select id, case form % 6 when 0 then case when y between 1990 and 2027 then y end when 1 then case when y between 1980 and 2027 then y end when 2 then g end::varchar as number, case form % 6 when 3 then 'auto' when 4 then 'mercedes_benz' when 5 then case when h = 1 then 'vn' end end as word from numbers""")
def canon_values(spark, d):
    """Raw values of six attributes in canonical form; invalid ones are null."""
    _, _, schemas, *_ = _dims(spark)
    raw = F.when(F.col("form") % 6 == 5, F.when(F.col("h") == 1, "VN/A").otherwise("XX")).otherwise(written("{y}", " {y} ", "{g} GB", "Auto", "Mercedes-Benz", ""))
    rows = _numbers(spark, d).select("id", raw.alias("raw"), _category("c", "v", "p", "c", "c", "p").alias("category_id"), _category("year", "year", "storage_gb", "transmission", "make", "market").alias("key"))
    value = E.canon_value(F.col("raw"), F.col("kind"), F.col("values"), F.col("low"), F.col("high"), F.col("unit"), F.col("max_len"), F.lit(YEAR))
    made = rows.join(schemas, ["category_id", "key"]).withColumn("value", value)
    return made.select("id", F.when(F.col("kind") == "number", F.col("value")).alias("number"), F.when(F.col("kind") != "number", F.col("value")).alias("word"))


@query("""with tree as (select 'r' || r_regionkey as category_id, 'r' || r_regionkey as path from region union all select 'n' || n_nationkey, 'r' || n_regionkey || '.n' || n_nationkey from nation)
select t.category_id, case when t.category_id[1:1] = 'r' then case when r.r_regionkey % 2 = 0 then 'colour,year' else 'year' end else concat_ws(',', case when r.r_regionkey % 2 = 0 then 'colour' end, case when n.n_nationkey % 2 = 0 then 'make' end, 'year') end as keys,
  cast(case when n.n_nationkey % 3 = 0 then 1990 else 1980 end as double) as year_low, cast(case when n.n_nationkey % 4 = 1 then 5e6 else 1e6 end as double) as low, cast(case when n.n_nationkey % 4 = 1 then 9e9 end as double) as high
from tree t left join nation n on t.category_id = 'n' || n.n_nationkey join region r on t.category_id = 'r' || r.r_regionkey or n.n_regionkey = r.r_regionkey""")
def schema_inheritance(spark, d):
    """Schemas and price bounds that nations inherit from their regions and override."""
    nation, region = B.table(spark, d, "nation"), B.table(spark, d, "region")
    r, n = F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    tree = region.select(r.alias("category_id"), r.alias("path")).unionByName(nation.select(n.alias("category_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("."), n).alias("path")))
    own = lambda df, i, key, low: df.select(i.alias("category_id"), F.lit(key).alias("key"), F.lit(low).cast("double").alias("low"))
    declared = own(region, r, "year", 1980).unionByName(own(region.where("r_regionkey % 2 = 0"), r, "colour", None)).unionByName(own(nation.where("n_nationkey % 3 = 0"), n, "year", 1990)).unionByName(own(nation.where("n_nationkey % 2 = 0"), n, "make", None))
    bounds = region.select(r.alias("category_id"), F.lit(1e6).alias("low"), F.lit(None).cast("double").alias("high")).unionByName(nation.where("n_nationkey % 4 = 1").select(n.alias("category_id"), F.lit(5e6).alias("low"), F.lit(9e9).alias("high")))
    schemas = E.resolved_schemas(tree, declared)
    keys = schemas.groupBy("category_id").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("keys"), F.max(F.when(F.col("key") == "year", F.col("low"))).alias("year_low"))
    return keys.join(E.price_bounds(tree, bounds), "category_id")


PATHS = [("v", "vehicles"), ("c", "vehicles.cars"), ("e", "electronics"), ("p", "electronics.phones")]
PATH_SQL = "paths(category, path) as (values ('v', 'vehicles'), ('c', 'vehicles.cars'), ('e', 'electronics'), ('p', 'electronics.phones'))"


@query(f"""with {LISTINGS}, {PATH_SQL}, r as (select id, [null, 'v', 'c', 'e', 'p'][c % 5 + 1] as category, case when n % 4 = 0 then 'item' end as item, [null, 'v', 'c', 'p'][d % 4 + 1] as dflt from listings),
j as (select r.*, a.path as own, b.path as dp from r left join paths a on a.category = r.category left join paths b on b.category = r.dflt)
select id, case when dflt is null then category when category is null then dflt when item is not null or split_part(own, '.', 1) <> split_part(dp, '.', 1) or own = dp or starts_with(own, dp || '.') then category else dflt end as chosen from j""")
def category_fallback(spark, d):
    pick = lambda i, *v: F.element_at(F.array(*map(F.lit, v)), (i + 1).cast("int"))
    rows = listings(spark, d).select("id", pick(F.col("c") % 5, None, "v", "c", "e", "p").alias("category"), F.when(F.col("n") % 4 == 0, "item").alias("item"), pick(F.col("d") % 4, None, "v", "c", "p").alias("dflt"))
    paths = spark.createDataFrame(PATHS, "category string, path string")
    both = rows.join(paths, "category", "left").join(paths.withColumnsRenamed({"category": "dflt", "path": "dflt_path"}), "dflt", "left")
    return both.select("id", E.category_or_default(F.col("category"), F.col("item"), F.col("dflt"), F.col("path"), F.col("dflt_path")).alias("chosen"))


@query(f"""with {LISTINGS}, r as (select id, cast(n * 1e6 as double) as price, cast(case when d % 3 > 0 then d * 2e7 else 0 end as double) as low, cast(case when d % 3 = 1 then d * 9e7 end as double) as high, d % 3 > 0 as bounded, form from listings),
k as (select *, form % 5 = 4 or (bounded and price < low) or price > case when bounded then coalesce(high, 9e15) else 2e9 end as bad from r)
select id, case when not bad and form % 5 <> 4 then price end as kept, bad as suspect from k""")
def prices_checked(spark, d):
    """Prices within a category's bounds; nine digits without a price are a phone number."""
    rows = listings(spark, d)
    phone = F.col("form") % 5 == 4
    d_, price = F.col("d"), F.when(~phone, F.col("n") * 1e6)
    raw = F.when(phone, F.lit("987654321")).otherwise(fill("{n}tr"))
    low, high = F.when(d_ % 3 > 0, d_ * 2e7).otherwise(0.0), F.when(d_ % 3 == 1, d_ * 9e7)
    return rows.select("id", E.checked_price(price, raw, low, high, d_ % 3 > 0).alias("c")).select("id", F.col("c.price").alias("kept"), F.col("c.suspect").alias("suspect"))


@query(f"""with {LISTINGS} select id, case when form % 3 = 2 then 'iPhone ' || d || ' · ' || n || 'GB' else 'KIA Morning ' || y || case when form % 3 = 0 then ' · Automatic · ' || n || '.000 km' else '' end end as rule, case when form % 3 = 2 then null when d % 2 = 0 then 'Kia ' || y end as given_kept from listings""")
def titles(spark, d):
    """Titles by rule, and given ones, of which a number that the text does not have is refused."""
    car, none = F.col("form") % 3 != 2, F.lit(None).cast("string")
    y, extra = F.col("y").cast("string"), F.col("form") % 3 == 0
    shown = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, ("make", "model", "year", "transmission", "odo_km"))), F.array(F.when(car, "KIA"), F.when(car, "Morning"), F.when(car, y), F.when(extra, "Automatic"), F.when(extra, fill("{n}.000 km")))), lambda k, v: v.isNotNull())
    given = F.when(car, F.when(F.col("d") % 2 == 0, fill("Kia {y}")).otherwise(fill("Kia 9{y}"))).otherwise(F.lit("<b>"))
    rule = E.rule_title(F.when(car, none).otherwise(fill("iPhone {d}")), shown, F.when(car, F.array().cast("array<string>")).otherwise(F.array(fill("{n}GB"))), car)
    return listings(spark, d).select("id", rule.alias("rule"), E.accepted_title(given, T.fold(fill("kia {y} dep")), shown).alias("given_kept"))


@query(f"""with {LISTINGS}, r as (select id, (n % 41 - 20) + 0.4 as pct, c % 9 as n, form from listings)
select id, case when form % 7 = 6 then 'No price' else case when form % 7 = 5 or n < 5 then 'Not enough comparable listings to judge the price (' || n || ' found)' when pct <= -1 then cast(floor(abs(pct) + 0.5) as bigint) || '% cheaper than ' || n || ' comparable listings'
  when pct >= 1 then cast(floor(pct + 0.5) as bigint) || '% pricier than ' || n || ' comparable listings' else 'At market price (' || n || ' comparable listings)' end || case when form % 2 = 0 then ' · price not exact' else '' end end as line from r""")
def verdicts(spark, d):
    kind = F.col("form") % 7
    pct = F.when(kind != 5, (F.col("n") % 41 - 20) + 0.4)
    return listings(spark, d).select("id", E.verdict(pct, F.col("c") % 9, 5, F.when(kind != 6, F.col("v")), F.when(F.col("form") % 2 == 0, "approx").otherwise("exact")).alias("line"))


@query(f"""with {LISTINGS}, r as (select id, n as price, form, d * 50 as low, d * 90 as high, ['exact', 'floor', 'ceiling', 'approx'][form % 4 + 1] as q, c % 5 = 0 as suspect, c % 7 = 0 as unbound from listings)
select id, case when suspect then 'unknown' when q = 'floor' then case when price >= low then 'ok' else 'unknown' end when q = 'ceiling' then case when price < low then 'fail' else 'unknown' end when price >= low then 'ok' else 'fail' end as fit_min,
  case when unbound then null when suspect then 'unknown' when q = 'floor' then case when price > high then 'fail' else 'unknown' end when q = 'ceiling' then case when price <= high then 'ok' else 'unknown' end when price <= high then 'ok' else 'fail' end as fit_max from r""")
def price_fits(spark, d):
    q = F.element_at(F.array(*map(F.lit, ("exact", "floor", "ceiling", "approx"))), (F.col("form") % 4 + 1).cast("int"))
    fit = E.price_fit(F.col("n").cast("double"), F.col("c") % 5 == 0, q, F.col("d") * 50.0, F.when(F.col("c") % 7 != 0, F.col("d") * 90.0))
    return listings(spark, d).select("id", fit.alias("f")).select("id", F.col("f.min").alias("fit_min"), F.col("f.max").alias("fit_max"))


@query(f"with {LISTINGS} select id, case form % 3 when 0 then 'Honda City' when 1 then 'iphone ' || d else 'macbook ' || n end as product, cast(case form % 3 when 0 then n * 1e6 when 1 then n * 1e3 end as double) as price, form % 3 = 0 as upper from listings")
def targets_split(spark, d):
    rows = listings(spark, d).select("id", E.split_target(written("Honda City dưới {n}tr", "iphone {d} >= {n}k", "macbook {n}")).alias("s")).select("id", "s.*")
    return P.with_prices(rows.withColumnRenamed("phrase", "text")).select("id", "product", "price", "upper")


@query(f"""with {LISTINGS} select id, case when form % 2 = 0 then 'Kia Morning ' || y else 'Old radio ' || n end as name, case when form % 2 = 0 then 'kia,morning' else '' end as terms, case when form % 2 = 0 then 'make=Kia,model=Morning,year>=' || (y - 1) || ',year<=' || (y + 1) else '' end as filters,
  cast(case when d % 2 = 0 then floor(n * 0.85 + 0.5) * 1e6 end as double) as price_min, cast(case when d % 2 = 0 then floor(round(n * 1.15, 6) + 0.5) * 1e6 end as double) as price_max from listings""")
def watch_drafts(spark, d):
    even = F.col("form") % 2 == 0
    rows = listings(spark, d).select("id", F.when(even, "Kia").alias("make"), F.when(even, "Morning").alias("model"), F.when(even, F.col("y")).alias("year"), fill("Old radio {n}").alias("title"), F.lit("c").alias("category_id"), (F.col("n") * 1e6).alias("price"), (F.col("d") % 2 != 0).alias("suspect"))
    return E.watch_draft(rows).select("id", "name", F.array_join("include", ",").alias("terms"), F.array_join("filters", ",").alias("filters"), "price_min", "price_max")


@query("select s_suppkey as source_id, nullif(nullif(nullif(coalesce(case when s_suppkey % 3 = 0 then 'hue' || s_nationkey end, case s_suppkey % 4 when 0 then 'mixed' when 1 then 'any' when 2 then 'hanoi' end, case when s_suppkey % 5 > 0 then 'other' end), 'mixed'), 'any'), 'other') as region from supplier")
def source_regions(spark, d):
    k = F.col("s_suppkey")
    auto = F.when(k % 4 == 0, "mixed").when(k % 4 == 1, "any").when(k % 4 == 2, "hanoi")
    return B.table(spark, d, "supplier").select(k.alias("source_id"), E.source_region(F.when(k % 3 == 0, F.concat(F.lit("hue"), F.col("s_nationkey").cast("string"))), auto, F.when(k % 5 > 0, "other")).alias("region"))


@query(f"""with {NUMBERS}, r as (select *, y between 1990 and 2027 as dated, n between 30 and 5000 as fair, d >= 2 as seated from numbers)
select id, 'c' as category_id, cast(case when fair then n * 1e6 end as double) as price, not fair as price_suspect, concat_ws(',', 'colour=red', 'make=kia', 'model=morning', 'odo_km=' || n * 1000, case when seated then 'seats=' || d end, case when dated then 'year=' || y end) as attributes,
  'KIA Morning' || case when dated then ' ' || y else '' end || ' · ' || n || '.000 km' as display_title from r""")
def finalize_enrichment(spark, d):
    """Cars: the default category, a price under its bounds, attributes of source, base and text, and the title by rule."""
    categories, items, schemas, aliases, bounds = _dims(spark)
    none, pair = F.lit(None).cast("string"), lambda k, v: F.create_map(F.lit(k), v)
    rows = _numbers(spark, d).select(
        "id", fill("Kia Morning {y} odo {n}.000 km").alias("text"), none.alias("category_id"), none.alias("item_id"), F.lit("c").alias("default_category_id"), (F.col("n") * 1e6).alias("price"), fill("{n}tr").alias("price_raw"), F.lit("exact").alias("price_qualifier"), F.lit(0.9).alias("price_confidence"),
        F.map_concat(pair("seats", F.col("d").cast("string")), pair("year", F.lit("1991"))).alias("base"), pair("colour", F.lit("red")).alias("defaults"), F.create_map().cast("map<string,string>").alias("structured"), none.alias("given_title"),
    )
    done = E.finalize(rows.withColumn("base", F.when(F.col("text").contains("1991"), F.col("base")).otherwise(F.map_filter("base", lambda k, v: k != "year"))), schemas, aliases, items, bounds, categories, YEAR)
    return done.select("id", "category_id", "price", "price_suspect", _csv("attributes").alias("attributes"), "display_title")


LOCAL = "(ts + interval 7 hours)"


@query(f"""with e as (select event_id as id, {LOCAL} as now, ['22:00', '12:00', '08:00'][event_id % 3 + 1] as a, ['07:00', '13:30', '08:00'][event_id % 3 + 1] as b from events),
q as (select *, strftime(now, '%H:%M') as clock, date_trunc('day', now) + to_minutes(cast(b[1:2] as integer) * 60 + cast(b[4:5] as integer)) as finish from e)
select id, case when (a < b and clock >= a and clock < b) or (a > b and (clock >= a or clock < b)) then case when finish > now then finish else finish + interval 1 day end - interval 7 hours end as until from q""")
def quiet_hours_end(spark, d):
    """When the quiet hours end that an event falls into: over night, at noon, and none."""
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("event_id") % 3 + 1).cast("int"))
    return B.table(spark, d, "events").select(F.col("event_id").alias("id"), L.quiet_until(pick("22:00", "12:00", "08:00"), pick("07:00", "13:30", "08:00"), F.col("ts"), ZONE).alias("until"))


NIGHT = dt.datetime(2026, 1, 1, 16, 30)


@query("""with n as (select l_orderkey * 10 + l_linenumber as id, l_partkey % 4 = 0 as muted, l_suppkey % 3 = 0 as quiet, case when l_linenumber % 2 = 0 then 'digest' else 'instant' end as mode, case l_orderkey % 3 when 0 then timestamp '2026-01-01 18:00:00' when 1 then timestamp '2026-01-01 16:00:00' end as due from lineitem)
select id, case when muted then 'suppressed' when quiet or mode = 'digest' or due > timestamp '2026-01-01 16:30:00' then 'pending' else 'send' end as status, case when muted then due when quiet then timestamp '2026-01-02 00:00:00' when mode = 'digest' and due is null then timestamp '2026-01-01 16:50:00' else due end as next_attempt_at,
  case when muted then null when quiet then 'quiet' when mode = 'digest' and due is null then 'accumulate' end as batch_kind from n""")
def notify_schedule(spark, d):
    """What becomes of pending notifications at half past eleven at night."""
    k = F.col("l_orderkey")
    watch = F.struct(F.when(F.col("l_partkey") % 4 == 0, F.lit(dt.datetime(2030, 1, 1)).cast("timestamp_ntz")).alias("muted_until"), F.when(F.col("l_suppkey") % 3 == 0, "22:00").alias("quiet_start"), F.when(F.col("l_suppkey") % 3 == 0, "07:00").alias("quiet_end"))
    due = F.when(k % 3 == 0, F.lit(dt.datetime(2026, 1, 1, 18)).cast("timestamp_ntz")).when(k % 3 == 1, F.lit(dt.datetime(2026, 1, 1, 16)).cast("timestamp_ntz"))
    rows = B.table(spark, d, "lineitem").select((k * 10 + F.col("l_linenumber")).alias("id"), F.array(watch).alias("watches"), F.when(F.col("l_linenumber") % 2 == 0, "digest").otherwise("instant").alias("mode"), F.lit(30).alias("every_min"), due.alias("next_attempt_at"), F.lit(dt.datetime(2026, 1, 1, 16, 20)).cast("timestamp_ntz").alias("matched_at"))
    return L.schedule(rows, F.lit(NIGHT).cast("timestamp_ntz"), ZONE, 60)


@query("""with s as (select c_custkey as source_id, timestamp '2026-01-01 03:00:00' - to_seconds(c_custkey * 97 % 20000) as last_ok, case when c_custkey % 4 = 0 then timestamp '2026-01-01 02:30:00' end as alert_at, case when c_custkey % 5 > 0 then 600 else 900 end as every, case c_custkey % 11 when 7 then 'paused' when 8 then 'paused_by_health' else 'active' end as status from customer),
g as (select *, epoch(timestamp '2026-01-01 03:00:00') - epoch(greatest(last_ok, timestamp '2026-01-01 00:00:00')) as gap from s where status <> 'paused')
select source_id, cast(gap as bigint) as gap_s, case when alert_at is not null and (last_ok > alert_at or gap < 1.5 * every + 60) then 'recovered' when alert_at is null and gap >= 1.5 * every + 60 then 'alert' end as verdict from g""")
def watchdog_verdicts(spark, d):
    """Silence of sources at ten in the morning: alerts once a gap, recoveries."""
    k, now = F.col("c_custkey"), F.lit(dt.datetime(2026, 1, 1, 3)).cast("timestamp_ntz")
    ago = F.timestamp_add("SECOND", (-(k * 97 % 20_000)).cast("int"), now)
    rows = B.table(spark, d, "customer").select(k.alias("source_id"), F.when(k % 11 == 7, "paused").when(k % 11 == 8, "paused_by_health").otherwise("active").alias("status"), F.when(k % 5 > 0, 600).alias("interval_s"), ago.alias("last_ok"), F.lit(dt.datetime(2025, 1, 1)).cast("timestamp_ntz").alias("created_at"), F.when(k % 4 == 0, F.lit(dt.datetime(2026, 1, 1, 2, 30)).cast("timestamp_ntz")).alias("alert_at"))
    return L.watchdog(rows, now, "07:00", "23:00", ZONE, 60, 900)


@query(f"""with {LISTINGS} select id, case when form % 4 = 0 then 'red' else 'red|pro' end as terms, concat_ws(';', case when d = 1 then 'name' end, case when d > 5 then 'priceMax must be >= priceMin' end, case when form % 4 = 2 then 'mutedUntil must be a future date' end, case when form % 4 = 3 then 'in both include and exclude: red' end) as problems from listings""")
def watch_validation(spark, d):
    """Watches with a term twice, wrong prices, a mute that is over, and a term that is also excluded."""
    form, none = F.col("form") % 4, F.array().cast("array<string>")
    rows = listings(spark, d).select(
        "id", F.when(F.col("d") == 1, "").otherwise(fill("watch {n}")).alias("name"), F.array(F.lit("red"), F.lit("Réd")).alias("include"), F.when(form == 0, F.array(F.lit("RED"))).otherwise(F.array(F.lit("RED"), F.lit("pro"))).alias("include_all"), F.when(form == 3, F.array(F.lit("RED"))).otherwise(none).alias("exclude"), F.lit(None).cast("string").alias("regex"),
        none.alias("category_ids"), none.alias("item_ids"), none.alias("intents"), F.lit(None).cast(f"array<{FILTER}>").alias("attribute_filters"), F.col("d").cast("double").alias("price_min"), F.lit(5.0).alias("price_max"), F.when(form == 2, F.lit(dt.datetime(2020, 1, 1)).cast("timestamp_ntz")).alias("muted_until"),
    )
    out = D.problems(rows, F.lit("2026-01-01").cast("timestamp_ntz"))
    return out.select("id", F.concat_ws("|", F.array_join("include", ","), F.nullif(F.array_join("include_all", ","), F.lit(""))).alias("terms"), F.array_join("problems", ";").alias("problems"))


@query(f"""with {LISTINGS} select id, case form % 6 when 0 then case when y > 2027 or y < 1990 then 'invalid value for year' else '' end when 1 then 'unknown attribute: year;unknown category: zz' || n || ';unknown item: i9' || n when 2 then 'gte is not for text' when 3 then 'in is not for number' when 4 then case when d % 2 = 0 then '' else 'invalid value for market' end else 'eq needs a value' end as told from listings""")
def watch_references(spark, d):
    """Watches' filters against the schemas of their categories."""
    categories, items, schemas, *_ = _dims(spark)
    form = F.col("form") % 6
    category = F.when(form == 1, fill("zz{n}")).when(form == 4, "p").otherwise("c")
    key = F.when(form == 2, "make").when(form == 4, "market").otherwise("year")
    op = F.when(form.isin(0, 2), "gte").when(form.isin(3, 4), "in").otherwise("eq")
    value = F.when(form.isin(0, 1), F.col("y").cast("string")).when(form == 2, "kia")
    values = F.when(form == 3, F.array(F.lit("2016"), F.lit("2017"))).when(form == 4, F.when(F.col("d") % 2 == 0, F.array(F.lit("vn"), F.lit("za"))).otherwise(F.array(F.lit("vn"), F.lit("xx"))))
    f = F.struct(key.alias("key"), op.alias("op"), value.alias("value"), values.alias("values"))
    watches = listings(spark, d).select(F.col("id").alias("watch_id"), F.array(category).alias("category_ids"), F.array(F.when(form == 1, fill("i9{n}")).otherwise("i15")).alias("item_ids"), F.array(f).alias("attribute_filters"))
    told = D.reference_problems(watches, categories, items, schemas, YEAR).groupBy("watch_id").agg(F.array_join(F.array_sort(F.collect_list("problem")), ";").alias("told"))
    return watches.select("watch_id").join(told, "watch_id", "left").select(F.col("watch_id").alias("id"), F.coalesce("told", F.lit("")).alias("told"))
