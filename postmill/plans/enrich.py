"""Enrichment on examples with known answers, over a small catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import price as P
from postmill.functions import text as T
from postmill.operators import enrich as E
from postmill.plans.texts import golden

CATEGORIES = [("v", "vehicles", "vehicles", "Vehicles"), ("c", "vehicles.cars", "cars", "Cars"), ("e", "electronics", "electronics", "Electronics"), ("p", "electronics.phones", "phones", "Phones"), ("l", "electronics.laptops", "laptops", "Laptops")]
ITEMS = [("i15", "p", "iPhone 15", ["ip15", "iphone15"], {"storage_gb": "256"}), ("i15p", "p", "iPhone 15 Pro Max", ["15 promax"], {}), ("mb", "l", "MacBook Pro", ["mbp"], {"chip": "m3"})]
#: category_id, key, kind, values, low, high, unit, max_len, label, key_attr, pos
SCHEMA = [
    ("v", "year", "number", None, 1980.0, 2100.0, "year", None, "Year", True, 1), ("v", "colour", "enum", ["red", "black", "other"], None, None, None, None, "Colour", False, 2), ("c", "make", "text", None, None, None, None, 40, "Make", True, 3),
    ("c", "model", "text", None, None, None, None, 40, "Model", True, 4), ("c", "transmission", "enum", ["auto", "manual"], None, None, None, None, "Gearbox", False, 5), ("c", "odo_km", "number", None, 0.0, 999999.0, "km", None, "Odometer", False, 6),
    ("c", "seats", "number", None, 2.0, 50.0, "count", None, "Seats", False, 7), ("c", "year", "number", None, 1990.0, 2100.0, "year", None, "Year", True, 1), ("p", "storage_gb", "number", None, 16.0, 2048.0, "gb", None, "Storage", True, 1),
    ("p", "battery_pct", "number", None, 50.0, 100.0, "pct", None, "Battery", False, 2), ("p", "market", "enum", ["vn", "ll", "za"], None, None, None, None, "Market", False, 3), ("l", "chip", "enum", ["m1", "m2", "m3", "m3_pro", "m3_max"], None, None, None, None, "Chip", True, 1),
    ("l", "ram_gb", "number", None, 4.0, 192.0, "gb", None, "RAM", True, 2), ("l", "ssd_gb", "number", None, 64.0, 8192.0, "gb", None, "SSD", True, 3), ("l", "screen_in", "number", None, 10.0, 20.0, "in", None, "Screen", False, 4),
]
#: category_id, key, value, label, match, implies
ALIASES = [("c", "make", "kia", "KIA", "kia", None), ("c", "make", "mercedes_benz", None, "mercedes", None), ("c", "model", "morning", None, "morning", {"make": "kia"}), ("c", "transmission", "auto", "Automatic", "so tu dong", None), ("c", "transmission", "manual", "Manual", "so san", None), ("v", "colour", "black", None, "đen", None)]
BOUNDS = [("v", 1e6, None), ("c", 30e6, 5e9), ("p", None, 60e6)]


def _dims(spark):
    categories = spark.createDataFrame(CATEGORIES, "category_id string, path string, slug string, name string")
    items = spark.createDataFrame(ITEMS, "item_id string, category_id string, name string, aliases array<string>, attributes map<string,string>")
    declared = spark.createDataFrame(SCHEMA, "category_id string, key string, kind string, values array<string>, low double, high double, unit string, max_len int, label string, key_attr boolean, pos int")
    aliases = spark.createDataFrame(ALIASES, "category_id string, key string, value string, label string, match string, implies map<string,string>")
    inherited = E.ancestors(categories).join(aliases.withColumnRenamed("category_id", "above"), "above").drop("above", "depth")
    bounds = E.price_bounds(categories, spark.createDataFrame(BOUNDS, "category_id string, low double, high double"))
    return categories, items, E.resolved_schemas(categories, declared), inherited, bounds


def _csv(m):
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")


TEXTS = [("bán iPhone 15 Pro Max 256gb giá 20tr", "p", "i15p", 0.9, "iphone 15,iphone 15 pro max"), ("ip15 đẹp", "p", "i15", 0.9, "ip15"), ("phones and laptops", "l", None, 0.6, "laptops,phones"), ("iphone 155", None, None, 0.0, ""), (None, None, None, 0.0, ""), ("MACBOOK-PRO macbook pro", "l", "mb", 0.9, "macbook pro")]


@golden("classify_posts", "text string", "category_id string, item_id string, confidence double, hits string", [((t,), tuple(r)) for t, *r in TEXTS])
def _classify(df):
    categories, items, *_ = _dims(df.sparkSession)
    return E.classify(df, E.alias_table(categories, items)).withColumn("hits", F.array_join("hits", ","))


RULES = [(("bán iPhone 15 giá 20tr like new",), ("sell", "like_new", 20e6, "exact", "i15", 0.9)), (("cần mua laptops 5x.000.000",), ("buy", "unknown", 50e6, "floor", None, 0.5)), (("mua xe cu",), ("buy", "used", None, None, None, 0.0)), (("987654321",), ("other", "unknown", None, None, None, 0.0))]


@golden("run_rules", "text string", "intent string, condition string, price double, price_qualifier string, item_id string, confidence double", RULES)
def _rules(df):
    categories, items, *_ = _dims(df.sparkSession)
    return E.run_rules(df, E.alias_table(categories, items))


@golden("prefilter", "text string", "kept boolean", [(("bán ip15",), (True,)), (("laptops cu",), (False,)), (("vé xem phim hay",), (True,)), (("khác",), (False,))])
def _prefilter(df):
    spark = df.sparkSession
    categories, items, *_ = _dims(spark)
    kept = E.prefilter(E.run_rules(df, E.alias_table(categories, items)), df, spark.createDataFrame([("Xem phim",)], "term string"), spark.createDataFrame([("p",)], "category_id string"))
    return df.join(kept.withColumn("kept", F.lit(True)), "id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


ATTRIBUTES = [
    (("Kia Morning 2016 số tự động odo 5,2 vạn 5 chỗ", "c"), ("make=kia,model=morning,odo_km=52000,seats=5,transmission=auto,year=2016",)),
    (("morning sx 2019, đăng kiểm 2027, đi 8v", "c"), ("make=kia,model=morning,odo_km=80000,year=2019",)),
    (("mercedes c200 màu đen, đăng kiểm 12/2026", "c"), ("colour=black,make=mercedes_benz",)),
    (("mercedes màu đen, đăng kiểm đến 12/2026", "c"), ("colour=black,make=mercedes_benz,year=2026",)),
    (("xe 12 2018 giá 2019tr odo 45.000 km", "c"), ("odo_km=45000",)),
    (("iphone 128gb pin 87% VN/A", "p"), ("battery_pct=87,market=vn,storage_gb=128",)),
    (("iphone 1tb pin 12%", "p"), ("storage_gb=1024",)),
    (('macbook m3 pro 16/512 14"', "l"), ("chip=m3_pro,ram_gb=16,screen_in=14,ssd_gb=512",)),
    (("mbp m3p 18/1tb", "l"), ("chip=m3_pro,ram_gb=18,ssd_gb=1024",)),
    (("ram 8 ssd 256gb m5", "l"), ("ram_gb=8,ssd_gb=256",)),
    (("không có gì", "e"), ("",)),
]


@golden("extract_attributes", "text string, category_id string", "found string", ATTRIBUTES)
def _attributes(df):
    _, _, schemas, aliases, _ = _dims(df.sparkSession)
    return E.extract_attributes(df, schemas, aliases, 2026).withColumn("found", _csv("attributes"))


@golden("canon_values", "key string, category_id string, raw string", "value string", [(("year", "c", "2016"), ("2016",)), (("year", "c", "2028"), (None,)), (("year", "c", "1985"), (None,)), (("year", "v", "1985"), ("1985",)), (("storage_gb", "p", "128 GB"), ("128",)), (("storage_gb", "p", "12,5"), (None,)), (("transmission", "c", "Auto"), ("auto",)), (("transmission", "c", "cvt"), (None,)), (("make", "c", "Mercedes-Benz"), ("mercedes_benz",)), (("market", "p", "VN/A"), ("vn",))])
def _canon(df):
    _, _, schemas, *_ = _dims(df.sparkSession)
    joined = df.join(schemas, ["category_id", "key"])
    return joined.withColumn("value", E.canon_value(F.col("raw"), F.col("kind"), F.col("values"), F.col("low"), F.col("high"), F.col("unit"), F.col("max_len"), F.lit(2026)))


@golden("schema_inheritance", "category_id string", "keys string, year_low double, price string", [(("v",), ("colour,year", 1980.0, "1000000.0-")), (("c",), ("colour,make,model,odo_km,seats,transmission,year", 1990.0, "30000000.0-5000000000.0")), (("p",), ("battery_pct,market,storage_gb", None, "0.0-60000000.0")), (("e",), (None, None, None))])
def _inherited(df):
    _, _, schemas, _, bounds = _dims(df.sparkSession)
    keys = schemas.groupBy("category_id").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("keys"), F.max(F.when(F.col("key") == "year", F.col("low"))).alias("year_low"))
    price = F.when(F.col("low").isNotNull(), F.concat(F.col("low").cast("decimal(20,1)").cast("string"), F.lit("-"), F.coalesce(F.col("high").cast("decimal(20,1)").cast("string"), F.lit(""))))
    return df.join(keys, "category_id", "left").join(bounds, "category_id", "left").withColumn("price", price)


@golden("category_fallback", "category string, item string, dflt string, path string, dflt_path string", "chosen string", [((None, None, "c", None, "vehicles.cars"), ("c",)), (("v", None, "c", "vehicles", "vehicles.cars"), ("c",)), (("p", None, "c", "electronics.phones", "vehicles.cars"), ("p",)), (("v", "x", "c", "vehicles", "vehicles.cars"), ("v",)), (("c", None, "v", "vehicles.cars", "vehicles"), ("c",)), (("c", None, None, "vehicles.cars", None), ("c",))])
def _fallback(df):
    return df.withColumn("chosen", E.category_or_default(F.col("category"), F.col("item"), F.col("dflt"), F.col("path"), F.col("dflt_path")))


@golden("prices_checked", "price double, raw string, low double, high double, bounded boolean", "kept double, suspect boolean", [((20e6, "20tr", 1e6, 60e6, True), (20e6, False)), ((90e6, "90tr", 1e6, 60e6, True), (None, True)), ((5e5, "500k", 1e6, None, True), (None, True)), ((3e9, "3 ty", None, None, False), (None, True)), ((None, "987654321", None, None, False), (None, True)), ((None, None, None, None, False), (None, False))])
def _checked(df):
    return df.withColumn("c", E.checked_price(F.col("price"), F.col("raw"), F.col("low"), F.col("high"), F.col("bounded"))).select("id", F.col("c.price").alias("kept"), F.col("c.suspect").alias("suspect"))


@golden("titles", "item string, shown_csv string, keyed string, car boolean, given string, text string", "rule string, given_kept string", [
    ((None, "make=KIA,model=Morning,year=2016,odo_km=52.000 km,fuel=Petrol,transmission=Automatic", "", True, "Kia Morning 2016", "kia morning"), ("KIA Morning 2016 · Automatic · 52.000 km", "Kia Morning 2016")),
    (("iPhone 15", "storage_gb=256GB", "256GB", False, "iPhone 15 512GB", "iphone 15"), ("iPhone 15 · 256GB", None)),
    ((None, "", "", False, "see www.x.com", "x"), (None, None)),
    ((None, "year=2016", "", True, "  Big\n deal ", "x"), (None, "Big deal")),
])
def _titles(df):
    shown = F.when(F.col("shown_csv") != "", F.str_to_map("shown_csv", F.lit(","), F.lit("="))).otherwise(F.create_map().cast("map<string,string>"))
    keyed = F.filter(F.split("keyed", ","), lambda x: x != "")
    ready = df.withColumn("shown", shown).withColumn("keys", keyed)
    return ready.select("id", E.rule_title(F.col("item"), F.col("shown"), F.col("keys"), F.col("car")).alias("rule"), E.accepted_title(F.col("given"), T.fold(F.col("text")), F.col("shown")).alias("given_kept"))


@golden("verdicts", "pct double, n bigint, price double, qualifier string", "line string", [((-10.4, 8, 1.0, "exact"), ("10% cheaper than 8 comparable listings",)), ((3.0, 6, 1.0, "approx"), ("3% pricier than 6 comparable listings · price not exact",)), ((0.2, 5, 1.0, None), ("At market price (5 comparable listings)",)), ((None, 1, 1.0, "exact"), ("Not enough comparable listings to judge the price (1 found)",)), ((-5.0, 9, None, None), ("No price",))])
def _verdicts(df):
    return df.withColumn("line", E.verdict(F.col("pct"), F.col("n"), 5, F.col("price"), F.col("qualifier")))


@golden("price_fits", "price double, suspect boolean, qualifier string, low double, high double", "fit_min string, fit_max string", [((10.0, False, "exact", 5.0, 9.0), ("ok", "fail")), ((10.0, False, "floor", 12.0, 9.0), ("unknown", "fail")), ((10.0, False, "ceiling", 12.0, 10.0), ("fail", "ok")), ((None, False, None, 5.0, None), ("unknown", None)), ((10.0, True, "exact", 5.0, 20.0), ("unknown", "unknown"))])
def _fits(df):
    return df.withColumn("f", E.price_fit(F.col("price"), F.col("suspect"), F.col("qualifier"), F.col("low"), F.col("high"))).select("id", F.col("f.min").alias("fit_min"), F.col("f.max").alias("fit_max"))


@golden("targets_split", "text string", "product string, price double, upper boolean", [(("Honda City dưới 250tr",), ("Honda City", 250e6, True)), (("iphone 15 >= 10tr",), ("iphone 15", 10e6, False)), (("macbook pro",), ("macbook pro", None, False)), (("dưới 5tr",), ("dưới 5tr", None, True))])
def _targets(df):
    split = df.withColumn("s", E.split_target(F.col("text"))).select("id", "s.*")
    return P.with_prices(split.withColumnRenamed("phrase", "text")).select("id", "product", "price", "upper")


@golden("watch_drafts", "make string, model string, year bigint, title string, category_id string, price double, suspect boolean", "name string, terms string, filters string, price_min double, price_max double", [(("Kia", "Morning", 2016, None, "c", 300e6, False), ("Kia Morning 2016", "kia,morning", "make=Kia,model=Morning,year>=2015,year<=2017", 255e6, 345e6)), ((None, None, None, "Old radio", "e", 1e6, True), ("Old radio", "", "", None, None))])
def _drafts(df):
    return E.watch_draft(df).withColumns({"terms": F.array_join("include", ","), "filters": F.array_join("filters", ",")})


@golden("source_regions", "override string, auto string, dflt string", "region string", [(("hanoi", "hue", "x"), ("hanoi",)), ((None, "mixed", "x"), (None,)), ((None, None, "hue"), ("hue",)), ((None, None, None), (None,)), (("any", "hue", None), (None,))])
def _regions(df):
    return df.withColumn("region", E.source_region(F.col("override"), F.col("auto"), F.col("dflt")))


FINAL = [
    (("Kia Morning 2016 odo 52.000 km", None, None, "c", 250e6, "250tr", "exact", 0.9, "seats=5,year=2010", "colour=red", "", None), ("c", 250e6, False, "colour=red,make=kia,model=morning,odo_km=52000,seats=5,year=2016", "KIA Morning 2016 · 52.000 km")),
    (("ip15 đẹp", "p", "i15", None, 90e6, "90tr", "exact", 0.9, "", "", "battery_pct=90", "iPhone 15 keng"), ("p", None, True, "battery_pct=90,storage_gb=256", "iPhone 15 keng")),
    (("xe hơi", "c", None, None, None, None, None, None, "year=2019,make=kia", "", "", None), ("c", None, False, "make=kia", "KIA")),
]


@golden("finalize_enrichment", "text string, category_id string, item_id string, default_category_id string, price double, price_raw string, price_qualifier string, price_confidence double, base_csv string, defaults_csv string, structured_csv string, given_title string", "category_id string, price double, price_suspect boolean, attributes string, display_title string", FINAL)
def _finalize(df):
    categories, items, schemas, aliases, bounds = _dims(df.sparkSession)
    pairs = lambda c: F.when(F.col(c) != "", F.str_to_map(c, F.lit(","), F.lit("="))).otherwise(F.create_map().cast("map<string,string>"))
    rows = df.withColumns({"base": pairs("base_csv"), "defaults": pairs("defaults_csv"), "structured": pairs("structured_csv")}).drop("base_csv", "defaults_csv", "structured_csv")
    return E.finalize(rows, schemas, aliases, items, bounds, categories, 2026).withColumn("attributes", _csv("attributes"))
