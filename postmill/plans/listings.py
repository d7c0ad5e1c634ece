"""Listings made of orders: each order's numbers are written into a text in one of many forms, and read back from it.

The SQL never sees the texts' grammar: it knows an order's form and numbers, and says by the rule what must be found.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import price as P
from postmill.functions import terms as K
from postmill.functions import text as T
from postmill.operators import enrich as E
from postmill.operators import matching as M
from postmill.operators import search as S
from postmill.operators import text_terms
from postmill.plans import catalog as C
from postmill.plans.catalog import query
from postmill.sources import bridge as B
from postmill.sources.bridge import CORPUS, views

#: id, form (0 to 15), n (10 to 899), d (1 to 9), x (three digits), y (a year), c and v (customer and amount).
LISTINGS = """listings as (select o_orderkey as id, (o_orderkey + o_custkey) % 16 as form, 10 + o_custkey % 890 as n, 1 + o_orderkey % 9 as d, cast(110 + o_custkey % 880 as varchar) as x, 1975 + o_orderkey % 60 as y, o_custkey as c, o_totalprice as v from orders)"""


def listings(spark, d) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return B.table(spark, d, "orders").select(k.alias("id"), ((k + c) % 16).alias("form"), (10 + c % 890).alias("n"), (1 + k % 9).alias("d"), (110 + c % 880).cast("string").alias("x"), (1975 + k % 60).alias("y"), c.alias("c"), F.col("o_totalprice").alias("v"))


def fill(template: str) -> Column:
    """A text with the values of the columns named in braces."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def written(*templates: str) -> Column:
    """The text of a listing's form; forms beyond the last template begin anew."""
    form = F.col("form") % len(templates)
    return reduce(lambda a, t: a.when(form == t[0], fill(t[1])), enumerate(templates), F)


PRICE_FORMS = (
    "giá {n}tr", "{n} triệu", "bán {n}tr{d}", "{n}k", "{n}.{d}00.000đ", "khoảng {n} củ", "dưới {n}tr", "hơn {n} triệu",
    "{n}-{m}tr", "{b} tỷ {d}", "giá {d}x.000.000", "đặt cọc {n}tr", "trả trước {d}tr, bán {n}tr", "lh 0912 345 {x}", "gia {n}0000", "xe {y}",
)
VALUE = """case form when 0 then n * 1e6 when 1 then n * 1e6 when 2 then n * 1e6 + d * 1e5 when 3 then n * 1e3 when 4 then n * 1e6 + d * 1e5 when 5 then n * 1e6 when 6 then n * 1e6 when 7 then n * 1e6 when 8 then n * 1e6
  when 9 then (1 + d % 4) * 1e9 + d * 1e8 when 10 then d * 1e7 when 12 then n * 1e6 when 14 then n * 1e4 end"""
PRICED = LISTINGS + f""", priced as (select *, cast({VALUE} as double) as price, case when form in (0, 1, 2, 3, 4, 9, 12, 14) then 'exact' when form = 5 then 'approx' when form = 6 then 'ceiling' when form in (7, 10) then 'floor' when form = 8 then 'range' end as price_qualifier,
  cast(case when form in (0, 2, 12, 14) then 0.9 when form in (1, 3, 4, 9) then 0.7 when form in (5, 8) then 0.6 when form in (6, 7, 10) then 0.5 else 0 end as double) as price_confidence from listings)"""


def _priced(spark, d) -> DataFrame:
    rows = listings(spark, d).withColumn("m", F.col("n") + 5).withColumn("b", 1 + F.col("d") % 4)
    return P.with_prices(rows.withColumn("text", written(*PRICE_FORMS)))


@query(f"with {PRICED} select id, price, price_qualifier, price_confidence from priced")
def price_parse(spark, d):
    return _priced(spark, d).select("id", "price", "price_qualifier", "price_confidence")


@query(f"""with {PRICED} select id, case when form in (13, 15) then 0 when form = 12 then 2 else 1 end as n_found, cast(case when form in (13, 15) then null when form = 11 then n * 1e6 when form = 12 then d * 1e6 + n * 1e6 else price end as double) as total,
  case when form in (13, 15) then '' when form in (0, 2, 10, 14) then 'asking' when form = 11 then 'excluded' when form = 12 then 'excluded asking' else 'neutral' end as roles from priced""")
def price_candidates(spark, d):
    found = F.col("candidates")
    total = F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, x: a + x["value"]))
    return _priced(spark, d).select("id", F.size(found).alias("n_found"), total.alias("total"), F.array_join(F.transform(found, lambda x: x["role"]), " ").alias("roles"))


@query(f"""with {PRICED} select id, coalesce(price_qualifier in ('exact', 'approx') and price_confidence >= 0.6, false) as comparable, (900000000 + c) % 1000 <> 0 as phone, id % 2 = 0 as grounded from priced""")
def price_checks(spark, d):
    """The peers' gate, nine digits that may be a phone number, and whether a price that is told (or one million more) stands in the text."""
    rows = _priced(spark, d)
    told = F.when(F.col("id") % 2 == 0, F.col("n")).otherwise(F.col("n") + 1) * 1_000_000.0
    return rows.select("id", P.comparable(F.col("price_qualifier"), F.col("price_confidence")).alias("comparable"), P.phone_shaped((900_000_000 + F.col("c")).cast("string")).alias("phone"), P.grounded(fill("giá {n} triệu"), told).alias("grounded"))


@query(f"with {LISTINGS} select id, ['sell', 'buy', 'buy', 'other', 'sell', 'buy', 'other', 'sell'][form % 8 + 1] as intent, cast([0.9, 0.9, 0.55, 0.5, 0.9, 0.9, 0.5, 0.9][form % 8 + 1] as double) as confidence from listings")
def intent_detect(spark, d):
    text = written("cần bán máy số {n}", "can mua máy số {n}", "mua máy số {n}", "người mua máy số {n} xem", "thanh ly máy {n}", "wtb máy {n}", "máy số {n}", "ai cần mua máy {n} ib, cần bán")
    return listings(spark, d).select("id", T.intent(text).alias("i")).select("id", "i.*")


@query(f"with {LISTINGS} select id, ['broken', 'new', 'like_new', 'used', 'unknown', 'broken'][form % 6 + 1] as condition from listings")
def condition_detect(spark, d):
    return listings(spark, d).select("id", T.condition(written("máy {n} hỏng", "hàng fullbox {n}", "đồ {n} như mới", "xe cu {n}", "máy {n} đẹp", "máy {n} mới tinh nhưng lỗi")).alias("condition"))


CONTACTS = ("gọi 0912 345 {x} nhé", "mail u{c}@mail.example.com nhé", "https://zalo.me/0912{x}", "zalo: 912345{x}", "giá {n}.500.000đ", "+84 912.345.{x} ok")


@query(f"with {LISTINGS} select id, case form % 6 when 0 then 'gọi [SĐT ẩn] nhé' when 1 then 'mail [email ẩn] nhé' when 2 then '[link ẩn]' when 3 then 'zalo: [SĐT ẩn]' when 4 then 'giá ' || n || '.500.000đ' else '[SĐT ẩn] ok' end as masked from listings")
def pii_masked(spark, d):
    return listings(spark, d).select("id", T.mask(written(*CONTACTS)).alias("masked"))


@query(f"with {LISTINGS} select id, case when form % 6 in (0, 5) then '0912345' || x end as phone, case when form % 6 in (0, 5) then '0912 ••• ' || x[2:3] end as shown from listings")
def phone_detect(spark, d):
    phone = T.first_phone(written(*CONTACTS))
    return listings(spark, d).select("id", phone.alias("phone"), T.mask_phone(phone).alias("shown"))


LONG = "repeat('x', cast(20 + n % 100 as integer))"


@query(f"""with {LISTINGS}, t as (select id, d, case when form % 2 = 0 then 'Tin ' || id || ' · ' || {LONG} else {LONG} end as joined, length({LONG}) as own, form from listings)
select id, case when form % 2 = 0 then left(joined, 80) when own < 40 then joined || ' · rest ' || d else left(joined, 80) end as title,
  case when form % 2 = 0 then case when length(joined) > 80 then substr(joined, 81) || chr(10) else '' end || case when contains(joined, 'rest') then '' else 'rest ' || d end
       when own < 40 then '' else case when own > 80 then substr(joined, 81) || chr(10) else '' end || 'rest ' || d end as rest
from (select id, d, form, own, case when form % 2 = 0 and length(joined) < 40 then joined || ' · rest ' || d else joined end as joined from t)""")
def title_split(spark, d):
    """Titles from first lines that are too short, long enough or too long."""
    long = F.repeat(F.lit("x"), (20 + F.col("n") % 100).cast("int"))
    text = F.when(F.col("form") % 2 == 0, F.concat(fill("Tin {id}\n"), long)).otherwise(long)
    split = T.split_title(F.concat(text, fill("\nrest {d}")))
    return listings(spark, d).select("id", split["title"].alias("title"), split["rest"].alias("rest"))


@query(f"with {LISTINGS} select id, case form % 4 when 0 then 'xe ' || n || ' đẹp' when 1 then 'ok ' || n when 2 then 'a ' || n || ' b' else '' end as shown from listings")
def comparable_text(spark, d):
    return listings(spark, d).select("id", T.comparable(written("  Xe {n} 🚗 ĐẸP​ ", "✅ OK {n} ©", "A\t{n}\n\n B", " \n ")).alias("shown"))


@query(f"with {LISTINGS} select id, case form % 3 when 0 then 'call [SĐT ẩn] now ' || n when 1 then case when length({LONG}) + 40 > 120 then left({LONG} || repeat('y', 40), 119) || '…' else {LONG} || repeat('y', 40) end end as shown from listings")
def snippet_masked(spark, d):
    long = F.concat(F.repeat(F.lit("x"), (20 + F.col("n") % 100).cast("int")), F.lit("y" * 40))
    text = F.when(F.col("form") % 3 == 0, fill("\n  call 0912345{x} now {n}\nmore")).when(F.col("form") % 3 == 1, long).otherwise(F.lit(" \n\t"))
    shown = T.snippet(text, masked=True)
    return listings(spark, d).select("id", shown.alias("shown"))


@query(f"with {LISTINGS} select id, case form % 3 when 0 then 'A' || n || ' & B' || chr(10) || 'c' || chr(10) || 'd' || chr(10) || chr(cast(65 + d as integer)) when 1 then 'x' || n || chr(10) || 'y' else n || ' <b> ...' end as shown from listings")
def feed_html_text(spark, d):
    html = F.when(F.col("form") % 3 == 0, F.concat(fill("<p>A{n} &amp; B</p><p>c<br>d</p><script>x</script>&#"), (65 + F.col("d")).cast("string"), F.lit(";"))).when(F.col("form") % 3 == 1, fill("<ul><li>x{n}</li><li>y</li></ul><!-- z -->")).otherwise(fill("{n} &lt;b&gt; &hellip;"))
    return listings(spark, d).select("id", T.html_text(html).alias("shown"))


SHORT = lambda x: f"regexp_replace(printf('%.1f', {x}), '\\.0$', '')"


@query(f"""with {LISTINGS}, a as (select id, v * pow(10, d % 5) as amount, (n % 41 - 20) + 0.4 as pct from listings)
select id, case when amount >= 1e9 then {SHORT('floor(amount / 1e8 + 0.5) / 10')} || 'B' when amount >= 1e7 then cast(cast(floor(amount / 1e6 + 0.5) as bigint) as varchar) || 'M' when amount >= 1e6 then {SHORT('floor(amount / 1e5 + 0.5) / 10')} || 'M' else cast(cast(floor(amount / 1e3 + 0.5) as bigint) as varchar) || 'k' end as price,
  replace(format('{{:,}}', cast(floor(amount + 0.5) as bigint)), ',', '.') || ' km' as km, case when floor(abs(pct) + 0.5) = 0 then '≈ avg' else case when pct < 0 then '▼' else '▲' end || cast(floor(abs(pct) + 0.5) as bigint) || '% vs avg' end as badge from a""")
def labels_formatted(spark, d):
    amount, pct = F.col("v") * F.pow(F.lit(10.0), F.col("d") % 5), (F.col("n") % 41 - 20) + 0.4
    return listings(spark, d).select("id", T.compact_price(amount).alias("price"), T.kilometres(amount).alias("km"), T.deal_badge(pct).alias("badge"))


@query(f"""with {LISTINGS}, a as (select id, case form % 3 when 0 then 'id:u' || c when 1 then 'name:ann ' || c else '' end as author, n from listings)
select id, author, case when author <> '' then 'Member #' || substr(sha256('s' || chr(31) || author), 1, 8) end as label, case when author <> '' then sha256(author || chr(31) || 'bán ' || n) end as repost from a""")
def author_keys(spark, d):
    """Author keys by id, else by name; their labels under a salt; keys of reposts."""
    rows = listings(spark, d)
    kind = F.col("form") % 3
    key = T.author_key(F.when(kind == 0, fill("u{c}")), F.when(kind < 2, fill("  Ann  {c} ")))
    return rows.select("id", key.alias("author"), T.author_label(T.pseudonym("s", key)).alias("label"), T.repost_key(key, fill(" BÁN  {n}")).alias("repost"))


@query(f"with {LISTINGS} select id, case form % 2 when 0 then 'red|red car|red car ' || n || '|car|car ' || n || '|car ' || n || ' b' || d || '|' || n || '|' || n || ' b' || d || '|b' || d else 'xe|xe ' || n || '|' || n end as found from listings")
def term_ngrams(spark, d):
    return K.with_terms(listings(spark, d).select("id", written("red car {n} b{d}", "bán xe {n} the https://x.com/{n} 09123456{x}").alias("text"))).select("id", F.array_join("terms", "|").alias("found"))


MAKES = "[('kia', 'Kia', 'morning', 'Morning'), ('toyota', 'Toyota', 'vios', 'Vios'), ('mercedes_benz', 'Mercedes Benz', 'c200', 'c200')]"


def _cars(rows: DataFrame) -> DataFrame:
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("c") % 3 + 1).cast("int"))
    return rows.withColumns({"make": pick("kia", "toyota", "mercedes_benz"), "model": pick("morning", "vios", "c200")})


@query(f"""with {LISTINGS}, m as (select id, form, y, ['Kia', 'Toyota', 'Mercedes Benz'][c % 3 + 1] as make, ['Morning', 'Vios', 'c200'][c % 3 + 1] as model from listings)
select id, case form % 2 when 0 then make || ' ' || model || ' ' || y || '|' || make || ' ' || model || '|' || make else 'AirPods' || '|' || make || ' ' || model || '|' || make end as found from m""")
def post_trend_terms(spark, d):
    """Trend terms of cars: of their attributes, or behind those that are given, of which names, contacts and idle words are left out."""
    rows = _cars(listings(spark, d))
    given = F.when(F.col("form") % 2 == 1, F.array(F.lit("AirPods"), F.lit("Nguyễn Văn A"), F.lit("giá rẻ"), F.lit("0912345678")))
    year = F.when(F.col("form") % 2 == 0, F.col("y").cast("string"))
    ready = rows.select("id", F.lit("").alias("text"), "make", "model", year.alias("year"), F.lit(None).cast("string").alias("item"), given.alias("given"), F.array(F.lit("x")).alias("authors"))
    return K.with_post_terms(ready, 5).select("id", F.array_join("trend_terms", "|").alias("found"))


#: Names of the catalogue that documents hold: (category, path, name), (item, category, name, aliases).
LEGAL = [("lic", "legal.licences", "License"), ("cop", "legal.copyright", "Copyright"), ("leg", "legal", "Legal notice")]
LEGAL_ITEMS = [("mit", "lic", "MIT License", ["mit licence"]), ("gpl", "lic", "General Public License", ["gpl"]), ("res", "cop", "All rights reserved", [])]
_HELD = lambda t: f"regexp_matches(low, '(^|[^\\pL\\pN])' || {t} || '([^\\pL\\pN]|$)')"
ALIAS_SQL = """a(term, category_id, item_id, rank) as (values ('license', 'lic', null, 0), ('lic', 'lic', null, 0), ('copyright', 'cop', null, 0), ('cop', 'cop', null, 0), ('legal notice', 'leg', null, 0), ('leg', 'leg', null, 0),
  ('mit license', 'lic', 'mit', 1), ('mit licence', 'lic', 'mit', 1), ('general public license', 'lic', 'gpl', 1), ('gpl', 'lic', 'gpl', 1), ('all rights reserved', 'cop', 'res', 1))"""
SQUEEZED = ", squeezed as (select id, trim(regexp_replace(low, '\\s+', ' ', 'g')) as low from folded)"
FOLDED = C.LINES.split("\nlines as")[0].rstrip(",") + SQUEEZED


def _legal(spark) -> DataFrame:
    categories = spark.createDataFrame([(c, p, c, n) for c, p, n in LEGAL], "category_id string, path string, slug string, name string")
    items = spark.createDataFrame([(*i, {}) for i in LEGAL_ITEMS], "item_id string, category_id string, name string, aliases array<string>, attributes map<string,string>")
    return E.alias_table(categories, items)


CLASSED = f""", {ALIAS_SQL}, h as (select id, a.* from squeezed join a on {_HELD('a.term')}),
b as (select id, min(struct_pack(n := -length(term), rank := rank, category_id := category_id, item := coalesce(item_id, ''))) as best, string_agg(distinct term, ',' order by term) as hits from h group by id)"""


@query(views(CORPUS) + FOLDED + CLASSED + """ select s.id, b.best.category_id as category_id, nullif(b.best.item, '') as item_id, coalesce(hits, '') as hits, cast(case when b.best.item <> '' then 0.9 when b.best.category_id is not null then 0.6 else 0 end as double) as confidence from squeezed s left join b using (id)""")
def classify_posts(spark, d):
    """Category and item of every document by the longest name that it holds."""
    return E.classify(B.corpus(spark, d), _legal(spark)).withColumn("hits", F.array_join("hits", ","))


@query(views(CORPUS) + FOLDED + CLASSED + f""" select id from b where best.category_id = 'lic' union select id from squeezed where {_HELD("'copyright'")} or {_HELD("'the'")}""")
def prefilter(spark, d):
    """Documents of a watched category, or with a watched term."""
    corpus = B.corpus(spark, d)
    ruled = E.classify(corpus, _legal(spark))
    return E.prefilter(ruled, corpus, spark.createDataFrame([("Copyright",), ("THE",)], "term string"), spark.createDataFrame([("lic",)], "category_id string"))


@query(views(CORPUS) + FOLDED + f", t(term) as (values ('the'), ('all rights'), ('rights reserved'), ('general public license version'), ('und'), ('http://')) select id, term from squeezed join t on {_HELD('t.term')} where term <> 'http://' union all select id, term from squeezed join t on contains(low, term) and term = 'http://' and regexp_matches(low, 'http://($|[^\\pL\\pN])')")
def dictionary_scan(spark, d):
    """Which terms of one to four words, and one that ends with a sign, each document holds."""
    terms = spark.createDataFrame([(t,) for t in ("the", "all rights", "rights reserved", "general public license version", "und", "http://")], "term string")
    return M.held_terms(B.corpus(spark, d), terms)


RULE_FORMS = ("bán iPhone 15 giá {n}tr like new", "cần mua laptops {d}x.000.000", "mua xe cu", "ip15 98765{x}1")


@query(f"""with {LISTINGS} select id, ['sell', 'buy', 'buy', 'other'][form % 4 + 1] as intent, ['like_new', 'unknown', 'used', 'unknown'][form % 4 + 1] as condition, cast(case form % 4 when 0 then n * 1e6 when 1 then d * 1e7 end as double) as price,
  case form % 4 when 0 then 'exact' when 1 then 'floor' end as price_qualifier, case when form % 4 in (0, 3) then 'i15' end as item_id, cast([0.9, 0.5, 0.0, 0.5][form % 4 + 1] as double) as confidence from listings""")
def run_rules(spark, d):
    from postmill.plans.enrich import _dims

    categories, items, *_ = _dims(spark)
    return E.run_rules(listings(spark, d).select("id", written(*RULE_FORMS).alias("text")), E.alias_table(categories, items)).select("id", "intent", "condition", "price", "price_qualifier", "item_id", "confidence")


COVERS = views(CORPUS) + C.SCORED.split("names as")[0].rstrip().rstrip(",") + " select id, round(coalesce(x, 0) / (coalesce(x, 0) + 1), 6) as score from found left join covers using (id)"


@query(COVERS)
def cover_density(spark, d):
    rows = C.search_index(spark, d).table("lines").where(S.line_predicate(S.parse("the license"), F.col("line")))
    return rows.select("id", F.round(S.cover_density(F.col("line"), ["the", "license"]), 6).alias("score"))


_WORDS = ", ".join(f"'{w}'" for w in sorted({*K.STOPWORDS_VI, *K.STOPWORDS_EN}))
DOCUMENT_TERMS = f"""low as (select doc_id as id, timestamp '2024-01-01' + to_hours(doc_id % 48) as ts, doc_id % 5 as category_id, regexp_replace(regexp_replace(lower(coalesce(text, '')), '(?:https?://|www\\.)\\S+', ' http ', 'g'), '[^\\pL\\pN\\n\\r]+', ' ', 'g') as x from documents),
found as (select id, ts, category_id, regexp_extract_all(x, '(?:[\\r\\n]\\s*)?[\\pL\\pN]+') as t from low),
token as (select id, ts, category_id, unnest(t) as raw, generate_subscripts(t, 1) as pos from found),
word as (select *, regexp_replace(raw, '\\s+', '', 'g') as w, regexp_matches(raw, '^[\\r\\n]') as fresh from token),
marked as (select *, (length(w) >= 2 or regexp_matches(w, '^\\pN$')) and not regexp_matches(w, '^\\pN{{8,}}$|^(?:http|www)') and w not in ({_WORDS}) as kept from word),
run as (select *, sum(case when fresh or not kept then 1 else 0 end) over (partition by id order by pos rows unbounded preceding) as r from marked),
next as (select id, ts, category_id, w, lead(w) over v as w2, lead(w, 2) over v as w3 from run where kept window v as (partition by id, r order by pos)),
gram as (select id, ts, category_id, w as term from next union select id, ts, category_id, w || ' ' || w2 from next where w2 is not null union select id, ts, category_id, w || ' ' || w2 || ' ' || w3 from next where w3 is not null),
term as (select distinct id, ts, category_id, case when term = 'mit license' then 'mit' else term end as term from gram where length(term) between 2 and {K.MAX_TERM} and term <> 'license')"""


@query(f"with {DOCUMENT_TERMS} select ts, term, cast(null as bigint) as category_id, count(*) as n from term group by all having count(*) >= 4 union all select ts, term, category_id, count(*) from term group by all having count(*) >= 4")
def trend_hist_documents(spark, d):
    """Hourly counts of the 1- to 3-grams of documents, after merging and dropping by alias; terms of at least four posts."""
    rows = B.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.timestamp_add("HOUR", (F.col("doc_id") % 48).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("first_seen_at"), (F.col("doc_id") % 5).alias("category_id"))
    aliases = spark.createDataFrame([("mit license", "mit"), ("license", None)], "term string, into string")
    return text_terms.frequent_counts(rows, aliases, 4)
