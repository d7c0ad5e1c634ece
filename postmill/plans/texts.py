"""Text functions on examples with known answers, and two queries over whole tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from postmill.functions import price as P
from postmill.functions import terms as K
from postmill.functions import text as T
from postmill.plans.catalog import query
from postmill.sources import bridge as B


#: Examples with known answers, which tests run: name to the function, its rows and the columns of both.
EXAMPLES: dict[str, tuple] = {}


def golden(name: str, given: str, answer: str, rows: list[tuple[tuple, tuple]]):
    """Keeps f(df) with examples. given and answer are schemas; rows pair inputs with answers. No query: it reads no table."""

    def register(f):
        EXAMPLES[name] = (f, f"id bigint, {given}", f"id bigint, {answer}", rows)
        return f

    return register


def _text(*rows: tuple) -> list[tuple[tuple, tuple]]:
    return [((r[0],), r[1:]) for r in rows]


def _one(name: str, answer: str, rows: list[tuple], make) -> None:
    golden(name, "text string", answer, _text(*rows))(lambda df: df.select("id", make(F.col("text")).alias(answer.split(" ")[0])))


PRICES = [
    ("ban 15tr", 15e6, "exact", 0.9), ("gia 15tr5", 15.5e6, "exact", 0.9), ("15.500.000đ", 15.5e6, "exact", 0.7), ("1k5 tien ship", 1500.0, "exact", 0.7), ("10-12tr", 10e6, "range", 0.6), ("600k đến 800k", 600e3, "range", 0.6),
    ("giá tốt", None, None, 0.0), ("8>10m", None, None, 0.0), ("12tr8", 12.8e6, "exact", 0.7), ("26 triệu 5", 26.5e6, "exact", 0.7), ("iphone 16 Pro Max 19tr500", 19.5e6, "exact", 0.7), ("máy đẹp giá 5x.000.000", 50e6, "floor", 0.5),
    ("ban macbook air hon 20 trieu", 20e6, "floor", 0.5), ("giá 1 tỷ 1xx triệu", 1.1e9, "range", 0.5), ("1 tỷ 2", 1.2e9, "exact", 0.7), ("1,2 tỷ", 1.2e9, "exact", 0.7), ("1ty250", 1.25e9, "exact", 0.7), ("1 tỷ 200tr", 1.2e9, "exact", 0.7),
    ("Mazda 3 - 550tr", 550e6, "exact", 0.7), ("90-950k", 90e3, "range", 0.6), ("trả trước 50tr, bán 390tr", 390e6, "exact", 0.9), ("185 củ", 185e6, "exact", 0.7), ("khoảng 9,5 củ", 9.5e6, "approx", 0.6), ("dưới 300tr", 300e6, "ceiling", 0.5),
    ("lh 0912 345 678", None, None, 0.0), ("zalo 987654321", None, None, 0.0), ("đặt cọc 5tr", None, None, 0.0), ("gia 5xtr", 50e6, "floor", 0.5), ("20 trieu tro len", 20e6, "floor", 0.5), ("gia 7000000", 7e6, "exact", 0.9), ("xe 2016", None, None, 0.0),
    ("iphone pro max 20tr", 20e6, "exact", 0.7), ("toi da 20tr", 20e6, "ceiling", 0.5), (None, None, None, 0.0), ("", None, None, 0.0),
]


@golden("price_parse", "text string", "price double, price_qualifier string, price_confidence double", _text(*PRICES))
def _price_parse(df):
    return P.with_prices(df)


@golden("price_candidates", "text string", "found string", _text(("bán 390tr, trả trước 50tr, góp 5tr", "390tr:asking 50tr:excluded 5tr:excluded"), ("10-12tr hoặc 1 tỷ 2", "10-12tr:neutral 1 ty 2:neutral"), ("không", "")))
def _price_candidates(df):
    return P.with_prices(df).withColumn("found", F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["raw"], c["role"])), " "))


@golden("price_checks", "raw string, qualifier string, confidence double, price double", "comparable boolean, phone boolean, grounded boolean", [(("987654321", "exact", 0.7, 987654321.0), (True, True, True)), (("987.654.000", "floor", 0.9, 987654000.0), (False, False, True)), (("19tr5", "approx", 0.6, 19500000.0), (True, False, True)), (("230tr", "exact", 0.5, 231000000.0), (False, False, False))])
def _price_checks(df):
    return df.select("id", P.comparable(F.col("qualifier"), F.col("confidence")).alias("comparable"), P.phone_shaped(F.col("raw")).alias("phone"), P.grounded(F.col("raw"), F.col("price")).alias("grounded"))


INTENTS = [("cần bán Kia, ai cần mua ib", "sell", 0.9), ("can mua iphone", "buy", 0.9), ("wtb macbook", "buy", 0.9), ("wts macbook", "sell", 0.9), ("mua xe cũ", "buy", 0.55), ("người mua xem hàng", "other", 0.5), ("ra đi con xe", "sell", 0.9), ("cho e ban cai nay", "sell", 0.9), ("hoi mua oto, ban gap", "buy", 0.9), ("xin chào", "other", 0.5), ("thanh ly ban ghe", "sell", 0.9), ("want to buy or for sale", "buy", 0.9), ("", "other", 0.5)]


@golden("intent_detect", "text string", "intent string, confidence double", _text(*INTENTS))
def _intent(df):
    return df.select("id", T.intent(F.col("text")).alias("i")).select("id", "i.*")


_one("condition_detect", "condition string", [("máy hỏng", "broken"), ("bi loi man", "broken"), ("xac iphone", "broken"), ("hàng fullbox", "new"), ("nguyên seal", "new"), ("brand new", "new"), ("like new", "like_new"), ("nhu moi 90", "like_new"), ("đồ second hand", "used"), ("qua tay roi", "used"), ("xe cu", "used"), ("đẹp", "unknown"), ("moi tinh nhung hong", "broken"), ("mới 99%x", "like_new")], T.condition)
_one("pii_masked", "masked string", [("gọi 0912 345 678 nhé", "gọi [SĐT ẩn] nhé"), ("+84 912.345.678", "[SĐT ẩn]"), ("khong chin mot hai ba bon nam sau bay tam", "[SĐT ẩn]"), ("không 9 1 2 3 4 5 6 7 8", "[SĐT ẩn]"), ("091o345678", "[SĐT ẩn]"), ("٠٩١٢٣٤٥٦٧٨", "[SĐT ẩn]"), ("a.b+c@mail.example.com", "[email ẩn]"), ("https://zalo.me/0912", "[link ẩn]"), ("zalo: 912345678", "zalo: [SĐT ẩn]"), ("giá 15.500.000đ", "giá 15.500.000đ"), ("call 09123…", "call 09123…"), ("call 0912345…", "call [SĐT ẩn]…"), ("nam 2016", "nam 2016"), ("02812345678", "[SĐT ẩn]"), ("", "")], T.mask)
_one("phone_detect", "phone string", [("gọi 0912 345 678", "0912345678"), ("+84 912.345.678", "0912345678"), ("0112345678 rồi 0987654321", "0987654321"), ("không có", None)], T.first_phone)
_one("title_split", "shown string", [("one\n\ntwo", "one · two|"), ("x" * 50 + "\nrest", "x" * 50 + "|rest"), ("a\n" + "b" * 90 + "\nc", "a · " + "b" * 76 + "|" + "b" * 14 + "\nc"), ("", "|"), (" a \r\n b ", "a · b|")], lambda c: F.concat_ws("|", T.split_title(c)["title"], T.split_title(c)["rest"]))
_one("comparable_text", "shown string", [("  Xe ĐẸP 🚗👍🏽  lắm​ ", "xe đẹp lắm"), ("á ệ", "á ệ"), ("✅ ok ©", "ok"), ("🇻🇳 vn", "vn"), ("", "")], T.comparable)
_one("snippet_masked", "shown string", [("\n  call 0912345678 now", "call [SĐT ẩn] now"), ("x" * 121, "x" * 119 + "…"), ("x" * 113 + " 0912345678", "x" * 113 + " [SĐT …"), ("   ", None), (None, None)], lambda c: T.snippet(c, masked=True))
_one("feed_html_text", "shown string", [("<p>A &amp; B</p><p>c<br>d</p><script>x</script>", "A & B\nc\nd"), ("&#65;&#x42;&#38;lt; &hellip; &amp;lt;", "AB&lt; ... &lt;"), ("a<!-- b -->c", "a c"), ("<ul><li>x</li><li>y</li></ul>", "x\ny"), ("a\n\n\n\nb", "a\n\nb"), ("&#0;&#xD800;x &unknown;", "x &unknown;")], T.html_text)


@golden("labels_formatted", "n double, pct double", "price string, km string, badge string", [((1.25e9, -10.4), ("1.3B", "1.250.000.000 km", "▼10% vs avg")), ((9.56e6, 0.4), ("9.6M", "9.560.000 km", "≈ avg")), ((19_500_000.0, 12.0), ("20M", "19.500.000 km", "▲12% vs avg")), ((650_000.0, None), ("650k", "650.000 km", None)), ((9e6, -0.5), ("9M", "9.000.000 km", "▼1% vs avg"))])
def _labels(df):
    return df.select("id", T.compact_price(F.col("n")).alias("price"), T.kilometres(F.col("n")).alias("km"), T.deal_badge(F.col("pct")).alias("badge"))


@golden("author_keys", "author_id string, author_name string, text string", "author string, label string, has_repost boolean", [(("u1", "X", "Hi"), ("id:u1", None, True)), ((None, "  Ann  LEE ", "Hi"), ("name:ann lee", None, True)), ((None, None, "Hi"), ("", None, False)), (("u1", None, " "), ("id:u1", None, False))])
def _authors(df):
    key = T.author_key(F.col("author_id"), F.col("author_name"))
    return df.select("id", key.alias("author"), F.when(T.author_label(T.pseudonym("s", key)).rlike("^Member #[0-9a-f]{8}$"), F.lit(None).cast("string")).when(key == "", F.lit(None).cast("string")).otherwise("bad").alias("label"), T.repost_key(key, F.col("text")).isNotNull().alias("has_repost"))


@golden("term_ngrams", "text string", "found string", _text(("https://x.com/abc 0912345678 iphone", "iphone"), ("airpods pro 2", "airpods|airpods pro|airpods pro 2|pro|pro 2"), ("red car\nblue", "red|red car|car|blue"), ("bán xe đẹp", "xe|xe đẹp|đẹp"), ("the a", ""), (None, "")))
def _terms(df):
    return K.with_terms(df).withColumn("found", F.array_join("terms", "|"))


POST_TERMS = [
    (("Bán AirPods Pro 2 gen", None, None, None, None, None), ("Airpods Pro|Airpods Pro 2|Airpods Pro 2 Gen|Pro 2|Pro 2 Gen",)),
    (("xe", "mercedes_benz", "c200", "2016", None, None), ("Mercedes Benz c200 2016|Mercedes Benz c200|Mercedes Benz",)),
    (("Anh Nguyễn Văn Nam", None, None, None, None, None), ("",)),
    (("x", None, None, None, "iPhone 15 Pro", "AirPods,Nguyễn Văn A,giá rẻ,0912345678"), ("AirPods|iPhone 15 Pro",)),
    (("x", "Kia", None, None, None, "Kia Morning shop"), ("Kia",)),
    ((None, None, None, None, None, None), ("",)),
]


@golden("post_trend_terms", "text string, make string, model string, year string, item string, given_csv string", "found string", POST_TERMS)
def _post_terms(df):
    ready = df.withColumn("given", F.split("given_csv", ",")).withColumn("authors", F.array(F.lit("Kia Morning shop")))
    return K.with_post_terms(ready, 5).withColumn("found", F.array_join("trend_terms", "|"))


HTML = """select page_id, regexp_replace(regexp_replace(list_aggregate(list_transform(string_split(t, chr(10)), lambda s: regexp_replace(regexp_replace(s, '[ \\t' || chr(160) || ']+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), 'string_agg', chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') as text
from (select page_id, replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?i)<\\s*br\\s*/?>', chr(10), 'g'),
  '(?i)</\\s*(?:p|div|li|h[1-6]|tr|blockquote|ul|ol)\\s*>', chr(10), 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '(c)'), '&amp;', '&') as t from pages)"""


@query(HTML)
def html_to_text(spark, d):
    return B.table(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query("select doc_id, text = regexp_replace(text, '[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+', '', 'g') as no_mail from documents where text is not null")
def mail_found(spark, d):
    return B.table(spark, d, "documents").where("text is not null").select("doc_id", (~F.col("text").rlike(T.EMAIL)).alias("no_mail"))


