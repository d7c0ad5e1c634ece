"""Trend terms of a post, as JVM expressions: 1- to 3-grams, entity-like 2- to 4-grams, attribute terms, and what is left after sanitising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import text as T

#: Fixed word lists and limits of the original.
STOPWORDS_VI = "và của có cho là các với được này không bán mua cần giá ạ nha nhé ib inbox lh liên hệ ở tại em anh chị mình bạn một những để thì mà".split()
STOPWORDS_EN = "the a an and or for of to in on is are with sale sell buy new at by it this that be from".split()
GENERIC = (
    "xe máy may xem chỉ chi đẹp dep bán mua cần can giá gia còn con mới moi cũ cu ib inbox zalo ship lh liên hệ sdt đt call gọi goi chính chủ chu full fullbox bao "
    "rẻ re tốt tot ok oke nhiều nhieu ít đủ du hàng hang sản phẩm pham cái cai chiếc đồ do dùng dung sử dụng tặng tang thanh lý ly pass send tìm tim thích thich hỏi "
    "hoi quan tâm tam nhận nhan trao đổi doi gấp gap ngay hôm nay mai tại chỗ cho xin cảm ơn on thanks hot sale like good best price contact call free đang dang vẫn "
    "van rất rat lắm lam luôn luon nữa nua thêm them hơn hon nhất nhat việc viec"
).split()
HONORIFICS = "anh chị em a c e bác cô chú mr ms".split()
SURNAMES = "nguyễn trần lê phạm hoàng huỳnh phan vũ võ đặng bùi đỗ hồ ngô dương lý đinh đoàn trịnh lâm lương quách diệp phùng".split()
WEAK_EN = ("for sale", "selling", "sell", "wanted", "buy", "price", "offer", "new", "used", "cheap", "contact", "pm", "dm", "obo", "shipping")
WEAK_VI = ("ban xe", "xe cu", "odo", "so tu dong", "so san", "can ban", "ban", "mua", "xe", "oto", "o to", "gia", "thanh ly", "pass", "lien he", "chinh chu", "zin", "full do", "bao test")
EXCLUDE_EN, EXCLUDE_VI = ("wtb", "want to buy", "looking to buy", "looking for"), ("thu mua", "cầm đồ", "cần mua", "tìm mua")
MAX_TERM, MAX_DISPLAY, MAX_RULE_TERMS = 64, 48, 30

URL = r"(?:https?://|www\.)\S+"


def preset_terms(preset: str, english: tuple[str, ...], vietnamese: tuple[str, ...], custom: tuple[str, ...] = ()) -> list[str]:
    """The terms of a preset (vi, none, anything else is en) and the custom ones, each once, in order."""
    return list(dict.fromkeys([*(vietnamese if preset == "vi" else () if preset == "none" else english), *custom]))


def _in(word: Column, words: list[str]) -> Column:
    return word.isin(sorted(set(words)))


def _kept(word: Column) -> Column:
    """Words that make terms: no single letter, no long number, no address, no stopword."""
    return ((F.length(word) >= 2) | word.rlike(r"^\p{N}$")) & ~word.rlike(r"^\p{N}{8,}$|^(?:http|www)") & ~_in(word, [*STOPWORDS_VI, *STOPWORDS_EN])


def runs(text: Column, mark_honorifics: bool = False) -> Column:
    """The runs of kept words of the whole text: a dropped word or a line break ends one. A run right after a dropped honorific starts with a caret if asked."""
    low = F.regexp_replace(F.lower(text), URL, " http ")
    words = F.regexp_extract_all(F.regexp_replace(low, r"[^\p{L}\p{N}\n\r]+", " "), F.lit(r"(?:[\r\n]\s*)?[\p{L}\p{N}]+"), F.lit(0))

    def shown(t: Column) -> Column:
        word = F.regexp_replace(t, r"\s+", "")
        dropped = F.when(_in(word, HONORIFICS), " | ^ ").otherwise(" | ") if mark_honorifics else F.lit(" | ")
        return F.concat(F.when(t.rlike(r"^[\r\n]"), " | ").otherwise(""), F.when(_kept(word), word).otherwise(dropped))

    parts = F.split(F.array_join(F.transform(words, shown), " "), r"\|")
    return F.filter(F.transform(parts, lambda p: F.filter(F.split(p, " "), lambda w: w != "")), lambda r: F.size(r) > 0)


def _grams(words: Column, low: int, high: int, make) -> Column:
    """make(start, n) for every n-gram of a run, by start, then length."""
    starts = F.when(F.size(words) >= low, F.sequence(F.lit(0), F.size(words) - low)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.size(words) - i)), lambda n: make(i, n))))


def term_ngrams(found: Column) -> Column:
    """The distinct 1- to 3-grams of runs, at most MAX_TERM long; a single one has two characters."""
    made = F.flatten(F.transform(found, lambda r: _grams(r, 1, 3, lambda i, n: F.array_join(F.slice(r, i + 1, n), " "))))
    return F.array_distinct(F.filter(made, lambda t: (F.length(t) <= MAX_TERM) & (F.length(t) >= 2)))


def trend_key(display: Column) -> Column:
    return T.compact(display)


def capitalise(word: Column) -> Column:
    return F.when(word.rlike("[0-9]"), word).otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 200)))


def first_by_key(displays: Column, keys: Column) -> Column:
    """Displays whose key no earlier one has."""
    return F.filter(displays, lambda d, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def entity_ngrams(found: Column) -> Column:
    """Of runs with honorifics marked the first MAX_RULE_TERMS 2- to 4-grams with meaningful words at both ends and without words of a probable person's name, capitalised, once per key."""

    def of_run(r: Column) -> Column:
        after = F.get(r, F.lit(0)) == "^"
        return T.once(F.filter(r, lambda w: w != "^"), lambda words: T.once(_named(words, after), lambda named: of_words(words, named)))

    def _named(words: Column, after: Column) -> Column:
        starts = F.concat(
            F.when(after, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")),
            F.filter(F.transform(words, lambda w, k: F.when(_in(w, HONORIFICS), k + 1).when(_in(w, SURNAMES) & (k + 1 < F.size(words)), k)), lambda k: k.isNotNull()),
        )
        return T.once(starts, lambda held: F.transform(words, lambda w, k: F.exists(held, lambda s: (k >= s) & (k < s + 3))))

    def of_words(words: Column, named: Column) -> Column:
        def make(i: Column, n: Column) -> Column:
            gram = F.slice(words, i + 1, n)
            first, last = F.get(gram, F.lit(0)), F.element_at(gram, -1)
            ok = ~_in(first, [*GENERIC, *HONORIFICS]) & ~_in(last, GENERIC) & ~F.exists(F.slice(named, i + 1, n), lambda x: x) & F.exists(gram, lambda w: w.rlike(r"\p{L}"))
            return F.when(ok, F.array_join(F.transform(gram, capitalise), " "))

        return F.array_compact(_grams(words, 2, 4, make))

    return F.flatten(F.transform(found, of_run))


def title_case(raw: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(raw, r"[\s_]+"), lambda w: w != ""), capitalise), " ")


def attribute_terms(make: Column, model: Column, year: Column, item: Column) -> Column:
    """The item's name, "Make Model Year", "Make Model" and "Make", as far as known."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    car = F.struct(title_case(some(make)).alias("a"), title_case(some(model)).alias("b"), F.when(year.rlike(r"^\d{4}$"), year).alias("y"))
    return T.once(car, lambda v: F.array_compact(F.array(some(item), F.concat(v["a"], F.lit(" "), v["b"], F.lit(" "), v["y"]), F.concat(v["a"], F.lit(" "), v["b"]), v["a"])))


def person_name(display: Column) -> Column:
    """Whether two to four capitalised words begin with a common surname."""
    named = lambda words: F.size(words).between(2, 4) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}\p{L}*$")) & _in(F.lower(F.get(words, F.lit(0))), SURNAMES)
    return T.once(F.split(F.trim(display), r"\s+"), named)


def with_terms(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds terms: the 1- to 3-grams. Null or empty texts have none."""
    held = df.withColumn("_low", T.compose(F.coalesce(F.col(text), F.lit("")))).withColumn("_runs", runs(F.col("_low")))
    return held.withColumn("terms", term_ngrams(F.col("_runs"))).drop("_low", "_runs")


def with_post_terms(df: DataFrame, most: int) -> DataFrame:
    """Adds trend_terms. df: text, make, model, year, item (strings), given, authors (arrays of strings); all may be null.

    The given terms come first (then attribute terms alone), else attribute terms and entity n-grams; sanitised, once per key,
    at most ``most``. Left out: long ones, names of persons and of the author, single words that are neither given nor the
    make, generic ones, contacts.
    """
    none = F.array().cast("array<string>")
    held = df.withColumn("_low", T.compose(F.coalesce(F.col("text"), F.lit("")))).withColumn("_runs", runs(F.col("_low"), True)).withColumn("_grams", entity_ngrams(F.col("_runs")))
    held = held.withColumn("_keys", F.transform("_grams", trend_key)).withColumn("_grams", F.slice(first_by_key(F.col("_grams"), F.col("_keys")), 1, MAX_RULE_TERMS))
    held = held.withColumn("_given", F.coalesce("given", none)).withColumn("_rule", attribute_terms(F.col("make"), F.col("model"), F.col("year"), F.col("item")))
    held = held.withColumn("_given_keys", F.transform("_given", trend_key)).withColumn("_author_keys", F.filter(F.transform(F.coalesce("authors", none), trend_key), lambda k: k != ""))
    held = held.withColumn("_make_key", trend_key(F.regexp_replace(F.trim("make"), "_", " "))).withColumn("_all", F.concat("_given", F.when(F.size("_given") > 0, F.col("_rule")).otherwise(F.concat("_rule", "_grams"))))
    held = held.withColumn("_all", F.transform("_all", T.squeeze))
    contact = "|".join(f"(?:{x})" for x in (T.SHORT_LINK, T.EMAIL, T.SPOKEN_PHONE, r"[0-9]{7,}"))
    # every contact has a digit, one of the words that a number begins with, an at sign or the link's host; most terms have none
    may_be = "(?i)[0-9@]|zalo|" + "|".join(w for d in "08" for w in T.DIGIT_WORDS[d])
    idle = [*GENERIC, *STOPWORDS_VI, *STOPWORDS_EN]

    def fits(display: Column) -> Column:
        seen = lambda low: F.struct(trend_key(display).alias("key"), F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("words"), T.same_length_fold(low).alias("plain"))
        return (F.length(display) <= MAX_DISPLAY) & T.once(T.once(F.lower(display), seen), lambda s: fit(display, s["key"], s["words"], s["plain"]))

    def fit(display: Column, key: Column, words: Column, plain: Column) -> Column:
        single = (F.size(words) == 1) & ~F.array_contains("_given_keys", key) & ~F.coalesce(key == F.col("_make_key"), F.lit(False))
        return (
            (key != "") & ~single & ~F.forall(words, lambda w: _in(w, idle)) & ~person_name(display) & ~(plain.rlike(may_be) & plain.rlike(contact))
            & ~((F.length(key) >= 4) & F.exists("_author_keys", lambda a: F.contains(a, key)))
        )

    held = held.withColumn("_kept", F.filter("_all", fits)).withColumn("_keys", F.transform("_kept", trend_key))
    return held.withColumn("trend_terms", F.slice(first_by_key(F.col("_kept"), F.col("_keys")), 1, most)).select(*df.columns, "trend_terms")
