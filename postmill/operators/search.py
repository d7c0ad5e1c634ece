"""Corpus search: the query grammar, its predicate over folded text, ranking and pages."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import text as T

MAX_TOKENS = 10
#: Fixed: how recency weighs in the rank, and the days over which it fades.
RECENCY_WEIGHT, RECENCY_DAYS = 0.5, 7


@dataclass
class Query:
    terms: list[str] = field(default_factory=list)
    phrases: list[list[str]] = field(default_factory=list)
    without: list[list[str]] = field(default_factory=list)


def fold_py(s: str) -> str:
    a, b = T._fold_table()
    return re.sub("[\u0300-\u036f]", "", " ".join(s.lower().split()).translate(str.maketrans(a, b)))


def parse(q: str) -> Query:
    """Terms, "phrases" and -exclusions, at most MAX_TOKENS. Words of one or two letters side by side are a phrase; a single letter alone goes."""
    out, short = Query(), []

    def close() -> None:
        if len(short) > 1:
            out.phrases.append(list(short))
        elif short and len(short[0]) > 1:
            out.terms.append(short[0])
        short.clear()

    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', q)[:MAX_TOKENS]:
        words = re.findall("[a-z0-9]+", fold_py(phrase or word))
        if not words:
            continue
        if minus:
            out.without.append(words)
        elif phrase or len(words) > 1:
            close()
            out.phrases.append(words)
        elif len(words[0]) <= 2:
            short.append(words[0])
        else:
            close()
            out.terms.append(words[0])
    close()
    return out


def _phrase(line: Column, words: list[str]) -> Column:
    return F.contains(line, F.lit(f" {' '.join(words)} "))


def _term(line: Column, packed: Column, word: str) -> Column:
    """A word that begins with the term (equals it, if short), or the term anywhere in the compact text; short numbers only as words."""
    whole = len(word) <= 2 or (word.isdigit() and len(word) < 4)
    found = F.contains(line, F.lit(f" {word} " if whole else f" {word}"))
    anywhere = len(word) >= 3 and (not word.isdigit() or 9 <= len(word) <= 11)
    return found | F.contains(packed, F.lit(word)) if anywhere else found


def line_predicate(q: Query, line: Column) -> Column:
    """The query on a line of folded words with blanks around; an unknown line fails every term and passes every exclusion."""
    packed = F.replace(line, F.lit(" "), F.lit(""))
    parts = [_term(line, packed, t) for t in q.terms] + [_phrase(line, p) for p in q.phrases] + [~F.coalesce(_phrase(line, w), F.lit(False)) for w in q.without]
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def predicate(q: Query, text: str = "text") -> Column:
    """The query on a text. The text is folded once, as the variable of a lambda, however many terms look at it."""
    return F.exists(F.array(T.word_line(F.coalesce(F.col(text), F.lit("")))), lambda line: line_predicate(q, line))


def indexed(corpus: DataFrame, text: str = "text") -> DataFrame:
    """The corpus with word_line, as it is stored once for many searches: line_predicate and cover_density then read it as it is."""
    return corpus.withColumn("word_line", T.word_line(F.coalesce(F.col(text), F.lit(""))))


def cover_density(line: Column, names: list[str]) -> Column:
    """How densely the terms stand together in a line: over all shortest stretches of words that hold every term, 0.1 over one and the other words in it; the sum as x / (x + 1).

    Terms are beginnings of words (whole words if of one or two letters). The line is cut before each hit, so only hits are folded over.
    """
    if not names:
        return F.lit(0.0)
    shape = lambda n: f" {n}(?= )" if len(n) <= 2 else f" {n}"
    parts = F.split(line, "(?=" + "|".join(map(shape, names)) + ")", -1)
    # of each part that begins with a hit: how many words it has, and which terms its first word is
    blanks = lambda p: F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit("")))
    hit = lambda p: F.filter(F.array(*[F.when(F.concat(p, F.lit(" ")).startswith(f" {n} ") if len(n) <= 2 else p.startswith(f" {n}"), F.lit(k)) for k, n in enumerate(names)]), lambda k: k.isNotNull())
    entries = F.filter(F.transform(parts, lambda p: F.struct(blanks(p).alias("n"), hit(p).alias("of"))), lambda e: F.size(e["of"]) > 0)
    start = F.struct(F.array_repeat(F.lit(-1), len(names)).alias("seen"), F.array_repeat(F.lit(-1), len(names)).alias("at"), F.lit(-1).alias("i"), F.lit(-1).alias("low"), F.lit(0).alias("here"), F.lit(0.0).alias("sum"))

    def step(a: Column, e: Column) -> Column:
        i, here = a["i"] + 1, a["here"]
        seen = F.transform(a["seen"], lambda x, k: F.when(F.array_contains(e["of"], k), i).otherwise(x))
        at = F.transform(a["at"], lambda x, k: F.when(F.array_contains(e["of"], k), here).otherwise(x))
        low, first = F.array_min(seen), F.array_min(at)
        noise = (here - first) - (i - low)
        new = (low >= 0) & (low > a["low"])
        return F.struct(seen.alias("seen"), at.alias("at"), i.alias("i"), F.when(new, low).otherwise(a["low"]).alias("low"), (here + e["n"]).alias("here"), (a["sum"] + F.when(new, 0.1 / (1 + noise)).otherwise(0.0)).alias("sum"))

    return F.aggregate(entries, start, step, lambda a: a["sum"] / (a["sum"] + 1))


def rank(q: Query, now: Column, line: Column, weight: float = RECENCY_WEIGHT, hours: float = 24 * RECENCY_DAYS) -> Column:
    """Cover density of a folded line, plus recency that fades by the age over ``hours``."""
    names = list(dict.fromkeys([*q.terms, *(w for p in q.phrases for w in p)]))
    age = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("effective_at").cast("timestamp"))) / 3600.0
    return F.round(cover_density(line, names) + weight * F.exp(-F.greatest(age, F.lit(0.0)) / hours), 6)


def headline(text: Column, names: list[str], most: int = 30) -> Column:
    """The stretch of at most ``most`` words that begins at the first hit with most hits behind it, HTML-escaped, hits marked; without hits the first words."""
    hit = lambda w: reduce(lambda a, b: a | b, [T.flat(w).rlike(rf"(?:^|[^a-z0-9]){n}") for n in names]) if names else F.lit(False)
    words = F.transform(F.filter(F.split(T.squeeze(text), " "), lambda w: w != ""), lambda w: F.struct(w.alias("w"), hit(w).alias("hit")))

    def shown(held: Column) -> Column:
        scored = F.transform(held, lambda e, i: F.struct(F.size(F.filter(F.slice(held, i + 1, most), lambda x: x["hit"])).alias("n"), (-i).alias("i"), e["hit"].alias("hit")))
        best = F.array_max(F.filter(scored, lambda s: s["hit"]))
        part = F.slice(held, F.coalesce(-best["i"], F.lit(0)) + 1, most)
        return F.array_join(F.transform(part, lambda e: F.when(e["hit"], F.concat(F.lit("<mark>"), T.escape_html(e["w"]), F.lit("</mark>"))).otherwise(T.escape_html(e["w"]))), " ")

    return F.get(F.transform(F.array(words), shown), F.lit(0))


def search(corpus: DataFrame, q: str, now: Column, size: int = 25, candidates: int | None = None) -> DataFrame:
    """The best of all hits, or of the newest ``candidates`` if so many are asked for: top-k passes, no full sort."""
    got = parse(q)
    found = corpus.where(predicate(got))
    if candidates is not None:
        found = found.orderBy(F.desc("effective_at"), F.desc("id")).limit(candidates)
    return found.withColumn("rank", rank(got, now, T.word_line(F.coalesce("text", F.lit(""))))).select("id", "effective_at", "rank", T.snippet(F.col("text")).alias("snippet")).orderBy(F.desc("rank"), F.desc("effective_at"), F.desc("id")).limit(size)


@dataclass
class Params:
    """What a search is narrowed by; None or empty: not at all. from_at is included, to_at not."""

    q: str = ""
    source_ids: list = field(default_factory=list)
    category_paths: list[str] = field(default_factory=list)
    item_ids: list = field(default_factory=list)
    intents: list[str] = field(default_factory=list)
    price_min: float | None = None
    price_max: float | None = None
    from_at: object = None
    to_at: object = None
    author: str | None = None
    sort: str = "relevance"


def narrow(posts: DataFrame, sources: DataFrame, team, params: Params, categories: DataFrame | None = None, salt: str = "") -> DataFrame:
    """The team's posts under all of the params. posts carry their enrichment, whose columns are null where there is none.

    A search by category, item, intent or price finds enriched posts only; a sort by price those with one. An author is named
    by the pseudonym of their key under the salt; nobody else's posts match.
    """
    rows = posts.join(sources.where(F.col("team") == team).select("source_id"), "source_id", "left_semi")
    rows = rows.where(predicate(parse(params.q))) if params.q else rows
    among = [("source_id", params.source_ids), ("item_id", params.item_ids), ("intent", params.intents)]
    for name, values in among:
        rows = rows.where(F.col(name).isin(values)) if values else rows
    for name, low, high in (("price", params.price_min, params.price_max),):
        rows = rows.where(F.col(name) >= low) if low is not None else rows
        rows = rows.where(F.col(name) <= high) if high is not None else rows
    rows = rows.where(F.col("effective_at") >= F.lit(params.from_at)) if params.from_at is not None else rows
    rows = rows.where(F.col("effective_at") < F.lit(params.to_at)) if params.to_at is not None else rows
    if params.category_paths:
        below = reduce(lambda a, b: a | b, [(F.col("path") == p) | F.col("path").startswith(f"{p}.") for p in params.category_paths])
        rows = rows.join(categories.where(below).select("category_id"), "category_id", "left_semi")
    if params.author:
        rows = rows.where(T.pseudonym(salt, T.author_key(F.col("author_id").cast("string"), F.col("author_name"))) == params.author)
    return rows.where(F.col("price").isNotNull()) if params.sort in ("price_asc", "price_desc") else rows


def dashboard(rows: DataFrame, year: tuple = (None, None), odo: tuple = (None, None), region: str | None = None, price: tuple = (None, None), saved: bool | None = None) -> DataFrame:
    """Rows (attributes, price, saved) within bounds: attributes count as numbers only if they are numbers, the region without regard to case."""
    number = lambda k: F.try_element_at("attributes", F.lit(k)).try_cast("double")
    for c, (low, high) in ((number("year"), year), (number("odo_km"), odo), (F.col("price"), price)):
        rows = rows.where(c >= low) if low is not None else rows
        rows = rows.where(c <= high) if high is not None else rows
    rows = rows.where(F.lower(F.try_element_at("attributes", F.lit("region"))) == region.lower()) if region else rows
    return rows.where(F.col("saved") == saved) if saved is not None else rows


def feed(rows: DataFrame, matches: DataFrame, flags: DataFrame, make: str | None = None, hide_other: bool = False, matched: bool = False, saved: bool = False) -> DataFrame:
    """Rows of the feed: of a make, without the intent other, only those that a watch matched or that are saved."""
    rows = rows.where(F.lower(F.try_element_at("attributes", F.lit("make"))) == make.lower()) if make else rows
    rows = rows.where(F.coalesce(F.col("intent") != "other", F.lit(True))) if hide_other else rows
    for wanted, keys in ((matched, matches), (saved, flags)):
        rows = rows.join(keys.select(F.col("post_id").alias("id")).distinct(), "id", "left_semi") if wanted else rows
    return rows


def safe_regex(pattern: str) -> bool:
    """Whether a user's pattern can be run: short, compiles, no backreference, lookaround, nested quantifier or quantified alternation."""
    if len(pattern) > 200 or re.search(r"\\[1-9]|\\k<|\(\?[=!<]", pattern):
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    plain = re.sub(r"\\.|\[(?:\\.|[^\]])*\]", "x", pattern)
    depth: list[bool] = []
    for i, c in enumerate(plain):
        if c == "(":
            depth.append(False)
        elif c == ")" and depth:
            inner = depth.pop()
            if inner and i + 1 < len(plain) and plain[i + 1] in "*+{":
                return False
            if depth:
                depth[-1] = depth[-1] or inner
        elif c in "*+{|" and depth:
            depth[-1] = True
    return not depth
