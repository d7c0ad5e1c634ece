"""Stored queries against every post: an inverted index of terms finds what each text holds; terms, gates and the evidence rule decide.

Texts are read once: each becomes the few terms and patterns of watches that it holds. From there on only ids, terms and the
posts' short columns move, and posts meet watches by equal terms, or, for watches without any, by category or item.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.operators.search import safe_regex

#: Watches up to this number are broadcast, and their words are filtered by before texts are unfolded; the bound is checked by a count.
MAX_BROADCAST_WATCHES = 10_000
#: Patterns are tried on every text, so there may be only so many different ones.
MAX_PATTERNS = 1_000

FILTER = "struct<key:string,op:string,value:string,values:array<string>>"
#: Columns of a watch and of a post, and their types; those that a table lacks count as null.
WATCH = {"name": "string", "include": "array<string>", "include_all": "array<string>", "exclude": "array<string>", "regex": "string", "category_ids": "array<string>", "item_ids": "array<string>", "price_min": "double", "price_max": "double"} | {
    "attribute_filters": f"array<{FILTER}>",
    "intents": "array<string>",
    "source_ids": "array<string>",
    "muted_until": "timestamp_ntz",
}
POST = {"source_id": "string", "price": "double", "price_qualifier": "string", "price_max_value": "double", "intent": "string", "category_id": "string", "item_id": "string", "attributes": "map<string,string>", "enriched": "boolean", "source_region": "string"}


@dataclass
class Context:
    """What terms mean: weak ones prove nothing; an alias pins its item; hints tell the category that a watch implies.

    categories: (category_id, path); aliases: (alias, item_id); schemas: (category_id, key, kind, values); the dimensions are
    small tables. weak and hints (category id to terms) are configuration.
    """

    categories: DataFrame | None = None
    aliases: DataFrame | None = None
    schemas: DataFrame | None = None
    weak: tuple[str, ...] = ()
    hints: dict[str, tuple[str, ...]] = field(default_factory=dict)


def _filled(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({c: (F.col(c) if c in df.columns else F.lit(None)).cast(t) for c, t in columns.items()})


def _holds(term: Column, folded: Column) -> Column:
    """Whether a folded text has a folded term, with no letter or digit beside it. A blank term is nowhere."""
    return (term != "") & F.rlike(folded, _whole(term))


def _whole(term: Column) -> Column:
    escaped = F.regexp_replace(term, r"[^\p{L}\p{N} ]", r"\\$0")
    return F.concat(F.lit(r"(?<![\p{L}\p{N}])"), escaped, F.lit(r"(?![\p{L}\p{N}])"))


def descendants(ids: DataFrame, categories: DataFrame) -> DataFrame:
    """(owner, category_id): each owner's categories with all below them, by an equi-join on the paths' ancestors."""
    parts = F.split("path", r"\.")
    up = categories.select(F.col("category_id").alias("below"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("path"))
    return ids.join(categories, "category_id").select("owner", "path").join(up, "path").select("owner", F.col("below").alias("category_id")).distinct()


def implied_category(watch_terms: Column, hints: dict[str, tuple[str, ...]]) -> Column:
    """The category whose hint terms stand most often among folded terms (as a line with bars between); null if none or several do."""
    if not hints:
        return F.lit(None).cast("string")
    scores = F.array(*[F.struct(F.lit(c).alias("c"), sum((F.when(F.contains(watch_terms, F.lit(f" {t} ")), 1).otherwise(0) for t in terms if t), F.lit(0)).alias("n")) for c, terms in hints.items()])
    top = F.array_max(F.transform(scores, lambda s: s["n"]))
    best = F.filter(scores, lambda s: s["n"] == top)
    return F.when((top > 0) & (F.size(best) == 1), F.get(best, F.lit(0))["c"])


def compile_watches(watches: DataFrame, context: Context | None = None, now: Column | None = None) -> DataFrame:
    """Watches that can match: enabled, not muted at ``now``, with folded terms, the categories below theirs, the implied ones, attribute definitions and a checked pattern.

    A pattern that safe_regex refuses makes its watch match nothing, as does an attribute filter without definition. Left out
    are watches whose evidence could never hold: those without terms, pattern, category and item.
    """
    c = context or Context()
    folded = lambda a: F.array_distinct(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda t: F.coalesce(T.fold(t), F.lit(""))))
    ready = _filled(watches, WATCH)
    if "enabled" in watches.columns:
        ready = ready.where("enabled")
    if now is not None:
        ready = ready.where(F.col("muted_until").isNull() | (F.col("muted_until") <= now))
    ready = ready.withColumns({n: folded(F.col(n)) for n in ("include", "include_all", "exclude")})
    ready = ready.withColumns({n: F.array_distinct(F.coalesce(F.col(n), F.array().cast("array<string>"))) for n in ("category_ids", "item_ids", "source_ids", "intents")})
    ready = ready.withColumn("attribute_filters", F.coalesce("attribute_filters", F.array().cast(f"array<{FILTER}>")))
    terms, gates = (F.size("include") + F.size("include_all")) > 0, (F.size("category_ids") + F.size("item_ids")) > 0
    ready = ready.where(terms | gates | F.col("regex").isNotNull())
    if "regex" in watches.columns:
        refused = [r for r in patterns_of(ready) if not safe_regex(r)]
        ready = ready.where(F.col("regex").isNull() | ~F.col("regex").isin(refused)) if refused else ready
    line = F.concat(F.lit(" "), F.array_join(F.concat("include", "include_all", F.array(F.coalesce(T.fold(F.col("name")), F.lit("")))), " | "), F.lit(" "))
    ready = ready.withColumn("implied", F.when(F.size("category_ids") == 0, implied_category(line, c.hints)))
    none = F.array().cast("array<string>")
    if c.categories is not None:
        below = lambda name, ids: descendants(ready.select(F.col("watch_id").alias("owner"), F.explode(ids).alias("category_id")), c.categories).groupBy("owner").agg(F.collect_set("category_id").alias(name)).withColumnRenamed("owner", "watch_id")
        ready = ready.join(below("category_set", F.col("category_ids")), "watch_id", "left").join(below("implied_set", F.array_compact(F.array("implied"))), "watch_id", "left")
    else:
        ready = ready.withColumn("category_set", F.col("category_ids")).withColumn("implied_set", F.array_compact(F.array("implied")))
    ready = ready.withColumns({n: F.coalesce(F.col(n), none) for n in ("category_set", "implied_set")})
    defs = F.array().cast("array<struct<pos:int,kind:string,values:array<string>>>")
    if c.schemas is not None:
        filters = ready.select("watch_id", "category_ids", F.posexplode("attribute_filters").alias("pos", "f")).select("watch_id", "pos", "f.key", F.posexplode("category_ids").alias("rank", "category_id"))
        own = filters.join(c.schemas, ["category_id", "key"]).select("watch_id", "pos", "rank", "kind", "values")
        regions = c.schemas.where("key = 'region'").groupBy("key").agg(F.min_by(F.struct("kind", "values"), "category_id").alias("d"))
        fallback = ready.select("watch_id", F.posexplode("attribute_filters").alias("pos", "f")).select("watch_id", "pos", "f.key").join(regions, "key").select("watch_id", "pos", F.lit(1 << 30).alias("rank"), "d.kind", "d.values")
        first = own.unionByName(fallback).groupBy("watch_id", "pos").agg(F.min_by(F.struct("kind", "values"), "rank").alias("d"))
        held = first.groupBy("watch_id").agg(F.collect_list(F.struct("pos", F.col("d.kind").alias("kind"), F.col("d.values").alias("values"))).alias("defs"))
        ready = ready.join(held, "watch_id", "left").withColumn("defs", F.coalesce("defs", defs))
    else:
        ready = ready.withColumn("defs", defs)
    return ready.where(F.size("attribute_filters") == F.size("defs"))


def patterns_of(watches: DataFrame) -> list[str]:
    """The different patterns of watches, on the driver; more than MAX_PATTERNS raise."""
    found = sorted(r["regex"] for r in watches.where("regex is not null").select("regex").distinct().limit(MAX_PATTERNS + 1).collect())
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} different patterns")
    return found


def filter_holds(f: Column, kind: Column, values: Column, value: Column) -> Column:
    """Whether an attribute value satisfies a filter: eq, in, gte or lte, the last two by place among ordered values or as numbers. No value never does."""
    place = lambda v: F.nullif(F.array_position(values, v), F.lit(0)).cast("double")
    rank = lambda v: F.when(kind == "ordered", place(v)).when(kind == "number", v.try_cast("double"))
    by_op = F.when(f["op"] == "eq", f["value"] == value).when(f["op"] == "in", F.array_contains(f["values"], value)).when(f["op"] == "gte", rank(value) >= rank(f["value"])).when(f["op"] == "lte", rank(value) <= rank(f["value"]))
    return F.coalesce(by_op, F.lit(False))


def price_fits(low: Column, high: Column) -> Column:
    """Whether the post's price interval meets [low, high]: a floor is open below itself and has no end, a ceiling begins at 0, a range ends at its maximum."""
    price, q = F.col("price"), F.coalesce("price_qualifier", F.lit("exact"))
    end = F.when(q == "floor", float("inf")).when(q == "range", F.coalesce("price_max_value", price)).otherwise(price)
    start = F.when(q == "ceiling", 0.0).otherwise(price)
    lo, hi = F.greatest(start, F.coalesce(low, F.lit(0.0))), F.least(end, F.coalesce(high, F.lit(float("inf"))))
    return (lo < hi) | ((lo == hi) & ~((q == "floor") & (lo == start)))


def gates_hold() -> Column:
    """The gates of a watch on a post's enrichment; they all pass where a watch has none, and none passes on a post without enrichment."""
    value = lambda f: F.when(f["key"] == "region", F.coalesce(F.try_element_at("attributes", F.lit("region")), "source_region")).otherwise(F.try_element_at("attributes", f["key"]))
    priced = F.col("price_min").isNotNull() | F.col("price_max").isNotNull()
    attributes = F.forall("defs", lambda d: filter_holds(F.get("attribute_filters", d["pos"]), d["kind"], d["values"], value(F.get("attribute_filters", d["pos"]))))
    has = (F.size("category_ids") > 0) | (F.size("item_ids") > 0) | priced | (F.size("attribute_filters") > 0) | (F.size("intents") > 0)
    passes = (
        F.coalesce("enriched", F.lit(False))
        & ((F.size("category_ids") == 0) | F.array_contains("category_set", F.col("category_id")))
        & ((F.size("item_ids") == 0) | F.array_contains("item_ids", F.col("item_id")))
        & (~priced | price_fits(F.col("price_min"), F.col("price_max")))
        & attributes
        & ((F.size("intents") == 0) | F.array_contains("intents", F.col("intent")))
    )
    return (~has | F.coalesce(passes, F.lit(False))) & ((F.size("source_ids") == 0) | F.coalesce(F.array_contains("source_ids", F.col("source_id")), F.lit(False)))


#: A word of a folded text.
WORD = r"[\p{L}\p{N}]+"
TAIL = rf"[^\p{{L}}\p{{N}}]*{WORD}"


def is_small(dimension: DataFrame, bound: int = MAX_BROADCAST_WATCHES) -> bool:
    """Whether a table has at most ``bound`` rows; counting stops there."""
    return dimension.limit(bound + 1).count() <= bound


def held_terms(posts: DataFrame, terms: DataFrame, positions: bool = False) -> DataFrame:
    """(id, term): which folded terms each text holds with no letter or digit beside them; with ``positions`` also pos, the number of the word where the first one begins.

    A text is cut into words once. Its different words meet the terms of one word by equality, and so do its stretches of as many
    words as other terms have, with what stands between. If the terms are few (counted first), they are looked for within the
    row and only those that are held are unfolded; else words and stretches are joined with them. A term that begins or ends with
    no letter or digit is looked for by its pattern.
    """
    few = few_terms(terms)
    if few is not None:
        # a plain explode is filtered by the size of what is held, which is then made twice
        rows = with_held(posts.select("id", "text"), few, "text", positions).select("id", F.explode_outer("held").alias("h"))
        return rows.select("id", "h.term", "h.pos").where("term is not null") if positions else rows.select("id", F.col("h").alias("term")).where("term is not null")
    shaped = _shaped(terms)
    plain, odd = shaped.where("whole"), shaped.where("not whole")
    single, several = plain.where(F.size("w") == 1), plain.where(F.size("w") > 1)
    longest = several.agg(F.max(F.size("w"))).first()[0] or 0
    held = _checked([r["term"] for r in odd.limit(MAX_PATTERNS + 1).collect()])
    lines = posts.select("id", _folded(F.col("text")).alias("folded"))
    cut = lines.select("id", F.regexp_extract_all("folded", F.lit(WORD), F.lit(0)).alias("w"), *([F.regexp_extract_all("folded", F.lit(TAIL), F.lit(0)).alias("tail")] if longest else []))
    own = F.array_distinct("w")
    met = cut.select("id", F.explode(F.transform(own, lambda t: F.struct(t.alias("term"), F.array_position("w", t).cast("int").alias("pos"))) if positions else own).alias("g"))
    met = met.select("id", "g.term", "g.pos") if positions else met.withColumnRenamed("g", "term")
    met = met.join(single.select("term"), "term").select(*met.columns)
    if longest:
        at = F.when(F.size("w") > 0, F.sequence(F.lit(1), F.size("w"))).otherwise(F.array().cast("array<int>"))
        each = F.concat(*[_stretches(F.col("w"), F.col("tail"), at, m) for m in range(2, longest + 1)])
        long = cut.select("id", F.explode(each).alias("g")).select("id", "g.*").join(several.select("term"), "term").groupBy("id", "term").agg(F.min("pos").alias("pos"))
        met = met.unionByName(long.select(*met.columns))
    if held:
        found = lines.select("id", "folded", F.explode(_tried(held, F.col("folded"))).alias("term"))
        met = met.unionByName(found.select("id", "term", *([_place(F.col("term"), F.col("folded")).alias("pos")] if positions else [])))
    return met


def _shaped(terms: DataFrame) -> DataFrame:
    return terms.where("term <> ''").select("term", F.regexp_extract_all("term", F.lit(WORD), F.lit(0)).alias("w"), F.col("term").rlike(rf"^{WORD}(?:.*[\p{{L}}\p{{N}}])?$").alias("whole")).distinct()


def _checked(odd: list[str]) -> list[str]:
    if len(odd) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} terms that begin or end with no letter or digit")
    return odd


def few_terms(terms: DataFrame) -> list[Row] | None:
    """The terms with their words on the driver, or None if they are more than MAX_BROADCAST_WATCHES."""
    some = _shaped(terms).limit(MAX_BROADCAST_WATCHES + 1).collect()
    return some if len(some) <= MAX_BROADCAST_WATCHES else None


def with_held(df: DataFrame, terms: list[Row], text: str, positions: bool = False) -> DataFrame:
    """Adds held: the few_terms() that a text holds, each once; with ``positions`` structs of term and pos. Nothing is joined or shuffled."""
    whole, odd = [r for r in terms if r["whole"]], _checked([r["term"] for r in terms if not r["whole"]])
    one, more = [r["term"] for r in whole if len(r["w"]) == 1], [r for r in whole if len(r["w"]) > 1]
    listed = lambda found: F.array(*map(F.lit, sorted(set(found)))).cast("array<string>")
    placed = lambda found, place: F.transform(found, lambda t: F.struct(t.alias("term"), place(t).alias("pos")))
    hot, by_length = sorted({r["w"][0] for r in more}), {}
    for r in more:
        by_length.setdefault(len(r["w"]), []).append(r["term"])
    names = lambda f: F.transform(f, lambda s: s["term"])
    first = lambda f: T.once(names(f), lambda n: F.filter(f, lambda s, i: F.array_position(n, s["term"]) == i + 1)) if positions else F.array_distinct(names(f))

    def longer(line: Column, w: Column) -> Column:
        # the stretches from first words of longer terms; most texts hold none, and go no further
        at = F.filter(F.transform(w, lambda x, i: F.when(x.isin(hot), i + 1)), lambda i: i.isNotNull())
        of = lambda tail, places, m: F.filter(_stretches(w, tail, places, m), lambda s: s["term"].isin(by_length[m]))
        found = lambda tail, places: F.concat(*[of(tail, places, m) for m in sorted(by_length)])
        none = F.array().cast("array<struct<term:string,pos:int>>" if positions else "array<string>")
        return T.once(at, lambda p: F.when(F.size(p) > 0, T.once(T.once(F.regexp_extract_all(line, F.lit(TAIL), F.lit(0)), lambda tail: found(tail, p)), first)).otherwise(none))

    def looked(line: Column, w: Column) -> Column:
        own = F.array_intersect(w, listed(one))
        made = [placed(own, lambda t: F.array_position(w, t).cast("int")) if positions else own]
        made += [longer(line, w)] if more else []
        if odd:
            tried = _tried(odd, line)
            made.append(placed(tried, lambda t: _place(t, line).cast("int")) if positions else tried)
        return F.concat(*made)

    # line and words are variables of lambdas: as columns, a filter on what is held would make them again for every word
    return df.withColumn("held", T.once(_folded(F.col(text)), lambda line: T.once(F.regexp_extract_all(line, F.lit(WORD), F.lit(0)), lambda w: looked(line, w))))


def _folded(text: Column) -> Column:
    return F.coalesce(T.fold(text), F.lit(""))


def _tried(odd: list[str], folded: Column) -> Column:
    """Those of a few terms that a text holds, by their patterns."""
    return F.array_compact(F.array(*[F.when(F.contains(folded, F.lit(t)) & _holds(F.lit(t), folded), F.lit(t)) for t in odd]))


def _place(term: Column, folded: Column) -> Column:
    """The words before a term that is held, and so the number of the word that follows its begin."""
    before = folded.substr(F.lit(1), F.regexp_instr(folded, _whole(term)) - 1)
    return F.size(F.regexp_extract_all(before, F.lit(WORD), F.lit(0))) + 1


def _stretches(w: Column, tail: Column, at: Column, m: int) -> Column:
    """The stretches of m words that begin at the given words and lie within the text: the first word, then the next ones, each with what stands before it, end to end."""
    inside = F.filter(at, lambda i: i + (m - 1) <= F.size(w))
    return F.transform(inside, lambda i: F.struct(F.concat(F.get(w, i - 1), F.array_join(F.slice(tail, i + 1, m - 1), "")).alias("term"), i.alias("pos")))


def held_patterns(posts: DataFrame, patterns: list[str]) -> DataFrame:
    """(id, regex): which patterns each folded text matches, without regard to case."""
    folded = F.coalesce(T.fold(F.col("text")), F.lit(""))
    tried = [F.when(F.col("folded").rlike(f"(?iu){p}"), F.lit(p)) for p in patterns]
    return posts.select("id", folded.alias("folded")).select("id", F.explode(F.array_compact(F.array(*tried))).alias("regex"))


def match(posts: DataFrame, watches: DataFrame, dry_run: bool = False, context: Context | None = None, now: Column | None = None) -> DataFrame:
    """(post_id, watch_id, score, terms): every pair of a post and a watch of its team whose terms, pattern, gates and evidence hold.

    Posts need id, team and text; watches watch_id and team; for the other columns see POST and WATCH. A term pinned to an
    item counts only on posts of it or of no known item. Any term of include (where there are any), all of include_all, none
    of exclude. Hits of weak terms alone are no evidence, unless the watch names categories or items, or the post's category is
    the implied one. The score is the number of terms hit, 1 for the pattern, 1.5 for items, 0.5 for a price, 0.5 for attributes.
    A dry run ignores team, enabled and mute, what terms mean, and price qualifiers.
    """
    if dry_run and context is not None:
        context = replace(context, aliases=None, weak=(), hints={})
    ready = compile_watches(watches.drop("enabled") if dry_run else watches, context, None if dry_run else now)
    small = is_small(ready)
    sent = F.broadcast if small else lambda d: d
    rows = _filled(posts.drop("price_qualifier") if dry_run else posts, POST)
    if "enriched" not in posts.columns:
        rows = rows.withColumn("enriched", F.lit(True))
    rows = rows.select("id", F.col("team").alias("post_team"), *POST)

    used = lambda k, name: F.transform(name, lambda t: F.struct(F.lit(k).alias("use"), t.alias("term")))
    uses = ready.select("watch_id", F.col("team").alias("watch_team"), F.explode(F.concat(used(0, "include"), used(1, "include_all"), used(2, "exclude"))).alias("u")).select("watch_id", "watch_team", "u.*")
    weak = sorted({w for w in (context.weak if context else ())})
    uses = uses.withColumn("weak", F.col("term").isin(weak) if weak else F.lit(False))
    if context and context.aliases is not None:
        single = context.aliases.select(T.fold(F.col("alias")).alias("term"), "item_id").where("term <> ''").groupBy("term").agg(F.min("item_id").alias("pin"), F.max("item_id").alias("other")).where("pin = other").select("term", "pin")
        uses = uses.join(single, "term", "left")
    else:
        uses = uses.withColumn("pin", F.lit(None).cast("string"))
    hits = held_terms(posts, uses.select("term").distinct())
    counted = hits.join(sent(uses), "term").join(rows.select("id", "post_team", F.col("item_id").alias("own_item")), "id")
    if not dry_run:
        counted = counted.where(F.col("post_team") == F.col("watch_team"))
    counted = counted.where((F.col("use") == 2) | F.col("pin").isNull() | F.col("own_item").isNull() | (F.col("own_item") == F.col("pin")))
    of = lambda k: F.col("use") == k
    by_pair = counted.groupBy("id", "watch_id").agg(
        F.count_if(of(0)).alias("n_any"), F.count_if(of(1)).alias("n_all"), F.count_if(of(2)).alias("n_none"), F.array_sort(F.collect_set(F.when(F.col("use") < 2, F.col("term")))).alias("hit"), F.max((F.col("use") < 2) & ~F.col("weak")).alias("evidence")
    )

    found = by_pair.join(sent(ready), "watch_id").join(rows, "id")
    free = ready.where((F.size("include") == 0) & (F.size("include_all") == 0))
    gated = free.withColumn("gate", F.when(F.size("item_ids") > 0, F.transform("item_ids", lambda x: F.concat(F.lit("i"), x))).when(F.size("category_ids") > 0, F.transform("category_set", lambda x: F.concat(F.lit("c"), x))))
    team = F.lit(True) if dry_run else F.col("post_team") == F.col("team")
    keys = rows.withColumn("gate", F.explode(F.array_compact(F.array(F.concat(F.lit("i"), "item_id"), F.concat(F.lit("c"), "category_id")))))
    nothing = {"n_any": F.lit(0), "n_all": F.lit(0), "n_none": F.lit(0), "hit": F.array().cast("array<string>"), "evidence": F.lit(False)}
    # a watch of no terms meets posts by item, else by category; its exclusions are those of the pairs by terms
    by_gate = keys.join(sent(gated.where(F.col("gate").isNotNull()).withColumn("gate", F.explode("gate"))), "gate").where(team).drop("gate").withColumns(nothing)
    patterns = patterns_of(ready) if "regex" in watches.columns else []
    columns = [*found.columns]
    barred = by_pair.where("n_none > 0").select("id", "watch_id")
    pairs = found.where(((F.size("include") > 0) | (F.size("include_all") > 0)) & (F.col("n_none") == 0)).unionByName(by_gate.join(barred, ["id", "watch_id"], "left_anti").select(*columns))
    if patterns:
        matched = held_patterns(posts, patterns)
        # a watch of a pattern alone meets the posts that match it
        only = gated.where("regex is not null and gate is null").drop("gate").withColumnRenamed("regex", "own")
        by_pattern = matched.join(sent(only), F.col("regex") == F.col("own")).drop("own").join(rows, "id").where(team).withColumns(nothing)
        pairs = _with_pattern(pairs, matched).unionByName(by_pattern.join(barred, ["id", "watch_id"], "left_anti").select(*columns).withColumn("regex_hit", F.lit(True)))
    else:
        pairs = pairs.withColumn("regex_hit", F.lit(False))
    terms_hold = ((F.size("include") == 0) | (F.col("n_any") > 0)) & (F.col("n_all") == F.size("include_all")) & (F.col("regex").isNull() | F.col("regex_hit"))
    pinned = (F.size("item_ids") > 0) | (F.size("category_ids") > 0)
    alone = F.col("regex_hit") & (F.size("include") == 0) & (F.size("include_all") == 0)
    proven = F.coalesce("evidence", F.lit(False)) | pinned | alone | F.coalesce(F.array_contains("implied_set", F.col("category_id")), F.lit(False))
    plus = lambda when, x: F.when(when, x).otherwise(0.0)
    score = F.size("hit") + plus(F.col("regex_hit"), 1.0) + plus(F.size("item_ids") > 0, 1.5) + plus(F.col("price_min").isNotNull() | F.col("price_max").isNotNull(), 0.5) + plus(F.size("attribute_filters") > 0, 0.5)
    shown = F.concat_ws(",", F.array_join("hit", ","), F.when(F.col("regex_hit"), F.concat(F.lit("regex:"), "regex")))
    out = pairs.where(terms_hold & gates_hold() & proven)
    return out.select(F.col("id").alias("post_id"), "watch_id", score.cast("double").alias("score"), F.regexp_replace(shown, "^,", "").alias("terms"))


def _with_pattern(pairs: DataFrame, matched: DataFrame) -> DataFrame:
    """Adds regex_hit: whether the post matches its watch's pattern. Only pairs whose watch has one are joined."""
    own = pairs.where("regex is not null").join(matched.withColumn("regex_hit", F.lit(True)), ["id", "regex"], "left").withColumn("regex_hit", F.coalesce("regex_hit", F.lit(False)))
    return pairs.where("regex is null").withColumn("regex_hit", F.lit(False)).unionByName(own.select(*pairs.columns, "regex_hit"))
