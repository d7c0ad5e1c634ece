"""Stored-query matching against plain Python: terms of several words, watches without include, and the gates."""

import re
from collections import Counter

import pytest

from postmill.operators import matching

POSTS = [(1, 0, "Selling iPhone 15, like new", 10.0), (2, 0, "iphone for 15 euro", 10.0), (3, 0, "broken IPHONE  15 c++ book", 99.0), (4, 1, "Phở bò, fresh", None), (5, 0, None, 5.0), (6, 0, "", 5.0), (7, 0, "книга c book wi-fi", 7.0), (8, 0, "xiphone 15 iphone 155", 1.0), (9, 0, "wi fi kit", 1.0)]
WATCHES = [
    (1, 0, True, ["iphone 15"], [], [], None, None),
    (2, 0, True, [], ["iphone", "new"], [], None, None),
    (3, 0, True, None, ["iPhone 15"], ["like new"], None, None),
    (4, 0, True, ["iphone", "15"], ["15"], ["iphone 15"], None, 50.0),
    (5, 1, True, ["pho bo"], None, None, None, None),
    (6, 0, True, ["c++", "wi-fi"], [], [], None, None),
    (7, 0, True, ["книга"], [], [], None, None),
    (8, 0, True, [], ["книга"], [], None, None),
    (9, 0, True, [], [], [], None, None),
    (10, 0, False, ["book"], [], [], None, None),
    (11, 0, True, [" "], [], [], None, None),
]


def plain(posts, watches, dry_run):
    fold = lambda t: " ".join((t or "").lower().replace("ở", "o").replace("ò", "o").split())
    out = []
    for i, team, text, price in posts:
        has = lambda t, text=fold(text): bool(t) and re.search(rf"(?<![^\W_]){re.escape(t)}(?![^\W_])", text) is not None
        for w, of, enabled, any_of, every, none, lo, hi in watches:
            any_of, every, none = ([fold(t) for t in x or []] for x in (any_of, every, none))
            if not (enabled or dry_run) or not (dry_run or team == of) or not (any_of or every) or (hi is not None and not (price is not None and price <= hi)):
                continue
            hit = sorted({t for t in any_of if has(t)})
            if (hit or not any_of) and all(map(has, every)) and not any(map(has, none)):
                out.append((i, w, float(len({*hit, *every})) + 0.5 * (lo is not None or hi is not None), ",".join(sorted({*hit, *every}))))
    return Counter(out)


@pytest.mark.parametrize("dry_run", [False, True])
@pytest.mark.parametrize("most", [10_000, 1])
def test_match_equals_plain_python(spark, monkeypatch, dry_run, most):
    monkeypatch.setattr(matching, "MAX_BROADCAST_WATCHES", most)
    posts = spark.createDataFrame([(i, t, x, p, None) for i, t, x, p in POSTS], "id bigint, team bigint, text string, price double, intent string")
    watches = spark.createDataFrame([(*w, None) for w in WATCHES], "watch_id bigint, team bigint, enabled boolean, include array<string>, include_all array<string>, exclude array<string>, price_min double, price_max double, intents array<string>")
    want = plain(POSTS, WATCHES, dry_run)
    assert {w for _, w, *_ in want} == {1, 2, 3, 4, 5, 6, 7, 8, *([10] if dry_run else [])}
    assert Counter(map(tuple, matching.match(posts, watches, dry_run).collect())) == want


def test_gates_evidence_and_patterns(spark):
    """One post, and watches that differ in one gate each: which match, and with what score."""
    post = [(1, 0, "Bán iPhone 15 Pro đẹp, giá tốt", "s1", 20.0, "floor", None, "sell", "phones.iphone", "i15", {"ram": "8gb", "region": "hanoi", "year": "2020"}, True, None)]
    posts = spark.createDataFrame(post, "id bigint, team bigint, text string, source_id string, price double, price_qualifier string, price_max_value double, intent string, category_id string, item_id string, attributes map<string,string>, enriched boolean, source_region string")
    f = lambda key, op, value=None, values=None: (key, op, value, values)
    #       id, include, include_all, exclude, regex, categories, items, price_min, price_max, filters, intents, sources, muted; the score or None
    cases = [
        (1, ["iphone 15"], [], [], None, [], [], None, None, [], [], [], None, 1.0),
        (2, ["iphone"], ["15 pro"], [], None, [], [], None, None, [], [], [], None, 2.0),
        (3, [], [], [], r"iphone\s?1[3-9]", [], [], None, None, [], [], [], None, 1.0),
        (4, ["gia"], [], [], None, [], [], None, None, [], [], [], None, None),  # weak
        (5, ["gia"], [], [], None, ["phones"], [], None, None, [], [], [], None, 1.0),
        (6, [], [], [], None, [], ["i15"], None, None, [], [], [], None, 1.5),
        (7, [], [], ["dep"], None, [], ["i15"], None, None, [], [], [], None, None),
        (8, ["iphone"], [], [], None, ["laptops"], [], None, None, [], [], [], None, None),
        (9, ["iphone"], [], [], None, [], [], 25.0, None, [], [], [], None, 1.5),  # a floor has no end
        (10, ["iphone"], [], [], None, [], [], None, 20.0, [], [], [], None, None),  # and is open below
        (11, ["iphone"], [], [], None, ["phones"], [], None, None, [f("ram", "gte", "4gb")], [], [], None, 1.5),
        (12, ["iphone"], [], [], None, ["phones"], [], None, None, [f("ram", "lte", "4gb")], [], [], None, None),
        (13, ["iphone"], [], [], None, ["phones"], [], None, None, [f("year", "gte", "2019")], [], [], None, 1.5),
        (14, ["iphone"], [], [], None, [], [], None, None, [f("region", "in", None, ["hanoi", "hue"])], [], [], None, 1.5),
        (15, ["iphone"], [], [], None, [], [], None, None, [f("colour", "eq", "red")], [], [], None, None),  # no such attribute
        (16, ["iphone"], [], [], None, [], [], None, None, [], ["buy"], [], None, None),
        (17, ["iphone"], [], [], None, [], [], None, None, [], ["sell"], ["s1"], None, 1.0),
        (18, ["iphone"], [], [], None, [], [], None, None, [], [], ["s2"], None, None),
        (19, ["iphone"], [], [], None, [], [], None, None, [], [], [], "2030-01-01", None),
        (20, ["iphone 14"], [], [], None, [], [], None, None, [], [], [], None, None),
        (21, ["dep"], [], [], None, [], [], None, None, [], [], [], None, None),  # an alias of another item
        (22, ["iphone"], [], [], "(a+)+", [], [], None, None, [], [], [], None, None),  # a pattern that is not run
        (23, ["gia", "may"], [], [], None, [], [], None, None, [], [], [], None, 1.0),  # weak, but may implies phones
        (24, [], [], [], None, [], [], 1.0, None, [], [], [], None, None),  # no evidence
        (25, ["pro"], [], [], "pro", [], ["i15"], None, 50.0, [], [], [], None, 4.0),
        (26, [], [], ["pro"], "iphone", [], [], None, None, [], [], [], None, None),
    ]
    import datetime as dt

    rows = [(*c[:12], dt.datetime.fromisoformat(c[12]) if c[12] else None, 0, True, "") for c in cases]
    watches = spark.createDataFrame(
        rows,
        f"watch_id bigint, include array<string>, include_all array<string>, exclude array<string>, regex string, category_ids array<string>, item_ids array<string>, price_min double, price_max double, attribute_filters array<{matching.FILTER}>, intents array<string>, source_ids array<string>, muted_until timestamp_ntz, team bigint, enabled boolean, name string",
    )
    context = matching.Context(
        categories=spark.createDataFrame([("phones", "phones"), ("phones.iphone", "phones.iphone"), ("laptops", "laptops")], "category_id string, path string"),
        aliases=spark.createDataFrame([("iPhone 15", "i15"), ("Đẹp", "i99"), ("pro", "i15"), ("pro", "i16")], "alias string, item_id string"),
        schemas=spark.createDataFrame([("phones", "ram", "ordered", ["4gb", "8gb"]), ("phones", "year", "number", None), ("laptops", "region", "enum", ["hanoi"])], "category_id string, key string, kind string, values array<string>"),
        weak=("gia", "dep", "may"),
        hints={"phones": ("may",), "laptops": ("laptop",)},
    )
    from pyspark.sql import functions as F

    got = {r["watch_id"]: r["score"] for r in matching.match(posts, watches, context=context, now=F.lit("2026-01-01").cast("timestamp_ntz")).collect()}
    assert got == {c[0]: c[13] for c in cases if c[13] is not None}


def test_words_of_a_text_are_cut_once(spark):
    """A filter on what is held must not bring the search for words into the lambdas over words, nor below the projection that makes them."""
    from postmill.plans import registry

    plan = registry.QUERIES["prefilter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # one search for words in each of the two scans, and one for what stands between words, as some names have several
    assert plan.count("regexp_extract_all") == 3
    assert not [line for line in plan.splitlines() if line.strip(" :+-").startswith("Filter") and "regexp_extract_all" in line]
