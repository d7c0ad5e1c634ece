"""Searches as watches and topics, the CSV files, and bucket overwrites."""

import glob

from postmill.operators import drafts, lifecycle, reads
from postmill.operators.search import Params, safe_regex


def test_search_to_watch_and_topic():
    p = Params(q='iphone "pro max" -seal', category_paths=["phones"], intents=["sell"], price_max=5.0, source_ids=[1], author="ab", sort="newest")
    watch, dropped = drafts.watch_of_search(p)
    assert watch["include_all"] == ["iphone", "pro max"] and watch["exclude"] == ["seal"] and watch["price_max"] == 5.0 and dropped == ["author", "sort"]
    assert drafts.watch_of_search(Params(q="-seal"))[0] is None
    topic, dropped = drafts.topic_of_search(p)
    assert (topic.q, topic.price_max, topic.source_ids, topic.author) == (p.q, 5.0, [], None) and dropped == ["sourceIds", "author", "sort"]


def test_csv_files(spark, tmp_path):
    rows = spark.createDataFrame([(2, "=1+1", "call 0912345678"), (1, 'a "b"', "x\ny"), (3, "c", None)], "id bigint, title string, text string").selectExpr("*", "'u' as author_id", "cast(null as string) as author_name")
    drafts.write_csv(rows, "salt", f"{tmp_path}/out", 2)
    (name,) = [f for f in glob.glob(f"{tmp_path}/out/part-*") if open(f, encoding="utf-8").read()]
    raw = open(name, encoding="utf-8", newline="").read()
    assert raw.startswith("﻿id,url,source,author,") and raw.endswith("\r\n") and "'=1+1" in raw and '"a ""b"""' in raw and "0912345678" not in raw and "Member #" in raw
    assert "\n3," not in raw


def test_bucket_overwrite_replaces_only_its_buckets(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "hour string, n int")
    path = f"{tmp_path}/t"
    reads.overwrite_buckets(frame([("a", 1), ("b", 2)]), path, "hour")
    for _ in range(2):
        reads.overwrite_buckets(frame([("b", 5), ("c", 3)]), path, "hour")
    assert sorted((r["hour"], r["n"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 5), ("c", 3)]


def test_alias_plan_and_patterns():
    terms = {"airpods": "AirPods", "airpodspro": "AirPods Pro", "xe": "Xe", "kia": "Kia"}
    got = dict((k, (what, to)) for k, what, to in lifecycle.plan_aliases([{"canonical": "AirPods", "keys": ["airpods", "airpodspro"]}, {"canonical": "unrelated", "keys": ["kia"]}], ["xe", "nothere"], terms))
    assert got == {"airpodspro": ("merge", "airpods"), "airpods": ("keep", None), "xe": ("drop", None), "kia": ("keep", None)}
    assert safe_regex(r"\biphone\s?1[3-9]\b") and not safe_regex("(a+)+") and not safe_regex(r"(a)\1") and not safe_regex("(?=x)") and not safe_regex("(") and not safe_regex("a" * 201)
