"""Licence scans of names beside versions, of short names behind a cue, and of texts with very many hits; redaction of many spans."""

import time

import pytest

from postmill.llm import licenses, secrets
from postmill.llm.shared import ship


def labels(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    return [r["labels"] for r in licenses.license_digest(licenses.scan_licenses(rows)).orderBy("doc_id").collect()]


def test_versions_need_a_licence_word(spark):
    got = labels(spark, "Python 2.0 was released", "the Unicode 3.0 standard", "Apache 2.0 web server tuning", "PHP 3.01", "license: Apache-2.0", "under the Python-2.0 license", "GPL-3.0-only", "code is Apache 2.0 licensed", "MPL 2.0")
    assert got[:4] == [""] * 4
    assert "apache-2.0" in got[4] and "python-2.0" in got[5] and "gpl-3.0" in got[6] and "apache-2.0" in got[7] and "mpl-2.0" in got[8]


def test_short_names_behind_a_cue(spark):
    got = labels(spark, "licensed under the MIT", "licence: MIT", "released by MIT Press", "License is BSD", "licensed under the terms of the ISC")
    assert got == ["mit", "mit", "", "bsd", "isc"]


@pytest.mark.parametrize("n", [300, 160_000])
def test_long_texts(spark, n):
    """Every hit is placed, also where there are more than a block of them; time grows with the text."""
    text = "word gpl " * (n // 2)
    began = time.time()
    (r,) = licenses.scan_licenses(spark.createDataFrame([(1, f"{text} general public license")], "doc_id int, text string")).collect()
    assert r["n_words"] == 2 * (n // 2) + 3
    assert [b["start"] for b in r["base"]] == [2 * (n // 2)]
    starts = [d["start"] for d in r["detections"]]
    assert starts == [*range(1, 2 * (n // 2), 2), 2 * (n // 2)]
    assert time.time() - began < 90


def test_redaction_of_many_spans(spark):
    ship(spark)
    text = " ".join(f"token: abcdefghij{i:06}" for i in range(20_000))
    docs = spark.createDataFrame([(1, text, 5, "kept"), (2, None, None, None), (3, "", 0, "x"), (4, "plain", 9, "y")], "doc_id int, text string, n_chars bigint, _changed string")
    got = {r["doc_id"]: r for r in secrets.redact_secrets(docs).collect()}
    assert got[1]["text"] == " ".join(["[secret]"] * 20_000) and got[1]["n_chars"] == len(got[1]["text"]) and got[1]["_changed"] == "kept"
    assert (got[2]["text"], got[2]["n_chars"], got[3]["text"], got[4]["n_chars"]) == (None, None, "", 9)
