"""Fill-in-middle against a plain version and against its SQL."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from oracle import compare

from postmill.llm import fim, queries

POOL = list("ab \n\t<>PSM") + ["é", "ß", "漢", "😀", "́", "<P>", "<S>", "<M>", "\r\n", "\x00"]
SPLIT = {"char": r"(?s).", "word": r"(?s)[ \t-\r]*[^ \t-\r]*[ \t-\r]*", "line": r"[^\n]*\n|[^\n]+"}


def units(text, unit):
    if unit != "word":
        return re.findall(SPLIT[unit], text)
    head = re.match(r"[ \t-\r]*", text)[0]
    return ([head] if head else []) + re.findall(r"[^ \t-\r]+[ \t-\r]*", text[len(head) :])


def plain(doc_id, text, unit="char", seed=1):
    text, h = text or "", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    u = units(text, unit)
    assert "".join(u) == text
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(u), "plain", None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h4 % 100 < 20:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_equals_plain_version(spark, unit):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices(POOL, k=rng.randrange(0, 30))), i) for i in range(600)]
    rows += [(None, "null id", 0), (5, None, 0), (6, "", 0), (7, "same", 1), (7, "same", 1), (8, "é" * 300_000, 2), (9, "漢 x\n" * 60_000, 2), (10, "   ", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int").repartition(3)
    got = fim.fill_in_middle(docs, unit=unit, carry=["doc_id", "text"]).withColumn("back", fim.restored()).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(r["doc_id"], r["text"], unit), r["doc_id"]
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_slices_and_no_rows(spark):
    whole = pa.array(["abc", "dé", None, "", "漢字"]).fill_null("")
    n, edges, chars = fim.cut(whole.slice(1), *[fim.np.arange(4, dtype=fim.np.int64)] * 2)
    assert n.tolist() == [2, 0, 0, 2] and edges[3].tolist() == [3, 3, 3, 9] and chars[3].tolist() == [2, 2, 2, 4]
    empty = fim.fill_in_middle(spark.createDataFrame([], "doc_id bigint, text string, output int, _draws int"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "_draws", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_clashing_columns_and_other_seed(spark):
    docs = spark.createDataFrame([(1, "some text", "x", "y")], "doc_id int, text string, _draws string, form string")
    (r,) = fim.fill_in_middle(docs, seed=9).collect()
    assert r["_draws"] == "x" and (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(1, "some text", seed=9)


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert compare(queries.op12_fill_in_middle(spark, folder), fim.FIM_SQL, folder) == 1000
