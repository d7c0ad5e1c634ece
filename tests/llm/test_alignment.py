"""Cross-tokenizer alignment against whole documents tokenized at once."""

import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from postmill.llm import alignment, queries
from postmill.llm.shared import ship

POOL = list("abcXYZ019 \n\t\r  .,;'\"<>{}") + ["é", "漢", "😀", " ", "　", " ", "\x85", "\x1c", "​", "﻿", "᠎", "\x00", "́", " the", "ing", "\r\n", "  ", ");\r\n", "<s>", "<unk>", "<0x0A>", "<|endoftext|>", "'ll", "ﬁ"]


def whole(text, v):
    """Ids and end bytes of both sides for one document; None if the bytes differ."""
    if not text:
        return None
    out = []
    for ids, table in ((v.a.encode(f" {text}", add_special_tokens=False).ids, v.a_bytes), (v.b.encode(text), v.b_bytes)):
        if b"".join(table[i] for i in ids) != f" {text}".encode():
            return None
        ends, at = [], 0
        for i in ids:
            at += len(table[i])
            ends.append(at)
        out.append((ids, ends))
    return out


def brute(texts):
    """All columns of each text, from the definition."""
    v, docs, held = alignment.vocabularies(), [], Counter()
    for t in texts:
        got = whole(t, v)
        groups = []
        if got:
            (a, ends_a), (b, ends_b) = got
            common = sorted(set(ends_a) & set(ends_b))
            number = {e: k for k, e in enumerate(common)}
            own = defaultdict(lambda: ([], []))
            for side, (ids, ends) in enumerate(got):
                k = 0
                for i, e in zip(ids, ends, strict=True):
                    own[k][side].append(i)
                    k += e in number
            groups = [own[k] for k in range(len(common))]
        docs.append((got, groups))
        held.update({(x, y) for a, b in groups for x in a for y in b})
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    rows = []
    for got, groups in docs:
        links = [(x, y) for a, b in groups for x in a for y in b]
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        rows.append((len(got[0][0]) if got else 0, len(got[1][0]) if got else 0, len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), shown))
    return rows


def test_equals_whole_documents(spark):
    ship(spark)
    rng = random.Random(6)
    texts = ["".join(rng.choices(POOL, k=rng.randrange(0, 40))) for _ in range(1500)]
    texts += [r["text"] for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()[:60]]
    texts += [None, "", " ", "\n", "a ", "same text", "same text", "a▁b", "x" * 20_000, "12 " * 20_000, "漢字" * 2_000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/", k=5_000))]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, groups string").repartition(5)
    got = {r["doc_id"]: r for r in alignment.align(docs).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute(texts)):
        assert tuple(got[i][c] for c in (*alignment.SUMS, "groups")) == want, (i, texts[i])


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    assert alignment.align(docs).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")
    assert [tuple(r)[2:] for r in alignment.align(nothing).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_unknown_segment_is_an_error(spark):
    known = alignment.align_segments(spark.createDataFrame([(1, "some words")], "doc_id int, text string"))
    with pytest.raises(Exception, match="not in the store"):
        alignment.align(spark.createDataFrame([(1, "other words")], "doc_id int, text string"), alignments=known).collect()


def test_equal_first_halves(tmp_path):
    """Two segments whose hashes agree in their first half are told apart by the second."""
    store = alignment.Store(str(tmp_path), "segment", 1, frozenset([0]))
    high, low = alignment.hashes(pa.array([" one", " two"]))
    keys = alignment.np.full(2, high[0])
    store.write(0, keys=keys, low=alignment.np.sort(low))
    hashed = alignment.hashes
    try:
        alignment.hashes = lambda segments: (alignment.np.full(len(segments), high[0]), hashed(segments)[1])
        shard, place = store.places(pa.array([" two", " one"]))
    finally:
        alignment.hashes = hashed
    assert place.tolist() == alignment.np.argsort(alignment.np.argsort([low[1], low[0]])).tolist() and shard.tolist() == [0, 0]


def test_query_digests(spark):
    rows = queries.op13_tokenizer_alignment(spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()}
    want = dict(zip(docs, brute(list(docs.values())), strict=True))
    assert len(rows) == len(docs)
    for r in rows:
        w = want[r["doc_id"]]
        assert tuple(r[c] for c in alignment.SUMS) == w[:6] and r["groups_sha256"] == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")
