"""Packing against the whole tokenizer: every character, random strings of awkward ones, and clashing columns."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from postmill.llm import packing


@pytest.fixture(scope="module")
def encoder():
    return packing.WordEncoder()


def own_ids(encoder, texts):
    ids, edge = encoder.texts(pa.array(texts))
    return [ids[s : e - 1].tolist() for s, e in zip(edge[:-1], edge[1:], strict=True)]


def whole_ids(encoder, texts):
    return [e.ids for e in encoder.whole.encode_batch(texts, add_special_tokens=False)]


def test_every_character_between_letters(encoder):
    texts = [f"a{chr(c)}b" for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    assert own_ids(encoder, texts) == whole_ids(encoder, texts)


def test_random_strings(encoder):
    rng = random.Random(11)
    pool = [chr(c) for c in (*range(0x530), *range(0x1C80, 0x1C90), *range(0x2000, 0x2070), *range(0x10D50, 0x10D60))] + list("'sStTrRe|<>\x00\x1c\x7f\x85 ́Σσİ") * 15
    texts = ["".join(rng.choices(pool, k=rng.randrange(1, 12))) for _ in range(20_000)] + ["a\x1cb", "<|endoftext|>x", "don't", "x" * 5000]
    assert own_ids(encoder, texts) == whole_ids(encoder, texts)


def test_pieces_and_digests(spark):
    rows = [(1, "a\x1cb " * 2000, "x"), (2, None, "x"), (3, "", None), (3, "", None), (4, "plain words", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").selectExpr("*", "1 as start", "2 as bucket", "3 as sequence_id", "4 as offset")
    encoder = packing.encoder()
    full, slim = (packing.pack_documents(docs, with_ids=x).collect() for x in (True, False))
    digest = lambda found: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found)
    assert digest(full) == digest(slim) and "ids" not in slim[0]
    assert len({r["sequence_id"] for r in full}) == len(full)
    for d, text, _ in {r[0]: r for r in rows}.values():
        ids = [*encoder.whole.encode(text or "", add_special_tokens=False).ids, 1]
        got = sorted((r for r in full if r["doc_id"] == d), key=lambda r: r["start"])
        if d == 3:
            assert [r["ids"] for r in got] == [[1], [1]]
            continue
        assert [x for r in got for x in r["ids"]] == ids
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) and r["doc_tokens"] == len(ids) for r in got)
