"""The pipeline against plain versions of its stages, row by row, on a small table with copies, secrets, nulls and repeated rows."""

import math
import random
from collections import Counter, defaultdict

import plain
import pytest

import corpus_pipeline as pipeline
from postmill.llm import packing, secrets

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    words = {"en": [f"the{i}" for i in range(60)] + ["and", "of"], "fr": [f"été{i}le" for i in range(60)] + ["le", "des"]}
    # digits part runs, so languages differ by their letters
    out = []
    for i in range(50):
        lang = ("en", "fr")[i % 2]
        out.append([i, " ".join(rng.choices(words[lang], k=rng.randrange(6, 40))), lang, ("hot", "hot", "b")[i % 3], 0])
    for i in range(12):
        w = out[i][1].split()
        out.append([100 + i, " ".join([*w[:-1], w[-1]] if i % 2 else [*w, "added"]), out[i][2], "copies", 0])
    out.append([200, "the1 and token: abcdefghijkl0123 of the2 Zx8Qv2Lm9Kp4Rt7Wy1Bn5Hc3 the4", "en", "b", 0])
    out += [[201, None, "en", "b", 0], [202, "", None, None, 0], [203, "12345 !!", "en", "b", 0], [None, "the5 and the6 of of", "en", None, 0]]
    out.append(list(out[3]))
    return [(*r[:4], len(r[1] or "")) for r in out]


def plain_run(rows):
    """doc_id and token ids of every packed document, with the number of times that it is there."""
    import public_tokenizers
    from tokenizers import Tokenizer

    model = plain.Languages([(r[1], r[2]) for r in rows if r[2] is not None])
    known = [r for r in rows if (p := model.predict(r[1]))[0] != "und" and p[1] >= pipeline.MIN_LANGUAGE_SCORE]
    order = sorted(known, key=lambda r: (r[0] is None, r[0] or 0))
    tops = plain.components([r[1] for r in order], 5, 80)
    kept = [r for i, r in enumerate(order) if tops[i] == i]
    encode = secrets.encoder()
    clean = [(r[0], secrets.redact(r[1], [(s, e) for s, _, e in secrets.all_spans(r[1], encode)]), r[3]) for r in kept]
    size = defaultdict(int)
    for _, text, source in clean:
        size[source] += max(len(text), 1)
    target = {s: math.floor(math.sqrt(n) * 1000) for s, n in size.items()}
    rate = {s: sum(size.values()) * target[s] / sum(target.values()) / size[s] for s in size}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = Counter()
    for doc_id, text, source in clean:
        n = plain.poisson_count(rate[source], "" if doc_id is None else doc_id)
        if n:
            out[doc_id, (*t.encode(text, add_special_tokens=False).ids, packing.END_ID)] += n
    return out


def test_run_equals_plain_version(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = pipeline.run(spark, str(tmp_path)).collect()
    want = plain_run(rows)
    # pieces of one copy follow each other in sequence ids; count them by place in the document instead
    pieces = Counter((r["doc_id"], r["start"], tuple(r["ids"])) for r in found)
    expected = Counter()
    for (doc_id, ids), n in want.items():
        at = 0
        for length in packing.binary_pieces(len(ids)):
            expected[doc_id, at, ids[at : at + length]] += n
            at += length
    assert pieces == expected and len(want) > 20
    assert len({r["sequence_id"] for r in found}) == len(found)


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sf = "/root/testdata/sf0.001"
    known = pipeline.stage_language(spark, docs, sf)
    assert known.columns == docs.columns and known.count() >= 0.97 * docs.count()
    kept = pipeline.stage_near_copies(spark, known, sf).cache()
    assert kept.columns == docs.columns and kept.count() == kept.select("doc_id").distinct().count()
    assert kept.join(known, docs.columns, "left_anti").count() == 0
    clean = pipeline.stage_secrets(spark, kept, sf)
    assert clean.columns == docs.columns and clean.count() == kept.count()
    assert clean.where("text rlike 'AKIA[A-Z0-9]{14,}'").count() == 0


def test_stages_take_clashing_columns(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    names = ["row", "lang_pred", "score", "_tag", "_set", "_spans", "_cut", "rate", "name", "_rate", "ident", "secrets"]
    clash = docs.selectExpr("*", *[f"doc_id * 10 + {k} as {n}" for k, n in enumerate(names)])
    want = docs
    for _, stage in pipeline.STAGES[:-1]:
        clash, want = stage(spark, clash, ""), stage(spark, want, "")
        assert Counter(map(tuple, clash.select(*docs.columns).collect())) == Counter(map(tuple, want.collect()))
    for k, n in enumerate(names):
        if n != "_rate":
            assert clash.where(f"doc_id is not null and {n} <> doc_id * 10 + {k}").count() == 0


def test_run_on_nulls_and_empty(spark, tmp_path):
    spark.createDataFrame([(1, None, None, None, 0), (2, "", "en", "a", 0), (3, "!!", "en", "a", 0)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
