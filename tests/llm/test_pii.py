"""Personal data: fixed spans by scanning characters, the tagger by numbers, by brute force and on forms it was not shown."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from postmill.llm import pii, queries
from postmill.llm.shared import ship
from postmill.llm.tagger import Tagger

DIGITS = "0123456789"


def plain_spans(text):
    """The contract's patterns as they are written."""
    text, found = text or "", []
    for kind, pattern in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in DIGITS]
            total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
            good = (True, kind == 1 and all(int(p) <= 255 for p in m.group().split(".")), 12 <= len(digits) <= 19 and total % 10 == 0, 9 <= len(digits) <= 15)[kind]
            if good:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def card(rng):
    body = [rng.randrange(10) for _ in range(15)]
    rest = next(d for d in range(10) if pii.luhn("".join(map(str, [*body, d]))))
    return "".join(map(str, [*body, rest]))


def sentence(rng, n):
    return " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(n))


def values(rng):
    """A value that the fixed patterns find, of each kind."""
    d = lambda n: "".join(rng.choices(DIGITS, k=n))
    return [f"{rng.choice(['ann', 'bo.li', 'x_y'])}{d(2)}@{rng.choice(['mail', 'post'])}{d(1)}.example.com", ".".join(str(rng.randrange(256)) for _ in range(4)), card(rng), f"+1 ({d(3)}) {d(3)}-{d(4)}"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(i, f"{sentence(rng, 12)} {values(rng)[i % 4]} {sentence(rng, 12)}" if i % 5 else f"{sentence(rng, 9)} {rng.randrange(1000)} {sentence(rng, 9)}") for i in range(1200)]


@pytest.fixture(scope="module")
def tagger(spark, rows):
    ship(spark)
    return pii.learn(spark.createDataFrame(rows, "doc_id int, text string"))


def test_fixed_spans_as_written():
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab1234567890.@+- ()%é", k=rng.randrange(1, 60))) for _ in range(6000)]
    texts += ["a@b.c+x@d.e", "a@b@c.d", "@@a@b.c.", "1.2.3.4.5.6.7.8", "300.1.1.1.1", "007.08.255.0", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (543) 555-9258", "+1" + " " * 50, "a@b", "", "é@b.c", "x.@y.z"]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), t
    for long in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "@" * 300_000, "+1 " * 100_000, "a.b-" * 50_000 + "@c.d"):
        pii.base_spans(long)  # in linear time


def test_gradient():
    t = Tagger(2, hidden=5, dtype=np.float64)
    rng = np.random.default_rng(3)
    chars, gold = rng.integers(0, 129, (3, 6)), np.array([[0, 1, 2, 2, 0, 3], [1, 2, 0, 0, 3, 4], [0, 0, 0, 0, 0, 0]])
    _, grad = t.loss(chars, gold)
    for name, w in t.w.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in w.shape) if name != "embed" else (chars[0, 1], rng.integers(0, w.shape[1]))
            if w[at] < -1000:
                continue
            kept, step = w[at], 1e-5
            w[at] = kept + step
            up = t.loss(chars, gold)[0]
            w[at] = kept - step
            down = t.loss(chars, gold)[0]
            w[at] = kept
            assert abs((up - down) / (2 * step) - grad[name][at]) < 1e-6, (name, at)


def test_decode_is_best_of_all_paths():
    t = Tagger(1, hidden=4, dtype=np.float64, seed=7)
    t.w["step"] += np.random.default_rng(1).standard_normal((3, 3))
    t.bar()
    chars = np.random.default_rng(2).integers(0, 129, (20, 5))
    labels, _ = t.decode(chars)
    emit, _ = t.emissions(chars)
    for r in range(20):
        value = lambda p, r=r: t.w["first"][p[0]] + sum(emit[i, r, x] for i, x in enumerate(p)) + sum(t.w["step"][a, b] for a, b in itertools.pairwise(p))
        assert tuple(labels[r]) == max(itertools.product(range(3), repeat=5), key=value)


def test_reconcile_is_best_set():
    rng = random.Random(9)
    for _ in range(300):
        spans = []
        for k in range(3):  # spans of one kind do not overlap here
            at = 0
            while at < 30:
                s = at + rng.randrange(0, 8)
                at = s + rng.randrange(1, 9)
                spans.append((s, k, at, float(rng.randrange(1, 20))))
        spans = spans[:11]
        score = {(s, k, e): x for s, k, e, x in spans}
        free = lambda c: all(a[2] <= b[0] for a, b in itertools.pairwise(sorted(c)))
        best = max(sum(x for *_, x in c) for n in range(len(spans) + 1) for c in itertools.combinations(spans, n) if free(c))
        got = pii.reconcile(spans)
        assert free(got) and sum(score[g] for g in got) == best
    # parts that two windows see become one
    assert pii.reconcile([(40, 0, 96, 5.0), (48, 0, 130, 9.0)]) == [(40, 0, 130)]


def test_other_forms_are_found(tagger):
    """Held-out values in forms without a fixed pattern: most are found whole; plain numbers stay free."""
    rng, found, wrong, total = random.Random(77), 0, 0, 0
    finder = pii.Finder(tagger)
    for i in range(400):
        kind = i % 4
        value = pii.varied(kind, values(rng)[kind], rng)
        before = sentence(rng, rng.randrange(3, 30))
        text = f"{before} {value} {sentence(rng, 20)}"
        if pii.base_spans(text):
            continue
        total += 1
        found += (len(before) + 1, kind, len(before) + 1 + len(value), False) in finder.spans([text])[0]
        plain = f"{before} {pii.misleading(rng)} {sentence(rng, 20)}"
        wrong += sum(not own for *_, own in finder.spans([plain])[0])
    assert total > 250 and found >= 0.9 * total, (found, total)
    assert wrong <= 4, wrong


def test_odd_rows(spark, tagger):
    value = "call (543) 555-9258 now"
    long = "no numbers here " * 40_000 + value
    texts = [None, "", "x", value, value, "+1 (543) 555-9258 a@b.cc", "9" * 20_000, "é@ü " * 3000, long, "a@" + "b" * 200 + ".cc"]
    docs = spark.createDataFrame([(i, t, "kept", i) for i, t in enumerate(texts)], "doc_id int, text string, spans string, kind int")
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs, tagger=tagger).collect()}
    assert len(got) == len(texts) and got[0]["spans"] == got[1]["spans"] == got[2]["spans"] == []
    assert got[3]["spans"] == got[4]["spans"] and [s["kind"] for s in got[3]["spans"]] == ["phone"]
    assert [(s["kind"], s["start"]) for s in got[8]["spans"]] == [("phone", len(long) - 18)]
    for i, t in enumerate(texts):
        assert [(s["start"], pii.KINDS.index(s["kind"]), s["end"]) for s in got[i]["spans"] if s["base"]] == plain_spans(t)
    assert pii.find_personal_data(docs.where("false"), tagger=tagger).count() == 0
    assert pii.learn(docs.where("doc_id < 3")) is None and pii.learn(docs.where("false")) is None


def test_sample_is_bounded_and_whole(spark, rows):
    docs = spark.createDataFrame(rows * 3, "doc_id int, text string")
    got = pii.sample_spans(docs, size=50)
    by_kind = [sum(len(s) > 0 and s[0][1] == k for _, s in got) for k in range(4)]
    assert all(20 <= n <= 50 for n in by_kind) and len({t for t, _ in got}) == len(got) <= 250
    for text, spans in got:
        assert all(s in pii.base_spans(text) for s in spans)


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()}
    rows = queries.op11_personal_data(spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain_spans(docs[r["doc_id"]])
        shown = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[1] == k for b in base) for k in range(4)]
        spans = [s for s in r["spans"].split(",") if s]
        assert set(shown) <= set(spans)
        order = [(int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])) for s in spans]
        assert order == sorted(order)
