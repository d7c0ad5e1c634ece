"""Personal data: fixed patterns, and a character tagger that learns their look from labelled spans and finds other forms.

The labels are the spans of the fixed patterns in a bounded sample of all texts. Each is learned as it stands and in a form that
the patterns don't know (a telephone number without its plus sign, an address with its at sign spelled out). Texts
are tagged in overlapping windows, wherever a digit or an at sign stands; the spans of all windows are then reconciled
over the whole text.
"""

from __future__ import annotations

import pickle
import random
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructType

from postmill.llm.shared import pieces
from postmill.llm.tagger import Tagger, codes

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, and from one window to the next: a span of at most half a window lies whole in one of them.
WINDOW, STEP = 96, 48
#: Windows that the tagger takes at a time.
ROWS = 512
#: About so many different labelled spans of each kind, and as many places without one, are learned from.
SAMPLE = 300
#: What any form of the four kinds holds.
TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]", re.IGNORECASE)
AT, DOT = re.compile(r"\s?[(\[]at[)\]]\s?|@", re.IGNORECASE), re.compile(r"\s?[(\[]dot[)\]]\s?|\[\.\]|\(\.\)", re.IGNORECASE)

_LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")

SPAN = ArrayType(StructType().add("kind", StringType()).add("start", LongType()).add("end", LongType()).add("base", BooleanType()))


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return (sum(map(int, digits[-1::-2])) + sum(doubled[int(d)] for d in digits[-2::-2])) % 10 == 0


def is_ip(parts: list[str]) -> bool:
    return len(parts) == 4 and all(p and len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in code points, sorted. Linear in the text."""
    found = []
    at, free, before = text.find("@"), 0, 0
    while at >= 0:
        # what stands before the sign, behind the last address and the last sign
        head = text[max(free, before) : at]
        own = len(head) - len(head.rstrip(_LOCAL))
        if own and (m := _DOMAIN.match(text, at + 1)):
            found.append((at - own, 0, m.end()))
            free = m.end()
        before = at + 1
        at = text.find("@", at + 1)
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if is_ip(m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= len(d := _NO_DIGIT.sub("", m.group())) <= 19 and luhn(d)]
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NO_DIGIT.sub("", m.group())) <= 15]
    return sorted(found)


# --- learning


def _snippet(text: str, start: int, end: int, spans: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The surroundings of a place, about a window wide, and the spans that lie whole in them. Cut spans are cut off."""
    room = max(WINDOW - (end - start), 0) // 2
    lo, hi = max(start - room, 0), min(end + room, len(text))
    for s, _, e in spans:
        if s < lo < e <= start:
            lo = e
        elif end <= s < hi < e:
            hi = s
    return text[lo:hi], [(s - lo, k, e - lo) for s, k, e in spans if lo <= s and e <= hi]


def sample_spans(docs: DataFrame, text: str = "text", size: int = SAMPLE) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """At most ``size`` different labelled spans of each kind with their surroundings, and places of digits without one, by the order of their hashes.

    All texts are searched. Only rows whose hash lies below a bound from the counts reach the driver, about one and a half times the size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            rows = []
            for t in b["text"].filter(pc.match_substring_regex(b["text"], "[0-9@]").fill_null(False)).to_pylist():
                spans = base_spans(t)
                places = [(k, s, e) for s, k, e in spans]
                starts, ends = [s for s, _, _ in spans], [0, *accumulate((e for _, _, e in spans), max)]
                places += [(len(KINDS), m.start(), m.end()) for m in re.finditer("[0-9]+", t) if ends[bisect_left(starts, m.end())] <= m.start()]
                for k, s, e in places:
                    if e - s <= WINDOW // 2:
                        own, inside = _snippet(t, s, e, spans)
                        rows.append((k, xxhash.xxh3_64_intdigest(own) >> 1, own, " ".join(f"{a}:{c}:{z}" for a, c, z in inside)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["kind", "key", "text", "spans"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "kind int, key bigint, text string, spans string")
    sizes = {r["kind"]: r["n"] for r in found.groupBy("kind").agg(F.approx_count_distinct("key").alias("n")).collect()}
    low = F.lit(False)
    for kind, n in sizes.items():
        low |= (F.col("kind") == kind) & (F.col("key") <= min((1 << 63) - 1, (1 << 62) // max(n, 1) * 3 * size))
    by_kind = defaultdict(list)
    for r in found.where(low).distinct().orderBy("kind", "key", "spans").collect():
        by_kind[r["kind"]].append((r["text"], [tuple(map(int, s.split(":"))) for s in r["spans"].split()]))
    return [row for kind in sorted(by_kind) for row in by_kind[kind][:size]]


def varied(kind: int, value: str, rng: random.Random) -> str:
    """A value of the same kind in a form that the fixed patterns don't know."""
    if kind == 0:
        user, _, host = value.partition("@")
        at, dot = rng.choice(["(at)", "[at]", " (at) ", " [at] "]), rng.choice([".", ".", "[dot]", " [dot] ", "(dot)"])
        return user + at + host.replace(".", dot)
    digits = _NO_DIGIT.sub("", value)
    if kind == 1:
        return rng.choice(["[.]", "(.)"]).join(value.split("."))
    if kind == 2:
        return rng.choice([".", "/", " - "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    own = "".join(rng.choice("23456789") if i % 3 == 0 else rng.choice("0123456789") for i in range(10))
    a, b, c = own[:3], own[3:6], own[6:]
    lead = rng.choice(["", "", "", "1-", "1 ", "001 ", "0"])
    return lead + rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"({a}) {b} {c}", f"({a}){b}-{c}"])


def misleading(rng: random.Random) -> str:
    """Numbers that are no personal data: dates, prices, book numbers, versions, measures, plain and grouped numbers."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    year = str(rng.randrange(1900, 2030))
    return rng.choice(
        [year, f"{year}-0{rng.randrange(1, 9)}-1{d(1)}", f"1{d(1)}.0{rng.randrange(1, 9)}.{year}", f"{year}-0{rng.randrange(1, 9)}-1{d(1)} 1{d(1)}:{rng.randrange(10, 59)}:00", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(3)},{d(3)},{d(3)}", f"{d(3)} {d(3)} {d(3)} {d(3)}"]
        + [f"{d(2)}.{d(2)}", f"v{d(1)}.{d(1)}.{d(2)}", f"{d(1)}.{d(1)}.{d(1)}", f"{d(rng.randrange(1, 9))}", d(16), d(11), f"${d(3)}.{d(2)}", f"{year}-{int(year) + 4}", f"#{d(6)}", f"{d(4)}-{d(4)}-{d(4)}", f"{d(1)}.{d(9)}", f"[{d(2)}]", f"@{d(3)}", "@", "user @ home"]
    )


def windows_of(rows: list[tuple[str, list[tuple[int, int, int]]]], seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels to learn from: each row as it stands, with its spans in other forms, and with misleading numbers in their places. Some rows lose what stands before or behind."""
    rng, chars, gold = random.Random(seed), [], []

    def add(text: str, spans: list[tuple[int, int, int]]) -> None:
        first, last = (min(s for s, _, _ in spans), max(e for _, _, e in spans)) if spans else (len(text) // 2, len(text) // 2)
        if rng.random() < 0.3:
            start = rng.randrange(0, first + 1)
            text, spans, last = text[start:], [(s - start, k, e - start) for s, k, e in spans], last - start
        if rng.random() < 0.3:
            text = text[: rng.randrange(last, len(text) + 1)]
        shift = rng.randrange(0, max(len(text) - WINDOW, 0) + 1)
        own, labels = np.zeros(WINDOW, np.uint8), np.zeros(len(text), np.int64)
        for s, k, e in spans:
            labels[s:e] = 2 * k + 2
            labels[s] = 2 * k + 1
        cut = labels[shift : shift + WINDOW]
        if len(cut) and cut[0] and cut[0] % 2 == 0:
            cut[0] -= 1  # the window begins inside
        whole = np.zeros(WINDOW, np.int64)
        whole[: len(cut)] = cut
        own[: len(cut)] = codes(text[shift : shift + WINDOW])
        chars.append(own)
        gold.append(whole.astype(np.int8))

    def replaced(text: str, spans: list[tuple[int, int, int]], value) -> tuple[str, list[tuple[int, int, int]]]:
        out, made, last = "", [], 0
        for s, k, e in sorted(spans):
            if s >= last:  # of two kinds at one place the first
                out += text[last:s]
                new = value(k, text[s:e])
                made.append((len(out), k, len(out) + len(new)))
                out += new
                last = e
        return out + text[last:], made

    for text, spans in rows:
        add(text, spans)
        if spans:
            add(*replaced(text, spans, lambda k, v: varied(k, v, rng)))
            add(replaced(text, spans, lambda k, v: misleading(rng))[0], [])
        else:
            middle = len(text) // 2
            for _ in range(2):
                add(f"{text[:middle]} {misleading(rng)} {text[middle:]}", [])
    return np.array(chars, np.uint8).reshape(-1, WINDOW), np.array(gold, np.int8).reshape(-1, WINDOW)


def learn(docs: DataFrame, text: str = "text", size: int = SAMPLE, epochs: int = 5) -> Tagger | None:
    """A tagger from the labelled spans of a sample of all texts; none if the texts hold no span. It is trained in one task, since the sample is bounded."""
    rows = sample_spans(docs, text, size)
    if not any(spans for _, spans in rows):
        return None
    spark, held = docs.sparkSession, pickle.dumps(windows_of(rows))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for windows in b["held"].to_pylist():
                tagger = Tagger(len(KINDS))
                tagger.train(*pickle.loads(windows), epochs=epochs)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tagger.w)], pa.binary())], names=["held"])

    (trained,) = spark.createDataFrame([(held,)], "held binary").coalesce(1).mapInArrow(train, "held binary").collect()
    tagger = Tagger(len(KINDS))
    tagger.w = pickle.loads(bytes(trained["held"]))
    return tagger


# --- finding


def accepted(text: str, start: int, kind: int, end: int) -> tuple[int, int] | None:
    """The part of a tagged span that has the shape of its kind, or none. What surrounds it must not carry it on."""
    value = text[start:end]
    if kind == 0:
        whole = DOT.sub(".", AT.sub("@", value))
        return (start, end) if whole.count("@") == 1 and base_spans(whole) == [(0, 0, len(whole))] else None
    edge = "()[] .-/" if kind != 3 else " .-/"
    start, end = start + len(value) - len(value.lstrip(edge)), end - len(value) + len(value.rstrip(edge))
    value = text[start:end]
    if not value or not (value[0].isdigit() or value[0] in "(+") or not value[-1].isdigit() or text[max(start - 1, 0) : start].isalnum() or text[end : end + 1].isalnum():
        return None
    digits = _NO_DIGIT.sub("", value)
    if kind == 1:
        return (start, end) if is_ip(DOT.sub(".", value).split(".")) else None
    if kind == 2:
        return (start, end) if 12 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9](?:[ ./-]{0,3}[0-9])+", value) else None
    if value[0].isdigit() and len({len(g) for g in re.findall("[0-9]+", value)}) == 1:
        return None  # groups of one length are a serial number
    return (start, end) if 10 <= len(digits) <= 15 and re.fullmatch(r"\+?(?:[0-9]{1,4}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,5}(?:[ .-][0-9]{2,5}){1,4}", value) else None


def reconcile(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Spans (start, kind, end, score) of all windows as one set without overlaps, of the greatest sum of scores.

    Of one kind, overlapping spans of neighbouring windows become one first, with the greater score: each window sees a part.
    """
    joined: list[tuple[int, int, int, float]] = []
    for s, k, e, x in sorted(spans, key=lambda r: (r[1], r[0], r[2])):
        if joined and joined[-1][1] == k and s < joined[-1][2]:
            s, _, f, y = joined.pop()
            e, x = max(e, f), max(x, y)
        joined.append((s, k, e, x))
    joined.sort(key=lambda r: (r[2], r[0], r[1]))
    ends = [e for _, _, e, _ in joined]
    best, take = [0.0], []
    for i, (s, _, _, x) in enumerate(joined):
        other = best[bisect_right(ends, s, 0, i)] + x
        take.append(other > best[-1])
        best.append(max(best[-1], other))
    out, i = [], len(joined)
    while i:
        i -= 1
        if take[i]:
            out.append(joined[i][:3])
            i = bisect_right(ends, joined[i][0], 0, i)
    return out[::-1]


class Finder:
    """Spans of texts: all texts' windows are tagged together."""

    def __init__(self, tagger: Tagger | None):
        self.tagger = tagger

    def tagged(self, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
        """For each text, spans and scores of all its windows that hold a trigger. Long texts are cut into windows as they come."""
        out, rows, owner = [[] for _ in texts], [], []

        def flush() -> None:
            if rows:
                labels, lead = self.tagger.decode(np.stack(rows))
                for r, at in zip(*np.nonzero(labels % 2), strict=True):  # begins
                    k, own = (labels[r, at] - 1) // 2, labels[r]
                    stop = at + 1 + int(np.argmin(np.append(own[at + 1 :] == 2 * k + 2, False)))
                    i, base = owner[r]
                    out[i].append((base + int(at), int(k), min(base + stop, len(texts[i])), float(lead[r, at:stop].sum())))
                rows.clear()
                owner.clear()

        for i, t in enumerate(texts):
            last = -1
            for m in TRIGGER.finditer(t):
                own = m.start() // STEP
                for k in range(max(own - WINDOW // STEP + 1, last + 1, 0), own + 1):
                    row = np.zeros(WINDOW, np.uint8)
                    part = codes(t[k * STEP : k * STEP + WINDOW])
                    row[: len(part)] = part
                    rows.append(row)
                    owner.append((i, k * STEP))
                    last = k
                if len(rows) >= ROWS:
                    flush()
        flush()
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int, bool]]]:
        """(start, kind number, end, whether of a fixed pattern) of each text, sorted by start and kind."""
        base = [base_spans(t) for t in texts]
        if self.tagger is None:
            return [[(s, k, e, True) for s, k, e in own] for own in base]
        out = []
        for t, own, tagged in zip(texts, base, self.tagged(texts), strict=True):
            starts, ends = [s for s, _, _ in own], [0, *accumulate((e for _, _, e in own), max)]
            free = []
            for s, k, e in reconcile(tagged):
                # fixed spans stay as they are: what overlaps one is left out
                if (got := accepted(t, s, k, e)) and ends[bisect_left(starts, got[1])] <= got[0]:
                    free.append((got[0], k, got[1], False))
            out.append(sorted([(s, k, e, True) for s, k, e in own] + free))
        return out


def find_personal_data(docs: DataFrame, text: str = "text", out: str = "spans", tagger: Tagger | None = None, carry: list[str] | None = None) -> DataFrame:
    """Adds ``out``: spans (kind, start, end, base) of every whole text, by start, then kind; code points, end exclusive.

    base tells the spans of the fixed patterns from those that the tagger adds; without a tagger there are only the former.
    Null or empty text: no span. The columns ``carry`` stay (all unless given); an existing column ``out`` is replaced. Rows are never
    dropped, repeated rows stay repeated, an empty table stays one. Of a very long text only windows around digits and at signs are tagged.
    """
    keep = [c for c in (docs.columns if carry is None else carry) if c != out]
    schema = StructType([docs.schema[c] for c in keep]).add(out, SPAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, kind = Finder(tagger), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for b in pieces(batches, text):
            hot = pc.match_substring_regex(b[text], "(?i)[0-9@]|[(\\[]at[)\\]]").fill_null(False).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(hot)
            found = dict(zip(at.tolist(), finder.spans(b[text].take(pa.array(at)).to_pylist()), strict=True))
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "base": own} for s, k, e, own in found.get(i, ())] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array(rows, kind)], names=[*keep, out])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def digest(spans: Column) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
