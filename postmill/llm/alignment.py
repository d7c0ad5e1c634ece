"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, by distinct segments.

Texts are cut before white space where neither vocabulary can merge across, as a look at all their entries shows. Most
segments repeat, so each distinct one is tokenized and aligned once, and its alignment is stored under its hash in sorted
arrays that workers memory-map. Documents are composed from the alignments of their segments. Between two places where
tokens of both sides end lies a group; tokens of the two sides are linked if they share one.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType, _parse_datatype_string

from postmill.llm.fim import utf8
from postmill.llm.shared import TALLY, HashShards, Tally, pieces, read_tally, shard_of, shared_dir, shards_of, to_shards

#: White space for any of the two libraries, or near it: no cut is made behind such a character.
SPACE = "\\s\u180e\u200b\ufeff"
#: Segments that are tokenized at a time, and characters.
BATCH, BATCH_CHARS = 20_000, 1 << 20
#: Distinct segments that a task remembers as sent.
SENT = 1_000_000
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def byte_of_letter() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """The byte-level vocabulary A and the piece vocabulary B, the bytes of their entries, and where texts can be cut."""

    def __init__(self, a_path: str | None = None, b_path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path or public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path or public_tokenizers.path("piece_bpe_32k.model"))
        letters = byte_of_letter()
        names = {i: name for name, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(letters[c] for c in names[i]) if i in names else b"" for i in range(max(names) + 1)]
        shown = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(shown)]
        self.blank = self.b.piece_to_id("▁")
        # a cut before c needs that no entry holds c behind a character that is no white space; c other than a blank may stand behind
        # none at all, so that the blank that B puts first can be taken off again
        entries = [e.decode(errors="replace") for e in self.a_bytes + self.b_bytes]
        joined = {m for e in entries for m in re.findall(rf"[^{SPACE}]([ \n\t])", e)} | {m for p in self.b_bytes for m in re.findall(r"(?s).([\n\t])", p.decode(errors="replace"))}
        self.cuts = "".join(c for c in " \n\t" if c not in joined)
        self.segment = re.compile(rf"[{re.escape(self.cuts)}][{SPACE}]*[^{SPACE}]*(?:(?![{re.escape(self.cuts)}])[{SPACE}]+[^{SPACE}]*)*" if " " in self.cuts else r"(?s).+")

        # characters that a text must not hold if its segments are to be parted by its blanks and line ends alone
        other = [c for c in map(chr, range(0x10000)) if re.match(f"[{SPACE}]", c) and c not in " \n"]
        self.other = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in other) + "]" if {" ", "\n"} <= set(self.cuts) else ""

    def segments(self, text: str | None) -> list[str]:
        """Of a blank and the text, in order. Null or empty: none."""
        return self.segment.findall(f" {text}") if text else []

    def plain(self, texts: pa.Array) -> np.ndarray:
        """Whether all white space of each text is single blanks and line ends, the first not at its start. Empty texts are not plain."""
        odd = pc.match_substring_regex(texts, self.other)
        for run in ("  ", "\n\n", " \n", "\n "):
            odd = pc.or_(odd, pc.match_substring(texts, run))
        return ~pc.or_(odd, pc.match_substring_regex(texts, r"\A(?:[ \n]|\z)")).to_numpy(zero_copy_only=False)

    def _b_ids(self, segments: list[str]) -> list[list[int]]:
        # B puts a blank before what it encodes
        own = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        return [[self.blank] if s == " " else ids if s[0] == " " else ids[1:] for s, ids in zip(segments, own, strict=True)]

    def align(self, segments: list[str]) -> Aligned:
        """The alignments of segments. One whose tokens do not give back its bytes has no tokens."""
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        b = self._b_ids(segments)
        for i, s in enumerate(segments):
            raw = s.encode()
            if b"".join(map(self.a_bytes.__getitem__, a[i])) != raw or b"".join(map(self.b_bytes.__getitem__, b[i])) != raw:
                a[i] = b[i] = []
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (a, b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (a, b))
        if not len(ids_a):
            nothing = np.empty(0, np.int64)
            return Aligned(n_a, n_b, n_a, np.zeros(len(a) + 1, np.int64), b"", np.zeros(len(a) + 1, np.int64), nothing.astype(np.uint64), nothing)
        # bytes of all segments end to end: both sides agree on the ends of segments
        ends_a, ends_b = (np.cumsum(np.array([len(table[i]) for i in ids.tolist()], np.int64)) for table, ids in ((self.a_bytes, ids_a), (self.b_bytes, ids_b)))
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        segment_of = np.empty(len(common), np.int64)
        segment_of[group_a] = np.repeat(np.arange(len(a)), n_a)
        n_groups = np.bincount(segment_of, minlength=len(a))
        # tokens of A, then of B, group by group, each with the mark that follows it
        key = np.concatenate([2 * group_a, 2 * group_b + 1])
        order = np.argsort(key, kind="stable")
        key, ids = key[order], np.concatenate([ids_a, ids_b])[order]
        last = np.append(key[1:] != key[:-1], True)
        mark = np.where(last, np.where(key & 1, ";", "|"), ",").tolist()
        shown = [f"{i}{m}" for i, m in zip(ids.tolist(), mark, strict=True)]
        width = np.bincount(segment_of[key >> 1], np.fromiter(map(len, shown), np.int64, len(shown)), len(a)).astype(np.int64)
        pairs, at, times = links(ids_a, group_a, ids_b, group_b, segment_of, len(a))
        return Aligned(n_a, n_b, n_groups, np.append(0, np.cumsum(width)), "".join(shown).encode(), at, pairs, times)


@dataclass
class Aligned:
    """Alignments of segments: counts, the groups as text with a semicolon behind each, and the linked id pairs with their occurrences."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    text_at: np.ndarray
    text: bytes
    pair_at: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for a pair of ids; all pairs of one A id are neighbours, and A ids are spread over the number range."""
    spread = a.astype(np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)  # one to one, as the factor is odd
    return spread << np.uint64(32) | b.astype(np.uint64)


def expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each row, count of them."""
    ends = np.cumsum(count)
    return np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def links(ids_a: np.ndarray, group_a: np.ndarray, ids_b: np.ndarray, group_b: np.ndarray, segment_of: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct linked pairs of each segment, where each segment's start, and how many token pairs each stands for.

    Ids are counted within their group first, so a token that repeats in a long group is not multiplied out.
    """
    one, times_a = np.unique(group_a << 32 | ids_a, return_counts=True)
    two, times_b = np.unique(group_b << 32 | ids_b, return_counts=True)
    group_one, groups = one >> 32, np.arange(len(segment_of))
    first, upto = np.searchsorted(two >> 32, groups), np.searchsorted(two >> 32, groups, side="right")
    count = (upto - first)[group_one]
    other = expand(first[group_one], count)
    keys = pair_key(np.repeat(one & 0xFFFFFFFF, count), two[other] & 0xFFFFFFFF)
    times = np.repeat(times_a, count) * times_b[other]
    distinct, code = np.unique(keys, return_inverse=True)
    held, back = np.unique(np.repeat(segment_of[group_one], count) << 32 | code, return_inverse=True)
    return distinct[held & 0xFFFFFFFF], np.searchsorted(held >> 32, np.arange(segments + 1)), np.bincount(back, times, len(held)).astype(np.int64)


_held: dict[tuple[str | None, str | None], Vocabularies] = {}


def vocabularies(a_path: str | None = None, b_path: str | None = None) -> Vocabularies:
    """Loaded once in a process."""
    if (a_path, b_path) not in _held:
        _held[a_path, b_path] = Vocabularies(a_path, b_path)
    return _held[a_path, b_path]


def _short(segment: str) -> str:
    """A segment without its blank, unless white space follows that; such a one has a blank more."""
    return segment if segment[0] in "\n\t" else f" {segment}" if segment[1:2] in (" ", "\n", "\t") else segment[1:]


def _whole(short: pa.Array) -> pa.Array:
    """The segments of short ones."""
    with_blank = pc.binary_join_element_wise(pa.scalar(" ", short.type), short, pa.scalar("", short.type))
    special = pc.match_substring_regex(short, r"\A[ \n\t]")
    return pc.if_else(special, pc.replace_substring_regex(short, r"\A ", ""), with_blank) if pc.any(special).as_py() else with_blank


def coded(texts: pa.Array, v: Vocabularies) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct segments of all texts, the number of each segment in order, and how many each text has.

    Texts whose words stand at single blanks and line ends, as most do, are parted by them all together; only others need the pattern.
    """
    texts = pc.fill_null(texts, "")
    plain = v.plain(texts)
    lists = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(plain)), "\n", " \n"), " ")
    odd = [[_short(s) for s in v.segments(t)] for t in texts.filter(pa.array(~plain)).to_pylist()]
    counts = np.zeros(len(texts), np.int64)
    counts[plain] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    counts[~plain] = [len(x) for x in odd]
    both = pa.concat_arrays([lists.flatten(), pa.array(list(chain.from_iterable(odd)), texts.type)]).dictionary_encode()
    # plain texts come first there, in their order
    start = np.empty(len(texts), np.int64)
    rows = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
    start[rows] = np.cumsum(counts[rows]) - counts[rows]
    order = both.indices.to_numpy(zero_copy_only=False).astype(np.int64)[expand(start, counts)]
    return _whole(both.dictionary), order, counts


def hashes(segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each as two halves."""
    raw, ends = utf8(segments)
    whole, at = memoryview(raw), ends.tolist()
    digests = [xxhash.xxh3_128_digest(whole[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    both = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64) if digests else np.empty((0, 2), np.uint64)
    return both[:, 0], both[:, 1]


_opened: dict[tuple, HashShards] = {}


def opened(held: HashShards) -> HashShards:
    """The same store as earlier tasks of this process used, whose files are mapped already."""
    return _opened.setdefault((held.folder, held.name, held.present), held)


class Store(HashShards):
    """Alignments by hash. Shards are sorted by both halves; a lookup finds the first and steps on while the second differs."""

    def places(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The shard and the place there of each segment. All must be stored."""
        high, low = hashes(segments)
        order = np.argsort(high, kind="stable")
        shard, place = np.full(len(high), -1, np.int64), np.zeros(len(high), np.int64)
        for s, i, p in self.find(high[order]):
            keys, own = self.array("keys", s), self.array("low", s)
            i, p = order[i], p.astype(np.int64)
            wrong = np.flatnonzero(own[p] != low[i])
            while len(wrong):
                p[wrong] += 1
                at = np.minimum(p[wrong], len(keys) - 1)
                wrong = wrong[(keys[at] == high[i[wrong]]) & (own[at] != low[i[wrong]])]
            p = np.minimum(p, len(keys) - 1)
            good = (keys[p] == high[i]) & (own[p] == low[i])
            shard[i[good]], place[i[good]] = s, p[good]
        if (shard < 0).any():
            raise LookupError("a segment is not in the store; the shared folder lacks rows or the input has changed")
        return shard, place

    def each(self, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The shards that occur, with the numbers of the segments there."""
        order = np.argsort(shard, kind="stable")
        edge = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(edge)).tolist():
            yield s, order[edge[s] : edge[s + 1]]

    def values(self, what: str, shard: np.ndarray, place: np.ndarray, rows: int) -> np.ndarray:
        """The first rows of a table of each shard, by segment."""
        out = np.zeros((rows, len(shard)), np.int64)
        for s, i in self.each(shard):
            out[:, i] = self.array(what, s)[:rows, place[i]]
        return out

    def pairs(self, shard: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct linked pairs of the segments end to end, ordered by segment, and how many each has."""
        keys, owner = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for s, i in self.each(shard):
            at = self.array("pair_at", s)
            first, n = at[place[i]], at[place[i] + 1] - at[place[i]]
            keys.append(self.array("pairs", s)[expand(first, n)])
            owner.append(np.repeat(i, n))
        owner = np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(keys)[order], np.bincount(owner, minlength=len(shard))

    def texts(self, shard: np.ndarray, place: np.ndarray) -> list[bytes]:
        out = [b""] * len(shard)
        for s, i in self.each(shard):
            at, raw = self.array("text_at", s), self.array("text", s)
            for k, p in zip(i.tolist(), place[i].tolist(), strict=True):
                out[k] = raw[at[p] : at[p + 1]].tobytes()
        return out


@dataclass
class Alignments:
    """Where the aligned segments lie, and what aligned them."""

    segments: Store
    a_path: str | None
    b_path: str | None


def align_segments(docs: DataFrame, text: str = "text", a_path: str | None = None, b_path: str | None = None) -> Alignments:
    """Tokenizes and aligns each distinct segment of all texts once, and counts for each id pair the documents that hold it linked.

    Three jobs: distinct segments meet in the shard of their hash and are aligned there; documents count their distinct
    pairs, which meet by A id; each shard of segments adds up its links. What a task holds is one shard or one batch.
    """
    spark = docs.sparkSession
    folder, shards = shared_dir(spark, "alignment"), shards_of(spark)
    texts = docs.select(F.col(text).alias("text"))
    store, pairs = Store(folder, "segment", shards), HashShards(folder, "pair", shards)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, sent = vocabularies(a_path, b_path), set()
        for b in pieces(batches, "text"):
            segments = coded(b["text"], v)[0]
            high = hashes(segments)[0]
            new = [i for i, h in enumerate(high.tolist()) if h not in sent]
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(shard_of(high[new], shards)), segments.take(pa.array(new)).cast(pa.string())], names=["shard", "segment"])
            if len(sent) + len(new) > SENT:
                sent.clear()
            sent.update(high[new].tolist())

    def write_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, held, rows, s = vocabularies(a_path, b_path), [], 0, -1
        for b in batches:
            if b.num_rows:
                held.append(b["segment"])
                rows, s = rows + b.num_rows, b["shard"][0].as_py()
            if rows > SENT:
                held = [pa.chunked_array(held).unique()]
                rows = len(held[0]) // 2  # so that what is new is a good part of what is sorted out next
        if s < 0:
            return
        own = pa.chunked_array(held).unique()
        high, low = hashes(own)
        order = np.lexsort((low, high))
        segments = own.take(pa.array(order)).to_pylist()
        parts, i = [], 0
        while i < len(segments):
            j, held = i, 0
            while j < len(segments) and j - i < BATCH and (j == i or held + len(segments[j]) <= BATCH_CHARS):
                held += len(segments[j])
                j += 1
            parts.append(v.align(segments[i:j]))
            i = j
        ends = lambda what: np.append(0, np.cumsum(np.concatenate([np.diff(getattr(p, what)) for p in parts])))
        whole = lambda what: np.concatenate([getattr(p, what) for p in parts])
        store.write(s, low=low[order], counts=np.stack([whole(c) for c in SUMS[:3]]).astype(np.uint32))
        store.write(s, text_at=ends("text_at"), text=np.frombuffer(b"".join(p.text for p in parts), np.uint8), pair_at=ends("pair_at"), pairs=whole("pairs"), times=whole("times").astype(np.uint32))
        store.write(s, keys=high[order])
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32())], names=["shard"])

    made = to_shards(texts.mapInArrow(distinct, "shard int, segment string"), shards).mapInArrow(write_segments, "shard int").collect()
    store.present = frozenset(r["shard"] for r in made)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, tally, held_segments = vocabularies(a_path, b_path), Tally(shards), opened(store)
        for b in pieces(batches, "text"):
            segments, order, counts = coded(b["text"], v)
            if not len(segments):
                continue
            shard, place = held_segments.places(segments)
            keys, n = held_segments.pairs(shard, place)
            distinct_keys, code = np.unique(keys, return_inverse=True)
            whole = usable(held_segments.values("counts", shard, place, 3)[2][order], counts)
            doc = np.repeat(np.arange(len(counts)), counts)
            held = np.unique((doc << 32 | order)[whole[doc]])  # each segment of a document once
            segment = held & 0xFFFFFFFF
            start = np.cumsum(n) - n
            linked = np.unique(np.repeat(held >> 32, n[segment]) << 32 | code[expand(start[segment], n[segment])])
            yield from tally.add(distinct_keys, np.bincount(linked & 0xFFFFFFFF, minlength=len(distinct_keys)))
        yield from tally.flush()

    def write_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, keys, counts = read_tally(batches)
        if s < 0:
            return
        first = np.flatnonzero(np.append(True, np.diff(keys >> np.uint64(32)) > 0))
        best = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(keys))))
        pairs.write(s, count=counts.astype(np.uint64), best=best == counts)
        pairs.write(s, keys=keys)
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32())], names=["shard"])

    counted = to_shards(texts.mapInArrow(count_pairs, TALLY), shards).mapInArrow(write_pairs, "shard int").collect()
    pairs.present = frozenset(r["shard"] for r in counted)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b["shard"].to_pylist():
                at, times = store.array("pair_at", s), store.array("times", s).astype(np.int64)
                keys, code = np.unique(store.array("pairs", s), return_inverse=True)
                count, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
                for t, i, p in pairs.find(keys):
                    count[i], best[i] = pairs.array("count", t)[p], pairs.array("best", t)[p]
                linked = [np.diff(np.append(0, np.cumsum(value))[at]) for value in (times, times * best[code], times * count[code])]
                store.write(s, sums=np.concatenate([store.array("counts", s).astype(np.int64), np.stack(linked)]))
            yield b

    todo = spark.createDataFrame([(s,) for s in sorted(store.present)], "shard int")
    done = {r["shard"] for r in to_shards(todo, shards).mapInArrow(add_up, "shard int").collect()}
    if done != store.present:
        raise OSError(f"{folder} lacks files that workers wrote; it must be shared by driver and executors")
    return Alignments(store, a_path, b_path)


def usable(groups: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether all segments of each text have groups, from those of its segments in order."""
    bad = np.append(0, np.cumsum(groups == 0))
    ends = np.cumsum(counts)
    return bad[ends] == bad[ends - counts]


def align(docs: DataFrame, text: str = "text", alignments: Alignments | None = None, a_path: str | None = None, b_path: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """Adds n_a, n_b (tokens), n_groups, n_links, n_best, count_sum and groups to the columns ``carry`` (all unless given).

    groups lists ``a1,a2|b1`` for each group, parted by semicolons. A null or empty text, and one that the tokens of either
    side do not give back, has no tokens: zeros and an empty string. Such a text counts in no pair. Repeated rows are separate documents.
    Columns with the names of new ones are replaced. An empty table stays one. A text without white space is one segment, however long.
    """
    a = alignments or align_segments(docs, text, a_path, b_path)
    made = StructType(_parse_datatype_string(", ".join(f"{c} bigint" for c in SUMS)).fields).add("groups", StringType())
    keep = [c for c in (docs.columns if carry is None else carry) if c not in made.names]
    schema = StructType([docs.schema[c] for c in keep] + made.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, store = vocabularies(a.a_path, a.b_path), opened(a.segments)
        for b in pieces(batches, text):
            segments, order, counts = coded(b[text], v)
            shard, place = store.places(segments)
            ends = np.cumsum(counts)
            values = store.values("sums", shard, place, len(SUMS))
            whole, cols = usable(values[2][order], counts), []
            for value in values:
                upto = np.append(0, np.cumsum(value[order]))
                cols.append(pa.array(np.where(whole, upto[ends] - upto[ends - counts], 0)))
            shown, numbers = store.texts(shard, place), order.tolist()
            groups = [b"".join([shown[i] for i in numbers[e - n : e]])[:-1] if ok else b"" for e, n, ok in zip(ends.tolist(), counts.tolist(), whole.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], *cols, pa.array(groups, pa.binary()).cast(pa.string())], names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
