"""Hourly counts of the 1- to 3-grams of whole texts, of which only the frequent ones ever travel as strings.

A text has more grams than bytes, so they are counted in two passes. The first adds up 40-bit hashes of hour and term, packed, and keeps
those that reach the bound: every frequent term is among them. The second counts the terms themselves that have such a hash, by hour
and category; the exact sums decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions import terms as K
from postmill.functions import text as T
from postmill.functions.times import hour_of
from postmill.llm.shared import BATCH_BYTES, TALLY, HashShards, Tally, mix, pieces, read_tally, shard_of, shards_of, shared_dir, ship, to_shards
from postmill.operators.trends import with_totals

#: The hashes' bits that count, and the least number of files that the frequent ones are kept in.
BITS, SHARDS = np.uint64(0xFFFFFFFFFF000000), 128
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _hash(words: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(words, categorize=False) if len(words) else np.empty(0, np.uint64)


def _runs_of_equal(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of sorted keys, and how often each stands."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)])


def parted(texts: pa.Array) -> pa.Array:
    """All words of texts, and a line feed for each line break, with blanks between: what terms.runs() cuts, as one string."""
    for pattern, by in ((K.URL, " http "), (r"[^\pL\pN\n\r]+", " "), (r"[\r\n]+", " \n ")):
        texts = pc.replace_substring_regex(pc.utf8_lower(texts) if pattern == K.URL else texts, pattern, by)
    return texts


def _kept(words: pa.Array) -> np.ndarray:
    """Which words make terms, as terms.runs() says."""
    size, number = pc.utf8_length(words), pc.match_substring_regex(words, r"^\pN+$")
    dropped = pc.or_(pc.and_(number, pc.greater_equal(size, 8)), pc.match_substring_regex(words, r"^(?:http|www)"))
    idle = pc.is_in(words, value_set=pa.array([*K.STOPWORDS_VI, *K.STOPWORDS_EN, "", "\n"]))
    return pc.and_(pc.or_(pc.greater_equal(size, 2), number), pc.invert(pc.or_(dropped, idle))).to_numpy(zero_copy_only=False)


@dataclass
class Grams:
    """The grams of some texts by number: words, pairs, triples, then names that aliases lead to. Texts have each once (text, gram)."""

    words: pa.Array
    pairs: np.ndarray  # first word * words + second
    triples: np.ndarray  # pair * words + third
    names: list[str]
    hashes: np.ndarray
    text: np.ndarray
    gram: np.ndarray

    def shown(self, ids: np.ndarray) -> pa.Array:
        """The grams of sorted numbers as strings."""
        v, p = len(self.words), len(self.pairs)
        one, two, three, name = np.split(ids, np.searchsorted(ids, [v, v + p, v + p + len(self.triples)]))
        join = lambda *at: pc.binary_join_element_wise(*[self.words.take(pa.array(a)) for a in at], " ")
        pair, triple = self.pairs[two - v], self.triples[three - v - p]
        head = self.pairs[triple // v] if len(triple) else triple
        names = pa.array([self.names[i] for i in name - v - p - len(self.triples)], pa.string())
        return pa.concat_arrays([self.words.take(pa.array(one)), join(pair // v, pair % v), join(head // v, head % v, triple % v), names])


def grams_of(texts: pa.Array, aliases: dict[str, str | None]) -> Grams:
    """The grams of texts, after merging and dropping by alias; lengths as for term_ngrams()."""
    split = pc.split_pattern(parted(texts), " ")
    coded, text = pc.list_flatten(split).dictionary_encode(), pc.list_parent_indices(split).to_numpy(zero_copy_only=False).astype(np.int64)
    known, code = coded.dictionary.cast(pa.string()), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.not_equal(known, "").to_numpy(zero_copy_only=False)[code]
    code, text, v = code[full], text[full], len(known)
    ok = _kept(known)[code]
    size, own = pc.utf8_length(known).to_numpy(zero_copy_only=False).astype(np.int64), _hash(known.to_numpy(zero_copy_only=False))

    # neighbours of one run: both kept, and no dropped word or line break between
    two = np.flatnonzero(ok[:-1] & ok[1:] & (text[:-1] == text[1:]))
    pairs, at = np.unique(code[two] * v + code[two + 1], return_inverse=True)
    begins = np.full(len(code) + 1, -1, np.int64)
    begins[two] = at
    three = two[begins[two + 1] >= 0]
    triples, last = np.unique(begins[three] * v + code[three + 2], return_inverse=True)
    p, one = len(pairs), np.flatnonzero(ok)
    gram, text = np.concatenate([code[one], at + v, last + v + p]), np.concatenate([text[one], text[two], text[three]])

    if v:
        pair_size, pair_hash = size[pairs // v] + 1 + size[pairs % v], mix(mix(own[pairs // v]) * FACTOR + own[pairs % v])
        lengths = np.concatenate([size, pair_size, pair_size[triples // v] + 1 + size[triples % v]])
        hashes = np.concatenate([mix(own), pair_hash, mix(pair_hash[triples // v] * FACTOR + own[triples % v])])
    else:
        lengths, hashes = size, own

    parts = list({w for name in (*aliases, *aliases.values()) if name is not None for w in name.split(" ")})
    place = dict(zip(parts, pc.index_in(pa.array(parts, pa.string()), value_set=known).to_pylist(), strict=True))

    def number(name: str) -> int | None:
        """The gram of that name, if the texts have it."""
        at = [place.get(w) for w in name.split(" ")]
        if len(at) > 3 or None in at:
            return None
        if len(at) == 1:
            return at[0]
        found = _place(pairs, at[0] * v + at[1])
        if len(at) == 2 or found is None:
            return None if found is None else v + found
        found = _place(triples, found * v + at[2])
        return None if found is None else v + p + found

    to, names = np.where((lengths >= 2) & (lengths <= K.MAX_TERM), np.arange(len(lengths)), -1), []
    moved = [(n, into) for term, into in aliases.items() if (n := number(term)) is not None and to[n] >= 0]
    for n, into in moved:
        own_number = None if into is None else number(into)
        if into is not None and own_number is None:
            if into not in names:
                names.append(into)
            own_number = len(lengths) + names.index(into)
        to[n] = -1 if own_number is None else own_number
    hashes = np.concatenate([hashes, _named(names)])
    gram = to[gram]
    text, gram = text[gram >= 0], gram[gram >= 0]
    each, _ = _runs_of_equal(np.sort(text * len(hashes) + gram))
    text, gram = np.divmod(each, max(1, len(hashes)))
    return Grams(known, pairs, triples, names, hashes, text, gram)


def _place(keys: np.ndarray, key: int) -> int | None:
    i = int(np.searchsorted(keys, key))
    return i if i < len(keys) and keys[i] == key else None


def _named(names: list[str]) -> np.ndarray:
    """The hashes that names have as grams."""
    out = np.zeros(len(names), np.uint64)
    for i, name in enumerate(names):
        first, *rest = _hash(np.array(name.split(" "), object))
        h = mix(np.array([first], np.uint64))
        for w in rest:
            h = mix(h * FACTOR + w)
        out[i] = h[0]
    return out


@dataclass
class Hours:
    """The grams of a batch by hour: which hours there are, of each gram of an hour the place of the hour, the gram's number and its texts, and the entry of each (text, gram)."""

    hours: pa.Array
    at: np.ndarray
    gram: np.ndarray
    n: np.ndarray
    entry: np.ndarray
    hashes: np.ndarray


def by_hour(ts: pa.Array, found: Grams) -> Hours:
    coded = ts.dictionary_encode("encode")
    place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(1, len(found.hashes))
    each = place[found.text] * width + found.gram
    order = np.argsort(each)
    keys, n = _runs_of_equal(each[order])
    entry = np.empty(len(each), np.int64)
    entry[order] = np.repeat(np.arange(len(keys)), n)
    at, gram = np.divmod(keys, width)
    seeds = mix(pc.fill_null(coded.dictionary.cast(pa.int64()), -1).to_numpy(zero_copy_only=False).astype(np.uint64))
    return Hours(coded.dictionary, at, gram, n, entry, mix(found.hashes[gram] + seeds[at]) & BITS)


def frequent_counts(posts: DataFrame, aliases: DataFrame, least: int) -> DataFrame:
    """What trends.term_counts() tells of the 1- to 3-grams of posts (id, text, first_seen_at, category_id), of at least ``least`` posts.

    aliases (term, into) is a small dimension with each term once. Texts of one id count as one post.
    """
    spark = posts.sparkSession
    ship(spark)
    into = {r["term"]: r["into"] for r in aliases.collect()}
    named = posts.select("id", "text", hour_of("first_seen_at").alias("ts"), "category_id")
    again = named.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("same"))
    if again.limit(1).count():
        # a line break ends a run, so texts that are put together have the grams of each
        alike = F.col("id").eqNullSafe(F.col("same"))
        together = named.join(again, alike, "left_semi").groupBy("id", "ts", "category_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
        named = named.join(again, alike, "left_anti").unionByName(together)
    texts = named.select("ts", "category_id", T.compose(F.coalesce("text", F.lit(""))).alias("text"))
    folder, shards = shared_dir(spark, "terms"), max(SHARDS, shards_of(spark))
    held = HashShards(folder, "frequent", shards)

    def count_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(shards)
        for b in pieces(batches, "text", BATCH_BYTES):
            hours = by_hour(b["ts"], grams_of(b["text"], into))
            yield from tally.add(hours.hashes, hours.n)
        yield from tally.flush()

    def write_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, keys, counts = read_tally(batches)
        if s >= 0 and (counts >= least).any():
            held.write(s, keys=keys[counts >= least])
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32())], names=["shard"])

    made = to_shards(texts.select("ts", "text").mapInArrow(count_hashes, TALLY), shards).mapInArrow(write_frequent, "shard int").collect()
    held.present = frozenset(r["shard"] for r in made)

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", BATCH_BYTES):
            found = grams_of(b["text"], into)
            hours = by_hour(b["ts"], found)
            order = np.argsort(hours.hashes)
            wanted = np.zeros(len(order), bool)
            for _, i, _ in held.find(hours.hashes[order]):
                wanted[order[i]] = True
            keep = np.flatnonzero(wanted[hours.entry])
            entry, text = hours.entry[keep], found.text[keep]
            groups = b["category_id"].dictionary_encode("encode")
            of = groups.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            kinds = max(1, len(groups.dictionary))
            keys, n = _runs_of_equal(np.sort(entry * kinds + of[text]))
            entry, kind = np.divmod(keys, kinds)
            # a gram is made a string once
            distinct, back = np.unique(hours.gram[entry], return_inverse=True)
            term = found.shown(distinct).take(pa.array(back))
            yield pa.RecordBatch.from_arrays([hours.hours.take(pa.array(hours.at[entry])), groups.dictionary.take(pa.array(kind)), term, pa.array(n, pa.int64())], names=["ts", "category_id", "term", "n"])

    kind = dict(texts.dtypes)
    each = texts.mapInArrow(count_terms, f"ts {kind['ts']}, category_id {kind['category_id']}, term string, n bigint")
    summed = each.groupBy("ts", "term", "category_id").agg(F.sum("n").alias("n"))
    return with_totals(summed).where(F.col("n") >= least)
