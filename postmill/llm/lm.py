"""LM scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays that workers memory-map.

Three passes of Spark write the model to the shared folder, sharded by hash: words and their counts; bigrams and their
counts; and by word what it is as a context (total, and how many continuations were seen once, twice, more) and after how
many different words it stands. A text's words stand between a begin, which is never predicted, and an end, which is.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.shared import TALLY, HashShards, Tally, merge_sums, mix, pieces, read_tally, shard_of, shared_dir, shards_of, to_shards, word_hashes, words_of

#: Keys of the two edges; they hold a blank, which no word does.
BEGIN, END = np.uint64(xxhash.xxh3_64_intdigest(b" begin")), np.uint64(xxhash.xxh3_64_intdigest(b" end"))
SCORES = "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


@dataclass
class Model:
    """Where the arrays are, and the sums that every score needs."""

    words: HashShards
    bigrams: HashShards
    offsets: np.ndarray  # the first word number of each shard, and the number after the last
    tokens: int
    vocabulary: int
    bigram_discounts: np.ndarray  # by count 0, 1, 2, 3 and more
    word_discounts: np.ndarray
    continuations: int  # different bigrams
    word_spread: float  # share of the words' mass that goes to the uniform distribution


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts by count 0 to 3+, from the numbers of entries with counts 1 to 4.

    Each lies above 0, so that every context leaves mass to the lower order and no word has probability 0: one that the estimate
    puts at 0 or below, as repeated text does, is the absolute discount n1 / (n1 + 2 n2). Where counts are too few, plain ones.
    """
    if (n[:3] == 0).any():
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    d = np.array([0.0, *(i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3))])
    return np.r_[0.0, np.where(d[1:] > 0, d[1:], y)]


def count_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.array([(counts == i).sum() for i in (1, 2, 3, 4)] + [(counts >= 3).sum()], np.int64)


def sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, and for all texts end to end (begin, words, end) the number of each token's key and of its text."""
    flat, counts = words_of(texts)
    keys, at = word_hashes(flat)
    n = len(keys)
    close = np.cumsum(counts)
    seq = np.insert(np.insert(at, close, n + 1), np.r_[0, close[:-1] + np.arange(1, len(close))] if len(close) else [], n)
    return np.r_[keys, BEGIN, END], seq, np.repeat(np.arange(len(counts)), counts + 2)


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Counts the model from all rows of ``docs``. Null texts count as empty ones: an end alone. No rows give an empty model."""
    spark = docs.sparkSession
    folder, shards = shared_dir(spark, "lm"), shards_of(spark)
    texts = docs.select(F.col(text).alias("text"))
    words, bigrams = HashShards(folder, "word", shards), HashShards(folder, "bigram", shards)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(shards)
        for b in pieces(batches, "text"):
            keys, seq, _ = sequences(b["text"])
            n = np.bincount(seq, minlength=len(keys))
            n[-2] = 0  # begin is a context only
            yield from tally.add(keys, n)
        yield from tally.flush()

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, keys, counts = read_tally(batches)
        if s >= 0:
            words.write(s, keys=keys, count=counts.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([int((counts > 0).sum())], pa.int64())], names=["shard", "entries", "tokens", "known"])

    made = to_shards(texts.mapInArrow(count_words, TALLY), shards).mapInArrow(write_words, "shard int, entries bigint, tokens bigint, known bigint").collect()
    sizes = np.zeros(shards, np.int64)
    for r in made:
        sizes[r["shard"]] = r["entries"]
    offsets = np.r_[0, np.cumsum(sizes)]
    tokens, vocabulary = sum(r["tokens"] for r in made), sum(r["known"] for r in made)
    if offsets[-1] >= 1 << 32:
        raise ValueError("more than 2**32 different words")
    words.present = frozenset(r["shard"] for r in made)

    def count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(shards, lambda k, n: shard_of(mix(k), n))
        for b in pieces(batches, "text"):
            keys, seq, doc = sequences(b["text"])
            ids = word_ids(words, offsets, keys).astype(np.uint64)[seq]
            pair = (ids[:-1] << np.uint64(32) | ids[1:])[doc[:-1] == doc[1:]]
            k, n = np.unique(pair, return_counts=True)
            yield from tally.add(k, n)
        yield from tally.flush()

    def write_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, pair, counts = read_tally(batches)
        if s < 0:
            return
        bigrams.write(s, seen=count_of_counts(counts))
        first, second = pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)
        # by word: what 0 total, 1 to 3 continuations seen once, twice, more, 4 different words before it
        by = Tally(shards, lambda k, _: np.searchsorted(offsets, k >> np.uint64(3), side="right").astype(np.int32) - 1)
        for what, ids, value in ((0, first, counts), (1, first, counts == 1), (2, first, counts == 2), (3, first, counts >= 3), (4, second, np.ones(len(pair), np.int64))):
            k, v = merge_sums([ids], [value])
            yield from by.add(k[v > 0] << np.uint64(3) | np.uint64(what), v[v > 0])
        hashed = mix(pair)  # one to one
        order = np.argsort(hashed)
        bigrams.write(s, keys=hashed[order], count=_narrow(counts[order]))
        yield from by.flush()

    def write_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, keys, values = read_tally(batches)
        if s < 0:
            return
        table = np.zeros((5, int(sizes[s])), np.int64)
        table[(keys & np.uint64(7)).astype(np.int64), (keys >> np.uint64(3)).astype(np.int64) - offsets[s]] = values
        words.write(s, context=_narrow(table), seen=count_of_counts(table[4]))
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([int(table[4].sum())], pa.int64())], names=["shard", "pairs"])

    pairs = to_shards(texts.mapInArrow(count_bigrams, TALLY), shards).mapInArrow(write_bigrams, TALLY)
    done = to_shards(pairs, shards).mapInArrow(write_contexts, "shard int, pairs bigint").collect()
    continuations = sum(r["pairs"] for r in done)
    # every word that is counted stands in a pair, so the contexts lie in the words' shards; which shards hold pairs is in the pairs' own hashes
    bigrams.present = frozenset(s for s in range(shards) if os.path.exists(f"{folder}/bigram-keys-{s}.npy"))
    seen = lambda held: sum((held.array("seen", s).astype(np.int64) for s in sorted(held.present)), np.zeros(5, np.int64))
    of_pairs, of_words = seen(bigrams), seen(words)
    # the shards must hold just the pairs and words that the jobs counted
    if (int(of_pairs[:2].sum() + of_pairs[4]), {r["shard"] for r in done}) != (continuations, set(words.present)):
        raise OSError(f"{folder} lacks files that workers wrote; it must be shared by driver and executors")
    d = discounts(of_words[:4])
    spread = float((d[1] * of_words[0] + d[2] * of_words[1] + d[3] * of_words[4]) / continuations) if continuations else 1.0
    return Model(words, bigrams, offsets, tokens, vocabulary, discounts(of_pairs[:4]), d, continuations, spread)


def _narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint32 if not a.size or a.max() < 1 << 32 else np.uint64)


def word_ids(words: HashShards, offsets: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The number of each key's word, or -1."""
    order = np.argsort(keys)
    ids = np.full(len(keys), -1, np.int64)
    for s, i, p in words.find(keys[order]):
        ids[order[i]] = p + offsets[s]
    return ids


def word_values(words: HashShards, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts, and the five context values, of word numbers; 0 for -1."""
    counts, context = np.zeros(len(ids), np.int64), np.zeros((5, len(ids)), np.int64)
    order = np.argsort(ids)
    edge = np.searchsorted(ids[order], offsets)
    for s in np.flatnonzero(np.diff(edge)).tolist():
        i = order[edge[s] : edge[s + 1]]
        at = ids[i] - offsets[s]
        counts[i] = words.array("count", s)[at]
        context[:, i] = words.array("context", s)[:, at]
    return counts, context


class Scorer:
    def __init__(self, m: Model):
        self.m, self.words, self.bigrams = m, m.words, m.bigrams

    def score(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and model score of each text."""
        m, n = self.m, len(texts)
        keys, seq, doc = sequences(texts)
        ids = word_ids(self.words, m.offsets, keys)
        counts, context = word_values(self.words, m.offsets, ids)
        inner = doc[:-1] == doc[1:]
        before, word, doc = seq[:-1][inner], seq[1:][inner], doc[1:][inner]
        tokens, known = np.bincount(doc, minlength=n), np.bincount(doc, counts[word] > 0, n).astype(np.int64)
        base = np.bincount(doc, np.log10((counts + 1) / (m.tokens + m.vocabulary + 1))[word], n)
        # lower order: different words before it, discounted, and the rest spread evenly over all words and an unknown one
        after = context[4]
        low = np.maximum(after - m.word_discounts[np.minimum(after, 3)], 0) / max(m.continuations, 1) + m.word_spread / (m.vocabulary + 1)
        total, once, twice, more = context[:4]
        d = m.bigram_discounts
        left = np.where(total > 0, (d[1] * once + d[2] * twice + d[3] * more) / np.maximum(total, 1), 1.0)
        p = left[before] * low[word]
        ok = np.flatnonzero((total[before] > 0) & (ids[word] >= 0))
        pair, at = np.unique(mix(ids[before[ok]].astype(np.uint64) << np.uint64(32) | ids[word[ok]].astype(np.uint64)), return_inverse=True)
        seen = np.zeros(len(pair), np.int64)
        for s, i, place in self.bigrams.find(pair):
            seen[i] = self.bigrams.array("count", s)[place]
        c = seen[at]
        p[ok] += np.maximum(c - d[np.minimum(c, 3)], 0) / total[before[ok]]
        return tokens, known, base, np.bincount(doc, np.log10(p), n)


def score(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds the columns SCORES and perplexity to the columns ``carry`` (all unless given), for every whole text.

    score is the model's log10 probability of the text with its end, base_score that of the add-one unigram model. A null
    text counts as empty and has one token, the end. Rows stay; columns with the names of new ones are replaced.
    """
    from pyspark.sql.types import DoubleType, StructType, _parse_datatype_string

    made = _parse_datatype_string(SCORES).add("perplexity", DoubleType())
    keep = [c for c in (docs.columns if carry is None else carry) if c not in made.names]
    schema = StructType([docs.schema[c] for c in keep] + made.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in pieces(batches, text, 4 << 20):
            n, known, base, own = scorer.score(b[text])
            cols = [pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(own), pa.array(10 ** (-own / n))]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], *cols], names=schema.names)

    return docs.mapInArrow(run, schema)


def learning(doc_id: str = "doc_id") -> Column:
    """The rows that the query learns from: crc32 of the id as text leaves something else than 2 by 7."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 7 != 2
