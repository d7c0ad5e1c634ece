"""Language ID by word-first backoff: known words score by their log frequency in each language, other words by the longest
character n-grams that any language knows.

Counts come from all learning rows, and every word and n-gram that was learned is known. The model lies in the shared folder
as sorted hash arrays, which workers memory-map; an entry holds only the languages that know it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.shared import HashShards, mix, pieces, shared_dir, shards_of, to_shards, words_of

#: What parts runs of letters: a run starts with a letter and goes on with letters and marks.
APART = r"[^\p{L}\p{M}]+\p{M}*|^\p{M}+"
MAX_N = 5
UNKNOWN = "und"
#: Words that a task cuts into n-grams at a time.
CUT_WORDS = 50_000


def runs_of(flat: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of white-space words: the distinct letter runs, those of each distinct word end to end with their edges, and each word's number."""
    coded = flat.dictionary_encode()
    lists = pc.ascii_split_whitespace(pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(coded.dictionary.cast(pa.string())), APART, " ")))
    every = lists.flatten()
    full = pc.greater(pc.binary_length(every), 0).to_numpy(zero_copy_only=False)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.bincount(np.repeat(np.arange(len(size)), size)[full], minlength=len(size)).astype(np.int64) if len(size) else size
    runs = every.filter(pa.array(full)).dictionary_encode()
    return runs.dictionary, runs.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(size)], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def expand(edge: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all entries of the rows, and the position in ``rows`` that each belongs to."""
    size = edge[rows + 1] - edge[rows]
    owner = np.repeat(np.arange(len(rows)), size)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(edge[rows], size), owner


class Padded:
    """Words with a blank before and after, as code points."""

    def __init__(self, words: list[str]):
        self.points = np.frombuffer("".join([f" {w} " for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        self.word = np.repeat(np.arange(len(words)), self.size)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-grams, and the word of each."""
        m = max(len(self.points) - n + 1, 0)
        if not m:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        h = mix(self.points[:m] + np.uint64(n << 32))
        for k in range(1, n):
            h = mix(h + self.points[k : k + m])
        own = self.word[:m] == self.word[n - 1 :]
        return h[own], self.word[:m][own]


def hashed_words(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


@dataclass
class Model:
    """Languages in order, the cost of what a language does not know by length (0: words), and the arrays.

    An entry is a hash; "edge" tells where its (lang, cost) pairs start. A cost is minus log10 of the share of a language's
    words, or n-grams of that length. Unknown is a tenth of one sighting in the language with most of them.
    """

    langs: list[str] = field(default_factory=list)
    unknown: np.ndarray = field(default_factory=lambda: np.zeros(MAX_N + 1))
    entries: HashShards | None = None

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which keys are known; and for these, pair by pair, the number of the key, the language and the cost."""
        order = np.argsort(keys)
        known, rows, langs, costs = np.zeros(len(keys), bool), [], [], []
        for s, i, p in self.entries.find(keys[order]):
            known[order[i]] = True
            place, owner = expand(self.entries.array("edge", s), p)
            rows.append(order[i][owner])
            langs.append(self.entries.array("lang", s)[place])
            costs.append(self.entries.array("cost", s)[place])
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
        return known, join(rows, np.int64), join(langs, np.int64), join(costs, np.float64)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", max_n: int = MAX_N) -> Model:
    """The model of all rows with a language. Rows without a language or without letters teach nothing; without any row there is no language.

    What reaches the driver are the sums by language and length. Repeated rows count as often as they stand.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            flat, per = words_of(b["text"])
            names = b["lang"].dictionary_encode()
            k = max(len(names.dictionary), 1)
            runs, of, edge, at = runs_of(flat)
            which = np.repeat(names.indices.to_numpy(zero_copy_only=False).astype(np.int64), per)
            pairs, n = np.unique(at * k + which, return_counts=True)
            place, owner = expand(edge, pairs // k)
            found, back = np.unique(of[place] * k + pairs[owner] % k, return_inverse=True)
            sums = np.bincount(back, n[owner], len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(found % k)), runs.take(pa.array(found // k)), pa.array(sums)], names=["lang", "word", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            names = t["lang"].dictionary_encode()
            k, which, weight, words = len(names.dictionary), names.indices.to_numpy(zero_copy_only=False).astype(np.int64), t["n"].to_numpy(), t["word"].to_pylist()
            padded = Padded(words)
            for n in range(max_n + 1):
                h, word = padded.grams(n) if n else (hashed_words(words), np.arange(len(words)))
                for x in range(k):
                    own = which[word] == x
                    keys, back = np.unique(h[own], return_inverse=True)
                    sums = np.bincount(back, weight[word[own]], len(keys)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(np.full(len(keys), x))), pa.array(np.full(len(keys), n), pa.int32()), pa.array(keys.view(np.int64)), pa.array(sums)], names=["lang", "size", "gram", "n"])

        rows = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= CUT_WORDS:
                yield from out()
                held, rows = [], 0
        if rows:
            yield from out()

    words = known.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    entries = words.mapInArrow(cut, "lang string, size int, gram bigint, n bigint").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")).persist(StorageLevel.DISK_ONLY)
    try:
        totals = {(r["lang"], r["size"]): r["total"] for r in entries.groupBy("lang", "size").agg(F.sum("n").alias("total")).collect()}
        langs = sorted({name for name, _ in totals})
        if not langs:
            return Model()
        number = {name: i for i, name in enumerate(langs)}
        total = np.array([[totals.get((name, n), 1) for n in range(max_n + 1)] for name in langs], np.float64)
        shards = shards_of(spark)
        held = HashShards(shared_dir(spark, "language"), "entry", shards)

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [b for b in batches if b.num_rows]
            if got:
                t = pa.Table.from_batches(got)
                which = np.concatenate([np.array([number[x] for x in c.dictionary.to_pylist()], np.int64)[c.indices.to_numpy(zero_copy_only=False)] for c in t["lang"].dictionary_encode().chunks])
                gram, size, n = (t[c].to_numpy() for c in ("gram", "size", "n"))
                gram = gram.view(np.uint64)
                order = np.lexsort((which, gram))
                gram, which = gram[order], which[order]
                keys, edge = np.unique(gram, return_index=True)
                s = got[0]["shard"][0].as_py()
                held.write(s, keys=keys, edge=np.r_[edge, len(gram)], lang=which.astype(np.uint16 if len(langs) <= 1 << 16 else np.uint32), cost=-np.log10(n[order] / total[which, size[order]]).astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32())], names=["shard"])

        # the shard is the hash's range, as find() expects
        shard = F.floor(F.shiftrightunsigned("gram", 32) * shards / F.lit(float(1 << 32))).cast("int")
        made = to_shards(entries.select("*", shard.alias("shard")), shards).mapInArrow(write, "shard int").collect()
    finally:
        entries.unpersist()
    held.present = frozenset(r["shard"] for r in made)
    return Model(langs, np.log10(total.max(0)) + 1, held)


def word_costs(words: list[str], model: Model) -> np.ndarray:
    """Costs of lower-case words by language: a known word's own; else the mean over the longest n-grams of which any is known."""
    k = len(model.langs)
    out = np.full((len(words), k), model.unknown[0])
    known, row, lang, cost = model.lookup(hashed_words(words))
    out[row, lang] = cost
    left = np.flatnonzero(~known)
    padded = Padded([words[i] for i in left.tolist()])
    for n in range(len(model.unknown) - 1, 0, -1):
        h, word = padded.grams(n)
        if not len(left) or not len(h):
            continue
        keys, back = np.unique(h, return_inverse=True)
        known, row, lang, cost = model.lookup(keys)
        hit = known[back]
        found = np.bincount(word[hit], minlength=len(left))
        # of each pair, how often a word holds the n-gram: the pairs of each occurrence
        by_row = np.argsort(row, kind="stable")
        start = np.searchsorted(row[by_row], np.arange(len(keys) + 1))
        place, owner = expand(start, back[hit])
        pair = by_row[place]
        less = np.bincount(word[hit][owner] * k + lang[pair], cost[pair] - model.unknown[n], len(left) * k).reshape(len(left), k)
        some = found > 0
        out[left[some]] = model.unknown[n] + less[some] / found[some, None]
        rest = ~some
        keep = rest[padded.word]
        renumber = np.cumsum(rest) - 1
        padded.points, padded.word = padded.points[keep], renumber[padded.word[keep]]
        left = left[rest]
    return out


class Scorer:
    """Predicts for texts."""

    def __init__(self, model: Model):
        self.model, self.langs = model, model.langs

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text. The score is the softmax of the languages' mean costs, in [0, 1]."""
        flat, per = words_of(texts)
        if not self.langs or not len(flat):
            return [UNKNOWN] * len(per), np.zeros(len(per))
        runs, of, edge, at = runs_of(flat)
        each = np.c_[word_costs(runs.to_pylist(), self.model), np.ones(len(runs))][of]  # by run of each distinct word
        owner = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        doc = np.repeat(np.arange(len(per)), per)
        by_word = [np.bincount(owner, each[:, k], len(edge) - 1) for k in range(each.shape[1])]
        sums = np.stack([np.bincount(doc, c[at], len(per)) for c in by_word], 1)
        n, mean = sums[:, -1], sums[:, :-1] / np.maximum(sums[:, -1:], 1)
        best = mean.argmin(1)
        share = 1 / np.exp((mean.min(1, keepdims=True) - mean) * math.log(10)).sum(1)
        return [self.langs[i] if k else UNKNOWN for i, k in zip(best, n, strict=True)], np.where(n > 0, share, 0.0)


def identify(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score to the columns ``carry`` (all unless given).

    A null text, or one without a letter, is ``und`` with score 0, as is every text under a model without languages.
    Equal costs go to the first language in order. Rows stay; columns with the names of new ones are replaced.
    """
    from pyspark.sql.types import DoubleType, StringType, StructType

    keep = [c for c in (docs.columns if carry is None else carry) if c not in ("lang_pred", "score")]
    schema = StructType([docs.schema[c] for c in keep]).add("lang_pred", StringType()).add("score", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in pieces(batches, text):
            lang, score = scorer.predict(b[text])
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array(lang, pa.string()), pa.array(score)], names=schema.names)

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str, modulus: int):
    """Whether crc32 of the id as text leaves 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus == 2
