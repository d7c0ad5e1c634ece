"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus, beside fixed text rules.

Words are cut into runs of letters and digits and runs of marks; unigrams and bigrams of these are hashed into buckets.
Both multinomials are counted in Spark: the raw one over all documents, the target over a bounded sample of trusted ones.
A document's score is its mean log ratio per n-gram; it is kept from a fixed threshold on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.shared import mix, pieces, word_hashes, words_of

BUCKETS = 1 << 16
#: At most so many trusted documents, the first by hash of their id, make the target.
TRUSTED_LIMIT = 20_000
#: Least mean log ratio of a kept document.
THRESHOLD = -0.5
PART = regex.compile(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+")
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
CONTINUES = np.zeros(256, bool)
CONTINUES[0x80:0xC0] = True

COLUMNS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return sums[offsets[1:]] - sums[offsets[:-1]]


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The fixed counts of every text; null as empty."""
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    flat, counts = words_of(texts, lower=False)
    hashes, at = word_hashes(flat)
    out = {
        "n_words": counts,
        "word_chars": _per_text(~SPACE[data] & ~CONTINUES[data], offsets),
        "n_symbols": _per_text(SYMBOL[data], offsets),
        "n_dup_lines": np.array([_dup_lines(t) for t in texts.to_pylist()], np.int64),
    }
    # windows of three words that lie in one text, keyed by text and words
    doc = np.repeat(np.arange(len(counts)), counts)
    covered = np.zeros(len(doc), bool)
    if len(doc) >= 3:
        h = mix(hashes)[at]
        key = mix(mix(mix(h[:-2] + doc[:-2].astype(np.uint64)) + h[1:-1]) + h[2:])
        own = np.flatnonzero(doc[:-2] == doc[2:])
        order = own[np.argsort(key[own], kind="stable")]
        same = key[order][1:] == key[order][:-1]
        twice = order[np.r_[same, False] | np.r_[False, same]]
        for k in range(3):
            covered[twice + k] = True
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=len(counts)).astype(np.int64)
    return out


def _dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def ngram_buckets(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams of the texts' parts, and the text that each belongs to. A-Z count as lower case."""
    flat, counts = words_of(texts)
    coded = flat.dictionary_encode()
    table = [[xxhash.xxh3_64_intdigest(p) for p in PART.findall(w)] for w in coded.dictionary.to_pylist()]
    size = np.fromiter(map(len, table), np.int64, len(table))
    parts = np.fromiter((p for t in table for p in t), np.uint64, int(size.sum()))
    order = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    each = size[order]
    starts = np.cumsum(each) - each
    h = parts[np.repeat((np.cumsum(size) - size)[order] - starts, each) + np.arange(int(each.sum()))]
    doc = np.repeat(np.repeat(np.arange(len(counts)), counts), each)
    pair = mix(mix(h[:-1]) + h[1:])[doc[:-1] == doc[1:]] if len(h) > 1 else np.empty(0, np.uint64)
    n = np.uint64(buckets)
    return np.r_[h % n, pair % n].astype(np.int64), np.r_[doc, doc[:-1][doc[:-1] == doc[1:]]] if len(h) else doc


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_LIMIT) -> DataFrame:
    """Ids of at most ``limit`` documents labelled good and not toxic; ties of the hash by id. Null ids are left out."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def fit(docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id", buckets: int = BUCKETS) -> np.ndarray:
    """Log ratios by bucket, add-one smoothed. trusted (doc_id) must be bounded: it is broadcast. What reaches the driver is one row a bucket."""
    flagged = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(trusted.select("doc_id", F.lit(True).alias("good"))), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in pieces(batches, "text"):
            found, doc = ngram_buckets(b["text"], buckets)
            raw += np.bincount(found, minlength=buckets)
            good += np.bincount(found[b["good"].to_numpy(zero_copy_only=False)[doc]], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])], names=["bucket", "raw", "good"])

    counts = flagged.mapInArrow(run, "bucket bigint, raw bigint, good bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    raw, good = np.zeros(buckets), np.zeros(buckets)
    raw[counts["bucket"]], good[counts["bucket"]] = counts["raw"], counts["good"]
    return np.log((good + 1) / (good.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))


def scores(texts: pa.Array, ratios: np.ndarray) -> np.ndarray:
    """Mean log ratio of each text's n-grams; 0 without any."""
    found, doc = ngram_buckets(texts, len(ratios))
    n = np.bincount(doc, minlength=len(texts))
    return np.bincount(doc, ratios[found], len(texts)) / np.maximum(n, 1)


def judge(docs: DataFrame, ratios: np.ndarray, text: str = "text", threshold: float = THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """Adds the counts of COLUMNS, base_failed, score and kept to the columns ``carry`` (all unless given).

    A null or empty text has no words, so it fails the fixed rules and is not kept; its score is 0. Every row is judged
    by itself and stays; columns with the names of new ones are replaced.
    """
    from pyspark.sql.types import BooleanType, DoubleType, StructType, _parse_datatype_string

    made = _parse_datatype_string(COLUMNS).add("base_failed", BooleanType()).add("score", DoubleType()).add("kept", BooleanType())
    keep = [c for c in (docs.columns if carry is None else carry) if c not in made.names]
    schema = StructType([docs.schema[c] for c in keep] + made.fields)
    ratios = ratios.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text):
            c, s = text_counts(b[text]), scores(b[text], ratios)
            failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
            new = [*(pa.array(c[n]) for n in list(made.names)[:5]), pa.array(failed), pa.array(s), pa.array(~failed & (s >= threshold))]
            yield pa.RecordBatch.from_arrays([*[b[n] for n in keep], *new], names=schema.names)

    return docs.mapInArrow(run, schema)
