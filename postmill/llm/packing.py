"""Packing by power-of-two decomposition: each document becomes pieces of binary lengths, equal lengths share a bucket.

Pieces come longest first: whole windows of the greatest length, then the binary digits of the rest. A sequence is one
piece, so none crosses documents and none needs padding.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.shared import pieces as slices
from postmill.llm.shared import words_of

END_ID = 1


def binary_pieces(n: int, longest: int = 2048) -> list[int]:
    """Lengths that sum to n: powers of two, at most longest (itself a power of two), not growing."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


#: The pre-tokenizer's pattern of the word-end vocabulary, as in its file.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words of these characters alone are cut and lower-cased here: printable ASCII, Latin letters with accents, Cyrillic, quotes
#: and dashes. They are in composed form, and every version of the character tables agrees on them; tests compare each one
#: with the whole tokenizer. Any other word, such as one with a control character, goes to the whole tokenizer.
PLAIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u017f\u0400-\u045f\u2010-\u2027\u2030-\u203a]*")
CACHE_WORDS = 250_000
#: Longer words are not kept.
LONG = 1_000


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Token ids of words without ASCII white space. White space always parts tokens in this vocabulary, so a text's ids are its words' ids.

    Ids of words are kept from task to task in a bounded cache, since texts repeat their words.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        self.model, self.letters = self.whole.model, _byte_letters()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        if (ids := self.parts.get(part)) is None:
            named = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            ids = self.parts[part] = array("i", [t.id for t in self.model.tokenize(named)]).tobytes()
        return ids

    def word(self, word: str) -> bytes:
        """The ids as native 32-bit integers end to end."""
        if (ids := self.words.get(word)) is None:
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            if len(self.parts) >= CACHE_WORDS:
                self.parts.clear()
            if PLAIN.fullmatch(word) and "<|" not in word:  # that may start an added token
                ids = b"".join([self._part(p) for p in PRETOKEN.findall(word.lower())])
            else:
                ids = array("i", self.whole.encode(word, add_special_tokens=False).ids).tobytes()
            if len(word) > LONG:
                self.parts.clear()
                return ids
            self.words[word] = ids
        return ids

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each text closed by END_ID, and where each text starts (one place more at the end)."""
        flat, counts = words_of(texts, lower=False)
        coded = flat.dictionary_encode()
        known = self.words.get
        table = [known(w) or self.word(w) for w in coded.dictionary.to_pylist()] + [array("i", [END_ID]).tobytes()]
        size, ids = np.fromiter(map(len, table), np.int32, len(table)) >> 2, np.frombuffer(b"".join(table), np.int32)
        # a closing entry after each text's words
        order = np.insert(coded.indices.to_numpy(zero_copy_only=False), np.cumsum(counts), len(table) - 1)
        each = size[order]
        starts = np.cumsum(each, dtype=np.int64) - each
        place = np.repeat(((np.cumsum(size) - size)[order] - starts).astype(np.int32), each)
        place += np.arange(len(place), dtype=np.int32)
        closing = np.cumsum(counts + 1) - 1
        return ids[place], np.r_[0, (starts + each)[closing]]


_encoders: dict[str | None, WordEncoder] = {}


def encoder(path: str | None = None) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pack_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", longest: int = 2048, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, bucket (log2 of length), ids_crc32, doc_tokens, ids, sequence_id, offset.

    ids are the piece's token ids, the document's last one a closing 1; without ``with_ids`` they are left out. ids_crc32 is
    the CRC-32 of their little-endian unsigned 32-bit form. Null or empty text: the closing id alone, one piece of length 1.
    Repeated rows are packed apart, each with sequences of its own. An empty table gives no rows. Extra columns are not
    carried, whatever their names. sequence_id is unique within a run.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, start bigint, length bigint, bucket int, ids_crc32 bigint, doc_tokens bigint" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for b in slices(batches, "text", 8 << 20):
            ids, edge = own.texts(b["text"])
            sizes = [binary_pieces(n, longest) for n in np.diff(edge).tolist()]
            many = np.fromiter(map(len, sizes), np.int64, len(sizes))
            length = np.concatenate([np.asarray(x, np.int64) for x in sizes])
            ends = np.cumsum(length)
            at = ends - length
            who = np.repeat(np.arange(len(sizes)), many)
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at.tolist(), ends.tolist(), strict=True)]
            columns = [b["doc_id"].take(pa.array(who)), pa.array(at - edge[who]), pa.array(length), pa.array(np.log2(length).astype(np.int32)), pa.array(crc, pa.int64()), pa.array(np.diff(edge)[who])]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.r_[at, len(ids)], pa.int32()), pa.array(ids, pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "bucket", "ids_crc32", "doc_tokens", "ids"][: len(columns)])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
    return rows.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences as Parquet, one folder per bucket of equal lengths, so that a reader batches without padding."""
    packed.write.partitionBy("bucket").parquet(path)
