"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

A string that a tokenizer's vocabulary cannot shorten (few characters a token) is likely random. Digests and
identifiers, which are random but no secrets, are excluded from that test.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from postmill.llm.shared import free_name

#: Fixed patterns: kind, pattern, group that holds the length, least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")

#: Whole runs, since the match is greedy and a shorter rest is no match.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: Known digests (MD5, SHA-1, SHA-2 in hex of one case) and identifiers (UUID, plain numbers, dashed dates, also with a time up to its first colon).
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64})\Z")
IDENTIFIER = re.compile(r"(?:[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|[0-9_=+/-]+|[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2,6}Z?)\Z")
MAX_CHARS_PER_TOKEN = 2.2
#: Strings below FULL characters are noisier: the limit falls by SLOPE for each character less.
FULL, SLOPE = 20, 0.075
#: Runs above WINDOW characters are tested in windows, each half over the one before.
WINDOW = 512

SPAN = ArrayType(StructType().add("kind", StringType()).add("start", LongType()).add("end", LongType()))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in code points, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def limit_of(n: int, limit: float = MAX_CHARS_PER_TOKEN) -> float:
    """The characters a token below which a string of n characters counts as random."""
    return limit - SLOPE * max(FULL - n, 0)


def random_spans(text: str, encode, limit: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """Strings of letters and digits with fewer characters a token than the limit of their length, less digests and identifiers.

    Of a run above WINDOW characters, the windows that are random are united where they overlap; the last one ends with the run.
    """
    found = []
    for m in CANDIDATE.finditer(text):
        s, at = m.group(), m.start()
        n = len(s)
        if DIGEST.match(s) or IDENTIFIER.match(s):
            continue
        if n <= WINDOW:
            if n < limit_of(n, limit) * len(encode(s)):
                found.append((at, 3, at + n))
            continue
        upto = -1  # end of the last random window of this run
        for i in [*range(0, n - WINDOW, WINDOW // 2), n - WINDOW]:
            if limit * len(encode(s[i : i + WINDOW])) > WINDOW:
                found.append((found.pop()[0] if i <= upto else at + i, 3, at + i + WINDOW))
                upto = i + WINDOW
    return found


def all_spans(text: str, encode, limit: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """Fixed and random spans, sorted; a random span that lies within a fixed one is left out."""
    own = base_spans(text)
    starts, ends = [s for s, _, _ in own], [0, *accumulate((e for _, _, e in own), max)]
    return sorted(own + [r for r in random_spans(text, encode, limit) if ends[bisect_right(starts, r[0])] < r[2]])


def encoder(path: str | None = None):
    """encode_ordinary of the byte-level vocabulary; path is a tiktoken rank file."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets", vocabulary: str | None = None, limit: float = MAX_CHARS_PER_TOKEN, carry: list[str] | None = None) -> DataFrame:
    """Adds ``out``: spans (kind, start, end) of every whole text, by start, then kind; code points, end exclusive.

    Null or empty text: no span. A random span that lies within a fixed one is left out.
    The columns ``carry`` stay (all unless given); an existing column ``out`` is replaced. Rows are never dropped, repeated rows stay repeated.
    """
    keep = [c for c in (docs.columns if carry is None else carry) if c != out]
    schema = StructType([docs.schema[c] for c in keep]).add(out, SPAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = encoder(vocabulary), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            spans = []
            for t in b[text]:
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in all_spans(t.as_py() or "", encode, limit)])
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array(spans, kind)], names=[*keep, out])

    return docs.drop(*[out] if out != text else []).mapInArrow(run, schema)


def redact(text: str | None, spans: list[tuple[int, int]], mark: str = "[secret]") -> str | None:
    """The text with each maximal run of overlapping spans replaced by the mark."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", vocabulary: str | None = None) -> DataFrame:
    """The same rows and columns with secrets in ``text`` replaced by ``[secret]``; ``n_chars``, if present, is counted anew for changed rows. Linear in each text."""
    made = free_name("_changed", docs.columns)
    schema = StructType([*docs.schema.fields, StructType().add(made, StringType()).fields[0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for b in batches:
            changed = []
            for t in b[text]:
                spans = all_spans(t.as_py() or "", encode)
                changed.append(redact(t.as_py(), [(s, e) for s, _, e in spans]) if spans else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(changed, pa.string())], names=schema.names)

    out = docs.mapInArrow(run, schema)
    new = F.col(made)
    if n_chars and n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(new.isNotNull(), F.length(new).cast(docs.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return out.withColumn(text, F.coalesce(new, F.col(text))).select(*docs.columns)


def digest(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)

