"""Fill-in-middle transformation: whole Arrow batches of UTF-8 text are cut by numpy, and the parts put in another order.

A text is a row of units (code points, words or lines). Two hashes of a document's id choose two cuts between units, and so
a prefix, a middle and a suffix. A lookup gives each byte its class, a table over adjacent classes says where units start,
sums that begin anew with each document number the units, and one binary search finds the bytes of the cuts of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from postmill.llm.shared import free_name, pieces

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Classes of bytes: inside a character, blank, line end, other first byte; before a document's first byte stands EDGE.
INNER, BLANK, LINE, LEAD, EDGE = range(5)
CLASS = np.full(256, LEAD, np.uint8)
CLASS[0x80:0xC0] = INNER
CLASS[[0x20, *range(0x09, 0x0E)]] = BLANK
CLASS[0x0A] = LINE


def _starts(rule) -> np.ndarray:
    """Where a unit starts, by the class before times 5 plus the own class. The first byte of a document always starts one."""
    return np.array([own != INNER and (before == EDGE or rule(before, own)) for before in range(5) for own in range(5)])


UNITS = {
    "char": _starts(lambda before, own: True),
    "word": _starts(lambda before, own: own == LEAD and before in (BLANK, LINE)),  # a word with the white space after it
    "line": _starts(lambda before, own: before == LINE),
}


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each starts (one place more at the end). No nulls."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, wide, len(texts) + 1, texts.offset * np.dtype(wide).itemsize) if ends is not None and len(texts) else np.zeros(len(texts) + 1, wide)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, (offsets - offsets[0]).astype(np.int64)


def cut(texts: pa.Array, first: np.ndarray, second: np.ndarray, unit: str = "char") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all texts together: units, the bytes of the edges (start, two cuts, end: 4 x rows) and the code points before each edge.

    The cuts lie after first % (units + 1) and second % (units + 1) units, the smaller first.
    """
    raw, offsets = utf8(texts)
    start, end = offsets[:-1], offsets[1:]
    own = CLASS[raw]
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[start[start < end]] = EDGE
    at = UNITS[unit][before * np.uint8(5) + own]
    # units (and characters) before each byte, counted through the batch; a document's own are the differences to its first byte
    rank = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(at, out=rank[1:])
    base = rank[start]
    n = rank[end] - base
    a, b = (h.astype(np.uint64) % (n + 1).astype(np.uint64) for h in (first, second))
    places = [np.where(k < n, np.searchsorted(rank, base + k + 1) - 1, end) for k in (np.minimum(a, b).astype(np.int64), np.maximum(a, b).astype(np.int64))]
    edges = np.stack([start, *places, end])
    if unit == "char":
        return n, edges, rank[edges]
    chars = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(own != INNER, out=chars[1:])
    return n, edges, chars[edges]


def reorder(texts: pa.Array, edges: np.ndarray, plain: np.ndarray, spm: np.ndarray) -> pa.Array:
    """The texts with their parts marked and moved: psm is prefix, suffix, middle; spm has the suffix first; plain rows stay."""
    raw, _ = utf8(texts)
    # three parts a row lie end to end, so they are strings over the same bytes
    offsets = np.append(edges[:3].T.ravel(), edges[3][-1:] if len(texts) else 0)
    parts = pa.LargeStringArray.from_buffers(3 * len(texts), pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
    prefix, middle, suffix = (parts.take(pa.array(np.arange(k, 3 * len(texts), 3))) for k in range(3))
    p, s, m, nothing = (pa.scalar(x, pa.large_string()) for x in (PREFIX, SUFFIX, MIDDLE, ""))
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, nothing)
    spm_first = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, nothing)
    return pc.if_else(pa.array(plain), texts.cast(pa.large_string()), pc.if_else(pa.array(spm), spm_first, psm))


def draws(doc_id: str | Column, seed: int = 1) -> Column:
    """Four unsigned 32-bit numbers of an id, as an array of longs. A null id counts as an empty one."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)])


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 1, unit: str = "char", plain_from: int = 90, spm_below: int = 20, carry: list[str] | None = None) -> DataFrame:
    """Adds n (units), form, prefix_chars, middle_chars and output to the columns ``carry`` (all unless given).

    Form is plain, and output the text, where the text is empty or holds a mark, or the third number of the id by 100 is
    plain_from or more; else spm where the fourth by 100 is below spm_below, else psm. A null text counts as empty. Rows with
    the same id and text get the same result; columns with the names of new ones are replaced; an empty table stays one. A text is never cut
    inside a code point. Batches are bounded by bytes, so a very long text is a batch of its own.
    """
    made = StructType().add("n", LongType()).add("form", StringType()).add("prefix_chars", LongType()).add("middle_chars", LongType()).add("output", StringType())
    keep = [c for c in (docs.columns if carry is None else carry) if c not in made.names]
    drawn = free_name("_draws", docs.columns)
    schema = StructType([docs.schema[c] for c in keep] + made.fields)
    needed = list(dict.fromkeys([*keep, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text):
            texts = pc.fill_null(b[text], "")
            numbers = b[drawn].flatten().to_numpy(zero_copy_only=False).reshape(-1, 4).T
            n, edges, chars = cut(texts, numbers[0], numbers[1], unit)
            marked = np.zeros(len(texts), bool)
            for mark in (PREFIX, SUFFIX, MIDDLE):
                marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
            plain = (n == 0) | marked | (numbers[2] % 100 >= plain_from)
            spm = numbers[3] % 100 < spm_below
            form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
            own = [pa.array(n), pa.array(form, pa.string()), *[pa.array(chars[k + 1] - chars[k], mask=plain) for k in (0, 1)], reorder(texts, edges, plain, spm).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], *own], names=schema.names)

    return docs.select(*needed, draws(doc_id, seed).alias(drawn)).mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from. No part of a marked output holds a mark, and none can arise where parts meet."""
    body = F.expr(f"substring(`{output}`, {len(PREFIX) + 1})")
    psm, spm = F.split(body, f"{SUFFIX}|{MIDDLE}", 3), F.split(body, f"{PREFIX}|{MIDDLE}", 3)
    return F.when(F.col(form) == "psm", F.concat(psm[0], psm[2], psm[1])).when(F.col(form) == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(F.col(output))


#: The whole transformation as DuckDB SQL, over units of one code point.
FIM_SQL = """
with drawn as (
  select doc_id, coalesce(text, '') t, length(coalesce(text, '')) n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) h from documents),
numbers as (
  select doc_id, t, n, cast('0x' || substr(h, 1, 8) as bigint) h1, cast('0x' || substr(h, 9, 8) as bigint) h2,
    cast('0x' || substr(h, 17, 8) as bigint) h3, cast('0x' || substr(h, 25, 8) as bigint) h4 from drawn),
cuts as (
  select doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end form from numbers),
parts as (
  select doc_id, t, n, form, a, b, substring(t, 1, a) p, substring(t, a + 1, b - a) m, substring(t, b + 1, n - b) s from cuts)
select doc_id, n, form, case when form <> 'plain' then a end prefix_chars, case when form <> 'plain' then b - a end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256,
  sha256(t) restored_sha256
from parts
"""
