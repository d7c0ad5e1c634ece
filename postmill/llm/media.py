"""Media columns: baseline JPEG. Markers are parsed, Huffman scans decoded in lockstep over all restart intervals of a batch,
and luminance thumbnails built from the DC coefficients alone.

``encode_payloads`` is the lossless store: one payload byte is the DC value of one flat 8x8 block (quantiser 8), so the
DC-only thumbnail of the stored image is the payload itself. Payloads too long for one frame become several frames,
one JPEG after the other.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.shared import pieces

UNIT = 576
#: Bytes that are encoded or decoded side by side; the arrays of a step take some fifty times as much.
BATCH_BYTES = 1 << 20
#: Blocks in a row of the stored image, which is also the restart interval, and rows in a frame (8 pixels each, 65,535 at most).
ROW, FRAME_ROWS = 24, 8184
#: Huffman tables of the stored form: code counts by length 1 to 16, then symbols. DC: the usual luminance table. AC: the end of block alone, in one bit.
DC_COUNTS, DC_SYMBOLS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))
AC_COUNTS, AC_SYMBOLS = (1,) + (0,) * 15, (0,)
#: Features of an image: dimensions and the hashes of its thumbnail.
FEATURES = "width bigint, height bigint, frames bigint, thumb_width bigint, thumb_height bigint, thumb_sha256 string, dhash string, media_error string"


def _codes(counts: tuple[int, ...], symbols: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(length, code, symbol) in canonical order."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((length, code, symbols[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _lookup(counts: tuple[int, ...], symbols: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: code length (0: no code) and symbol."""
    length, symbol = np.zeros(65536, np.int32), np.zeros(65536, np.int32)
    for n, code, s in _codes(counts, symbols):
        lo = code << (16 - n)
        length[lo : lo + (1 << (16 - n))], symbol[lo : lo + (1 << (16 - n))] = n, s
    return length, symbol


def _blocks(dc: tuple, ac: tuple) -> np.ndarray:
    """By the next 16 bits, the bits that a whole DC-only block takes (0: not one, or longer), and its DC difference beside."""
    (n, cat), (m, run) = _lookup(*dc), _lookup(*ac)
    peek = np.arange(65536)
    used = n + cat
    ok = (n > 0) & (used < 16)
    extra = (peek >> np.maximum(16 - used, 0)) & ((1 << np.minimum(cat, 15)) - 1)
    diff = np.where(cat == 0, 0, np.where(extra >> np.maximum(cat - 1, 0) & 1, extra, extra - (1 << np.minimum(cat, 15)) + 1))
    rest = (peek << np.minimum(used, 16)) & 0xFFFF
    total = used + m[rest]
    ok &= (m[rest] > 0) & (run[rest] == 0) & (total <= 16)
    return np.where(ok, total, 0).astype(np.int64), diff.astype(np.int32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\0" + bytes([8] * 64))
        + _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + b"\x01\x11\0")
        + _segment(0xC4, b"\x00" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS))
        + _segment(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS))
        + _segment(0xDD, struct.pack(">H", ROW))
        + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


_LEN = np.zeros(12, np.int64)
_CODE = np.zeros(12, np.int64)
for _n, _c, _s in _codes(DC_COUNTS, DC_SYMBOLS):
    _LEN[_s], _CODE[_s] = _n, _c
#: By DC difference + 255: bits of a whole block (code, difference, end of block) and their number.
_D = np.arange(-255, 256)
_CAT = np.array([int(abs(d)).bit_length() for d in _D])
_BLOCK_BITS = (((_CODE[_CAT] << _CAT) | np.where(_D >= 0, _D, _D + (1 << _CAT) - 1)) << 1).astype(np.uint32)
_BLOCK_LEN = (_LEN[_CAT] + _CAT + 1).astype(np.int64)


def payload_of(text: str | None) -> bytes:
    """UTF-8, closed with bytes 255 to a positive multiple of 576."""
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """The stored form of payloads (multiples of 576 bytes): JPEG files, frame after frame."""
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW).astype(np.int16)
    diff = np.diff(rows, axis=1, prepend=np.int16(128)) + np.int16(255)
    bits, size = _BLOCK_BITS[diff], _BLOCK_LEN[diff]
    used = size.sum(1)
    nbytes = (used + 7) >> 3
    first = np.cumsum(nbytes) - nbytes
    at = (np.cumsum(size, 1) - size + (first << 3)[:, None]).ravel()
    # each block has at most 16 bits: it lies in the 32-bit word where it starts and the next one, and every word has a start
    total, word = int(nbytes.sum()), at >> 5
    window = bits.ravel().astype(np.uint64) << (64 - (at & 31) - size.ravel()).astype(np.uint64)
    begins = np.r_[0, np.flatnonzero(word[1:] != word[:-1]) + 1]
    words = np.zeros(len(begins) + 1, np.uint64)
    words[:-1] = np.add.reduceat(window >> np.uint64(32), begins)
    words[1:] |= (window & np.uint64(0xFFFFFFFF))[np.r_[begins[1:] - 1, len(window) - 1]]
    out = words.astype(">u4").view(np.uint8)[:total].copy()
    last = first + nbytes - 1
    out[last] |= ((1 << (-used & 7)) - 1).astype(np.uint8)  # the rest of a row's last byte is ones
    # a zero byte after each 255, then the restart marker after each row
    full = out == 255
    grown = np.cumsum(full)
    row = np.repeat(np.arange(len(rows)), nbytes)
    place = np.arange(total) + grown - full + 2 * row
    stuffed = np.zeros(total + int(grown[-1]) + 2 * len(rows), np.uint8)
    stuffed[place] = out
    ends = last + grown[last] + 2 * np.arange(len(rows))  # place of the last byte of each row, its stuffing included
    files, r = [], 0
    data = stuffed
    starts = np.r_[0, ends + 3][: len(rows) + 1]
    index = np.empty(len(rows), np.int64)
    spans = []
    for p in payloads:
        n = len(p) // ROW
        frames = []
        for f in range(0, n, FRAME_ROWS):
            k = min(FRAME_ROWS, n - f)
            index[r + f : r + f + k] = np.arange(k)
            frames.append((r + f, k))
        spans.append(frames)
        r += n
    data[ends + 1] = 255
    data[ends + 2] = 0xD0 + index % 8
    for frames in spans:
        files.append(b"".join(_header(k) + data[starts[a] : ends[a + k - 1] + 1].tobytes() + b"\xff\xd9" for a, k in frames))
    return files


class Scan:
    """One baseline scan with what is needed to decode it: frame, components, tables, and its restart intervals' bytes."""

    __slots__ = ("ac", "blocks", "body", "dc", "height", "intervals", "luma", "per_mcu", "quant", "restart", "wide", "width")


def parse(data: bytes) -> list[Scan]:
    """The frames of a file. Raises ValueError for what is not baseline JPEG."""
    at, scans, quant, dc, ac, frame, restart = 0, [], {}, {}, {}, None, 0
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        marker = data[at + 1] if at + 1 < len(data) else -1
        at += 2
        if marker in (0xD8, 0xFF):
            quant, dc, ac, frame, restart = ({}, {}, {}, None, 0) if marker == 0xD8 else (quant, dc, ac, frame, restart)
            at -= marker == 0xFF
            continue
        if marker == 0xD9:
            continue
        if marker == -1 or at + 2 > len(data):
            raise ValueError("cut short")
        size = int.from_bytes(data[at : at + 2], "big")
        body, at = data[at + 2 : at + size], at + size
        if marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quant[body[0] & 15] = int.from_bytes(body[1 : 1 + wide], "big")  # the DC step comes first
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                counts = tuple(body[1:17])
                n = sum(counts)
                (ac if body[0] >> 4 else dc)[body[0] & 15] = counts, tuple(body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("not 8-bit samples")
            h, w = struct.unpack(">HH", body[1:5])
            frame = w, h, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("scan before frame")
            x = Scan()
            w, h, parts = frame
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            if len(chosen) != len(parts):
                raise ValueError("components in several scans")
            hm, vm = max(p[1] for p in parts), max(p[2] for p in parts)
            if len(parts) == 1:
                parts, hm, vm = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
            try:
                order = [(i, dc[chosen[c] >> 4], ac[chosen[c] & 15]) for i, (c, hs, vs, _) in enumerate(parts) for _ in range(hs * vs)]
                x.quant = quant[parts[0][3]]
            except KeyError as e:
                raise ValueError("table missing") from e
            x.width, x.height, x.restart = w, h, restart
            x.per_mcu, x.dc, x.ac = [o[0] for o in order], [o[1] for o in order], [o[2] for o in order]
            x.wide, high = -(-w // (8 * hm)), -(-h // (8 * vm))
            x.luma, x.blocks = (parts[0][1], parts[0][2]), x.wide * high * len(order)
            body = np.frombuffer(data, np.uint8, offset=at)
            marks = np.flatnonzero((body[:-1] == 255) & (body[1:] != 0))
            ends = marks[~((body[marks + 1] >= 0xD0) & (body[marks + 1] <= 0xD7))]
            stop = int(ends[0]) if len(ends) else len(body)
            marks = marks[marks < stop]
            x.intervals, x.body = np.stack([np.r_[0, marks + 2], np.r_[marks, stop]]), body[:stop]
            at += stop
            scans.append(x)
    if not scans:
        raise ValueError("no scan")
    return scans


def dc_values(scans: list[list[Scan]]) -> list[list[np.ndarray]]:
    """Quantised DC values of every block of every scan, in scan order. Intervals with the same tables are decoded side by side."""
    out = [[np.zeros(s.blocks, np.int64) for s in own] for own in scans]
    groups: dict[tuple, list[tuple[Scan, np.ndarray]]] = {}
    for f, own in enumerate(scans):
        for k, s in enumerate(own):
            groups.setdefault((tuple(s.per_mcu), tuple(s.dc), tuple(s.ac)), []).append((s, out[f][k]))
    for (per_mcu, dcs, acs), jobs in groups.items():
        _decode_group(per_mcu, dcs, acs, jobs)
    return out


def _decode_group(per_mcu, dcs, acs, jobs) -> None:
    """All intervals advance by one block a step; a block that is not DC-only goes symbol by symbol."""
    lo, hi, n, owners, base = [], [], [], [], 0
    for s, _ in jobs:
        step = s.restart * len(s.per_mcu) if s.restart else s.blocks
        m = min(s.intervals.shape[1], -(-s.blocks // step))
        lo.append(s.intervals[0, :m] + base)
        hi.append(s.intervals[1, :m] + base)
        n.append(np.minimum(step, s.blocks - step * np.arange(m)))
        owners.append((m, step))
        base += len(s.body)
    lo, hi, n = np.concatenate(lo), np.concatenate(hi), np.concatenate(n)
    raw = np.concatenate([s.body for s, _ in jobs])
    stuffing = np.r_[False, (raw[1:] == 0) & (raw[:-1] == 255)]
    dropped = np.r_[0, np.cumsum(stuffing, dtype=np.int64)]
    start, stop = lo - dropped[lo], hi - dropped[hi]
    flat = np.concatenate([raw[~stuffing], np.zeros(8, np.uint8)]).astype(np.uint32)
    word = (flat[:-3] << 24) | (flat[1:-2] << 16) | (flat[2:-1] << 8) | flat[3:]  # 32 bits from each byte on
    bit, limit, tables = start << 3, stop << 3, {}
    most, even = int(n.max()), bool((n == n[0]).all())
    values = np.zeros((most, len(n)), np.int32)
    pred = np.zeros((max(per_mcu) + 1, len(n)), np.int32)
    top, live = len(word) - 1, slice(None)
    for step in range(most):
        if not even:
            live = np.flatnonzero(n > step)
        b = step % len(per_mcu)
        if b not in tables:
            tables[b] = _blocks(dcs[b], acs[b]), _lookup(*dcs[b]), _lookup(*acs[b])
        (used, diff), dc, ac = tables[b]
        at = bit[live]
        peek = (word[np.minimum(at >> 3, top)] >> (16 - (at & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        took, d = used[peek], diff[peek]
        slow = np.flatnonzero(took == 0)
        if len(slow):
            took[slow], d[slow] = _slow_block(word, at[slow], top, dc, ac)
        bit[live] = at + took
        pred[per_mcu[b], live] += d
        values[step, live] = pred[per_mcu[b], live]
    if (bit > limit + 7).any():
        raise ValueError("scan cut short")
    r = 0
    for (_, v), (m, step) in zip(jobs, owners, strict=True):
        own = values[:step, r : r + m].T.ravel()[: len(v)]
        v[: len(own)] = own
        r += m


def _slow_block(word, at, top, dc, ac):
    """One whole block at each bit place: bits taken and DC difference. AC values are passed over."""
    here = at.copy()
    peek16 = lambda p: ((word[np.minimum(p >> 3, top)] >> (16 - (p & 7)).astype(np.uint32)) & np.uint32(0xFFFF)).astype(np.int64)
    p = peek16(here)
    n, cat = dc[0][p], dc[1][p]
    if (n == 0).any():
        raise ValueError("bad DC code")
    here += n
    extra = peek16(here) >> (16 - cat)
    d = np.where(cat == 0, 0, np.where(extra >> np.maximum(cat - 1, 0) & 1, extra, extra - (1 << cat) + 1))
    here += cat
    k, open_ = np.ones(len(at), np.int64), np.arange(len(at))
    while len(open_):
        p = peek16(here[open_])
        n, rs = ac[0][p], ac[1][p]
        if (n == 0).any():
            raise ValueError("bad AC code")
        here[open_] += n + (rs & 15)
        k[open_] = np.where(rs == 0, 64, k[open_] + (rs >> 4) + 1)
        open_ = open_[k[open_] < 64]
    return here - at, d


def thumbnail(scan: Scan, dc: np.ndarray) -> np.ndarray:
    """One 8-bit luminance sample per 8x8 block, as wide and high as the image needs."""
    m, (h, v) = len(scan.per_mcu), scan.luma
    own = dc.reshape(-1, m)[:, : h * v].reshape(-1, scan.wide, v, h).transpose(0, 2, 1, 3).reshape(-1, scan.wide * h)
    grey = np.clip((own * scan.quant + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    return grey[: -(-scan.height // 8), : -(-scan.width // 8)]


def dhash(thumb: np.ndarray) -> str:
    """A 64-bit difference hash: nine by eight sampled means, each compared with its right neighbour."""
    rows = np.array_split(np.arange(thumb.shape[0]), 8) if thumb.shape[0] >= 8 else [np.array([i * thumb.shape[0] // 8]) for i in range(8)]
    cols = np.linspace(0, thumb.shape[1] - 1, 9).astype(int)
    grid = np.stack([thumb[r][:, cols].sum(0, dtype=np.int64) / len(r) for r in rows])
    return f"{int(''.join('1' if x else '0' for x in (grid[:, 1:] > grid[:, :-1]).ravel()), 2):016x}"


def decode_files(files: list[bytes | None]) -> list[tuple[list[Scan], list[np.ndarray]] | ValueError | None]:
    """Scans and thumbnails of each file; None for null, the error for a file that is not whole baseline JPEG."""
    parsed: list = []
    for f in files:
        try:
            parsed.append(None if f is None else parse(f))
        except (ValueError, IndexError, struct.error) as e:
            parsed.append(ValueError(str(e)))
    good = [i for i, p in enumerate(parsed) if isinstance(p, list)]

    def values(which: list[int]) -> dict[int, list[np.ndarray] | ValueError]:
        try:
            return dict(zip(which, dc_values([parsed[i] for i in which]), strict=True))
        except ValueError as e:  # one bad file must not spoil the others
            if len(which) == 1:
                return {which[0]: e}
            half = len(which) // 2
            return values(which[:half]) | values(which[half:])

    found = values(good) if good else {}
    out: list = []
    for i, p in enumerate(parsed):
        if i not in found or isinstance(found[i], ValueError):
            out.append(found.get(i, p))
        else:
            out.append((p, [thumbnail(s, d) for s, d in zip(p, found[i], strict=True)]))
    return out


def features_of(found) -> tuple:
    """The FEATURES of a decoded file."""
    if found is None:
        return (None,) * 8
    if isinstance(found, ValueError):
        return (None,) * 7 + (str(found),)
    scans, thumbs = found
    sha = hashlib.sha256(b"".join(t.tobytes() for t in thumbs)).hexdigest()
    return scans[0].width, sum(s.height for s in scans), len(scans), thumbs[0].shape[1], sum(len(t) for t in thumbs), sha, dhash(thumbs[0]), None


def media_columns(df: DataFrame, media: str = "media", carry: list[str] | None = None, samples: str | None = None) -> DataFrame:
    """Adds to the columns ``carry`` (all unless given) the dimensions and thumbnail hashes of JPEG bytes; ``samples`` names a column for the thumbnail's bytes.

    A null file gives nulls, a file that is not whole baseline JPEG nulls and its reason in ``media_error``. Several
    images end to end count as frames of one: heights add up. Input columns with the names of new ones are replaced.
    """
    from pyspark.sql.types import BinaryType, StructType, _parse_datatype_string

    made = _parse_datatype_string(FEATURES)
    if samples:
        made = made.add(samples, BinaryType())
    keep = [c for c in (df.columns if carry is None else carry) if c not in made.names]
    schema = StructType([df.schema[c] for c in keep] + made.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 5 + [pa.string()] * 3
        for b in pieces(batches, media, BATCH_BYTES):
            found = decode_files(b[media].to_pylist())
            cols = [pa.array(c, t) for c, t in zip(zip(*map(features_of, found), strict=True), types, strict=True)]
            if samples:
                cols.append(pa.array([b"".join(t.tobytes() for t in x[1]) if isinstance(x, tuple) else None for x in found], pa.binary()))
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], *cols], names=schema.names)

    return df.mapInArrow(run, schema)


def store_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text, null as empty, as stored JPEG bytes. Equal texts, equal bytes."""
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_bytes bigint, media binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", BATCH_BYTES):
            media = encode_payloads([payload_of(t) for t in b["text"].to_pylist()])
            n = pc.cast(pc.fill_null(pc.binary_length(b["text"]), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"], n, pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
