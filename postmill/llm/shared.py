"""What the training-data operators share: tables, shipping the package, the shared folder, Arrow tokens, sorted hash shards."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that a Python worker turns into arrays at a time. A single longer text is still one piece.
CHUNK_BYTES = 4 << 20
#: Bytes of an Arrow batch that goes to a worker; a batch has at least one row.
BATCH_BYTES = 8 << 20
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark only, so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; they then need no installation of it.

    Also bounds Arrow batches of the session by bytes: 10,000 long texts, the default, are too much for a worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp()) / f"{top.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share, as a local path.

    Workers memory-map files from it, so it must be mounted as a file system (``file:`` or no scheme);
    another scheme raises. Only where the setting is absent, as in tests, a local folder is made.
    """
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = "/" + base[5:].lstrip("/")
    if "://" in base:
        raise ValueError(f"spark.checkpoint.dir must be a mounted folder for memory-mapped models, not {base}")
    path = os.path.join(base, f"{label}-{uuid.uuid4().hex}")
    os.makedirs(path)
    delete_at_exit(spark, path)
    return path


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver delete an existing folder of any store when it ends."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)


def free_name(name: str, columns: list[str]) -> str:
    """The name, or the name with as many underscores as it takes to be no column's."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where unset, the context's folder, or on a local master a new local one.

    On a cluster without the setting this raises: a folder of one machine would be absent on the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(base)
        return base
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="postmill-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get()


def save_as(path: str, array: np.ndarray) -> None:
    """Write an array whole or not at all, so that a retried or speculative task does no harm."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, path)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold at most limit bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def words_of(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts in order, as one flat array, and the words of each text. Null: none."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full).as_py() and len(flat):
        keep = full.to_numpy(zero_copy_only=False)
        at = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(at[keep], minlength=len(counts)).astype(np.int64)
        flat = flat.filter(full)
    return flat, counts


def word_hashes(flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words, and for each word its place among them."""
    coded = flat.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return hashes, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs, equal outputs; all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of the hash space, in hash order."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def cuts(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard starts in sorted hashes; shards + 1 places."""
    return np.searchsorted(shard_of(hashes, shards), np.arange(shards + 1))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as byte planes under zstd; high planes of sorted keys shrink well."""
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in map(np.ascontiguousarray, arrays)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, *types: type) -> list[np.ndarray]:
    """The arrays that pack() took."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = [np.dtype(t).itemsize for t in types]
    n, out, at = len(raw) // sum(sizes), [], 0
    for t, size in zip(types, sizes, strict=True):
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(t).reshape(n))
        at += n * size
    return out


def merge_sums(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their values (whole numbers)."""
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k, v = np.concatenate(keys), np.concatenate(values).astype(np.int64)
    order = np.argsort(k, kind="stable")
    k, v = k[order], v[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(v, first) if len(first) else v


class HashShards:
    """Sorted hashes in one file per shard with value arrays beside them, memory-mapped; a lookup is a binary search.

    ``present`` are the shards that hold entries, as the jobs that wrote them report; others have no file and are empty.
    A file of a present shard that can't be found is an error, never an empty shard.
    """

    def __init__(self, folder: str, name: str, shards: int, present: frozenset[int] = frozenset()):
        self.folder, self.name, self.shards, self.present, self.maps = folder, name, shards, present, {}

    def array(self, what: str, s: int) -> np.ndarray:
        """An array of shard s: "keys" or a value array."""
        if (what, s) not in self.maps:
            self.maps[what, s] = np.load(f"{self.folder}/{self.name}-{what}-{s}.npy", mmap_mode="r") if s in self.present else np.empty(0, np.uint64)
        return self.maps[what, s]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"maps": {}}

    def write(self, s: int, **arrays: np.ndarray) -> None:
        for what, array in arrays.items():
            save_as(f"{self.folder}/{self.name}-{what}-{s}.npy", array)

    def find(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For sorted keys: the shards that hold any of them, with the numbers of the keys found and their places in the shard."""
        edge = cuts(keys, self.shards)
        for s in np.flatnonzero(np.diff(edge)).tolist():
            own, known = keys[edge[s] : edge[s + 1]], self.array("keys", s)
            if len(known):
                p = np.minimum(np.searchsorted(known, own), len(known) - 1)
                hit = np.flatnonzero(known[p] == own)
                if len(hit):
                    yield s, hit + edge[s], p[hit]


def shards_of(spark: SparkSession) -> int:
    """As many shards as the session has shuffle partitions, within what one process can map."""
    return max(1, min(4096, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def to_shards(rows: DataFrame, shards: int) -> DataFrame:
    """Rows dealt out so that partition s holds just those whose column "shard" is s."""
    return rows.repartitionById(shards, "shard")


class Tally:
    """Sums by key that leave a task as packed blobs, one per shard, whenever there are many."""

    LIMIT = 1_000_000

    def __init__(self, shards: int, shard_of_keys=shard_of):
        self.shards, self.shard_of, self.keys, self.values, self.held = shards, shard_of_keys, [], [], 0

    def add(self, keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.values.append(values)
        self.held += len(keys)
        if self.held >= self.LIMIT:
            keys, values = merge_sums(self.keys, self.values)
            self.keys, self.values, self.held = [keys], [values], len(keys)
            if self.held >= self.LIMIT // 2:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        keys, values = merge_sums(self.keys, self.values)
        self.keys, self.values, self.held = [], [], 0
        shard = self.shard_of(keys, self.shards)
        order = np.argsort(shard, kind="stable")  # keys stay sorted within a shard
        keys, values, edge = keys[order], values[order].astype(np.uint32 if not len(values) or values.max() < 1 << 32 else np.uint64), np.searchsorted(shard[order], np.arange(self.shards + 1))
        full = np.flatnonzero(np.diff(edge)).tolist()
        wide = values.dtype.itemsize
        blobs = [pack(keys[edge[s] : edge[s + 1]], values[edge[s] : edge[s + 1]]) for s in full]
        if full:
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([wide] * len(full), pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "wide", "blob"])


TALLY = "shard int, wide int, blob binary"


def read_tally(batches: Iterator[pa.RecordBatch], limit: int = 1_000_000) -> tuple[int, np.ndarray, np.ndarray]:
    """The shard (-1 without rows), sorted keys and summed values of a partition's blobs. Partial sums bound what is held."""
    shard, keys, values, held, base = -1, [], [], 0, 0
    for b in batches:
        for s, wide, blob in zip(*(b[c].to_pylist() for c in ("shard", "wide", "blob")), strict=True):
            shard = s
            k, v = unpack(blob, np.uint64, np.uint32 if wide == 4 else np.uint64)
            keys.append(k)
            values.append(v)
            held += len(k)
            if held > max(limit, 2 * base):
                k, v = merge_sums(keys, values)
                keys, values, held, base = [k], [v], len(k), len(k)
    return shard, *merge_sums(keys, values)
