"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, verified once per pair.

Every document becomes the set of its word n-grams, as 64-bit hashes. Equal sets are one class, of which one row stands for
all. How many classes hold an n-gram is counted in Spark and kept, for those that more than one holds, as sorted hash
arrays in the shared folder, which workers memory-map. Each set is ordered from rare to frequent; two sets that link share
an n-gram within their prefixes, and n-grams that only one class holds count towards the prefix without ever being joined.

Sets that share a prefix n-gram form a bin. Each is first verified against its bin's leader, which is linear in the bin: the set
with the fewest n-grams of its own, as the text that others were copied from has.
Only bins that are not one component by then are searched further: small ones pair by pair, large ones in pairs of blocks,
each of which is one task's work. So no link between components is lost and no bin is ever gathered as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.shared import TALLY, HashShards, Tally, ensure_checkpoint_dir, free_name, mix, pieces, read_tally, shared_dir, shards_of, to_shards, word_hashes, words_of

#: Bins up to this size are searched pair by pair, larger ones in blocks of about BLOCK sets.
PAIRED = 32
BLOCK = 128
#: Ranges of the hash space in which the suffix filter counts.
PARTS = 32


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all texts end to end, and where each text starts (one place more at the end).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. A text with fewer than n words has one: all its words. Null: none.
    """
    flat, counts = words_of(texts)
    hashes, at = word_hashes(flat)
    h = mix(hashes)[at] if len(hashes) else np.empty(0, np.uint64)
    start = np.cumsum(counts) - counts
    grams = mix(h)
    for k in range(1, n):
        grams = mix(grams[: max(len(h) - k, 0)] + h[k:])
    found = []
    for s, c in zip(start.tolist(), counts.tolist(), strict=True):
        if c >= n:
            found.append(np.unique(grams[s : s + c - n + 1]))
        elif c:
            key = mix(h[s : s + 1])
            for k in range(1, c):
                key = mix(key + h[s + k : s + k + 1])
            found.append(key)
        else:
            found.append(h[:0])
    return np.concatenate(found) if found else h, np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int64)


def _set_ids(keys: np.ndarray, edge: np.ndarray) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(keys[s:e]) for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)), np.uint64, len(edge) - 1)


def _nullable(ids: np.ndarray, edge: np.ndarray) -> pa.Array:
    return pa.array(ids.view(np.int64), mask=np.diff(edge) == 0)


@dataclass
class Standing:
    """Which row stands for a class of several rows, or stays of it: by set, the tag (hash of the id) of that row."""

    tags: HashShards

    def chosen(self, ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """True for rows whose set is not listed, and for those with the listed tag."""
        order = np.argsort(ids)
        out = np.ones(len(ids), bool)
        for s, i, p in self.tags.find(ids[order]):
            rows = order[i]
            out[rows] = self.tags.array("tag", s)[p] == tags[rows]
        return out


def write_standing(rows: DataFrame, label: str) -> Standing:
    """Sets (set_id, tag) as sorted arrays in the shared folder."""
    spark = rows.sparkSession
    shards = shards_of(spark)
    held = HashShards(shared_dir(spark, label), "set", shards)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            keys, tags = (np.concatenate([b[c].to_numpy() for b in got]) for c in ("set_id", "tag"))
            keys = keys.view(np.uint64)
            order = np.argsort(keys)
            held.write(got[0]["shard"][0].as_py(), keys=keys[order], tag=tags[order])
            yield pa.RecordBatch.from_arrays([got[0]["shard"].slice(0, 1)], names=["shard"])

    # the shard is the hash's range; shifting the sign bit away keeps the order of unsigned numbers
    shard = F.floor(F.shiftrightunsigned("set_id", 32) * shards / F.lit(float(1 << 32))).cast("int")
    made = to_shards(rows.select("set_id", "tag", shard.alias("shard")), shards).mapInArrow(write, "shard int").collect()
    held.present = frozenset(r["shard"] for r in made)
    return Standing(held)


def describe(docs: DataFrame, text: str, doc_id: str, n: int) -> DataFrame:
    """doc_id, tag, set_id (null for the empty set) and n_shingles of every row."""
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, tag bigint, set_id bigint, n_shingles bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            keys, edge = shingle_sets(b["text"], n)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["tag"], _nullable(_set_ids(keys, edge), edge), pa.array(np.diff(edge))], names=["doc_id", "tag", "set_id", "n_shingles"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id).alias("tag"), F.col(text).alias("text")).mapInArrow(run, schema)


def count_shingles(docs: DataFrame, standing: Standing, text: str, doc_id: str, n: int) -> HashShards:
    """N-grams that more than one class holds, with their number of classes, as sorted arrays."""
    spark = docs.sparkSession
    shards = shards_of(spark)
    held = HashShards(shared_dir(spark, "shingles"), "shingle", shards)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(shards)
        for b in pieces(batches, "text"):
            keys, edge = shingle_sets(b["text"], n)
            stands = standing.chosen(_set_ids(keys, edge), b["tag"].to_numpy())
            k, c = np.unique(keys[np.repeat(stands, np.diff(edge))], return_counts=True)
            yield from tally.add(k, c)
        yield from tally.flush()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, keys, counts = read_tally(batches)
        if s >= 0:
            some = counts > 1
            held.write(s, keys=keys[some], count=np.minimum(counts[some], (1 << 32) - 1).astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32())], names=["shard"])

    texts = docs.select(F.xxhash64(doc_id).alias("tag"), F.col(text).alias("text"))
    made = to_shards(texts.mapInArrow(count, TALLY), shards).mapInArrow(write, "shard int").collect()
    held.present = frozenset(r["shard"] for r in made)
    return held


SET = "set_id bigint, n bigint, prefix int, grams array<bigint>, parts array<int>"


def joinable_sets(docs: DataFrame, standing: Standing, held: HashShards, text: str, doc_id: str, n: int, percent: int) -> DataFrame:
    """Classes with an n-gram in their prefix that others hold too: such n-grams rare first, how many lie in the prefix, and counts by hash range.

    A class whose prefix is filled by n-grams of its own links with nothing and is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            keys, edge = shingle_sets(b["text"], n)
            ids = _set_ids(keys, edge)
            stands = standing.chosen(ids, b["tag"].to_numpy())
            order = np.argsort(keys)
            count = np.zeros(len(keys), np.uint32)
            for s, i, p in held.find(keys[order]):
                count[order[i]] = held.array("count", s)[p]
            rows: list[tuple] = []
            grams, parts = [], []
            for d in np.flatnonzero(stands & (np.diff(edge) > 0)).tolist():
                k, c = keys[edge[d] : edge[d + 1]], count[edge[d] : edge[d + 1]]
                shared = c > 0
                prefix = len(k) - -(-percent * len(k) // 100) + 1 - int(len(k) - shared.sum())
                if prefix > 0:
                    own = k[shared]
                    own = own[np.lexsort((own, c[shared]))]
                    rows.append((ids[d], len(k), min(prefix, len(own))))
                    grams.append(own)
                    parts.append(np.bincount((own >> np.uint64(59)).astype(np.int64), minlength=PARTS))
            if rows:
                size = np.r_[0, np.cumsum([len(g) for g in grams])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array([r[0] for r in rows], np.uint64).view(np.int64)),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.int32()),
                        pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(np.concatenate(grams).view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * PARTS, pa.int32()), pa.array(np.concatenate(parts), pa.int32())),
                    ],
                    names=["set_id", "n", "prefix", "grams", "parts"],
                )

    texts = docs.select(F.xxhash64(doc_id).alias("tag"), F.col(text).alias("text"))
    return texts.mapInArrow(run, SET)


def _may_link(a: str, b: str, percent: int) -> Column:
    """Length and positional filters on two postings of one n-gram."""
    # before the common n-gram at most as many are common as the shorter part has, and likewise from it on
    most = F.least(F.col(f"{a}.i"), F.col(f"{b}.i")) + F.least(F.col(f"{a}.s") - F.col(f"{a}.i"), F.col(f"{b}.s") - F.col(f"{b}.i"))
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * most >= percent * (na + nb))


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(F.col(f"{a}.set_id"), F.col(f"{b}.set_id")).alias("a"), F.greatest(F.col(f"{a}.set_id"), F.col(f"{b}.set_id")).alias("b")]


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) that link. The suffix filter bounds the common n-grams by their counts in ranges of the hash."""
    left = sets.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"), F.col("parts").alias("pa"))
    right = sets.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"), F.col("parts").alias("pb"))
    both = pairs.distinct().join(left, "a").join(right, "b")
    bound = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    enough = lambda common: (100 + percent) * common.cast("bigint") >= percent * (F.col("na") + F.col("nb"))
    return both.where(F.when(enough(bound), enough(F.size(F.array_intersect("ga", "gb")))).otherwise(False)).select("a", "b")


def linked_in_block(grams: list[np.ndarray], sizes: np.ndarray, roots: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of different roots, as few as join the same sets. Common n-grams of all pairs come from products of 0/1 matrices."""
    m = len(grams)
    who = np.repeat(np.arange(m), [len(g) for g in grams])
    _, col = np.unique(np.concatenate(grams), return_inverse=True)
    order = np.argsort(col, kind="stable")
    who, col = who[order], col[order]
    common = np.zeros((m, m), np.float32)
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        s, e = np.searchsorted(col, [lo, lo + 4096])
        part = np.zeros((m, 4096), np.float32)
        part[who[s:e], col[s:e] - lo] = 1
        common += part @ part.T
    total = sizes[:, None] + sizes[None, :]
    a, b = np.nonzero(np.triu(((100 + percent) * common.astype(np.int64) >= percent * total) & (roots[:, None] != roots[None, :]), 1))
    names, start = np.unique(roots, return_inverse=True)
    top = list(range(len(names)))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(start[x]), find(start[y])
        if p != q:
            top[p] = q
            out.append((x, y))
    return out


def components(links: DataFrame) -> DataFrame:
    """(set_id, root): root is the least set reachable. Alternating stars; each round is written to the checkpoint folder."""
    ensure_checkpoint_dir(links.sparkSession)
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == seen or not state["n"]:
            return edges.select(F.col("u").alias("set_id"), F.col("v").alias("root"))
        seen = state["n"], state["h"]
        # large star: what is greater than a node hangs on the node's least neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: what is less than a node, and the node, hang on the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = small.where("u <> v").distinct().checkpoint()


def link_sets(sets: DataFrame, percent: int) -> DataFrame:
    """(set_id, root) of all sets that link with another."""
    postings = sets.select("set_id", "n", F.size("grams").alias("s"), F.posexplode(F.slice("grams", F.lit(1), F.col("prefix"))).alias("i", "gram"))
    bins = postings.groupBy("gram").agg(F.count("*").alias("m"), F.min(F.struct((F.col("n") - F.col("s")).alias("own"), "set_id", "n", "s", "i")).alias("x")).where("m > 1")
    led = postings.alias("y").join(bins, "gram").where(F.col("y.set_id") != F.col("x.set_id")).where(_may_link("x", "y", percent)).select(*_pair("x", "y"))
    first = verify(led, sets, percent).checkpoint()
    roots = components(first)

    # what the leaders left: bins of three and more sets in more than one component
    rooted = postings.join(bins.where("m > 2").select("gram", "m"), "gram").join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    mixed = rooted.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("gram")
    open_ = rooted.join(mixed, "gram").checkpoint()

    few = open_.where(F.col("m") <= PAIRED)
    pairs = few.alias("x").join(few.alias("y"), "gram").where((F.col("x.set_id") < F.col("y.set_id")) & (F.col("x.root") != F.col("y.root"))).where(_may_link("x", "y", percent)).select(*_pair("x", "y"))
    second = verify(pairs, sets, percent)

    # large bins: the sets outside the leader's component, in blocks, meet all sets of their bin, in blocks
    many = open_.where(F.col("m") > PAIRED)
    heads = bins.where(F.col("m") > PAIRED).select("gram", F.col("x.set_id").alias("set_id")).join(roots, "set_id", "left").select("gram", F.coalesce("root", "set_id").alias("head"))
    many = many.join(heads, "gram").withColumn("outer", F.col("root") != F.col("head"))
    sides = many.groupBy("gram").agg(*[F.ceil(F.count_if(F.col("outer") == side) / BLOCK).cast("int").alias(f"blocks_{side}".lower()) for side in (True, False)])
    many = many.join(sides, "gram").withColumn("own", F.pmod(F.xxhash64("set_id"), F.when(F.col("outer"), F.col("blocks_true")).otherwise(F.col("blocks_false"))).cast("int"))
    # an item is a block of the outer sets and another block: lo of the outer ones, hi of them (from 0) or of the inner ones (below 0)
    outer = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("blocks_true") - 1), lambda j: F.struct(F.least("own", j).alias("lo"), F.greatest("own", j).alias("hi"))),
        F.when(F.col("blocks_false") > 0, F.transform(F.sequence(F.lit(1), F.col("blocks_false")), lambda j: F.struct(F.col("own").alias("lo"), (-j).alias("hi")))).otherwise(F.array()),
    )
    inner = F.transform(F.sequence(F.lit(0), F.col("blocks_true") - 1), lambda j: F.struct(j.alias("lo"), (-F.col("own") - 1).alias("hi")))
    items = many.select("gram", "set_id", "root", F.explode(F.when(F.col("outer"), outer).otherwise(inner)).alias("item")).select("gram", "item.*", "set_id", "root")
    work = items.join(sets.select("set_id", "n", "grams"), "set_id")

    def search(rows):
        import pandas as pd

        found = linked_in_block([np.asarray(g) for g in rows["grams"]], rows["n"].to_numpy(), rows["root"].to_numpy(), percent)
        ids = rows["set_id"].to_numpy()
        return pd.DataFrame({"a": [ids[x] for x, _ in found], "b": [ids[y] for _, y in found]}, dtype="int64")

    third = work.groupBy("gram", "lo", "hi").applyInPandas(search, "a bigint, b bigint")
    return components(roots.select(F.col("set_id").alias("a"), F.col("root").alias("b")).unionByName(second).unionByName(third))


@dataclass
class Found:
    """Members (doc_id, tag, set_id, n_shingles), one row each; classes (set_id, rows, least id, its tag, root)."""

    members: DataFrame
    classes: DataFrame


def find_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 5, percent: int = 80) -> Found:
    """Runs the join. percent is the least Jaccard similarity in hundredths; five words and 80 unless told otherwise."""
    if n < 1 or not 0 < percent <= 100:
        raise ValueError("n must be positive and percent in 1..100")
    ensure_checkpoint_dir(docs.sparkSession)
    members = describe(docs, text, doc_id, n).checkpoint()
    classes = members.where("set_id is not null").groupBy("set_id").agg(F.count("*").alias("rows"), F.min("tag").alias("tag"))
    standing = write_standing(classes.where("rows > 1"), "standing")
    held = count_shingles(docs, standing, text, doc_id, n)
    # rows that repeat id and text stand twice; one is enough
    sets = joinable_sets(docs, standing, held, text, doc_id, n, percent).dropDuplicates(["set_id"]).checkpoint()
    roots = link_sets(sets, percent)
    least = members.where("set_id is not null").groupBy("set_id").agg(F.count("*").alias("rows"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("first"))
    out = least.join(roots, "set_id", "left").select("set_id", "rows", "first", F.coalesce("root", "set_id").alias("root"))
    return Found(members, out)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (least doc_id reachable by links), set_rows (rows with the same set).

    Rows with equal sets are linked. Null and empty texts have no n-grams and are linked with nothing: their component is
    their own id, their set_rows 1. A null id is never the least unless all ids of a component are null. Repeated rows stay.
    An empty table gives no rows.
    """
    found = find_classes(docs, text, doc_id, n, percent)
    least = found.classes.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    named = found.classes.join(least, "root").select("set_id", "rows", "component_id")
    # rows without n-grams stay apart: as one null key they would all be one task's
    linked = found.members.where("set_id is not null").join(named, "set_id").select("doc_id", "n_shingles", "component_id", F.col("rows").alias("set_rows"))
    alone = found.members.where("set_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).cast("bigint").alias("set_rows"))
    return linked.unionByName(alone)


def drop_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without all but one document of each component: the one with the least id (nulls last), once.

    Rows without n-grams all stay. Texts are not shuffled: what goes is known by set and id from sorted arrays in the
    shared folder. Only if a kept row is itself repeated, rows are gathered by id and text to keep it once.
    """
    tag, own = free_name("_tag", docs.columns), free_name("_set", docs.columns)
    found = find_classes(docs, text, doc_id, n, percent)
    keeper = found.classes.groupBy("root").agg(F.count("*").alias("sets"), F.sum("rows").alias("all_rows"), F.min(F.struct("first", "set_id")).alias("keep")).where("all_rows > 1")
    tagged = found.classes.join(keeper, "root").select("set_id", F.when(F.col("set_id") == F.col("keep.set_id"), F.col("keep.first.tag")).alias("kept")).checkpoint()
    going = write_standing(tagged.where("kept is null").select("set_id", F.lit(0).cast("bigint").alias("tag")), "going")
    staying = write_standing(tagged.where("kept is not null").select("set_id", F.col("kept").alias("tag")), "staying")
    repeats = found.members.join(tagged.where("kept is not null"), "set_id").where("tag = kept").groupBy("set_id").count().where("count > 1").limit(1).count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text):
            keys, edge = shingle_sets(b[text], n)
            ids, full = _set_ids(keys, edge), np.diff(edge) > 0
            listed = np.zeros(len(ids), bool)
            order = np.argsort(ids)
            for _, i, _ in going.tags.find(ids[order]):
                listed[order[i]] = True
            stay = ~full | (~listed & staying.chosen(ids, b[tag].to_numpy()))
            yield b.filter(pa.array(stay)).append_column(own, _nullable(ids, edge).filter(pa.array(stay)))

    from pyspark.sql.types import LongType, StructType

    rows = docs.select("*", F.xxhash64(doc_id).alias(tag))
    kept = rows.mapInArrow(run, StructType([*rows.schema.fields]).add(own, LongType()))
    if repeats:
        alone = kept.where(F.col(own).isNull())
        kept = kept.where(F.col(own).isNotNull()).dropDuplicates([own, tag]).unionByName(alone)
    return kept.select(*docs.columns)
