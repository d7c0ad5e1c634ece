"""Corpus search by a stored index: folded lines in blocks by age, and posting lists of words and of three-letter runs.

The index is four Parquet tables. ``lines`` holds each text with its folded line, sorted by block; a block is some thousand rows of
neighbouring times, the newest first. ``words`` and ``grams`` (two folders of ``lists``) hold, bucketed by a hash of the first three letters, for
each word or run and block the ids that have it, and the most times that one of them does (a run: once). ``blocks`` holds each block's rows
and newest time. Lists are made block by block with Arrow and numpy: no row is made for a word or run of a text. A query reads the buckets of its terms, meets lists block by block, and looks at the lines of what
is left; a ranked page leaves out blocks whose bound is below the page's last rank.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.operators import search as S

BLOCK, BUCKETS = 2048, 64
KINDS = ("words", "grams")
#: Letters and digits of a folded line. Lines are taken apart in slices of about so many bytes.
LETTERS, SLICE = "abcdefghijklmnopqrstuvwxyz0123456789", 4 << 20
#: More candidate blocks than this are not listed in a filter: then most of the lines are read anyway.
LISTED = 2_000


@dataclass
class Index:
    spark: SparkSession
    path: str
    schema: str  # of words and grams, which have no file if no text has a word
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        """A table of the index; its files are listed once."""
        if name not in self.tables:
            folder = f"lists/kind={name}" if name in KINDS else name
            self.tables[name] = (self.spark.read.schema(self.schema) if name in KINDS else self.spark.read).parquet(f"{self.path}/{folder}")
        return self.tables[name]


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(word, 1, 3)), F.lit(BUCKETS)).cast("int")


def _in_buckets(words: list[str]) -> Column:
    """Whether a row lies in a bucket of the words: constants, by which folders are pruned."""
    return F.col("bucket").isin([_bucket(F.lit(w)) for w in words])


def build(corpus: DataFrame, path: str, block: int = BLOCK) -> Index:
    """Index a corpus (id, text, effective_at, and what else it has). Null texts are indexed as empty ones; ids must differ."""
    spark = corpus.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    aged = corpus.repartitionByRange(parts, F.desc("effective_at"), F.desc("id")).sortWithinPartitions(F.desc("effective_at"), F.desc("id"))
    # numbers grow through the sorted partitions, so a block holds neighbours in time
    placed = aged.withColumn("block", F.floor(F.monotonically_increasing_id() / block)).withColumn("line", T.word_line(F.coalesce(F.col("text"), F.lit(""))))
    placed.write.option("parquet.block.size", 8 << 20).parquet(f"{path}/lines")
    lines = spark.read.parquet(f"{path}/lines")
    lines.groupBy("block").agg(F.count("*").alias("rows"), F.max("effective_at").alias("newest"), F.min("effective_at").alias("oldest")).write.parquet(f"{path}/blocks")
    id_type = dict(lines.dtypes)["id"]
    lists = lines.select("block", "id", "line").groupBy("block").applyInArrow(block_lists, f"kind string, block bigint, word string, ids array<{id_type}>, most bigint")
    # a bucket's lists come together, so it is one file, or several if it is large
    bucketed = lists.withColumn("bucket", _bucket(F.col("word"))).hint("rebalance", "kind", "bucket").sortWithinPartitions("kind", "bucket", "word")
    bucketed.write.partitionBy("kind", "bucket").parquet(f"{path}/lists")
    for kind in KINDS:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/lists/kind={kind}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    return Index(spark, path, f"block bigint, word string, ids array<{id_type}>, most bigint, bucket int")


def block_lists(table):
    """The lists of one block (block, id, line): words and runs of three letters with the ids that have them."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    ids, line, n = table["id"].combine_chunks(), table["line"].combine_chunks(), table.num_rows

    def lists(kind, names, keys, times):
        """keys: name * n + row, sorted; names are told by number."""
        name, row = np.divmod(keys, n)
        starts = np.flatnonzero(np.diff(name, prepend=-1))
        held = pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)), pa.int32()), ids.take(pa.array(row)))
        most = np.maximum.reduceat(times, starts) if len(starts) else times
        word = names.take(pa.array(name[starts])).cast(pa.string())
        return pa.table({"kind": pa.array([kind] * len(starts), pa.string()), "block": pa.repeat(table["block"][0], len(starts)), "word": word, "ids": held, "most": pa.array(most, pa.int64())})

    split = pc.split_pattern(pc.utf8_trim(line, " "), " ")
    encoded, parent = pc.list_flatten(split).dictionary_encode(), pc.list_parent_indices(split)
    words, place = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keep = np.array([w != "" for w in words.to_pylist()], bool)[place] if len(words) else np.zeros(0, bool)
    keys, times = np.unique(place[keep] * n + parent.to_numpy(zero_copy_only=False)[keep], return_counts=True)

    # which run each row has, as a field of flags: run * n + row
    flags, code = np.zeros(len(LETTERS) ** 3 * n, bool), np.zeros(256, np.int64)
    code[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(len(LETTERS))
    low, sizes = 0, np.cumsum(pc.binary_length(line).to_numpy(zero_copy_only=False))
    while low < n:
        high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + SLICE, "right")))
        packed = [t.replace(" ", "") for t in line.slice(low, high - low).to_pylist()]
        letters, row = code[np.frombuffer("".join(packed).encode(), np.uint8)], np.repeat(np.arange(low, high), [len(t) for t in packed])
        if len(row) > 2:
            run = letters[:-2] * len(LETTERS) ** 2 + letters[1:-1] * len(LETTERS) + letters[2:]
            flags[(run * n + row[2:])[row[:-2] == row[2:]]] = True
        low = high
    runs, names = np.flatnonzero(flags), pa.array([a + b + c for a in LETTERS for b in LETTERS for c in LETTERS])
    return pa.concat_tables([lists("words", words, keys, times), lists("grams", names, runs, np.ones(len(runs), np.int64))])


def anywhere(term: str) -> bool:
    """Whether a term is also looked for inside and across words, as search._term does."""
    return len(term) >= 3 and (not term.isdigit() or 9 <= len(term) <= 11)


def _needs(q: S.Query) -> list[tuple[str, str]]:
    """What a hit must have: ("word", w) a word, ("start", t) a word that begins so, ("gram", g) a run of letters."""
    out = []
    for t in q.terms:
        if anywhere(t):
            out += [("gram", t[i : i + 3]) for i in range(len(t) - 2)]
        else:
            out.append(("word" if len(t) <= 2 or (t.isdigit() and len(t) < 4) else "start", t))
    return list(dict.fromkeys([*out, *(("word", w) for p in q.phrases for w in p)]))


def candidates(index: Index, q: S.Query) -> DataFrame | None:
    """(block, ids): the rows that have all that the query needs, block by block; None if it needs nothing. Only the needed buckets are read."""
    needs = _needs(q)
    if not needs:
        return None
    lists = []
    for table, kinds in (("words", ("word", "start")), ("grams", ("gram",))):
        own = [(k, v) for k, v in needs if k in kinds]
        if own:
            held = index.table(table).where(_in_buckets([v for _, v in own]))
            exact = [v for k, v in own if k != "start"]
            if exact:
                lists.append(held.where(F.col("word").isin(exact)).select("block", "ids"))
            # the words that begin with a term are one list
            lists += [held.where(F.col("word").startswith(v)).groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids")) for k, v in own if k == "start"]
    if len(needs) == 1:
        return lists[0]
    # a block's lists are bounded by the block
    met = reduce(DataFrame.unionByName, lists).groupBy("block").agg(F.collect_list("ids").alias("lists")).where(F.size("lists") == len(needs))
    both = F.aggregate(F.slice("lists", 2, len(needs)), F.get("lists", F.lit(0)), F.array_intersect)
    return met.select("block", both.alias("ids")).where(F.size("ids") > 0)


def hits(index: Index, q: S.Query, blocks: list[int] | None = None) -> DataFrame:
    """The rows of ``lines`` for which the query holds, exactly: candidates come from the lists, the line decides."""
    lines, found = index.table("lines"), candidates(index, q)
    if blocks is not None:
        lines = lines.where(F.col("block").isin(blocks))
    if found is None:
        return lines.where(S.line_predicate(q, F.col("line")))
    if blocks is None:
        listed = [r["block"] for r in found.select("block").limit(LISTED + 1).collect()]
        lines = lines.where(F.col("block").isin(listed)) if len(listed) <= LISTED else lines
    return lines.join(found.select("block", F.explode("ids").alias("id")), ["block", "id"], "left_semi").where(S.line_predicate(q, F.col("line")))


def bounds(index: Index, q: S.Query, now: Column, weight: float, hours: float) -> DataFrame:
    """(block, bound): what no rank in the block can exceed: each of a text's shortest covers ends at a hit of its own and counts 0.1 at most, and none is younger than the newest."""
    names = list(dict.fromkeys([*q.terms, *(w for p in q.phrases for w in p)]))
    age = F.greatest((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("newest").cast("timestamp"))) / 3600.0, F.lit(0.0))
    fresh = index.table("blocks").select("block", (weight * F.exp(-age / hours)).alias("fresh"))
    if not names:
        return fresh.select("block", F.col("fresh").alias("bound"))
    held = index.table("words").where(_in_buckets(names))
    begins = reduce(lambda a, b: a | b, [F.col("word") == n if len(n) <= 2 else F.col("word").startswith(n) for n in names])
    most = held.where(begins).groupBy("block").agg((0.1 * F.sum("most")).alias("x"))
    # rounding a rank may lift it by half a millionth
    return fresh.join(most, "block", "left").select("block", (F.coalesce(F.col("x") / (F.col("x") + 1), F.lit(0.0)) + F.col("fresh") + 1e-6).alias("bound"))


@dataclass
class Page:
    rows: DataFrame
    ranked_blocks: int
    hit_blocks: int


def top(index: Index, text: str, now: Column, size: int = 25, newest: int | None = None, weight: float = S.RECENCY_WEIGHT, hours: float = 24 * S.RECENCY_DAYS) -> Page:
    """search.search by the index: the best ``size`` of all hits, or of the ``newest`` ones if so many are asked for. Blocks that cannot reach the page are not ranked.

    Hits are counted by block, and the blocks with the highest bounds, one for each place of the page at most, are ranked first. The last
    rank of that page leaves out every block with a lower bound.
    """
    q = S.parse(text)
    kept = hits(index, q).select("block", "id", "effective_at")
    if newest is not None:
        # at most ``newest`` short rows; they can be computed again
        kept = kept.orderBy(F.desc("effective_at"), F.desc("id")).limit(newest).cache()
    # one short row for each block with a hit
    by_block = kept.groupBy("block").agg(F.count("*").alias("n")).join(bounds(index, q, now, weight, hours), "block").cache()
    of_page = by_block.orderBy(F.desc("bound"), F.desc("block")).limit(size).collect()

    def ranked(blocks: DataFrame, listed: list[int]) -> DataFrame:
        rows = index.table("lines")
        rows = rows.where(F.col("block").isin(listed)) if len(listed) <= LISTED else rows.join(blocks.select("block"), "block", "left_semi")
        if newest is None:
            rows = rows.where(S.line_predicate(q, F.col("line")))
        else:
            rows = rows.join(kept.select("block", "id"), ["block", "id"], "left_semi")
        return rows.withColumn("rank", S.rank(q, now, F.col("line"), weight, hours)).select("id", "effective_at", "rank", T.snippet(F.col("text")).alias("snippet"))

    best = lambda rows: rows.orderBy(F.desc("rank"), F.desc("effective_at"), F.desc("id")).limit(size)
    first, n = [], 0
    for r in of_page:
        if n >= size:
            break
        first.append(r["block"])
        n += r["n"]
    hit_blocks = by_block.count()
    if len(first) == hit_blocks:
        return Page(best(ranked(by_block, first)), len(first), hit_blocks)
    last = best(ranked(by_block, first)).agg(F.min("rank")).first()[0]
    # those ranked first have the highest bounds, so they are among these
    rest = by_block.where(F.col("bound") >= F.lit(last if last is not None else -math.inf))
    listed = [r["block"] for r in rest.select("block").limit(LISTED + 1).collect()]
    return Page(best(ranked(rest, listed)), len(listed) if len(listed) <= LISTED else rest.count(), hit_blocks)
