"""Tables that jobs keep: a folder all machines share, and a table of buckets to which each batch is applied once."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below spark.checkpoint.dir, which Spark reads and writes; deleted when the driver ends.

    Without the setting the context's checkpoint folder counts, or on a local master a new local one; on a cluster this raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not base and found.isDefined():
        base = found.get()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="postmill-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base}/{label}-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(folder)
    system.deleteOnExit(folder)
    return path


class BucketTable:
    """Rows by bucket (an hour, a day) and key in a folder. A batch is applied whole or not at all, and once.

    A batch's buckets are staged under its version: the batch's rows, and those that the table has there under other keys.
    One small log file, which appears by a rename, names the batch and its buckets; from then on they are
    read from the new version. A batch whose log exists changes nothing, so one that is replayed after a failure does no harm,
    and what a failed attempt had staged is overwritten by the next. One writer at a time, as a stream has. Keys may be null.

    A version's buckets lie in up to GROUPS folders by a hash, so files grow with bytes and not with buckets. A batch is
    computed once: what is compared, merged and logged is read from the rows that were written.
    """

    #: Folders of a version. Reading a few buckets reads as many folders at most.
    GROUPS = 64
    LOG = StructType().add("version", LongType()).add("batch", StringType()).add("slot", StringType())

    def __init__(self, spark: SparkSession, path: str, schema: StructType, bucket: str, keys: list[str]):
        if {"version", "slot", "slot_group"} & {n.lower() for n in schema.names}:
            raise ValueError("version, slot and slot_group are names of the table's own columns")
        self.spark, self.path, self.schema, self.bucket, self.keys = spark, path, schema, bucket, [bucket, *keys]

    def _folder(self, name: str) -> str:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
        return f"{self.path}/{name}"

    def _slot(self) -> Column:
        """A bucket as text."""
        return F.col(self.bucket).cast("string")

    def _group(self) -> Column:
        return F.pmod(F.hash("slot"), F.lit(self.GROUPS))

    def log(self) -> DataFrame:
        """(version, batch, slot): the buckets that each batch wrote. One without rows counts as well."""
        return self.spark.read.schema(self.LOG).option("recursiveFileLookup", True).json(self._folder("log"))

    def applied(self, batch: str) -> bool:
        return bool(self.log().where(F.col("batch") == batch).limit(1).count())

    def _next(self) -> int:
        return self.log().agg(F.coalesce(F.max("version") + 1, F.lit(0))).first()[0]

    def read(self, slots: DataFrame | None = None, slot: bool = False) -> DataFrame:
        """The rows as the last batch left them, if asked with their slot; with ``slots`` (a column slot), only of those buckets. Versions without such buckets are not opened; the join prunes folders of others."""
        return self._read(slots).select(*self.schema.names, *(["slot"] if slot else []))

    def _read(self, slots: DataFrame | None = None) -> DataFrame:
        current = self.log().groupBy("slot").agg(F.max("version").alias("version"))
        if slots is not None:
            current = current.join(slots, "slot", "left_semi")
        held = self._data([r[0] for r in current.select("version").distinct().collect()])
        return held.join(current.withColumn("slot_group", self._group()), ["version", "slot_group", "slot"], "left_semi")

    def _data(self, versions: list[int]) -> DataFrame:
        """All rows of versions with version, slot_group and slot, as they were written."""
        whole = StructType([*self.schema.fields]).add("slot", StringType()).add("version", LongType()).add("slot_group", IntegerType())
        if not versions:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/version={v}" for v in sorted(versions)])

    def _write(self, rows: DataFrame, version: int, mode: str) -> None:
        # a group's rows come together, so it is one file, or several if it is large; by bucket, so that a reader can skip pages
        dealt = rows.withColumn("slot_group", self._group()).hint("rebalance", "slot_group").sortWithinPartitions("slot_group", "slot")
        dealt.write.mode(mode).partitionBy("slot_group").parquet(f"{self._folder('data')}/version={version}")

    def _commit(self, slots: DataFrame, batch: str, version: int) -> None:
        slots.select(F.lit(version).cast("bigint").alias("version"), F.lit(batch).alias("batch"), "slot").coalesce(1).write.mode("overwrite").json(f"{self._folder('log')}/{version}")

    def apply(self, rows: DataFrame, batch: str) -> bool:
        """Merge a batch of rows, of which no two have the same bucket and key: they replace or join what is there. False if it was applied before."""
        if self.applied(batch):
            return False
        version = self._next()
        self._write(rows.select(*self.schema.names).withColumn("slot", self._slot()), version, "overwrite")
        new = self._data([version])
        slots = new.select("slot").distinct()
        old = self._read(slots)
        same = reduce(lambda a, b: a & b, [F.equal_null(F.col(f"old.{k}"), F.col(f"new.{k}")) for k in self.keys])
        kept = old.alias("old").join(new.select(*self.keys).alias("new"), same, "left_anti")
        self._write(kept.select(*self.schema.names, "slot"), version, "append")
        self._commit(slots, batch, version)
        return True

    def replace(self, rows: DataFrame, within: Column, batch: str) -> DataFrame:
        """Make the buckets for which ``within`` holds what ``rows`` says, and write only those that differ. Returns these, as (slot).

        Buckets are compared by the number and the summed hashes of their rows, so one row a bucket is shuffled, and a run over a
        day of which one hour has changed writes that hour. A bucket that has no rows any more is emptied.
        """
        if not self.applied(batch):
            version, names = self._next(), self.schema.names
            staged, whole = f"{self._folder('staged')}/{version}", StructType([*self.schema.fields]).add("slot", StringType())
            rows.where(within).select(*names).withColumn("slot", self._slot()).write.mode("overwrite").parquet(staged)
            right = self.spark.read.schema(whole).parquet(staged)
            print_of = lambda df: df.groupBy("slot").agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.isnull(n) for n in names], *names).cast("decimal(38,0)")).alias("h"))
            new, old = print_of(right).withColumnsRenamed({"n": "m", "h": "g"}), print_of(self._read().where(within))
            changed = new.join(old, "slot", "full").where(~(F.equal_null("n", "m") & F.equal_null("h", "g"))).select("slot")
            # the list is written, since it must stay as it is once the new version counts
            changed.coalesce(1).write.mode("overwrite").json(f"{self._folder('changed')}/{version}")
            slots = self.spark.read.schema("slot string").json(f"{self.path}/changed/{version}")
            self._write(right.join(slots, "slot", "left_semi").select(*names, "slot"), version, "overwrite")
            self._commit(slots, batch, version)
            folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        return self.log().where(F.col("batch") == batch).select("slot")

    def vacuum(self) -> list[int]:
        """Delete the versions of which no bucket is current; returns their numbers. Not while another job reads."""
        current = {r[0] for r in self.log().groupBy("slot").agg(F.max("version").alias("v")).select("v").distinct().collect()}
        gone = sorted({r[0] for r in self.log().select("version").distinct().collect()} - current)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for v in gone:
            folder = path(f"{self.path}/data/version={v}")
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        return gone


def bucket_sink(table: BucketTable, name: str):
    """For foreachBatch of a stream: each micro-batch is applied once, under the stream's name and the batch's number."""

    def write(rows: DataFrame, batch: int) -> None:
        table.apply(rows, f"{name}-{batch}")

    return write
