"""Postings that arrive in batches, kept once, and counted as they come."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from labourlens.operators.merge import keep_first
from labourlens.session import scratch
from labourlens.sources.files import empty

BUCKETS = 64
#: Rows that one file of a batch should hold, and batches that are merged into one folder, level by level.
FILE_ROWS, MERGED = 1_000_000, 16
OWN = [StructField("batch_id", LongType()), StructField("key_bucket", IntegerType())]


@dataclass(frozen=True, order=True)
class Folder:
    """The rows of batches ``first`` to ``last``."""

    first: int
    last: int
    path: str

    def holds(self, other: Folder) -> bool:
        return self != other and self.first <= other.first and other.last <= self.last


class Store:
    """New rows of every batch under one path, with a bounded number of files.

    A batch writes one folder, ``FILE_ROWS`` rows a file, ordered by a hash bucket of the key, so that a reader of few
    buckets skips most of a file.  ``MERGED`` folders become one, and so on with those, like the runs of a sorted-run
    store: after n batches there are at most ``MERGED`` folders for each of log n levels, and a row is written log n times.
    A merged folder counts once it is complete; what it replaces is ignored from then on, and deleted with the next merge,
    so that a reader who listed folders before has time to finish.  There is one writer.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path, StructType([*schema, *OWN])
        jvm = spark.sparkContext._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def drop(self, path: str) -> None:
        """Delete a table that is no longer read."""
        gone = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        gone.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)

    def complete(self) -> list[Folder]:
        """All finished folders; a listing, no file is opened."""
        if not self._fs.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        found = [re.fullmatch(r"batches-(\d+)-(\d+)", n) for n in names]
        return sorted(Folder(int(m[1]), int(m[2]), f"{self.path}/{m[0]}") for m in found if m and self._fs.exists(self._path(f"{m[0]}/_SUCCESS")))

    def folders(self) -> list[Folder]:
        """Finished folders that no larger one replaces."""
        found = self.complete()
        return [f for f in found if not any(g.holds(f) for g in found)]

    def read(self, folders: list[Folder] | None = None) -> DataFrame:
        paths = [f.path for f in (self.folders() if folders is None else folders)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else empty(self.spark, self.schema)

    def write(self, rows: DataFrame, count: int, first: int, last: int) -> None:
        """Rows of batches ``first`` to ``last``; a folder that is there is written anew."""
        files = max(1, min(BUCKETS, count // FILE_ROWS + 1)) if last - first < MERGED else max(1, count // FILE_ROWS + 1)
        # Also for one file by an exchange: a coalesce would draw all that precedes the file into its task.
        dealt = rows.repartition(files, "key_bucket")
        dealt.select(*self.schema.fieldNames()).sortWithinPartitions("key_bucket").write.mode("overwrite").parquet(f"{self.path}/batches-{first:012d}-{last:012d}")

    def merge(self, batch_id: int) -> None:
        """Merge what ends with this batch, level by level."""
        size = MERGED
        while (batch_id + 1) % size == 0:
            old = [g for g in self.complete() if any(f.holds(g) for f in self.folders())]  # replaced by an earlier merge
            parts = [f for f in self.folders() if f.first > batch_id - size and f.last <= batch_id]
            if len(parts) > 1:
                rows = self.read(parts)
                self.write(rows, rows.count(), batch_id - size + 1, batch_id)
            for f in old:
                self._fs.delete(self._path(f.path.rsplit("/", 1)[1]), True)
            size *= MERGED


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("key_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))


def merge_batch(batch: DataFrame, history: DataFrame, key: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """Rows of a batch whose key is not stored yet; both sides carry the bucket of the key.

    Of the history only rows in ``buckets`` (all that the batch has) are read.
    """
    known = history if buckets is None else history.where(F.col("key_bucket").isin(*buckets))
    return batch.join(known.select("key_bucket", key), ["key_bucket", key], "left_anti")


def ingest(stream: DataFrame, path: str, checkpoint: str, key: str, order: str, schema: StructType,
           prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append the new rows of every micro-batch to a :class:`Store` at ``path`` and run until caught up.

    ``prepare`` turns the rows of a batch into rows of ``schema``, for example
    raw postings into records; the first row of each key stays.  A batch is
    prepared once, into a table that goes with it.  Each batch owns the folder of its number and writes it anew, so a batch that
    is retried after a lost executor leaves its rows once; one that is part of a merged folder is done.
    History is read as keys only, without the batch's own rows, and only where it
    can hold keys of the batch.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        store = Store(batch.sparkSession, path, schema)
        folders = store.folders()
        if not any(f.first <= batch_id <= f.last and f.first < f.last for f in folders):
            rows = keep_first(prepare(batch) if prepare else batch, [key], [order])
            rows = _bucketed(rows.select(*schema.fieldNames()), key).withColumn("batch_id", F.lit(batch_id).cast("long"))
            prepared = scratch(batch.sparkSession, "batch")
            try:
                rows.write.parquet(prepared)
                rows = batch.sparkSession.read.schema(rows.schema).parquet(prepared)
                count, buckets = rows.agg(F.count("*"), F.collect_set("key_bucket")).first()  # BUCKETS numbers at most
                history = [f for f in folders if f.first != batch_id]
                fresh = merge_batch(rows, store.read(history), key, buckets) if history and count else rows
                store.write(fresh, count, batch_id, batch_id)
            finally:
                store.drop(prepared)
        store.merge(batch_id)

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def kept(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows that :func:`ingest` has kept."""
    return Store(spark, path, schema).read().select(*schema.fieldNames())


def new_per_batch(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """How many new rows each batch brought."""
    return Store(spark, path, schema).read().groupBy("batch_id").agg(F.count("*").alias("n_new"))


def distinct_within(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The stateful form: one row per key as long as repeats come within ``delay``."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def period_counts(stream: DataFrame, time: str, period: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Rows per tumbling period; rows later than the watermark are dropped."""
    return (stream.withWatermark(time, delay).groupBy(F.window(time, period).alias("w"))
            .agg(F.count("*").alias("n")).select(F.col("w.start").alias("period"), "n"))


def write_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep every update of the running counts, one folder per batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return (counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The last known count of every period."""
    stored = spark.read.option("basePath", path).parquet(f"{path}/batch_id=*")
    return stored.groupBy("period").agg(F.max_by("n", "batch_id").alias("n"))
