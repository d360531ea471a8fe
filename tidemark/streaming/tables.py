"""Tables that running queries keep up to date, in bucketed, versioned folders."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import cdc
from tidemark.operators.tables import Table
from tidemark.plans.topology import Node
from tidemark.sources.versioned import VersionedTable

#: Buckets of a new table, and the bytes of a bucket at which their number is doubled.
BUCKETS = 4
BUCKET_BYTES = 128 << 20


class LiveTable:
    """The latest row per key of a stream of changes.

    A micro-batch rewrites only the buckets (hash of the key) that it
    touches, and commits them together with its number in one manifest, so
    that a repeated micro-batch changes nothing.  The number of buckets
    follows the table: when those that a micro-batch wrote have grown beyond
    ``bucket_bytes`` each, the next one doubles it.  Files that only older
    versions than the last two have are deleted.  Rules as for
    :func:`tidemark.operators.tables.latest` and, with ``version``,
    ``versioned``; the row's whole record is kept.

    ``prepare`` is given a micro-batch's changes, and what it makes of them is
    applied.  ``write`` is the user's writer: it is called with this table,
    the changes and the micro-batch's number instead of :meth:`apply`, and
    calls that (or not) with what it wants to be there.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, version: Column | None = None, buckets: int = BUCKETS, prepare: Callable[[DataFrame], DataFrame] | None = None, write: Callable[[LiveTable, DataFrame, int], None] | None = None, bucket_bytes: int = BUCKET_BYTES):
        self.prepare, self.write, self.bucket_bytes = prepare, write, bucket_bytes
        self.version, self.buckets, self.record = version, buckets, schema
        state = T.StructType([T.StructField("key", schema["key"].dataType), T.StructField("ver", T.DoubleType()), T.StructField("pos", T.StructType(schema.fields)), T.StructField("bucket", T.IntegerType())])
        self.store = VersionedTable(spark, path, state)

    def upsert(self, changes: DataFrame, number: int) -> None:
        """Pass a micro-batch on to the user's writer or to :meth:`apply`."""
        (self.write or LiveTable.apply)(self, self.prepare(changes) if self.prepare else changes, number)

    def apply(self, changes: DataFrame, number: int) -> None:
        """Apply a micro-batch's changes, once for each number."""
        done = self.store.manifest()
        if done.processed.get("micro-batch", -1) >= number:
            return
        changes = changes.where(F.col("key").isNotNull())
        buckets = int(done.details.get("buckets", self.buckets))
        grow = done.details.get("grow") == "yes"
        if grow:
            buckets *= 2
        bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
        touched = {r[0] for r in changes.select(bucket).distinct().collect()}  # numbers of buckets
        old = {f: v for f, v in done.files.items() if grow or int(f.rpartition("/bucket=")[2].partition("/")[0]) in touched}
        base = self.store._scan(old).drop("bucket")
        # without a version every change is newer: versions are the offsets
        ver = self.version if self.version is not None else F.col("offset")
        ops = changes.select("key", "offset", ver.cast("double").alias("ver"), F.col("value").isNull().alias("gone"), F.struct(*self.record.names).alias("place"))
        if self.version is None:
            base = base.withColumn("ver", F.lit(-1.0))
        state = cdc.apply_patches(cdc.patches(ops, ["key"], "offset", "ver", "gone", "place"), ["key"], base)
        folder = f"data/{uuid.uuid4().hex}"
        kept = state.withColumn("bucket", bucket)
        kept.withColumn("b", F.col("bucket")).repartition("b").write.partitionBy("b").parquet(f"{self.store.path}/{folder}")
        files = self._files(folder)
        large = sum(self.store.files.size(f) for f in files) > self.bucket_bytes * max(1, len({f.rpartition("/bucket=")[2].partition("/")[0] for f in files}))
        self.store.commit(add=files, remove=list(old), processed={"micro-batch": number}, base=done.version, details={"buckets": str(buckets), "grow": "yes" if large else "no"})
        self.store.vacuum()

    def _files(self, folder: str) -> list[str]:
        """Files of the folder ``b=<n>`` are moved to ``bucket=<n>``, so that the column in the file isn't one of the path."""
        files, out = self.store.files, []
        for name in files.names(folder):
            if name.startswith("b="):
                files.rename(f"{folder}/{name}", f"{folder}/bucket={name[2:]}")
                out += files.paths(f"{folder}/bucket={name[2:]}", ".parquet")
        return out

    def table(self, name: str = "table") -> Table:
        """The present rows, as a table to join with."""
        return Table(self.rows(), name, Node("table", name))

    def rows(self) -> DataFrame:
        return self.store.read().select("pos.*")

    def follow(self, changes: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        """The query that applies a stream of changes; with ``once`` it ends when it is up to date."""
        writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.upsert)
        return (writer.trigger(availableNow=True) if once else writer).start()
