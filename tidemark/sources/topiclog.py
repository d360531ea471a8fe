"""Topic logs: named, partitioned, append-only logs of records in Parquet.

A log is a folder ``<root>/<topic>``; its settings are in ``_topic.json``.
Each append writes one folder of files, ``batch=<n>/partition=<p>/``, so a
streaming read takes appends in order and a filter on the partition prunes
folders.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidemark.operators.scan import running
from tidemark.sources.files import Files, NameTaken

HEADERS = "array<struct<key:string,value:binary>>"
RECORD = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("headers", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())]))),
        T.StructField("uuid", T.StringType()),
    ]
)
STORED = T.StructType([*RECORD, T.StructField("batch", T.LongType()), T.StructField("partition", T.IntegerType())])
EARLIEST, LATEST = -2, -1
HASH, MANUAL, RANDOM = "hash", "manual", "random"
_SETTINGS = "_topic.json"
_ENDS = "_ends.json"


class TopicExists(ValueError):
    pass


class UnknownTopic(KeyError):
    pass


class TopicLogs:
    """The topics under one root: administration, producing and consuming."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)

    def _folder(self, topic: str) -> str:
        return f"{self.root}/{topic}"

    # administration

    def create(self, topic: str, partitions: int = 1, replication: int = 1, config: Mapping[str, str] | None = None, exist_ok: bool = True) -> None:
        """A new topic; an existing one stays as it is (or raises)."""
        if partitions < 1:
            raise ValueError("a topic has at least one partition")
        if not topic or topic.startswith(("_", ".")) or "/" in topic:
            raise ValueError(f"no name for a topic: {topic!r}")
        try:
            self.files.create(f"{topic}/{_SETTINGS}", json.dumps({"partitions": partitions, "replication": replication, "config": dict(config or {})}))
        except NameTaken:
            if not exist_ok:
                raise TopicExists(topic) from None

    def info(self, topic: str) -> dict:
        text = self.files.text(f"{topic}/{_SETTINGS}")
        if text is None:
            raise UnknownTopic(topic)
        return {"topic": topic} | json.loads(text)

    def topics(self) -> list[str]:
        return sorted(t for t in self.files.names() if self.files.exists(f"{t}/{_SETTINGS}"))

    def delete(self, topic: str) -> None:
        self.info(topic)
        self.files.delete(topic)

    def offsets(self, topic: str) -> DataFrame:
        """``partition``, ``oldest``, ``latest``, ``records``: of the partitions that have records."""
        return self.read(topic).groupBy("partition").agg(F.min("offset").alias("oldest"), F.max("offset").alias("latest"), F.count(F.lit(1)).alias("records"))

    def offset_valid(self, topic: str, partition: int, offset: int) -> bool:
        """Whether a reader can start there: an existing offset or the one after the last."""
        r = self.offsets(topic).where(F.col("partition") == partition).first()
        return offset == 0 if r is None else r["oldest"] <= offset <= r["latest"] + 1

    # producing

    def append(self, topic: str, records: DataFrame, partitioner: str | Column = HASH, order: Column | None = None, uuid: Column | None = None, once: str | None = None) -> int:
        """Append the records (``key``, ``value`` bytes; optional ``headers``, ``timestamp``, ``partition``); the batch's number.

        ``hash``: equal keys share a partition, NULL keys are partition 0;
        ``manual``: the column ``partition``; ``random``: any; or an expression
        of the key and value; where these give NULL it is partition 0.  Offsets go on
        from the partition's last, in the order of ``order`` (bigint) or as the
        rows come; they are counted split by split, so a partition with a
        third of all rows isn't numbered by one task.  Where they go on is
        kept with each batch, so earlier ones aren't read.  ``uuid`` computes the
        records' uuid; default random.  ``once`` names the append (no ``=`` or
        ``/``); the name is kept with the data and appears in one step with
        it, so :meth:`appended` tells whether it was made.
        """
        n = self.info(topic)["partitions"]
        have = set(records.columns)
        place = {
            HASH: F.coalesce(F.pmod(F.xxhash64("key"), F.lit(n)), F.lit(0)) if "key" in have else F.lit(0),
            MANUAL: F.col("partition") if "partition" in have else None,
            RANDOM: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)),
        }.get(partitioner) if isinstance(partitioner, str) else F.pmod(partitioner.cast("bigint"), F.lit(n))
        if place is None:
            raise ValueError("partitioner is 'hash', 'random' or 'manual' with a column partition")
        row = records.select(
            F.col("key").cast("binary").alias("key"),
            F.col("value").cast("binary").alias("value"),
            F.lit(topic).alias("topic"),
            (F.col("timestamp") if "timestamp" in have else F.current_timestamp()).alias("timestamp"),
            (F.col("headers") if "headers" in have else F.array()).cast(HEADERS).alias("headers"),
            (uuid if uuid is not None else F.expr("uuid()")).alias("uuid"),
            F.coalesce(place.cast("int"), F.lit(0)).alias("partition"),
            (order if order is not None else F.monotonically_increasing_id()).alias("_order"),
        )
        batch = self._next_batch(topic)
        ends = self._ends(topic, batch)
        counted = running(row, ["partition"], "_order", sums={"_n": F.lit(1)}, **({} if order is not None else {"width": 1 << 33}))
        start = F.lit(0).cast("bigint")
        for p, end in ends.items():
            start = F.when(F.col("partition") == p, end).otherwise(start)
        placed = counted.withColumn("offset", start + F.col("_n") - 1)
        out = f"{self._folder(topic)}/batch={batch}"
        # readers pass over what begins with _
        staged = out if once is None else f"{self._folder(topic)}/_staged-{once}"
        placed.select(*RECORD.names, "partition").sortWithinPartitions("offset").write.mode("error" if once is None else "overwrite").partitionBy("partition").parquet(staged)
        if once is not None:
            self.files.create(f"{topic}/_staged-{once}/_once-{once}", "")
            if self.files.exists(f"{topic}/batch={batch}"):
                raise NameTaken(out)
            self.files.rename(f"{topic}/_staged-{once}", f"{topic}/batch={batch}")
            if self.appended(topic, once, batch - 1) != batch:  # another writer was faster: the folder was moved into its folder
                raise NameTaken(out)
        self._keep_ends(topic, batch, ends)
        return batch

    def _counts(self, topic: str, batch: int) -> dict[int, int]:
        """The first offset behind a batch, by partition: read from that batch only."""
        rows = self.spark.read.schema(STORED).option("basePath", self._folder(topic)).parquet(f"{self._folder(topic)}/batch={batch}").groupBy("partition").agg(F.max("offset").alias("m")).collect()  # a row per partition
        return {r["partition"]: r["m"] + 1 for r in rows if r["m"] is not None}

    def _keep_ends(self, topic: str, batch: int, ends: Mapping[int, int]) -> dict[int, int]:
        """The ends after a batch, kept beside it; a reader passes over what begins with _."""
        after = dict(ends) | self._counts(topic, batch)
        name = f"{topic}/batch={batch}/{_ENDS}"
        if not self.files.exists(name):
            self.files.create(name, json.dumps({str(p): n for p, n in after.items()}))
        return after

    def _ends(self, topic: str, batch: int) -> dict[int, int]:
        """The next offset of each partition before ``batch``: from the batch before, or those that a lost writer left without ends."""
        known, missing = {}, []
        batches = sorted((int(d[6:]) for d in self.files.names(topic) if d.startswith("batch=") and int(d[6:]) < batch), reverse=True)
        for b in batches:
            text = self.files.text(f"{topic}/batch={b}/{_ENDS}")
            if text is not None:
                known = {int(p): n for p, n in json.loads(text).items()}
                break
            missing.append(b)
        for b in reversed(missing):
            known = self._keep_ends(topic, b, known)
        return known

    def appended(self, topic: str, once: str, after: int = -1) -> int | None:
        """The batch behind ``after`` that was appended as ``once``; None if there is none."""
        batches = sorted(int(d[6:]) for d in self.files.names(topic) if d.startswith("batch="))
        return next((b for b in batches if b > after and self.files.exists(f"{topic}/batch={b}/_once-{once}")), None)

    def _next_batch(self, topic: str) -> int:
        return 1 + max([-1, *(int(d[6:]) for d in self.files.names(topic) if d.startswith("batch="))])

    # consuming

    def read(self, topic: str, start: int | Column | Mapping[int, int] = EARLIEST) -> DataFrame:
        """The records from ``start`` (EARLIEST, LATEST, an offset or a scalar column of one, or one by partition) to the present end."""
        self.info(topic)
        if self._next_batch(topic) == 0:
            df = self.spark.createDataFrame([], STORED)
        else:
            df = self.spark.read.schema(STORED).option("basePath", self._folder(topic)).parquet(self._folder(topic))
        if isinstance(start, Mapping):
            cases = F.lit(0)
            for p, o in start.items():
                cases = F.when(F.col("partition") == p, o).otherwise(cases)
            return df.where(F.col("offset") >= cases)
        if isinstance(start, Column):
            return df.where(F.col("offset") >= start)
        if start == LATEST:
            return df.where(F.lit(False))
        return df if start == EARLIEST else df.where(F.col("offset") >= start)

    def scan(self, topic: str, on_records: Callable[[DataFrame, int], None], on_end: Callable[[dict[int, int]], None], checkpoint: str, start: int = EARLIEST, trigger: str = "1 second") -> StreamingQuery:
        """What there is now, then, after ``on_end`` (the next offset by partition), what comes: one consumer, one checkpoint.

        ``on_records`` gets each micro-batch and its number; ``on_end`` is
        called once, when all that was there at the call has been passed on.
        """
        until = self._next_batch(topic)
        ends = self._ends(topic, until)

        def live() -> DataStreamWriter:
            return self.read_stream(topic, start).writeStream.option("checkpointLocation", checkpoint).foreachBatch(on_records)

        live().trigger(availableNow=True).start().awaitTermination()
        on_end(ends)
        return live().trigger(processingTime=trigger).start()

    def read_stream(self, topic: str, start: int = EARLIEST, batches_per_trigger: int | None = None) -> DataFrame:
        """The records as a stream: those from ``start`` on, and all later appends."""
        self.info(topic)
        reader = self.spark.readStream.schema(STORED).option("basePath", self._folder(topic))
        if batches_per_trigger:
            reader = reader.option("maxFilesPerTrigger", batches_per_trigger)
        df = reader.parquet(self._folder(topic))
        if start == LATEST:
            # appends that exist now are before the latest offset
            return df.where(F.col("batch") >= self._next_batch(topic))
        return df if start == EARLIEST else df.where(F.col("offset") >= start)
