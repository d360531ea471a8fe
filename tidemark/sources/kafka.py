"""Reading from and writing to Kafka with Spark's connector (its package must be on the class path)."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.topiclog import EARLIEST, LATEST

ACKS = {"none": "0", "leader": "1", "all": "-1"}


def reader_options(servers: str, topics: Sequence[str], start: int | Mapping[str, Mapping[int, int]] = EARLIEST, most_per_trigger: int | None = None, group: str | None = None) -> dict[str, str]:
    """Options of the source: several topics in one stream, start offsets by topic and partition."""
    if not topics:
        raise ValueError("no topic")
    if isinstance(start, Mapping):
        offsets = json.dumps({t: {str(p): o for p, o in ps.items()} for t, ps in start.items()})
    else:
        offsets = {EARLIEST: "earliest", LATEST: "latest"}.get(start)
        if offsets is None:
            raise ValueError("start is EARLIEST, LATEST or offsets by topic and partition")
    out = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "startingOffsets": offsets, "includeHeaders": "true"}
    if most_per_trigger:
        out["maxOffsetsPerTrigger"] = str(most_per_trigger)
    if group:
        out["kafka.group.id"] = group
    return out


def writer_options(servers: str, topic: str | None = None, acks: str = "all", compression: str = "snappy", **producer: str) -> dict[str, str]:
    """Options of the sink: waits for all replicas and compresses by default."""
    out = {"kafka.bootstrap.servers": servers, "kafka.acks": ACKS[acks], "kafka.compression.type": compression, "includeHeaders": "true"}
    return out | ({"topic": topic} if topic else {}) | {f"kafka.{k.replace('_', '.')}": v for k, v in producer.items()}


def read(spark: SparkSession, streaming: bool = True, **options: object) -> DataFrame:
    """Records of topics in the engine's envelope; without ``streaming`` up to the present end."""
    source = (spark.readStream if streaming else spark.read).format("kafka").options(**reader_options(**options))
    return source.load().select("key", "value", "topic", "partition", "offset", "timestamp", "headers", F.expr("uuid()").alias("uuid"))


def outgoing(df: DataFrame) -> DataFrame:
    """The columns that the Kafka sink takes, of those that there are."""
    return df.select(*(c for c in ("key", "value", "topic", "partition", "headers") if c in df.columns))
