"""Ends of a stream: records back to bytes, tombstones, headers, error rows, topics."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.serdes import Codec
from tidemark.operators.stores import Registry, Store
from tidemark.operators.stream import ERRORS, Expr, KeyedStream, column, lenient
from tidemark.operators.tables import latest
from tidemark.plans.topology import Node
from tidemark.sources.files import Files
from tidemark.sources.topiclog import HEADERS, TopicLogs


@dataclass(frozen=True)
class SinkOptions:
    """``rewrite``: name to expression for key, value, headers or timestamp, before all else; ``headers``: computes
    the headers (default: those of the record); ``tombstone``: records whose value becomes NULL; ``prefix``: application
    prefix of the topic's name; ``partitioner``: as of :meth:`TopicLogs.append`."""

    rewrite: dict[str, Expr] | None = None
    headers: Expr | None = None
    tombstone: Expr | None = None
    prefix: str | None = None
    partitioner: str | Column = "hash"


def topic_name(topic: str, prefix: str | None = None) -> str:
    return f"{prefix}_{topic}" if prefix else topic


def header_array(**values: Column) -> Column:
    """Headers from named values."""
    return F.array(*(F.struct(F.lit(k).alias("key"), v.cast("binary").alias("value")) for k, v in values.items())).cast(HEADERS)


def encoded(stream: KeyedStream, topic: str, key: Codec, value: Codec, options: SinkOptions = SinkOptions()) -> KeyedStream:
    """The stream as records to write: rewrite, headers, key, tombstones, value, in this order.

    Records whose key or value can't be encoded (NULL where there was a
    value) are errors of the sink.  A NULL value, from the stream or by the
    tombstone rule, is written as NULL.
    """
    marked = _marked(stream, topic, key, value, options)
    good, bad = marked.where("_tm_bad IS NULL").drop("_tm_bad", "_tm_source"), _unwritable(marked)
    return replace(stream, df=good, node=Node("sink", topic, (stream.node,)))._with_errors(bad, f"sink {topic}", F.col("_tm_bad"))


def _unwritable(marked: DataFrame) -> DataFrame:
    """The rows that can't be written, under the topic that they came from."""
    return marked.where("_tm_bad IS NOT NULL").withColumn("topic", F.col("_tm_source"))


def _marked(stream: KeyedStream, topic: str, key: Codec, value: Codec, options: SinkOptions) -> DataFrame:
    """Records to write, and in ``_tm_bad`` why one can't be written: in one pass."""
    df = stream.df
    for name, f in (options.rewrite or {}).items():
        if name not in ("key", "value", "headers", "timestamp"):
            raise ValueError(f"a sink can't rewrite {name}")
        with lenient(df.sparkSession):
            df = df.withColumn(name, column(f))
    if options.headers is not None:
        with lenient(df.sparkSession):
            df = df.withColumn("headers", column(options.headers).cast(HEADERS))
    gone = F.coalesce(column(options.tombstone), F.lit(False)) if options.tombstone is not None else F.lit(False)
    empty = F.col("value").isNull() | gone
    with lenient(df.sparkSession):
        df = df.withColumn("_tm_empty", empty)
    empty = F.col("_tm_empty")
    marked = df.withColumns({"_tm_key": key.encode(F.col("key")), "_tm_value": F.when(~empty, value.encode(F.col("value")))})
    bad = F.when(F.col("_tm_key").isNull(), "unencodable key").when(~F.col("_tm_empty") & F.col("_tm_value").isNull(), "unencodable value")
    marked = marked.withColumn("_tm_bad", bad).withColumns({"key": F.col("_tm_key"), "value": F.col("_tm_value"), "_tm_source": F.col("topic") if "topic" in df.columns else F.lit(None).cast("string")})
    return marked.drop("_tm_key", "_tm_value", "_tm_empty").withColumn("topic", F.lit(topic_name(topic, options.prefix)))


def to(
    stream: KeyedStream, logs: TopicLogs, topic: str, key: Codec, value: Codec, options: SinkOptions = SinkOptions(),
    checkpoint: str | None = None, errors: str | None = None, trigger: str | None = None, name: str | None = None,
) -> StreamingQuery | int:
    """Write the stream to a topic: a batch number, or the running query of a streaming pipeline.

    ``errors`` names the topic of dropped records (dead letters).  A running
    query needs a ``checkpoint`` folder and goes on with ``trigger`` (as
    '1 second') or, without it, ends when it has written what there is; it
    writes its records and its dead letters in the same micro-batch.  Each
    append is made once for each micro-batch, since its number is committed
    with the data.
    """
    target = topic_name(topic, options.prefix)
    logs.create(target)
    if errors:
        logs.create(errors)
    marked = _marked(stream, topic, key, value, options)
    kept = ["key", "value", "headers", "timestamp", "offset", *(["partition"] if isinstance(options.partitioner, str) and options.partitioner == "manual" else [])]
    kept = [c for c in kept if c in marked.columns]

    def put(df: DataFrame, once: str | None = None) -> int:
        return logs.append(target, df, options.partitioner, F.col("offset") if "offset" in df.columns else None, once=once)

    def put_letters(df: DataFrame, once: str | None = None) -> int:
        return logs.append(errors, df, once=once)

    if not marked.isStreaming:
        if errors:
            put_letters(_letters(stream._with_errors(_unwritable(marked), f"sink {topic}", F.col("_tm_bad")).errors))
        return put(marked.where("_tm_bad IS NULL").select(*kept))
    if checkpoint is None:
        raise ValueError("a streaming sink needs a checkpoint folder")
    # one query for records and errors, so that none is lost between two; what can't be encoded is told apart in the micro-batch, so nothing before it runs twice
    letter, record = F.struct(*ERRORS), F.struct(*kept)
    bad = F.col("_tm_bad").isNotNull()
    here = marked.withColumns({"topic": F.col("_tm_source"), **{c: F.lit(None).cast(t) for c, t in (("partition", "int"), ("offset", "bigint")) if c not in marked.columns}})
    here = here.withColumns({"stage": F.lit(f"sink {topic}"), "reason": F.col("_tm_bad")})
    out = here.select(F.when(~bad, record).alias("r"), F.when(bad, letter).alias("e"))
    if errors and stream.errors is not None:
        out = out.unionByName(stream.errors.select(F.lit(None).cast(out.schema["r"].dataType).alias("r"), letter.cast(out.schema["e"].dataType).alias("e")))
    writers = [("r", lambda df: df, _once(put, logs, target, checkpoint, "written"))]
    if errors:
        writers.append(("e", _letters, _once(put_letters, logs, errors, checkpoint, "written-errors")))

    def write(df: DataFrame, number: int) -> None:
        df = df.persist()
        try:
            for member, made, put_once in writers:
                put_once(made(df.where(F.col(member).isNotNull()).select(f"{member}.*")), number)
        finally:
            df.unpersist()

    writer = out.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def _once(put, logs: TopicLogs, topic: str, checkpoint: str, folder: str):
    """A foreachBatch function that skips a micro-batch which it has written before.

    The data carry the checkpoint's own id and the micro-batch's number and
    appear together with them.  The marks in the checkpoint only say where to
    look: a micro-batch without one may be in a batch behind the last mark's.
    """

    def write(df: DataFrame, number: int) -> None:
        marks = Files(df.sparkSession, f"{checkpoint.rstrip('/')}/{folder}")
        if marks.exists(str(number)):
            return
        if not marks.exists("id"):
            marks.create("id", uuid.uuid4().hex)
        once = f"{marks.text('id')}-{number}"
        batch = logs.appended(topic, once, int(marks.text(str(number - 1)) or -1))
        marks.create(str(number), str(put(df, once) if batch is None else batch))

    return write


def dead_letters(errors: DataFrame, logs: TopicLogs, topic: str) -> int:
    """Error rows as records: the origin as key, the row as JSON value."""
    logs.create(topic)
    return logs.append(topic, _letters(errors))


def _letters(errors: DataFrame) -> DataFrame:
    key = F.concat_ws("_", "topic", "partition", "offset")
    return errors.select(key.cast("binary").alias("key"), F.to_json(F.struct(*errors.columns)).cast("binary").alias("value"))


def through(stream: KeyedStream, logs: TopicLogs, topic: str, key: Codec, value: Codec, options: SinkOptions = SinkOptions(), checkpoint: str | None = None) -> KeyedStream:
    """Write the stream to a topic and go on from there; the new stream has the topic's positions.

    A streaming pipeline is written up to the present end of its sources, and
    goes on from the topic's records as they are then.
    """
    done = to(stream, logs, topic, key, value, options, checkpoint)
    if isinstance(done, StreamingQuery):
        done.awaitTermination()
    again = KeyedStream.source(logs.read(topic_name(topic, options.prefix)), key, value, topic)
    return replace(again, node=Node("through", topic, (stream.node,)))


def materialize_to(stream: KeyedStream, logs: TopicLogs, topic: str, store: str, registry: Registry, key: Codec, value: Codec, options: SinkOptions = SinkOptions(), **versions: object) -> KeyedStream:
    """Version the stream's values, keep the latest of each key as a registered store, and write all to a topic.

    ``versions``: options of :func:`tidemark.operators.tables.materialize`.
    The stream goes on with the versioned values.
    """
    kept = stream.materialize(store, **versions)
    registry.register(Store(store, latest(kept.df).select("key", "value")))
    to(kept, logs, topic, key, value, options)
    return kept
