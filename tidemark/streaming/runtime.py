"""Running an application: tables first, then streams; metrics; orderly stop."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidemark.functions.serdes import Codec
from tidemark.operators.sinks import SinkOptions, to
from tidemark.operators.stores import Registry
from tidemark.operators.stream import KeyedStream
from tidemark.plans.config import EngineConfig, StreamConfig
from tidemark.plans.topology import Node, to_dot
from tidemark.serving import serve
from tidemark.sources.topiclog import TopicLogs
from tidemark.streaming.tables import LiveTable


def latency() -> dict[str, Column]:
    """Metrics for ``peek(name, **latency())``: milliseconds from a record's timestamp to its processing, and from the newest one's: the lag of a table that the stream keeps."""
    ms = F.unix_millis(F.current_timestamp()) - F.unix_millis("timestamp")
    return {"records": F.count(F.lit(1)), "mean_latency_ms": F.avg(ms), "max_latency_ms": F.max(ms), "lag_ms": F.min(ms)}


class Metrics(StreamingQueryListener):
    """Counts and rates of the running queries, by name."""

    def __init__(self) -> None:
        self.latest: dict[str, dict] = {}
        self.failures: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self.latest.setdefault(event.name or str(event.id), {"batches": 0, "rows": 0})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        m = self.latest.setdefault(p.name or str(p.id), {"batches": 0, "rows": 0})
        m["batches"] += 1
        m["rows"] += p.numInputRows
        m["rows_per_second"] = p.processedRowsPerSecond
        m["duration_ms"] = dict(p.durationMs)
        m["state_rows"] = sum(s.numRowsTotal for s in p.stateOperators)
        m["observed"] = {k: v.asDict() for k, v in p.observedMetrics.items()}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failures[str(event.id)] = event.exception


@dataclass
class Application:
    """Tables that are followed and streams that run, under one configuration.

    ``start`` brings every table up to the present end of its changes before
    the first stream starts, then lets the tables follow on; ``on_start`` is
    called when all runs.
    """

    spark: SparkSession
    config: EngineConfig
    on_start: Callable[[], None] | None = None
    registry: Registry = field(default_factory=Registry)
    _tables: dict[str, tuple[LiveTable, DataFrame]] = field(default_factory=dict)
    _streams: dict[str, Callable[[bool], StreamingQuery]] = field(default_factory=dict)
    _nodes: dict[str, Node] = field(default_factory=dict)
    _settings: dict[str, StreamConfig] = field(default_factory=dict)
    _left: dict[str, int] = field(default_factory=dict)
    _named: dict[str, StreamingQuery] = field(default_factory=dict)
    _before: dict[str, str | None] = field(default_factory=dict)
    server: object = None
    queries: list[StreamingQuery] = field(default_factory=list)
    metrics: Metrics = field(default_factory=Metrics)

    def add_table(self, name: str, table: LiveTable, changes: DataFrame) -> LiveTable:
        if name in self._tables:
            raise ValueError(f"there is a table named {name}")
        self._tables[name] = (table, changes)
        return table

    def source(self, logs: TopicLogs, topic: str, settings: StreamConfig = StreamConfig()) -> DataFrame:
        """A topic as a stream, in micro-batches of the size that the settings allow."""
        return logs.read_stream(topic, batches_per_trigger=settings.most_per_trigger)

    def _add(self, name: str, node: Node, settings: StreamConfig, start: Callable[[bool], StreamingQuery]) -> None:
        if name in self._streams:
            raise ValueError(f"there is a stream named {name}")
        self._streams[name], self._nodes[name], self._settings[name] = start, node, settings

    def add_stream(self, name: str, stream: KeyedStream | DataFrame, write: Callable[[DataFrame, int], None], settings: StreamConfig = StreamConfig()) -> None:
        """A stream whose micro-batches go to a function."""
        df = stream.df if isinstance(stream, KeyedStream) else stream

        def start(once: bool) -> StreamingQuery:
            writer = df.writeStream.queryName(name).option("checkpointLocation", self._checkpoint("stream", name)).foreachBatch(write)
            return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=self.config.trigger)).start()

        self._add(name, stream.node if isinstance(stream, KeyedStream) else Node("source", name), settings, start)

    def add_sink(self, name: str, stream: KeyedStream, logs: TopicLogs, topic: str, key: Codec, value: Codec, options: SinkOptions = SinkOptions(), settings: StreamConfig = StreamConfig()) -> None:
        """A stream that ends in a topic, its dropped records in another if the settings say so."""
        errors = (settings.dead_letter_topic or f"{topic}_dead") if settings.dead_letters else None

        def start(once: bool) -> StreamingQuery:
            return to(stream, logs, topic, key, value, options, self._checkpoint("stream", name), errors, None if once else self.config.trigger, name)

        self._add(name, Node("sink", topic, (stream.node,)), settings, start)

    def _checkpoint(self, kind: str, name: str) -> str:
        return f"{self.config.checkpoint_dir.rstrip('/')}/{self.config.application_id}/{kind}/{name}"

    def bootstrap(self) -> None:
        """Bring the tables up to date, all at once, and wait for them."""
        running = [t.follow(changes, self._checkpoint("table", n)) for n, (t, changes) in self._tables.items()]
        for q in running:
            q.awaitTermination()

    def start(self, once: bool = False) -> list[StreamingQuery]:
        """Run; with ``once`` the streams end when they have processed what there is."""
        for setting, v in self.config.spark_settings().items():
            self._before[setting] = self.spark.conf.get(setting, None)
            self.spark.conf.set(setting, v)
        self.spark.streams.addListener(self.metrics)
        self.bootstrap()
        if self.config.http_port is not None:
            self.server = serve(self.registry, self.config.http_host, self.config.http_port)
        if not once:
            self.queries += [t.follow(changes, self._checkpoint("table", n), once=False) for n, (t, changes) in self._tables.items()]
        for name, begin in self._streams.items():
            self._left[name] = self._settings[name].retries
            self._named[name] = begin(once)
            self.queries.append(self._named[name])
        self._once = once
        if self.on_start:
            threading.Thread(target=self.on_start, daemon=True).start()
        return self.queries

    def await_end(self, timeout: float | None = None) -> None:
        """Wait until all streams have ended; one that fails is started again as often as its settings allow."""
        names = {id(q): n for n, q in self._named.items()}
        waiting = list(self.queries)
        while waiting:
            q = waiting.pop(0)
            try:
                q.awaitTermination(timeout) if timeout else q.awaitTermination()
            except StreamingQueryException:
                name = names.get(id(q))
                if name is None or self._left[name] < 1:
                    raise
                self._left[name] -= 1
                time.sleep(self._settings[name].retry_interval_ms / 1000)
                again = self._named[name] = self._streams[name](self._once)
                self.queries[self.queries.index(q)] = again
                names[id(again)] = name
                waiting.append(again)

    def stop(self) -> None:
        """Stop the streams, then the tables' queries; what was committed stays, and the session's settings are as before."""
        for q in reversed(self.queries):
            q.stop()
        for setting, v in self._before.items():
            self.spark.conf.unset(setting) if v is None else self.spark.conf.set(setting, v)
        self._before.clear()
        self.queries.clear()
        if self.server is not None:
            self.server.shutdown()
            self.server = None
        self.spark.streams.removeListener(self.metrics)

    def graph(self) -> str:
        """The topology in the DOT language."""
        return to_dot(*self._nodes.values())
