"""Configuration of applications and streams, checked when it is made."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class StreamConfig:
    """Settings of one stream of an :class:`~tidemark.streaming.runtime.Application`.

    ``retries``: how often its query is started again, ``retry_interval_ms``
    after it failed (tasks are retried by Spark); it goes on from its
    checkpoint.  ``dead_letters``: dropped records go to
    ``dead_letter_topic`` (default: the sink's topic with ``_dead``).
    ``most_per_trigger``: files of the source's topic in a micro-batch.
    """

    retries: int = 2
    retry_interval_ms: int = 100
    dead_letters: bool = False
    dead_letter_topic: str | None = None
    most_per_trigger: int | None = None

    @staticmethod
    def from_mapping(values: Mapping[str, object]) -> StreamConfig:
        """From dotted names (``stream.dead_letters``); unknown names and wrong types raise."""
        return _checked(StreamConfig, values, "stream.")


@dataclass(frozen=True)
class EngineConfig:
    """Settings of an application."""

    application_id: str
    checkpoint_dir: str
    trigger: str = "1 second"
    shuffle_partitions: int = 200
    state_store: str = "rocksdb"
    http_host: str = "127.0.0.1"
    http_port: int | None = None

    def __post_init__(self) -> None:
        for name in ("application_id", "checkpoint_dir"):
            if not getattr(self, name):
                raise ValueError(f"{name} must be given")
        if self.shuffle_partitions < 1:
            raise ValueError("shuffle_partitions must be positive")
        if self.state_store not in PROVIDERS:
            raise ValueError(f"state_store is one of {', '.join(PROVIDERS)}")

    @staticmethod
    def from_mapping(values: Mapping[str, object]) -> EngineConfig:
        return _checked(EngineConfig, values, "engine.")

    def spark_settings(self) -> dict[str, str]:
        return {"spark.sql.shuffle.partitions": str(self.shuffle_partitions), "spark.sql.streaming.stateStore.providerClass": PROVIDERS[self.state_store]}

    def __str__(self) -> str:
        width = max(len(f.name) for f in fields(self))
        return "\n".join(f"{f.name:<{width}}  {getattr(self, f.name)}" for f in sorted(fields(self), key=lambda f: f.name))


_STATE = "org.apache.spark.sql.execution.streaming.state."
PROVIDERS = {"rocksdb": f"{_STATE}RocksDBStateStoreProvider", "hdfs": f"{_STATE}HDFSBackedStateStoreProvider"}


def _checked(kind: type, values: Mapping[str, object], prefix: str):
    known = {f.name: f.type for f in fields(kind)}
    out = {}
    for name, v in values.items():
        short = name.removeprefix(prefix)
        if short not in known:
            raise ValueError(f"unknown setting {name}")
        wanted = {"int": int, "bool": bool, "str": str}[known[short].split(" ")[0]]
        if not (isinstance(v, wanted) and (wanted is bool or not isinstance(v, bool))) and not (v is None and "None" in known[short]):
            raise TypeError(f"{name} must be {known[short]}")
        out[short] = v
    return kind(**out)
