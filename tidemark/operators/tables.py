"""Tables kept up to date by a stream: last value, versioned, materialized, compacted, expiring."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import cdc
from tidemark.operators.scan import numbered
from tidemark.plans.topology import Node
from tidemark.session import columns


class TableMisuse(TypeError):
    """A stream operation on a table."""


@dataclass(frozen=True)
class Table:
    """One row per key: ``key``, ``value`` and what came with it."""

    df: DataFrame
    name: str = "table"
    node: Node = Node("table", "table")

    def _refuse(self, *_: object, **__: object) -> None:
        raise TableMisuse("a table can be joined and queried; to, map, filter and peek are for streams")

    to = map = map_values = filter = peek = process = branch = _refuse


def latest(changes: DataFrame, key: str = "key", order: str = "offset", deleted: Column | None = None) -> DataFrame:
    """The last row of each key in the order of ``order``; keys whose last row is a tombstone are absent.

    ``deleted`` tells tombstones (default: NULL ``value``).  NULL keys can't
    be stored and are left out.  Aggregated before the shuffle, so a hot key
    is one row per input split.  Equal orders: the greatest row wins.
    """
    gone = F.coalesce(deleted if deleted is not None else F.col("value").isNull(), F.lit(False))
    row = F.struct(gone.alias("_tm_gone"), F.struct(*columns(changes.drop(key))).alias("row"))
    last = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(row, F.coalesce(F.col(order), F.lit(-1))).alias("_tm_row"))
    return last.where("NOT _tm_row._tm_gone").select(key, "_tm_row.row.*")


def versioned(changes: DataFrame, version: Column, key: str = "key", order: str = "offset", deleted: Column | None = None, or_equal: bool = False) -> DataFrame:
    """The row of each key under the version guard: ``key``, ``order`` and the row's ``version``.

    A tombstone always deletes and forgets the version; any version is taken
    where there is no row, else only a greater one (with ``or_equal``, one
    that isn't smaller).  Rows that are neither
    tombstones nor have a version are skipped, as are NULL keys.
    """
    gone = F.coalesce(deleted if deleted is not None else F.col("value").isNull(), F.lit(False))
    rows = changes.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(order).alias("order"), version.alias("version"), gone.alias("gone"), F.struct(F.col(order).alias("order"), version.alias("version")).alias("place"))
    state = cdc.apply_patches(cdc.patches(rows, ["key"], "order", "version", "gone", "place", or_equal=or_equal), ["key"])
    return state.select(F.col("key").alias(key), F.col("pos.order").alias(order), F.col("pos.version").alias("version"))


def compared(changes: DataFrame, version: Column, accept: Callable[[int, int], bool], key: str = "key", order: str = "offset") -> DataFrame:
    """Like :func:`versioned` with a version comparator of the user's, ``accept(new, current)``.

    Only an order-dependent fold can apply an arbitrary function, so a key's
    changes pass one task one after the other; they pass as a stream of
    (order, version) in sorted batches, so a hot key takes time, not memory.
    A comparator that is a total order of versions doesn't need this: see
    :func:`versioned`, also for equal versions that replace the row.
    """
    rows = changes.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(order).cast("bigint").alias("order"), F.when(F.col("value").isNotNull(), version.cast("bigint")).alias("version"), F.col("value").isNull().alias("gone"))
    schema = T.StructType([rows.schema["key"], T.StructField("order", T.LongType()), T.StructField("version", T.LongType())])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, now, held = [], None, None
        for pdf in batches:
            for k, at, new, gone in pdf.itertuples(index=False):
                if k != now:
                    if held is not None:
                        done.append((now, *held))
                    now, held = k, None
                if gone:
                    held = None
                elif not pd.isna(new) and (held is None or accept(int(new), held[1])):
                    held = (at, int(new))
            yield pd.DataFrame(done, columns=["key", "order", "version"])
            done = []
        yield pd.DataFrame([] if held is None else [(now, *held)], columns=["key", "order", "version"])

    ordered = rows.repartition("key").sortWithinPartitions("key", "order")
    return ordered.mapInPandas(fold, schema).select(F.col("key").alias(key), F.col("order").alias(order), "version")


def materialize(changes: DataFrame, key: str = "key", order: str = "offset", deleted: Column | None = None, version_column: str = "version", write: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Every record with its version: its number under the key since the last tombstone, from 1.

    A tombstone itself has the next number.  ``write(version, value)`` gives
    the value to keep.  Hot keys are numbered in stretches.  NULL keys can't
    be stored and are left out.
    """
    gone = deleted if deleted is not None else F.col("value").isNull()
    out = numbered(changes.where(F.col(key).isNotNull()), [key], order, gone, version_column)
    return out.withColumn("value", write(F.col(version_column), F.col("value"))) if write else out


def materialize_by(changes: DataFrame, extract: Callable[[object, object], int], write: Callable[[int, object], object], key: str = "key", order: str = "offset") -> DataFrame:
    """``key``, ``order``, ``value``, ``version``: :func:`materialize` with the user's version extractor and writer.

    ``extract(key, previous)`` gives the version of the value that is kept
    under the key (None if there is none); the record's version is one more,
    and ``write(version, value)`` the value to keep; None deletes.  What is
    kept depends on what was kept before, so a key's changes pass one task
    one after the other, as a stream of sorted batches.  NULL keys are left
    out.
    """
    rows = changes.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(order).cast("bigint").alias("order"), "value")
    schema = T.StructType([*rows.schema, T.StructField("version", T.LongType())])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, None
        for pdf in batches:
            done = []
            for k, at, value in pdf.itertuples(index=False):
                if k != now:
                    now, held = k, None
                version = extract(k, held) + 1
                held = write(version, None if value is None or value is pd.NaT or value != value else value)
                done.append((k, at, held, version))
            yield pd.DataFrame(done, columns=["key", "order", "value", "version"])

    ordered = rows.repartition("key").sortWithinPartitions("key", "order")
    return ordered.mapInPandas(fold, schema).select(F.col("key").alias(key), F.col("order").alias(order), "value", "version")


def compact(changes: DataFrame, key: str = "key", order: str = "offset", deleted: Column | None = None) -> DataFrame:
    """A changelog reduced to the last record of each key that isn't deleted, in the records' order."""
    return latest(changes, key, order, deleted)


def expired(written: Column, ttl_ms: int, now: Column) -> Column:
    """Whether a row is older than its time to live at ``now``; rows without time never expire."""
    return F.coalesce(F.unix_micros(now) - F.unix_micros(written) > ttl_ms * 1000, F.lit(False))


def live(df: DataFrame, written: Column, ttl_ms: int, now: Column) -> DataFrame:
    """The rows that haven't expired."""
    return df.where(~expired(written, ttl_ms, now))
