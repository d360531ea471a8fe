"""Joins of streams with tables and with streams."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import running
from tidemark.operators.stream import Expr, KeyedStream, both_errors, column, lenient
from tidemark.operators.tables import Table
from tidemark.plans.topology import Node

LEFT, INNER = "left", "inner"


def join_table(stream: KeyedStream, table: object, on: Expr | None = None, value: Expr | None = None, how: str = INNER, name: str = "join_table") -> KeyedStream:
    """Each record with the table's row under its mapped key.

    ``on`` maps a record to the table's key (default: the record's key);
    ``value`` is computed from ``value`` and ``right`` (the row's value), by
    default the struct of both.  The stream's key stays.

    A table has one row per key, so no record is multiplied.  A NULL mapped
    key drops the record, also with ``left``; a miss drops it with ``inner``.
    Both are errors of this stage, as rows of ``errors``.  An empty table is
    all misses.  The table is broadcast when it is small (measured by the
    planner and again at run time), else both sides are shuffled, with skewed
    partitions split.
    """
    if not isinstance(table, Table):
        raise TypeError("join_table joins a stream with a table")
    if how not in (LEFT, INNER):
        raise ValueError("how is 'left' or 'inner'")
    with lenient(stream.df.sparkSession):
        mapped = stream.df.withColumn("_tm_on", column(on) if on is not None else F.col("key"))
    rows = table.df.select(F.col("key").alias("_tm_table_key"), F.struct(F.col("value")).alias("_tm_right"))
    match = F.col("_tm_on") == F.col("_tm_table_key")
    found = mapped.where("_tm_on IS NOT NULL").join(rows, match, how)
    found = found.withColumn("right", F.col("_tm_right.value"))
    with lenient(stream.df.sparkSession):
        joined = found.withColumn("value", column(value) if value is not None else F.struct(F.col("value").alias("left"), F.col("right"))).drop("_tm_on", "_tm_table_key", "_tm_right", "right")
    out = replace(stream, df=joined, node=Node("joiner", f"{name} ({how})", (stream.node, table.node)))
    out = out._with_errors(mapped.where("_tm_on IS NULL"), name, F.lit("key mapping failed"))
    if how == INNER:
        out = out._with_errors(mapped.where("_tm_on IS NOT NULL").join(rows, match, "left_anti"), name, F.lit("no row under the key"))
    return out


def star_join(stream: KeyedStream, tables: dict[str, tuple[Table, Expr]], how: str = LEFT) -> KeyedStream:
    """A record with the rows of several tables, each under its own mapped key: ``value`` becomes (value, name, ...).

    Rules of :func:`join_table` for each table; keys are mapped from the
    original record.
    """
    named = stream.df.withColumn("_tm_star", F.struct("value"))
    for i, (_, on) in enumerate(tables.values()):
        named = named.withColumn(f"_tm_on{i}", column(on))
    out = replace(stream, df=named)
    for i, (label, (t, _)) in enumerate(tables.items()):
        out = join_table(out, t, F.col(f"_tm_on{i}"), F.col("right"), how, label)
        out = replace(out, df=out.df.withColumn("_tm_star", F.struct("_tm_star.*", F.col("value").alias(label))).withColumn("value", F.col("_tm_star.value")))
    return replace(out, df=out.df.withColumn("value", F.col("_tm_star")).drop("_tm_star", *(f"_tm_on{i}" for i in range(len(tables)))))


def join_tables(left: Table, right: Table, on: Expr | None = None, value: Expr | None = None, how: str = INNER, name: str = "join_tables") -> Table:
    """Table with table, under the left row's mapped key; the result has the left keys."""
    s = join_table(KeyedStream(left.df, left.node), right, on, value, how, name)
    return Table(s.df, name, s.node)


def paired(left: DataFrame, right: DataFrame, key: str, order: str, left_value: Column, right_value: Column, width: int | None = None) -> DataFrame:
    """``key``, ``order``, ``left``, ``right``: the rule of :func:`join_stream` on two static inputs.

    ``order`` is a bigint that is unique over both inputs.
    """
    both = left.select(F.col(key).alias("key"), F.col(order).alias("order"), F.lit("L").alias("side"), F.struct(left_value.alias("v")).alias("l"), F.lit(None).alias("r")).unionByName(
        right.select(F.col(key).alias("key"), F.col(order).alias("order"), F.lit("R").alias("side"), F.lit(None).alias("l"), F.struct(right_value.alias("v")).alias("r"))
    )
    more = {"width": width} if width else {}
    seen = running(both.where("key IS NOT NULL AND order IS NOT NULL"), ["key"], "order", lasts={"last_l": F.col("l"), "last_r": F.col("r")}, firsts={"first": F.col("side")}, **more)
    probe = seen.where("side <> first")
    own = F.col("side") == "L"
    return probe.select("key", "order", F.when(own, F.col("l")).otherwise(F.col("last_l"))["v"].alias("left"), F.when(own, F.col("last_r")).otherwise(F.col("r"))["v"].alias("right"))


def join_stream(left: KeyedStream, right: KeyedStream, value: Expr | None = None, name: str = "join_stream") -> KeyedStream:
    """Inner join of two streams by key, with the last value of one side as state.

    For each key the side that arrives first is the table side for good: its
    later records update the value, and each record of the other side is
    joined with the latest one and emitted under its own position.  There is
    no time bound.  ``value`` is computed from ``left`` and ``right``; by
    default it is the struct of both.

    Arrival is the order of ``offset``, which must be unique over both
    streams; chained joins keep the position of the record that triggered
    them.  NULL keys don't join.  NULL values (tombstones) are values.
    Static streams only; :mod:`tidemark.streaming.stateful` has the same rule
    for running queries.
    """
    if left.df.isStreaming or right.df.isStreaming:
        from tidemark.streaming.stateful import join_running

        return join_running(left, right, value, name)
    pairs = paired(left.df, right.df, "key", "offset", F.col("value"), F.col("value"))
    made = column(value) if value is not None else F.struct("left", "right")
    with lenient(pairs.sparkSession):
        df = pairs.select("key", made.alias("value"), F.col("order").alias("offset"))
    return KeyedStream(df, Node("stream_joiner", name, (left.node, right.node)), both_errors(left, right), left.key_selected or right.key_selected)
