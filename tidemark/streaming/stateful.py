"""The stream-stream join for running queries: per key, the first side to arrive is the table side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.stream import Expr, KeyedStream, both_errors, column
from tidemark.plans.topology import Node


def _join_key(ttl_ms: int | None):
    """The state of a key: the table side and its last value, as JSON."""

    def join(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, held = state.get if state.exists else (None, None)
        rows = pd.concat(list(parts)).sort_values("offset", kind="stable")
        side, own = rows["side"].to_numpy(), rows["own"].to_numpy(dtype=object)
        first = first or side[0]
        table = side == first
        at = np.maximum.accumulate(np.where(table, np.arange(len(rows)), -1))
        last = np.array([held if i < 0 else own[i] for i in at], dtype=object)
        state.update((first, last[-1]))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        out = pd.DataFrame({"key": rows["key"], "offset": rows["offset"], "side": side, "own": own, "other": last})
        yield out[~table]

    return join


def join_running(left: KeyedStream, right: KeyedStream, value: Expr | None = None, name: str = "join_stream", ttl_ms: int | None = None) -> KeyedStream:
    """:func:`tidemark.operators.joins.join_stream` on streaming DataFrames.

    Within a micro-batch records are ordered by ``offset``; micro-batches are
    in the order of the source.  State is unbounded, as in the static rule,
    unless ``ttl_ms`` forgets keys that are idle for so long (processing
    time).  Values are kept as JSON between micro-batches.  A key's records of
    one micro-batch are put in order in memory, since groups with state come
    unordered: bound micro-batches at the source (``batches_per_trigger``)
    where one key may have very many.
    """
    kinds = (left.df.schema["value"].dataType, right.df.schema["value"].dataType)
    key = left.df.schema["key"].dataType

    def tagged(s: KeyedStream, side: str):
        return s.df.where("key IS NOT NULL").select("key", F.col("offset").cast("bigint").alias("offset"), F.lit(side).alias("side"), F.to_json(F.struct(F.col("value").alias("v")), {"ignoreNullFields": "false"}).alias("own"))

    out = T.StructType([T.StructField("key", key), T.StructField("offset", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("side", "own", "other"))])
    state = T.StructType([T.StructField("first", T.StringType()), T.StructField("held", T.StringType())])
    timeout = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    pairs = tagged(left, "L").unionByName(tagged(right, "R")).groupBy("key").applyInPandasWithState(_join_key(ttl_ms), out, state, "append", timeout)
    sides = [F.from_json(F.when(F.col("side") == s, F.col("own")).otherwise(F.col("other")), T.StructType([T.StructField("v", k)]))["v"] for s, k in zip("LR", kinds, strict=True)]
    named = pairs.select("key", "offset", sides[0].alias("left"), sides[1].alias("right"))
    df = named.select("key", (column(value) if value is not None else F.struct("left", "right")).alias("value"), "offset")
    return KeyedStream(df, Node("stream_joiner", name, (left.node, right.node)), both_errors(left, right), left.key_selected or right.key_selected)
