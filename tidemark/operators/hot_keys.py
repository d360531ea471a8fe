"""Totals per key when a few keys hold most rows.

Rows are never shuffled by key.  Every input split (splits are equal in
bytes) dictionary-encodes its keys and adds its rows up in dense numpy arrays
indexed by code, whatever the keys' frequencies.  The arrays are cut into
blocks by the leading bits of the keys' hash, and the blocks are summed by a
tree: each level adds up FAN_IN splits and cuts the sums into FAN_IN smaller
blocks, until one split is left.  So no task holds more than the blocks of
FAN_IN splits, however many splits and keys there are, and the hottest key is
one array element per split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import input_splits

#: Entries of a split's dictionary at which its arrays are sent on and begun anew.
MOST_ENTRIES = 1 << 20
#: Rows that are encoded at once.
ROWS = 1 << 18
#: Leading bits of the hash that a split's own blocks have in common.
BITS = 6
#: Splits that are added up in one step, as a power of two: so many more bits a level.
STEP = 4


def _exact_sums(codes: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """int64 sums by code; bincount adds floats, so halves of 26 bits are added apart to stay exact."""
    low = np.bincount(codes, weights=(weights & 0x3FFFFFF).astype(np.float64), minlength=size)
    high = np.bincount(codes, weights=(weights >> 26).astype(np.float64), minlength=size)
    return low.astype(np.int64) + (high.astype(np.int64) << 26)


def _encode(keys: pa.ChunkedArray | pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Dictionary of the keys (NULL has an entry) and the code of each row."""
    if isinstance(keys, pa.ChunkedArray):
        keys = keys.combine_chunks()
    coded = keys.dictionary_encode(null_encoding="encode")
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _merged(tables: list[pa.Table], n_measures: int) -> pa.Table:
    """Rows of equal key added up: key, hash, n, m0, m1, ...

    Columns of the plan may be declared not NULL, those of sums aren't; promotion takes both together.
    """
    whole = pa.concat_tables(tables, promote_options="default")
    entries, codes = _encode(whole["key"])
    size = len(entries)
    hashes = np.zeros(size, np.int64)
    hashes[codes] = whole["hash"].to_numpy()
    columns = {"key": entries, "hash": pa.array(hashes)}
    for name in ["n", *(f"m{i}" for i in range(n_measures))]:
        columns[name] = pa.array(_exact_sums(codes, whole[name].to_numpy().astype(np.int64), size))
    return pa.table(columns)


def _members(n_measures: int) -> list[str]:
    return ["key", "hash", "n", *(f"m{i}" for i in range(n_measures))]


def _blocks(totals: pa.Table, lane: int, bits: int, n_measures: int) -> pa.RecordBatch:
    """A row per block, with the block's slices of the arrays; ``bits`` leading bits of the hash name the block."""
    block = (totals["hash"].to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    block, totals = block[order], totals.take(pa.array(order))
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
    ends = pa.array(np.r_[starts, len(block)].astype(np.int32))
    lists = {f"{name}s": pa.ListArray.from_arrays(ends, totals[name].combine_chunks()) for name in _members(n_measures)}
    return pa.RecordBatch.from_pydict({"block": pa.array(block[starts]), "lane": pa.array(np.full(len(starts), lane, np.int32))} | lists)


def _opened(table: pa.Table, n_measures: int) -> pa.Table:
    """The arrays of a table of blocks, as rows."""
    whole = table.combine_chunks()
    return pa.table({name: whole[f"{name}s"].combine_chunks().flatten() for name in _members(n_measures)})


def key_totals(df: DataFrame, key: Column, measures: dict[str, Column] | None = None, splits: int | None = None) -> DataFrame:
    """``key``, ``n`` (rows) and the sum of each measure (bigint, NULL counts as 0), a row per distinct key.

    NULL keys are a key.  Keys of any type that Arrow can encode as a
    dictionary.  An empty input gives an empty result.  Other columns of
    ``df`` aren't read.  ``splits``: about how many input splits there are
    (default: the planner's number), which sets the levels of the tree; the
    result is the same with any.
    """
    measures = measures or {}
    count = len(measures)
    rows = df.select(
        key.alias("key"),
        F.xxhash64(key).alias("hash"),
        *(F.coalesce(c.cast("bigint"), F.lit(0)).alias(f"m{i}") for i, c in enumerate(measures.values())),
    )
    kind = rows.schema["key"].dataType
    lists = [T.StructField(f"{name}s", T.ArrayType(kind if name == "key" else T.LongType())) for name in _members(count)]
    arrays = T.StructType([T.StructField("block", T.LongType()), T.StructField("lane", T.IntegerType()), *lists])
    totals = T.StructType([T.StructField("key", kind), T.StructField("n", T.LongType()), *(T.StructField(m, T.LongType()) for m in measures)])
    names = list(measures)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lane = TaskContext.get().partitionId()
        waiting: list[pa.RecordBatch] = []
        held, size = None, 0

        def add() -> pa.Table:
            t = pa.Table.from_batches(waiting)
            t = t.append_column("n", pa.array(np.ones(len(t), np.int64)))
            return _merged([t] if held is None else [held, t.select(held.column_names)], count)

        for b in batches:
            waiting.append(b)
            size += b.num_rows
            if size >= ROWS:
                held, waiting, size = add(), [], 0
                if len(held) >= MOST_ENTRIES:
                    yield _blocks(held, lane, BITS, count)
                    held = None
        if size:
            held = add()
        if held is not None and len(held):
            yield _blocks(held, lane, BITS, count)

    def summed(bits: int):
        def step(t: pa.Table) -> pa.Table:
            lane = t["lane"][0].as_py() >> STEP
            return pa.Table.from_batches([_blocks(_merged([_opened(t, count)], count), lane, bits, count)])

        return step

    def last(t: pa.Table) -> pa.Table:
        m = _merged([_opened(t, count)], count)
        return pa.table([m["key"], m["n"], *(m[f"m{i}"] for i in range(count))], names=["key", "n", *names])

    out, lanes, bits = rows.mapInArrow(split, arrays), splits or input_splits(df), BITS
    while lanes > 1 << STEP:
        bits += STEP
        out = out.groupBy("block", F.shiftright("lane", STEP)).applyInArrow(summed(bits), arrays)
        lanes = -(-lanes >> STEP)
    return out.groupBy("block").applyInArrow(last, totals)


def heavy_keys(totals: DataFrame, rows: DataFrame, share: tuple[int, int] = (2, 100)) -> DataFrame:
    """Keys with at least ``share`` (numerator, denominator) of all rows of ``rows``; the NULL key isn't one.

    The number of all rows is a scalar subquery that reads no column.
    """
    every = rows.agg(F.count(F.lit(1)).alias("n"))
    return totals.where(F.col("key").isNotNull() & (F.col("n") * share[1] >= every.scalar() * share[0]))
