"""Documents into containers of fixed capacity, with certified bounds.

Items are packed in independent partitions by best-fit decreasing, a size at
a time.  Every partition computes a lower bound of its containers from dual
feasible functions; where the bound is met, no packing of these items is
better and the partition is done.  Partitions with a gap give up the items of
their unfilled containers, exchange them and pack again, round after round,
until all are certified or a round saves nothing.  Then all partitions
exchange what is in their unfilled containers, in the same way, so that their
remainders share containers, too.  What is done is written once and not
touched again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import written

CAPACITY = 2048
#: Items in a partition, on average.
ITEMS = 20_000
#: Dual feasible functions of the second family: shares of the capacity in k-ths for k below this.
SHARES = 40
_BIN_BITS = 32
#: Repeated rows that one row is spread to at once.
_COPIES = 1 << 16


@dataclass(frozen=True)
class Packing:
    """``placed``: a row per piece; ``containers`` of the packing and ``lower_bound`` of any packing."""

    placed: DataFrame
    containers: int
    lower_bound: int


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Containers that items of size s, ``counts[s]`` of them, need at least.

    The maximum over two families of dual feasible functions: the one that
    drops items below a threshold and rounds up those that leave less room
    than it, and the one that rounds shares of the capacity to k-ths.
    """
    sizes = np.arange(len(counts))
    total, number = int((counts * sizes).sum()), int(counts.sum())
    best = max(-(-total // capacity), int(number > 0))
    c, s = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * sizes)]
    for low in range(1, capacity // 2 + 1):
        half = capacity // 2
        big = c[capacity + 1] - c[capacity - low + 1]
        middle = c[capacity - low + 1] - c[half + 1]
        room = int(middle) * capacity - int(s[capacity - low + 1] - s[half + 1])
        small = int(s[half + 1] - s[low])
        best = max(best, int(big + middle) + max(0, -(-(small - room) // capacity)))
    for k in range(1, SHARES):
        exact = sizes * (k + 1) % capacity == 0
        value = np.where(exact, sizes * k, sizes * (k + 1) // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container of each item, and the room left in each container.

    Items of one size go together: the tightest room takes as many as fit,
    since what is left of it is tighter still, then the next one.  The rooms
    with an open container are the bits of one integer.
    """
    where = np.zeros(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    ordered = sizes[order]
    starts = np.flatnonzero(np.diff(ordered, prepend=-1))
    by_room: list[list[np.ndarray]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0
    left = np.zeros(len(sizes), np.int64)

    def put(bins: np.ndarray, room: int) -> None:
        nonlocal rooms
        left[bins] = room
        by_room[room].append(bins)
        rooms |= 1 << room

    for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(ordered)]):
        size, at = int(ordered[a]), a
        if size == 0:
            # what takes no room goes into one container
            if not used:
                used = 1
                put(np.zeros(1, np.int64), capacity)
            where[order[a:z]] = 0
            continue
        while at < z:
            fits = rooms >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                bins = np.concatenate(by_room[room])
                by_room[room] = []
                rooms &= ~(1 << room)
            else:
                room = capacity
                bins = np.arange(used, used + -(-(z - at) // (capacity // size)))
                used += len(bins)
            each = room // size
            full = min(len(bins), (z - at) // each)
            taken = np.repeat(bins[:full], each)
            where[order[at : at + len(taken)]] = taken
            at += len(taken)
            if full:
                put(bins[:full], room - each * size)
            rest = bins[full:]
            if len(rest) and at < z:  # the last container of this size takes fewer
                where[order[at:z]] = rest[0]
                put(rest[:1], room - (z - at) * size)
                at, rest = z, rest[1:]
            if len(rest):
                put(rest, room)
    return where, left[:used]


def _packed(items: DataFrame, columns: Sequence[str], capacity: int, first: int) -> DataFrame:
    """Items with ``part`` packed part by part: adds ``container``, ``room``, the part's ``gap`` and whether the item is its container's ``head``."""
    kept = items.select(*columns, "part")
    schema = T.StructType([*kept.schema, *(T.StructField(n, T.LongType()) for n in ("container", "room", "gap", "head"))])

    def pack(t: pa.Table) -> pa.Table:
        # in an order of their own, however the rows came
        t = t.sort_by([(n, "ascending") for n in columns])
        sizes = t["size"].to_numpy().astype(np.int64)
        where, left = best_fit_decreasing(sizes, capacity)
        gap = len(left) - lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        base = (first + t["part"][0].as_py()) << _BIN_BITS
        head = np.zeros(len(sizes), np.int64)
        head[np.unique(where, return_index=True)[1]] = 1
        for name, values in (("container", base + where), ("room", left[where]), ("gap", np.full(len(sizes), gap)), ("head", head)):
            t = t.append_column(name, pa.array(values.astype(np.int64)))
        return t

    return kept.groupBy("part").applyInArrow(pack, schema)


def _items(sized: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """Pieces of at most ``capacity``; equal rows are told apart by ``copy``, however they lie."""
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("bigint"), F.lit(0))
    rows = sized.select(F.col(key).alias(key), n.alias("_n")).groupBy(key, "_n").agg(F.count(F.lit(1)).alias("_c"))
    rows = rows.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_c - 1) div {_COPIES}"))))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.expr(f"_b * {_COPIES}"), F.expr(f"least(_c, (_b + 1) * {_COPIES}) - 1"))))
    rows = rows.withColumn("n_pieces", F.greatest(F.expr(f"CAST(ceil(_n / {capacity}D) AS INT)"), F.lit(1)))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    return rows.select(key, "piece", "n_pieces", F.least(F.lit(capacity), F.col("_n") - F.col("piece").cast("bigint") * capacity).alias("size"), "copy")


def pack_items(sized: DataFrame, key: str, size: str, capacity: int = CAPACITY, items_per_part: int = ITEMS) -> Packing:
    """Every row of ``sized`` in containers of ``capacity``: ``key``, ``piece``, ``n_pieces``, ``size``, ``container``.

    Only an item larger than the capacity is split: into full pieces and one
    rest, numbered from 0.  Items of size 0 or NULL (empty texts) take no
    room but have a container.  Repeated rows are items of their own.  An
    empty input gives no container.  The same rows give the same containers,
    however they are spread over files and tasks.

    Groups stay bounded: ``items_per_part`` items are expected in each, by a
    hash of the row.  The driver holds the number of items by size (capacity
    + 1 numbers) and a few sums a round.
    """
    columns = [key, "piece", "n_pieces", "size", "copy"]
    items = written(_items(sized, key, size, capacity), "items")
    counts = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect():  # capacity + 1 rows at most
        counts[r["size"]] = r["n"]
    bound, total, used = lower_bound(counts, capacity), int(counts.sum()), 0

    def packed(rows: DataFrame, number: int, salt: int) -> DataFrame:
        nonlocal used
        parts = max(1, -(-number // items_per_part))
        placed = rows.withColumn("part", F.pmod(F.xxhash64(key, "piece", "copy", F.lit(salt)), F.lit(parts)).cast("long"))
        out = written(_packed(placed, columns, capacity, used), "packed")
        used += parts
        return out

    def sums(df: DataFrame) -> tuple[int, int]:
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum("head").alias("c")).first()
        return r["n"], r["c"] or 0

    # tables of which only the rows that aren't open any more count, but for the last one
    now = packed(items, total, 0)
    done: list[DataFrame] = []
    containers, turn = sums(now)[1], 0
    for open_ in (F.expr("room > 0 AND gap > 0"), F.expr("room > 0")):
        while containers > bound:
            rows = now.where(open_)
            number, before = sums(rows)
            if not number:
                break
            turn += 1
            tried = packed(rows, number, turn)
            after = sums(tried)[1]
            if after >= before:
                break
            done.append(now.where(~open_))
            now, containers = tried, containers - before + after
        # the second time, all tables' unfilled containers are exchanged
        if done:
            now = _union([*done, now])
            done = []
    return Packing(now.select(key, "piece", "n_pieces", "size", "container"), containers, bound)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
