"""Packings are whole and valid; bounds are below every packing."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.llm.packing import best_fit_decreasing, lower_bound, pack_items


def best(sizes, capacity):
    """The fewest containers, by search."""
    found = len(sizes)

    def place(i, rooms):
        nonlocal found
        if len(rooms) >= found:
            return
        if i == len(sizes):
            found = len(rooms)
            return
        for j, room in enumerate(rooms):
            if room >= sizes[i] and room not in rooms[:j]:
                place(i + 1, [*rooms[:j], room - sizes[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return found


def test_bounds_and_fit():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([7, 10, 13])
        sizes = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))), reverse=True)
        where, left = best_fit_decreasing(np.array(sizes), capacity)
        fill = np.bincount(where, weights=sizes, minlength=len(left))
        # item by item, as the rule says
        rooms = []
        for x in sizes:
            fits = [r for r in rooms if r >= x]
            room = min(fits) if fits else capacity
            if fits:
                rooms.remove(room)
            rooms.append(room - x)
        assert sorted(rooms) == sorted(left.tolist())
        assert (fill + left == capacity).all() and (fill <= capacity).all()
        assert lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity) <= best(sizes, capacity) <= len(left)
    assert lower_bound(np.bincount([6] * 5, minlength=11), 10) == 5
    assert lower_bound(np.bincount([4] * 6, minlength=11), 10) == 3
    assert lower_bound(np.zeros(11, int), 10) == 0 and lower_bound(np.bincount([0], minlength=11), 10) == 1


@pytest.mark.parametrize("per_part", [20_000, 40])
@pytest.mark.parametrize("kind", ["any", "large", "same", "hot"])
def test_packing(spark, kind, per_part):
    rng = random.Random(5)
    size = {"any": lambda: rng.randrange(0, 260), "large": lambda: rng.randrange(40, 101), "same": lambda: 34, "hot": lambda: 1 if rng.random() < 0.4 else rng.randrange(90)}[kind]
    data = [(i, size(), "x") for i in range(600)] + [(1, 5, "x"), (1, 5, "x"), (None, 7, "x"), (None, None, "x"), (900, 0, "x"), (901, -3, "x"), (902, 1000, "x")]
    p = pack_items(spark.createDataFrame(data, "k bigint, n int, container string"), "k", "n", 100, per_part)
    fill, pieces = defaultdict(int), defaultdict(list)
    for r in p.placed.collect():
        fill[r["container"]] += r["size"]
        pieces[r["k"]].append(r)
    assert max(fill.values()) <= 100 and len(fill) == p.containers >= p.lower_bound
    want = defaultdict(int)
    for k, n, _ in data:
        want[k] += max(0, n or 0)
    assert {k: sum(r["size"] for r in v) for k, v in pieces.items()} == dict(want)
    assert all(len({r["container"] for r in v}) == 1 or len(v) > 1 for v in pieces.values())
    assert all(len(pieces[k]) == 1 for k, n, _ in data if k not in (1, None) and (n or 0) <= 100)
    assert sorted(r["piece"] for r in pieces[902]) == list(range(10))
    if per_part == 20_000 or kind == "same":
        assert p.containers <= 1.02 * p.lower_bound + 1


def test_exchange_saves_containers(spark):
    rng = random.Random(8)
    sizes = [rng.randrange(1, 60) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "k bigint, n int")
    exchanged = pack_items(df, "k", "n", 100, 30)
    alone = sum(len(best_fit_decreasing(np.array(sizes[i : i + 30]), 100)[1]) for i in range(0, 2000, 30))
    assert exchanged.lower_bound <= exchanged.containers <= exchanged.lower_bound + 3 < alone


def test_the_same_however_rows_lie(spark):
    rng = random.Random(9)
    data = [(i % 700, rng.randrange(1, 90) if i < 700 else 5) for i in range(900)]
    one = pack_items(spark.createDataFrame(data, "k bigint, n int").coalesce(1), "k", "n", 100, 100)
    rng.shuffle(data)
    other = pack_items(spark.createDataFrame(data, "k bigint, n int").repartition(7), "k", "n", 100, 100)
    assert rows(one.placed) == rows(other.placed)


def test_many_equal_rows(spark):
    """One row a third of all, in more copies than are spread at once."""
    df = spark.range(70_000).select(F.when(F.col("id") < 68_000, -1).otherwise(F.col("id")).alias("k"), F.when(F.col("id") < 68_000, 3).otherwise(40).cast("int").alias("n"))
    p = pack_items(df, "k", "n", 100)
    assert p.placed.count() == 70_000 and p.lower_bound <= p.containers == p.placed.select("container").distinct().count() <= 2881


def test_empty(spark):
    p = pack_items(spark.createDataFrame([], "k bigint, n int"), "k", "n")
    assert p.placed.collect() == [] and p.containers == p.lower_bound == 0
