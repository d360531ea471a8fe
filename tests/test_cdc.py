import math
import random

import pytest

from tests.conftest import rows
from tidemark.operators.cdc import CHUNK, apply_patches, patches

SCHEMA = "k string, at bigint, ver double, gone boolean, place bigint, patch int"


def fold(changes, base=None):
    state = dict(base or {})
    for k, _, ver, gone, place, _ in sorted(changes, key=lambda r: (-1 if r[1] is None else r[1], r[4])):
        if gone:
            state.pop(k, None)
        elif ver is not None and (k not in state or ver > state[k][0]):
            state[k] = (ver, place)
    return sorted(((k, *v) for k, v in state.items()), key=repr)


@pytest.mark.parametrize("seed,chunk", [(0, None), (1, 4), (2, 1), (3, 1 << 16)])
def test_equals_ordered_fold(spark, seed, chunk):
    rng = random.Random(seed)
    changes = [(rng.choice(["hot", "hot", "hot", None, f"k{rng.randrange(20)}"]), rng.choice([i, i, rng.randrange(50), None]), rng.choice([None, float(rng.randrange(8))]), rng.random() < 0.15, i, 0) for i in range(300)]
    base = {k: (float(rng.randrange(8)), 1000 + i) for i, k in enumerate(["hot", None, "k1", "k2", "only base"])}
    df = spark.createDataFrame(changes, SCHEMA)
    patched = patches(df, ["k"], "at", "ver", "gone", "place", tie="place", chunk=chunk)
    assert rows(apply_patches(patched, ["k"])) == fold(changes)
    frame = spark.createDataFrame([(k, *v) for k, v in base.items()], "k string, ver double, pos bigint")
    assert rows(apply_patches(patched, ["k"], frame)) == fold(changes, base)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows(apply_patches(patches(empty, ["k"], "at", "ver", "gone", "place"), ["k"])) == []


@pytest.mark.parametrize("top", [225, 9999])
def test_hot_key_spans_chunks_at_the_default_width(spark, top):
    """A hot key's changes lie in many chunks, reduced in two levels, also at the largest offset of the smaller test tables."""
    rng = random.Random(3)
    changes = [(rng.choice(["hot", f"k{rng.randrange(40)}", f"k{rng.randrange(40)}"]), o, float(rng.randrange(500)), rng.random() < 0.01, i, 0) for i, o in enumerate(rng.sample(range(top + 1), min(top + 1, 3000)))]
    df = spark.createDataFrame(changes, SCHEMA)
    patched = patches(df, ["k"], "at", "ver", "gone", "place")
    levels = [line for line in patched._jdf.queryExecution().optimizedPlan().toString().splitlines() if line.strip(" :+-").startswith("Aggregate [") and "collect_list" in line]
    width = max(CHUNK, math.ceil(math.sqrt(top + 1)))
    assert len(levels) == 2 and len({o // width for k, o, *_ in changes if k == "hot"}) >= 10
    assert rows(apply_patches(patched, ["k"])) == fold(changes)


def test_changes_without_order_are_split_too(spark):
    changes = [("hot", None, float(i % 977), i % 500 == 3, i, 0) for i in range(2000)]
    patched = patches(spark.createDataFrame(changes, SCHEMA), ["k"], "at", "ver", "gone", "place", tie="place")
    assert rows(apply_patches(patched, ["k"])) == fold(changes)
