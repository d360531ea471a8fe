"""Versioned upserts, materialized versions and stream joins: pinned cases and simulations."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators import tables
from tidemark.operators.joins import paired
from tidemark.operators.scan import numbered, running
from tidemark.operators.stores import IndexedStore, Registry, Store, UnknownIndex, UnknownStore
from tidemark.functions.serdes import IntCodec, StringCodec


def changes(spark, data):
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(data)], "key string, value string, offset bigint")


VERSION = "try_cast(value AS bigint)"


@pytest.mark.parametrize(
    "data,want",
    [
        ([("1", "1"), ("2", "2")], [("1", 1), ("2", 2)]),
        ([("1", "1"), ("1", "5"), ("1", "7")], [("1", 7)]),
        ([("1", "1"), ("1", "5"), ("1", "2")], [("1", 5)]),
        ([("1", "1"), ("1", "5"), ("1", None), ("1", "2")], [("1", 2)]),
        ([("1", "1"), ("1", None)], []),
        ([("1", "3"), ("1", "bad"), (None, "9")], [("1", 3)]),
        ([], []),
    ],
)
def test_versioned(spark, data, want):
    df = changes(spark, data)
    assert rows(tables.versioned(df, F.expr(VERSION)).select("key", "version")) == want
    assert rows(tables.compared(df, F.expr(VERSION), lambda new, old: new > old).select("key", "version")) == want
    equal = tables.versioned(df, F.expr(VERSION), or_equal=True)
    assert rows(equal) == rows(tables.compared(df, F.expr(VERSION), lambda new, old: new >= old).select(*equal.columns))


def test_latest(spark):
    assert rows(tables.latest(changes(spark, [("1", "1"), ("1", "5"), ("1", "2")])).select("key", "value")) == [("1", "2")]
    assert rows(tables.latest(changes(spark, [("1", "1"), ("1", None), ("2", "x"), (None, "y")])).select("key", "value")) == [("2", "x")]
    many = [(str(i), "v") for i in range(3333)]
    assert tables.latest(changes(spark, many)).count() == 3333
    assert tables.latest(changes(spark, many).where("offset > 9999")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_materialize_equals_simulation(spark, seed):
    rng = random.Random(seed)
    data = [(rng.choice("aab"), rng.choice(["x", "y", None])) for _ in range(200)]
    count, want = {}, []
    for i, (k, v) in enumerate(data):
        count[k] = count.get(k, 0) + 1
        want.append((i, count[k]))
        if v is None:
            count[k] = 0
    assert rows(tables.materialize(changes(spark, data)).select("offset", "version")) == sorted(want, key=repr)
    written = tables.materialize(changes(spark, data), write=lambda n, v: F.concat_ws("#", v, n))
    assert written.where("offset = 0").first()["value"] in ("x#1", "y#1", "1")


@pytest.mark.parametrize("width", [1 << 20, 7])
@pytest.mark.parametrize("seed", range(3))
def test_stream_join_equals_simulation(spark, seed, width):
    rng = random.Random(seed)
    data = [(rng.choice(["a", "a", "b", "c", None]), i, rng.choice("LR"), rng.choice([None, i])) for i in rng.sample(range(1000), 150)]
    state, want = {}, []
    for k, i, side, v in sorted(data, key=lambda r: r[1]):
        if k is None:
            continue
        first, held = state.setdefault(k, (side, None))
        if side == first:
            state[k] = (first, v)
        else:
            want.append((k, i, v, held) if side == "L" else (k, i, held, v))
    df = spark.createDataFrame(data, "key string, offset bigint, side string, v bigint")
    got = paired(df.where("side = 'L'"), df.where("side = 'R'"), "key", "offset", F.col("v"), F.col("v"), width)
    assert rows(got) == sorted(want, key=repr)


def test_running_over_stretches(spark):
    df = spark.createDataFrame([("a", i, i % 3 if i % 4 else None) for i in range(50)] + [(None, 3, 1)], "k string, o bigint, x int")
    x = {"x": F.col("x")}
    for before in (False, True):
        small, large = (rows(running(df, ["k"], "o", *({t + n: c for n, c in x.items()} for t in "slfm"), before=before, width=w, nullable=True)) for w in (4, 1000))
        assert small == large
        held, want = [], []
        for o, v in ((r[1], r[2]) for r in df.where("k = 'a'").collect()):
            now = [*held, v]
            seen = [y for y in (held if before else now) if y is not None]
            want.append(("a", o, v, sum(seen), seen[-1] if seen else None, seen[0] if seen else None, max(seen, default=None)))
            held = now
        assert [r for r in small if r[0]] == sorted(want, key=repr)
    assert rows(running(df.where("k = 'a'"), [], "o", {"s": F.col("x")}, width=4)) == rows(running(df.where("k = 'a'"), ["k"], "o", {"s": F.col("x")}))
    for reset in ("x = 2", "false", "x IS NULL"):
        small, large = (rows(numbered(df, ["k"], "o", F.expr(reset), "n", w, True)) for w in (4, 1000))
        assert small == large


def test_expiry(spark):
    df = spark.sql("SELECT 100L AS key, 'v' AS value, timestamp'2024-01-01 00:00:00' AS timestamp")
    at = lambda t: F.lit(t).cast("timestamp")
    assert rows(Store("s", df, 100, now=at("2024-01-01 00:00:00.200")).get(100)) == []
    assert len(rows(Store("s", df, 100, now=at("2024-01-01 00:00:00.050")).get(100))) == 1
    assert rows(tables.live(df, F.col("timestamp"), 100, at("2024-01-01 00:00:01"))) == []


def test_expiry_of_single_records(spark):
    df = spark.sql("SELECT 100L AS key, 'v' AS value, timestamp'2024-01-01 00:00:00' AS timestamp")
    at = lambda t: F.lit(t).cast("timestamp")
    s = Store("s", df, ttl_ms=60_000, now=at("2024-01-01 00:00:30"))
    put = s.put(1, "kept").put(2, "gone", expiry_ms=0).put(3, "short", expiry_ms=10)
    assert rows(put.df.select("key")) == [(1,), (100,), (3,)]
    assert rows(Store("s", df, ttl_ms=60_000, now=at("2024-01-01 00:02:00")).put(1, "x").df.select("key")) == [(1,)]  # the store's time to live stays
    before = put.df._jdf.queryExecution().analyzed().toString().count("Union")
    for k in range(50):
        put = put.put(k, "w")
    assert put.df._jdf.queryExecution().analyzed().toString().count("Union") == before and put.df.count() == 51
    i = IndexedStore("s", df, {"v": "value"}, ttl_ms=60_000, now=at("2024-01-01 00:02:00")).put(7, "q", 5)
    assert rows(i.dump("v")) == [("q", 7)]


def test_materialize_by(spark):
    df = changes(spark, [("a", "x"), ("a", "y"), ("b", "z"), ("a", None), ("a", "w"), (None, "n")])
    out = tables.materialize_by(df, lambda k, held: int(held.split("#")[1]) if held else 0, lambda n, v: None if v is None else f"{v}#{n}")
    assert rows(out) == [("a", 0, "x#1", 1), ("a", 1, "y#2", 2), ("a", 3, None, 3), ("a", 4, "w#1", 1), ("b", 2, "z#1", 1)]


def test_store(spark):
    df = spark.createDataFrame([(100, "test_value"), (200, ""), (300, None), (None, "x")], "key bigint, value string")
    s = Store("s", df)
    assert s.value(100) == "test_value" and s.value(200) is None and s.value(300) is None and s.value(1) is None
    s = s.put(5, "five").put(7, "seven").delete(100)
    assert [r["key"] for r in s.scan().collect()] == [5, 7] and [r["key"] for r in s.iterate(descending=True)] == [7, 5]
    assert rows(s.range(6, 9).select("key")) == [(7,)] and rows(s.scan(after=6).select("key")) == [(7,)]
    raw = spark.createDataFrame([(b"1", b"a"), (b"x", b"b")], "key binary, value binary")
    assert rows(Store.encoded("e", raw, IntCodec(), StringCodec()).df) == [(1, "a")]


def test_indexed_store(spark):
    df = spark.createDataFrame([("200", "111,222"), ("300", "111,333"), ("400", "222,333"), ("500", None)], "key string, value string")
    s = IndexedStore("s", df, {"head": "split(value, ',')[0]"})
    assert rows(s.lookup("head", "111").select("value")) == [("111,222",), ("111,333",)]
    assert rows(s.delete("200").lookup("head", "111").select("key")) == [("300",)]
    assert rows(s.put("300", "999,1").dump("head")) == [("111", "200"), ("222", "400"), ("999", "300")]
    assert rows(s.lookup("head", "none")) == []
    with pytest.raises(UnknownIndex):
        s.lookup("nope", 1)
    r = Registry()
    r.register(s)
    with pytest.raises(ValueError):
        r.register(s)
    with pytest.raises(UnknownStore):
        r.store("nope")
    assert r.stores() == ["s"] and r.indexes() == r.indexes("s") == ["head"]
