"""The stream operators' pinned cases."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.functions.records import header, record_id
from tidemark.functions.serdes import IntCodec, JsonCodec, StringCodec, UnionCodec, UuidCodec, http_time
from tidemark.operators.joins import join_table, join_tables, star_join
from tidemark.operators.stream import KeyedStream
from tidemark.operators.tables import Table, TableMisuse
from tidemark.plans.topology import to_dot


def stream(spark, data, key="bigint", value="string"):
    df = spark.createDataFrame([(k, v, "t", 0, i) for i, (k, v) in enumerate(data)], f"key {key}, value {value}, topic string, partition int, offset bigint")
    return KeyedStream.source(df)


def pairs(s):
    return rows(s.df.select("key", "value"))


def test_int_codec(spark):
    s = spark.createDataFrame([(b"1",), (b"ss",), (b"",), (None,), (b"-7",), (b"1.5",)], "b binary")
    got = s.select(IntCodec().decode(F.col("b")), IntCodec().valid(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(1, True), (None, False), (None, False), (None, True), (-7, True), (None, False)]
    assert spark.range(1).select(IntCodec().encode(F.lit(100)), IntCodec().encode(F.lit(None))).first() == (b"100", None)


def test_json_codec_is_strict(spark):
    texts = ['{"a":1}', ' {"a":1} ', '{"a":1', '{"a":1}x', '{"a":1}}', '[{"a":1}]', '"a"', "null", "", None, "{'a':1}", '{"a":"1"}', "{}", '{"a":1},{"a":2}', '{"a":NaN}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(JsonCodec("a bigint").decode(F.col("t").cast("binary"))).collect()]
    assert [None if g is None else g["a"] for g in got] == [1, 1, *[None] * 13]
    assert [g is not None for g in got] == [True, True, *[False] * 9, True, True, False, False]


def test_union_and_uuid_codec(spark):
    c = UnionCodec({"A": "type string, a int", "B": "type string, b string"})
    df = spark.createDataFrame([('{"type":"A","a":3}',), ('{"type":"B","b":"x"}',), ('{"type":"C"}',), ("junk",)], "t string")
    got = df.select(c.decode(F.col("t").cast("binary")).alias("v")).select("v.kind", "v.A.a", "v.B.b").collect()
    assert [tuple(r) for r in got] == [("A", 3, None), ("B", None, "x"), (None, None, None), (None, None, None)]
    u = "0f8fad5b-d9cb-469f-a165-70867728950e"
    assert spark.range(1).select(UuidCodec().decode(F.lit(u.upper().encode())), UuidCodec().decode(F.lit(b"x"))).first() == (u, None)


def test_headers_and_identity(spark):
    df = spark.sql("SELECT array(named_struct('key', 'a', 'value', X'01'), named_struct('key', 'a', 'value', X'02')) AS h, CAST(array() AS array<struct<key:string,value:binary>>) AS e, 't' AS topic, 3 AS partition, 9L AS offset")
    assert df.select(header(F.col("h"), "a"), header(F.col("e"), "a"), header(F.lit(None).cast("array<struct<key:string,value:binary>>"), "a"), record_id(F.col("topic"), F.col("partition"), F.col("offset"))).first() == (b"\x01", None, None, "t_3_9")
    assert spark.range(1).select(http_time(F.lit(0))).first()[0] == "Thu, 01 Jan 1970 00:00:00 UTC"


def test_source_errors(spark):
    df = spark.createDataFrame([(b"1", b"x"), (b"q", b"y"), (None, None)], "key binary, value binary")
    s = KeyedStream.source(df, IntCodec(), StringCodec())
    assert pairs(s) == [(1, "x"), (None, None)]
    assert rows(s.errors.select("stage", "reason")) == [("source", "undecodable key")]
    with pytest.raises(ValueError):
        KeyedStream.source(df.drop("key"))


def test_filter_and_map(spark):
    s = stream(spark, [(1, None), (2, "b"), (None, "c")])
    assert pairs(s.filter("key = 1")) == [(1, None)]
    assert pairs(s.filter("value = 'b'")) == [(2, "b")]
    bad = s.filter("key > 0", fails="value IS NULL")
    assert pairs(bad) == [(2, "b")] and rows(bad.errors.select("offset", "reason")) == [(0, "function failed")]
    t = stream(spark, [(1, "1")]).map(F.col("key") * 10, F.concat("value", F.lit("test")))
    assert pairs(t) == [(10, "1test")] and t.key_selected
    assert pairs(s.map_values(lambda k, v: v.fillna("-"), returns="string")) == [(1, "-"), (2, "b"), (None, "c")]
    with pytest.raises(TypeError):
        s.map_values(lambda k, v: v)
    assert not s.map_values(F.lit(1)).key_selected and s.select_key("value").key_selected


def test_branch(spark):
    s = stream(spark, [(i, "v") for i in range(6)] + [(None, "v")])
    b = s.branch({"even": "key % 2 = 0", "low": "key < 4"})
    assert pairs(b["even"]) == [(0, "v"), (2, "v"), (4, "v")] and pairs(b["low"]) == [(1, "v"), (3, "v")]
    strict = s.strict_siblings({"a": "key > 1", "b": "key < 4"})
    assert pairs(strict["b"]) == [(2, "v"), (3, "v")]


def test_flat_map_peek_union(spark):
    s = stream(spark, [(1, "a,b"), (2, None)])
    assert pairs(s.flat_map("split(value, ',')")) == [(1, "a"), (1, "b")]
    assert pairs(s.peek("seen", n=F.count(F.lit(1))).union(s)) == sorted(pairs(s) * 2, key=repr)


def test_deduplicate_window_order(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 1, 'u', 0, 5L, timestamp'2024-01-01 00:10:00'), ('a', 2, 'u', 0, 4L, timestamp'2024-01-01 00:50:00'), ('b', 3, 'v', 1, 1L, timestamp'2024-01-01 01:10:00') AS t(key, value, uuid, partition, offset, timestamp)")
    s = KeyedStream.source(df)
    assert s.deduplicate().df.count() == 2 and s.deduplicate("key", "value").df.count() == 3
    w = s.windowed("1 hour", n=F.count(F.lit(1)))
    assert rows(w.df.select("key", F.hour("value.start"), "value.n")) == [("a", 0, 2), ("b", 1, 1)]
    assert rows(s.windowed("1 hour", "30 minutes", n=F.count(F.lit(1))).df.select("key", "value.n")) == [("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 1)]
    assert [r["offset"] for r in s.ordered().df.where("partition = 0").collect()] == [4, 5]


def test_deduplicate_without_uuid(spark):
    """Records without a UUID are copies by position only; a UUID is the same in any spelling."""
    u = "0f8fad5b-d9cb-469f-a165-70867728950e"
    none = [None, "", "0" * 32, "00000000-0000-0000-0000-000000000000", "{00000000-0000-0000-0000-000000000000}"]
    same = [u, u.upper(), "{" + u + "}", "urn:uuid:" + u, u.replace("-", "")]
    data = [(x, "t", 0, i) for i, x in enumerate(none)] + [(None, "t", 1, 0), ("0" * 32, "t", 1, 0), (None, "s", 1, 0)] + [(x, "t", 0, 50 + i) for i, x in enumerate(same)]
    df = spark.createDataFrame([(1, 1, *r) for r in data], "key int, value int, uuid string, topic string, partition int, offset bigint")
    got = KeyedStream.source(df).deduplicate().df
    assert got.columns == df.columns
    places = [tuple(r) for r in got.select("topic", "partition", "offset").collect()]
    assert sorted(p for p in places if p[2] < 50) == [("s", 1, 0), *(("t", 0, i) for i in range(5)), ("t", 1, 0)]
    assert len([p for p in places if p[2] >= 50]) == 1


def joined_pair(spark):
    left = spark.createDataFrame([(1, (1000, 2000), "t", 0, 0), (2, (1001, 9), "t", 0, 1), (3, None, "t", 0, 2)], "key int, value struct<primary_key:int, foreign_key:int>, topic string, partition int, offset bigint")
    right = spark.createDataFrame([(2000, (1000, 2000))], "key int, value struct<primary_key:int, foreign_key:int>")
    return KeyedStream.source(left), Table(right)


def test_join_table(spark):
    s, t = joined_pair(spark)
    value = F.struct(F.col("value.primary_key").alias("l"), F.col("right.primary_key").alias("r"))
    inner = join_table(s, t, "value.foreign_key", value)
    assert rows(inner.df.select("key", "value.l", "value.r")) == [(1, 1000, 1000)]
    assert rows(inner.errors.select("offset", "reason")) == [(1, "no row under the key"), (2, "key mapping failed")]
    left = join_table(s, t, "value.foreign_key", value, "left")
    assert rows(left.df.select("key", "value.l", "value.r")) == [(1, 1000, 1000), (2, 1001, None)]
    empty = Table(t.df.limit(0))
    assert rows(join_table(s, empty, "value.foreign_key", value, "left").df.select("key")) == [(1,), (2,)]
    assert rows(join_table(s, empty, "value.foreign_key", value).df) == []
    with pytest.raises(TypeError):
        join_table(s, s)
    with pytest.raises(ValueError):
        join_table(s, t, how="right")
    for forbidden in ("to", "map", "filter", "process"):
        with pytest.raises(TableMisuse):
            getattr(t, forbidden)("x")


def test_star_and_table_join(spark):
    s, t = joined_pair(spark)
    star = star_join(s, {"one": (t, F.col("value.foreign_key")), "two": (t, F.lit(2000))})
    assert rows(star.df.select("key", "value.one.primary_key", "value.two.primary_key")) == [(1, 1000, 1000), (2, None, 1000)]
    both = join_tables(t, t, "key", F.col("right.foreign_key"))
    assert rows(both.df.select("key", "value")) == [(2000, 2000)]


def test_extra_columns_of_any_name(spark):
    s = stream(spark, [(1, "a"), (2, "b")])
    for c in ("right", "left", "_bad", "_branch", "_on", "_stretch", "side", "order", "first", "version", "name", "stage", "reason", "count", "weird name`"):
        s = KeyedStream.source(s.df.withColumn(c, F.lit("x")))
    t = Table(s.df.select("key", "value", "right", "_on", "order"))
    assert rows(s.join_table(t).df.select("key")) == [(1,), (2,)]
    assert rows(s.branch({"a": "key = 1"})["a"].df.select("key", "_branch")) == [(1, "x")]
    assert rows(s.materialize().df.select("key", "version")) == [(1, 1), (2, 1)]
    with_order = s.df.withColumn("offset", F.col("offset") + 10)
    assert rows(s.join_stream(KeyedStream.source(with_order)).df.select("key", "value.left", "value.right")) == [(1, "a", "a"), (2, "b", "b")]


def test_graph(spark):
    s, t = joined_pair(spark)
    j = join_table(s.filter("true", 'big "one"'), t, "value.foreign_key")
    b = j.branch({"a": "true"})["a"]
    dot = to_dot(b.node, j.node)
    assert dot.startswith("digraph") and dot.count("->") == 5 and '\\"one\\"' in dot


def test_functions_that_fail(spark):
    """What raises or can't be computed drops its own record, as an error row, and no other."""
    s = stream(spark, [(1, "7"), (2, "x"), (3, None), (4, "0")])
    cast = s.map_values("CAST(value AS bigint)")
    assert pairs(cast) == [(1, 7), (3, None), (4, 0)] and rows(cast.errors.select("stage", "offset", "reason")) == [("map_values", 1, "function failed")]
    over = cast.map("key", F.lit(1) / F.col("value"))
    assert pairs(over) == [(1, 1 / 7), (3, None)] and rows(over.errors.select("stage", "offset")) == [("map", 3), ("map_values", 1)]
    some = s.filter("CAST(value AS int) > 1")
    assert pairs(some) == [(1, "7")] and rows(some.errors.select("offset")) == [(1,)]
    assert s.filter("value > 'a'").errors is None and s.map_values(F.upper("value")).errors is None

    def picky(k, v):
        return v.map(lambda x: None if x is None else int(x)).astype("Int64")

    made = s.map_values(picky, returns="bigint")
    assert pairs(made) == [(1, 7), (3, None), (4, 0)] and rows(made.errors.select("offset", "reason")) == [(1, "function failed")]
    assert pairs(s.select_key(lambda k, v: k + v.map(len), returns="bigint")) == [(2, "7"), (3, "x"), (5, "0")]
    assert pairs(s.branch({"n": "CAST(value AS int) = 7"})["n"]) == [(1, "7")]

    def effect(k, v):
        if (v == "x").any():
            raise RuntimeError("no")

    done = s.peek(effect=effect)
    assert pairs(done) == [(1, "7"), (3, None), (4, "0")] and rows(done.errors.select("stage", "offset")) == [("peek", 1)]
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_errors_of_both_sides_of_a_join(spark):
    left = stream(spark, [(1, "1"), (2, "x")]).map_values("CAST(value AS int)", "left cast")
    right = stream(spark, [(1, "y"), (1, "2")])
    right = KeyedStream.source(right.df.withColumn("offset", F.col("offset") + 10)).map_values("CAST(value AS int)", "right cast")
    joined = left.join_stream(right)
    assert rows(joined.df.select("value.left", "value.right")) == [(1, 2)]
    assert rows(joined.errors.select("stage", "offset")) == [("left cast", 1), ("right cast", 10)]
