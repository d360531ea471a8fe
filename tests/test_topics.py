"""Topic logs, sinks and running queries."""

import json
import time
import urllib.request

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.functions.serdes import IntCodec, StringCodec
from tidemark.operators import sinks, tables
from tidemark.operators.joins import paired
from tidemark.operators.stores import IndexedStore, Registry
from tidemark.operators.stream import KeyedStream
from tidemark.operators.tables import Table
from tidemark.plans.config import EngineConfig, StreamConfig
from tidemark.serving import PAGE, answer, serve
from tidemark.sources import kafka
from tidemark.sources.files import Files
from tidemark.sources.topiclog import LATEST, TopicExists, TopicLogs, UnknownTopic
from tidemark.streaming.runtime import Application
from tidemark.streaming.tables import LiveTable


@pytest.fixture
def logs(spark, tmp_path):
    return TopicLogs(spark, str(tmp_path / "topics"))


def messages(spark, *pairs):
    return spark.createDataFrame([(None if k is None else str(k).encode(), None if v is None else str(v).encode()) for k, v in pairs], "key binary, value binary")


def test_topic_admin(spark, logs):
    logs.create("a", 2, 3, {"cleanup": "compact"})
    logs.create("a", 9)
    assert logs.info("a")["partitions"] == 2 and logs.topics() == ["a"]
    with pytest.raises(TopicExists):
        logs.create("a", exist_ok=False)
    with pytest.raises(UnknownTopic):
        logs.read("b")
    for bad in ("", "_x", "a/b"):
        with pytest.raises(ValueError):
            logs.create(bad)
    with pytest.raises(ValueError):
        logs.create("c", 0)
    logs.delete("a")
    assert logs.topics() == []


def test_offsets(spark, logs):
    logs.create("one")
    assert rows(logs.read("one")) == [] and rows(logs.offsets("one")) == []
    data = spark.range(3333).select(F.col("id").cast("string").alias("key"), F.lit("v").alias("value"), "id")
    logs.append("one", data, order=F.col("id"))
    assert rows(logs.offsets("one")) == [(0, 0, 3332, 3333)]
    logs.append("one", data.limit(2), order=F.col("id"))
    assert logs.read("one").count() == 3335 and logs.read("one", LATEST).count() == 0 and logs.read("one", 3330).count() == 5 and logs.read("one", {0: 3334}).count() == 1
    assert logs.offset_valid("one", 0, 3335) and not logs.offset_valid("one", 0, 3336)
    first = logs.read("one").where("offset = 17").first()
    assert first["key"] == b"17" and first["topic"] == "one" and first["uuid"]


def test_partitioners(spark, logs):
    logs.create("many", 4)
    logs.append("many", messages(spark, *[(i % 10, i) for i in range(100)], (None, "x")))
    spread = logs.read("many").where("key IS NOT NULL").groupBy("key").agg(F.count_distinct("partition").alias("n"))
    assert {r["n"] for r in spread.collect()} == {1}
    logs.append("many", messages(spark, (1, 1)).withColumn("partition", F.lit(3)), "manual")
    logs.append("many", messages(spark, (1, 1)), "random")
    with pytest.raises(ValueError):
        logs.append("many", messages(spark, (1, 1)), "manual")


def test_sink_through_and_dead_letters(spark, logs):
    df = spark.createDataFrame([(1, "a", 0), (2, None, 1), (None, "c", 2), (4, "d", 3)], "key bigint, value string, offset bigint")
    s = KeyedStream.source(df)
    options = sinks.SinkOptions(tombstone="value = 'd'", headers=sinks.header_array(h=F.col("value")), prefix="app")
    again = sinks.through(s, logs, "out", IntCodec(), StringCodec(), options)
    assert rows(again.df.select("key", "value")) == [(1, "a"), (2, None), (4, None)]
    sinks.to(s, logs, "out2", IntCodec(), StringCodec(), errors="dead")
    bad = sinks.encoded(s, "out2", IntCodec(), StringCodec())
    assert rows(bad.errors.select("stage", "offset", "reason")) == [("sink out2", 2, "unencodable key")]
    sinks.dead_letters(bad.errors, logs, "dead")
    assert json.loads(logs.read("dead").first()["value"])["reason"] == "unencodable key"
    with pytest.raises(ValueError):
        sinks.encoded(s, "x", IntCodec(), StringCodec(), sinks.SinkOptions(rewrite={"topic": "key"}))


def test_materialize_to(spark, logs):
    df = spark.createDataFrame([("a", "x", 0), ("a", "y", 1), ("b", "z", 2), ("b", None, 3)], "key string, value string, offset bigint")
    r = Registry()
    s = sinks.materialize_to(KeyedStream.source(df), logs, "m", "latest", r, StringCodec(), StringCodec(), write=lambda n, v: F.when(v.isNotNull(), F.concat_ws("#", v, n)))
    assert rows(s.df.select("key", "version")) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    assert r.store("latest").value("a") == "y#2" and r.store("latest").value("b") is None and logs.read("m").count() == 4


def test_stateless_stream_equals_batch(spark, logs, tmp_path):
    logs.create("in", 2)
    logs.append("in", messages(spark, *[(i, i) for i in range(50)]))
    logs.append("in", messages(spark, *[(i, i) for i in range(50, 80)], ("bad", 1)))

    def pipeline(df):
        s = KeyedStream.source(df, IntCodec(), StringCodec())
        return s.branch({"even": "key % 2 = 0"})["even"].map_values(F.concat("value", F.lit("!")))

    query = sinks.to(pipeline(logs.read_stream("in")), logs, "out", IntCodec(), StringCodec(), checkpoint=str(tmp_path / "cp"))
    query.awaitTermination(120)
    got = rows(logs.read("out").select(F.col("key").cast("string"), F.col("value").cast("string")))
    want = rows(sinks.encoded(pipeline(logs.read("in")), "out", IntCodec(), StringCodec()).df.select(F.col("key").cast("string"), F.col("value").cast("string")))
    assert got == want and len(got) == 40
    logs.append("in", messages(spark, (100, "more")))
    sinks.to(pipeline(logs.read_stream("in")), logs, "out", IntCodec(), StringCodec(), checkpoint=str(tmp_path / "cp")).awaitTermination(120)
    assert logs.read("out").count() == 41


def test_running_errors_are_dead_letters(spark, logs, tmp_path):
    """Undecodable, failing, missing and unencodable records of a running query: each once, in the topic of dead letters."""
    logs.create("in")
    logs.append("in", messages(spark, (1, "5"), (2, "x"), ("k", "7"), (3, "8"), (9, "4")))
    table = Table(spark.createDataFrame([(1, "a"), (3, "b")], "key bigint, value string"))

    def run():
        s = KeyedStream.source(logs.read_stream("in"), IntCodec(), StringCodec()).map_values("CAST(value AS int)").join_table(table, value=F.col("right"))
        sinks.to(s, logs, "out", IntCodec(), StringCodec(), checkpoint=str(tmp_path / "cp"), errors="dead").awaitTermination(120)

    run()
    assert rows(logs.read("out").select(F.col("value").cast("string"))) == [("a",), ("b",)]
    want = ["function failed", "no row under the key", "undecodable key"]
    assert sorted(json.loads(r["value"])["reason"] for r in logs.read("dead").collect()) == want
    logs.append("in", messages(spark, (1, "y")))
    run()
    run()
    assert sorted(json.loads(r["value"])["reason"] for r in logs.read("dead").collect()) == sorted([*want, "function failed"])


def test_a_sink_runs_on(spark, logs, tmp_path):
    logs.create("in")
    logs.append("in", messages(spark, (1, "a")))
    s = KeyedStream.source(logs.read_stream("in"), IntCodec(), StringCodec())
    query = sinks.to(s, logs, "out", IntCodec(), StringCodec(), checkpoint=str(tmp_path / "cp"), trigger="100 milliseconds", name="on")
    try:
        for n, more in ((1, None), (2, (2, "b"))):
            if more:
                logs.append("in", messages(spark, more))
            end = time.time() + 60
            while time.time() < end and logs.read("out").count() < n:
                time.sleep(0.3)
            assert logs.read("out").count() == n
    finally:
        query.stop()


def test_scan_is_bounded_then_live(spark, logs, tmp_path):
    logs.create("in", 2)
    logs.append("in", messages(spark, *[(i, i) for i in range(20)]))
    seen, ended = [], []
    query = logs.scan("in", lambda df, _: seen.extend(r["key"] for r in df.collect()), lambda ends: ended.append((len(seen), ends)), str(tmp_path / "cp"), trigger="100 milliseconds")
    try:
        assert len(ended) == 1 and ended[0][0] == 20 and sum(ended[0][1].values()) == 20
        logs.append("in", messages(spark, ("new", 1)))
        end = time.time() + 60
        while time.time() < end and len(seen) < 21:
            time.sleep(0.3)
        assert seen[-1] == b"new" and len(seen) == 21 and len(ended) == 1
    finally:
        query.stop()


def test_offsets_go_on_without_reading(spark, logs):
    """The ends are kept with each batch; those that a lost writer left without are made up for; a partitioner of the user's."""
    logs.create("t", 3)
    for _ in range(2):
        logs.append("t", messages(spark, *[(i, i) for i in range(9)]), F.length("value") + F.ascii("value"))
    logs.files.delete("t/batch=1/_ends.json")
    logs.append("t", messages(spark, *[(i, i) for i in range(9)]), F.length("value") + F.ascii("value"))
    assert rows(logs.read("t").groupBy("partition").agg(F.min("offset"), F.max("offset"), F.count_distinct("offset"))) == [(p, 0, 8, 9) for p in range(3)]
    assert rows(logs.offsets("t")) == [(p, 0, 8, 9) for p in range(3)]


def test_running_join_equals_batch(spark, tmp_path):
    import random

    rng = random.Random(2)
    data = [(rng.choice("abc"), rng.choice("LR"), i, float(i)) for i in range(60)]
    schema = "key string, side string, offset bigint, value double"
    for n in range(3):
        spark.createDataFrame(data[n * 20 : n * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/b={n}"))
    df = spark.readStream.schema(schema + ", b int").option("basePath", str(tmp_path / "in")).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    s = KeyedStream.source(df)
    j = s.filter("side = 'L'").join_stream(s.filter("side = 'R'"))
    out = []
    j.df.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda d, n: out.extend(map(tuple, d.select("key", "offset", "value.left", "value.right").collect()))).trigger(availableNow=True).start().awaitTermination(180)
    batch = spark.createDataFrame(data, schema)
    want = paired(batch.where("side = 'L'"), batch.where("side = 'R'"), "key", "offset", F.col("value"), F.col("value"))
    assert sorted(out, key=repr) == rows(want)


@pytest.mark.parametrize("version", [None, "try_cast(value AS bigint)"])
def test_live_table_equals_batch(spark, tmp_path, version):
    data = [("a", "1"), ("b", "4"), ("a", "5"), ("b", None), ("a", "2"), ("c", "3"), ("b", "1"), (None, "7"), ("c", None)]
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(data)], "key string, value string, offset bigint")
    live = LiveTable(spark, str(tmp_path / "t"), df.schema, F.expr(version) if version else None, buckets=3)
    for n in range(3):
        part = df.where(f"offset div 3 = {n}")
        live.upsert(part, n)
        live.upsert(part, n)  # a repeated micro-batch
    want = tables.versioned(df, F.expr(version)).select("key", "offset") if version else tables.latest(df).select("key", "offset")
    assert rows(live.rows().select("key", "offset")) == rows(want)


def test_live_table_grows_and_forgets(spark, tmp_path):
    """Buckets double when they have grown too large; files that only older versions have are deleted."""
    schema = spark.createDataFrame([], "key bigint, value string, offset bigint").schema
    live = LiveTable(spark, str(tmp_path / "t"), schema, buckets=1, bucket_bytes=1)
    for n in range(4):
        live.upsert(spark.range(n * 10, n * 10 + 30).select(F.col("id").alias("key"), F.lit(f"v{n}").alias("value"), (F.col("id") + 1000 * n).alias("offset")), n)
    assert live.store.manifest().details["buckets"] == "8" and live.rows().count() == 60
    assert rows(live.rows().where("key IN (5, 15, 40)").select("key", "value")) == [(15, "v1"), (40, "v3"), (5, "v0")]
    there = {str(f).partition("/t/")[2] for f in (tmp_path / "t" / "data").rglob("*.parquet")}
    used = {f.partition("/t/")[2] for v in (live.store.latest(), live.store.latest() - 1) for f in live.store.manifest(v).files}
    assert there == used


def test_a_table_writer_of_the_user(spark, tmp_path):
    def write(table, changes, number):
        table.apply(changes.where("value <> 'secret'").withColumn("value", F.upper("value")), number)

    df = spark.createDataFrame([(1, "a", 0), (2, "secret", 1)], "key bigint, value string, offset bigint")
    live = LiveTable(spark, str(tmp_path / "t"), df.schema, write=write)
    live.upsert(df, 0)
    assert rows(live.rows().select("key", "value")) == [(1, "A")]


def test_an_application_starts_a_stream_again(spark, logs, tmp_path):
    """A sink with dead letters by its settings; a stream that fails twice goes on from its checkpoint."""
    logs.create("in")
    logs.append("in", messages(spark, (1, "5"), (2, "x")))
    app = Application(spark, EngineConfig("again", str(tmp_path / "cp"), http_port=0, shuffle_partitions=4))
    settings = StreamConfig(retries=2, dead_letters=True, retry_interval_ms=1, most_per_trigger=1)
    s = KeyedStream.source(app.source(logs, "in", settings), IntCodec(), StringCodec()).map_values("CAST(value AS int)")
    app.add_sink("out", s, logs, "out", IntCodec(), IntCodec(), settings=settings)
    tries = []

    def write(df, n):
        tries.append(n)
        if len(tries) < 3:
            raise RuntimeError("lost")

    app.add_stream("shaky", s, write, settings)
    app.start(once=True)
    app.await_end()
    with urllib.request.urlopen(f"http://127.0.0.1:{app.server.server_port}/stores") as f:
        assert json.load(f) == []
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")
    app.stop()
    assert not spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")
    assert tries == [0, 0, 0] and logs.read("out").count() == 1 and logs.read("out_dead").count() == 1
    failing = Application(spark, EngineConfig("failing", str(tmp_path / "cp"), shuffle_partitions=4))
    failing.add_stream("never", s, lambda df, n: 1 / 0, StreamConfig(retries=1, retry_interval_ms=1))
    failing.start(once=True)
    with pytest.raises(StreamingQueryException):
        failing.await_end()
    failing.stop()


def test_pages_go_on_within_an_index_value(spark):
    df = spark.range(30).select(F.col("id").alias("key"), F.concat(F.lit("v"), F.col("id") % 2).alias("value"))
    r = Registry()
    r.register(IndexedStore("s", df, {"v": "value"}))
    got, after = {}, ""
    for _ in range(4):
        page = answer(r, f"/stores/s/indexes/v?limit=9{after}")[1]
        for name, keys in page.items():
            got.setdefault(name, []).extend(keys)
        last = list(page)[-1]
        after = f"&after={last}&after_key={page[last][-1]}"
    assert got == {"v0": list(range(0, 30, 2)), "v1": list(range(1, 30, 2))}


def test_intermediate_tables_can_be_deleted(spark):
    from tidemark.session import clear_scratch, scratch_path, written

    kept = scratch_path(spark, "x")
    written(spark.range(3), "numbers")
    import os

    folder = kept.rpartition("/")[0].removeprefix("file:")
    assert any(n.startswith("numbers-") for n in os.listdir(folder))
    clear_scratch(spark)
    assert not os.path.exists(folder) and rows(written(spark.range(1), "again")) == [(0,)]


def test_application(spark, logs, tmp_path):
    logs.create("t")
    logs.create("s")
    logs.append("t", messages(spark, (1, "one"), (2, "two")))
    logs.append("s", messages(spark, (1, "x"), (3, "y")))
    app = Application(spark, EngineConfig("app", str(tmp_path / "cp")))
    text = lambda df: df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "offset")
    live = app.add_table("t", LiveTable(spark, str(tmp_path / "live"), text(logs.read("t")).schema, buckets=2), text(logs.read_stream("t")))
    got = []

    def write(df, n):
        joined = KeyedStream.source(df).join_table(live.table(), value=F.col("right"))
        got.extend(map(tuple, joined.df.select("key", "value").collect()))

    app.add_stream("s", KeyedStream.source(text(logs.read_stream("s"))).peek("seen", n=F.count(F.lit(1))), write)
    with pytest.raises(ValueError):
        app.add_stream("s", KeyedStream.source(text(logs.read("s"))), write)
    app.start(once=True)
    app.await_end()
    app.stop()
    assert got == [("1", "one")] and "digraph" in app.graph()


def test_config():
    c = EngineConfig.from_mapping({"engine.application_id": "a", "checkpoint_dir": "/x", "shuffle_partitions": 7})
    assert c.shuffle_partitions == 7 and "application_id" in str(c) and c.spark_settings()["spark.sql.shuffle.partitions"] == "7"
    assert StreamConfig.from_mapping({"stream.dead_letters": True, "most_per_trigger": None}).dead_letters
    with pytest.raises(ValueError):
        StreamConfig.from_mapping({"nope": 1})
    with pytest.raises(TypeError):
        StreamConfig.from_mapping({"retries": "3"})
    for bad in ({"application_id": "", "checkpoint_dir": "/x"}, {"application_id": "a", "checkpoint_dir": "/x", "state_store": "none"}):
        with pytest.raises(ValueError):
            EngineConfig.from_mapping(bad)


def test_kafka_options():
    r = kafka.reader_options("h:1", ["a", "b"], {"a": {0: 5}}, 100, "g")
    assert r["subscribe"] == "a,b" and json.loads(r["startingOffsets"]) == {"a": {"0": 5}} and r["maxOffsetsPerTrigger"] == "100"
    assert kafka.reader_options("h:1", ["a"], LATEST)["startingOffsets"] == "latest"
    w = kafka.writer_options("h:1", "t", "leader", linger_ms="5")
    assert w["kafka.acks"] == "1" and w["kafka.compression.type"] == "snappy" and w["kafka.linger.ms"] == "5" and w["topic"] == "t"
    with pytest.raises(ValueError):
        kafka.reader_options("h:1", [])


def test_http(spark):
    df = spark.createDataFrame([("200", "111,222"), ("300", "111,333")], "key string, value string")
    r = Registry()
    r.register(IndexedStore("s", df, {"head": "split(value, ',')[0]"}))
    assert answer(r, "/stores") == (200, ["s"]) and answer(r, "/indexes") == (200, ["head"]) and answer(r, "/stores/s/indexes") == (200, ["head"])
    assert answer(r, "/stores/s?limit=1") == (200, [{"key": "200", "value": "111,222"}])
    assert answer(r, "/stores/s?after=200") == (200, [{"key": "300", "value": "111,333"}])
    assert answer(r, "/stores/s/indexes/head") == (200, {"111": ["200", "300"]})
    assert answer(r, "/stores/s/indexes/head/111")[1][0]["key"] == "200"
    assert answer(r, "/stores/s/999") == (200, {"key": "999", "value": None})
    assert answer(r, "/stores/nope")[0] == answer(r, "/stores/s/indexes/nope")[0] == answer(r, "/x")[0] == 404
    server = serve(r)
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/stores/s/200") as f:
        assert json.load(f) == {"key": "200", "value": "111,222"}
    server.shutdown()


def test_http_pages_of_indexes(spark):
    n = PAGE + 205
    df = spark.range(n).select(F.col("id").alias("key"), F.concat(F.lit("v"), "id").alias("value"))
    r = Registry()
    r.register(IndexedStore("s", df, {"own": "key * 10", "text": "IF(key = 0, '', value)", "hot": "IF(key % 100 = 7, 'cold', 'hot')"}))

    def pages(path, last):
        out, after = [], ""
        while len(out) < 4 and (page := answer(r, path + after)[1]):
            out.append(page)
            after = f"?after={last(page)}"
        return out

    for index, name in (("own", lambda i: str(i * 10)), ("text", lambda i: f"v{i}" if i else "")):
        got = pages(f"/stores/s/indexes/{index}", lambda page: list(page)[-1])
        assert [len(p) for p in got] == [PAGE, 205]
        assert got[0] | got[1] == {name(i): [i] for i in range(n)}
    assert answer(r, "/stores/s/indexes/text?after=&limit=1") == (200, {"v1": [1]})
    got = pages("/stores/s/indexes/hot/hot", lambda page: page[-1]["key"])
    assert len(got) == 2 and [x["key"] for p in got for x in p] == [i for i in range(n) if i % 100 != 7]
    assert len(answer(r, "/stores/s/indexes/hot/cold?after=7")[1]) == 11


@pytest.mark.parametrize("lost_at", ["mark", "data", "name"])
def test_a_micro_batch_is_appended_once(spark, logs, tmp_path, monkeypatch, lost_at):
    """A driver lost after the append and before its mark, or within the append, repeats nothing and loses nothing."""
    logs.create("in")
    logs.append("in", messages(spark, *[(i, i) for i in range(20)]))

    def run():
        s = KeyedStream.source(logs.read_stream("in"), IntCodec(), StringCodec())
        sinks.to(s, logs, "out", IntCodec(), StringCodec(), checkpoint=str(tmp_path / "cp")).awaitTermination(120)

    create, rename = Files.create, Files.rename

    def lose(self, name, *args):
        last = name.rpartition("/")[2]
        if last.startswith("_once-") if lost_at == "name" else lost_at == "mark" and self.root.endswith("/written") and last.isdigit():
            raise OSError("lost")
        create(self, name, *args)

    def unmoved(self, *args):
        raise OSError("lost")

    monkeypatch.setattr(Files, "create", lose)
    if lost_at == "data":
        monkeypatch.setattr(Files, "rename", unmoved)
    for _ in range(2):
        with pytest.raises(StreamingQueryException):
            run()
    assert logs.read("out").count() == (20 if lost_at == "mark" else 0)
    monkeypatch.setattr(Files, "create", create)
    monkeypatch.setattr(Files, "rename", rename)
    run()
    assert rows(logs.read("out").select(F.col("key").cast("string"))) == sorted((str(i),) for i in range(20))
    logs.append("in", messages(spark, (100, "more")))
    run()
    run()
    assert logs.read("out").count() == 21 and logs.read("out").select("offset").distinct().count() == 21
