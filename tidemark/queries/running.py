"""The stream operators as running queries: read as a stream until all is processed, same results as the static ones."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.serdes import IntCodec, StringCodec
from tidemark.operators import sinks
from tidemark.operators.stream import KeyedStream
from tidemark.queries import corpus_core, streams
from tidemark.session import scratch_path, table, written
from tidemark.sources.topiclog import TopicLogs
from tidemark.streaming.periods import PeriodCloser, open_and_closed
from tidemark.streaming.tables import LiveTable


def _live(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a stream of records."""
    path = f"{folder}/events.parquet"
    reader = spark.readStream.schema(table(spark, folder, "events").schema)
    df = reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", "events.parquet").parquet(folder)
    return streams.as_records(df)


def _events(spark: SparkSession, folder: str) -> KeyedStream:
    return KeyedStream.source(_live(spark, folder), name="events")


def _result(df: DataFrame) -> DataFrame:
    """What a running query has written when it is up to date."""
    spark = df.sparkSession
    base = scratch_path(spark, "running")
    writer = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def stream_filter(spark, folder):
    return _result(_events(spark, folder).filter("event_type = 'click' AND value > 10").df.select("key", "offset", "value"))


def stream_select_key(spark, folder):
    return _result(_events(spark, folder).select_key(F.from_json("props", "k bigint")["k"]).df.select("key", "offset", "value"))


def stream_branch(spark, folder):
    b = _events(spark, folder).branch({"large": "value > 60", "click": "event_type = 'click'", "small": "value < 20"})
    return _result(b["large"].df.select(F.lit("large").alias("branch"), "key", "offset").unionByName(b["click"].df.select(F.lit("click").alias("branch"), "key", "offset")).unionByName(b["small"].df.select(F.lit("small").alias("branch"), "key", "offset")))


def stream_join_table_inner(spark, folder):
    wide = _events(spark, folder).select_key(F.col("key") * 20)
    return _result(wide.join_table(streams.customers(spark, folder), value=F.col("right.c_name")).df.select("key", "offset", F.col("value").alias("c_name")))


def stream_join_table_left(spark, folder):
    wide = _events(spark, folder).select_key(F.col("key") * 20)
    return _result(wide.join_table(streams.customers(spark, folder), value=F.col("right.c_name"), how="left").df.select("key", "offset", F.col("value").alias("c_name")))


def stream_join_stream(spark, folder):
    """The stateful join: the state of a key is its table side and that side's last value."""
    e = _events(spark, folder)
    j = e.filter("event_type = 'click'").join_stream(e.filter("event_type = 'view'"))
    return _result(j.df.select("key", "offset", F.col("value.left").alias("left_v"), F.col("value.right").alias("right_v")))


def _table(spark, folder, version=None) -> DataFrame:
    changes = _live(spark, folder).withColumn("value", F.when(F.col("event_type") != "error", F.col("value"))).select("key", "value", "offset")
    base = scratch_path(spark, "table")
    live = LiveTable(spark, f"{base}/table", changes.schema, version, buckets=8)
    live.follow(changes, f"{base}/checkpoint").awaitTermination()
    return live.rows()


def stream_table_latest(spark, folder):
    """A table that a running query keeps up to date."""
    return _table(spark, folder).select("key", "offset", "value")


def stream_table_versioned(spark, folder):
    return _table(spark, folder, F.floor("value")).select("key", "offset", F.floor("value").alias("version"))


def stream_deduplicate(spark, folder):
    """Copies are remembered for an hour of event time."""
    e = _events(spark, folder)
    return _result(e.union(e).deduplicate("offset", within="1 hour").df.select("key", "offset", "value"))


def stream_through(spark, folder):
    """Into a topic, with tombstones, and read again from there."""
    base = scratch_path(spark, "topics")
    logs = TopicLogs(spark, base)
    plain = _events(spark, folder).map_values(F.concat_ws(":", "event_type", F.round(F.col("value"), 1).cast("decimal(18,1)").cast("string")))
    again = sinks.through(plain, logs, "out", IntCodec(), StringCodec(), sinks.SinkOptions(tombstone="event_type = 'error'", prefix="app"), f"{base}/checkpoint")
    return again.df.groupBy("topic", F.col("key").cast("string").alias("key"), "value").agg(F.count(F.lit(1)).alias("n"))


def stream_periods(spark, folder):
    """Hours closed by a running query over first deliveries that are appended in two parts of whole delivery batches."""
    base = scratch_path(spark, "periods")
    rows = written(corpus_core.first_transactions(spark, folder), "first").where("account_no IS NOT NULL")
    most = rows.agg(F.max("batch").alias("m")).first()["m"] or 0
    for part in range(2):
        rows.where(F.expr(f"coalesce(batch, 0) * 2 div {most + 1}") == part).write.mode("append").parquet(f"{base}/in/part={part}")
    closer = PeriodCloser(spark, f"{base}/periods", T.StructField("account_no", T.LongType()), corpus_core.CLOSING, F.col("amount"))
    live = spark.readStream.schema(T.StructType([*rows.schema, T.StructField("part", T.IntegerType())])).option("maxFilesPerTrigger", 1_000_000).parquet(f"{base}/in")
    # a part is a micro-batch, as if it had just arrived
    for part in range(2):
        query = live.where(F.col("part") == part).writeStream.option("checkpointLocation", f"{base}/checkpoint-{part}")
        query.foreachBatch(lambda df, _, n=part: closer(df, n)).trigger(availableNow=True).start().awaitTermination()
    return open_and_closed(closer).select("account_no", "period_start", "n_on_time", "n_late", F.col("amount").cast("double").alias("amount"), "closed_in")


def _dead(spark, logs: TopicLogs) -> DataFrame:
    letters = logs.read("dead").select(F.from_json(F.col("value").cast("string"), "stage string, offset bigint, reason string").alias("e"))
    return letters.select("e.*")


def stream_dead_letters(spark, folder):
    """A running sink with functions and joins that fail: its records, and the dead letters that it writes beside them."""
    base = scratch_path(spark, "topics")
    logs = TopicLogs(spark, base)
    failing = _events(spark, folder).map_values(F.when(F.col("key") % 10 == 3, "x").otherwise(F.col("key").cast("string")), "text").map_values("CAST(value AS bigint)", "cast")
    named = failing.select_key(F.col("value") * 20, "wide").join_table(streams.customers(spark, folder), value=F.col("right.c_name"), name="customer")
    sinks.to(named, logs, "out", IntCodec(), StringCodec(), checkpoint=f"{base}/checkpoint", errors="dead").awaitTermination()
    sent = logs.read("out").groupBy(F.lit("sent").alias("stage"), F.lit(None).cast("string").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return sent.unionByName(_dead(spark, logs).groupBy("stage", "reason").agg(F.count(F.lit(1)).alias("n")))


def stream_join_errors(spark, folder):
    """What fails on either side of a running stream join, as dead letters."""
    base = scratch_path(spark, "topics")
    logs = TopicLogs(spark, base)
    e = _events(spark, folder)
    bad = F.when(F.col("key") % 10 == 3, "x").otherwise(F.col("value").cast("int").cast("string"))
    left, right = (e.filter(f"event_type = '{kind}'").map_values(bad, "text").map_values("CAST(value AS int)", f"cast {kind}") for kind in ("click", "view"))
    joined = left.join_stream(right, F.concat_ws(":", "left", "right"))
    sinks.to(joined, logs, "out", IntCodec(), StringCodec(), checkpoint=f"{base}/checkpoint", errors="dead").awaitTermination()
    return _dead(spark, logs).select("stage", "offset", "reason")


NAMED = (stream_dead_letters, stream_join_errors, stream_periods, stream_filter, stream_select_key, stream_branch, stream_join_table_inner, stream_join_table_left, stream_join_stream, stream_table_latest, stream_table_versioned, stream_deduplicate, stream_through)
QUERIES = {f.__name__: f for f in NAMED}
_SAME = {"stream_branch": "branch_first_match"}
_OWN = ("stream_through", "stream_periods", "stream_deduplicate", "stream_dead_letters", "stream_join_errors")
SQL = {n: streams.SQL[_SAME.get(n, n.removeprefix("stream_"))] for n in QUERIES if n not in _OWN}
SQL["stream_deduplicate"] = "SELECT user_id AS key, event_id AS \"offset\", value FROM events"
SQL["stream_dead_letters"] = """SELECT stage, CASE stage WHEN 'cast' THEN 'function failed' WHEN 'customer' THEN 'no row under the key' END AS reason, count(*) AS n FROM (
    SELECT CASE WHEN user_id % 10 = 3 THEN 'cast' WHEN c_custkey IS NULL THEN 'customer' ELSE 'sent' END AS stage FROM events LEFT JOIN customer ON c_custkey = user_id * 20) GROUP BY ALL"""
SQL["stream_join_errors"] = "SELECT 'cast ' || event_type AS stage, event_id AS \"offset\", 'function failed' AS reason FROM events WHERE event_type IN ('click', 'view') AND user_id % 10 = 3"
SQL["stream_periods"] = f"""WITH {corpus_core._FIRST}, {corpus_core._LOWS} SELECT account_no, period_start, count(*) FILTER (NOT late) AS n_on_time, count(*) FILTER (late) AS n_late, CAST(sum(coalesce(credit, debit)) AS DOUBLE) AS amount, any_value(closed_in) AS closed_in
    FROM ({corpus_core._MARKED}) WHERE NOT behind GROUP BY account_no, period_start"""
SQL["stream_through"] = f"SELECT topic, key, value, count(*) AS n FROM ({streams.SQL['sink_tombstone']}) GROUP BY ALL"
