"""The stream operators on the general tables: ``events`` as a keyed topic, the others as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.records import canonical_uuid, header, record_id, utc_instant
from tidemark.functions.serdes import IntCodec, JsonCodec, StringCodec, UnionCodec, http_time
from tidemark.operators import sinks, tables
from tidemark.operators.joins import join_tables, star_join
from tidemark.operators.stores import IndexedStore, Registry, Store
from tidemark.operators.stream import KeyedStream, decoded
from tidemark.operators.tables import Table
from tidemark.plans.topology import Node
from tidemark.session import scratch_path, table, written
from tidemark.sources.topiclog import MANUAL, TopicLogs

PARTITIONS = 8


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Events as records: key = user, offset = event id, value = the number measured."""
    return as_records(table(spark, folder, "events"))


def as_records(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("key"),
        "value",
        F.lit("events").alias("topic"),
        F.pmod("user_id", F.lit(PARTITIONS)).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        (utc_instant(F.col("ts")) if events.schema["ts"].dataType.typeName() == "timestamp_ntz" else F.col("ts")).alias("timestamp"),
        "event_type",
        "props",
    )


def events(spark: SparkSession, folder: str) -> KeyedStream:
    return KeyedStream.source(records(spark, folder), name="events")


def customers(spark: SparkSession, folder: str) -> Table:
    c = table(spark, folder, "customer")
    return Table(c.select(F.col("c_custkey").alias("key"), F.struct("c_name", "c_nationkey", "c_mktsegment").alias("value")), "customer", Node("table", "customer"))


def nations(spark: SparkSession, folder: str) -> Table:
    n = table(spark, folder, "nation")
    return Table(n.select(F.col("n_nationkey").alias("key"), F.struct("n_name", "n_regionkey").alias("value")), "nation", Node("table", "nation"))


def _tombstoned(spark: SparkSession, folder: str) -> DataFrame:
    """Events in which errors are tombstones."""
    return records(spark, folder).withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))


# --- sources and codecs


def source_scan(spark, folder):
    return records(spark, folder).select("key", "value", "topic", "partition", "offset", F.unix_micros("timestamp").alias("ts_us"))


def json_decode(spark, folder):
    s = KeyedStream.source(records(spark, folder).withColumn("value", F.col("props").cast("binary")), value=JsonCodec("k bigint"))
    return s.df.select("offset", F.col("value.k").alias("k"))


def decode_errors(spark, folder):
    """Keys that aren't whole numbers are errors of the source."""
    text = F.when(F.col("offset") % 7 == 0, F.concat(F.lit("x"), F.col("key"))).otherwise(F.col("key").cast("string"))
    s = KeyedStream.source(records(spark, folder).withColumn("key", text.cast("binary")), key=IntCodec())
    return s.errors.groupBy("stage", "topic", "partition", "reason").agg(F.count(F.lit(1)).alias("n"))


def record_headers(spark, folder):
    t = table(spark, folder, "transaction_records")
    return t.select("delivery_id", header(F.col("headers"), "origin").cast("string").alias("origin"), header(F.col("headers"), "trace").cast("string").alias("trace"), record_id(F.col("topic"), F.col("partition"), F.col("offset")).alias("record_id"))


CREDIT = "id string, type string, body struct<account_no: bigint, transaction_id: bigint, amount: decimal(18,2), reason: string>, timestamp double"
UNION = UnionCodec({"account_credited": CREDIT, "account_debited": CREDIT})


def tagged_union(spark, folder):
    """Transactions by their type; unknown types and broken payloads are errors."""
    logs = table(spark, folder, "transaction_records").where("value IS NOT NULL").select("key", "value", "topic", "partition", "offset")
    return decoded(logs, value=UNION, reason="bad").groupBy(F.coalesce("bad", "value.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def multi_topic(spark, folder):
    """Several topics as one stream, counted by topic and partition."""
    logs = [table(spark, folder, n).select("key", "value", "topic", "partition", "offset") for n in ("transaction_records", "account_detail_records", "customer_profile_records")]
    first, *others = (KeyedStream.source(x) for x in logs)
    return first.union(*others).df.groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"))


def _topic(spark, df: DataFrame, partitions: int = PARTITIONS) -> tuple[TopicLogs, str]:
    """Records appended to a topic of their own in two batches, each record in its partition and in the order of its offset."""
    logs = TopicLogs(spark, scratch_path(spark, "topics"))
    logs.create("events", partitions)
    rows = written(df, "records")
    half = (rows.agg(F.max("offset").alias("m")).first()["m"] or 0) // 2
    for part in (F.col("offset") <= half, F.col("offset") > half):
        logs.append("events", rows.where(part), MANUAL, F.col("offset"), uuid=F.col("uuid") if "uuid" in rows.columns else None)
    return logs, "events"


def _encoded_events(spark, folder) -> DataFrame:
    r = records(spark, folder)
    return r.select(F.col("key").cast("string").cast("binary").alias("key"), F.col("value").cast("string").cast("binary").alias("value"), "partition", "offset", "timestamp")


def topic_offsets(spark, folder):
    """The offsets of a topic that was written in two appends: each partition's go from 0 on."""
    logs, topic = _topic(spark, _encoded_events(spark, folder))
    return logs.offsets(topic)


def topic_uuids(spark, folder):
    """Records whose uuid is computed when they are appended."""
    named = _encoded_events(spark, folder).withColumn("uuid", F.concat_ws("_", F.lit("e"), "offset"))
    logs, topic = _topic(spark, named)
    return logs.read(topic).select("uuid", F.col("key").cast("string").cast("bigint").alias("key"))


def table_offset_latest(spark, folder):
    """What a table holds that reads its topic from an offset on, in each of the partitions."""
    logs, topic = _topic(spark, _encoded_events(spark, folder))
    start = {r["partition"]: r["latest"] * 9 // 10 for r in logs.offsets(topic).collect()}  # a row per partition
    later = logs.read(topic, start)
    return tables.latest(later.select(F.col("key").cast("string").cast("bigint").alias("key"), F.col("value").cast("string").cast("double").alias("value"), "partition", "offset")).select("key", "partition", "offset", "value")


# --- projections, filters, branches


def filter_(spark, folder):
    return events(spark, folder).filter("event_type = 'click' AND value > 10").df.select("key", "offset", "value")


def filter_event_age(spark, folder):
    """Records at most seven days older than the newest one."""
    r = records(spark, folder)
    newest = r.agg(F.max(F.unix_micros("timestamp")).alias("m")).scalar()
    return KeyedStream.source(r).filter(newest - F.unix_micros("timestamp") <= 7 * 86_400_000_000).df.select("key", "offset")


def transform_value(spark, folder):
    return events(spark, folder).map_values(F.struct((F.col("value") * 2).alias("doubled"), F.upper("event_type").alias("kind"))).df.select("key", "offset", "value.doubled", "value.kind")


def transform(spark, folder):
    return events(spark, folder).map("event_type", F.concat_ws("-", "event_type", "key")).df.select("key", "value", "offset")


def transform_python(spark, folder):
    """A Python function of Series, where Columns don't do."""
    return events(spark, folder).map_values(lambda k, v: v * 3 + k, returns="double").df.select("key", "value", "offset")


def select_key(spark, folder):
    return events(spark, folder).select_key(F.from_json("props", "k bigint")["k"]).df.select("key", "offset", "value")


def process_peek(spark, folder):
    """The metrics that are observed while records pass."""
    seen = Observation("seen")
    events(spark, folder).peek(seen, n=F.count(F.lit(1)), top=F.max("value")).df.write.format("noop").mode("overwrite").save()
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in seen.get.items()))


def process_effect(spark, folder):
    """Records pass a function that is called for its effect; those for which it raises are errors."""

    def effect(key, value):
        if (value > 90).any():
            raise ValueError("too large")

    s = events(spark, folder).peek("effect", effect=effect)
    good = s.df.select(F.lit("passed").alias("what"), "offset")
    return good.unionByName(s.errors.select(F.col("reason").alias("what"), "offset"))


def function_errors(spark, folder):
    """A cast that can't be done, a division by zero and a Python function that raises: error rows, and the others go on."""
    text = events(spark, folder).map_values(F.when(F.col("key") % 10 == 3, F.concat(F.lit("x"), "event_type")).otherwise((F.col("key") % 5).cast("string")), "text")
    number = text.map_values("CAST(value AS bigint)", "cast").map_values(F.lit(12) / F.col("value"), "divide")

    def picky(key, value):
        if (value == 4).any():
            raise ValueError("four")
        return value * 2

    done = number.map_values(picky, "python", returns="double")
    good = done.df.select(F.lit("done").alias("stage"), "offset", "value")
    return good.unionByName(done.errors.select("stage", "offset", F.lit(None).cast("double").alias("value")))


def branch_first_match(spark, folder):
    """Overlapping predicates: the first takes the record; what none takes is dropped."""
    b = events(spark, folder).branch({"large": "value > 60", "click": "event_type = 'click'", "small": "value < 20"})
    out = None
    for label, s in b.items():
        d = s.df.select(F.lit(label).alias("branch"), "key", "offset")
        out = d if out is None else out.unionByName(d)
    return out


def branch_strict_siblings(spark, folder):
    s = events(spark, folder).strict_siblings({"first": "value > 20", "second": "event_type <> 'error'", "third": "key % 2 = 0"})
    out = None
    for label, x in s.items():
        d = x.df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("sibling"), "event_type", "n")
        out = d if out is None else out.unionByName(d)
    return out


def flat_map(spark, folder):
    return events(spark, folder).flat_map(F.split("event_type", "i")).df.select("offset", F.col("value").alias("part"))


def scalar_functions(spark, folder):
    r = records(spark, folder)
    return r.select(
        "offset",
        http_time(F.unix_seconds("timestamp")).alias("sent"),
        F.format_string("user %d did %s", "key", "event_type").alias("text"),
        F.split(F.concat_ws(",", "event_type", "key"), ",")[0].alias("head"),
        F.sha1(F.col("event_type").cast("binary")).alias("digest"),
        F.get_json_object("props", "$.k").try_cast("bigint").alias("k"),
    )


def union_sinks(spark, folder):
    """Two pipelines into one topic."""
    e = events(spark, folder)
    a = e.filter("event_type = 'purchase'").map_values(F.concat(F.lit("bought "), F.round(F.col("value"), 2).cast("decimal(18,2)").cast("string")))
    b = e.filter("event_type = 'error'").map_values(F.lit("failed"))
    return a.union(b).df.select("key", "offset", "value")


# --- joins with tables


def _wide(spark, folder) -> KeyedStream:
    """Events whose key meets the customers in part only."""
    return events(spark, folder).select_key(F.col("key") * 20)


def join_table_inner(spark, folder):
    return _wide(spark, folder).join_table(customers(spark, folder), value=F.col("right.c_name")).df.select("key", "offset", F.col("value").alias("c_name"))


def join_table_left(spark, folder):
    return _wide(spark, folder).join_table(customers(spark, folder), value=F.col("right.c_name"), how="left").df.select("key", "offset", F.col("value").alias("c_name"))


def join_table_miss(spark, folder):
    return _wide(spark, folder).join_table(customers(spark, folder)).errors.select("stage", "topic", "partition", "offset", "reason")


def join_table_chain(spark, folder):
    """The whole pipeline: branch, age, two joins, text."""
    r = records(spark, folder)
    newest = r.agg(F.max(F.unix_micros("timestamp")).alias("m")).scalar()
    bought = KeyedStream.source(r, name="events").branch({"purchase": "event_type = 'purchase'"})["purchase"]
    recent = bought.filter(newest - F.unix_micros("timestamp") <= 14 * 86_400_000_000, "age")
    named = recent.join_table(customers(spark, folder), value=F.struct(F.col("value").alias("amount"), F.col("right.c_name"), F.col("right.c_nationkey")))
    placed = named.join_table(nations(spark, folder), on="value.c_nationkey", value=F.struct("value.amount", "value.c_name", "right.n_name"))
    return placed.df.select("key", "offset", F.format_string("%s of %s", "value.c_name", "value.n_name").alias("text"), F.col("value.amount").alias("amount"))


def join_table_star(spark, folder):
    """One record with two tables at once; misses stay NULL."""
    s = star_join(_wide(spark, folder), {"customer": (customers(spark, folder), F.col("key")), "nation": (nations(spark, folder), F.col("offset") % 30)})
    return s.df.select("offset", "value.value", "value.customer.c_name", "value.nation.n_name")


def join_table_star_inner(spark, folder):
    """Two tables, both needed: the records and what missed either."""
    s = star_join(_wide(spark, folder), {"customer": (customers(spark, folder), F.col("key")), "nation": (nations(spark, folder), F.col("offset") % 30)}, "inner")
    return s.df.select("offset", F.lit("joined").alias("stage")).unionByName(s.errors.select("offset", "stage"))


def join_table_table(spark, folder):
    t = join_tables(customers(spark, folder), nations(spark, folder), "value.c_nationkey", F.struct("value.c_name", "right.n_name"))
    return t.df.select("key", "value.c_name", "value.n_name")


def join_table_keyed(spark, folder):
    """A stream with a table that another stream keeps up to date (partitioned, not replicated)."""
    last = Table(tables.latest(_tombstoned(spark, folder).select("key", "value", "offset")), "last")
    return events(spark, folder).filter("event_type = 'view'").join_table(last, value=F.struct(F.col("value").alias("seen"), F.col("right").alias("last"))).df.select("key", "offset", "value.seen", "value.last")


# --- joins of streams


def join_stream(spark, folder):
    e = events(spark, folder)
    j = e.filter("event_type = 'click'").join_stream(e.filter("event_type = 'view'"))
    return j.df.select("key", "offset", F.col("value.left").alias("left_v"), F.col("value.right").alias("right_v"))


def join_stream_chain(spark, folder):
    e = events(spark, folder)
    ab = e.filter("event_type = 'click'").join_stream(e.filter("event_type = 'view'"))
    abc = ab.join_stream(e.filter("event_type = 'purchase'"))
    return abc.df.select("key", "offset", F.col("value.left.left").alias("a"), F.col("value.left.right").alias("b"), F.col("value.right").alias("c"))


def join_stream_rekeyed(spark, folder):
    e = events(spark, folder).select_key(F.from_json("props", "k bigint")["k"])
    j = e.filter("event_type = 'click'").join_stream(e.filter("event_type = 'view'"))
    return j.df.select("key", "offset", F.col("value.left").alias("left_v"), F.col("value.right").alias("right_v"))


# --- tables


def table_latest(spark, folder):
    return tables.latest(_tombstoned(spark, folder)).select("key", "offset", "value")


def table_versioned(spark, folder):
    return tables.versioned(_tombstoned(spark, folder), F.floor("value")).select("key", "offset", "version")


def table_compared(spark, folder):
    """A comparator of the user's: equal versions replace the row, too."""
    return tables.compared(_tombstoned(spark, folder).withColumn("version", F.floor("value")), F.col("version"), lambda new, current: new >= current).select("key", "offset", "version")


def table_versioned_equal(spark, folder):
    """Equal versions replace the row: a total order, by patches."""
    return tables.versioned(_tombstoned(spark, folder), F.floor("value"), or_equal=True).select("key", "offset", "version")


def materialize_by_value(spark, folder):
    """Versions that the user's extractor reads from the value before, and the writer puts into the new one."""
    rows = _tombstoned(spark, folder).withColumn("value", F.when(F.col("value").isNotNull(), F.col("event_type")))
    out = tables.materialize_by(rows, lambda key, held: 0 if held is None else int(held.split("#")[1]), lambda version, value: None if value is None else f"{value}#{version}")
    return out.select("key", "offset", "value", "version")


def materialize_topic(spark, folder):
    """Versioned values in a topic, and the newest of each key in a store."""
    logs, registry = TopicLogs(spark, scratch_path(spark, "topics")), Registry()
    stream = KeyedStream.source(_tombstoned(spark, folder).select("key", F.when(F.col("value").isNotNull(), F.col("event_type")).alias("value"), "offset"))
    sinks.materialize_to(stream, logs, "versions", "newest", registry, IntCodec(), StringCodec(), write=lambda n, v: F.when(v.isNotNull(), F.concat_ws("#", v, n)))
    topic = logs.read("versions").groupBy(F.lit("topic").alias("place"), F.col("value").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return topic.unionByName(registry.store("newest").df.groupBy(F.lit("store").alias("place"), "value").agg(F.count(F.lit(1)).alias("n")))


def materialize_versions(spark, folder):
    return tables.materialize(_tombstoned(spark, folder)).select("key", "offset", "version")


def changelog_compact(spark, folder):
    return tables.compact(_tombstoned(spark, folder).select("key", "value", "offset", "event_type")).select("key", "offset", "event_type")


def ttl_expired(spark, folder):
    """Rows of a table that are older than an hour at the newest record's time."""
    r = records(spark, folder)
    newest = r.agg(F.max("timestamp").alias("m")).scalar()
    return tables.latest(r).where(tables.expired(F.col("timestamp"), 3_600_000, newest)).select("key", "offset")


# --- stores


def _store(spark, folder) -> Store:
    return Store("last", tables.latest(_tombstoned(spark, folder)).select("key", "value", "event_type"))


def store_get(spark, folder):
    return _store(spark, folder).get(42).select("key", "value")


def store_range(spark, folder):
    return _store(spark, folder).range(10, 50).select("key", "value")


def store_scan(spark, folder):
    return _store(spark, folder).scan(after=5).select("key", "value")


def _by_nation(spark, folder) -> IndexedStore:
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.struct("c_name", "c_nationkey").alias("value"))
    return IndexedStore("customers", c, {"nation": "value.c_nationkey"})


def index_lookup(spark, folder):
    return _by_nation(spark, folder).lookup("nation", 7).select("key", "value.c_name")


def index_dump(spark, folder):
    return _by_nation(spark, folder).dump("nation")


def index_after_update(spark, folder):
    """Rows set, set anew and deleted in an indexed store: each is found under its newest value only."""
    s = IndexedStore("last", tables.latest(_tombstoned(spark, folder)).select("key", F.col("event_type").alias("value")), {"kind": "value"})
    return s.put(1, "changed").put(2, "first").put(2, "second").delete(3).put(-5, "new").dump("kind")


def store_expiry(spark, folder):
    """Rows with a time to live of their own: judged a second and an hour after they were set."""
    s = _store(spark, folder)
    out = None
    for hours in (0, 1):
        now = F.timestamp_seconds(F.lit(1_700_000_000 + 3600 * hours))
        stored = Store("last", s.rows.select("key", "value").withColumn("expires", F.when(F.col("key") % 2 == 0, F.timestamp_seconds(F.lit(1_700_000_000 + 60)))), now=now)
        d = stored.put(-1, 5.0, expiry_ms=1000).df.select(F.lit(hours).alias("hours"), "key")
        out = d if out is None else out.unionByName(d)
    return out


# --- sinks


def _plain(spark, folder) -> KeyedStream:
    return events(spark, folder).map_values(F.concat_ws(":", "event_type", F.round(F.col("value"), 1).cast("decimal(18,1)").cast("string")))


def sink_tombstone(spark, folder):
    out = sinks.encoded(_plain(spark, folder), "out", IntCodec(), StringCodec(), sinks.SinkOptions(tombstone="event_type = 'error'", prefix="app"))
    return out.df.select("topic", "offset", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def sink_headers(spark, folder):
    out = sinks.encoded(_plain(spark, folder), "out", IntCodec(), StringCodec(), sinks.SinkOptions(headers=sinks.header_array(kind=F.col("event_type"), source=F.lit("events"))))
    return out.df.select("offset", header(F.col("headers"), "kind").cast("string").alias("kind"), F.size("headers").alias("n"), header(F.col("headers"), "none").cast("string").alias("missing"))


def sink_rewrite(spark, folder):
    out = sinks.encoded(_plain(spark, folder), "out", IntCodec(), StringCodec(), sinks.SinkOptions(rewrite={"key": F.col("key") + 1000, "value": F.upper("value")}))
    return out.df.select("offset", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def uuid_dedup(spark, folder):
    """Deliveries of the transaction log, one of each message: by the UUID in any spelling, else by place."""
    log = KeyedStream.source(table(spark, folder, "transaction_records").select("key", "value", "topic", "partition", "offset", "uuid"))
    one = log.deduplicate().df
    return one.groupBy("topic").agg(F.count(F.lit(1)).alias("messages"), F.count(canonical_uuid(F.col("uuid"))).alias("with_uuid"))


def sink_through(spark, folder):
    """Into a topic and on from there, with the topic's own positions."""
    logs = TopicLogs(spark, scratch_path(spark, "topics"))
    again = sinks.through(_plain(spark, folder), logs, "out", IntCodec(), StringCodec(), sinks.SinkOptions(tombstone="event_type = 'error'", prefix="app"))
    return again.df.select("topic", "offset", "key", "value")


def windowed_counts(spark, folder):
    """Events per user and hour."""
    w = events(spark, folder).windowed("1 hour", n=F.count(F.lit(1)), top=F.max("value"))
    return w.df.select("key", F.unix_millis("value.start").alias("start_ms"), "value.n", "value.top")


def uuid_messages(spark, folder):
    """How many messages the transaction log's uuids name."""
    return table(spark, folder, "transaction_records").select(canonical_uuid(F.col("uuid")).alias("u")).agg(F.count_distinct("u").alias("messages"), F.count_if(F.col("u").isNull()).alias("without"))


NAMED = (
    source_scan, json_decode, decode_errors, record_headers, tagged_union, multi_topic, topic_offsets, topic_uuids, function_errors, process_effect, join_table_star_inner, table_versioned_equal, materialize_by_value, materialize_topic, store_expiry, sink_through, table_offset_latest,
    filter_event_age, transform_value, transform, transform_python, select_key, process_peek, branch_first_match, branch_strict_siblings, flat_map, scalar_functions, union_sinks,
    join_table_inner, join_table_left, join_table_miss, join_table_chain, join_table_star, join_table_table, join_table_keyed, join_stream, join_stream_chain, join_stream_rekeyed,
    table_latest, table_versioned, table_compared, materialize_versions, changelog_compact, ttl_expired,
    store_get, store_range, store_scan, index_lookup, index_dump, index_after_update, sink_tombstone, sink_headers, sink_rewrite, uuid_dedup, windowed_counts, uuid_messages,
)
QUERIES = {"filter": filter_} | {f.__name__: f for f in NAMED}

# --- the same in SQL

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _pairs(source: str, key: str, order: str, side: str, value: str, where: str) -> str:
    """The rule of the stream join as windows: (key, offset, left, right)."""
    return f"""SELECT k AS key, o AS "offset", CASE WHEN side = 'L' THEN v ELSE tv END AS l, CASE WHEN side = 'L' THEN tv ELSE v END AS r FROM (
      SELECT *, last_value(CASE WHEN side = fs THEN v END IGNORE NULLS) OVER (PARTITION BY k ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tv FROM (
      SELECT *, first_value(side) OVER (PARTITION BY k ORDER BY o) AS fs FROM (SELECT {key} AS k, {order} AS o, {side} AS side, {value} AS v FROM {source} WHERE {where}) WHERE k IS NOT NULL)) WHERE side <> fs"""


_AB = _pairs("events", "user_id", "event_id", "CASE WHEN event_type = 'click' THEN 'L' ELSE 'R' END", "value", "event_type IN ('click', 'view')")
_LATEST = "SELECT user_id AS key, event_id AS \"offset\", value, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"
_LIVE = f"SELECT * FROM ({_LATEST}) WHERE event_type <> 'error'"
_PLAIN_V = "concat_ws(':', event_type, CAST(CAST(round(value, 1) AS DECIMAL(18,1)) AS VARCHAR))"
_TXT = "CASE WHEN json_valid(try(decode(value))) THEN decode(value) END"

SQL = {
    "source_scan": "SELECT user_id AS key, value, 'events' AS topic, CAST(user_id % 8 AS INT) AS partition, event_id AS \"offset\", epoch_us(ts) AS ts_us FROM events",
    "json_decode": f"SELECT event_id AS \"offset\", {_K} AS k FROM events",
    "decode_errors": "SELECT 'source' AS stage, 'events' AS topic, CAST(user_id % 8 AS INT) AS partition, 'undecodable key' AS reason, count(*) AS n FROM events WHERE event_id % 7 = 0 GROUP BY ALL",
    "record_headers": "SELECT delivery_id, decode(list_filter(headers, lambda h: h.key = 'origin')[1].value) AS origin, decode(list_filter(headers, lambda h: h.key = 'trace')[1].value) AS trace, concat_ws('_', topic, CAST(partition AS VARCHAR), CAST(\"offset\" AS VARCHAR)) AS record_id FROM transaction_records",
    "tagged_union": f"""SELECT coalesce(CASE WHEN kind IN ('account_credited', 'account_debited') THEN kind END, 'undecodable value') AS kind, count(*) AS n FROM (
        SELECT CASE WHEN json_type({_TXT}) = 'OBJECT' THEN json_extract_string({_TXT}, '$.type') END AS kind FROM transaction_records WHERE value IS NOT NULL) GROUP BY ALL""",
    "multi_topic": "SELECT topic, partition, count(*) AS n, count(value) AS n_values FROM (SELECT topic, partition, value FROM transaction_records UNION ALL SELECT topic, partition, value FROM account_detail_records UNION ALL SELECT topic, partition, value FROM customer_profile_records) GROUP BY ALL",
    "topic_offsets": "SELECT CAST(user_id % 8 AS INT) AS partition, CAST(0 AS BIGINT) AS oldest, count(*) - 1 AS latest, count(*) AS records FROM events GROUP BY ALL",
    "topic_uuids": "SELECT 'e_' || event_id AS uuid, user_id AS key FROM events",
    "function_errors": """WITH t AS (SELECT event_id, user_id % 10 = 3 AS bad, user_id % 5 AS n FROM events)
        SELECT CASE WHEN bad THEN 'cast' WHEN n = 0 THEN 'divide' WHEN 12.0 / n = 4 THEN 'python' ELSE 'done' END AS stage, event_id AS "offset", CASE WHEN NOT bad AND n <> 0 AND 12.0 / n <> 4 THEN 24.0 / n END AS value FROM t""",
    "process_effect": "SELECT CASE WHEN value > 90 THEN 'function failed' ELSE 'passed' END AS what, event_id AS \"offset\" FROM events",
    "join_table_star_inner": "SELECT event_id AS \"offset\", CASE WHEN c_custkey IS NULL THEN 'customer' WHEN n_nationkey IS NULL THEN 'nation' ELSE 'joined' END AS stage FROM events LEFT JOIN customer ON c_custkey = user_id * 20 LEFT JOIN nation ON n_nationkey = event_id % 30",
    "table_offset_latest": """WITH r AS (SELECT user_id AS key, CAST(user_id % 8 AS INT) AS partition, value, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS o FROM events),
        e AS (SELECT partition, max(o) * 9 // 10 AS s FROM r GROUP BY ALL) SELECT key, partition, o AS "offset", value FROM r JOIN e USING (partition) WHERE o >= s QUALIFY row_number() OVER (PARTITION BY key ORDER BY o DESC) = 1""",
    "filter": "SELECT user_id AS key, event_id AS \"offset\", value FROM events WHERE event_type = 'click' AND value > 10",
    "filter_event_age": "SELECT user_id AS key, event_id AS \"offset\" FROM events WHERE (SELECT max(epoch_us(ts)) FROM events) - epoch_us(ts) <= 7 * 86400000000",
    "transform_value": "SELECT user_id AS key, event_id AS \"offset\", value * 2 AS doubled, upper(event_type) AS kind FROM events",
    "transform": "SELECT event_type AS key, concat_ws('-', event_type, CAST(user_id AS VARCHAR)) AS value, event_id AS \"offset\" FROM events",
    "transform_python": "SELECT user_id AS key, value * 3 + user_id AS value, event_id AS \"offset\" FROM events",
    "select_key": f"SELECT {_K} AS key, event_id AS \"offset\", value FROM events",
    "process_peek": "SELECT count(*) AS n, max(value) AS top FROM events",
    "branch_first_match": "SELECT * FROM (SELECT CASE WHEN value > 60 THEN 'large' WHEN event_type = 'click' THEN 'click' WHEN value < 20 THEN 'small' END AS branch, user_id AS key, event_id AS \"offset\" FROM events) WHERE branch IS NOT NULL",
    "branch_strict_siblings": """SELECT 'first' AS sibling, event_type, count(*) AS n FROM events WHERE value > 20 GROUP BY ALL UNION ALL SELECT 'second', event_type, count(*) FROM events WHERE value > 20 AND event_type <> 'error' GROUP BY ALL
        UNION ALL SELECT 'third', event_type, count(*) FROM events WHERE value > 20 AND event_type <> 'error' AND user_id % 2 = 0 GROUP BY ALL""",
    "flat_map": "SELECT event_id AS \"offset\", unnest(string_split(event_type, 'i')) AS part FROM events",
    "scalar_functions": f"""SELECT event_id AS "offset", strftime(date_trunc('second', ts), '%a, %d %b %Y %H:%M:%S UTC') AS sent, 'user ' || user_id || ' did ' || event_type AS text, event_type AS head, sha1(event_type) AS digest, {_K} AS k FROM events""",
    "union_sinks": "SELECT user_id AS key, event_id AS \"offset\", 'bought ' || CAST(CAST(round(value, 2) AS DECIMAL(18,2)) AS VARCHAR) AS value FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, event_id, 'failed' FROM events WHERE event_type = 'error'",
    "join_table_inner": "SELECT user_id * 20 AS key, event_id AS \"offset\", c_name FROM events JOIN customer ON c_custkey = user_id * 20",
    "join_table_left": "SELECT user_id * 20 AS key, event_id AS \"offset\", c_name FROM events LEFT JOIN customer ON c_custkey = user_id * 20",
    "join_table_miss": "SELECT 'join_table' AS stage, 'events' AS topic, CAST(user_id % 8 AS INT) AS partition, event_id AS \"offset\", 'no row under the key' AS reason FROM events WHERE user_id * 20 NOT IN (SELECT c_custkey FROM customer)",
    "join_table_chain": "SELECT user_id AS key, event_id AS \"offset\", c_name || ' of ' || n_name AS text, value AS amount FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey WHERE event_type = 'purchase' AND (SELECT max(epoch_us(ts)) FROM events) - epoch_us(ts) <= 14 * 86400000000",
    "join_table_star": "SELECT event_id AS \"offset\", value, c_name, n_name FROM events LEFT JOIN customer ON c_custkey = user_id * 20 LEFT JOIN nation ON n_nationkey = event_id % 30",
    "join_table_table": "SELECT c_custkey AS key, c_name, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey",
    "join_table_keyed": f"SELECT e.user_id AS key, e.event_id AS \"offset\", e.value AS seen, t.value AS last FROM events e JOIN ({_LIVE}) t ON t.key = e.user_id WHERE e.event_type = 'view'",
    "join_stream": f"SELECT key, \"offset\", l AS left_v, r AS right_v FROM ({_AB})",
    "join_stream_chain": "SELECT key, \"offset\", l.a AS a, l.b AS b, r.c AS c FROM ("
    + _pairs(f"(SELECT key, \"offset\", 'L' AS side, {{'a': l, 'b': r, 'c': NULL::DOUBLE}} AS v FROM ({_AB}) UNION ALL SELECT user_id, event_id, 'R', {{'a': NULL::DOUBLE, 'b': NULL::DOUBLE, 'c': value}} FROM events WHERE event_type = 'purchase')", "key", '"offset"', "side", "v", "true")
    + ")",
    "join_stream_rekeyed": "SELECT key, \"offset\", l AS left_v, r AS right_v FROM (" + _pairs("events", _K, "event_id", "CASE WHEN event_type = 'click' THEN 'L' ELSE 'R' END", "value", "event_type IN ('click', 'view')") + ")",
    "table_latest": f"SELECT key, \"offset\", value FROM ({_LIVE})",
    "table_versioned": """WITH e AS (SELECT user_id AS key, event_id AS "offset", CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) END AS version FROM events),
        t AS (SELECT *, max(CASE WHEN version IS NULL THEN "offset" END) OVER (PARTITION BY key) AS d FROM e) SELECT key, "offset", version FROM t WHERE d IS NULL OR "offset" > d QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC, "offset") = 1""",
    "table_compared": """WITH e AS (SELECT user_id AS key, event_id AS "offset", CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) END AS version FROM events),
        t AS (SELECT *, max(CASE WHEN version IS NULL THEN "offset" END) OVER (PARTITION BY key) AS d FROM e) SELECT key, "offset", version FROM t WHERE d IS NULL OR "offset" > d QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC, "offset" DESC) = 1""",
    "table_versioned_equal": """WITH e AS (SELECT user_id AS key, event_id AS "offset", CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) END AS version FROM events),
        t AS (SELECT *, max(CASE WHEN version IS NULL THEN "offset" END) OVER (PARTITION BY key) AS d FROM e) SELECT key, "offset", version FROM t WHERE d IS NULL OR "offset" > d QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC, "offset" DESC) = 1""",
    "materialize_by_value": """SELECT key, "offset", CASE WHEN event_type <> 'error' THEN event_type || '#' || version END AS value, version FROM (SELECT key, "offset", event_type, row_number() OVER (PARTITION BY key, seg ORDER BY "offset") AS version FROM (SELECT user_id AS key, event_id AS "offset", event_type,
        coalesce(count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM events))""",
    "materialize_topic": """WITH v AS (SELECT key, "offset", CASE WHEN event_type <> 'error' THEN event_type || '#' || version END AS value FROM (SELECT key, "offset", event_type, row_number() OVER (PARTITION BY key, seg ORDER BY "offset") AS version FROM (SELECT user_id AS key, event_id AS "offset", event_type,
        coalesce(count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM events)))
        SELECT 'topic' AS place, value, count(*) AS n FROM v GROUP BY ALL UNION ALL SELECT 'store', value, count(*) FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY key ORDER BY "offset" DESC) = 1) WHERE value IS NOT NULL GROUP BY ALL""",
    "materialize_versions": """SELECT key, "offset", row_number() OVER (PARTITION BY key, seg ORDER BY "offset") AS version FROM (SELECT user_id AS key, event_id AS "offset",
        coalesce(count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM events)""",
    "changelog_compact": f"SELECT key, \"offset\", event_type FROM ({_LIVE})",
    "ttl_expired": f"SELECT key, \"offset\" FROM ({_LATEST}) WHERE (SELECT max(epoch_us(ts)) FROM events) - epoch_us(ts) > 3600000000",
    "store_get": f"SELECT key, value FROM ({_LIVE}) WHERE key = 42",
    "store_range": f"SELECT key, value FROM ({_LIVE}) WHERE key BETWEEN 10 AND 50",
    "store_scan": f"SELECT key, value FROM ({_LIVE}) WHERE key >= 5",
    "index_lookup": "SELECT c_custkey AS key, c_name FROM customer WHERE c_nationkey = 7",
    "index_dump": "SELECT c_nationkey AS index_key, c_custkey AS key FROM customer",
    "index_after_update": f"""SELECT index_key, key FROM (SELECT event_type AS index_key, key FROM ({_LIVE}) WHERE key NOT IN (1, 2, 3) UNION ALL VALUES ('changed', 1), ('second', 2), ('new', -5))""",
    "store_expiry": f"SELECT 0 AS hours, key FROM ({_LIVE}) UNION ALL SELECT 1, key FROM ({_LIVE}) WHERE key % 2 <> 0 UNION ALL SELECT h, -1 FROM (VALUES (0), (1)) t(h)",
    "sink_through": f"""SELECT 'app_out' AS topic, row_number() OVER (ORDER BY event_id) - 1 AS "offset", user_id AS key, CASE WHEN event_type <> 'error' THEN {_PLAIN_V} END AS value FROM events""",
    "sink_tombstone": f"SELECT 'app_out' AS topic, event_id AS \"offset\", CAST(user_id AS VARCHAR) AS key, CASE WHEN event_type <> 'error' THEN {_PLAIN_V} END AS value FROM events",
    "sink_headers": "SELECT event_id AS \"offset\", event_type AS kind, CAST(2 AS INT) AS n, CAST(NULL AS VARCHAR) AS missing FROM events",
    "sink_rewrite": f"SELECT event_id AS \"offset\", CAST(user_id + 1000 AS VARCHAR) AS key, upper({_PLAIN_V}) AS value FROM events",
    "uuid_dedup": """WITH r AS (SELECT topic, CASE WHEN length(u) = 32 AND u <> repeat('0', 32) THEN u END AS u, partition, "offset" AS o FROM (SELECT *, replace(replace(replace(replace(lower(trim(uuid)), 'urn:uuid:', ''), '-', ''), '{', ''), '}', '') AS u FROM transaction_records))
        SELECT topic, count(DISTINCT coalesce(u, concat_ws('|', topic, CAST(partition AS VARCHAR), CAST(o AS VARCHAR)))) AS messages, count(DISTINCT u) AS with_uuid FROM r GROUP BY topic""",
    "windowed_counts": "SELECT user_id AS key, epoch_ms(date_trunc('hour', ts)) AS start_ms, count(*) AS n, max(value) AS top FROM events GROUP BY ALL",
    "uuid_messages": """SELECT count(DISTINCT u) AS messages, count(*) FILTER (u IS NULL) AS without FROM (SELECT CASE WHEN u <> repeat('0', 32) THEN u END AS u FROM (
        SELECT replace(replace(replace(replace(lower(trim(uuid)), 'urn:uuid:', ''), '-', ''), '{', ''), '}', '') AS u FROM transaction_records))""",
}
