"""Queries p1_ to p5_: the record logs through the operators for large logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.records import IDENTITY, account_key_text, account_number, canonical_uuid, message_identity, payload_ms, payload_time, strict_json, uuid_key_text
from tidemark.operators import cdc, dedup, hot_keys, incremental, late_events
from tidemark.operators.stream import KeyedStream
from tidemark.operators.tables import Table
from tidemark.plans.topology import Node
from tidemark.session import scratch_path, table, written
from tidemark.sources.versioned import VersionedTable, run_incrementally

LOGS = ("transaction_records", "account_detail_records", "customer_profile_records")
FEEDS = LOGS[1:]
TRANSACTION = "type string, body struct<amount: decimal(18,2)>, timestamp double"


# --- 1: late and out-of-order events


def first_transactions(spark: SparkSession, folder: str, amounts: bool = True) -> DataFrame:
    """First deliveries in the transaction log with a readable key, as narrow rows for :func:`late_events.close_periods`, with or without their amounts.

    All columns are fixed-width, so copies are aggregated by hash before the shuffle.
    """
    payload = strict_json(F.col("value"), TRANSACTION if amounts else "timestamp double")
    rows = table(spark, folder, "transaction_records").select(*message_identity("transaction"), "delivery_id", "key", "partition", "batch_id", "timestamp", "block_timestamp", payload.alias("p"))
    read = F.col("p.timestamp").isNotNull()
    rows = rows.select(
        *IDENTITY,
        "delivery_id",
        account_number(F.col("key")).alias("account_no"),
        F.col("partition").alias("source"),
        F.col("batch_id").alias("batch"),
        F.when(read, payload_ms(F.col("p.timestamp"))).otherwise(F.unix_millis("timestamp")).alias("event_ms"),
        F.coalesce(F.unix_millis("block_timestamp"), F.unix_millis("timestamp")).alias("arrival_ms"),
        *([F.when(read & F.col("p.type").isin("account_credited", "account_debited"), F.col("p.body.amount")).alias("amount"), F.when(read, F.col("p.type") == "account_credited").alias("is_credit")] if amounts else []),
    )
    carried = ["account_no", "source", "batch", "event_ms", "arrival_ms", *(["amount", "is_credit"] if amounts else [])]
    first = rows.groupBy(*IDENTITY).agg(*(F.min_by(c, "delivery_id").alias(c) for c in carried))
    return first.where("account_no IS NOT NULL").select(*carried)


#: Sources deliver batch by batch, which is their punctuation; disorder of six hours of arrival is let pass besides.
CLOSING = late_events.Rule(slack_ms=6 * late_events.HOUR_MS, by_batch=True)


def _periods(spark: SparkSession, folder: str, amounts: bool = True) -> late_events.Periods:
    credited = F.col("is_credit")
    return late_events.close_periods(
        # two passes: over the watermarks and over the periods
        written(first_transactions(spark, folder, amounts), "first"),
        ["account_no"],
        {"credits": F.when(credited, F.col("amount")), "debits": F.when(~credited, F.col("amount"))} if amounts else {},
        CLOSING,
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts and hours with messages that arrived late but in time: corrections, and what was delivered after the hour was closed."""
    return _periods(spark, folder, amounts=False).aggregates.where("n_late + n_late_after_close > 0").select("account_no", "period_start")


def p1_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and amounts of every account and hour, first and corrected, and the batch in which the hour was closed."""
    periods = _periods(spark, folder)
    amounts = [F.col(c).cast("double").alias(c) for c in ("credits_on_time", "debits_on_time", "credits_total", "debits_total")]
    rows = periods.aggregates.join(periods.closings, "period_start", "left")
    return rows.select("account_no", "period_start", "n_on_time", "n_late", "n_total", "n_revisions", "n_after_close", "n_late_after_close", "closed_in", *amounts)


def p1_diverted(spark: SparkSession, folder: str) -> DataFrame:
    """Records that were too late, by reason and hour."""
    return _periods(spark, folder).diverted.groupBy("reason", "period_start").agg(F.count(F.lit(1)).alias("n"))


# --- 2: only new or changed records


def _deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of all logs as (topic, partition, offset, message, version)."""
    out = None
    for log in LOGS:
        own = table(spark, folder, log).select("topic", "partition", "offset", canonical_uuid(F.col("uuid")).alias("message"), F.col("batch_id").alias("version"))
        out = own if out is None else out.unionByName(own)
    return out


POSITION = T.StructType([T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("newest", T.LongType())])


def _log_table(spark: SparkSession, base: str) -> VersionedTable:
    return VersionedTable(spark, f"{base}/log", POSITION)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Positions that the next run has to process: the logs as a table, the ledger as its processed version, and the difference."""
    base = scratch_path(spark, "runs")
    log, out = _log_table(spark, base), VersionedTable(spark, f"{base}/out", T.StructType(POSITION.fields[:3]))
    incremental.take_over(log, incremental.log_positions(_deliveries(spark, folder)))
    incremental.next_run(log, out, table(spark, folder, "run_ledger"))
    return out.read()


def p2_files(spark: SparkSession, folder: str) -> DataFrame:
    """The slices of the logs' table by partition and status against the committed runs, from the manifest's entries."""
    log = _log_table(spark, scratch_path(spark, "runs"))
    incremental.take_over(log, incremental.log_positions(_deliveries(spark, folder)))
    present = log.manifest()
    entries = spark.read.schema(incremental.ENTRIES).parquet(present.details["entries"]) if present.files else spark.createDataFrame([], incremental.ENTRIES)
    slices = entries.groupBy("topic", "partition", "file").agg(F.sum("records").alias("records"), F.max("newest").alias("newest"))
    diff = incremental.manifest_diff(slices, incremental.commits(table(spark, folder, "run_ledger")))
    return diff.groupBy("topic", "partition", "status").agg(F.count(F.lit(1)).alias("files"), F.sum("records").alias("records"))


def p2_resumed(spark: SparkSession, folder: str) -> DataFrame:
    """Positions by the run that processed them: the log grows by a version between two runs, and each run dies once between its write and its commit."""
    base = scratch_path(spark, "runs")
    log, out = _log_table(spark, base), VersionedTable(spark, f"{base}/out", T.StructType([*POSITION.fields[:3], T.StructField("run", T.IntegerType())]))
    first = _deliveries(spark, folder).groupBy("topic", "partition", "offset").agg(F.min("version").cast("bigint").alias("newest")).where("topic IS NOT NULL AND partition IS NOT NULL AND offset IS NOT NULL")
    positions = written(first, "positions")
    half = (positions.agg(F.max("newest").alias("m")).first()["m"] or 0) // 2
    for run, part in enumerate((F.coalesce(F.col("newest") <= half, F.lit(False)), F.coalesce(F.col("newest") > half, F.lit(True))), 1):
        incremental.take_over(log, positions.where(part))

        def process(deltas: DataFrame, run: int = run) -> DataFrame:
            return deltas.where("change = 'added'").withColumn("run", F.lit(run))

        # the files of a run that was lost before its commit are part of no version
        out.write_files(process(log.diff(out.manifest().processed.get(log.path, 0), log.latest())))
        run_incrementally(log, out, process)
    return out.read()


# --- 3: a few keys holding most records


def _account_totals(spark: SparkSession, folder: str) -> DataFrame:
    payload = strict_json(F.col("value"), TRANSACTION)
    rows = table(spark, folder, "transaction_records").select("key", payload.alias("p")).select("key", F.when(F.col("p.timestamp").isNotNull(), F.col("p")).alias("p"))
    cents = (F.col("p.body.amount") * 100).cast("bigint")
    return hot_keys.key_totals(
        rows,
        account_number(F.col("key")),
        {
            "n_credits": (F.col("p.type") == "account_credited").cast("bigint"),
            "n_debits": (F.col("p.type") == "account_debited").cast("bigint"),
            "credit_cents": F.when(F.col("p.type") == "account_credited", cents),
            "debit_cents": F.when(F.col("p.type") == "account_debited", cents),
        },
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts with at least 2 % of all rows."""
    rows = table(spark, folder, "transaction_records")
    totals = hot_keys.key_totals(rows, account_number(F.col("key")))
    return hot_keys.heavy_keys(totals, rows).select(F.col("key").alias("account_no"))


def p3_accounts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, credits and debits of every account."""
    return _account_totals(spark, folder).where("key IS NOT NULL").withColumnRenamed("key", "account_no")


def p3_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every partition and its share in thousandths."""
    rows = table(spark, folder, "transaction_records")
    totals = hot_keys.key_totals(rows, F.col("partition"))
    every = rows.agg(F.count(F.lit(1)).alias("n"))
    return totals.select(F.col("key").alias("partition"), "n", F.floor(F.col("n") * 1000 / every.scalar()).alias("per_mille"))


# --- 4: messages delivered more than once


def _lost(spark: SparkSession, folder: str) -> DataFrame:
    placed = None
    for log in LOGS:
        own = dedup.positions(table(spark, folder, log), message_identity(log), F.col("delivery_id"))
        placed = own if placed is None else placed.unionByName(own)
    return dedup.deletions(placed, IDENTITY, unique_order=True)


def _applied(spark: SparkSession, folder: str, deleted: bool, *columns: str) -> DataFrame:
    """The rows of all logs that one set of deletion vectors deletes or leaves, each log read in place."""
    logs = [table(spark, folder, log) for log in LOGS]
    vectors, out = dedup.store_vectors(spark, dedup.deletion_vectors(_lost(spark, folder)), sum(len(x.inputFiles()) for x in logs)), None
    for rows in logs:
        own = dedup.apply_vectors(spark, (rows.select(*columns) if columns else rows).schema, rows.inputFiles(), vectors, deleted)
        out = own if out is None else out.unionByName(own)
    return out


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that aren't the first delivery of their message: those that the deletion vectors delete, read in place."""
    return _applied(spark, folder, True, "delivery_id")


def p4_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The first delivery of each message of all logs: whole records."""
    return _applied(spark, folder, False)


def p4_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The first delivery of each message of all logs: its place, and the sizes of its payload."""
    kept = _applied(spark, folder, False)
    return kept.select("topic", "partition", "offset", "delivery_id", "batch_id", F.octet_length("value").alias("value_bytes"), F.size("headers").alias("n_headers"))


# --- 5: a stream of inserts, updates and deletes


def _changes(spark: SparkSession, folder: str, placed: bool = False) -> DataFrame:
    """The operations of both feeds: of each message the copy with the smallest offset, if its key and value can be read.

    Ties of the offset go to the earliest delivery.  ``place``: the offset,
    the delivery and, with ``placed``, where the row is in its file.
    """
    out, where = None, ["_tm_h", "_tm_g", "_tm_row"] if placed else []
    for log, key in zip(FEEDS, (account_key_text, uuid_key_text), strict=True):
        own = table(spark, folder, log).select(
            *message_identity(log),
            "topic",
            key(F.col("key")).alias("key"),
            "offset",
            "delivery_id",
            *([*dedup.file_name(), dedup.row_index()] if placed else []),
            F.col("value").isNull().alias("is_delete"),
            payload_time(strict_json(F.col("value"), "timestamp double")["timestamp"]).alias("version"),
        )
        out = own if out is None else out.unionByName(own)
    # rows without offset come last
    row = F.struct(F.col("offset").isNull().alias("none"), "offset", "delivery_id", "topic", "key", "is_delete", "version", *where)
    first = out.groupBy(*IDENTITY).agg(F.min(row).alias("r")).select("r.*")
    return first.where("key IS NOT NULL AND (is_delete OR version IS NOT NULL)").select("topic", "key", F.struct("offset", "delivery_id", *where).alias("place"), "offset", "delivery_id", "is_delete", "version")


def _patches(spark: SparkSession, folder: str, changes: DataFrame) -> DataFrame:
    # the greatest offset of the feeds as they are, from one column each
    one, two = (table(spark, folder, log).select("offset") for log in FEEDS)
    return cdc.patches(changes, ["topic", "key"], "offset", "version", "is_delete", "place", tie="delivery_id", top=one.unionByName(two).agg(F.max("offset")).scalar())


def _state(spark: SparkSession, folder: str, placed: bool = False) -> DataFrame:
    return cdc.apply_patches(_patches(spark, folder, _changes(spark, folder, placed)), ["topic", "key"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The keys that have a row at the end, and the change that supplied it."""
    return _state(spark, folder).select("topic", "key", F.col("pos.offset").alias("offset"))


def p5_resumed(spark: SparkSession, folder: str) -> DataFrame:
    """The same state in two steps: a base table from the first half of each feed's offsets, and the patches of the rest on top of it.

    A message counts in the half of its first copy; patches don't need the
    rows of the base.
    """
    changes = written(_changes(spark, folder), "changes")
    half = changes.agg(F.max("offset")).scalar() / 2
    keys = ["topic", "key"]
    base = cdc.apply_patches(_patches(spark, folder, changes.where(F.col("offset") <= half)), keys)
    after = cdc.apply_patches(_patches(spark, folder, changes.where(F.col("offset") > half)), keys, written(base, "base"))
    return after.select("topic", "key", F.col("pos.offset").alias("offset"))


def _current(spark: SparkSession, folder: str, log: str, key: Callable[[Column], Column], body: str) -> DataFrame:
    """The current rows of a feed: ``key``, ``version_ms`` and the members of the payload's body, read where they are."""
    topic = log.removesuffix("_records")
    rows = table(spark, folder, log)
    current = dedup.deletion_vectors(_state(spark, folder, placed=True).where(F.col("topic") == topic).select("pos.*"))
    found = dedup.apply_vectors(spark, rows.select("key", "value").schema, rows.inputFiles(), current, deleted=True)
    read = found.select(key(F.col("key")).alias("key"), strict_json(F.col("value"), f"body struct<{body}>, timestamp double").alias("p"))
    return read.select("key", payload_time(F.col("p.timestamp")).cast("bigint").alias("version_ms"), "p.body.*")


def p5_accounts(spark: SparkSession, folder: str) -> DataFrame:
    """The current row of each account."""
    return _current(spark, folder, FEEDS[0], account_key_text, "account_type string, customer_id string, branch string, branch_code int, updated_at bigint")


def p5_customers(spark: SparkSession, folder: str) -> DataFrame:
    """The current row of each customer."""
    rows = _current(spark, folder, FEEDS[1], uuid_key_text, "customer_name string, nic string, contact_details struct<phone: string, email: string, address: string>, date_of_birth string, updated_at bigint")
    return rows.select("key", "version_ms", "customer_name", "nic", "contact_details.phone", "contact_details.email", "contact_details.address", "date_of_birth", "updated_at")


def message_flow(spark: SparkSession, folder: str) -> DataFrame:
    """A whole application: first deliveries, branches by type, two table joins, one topic of messages."""
    payload = strict_json(F.col("value"), TRANSACTION)
    rows = table(spark, folder, "transaction_records").select(*message_identity("transaction"), "delivery_id", account_number(F.col("key")).alias("key"), payload.alias("p"))
    first = rows.groupBy(*IDENTITY).agg(F.min("delivery_id").alias("offset"), F.min_by("key", "delivery_id").alias("key"), F.min_by("p", "delivery_id").alias("p"))
    records = first.where("key IS NOT NULL AND p.timestamp IS NOT NULL").select("key", "offset", F.struct("p.type", F.col("p.body.amount").alias("amount")).alias("value"))
    branches = KeyedStream.source(records, name="transaction").branch({"credit": "value.type = 'account_credited'", "debit": "value.type = 'account_debited'"})
    accounts = Table(p5_accounts(spark, folder).select(F.col("key").try_cast("bigint").alias("key"), F.struct(F.lower("customer_id").alias("customer_id")).alias("value")), "account_detail", Node("table", "account_detail"))
    customers = Table(p5_customers(spark, folder).select("key", F.struct("customer_name", "phone").alias("value")), "customer_profile", Node("table", "customer_profile"))

    def messages(s: KeyedStream, verb: str) -> KeyedStream:
        owned = s.join_table(accounts, value=F.struct("value.amount", "right.customer_id"), name="account")
        named = owned.join_table(customers, "value.customer_id", F.struct("value.*", "right.customer_name", "right.phone"), name="customer")
        return named.map("value.customer_id", F.concat_ws(" ", "value.customer_name", F.lit(verb), F.col("value.amount").cast("string"), "value.phone"))

    out = messages(branches["credit"], "received").union(messages(branches["debit"], "paid"))
    return out.df.select("key", F.col("value").alias("text"), "offset")


QUERIES = {f.__name__: f for f in (p1_found, p1_periods, p1_diverted, p2_found, p2_files, p2_resumed, p3_found, p3_accounts, p3_partitions, p4_found, p4_messages, p4_kept, p5_found, p5_resumed, p5_accounts, p5_customers, message_flow)}

# --- the same results in SQL

_UUID = "replace(replace(replace(CASE WHEN lower(trim(uuid)) LIKE 'urn:uuid:%' THEN substr(lower(trim(uuid)), 10) ELSE lower(trim(uuid)) END, '-', ''), '{', ''), '}', '')"
_TEXT = "CASE WHEN json_valid(try(decode(value))) THEN decode(value) END"
_READ = f"coalesce(json_type({_TEXT}) = 'OBJECT' AND json_type({_TEXT}, '$.timestamp') IN ('UBIGINT', 'BIGINT', 'DOUBLE'), false)"


def _marked(log: str, topic: str, more: str) -> str:
    """Rows of a log with the identity of their message."""
    return f"""SELECT *, CASE WHEN u IS NULL THEN concat_ws('|', topic, CAST(partition AS VARCHAR), CAST("offset" AS VARCHAR)) ELSE u END AS m
    FROM (SELECT '{topic}' AS lg, topic, partition, "offset", delivery_id, batch_id, CASE WHEN length({_UUID}) = 32 AND {_UUID} <> repeat('0', 32) THEN {_UUID} END AS u{more} FROM {log})"""


_ACCOUNT = r"CASE WHEN regexp_full_match(try(decode(key)), '\+?[0-9]+') THEN try_cast(try(decode(key)) AS BIGINT) END"
_READ_ROWS = f""", {_ACCOUNT} AS account_no, CASE WHEN {_READ} THEN CAST(json_extract_string({_TEXT}, '$.timestamp') AS DOUBLE) END AS pt,
    CASE WHEN {_READ} THEN json_extract_string({_TEXT}, '$.type') END AS kind, CASE WHEN {_READ} THEN CAST(json_extract_string({_TEXT}, '$.body.amount') AS DECIMAL(18,2)) END AS amount, "timestamp" AS ts, block_timestamp AS bt"""
_FIRST = f"""first AS (SELECT *, e - ((e % 3600000) + 3600000) % 3600000 AS period_start FROM (SELECT *,
      CAST(CASE WHEN pt IS NULL THEN floor(epoch_us(ts) / 1000) WHEN pt < 1e11 THEN floor(pt * 1000) ELSE floor(pt) END AS BIGINT) AS e, epoch_us(coalesce(bt, ts)) AS a
      FROM ({_marked("transaction_records", "transaction", _READ_ROWS)}) QUALIFY row_number() OVER (PARTITION BY m ORDER BY delivery_id) = 1) WHERE account_no IS NOT NULL)"""
#: Batch by batch: each source's watermark as it was then, the least of the active ones, and the greatest of those so far.
_LOWS = """steps AS (SELECT partition AS src, batch_id AS b, max(CAST(floor(a / 1000) AS BIGINT)) AS hi FROM first WHERE a IS NOT NULL AND batch_id IS NOT NULL GROUP BY ALL),
    numbers AS (SELECT unnest(range((SELECT min(b) FROM steps), (SELECT max(b) FROM steps) + 1)) AS n),
    active AS (SELECT n, src FROM numbers JOIN steps ON b BETWEEN n - 5 AND n GROUP BY ALL),
    own AS (SELECT n, s.src, greatest(max(s.hi) - 6 * 3600000, max(s.hi) FILTER (s.b < z.b)) AS low FROM active c JOIN steps s ON s.src IS NOT DISTINCT FROM c.src AND s.b <= n JOIN (SELECT n AS zn, src AS zs, max(b) AS b FROM numbers JOIN steps ON b <= n GROUP BY ALL) z ON zn = n AND zs IS NOT DISTINCT FROM s.src GROUP BY ALL),
    lows AS (SELECT n, max(min(low)) OVER (ORDER BY n) AS low FROM own GROUP BY n)"""
_BEHIND = "coalesce((SELECT max(low) FROM lows WHERE n < batch_id) >= period_start + 7 * 3600000, false)"
_MARKED = f"""SELECT *, a >= (period_start + 3600000) * 1000 AS late, {_BEHIND} AS behind, (SELECT min(n) FROM lows WHERE low >= period_start + 7 * 3600000) AS closed_in,
    CASE WHEN kind = 'account_credited' THEN amount END AS credit, CASE WHEN kind = 'account_debited' THEN amount END AS debit FROM first WHERE a < (period_start + 7 * 3600000) * 1000 AND batch_id IS NOT NULL"""
_PERIODS = "FROM first WHERE a < (period_start + 3600000 + 6 * 3600000) * 1000"
_ALL_POS = "deliveries AS (" + " UNION ALL ".join(f"SELECT topic, partition, \"offset\", coalesce(u, '') AS m, batch_id FROM ({_marked(log, log, '')})" for log in LOGS) + ")"
_LOST = " UNION ALL ".join(f"SELECT delivery_id FROM ({_marked(log, log, '')}) QUALIFY row_number() OVER (PARTITION BY m ORDER BY delivery_id) > 1" for log in LOGS)
_KEYS = (r"CASE WHEN regexp_full_match(try(decode(key)), '\+?[0-9]+') THEN regexp_replace(regexp_replace(try(decode(key)), '^\+', ''), '^0+([0-9])', '\1') END", r"CASE WHEN regexp_full_match(lower(try(decode(key))), '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}') THEN lower(try(decode(key))) END")
_FEED = " UNION ALL ".join(
    "SELECT * FROM (" + _marked(log, log, f", {k} AS k, value IS NULL AS del, CASE WHEN {_READ} THEN CAST(json_extract_string({_TEXT}, '$.timestamp') AS DOUBLE) END AS pt, value AS raw") + ') QUALIFY row_number() OVER (PARTITION BY m ORDER BY "offset", delivery_id) = 1' for log, k in zip(FEEDS, _KEYS, strict=True)
)
_STATE = f"""ops AS (SELECT topic, k, "offset" AS o, delivery_id, del, CASE WHEN pt < 1e11 THEN pt * 1000 ELSE pt END AS v, raw FROM ({_FEED}) WHERE k IS NOT NULL AND (del OR pt IS NOT NULL)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY topic, k ORDER BY o, delivery_id) AS n FROM ops),
    last AS (SELECT *, max(CASE WHEN del THEN n ELSE 0 END) OVER (PARTITION BY topic, k) AS d FROM placed),
    state AS (SELECT topic, k AS key, o AS "offset", v, raw FROM last WHERE n > d QUALIFY row_number() OVER (PARTITION BY topic, k ORDER BY v DESC, n) = 1)"""

SQL = {
    "p1_found": f"WITH {_FIRST} SELECT DISTINCT account_no, period_start {_PERIODS} AND a >= (period_start + 3600000) * 1000",
    "p1_periods": f"""WITH {_FIRST}, {_LOWS}, marked AS ({_MARKED})
        SELECT account_no, period_start, CAST(coalesce(sum(1) FILTER (NOT late AND NOT behind), 0) AS BIGINT) AS n_on_time, CAST(coalesce(sum(1) FILTER (late AND NOT behind), 0) AS BIGINT) AS n_late, count(*) FILTER (NOT behind) AS n_total,
          count(DISTINCT batch_id) FILTER (late AND NOT behind) AS n_revisions, count(*) FILTER (behind) AS n_after_close, count(*) FILTER (behind AND late) AS n_late_after_close, any_value(closed_in) AS closed_in,
          CAST(sum(credit) FILTER (NOT late AND NOT behind) AS DOUBLE) AS credits_on_time, CAST(sum(debit) FILTER (NOT late AND NOT behind) AS DOUBLE) AS debits_on_time, CAST(sum(credit) FILTER (NOT behind) AS DOUBLE) AS credits_total, CAST(sum(debit) FILTER (NOT behind) AS DOUBLE) AS debits_total
        FROM marked GROUP BY account_no, period_start""",
    "p1_diverted": f"""WITH {_FIRST}, {_LOWS} SELECT reason, period_start, count(*) AS n FROM (
        SELECT period_start, CASE WHEN e IS NULL OR a IS NULL OR batch_id IS NULL THEN 'no_time' WHEN a >= (period_start + 7 * 3600000) * 1000 THEN 'past_cut_off' WHEN {_BEHIND} THEN 'after_close' END AS reason FROM first) WHERE reason IS NOT NULL GROUP BY ALL""",
    "p2_found": f"""WITH {_ALL_POS}, messages AS (SELECT topic, partition, "offset", m, coalesce(min(batch_id), 2147483647) AS b FROM deliveries WHERE topic IS NOT NULL AND partition IS NOT NULL AND "offset" IS NOT NULL GROUP BY ALL), newest AS (SELECT topic, partition, "offset", max(b) AS b FROM messages GROUP BY ALL),
        done AS (SELECT DISTINCT topic, partition, start_offset, next_offset, last_batch FROM run_ledger WHERE lower(trim(state)) = 'committed')
        SELECT topic, partition, "offset" FROM newest n WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.topic = n.topic AND d.partition = n.partition AND d.start_offset <= n."offset" AND n."offset" < d.next_offset AND d.last_batch >= n.b)""",
    "p2_files": f"""WITH {_ALL_POS}, messages AS (SELECT topic, partition, "offset", m, coalesce(min(batch_id), 2147483647) AS b FROM deliveries WHERE topic IS NOT NULL AND partition IS NOT NULL AND "offset" IS NOT NULL GROUP BY ALL), newest AS (SELECT topic, partition, "offset", max(b) AS b FROM messages GROUP BY ALL),
        files AS (SELECT topic, partition, "offset" // 256 AS file, count(*) AS records, max(b) AS newest FROM newest GROUP BY ALL),
        done AS (SELECT DISTINCT topic, partition, start_offset AS s, next_offset AS e, last_batch AS v FROM run_ledger WHERE lower(trim(state)) = 'committed' AND start_offset < next_offset AND last_batch IS NOT NULL),
        met AS (SELECT f.topic, f.partition, f.file, f.records, f.newest, max(CASE WHEN d.s <= f.file * 256 AND d.e >= (f.file + 1) * 256 THEN d.v END) AS processed, bool_or(d.s > f.file * 256 OR d.e < (f.file + 1) * 256) AS in_part
          FROM files f LEFT JOIN done d ON d.topic = f.topic AND d.partition = f.partition AND d.s < (f.file + 1) * 256 AND d.e > f.file * 256 GROUP BY ALL)
        SELECT topic, partition, CASE WHEN processed >= newest THEN 'current' WHEN processed IS NULL AND NOT coalesce(in_part, false) THEN 'added' ELSE 'changed' END AS status, count(*) AS files, CAST(sum(records) AS BIGINT) AS records FROM met GROUP BY ALL""",
    "p2_resumed": f"""WITH {_ALL_POS}, seen AS (SELECT topic, partition, "offset", min(batch_id) AS b FROM deliveries WHERE topic IS NOT NULL AND partition IS NOT NULL AND "offset" IS NOT NULL GROUP BY ALL)
        SELECT topic, partition, "offset", CAST(CASE WHEN b <= (SELECT coalesce(max(b), 0) FROM seen) // 2 THEN 1 ELSE 2 END AS INT) AS run FROM seen""",
    "p3_found": f"SELECT account_no FROM (SELECT {_ACCOUNT} AS account_no, count(*) AS n FROM transaction_records GROUP BY ALL) WHERE account_no IS NOT NULL AND n * 100 >= 2 * (SELECT count(*) FROM transaction_records)",
    "p3_accounts": f"""SELECT account_no, count(*) AS n, count(*) FILTER (kind = 'account_credited') AS n_credits, count(*) FILTER (kind = 'account_debited') AS n_debits,
        CAST(coalesce(sum(CAST(amount * 100 AS BIGINT)) FILTER (kind = 'account_credited'), 0) AS BIGINT) AS credit_cents, CAST(coalesce(sum(CAST(amount * 100 AS BIGINT)) FILTER (kind = 'account_debited'), 0) AS BIGINT) AS debit_cents
        FROM ({_marked("transaction_records", "transaction", _READ_ROWS)}) WHERE account_no IS NOT NULL GROUP BY account_no""",
    "p3_partitions": "SELECT partition, count(*) AS n, CAST(floor(count(*) * 1000 / (SELECT count(*) FROM transaction_records)) AS BIGINT) AS per_mille FROM transaction_records GROUP BY partition",
    "p4_found": _LOST,
    "p4_kept": " UNION ALL ".join(f"SELECT topic, partition, \"offset\", delivery_id, batch_id, octet_length(value) AS value_bytes, len(headers) AS n_headers FROM {log}" for log in LOGS).replace(" UNION ALL ", f" WHERE delivery_id NOT IN ({_LOST}) UNION ALL ") + f" WHERE delivery_id NOT IN ({_LOST})",
    "p5_found": f'WITH {_STATE} SELECT topic, key, "offset" FROM state',
    "p5_resumed": f'WITH {_STATE} SELECT topic, key, "offset" FROM state',
    "p5_customers": f"""WITH {_STATE} SELECT key, CAST(v AS BIGINT) AS version_ms, json_extract_string(t, '$.body.customer_name') AS customer_name, json_extract_string(t, '$.body.nic') AS nic, json_extract_string(t, '$.body.contact_details.phone') AS phone,
        json_extract_string(t, '$.body.contact_details.email') AS email, json_extract_string(t, '$.body.contact_details.address') AS address, json_extract_string(t, '$.body.date_of_birth') AS date_of_birth, CAST(json_extract_string(t, '$.body.updated_at') AS BIGINT) AS updated_at FROM (SELECT *, decode(raw) AS t FROM state WHERE topic = 'customer_profile')""",
    "message_flow": f"""WITH {_FIRST}, {_STATE}, acc AS (SELECT try_cast(key AS BIGINT) AS account, lower(json_extract_string(decode(raw), '$.body.customer_id')) AS customer_id FROM state WHERE topic = 'account_detail'),
        cus AS (SELECT key, json_extract_string(decode(raw), '$.body.customer_name') AS customer_name, json_extract_string(decode(raw), '$.body.contact_details.phone') AS phone FROM state WHERE topic = 'customer_profile')
        SELECT c.key AS key, concat_ws(' ', customer_name, CASE kind WHEN 'account_credited' THEN 'received' ELSE 'paid' END, CAST(amount AS VARCHAR), phone) AS text, f.delivery_id AS "offset"
        FROM first f JOIN acc a ON a.account = f.account_no JOIN cus c ON c.key = a.customer_id WHERE kind IN ('account_credited', 'account_debited')""",
    "p5_accounts": f"""WITH {_STATE} SELECT key, CAST(v AS BIGINT) AS version_ms, json_extract_string(t, '$.body.account_type') AS account_type, json_extract_string(t, '$.body.customer_id') AS customer_id,
        json_extract_string(t, '$.body.branch') AS branch, CAST(json_extract_string(t, '$.body.branch_code') AS INT) AS branch_code, CAST(json_extract_string(t, '$.body.updated_at') AS BIGINT) AS updated_at FROM (SELECT *, decode(raw) AS t FROM state WHERE topic = 'account_detail')""",
}
