"""Per-period results of a running query, closed by per-source watermarks.

The rule is that of :mod:`tidemark.operators.late_events`, batch by delivery
batch, so how delivery batches fall into micro-batches changes nothing.  State
between micro-batches is one small row per source (last batch, newest
arrivals, punctuations), the log's low watermark, and one row per open key
and period.  Results are the closed periods; what comes behind them is
diverted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.late_events import Rule, closing_batches, low_watermarks, shown
from tidemark.session import checkpointed
from tidemark.sources.versioned import VersionedTable

_START = -(1 << 63)


@dataclass
class PeriodCloser:
    """foreachBatch function over records with ``key``, ``source``, ``batch``, ``event_ms``, ``arrival_ms`` and an amount.

    Delivery batches come whole and in their order; the last one is not
    repeated in a later micro-batch.  ``punctuations`` picks those of a
    micro-batch (``source``, ``batch``, ``low_ms``) out of it.

    ``results`` (closed periods), ``diverted`` and ``open`` are read from
    versioned tables under ``path``.  A micro-batch is committed last in
    ``open``, which holds its number and the low watermark; each of the other
    tables holds the number too, so that a repeated micro-batch writes only
    what a lost one hadn't.
    """

    spark: SparkSession
    path: str
    key: T.StructField
    rule: Rule = field(default_factory=Rule)
    amount: Column | None = None
    punctuations: object = None

    def __post_init__(self) -> None:
        number, source = T.LongType(), T.StructField("source", T.StringType())
        counts = [T.StructField(n, number) for n in ("period_start", "n_on_time", "n_late")]
        cell = [self.key, *counts, T.StructField("amount", T.DecimalType(38, 4))]
        make = lambda name, fields: VersionedTable(self.spark, f"{self.path}/{name}", T.StructType(fields))
        self.results = make("results", [*cell, T.StructField("closed_in", number)])
        self.open = make("open", cell)
        self.sources = make("sources", [source, *(T.StructField(n, number) for n in ("batch", "seen", "declared"))])
        self.diverted = make("diverted", [self.key, *(T.StructField(n, number) for n in ("event_ms", "arrival_ms", "batch")), T.StructField("reason", T.StringType())])

    def _put(self, table: VersionedTable, df: DataFrame, number: int, replace: bool = False, **more: int) -> None:
        state = table.manifest()
        if state.processed.get("micro-batch", -1) < number:
            table.commit(add=table.write_files(df), remove=list(state.files) if replace else None, processed={"micro-batch": number, **more}, base=state.version)

    def __call__(self, batch: DataFrame, number: int) -> None:
        now = self.open.manifest()
        if now.processed.get("micro-batch", -1) >= number:
            return
        name, rule, low = self.key.name, self.rule, now.processed.get("low", _START)
        # the sources as they were before this micro-batch, also if a lost run has replaced them
        known = self.sources.manifest()
        old = self.sources.read(known.processed["previous"] if known.processed.get("micro-batch", -1) >= number else known.version)
        records = batch.withColumn("source", F.col("source").cast("string"))
        fresh = shown(records, self.punctuations(records) if self.punctuations else None)
        steps = checkpointed(old.unionByName(fresh))
        lows = checkpointed(low_watermarks(steps, rule, low, now.processed.get("last", _START)))
        last = steps.agg(F.max("batch").alias("m")).first()["m"]
        reached = None if last is None else lows.where(F.col("batch") <= last).agg(F.max("low").alias("m")).first()["m"]
        after, last = low if reached is None else reached, _START if last is None else last
        # one row of a source holds all that its next steps need: what it showed in earlier batches counts as declared
        earlier = F.max("seen").over(Window.partitionBy("source").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1))
        with_earlier = steps.withColumn("earlier", earlier if rule.by_batch else F.lit(None).cast("bigint"))
        newest = with_earlier.groupBy("source").agg(F.max("batch").alias("batch"), F.max("seen").alias("seen"), F.greatest(F.max("declared"), F.max_by("earlier", "batch")).alias("declared"))
        self._put(self.sources, newest, number, replace=True, previous=known.version)
        timed = records.withColumn("period_start", rule.start(F.col("event_ms")))
        at, arrival = F.col("period_start"), F.col("arrival_ms")
        missing = at.isNull() | arrival.isNull() | F.col("batch").isNull()
        marks = lows.select(F.col("batch").alias("_tm_batch"), F.col("before").alias("_tm_before"))
        reason = F.when(missing, "no_time").when(~rule.in_time(arrival, at), "past_cut_off").when(rule.reached(F.col("_tm_before"), at), "after_close")
        marked = timed.join(marks, F.col("batch").cast("bigint") == F.col("_tm_batch"), "left").withColumn("reason", reason)
        self._put(self.diverted, marked.where("reason IS NOT NULL").select(name, "event_ms", "arrival_ms", "batch", "reason"), number)
        late, taken = rule.late(arrival, at), F.col("reason").isNull()
        amount = (self.amount if self.amount is not None else F.lit(0)).cast("decimal(28,4)")
        cells = marked.where("reason IS NULL").groupBy(name, "period_start").agg(F.count_if(~late & taken).alias("n_on_time"), F.count_if(late & taken).alias("n_late"), F.sum(amount).alias("amount"))
        sums = [F.sum(n).alias(n) for n in ("n_on_time", "n_late", "amount")]
        total = checkpointed(self.open.read().unionByName(cells.select(*self.open.schema.names)).groupBy(name, "period_start").agg(*sums))
        closed = rule.reached(F.lit(after), at)
        ended = total.where(closed)
        when = closing_batches(ended.select("period_start").distinct(), lows, F.lit(last), rule)
        self._put(self.results, ended.join(when, "period_start").select(*self.results.schema.names), number)
        self._put(self.open, total.where(~closed), number, replace=True, low=after, last=last)


def open_and_closed(closer: PeriodCloser) -> DataFrame:
    """Every period's present result; ``closed_in`` is NULL while it is open."""
    return closer.results.read().unionByName(closer.open.read().withColumn("closed_in", F.lit(None).cast("bigint")))
