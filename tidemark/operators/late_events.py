"""Aggregates per key and period of event time, corrected by late records.

Method: every source (a partition of the log) has a low watermark, the
arrival time below which it is taken to deliver nothing more.  It follows
from what is known when a delivery batch comes, never from later ones: the
newest arrival shown so far less the slack that its disorder is allowed, and
the source's *punctuations*, statements of its own that nothing that arrived
before a given time is still to come.  The log's low watermark after a batch
is the least of those of the active sources; a source that has shown nothing
for a number of batches is idle and doesn't hold the others up until it shows
something again.  The log's low watermark never goes back.

A period is closed in the first batch after which the log's low watermark has
reached the period's end plus the allowed lateness.  Records of later batches
are diverted, even if they arrived in time.

Nothing here is sequential over the log: watermarks are windows over one row
per source and batch, then over one row per batch.
:mod:`tidemark.streaming.periods` is the same rule between micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.records import floor_to
from tidemark.operators.scan import running

HOUR_MS = 3_600_000
#: Periods in a stretch of the search for closing batches.
SPAN = 64
IDLE_BATCHES = 5
_LONG_MIN = -(1 << 63)


@dataclass(frozen=True)
class Periods:
    """``aggregates``: a row per key and period; ``diverted``: the records left out, with ``reason``; ``closings``: a row per period with ``closed_in`` (NULL: still open). Each is planned when it is asked for."""

    _plans: dict[str, Callable[[], DataFrame]]

    @property
    def aggregates(self) -> DataFrame:
        return self._plans["aggregates"]()

    @property
    def diverted(self) -> DataFrame:
        return self._plans["diverted"]()

    @property
    def closings(self) -> DataFrame:
        return self._plans["closings"]()


@dataclass(frozen=True)
class Rule:
    """When periods close. ``by_batch``: with each batch a source states that what arrived before the newest arrival of its earlier batches has been delivered."""

    period_ms: int = HOUR_MS
    lateness_ms: int = 6 * HOUR_MS
    slack_ms: int = 0
    idle_batches: int = IDLE_BATCHES
    by_batch: bool = False

    def start(self, event_ms: Column) -> Column:
        return floor_to(event_ms, self.period_ms)

    def late(self, arrival_ms: Column, start: Column) -> Column:
        """Whether a record arrived when its period had ended; in this form nothing overflows."""
        return F.try_subtract(arrival_ms, F.lit(self.period_ms)) >= start

    def in_time(self, arrival_ms: Column, start: Column) -> Column:
        return F.coalesce(F.try_subtract(arrival_ms, F.lit(self.period_ms + self.lateness_ms)) < start, F.lit(True))

    def reached(self, low: Column, start: Column) -> Column:
        """Whether a low watermark has reached a period's bound; false where there is none."""
        return F.coalesce(F.try_subtract(low, F.lit(self.period_ms + self.lateness_ms)) >= start, F.lit(False))


def shown(records: DataFrame, punctuations: DataFrame | None = None) -> DataFrame:
    """``source``, ``batch``, ``seen``, ``declared``: what each source shows in each batch, aggregated before any shuffle.

    ``punctuations`` has ``source``, ``batch`` and ``low_ms``; a punctuation
    also shows that its source isn't idle.  Rows without batch, and records
    without arrival, show nothing.
    """
    batch = F.col("batch").cast("bigint").alias("batch")
    rows = records.where("arrival_ms IS NOT NULL AND batch IS NOT NULL").select("source", batch, F.col("arrival_ms").cast("bigint").alias("seen"))
    if punctuations is None:
        return rows.groupBy("source", "batch").agg(F.max("seen").alias("seen")).withColumn("declared", F.lit(None).cast("bigint"))
    said = punctuations.where("low_ms IS NOT NULL AND batch IS NOT NULL").select("source", batch, F.lit(None).cast("bigint").alias("seen"), F.col("low_ms").cast("bigint").alias("declared"))
    both = rows.withColumn("declared", F.lit(None).cast("bigint")).unionByName(said)
    return both.groupBy("source", "batch").agg(F.max("seen").alias("seen"), F.max("declared").alias("declared"))


def low_watermarks(steps: DataFrame, rule: Rule, start: int = _LONG_MIN, after: int = _LONG_MIN) -> DataFrame:
    """``batch``, ``before``, ``low``: the log's low watermark before and after each batch in which it may change.

    ``steps``: see :func:`shown`; ``start``: the watermark after the batch
    ``after``, up to which nothing is to be found out anew.  A
    source's step holds until its next one, but for ``idle_batches`` batches
    at most, so a source takes at most so many rows a step.  Batches behind
    the last one shown are those in which sources would fall idle.
    """
    order = Window.partitionBy("source").orderBy("batch")
    so_far, earlier = (order.rowsBetween(Window.unboundedPreceding, e) for e in (0, -1))
    known = [F.max("seen").over(so_far) - rule.slack_ms, F.max("declared").over(so_far), *([F.max("seen").over(earlier)] if rule.by_batch else [])]
    held = steps.select("batch", F.greatest(*known).alias("low"), F.lead("batch").over(order).alias("next"))
    until = F.least(F.col("next") - 1, F.col("batch") + rule.idle_batches)
    every = held.select("low", F.explode(F.sequence("batch", until)).alias("batch")).where(F.col("batch") > after).groupBy("batch").agg(F.min("low").alias("least"))
    line = running(every, [], "batch", maxes={"before": F.col("least")}, before=True)
    before = F.coalesce(F.greatest("before", F.lit(start)), F.lit(start))
    return line.select("batch", before.alias("before"), F.greatest(before, "least").alias("low"))


def closing_batches(periods: DataFrame, lows: DataFrame, last: Column, rule: Rule) -> DataFrame:
    """``period_start`` and ``closed_in``, the first batch (up to ``last``) after which the low watermark has reached the bound, or NULL.

    Bounds below the first mark close with it, those beyond the last one stay
    open, so however far out of range periods are, no more than the periods
    between the marks are searched; in stretches of SPAN periods.
    """
    marks = lows.where((F.col("low") > F.col("before")) & (F.col("batch") <= last)).select(F.col("low").alias("v"), "batch")
    ends = marks.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    bound = F.try_add("period_start", F.lit(rule.period_ms + rule.lateness_ms))
    bounded = periods.select("period_start", F.greatest(bound, ends.select("lo").scalar()).alias("v"), (bound <= ends.select("hi").scalar()).alias("closes"))
    line = marks.select("v", "batch").unionByName(bounded.where("closes").select("v").distinct().withColumn("batch", F.lit(None).cast("bigint"))).groupBy("v").agg(F.min("batch").alias("b")).withColumn("down", -F.col("v"))
    found = running(line, [], "down", lasts={"closed_in": F.col("b")}, width=SPAN * rule.period_ms).select("v", "closed_in")
    return bounded.join(found.withColumn("closes", F.lit(True)), ["v", "closes"], "left").select("period_start", "closed_in")


def close_periods(records: DataFrame, keys: Sequence[str], measures: dict[str, Column], rule: Rule = Rule(), punctuations: DataFrame | None = None) -> Periods:
    """Counts and sums per key and period, with corrections up to the rule's lateness after the period's end.

    ``records`` has the columns ``keys``, ``source``, ``batch``, ``event_ms``
    and ``arrival_ms`` (bigint milliseconds, rounded down) and what
    ``measures`` (name to numeric column, exact types for exact sums) read.
    Extra columns are passed on to ``diverted`` only, but for those with
    names that this gives: ``period_start``, ``reason``.

    * Records that arrive before their period ends are its first result
      (``_on_time``); those up to the cut-off are corrections (``n_late``),
      made in ``n_revisions`` batches; ``_total`` is the corrected result.
    * Diverted, each with a reason: ``no_time`` (event or arrival time or
      batch missing, or no bigint has the period's start), ``past_cut_off``
      (arrival at the cut-off or later), ``after_close`` (arrived in time but
      delivered after the period was closed).  The last are also counted with
      their period: ``n_after_close`` and, of these, ``n_late_after_close``.
    * NULL keys form a group of their own, as do NULL sources.  An empty
      input gives empty results.  Repeated rows count repeatedly: remove
      copies first.
    """
    timed = records.drop("period_start", "reason").withColumn("period_start", rule.start(F.col("event_ms")))
    at, arrival = F.col("period_start"), F.col("arrival_ms")
    known = at.isNotNull() & arrival.isNotNull() & F.col("batch").isNotNull()
    in_time = rule.in_time(arrival, at)
    lows = low_watermarks(shown(records, punctuations), rule)
    marks = lows.select(F.col("batch").alias("_tm_batch"), F.col("before").alias("_tm_before"))
    behind = rule.reached(F.col("_tm_before"), at)

    def aggregates() -> DataFrame:
        cells = (
            timed.where(known & in_time)
            .groupBy(*keys, "period_start", F.col("batch").cast("bigint").alias("_tm_in"), rule.late(arrival, at).alias("_tm_late"))
            .agg(F.count(F.lit(1)).alias("_tm_n"), *(F.sum(c).alias(f"_tm_sum_{m}") for m, c in measures.items()))
        )
        # every batch of a record with an arrival has a mark
        cells = cells.join(marks, F.col("_tm_in") == F.col("_tm_batch"), "left")
        late, n = F.col("_tm_late"), F.col("_tm_n")
        total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
        return cells.groupBy(*keys, "period_start").agg(
            total(~late & ~behind).alias("n_on_time"),
            total(late & ~behind).alias("n_late"),
            total(~behind).alias("n_total"),
            *(F.sum(F.when(~late & ~behind, F.col(f"_tm_sum_{m}"))).alias(f"{m}_on_time") for m in measures),
            *(F.sum(F.when(~behind, F.col(f"_tm_sum_{m}"))).alias(f"{m}_total") for m in measures),
            F.count_if(late & ~behind).alias("n_revisions"),
            total(behind).alias("n_after_close"),
            total(behind & late).alias("n_late_after_close"),
        )

    def diverted() -> DataFrame:
        reason = F.when(~known, "no_time").when(~in_time, "past_cut_off").when(behind, "after_close")
        return timed.join(marks, F.col("batch").cast("bigint") == F.col("_tm_batch"), "left").withColumn("reason", reason).where("reason IS NOT NULL").drop("_tm_batch", "_tm_before")

    def closings() -> DataFrame:
        last = records.where("arrival_ms IS NOT NULL").agg(F.max(F.col("batch").cast("bigint"))).scalar()
        return closing_batches(timed.where(known & in_time).select("period_start").distinct(), lows, last, rule)

    return Periods({"aggregates": aggregates, "diverted": diverted, "closings": closings})
