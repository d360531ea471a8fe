"""Periods closed by per-source watermarks, against a plain replay of the batches, at once and in micro-batches."""

import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import rows
from tidemark.operators.late_events import Rule, close_periods
from tidemark.streaming.periods import PeriodCloser, open_and_closed

P, LATE = 10, 60
SCHEMA = "account string, source int, batch int, event_ms bigint, arrival_ms bigint, reason string, before string"
SAID = "source int, batch int, low_ms bigint"


def replay(records, rule, said=()):
    """Batch by batch: what is known then, closings, and what becomes of each record."""
    shows = [(r[1], r[2], r[4]) for r in records if r[4] is not None and r[2] is not None]
    marks = [(s, b, low) for s, b, low in said if b is not None and low is not None]
    numbers = [b for _, b, _ in shows]
    low, before, closed = float("-inf"), {}, {}
    periods = {r[3] - r[3] % P for r in records if None not in r[2:5] and r[4] < r[3] - r[3] % P + P + LATE}
    every = sorted({b for _, b, _ in shows + marks})
    for b in range(every[0], (max(numbers) if numbers else every[0]) + 1) if every else ():
        before[b] = low
        own = []
        for s in {x[0] for x in shows + marks}:
            mine = [x for x in shows if x[0] == s and x[1] <= b]
            mark = [x for x in marks if x[0] == s and x[1] <= b]
            last = max((x[1] for x in mine + mark), default=None)
            if last is None or b - last > rule.idle_batches:
                continue
            known = [x[2] for x in mark] + ([max(x[2] for x in mine) - rule.slack_ms] if mine else [])
            known += [x[2] for x in mine if rule.by_batch and x[1] < last]
            own.append(max(known))
        low = max(low, min(own, default=low))
        for p in periods - set(closed):
            if low >= p + P + LATE:
                closed[p] = b
    out, diverted = defaultdict(lambda: [0, 0, 0]), []
    for a, _, b, e, t, *_ in records:
        if e is None or t is None or b is None:
            diverted.append((a, "no_time"))
            continue
        p = e - e % P
        if t >= p + P + LATE:
            diverted.append((a, "past_cut_off"))
        elif before[b] >= p + P + LATE:
            diverted.append((a, "after_close"))
            out[a, p][2] += 1
        else:
            out[a, p][t >= p + P] += 1
    return out, diverted, {p: closed.get(p) for p in periods}


def check(spark, records, rule, said=()):
    got = close_periods(spark.createDataFrame(records, SCHEMA), ["account"], {}, rule, spark.createDataFrame(said, SAID) if said else None)
    out, diverted, closed = replay(records, rule, said)
    assert rows(got.aggregates.select("account", "period_start", "n_on_time", "n_late", "n_after_close")) == sorted(((a, p, *n) for (a, p), n in out.items()), key=repr)
    assert rows(got.diverted.select("account", "reason")) == sorted(diverted, key=repr)
    assert rows(got.closings) == sorted(closed.items(), key=repr)
    return diverted


def made(seed, n=250):
    rng = random.Random(seed)
    records = []
    for _ in range(n):
        batch, e = rng.randrange(40), rng.randrange(-30, 300)
        t = None if rng.random() < 0.03 else batch * 8 + rng.randrange(-90 if rng.random() < 0.1 else -8, 8)
        records.append((rng.choice(["a", "b", None]), rng.choice([0, 0, 0, 1, 2, None]), batch, None if rng.random() < 0.03 else e, t, "x", "y"))
    return records


@pytest.mark.parametrize("seed,slack,by_batch", [(0, 0, False), (1, 20, False), (2, 20, True)])
def test_equals_replay(spark, seed, slack, by_batch):
    said = [(s, b, b * 8 - 30) for s in (0, 1) for b in range(0, 40, 7)] if seed % 2 else []
    diverted = check(spark, made(seed), Rule(P, LATE, slack, 3, by_batch), said)
    assert slack or any(r == "after_close" for _, r in diverted)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", None]), st.integers(0, 2), st.integers(0, 9), st.one_of(st.none(), st.integers(-50, 50)), st.one_of(st.none(), st.integers(-50, 150)), st.just("r"), st.just("c")), max_size=25))
def test_any_records(spark, records):
    check(spark, records, Rule(P, LATE, 0, 3))


def test_empty_and_out_of_range(spark):
    check(spark, [], Rule(P, LATE))
    top = (1 << 63) - 1
    far = [("a", 0, 1, e, t, "", "") for e in (top, -top - 1, 0) for t in (5, -5)] + [("a", 0, 9, 0, 10**15, "", "")]
    got = close_periods(spark.createDataFrame(far, SCHEMA), ["account"], {}, Rule(P, LATE))
    assert rows(got.diverted.select("event_ms", "reason")) == [(-top - 1, "no_time"), (-top - 1, "no_time"), (0, "past_cut_off")]
    assert rows(got.closings) == [(0, 9), (top - top % P, None)]


def test_a_silent_source_does_not_hold_up(spark):
    steady = [("a", 0, b, b * 10, b * 10 + 1, "", "") for b in range(60)]
    records = [("a", 1, 0, 0, 1, "", ""), *steady]
    patient, hasty = (close_periods(spark.createDataFrame(records, SCHEMA), ["account"], {}, Rule(P, LATE, 0, idle)).closings.where("period_start = 0").first()["closed_in"] for idle in (50, 12))
    assert patient == 51 and hasty == 13


@pytest.mark.parametrize("seed", [1])
def test_micro_batches_change_nothing(spark, tmp_path, seed):
    rule = Rule(P, LATE, 10 * seed, 3, seed == 1)
    records = [r for r in made(seed, 120) if r[0]]
    said = [(s, b, b * 8 - 30) for s in (0, 1) for b in range(0, 40, 7)]
    df = spark.createDataFrame(records, SCHEMA)
    # punctuations come in the micro-batch of their delivery batch
    marks = spark.createDataFrame(said, SAID).withColumn("source", F.col("source").cast("string"))
    cuts = [0, 11, 12, 40]

    def of(batch):
        lo, hi = current
        return marks.where((F.col("batch") >= lo) & (F.col("batch") < hi))

    closer = PeriodCloser(spark, str(tmp_path / "p"), T.StructField("account", T.StringType()), rule, punctuations=of)
    for n, current in enumerate(zip(cuts, cuts[1:])):
        part = df.where((F.col("batch") >= current[0]) & (F.col("batch") < current[1]))
        closer(part, n)
        closer(part, n)  # a repeated micro-batch
    out, diverted, closed = replay(records, rule, said)
    want = [(a, p, n[0], n[1], closed[p]) for (a, p), n in out.items() if n[0] + n[1]]
    assert rows(open_and_closed(closer).select("account", "period_start", "n_on_time", "n_late", "closed_in")) == sorted(want, key=repr)
    assert rows(closer.diverted.read().select("account", "reason")) == sorted(diverted, key=repr)


def test_a_lost_micro_batch_is_made_up_for(spark, tmp_path, monkeypatch):
    rule = Rule(P, LATE, 0, 3, True)
    records = [r for r in made(5, 60) if r[0]]
    df = spark.createDataFrame(records, SCHEMA)
    closer = PeriodCloser(spark, str(tmp_path / "p"), T.StructField("account", T.StringType()), rule)
    for n, part in enumerate((df.where("batch < 20"), df.where("batch >= 20"))):
        for lost in (closer.results, closer.open):  # after the sources, and after the results
            with monkeypatch.context() as m:
                m.setattr(lost, "commit", lambda **_: (_ for _ in ()).throw(RuntimeError("lost")))
                with pytest.raises(RuntimeError):
                    closer(part, n)
        closer(part, n)
    out, diverted, closed = replay(records, rule)
    want = [(a, p, n[0], n[1], closed[p]) for (a, p), n in out.items() if n[0] + n[1]]
    assert rows(open_and_closed(closer).select("account", "period_start", "n_on_time", "n_late", "closed_in")) == sorted(want, key=repr)
    assert rows(closer.diverted.read().select("account", "reason")) == sorted(diverted, key=repr)
