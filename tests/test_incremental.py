"""Manifest differences against a position-by-position search; resumable runs."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators.dedup import FILE, plain_name
from tidemark.operators.incremental import commit_processed, commits, log_manifest, log_positions, manifest_diff, next_run, take_over
from tidemark.queries.corpus_core import POSITION
from tidemark.sources.versioned import CommitConflict, VersionedTable, run_incrementally

DELIVERIES = "topic string, partition int, offset bigint, message string, version int"
LEDGER = "topic string, partition int, start_offset bigint, next_offset bigint, last_batch int, state string, run_id string"


def brute(deliveries, ledger):
    seen = {}
    for t, p, o, m, v in deliveries:
        if None not in (t, p, o):
            v = float("inf") if v is None else v
            seen[t, p, o, m] = min(v, seen.get((t, p, o, m), v))
    done = [r for r in ledger if r[5] and r[5].strip().lower() == "committed" and None not in r[:5]]
    return sorted({(t, p, o) for (t, p, o, m), v in seen.items() if not any(r[0] == t and r[1] == p and r[2] <= o < r[3] and r[4] >= v for r in done)})


def unprocessed(spark, path, deliveries, ledger, size=256):
    log, out = VersionedTable(spark, f"{path}/log", POSITION), VersionedTable(spark, f"{path}/out", POSITION)
    take_over(log, log_positions(deliveries), size)
    next_run(log, out, ledger, size)
    assert out.manifest().processed == {log.path: 3} and log.latest() == 3
    return out.read().drop("newest")


@pytest.mark.parametrize("seed,size", [(0, 4), (1, 256), (2, 16)])
def test_equals_search(spark, tmp_path, seed, size):
    rng = random.Random(seed)
    deliveries = [(rng.choice(["a", "b", None]), rng.choice([0, 1, 1, 1, None]), rng.choice([rng.randrange(80), rng.randrange(2000), None]), rng.choice(["x", "y", None]), rng.choice([None, *range(10)])) for _ in range(400)]
    ledger = []
    for _ in range(60):
        s = rng.choice([rng.randrange(80), rng.randrange(2000), None])
        ledger.append((rng.choice(["a", "b"]), rng.choice([0, 1]), s, None if s is None else s + rng.choice([0, 1, 7, 40, 900]), rng.choice([rng.randrange(12), None]), rng.choice(["committed", " Committed ", "COMMITTED", "failed", None, "not committed"]), "r"))
    got = unprocessed(spark, tmp_path, spark.createDataFrame(deliveries, DELIVERIES), spark.createDataFrame(ledger, LEDGER), size)
    assert sorted(map(tuple, got.collect())) == brute(deliveries, ledger)


def test_only_what_differs_is_read(spark, tmp_path):
    """Of four files one is wholly processed, one in part, one not at all and one was delivered again since."""
    log = VersionedTable(spark, str(tmp_path / "log"), POSITION)
    for p in range(4):
        log.commit(add=log.write_files(spark.createDataFrame([("a", p, o, 9 if (p, o) == (3, 2) else 1) for o in range(8)], POSITION).coalesce(1)))
    names = {r["partition"]: r["p"] for r in log.rows(list(log.manifest().files)).select("partition", F.col("_tm_path").alias("p")).distinct().collect()}
    entries = log.rows(list(log.manifest().files)).withColumn("file", F.expr("offset div 4")).groupBy(F.col("_tm_path").alias("path"), *FILE, "topic", "partition", "file").agg(F.count("*").alias("records"), F.max("newest").alias("newest"))
    entries.write.parquet(str(tmp_path / "entries"))
    log.commit(details={"entries": str(tmp_path / "entries")})
    ledger = spark.createDataFrame([("a", p, 0, n, 1, "committed", "") for p, n in ((0, 8), (1, 3), (3, 8))], LEDGER)
    before, present = (log.manifest(v) for v in commit_processed(log, ledger, 4))
    of = {plain_name(f): v for f, v in before.files.items()}
    assert {p: (of[plain_name(f)] is not None) if plain_name(f) in of else None for p, f in names.items()} == {0: False, 1: True, 2: None, 3: True}
    assert len(present.files) == 4 and not any(present.files.values())
    assert sorted((r[1], r[2]) for r in log.diff(before.version).where("change = 'added'").collect()) == [*((1, o) for o in range(3, 8)), *((2, o) for o in range(8)), (3, 2)]


def test_empty_ledger_and_log(spark, tmp_path):
    log = spark.createDataFrame([("a", 0, 5, "m", 1)] * 3, DELIVERIES)
    none = spark.createDataFrame([], LEDGER)
    assert rows(unprocessed(spark, tmp_path / "1", log, none)) == [("a", 0, 5)]
    assert rows(unprocessed(spark, tmp_path / "2", spark.createDataFrame([], DELIVERIES), none)) == []


def test_a_file_status(spark):
    log = spark.createDataFrame([("a", 0, o, "m", 1) for o in range(12)], DELIVERIES)
    ledger = spark.createDataFrame([("a", 0, 0, 6, 1, "committed", "")], LEDGER)
    diff = manifest_diff(log_manifest(log_positions(log), 4), commits(ledger), 4)
    assert rows(diff.select("file", "status")) == [(0, "current"), (1, "changed"), (2, "added")]


@pytest.fixture
def pair(spark, tmp_path):
    schema = spark.createDataFrame([], "id bigint, v string").schema
    return VersionedTable(spark, str(tmp_path / "in"), schema), VersionedTable(spark, str(tmp_path / "out"), schema)


def frame(spark, *ids):
    return spark.createDataFrame([(i, f"v{i}") for i in ids], "id bigint, v string")


def test_runs_take_what_changed(spark, pair):
    source, sink = pair
    deltas = lambda df: df.select("id", "change")
    source.append(frame(spark, 1, 2, 3))
    source.append(frame(spark, 4))
    assert rows(deltas(source.diff(0))) == [(1, "added"), (2, "added"), (3, "added"), (4, "added")]
    source.delete_where("id = 2")
    assert rows(deltas(source.diff(2))) == [(2, "removed")]
    assert rows(source.read().select("id")) == [(1,), (3,), (4,)]
    assert rows(deltas(source.diff(1))) == [(2, "removed"), (4, "added")]
    source.delete_where("id = 1")
    assert rows(source.read().select("id")) == [(3,), (4,)]
    assert rows(deltas(source.diff(3))) == [(1, "removed")]
    assert rows(source.read(2).select("id")) == [(1,), (2,), (3,), (4,)]
    keep = lambda d: d.where("change = 'added'").drop("change")
    assert run_incrementally(source, sink, keep) == 1
    assert run_incrementally(source, sink, keep) is None
    source.append(frame(spark, 9))
    assert run_incrementally(source, sink, keep) == 2
    assert rows(sink.read().select("id")) == [(3,), (4,), (9,)]


def test_a_run_that_dies_leaves_nothing(spark, pair, monkeypatch):
    source, sink = pair
    source.append(frame(spark, 1, 2))
    keep = lambda d: d.drop("change")
    with monkeypatch.context() as m:
        m.setattr(sink, "commit", lambda **_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            run_incrementally(source, sink, keep)
    assert sink.latest() == 0
    run_incrementally(source, sink, keep)
    assert rows(sink.read().select("id")) == [(1,), (2,)]


def test_two_writers(spark, pair):
    source, _ = pair
    source.append(frame(spark, 1))
    files = source.write_files(frame(spark, 2))
    source.append(frame(spark, 3))
    with pytest.raises(CommitConflict):
        source.commit(add=files, base=1)
    assert rows(source.read().select("id")) == [(1,), (3,)]
    assert rows(VersionedTable(spark, source.path).read().select("id")) == [(1,), (3,)]
