import random
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.functions.records import IDENTITY, canonical_uuid, message_identity
from tidemark.operators import dedup
from tidemark.operators.dedup import FILES_A_FOLDER, apply_vectors, deletion_vectors, deletions, positions, read_without, store_vectors
from tidemark.queries import corpus_core
from tidemark.queries.corpus_core import LOGS

U = "0f8fad5b-d9cb-469f-a165-70867728950e"


def test_forms_of_a_uuid(spark):
    same = [U, U.upper(), "{" + U + "}", "urn:uuid:" + U, "URN:UUID:" + U.upper(), U.replace("-", ""), f" {U} "]
    other = [None, "0" * 32, "00000000-0000-0000-0000-000000000000", "", "no uuid", U[:-1], U[:-1] + "g"]
    df = spark.createDataFrame([(x,) for x in same + other], "u string").select(canonical_uuid(F.col("u")).alias("c"))
    got = [r["c"] for r in df.collect()]
    assert {bytes(x).hex() for x in got[: len(same)]} == {U.replace("-", "")}
    assert got[len(same) :] == [None] * len(other)


@pytest.fixture
def log(spark, tmp_path):
    rng = random.Random(5)
    data = []
    for i in range(3000):
        u = U if rng.random() < 0.35 else rng.choice([None, "0" * 32, f"{rng.randrange(900):032x}"])
        data.append((u, "t", rng.randrange(3), rng.randrange(400), i + 1, b"x" * rng.randrange(20), "f", 1))
    rng.shuffle(data)
    df = spark.createDataFrame(data, "uuid string, topic string, partition int, offset bigint, delivery_id bigint, value binary, _file string, _row int")
    df.repartition(5).write.parquet(str(tmp_path / "log"))
    return data, str(tmp_path / "log")


def brute(data):
    first = {}
    for u, t, p, o, d, *_ in sorted(data, key=lambda r: r[4]):
        first.setdefault(u if u and set(u) != {"0"} else (t, p, o), d)
    return set(first.values())


@pytest.mark.parametrize("unique", [True, False])
def test_equals_brute_force(spark, log, unique):
    data, path = log
    placed = positions(spark.read.parquet(path), message_identity("log"), F.col("delivery_id"))
    lost = deletions(placed, IDENTITY, unique)
    kept = brute(data)
    assert {r[0] for r in lost.select("_tm_order").collect()} == {r[4] for r in data} - kept
    for folders in (1, 5 * FILES_A_FOLDER):
        stored = store_vectors(spark, deletion_vectors(lost), folders)
        out = read_without(spark, path, stored)
        assert out.columns == spark.read.parquet(path).columns
        assert sorted(r["delivery_id"] for r in out.collect()) == sorted(kept)
        gone = apply_vectors(spark, out.schema, spark.read.parquet(path).inputFiles(), stored, deleted=True)
        assert {r["delivery_id"] for r in gone.collect()} == {r[4] for r in data} - kept


def test_ties_and_missing_order(spark, tmp_path):
    data = [("a" * 32, None), ("a" * 32, None), ("b" * 32, 4), ("b" * 32, 4), ("c" * 32, None), ("c" * 32, 9)]
    spark.createDataFrame([(u, "t", 0, 0, d) for u, d in data], "uuid string, topic string, partition int, offset bigint, delivery_id bigint").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    lost = deletions(positions(df, message_identity("t"), F.col("delivery_id")), IDENTITY)
    assert rows(lost.select("_tm_row")) == [(1,), (3,), (4,)]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "uuid string, topic string, partition int, offset bigint, delivery_id bigint").write.parquet(str(tmp_path / "e"))
    df = spark.read.parquet(str(tmp_path / "e"))
    lost = deletions(positions(df, message_identity("e"), F.col("delivery_id")), IDENTITY, True)
    assert rows(lost) == [] and rows(read_without(spark, str(tmp_path / "e"), deletion_vectors(lost))) == []


def test_all_logs_come_out_whole(spark, tmp_path):
    rng = random.Random(7)
    schema = "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, block_timestamp timestamp, headers array<struct<key string, value binary>>, uuid string, delivery_id bigint, batch_id int"
    at, want, n = datetime(2024, 5, 1), [], 0
    for log in LOGS:
        data = []
        for _ in range(400):
            n += 1
            # the same uuids and positions in every log: messages of different logs are never copies
            u = rng.choice([None, "0" * 32, f"{rng.randrange(1, 150):032x}"])
            headers = rng.choice([None, [], [("h", bytes([n % 256]))]])
            data.append((b"k%d" % n, rng.choice([None, b"", b"v%d" % n]), "t", rng.randrange(2), rng.randrange(60), rng.choice([None, at + timedelta(seconds=n)]), at + timedelta(hours=n), headers, u, n, n // 50))
        kept, first = [], set()
        for r in data:
            m = r[8] if r[8] and set(r[8]) != {"0"} else r[2:5]
            kept += [] if m in first else [r]
            first.add(m)
        want += kept
        rng.shuffle(data)
        spark.createDataFrame(data, schema).repartition(3).write.parquet(str(tmp_path / f"{log}.parquet"))
    out = corpus_core.QUERIES["p4_messages"](spark, str(tmp_path))
    assert dict(out.dtypes) == dict(spark.createDataFrame([], schema).dtypes)
    assert rows(out.select(*spark.createDataFrame([], schema).columns)) == rows(spark.createDataFrame(want, schema))


def test_found_comes_by_vectors(spark, monkeypatch):
    """p4_found reads its rows by place: what the vectors of the files delete comes out, and nothing else."""
    seen = []

    def vectors(lost):
        seen.append(deletion_vectors(lost).where("_tm_word = 0"))
        return seen[-1]

    monkeypatch.setattr(corpus_core.dedup, "deletion_vectors", vectors)
    got = corpus_core.QUERIES["p4_found"](spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and got.columns == ["delivery_id"]
    lost = corpus_core._lost(spark, "/root/testdata/sf0.001").where("_tm_row < 64").select("_tm_order")
    assert rows(got) == rows(lost) != []


def test_a_folder_that_python_cannot_open(spark, log, monkeypatch):
    data, path = log
    lost = deletions(positions(spark.read.parquet(path), message_identity("log"), F.col("delivery_id")), IDENTITY, True)
    stored = store_vectors(spark, deletion_vectors(lost), 5)
    monkeypatch.setattr(dedup, "_file_system", lambda path: (_ for _ in ()).throw(OSError("no such kind")))
    schema, files = spark.read.parquet(path).schema, spark.read.parquet(path).inputFiles()
    kept, gone = (sorted(r["delivery_id"] for r in apply_vectors(spark, schema, files, stored, d).collect()) for d in (False, True))
    assert kept == sorted(brute(data)) and sorted(kept + gone) == sorted(r[4] for r in data)


def test_a_folder_that_is_not_shared(spark, log):
    """Vectors that a task can't see are an error, not rows that were never deleted."""
    _, path = log
    lost = deletions(positions(spark.read.parquet(path), message_identity("log"), F.col("delivery_id")), IDENTITY, True)
    stored = store_vectors(spark, deletion_vectors(lost), 5)
    shutil.rmtree(stored.path.removeprefix("file:"))
    with pytest.raises(PythonException, match="isn't shared"):
        apply_vectors(spark, spark.read.parquet(path).schema, spark.read.parquet(path).inputFiles(), stored).collect()


def test_names_with_escapes(spark, tmp_path):
    """Paths with blanks, signs and characters that a URI escapes."""
    path = str(tmp_path / "a b=c%20d+é")
    spark.range(200, numPartitions=3).withColumn("u", F.col("id") % 50).write.parquet(path)
    lost = positions(spark.read.parquet(path), [F.col("u")], F.col("id"))
    kept = read_without(spark, path, deletion_vectors(deletions(lost, ["u"], True)))
    assert rows(kept.select("id")) == sorted(((i,) for i in range(50)), key=repr)
