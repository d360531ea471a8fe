"""Problems 1 to 5 on made-up tables: empty, all NULL, skewed and full of ties, with extra columns; against their SQL."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.queries import corpus_core

LOG = "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, block_timestamp timestamp, headers array<struct<key:string,value:binary>>, uuid string, delivery_id bigint, batch_id int"
LEDGER = "run_id bigint, attempt int, topic string, partition int, start_offset bigint, next_offset bigint, last_batch int, state string, started_at timestamp, finished_at timestamp"
NAMES = ("transaction_records", "account_detail_records", "customer_profile_records")
EXTRA = ("m_log", "m_uuid", "message", "version", "file", "newest", "n", "block", "_tm_order", "event_ms", "period_start", "reason", "place", "at", "r")
HOUR = 3_600_000
START = 1465171200000


def hex_uuid(rng):
    u = f"{rng.randrange(1, 60):032x}"
    dashed = f"{u[:8]}-{u[8:12]}-{u[12:16]}-{u[16:20]}-{u[20:]}"
    return rng.choice([u, dashed, dashed.upper(), "{" + dashed + "}", "urn:uuid:" + dashed])


def value(rng, kind):
    t = rng.choice([START + rng.randrange(30 * HOUR), (START + rng.randrange(30 * HOUR)) // 1000, 5, -7, 1.5e12, "1465171200000", None, True])
    whole = json.dumps({"type": rng.choice(["account_credited", "account_debited", "other", None]), "body": {"amount": rng.choice([12.34, 0.1, 7, None]), "account_type": "x", "branch_code": 3, "updated_at": 9}, "timestamp": t})
    return rng.choice([whole, whole, whole, whole, whole[: rng.randrange(len(whole))], None, "", "[]", whole + "x"] if kind == "feed" else [whole] * 6 + [whole[: rng.randrange(len(whole))], None, "null", "[" + whole + "]"])


def make(seed):
    import datetime as d

    rng = random.Random(seed)
    when = lambda ms: None if rng.random() < 0.1 else d.datetime.fromtimestamp(ms / 1000, d.UTC)
    keys = ["7", "7", "7", "+7", "007", "8", "0", "00", "x", "", None, "99999999999999999999", "1 2", "9\n"]
    hot = "ab" * 16
    out, delivery = {}, 0
    for name in NAMES:
        rows = []
        for _ in range(300):
            delivery += 1
            u = hot if rng.random() < 0.3 else rng.choice([None, "0" * 32, "{00000000-0000-0000-0000-000000000000}", *[hex_uuid(rng)] * 4])
            at = START + rng.randrange(40 * HOUR)
            if name == NAMES[2]:
                k = rng.choice([f"{rng.randrange(4):08x}-0000-4000-8000-00000000000A", f"{rng.randrange(4):08x}-0000-4000-8000-00000000000a", "no", None])
            else:
                k = rng.choice(keys)
            v = value(rng, "log" if name == NAMES[0] else "feed")
            rows.append((None if k is None else bytearray(k.encode()), None if v is None else bytearray(v.encode()), name, rng.randrange(3), rng.randrange(500), when(at), when(at + rng.randrange(9 * HOUR)), None, u, delivery, rng.randrange(20)))
        rng.shuffle(rows)
        out[name] = rows
    ledger = []
    for i in range(80):
        s = rng.randrange(500)
        ledger.append((i, 1, rng.choice([*NAMES, None]), rng.choice([0, 1, 2, None]), rng.choice([s, None]), s + rng.choice([0, 1, 30, 300]), rng.choice([None, rng.randrange(25)]), rng.choice(["committed", " COMMITTED", "failed", None]), None, None))
    out["run_ledger"] = ledger
    return out


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("rough")
    nulls = {n: [(None,) * 11] * 3 for n in NAMES} | {"run_ledger": [(None,) * 10] * 2}
    for n in NAMES:  # delivery ids are unique, whatever else is missing
        nulls[n] = [(*r[:9], i + 10 * NAMES.index(n), None) for i, r in enumerate(nulls[n])]
    kinds = {"empty": dict.fromkeys([*NAMES, "run_ledger"], []), "nulls": nulls, "one": make(1), "two": make(2)}
    for kind, tables in kinds.items():
        for name, rows in tables.items():
            df = spark.createDataFrame(rows, LEDGER if name == "run_ledger" else LOG)
            for c in EXTRA:
                df = df.withColumn(c, F.lit("extra"))
            df.coalesce(2).write.parquet(str(base / kind / f"{name}.parquet"))
    return base


def plain(x):
    return f"{float(x):.6f}" if type(x).__name__ in ("float", "Decimal") else None if x is None else str(x)


@pytest.mark.parametrize("kind", ["empty", "nulls", "one", "two"])
@pytest.mark.parametrize("name", corpus_core.QUERIES)
def test_query(spark, folders, kind, name):
    df = corpus_core.QUERIES[name](spark, str(folders / kind))
    got = sorted([tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()], key=repr)
    if name not in corpus_core.SQL:  # whole records: tests/test_dedup.py
        return
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in [*NAMES, "run_ledger"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folders / kind / t}.parquet/*.parquet'")
    cursor = con.execute(corpus_core.SQL[name])
    names = [d[0] for d in cursor.description]
    at = [names.index(c) for c in sorted(names)]
    assert got == sorted([tuple(plain(r[i]) for i in at) for r in cursor.fetchall()], key=repr)
