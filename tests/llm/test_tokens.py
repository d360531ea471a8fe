"""Encoding by chunks against plain encoding of whole texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from tidemark.llm import tokens as t

PATH = t.vocabulary_path()
PIECES = ["a", "b", " ", "  ", "\n", "\n\n", "'", "l", "ll", "'s", "é", "漢", "字", "😀", "1", "22", ".", ",", "\t", "\r\n", " ", " ", "it's", "word ", "<|endoftext|>", "​", "\x00", "\x85"]


def plain(text):
    return t.encoder(PATH).encode_ordinary(text) if text else []


def by_chunks(texts, bits):
    keys, number, chunk = t._chunked([pa.array(range(len(texts)))], pa.array(texts, pa.string()), bits)
    parts = {}
    for k, n, c in zip(keys[0].to_pylist(), number.to_pylist(), chunk.to_pylist(), strict=True):
        assert n == len(parts.setdefault(k, []))
        parts[k].append(c)
    for i, x in enumerate(texts):
        assert "".join(parts.get(i, [])) == (x or "")
    return [t._repaired([np.array(plain(c), np.int32) for c in parts.get(i, [])], PATH).tolist() for i in range(len(texts))], parts


@pytest.mark.parametrize("bits", [4, 5, 6])
def test_random_texts(bits):
    rng = random.Random(bits)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(900))) for _ in range(300)]
    texts += ["a" * 5000, " " * 5000, "漢" * 2000, "\n" * 300 + "a", "", None, "'" * 400, "ab" * 3000]
    got, parts = by_chunks(texts, bits)
    assert got == [plain(x) for x in texts]
    assert sum(len(p) for p in parts.values()) > 4 * len(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab 's1.\n\té漢 😀"), max_size=400), min_size=1, max_size=6))
def test_any_texts(texts):
    assert by_chunks(texts, 4)[0] == [plain(x) for x in texts]


def test_equal_passages_are_cut_alike():
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh ijkl") for _ in range(20_000))
    _, parts = by_chunks(["x" * 77 + passage, "some other beginning " + passage], 7)
    shared = set(parts[0]) & set(parts[1])
    assert sum(map(len, shared)) > 0.95 * len(passage)


def test_the_whole_table(spark):
    rng = random.Random(9)
    passages = ["".join(rng.choice(PIECES) for _ in range(500)) for _ in range(5)]
    data = [(i, "".join(rng.choices(passages, k=rng.randrange(4))), "x", "y") for i in range(80)] + [(1, "again", "x", "y"), (1, "again", "x", "y"), (None, "no key", "x", "y"), (None, None, "x", "y"), (200, None, "x", "y"), (201, "", "x", "y")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids string, key string")
    for bits in (4, t.CUT_BITS):
        got = t.encode_corpus(df, "doc_id", "text", bits=bits)
        assert rows(got) == sorted(((k, plain(x)) for k, x, *_ in data), key=repr)
        assert got.schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"


def test_only_sharing_documents_meet(spark, tmp_path):
    """Documents with a repeated chunk are found by digests and go by the dictionary; the others are encoded where they are."""
    rng = random.Random(4)
    passage = "".join(rng.choice(PIECES) for _ in range(3000))
    own = ["".join(rng.choice("abcdefghijkl ") for _ in range(3000)) for _ in range(30)]
    data = [(i, x + (passage if i % 5 == 0 else "")) for i, x in enumerate(own)] + [(100, None), (101, "")]
    spark.createDataFrame(data, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    assert t.sharing(df.select("doc_id", "text"), "text", 6).count() == 6
    assert rows(t.encode_corpus(df, "doc_id", "text", bits=6)) == sorted(((k, plain(x)) for k, x in data), key=repr)
    # a part of a table is no table of files
    assert rows(t.encode_corpus(df.where("doc_id < 7"), "doc_id", "text", bits=6)) == sorted(((k, plain(x)) for k, x in data if k < 7), key=repr)


def test_counts_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (None, "<|endoftext|>")], "k int, x string")
    assert rows(t.count_tokens(df, "k", "x")) == sorted([(1, 2), (2, 0), (3, 0), (None, len(plain("<|endoftext|>")))], key=repr)
    none = df.limit(0)
    assert rows(t.encode_corpus(none, "k", "x")) == [] and rows(t.count_tokens(none, "k", "x")) == []


def test_agrees_with_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    other = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    rng = random.Random(3)
    for _ in range(100):
        text = "".join(rng.choice(PIECES) for _ in range(60))
        assert other.encode(text, add_special_tokens=False).ids == plain(text)
