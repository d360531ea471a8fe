"""Pieces keep the limit, the overlap and every token, and are cut where a text allows it."""

import random

import numpy as np
import pytest

from tests.conftest import rows
from tidemark.llm import splitting as s
from tidemark.llm import tokens as t

PATH = t.vocabulary_path()


def cut(text, limit, overlap):
    e = t.encoder(PATH)
    ids = np.array(e.encode_ordinary(text), np.int32)
    places = np.r_[0, np.cumsum(t.token_facts(PATH)[0][ids])]
    strength = s.boundary_strengths(text.encode(), places)
    return ids, strength, s.bisect(strength, len(ids), limit, overlap)


def test_strengths():
    text = 'One two. "Three."  Four\nfive\r\n\r\nsix 漢字。字 end'
    ids, strength, _ = cut(text, 512, 32)
    e = t.encoder(PATH)
    named = {e.decode(ids[k:].tolist()).lstrip()[:4]: int(strength[k]) for k in range(1, len(ids))}
    assert named["two."] == s.WORD and named['"Thr'] == s.SENTENCE and named["Four"] == s.SENTENCE and named["five"] == s.LINE and named["six "] == s.PARAGRAPH and named["字 en"[:4]] == s.SENTENCE
    assert s.INSIDE in cut("🙂🙃" * 9, 512, 32)[1]


@pytest.mark.parametrize("limit,overlap", [(512, 32), (40, 0), (40, 30), (20, 5)])
def test_any_text(spark, limit, overlap):
    rng = random.Random(limit)
    words = ["alpha", "beta.", "Gamma", "x" * 30, "漢字", "\n", "\n\n", "1234", "don't", "🙂"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1500))) for _ in range(12)] + ["z" * 6000, "🙂" * 900, " " * 4000, "\n" * 2000, "", None, "short"]
    df = spark.createDataFrame([(i, x, "q") for i, x in enumerate(texts)], "doc_id bigint, text string, piece string")
    pieces = {}
    for r in s.split_documents(df, "doc_id", "text", limit, overlap).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    e = t.encoder(PATH)
    for i, x in enumerate(texts):
        whole = e.encode_ordinary(x) if x else []
        got = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in got] == list(range(len(got))) and {r["n_pieces"] for r in got} == {len(got)}
        assert (len(got) == 1) == (len(whole) <= limit)
        back = []
        for k, r in enumerate(got):
            assert r["n_tokens"] == len(r["ids"]) <= limit
            if k:
                before = got[k - 1]["ids"]
                assert r["ids"][: r["overlap"]] == before[len(before) - r["overlap"] :] and r["overlap"] == min(overlap, len(before))
            back += r["ids"][r["overlap"] :]
        assert back == whole


def test_natural_places():
    paragraph = " ".join(["word"] * 60) + "."
    text = "\n\n".join([paragraph] * 40)
    ids, strength, firsts = cut(text, 512, 32)
    assert all(strength[k] == s.PARAGRAPH for k in firsts[1:])
    _, strength, firsts = cut(" ".join(["word"] * 3000), 512, 32)
    assert all(strength[k] == s.WORD for k in firsts[1:]) and len(firsts) == 8
    # the first piece has no overlap, so it may have the whole limit
    assert s.bisect(np.zeros(1000, int), 1000, 512, 32) == [0, 500, 750]


def test_limits(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert rows(s.split_documents(df, "doc_id", "text")) == []
    with pytest.raises(ValueError):
        s.split_documents(df, "doc_id", "text", 32, 32)
