"""Documents above a token limit into overlapping pieces, cut at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.tokens import _lists, ids_of, texts_of, token_facts, vocabulary_path

LIMIT = 512
OVERLAP = 32
PARAGRAPH, LINE, SENTENCE, WORD, NONE, INSIDE = 4, 3, 2, 1, 0, -1


def _bytes(values: bytes) -> np.ndarray:
    """Whether each byte value is one of these."""
    return np.isin(np.arange(256), np.frombuffer(values, np.uint8))


_BLANK, _CLOSING, _MARK = _bytes(b" \t\r\n\x0b\x0c"), _bytes(b"\"')]}"), _bytes(b".!?")
_WIDE_ENDS = re.compile("。|！|？".encode())


def boundary_strengths(data: bytes, places: np.ndarray) -> np.ndarray:
    """How natural a cut before each token is; ``places``: the tokens' first bytes and the text's end.

    The blanks between two words count once, at the last token that begins
    in or right after them: a paragraph if they have two line ends, a line if
    they have one, a sentence after its end mark (also before closing quotes
    and brackets), else a word.  Ideographic end marks need no blank.
    Places inside a character come last.
    """
    raw = np.frombuffer(data, np.uint8)
    strength = np.zeros(len(places), np.int64)
    inner = places < len(raw)
    strength[inner] = np.where((raw[places[inner]] & 0xC0) == 0x80, INSIDE, NONE)
    edges = np.flatnonzero(np.diff(_BLANK[raw].view(np.int8), prepend=0, append=0))
    starts, stops = edges[0::2], edges[1::2]
    if len(starts):
        line_end = (raw == 10) | ((raw == 13) & (np.r_[raw[1:], 0] != 10))
        lines = np.r_[0, np.cumsum(line_end)]
        count = lines[stops] - lines[starts]
        before = np.maximum(starts - 1, 0)
        mark = raw[np.maximum(before - _CLOSING[raw[before]], 0)]
        kind = np.where(count >= 2, PARAGRAPH, np.where(count == 1, LINE, np.where(_MARK[mark], SENTENCE, WORD)))
        at = np.searchsorted(places, stops, "right") - 1
        usable = places[at] >= starts
        strength[at[usable]] = np.maximum(strength[at[usable]], kind[usable])
    ends = np.array([m.end() for m in _WIDE_ENDS.finditer(data)], np.int64)
    if len(ends):
        at = np.minimum(np.searchsorted(places, ends), len(places) - 1)
        hit = at[places[at] == ends]
        strength[hit] = np.maximum(strength[hit], SENTENCE)
    return strength


def bisect(strength: np.ndarray, size: int, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """First tokens of the pieces' own parts: 0, then the cuts, in order.

    A stretch of more than ``limit - overlap`` tokens (the first one, which
    gets no overlap, of more than ``limit``) is cut in its middle half at the
    strongest boundary, of several at the one nearest to the midpoint.
    """
    if size <= limit:
        return [0]
    cuts, todo = [], [(0, size)]
    while todo:
        a, b = todo.pop()
        n = b - a
        if n <= (limit - overlap if a else limit):
            continue
        low, high = a + max(1, n // 4), b - max(1, n // 4)
        near = strength[low : high + 1]
        best = np.flatnonzero(near == near.max()) + low
        cut = int(best[np.argmin(np.abs(2 * best - (a + b)))])
        cuts.append(cut)
        todo += [(a, cut), (cut, b)]
    return [0, *sorted(cuts)]


def split_documents(documents: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, path: str | None = None) -> DataFrame:
    """The pieces of every document: ``key``, ``piece``, ``n_pieces``, ``first_token``, ``overlap``, ``n_tokens``, ``ids``.

    A document of at most ``limit`` tokens is one piece; NULL and empty texts
    are one piece without tokens.  Each later piece begins with the last
    ``overlap`` tokens of the piece before it.  Without the overlaps the ids
    of a document's pieces are its ids.  No shuffle; every row is split on
    its own, so repeated rows and NULL keys are just rows.
    """
    if not 0 <= overlap < limit - 3:
        raise ValueError("the overlap must leave room for at least four tokens of a piece's own")
    path = path or vocabulary_path()
    rows = documents.select(F.col(key).alias(key), F.col(text).alias("_text"))
    names = ["piece", "n_pieces", "first_token", "overlap", "n_tokens"]
    schema = T.StructType([rows.schema[key], *(T.StructField(n, T.IntegerType()) for n in names), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = token_facts(path)[0]
        for b in batches:
            source, numbers, pieces = [], [], []
            for i, t in enumerate(texts_of(b.column(1))):
                ids = ids_of(t, path).astype(np.int32)
                firsts = [0]
                if len(ids) > limit:
                    places = np.r_[0, np.cumsum(length[ids])]
                    firsts = bisect(boundary_strengths(t.encode(), places), len(ids), limit, overlap)
                for k, (a, z) in enumerate(zip(firsts, [*firsts[1:], len(ids)], strict=True)):
                    begin = max(0, a - overlap) if k else 0
                    source.append(i)
                    numbers.append((k, len(firsts), begin, a - begin, z - begin))
                    pieces.append(ids[begin:z])
            columns = np.array(numbers, np.int32).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(source, pa.int64())), *(pa.array(c) for c in columns.T), _lists(pieces, pa.int32())], [key, *names, "ids"])

    return rows.mapInArrow(split, schema)
