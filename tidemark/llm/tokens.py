"""Encoding a corpus with a public byte-level BPE vocabulary.

Plain encoding (``count_tokens``, and the encoder that the other operators
share) and encoding by content-defined chunks, where a chunk that occurs in
several documents is encoded once:

1. A rolling hash over 32 bytes cuts every document where its value says so,
   so equal passages are cut alike wherever they stand.
2. The chunks' digests alone are shuffled, to find those that occur more than
   once.  Documents without any share nothing: they are encoded where they
   are.  The others are marked by deletion vectors and read in place.
3. The distinct chunks of the sharing documents are encoded, each once.
4. Their chunks are put together again.  Tokens next to a join may
   differ from those of the whole text; around each join the text between
   the nearest *agreeing* places is encoded again.  A place agrees if a
   visible ASCII character is followed by a blank there: no piece of the
   vocabulary's pattern goes across it, whatever stands around, so both
   encodings have a token boundary there and what follows doesn't depend on
   what precedes.  If a chunk has no such place the region grows to the next.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import dedup
from tidemark.session import written

VOCABULARY = "byte_bpe_50k"
#: A byte ends a chunk if the top bits of its hash are zero: 512 bytes a chunk on average.
CUT_BITS = 9
#: Bytes that the rolling hash looks back on: as many as the hash has bits.
WINDOW = 32
#: Bytes that are hashed at once.
BLOCK = 1 << 17
#: A cut is left out if another one would precede it by fewer bytes.
LEAST = 32


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The installed rank file of a vocabulary; pass another path to the operators to use another place."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


@cache
def encoder(path: str):
    """The encoder of a rank file, kept for the life of the Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(text: str | None, path: str) -> np.ndarray:
    """The ids of a text as an array; what reads like a special token is ordinary text. None has no ids."""
    return encoder(path).encode_to_numpy(text, allowed_special=set(), disallowed_special=()) if text else np.zeros(0, np.uint32)


@cache
def token_facts(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each id: length in bytes, whether it begins with a blank, whether it ends with a visible ASCII character."""
    ranks = encoder(path)._mergeable_ranks
    size = max(ranks.values()) + 1
    length, blank, visible = np.zeros(size, np.int64), np.zeros(size, bool), np.zeros(size, bool)
    for token, i in ranks.items():
        length[i], blank[i], visible[i] = len(token), token[:1] in (b" ", b"\n", b"\r", b"\t"), 0x21 <= token[-1] <= 0x7E
    return length, blank, visible


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """The texts of an Arrow column; bytes that aren't UTF-8 become the replacement character."""
    for x in column.cast(pa.binary()) if not pa.types.is_large_string(column.type) else column.cast(pa.large_binary()):
        yield x.as_py().decode("utf-8", "replace") if x.is_valid else None


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32), kind))


def count_tokens(documents: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key`` and ``n_tokens`` of every row; NULL and empty texts have 0. No shuffle."""
    path = path or vocabulary_path()
    rows = documents.select(F.col(key).alias(key), F.col(text).alias("_text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(ids_of(t, path)) for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], [key, "n_tokens"])

    return rows.mapInArrow(counted, T.StructType([rows.schema[key], T.StructField("n_tokens", T.LongType())]))


def _gear() -> np.ndarray:
    """A random 32-bit number for each byte value; any fixed ones will do."""
    return np.random.Generator(np.random.PCG64(64)).integers(0, 1 << 32, 256, np.uint32)


def _hits(data: np.ndarray, first: int, bits: int) -> np.ndarray:
    """Bytes of the block from ``first`` on whose hash makes a cut; those before it are looked back on."""
    back = min(first, WINDOW - 1)
    h = _gear()[data[first - back : first + BLOCK]]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return np.flatnonzero(h[back:] < np.uint32(1 << (WINDOW - bits))).astype(np.int64) + first


def cut_places(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int = CUT_BITS) -> np.ndarray:
    """Places in ``data`` (UTF-8 bytes of many texts) before which a chunk begins; never a text's first byte.

    The hash of a byte sums up the random numbers of the WINDOW bytes up to
    it, each shifted by its distance; doubling the window five times gives it
    for all bytes at once.  A cut needs its whole window inside its text, and
    lies between characters.
    """
    at = np.concatenate([np.zeros(0, np.int64), *(_hits(data, k, bits) for k in range(0, len(data), BLOCK))])
    at = at[np.diff(at, prepend=-LEAST - 1) >= LEAST] + 1
    for _ in range(3):
        inside = at < len(data)
        at[inside] += (data[at[inside]] & 0xC0) == 0x80
    text = np.searchsorted(starts, at, "right") - 1
    return np.unique(at[(text >= 0) & (at < ends[text]) & (at - starts[text] >= WINDOW + 4)])


def _chunked(keys: list[pa.Array], texts: pa.Array, bits: int) -> tuple[list[pa.Array], pa.Array, pa.Array]:
    """Keys, number and text of each chunk of the non-empty texts; chunks are slices of the texts' own buffer."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    base = int(offsets[0]) if len(texts) else 0
    starts, ends = offsets[:-1] - base, offsets[1:] - base
    used = ends > starts
    cuts = cut_places(raw[base : int(offsets[-1])] if len(texts) else raw, starts[used], ends[used], bits)
    begins = np.sort(np.r_[starts[used], cuts])
    stops = np.r_[begins[1:], ends[used][-1:]] if used.any() else begins
    rows = np.flatnonzero(used)[np.searchsorted(starts[used], begins, "right") - 1]
    number = np.arange(len(begins)) - np.searchsorted(begins, starts[rows])
    chunk = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.r_[begins, stops[-1:]] + base), data) if len(begins) else pa.array([], pa.large_string())
    take = pa.array(rows)
    return [k.take(take) for k in keys], pa.array(number.astype(np.int32)), chunk.cast(pa.string())


def repair(ids: np.ndarray, joins: np.ndarray, ends: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts from those of their chunks, and the texts' new ends.

    ``ids``: those of all chunks of all texts, in order; ``joins``: where a
    chunk of the same text follows another; ``ends``: where texts end.
    """
    if not len(joins):
        return ids, ends
    _, blank, visible = token_facts(path)
    agrees = np.zeros(len(ids) + 1, bool)
    agrees[1:-1] = visible[ids[:-1]] & blank[ids[1:]]
    agrees[0] = agrees[ends] = True
    agree = np.flatnonzero(agrees)
    after = np.searchsorted(agree, joins[~agrees[joins]])
    after = after[np.diff(after, prepend=-1) != 0]
    left, right = agree[after - 1], agree[after]
    of = encoder(path).decode_bytes
    fresh = [ids_of(of(ids[a:z].tolist()).decode("utf-8", "replace"), path).astype(ids.dtype) for a, z in zip(left.tolist(), right.tolist(), strict=True)]
    kept = np.split(ids, np.ravel(np.column_stack([left, right])))
    out = [x for pair in zip(kept[0::2], [*fresh, ids[:0]], strict=True) for x in pair]
    grown = np.r_[0, np.cumsum([len(f) for f in fresh] - (right - left))]
    return np.concatenate(out), ends + grown[np.searchsorted(right, ends, "right")]


def _repaired(parts: list[np.ndarray], path: str) -> np.ndarray:
    """The ids of one text from those of its chunks."""
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return repair(ids, np.cumsum([len(p) for p in parts], dtype=np.int64)[:-1], np.array([len(ids)]), path)[0]


def _wide(path: str) -> bool:
    return len(token_facts(path)[0]) > 1 << 16


def _packed(rows: list[np.ndarray], path: str) -> pa.Array:
    """Ids as bytes, two each where the vocabulary allows it."""
    ends = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    kind = np.dtype(np.uint32 if _wide(path) else np.uint16)
    flat = np.concatenate([np.zeros(0, kind), *rows]).astype(kind)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends * kind.itemsize), pa.py_buffer(flat)]).cast(pa.binary())


def _direct(documents: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """``key`` and ``ids`` of every row, each text encoded whole where it is."""
    rows = documents.select(F.col(key).alias(key), F.col(text).alias("_text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([ids_of(t, path) for t in texts_of(b.column(1))], pa.int32())], [key, "ids"])

    return rows.mapInArrow(encoded, _ids_schema(rows.schema[key].dataType, key))


def _ids_schema(kind: T.DataType, key: str) -> T.StructType:
    return T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])


def _in_files(documents: DataFrame, *columns: str) -> DataFrame:
    """The columns as rows of Parquet files: as they are if ``documents`` is a table of such files, else written to the shared folder."""
    rows = documents.select(*columns)
    if documents._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return written(rows, "documents")
    try:
        rows.select("_metadata.row_index")
    except AnalysisException:
        return written(rows, "documents")
    return rows


def sharing(rows: DataFrame, text: str, bits: int = CUT_BITS) -> DataFrame:
    """The places of the documents with a chunk that occurs more than once in the corpus, by the chunks' digests."""
    placed = rows.where(F.col(text) != "").select(*dedup.file_name(), dedup.row_index(), F.col(text).alias("_text"))
    names = ["_tm_h", "_tm_g", "_tm_row"]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, _, chunks = _chunked([b.column(i) for i in range(3)], b.column(3), bits)
            ids = [hashlib.md5(c.as_py(), usedforsecurity=False).digest() for c in chunks.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*places, pa.array(ids, pa.binary())], [*names, "chunk_id"])

    schema = T.StructType([*(T.StructField(n, T.LongType()) for n in names), T.StructField("chunk_id", T.BinaryType())])
    cut = written(placed.mapInArrow(digests, schema), "digests")
    # a chunk of a third of all documents is one row a split here, and its rows are split again in the join
    again = cut.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk_id")
    return cut.join(again, "chunk_id", "left_semi").select(*names).distinct()


def encode_corpus(documents: DataFrame, key: str, text: str, path: str | None = None, bits: int = CUT_BITS) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row of ``documents``, each chunk that documents share encoded once.

    NULL and empty texts have an empty list.  Rows may repeat and keys may be
    NULL or have several texts: every row gets the ids of its own text.  A
    chunk that occurs in a third of all documents is one row of the chunks'
    dictionary; where it makes the join back skewed, adaptive execution
    splits that partition.
    """
    path = path or vocabulary_path()
    rows = _in_files(documents, key, text)
    files = rows.inputFiles()
    if not files:
        return _direct(rows, key, text, path)
    vectors = dedup.store_vectors(rows.sparkSession, dedup.deletion_vectors(sharing(rows, text, bits)), len(files))
    alone = dedup.apply_vectors(rows.sparkSession, rows.schema, files, vectors)
    shared = dedup.apply_vectors(rows.sparkSession, rows.schema, files, vectors, deleted=True)
    return _direct(alone, key, text, path).unionByName(encode_shared(shared, key, text, path, bits))


def encode_shared(documents: DataFrame, key: str, text: str, path: str, bits: int = CUT_BITS) -> DataFrame:
    """:func:`encode_corpus` of documents whose texts aren't empty, with all their chunks in the dictionary."""
    rows = documents.select(F.col(key).alias("key"), F.unhex(F.md5(F.col(text))).alias("digest"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, number, chunk = _chunked([b.column(0), b.column(1)], b.column(2), bits)
            yield pa.RecordBatch.from_arrays([*keys, number, chunk], ["key", "digest", "number", "chunk"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _packed([ids_of(t, path) for t in texts_of(b.column(1))], path)], ["chunk_id", "packed"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(np.uint32 if _wide(path) else np.uint16)
        for b in batches:
            lists = b.column(1)
            first = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
            parts = lists.flatten()
            number, packed = parts.field("number").to_numpy(zero_copy_only=False), parts.field("packed")
            text = np.repeat(np.arange(len(lists)), np.diff(first))
            # equal rows have their chunks as often as there are rows: each is used once here
            copies = np.bincount(text[number == 0], minlength=len(lists))
            once = (np.arange(len(text)) - first[text]) % copies[text] == 0
            if not once.all():
                text, packed = text[once], packed.take(pa.array(np.flatnonzero(once)))
            packed = packed.cast(pa.large_binary())
            bounds = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1]
            ids = np.frombuffer(packed.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(width)
            stops = (bounds[1:] - bounds[0]) // width.itemsize
            last = np.r_[text[1:] != text[:-1], True]
            ids, ends = repair(ids, stops[~last], stops[last], path)
            rows_ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids.astype(np.int32)))
            again = pa.array(np.repeat(np.arange(len(lists)), copies))
            yield pa.RecordBatch.from_arrays([b.column(0).take(again), rows_ids.take(again)], [key, "ids"])

    place = [T.StructField("key", kind), T.StructField("digest", T.BinaryType())]
    cut = rows.mapInArrow(chunks, T.StructType([*place, T.StructField("number", T.IntegerType()), T.StructField("chunk", T.StringType())]))
    cut = written(cut.withColumn("chunk_id", F.unhex(F.md5("chunk"))), "chunks")
    dictionary = cut.groupBy("chunk_id").agg(F.any_value("chunk").alias("chunk")).mapInArrow(encoded, T.StructType([T.StructField("chunk_id", T.BinaryType()), T.StructField("packed", T.BinaryType())]))
    parts = cut.select("key", "digest", "number", "chunk_id").join(dictionary, "chunk_id").groupBy("key", "digest").agg(F.array_sort(F.collect_list(F.struct("number", "packed"))).alias("parts"))
    return parts.select("key", "parts").mapInArrow(joined, _ids_schema(kind, key))
