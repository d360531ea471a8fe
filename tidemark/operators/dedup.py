"""Exactly one delivery of each message, without shuffling payloads.

Only the identifier, the order of delivery and the place of a row in its file
(file, row) are shuffled.  What loses becomes a deletion vector per file, and
the payloads are read once, in place: each task loads the vectors of the
files that it reads and nothing else, however many files and deletions there
are.  A file is named by 128 bits of the hash of its path.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.records import LONG_MAX
from tidemark.session import scratch_path

#: A deletion vector is stored as words of so many rows.
WORD = 64
VECTORS = "_tm_h bigint, _tm_g bigint, _tm_word bigint, _tm_mask bigint"
FILE = ["_tm_h", "_tm_g"]
#: Files, on average, whose vectors share a folder, and vectors that a task keeps.
FILES_A_FOLDER = 64
KEPT = 8


def file_name() -> list[Column]:
    """The columns that name the file of a row in a Parquet scan."""
    path = F.col("_metadata.file_path")
    return [F.xxhash64(path).alias("_tm_h"), F.xxhash64(path, F.lit(1)).alias("_tm_g")]


def row_index() -> Column:
    return F.col("_metadata.row_index").alias("_tm_row")


def positions(df: DataFrame, identity: Sequence[Column], order: Column, carry: Sequence[Column] = ()) -> DataFrame:
    """Identifier, order of delivery and file-row position of each row of a Parquet table."""
    return df.select(*identity, order.cast("bigint").alias("_tm_order"), *file_name(), row_index(), *carry)


def deletions(placed: DataFrame, identity: Sequence[str], unique_order: bool = False) -> DataFrame:
    """The rows of ``placed`` that are not the first delivery of their message.

    The first delivery is the row with the smallest ``_tm_order``; rows without
    an order come last, and ties go to one file (by its name's hash) and its
    first row, so that exactly one row stays.  NULL identifiers are one message like any other value.

    ``unique_order`` promises an order that is never NULL and never repeated
    over the whole input.  Winners are then found by a hash aggregate of two
    columns and losers by an anti-join on the order.  Both ways aggregate
    before the shuffle, so a message with a third of all rows reaches the
    shuffle as one row per input split, and the anti-join's key is unique.
    """
    if unique_order:
        winners = placed.groupBy(*identity).agg(F.min("_tm_order").alias("_tm_order")).select("_tm_order")
        return _without(placed, winners, ["_tm_order"])
    place = F.struct(F.coalesce("_tm_order", F.lit(LONG_MAX)).alias("o"), F.col("_tm_order").isNull().alias("n"), F.col("_tm_h").alias("f"), F.col("_tm_g").alias("g"), F.col("_tm_row").alias("r"))
    winners = placed.groupBy(*identity).agg(F.min(place).alias("w")).select(F.col("w.f").alias("_tm_h"), F.col("w.g").alias("_tm_g"), F.col("w.r").alias("_tm_row"))
    return _without(placed, winners, [*FILE, "_tm_row"])


def _without(placed: DataFrame, winners: DataFrame, on: list[str]) -> DataFrame:
    """An anti-join that isn't pushed below a union of logs, where each of them would meet all winners."""
    return placed.join(winners.withColumn("_tm_first", F.lit(True)), on, "left").where("_tm_first IS NULL").drop("_tm_first")


def deletion_vectors(lost: DataFrame) -> DataFrame:
    """Deletion vectors as words of files: bit i of ``_tm_mask`` stands for row 64 * ``_tm_word`` + i."""
    return (
        lost.select(*FILE, F.expr(f"_tm_row div {WORD}").alias("_tm_word"), F.expr(f"shiftleft(1L, CAST(_tm_row % {WORD} AS INT))").alias("_tm_bit"))
        .groupBy(*FILE, "_tm_word")
        .agg(F.bit_or("_tm_bit").alias("_tm_mask"))
    )


@dataclass(frozen=True)
class Stored:
    """Deletion vectors in the shared folder: ``path/b=<n>``, sorted by file and word, for tasks to look up."""

    path: str
    folders: int


def store_vectors(spark: SparkSession, vectors: DataFrame, n_files: int, path: str | None = None) -> Stored:
    """Write the vectors of a table of ``n_files`` files; small row groups, so that one file's words are read alone."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path or scratch_path(spark, "vectors"))
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    stored = Stored(whole, max(1, -(-n_files // FILES_A_FOLDER)))
    placed = vectors.withColumn("b", F.pmod("_tm_h", F.lit(stored.folders)))
    placed.repartition("b").sortWithinPartitions("b", *FILE, "_tm_word").write.partitionBy("b").option("parquet.block.size", 1 << 20).parquet(stored.path)
    return stored


def plain_name(uri: str) -> str:
    """A file's name without escapes; local ones come with one or three slashes after the scheme."""
    name = unquote(uri)
    return "/" + name[5:].lstrip("/") if name.startswith("file:") else name


@cache
def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path, for Python, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


_kept: OrderedDict = OrderedDict()


def _words(stored: Stored, h: int, g: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of a file, in order; kept in the Python worker while its task is at the file."""
    at = (stored.path, h, g)
    if at not in _kept:
        system, root = _file_system(stored.path)
        folder = f"{root}/b={h % stored.folders}"
        names = [i.path for i in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.path.endswith(".parquet")]
        if not names and system.get_file_info(root).type == fs.FileType.NotFound:
            raise FileNotFoundError(f"{stored.path} isn't shared with this executor")
        found = [pq.read_table(n, filesystem=system, columns=["_tm_word", "_tm_mask"], filters=[("_tm_h", "=", h), ("_tm_g", "=", g)], partitioning=None) for n in names]
        word, mask = (np.concatenate([np.zeros(0, np.int64), *(t[c].to_numpy() for t in found)]) for c in ("_tm_word", "_tm_mask"))
        order = np.argsort(word)
        _kept[at] = (word[order], mask[order].view(np.uint64))
        while len(_kept) > KEPT:
            _kept.popitem(last=False)
    return _kept[at]


def _deleted(stored: Stored) -> Column:
    """Whether the vectors delete a row: only its file's name and index go to Python, the other columns stay where they are."""

    def look_up(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for h, g, row in parts:
            hs, gs, rows = h.to_numpy(), g.to_numpy(), row.to_numpy()
            gone = np.zeros(len(rows), bool)
            starts = np.flatnonzero(np.r_[True, (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1])]) if len(rows) else np.zeros(0, np.int64)
            for a, z in zip(starts, np.r_[starts[1:], len(rows)]):
                word, mask = _words(stored, int(hs[a]), int(gs[a]))
                if len(word):
                    at = np.minimum(np.searchsorted(word, rows[a:z] // WORD), len(word) - 1)
                    bit = (mask[at] >> (rows[a:z] % WORD).astype(np.uint64)) & np.uint64(1)
                    gone[a:z] = (word[at] == rows[a:z] // WORD) & (bit == 1)
            yield pd.Series(gone)

    return F.pandas_udf(look_up, "boolean")(*FILE, "_tm_row")


def read_without(spark: SparkSession, path: str, vectors: DataFrame | Stored) -> DataFrame:
    """The rows of the Parquet table at ``path`` that ``vectors`` doesn't delete; see :func:`apply_vectors`."""
    table = spark.read.parquet(path)
    return apply_vectors(spark, table.schema, table.inputFiles(), vectors)


def apply_vectors(spark: SparkSession, schema: T.StructType, files: list[str], vectors: DataFrame | Stored, deleted: bool = False) -> DataFrame:
    """The rows of some Parquet files that their vectors leave (or, with ``deleted``, only those that they delete).

    Vectors that aren't stored yet are written once to the shared folder,
    which Python workers must be able to open by its URI.  The plan is one
    scan and one filter, of the same size however many files and vectors
    there are; nothing is broadcast, and no payload is shuffled or sent to
    Python.  Only where the shared folder is of a kind that Python can't open
    the rows are joined with the vectors.  Files without vectors are left as
    they are; no files give no rows.
    """
    if not files:
        return spark.createDataFrame([], schema)
    stored = vectors if isinstance(vectors, Stored) else store_vectors(spark, vectors, len(files))
    scan = spark.read.schema(schema).parquet(*map(unquote, files)).select("*", *file_name(), row_index())
    try:
        _file_system(stored.path)
    except (pa.ArrowException, OSError, ImportError):
        return _joined(scan, stored, deleted)
    gone = _deleted(stored)
    return scan.where(gone if deleted else ~gone).drop(*FILE, "_tm_row")


def _joined(scan: DataFrame, stored: Stored, deleted: bool) -> DataFrame:
    """The same by a join of the rows with the vectors' words."""
    words = scan.sparkSession.read.schema(VECTORS).parquet(stored.path).select(*FILE, "_tm_word", "_tm_mask")
    joined = scan.withColumn("_tm_word", F.expr(f"_tm_row div {WORD}")).join(words, [*FILE, "_tm_word"], "inner" if deleted else "left")
    gone = F.coalesce(F.expr(f"(shiftrightunsigned(_tm_mask, CAST(_tm_row % {WORD} AS INT)) & 1L) = 1L"), F.lit(False))
    return joined.where(gone if deleted else ~gone).drop(*FILE, "_tm_row", "_tm_word", "_tm_mask")
