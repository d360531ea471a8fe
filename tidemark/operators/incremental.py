"""What the next run has to process: the difference of two versions of a log's table.

Logs come as plain files, so their positions are taken over once, into a
table of immutable files sorted by place (:class:`VersionedTable`), whose
manifest also names its *entries*: how many positions of which slice of
offsets a file holds, and up to which version.  The ledger's commits make the
version of that table that *is processed*: files none of which is processed
aren't part of it, and files that are processed in part have deletion vectors
over the rest.  The present version has all files, without vectors.  The
difference of the two manifests is what has to be processed: added files are
read whole, of files whose vectors differ only those rows, and of files that
are the same in both nothing.  Only for slices that commits cover in part
positions are compared with the commits' ranges.

The output table's commit holds the version of the log's table that went into
it, together with the rows (:func:`run_incrementally`): a run that dies before
it has done nothing, one that dies after it everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.records import LONG_MAX
from tidemark.operators.dedup import FILE, plain_name
from tidemark.session import input_splits, shuffle_partitions, written
from tidemark.sources.versioned import VersionedTable, run_incrementally

#: Offsets in a file of a log's manifest.
SLICE = 256
_PLACE = ["topic", "partition"]
ENTRIES = "path string, _tm_h bigint, _tm_g bigint, topic string, partition int, file bigint, records bigint, newest bigint"


def log_positions(deliveries: DataFrame) -> DataFrame:
    """``topic``, ``partition``, ``offset``, ``newest``: a row per position.

    ``deliveries`` has ``topic``, ``partition``, ``offset``, ``message`` and
    ``version``.  A message at a position exists from the smallest version of
    its rows there; the position has ``newest``, that of its latest message.
    Both steps aggregate before the shuffle.  Rows without topic, partition or
    offset are at no position.  A message without a version in any of its
    rows is newer than every run, so it stays to be processed.
    """
    placed = deliveries.where("topic IS NOT NULL AND partition IS NOT NULL AND offset IS NOT NULL")
    version = F.coalesce(F.col("version").cast("bigint"), F.lit(LONG_MAX))
    messages = placed.groupBy(*_PLACE, "offset", "message").agg(F.min(version).alias("version"))
    return messages.groupBy(*_PLACE, "offset").agg(F.max("version").alias("newest"))


def log_manifest(positions: DataFrame, size: int = SLICE) -> DataFrame:
    """``topic``, ``partition``, ``file``, ``records``, ``newest``: the files of the log at its present version."""
    return positions.groupBy(*_PLACE, F.expr(f"offset div {size}").alias("file")).agg(F.count(F.lit(1)).alias("records"), F.max("newest").alias("newest"))


def successful(state: Column) -> Column:
    """Whether a ledger row's state is a commit, in whatever spelling."""
    return F.lower(F.trim(state)) == "committed"


def commits(ledger: DataFrame) -> DataFrame:
    """The distinct non-empty ranges that successful runs committed, each with the newest version it had seen."""
    return (
        ledger.where(successful(F.col("state")) & (F.col("start_offset") < F.col("next_offset")) & F.col("last_batch").isNotNull())
        .groupBy(*_PLACE, "start_offset", "next_offset")
        .agg(F.max("last_batch").alias("version"))
    )


def processed_files(committed: DataFrame, manifest: DataFrame, size: int = SLICE) -> DataFrame:
    """``topic``, ``partition``, ``file``, ``version``: the newest commit that covers the whole file.

    A commit covers a range of files, which is cut into at most two blocks of
    2^n files for each n; a file meets the commits of its block for each n.
    So neither wide commits nor many overlapping ones multiply rows.
    """
    lo, hi = F.expr(f"CAST(ceil(start_offset / {size}D) AS BIGINT)"), F.expr(f"next_offset div {size}")
    whole = committed.select(*_PLACE, "version", lo.alias("lo"), hi.alias("hi")).where("lo < hi")
    # levels at which the range has a block: none is wider than the range
    whole = whole.select("*", F.explode(F.sequence(F.lit(0), F.expr("CAST(floor(log2(CAST(hi - lo AS DOUBLE))) AS INT) + 1"))).alias("level"))
    whole = whole.select(*_PLACE, "version", "level", F.expr("(lo + shiftleft(1L, level) - 1) div shiftleft(1L, level)").alias("a"), F.expr("hi div shiftleft(1L, level)").alias("b")).where("a < b")
    odd = F.array(F.when(F.col("a") % 2 == 1, F.col("a")), F.when(F.col("b") % 2 == 1, F.col("b") - 1))
    blocks = whole.select(*_PLACE, "level", "version", F.explode(odd).alias("block")).where("block IS NOT NULL").groupBy(*_PLACE, "level", "block").agg(F.max("version").alias("version"))
    # a file meets the blocks of the levels that there are
    levels = blocks.select("level").distinct()
    files = manifest.select(*_PLACE, "file").distinct().withColumn("levels", levels.agg(F.collect_list("level")).scalar()).select(*_PLACE, "file", F.explode("levels").alias("level")).withColumn("block", F.expr("shiftright(file, level)"))
    return files.join(blocks, [*_PLACE, "level", "block"]).groupBy(*_PLACE, "file").agg(F.max("version").alias("version"))


def processed_parts(committed: DataFrame, size: int = SLICE) -> DataFrame:
    """``topic``, ``partition``, ``file``, ``from``, ``to``, ``version``: the files that a commit covers in part (two at most)."""
    first, last = F.expr(f"start_offset div {size}"), F.expr(f"(next_offset - 1) div {size}")
    ends = committed.select(*_PLACE, "version", "start_offset", "next_offset", F.explode(F.array_distinct(F.array(first, last))).alias("file"))
    start = F.greatest(F.col("start_offset"), F.col("file") * size)
    stop = F.least(F.col("next_offset"), (F.col("file") + 1) * size)
    parts = ends.select(*_PLACE, "file", start.alias("from"), stop.alias("to"), "version").where(F.col("to") - F.col("from") < size)
    return parts.groupBy(*_PLACE, "file", "from", "to").agg(F.max("version").alias("version"))


def manifest_diff(manifest: DataFrame, committed: DataFrame, size: int = SLICE) -> DataFrame:
    """The log's manifest with ``processed`` (version of the newest commit over the whole file) and ``status``.

    ``current``: nothing to do; ``added``: no commit touches it; ``changed``:
    a part of it, or what was delivered since, is to be processed.
    """
    full = processed_files(committed, manifest, size).withColumnRenamed("version", "processed")
    touched = processed_parts(committed, size).select(*_PLACE, "file").distinct().withColumn("in_part", F.lit(True))
    joined = manifest.join(full, [*_PLACE, "file"], "left").join(touched, [*_PLACE, "file"], "left")
    status = F.when(F.col("processed") >= F.col("newest"), "current").when(F.col("processed").isNull() & F.col("in_part").isNull(), "added").otherwise("changed")
    return joined.select(*manifest.columns, "processed", status.alias("status"))


def take_over(log: VersionedTable, positions: DataFrame, size: int = SLICE) -> int:
    """``positions`` as a new version of ``log``: immutable files sorted by place, and their entries beside the manifest.

    The entries (``path``, ``topic``, ``partition``, ``file``: the slice,
    ``records``, ``newest``) are made from what was written.  The number of
    files follows the size of the input.
    """
    n = input_splits(positions)
    spread = [n] if n > shuffle_partitions(log.spark) else []
    added = log.write_files(positions.repartitionByRange(*spread, *_PLACE, "offset").sortWithinPartitions(*_PLACE, "offset"))
    entries = f"{log.path}/entries/{log.latest() + 1}"
    if added:
        placed = log.rows(added).withColumn("file", F.expr(f"offset div {size}"))
        placed.groupBy(F.col("_tm_path").alias("path"), *FILE, *_PLACE, "file").agg(F.count(F.lit(1)).alias("records"), F.max("newest").alias("newest")).write.mode("overwrite").parquet(entries)
    return log.commit(add=added, details={"entries": entries})


def commit_processed(log: VersionedTable, ledger: DataFrame, size: int = SLICE) -> tuple[int, int]:
    """The ledger's commits as versions of ``log``: what is processed, and on top of it the present; their numbers."""
    present = log.manifest()
    names = {plain_name(f): f for f in present.files}
    if not names:
        return log.commit(base=present.version), log.commit()
    entries = log.spark.read.schema(ENTRIES).parquet(present.details["entries"])
    committed = commits(ledger)
    status = written(manifest_diff(entries, committed, size), "status")
    # a row per file of the manifest, which the driver holds anyway
    files = status.groupBy("path", *FILE).agg(F.bool_and(F.col("status") == "added").alias("new"), F.bool_and(F.col("status") == "current").alias("done")).collect()
    new = [names[plain_name(r["path"])] for r in files if r["new"]]
    partly = {names[plain_name(r["path"])]: [r[c] for c in FILE] for r in files if not r["new"] and not r["done"]}
    vectors: dict[str, list] = {}
    if partly:
        rows = log.rows(list(partly)).withColumn("file", F.expr(f"offset div {size}"))
        # slices with something to do; no part of a commit meets an added one
        todo = status.where("status <> 'current'").select(*FILE, *_PLACE, "file", "processed")
        open_ = rows.join(todo, [rows[c] == todo[c] for c in (*FILE, *_PLACE, "file")]).where("processed IS NULL OR processed < newest").select(*(rows[c] for c in rows.columns))
        # at most SLICE positions and SLICE^2 / 2 distinct parts meet in a slice
        parts = processed_parts(committed, size).select(*_PLACE, "file", "from", "to", F.col("version").alias("v"))
        inside = [open_[c] == parts[c] for c in (*_PLACE, "file")] + [open_["offset"] >= parts["from"], open_["offset"] < parts["to"], parts["v"] >= open_["newest"]]
        vectors = log.mark(open_.join(parts, inside, "left_anti"), partly)
    before = log.commit(remove=new, vectors=vectors, base=present.version)
    return before, log.commit(add=new, vectors=dict.fromkeys(vectors), base=before)


def next_run(log: VersionedTable, out: VersionedTable, ledger: DataFrame, size: int = SLICE) -> int | None:
    """Write the positions that no successful run processed to ``out``, in one commit with the version of ``log``.

    Runs that failed, are unfinished or of unknown state processed nothing;
    nor did empty ranges.  An empty ledger gives every position, an empty log
    nothing.  Each position comes once, however often it was delivered.
    """
    before, _ = commit_processed(log, ledger, size)
    out.commit(processed={log.path: before})
    return run_incrementally(log, out, lambda deltas: deltas.where("change = 'added'"))
