"""Parquet tables with immutable version manifests, and runs that resume from them.

A version is one JSON manifest, ``_versions/<n>.json``, created atomically
and never changed: its data files, their deletion vectors and, of an output
table, the source versions that went into it.  A run reads what changed
between the source version named by its output's last manifest and the
present one, writes data files that nothing refers to yet, and commits them
together with the new source version in one manifest.  A run that dies before
that commit leaves no trace but unused files; one that dies after it has
nothing left to do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.dedup import FILE, VECTORS, Stored, apply_vectors, deletion_vectors, file_name, plain_name, row_index, store_vectors
from tidemark.sources.files import Files, NameTaken

VERSIONS = "_versions"


class CommitConflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass
class Manifest:
    """``files``: data file to its deletion vector (folder, number of folders in it, the file's name there) or None;
    ``processed``: source table to its version; ``details``: whatever else belongs to the version."""

    version: int
    files: dict[str, list | None]
    processed: dict[str, int] = field(default_factory=dict)
    details: dict[str, str] = field(default_factory=dict)


class VersionedTable:
    """A table folder on any Hadoop file system whose ``create`` without overwrite is atomic."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)
        self.schema = schema or self._schema()

    def _schema(self) -> T.StructType:
        """The schema stored with the table's first version."""
        text = self.files.text(f"{VERSIONS}/schema.json")
        if text is None:
            raise ValueError(f"{self.path} is no versioned table; give a schema to create one")
        return T.StructType.fromJson(json.loads(text))

    def _create(self, name: str, text: str) -> None:
        try:
            self.files.create(name, text)
        except NameTaken as e:
            raise CommitConflict(str(e)) from None

    def latest(self) -> int:
        """The newest version; 0 of a table without versions."""
        names = self.files.names(VERSIONS)
        return max([0, *(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())])

    def manifest(self, version: int | None = None) -> Manifest:
        """A version's manifest; version 0 is the empty table."""
        version = self.latest() if version is None else version
        if version == 0:
            return Manifest(0, {})
        text = self.files.text(f"{VERSIONS}/{version:012d}.json")
        if text is None:
            raise ValueError(f"{self.path} has no version {version}")
        return Manifest(version, **json.loads(text))

    def write_files(self, df: DataFrame) -> list[str]:
        """Data files with the rows of ``df``, not yet part of the table."""
        folder = f"data/{uuid.uuid4().hex}"
        df.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema)).write.parquet(f"{self.path}/{folder}")
        return self.files.paths(folder, ".parquet")

    def commit(self, add: list[str] | None = None, remove: list[str] | None = None, vectors: dict[str, list | None] | None = None, processed: dict[str, int] | None = None, base: int | None = None, details: dict[str, str] | None = None) -> int:
        """A new version on top of ``base`` (the latest); CommitConflict if another writer was faster."""
        old, gone = self.manifest(base), set(remove or ())
        files = {f: v for f, v in old.files.items() if f not in gone} | {f: None for f in add or ()}
        files |= {f: v for f, v in (vectors or {}).items() if f in files}
        if old.version == 0 and self.files.text(f"{VERSIONS}/schema.json") is None:
            self._create(f"{VERSIONS}/schema.json", self.schema.json())
        self._create(f"{VERSIONS}/{old.version + 1:012d}.json", json.dumps({"files": files, "processed": old.processed | (processed or {}), "details": old.details | (details or {})}))
        return old.version + 1

    def vacuum(self, keep: int = 2) -> int:
        """Delete the data files that none of the last ``keep`` versions has but the version before them had; how many."""
        newest = self.latest()
        if newest <= keep:
            return 0
        used = {f for v in range(newest - keep + 1, newest + 1) for f in self.manifest(v).files}
        gone = [f for f in self.manifest(newest - keep).files if f not in used]
        for f in gone:
            self.files.delete(f"data/{f.rpartition('/data/')[2]}")
        return len(gone)

    def append(self, df: DataFrame, processed: dict[str, int] | None = None) -> int:
        return self.commit(add=self.write_files(df), processed=processed)

    def rows(self, files: list[str]) -> DataFrame:
        """The rows of data files with their places: ``_tm_path``, the file's name as in vectors, and the row's index."""
        return self.spark.read.schema(self.schema).parquet(*files).select("*", F.col("_metadata.file_path").alias("_tm_path"), *file_name(), row_index())

    def mark(self, hit: DataFrame, files: dict[str, list], before: DataFrame | None = None) -> dict[str, list]:
        """New vectors over the rows ``hit`` (of :meth:`rows`), to be committed for ``files`` (with their names in vectors); ``before``: vectors that stay in force."""
        words = deletion_vectors(hit)
        if before is not None:
            words = words.unionByName(before).groupBy(*FILE, "_tm_word").agg(F.bit_or("_tm_mask").alias("_tm_mask"))
        stored = store_vectors(self.spark, words, len(files), f"{self.path}/vectors/{uuid.uuid4().hex}")
        return {f: [stored.path, stored.folders, *name] for f, name in files.items()}

    def delete_where(self, condition: str) -> int:
        """Mark rows as deleted by new deletion vectors; data files stay as they are."""
        old = self.manifest()
        if not old.files:
            return self.commit(base=old.version)
        hit = self.rows(list(old.files)).where(condition)
        # a row per file that is hit, of those of the manifest that the driver holds anyway
        names = {plain_name(r["_tm_path"]): [r[c] for c in FILE] for r in hit.select("_tm_path", *FILE).distinct().collect()}
        hits = {f: names[plain_name(f)] for f in old.files if plain_name(f) in names}
        return self.commit(vectors=self.mark(hit, hits, self._vectors(old.files)) if hits else None, base=old.version)

    def _vectors(self, files: dict[str, list | None]) -> DataFrame | None:
        """The words of these files' deletion vectors; a vectors folder may also hold words of other files."""
        folders: dict[str, list[list]] = {}
        for v in files.values():
            if v:
                folders.setdefault(v[0], []).append(v[2:])
        out = None
        for folder, names in folders.items():
            read = self.spark.read.schema(VECTORS).parquet(folder)
            own = read.select(*FILE, "_tm_word", "_tm_mask").where(F.col("_tm_h").isin([h for h, _ in names]) & F.col("_tm_g").isin([g for _, g in names]))
            out = own if out is None else out.unionByName(own)
        return out

    def _scan(self, files: dict[str, list | None]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        clean = [f for f, v in files.items() if not v]
        out = self.spark.read.schema(self.schema).parquet(*clean) if clean else None
        marked = {f: v for f, v in files.items() if v}
        if not marked:
            return out
        own = self._read_marked(marked)
        return own if out is None else out.unionByName(own)

    def _read_marked(self, files: dict[str, list], deleted: bool = False) -> DataFrame:
        """Rows of files with vectors: a scan for each commit that left vectors in force."""
        folders: dict[tuple, list[str]] = {}
        for f, v in files.items():
            folders.setdefault((v[0], v[1]), []).append(f)
        out = None
        for (path, n), names in folders.items():
            own = apply_vectors(self.spark, self.schema, names, Stored(path, n), deleted)
            out = own if out is None else out.unionByName(own)
        return out

    def read(self, version: int | None = None) -> DataFrame:
        return self._scan(self.manifest(version).files)

    def diff(self, old: int, new: int | None = None) -> DataFrame:
        """Record deltas from version ``old`` to ``new``: the table's columns and ``change`` ('added' or 'removed').

        Only files whose entry differs are read: added files give added rows,
        removed ones removed rows, files with another deletion vector the
        rows by which the vectors differ.
        """
        a, b = self.manifest(old).files, self.manifest(new).files
        added = {f: v for f, v in b.items() if f not in a}
        removed = {f: v for f, v in a.items() if f not in b}
        other = [f for f, v in b.items() if f in a and a[f] != v]
        out = self._scan(added).withColumn("change", F.lit("added")).unionByName(self._scan(removed).withColumn("change", F.lit("removed")))
        if other and not any(b[f] for f in other):
            # vectors that are no longer in force: what they deleted is there again
            out = out.unionByName(self._read_marked({f: a[f] for f in other}, deleted=True).withColumn("change", F.lit("added")))
        elif other:
            none = self.spark.createDataFrame([], VECTORS)
            before, after = (self._vectors({f: m[f] for f in other}) for m in (a, b))
            before, after = none if before is None else before, none if after is None else after
            for x, y, kind in ((after, before, "removed"), (before, after, "added")):
                rest = x.join(y.withColumnRenamed("_tm_mask", "_tm_old"), [*FILE, "_tm_word"], "left")
                words = rest.select(*FILE, "_tm_word", F.expr("_tm_mask & ~coalesce(_tm_old, 0L)").alias("_tm_mask")).where("_tm_mask <> 0")
                out = out.unionByName(apply_vectors(self.spark, self.schema, other, words, deleted=True).withColumn("change", F.lit(kind)))
        return out


def run_incrementally(source: VersionedTable, sink: VersionedTable, process: Callable[[DataFrame], DataFrame], name: str | None = None) -> int | None:
    """Process what changed in ``source`` since the sink's last commit; the sink's new version, or None if nothing did.

    ``process`` gets the deltas with their ``change`` column.  The sink's
    commit holds the source's version, so a repeated or resumed call neither
    skips nor repeats a record; of two concurrent calls one fails with
    CommitConflict.
    """
    name = name or source.path
    state = sink.manifest()
    now, done = source.latest(), state.processed.get(name, 0)
    if now == done:
        return None
    files = sink.write_files(process(source.diff(done, now)))
    return sink.commit(add=files, processed={name: now}, base=state.version)
