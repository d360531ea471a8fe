"""Session construction and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: The planner's estimates from here on stand for no estimate.
UNKNOWN_BYTES = 1 << 60


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine relies on.

    UTC is required (event times are UTC instants); AQE sizes and splits the
    shuffle partitions at run time, so only their upper bound is set here.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing and the master is local (tests, single-node
    use) a folder of this machine is made and remembered in the context.  On
    a cluster without the setting this raises: a machine-local folder would
    lose data with its executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or getattr(context, "_tidemark_shared", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        context._tidemark_shared = folder
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: what is read several times is computed once, and later reads are pruned.

    It goes with the other intermediate tables (:func:`scratch_path`).
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the application's own folder in the shared one, which is deleted when the application ends."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _scratch_root(spark: SparkSession) -> str:
    root = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"
    if getattr(spark.sparkContext, "_tidemark_scratch", None) != root:
        at = spark._jvm.org.apache.hadoop.fs.Path(root)
        system = at.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(at)
        system.deleteOnExit(at)
        spark.sparkContext._tidemark_scratch = root
    return root


def clear_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables now: when the results that were read from them are no longer needed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    spark.sparkContext._tidemark_scratch = None


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def input_splits(df: DataFrame) -> int:
    """How many input splits the planner expects to read for ``df``, 1 where it knows nothing of the size; nothing is run for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    each = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes", "128m"))
    return 1 if size >= UNKNOWN_BYTES else max(1, -(-size // each))


_schemas: dict[tuple, T.StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder.

    Finding out a schema takes a job; it is kept with the path's time and
    length as they are now, so a table that changes is looked at again.
    """
    path = os.path.join(folder, f"{name}.parquet")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
    known = (path, status.getModificationTime(), status.getLen())
    if not known[1]:  # a store that keeps no times of folders
        return spark.read.parquet(path)
    if known not in _schemas:
        _schemas[known] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[known]).parquet(path)
