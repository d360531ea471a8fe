"""Keyed streams: one pipeline definition for static and streaming DataFrames.

A stream is a DataFrame with ``key``, ``value`` and the columns of the record
envelope.  Functions of a record are Columns or SQL strings over those
columns, so Catalyst sees through them; a Python function of pandas Series
is the fallback.

A record for which a function fails is dropped and goes to the error rows: it
never stops the stream.  A Python function that raises for a batch is called
again row by row, and the rows for which it raises have failed.  Columns and
SQL strings are analyzed so that nothing in them raises; where one of them
*can* fail (has a cast, a division, an index, ... that would raise by the SQL
standard) it has failed if it gives NULL for a record whose value isn't NULL.
Whole numbers that overflow wrap around.  What else counts as a failure is
said with ``fails``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.records import canonical_uuid
from tidemark.functions.serdes import Codec
from tidemark.plans.topology import Node

Expr = Column | str | Callable[..., pd.Series]
ENVELOPE = ("key", "value", "topic", "partition", "offset", "timestamp", "headers", "uuid")
ERRORS = ("stage", "topic", "partition", "offset", "reason")


def column(f: Expr, returns: str | None = None, inputs: Sequence[str] = ("key", "value")) -> Column:
    """A function of a record as a Column; Python functions get pandas Series and need ``returns``."""
    if isinstance(f, Column):
        return f
    if isinstance(f, str):
        return F.expr(f)
    if returns is None:
        raise TypeError("a Python function needs the type that it returns")
    return F.pandas_udf(f, returns)(*inputs)


def guarded(f: Callable[..., object], returns: str | None, inputs: Sequence[str] = ("key", "value")) -> Column:
    """A Python function of pandas Series as struct<failed, v>: rows for which it raises have failed; without ``returns`` it is called for its effect."""
    if returns is not None and not isinstance(returns, str):
        raise TypeError("the type that a Python function returns is given as DDL")

    kind = T.StructType.fromDDL(f"failed boolean, v {returns or 'boolean'}")

    def call(*series: pd.Series) -> pd.DataFrame:
        n = len(series[0])
        try:
            out = f(*series)
            if returns is None:
                return pd.DataFrame({"failed": [False] * n, "v": [None] * n})
            # a struct is given as a DataFrame; Spark wants its rows
            values = out.to_dict("records") if isinstance(out, pd.DataFrame) else list(pd.Series(out).array)
            if len(values) == n:
                return pd.DataFrame({"failed": [False] * n, "v": pd.Series(values, dtype=object if isinstance(out, pd.DataFrame) else pd.Series(out).dtype)})
        except Exception:  # noqa: BLE001 - whatever it raises, the row has failed
            pass
        failed, made = [], []
        for i in range(n):
            try:
                one = f(*(x.iloc[i : i + 1].reset_index(drop=True) for x in series))
                made.append(None if returns is None else one.to_dict("records")[0] if isinstance(one, pd.DataFrame) else pd.Series(one).iloc[0])
                failed.append(False)
            except Exception:  # noqa: BLE001
                made.append(None)
                failed.append(True)
        return pd.DataFrame({"failed": failed, "v": pd.Series(made, dtype=object)})

    return F.pandas_udf(call, kind)(*inputs)


@contextmanager
def lenient(spark: SparkSession) -> Iterator[None]:
    """What is analyzed inside gives NULL where the SQL standard raises."""
    before = spark.conf.get("spark.sql.ansi.enabled", "true")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def _is_python(f: Expr) -> bool:
    return not isinstance(f, (Column, str))


def _raises(spark: SparkSession, e: object) -> bool:
    """Whether an analyzed expression has a part that may raise; numbers that overflow don't count, they wrap around."""
    kind = e.getClass().getSimpleName()
    if kind == "Cast":
        to = e.dataType()
        own = to.typeName() != "string" and not spark._jvm.org.apache.spark.sql.catalyst.expressions.Cast.canUpCast(e.child().dataType(), to)
    elif kind in ("Add", "Subtract", "Multiply", "UnaryMinus", "Abs"):
        own = e.dataType().typeName().startswith("decimal")
    else:
        own = False
        for flag, raising in (("failOnError", "true"), ("evalMode", "ANSI")):
            try:
                own = own or str(getattr(e, flag)()).lower() == raising.lower()
            except Py4JError:  # expressions without that flag
                pass
    children = e.children()
    return own or any(_raises(spark, children.apply(i)) for i in range(children.size()))


def _can_fail(df: DataFrame, made: dict[str, Column]) -> tuple[DataFrame, bool]:
    """``df`` with columns that never raise, and whether one of them would by the standard."""
    strict = df.withColumns(made)
    with lenient(df.sparkSession):
        out = df.withColumns(made)
    before, after = (x._jdf.queryExecution().analyzed() for x in (strict, out))
    if before.sameResult(after):
        return out, False
    own = before.projectList()
    return out, any(_raises(df.sparkSession, own.apply(i)) for i in range(own.size() - len(made), own.size()))


def computed(df: DataFrame, new: dict[str, tuple[Expr, str | None]], failed: str = "_tm_failed") -> DataFrame:
    """``df`` with columns computed by functions of the record, and, if any of these can fail, whether one has."""
    at = {name: f"_tm_new_{i}" for i, name in enumerate(new)}
    plain = {at[name]: column(f) for name, (f, _) in new.items() if not _is_python(f)}
    python = {at[name]: guarded(f, returns) for name, (f, returns) in new.items() if _is_python(f)}
    out, bad = df, [F.col(c)["failed"] for c in python]
    if plain:
        out, some = _can_fail(df, plain)
        bad += [F.col(c).isNull() & F.col("value").isNotNull() for c, made in plain.items() if some and (len(plain) == 1 or _can_fail(df, {c: made})[1])]
    if python:
        out = out.withColumns(python)
    if bad:
        any_ = bad[0]
        for b in bad[1:]:
            any_ = any_ | b
        out = out.withColumn(failed, any_)
    return out.withColumns({name: F.col(c)["v"] if c in python else F.col(c) for name, c in at.items()}).drop(*at.values())


def decoded(df: DataFrame, key: Codec | None = None, value: Codec | None = None, reason: str = "_tm_bad") -> DataFrame:
    """Records with ``key`` and ``value`` decoded and the ``reason`` why one couldn't be (else NULL): good and bad ones in one pass."""
    codecs = {what: codec for what, codec in (("value", value), ("key", key)) if codec}
    made = df.withColumns({f"_tm_{what}": codec.decode(F.col(what)) for what, codec in codecs.items()})
    bad = F.lit(None).cast("string")
    for what in codecs:
        bad = F.when(F.col(what).isNotNull() & F.col(f"_tm_{what}").isNull(), F.lit(f"undecodable {what}")).otherwise(bad)
    marked = made.withColumn(reason, bad)
    return marked.withColumns({what: F.col(f"_tm_{what}") for what in codecs}).drop(*(f"_tm_{what}" for what in codecs))


def both_errors(left: KeyedStream, right: KeyedStream) -> DataFrame | None:
    """The error rows of two streams that become one."""
    if left.errors is None or right.errors is None:
        return right.errors if left.errors is None else left.errors
    return left.errors.unionByName(right.errors)


def _message(df: DataFrame) -> dict[str, Column]:
    """The columns by which :meth:`KeyedStream.deduplicate` knows the message of a record."""
    text = F.trim(F.col("uuid"))
    bare = F.translate(F.regexp_replace(F.lower(text), r"\Aurn:uuid:", ""), "{}-", "")
    known = F.coalesce(F.hex(canonical_uuid(text)), F.when(~bare.isin("", "0" * 32), text))
    place = [c for c in ("topic", "partition", "offset") if c in df.columns or c == "offset"]
    return {"_tm_uuid": known, **{f"_tm_{c}": F.when(known.isNull(), F.col(c)) for c in place}}


@dataclass(frozen=True)
class KeyedStream:
    """``errors``: what was dropped, (stage, topic, partition, offset, reason), or None; ``key_selected``: whether the key changed since the source."""

    df: DataFrame
    node: Node
    errors: DataFrame | None = None
    key_selected: bool = False

    @staticmethod
    def source(df: DataFrame, key: Codec | None = None, value: Codec | None = None, name: str = "source") -> KeyedStream:
        """A stream of records; with codecs ``key`` and ``value`` are decoded, and undecodable records are errors.

        A NULL key or value is no error (a NULL value is a tombstone).
        """
        stream = KeyedStream(df, Node("source", name))
        missing = [c for c in ("key", "value") if c not in df.columns]
        if missing:
            raise ValueError(f"a stream needs the columns key and value; missing: {missing}")
        if key is None and value is None:
            return stream
        marked = decoded(df, key, value)
        return replace(stream, df=marked.where("_tm_bad IS NULL").drop("_tm_bad"))._with_errors(marked.where("_tm_bad IS NOT NULL"), "source", F.col("_tm_bad"))

    def _with_errors(self, rows: DataFrame, stage: str, reason: Column) -> KeyedStream:
        have = set(rows.columns)
        kinds = {"topic": "string", "partition": "int", "offset": "bigint"}
        new = rows.select(F.lit(stage).alias("stage"), *((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()), reason.alias("reason"))
        return replace(self, errors=new if self.errors is None else self.errors.unionByName(new))

    def _next(self, df: DataFrame, kind: str, name: str, **changes: object) -> KeyedStream:
        return replace(self, df=df, node=Node(kind, name, (self.node,)), **changes)

    def _computed(self, new: dict[str, tuple[Expr, str | None]], fails: Expr | None, stage: str) -> tuple[DataFrame, KeyedStream]:
        """Rows with new columns; those for which ``fails`` is true or a function fails become errors of this stage."""
        for f, returns in new.values():
            if _is_python(f) and returns is None:
                raise TypeError("a Python function needs the type that it returns")
        marked = computed(self.df, new | ({"_tm_fails": (fails, "boolean")} if fails is not None else {}))
        bad = [F.coalesce(F.col(c), F.lit(False)) for c in ("_tm_failed", "_tm_fails") if c in marked.columns]
        if not bad:
            return marked, self
        any_ = bad[0] | bad[-1]
        return marked.where(~any_).drop("_tm_failed", "_tm_fails"), self._with_errors(marked.where(any_), stage, F.lit("function failed"))

    def filter(self, keep: Expr, name: str = "filter", fails: Expr | None = None) -> KeyedStream:
        """Records for which ``keep`` is true; NULL counts as false. The key stays as it is."""
        df, s = self._computed({"_tm_keep": (keep, "boolean")}, fails, name)
        return s._next(df.where("_tm_keep").drop("_tm_keep"), "filter", name)

    def map_values(self, value: Expr, name: str = "map_values", returns: str | None = None, fails: Expr | None = None) -> KeyedStream:
        """Another value under the same key."""
        df, s = self._computed({"value": (value, returns)}, fails, name)
        return s._next(df, "map_values", name)

    def map(self, key: Expr, value: Expr, name: str = "map", returns: tuple[str | None, str | None] = (None, None), fails: Expr | None = None) -> KeyedStream:
        """Another key and value, both computed from the record before."""
        df, s = self._computed({"key": (key, returns[0]), "value": (value, returns[1])}, fails, name)
        return s._next(df, "map", name, key_selected=True)

    def select_key(self, key: Expr, name: str = "select_key", returns: str | None = None, fails: Expr | None = None) -> KeyedStream:
        """Another key; what needs records by key shuffles when it comes to it, and not before."""
        df, s = self._computed({"key": (key, returns)}, fails, name)
        return s._next(df, "select_key", name, key_selected=True)

    def flat_map(self, values: Expr, name: str = "flat_map", returns: str | None = None) -> KeyedStream:
        """A record per element of an array of values."""
        return self._next(self.df.withColumn("value", F.explode(column(values, returns))), "flat_map", name)

    def peek(self, name: str | Observation = "peek", fails: Expr | None = None, effect: Callable[..., object] | None = None, **metrics: Column) -> KeyedStream:
        """The same records; ``metrics`` (aggregates) are observed under the name, or in the observation, when the query runs.

        ``effect`` is a Python function of the Series ``key`` and ``value``,
        called on the executors for what it does; records for which it raises
        are errors.  A task that is tried again calls it again.
        """
        stage = name if isinstance(name, str) else "peek"
        df, s = self._computed({}, fails, stage) if fails is not None else (self.df, self)
        if effect is not None:
            marked = df.withColumn("_tm_effect", guarded(effect, None))
            df, s = marked.where(~F.col("_tm_effect.failed")).drop("_tm_effect"), s._with_errors(marked.where("_tm_effect.failed"), stage, F.lit("function failed"))
        return s._next(df.observe(name, *(c.alias(m) for m, c in metrics.items())) if metrics else df, "process", stage)

    def branch(self, predicates: dict[str, Expr], name: str = "branch") -> dict[str, KeyedStream]:
        """A stream per predicate. A record goes to the first that is true, or nowhere; NULL counts as false."""
        chosen = F.lit(None).cast("string")
        for label, p in reversed(predicates.items()):
            chosen = F.when(F.coalesce(column(p, "boolean"), F.lit(False)), F.lit(label)).otherwise(chosen)
        with lenient(self.df.sparkSession):
            split = self._next(self.df.withColumn("_tm_branch", chosen), "branch", name)
        return {label: split._next(split.df.where(F.col("_tm_branch") == label).drop("_tm_branch"), "predicate", label) for label in predicates}

    def strict_siblings(self, filters: dict[str, Expr], name: str = "siblings") -> dict[str, KeyedStream]:
        """Filters as dependent siblings: a record reaches a filter only if all filters declared before it kept it."""
        out, passed = {}, F.lit(True)
        for label, p in filters.items():
            passed = passed & F.coalesce(column(p, "boolean"), F.lit(False))
            with lenient(self.df.sparkSession):
                out[label] = self._next(self.df.where(passed), "filter", f"{name}.{label}")
        return out

    def union(self, *others: KeyedStream, name: str = "union") -> KeyedStream:
        """Records of several streams of the same columns, as through one topic."""
        df, errors = self.df, self.errors
        for o in others:
            df = df.unionByName(o.df)
            errors = o.errors if errors is None else errors if o.errors is None else errors.unionByName(o.errors)
        return replace(self, df=df, errors=errors, node=Node("union", name, (self.node, *(o.node for o in others))), key_selected=any(x.key_selected for x in (self, *others)))

    def deduplicate(self, *by: str, within: str | None = None, name: str = "deduplicate") -> KeyedStream:
        """One record of those that agree in ``by`` (default: copies of one message).

        By default records are copies if their uuid is the same UUID in any
        text form, or the same other text; those whose uuid is NULL, blank or
        all zeros are copies only if topic, partition and offset agree (of
        these, the columns that there are; the offset must be).

        On a running query give ``within`` (as '2 hours'), for which copies
        are remembered by event time; without it they are remembered forever.
        For the first delivery in a log of wide records, see
        :mod:`tidemark.operators.dedup`.
        """
        own = {} if by else _message(self.df)
        columns, df = list(by) or list(own), self.df.withColumns(own) if own else self.df
        df = df.withWatermark("timestamp", within).dropDuplicatesWithinWatermark(columns) if within and df.isStreaming else df.dropDuplicates(columns)
        return self._next(df.drop(*own), "process", name)

    def windowed(self, length: str, slide: str | None = None, late: str | None = None, name: str = "windowed", **aggregates: Column) -> KeyedStream:
        """Aggregates per key and window of ``timestamp``: the value is the struct of window start and end (UTC) and the aggregates.

        On a running query ``late`` is how long a window waits for late
        records.  For corrections and per-source watermarks, see
        :mod:`tidemark.operators.late_events`.
        """
        df = self.df.withWatermark("timestamp", late) if late and self.df.isStreaming else self.df
        grouped = df.groupBy("key", F.window("timestamp", length, slide).alias("_tm_window")).agg(*(c.alias(n) for n, c in aggregates.items()))
        value = F.struct(F.col("_tm_window.start").alias("start"), F.col("_tm_window.end").alias("end"), *aggregates)
        return self._next(grouped.select("key", value.alias("value")), "window", name)

    def ordered(self, name: str = "ordered") -> KeyedStream:
        """Records in the order of partition and offset, for a sink that needs it (static streams): each task has a range of both, so a large partition is several tasks."""
        return self._next(self.df.repartitionByRange("partition", "offset").sortWithinPartitions("partition", "offset"), "process", name)

    def join_table(self, table: object, on: Expr | None = None, value: Expr | None = None, how: str = "inner", name: str = "join_table") -> KeyedStream:
        """See :func:`tidemark.operators.joins.join_table`."""
        from tidemark.operators.joins import join_table

        return join_table(self, table, on, value, how, name)

    def join_stream(self, right: KeyedStream, value: Expr | None = None, name: str = "join_stream") -> KeyedStream:
        """See :func:`tidemark.operators.joins.join_stream`."""
        from tidemark.operators.joins import join_stream

        return join_stream(self, right, value, name)

    def materialize(self, name: str = "materialize", **options: object) -> KeyedStream:
        """Values with their version under the key; see :func:`tidemark.operators.tables.materialize`."""
        from tidemark.operators.tables import materialize

        return self._next(materialize(self.df, **options), "materializer", name)
