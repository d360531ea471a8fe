"""Queries on materialized tables: by key, range and secondary index."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.serdes import Codec
from tidemark.operators.stream import Expr, column
from tidemark.operators.tables import Table, expired


class UnknownStore(KeyError):
    pass


class UnknownIndex(KeyError):
    pass


class Store:
    """A table seen as a key-value store.

    Empty values (zero-length binary or text) count as missing.  With a time
    to live, rows are missing once it has passed since ``written``; a row
    with a time in the column ``expires`` (if there is one) is missing once
    that has passed.  Both are judged at the time of the query or at ``now``.

    Single changes (:meth:`put`) lie over the table in the driver's memory,
    one entry a key, and are one local table in the plan, however many there
    are; bulk changes belong to the table's own stream.
    """

    def __init__(self, name: str, df: DataFrame, ttl_ms: int | None = None, written: str = "timestamp", now: Column | None = None, changes: dict | None = None):
        self.name, self.rows, self.ttl_ms, self.written, self.now, self.changes = name, df, ttl_ms, written, now, dict(changes or {})

    def _now(self) -> Column:
        return self.now if self.now is not None else F.current_timestamp()

    @property
    def df(self) -> DataFrame:
        """The rows that are there now."""
        df = self.rows
        if self.changes:
            if self.ttl_ms is not None and self.written not in df.columns:
                raise ValueError(f"a time to live needs the column {self.written}")
            if "expires" not in df.columns:
                df = df.withColumn("expires", F.lit(None).cast("timestamp"))
            put = [tuple({"key": k, "value": v}.get(c) for c in df.columns) + (ms,) for k, (v, ms) in self.changes.items() if v is not None]
            new = df.sparkSession.createDataFrame(put, T.StructType([*(T.StructField(f.name, f.dataType) for f in df.schema), T.StructField("_tm_ms", T.LongType())]))
            after = F.timestamp_micros(F.unix_micros(self._now()) + F.col("_tm_ms") * 1000)
            new = new.withColumn("expires", F.when(F.col("_tm_ms").isNotNull(), after)).drop("_tm_ms")
            if self.written in df.columns:
                new = new.withColumn(self.written, self._now().cast(df.schema[self.written].dataType))
            df = df.where(~F.col("key").isin(list(self.changes))).unionByName(new)
        kind = df.schema["value"].dataType.typeName()
        there = F.col("value").isNotNull() & ((F.length("value") > 0) if kind in ("binary", "string") else F.lit(True))
        df = df.where(F.col("key").isNotNull() & there)
        if self.ttl_ms is not None:
            df = df.where(~expired(F.col(self.written), self.ttl_ms, self._now()))
        if "expires" in df.columns:
            df = df.where(F.col("expires").isNull() | (F.col("expires") > self._now()))
        return df

    @staticmethod
    def encoded(name: str, df: DataFrame, key: Codec, value: Codec, **options: object) -> Store:
        """A store over bytes; rows that don't decode are left out."""
        good = df.where(key.valid(F.col("key")) & value.valid(F.col("value")))
        return Store(name, good.withColumns({"key": key.decode(F.col("key")), "value": value.decode(F.col("value"))}), **options)

    def get(self, key: object) -> DataFrame:
        """The row of a key: one or none."""
        return self.df.where(F.col("key") == F.lit(key))

    def value(self, key: object) -> object:
        """The value of a key, or None."""
        row = self.get(key).first()
        return None if row is None else row["value"]

    def range(self, low: object, high: object) -> DataFrame:
        """The rows with low <= key <= high."""
        return self.df.where(F.col("key").between(F.lit(low), F.lit(high)))

    def scan(self, after: object | None = None, descending: bool = False) -> DataFrame:
        """All rows in the order of their keys, from a key on."""
        df = self.df
        if after is not None:
            df = df.where(F.col("key") <= F.lit(after) if descending else F.col("key") >= F.lit(after))
        return df.orderBy(F.col("key").desc() if descending else F.col("key"))

    def iterate(self, **options: object) -> Iterator[Row]:
        """The rows one by one; one partition at a time is in the driver's memory."""
        return self.scan(**options).toLocalIterator()

    def put(self, key: object, value: object, expiry_ms: int | None = None) -> Store:
        """A new store with the row set, for ``expiry_ms`` from the time of the query if given; None deletes."""
        return self._with(self.changes | {key: (value, expiry_ms)})

    def delete(self, key: object) -> Store:
        return self.put(key, None)

    def _with(self, changes: dict) -> Store:
        return Store(self.name, self.rows, self.ttl_ms, self.written, self.now, changes)

    def table(self) -> Table:
        return Table(self.df, self.name)


class IndexedStore(Store):
    """A store with named secondary indexes, functions of ``key`` and ``value``.

    An index is an expression, evaluated on the table's current rows, so an
    updated row is found under its new index value only.
    """

    def __init__(self, name: str, df: DataFrame, indexes: dict[str, Expr], **options: object):
        super().__init__(name, df, **options)
        self.indexes = dict(indexes)

    def _with(self, changes: dict) -> IndexedStore:
        return IndexedStore(self.name, self.rows, self.indexes, ttl_ms=self.ttl_ms, written=self.written, now=self.now, changes=changes)

    def index(self, name: str) -> Column:
        try:
            return column(self.indexes[name])
        except KeyError:
            raise UnknownIndex(name) from None

    def lookup(self, name: str, value: object) -> DataFrame:
        """The rows under an index value; none if nothing is there."""
        return self.df.where(self.index(name) == F.lit(value))

    def dump(self, name: str) -> DataFrame:
        """``index_key``, ``key``: the whole index, a row per entry. NULL index values aren't indexed."""
        return self.df.select(self.index(name).alias("index_key"), "key").where("index_key IS NOT NULL")


class Registry:
    """The stores of an application, by name."""

    def __init__(self) -> None:
        self._stores: dict[str, Store] = {}

    def register(self, store: Store) -> Store:
        if store.name in self._stores:
            raise ValueError(f"there is a store named {store.name}")
        self._stores[store.name] = store
        return store

    def replace(self, store: Store) -> Store:
        """A newer state of a store."""
        self.store(store.name)
        self._stores[store.name] = store
        return store

    def store(self, name: str) -> Store:
        try:
            return self._stores[name]
        except KeyError:
            raise UnknownStore(name) from None

    def stores(self) -> list[str]:
        return sorted(self._stores)

    def indexes(self, store: str | None = None) -> list[str]:
        some = [self.store(store)] if store else self._stores.values()
        return sorted({i for s in some for i in getattr(s, "indexes", ())})
