"""Codecs between the bytes of a record and typed columns.

A codec decodes with built-in expressions: invalid bytes become NULL, never
an exception, so bytes that aren't NULL but decode to NULL are an error.
Decoding NULL gives NULL without error, since NULL is the tombstone.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.records import STRICT, strict_json


@dataclass(frozen=True)
class Codec:
    """The interface: ``decode`` bytes to a value, ``valid`` of bytes, ``encode`` a value to bytes."""

    def decode(self, data: Column) -> Column:
        raise NotImplementedError

    def encode(self, value: Column) -> Column:
        raise NotImplementedError

    def valid(self, data: Column) -> Column:
        return data.isNull() | self.decode(data).isNotNull()


@dataclass(frozen=True)
class IntCodec(Codec):
    """Whole numbers as decimal ASCII; also the 64-bit codec."""

    def decode(self, data: Column) -> Column:
        s = data.cast("string")
        return F.when(s.rlike(r"\A[+-]?[0-9]+\z"), s.try_cast("bigint"))

    def encode(self, value: Column) -> Column:
        return value.cast("bigint").cast("string").cast("binary")


@dataclass(frozen=True)
class StringCodec(Codec):
    """UTF-8 text; every byte string decodes."""

    def decode(self, data: Column) -> Column:
        return data.cast("string")

    def encode(self, value: Column) -> Column:
        return value.cast("string").cast("binary")


@dataclass(frozen=True)
class UuidCodec(Codec):
    """UUIDs as canonical lower-case text."""

    def decode(self, data: Column) -> Column:
        s = F.lower(F.trim(data.cast("string")))
        return F.when(s.rlike(r"\A[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\z"), s)

    def encode(self, value: Column) -> Column:
        return F.lower(value).cast("binary")


@dataclass(frozen=True)
class JsonCodec(Codec):
    """One JSON object of a fixed schema (DDL of its members)."""

    schema: str

    def decode(self, data: Column) -> Column:
        return strict_json(data, self.schema)

    def encode(self, value: Column) -> Column:
        return F.to_json(value).cast("binary")


@dataclass(frozen=True)
class UnionCodec(Codec):
    """A JSON object whose member ``tag`` names its schema; unknown tags are invalid.

    Decodes to a struct with one member per kind, of which that of the
    record's kind is set, and the kind itself.
    """

    kinds: Mapping[str, str]
    tag: str = "type"

    def _merged(self) -> T.StructType | None:
        """One schema for all kinds, or None where a member has several types."""
        members: dict[str, T.DataType] = {self.tag: T.StringType()}
        for schema in self.kinds.values():
            for m in T.StructType.fromDDL(schema):
                if members.setdefault(m.name, m.dataType) != m.dataType:
                    return None
        return T.StructType([T.StructField(n, t) for n, t in members.items()])

    def decode(self, data: Column) -> Column:
        """Read once where one schema holds all kinds, else twice: the tag, then what it names."""
        text, merged = data.cast("string"), self._merged()
        read = strict_json(text, merged if merged is not None else T.StructType([T.StructField(self.tag, T.StringType())]))
        kind, members = read[self.tag], []
        for name, schema in self.kinds.items():
            own = F.struct(*(read[n].alias(n) for n in T.StructType.fromDDL(schema).names)) if merged is not None else F.from_json(text, schema, STRICT)
            members.append(F.when(kind == name, own).alias(name))
        return F.when(kind.isin(*self.kinds), F.struct(kind.alias("kind"), *members))

    def encode(self, value: Column) -> Column:
        return F.coalesce(*(F.to_json(value[name]) for name in self.kinds)).cast("binary")


def http_time(seconds: Column) -> Column:
    """Epoch seconds as RFC 1123 text."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_seconds(seconds).cast("timestamp_ntz"))
    return F.date_format(utc, "EEE, dd MMM yyyy HH:mm:ss 'UTC'")
