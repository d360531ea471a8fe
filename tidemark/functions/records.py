"""Column functions for record envelopes: identities, keys, payload checks, times.

All are built-in expressions, so they stay inside whole-stage code generation
and their inputs are pruned at the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG_MAX = 9223372036854775807
#: Payload times below this are epoch seconds, the others epoch milliseconds.
SECONDS_BELOW = 1e11


def canonical_uuid(text: Column) -> Column:
    """The 16 bytes of a UUID in any text form; NULL for NULL, all zeros and text that is no UUID.

    Accepted: any letter case, with or without hyphens, in braces, after
    ``urn:uuid:``, with blanks around.
    """
    s = F.lower(F.trim(text))
    s = F.when(s.startswith("urn:uuid:"), F.substring(s, 10, 64)).otherwise(s)
    s = F.translate(s, "{}-", "")
    return F.when((F.length(s) == 32) & (s != F.lit("0" * 32)), F.unhex(s))


def account_number(key: Column) -> Column:
    """The account number of a decimal key: an optional ``+``, then only digits; else NULL.

    Numbers beyond the range of bigint are NULL.
    """
    s = key.cast("string")
    return F.when(s.rlike(r"\A\+?[0-9]+\z"), s.try_cast("bigint"))


def account_key_text(key: Column) -> Column:
    """The plain decimal text of a readable account key (no sign, no leading zeros), of any length; else NULL."""
    s = key.cast("string")
    return F.when(s.rlike(r"\A\+?[0-9]+\z"), F.regexp_replace(s, r"\A\+?0*(?=[0-9])", ""))


def uuid_key_text(key: Column) -> Column:
    """The lower-case text of a readable uuid key (8-4-4-4-12 hex digits in any letter case); else NULL."""
    s = F.lower(key.cast("string"))
    return F.when(s.rlike(r"\A[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\z"), s)


#: Options of from_json that leave only JSON by the standard.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}
_END = "␂end"


def strict_json(value: Column, schema: str | T.StructType) -> Column:
    """``value`` read as one JSON object of ``schema``; NULL unless the whole text is one valid object.

    ``from_json`` alone stops after the first token tree, unpacks one-element
    arrays, keeps what precedes an error and turns broken text into a struct
    of NULLs.  So the text is read, once, as the first element of an array
    whose second one ends it: text that is cut off or goes on breaks the
    array or isn't followed by that end.  Members of another type than the
    schema's are NULL; of a repeated member the last counts.
    """
    members = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    text = F.concat(F.lit("["), value.cast("string"), F.lit(f',{{"{_END}":1}}]'))
    read = F.from_json(text, T.ArrayType(T.StructType([*members, T.StructField(_END, T.IntegerType())])), STRICT)
    first = F.get(read, 0)
    whole = (F.size(read) == 2) & (F.get(read, 1)[_END] == 1) & first.isNotNull()
    return F.when(whole, F.struct(*(first[m.name].alias(m.name) for m in members)))


def payload_time(number: Column) -> Column:
    """A payload time (double) in milliseconds: below SECONDS_BELOW it is in seconds."""
    return F.when(number < SECONDS_BELOW, number * 1000).otherwise(number)


def payload_ms(number: Column) -> Column:
    """A payload time (double) in whole epoch milliseconds; NULL where missing or beyond the range of bigint."""
    ms = payload_time(number)
    return F.when((ms >= -(2.0**63)) & (ms < 2.0**63), F.floor(ms))


def utc_instant(column: Column) -> Column:
    """The instant of a timestamp without time zone that is meant in UTC, whatever the session's time zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), column).cast("timestamp")


def floor_to(ms: Column, step: int) -> Column:
    """The start of the step that holds ``ms``; exact for times before 1970, too; NULL where no bigint has it."""
    return F.try_subtract(ms, F.pmod(ms, F.lit(step)))


def header(headers: Column, name: str) -> Column:
    """The value of the first header of that name; NULL if there is none or no headers."""
    return F.get(F.filter(headers, lambda h: h["key"] == name), 0)["value"]


def record_id(topic: Column, partition: Column, offset: Column) -> Column:
    """``topic_partition_offset``, the identity of a record in its log."""
    return F.concat_ws("_", topic, partition, offset)


def message_identity(log: str) -> list[Column]:
    """Grouping columns of a message: its uuid, or its position where it has none.

    ``log`` keeps apart the messages of different logs.
    """
    known = canonical_uuid(F.col("uuid"))
    alone = known.isNull()
    return [
        F.lit(log).alias("m_log"),
        known.alias("m_uuid"),
        F.when(alone, F.col("topic")).alias("m_topic"),
        F.when(alone, F.col("partition")).alias("m_partition"),
        F.when(alone, F.col("offset")).alias("m_offset"),
    ]


IDENTITY = ["m_log", "m_uuid", "m_topic", "m_partition", "m_offset"]
