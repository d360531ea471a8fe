"""Running values per key in two levels, so that a hot key's rows don't all meet in one task.

Rows are scanned in stretches of a key's orders.  The last row of a stretch
has the stretch's own totals; those rows alone are shuffled by key to carry
values across stretches, and are joined back.  Where what is carried needs no
other columns than the rows themselves, the stretches are shuffled once and
both readings share that exchange: three exchanges in all, one of them of
whole rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import columns

#: Orders (offsets) of a key that are scanned in one task.
WIDTH = 1 << 20


def _stretched(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_tm_stretch", F.expr(f"`{order}` div {width}"))


def _joined(own: DataFrame, carry: DataFrame, keys: Sequence[str], nullable: bool) -> DataFrame:
    """Rows with their stretch's carry; the keys' plain equality keeps the rows' partitioning."""
    match = F.col("_tm_stretch") == F.col("_tm_k_s")
    for i, k in enumerate(keys):
        match = match & (F.col(k).eqNullSafe(F.col(f"_tm_k_{i}")) if nullable else F.col(k) == F.col(f"_tm_k_{i}"))
    return own.join(carry, match, "left")


def _names(keys: Sequence[str]) -> list[Column]:
    return [*(F.col(k).alias(f"_tm_k_{i}") for i, k in enumerate(keys)), F.col("_tm_stretch").alias("_tm_k_s")]


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    firsts: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    before: bool = False,
    width: int = WIDTH,
    nullable: bool = False,
) -> DataFrame:
    """``df`` with the running sum, last and first non-NULL value, and maximum of expressions per key in the order of ``order``.

    ``order`` is a bigint that is unique within a key.  ``before`` leaves the
    row itself out.  Rows are scanned in stretches of ``width`` orders of a
    key; one row per stretch carries the values across stretches.  Sums over
    nothing are 0.  No keys: all rows are one key.  With ``nullable`` NULL
    keys are a key; else they must not occur.
    """
    sums, lasts, firsts, maxes = sums or {}, lasts or {}, firsts or {}, maxes or {}
    kinds = [("s", sums, F.sum), ("l", lasts, lambda c: F.last(c, ignorenulls=True)), ("f", firsts, lambda c: F.first(c, ignorenulls=True)), ("m", maxes, F.max)]
    ordered = Window.partitionBy(*keys, "_tm_stretch").orderBy(order)
    whole, part = (ordered.rowsBetween(Window.unboundedPreceding, e) for e in (0, -1))
    own = _stretched(df, order, width).select(
        "*",
        *(f(c).over(whole).alias(f"_tm_w{t}_{n}") for t, some, f in kinds for n, c in some.items()),
        *(f(c).over(part).alias(f"_tm_p{t}_{n}") for t, some, f in kinds for n, c in some.items() if before),
        F.lead(F.lit(True)).over(ordered).alias("_tm_more"),
    )
    ahead = Window.partitionBy(*keys).orderBy("_tm_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carry = own.where("_tm_more IS NULL").select(*_names(keys), *(f(f"_tm_w{t}_{n}").over(ahead).alias(f"_tm_c{t}_{n}") for t, some, f in kinds for n in some))
    joined = _joined(own, carry, keys, nullable)
    mine = "p" if before else "w"
    nothing = F.lit(0)
    return joined.select(
        *columns(df),
        *((F.coalesce(F.col(f"_tm_{mine}s_{n}"), nothing) + F.coalesce(F.col(f"_tm_cs_{n}"), nothing)).alias(n) for n in sums),
        *(F.coalesce(f"_tm_{mine}l_{n}", f"_tm_cl_{n}").alias(n) for n in lasts),
        *(F.coalesce(f"_tm_cf_{n}", f"_tm_{mine}f_{n}").alias(n) for n in firsts),
        *(F.greatest(f"_tm_{mine}m_{n}", f"_tm_cm_{n}").alias(n) for n in maxes),
    )


def numbered(df: DataFrame, keys: Sequence[str], order: str, reset: Column, name: str, width: int = WIDTH, nullable: bool = False) -> DataFrame:
    """``df`` with each row's number under its key since the last earlier row for which ``reset`` is true, from 1; a column of that name is replaced."""
    ordered = Window.partitionBy(*keys, "_tm_stretch").orderBy(order)
    own = _stretched(df.withColumn("_tm_reset", F.coalesce(reset, F.lit(False))), order, width)
    own = own.select("*", F.row_number().over(ordered).cast("bigint").alias("_tm_n"), F.lead(F.lit(True)).over(ordered).alias("_tm_more"))
    at = F.when(F.col("_tm_reset"), F.col("_tm_n"))
    own = own.withColumn("_tm_at", F.last(at, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
    ahead = Window.partitionBy(*keys).orderBy("_tm_stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = own.where("_tm_more IS NULL").withColumn("_tm_base", F.coalesce(F.sum("_tm_n").over(ahead), F.lit(0)))
    carry = ends.select(*_names(keys), F.col("_tm_base"), F.last(F.col("_tm_base") + F.coalesce(at, F.col("_tm_at")), ignorenulls=True).over(ahead).alias("_tm_last"))
    joined = _joined(own, carry, keys, nullable)
    # rows behind a reset of their own stretch need nothing from the stretches before
    since = F.when(F.col("_tm_at").isNotNull(), F.col("_tm_n") - F.col("_tm_at")).otherwise(F.coalesce(F.col("_tm_base"), F.lit(0)) + F.col("_tm_n") - F.coalesce(F.col("_tm_last"), F.lit(0)))
    return joined.select(*columns(df.drop(name)), since.alias(name))
