"""Current state of a table from a feed of inserts, updates and deletes.

Each ordered run of operations on a key is a function from the row before to
the row after, and all such functions have one small form, the *patch*:

    (reset, ver, pos)   reset: a delete is among the operations;
                        ver, pos: the version and place of the row that the
                        operations after the last delete supply, or NULL

Composition of patches is associative, so an ordered run is cut into chunks,
each chunk is folded to a patch, and the chunks' patches are folded again.
Chunks are as wide as the root of the feed's length, so that neither level
has longer arrays than that, however hot a key is: of a feed of 10^10 offsets
10^5.  The last patch is applied to the base row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Orders (offsets) in a chunk at least.
CHUNK = 16


def _compose(first: Column, then: Column, or_equal: bool) -> Column:
    """The patch of ``first`` followed by ``then``."""
    newer = then["pos"].isNotNull() & (first["pos"].isNull() | (then["ver"] >= first["ver"] if or_equal else then["ver"] > first["ver"]))
    taken = then["reset"] | newer
    return F.struct(
        (first["reset"] | then["reset"]).alias("reset"),
        F.when(taken, then["ver"]).otherwise(first["ver"]).alias("ver"),
        F.when(taken, then["pos"]).otherwise(first["pos"]).alias("pos"),
    )


def _fold(ordered: Column, pos_type: str, or_equal: bool = False) -> Column:
    nothing = F.struct(F.lit(False).alias("reset"), F.lit(None).cast("double").alias("ver"), F.lit(None).cast(pos_type).alias("pos"))
    return F.aggregate(ordered, nothing, lambda a, x: _compose(a, x["patch"], or_equal))


def patches(changes: DataFrame, keys: Sequence[str], order: str, version: str, is_delete: str, place: str, tie: str | None = None, chunk: int | None = None, top: Column | None = None, or_equal: bool = False) -> DataFrame:
    """One patch per key: ``keys``, ``reset``, ``ver``, ``pos``.

    ``changes``: ``order`` (bigint, the feed's order within a key), ``version``
    (number), ``is_delete`` (boolean) and ``place`` (what names the row that a
    change supplies).  A change is taken if the key has no row or its version
    is greater than the row's (with ``or_equal``, not smaller: with or without
    it versions are a total order, so patches compose); a delete always counts
    and forgets the version.  Changes of equal order are ordered by ``tie`` (bigint), then by place.
    Changes without order come first, in chunks of their ties; without
    version they are left out unless they delete.  NULL keys are a key.

    Chunks are ``chunk`` orders wide, by default the root of ``top``, the
    greatest order (a scalar subquery over the feed's column, if possible;
    else over ``changes``).
    """
    kind = changes.schema[place].dataType.simpleString()
    at, by = F.col(order).cast("bigint"), F.coalesce(F.col(tie), F.lit(0)).cast("bigint") if tie else F.lit(0).cast("bigint")
    own = F.struct(
        F.col(is_delete).alias("reset"),
        F.when(~F.col(is_delete), F.col(version)).cast("double").alias("ver"),
        F.when(~F.col(is_delete), F.col(place)).alias("pos"),
    )
    usable = changes.where(F.col(is_delete) | F.col(version).isNotNull())
    if chunk is None:
        greatest = top if top is not None else usable.agg(F.max(at)).scalar()
        width = F.greatest(F.lit(CHUNK), F.ceil(F.sqrt(F.greatest(greatest, F.lit(0)) + 1.0))).cast("bigint")
    else:
        width = F.lit(chunk).cast("bigint")
    op = F.struct(F.coalesce(at, F.lit(-1)).alias("at"), by.alias("tie"), F.col(place).alias("place"), own.alias("patch"))
    rows = usable.select(*keys, F.coalesce(at, by).alias("_at"), at.isNotNull().alias("_known"), width.alias("_w"), op.alias("_op"))
    level = rows.select(*keys, "_known", F.expr("_at div _w").alias("_c"), "_op")
    chunks = level.groupBy(*keys, "_known", "_c").agg(F.array_sort(F.collect_list("_op")).alias("ops")).select(*keys, "_known", "_c", _fold(F.col("ops"), kind, or_equal).alias("patch"))
    whole = chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_known", "_c", "patch"))).alias("ops")).select(*keys, _fold(F.col("ops"), kind, or_equal).alias("patch"))
    return whole.select(*keys, "patch.*")


def apply_patches(patched: DataFrame, keys: Sequence[str], base: DataFrame | None = None, or_equal: bool = False) -> DataFrame:
    """The state after the patches: ``keys``, ``ver``, ``pos`` of every key that has a row.

    ``base`` has the same columns; its rows without a patch stay, and a
    patched row stays where the patch has no delete and no newer version.
    """
    if base is None:
        return patched.where("pos IS NOT NULL").select(*keys, "ver", "pos")
    b = base.select(*(F.col(k).alias(f"b_{k}") for k in keys), F.col("ver").alias("b_ver"), F.col("pos").alias("b_pos"))
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    j = patched.withColumn("_p", F.lit(True)).join(b, match, "full_outer")
    stays = F.col("_p").isNull() | (~F.col("reset") & F.col("b_pos").isNotNull() & (F.col("pos").isNull() | (F.col("ver") < F.col("b_ver") if or_equal else F.col("ver") <= F.col("b_ver"))))
    return j.select(
        *(F.when(F.col("_p").isNull(), F.col(f"b_{k}")).otherwise(F.col(k)).alias(k) for k in keys),
        F.when(stays, F.col("b_ver")).otherwise(F.col("ver")).alias("ver"),
        F.when(stays, F.col("b_pos")).otherwise(F.col("pos")).alias("pos"),
    ).where("pos IS NOT NULL")
