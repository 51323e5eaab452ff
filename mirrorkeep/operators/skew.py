"""Joins and numbering that hold when one key owns a large part of the rows.

Both helpers first measure the skew with one column-pruned scan and no shuffle
(a frequent-items sketch, merged on the way up). A key is hot when it holds more
than one shuffle partition's fair share, so there are never more hot keys than
shuffle partitions, and that is what bounds everything collected or broadcast
here. Without a hot key the plain Spark plan is returned unchanged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import materialize

# A key with fewer rows than this is never worth splitting.
MIN_ROWS_CONF = "mirrorkeep.skew.minRows"
MIN_ROWS_DEFAULT = "1000000"


@dataclass(frozen=True)
class HotKey:
    """Hash of a hot key, about how many rows it has, and the pieces to cut them into."""

    hash: int
    rows: int
    pieces: int


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def hot_keys(df: DataFrame, keys: list[str]) -> list[HotKey]:
    """The hot keys of a table: at most one per shuffle partition."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    floor = int(spark.conf.get(MIN_ROWS_CONF, MIN_ROWS_DEFAULT))
    tracked = min(1_000_000, max(1024, 16 * parts))
    row = (
        df.select(key_hash(keys).alias("h"))
        .agg(
            F.expr(f"approx_top_k(h, {min(parts, tracked)}, {tracked})").alias("top"),
            F.count(F.lit(1)).alias("total"),
        )
        .first()
    )
    share = max(row["total"] / parts, floor)
    return [
        HotKey(t["item"], t["count"], min(parts, math.ceil(t["count"] / share)))
        for t in row["top"] or []
        if t["count"] > share
    ]


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "left",
    weigh: DataFrame | None = None,
) -> DataFrame:
    """Equi-join of any table with one that has a single row per key.

    ``how`` is ``left``, ``inner``, ``left_semi`` or ``left_anti``. Rows of a hot
    key on the left are spread over several pieces by a hash of the whole row,
    and the one matching right row is repeated once per piece: at most two extra
    right rows per shuffle partition in total.

    The left keys are read once more to find the hot ones. Where the left table
    is the outcome of shuffles, ``weigh`` names a cheaper table with the same keys,
    for instance the one it was derived from. It only steers the cut.
    """
    for k in on:
        types = {df.schema[k].dataType for df in (left, right, weigh) if df is not None}
        if len(types) > 1:
            raise TypeError(f"key {k} has several types: {types}")
    hot = hot_keys(left if weigh is None else weigh, on)
    if not hot:
        return left.join(right, on, how)
    spark = left.sparkSession
    pieces = F.broadcast(
        spark.createDataFrame([(k.hash, k.pieces) for k in hot], "_hot long, _pieces int")
    )
    spread = [f.name for f in left.schema.fields if not _holds_map(f.dataType)]
    cut = (
        left.withColumn("_hot", key_hash(on))
        .join(pieces, "_hot", "left")
        .withColumn(
            "_piece",
            F.when(
                F.col("_pieces").isNotNull(),
                F.pmod(F.xxhash64(*spread), F.col("_pieces").cast("long")).cast("int"),
            ).otherwise(0),
        )
        .drop("_hot", "_pieces")
    )
    copies = (
        right.withColumn("_hot", key_hash(on))
        .join(pieces, "_hot", "left")
        .withColumn(
            "_piece",
            F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)),
        )
        .drop("_hot", "_pieces")
    )
    return cut.join(copies, on + ["_piece"], how).drop("_piece")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``row_number`` per group, for groups larger than one task should sort.

    A hot group is cut into ranges of its order columns, as many as it has pieces. Each
    range is numbered by itself and shifted by the rows in the ranges before it, which
    gives the same numbers as one window over the whole group.
    """
    hot = hot_keys(df, keys)
    if not hot:
        return df.withColumn(
            name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        )
    cut = with_range(df, keys, order, hot)
    # One row per range of a hot group, so a few per shuffle partition.
    shift = (
        cut.where("_cut")
        .groupBy(*keys, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_before",
            F.sum("_n").over(
                Window.partitionBy(*keys)
                .orderBy("_range")
                .rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_range", "_before")
    )
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    out = cut.withColumn("_own", own)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    same.append(out["_range"] == shift["_range"])
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return out.join(F.broadcast(shift), cond, "left").select(
        *df.columns,
        (F.col("_own") + F.coalesce("_before", F.lit(0))).cast("int").alias(name),
    )


def with_range(
    df: DataFrame, keys: list[str], order: list[str], hot: list[HotKey]
) -> DataFrame:
    """Add ``_cut``, is the row in a hot group, and ``_range``, its range there (else 0).

    The rows of the hot groups are range-partitioned by keys and order, equal ones spread by a random number, and a
    range is a partition. They are written out, so that every use sees the same ranges, also in a task that is run again.
    """
    is_hot = key_hash(keys).isin([k.hash for k in hot])
    ranges = max(2, sum(k.pieces for k in hot))
    cut = df.where(is_hot).withColumn("_tie", F.rand(7)).repartitionByRange(ranges, *keys, *order, "_tie")
    cut = cut.drop("_tie").withColumn("_cut", F.lit(True)).withColumn("_range", F.spark_partition_id())
    rest = df.where(~is_hot).withColumn("_cut", F.lit(False)).withColumn("_range", F.lit(0))
    return rest.unionByName(materialize(cut, "ranges"))


def _holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return _holds_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_holds_map(f.dataType) for f in dtype.fields)
    return False
