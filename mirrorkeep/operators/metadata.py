"""Difference and merge of alias tables and configuration trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import scoped, shared_scope
from ..functions.naming import Rules, map_forward


def alias_diff(src: DataFrame, dst: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """What to do for each source alias: create, repoint or skip.

    Aliases are unique keys of both tables. The new target is the source target
    under the rename rules.
    """
    on = shared_scope(src, dst, "alias")
    target = map_forward(F.col("target"), rules)
    there = dst.select(*on, F.col("target").alias("dest_target"), F.lit(True).alias("there"))
    return (
        src.select(*scoped(src, "alias"), target.alias("new_target"))
        .join(there, on, "left")
        .select(
            *scoped(src, "alias"),
            "new_target",
            "dest_target",
            F.when(F.col("there").isNull(), "create")
            .when(F.col("dest_target").eqNullSafe(F.col("new_target")), "skip")
            .otherwise("repoint")
            .alias("op"),
        )
    )


def alias_merge(diff: DataFrame, dst: DataFrame) -> DataFrame:
    """The destination alias table after the operations; aliases only there stay."""
    on = shared_scope(diff, dst, "alias")
    changed = diff.select(*on, F.col("new_target").alias("target"))
    kept = dst.select(*on, "target").join(diff.select(*on), on, "left_anti")
    return changed.unionByName(kept)


def alias_verify(src: DataFrame, after: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Does each source alias exist at the destination, with the right target?"""
    return alias_diff(src, after, rules).select(
        *scoped(src, "alias"),
        F.when(F.col("op") == "skip", "ok")
        .when(F.col("op") == "create", "missing")
        .otherwise("wrong target")
        .alias("verdict"),
    )


def _fingerprint(data: Column) -> Column:
    """What stands for a node's data in a comparison, so the data itself is not shuffled."""
    return F.sha2(data.cast("binary"), 256)


def tree_diff(src: DataFrame, dst: DataFrame) -> DataFrame:
    """What to do for each source path: create, set, or nothing (``same``)."""
    on = shared_scope(src, dst, "path")
    have = dst.select(
        *on, _fingerprint(F.col("data")).alias("have"), F.lit(True).alias("there")
    )
    return (
        src.select(*scoped(src, "path"), _fingerprint(F.col("data")).alias("want"))
        .join(have, on, "left")
        .select(
            *scoped(src, "path"),
            F.when(F.col("there").isNull(), "create")
            .when(F.col("have").eqNullSafe(F.col("want")), "same")
            .otherwise("set")
            .alias("op"),
        )
    )


def tree_merge(src: DataFrame, dst: DataFrame) -> DataFrame:
    """The destination tree after the copy: every source path, and those only there.

    The data of the source side is passed on without a shuffle.
    """
    on = shared_scope(src, dst, "path")
    only_dst = dst.select(*on, "data").join(src.select(*on), on, "left_anti")
    return src.select(*on, "data").unionByName(only_dst)
