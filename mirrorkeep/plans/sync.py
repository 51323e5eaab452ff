"""Copy of aliases and configuration trees, and the full backup made of both jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import materialize, scoped, shared_dir, shared_scope
from ..functions.naming import Rules
from ..operators.metadata import alias_diff, alias_merge, alias_verify, tree_diff, tree_merge
from .clone import CloneResult, clone_collections


@dataclass(frozen=True)
class SyncResult:
    """Where the new table is, and a row per source entry: operation and verdict."""

    path: str | None
    diagnostics: DataFrame


def clone_aliases(
    src: DataFrame, dst: DataFrame, rules: Rules = Rules(), out: str | None = None
) -> SyncResult:
    """Create and repoint aliases; the new alias table is written, reread and checked.

    If every alias is right already, nothing is written.
    """
    spark = src.sparkSession
    diff = materialize(alias_diff(src, dst, rules), "alias-diff")
    keys = scoped(diff, "alias")
    if diff.where("op <> 'skip'").isEmpty():
        return SyncResult(None, diff.select(*keys, "op", F.lit("ok").alias("verdict")))
    merged = alias_merge(diff, dst)
    path = out or shared_dir(spark, "aliases")
    merged.write.parquet(path)
    after = spark.read.schema(merged.schema).parquet(path)
    verdict = alias_verify(src, after, rules)
    return SyncResult(path, diff.select(*keys, "op").join(verdict, keys))


def clone_tree(src: DataFrame, dst: DataFrame, out: str | None = None) -> SyncResult:
    """Copy a configuration tree: create or overwrite paths, delete none.

    The merged tree goes to a new place and is read back for the check.
    """
    spark = src.sparkSession
    merged = tree_merge(src, dst)
    path = out or shared_dir(spark, "tree")
    merged.write.parquet(path)
    after = spark.read.schema(merged.schema).parquet(path)
    keys = shared_scope(src, dst, "path")
    left = tree_diff(src, after).select(
        *keys, F.when(F.col("op") == "same", "ok").otherwise("failed").alias("verdict")
    )
    return SyncResult(path, tree_diff(src, dst).join(left, keys))


def full_backup(
    src_tree: DataFrame,
    dst_tree: DataFrame,
    src_inv: DataFrame,
    dst_inv: DataFrame,
    contents: DataFrame,
    strict: bool = False,
    **options,
) -> tuple[SyncResult, CloneResult, DataFrame]:
    """Configuration tree first, then all collections.

    The third value has a row per tree path and destination core, led by the scope both
    have. With ``strict`` any failure of either job ends in one error.
    """
    try:
        tree = clone_tree(src_tree, dst_tree)
        data = clone_collections(
            src_inv, dst_inv, contents, names=("all",), skip_failures=not strict, **options
        )
    except Exception as error:
        raise RuntimeError("cluster clone failed") from error
    scope = shared_scope(tree.diagnostics, data.diagnostics)
    rows = tree.diagnostics.select(
        *scope,
        F.lit("tree").alias("step"),
        F.col("path").alias("entity"),
        F.when(F.col("verdict") == "ok", "ok").otherwise("failed").alias("status"),
        F.col("op").alias("detail"),
    ).unionByName(
        data.diagnostics.select(
            *scope,
            F.lit("collection").alias("step"),
            F.col("dest_core").alias("entity"),
            "status",
            F.col("reason").alias("detail"),
        )
    )
    return tree, data, rows
