"""Configuration trees: folders of files, path tables and parent/child edges."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import materialize, scoped
from ..operators.skew import lookup


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root), data of every file of a folder."""
    base = root.rstrip("/")
    full = F.regexp_replace("path", "^file:/+", "/")
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(base)
        .select(
            F.regexp_replace(full, f"^.*?{_quoted(base)}", "").alias("path"),
            F.col("content").alias("data"),
        )
    )


def _quoted(text: str) -> str:
    return "\\Q" + text.split("://", 1)[-1] + "\\E"


def config_names(tree: DataFrame) -> DataFrame:
    """Names right below the configuration root."""
    name = F.split_part("path", F.lit("/"), F.lit(3))
    inside = F.startswith("path", F.lit("/configs/")) & (name != "")
    return tree.where(inside).select(*scoped(tree), name.alias("config")).distinct()


def tree_paths(tree: DataFrame) -> DataFrame:
    """Every node on the way to every path: full path, parent, label, depth, data size.

    ``tree`` has path and data. Inner nodes without data of their own have no size.
    """
    scope = scoped(tree)
    parts = F.split("path", "/")
    # Prefix i of the path joins its first i + 1 parts, the first being empty.
    steps = F.sequence(F.lit(1), F.size(parts) - 1)
    at = tree.select(
        *scope,
        "path",
        F.octet_length("data").alias("bytes"),
        F.explode(steps).alias("depth"),
    )
    nodes = (
        at.withColumn("node", F.expr("substring_index(path, '/', depth + 1)"))
        .groupBy(*scope, "node", "depth")
        .agg(F.max(F.when(F.col("node") == F.col("path"), F.col("bytes"))).alias("bytes"))
    )
    label = F.substring_index("node", "/", -1)
    cut = F.length("node") - F.length(label) - 1
    return nodes.select(
        *scope,
        F.col("node").alias("path"),
        F.when(cut > 0, F.substr("node", F.lit(1), cut)).otherwise("/").alias("parent"),
        label.alias("label"),
        "depth",
        F.col("bytes").cast("long").alias("bytes"),
    )


def _keys(table: DataFrame, name: str) -> list:
    """Scope columns and one more, named so that they can be joined with."""
    return [*scoped(table), name]


def orphans(edges: DataFrame) -> DataFrame:
    """Nodes whose parent is not in the table of their cluster: they have no path, and neither has anything below them."""
    there = edges.select(*scoped(edges), F.col("id").alias("parent_id")).distinct()
    return edges.where(F.col("parent_id").isNotNull()).join(there, _keys(edges, "parent_id"), "left_anti")


def paths_from_edges(edges: DataFrame) -> DataFrame:
    """Full path of every node of a parent/child table that hangs on a root.

    ``edges`` has id, parent_id (null at the root) and label; ids are unique within a cluster and snapshot. Each round joins the
    path known so far with the path of its topmost node, so the known part doubles and a tree of any depth takes as many
    rounds as its depth has bits. The table of a round is written out, as the next round uses it twice. Nodes
    below one that is missing have no row; ``orphans`` lists where they are cut off. A cycle raises: after
    as many rounds as the number of rows has bits, no path can be unfinished.
    """
    scope = scoped(edges)
    known = edges.select(*scope, "id", F.col("parent_id").alias("up"), F.concat(F.lit("/"), "label").alias("path"))
    rounds = math.ceil(math.log2(max(2, edges.count()))) + 1
    for _ in range(rounds):
        if known.where("up is not null").isEmpty():
            break
        above = known.select(*scope, F.col("id").alias("up"), F.col("up").alias("next_up"), F.col("path").alias("above"))
        # A root is done; any other node goes on only if its topmost one is there.
        done = known.where("up is null")
        open_nodes = lookup(known.where("up is not null"), above, [*scope, "up"], "inner")
        joined = open_nodes.select(*scope, "id", F.col("next_up").alias("up"), F.concat("above", "path").alias("path"))
        known = materialize(done.unionByName(joined), "tree-paths")
    if not known.where("up is not null").isEmpty():
        raise ValueError("the tree has a cycle")
    return known.select(*scope, "id", "path")
