"""Which documents differ between two tables, found by trees of digests over ranges of hashed ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import materialize, scoped, shared_scope
from ..functions.digest import row_digest, table_digest

# Bits of the hashed id that tell the ranges of each level of a tree, from the root to the leaves.
LEVELS = (0, 6, 12)
# Columns of a table that is laid out by ranges of the same hash: how many bits, and the range.
BITS, PART = "bits", "part"
# Partitions that are named in a filter; more are left to the join.
MAX_LISTED = 10_000


def id_range(key: str, bits: Column | int) -> Column:
    """The range of an id: so many leading bits of its hash."""
    count = F.lit(bits) if isinstance(bits, int) else bits
    shifted = F.call_function("shiftrightunsigned", F.xxhash64(key), (F.lit(64) - count).cast("int"))
    # A shift by all 64 bits shifts by none.
    return F.when(count == 0, F.lit(0).cast("long")).otherwise(shifted)


def _values(contents: DataFrame) -> list[Column]:
    """What a document's digest covers: all but what says where it is."""
    out = {*scoped(contents, "collection", "shard"), BITS, PART}
    return [F.col(f"`{c}`") for c in sorted(contents.columns) if c not in out]


def range_tree(contents: DataFrame, key: str = "doc_id", levels: Sequence[int] = LEVELS) -> DataFrame:
    """collection, shard, level, node, docs, digest: documents and digest sum of every range of every level.

    Rows are digested and added up where they are read; only sums per leaf are shuffled. Keep a written tree beside a
    table to compare it again without reading the table.
    """
    by = scoped(contents, "collection", "shard")
    leaf = levels[-1]
    leaves = contents.groupBy(*by, id_range(key, leaf).alias("node")).agg(F.count(F.lit(1)).alias("docs"), table_digest(*_values(contents)).alias("digest"))
    up = F.array(*[F.struct(F.lit(b).alias("level"), F.shiftright("node", leaf - b).alias("node")) for b in levels])
    nodes = leaves.select(*by, F.explode(up).alias("at"), "docs", "digest")
    return nodes.groupBy(*by, "at.level", "at.node").agg(F.sum("docs").alias("docs"), F.sum("digest").cast("decimal(38,0)").alias("digest"))


def differing_ranges(src_tree: DataFrame, dst_tree: DataFrame, levels: Sequence[int] = LEVELS) -> DataFrame:
    """collection, shard, node: the leaves that differ, found from the root down.

    On each level only children of ranges that differ are compared; equal shards end at the root.
    """
    by = shared_scope(src_tree, dst_tree, "collection", "shard")
    before, opened = 0, None
    for level in levels:
        sides = []
        for tree in (src_tree, dst_tree):
            side = tree.where(F.col("level") == level).select(*by, "node", "docs", "digest")
            if opened is not None:
                side = side.withColumn("parent", F.shiftright("node", level - before))
                side = side.join(opened.withColumnRenamed("node", "parent"), [*by, "parent"], "left_semi").drop("parent")
            sides.append(side)
        a, b = sides
        both = a.join(b.withColumnsRenamed({"docs": "d_docs", "digest": "d_digest"}), [*by, "node"], "full")
        same = F.col("docs").eqNullSafe(F.col("d_docs")) & F.col("digest").eqNullSafe(F.col("d_digest"))
        opened, before = materialize(both.where(~same).select(*by, "node"), "differing"), level
    return opened


def _within(contents: DataFrame, leaves: DataFrame, key: str, leaf: int) -> DataFrame:
    """The documents in the given leaves. Of a table laid out by ranges only the partitions concerned are read."""
    by = shared_scope(contents, leaves, "collection", "shard")
    if BITS in contents.columns and PART in contents.columns:
        widths = F.explode(F.sequence(F.lit(0), F.lit(leaf)))
        parts = leaves.select("collection", "node", widths.alias("b"))
        named = parts.select(F.concat_ws("/", "collection", "b", F.expr(f"shiftright(node, {leaf} - b)")).alias("p")).distinct()
        listed = named.limit(MAX_LISTED + 1).collect()
        if len(listed) <= MAX_LISTED:
            # Layouts finer than the leaves are found by the leading bits of their ranges.
            width = F.least(F.col(BITS), F.lit(leaf))
            place = F.concat_ws("/", "collection", width, F.expr(f"shiftright({PART}, {BITS} - least({BITS}, {leaf}))"))
            contents = contents.where(place.isin([r["p"] for r in listed]))
    found = contents.withColumn("_node", id_range(key, leaf)).join(leaves.withColumnRenamed("node", "_node"), [*by, "_node"], "left_semi")
    return found.drop("_node")


def content_diff(
    src: DataFrame,
    dst: DataFrame,
    key: str = "doc_id",
    levels: Sequence[int] = LEVELS,
    src_tree: DataFrame | None = None,
    dst_tree: DataFrame | None = None,
) -> DataFrame:
    """collection, shard, key, op: the documents to ``add``, ``replace`` and ``remove`` at the destination.

    Both sides are under destination names and have the same columns. Trees that were kept are used, others are made. Documents are then
    read again in differing ranges only, and compared by id and digest. Rows that share an id in a shard are one document with several
    values, a null id is an id, and equal tables, also empty ones, give no rows.
    """
    src_tree = materialize(range_tree(src, key, levels), "tree") if src_tree is None else src_tree
    dst_tree = materialize(range_tree(dst, key, levels), "tree") if dst_tree is None else dst_tree
    by = shared_scope(src, dst, "collection", "shard")
    leaves = differing_ranges(src_tree, dst_tree, levels)

    def side(table: DataFrame, prefix: str) -> DataFrame:
        near = _within(table, leaves, key, levels[-1])
        rows = near.select(*by, F.col(key).alias("_key"), row_digest(*_values(table)).alias("_row"))
        return rows.groupBy(*by, "_key").agg(F.count(F.lit(1)).alias(f"{prefix}n"), F.sum("_row").alias(f"{prefix}d"))

    a, b = side(src, "a"), side(dst, "b").withColumnsRenamed({c: f"b_{c}" for c in [*by, "_key"]})
    on = a["_key"].eqNullSafe(b["b__key"])
    for c in by:
        on = on & a[c].eqNullSafe(b[f"b_{c}"])
    both = a.join(b, on, "full")
    same = F.col("an").eqNullSafe(F.col("bn")) & F.col("ad").eqNullSafe(F.col("bd"))
    at_src = F.col("an").isNotNull()
    return both.where(~same).select(
        *[F.when(at_src, a[c]).otherwise(b[f"b_{c}"]).alias(c) for c in by],
        F.when(at_src, a["_key"]).otherwise(b["b__key"]).alias(key),
        F.when(F.col("bn").isNull(), "add").when(F.col("an").isNull(), "remove").otherwise("replace").alias("op"),
    )
