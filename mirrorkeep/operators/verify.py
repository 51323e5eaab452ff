"""Checks of a destination against its source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import scoped, shared_scope
from ..functions.digest import table_digest
from ..functions.naming import Rules, map_forward
from ..functions.status import data_match, source_gate
from .inventory import exclude_default, shard_count
from .skew import lookup

STATUS = ("host", "core", "available", "num_docs", "version", "last_modified")


def shard_parity(src_inv: DataFrame, dst_inv: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Collections whose number of shards differs; a missing collection counts 0."""
    src = exclude_default(shard_count(src_inv)).select(
        *scoped(src_inv),
        map_forward(F.col("collection"), rules).alias("collection"),
        F.col("shards").alias("source_shards"),
    )
    dst = exclude_default(shard_count(dst_inv)).withColumnRenamed("shards", "dest_shards")
    on = shared_scope(src, dst, "collection")
    zero = F.lit(0).cast("long")
    return (
        src.join(dst, on, "full")
        .select(
            *on,
            F.coalesce("source_shards", zero).alias("source_shards"),
            F.coalesce("dest_shards", zero).alias("dest_shards"),
        )
        .where("source_shards <> dest_shards")
    )


def collection_size(contents: DataFrame) -> DataFrame:
    """Documents per collection."""
    return contents.groupBy(*scoped(contents, "collection")).agg(
        F.count(F.lit(1)).alias("docs")
    )


def size_parity(
    src_alias: DataFrame,
    dst_alias: DataFrame,
    src_size: DataFrame,
    dst_size: DataFrame,
    both_sides: bool = False,
) -> DataFrame:
    """Documents behind each destination alias on both clusters.

    The sizes are ``collection_size`` tables; an alias or collection the source does
    not have counts 0 there. ``both_sides`` also lists aliases only the source has.
    """
    src = _alias_size(src_alias, src_size, "source_docs").withColumn(
        "source_exists", F.lit(True)
    )
    dst = _alias_size(dst_alias, dst_size, "dest_docs")
    on = shared_scope(src, dst, "alias")
    zero = F.lit(0).cast("long")
    joined = dst.join(src, on, "full" if both_sides else "left")
    return joined.select(
        *on,
        F.coalesce("source_docs", zero).alias("source_docs"),
        F.coalesce("dest_docs", zero).alias("dest_docs"),
        F.coalesce("source_exists", F.lit(False)).alias("source_exists"),
    ).withColumn("match", F.col("source_docs") == F.col("dest_docs"))


def _alias_size(alias: DataFrame, size: DataFrame, name: str) -> DataFrame:
    """Many aliases may point at one collection, so its size is looked up."""
    size = size.select(
        *scoped(size), F.col("collection").alias("target"), F.col("docs").alias(name)
    )
    on = shared_scope(alias, size, "target")
    return lookup(alias, size, on).drop("target")


def match_data(pairs: DataFrame, source: str = "src_", replica: str = "dst_") -> DataFrame:
    """Add the data-match verdict to rows that hold both sides' status columns."""
    return pairs.select("*", *[c.alias(n) for n, c in data_match(source, replica).items()])


def post_copy_check(plan: DataFrame, src_status: DataFrame, dst_status: DataFrame) -> DataFrame:
    """Diagnostics of every copy request, from the status of both cores after the copy.

    The plan is a written table. The status tables have one row per collection and core, with the
    columns in ``STATUS``; the same core name in another collection is another core. A
    replica without any status is ``unverified``: it may answer queries, but its data
    was not compared. A request that had no source keeps its failure.
    """
    def side(status: DataFrame, prefix: str, collection: str, key: str) -> DataFrame:
        return status.select(
            *scoped(status),
            F.col("collection").alias(collection),
            F.col("core").alias(key),
            F.lit(True).alias(f"{prefix}there"),
            *[F.col(c).alias(prefix + c) for c in STATUS if c != "core"],
        )

    keys = scoped(plan, "dest_collection")
    tried = F.coalesce("ok", F.lit(True))
    refused = plan.where(~tried).select(
        *keys, F.col("dest_core").alias("entity"), "source_core", F.lit("failed").alias("status"), "reason"
    )
    plan = plan.where(tried)
    dst = side(dst_status, "dst_", "dest_collection", "dest_core")
    # What is not available is not compared: nothing else of it is sent along.
    dst = dst.withColumns({f"dst_{c}": F.when(F.col("dst_available"), F.col(f"dst_{c}")) for c in STATUS if c not in ("core", "available")})
    src = side(src_status, "src_", "collection", "source_core")
    # Each destination core occurs once; several may share a source core.
    joined = plan.select(*keys, "dest_core", "collection", "source_core").join(
        dst, shared_scope(plan, dst, "dest_collection", "dest_core"), "left"
    )
    joined = lookup(joined, src, shared_scope(joined, src, "collection", "source_core"), weigh=plan)
    joined = joined.withColumns({"dst_core": F.when(F.col("dst_there"), F.col("dest_core")), "src_core": F.when(F.col("src_there"), F.col("source_core"))})
    verdict = data_match("src_", "dst_")
    gate_ok, _, gate_reason = source_gate(F.col("dst_core"), F.col("dst_available"))
    status = F.when(F.col("dst_core").isNull(), "unverified").when(~gate_ok | ~verdict["ok"], "failed").otherwise("ok")
    reason = F.when(F.col("dst_core").isNull(), "no status of the replica").when(~gate_ok, gate_reason).otherwise(verdict["reason"])
    compared = joined.select(*keys, F.col("dest_core").alias("entity"), "source_core", status.alias("status"), reason.alias("reason"))
    return refused.unionByName(compared)


def diagnostics_summary(diagnostics: DataFrame, by: str = "status") -> DataFrame:
    """Number of cores per outcome."""
    return diagnostics.groupBy(*scoped(diagnostics, by)).agg(F.count(F.lit(1)).alias("cores"))


def content_digest(contents: DataFrame) -> DataFrame:
    """Documents of each collection and shard, and a digest of all their other columns."""
    by = scoped(contents, "collection", "shard")
    values = [F.col(c) for c in sorted(contents.columns) if c not in by]
    return contents.groupBy(*by).agg(
        F.count(F.lit(1)).alias("docs"), table_digest(*values).alias("digest")
    )


def content_parity(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Shards whose documents differ; both sides under destination names."""
    on = shared_scope(src, dst, "collection", "shard")
    a = content_digest(src).withColumnsRenamed({"docs": "source_docs", "digest": "source_digest"})
    b = content_digest(dst).withColumnsRenamed({"docs": "dest_docs", "digest": "dest_digest"})
    zero = F.lit(0).cast("long")
    return a.join(b, on, "full").select(
        *on,
        F.coalesce("source_docs", zero).alias("source_docs"),
        F.coalesce("dest_docs", zero).alias("dest_docs"),
        F.col("source_digest").eqNullSafe(F.col("dest_digest")).alias("same"),
    )


def smoke_test(parity: DataFrame, inv: DataFrame) -> DataFrame:
    """Size mismatches and unavailable cores as (check, entity, detail) rows, led by the scope both tables have."""
    scope = shared_scope(parity, inv)
    sizes = parity.where(~F.col("match")).select(
        *scope,
        F.lit("size").alias("check"),
        F.col("alias").alias("entity"),
        F.concat(
            F.lit("source "),
            F.col("source_docs").cast("string"),
            F.lit(", destination "),
            F.col("dest_docs").cast("string"),
        ).alias("detail"),
    )
    down = inv.where(~F.coalesce("available", F.lit(False))).select(
        *scope,
        F.lit("health").alias("check"),
        F.col("core").alias("entity"),
        F.concat(F.lit("unavailable on "), F.coalesce("node", F.lit("unknown node"))).alias(
            "detail"
        ),
    )
    return sizes.unionByName(down)
