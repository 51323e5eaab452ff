"""Source peers of destination replicas, and the copy plan made from them."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import DEFAULT_COLLECTION, materialize, scoped, shared_scope
from ..functions.naming import (
    REPLICA_MARK,
    Rules,
    map_forward,
    map_reverse,
    replica_number,
    shard_key,
)
from ..functions.status import source_gate
from .inventory import collections, core_to_best, cores_by_collection, exclude_default
from .skew import hot_keys, lookup


def symmetry_table(src_inv: DataFrame, fallback: str = "first_two") -> DataFrame:
    """Per shard key, the source cores to fall back on, with their nodes.

    Replica 1 and 2 are told by the end of the core name. ``fallback='any'`` adds
    the lowest replica of all.
    """
    src = src_inv.withColumn("shard_key", shard_key(F.col("core")))
    # Of a repeated core the last row wins here too.
    picks = [
        F.max(
            F.when(
                F.col("core") == F.concat("shard_key", F.lit(f"{REPLICA_MARK}{i}")),
                F.struct("rn", "node", "core"),
            )
        ).alias(f"r{i}")
        for i in (1, 2)
    ]
    if fallback == "any":
        number = replica_number(F.col("core"))
        low = F.struct(number.isNull().alias("odd"), number.alias("number"), "core")
        last = F.struct(low.alias("low"), (-F.col("rn")).alias("last"), F.col("node"))
        picks.append(F.min(last).alias("low"))
    out = src.groupBy(*scoped(src, "collection", "shard_key")).agg(*picks)
    candidates = [F.struct(F.col(f"r{i}.core"), F.col(f"r{i}.node")) for i in (1, 2)]
    candidates = [F.when(F.col(f"r{i}").isNotNull(), c) for i, c in zip((1, 2), candidates)]
    how = F.when(F.col("r1").isNotNull(), "replica1").when(F.col("r2").isNotNull(), "replica2")
    if fallback == "any":
        candidates.append(F.struct(F.col("low.low.core"), F.col("low.node")))
        how = how.otherwise("any")
    elif fallback != "first_two":
        raise ValueError(f"unknown fallback {fallback!r}")
    return out.select(
        *scoped(out, "collection", "shard_key"),
        F.coalesce(*candidates).alias("instead"),
        how.alias("instead_how"),
    )


# Replicas of a task that matches both clusters; its sorts hold about 1 kB for each.
MET_ROWS = 400_000


def _met(src_inv: DataFrame, dst_inv: DataFrame, rules: Rules, *more: str) -> DataFrame | None:
    """The replicas of both clusters dealt once by their source collection, or None where one of these is hot or the scopes differ.

    One row per source core, shard and whatever ``more`` says, and per destination core (``dest_collection`` is set there). Windows
    below a collection need no further shuffle.
    """
    scope = shared_scope(src_inv, dst_inv)
    if scoped(src_inv) != scope or scoped(dst_inv) != scope:
        return None
    src = src_inv.select(
        *scope, "collection", F.lit(None).cast("string").alias("dest_collection"), "core", "rn", "node", "shard", *more
    )
    dst = exclude_default(dst_inv).select(
        *scope,
        map_reverse(F.col("collection"), rules).alias("collection"),
        F.col("collection").alias("dest_collection"),
        "core",
        "rn",
        "node",
        "shard",
        *[F.lit(None).cast(src.schema[c].dataType).alias(c) for c in more],
    )
    both = src.unionByName(dst)
    if hot_keys(both, [*scope, "collection"]):
        return None
    parts = max(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), both.count() // MET_ROWS + 1)
    at_source = F.col("dest_collection").isNull()
    pick = F.struct(F.col("rn").isNull().alias("odd"), "rn", "core", "node")
    best = [F.min(F.when(F.col("available"), pick)).alias("pick")] if more else []
    return (
        both.repartition(parts, *scope, "collection")
        .groupBy(*scope, "collection", "dest_collection", "core", F.when(at_source, F.col("shard")).alias("src_shard"))
        .agg(F.max(F.struct("rn", "node", "shard")).alias("last"), *best)
        .withColumn("wanted", F.when(at_source, F.col("core")).otherwise(map_reverse(F.col("core"), rules)))
        .withColumn("shard_key", shard_key(F.col("wanted")))
    )


def _peers(met: DataFrame, scope: list[str]) -> DataFrame:
    """``met`` with ``known``: has the source this collection; ``found``, ``instead`` and ``instead_how``: the source core of each destination core."""
    at_source = F.col("dest_collection").isNull()
    keys = [*scope, "collection"]
    told = reduce(and_, [F.col(c).isNotNull() for c in keys])
    last = F.struct("last.rn", "last.node", "core")
    by_core, by_shard = Window.partitionBy(*keys, "wanted"), Window.partitionBy(*keys, "shard_key")
    picks = [F.max(F.when(at_source & (F.col("core") == F.concat("shard_key", F.lit(f"{REPLICA_MARK}{i}"))), last)).over(by_shard) for i in (1, 2)]
    return (
        met.withColumn("found", F.max(F.when(at_source & F.col("core").isNotNull(), last)).over(by_core))
        .withColumn("known", told & F.max(at_source).over(Window.partitionBy(*keys)))
        .withColumns({"r1": picks[0], "r2": picks[1]})
        .withColumn("instead", F.coalesce("r1", "r2"))
        .withColumn("instead_how", F.when(F.col("r1").isNotNull(), "replica1").when(F.col("r2").isNotNull(), "replica2"))
        .drop("r1", "r2")
    )


def peer_match(
    src_inv: DataFrame,
    dst_inv: DataFrame,
    rules: Rules,
    wanted: DataFrame | None = None,
    fallback: str = "first_two",
) -> DataFrame:
    """The source core each destination core is filled from.

    The wanted core is the destination core under the reversed rules. If the source
    has no such core, replica 1 or else replica 2 of its shard stands in; failing
    that, the wanted name stays, without a node (``how='unmatched'``). Destination
    collections whose source collection is not wanted or not there are left out.

    Both sides are reduced to one row per core first, so the exact join has unique
    keys; the fallback and the collection check look up one row per key and are
    safe for a shard or a collection that holds most of the replicas. Where no collection is hot, both sides are dealt
    by their source collection once, and matched by windows.
    """
    scope = shared_scope(src_inv, dst_inv)
    if wanted is None and fallback == "first_two" and (met := _met(src_inv, dst_inv, rules)) is not None:
        found = F.col("found").isNotNull()
        return _peers(met, scope).where("dest_collection is not null and known").select(
            *scope,
            "dest_collection",
            F.col("last.shard").alias("shard"),
            F.col("core").alias("dest_core"),
            F.col("last.node").alias("dest_node"),
            "collection",
            F.when(found, F.col("wanted")).otherwise(F.coalesce("instead.core", "wanted")).alias("source_core"),
            F.when(found, F.col("found.node")).otherwise(F.col("instead.node")).alias("source_node"),
            F.when(found, "exact").otherwise(F.coalesce("instead_how", F.lit("unmatched"))).alias("how"),
        )
    source_names = [
        map_reverse(F.col("collection"), rules).alias("collection"),
        map_reverse(F.col("core"), rules).alias("core"),
        shard_key(map_reverse(F.col("core"), rules)).alias("shard_key"),
    ]
    src = cores_by_collection(src_inv)
    dst_inv = exclude_default(dst_inv)
    raw = dst_inv.select(*scope, *source_names)
    dst = cores_by_collection(dst_inv, "shard").select(
        *scope,
        F.col("collection").alias("dest_collection"),
        "shard",
        F.col("core").alias("dest_core"),
        F.col("node").alias("dest_node"),
        *source_names,
    )
    known = collections(src_inv).select(*scope, "collection").distinct()
    if wanted is not None:
        known = known.join(
            wanted.select(*shared_scope(known, wanted, "collection")).distinct(),
            shared_scope(known, wanted, "collection"),
            "left_semi",
        )
    on = [*scope, "collection"]
    dst = lookup(dst, known, on, "left_semi", weigh=raw)
    exact = dst.join(src.withColumn("found", F.lit(True)), [*on, "core"], "left")
    both = lookup(exact, symmetry_table(src_inv, fallback), [*on, "shard_key"], weigh=raw)
    found = F.col("found").isNotNull()
    return both.select(
        *scope,
        "dest_collection",
        "shard",
        "dest_core",
        "dest_node",
        "collection",
        F.when(found, F.col("core"))
        .otherwise(F.coalesce("instead.core", "core"))
        .alias("source_core"),
        F.when(found, F.col("node")).otherwise(F.col("instead.node")).alias("source_node"),
        F.when(found, "exact")
        .otherwise(F.coalesce("instead_how", F.lit("unmatched")))
        .alias("how"),
    )


def replication_plan(peers: DataFrame, best: DataFrame, skip_failures: bool = True) -> DataFrame:
    """One copy request per destination core, from the best core of its source shard.

    ``best`` comes from ``core_to_best``. A core without a healthy source becomes a
    failed row; with ``skip_failures=False`` the first such row raises. The peers are
    written to the shared folder first, as they are read more than once.
    """
    peers = materialize(peers, "peers")
    sources = best.select(
        *scoped(best, "collection"),
        F.col("core").alias("source_core"),
        "best_core",
        "best_node",
    )
    on = shared_scope(peers, sources, "collection", "source_core")
    joined = lookup(peers, sources, on)
    plan = _requests(joined, scoped(peers))
    if not skip_failures:
        bad = plan.where(~F.col("ok")).first()
        if bad is not None:
            raise RuntimeError(f"replication of {bad['dest_core']} failed: {bad['reason']}")
    return plan


def _requests(peers: DataFrame, scope: list[str]) -> DataFrame:
    """The plan out of peers with the best core of their source shard."""
    ok, entity, reason = source_gate(F.col("best_core"), F.col("best_core").isNotNull())
    return peers.select(
        *scope,
        "dest_collection",
        "shard",
        F.split_part("dest_node", F.lit(":"), F.lit(1)).alias("dest_node"),
        "dest_core",
        "collection",
        F.col("best_node").alias("source_node"),
        F.col("best_core").alias("source_core"),
        ok.alias("ok"),
        entity.alias("entity"),
        reason.alias("reason"),
    )


def copy_plan(src_inv: DataFrame, dst_inv: DataFrame, rules: Rules) -> DataFrame:
    """``replication_plan`` of ``peer_match`` and ``core_to_best``; where no collection is hot, in one shuffle by source collection."""
    scope = shared_scope(src_inv, dst_inv)
    met = _met(src_inv, dst_inv, rules, "available")
    if met is None:
        return replication_plan(peer_match(src_inv, dst_inv, rules), core_to_best(src_inv))
    keys = [*scope, "collection"]
    at_source = F.col("dest_collection").isNull()
    # A core has a row for each shard that it is listed in. Shards without a name and the default collection have no best core.
    best = F.min("pick").over(Window.partitionBy(*keys, "src_shard"))
    source = F.when(at_source, F.col("core")).when(F.col("found").isNotNull(), F.col("wanted"))
    listed = at_source & F.col("core").isNotNull() & (F.col("collection") != DEFAULT_COLLECTION)
    bests = F.collect_list(F.when(listed, F.struct(F.struct("best.core", "best.node").alias("b")))).over(Window.partitionBy(*keys, "source"))
    rows = (
        _peers(met, scope)
        .withColumn("best", F.when(F.col("src_shard").isNotNull(), best))
        .withColumn("source", source.otherwise(F.coalesce("instead.core", "wanted")))
        .withColumn("bests", bests)
        .where("dest_collection is not null and known")
        .withColumn("best", F.explode_outer("bests"))
    )
    return _requests(
        rows.select(
            *scope,
            "dest_collection",
            F.col("last.shard").alias("shard"),
            F.col("core").alias("dest_core"),
            F.col("last.node").alias("dest_node"),
            "collection",
            F.col("best.b.core").alias("best_core"),
            F.col("best.b.node").alias("best_node"),
        ),
        scope,
    )


def inventory_drift(src_inv: DataFrame, dst_inv: DataFrame, rules: Rules) -> DataFrame:
    """Cores of both clusters under destination names: in both, or on one side only."""
    scope = shared_scope(src_inv, dst_inv)
    src = exclude_default(src_inv).select(
        *scope,
        map_forward(F.col("collection"), rules).alias("dest_collection"),
        _core_in(F.col("core"), F.col("collection"), rules).alias("dest_core"),
    )
    dst = exclude_default(dst_inv).select(
        *scope,
        F.col("collection").alias("dest_collection"),
        F.col("core").alias("dest_core"),
    )
    both = src.withColumn("at_source", F.lit(True)).withColumn("at_dest", F.lit(False)).unionByName(
        dst.withColumn("at_source", F.lit(False)).withColumn("at_dest", F.lit(True))
    )
    # One grouping instead of a full join: each side is combined before the shuffle.
    return (
        both.groupBy(*scope, "dest_collection", "dest_core")
        .agg(F.bool_or("at_source").alias("at_source"), F.bool_or("at_dest").alias("at_dest"))
        .select(
            *scope,
            "dest_collection",
            "dest_core",
            F.when(F.col("at_source") & F.col("at_dest"), "both")
            .when(F.col("at_source"), "source only")
            .otherwise("destination only")
            .alias("side"),
        )
    )


def _core_in(core, collection, rules: Rules):
    """Core name at the destination: the renamed collection, then the rest of the core name."""
    rest = F.substr(core, F.length(collection) + 1)
    return F.when(
        F.startswith(core, collection), F.concat(map_forward(collection, rules), rest)
    ).otherwise(core)
