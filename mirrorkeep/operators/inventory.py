"""Views of the replica inventory: one row per replica in, grouped rows out.

The inventory has the columns collection, shard, core, rn, node_name, node,
state, leader, available. The views stay flat tables; a map or list per group
would put a whole group into one row. Every grouping combines before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import DEFAULT_COLLECTION, NO_LEADER, scoped, shared_scope
from .skew import lookup

# A host map is broadcast up to this many rows of two names (some 10 MB).
MAX_BROADCAST_HOSTS = 100_000


def exclude_default(df: DataFrame, column: str = "collection") -> DataFrame:
    """Drop the default collection, by its exact name."""
    return df.where(F.col(column) != DEFAULT_COLLECTION)


def _last(value: str) -> Column:
    """The value seen last, by replica number, ties by the value itself."""
    return F.max_by(F.col(value), F.struct("rn", value))


def collections(inv: DataFrame) -> DataFrame:
    return inv.select(*scoped(inv, "collection")).distinct()


def all_nodes(inv: DataFrame) -> DataFrame:
    """Every host a replica mentions."""
    return inv.select(*scoped(inv, "node")).distinct()


def live_nodes(inv: DataFrame) -> DataFrame:
    """Hosts with at least one active replica."""
    return all_nodes(inv.where(F.col("state") == "active"))


def translate_hosts(
    inv: DataFrame, host_map: DataFrame | None, column: str = "node"
) -> DataFrame:
    """Add the public name of each host; a host the map does not have gets null.

    ``host_map`` has private and public, one row per private name. It is counted up to
    a limit: a small one is broadcast, so the inventory is neither scanned for hot
    hosts nor shuffled.
    """
    if host_map is None:
        raise ValueError("no host map to translate with")
    hosts = host_map.select(*scoped(host_map), F.col("private").alias(column), "public")
    on = shared_scope(inv, hosts, column)
    if hosts.limit(MAX_BROADCAST_HOSTS + 1).count() <= MAX_BROADCAST_HOSTS:
        return inv.join(F.broadcast(hosts), on, "left")
    return lookup(inv, hosts, on)


def cores_by_collection(inv: DataFrame, *extra: str) -> DataFrame:
    """One row per collection and core with its node; of a repeated core the last one wins.

    ``extra`` names further columns to take from that last row.
    """
    last = F.max(F.struct("rn", "node", *extra)).alias("last")
    keys = scoped(inv, "collection", "core")
    return (
        inv.groupBy(*keys)
        .agg(last)
        .select(*keys, *[F.col(f"last.{c}") for c in ("node", *extra)])
    )


def cores_by_shard(inv: DataFrame) -> DataFrame:
    """One row per collection, shard and core, without the default collection."""
    inv = exclude_default(inv)
    return inv.groupBy(*scoped(inv, "collection", "shard", "core")).agg(
        _last("node").alias("node")
    )


def cores_by_node(inv: DataFrame) -> DataFrame:
    """Cores of each node; repeats are kept as a count."""
    return inv.groupBy(*scoped(inv, "node", "core")).agg(F.count(F.lit(1)).alias("copies"))


def core_status_by_node(inv: DataFrame) -> DataFrame:
    """State of each core on each node, the last one seen."""
    return inv.groupBy(*scoped(inv, "node", "core")).agg(_last("state").alias("state"))


def shard_count(inv: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Shards per collection; with ``of``, a row for each of its collections, 0 if unknown."""
    counts = inv.groupBy(*scoped(inv, "collection")).agg(
        F.count_distinct("shard").alias("shards")
    )
    if of is None:
        return counts
    on = shared_scope(of, counts, "collection")
    wanted = of.select(*on).distinct()
    return wanted.join(counts, on, "left").withColumn(
        "shards", F.coalesce("shards", F.lit(0).cast("long"))
    )


def leader_by_shard(inv: DataFrame) -> DataFrame:
    """First leader of each shard as ``node_name,core``, or the no-leader text."""
    inv = exclude_default(inv)
    who = F.concat_ws(",", "node_name", "core")
    place = F.struct(F.col("rn").isNull().alias("odd"), F.col("rn"), who.alias("who"))
    first = F.min(F.when(F.lower("leader") == "true", place))
    return inv.groupBy(*scoped(inv, "collection", "shard")).agg(
        F.coalesce(first["who"], F.lit(NO_LEADER)).alias("leader")
    )


def core_health(inv: DataFrame, status: DataFrame) -> DataFrame:
    """Status of every core of the inventory; a core without a loadable status is unavailable.

    ``status`` has one row per collection and core (see ``parse_core_status``).
    """
    cores = cores_by_collection(inv)
    on = shared_scope(cores, status, "collection", "core")
    return cores.join(
        status.select(*on, "available", "num_docs", "version"), on, "left"
    ).withColumn("available", F.coalesce("available", F.lit(False)))


def cluster_health_rollup(inv: DataFrame) -> DataFrame:
    """Health of every shard, every collection and each cluster, by grouping sets in one pass; ``level`` says which.

    A row of a level has null in the finer columns; a null collection or shard of the table itself is a group of its level.
    """
    keys = scoped(inv, "collection", "shard")
    up = F.coalesce("available", F.lit(False))
    level = F.grouping_id()
    return (
        inv.groupingSets([keys, keys[:-1], keys[:-2]], *keys)
        .agg(
            F.when(level == 0, "shard").when(level == 1, "collection").otherwise("cluster").alias("level"),
            F.bool_and(up).alias("healthy"),
            F.count(F.lit(1)).alias("cores"),
            F.count_if(~up).alias("unavailable"),
        )
    )


def cluster_health(inv: DataFrame, by: str | None = "collection") -> DataFrame:
    """Are all cores available, and how many are not, per collection or in total."""
    keys = scoped(inv, by) if by else scoped(inv)
    up = F.coalesce("available", F.lit(False))
    return inv.groupBy(*keys).agg(
        F.bool_and(up).alias("healthy"),
        F.count(F.lit(1)).alias("cores"),
        F.count_if(~up).alias("unavailable"),
    )


def best_replica(inv: DataFrame, policy: str = "replica") -> DataFrame:
    """The replica to copy each shard from, among those available.

    ``replica`` takes the lowest replica number, ``freshest`` the highest version,
    then the latest change. Ties go to the first core name. A shard without an
    available replica has no row.
    """
    if policy == "replica":
        rank = [F.col("rn").isNull(), F.col("rn")]
    elif policy == "freshest":
        changed = F.expr(
            "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', last_modified)"
        )
        rank = [
            F.col("version").isNull(),
            -F.col("version"),
            changed.isNull(),
            -changed,
        ]
    else:
        raise ValueError(f"unknown policy {policy!r}")
    rank = [c.alias(f"k{i}") for i, c in enumerate(rank)]
    pick = F.min(F.struct(*rank, F.col("core"), F.col("node")))
    inv = exclude_default(inv)
    return (
        inv.where("available")
        .groupBy(*scoped(inv, "collection", "shard"))
        .agg(pick.alias("pick"))
        .select(
            *scoped(inv, "collection", "shard"),
            F.col("pick.core").alias("best_core"),
            F.col("pick.node").alias("best_node"),
        )
    )


def core_to_best(inv: DataFrame, policy: str = "replica") -> DataFrame:
    """Every core with the best replica of its shard, null when there is none."""
    cores = cores_by_shard(inv).drop("node")
    on = scoped(inv, "collection", "shard")
    return lookup(cores, best_replica(inv, policy), on, weigh=inv)
