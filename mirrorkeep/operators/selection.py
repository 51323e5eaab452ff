"""Which collections an action works on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import DEFAULT_COLLECTION, materialize, scoped, shared_scope
from ..functions.naming import Rules, map_config, map_forward, map_reverse
from .inventory import collections, exclude_default, shard_count
from .skew import lookup, numbered

# Fixed value: the limit the create call is given.
MAX_SHARDS_PER_NODE = 500


def requested(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """An explicit list of collections, as a table."""
    return spark.createDataFrame([(n,) for n in names], "collection string")


def selected(
    names: Sequence[str] = ("all",),
    include: str | None = None,
    exclude: str | None = None,
) -> Column:
    """The condition behind ``select_collections``, for pruning other tables by collection."""
    if not names:
        raise ValueError("no collections specified")
    name = F.col("collection")
    if names[0].lower() != "all":
        return name.isin(list(names))
    out = name != DEFAULT_COLLECTION
    if include and include.strip():
        out = out & name.contains(include)
    if exclude and exclude.strip():
        out = out & ~name.contains(exclude)
    return out


def select_collections(
    inv: DataFrame,
    names: Sequence[str] = ("all",),
    include: str | None = None,
    exclude: str | None = None,
) -> DataFrame:
    """Collections to work on.

    If the first name is ``all``, these are the collections of the inventory but
    the default one, kept when they contain ``include`` and dropped when they
    contain ``exclude``. Any other list is taken as given, without the filters.
    """
    condition = selected(names, include, exclude)
    if names[0].lower() != "all":
        return requested(inv.sparkSession, names).distinct()
    return collections(inv.where(condition))


def missing_in_source(wanted: DataFrame, src_inv: DataFrame) -> DataFrame:
    """Wanted collections the source does not have."""
    on = shared_scope(wanted, src_inv, "collection")
    return wanted.select(*scoped(wanted, "collection")).distinct().join(
        collections(src_inv), on, "left_anti"
    )


def missing_in_dest(
    src_inv: DataFrame,
    dst_inv: DataFrame,
    rules: Rules,
    wanted: DataFrame | None = None,
    config_rules: Rules = Rules(),
    configs: DataFrame | None = None,
    replication_factor: int = 1,
) -> DataFrame:
    """Collections to create at the destination, with what the create call needs.

    ``wanted`` restricts them; names the source does not have are left to
    ``missing_in_source``. ``configs`` (collection, config) is used when there are no config rules; a
    collection without one gets a null config, which the clone job reports as a violation.
    """
    src = shard_count(src_inv)
    if wanted is not None:
        on = shared_scope(src, wanted, "collection")
        src = src.join(wanted.select(*on).distinct(), on, "left_semi")
    src = exclude_default(src).withColumn(
        "dest_collection", map_forward(F.col("collection"), rules)
    )
    there = collections(dst_inv).withColumnRenamed("collection", "dest_collection")
    todo = src.join(there, shared_scope(src, there, "dest_collection"), "left_anti")
    if not config_rules.pairs and not config_rules.default:
        if configs is None:
            todo = todo.withColumn("config", F.lit(None).cast("string"))
        else:
            on = shared_scope(todo, configs, "collection")
            todo = todo.join(configs.select(*on, "config"), on, "left")
    else:
        todo = todo.withColumn("config", map_config(F.col("collection"), config_rules))
    return todo.select(
        *scoped(todo, "collection"),
        "dest_collection",
        "config",
        "shards",
        F.lit(int(replication_factor)).alias("replication_factor"),
        F.lit(MAX_SHARDS_PER_NODE).alias("max_shards_per_node"),
    )


def place_replicas(replicas: DataFrame, nodes: DataFrame, limit: int = MAX_SHARDS_PER_NODE) -> DataFrame:
    """``replicas`` (collection, shard, core, rn, node) with a live node each, out of ``nodes`` (node).

    Replicas are numbered in order and nodes are taken in turn, so the copies of a shard are on different nodes, and the numbers of
    replicas that any two nodes get, of a collection or in all, differ by one at most. A collection with a shard of more copies than there are nodes, or with
    more than ``limit`` replicas a node, is not placed at all: its node is null.

    What the next step reads several times is written to the shared folder first.
    """
    columns, replicas = replicas.columns, materialize(replicas.drop("node"), "replicas")
    keys = scoped(replicas, "collection")
    on = shared_scope(replicas, nodes, "_all")
    there = nodes.where("node is not null").select(*on[:-1], "node").distinct().withColumn("_all", F.lit(1))
    slots = numbered(there, on, ["node"], "_slot")
    sizes = there.groupBy(*on).agg(F.count(F.lit(1)).alias("_nodes"))
    copies = replicas.groupBy(*keys, "shard").agg(F.count(F.lit(1)).alias("_copies"))
    fit = copies.groupBy(*keys).agg(F.max("_copies").alias("_most"), F.sum("_copies").alias("_count"))
    fit = fit.withColumn("_all", F.lit(1)).join(sizes, on, "left")
    fits = (F.col("_most") <= F.col("_nodes")) & (F.col("_count") <= limit * F.col("_nodes"))
    fit = fit.select(*keys, "_nodes", F.coalesce(fits, F.lit(False)).alias("_fits"))
    rows = materialize(lookup(replicas, fit, keys, "left"), "fitted-replicas")
    rows = numbered(rows, [*keys[:-1], "_fits"], ["collection", "shard", "rn", "core"], "_number")
    turn = F.when(F.col("_fits"), (F.col("_number") - 1) % F.col("_nodes") + 1)
    rows = rows.withColumn("_slot", turn.cast("int")).withColumn("_all", F.lit(1))
    rows = materialize(rows, "numbered-replicas")
    placed = lookup(rows, slots.select(*on, "_slot", "node"), [*on, "_slot"], "left")
    return placed.select(*columns)


def mapping_roundtrip(names: DataFrame, rules: Rules) -> DataFrame:
    """Names the rules do not bring back, or that share their destination with another.

    Peer matching goes from destination names back to source names, so it is only
    right for names that are not listed here.
    """
    keys = scoped(names, "collection")
    scope = keys[:-1]
    named = names.select(*keys, map_forward(F.col("collection"), rules).alias("dest_collection"))
    mapped = named.distinct()
    back = map_reverse(F.col("dest_collection"), rules)
    # Only the shared destination names travel back to the names, not every count.
    shared = (
        mapped.groupBy(*scope, "dest_collection")
        .agg(F.count(F.lit(1)).alias("sources"))
        .where("sources > 1")
    )
    return (
        lookup(mapped, shared, [*scope, "dest_collection"], weigh=named)
        .select(
            *keys,
            "dest_collection",
            back.alias("back"),
            F.coalesce("sources", F.lit(1).cast("long")).alias("sources"),
        )
        .where((F.col("back") != F.col("collection")) | (F.col("sources") > 1))
    )


def delete_plan(inv: DataFrame, names: Sequence[str], cluster: str | None = None) -> DataFrame:
    """What a delete request does to each listed collection; no names, no rows.

    ``inv`` is any table with the collections that are there. If it has a cluster column, the request is for one
    ``cluster``, which leads the rows of the plan.
    """
    spark = inv.sparkSession
    if "cluster" in inv.columns:
        if cluster is None:
            raise ValueError("name the cluster to delete from")
        inv = inv.where(F.col("cluster") == cluster)
    wanted = requested(spark, names).distinct()
    there = (
        inv.where(F.col("collection").isin(list(names)))
        .select("collection")
        .distinct()
        .withColumn("there", F.lit(True))
    )
    scope = [] if cluster is None else [F.lit(cluster).alias("cluster")]
    return wanted.join(there, "collection", "left").select(
        *scope,
        "collection",
        F.when(F.col("collection") == DEFAULT_COLLECTION, "protected")
        .when(F.col("there"), "drop")
        .otherwise("absent")
        .alias("action"),
    )
