"""Copy of whole collections as one partitioned write, checked by reading it back."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import materialize, scoped, shared_dir, shared_scope
from ..functions.naming import REPLICA_MARK, Rules, map_forward
from ..operators.inventory import core_to_best, exclude_default
from ..operators.matching import peer_match, replication_plan
from ..operators.selection import (
    mapping_roundtrip,
    missing_in_dest,
    missing_in_source,
    select_collections,
    selected,
)
from ..operators.skew import lookup
from ..operators.verify import content_digest, shard_parity

# The list of shards to copy is broadcast up to this size, so that the documents need
# not be shuffled to find theirs.
MAX_BROADCAST_BYTES = 64 << 20


NO_PEERS = "no peers at the destination"


@dataclass(frozen=True)
class ClonePlan:
    """What a clone will do: collections to create, copy requests, setup violations."""

    create: DataFrame
    requests: DataFrame
    violations: DataFrame


@dataclass(frozen=True)
class CloneResult:
    """What a clone did: its plan, where the copy is, and a row per destination core."""

    plan: ClonePlan
    path: str
    diagnostics: DataFrame


def created_replicas(create: DataFrame, src_inv: DataFrame) -> DataFrame:
    """Replica rows of the collections to create: the source's shards, so many copies each.

    Where a replica is placed is up to the destination cluster, so its node is null; ``place_replicas`` deals them to live nodes.
    """
    keys = scoped(src_inv, "collection")
    shards = src_inv.select(*keys, "shard").distinct()
    made = create.select(*keys, "dest_collection", "replication_factor")
    rows = lookup(shards, made, keys, "inner", weigh=src_inv)
    numbered = rows.withColumn("rn", F.explode(F.sequence(F.lit(1), "replication_factor")))
    return numbered.select(
        *keys[:-1],
        F.col("dest_collection").alias("collection"),
        "shard",
        F.concat(
            "dest_collection", F.lit("_"), "shard", F.lit(REPLICA_MARK), F.col("rn").cast("string")
        ).alias("core"),
        "rn",
        F.lit(None).cast("string").alias("node"),
    )


def plan_clone(
    src_inv: DataFrame,
    dst_inv: DataFrame,
    rules: Rules = Rules(),
    names: Sequence[str] = ("all",),
    include: str | None = None,
    exclude: str | None = None,
    config_rules: Rules = Rules(),
    configs: DataFrame | None = None,
    replication_factor: int = 1,
    policy: str = "replica",
    strict: bool = False,
) -> ClonePlan:
    """The plan of a clone, without writing any content: the dry run.

    The two inventories it works on go to the shared folder, as each is used in
    several steps. Violations are collections the source does not have, that share their destination name or whose
    destination name does not lead back to them, that would be created without a configuration (where configurations or
    rules for them are given), and those whose shard counts differ. ``strict`` raises on the first one;
    otherwise the collections concerned are left out and listed. A collection that is left in and has no peers at the destination
    is a failed request, so every wanted collection is in the requests or in the violations.
    """
    wanted = select_collections(src_inv, names, include, exclude)
    unknown = missing_in_source(wanted, src_inv)
    chosen = materialize(
        lookup(src_inv, wanted, scoped(wanted, "collection"), "left_semi"), "clone-source"
    )
    keys = scoped(chosen, "collection")
    unclear = materialize(mapping_roundtrip(chosen.select(*keys).distinct(), rules), "unclear-names")
    unclear = unclear.select(
        *keys,
        F.when(F.col("sources") > 1, F.concat(F.lit("shares its destination "), "dest_collection"))
        .otherwise(F.concat(F.lit("destination "), "dest_collection", F.lit(" leads back to "), "back"))
        .alias("reason"),
    )
    chosen = chosen.join(unclear.select(*keys), keys, "left_anti")
    create = missing_in_dest(
        chosen,
        dst_inv,
        rules,
        config_rules=config_rules,
        configs=configs,
        replication_factor=replication_factor,
    )
    dst_cols = [*scoped(dst_inv, "collection"), "shard", "core", "rn", "node"]
    no_config = create.where("false")
    if configs is not None or config_rules.pairs or config_rules.default:
        create = materialize(create, "clone-create")
        no_config = create.where("config is null")
        create = create.where("config is not null")
        chosen = chosen.join(no_config.select(*keys), keys, "left_anti")
    after = materialize(
        dst_inv.select(*dst_cols).unionByName(created_replicas(create, chosen)), "clone-dest"
    )
    named = chosen.select(*keys, map_forward(F.col("collection"), rules).alias("dest_collection")).distinct()
    targets = named.select(*keys[:-1], F.col("dest_collection").alias("collection"))
    on = scoped(targets, "collection")
    uneven = shard_parity(
        chosen, lookup(after, targets, on, "left_semi"), rules
    ).select(
        *on,
        F.concat(
            F.lit("shards differ: source "),
            F.col("source_shards").cast("string"),
            F.lit(", destination "),
            F.col("dest_shards").cast("string"),
        ).alias("reason"),
    )
    violations = (
        unknown.select(*on, F.lit("not at the source").alias("reason"))
        .unionByName(unclear.select(*on, "reason"))
        .unionByName(no_config.select(*on, F.lit("no configuration").alias("reason")))
        .unionByName(uneven)
    )
    if strict:
        bad = violations.first()
        if bad is not None:
            raise LookupError(f"collection {bad['collection']}: {bad['reason']}")
    sound = lookup(after, uneven.select(*on), on, "left_anti")
    peers = peer_match(chosen, sound, rules)
    requests = replication_plan(peers, core_to_best(chosen, policy), skip_failures=not strict)
    lonely = named.join(
        uneven.select(*on[:-1], F.col("collection").alias("dest_collection")), [*on[:-1], "dest_collection"], "left_anti"
    ).join(sound.select(*on[:-1], F.col("collection").alias("dest_collection")).distinct(), [*on[:-1], "dest_collection"], "left_anti")
    values = {"ok": F.lit(False), "entity": F.lit("NULL"), "reason": F.lit(NO_PEERS)}
    blanks = [values.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in requests.schema if f.name not in lonely.columns]
    failed = lonely.select("*", *blanks).select(*requests.columns)
    if strict and (bad := failed.first()) is not None:
        raise RuntimeError(f"collection {bad['dest_collection']}: {NO_PEERS}")
    return ClonePlan(create, requests.unionByName(failed), violations)


def clone_collections(
    src_inv: DataFrame,
    dst_inv: DataFrame,
    contents: DataFrame,
    rules: Rules = Rules(),
    skip_failures: bool = True,
    out: str | None = None,
    names: Sequence[str] = ("all",),
    include: str | None = None,
    exclude: str | None = None,
    **options,
) -> CloneResult:
    """Copy every requested collection whose shards have a healthy source.

    The copy is one write, partitioned by collection and shard. Spark cuts large
    shards over several tasks and files and packs small ones together (rebalance),
    so a shard that holds much of the data does not end up in one task. The files
    are then read back and their documents compared with the source, shard by shard.
    With ``skip_failures=False`` the first failed core raises.
    """
    spark = contents.sparkSession
    plan = plan_clone(
        src_inv, dst_inv, rules, names, include, exclude, strict=not skip_failures, **options
    )
    # Prunes partitions where the contents are laid out by collection.
    contents = contents.where(selected(names, include, exclude))
    requests = materialize(plan.requests, "clone-plan")
    plan = ClonePlan(plan.create, requests, plan.violations)
    keys = scoped(contents, "collection")
    by = [*keys, "shard"]
    units = materialize(
        requests.where("ok").select(*by, "dest_collection").distinct(), "clone-shards"
    )
    size = units.agg(F.sum(F.octet_length(F.concat_ws("", *units.columns)) + 64)).first()[0] or 0
    if size <= MAX_BROADCAST_BYTES:
        found = contents.join(F.broadcast(units), by)
    else:
        found = lookup(contents, units, by, "inner")
    copied = found.withColumn("collection", F.col("dest_collection")).select(*contents.columns)
    path = out or shared_dir(spark, "clone")
    copied.hint("rebalance", *by).write.partitionBy(*by).parquet(path)
    landed = spark.read.schema(copied.schema).parquet(path)

    # Both digests are combined where the documents are read; only sums are shuffled.
    want = (
        content_digest(found.select(*contents.columns))
        .join(units, by)
        .select(
            *keys[:-1],
            F.col("dest_collection").alias("collection"),
            "shard",
            F.col("docs").alias("want_docs"),
            F.col("digest").alias("want"),
        )
    )
    have = content_digest(landed).withColumnsRenamed({"docs": "docs", "digest": "have"})
    shards = want.join(have, by, "full").select(
        *keys[:-1],
        F.col("collection").alias("dest_collection"),
        "shard",
        F.coalesce("docs", F.lit(0).cast("long")).alias("docs"),
        F.col("have").alias("digest"),
        (F.col("want_docs").eqNullSafe(F.col("docs")) & F.col("want").eqNullSafe(F.col("have"))).alias(
            "same"
        ),
    )
    # A shard without documents is in neither digest, and that is a match.
    same = F.coalesce("same", F.lit(True))
    checked = lookup(requests, shards, [*keys[:-1], "dest_collection", "shard"])
    diagnostics = checked.select(
        *scoped(requests, "dest_collection", "shard"),
        "dest_core",
        "source_core",
        F.when(F.col("ok") & same, "ok").otherwise("failed").alias("status"),
        F.when(~F.col("ok"), F.col("reason"))
        .when(~same, "content differs after the copy")
        .otherwise("")
        .alias("reason"),
        F.when(F.col("ok"), F.coalesce("docs", F.lit(0).cast("long")))
        .otherwise(F.lit(0).cast("long"))
        .alias("docs"),
        F.when(F.col("ok"), F.col("digest").cast("string")).alias("digest"),
    )
    if not skip_failures:
        bad = diagnostics.where("status = 'failed'").first()
        if bad is not None:
            raise RuntimeError(f"clone of {bad['dest_core']} failed: {bad['reason']}")
    return CloneResult(plan, path, diagnostics)


def apply_delete(contents: DataFrame, plan: DataFrame, out: str) -> str:
    """Write the contents without the collections a delete plan drops, in the plan's cluster only.

    The plan is a request's argument, so it is short: Spark broadcasts it if its size allows.
    """
    by = scoped(contents, "collection")
    drop = plan.where("action = 'drop'").select(*shared_scope(plan, contents, "collection"))
    kept = contents.join(drop, drop.columns, "left_anti").select(*contents.columns)
    kept.hint("rebalance", *by).write.partitionBy(*by).parquet(out)
    return out
