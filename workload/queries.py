"""One query per operator: ``(spark, sf_dir) -> DataFrame`` over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorkeep.common import blank, materialize, shared_dir
from mirrorkeep.functions.naming import (
    Rules,
    map_config,
    map_forward,
    map_reverse,
    node_name,
    parse_rules,
    shard_key,
)
from mirrorkeep.functions.status import core_label, is_replicating, source_gate
from mirrorkeep.operators import difference, history, inventory, matching, metadata, monitor, selection, verify
from mirrorkeep.plans import clone, store, sync
from mirrorkeep.sources import cluster_state, status, tree
from mirrorkeep.streaming import monitor as streaming
from mirrorkeep.streaming import timers
from workload import fixtures as t

RULES = parse_rules(t.RULES)
CONFIG_RULES = parse_rules("_collection:big_config,default:std_config")

# The samples are far apart here, so the limits are wider than the defaults.
TIMEOUT = "6 hours"
MAX_FAILURES = 3

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def named(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def query(fn: Query) -> Query:
    return named(fn.__name__)(fn)


# Sources


@query
def scan_cluster_state(spark, sf_dir):
    return cluster_state.scan_cluster_state(t.state_documents(spark, sf_dir)).select(
        "collection",
        "max_shards_per_node",
        "replication_factor",
        "shard",
        "range",
        "shard_state",
        "replica",
        "core",
        "node_name",
        "base_url",
        "state",
        "leader",
    )


@query
def flatten_state(spark, sf_dir):
    return cluster_state.flatten_state(
        cluster_state.scan_cluster_state(t.state_documents(spark, sf_dir))
    )


@query
def state_size(spark, sf_dir):
    return cluster_state.state_size(t.state_documents(spark, sf_dir), ["collection"])


@query
def scan_aliases(spark, sf_dir):
    return cluster_state.scan_aliases(t.alias_documents(spark, sf_dir))


@query
def live_nodes(spark, sf_dir):
    return inventory.live_nodes(t.placed(spark, sf_dir))


@query
def scan_live_nodes(spark, sf_dir):
    return cluster_state.scan_live_nodes(t.live_documents(spark, sf_dir))


@query
def rejected_documents(spark, sf_dir):
    docs = t.table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(F.to_json(F.create_map("role", F.struct(F.lit("1").alias("maxShardsPerNode"))))).alias("doc"),
    )
    return cluster_state.rejected_documents(docs).select("conv_id", "turn")


@query
def read_documents(spark, sf_dir):
    """Snapshots of many collections, shards and replicas, written as files and read back."""
    folder = t.snapshot_files(spark, sf_dir)
    scanned = cluster_state.scan_cluster_state(cluster_state.read_documents(spark, folder))
    return scanned.select("collection", "shard", "replica", "core", "node_name", "state", "leader")


@query
def config_names(spark, sf_dir):
    return tree.config_names(t.src_tree(spark, sf_dir))


@query
def collection_config(spark, sf_dir):
    return cluster_state.collection_config(
        inventory.collections(t.placed(spark, sf_dir)), t.metadata_documents(spark, sf_dir)
    )


@query
def parse_core_status(spark, sf_dir):
    docs = t.status_documents(t.inv(spark, sf_dir))
    return status.parse_core_status(docs).select(
        "core", "available", "num_docs", "deleted_docs", "max_docs", "version", "last_modified",
        "current",
    )


@query
def parse_replication_status(spark, sf_dir):
    return status.parse_replication_status(t.progress_documents(spark, sf_dir))


@query
def collection_size(spark, sf_dir):
    return verify.collection_size(t.contents(spark, sf_dir))


@query
def tree_paths(spark, sf_dir):
    return tree.tree_paths(t.src_tree(spark, sf_dir))


@query
def tree_paths_from_edges(spark, sf_dir):
    nodes = tree.tree_paths(t.src_tree(spark, sf_dir))
    edges = nodes.select(
        F.col("path").alias("id"),
        F.nullif("parent", F.lit("/")).alias("parent_id"),
        "label",
    )
    return tree.paths_from_edges(edges)


# Projections, filters, predicates


@named("node_name")
def node_names(spark, sf_dir):
    return t.inv(spark, sf_dir).select(
        "core", "node_name", node_name(F.col("node_name")).alias("node")
    )


@query
def translate_host(spark, sf_dir):
    cores = t.inv(spark, sf_dir).select("core", "node")
    return inventory.translate_hosts(cores, t.host_map(spark, sf_dir))


@query
def select_collections(spark, sf_dir):
    return selection.select_collections(
        t.placed(spark, sf_dir), include="_collection", exclude="7"
    )


@query
def exclude_default(spark, sf_dir):
    named = t.placed(spark, sf_dir).select(
        F.replace("shard", F.lit("shard"), F.lit("collection")).alias("collection")
    )
    return inventory.exclude_default(named).groupBy("collection").agg(
        F.count(F.lit(1)).alias("replicas")
    )


@query
def missing_in_source(spark, sf_dir):
    inv = t.placed(spark, sf_dir)
    return selection.missing_in_source(inventory.collections(inv), t.src_inv(inv))


@named("shard_key")
def shard_keys(spark, sf_dir):
    return t.inv(spark, sf_dir).select("core", shard_key(F.col("core")).alias("shard_key"))


# Names


@named("map_forward")
def forward_names(spark, sf_dir):
    names = inventory.collections(t.placed(spark, sf_dir))
    return names.select(
        "collection", map_forward(F.col("collection"), RULES).alias("dest_collection")
    )


@named("map_reverse")
def reverse_names(spark, sf_dir):
    return t.dst_inv(t.inv(spark, sf_dir)).select(
        "collection",
        "core",
        map_reverse(F.col("collection"), RULES).alias("source_collection"),
        map_reverse(F.col("core"), RULES).alias("source_core"),
    )


@named("map_config")
def config_by_rule(spark, sf_dir):
    names = inventory.collections(t.placed(spark, sf_dir))
    own = t.metadata_documents(spark, sf_dir).select(
        "collection", F.get_json_object("doc", "$.configName").alias("own")
    )
    return names.join(own, "collection", "left").select(
        "collection",
        map_config(F.col("collection"), Rules(), F.col("own")).alias("own_config"),
        map_config(F.col("collection"), CONFIG_RULES).alias("rule_config"),
    )


@query
def mapping_roundtrip(spark, sf_dir):
    names = t.placed(spark, sf_dir).select("collection")
    there = names.select(map_forward(F.col("collection"), RULES).alias("collection"))
    names = names.unionByName(there)
    return selection.mapping_roundtrip(names, RULES)


# Joins


@query
def peer_match(spark, sf_dir):
    inv = t.stored_inv(spark, sf_dir)
    return matching.peer_match(t.src_inv(inv), t.dst_inv(inv), RULES)


@query
def symmetry_fallback(spark, sf_dir):
    return matching.symmetry_table(t.inv(spark, sf_dir)).select(
        "collection",
        "shard_key",
        F.col("instead.core").alias("core"),
        F.col("instead.node").alias("node"),
        F.col("instead_how").alias("how"),
    )


def _plan(src, dst):
    return matching.copy_plan(src, dst, RULES)


@query
def replication_plan(spark, sf_dir):
    inv = t.stored_inv(spark, sf_dir)
    return _plan(t.src_inv(inv), t.dst_inv(inv))


@query
def alias_diff(spark, sf_dir):
    return metadata.alias_diff(t.src_alias(spark, sf_dir), t.dst_alias(spark, sf_dir))


@query
def alias_verify(spark, sf_dir):
    return metadata.alias_verify(t.src_alias(spark, sf_dir), t.dst_alias(spark, sf_dir))


@query
def missing_in_dest(spark, sf_dir):
    inv = t.placed(spark, sf_dir)
    configs = t.metadata_documents(spark, sf_dir).select(
        "collection", F.get_json_object("doc", "$.configName").alias("config")
    )
    return selection.missing_in_dest(
        inv, t.src_inv(inv), Rules(), configs=configs, replication_factor=4
    )


@query
def place_replicas(spark, sf_dir):
    inv = t.placed(spark, sf_dir)
    create = selection.missing_in_dest(inv, t.src_inv(inv), Rules(), replication_factor=4)
    return selection.place_replicas(clone.created_replicas(create, inv), inventory.live_nodes(inv))


@query
def shard_parity(spark, sf_dir):
    inv = t.placed(spark, sf_dir)
    return verify.shard_parity(inv, t.src_inv(inv))


def _size_parity(spark, sf_dir, **options):
    docs = t.segment_contents(spark, sf_dir)
    return verify.size_parity(
        t.src_alias(spark, sf_dir),
        t.dst_alias(spark, sf_dir),
        verify.collection_size(docs),
        verify.collection_size(docs.where("o_orderstatus <> 'P'")),
        **options,
    )


@query
def size_parity(spark, sf_dir):
    return _size_parity(spark, sf_dir)


@query
def size_parity_both_sides(spark, sf_dir):
    return _size_parity(spark, sf_dir, both_sides=True)


@query
def tree_diff(spark, sf_dir):
    return metadata.tree_diff(t.src_tree(spark, sf_dir), t.dst_tree(spark, sf_dir))


@query
def inventory_drift(spark, sf_dir):
    inv = t.stored_inv(spark, sf_dir)
    return matching.inventory_drift(t.src_inv(inv), t.dst_inv(inv), RULES)


# Aggregations and first-match picks


@query
def collections(spark, sf_dir):
    return inventory.collections(t.placed(spark, sf_dir))


@query
def cores_by_collection(spark, sf_dir):
    return inventory.cores_by_collection(t.inv(spark, sf_dir))


@query
def cores_by_shard(spark, sf_dir):
    return inventory.cores_by_shard(t.inv(spark, sf_dir))


@query
def cores_by_node(spark, sf_dir):
    return inventory.cores_by_node(t.inv(spark, sf_dir))


@query
def core_status_by_node(spark, sf_dir):
    return inventory.core_status_by_node(t.inv(spark, sf_dir))


@query
def all_nodes(spark, sf_dir):
    return inventory.all_nodes(t.placed(spark, sf_dir))


@query
def shard_count(spark, sf_dir):
    inv = t.placed(spark, sf_dir)
    return inventory.shard_count(t.src_inv(inv), of=inventory.collections(inv))


@query
def core_health(spark, sf_dir):
    inv = t.stored_inv(spark, sf_dir)
    return inventory.core_health(inv, status.parse_core_status(t.status_documents(inv)))


@query
def cluster_health_rollup(spark, sf_dir):
    return inventory.cluster_health_rollup(t.placed(spark, sf_dir))


@query
def cluster_health(spark, sf_dir):
    return inventory.cluster_health(t.placed(spark, sf_dir))


@query
def leader_by_shard(spark, sf_dir):
    return inventory.leader_by_shard(t.inv(spark, sf_dir))


@query
def leader_by_snapshot(spark, sf_dir):
    yearly = F.date_trunc("year", "last_modified").cast("timestamp_ntz")
    return inventory.leader_by_shard(t.inv(spark, sf_dir).withColumn("snapshot_ts", yearly))


@query
def core_history(spark, sf_dir):
    """A collection per part and a core per supplier of it, as the line items of each year leave them."""
    return history.core_history(t.yearly_cores(spark, sf_dir))


@query
def core_to_best_by_snapshot(spark, sf_dir):
    yearly = F.date_trunc("year", "last_modified").cast("timestamp_ntz")
    inv = t.stored_inv(spark, sf_dir).withColumn("snapshot_ts", yearly)
    return inventory.core_to_best(inv, policy="freshest")


@query
def best_replica(spark, sf_dir):
    return inventory.best_replica(t.inv(spark, sf_dir))


@query
def best_replica_freshest(spark, sf_dir):
    return inventory.best_replica(t.inv(spark, sf_dir), policy="freshest")


@query
def core_to_best(spark, sf_dir):
    return inventory.core_to_best(t.stored_inv(spark, sf_dir))


# Status checks


def _status_of(inv):
    return inv.select(
        "collection", F.col("node").alias("host"), "core", "available", "num_docs", "version", "last_modified"
    )


@query
def data_match(spark, sf_dir):
    def side(inv, prefix, core):
        s = _status_of(inv)
        return s.select(core.alias("pair"), *[F.col(c).alias(prefix + c) for c in s.columns])

    inv = t.stored_inv(spark, sf_dir)
    src = side(t.src_inv(inv), "src_", F.col("core"))
    dst = side(t.dst_inv(inv), "dst_", map_reverse(F.col("core"), RULES))
    return verify.match_data(src.join(dst, "pair")).select(
        "src_core", "dst_core", "unavailable", "behind", "drift", "ok", "reason"
    )


@query
def post_copy_check(spark, sf_dir):
    inv = t.stored_inv(spark, sf_dir)
    src, dst = t.src_inv(inv), t.dst_inv(inv)
    plan = materialize(_plan(src, dst), "plan")
    return verify.post_copy_check(plan, _status_of(src), _status_of(dst))


@query
def diagnostics_summary(spark, sf_dir):
    return verify.diagnostics_summary(post_copy_check(spark, sf_dir))


@named("core_label")
def core_labels(spark, sf_dir):
    cols = [F.col(c) for c in ("node", "core", "available", "num_docs", "version")]
    return t.inv(spark, sf_dir).select("core", core_label(*cols).alias("label"))


@named("is_replicating")
def replicating_flags(spark, sf_dir):
    events = t.table(spark, sf_dir, "events")
    date = F.when(F.col("event_type") != "signup", F.col("props"))
    flag = (
        F.when(F.col("event_type") == "purchase", "FALSE")
        .when(F.col("event_type") == "view", " ")
        .otherwise("true")
    )
    return events.select("event_id", is_replicating(date, flag).alias("replicating"))


@query
def blank_test(spark, sf_dir):
    lines = t.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.select("doc_id", "line", blank(F.col("text")).alias("blank"))


@query
def json_path(spark, sf_dir):
    doc = F.concat(
        F.lit('{"response":{"numFound":'), F.col("n_chars").cast("string"), F.lit("}}")
    )
    return t.table(spark, sf_dir, "documents").select(
        "doc_id", cluster_state.found_documents(doc).alias("found")
    )


@named("source_gate")
def source_gates(spark, sf_dir):
    core = F.when(F.col("leader").isNotNull(), F.col("core"))
    ok, entity, reason = source_gate(core, F.col("available"))
    return t.inv(spark, sf_dir).select(
        "core", ok.alias("ok"), entity.alias("entity"), reason.alias("reason")
    )


# Actions


def _content_clone(spark, sf_dir, rules=None, **options):
    return clone.clone_collections(
        t.content_inv(spark, sf_dir),
        t.content_dst_inv(spark, sf_dir, rules),
        t.contents(spark, sf_dir),
        parse_rules(rules),
        **options,
    )


@query
def clone_collections(spark, sf_dir):
    return _content_clone(spark, sf_dir, replication_factor=1).diagnostics


@query
def clone_with_rename(spark, sf_dir):
    return _content_clone(
        spark, sf_dir, t.RULES, config_rules=CONFIG_RULES, replication_factor=4
    ).diagnostics


def _outcomes(done):
    """One row per violation, and per destination collection and shard with its outcome."""
    said = done.plan.violations.select(
        "collection", F.lit(None).cast("string").alias("shard"), F.lit("violation").alias("status"), "reason", F.lit(0).cast("long").alias("docs")
    )
    ran = done.diagnostics.select(F.col("dest_collection").alias("collection"), "shard", "status", "reason", "docs").distinct()
    return said.unionByName(ran)


@query
def clone_with_collisions(spark, sf_dir):
    """Names that meet at the destination, or do not lead back, are violations; the rest is copied."""
    empty = t.content_inv(spark, sf_dir).where("false")
    return _outcomes(
        clone.clone_collections(t.content_inv(spark, sf_dir), empty, t.contents(spark, sf_dir), parse_rules("src1:src"))
    )


@query
def clone_unmapped(spark, sf_dir):
    """Collections whose name holds the default text do not lead back."""
    def renamed(df):
        odd = F.col("collection").rlike("^src1[0-9]_")
        name = F.when(odd, F.replace("collection", F.lit("_collection"), F.lit("_copy_idx"))).otherwise(F.col("collection"))
        out = df.withColumn("collection", name)
        return out.withColumn("core", F.concat_ws("_", "collection", "shard", F.concat(F.lit("replica"), "rn"))) if "core" in df.columns else out

    src = renamed(t.content_inv(spark, sf_dir))
    return _outcomes(
        clone.clone_collections(src, src.where("false"), renamed(t.contents(spark, sf_dir)), parse_rules("default:_copy"))
    )


@query
def content_parity(spark, sf_dir):
    docs = t.contents(spark, sf_dir)
    other = docs.where("doc_id % 50 <> 7").withColumn(
        "text", F.when(F.col("doc_id") % 64 == 1, F.lit("")).otherwise(F.col("text"))
    )
    return verify.content_parity(docs, other)


@query
def apply_delete(spark, sf_dir):
    docs = t.contents(spark, sf_dir)
    plan = selection.delete_plan(docs, ["collection1", "src1_collection", "src7_collection", "no_such_collection"])
    left = spark.read.parquet(clone.apply_delete(docs, plan, shared_dir(spark, "after-delete")))
    return left.groupBy("collection").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))


@query
def content_diff(spark, sf_dir):
    docs = t.contents(spark, sf_dir)
    return difference.content_diff(docs, t.other_contents(docs))


@query
def clone_resumed(spark, sf_dir):
    """A clone that stops after its first wave and is started again: the check of its cores, and partitions that both runs wrote."""
    into = store.Store(shared_dir(spark, "store"))
    tables = t.content_inv(spark, sf_dir), t.content_dst_inv(spark, sf_dir, None), t.contents(spark, sf_dir), t.content_status(spark, sf_dir)
    size = tables[2].agg(F.sum(F.octet_length("text"))).first()[0]
    first = store.clone_into(into, *tables, wave_bytes=max(size // 3, 1), max_waves=1)
    second = store.clone_into(into, *tables, wave_bytes=max(size // 3, 1))
    written = [done.refreshed.partitions.where("action = 'written'").select("collection", "bits", "part") for done in (first, second)]
    twice = written[0].join(written[1], ["collection", "bits", "part"]).count()
    return second.diagnostics.withColumn("copied_twice", F.lit(twice).cast("long"))


@query
def clone_incremental(spark, sf_dir):
    """What a second copy does with each collection, after some documents have changed and a collection has gone."""
    into = store.Store(shared_dir(spark, "store"))
    docs = t.contents(spark, sf_dir)
    store.refresh(docs, into)
    done = store.refresh(t.later_contents(docs), into)
    return done.partitions.groupBy("collection").agg(F.max("action").alias("action"), F.sum("docs").alias("docs"))


@query
def drop_partitions(spark, sf_dir):
    """What a store holds after a delete plan was applied to its partitions, twice."""
    into = store.Store(shared_dir(spark, "store"))
    docs = t.contents(spark, sf_dir)
    store.refresh(docs, into)
    plan = selection.delete_plan(docs, ["collection1", "src1_collection", "src7_collection", "no_such_collection"])
    for _ in range(2):
        store.drop_collections(spark, into, plan)
    return store.read(spark, into).groupBy("collection").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))


@query
def full_backup(spark, sf_dir):
    return sync.full_backup(
        t.src_tree(spark, sf_dir).select("path", "data"),
        t.dst_tree(spark, sf_dir),
        t.content_inv(spark, sf_dir),
        t.content_dst_inv(spark, sf_dir, None),
        t.contents(spark, sf_dir),
    )[2]


@query
def clone_tree(spark, sf_dir):
    done = sync.clone_tree(
        t.src_tree(spark, sf_dir).select("path", "data"), t.dst_tree(spark, sf_dir)
    )
    return spark.read.parquet(done.path).select("path", F.md5("data").alias("digest"))


@query
def clone_aliases(spark, sf_dir):
    return sync.clone_aliases(
        t.src_alias(spark, sf_dir), t.dst_alias(spark, sf_dir)
    ).diagnostics


@query
def smoke_test(spark, sf_dir):
    return verify.smoke_test(_size_parity(spark, sf_dir), t.dst_inv(t.inv(spark, sf_dir)))


@query
def delete_plan(spark, sf_dir):
    return selection.delete_plan(
        t.contents(spark, sf_dir),
        ["collection1", "src1_collection", "src7_collection", "no_such_collection"],
    )


# Monitoring, as batch and as stream


@query
def completion_monitor(spark, sf_dir):
    return monitor.completion_monitor(t.progress(spark, sf_dir), TIMEOUT)


@query
def completion_summary(spark, sf_dir):
    return monitor.completion_summary(completion_monitor(spark, sf_dir))


@query
def latest_status(spark, sf_dir):
    return monitor.latest_status(t.progress(spark, sf_dir))


@query
def retry_gate(spark, sf_dir):
    return monitor.retry_gate(t.progress(spark, sf_dir), MAX_FAILURES)


@query
def retry_verdict(spark, sf_dir):
    progress = t.progress(spark, sf_dir)
    gates = monitor.retry_gate(progress, MAX_FAILURES)
    return monitor.retry_verdict(gates, progress.where("status = 'done'").select("core"))


def _streamed(spark, sf_dir, run, **options):
    out = shared_dir(spark, "stream")
    run(t.progress_stream(spark, sf_dir), out, **options).awaitTermination()
    return spark.read.parquet(out)


@query
def completion_monitor_stream(spark, sf_dir):
    return streaming.read_completion(
        _streamed(spark, sf_dir, streaming.run_completion), TIMEOUT
    )


@query
def latest_status_stream(spark, sf_dir):
    return streaming.read_latest(_streamed(spark, sf_dir, streaming.run_latest))


@query
def retry_gate_stream(spark, sf_dir):
    return streaming.read_retry_gate(
        _streamed(spark, sf_dir, streaming.run_samples), MAX_FAILURES
    )


@query
def overdue_alarms_stream(spark, sf_dir):
    out = shared_dir(spark, "alarms")
    stream = t.progress_stream(spark, sf_dir)
    streaming.run_overdue(stream, out, timeout=TIMEOUT).awaitTermination()
    return streaming.read_alarms(spark.read.parquet(f"{out}/alarms"))


@query
def overdue_timers_stream(spark, sf_dir):
    """The alarms by timers in the state store; schema and rows are those of the alarms by a table of requests."""
    out = shared_dir(spark, "alarms")
    timers.run_overdue_timers(t.progress_stream(spark, sf_dir), out, timeout=TIMEOUT).awaitTermination()
    return spark.read.schema("req string, started timestamp_ntz").parquet(out)
