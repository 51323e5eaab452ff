import json
import re

import pytest
from pyspark.sql import functions as F

from mirrorkeep.common import NO_LEADER
from mirrorkeep.operators import inventory, selection
from mirrorkeep.sources import cluster_state, tree
from tests.helpers import HOSTS, collection, docs, draw, inv, ordered, replica, rows


@pytest.fixture(scope="module", params=[1, 2])
def drawn(request):
    return draw(request.param)


def test_scanned_state_and_flat_inventory(spark, drawn):
    state, cells = drawn
    scanned = cluster_state.scan_cluster_state(docs(spark, state))
    names = ("collection", "shard", "core", "state", "leader")
    assert rows(scanned, *names) == ordered(tuple(c[n] for n in names) for c in cells)
    extra = scanned.select("max_shards_per_node", "replication_factor", "shard_state").distinct()
    assert rows(extra) == [(7, 3, "active")]
    ranges = {(c, s): body["range"] for c, one in state.items() for s, body in one["shards"].items()}
    assert {(r["collection"], r["shard"]): r["range"] for r in scanned.collect()} == ranges
    flat = cluster_state.flatten_state(scanned)
    names = ("collection", "shard", "core", "rn", "node", "state", "leader")
    assert rows(flat, *names) == ordered(tuple(c[n] for n in names) for c in cells)


def test_unknown_keys_are_ignored_and_bad_documents_rejected(spark, drawn):
    state, cells = drawn
    state = state | {"alpha": state["alpha"] | {"novel": {"deep": [1, 2]}}}
    table = docs(spark, state, "[1,", " ", "", None)
    assert cluster_state.scan_cluster_state(table).count() == len(cells)
    assert cluster_state.rejected_documents(table).count() == 4


def test_read_and_stream_snapshot_files(spark, tmp_path, drawn):
    state, cells = drawn
    folder = tmp_path / "snapshots"
    folder.mkdir()
    sizes = []
    for i, (name, body) in enumerate(state.items()):
        text = json.dumps({name: body}, indent=i)
        sizes.append((len(text.encode()),))
        (folder / f"{i}.json").write_text(text)
    table = cluster_state.read_documents(spark, str(folder))
    assert cluster_state.scan_cluster_state(table).count() == len(cells)
    assert rows(table, "bytes") == sorted(sizes)
    assert rows(cluster_state.state_size(table)) == [(sum(n for (n,) in sizes),)]

    stream = cluster_state.stream_documents(spark, str(folder))
    out = str(tmp_path / "out")
    (
        cluster_state.scan_cluster_state(stream)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    assert spark.read.parquet(out).count() == len(cells)


def test_aliases(spark):
    pairs = {f"a{i}": f"target{i % 3}" for i in range(7)}
    table = docs(spark, {"collection": pairs}, {"other": {"x": "y"}}, "{}", None)
    assert dict(rows(cluster_state.scan_aliases(table))) == pairs


def test_nodes_and_collections(spark, drawn):
    state, cells = drawn
    flat = inv(spark, state)
    nodes = ordered({(c["node"],) for c in cells})
    assert rows(inventory.all_nodes(flat)) == nodes
    assert rows(inventory.live_nodes(flat)) == ordered({(c["node"],) for c in cells if c["state"] == "active"})
    assert rows(inventory.collections(flat)) == ordered((n,) for n in state)


def test_live_node_list(spark):
    table = docs(spark, [f"{h}:{p}_solr" for h in ("x", "y") for p in (1, 2)], ["z:3_solr"], "[]", None)
    assert rows(cluster_state.scan_live_nodes(table)) == [("x",), ("y",), ("z",)]


def test_hosts_are_translated(spark):
    state, cells = draw(5)
    flat = inv(spark, state).select("core", "node")
    public = {h: f"pub-{h}" for h in HOSTS[:4]}
    hosts = spark.createDataFrame([*public.items(), ("unused", "u")], "private string, public string")
    got = inventory.translate_hosts(flat, hosts)
    assert rows(got, "core", "public") == ordered((c["core"], public.get(c["node"])) for c in cells)
    with pytest.raises(ValueError):
        inventory.translate_hosts(flat, None)


def test_large_host_map_is_not_broadcast(spark, monkeypatch, small_groups_hot):
    monkeypatch.setattr(inventory, "MAX_BROADCAST_HOSTS", 1)
    test_hosts_are_translated(spark)


def test_core_without_number_comes_last(spark):
    table = spark.createDataFrame(
        [("c", "s", "odd", None, "h0:1_solr", "h0", "true", True),
         ("c", "s", "c_s_replica7", 7, "h7:1_solr", "h7", "true", True)],
        "collection string, shard string, core string, rn int, node_name string, node string,"
        " leader string, available boolean",
    )
    assert rows(inventory.best_replica(table), "best_core") == [("c_s_replica7",)]
    assert rows(inventory.leader_by_shard(table), "leader") == [("h7:1_solr,c_s_replica7",)]


def test_views_by_collection_shard_and_node(spark, drawn):
    state, cells = drawn
    flat = inv(spark, state)
    cores = ordered((c["collection"], c["core"], c["node"]) for c in cells)
    assert rows(inventory.cores_by_collection(flat)) == cores
    assert rows(inventory.cores_by_shard(flat), "collection", "core", "node") == cores
    assert rows(inventory.cores_by_node(flat), "node", "core", "copies") == ordered((c["node"], c["core"], 1) for c in cells)
    states = rows(inventory.core_status_by_node(flat), "node", "core", "state")
    assert states == ordered((c["node"], c["core"], c["state"]) for c in cells)


def test_leaders(spark, drawn):
    state, cells = drawn
    want = {(c["collection"], c["shard"]): NO_LEADER for c in cells}
    for c in sorted(cells, key=lambda c: -c["rn"]):
        if (c["leader"] or "").lower() == "true":
            want[c["collection"], c["shard"]] = f"{c['node']}:9000_solr,{c['core']}"
    got = {(r["collection"], r["shard"]): r["leader"] for r in inventory.leader_by_shard(inv(spark, state)).collect()}
    assert got == want


def test_default_collection_is_told_by_its_whole_name(spark):
    state = {
        name: collection({"shard1": [replica(f"{name}_shard1_replica1", "h")]})
        for name in ("collection1", "collection10", "x_collection1")
    }
    flat = inv(spark, state)
    assert rows(inventory.cores_by_shard(flat), "collection") == [
        ("collection10",),
        ("x_collection1",),
    ]
    assert inventory.cores_by_collection(flat).count() == 3
    assert rows(selection.select_collections(flat)) == [("collection10",), ("x_collection1",)]


def test_last_of_a_repeated_core_wins(spark):
    table = spark.createDataFrame(
        [("c", "shard1", "c_shard1_replica1", 1, "old", "active"),
         ("c", "shard1", "c_shard1_replica1", 2, "new", "down")],
        "collection string, shard string, core string, rn int, node string, state string",
    )
    assert rows(inventory.cores_by_collection(table), "node") == [("new",)]
    assert rows(inventory.cores_by_shard(table), "node") == [("new",)]


def test_shard_count_of_unknown_collection_is_zero(spark, drawn):
    state, _ = drawn
    wanted = selection.requested(spark, ["delta", "nowhere"])
    got = rows(inventory.shard_count(inv(spark, state), of=wanted))
    assert got == [("delta", len(state["delta"]["shards"])), ("nowhere", 0)]


def test_cluster_and_snapshot_columns_keep_clusters_apart(spark):
    (one, first), (two, second) = draw(3), draw(4)
    both = inv(spark, one).withColumn("cluster", F.lit("p")).unionByName(inv(spark, two).withColumn("cluster", F.lit("q")))
    alone = [("p", inventory.leader_by_shard(inv(spark, one))), ("q", inventory.leader_by_shard(inv(spark, two)))]
    want = ordered((c, *r) for c, df in alone for r in rows(df, "collection", "shard", "leader"))
    assert rows(inventory.leader_by_shard(both), "cluster", "collection", "shard", "leader") == want
    counts = ordered({(c, r["collection"], len({x["shard"] for x in cells if x["collection"] == r["collection"]})) for c, cells in (("p", first), ("q", second)) for r in cells})
    assert rows(inventory.shard_count(both), "cluster", "collection", "shards") == counts


def test_selection(spark, drawn):
    state, _ = drawn
    flat = inv(spark, state)

    def pick(**options):
        return [r[0] for r in rows(selection.select_collections(flat, **options))]

    everything = sorted(state)
    assert pick(names=["aLL"]) == pick(include="\t", exclude="") == everything
    assert pick(include="idx") == ["beta_idx", "gamma_idx"]
    # Leaving out without taking in starts from all collections.
    assert pick(exclude="a_idx") == ["alpha", "delta"]
    assert pick(include="a", exclude="mm") == ["alpha", "beta_idx", "delta"]
    # A list is taken as given, without the filters.
    assert pick(names=["delta", "nowhere"], include="idx") == ["delta", "nowhere"]
    with pytest.raises(ValueError):
        selection.select_collections(flat, [])
    wanted = selection.requested(spark, ["delta", "nowhere"])
    assert rows(selection.missing_in_source(wanted, flat)) == [("nowhere",)]


def test_collection_config(spark):
    cols = spark.createDataFrame([("a",), ("b",), ("gone",)], "collection string")
    meta = spark.createDataFrame(
        [("a", '{"configName":"cfg","router":"implicit"}'), ("b", None)],
        "collection string, doc string",
    )
    got = rows(cluster_state.collection_config(cols, meta))
    assert got == [("a", "cfg", None), ("b", None, "no metadata")]
    with pytest.raises(LookupError):
        cluster_state.collection_config(cols, meta, strict=True)


def test_config_names(spark):
    paths = ["/configs", "/configs/collection1/a.xml", "/configs/cfg/b.xml", "/configs/cfg", "/other/x"]
    table = spark.createDataFrame([(p, "") for p in paths], "path string, data string")
    assert rows(tree.config_names(table)) == [("cfg",), ("collection1",)]


def test_found_documents(spark):
    table = docs(spark, {"response": {"numFound": 12, "docs": []}}, "{}")
    got = table.select(cluster_state.found_documents(F.col("doc")).alias("n"))
    assert rows(got) == [(None,), (12,)]


def test_a_shard_does_not_carry_its_collection_nor_a_replica_its_shard(spark, drawn):
    scanned = cluster_state.scan_cluster_state(docs(spark, drawn[0]))
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    carried = re.findall(r"Generate explode\([^)]*\), \[([^\]]*)\]", plan)
    assert len(carried) == 2
    assert not any(re.search(r"\b[cs]#", names) for names in carried), carried
