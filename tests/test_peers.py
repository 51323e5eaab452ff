import json
import random

import pytest
from pyspark.sql import functions as F

from mirrorkeep.functions.naming import Rules, parse_rules
from mirrorkeep.operators import inventory, matching, selection, verify
from tests.helpers import collection, draw, inv, replica, rows

def plain_peers(src, dst, forward, back, wanted=None, fallback="first_two"):
    """What the rule says, row by row."""
    known = {c["collection"] for c in src if wanted is None or c["collection"] in wanted}
    out = set()
    for d in dst:
        name, core = back(d["collection"]), back(d["core"])
        if name not in known:
            continue
        mine = {c["core"]: c for c in src if c["collection"] == name}
        key = core.split("_replica")[0]
        found, how = mine.get(core), "exact"
        for n in (1, 2):
            if found is None:
                found, how = mine.get(f"{key}_replica{n}"), f"replica{n}"
        if found is None and fallback == "any":
            same = sorted((c for c in mine.values() if c["core"].split("_replica")[0] == key), key=lambda c: c["rn"])
            found, how = (same[0], "any") if same else (None, None)
        out.add((d["core"], d["node"], *((found["core"], found["node"], how) if found else (core, None, "unmatched"))))
    return out


def renamed(state, forward):
    """The snapshot under destination names."""
    text = json.dumps(state)
    for name in sorted(state, key=len, reverse=True):
        text = text.replace(f'"{name}"', f'"{forward(name)}"').replace(f'"{name}_part', f'"{forward(name)}_part')
    return json.loads(text)


RENAMES = {
    "none": (Rules(), lambda n: n, lambda n: n),
    "rules": (
        parse_rules("_idx:_index9,default:_mirror"),
        lambda n: n.replace("_idx", "_index9") if "_idx" in n else n + "_mirror",
        lambda n: n.replace("_index9", "_idx") if "_index9" in n else n.replace("_mirror", ""),
    ),
}


@pytest.mark.parametrize("fallback", ["first_two", "any"])
@pytest.mark.parametrize("rename", RENAMES)
@pytest.mark.parametrize("seed", [11, 12, 13])
def test_peers_against_plain_python(spark, seed, rename, fallback):
    rules, forward, back = RENAMES[rename]
    names = ("alpha", "beta_idx", "gamma_idx", "delta", "only_here")
    (src, src_cells), (dst, dst_cells) = draw(seed, names[:4]), draw(seed + 100, names[1:])
    dst_cells = [c | {"collection": forward(c["collection"]), "core": forward(c["collection"]) + c["core"][len(c["collection"]):]} for c in dst_cells]
    found = matching.peer_match(inv(spark, src), inv(spark, renamed(dst, forward)), rules, fallback=fallback)
    got = {tuple(r[c] for c in ("dest_core", "dest_node", "source_core", "source_node", "how")) for r in found.collect()}
    assert got == plain_peers(src_cells, dst_cells, forward, back, fallback=fallback)
    assert found.count() == len(got)
    drift = matching.inventory_drift(inv(spark, src), inv(spark, renamed(dst, forward)), rules)
    there = {forward(c["collection"]) + c["core"][len(c["collection"]):] for c in src_cells}
    sides = {c: "source only" for c in there} | {c["core"]: "both" if c["core"] in there else "destination only" for c in dst_cells}
    assert dict(rows(drift, "dest_core", "side")) == sides


def test_only_wanted_collections_are_matched(spark):
    (src, src_cells), (dst, dst_cells) = draw(21), draw(22)
    wanted = selection.requested(spark, ["delta", "beta_idx", "nowhere"])
    found = matching.peer_match(inv(spark, src), inv(spark, dst), Rules(), wanted)
    got = {tuple(r[c] for c in ("dest_core", "dest_node", "source_core", "source_node", "how")) for r in found.collect()}
    assert got == plain_peers(src_cells, dst_cells, None, lambda n: n, {"delta", "beta_idx", "nowhere"})


def test_a_longer_number_is_another_replica(spark):
    def one(number, host):
        return inv(spark, {"m": collection({"part0": [replica(f"m_part0_replica{number}", host)]})})

    assert rows(matching.peer_match(one(12, "a"), one(1, "b"), Rules()), "source_core", "source_node", "how") == [
        ("m_part0_replica1", None, "unmatched")
    ]


def one_shard(name, hosts, first=1):
    return {name: collection({"shard1": [replica(f"{name}_shard1_replica{i}", h) for i, h in enumerate(hosts, first)]})}


def test_pairs_of_clusters_stay_apart(spark, small_groups_hot):
    def side(east, west):
        return inv(spark, east).withColumn("cluster", F.lit("east")).unionByName(
            inv(spark, west).withColumn("cluster", F.lit("west"))
        )

    src = side(one_shard("films", ["e1"]), one_shard("films", ["w1", "w2"]))
    dst = side(one_shard("films", ["d1", "d2"]), one_shard("films", ["x1", "x2"]))
    found = matching.peer_match(src, dst, Rules())
    assert rows(found, "cluster", "dest_node", "source_node", "how") == [
        ("east", "d1", "e1", "exact"), ("east", "d2", "e1", "replica1"),
        ("west", "x1", "w1", "exact"), ("west", "x2", "w2", "exact"),
    ]
    up = src.withColumn("available", F.col("node") != "w1")
    plan = matching.replication_plan(found, inventory.core_to_best(up))
    assert rows(plan, "cluster", "dest_node", "source_node") == [
        ("east", "d1", "e1"), ("east", "d2", "e1"), ("west", "x1", "w2"), ("west", "x2", "w2"),
    ]
    drift = matching.inventory_drift(src, dst, Rules())
    assert rows(drift, "cluster", "dest_core", "side") == [
        ("east", "films_shard1_replica1", "both"),
        ("east", "films_shard1_replica2", "destination only"),
        ("west", "films_shard1_replica1", "both"),
        ("west", "films_shard1_replica2", "both"),
    ]


def status(spark, table):
    return spark.createDataFrame(
        table,
        "collection string, shard string, core string, rn int, node string, available boolean,"
        " version long, last_modified timestamp_ntz",
    )


def test_best_replica_and_plan(spark):
    src = status(
        spark,
        [
            ("a", "shard1", "a_shard1_replica1", 1, "h1", False, 9, None),
            ("a", "shard1", "a_shard1_replica2", 2, "h2", True, 5, None),
            ("a", "shard1", "a_shard1_replica3", 3, "h3", True, 7, None),
            # The same shard name in another collection stays apart.
            ("b", "shard1", "b_shard1_replica1", 1, "h1", False, 1, None),
        ],
    )
    assert rows(inventory.best_replica(src)) == [("a", "shard1", "a_shard1_replica2", "h2")]
    fresh = inventory.best_replica(src, policy="freshest")
    assert rows(fresh, "best_core") == [("a_shard1_replica3",)]
    best = inventory.core_to_best(src)
    assert rows(best, "core", "best_core") == [
        ("a_shard1_replica1", "a_shard1_replica2"),
        ("a_shard1_replica2", "a_shard1_replica2"),
        ("a_shard1_replica3", "a_shard1_replica2"),
        ("b_shard1_replica1", None),
    ]
    with pytest.raises(ValueError):
        inventory.best_replica(src, policy="random")
    found = matching.peer_match(src, src, Rules())
    plan = matching.replication_plan(found, best)
    assert rows(plan, "dest_core", "source_core", "ok") == [
        ("a_shard1_replica1", "a_shard1_replica2", True),
        ("a_shard1_replica2", "a_shard1_replica2", True),
        ("a_shard1_replica3", "a_shard1_replica2", True),
        ("b_shard1_replica1", None, False),
    ]
    with pytest.raises(RuntimeError):
        matching.replication_plan(found, best, skip_failures=False)


def test_freshest_breaks_ties_by_time_then_name(spark):
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    src = status(
        spark,
        [
            ("a", "s", "a_s_replica1", 1, "h1", True, 5, None),
            ("a", "s", "a_s_replica2", 2, "h2", True, 5, day),
            ("a", "s", "a_s_replica4", 4, "h4", True, 5, day + dt.timedelta(days=1)),
            ("a", "s", "a_s_replica3", 3, "h3", True, 5, day + dt.timedelta(days=1)),
            ("a", "s", "a_s_replica0", 0, "h0", True, None, day + dt.timedelta(days=9)),
        ],
    )
    assert rows(inventory.best_replica(src, "freshest"), "best_core") == [("a_s_replica3",)]


def test_every_core_is_matched_once_in_a_hot_shard(spark, small_groups_hot):
    wide = one_shard("songs", [f"s{i}" for i in range(40)]), one_shard("songs", [f"d{i}" for i in range(60)])
    got = matching.peer_match(inv(spark, wide[0]), inv(spark, wide[1]), Rules()).collect()
    assert len(got) == len({r["dest_core"] for r in got}) == 60
    assert all(r["source_core"] == r["dest_core"] for r in got if r["how"] == "exact")
    assert sum(r["how"] == "replica1" for r in got) == 20


def test_both_clusters_are_shuffled_once(spark, monkeypatch):
    """Rows equal those of the operators one by one, with repeated, missing and default names; without a hot collection there is one shuffle by collection."""
    dice, rules = random.Random(5), parse_rules("_collection:_twin,default:_copy")

    def side(there):
        cells = []
        for _ in range(400):
            c, shard = dice.choice(["a_collection", "b_idx", "collection1", None, "c_collection"]), dice.choice(["shard1", "shard2", "shard3", None])
            n = dice.choice([1, 2, 3, 4, None])
            if there and c and c != "collection1":
                c = c.replace("_collection", "_twin") if "_collection" in c else f"{c}_copy"
            core = None if c is None or n is None else f"{c}_{shard if dice.random() < 0.9 else 'shard1'}_replica{n}"
            cells.append((dice.choice(["e", "w", None]), c, shard, core, n if dice.random() < 0.9 else None, dice.choice(["h1:8", "h2", None]), dice.choice([True, False, None])))
        return spark.createDataFrame(cells, "cluster string, collection string, shard string, core string, rn int, node string, available boolean")

    src, dst = side(False), side(True)
    peers, plan = matching.peer_match(src, dst, rules), matching.copy_plan(src, dst, rules)
    for df in (peers, plan):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text
    monkeypatch.setattr(matching, "_met", lambda *args: None)
    apart = matching.peer_match(src, dst, rules)
    assert rows(peers) == rows(apart) and peers.count()
    assert rows(plan) == rows(matching.replication_plan(apart, inventory.core_to_best(src)))


def test_refused_requests_are_not_shuffled(spark, tmp_path):
    """Each outcome of the check; requests without a source go past both joins, and of an unavailable replica nothing but that is sent."""
    cells = [(f"{c}", "src", c, c != "refused", "" if c != "refused" else "no source") for c in ("fine", "behind", "down", "odd", "gone", "refused")]
    spark.createDataFrame([("dst", d, s, c, ok, r) for d, s, c, ok, r in cells], "dest_collection string, dest_core string, collection string, source_core string, ok boolean, reason string").write.parquet(str(tmp_path / "plan"))
    fields = "collection string, host string, core string, available boolean, num_docs int, version long, last_modified timestamp_ntz"
    src = spark.createDataFrame([("src", "h", c, True, 1, 5, None) for c, *_ in cells], fields)
    there = [("fine", True, 5), ("behind", True, 4), ("down", False, 3), ("odd", None, 3), ("refused", True, 5)]
    dst = spark.createDataFrame([("dst", "h", c, up, 1, v, None) for c, up, v in there], fields)
    got = verify.post_copy_check(spark.read.parquet(str(tmp_path / "plan")), src, dst)
    down = "Replication Failed since source Core is not available.."
    assert [r[1:] for r in rows(got)] == [
        ("behind", "behind", "failed", "DataMatch-Failed: Version mismatch: this:5 replica:4"),
        ("down", "down", "failed", down),
        ("fine", "fine", "ok", ""),
        ("gone", "gone", "unverified", "no status of the replica"),
        ("odd", "odd", "failed", down),
        ("refused", "refused", "failed", "no source"),
    ]
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter coalesce(ok" in text and "CASE WHEN available" in text
