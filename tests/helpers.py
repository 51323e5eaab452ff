"""Snapshots drawn at random, and small conversions."""

import json
import random

from mirrorkeep.sources.cluster_state import flatten_state, scan_cluster_state

STATES = ["active", "recovering", "down", "gone"]
HOSTS = [f"node{c}" for c in "abcdefg"]


def replica(core, host, state="active", leader=None, port=9000):
    out = {"state": state, "base_url": f"http://{host}:{port}/s", "core": core, "node_name": f"{host}:{port}_solr"}
    return out if leader is None else out | {"leader": leader}


def collection(shards, factor="3", limit="7"):
    """``shards`` maps a shard's name to its replicas."""
    body = {
        name: {"range": f"{i:x}0-{i:x}f", "state": "active", "replicas": {f"r{j}": r for j, r in enumerate(replicas)}}
        for i, (name, replicas) in enumerate(shards.items())
    }
    return {"shards": body, "maxShardsPerNode": limit, "router": {"name": "plain"}, "replicationFactor": factor}


def draw(seed, names=("alpha", "beta_idx", "gamma_idx", "delta")):
    """A snapshot and its replicas as plain rows."""
    dice, state, cells = random.Random(seed), {}, []
    for name in names:
        shards = {}
        for s in range(dice.randint(1, 5)):
            shard = f"part{s}"
            numbers = sorted(dice.sample(range(1, 13), dice.randint(1, 6)))
            for n in numbers:
                core = f"{name}_{shard}_replica{n}"
                row = {"collection": name, "shard": shard, "core": core, "rn": n, "node": dice.choice(HOSTS),
                       "state": dice.choice(STATES), "leader": dice.choice([None, None, "true", "false", "TRUE"])}
                cells.append(row)
                shards.setdefault(shard, []).append(replica(core, row["node"], row["state"], row["leader"]))
            dice.shuffle(shards[shard])
        state[name] = collection(shards)
    return state, cells


def docs(spark, *states):
    rows = [(s if isinstance(s, str) or s is None else json.dumps(s),) for s in states]
    return spark.createDataFrame(rows, "doc string")


def inv(spark, state):
    return flatten_state(scan_cluster_state(docs(spark, state)))


def rows(df, *cols):
    return ordered(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


def ordered(found):
    return sorted(found, key=lambda r: tuple((v is not None, v) for v in r))
