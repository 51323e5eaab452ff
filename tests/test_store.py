"""Differences by trees of digests, and copies in partitions: resumed, brought up to date, dropped from."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mirrorkeep.operators import difference, selection
from mirrorkeep.plans import store as stores
from mirrorkeep.plans.store import Store
from tests.helpers import rows
from tests.test_clone import INV, inv

FIELDS = "collection string, shard string, doc_id long, text string, size int"


def drawn(seed, n=400):
    dice = random.Random(seed)
    names = ["big", "big", "big", "small", "odd/ name=1"]
    return [(dice.choice(names), f"s{dice.randrange(3)}", i if dice.random() < 0.97 else None, dice.choice([None, "", f"text {i}"]), dice.choice([None, i])) for i in range(n)]


def changed(cells, seed):
    """Some documents changed, some gone, some new, some twice."""
    dice, out = random.Random(seed), []
    for c in cells:
        kind = dice.random()
        if kind < 0.02:
            continue
        out.append(c if kind > 0.06 else (*c[:3], "changed", c[4]))
        if kind > 0.98:
            out.append(c)
    return out + [("new", "s0", 5000 + i, "n", 1) for i in range(3)]


def plain_diff(a, b):
    def documents(cells):
        out = {}
        for c in cells:
            out.setdefault(c[:3], Counter())[c[3:]] += 1
        return out

    a, b = documents(a), documents(b)
    ops = {k: "add" if k not in b else "remove" if k not in a else "replace" for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
    return Counter((*k, op) for k, op in ops.items())


@pytest.mark.parametrize("levels", [(0, 6, 12), (0, 1, 2, 3), (4,)])
def test_difference_equals_plain_comparison(spark, levels):
    a = drawn(1)
    b = changed(a, 2)
    got = difference.content_diff(spark.createDataFrame(a, FIELDS), spark.createDataFrame(b, FIELDS).repartition(5), levels=levels)
    assert got.columns == ["collection", "shard", "doc_id", "op"]
    assert Counter(map(tuple, got.collect())) == plain_diff(a, b)


def test_equal_and_empty_tables_do_not_differ(spark):
    a, none = spark.createDataFrame(drawn(3), FIELDS), spark.createDataFrame([], FIELDS)
    assert difference.content_diff(a, a.repartition(3)).collect() == []
    assert difference.content_diff(none, none).collect() == []
    assert {r["op"] for r in difference.content_diff(a, none).collect()} == {"add"}
    assert {r["op"] for r in difference.content_diff(none, a).collect()} == {"remove"}


def test_clusters_differ_apart(spark):
    a = spark.createDataFrame(drawn(4), FIELDS)
    east, west = (a.withColumn("cluster", F.lit(c)) for c in ("east", "west"))
    other = west.where("not doc_id <=> 7 and not doc_id <=> 8")
    got = difference.content_diff(east.unionByName(west), east.unionByName(other))
    assert rows(got, "cluster", "doc_id", "op") == [("west", 7, "add"), ("west", 8, "add")]


def test_tree_levels_add_up(spark):
    tree = difference.range_tree(spark.createDataFrame(drawn(5), FIELDS))
    sums = tree.groupBy("collection", "shard", "level").agg(F.sum("docs").alias("docs"), F.sum("digest").alias("digest"))
    per_shard = sums.groupBy("collection", "shard").agg(F.countDistinct("docs", "digest").alias("n"))
    assert {r["n"] for r in per_shard.collect()} == {1}
    assert tree.where("level = 0").select("node").distinct().count() == 1


def test_only_differing_ranges_are_open(spark):
    a = [("c", "s", i, f"t{i}", 1) for i in range(3000)]
    b = [(*r[:3], "x" if r[2] == 1234 else r[3], 1) for r in a]
    a, b = (difference.range_tree(spark.createDataFrame(x, FIELDS)) for x in (a, b))
    assert difference.differing_ranges(a, b).count() == 1
    # Children of equal ranges are not looked at: a leaf that differs below an equal parent stays closed.
    odd = b.withColumn("docs", F.when((F.col("level") == 12) & (F.col("node") % 64 != 0), F.col("docs") + 1).otherwise(F.col("docs")))
    assert difference.differing_ranges(a, odd).count() <= 64


def test_difference_reads_partitions_of_differing_ranges_only(spark, tmp_path):
    cells = [("c", "s", i, f"t{i}" * 20, 1) for i in range(2000)]
    into = Store(str(tmp_path / "store"))
    docs = spark.createDataFrame(cells, FIELDS)
    stores.refresh(docs, into, partition_bytes=8000)
    there = stores.read(spark, into)
    assert there.select("bits", "part").distinct().count() == 32
    leaves = docs.where("doc_id = 5").select("collection", "shard", difference.id_range("doc_id", 12).alias("node"))
    near = difference._within(spark.read.schema(there.schema).parquet(into.at("data")), leaves, "doc_id", 12)
    assert 5 in {r["doc_id"] for r in near.collect()} and near.count() < 10
    # The partitions are chosen before any file is opened.
    assert "PartitionFilters: [concat_ws(/, collection" in near._jdf.queryExecution().executedPlan().toString()
    got = difference.content_diff(docs.withColumn("text", F.when(F.col("doc_id") == 5, "new").otherwise(F.col("text"))), there)
    assert rows(got, "doc_id", "op") == [(5, "replace")]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def table(df):
    return Counter(map(tuple, df.select("collection", "shard", "doc_id", "text", "size").collect()))


@pytest.mark.parametrize("partition_bytes", [1 << 28, 900])
def test_store_holds_what_it_was_given(spark, tmp_path, partition_bytes):
    into = Store(str(tmp_path / "store"))
    a = drawn(6)
    b = changed(a, 7)
    for cells in (a, b, b, [], a):
        done = stores.refresh(spark.createDataFrame(cells, FIELDS).repartition(3), into, partition_bytes=partition_bytes)
        assert done.finished and "failed" not in {r["action"] for r in done.partitions.collect()}
        assert table(stores.read(spark, into)) == Counter(cells)


def test_a_stopped_copy_goes_on_with_the_rest(spark, tmp_path):
    into = Store(str(tmp_path / "store"))
    cells = [(f"c{i % 10}", "s", i, "text" * 50, 1) for i in range(1000)]
    docs = spark.createDataFrame(cells, FIELDS)
    first = stores.refresh(docs, into, wave_bytes=60_000, max_waves=2)
    written = first.partitions.where("action = 'written'").count()
    assert not first.finished and 0 < written < 10
    assert first.partitions.where("action = 'waiting'").count() == 10 - written
    before = files(into.at("data"))
    second = stores.refresh(docs, into, wave_bytes=60_000)
    assert {r["action"]: r["count"] for r in second.partitions.groupBy("action").count().collect()} == {"kept": written, "written": 10 - written}
    after = files(into.at("data"))
    assert all(after[f] == t for f, t in before.items()) and table(stores.read(spark, into)) == Counter(cells)


def test_a_run_that_breaks_between_write_and_commit(spark, tmp_path, monkeypatch):
    into = Store(str(tmp_path / "store"))
    docs = spark.createDataFrame(drawn(8), FIELDS)
    with monkeypatch.context() as m:
        m.setattr(stores, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            stores.refresh(docs, into)
    assert stores.read(spark, into).count() == 0
    stores.refresh(docs, into)
    assert table(stores.read(spark, into)) == Counter(drawn(8))


def test_second_copy_writes_changed_partitions_only(spark, tmp_path):
    into = Store(str(tmp_path / "store"))
    cells = [(f"c{i % 100}", "s", i, f"text {i}", 1) for i in range(2000)]
    stores.refresh(spark.createDataFrame(cells, FIELDS), into)
    before = files(into.at("data"))
    later = [(*c[:3], "changed", 1) if c[0] == "c42" else c for c in cells]
    done = stores.refresh(spark.createDataFrame(later, FIELDS), into)
    after = files(into.at("data"))
    new = {f for f in after if before.get(f) != after[f]}
    assert len(before) == 100 and len(new) == 1 and all("collection=c42/" in f for f in new)
    assert done.partitions.where("action = 'kept'").count() == 99 and table(stores.read(spark, into)) == Counter(later)


def test_grown_collections_are_cut_anew(spark, tmp_path):
    into = Store(str(tmp_path / "store"))
    small = [("c", "s", i, "t" * 100, 1) for i in range(50)]
    stores.refresh(spark.createDataFrame(small, FIELDS), into, partition_bytes=10_000)
    large = [("c", "s", i, "t" * 100, 1) for i in range(3000)]
    stores.refresh(spark.createDataFrame(large, FIELDS), into, partition_bytes=10_000)
    there = stores.read(spark, into)
    assert table(there) == Counter(large) and there.select("part").distinct().count() == 64


def test_dropping_rewrites_nothing_and_may_be_repeated(spark, tmp_path, monkeypatch):
    into = Store(str(tmp_path / "store"))
    cells = drawn(9) + [("collection1", "s0", 1, "kept", 1)]
    docs = spark.createDataFrame(cells, FIELDS)
    stores.refresh(docs, into, partition_bytes=900)
    before = files(into.at("data"))
    plan = selection.delete_plan(docs, ["odd/ name=1", "small", "collection1", "nowhere"])
    left = Counter(c for c in cells if c[0] in ("big", "collection1"))
    with monkeypatch.context() as m:
        m.setattr(stores, "remove", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            stores.drop_collections(spark, into, plan)
    # Marked partitions are out of sight before they are deleted.
    assert files(into.at("data")) == before and table(stores.read(spark, into)) == left
    assert stores.drop_collections(spark, into, plan) > 0
    after = files(into.at("data"))
    assert all(before[f] == t for f, t in after.items()) and not [f for f in after if "small" in f or "odd" in f]
    assert stores.drop_collections(spark, into, plan) == 0 and table(stores.read(spark, into)) == left
    # A later copy brings them back.
    stores.refresh(docs, into, partition_bytes=900)
    assert table(stores.read(spark, into)) == Counter(cells)


def test_clusters_share_a_store(spark, tmp_path):
    into = Store(str(tmp_path / "store"))
    a = spark.createDataFrame(drawn(10), FIELDS)
    both = a.withColumn("cluster", F.lit("east")).unionByName(a.withColumn("cluster", F.lit("west")))
    stores.refresh(both, into)
    plan = selection.delete_plan(both, ["big"], cluster="west")
    stores.drop_collections(spark, into, plan)
    left = {(r["cluster"], r["collection"]) for r in stores.read(spark, into).select("cluster", "collection").distinct().collect()}
    assert ("east", "big") in left and ("west", "big") not in left and ("west", "small") in left


STATUS = "collection string, host string, core string, available boolean, num_docs int, version long, last_modified timestamp_ntz"


def test_clone_into_a_store_ends_with_the_check(spark, tmp_path, monkeypatch):
    src = inv(spark, ("a", "s0", [1, 2], [2]), ("b", "s0", [1], []), ("c", "s0", [1], [1]))
    status = spark.createDataFrame([("a", "h2", "a_s0_replica2", True, 20, 9, None), ("c", "h1", "c_s0_replica1", True, 5, 3, None)], STATUS)
    docs = spark.createDataFrame([(c, "s0", i, f"{c}{i}", 1) for c, n in (("a", 20), ("b", 3), ("c", 5)) for i in range(n)], FIELDS)
    empty = spark.createDataFrame([], INV)

    def run(name):
        return stores.clone_into(Store(str(tmp_path / name)), src, empty, docs, status)

    done = run("good")
    assert rows(done.diagnostics, "entity", "status") == [("a_s0_replica1", "ok"), ("b_s0_replica1", "failed"), ("c_s0_replica1", "ok")]
    assert stores.read(spark, Store(str(tmp_path / "good"))).count() == 25
    # A shard that is not what the source has makes its cores fail.
    real = stores.read
    monkeypatch.setattr(stores, "read", lambda *a: real(*a).where("not (collection = 'c' and doc_id = 2)"))
    assert rows(run("bad").diagnostics.where("status = 'failed'"), "entity") == [("b_s0_replica1",), ("c_s0_replica1",)]
