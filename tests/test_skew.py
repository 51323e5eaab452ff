import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mirrorkeep.common import materialize, shared_dir
from mirrorkeep.operators import skew
from mirrorkeep.operators.skew import hot_keys, lookup, numbered
from tests.helpers import rows


@pytest.fixture
def left(spark):
    """A third of the rows has one key, another third none at all."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), "id"))
    return spark.range(3000).select("id", key.alias("key"))


@pytest.fixture
def right(spark):
    return spark.createDataFrame(
        [("hot", 1), ("k1", 2), ("k4", 3), ("unused", 4), (None, 5)], "key string, v int"
    )


def test_no_hot_key_below_the_floor(left):
    assert hot_keys(left, ["key"]) == []


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_equals_join(left, right, how, small_groups_hot):
    assert [k.pieces for k in hot_keys(left, ["key"])] == [3, 3]
    got = lookup(left, right, ["key"], how)
    want = left.join(right, "key", how)
    assert got.columns == want.columns
    assert rows(got) == rows(want)


def test_lookup_spreads_the_hot_key(spark, left, right, small_groups_hot):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = lookup(left, right, ["key"]).where("key = 'hot'")
        parts = out.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(parts) > 1
    assert sum(r["count"] for r in parts) == 1000


def test_lookup_weighed_by_another_table(left, right, small_groups_hot):
    few = left.distinct()
    assert rows(lookup(few, right, ["key"], weigh=left)) == rows(few.join(right, "key", "left"))


def test_lookup_wants_equal_key_types(left, right):
    with pytest.raises(TypeError):
        lookup(left, right.select(F.lit(1).alias("key"), "v"), ["key"])


def test_lookup_leaves_maps_alone(spark, right, small_groups_hot):
    table = spark.range(100).select(
        F.lit("hot").alias("key"), F.create_map(F.lit("a"), F.col("id")).alias("m")
    )
    assert lookup(table, right, ["key"]).where("v = 1").count() == 100


def group_table(spark):
    day = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
    return spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("g"),
        F.when(F.col("id") % 7 != 0, F.col("id") * 7919 % 1000).alias("a"),
        F.timestamp_add("DAY", (F.col("id") % 11).cast("int"), day).alias("b"),
        "id",
    )


def test_numbered_equals_window(spark, small_groups_hot):
    table = group_table(spark)
    assert hot_keys(table, ["g"])
    got = numbered(table, ["g"], ["a", "b", "id"], "n")
    want = table.withColumn(
        "n", F.row_number().over(Window.partitionBy("g").orderBy("a", "b", "id"))
    )
    assert got.schema["n"].dataType == want.schema["n"].dataType
    assert rows(got) == rows(want)


def test_numbered_with_equal_order_values(spark, small_groups_hot):
    table = group_table(spark).select("g", "a")
    got = numbered(table, ["g"], ["a"], "n")
    want = table.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("a")))
    assert rows(got) == rows(want)


def test_equal_rows_of_a_hot_group_are_spread(spark, small_groups_hot):
    """However few distinct order values there are."""
    table = spark.range(3000).select(F.lit("k").alias("g"), (F.col("id") % 3).alias("a"))
    hot = hot_keys(table, ["g"])
    cut = skew.with_range(table, ["g"], ["a"], hot)
    sizes = [r["count"] for r in cut.groupBy("_range").count().collect()]
    assert len(sizes) == hot[0].pieces == 8 and max(sizes) < 1000
    numbers = rows(numbered(table, ["g"], ["a"], "n"), "n", "a")
    assert numbers == [(i + 1, i // 1000) for i in range(3000)]


def test_ranges_follow_the_order(spark, small_groups_hot):
    table = group_table(spark)
    hot = hot_keys(table, ["g"])
    # All even ids and id 1.
    assert (hot[0].rows, hot[0].pieces) == (2001, 5)
    hot = [skew.HotKey(k.hash, k.rows, 9) for k in hot]
    cut = skew.with_range(table, ["g"], ["a", "b", "id"], hot)
    assert cut.where("_cut").select("g").distinct().count() == 1
    assert cut.where("not _cut and _range <> 0").count() == 0
    spans = (
        cut.where("_cut")
        .groupBy("_range")
        .agg(
            F.min(F.struct("a", "b", "id")).alias("low"),
            F.max(F.struct("a", "b", "id")).alias("high"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumn("before", F.lag("high").over(Window.orderBy("_range")))
    )
    assert spans.where("before >= low").count() == 0
    sizes = [r["n"] for r in spans.collect()]
    assert len(sizes) == 9 and sum(sizes) == 2001
    assert max(sizes) < 600


def test_a_cluster_must_name_its_shared_folder():
    class Cluster:
        conf = {}
        sparkContext = type("Context", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster, "x")


def test_folders_come_from_the_shared_setting(spark, left):
    root = spark.conf.get("spark.checkpoint.dir")
    a, b = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert a != b and a.startswith(root)
    kept = materialize(left, "left")
    assert rows(kept) == rows(left)
