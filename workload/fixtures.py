"""Inventory, alias, tree, content and progress tables derived from the test tables.

FIXTURES.md gives the same tables as SQL. Its remainder tests make the two clusters
differ (a row one side lacks or has in another state); every query reads both in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorkeep.common import materialize, shared_dir
from mirrorkeep.functions.naming import map_forward, parse_rules
from mirrorkeep.operators.skew import lookup, numbered

RULES = "_collection:_twin,default:_copy"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each repeat of an order line is a replica of one shard."""
    # Names are made behind the shuffle that numbers the replicas.
    lines = numbered(
        table(spark, sf_dir, "lineitem"),
        ["l_orderkey", "l_linenumber"],
        [
            "l_partkey",
            "l_suppkey",
            "l_shipdate",
            "l_extendedprice",
            "l_quantity",
            "l_discount",
            "l_tax",
        ],
        "rn",
    )
    return _placed(lines).select(
        "collection",
        "shard",
        F.concat(
            "collection", F.lit("_"), "shard", F.lit("_replica"), F.col("rn").cast("string")
        ).alias("core"),
        "rn",
        F.concat("node", F.lit(":8983_solr")).alias("node_name"),
        "node",
        "state",
        F.when(F.col("l_returnflag") == "R", "true")
        .when(F.col("l_returnflag") == "A", "false")
        .alias("leader"),
        "available",
        F.col("l_quantity").cast("int").alias("num_docs"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("version"),
        F.col("l_shipdate").alias("last_modified"),
        "l_returnflag",
        "l_partkey",
        "l_suppkey",
    )


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory before its replicas are numbered: enough where no core is named."""
    return _placed(table(spark, sf_dir, "lineitem"))


def _placed(lines: DataFrame) -> DataFrame:
    order = F.concat(F.lit("c"), F.col("l_orderkey").cast("string"))
    up = F.col("l_linestatus") == "O"
    return lines.select(
        "*",
        F.when(F.col("l_orderkey") % 3 != 0, F.concat(order, F.lit("_collection")))
        .otherwise(F.concat(order, F.lit("_idx")))
        .alias("collection"),
        F.concat(F.lit("shard"), F.col("l_linenumber").cast("string")).alias("shard"),
        F.concat(F.lit("host"), F.col("l_suppkey").cast("string")).alias("node"),
        F.when(up, "active").otherwise("down").alias("state"),
        up.alias("available"),
    )


def stored_inv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory as a written table, for queries that read it several times."""
    return materialize(inv(spark, sf_dir), "inv")


def src_inv(replicas: DataFrame) -> DataFrame:
    """The source cluster: it lacks some replicas of the inventory."""
    return replicas.where("l_returnflag <> 'N'")


def dst_inv(replicas: DataFrame) -> DataFrame:
    """The destination cluster: renamed, with versions and times that are a bit off."""
    new = map_forward(F.col("collection"), parse_rules(RULES))
    rest = F.substr("core", F.length("collection") + 1)
    return replicas.select(
        new.alias("collection"),
        "shard",
        F.concat(new, rest).alias("core"),
        "rn",
        "node",
        "available",
        "num_docs",
        (F.col("version") + F.col("l_suppkey") % 3 - 1).alias("version"),
        F.timestamp_add("MINUTE", F.col("l_partkey") % 90, F.col("last_modified")).alias(
            "last_modified"
        ),
    )


def src_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("alias"),
        F.concat(F.lit("seg_"), "c_mktsegment").alias("target"),
    )


def dst_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(
        F.col("c_name").alias("alias"),
        F.when(F.col("c_custkey") % 7 == 0, "seg_OLD")
        .otherwise(F.concat(F.lit("seg_"), "c_mktsegment"))
        .alias("target"),
    )
    only = spark.range(1).select(F.lit("only_dst").alias("alias"), F.lit("seg_X").alias("target"))
    return there.unionByName(only)


def segment_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents; their collection is the segment of the customer."""
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return lookup(orders, customer, ["o_custkey"], "inner").select(
        F.concat(F.lit("seg_"), "c_mktsegment").alias("collection"),
        F.col("o_orderkey").alias("doc_id"),
        "o_orderstatus",
    )


def src_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.concat_ws(
            "/",
            F.lit("/configs"),
            F.split_part("url", F.lit("/"), F.lit(3)),
            F.split_part("url", F.lit("/"), F.lit(4)),
            F.col("page_id").cast("string"),
        ).alias("path"),
        "page_id",
        F.col("html").alias("data"),
    )


def dst_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        src_tree(spark, sf_dir)
        .where("page_id % 4 <> 0")
        .select(
            "path",
            F.when(F.col("page_id") % 3 == 0, "stale").otherwise(F.col("data")).alias("data"),
        )
    )


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("_collection")).alias("collection"),
        F.concat(F.lit("shard"), (F.col("doc_id") % 4 + 1).cast("string")).alias("shard"),
        "doc_id",
        "text",
        "n_chars",
    )


def content_inv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory of the documents: a replica per shard and language.

    A replica is available if one of its documents is labelled of good quality.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    number = (
        F.when(F.col("lang") == "de", 1)
        .when(F.col("lang") == "en", 2)
        .when(F.col("lang") == "es", 3)
        .otherwise(4)
    )
    return (
        docs.join(labels, "doc_id", "left")
        .groupBy(
            F.concat("source", F.lit("_collection")).alias("collection"),
            F.concat(F.lit("shard"), (F.col("doc_id") % 4 + 1).cast("string")).alias("shard"),
            number.alias("rn"),
        )
        .agg(F.coalesce(F.max("quality") == 1, F.lit(False)).alias("available"))
        .select(
            "collection",
            "shard",
            F.concat_ws("_", "collection", "shard", F.concat(F.lit("replica"), "rn")).alias(
                "core"
            ),
            "rn",
            F.concat(F.lit("host"), "rn").alias("node"),
            "available",
        )
    )


def content_dst_inv(spark: SparkSession, sf_dir: str, rules: str | None) -> DataFrame:
    """What the destination has before the clone: some of the collections, fewer replicas."""
    new = map_forward(F.col("collection"), parse_rules(rules))
    rest = F.substr("core", F.length("collection") + 1)
    return (
        content_inv(spark, sf_dir)
        .where("collection < 'src15' and rn <= 2")
        .select(
            new.alias("collection"),
            "shard",
            F.concat(new, rest).alias("core"),
            "rn",
            "node",
            "available",
        )
    )


def other_contents(docs: DataFrame) -> DataFrame:
    """The documents as another cluster has them: some are missing, some have no text, some it has alone."""
    kept = docs.where("doc_id % 50 <> 7").withColumn("text", F.when(F.col("doc_id") % 64 == 1, F.lit("")).otherwise(F.col("text")))
    return kept.unionByName(docs.where("doc_id % 97 = 5").withColumn("doc_id", F.col("doc_id") + 10_000_000))


def later_contents(docs: DataFrame) -> DataFrame:
    """The documents some time later: a collection is gone, and some texts of another are changed."""
    changed = (F.col("collection") == "src3_collection") & (F.col("doc_id") % 10 == 3)
    return docs.where("collection <> 'src9_collection'").withColumn("text", F.when(changed, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))


def content_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of the replicas of the documents: size, largest id and a time of their shard."""
    sizes = contents(spark, sf_dir).groupBy("collection", "shard").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("version"))
    return content_inv(spark, sf_dir).join(sizes, ["collection", "shard"]).select(
        "collection",
        F.col("node").alias("host"),
        "core",
        "available",
        F.col("n").cast("int").alias("num_docs"),
        "version",
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(n as int))").alias("last_modified"),
    )


def samples(events: DataFrame) -> DataFrame:
    """Event rows as polled status samples; works on a stream too."""
    core = F.concat(F.lit("core"), F.col("user_id").cast("string"))
    return events.select(
        core.alias("core"),
        F.concat(core, F.lit("/"), F.col("ts").cast("date").cast("string")).alias("req"),
        "event_id",
        "ts",
        F.when(F.col("event_type") == "purchase", "done")
        .when(F.col("event_type") == "error", "failed")
        .otherwise("replicating")
        .alias("status"),
    )


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(table(spark, sf_dir, "events"))


def progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as files in order of time, which a stream takes one by one."""
    events = table(spark, sf_dir, "events")
    low, high, count = events.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first()
    folder = shared_dir(spark, "event-files")
    cuts = [low + (high - low) * i / 4 for i in range(1, 4)]
    # Every quarter has so many files, and a micro-batch takes as many.
    files = 1 + count // 1_000_000
    for begin, end in zip([None, *cuts], [*cuts, None]):
        part = events
        if begin is not None:
            part = part.where(F.col("ts") >= F.lit(begin).cast("timestamp_ntz"))
        if end is not None:
            part = part.where(F.col("ts") < F.lit(end).cast("timestamp_ntz"))
        part.repartition(files, "event_id").write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files)
    return samples(stream.parquet(folder))


def host_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where("s_suppkey % 4 <> 0").select(
        F.concat(F.lit("host"), F.col("s_suppkey").cast("string")).alias("private"),
        F.concat(F.lit("pub-"), "s_name").alias("public"),
    )


def yearly_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of every year: a core per part and supplier, on a node and in a state of its last line item."""
    collection = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        F.date_trunc("year", "l_shipdate").cast("timestamp_ntz").alias("snapshot_ts"),
        collection.alias("collection"),
        F.lit("shard1").alias("shard"),
        F.concat(collection, F.lit("_s"), F.col("l_suppkey").cast("string")).alias("core"),
        F.col("l_orderkey").alias("rn"),
        F.concat(F.lit("host"), (F.col("l_linenumber") % 2).cast("string")).alias("node"),
        F.when(F.col("l_returnflag") == "R", "down").otherwise("active").alias("state"),
    )


def state_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State documents of the inventory, one per replica, so no group has to be collected."""
    replica = F.struct(
        "state",
        "core",
        "node_name",
        F.concat(F.lit("http://"), F.split_part("node_name", F.lit("_solr"), F.lit(1))).alias(
            "base_url"
        ),
        "leader",
    )
    shard = F.struct(
        F.concat("shard", F.lit("/"), F.col("rn").cast("string")).alias("range"),
        F.lit("active").alias("state"),
        F.create_map(F.concat(F.lit("core_node"), F.col("rn").cast("string")), replica).alias(
            "replicas"
        ),
    )
    state = F.struct(
        F.create_map("shard", shard).alias("shards"),
        F.col("num_docs").cast("string").alias("maxShardsPerNode"),
        F.col("rn").cast("string").alias("replicationFactor"),
    )
    return inv(spark, sf_dir).select(
        "collection", F.to_json(F.create_map("collection", state)).alias("doc")
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of whole collections, a part and its state: one document for about every 1024 orders, whose lines are shards and repeats replicas.

    An order has at most a few dozen lines, so a document is of bounded size, some megabytes.
    """
    replica = F.struct("state", "core", "node_name", "leader")
    named = F.struct(F.concat(F.lit("core_node"), F.col("rn").cast("string")), replica)
    numbered_rows = inv(spark, sf_dir).withColumn("part", F.xxhash64("collection") % (spark.read.parquet(f"{sf_dir}/orders.parquet").count() // 1024 + 1))
    # Shards, collections and documents are put together where the rows of a document are.
    numbered_rows = numbered_rows.repartition("part")
    shards = numbered_rows.groupBy("part", "collection", "shard").agg(F.map_from_entries(F.collect_list(named)).alias("replicas"))
    whole = shards.groupBy("part", "collection").agg(
        F.map_from_entries(F.collect_list(F.struct("shard", F.struct(F.lit("active").alias("state"), "replicas")))).alias("shards")
    )
    return whole.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("collection", F.struct("shards")))).alias("state"))


def snapshot_files(spark: SparkSession, sf_dir: str) -> str:
    """The snapshots, written as files."""
    folder = shared_dir(spark, "snapshots")
    # One document per file is what a snapshot is; as many files as there are parts.
    snapshots(spark, sf_dir).select(F.to_json("state").alias("value"), "part").write.partitionBy("part").text(folder)
    return folder


def live_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of live node names: one for the suppliers of each nation."""
    name = F.concat(F.lit("host"), F.col("s_suppkey").cast("string"), F.lit(":8983_solr"))
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey", (F.col("s_suppkey") % 97).alias("part")).agg(
        F.to_json(F.collect_list(name)).alias("doc")
    )


def alias_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.create_map(F.lit("collection"), F.create_map("alias", "target"))
    return src_alias(spark, sf_dir).select(F.to_json(body).alias("doc"))


def metadata_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection metadata out of the orders; pending orders have a node without data."""
    order = F.concat(F.lit("c"), F.col("o_orderkey").cast("string"))
    body = F.struct(
        F.concat(F.lit("cfg_"), F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))))
        .alias("configName"),
        F.lit("implicit").alias("router"),
    )
    return table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 3 != 0, F.concat(order, F.lit("_collection")))
        .otherwise(F.concat(order, F.lit("_idx")))
        .alias("collection"),
        F.when(F.col("o_orderstatus") != "P", F.to_json(body)).alias("doc"),
    )


def _value(tag: str, name: str, value) -> list:
    return [F.lit(f'<{tag} name="{name}">'), value, F.lit(f"</{tag}>")]


def status_documents(replicas: DataFrame) -> DataFrame:
    """Status document of every core; the ones that are down report a start-up failure."""
    up = F.col("available")
    index = F.concat(
        F.lit('<lst name="index">'),
        *_value("int", "numDocs", F.col("num_docs").cast("string")),
        *_value("int", "deletedDocs", F.lit("0")),
        *_value("long", "version", F.col("version").cast("string")),
        *_value(
            "date",
            "lastModified",
            F.date_format("last_modified", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        ),
        *_value("bool", "current", F.lit("true")),
        F.lit("</lst>"),
    )
    core = F.concat(F.lit('<lst name="'), "core", F.lit('">'))
    failure = F.when(~up, F.concat(core, F.lit("index is locked</lst>"))).otherwise("")
    return replicas.select(
        "collection",
        "core",
        F.concat(
            F.lit('<response><lst name="initFailures">'),
            failure,
            F.lit('</lst><lst name="status">'),
            core,
            index,
            F.lit("</lst></lst></response>"),
        ).alias("doc"),
    )


def progress_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replication status document of every event.

    Sign-ups stand for a copy that has not started, views for one without a flag.
    """
    kind = F.col("event_type")
    date = F.when(kind != "signup", F.col("ts").cast("string")).otherwise("")
    flag = (
        F.when(kind == "purchase", "false").when(kind == "view", "").otherwise("true")
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(
            F.lit('<response><lst name="details"><lst name="slave">'),
            *_value("str", "currentDate", date),
            *_value("str", "isReplicating", flag),
            *_value("str", "totalPercent", F.floor("value").cast("string")),
            *_value("str", "timeElapsed", F.concat(F.col("user_id").cast("string"), F.lit("s"))),
            *_value("str", "bytesDownloaded", F.when(kind != "error", F.col("event_id").cast("string")).otherwise("")),
            *_value("str", "bytesToDownload", (F.col("event_id") * 2).cast("string")),
            *_value("str", "downloadSpeed", F.when(kind == "view", F.concat(F.col("user_id").cast("string"), F.lit(" KB"))).otherwise("")),
            *_value("str", "timeRemaining", F.when(kind == "view", F.lit(" ")).otherwise(F.concat(F.col("user_id").cast("string"), F.lit("s")))),
            F.lit("</lst></lst></response>"),
        ).alias("doc"),
    )
