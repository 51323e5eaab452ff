"""Cluster state, alias and collection metadata documents (JSON)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import scoped
from ..functions.naming import node_name, replica_number

# The keys of the state document.
REPLICA = (
    "struct<state:string,core:string,collection:string,shard:string,"
    "node_name:string,base_url:string,leader:string>"
)
SHARD = f"struct<range:string,state:string,parent:string,replicas:map<string,{REPLICA}>>"
COLLECTION = (
    f"struct<shards:map<string,{SHARD}>,maxShardsPerNode:string,replicationFactor:string>"
)
STATE = f"map<string,{COLLECTION}>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file below the path: its whole text, where it came from and its size."""
    return _documents(spark.read, path)


def stream_documents(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_documents``, for a folder that keeps receiving snapshot files."""
    return _documents(spark.readStream, path)


def _documents(reader, path: str) -> DataFrame:
    return (
        reader.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .load(path)
        .select(
            F.col("value").alias("doc"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_size").alias("bytes"),
        )
    )


def state_size(docs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Bytes of the state documents, in total or per given column."""
    size = F.sum(F.octet_length("doc")).cast("long").alias("bytes")
    return docs.groupBy(*(by or [])).agg(size)


def scan_cluster_state(docs: DataFrame) -> DataFrame:
    """One row per replica of every state document, with its shard and collection.

    Unknown keys are ignored. A document that is no JSON object at all has no rows
    here; ``rejected_documents`` lists it. Numbers held as text are cast.
    """
    keep = scoped(docs)
    state = docs.select(*keep, F.from_json("doc", STATE).alias("state"))
    # A plain explode would have Spark test the map first, which parses it twice.
    per_collection = state.select(
        *keep, F.explode_outer("state").alias("collection", "c")
    ).where(F.col("collection").isNotNull())
    # Fields are taken out first, or every shard would carry its whole collection along, and every replica its shard.
    per_shard = per_collection.select(
        *keep,
        "collection",
        F.col("c.maxShardsPerNode").try_cast("int").alias("max_shards_per_node"),
        F.col("c.replicationFactor").try_cast("int").alias("replication_factor"),
        F.col("c.shards").alias("shards"),
    ).select(
        *keep,
        "collection",
        "max_shards_per_node",
        "replication_factor",
        F.explode("shards").alias("shard", "s"),
    )
    return per_shard.select(
        *keep,
        "collection",
        "max_shards_per_node",
        "replication_factor",
        "shard",
        F.col("s.range").alias("range"),
        F.col("s.state").alias("shard_state"),
        F.col("s.parent").alias("parent"),
        F.col("s.replicas").alias("replicas"),
    ).select(
        *keep,
        "collection",
        "max_shards_per_node",
        "replication_factor",
        "shard",
        "range",
        "shard_state",
        "parent",
        F.explode("replicas").alias("replica", "r"),
    ).select(
        *keep,
        "collection",
        "max_shards_per_node",
        "replication_factor",
        "shard",
        "range",
        "shard_state",
        "parent",
        "replica",
        F.col("r.core").alias("core"),
        F.col("r.node_name").alias("node_name"),
        F.col("r.base_url").alias("base_url"),
        F.col("r.state").alias("state"),
        F.col("r.leader").alias("leader"),
    )


def rejected_documents(docs: DataFrame) -> DataFrame:
    """Documents that do not parse as a cluster state."""
    empty = F.coalesce(F.octet_length("doc"), F.lit(0)) == 0
    bad = F.from_json("doc", STATE).isNull() | empty
    return docs.where(bad)


def flatten_state(scanned: DataFrame) -> DataFrame:
    """The replica inventory out of scanned state: host and replica number added."""
    return scanned.select(
        *scoped(scanned, "collection", "shard", "core"),
        replica_number(F.col("core")).alias("rn"),
        "node_name",
        node_name(F.col("node_name")).alias("node"),
        "state",
        "leader",
    )


def scan_live_nodes(docs: DataFrame) -> DataFrame:
    """Hosts out of documents that list the names of the live nodes."""
    # See scan_cluster_state for why not a plain explode.
    names = docs.select(
        *scoped(docs), F.explode_outer(F.from_json("doc", "array<string>")).alias("full")
    ).where(F.col("full").isNotNull())
    return names.select(*scoped(docs), node_name(F.col("full")).alias("node")).distinct()


def scan_aliases(docs: DataFrame) -> DataFrame:
    """alias, target out of ``{"collection": {alias: target}}``; null content has no rows."""
    parsed = F.from_json("doc", "struct<collection:map<string,string>>")
    # See scan_cluster_state for why not a plain explode.
    return docs.select(
        *scoped(docs), F.explode_outer(parsed["collection"]).alias("alias", "target")
    ).where(F.col("alias").isNotNull())


def collection_config(
    cols: DataFrame, metadata: DataFrame, strict: bool = False
) -> DataFrame:
    """Configuration name of each collection.

    ``metadata`` has collection and doc. A collection without a row there is
    skipped; one with a row but no document is a violation (``problem`` is set),
    which raises when ``strict``.
    """
    on = [c for c in scoped(cols, "collection") if c in metadata.columns]
    out = cols.join(metadata, on).select(
        *scoped(cols, "collection"),
        F.get_json_object("doc", "$.configName").alias("config"),
        F.when(F.col("doc").isNull(), "no metadata").alias("problem"),
    )
    if strict:
        bad = out.where(F.col("problem").isNotNull()).first()
        if bad is not None:
            raise LookupError(f"no metadata for collection {bad['collection']}")
    return out


def found_documents(doc: Column) -> Column:
    """Number of hits a count request reports."""
    return F.get_json_object(doc, "$.response.numFound").try_cast("long")
