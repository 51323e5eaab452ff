"""A copy of contents in partitions, kept up to date, resumed where it stopped, and dropped from without rewriting what stays.

Below the store's path are the documents, laid out by collection and range of hashed ids, and a manifest. A collection has as many ranges as its
size asks for, so folders are as many as the data has pieces of ``PARTITION_BYTES`` and collections. The manifest has rows for what was done to a partition; the latest
says what it holds: documents, digest, or that it is gone. It is written after the partitions, in waves: a run that stops loses at most the wave
it was at, and the next run finds by the digests what is left to do.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import exists, materialize, remove, scoped, shared_scope
from ..functions.digest import table_digest
from ..operators.difference import BITS, PART, _values, id_range
from ..operators.skew import lookup
from ..operators.verify import STATUS, content_digest, post_copy_check
from .clone import ClonePlan, plan_clone

# Bytes of a partition, and of partitions that are written and committed together.
PARTITION_BYTES = 256 << 20
WAVE_BYTES = 1 << 40
# A collection whose partitions are this many times too large is cut anew.
GROWN = 4
MAX_BITS = 24

WRITTEN, DROPPING, DROPPED = "written", "dropping", "dropped"


@dataclass(frozen=True)
class Store:
    """A copy below a path that all executors reach."""

    path: str

    def at(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{name}"


@dataclass(frozen=True)
class Refreshed:
    """What a refresh did: a row per partition (``kept``, ``written``, ``dropped``, ``failed`` or ``waiting``), and whether any waits."""

    partitions: DataFrame
    finished: bool


def _keys(table: DataFrame) -> list[str]:
    return [*scoped(table, "collection"), BITS, PART]


def manifest(spark: SparkSession, store: Store) -> DataFrame | None:
    """The latest row of every partition: seq, action, docs, digest, bytes."""
    if not exists(spark, store.at("manifest")):
        return None
    rows = spark.read.parquet(store.at("manifest"))
    rest = F.struct("seq", *[c for c in rows.columns if c not in (*_keys(rows), "seq")])
    return rows.groupBy(*_keys(rows)).agg(F.max(rest).alias("r")).select(*_keys(rows), "r.*")


def _commit(store: Store, rows: DataFrame, action: str) -> None:
    """Append to the manifest. Numbers grow with time, also from run to run."""
    columns = [*_keys(rows), F.lit(time.time_ns()).alias("seq"), F.lit(action).alias("action"), "docs", "digest", "bytes"]
    rows.select(*columns).coalesce(1).write.mode("append").parquet(store.at("manifest"))


def live(spark: SparkSession, store: Store) -> DataFrame | None:
    """The partitions that the manifest says are there."""
    rows = manifest(spark, store)
    return None if rows is None else rows.where(F.col("action") == WRITTEN)


def read(spark: SparkSession, store: Store) -> DataFrame:
    """The documents, with the layout columns ``bits`` and ``part``; partitions that are not in the manifest, or gone, are left out."""
    schema = spark.read.parquet(store.at("schema")).schema
    if not exists(spark, store.at("data")):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(store.at("data"))
    there = live(spark, store)
    if there is None:
        return rows.where("false")
    return lookup(rows, materialize(there.select(*_keys(there)), "live"), _keys(there), "left_semi", weigh=there)


def _laid_out(contents: DataFrame, store: Store, key: str, partition_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The contents with their layout, and docs, digest and bytes of every partition they make. One pass for sizes, one for digests."""
    spark = contents.sparkSession
    by = scoped(contents, "collection")
    size = sum((F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) if f.dataType.simpleString() in ("string", "binary") else F.lit(8) for f in contents.schema), F.lit(0))
    sized = contents.groupBy(*by).agg(F.sum(size).alias("bytes"))
    bits = F.greatest(F.ceil(F.log2(F.col("bytes") / partition_bytes)), F.lit(0)).cast("int")
    sized = sized.select(*by, F.least(bits, F.lit(MAX_BITS)).alias("fit"))
    there = live(spark, store)
    if there is not None:
        now = there.groupBy(*by).agg(F.max(BITS).alias("now"))
        sized = sized.join(now, by, "left")
        near = F.col("fit") <= F.col("now") + F.lit(GROWN.bit_length() - 1)
        sized = sized.select(*by, F.when(near, F.col("now")).otherwise(F.col("fit")).alias("fit"))
    widths = materialize(sized.select(*by, F.col("fit").cast("int").alias(BITS)), "widths")
    laid = lookup(contents, widths, by, "inner").withColumn(PART, id_range(key, F.col(BITS)))
    wanted = laid.groupBy(*_keys(laid)).agg(
        F.count(F.lit(1)).alias("docs"), table_digest(*[F.col("shard").cast("string"), *_values(laid)]).alias("digest"), F.sum(size).cast("long").alias("bytes")
    )
    return laid, wanted


def _folder(spark: SparkSession, store: Store, keys: list[str], values: tuple) -> str:
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    return "/".join([store.at("data"), *(escape(k, None if v is None else str(v)) for k, v in zip(keys, values, strict=True))])


def refresh(
    contents: DataFrame,
    store: Store,
    key: str = "doc_id",
    partition_bytes: int = PARTITION_BYTES,
    wave_bytes: int = WAVE_BYTES,
    max_waves: int | None = None,
) -> Refreshed:
    """Make the store hold the contents (collection, shard, ``key`` and more), and write no partition that does already.

    The partitions the contents make are compared with the manifest by document count and digest. What differs is written, with dynamic
    partition overwrite, in waves of about ``wave_bytes``; each wave is read back, compared, and committed. Partitions that the contents no longer have are
    dropped. ``max_waves`` ends a run early, as a stopped one would.

    The waves come from a running sum over the partitions to write: one row for each ``PARTITION_BYTES``, so a window without a key holds them.
    """
    spark = contents.sparkSession
    laid, wanted = _laid_out(contents, store, key, partition_bytes)
    keys = _keys(laid)
    columns = [*keys, *[c for c in laid.columns if c not in keys]]
    if not exists(spark, store.at("schema")):
        laid.select(*columns).where("false").write.parquet(store.at("schema"))
    wanted = materialize(wanted, "wanted-partitions")
    there = live(spark, store)
    if there is None:
        there = wanted.where("false")
    there = materialize(there.select(*keys, F.col("docs").alias("h_docs"), F.col("digest").alias("h_digest"), F.col("bytes").alias("h_bytes")), "live-partitions")
    both = wanted.join(there, keys, "full")
    same = F.col("docs").eqNullSafe(F.col("h_docs")) & F.col("digest").eqNullSafe(F.col("h_digest"))
    action = F.when(F.col("docs").isNull(), DROPPED).when(same, "kept").otherwise(WRITTEN)
    todo = both.withColumn("action", action)
    before = F.sum(F.when(F.col("action") == WRITTEN, F.col("bytes")).otherwise(0)).over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    todo = materialize(todo.withColumn("wave", F.when(F.col("action") == WRITTEN, F.floor(F.coalesce(before, F.lit(0)) / wave_bytes))), "partitions-to-do")
    waves = [r["wave"] for r in todo.where("wave is not null").select("wave").distinct().orderBy("wave").collect()]
    failed = todo.where("false").select(*keys)
    for wave in waves[:max_waves]:
        some = materialize(todo.where(F.col("wave") == wave).select(*keys, "docs", "digest", "bytes"), "wave")
        rows = lookup(laid, some.select(*keys), keys, "left_semi", weigh=todo)
        ordered = rows.select(*columns).hint("rebalance", *keys).sortWithinPartitions(*keys, "shard")
        ordered.write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(store.at("data"))
        landed = spark.read.schema(laid.select(*columns).schema).parquet(store.at("data"))
        landed = lookup(landed, some.select(*keys), keys, "left_semi", weigh=todo)
        found = landed.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("f_docs"), table_digest(*[F.col("shard").cast("string"), *_values(landed)]).alias("f_digest")
        )
        good = materialize(some.join(found, keys, "left").where("docs <=> f_docs and digest <=> f_digest").select(*some.columns), "good-partitions")
        _commit(store, good, WRITTEN)
        failed = failed.unionByName(some.join(good, keys, "left_anti").select(*keys))
    finished = max_waves is None or len(waves) <= max_waves
    if finished:
        _drop(spark, store, todo.where(F.col("action") == DROPPED).select(*keys, F.col("h_docs").alias("docs"), F.col("h_digest").alias("digest"), F.col("h_bytes").alias("bytes")))
    last = None if finished else waves[max_waves]
    waits = F.lit(False) if last is None else (F.col("wave") >= last) | (F.col("action") == DROPPED)
    done = todo.join(failed.withColumn("bad", F.lit(True)), keys, "left").select(
        *keys,
        F.when(F.coalesce(waits, F.lit(False)), "waiting").when(F.col("bad"), "failed").otherwise(F.col("action")).alias("action"),
        F.coalesce("docs", F.lit(0).cast("long")).alias("docs"),
        "wave",
    )
    return Refreshed(materialize(done, "refreshed"), finished)


def _drop(spark: SparkSession, store: Store, rows: DataFrame) -> int:
    """Mark partitions as going, delete their folders, mark them as gone. Returns how many.

    A run that stops between leaves marked partitions, which no reader sees and the next run deletes.
    """
    rows = materialize(rows.select(*_keys(rows), "docs", "digest", "bytes"), "dropping")
    if not rows.isEmpty():
        _commit(store, rows, DROPPING)
    marked = manifest(spark, store)
    if marked is None:
        return 0
    going = materialize(marked.where(F.col("action") == DROPPING), "going")
    count = 0
    # Rows come a partition at a time; a folder is deleted by its name, nothing else is read or written.
    for row in going.select(*_keys(going)).toLocalIterator():
        remove(spark, _folder(spark, store, _keys(going), tuple(row)))
        count += 1
    if count:
        _commit(store, going, DROPPED)
    return count


def drop_collections(spark: SparkSession, store: Store, plan: DataFrame) -> int:
    """Take the collections that a delete plan drops out of the store, by their partitions; no kept file is read or written.

    A repeated run finds nothing left to do. Returns the number of partitions deleted.
    """
    there = live(spark, store)
    if there is None:
        return 0
    gone = plan.where("action = 'drop'").select(*shared_scope(plan, there, "collection")).distinct()
    return _drop(spark, store, there.join(gone, gone.columns, "left_semi"))


def copied_status(requests: DataFrame, src_status: DataFrame, shards: DataFrame) -> DataFrame:
    """The status of every core that was filled, from what the store holds: ``collection`` and the columns of ``STATUS``.

    A core has the version and time of the source core it was copied from, and the documents of its shard; it is available if
    the shard's documents are those of the source. ``shards`` has collection, shard, docs, same.
    """
    src = src_status.select(*scoped(src_status, "collection"), F.col("core").alias("source_core"), "version", "last_modified")
    filled = requests.where("ok").select(*scoped(requests, "dest_collection"), "shard", "dest_node", "dest_core", "collection", "source_core")
    filled = lookup(filled, src, shared_scope(filled, src, "collection", "source_core"), weigh=requests).drop("collection")
    there = shards.withColumnRenamed("collection", "dest_collection")
    out = lookup(filled, there, shared_scope(filled, there, "dest_collection", "shard"), weigh=requests)
    return out.select(
        *scoped(out), F.col("dest_collection").alias("collection"), F.col("dest_node").alias("host"), F.col("dest_core").alias("core"),
        F.coalesce("same", F.lit(True)).alias("available"), F.coalesce("docs", F.lit(0).cast("long")).cast("int").alias("num_docs"), "version", "last_modified",
    ).select(*scoped(out), "collection", *STATUS)


@dataclass(frozen=True)
class StoredClone:
    """A clone into a store: its plan, what the refresh did, and the check of every destination core afterwards."""

    plan: ClonePlan
    refreshed: Refreshed
    diagnostics: DataFrame


def clone_into(
    store: Store,
    src_inv: DataFrame,
    dst_inv: DataFrame,
    contents: DataFrame,
    src_status: DataFrame,
    key: str = "doc_id",
    partition_bytes: int = PARTITION_BYTES,
    wave_bytes: int = WAVE_BYTES,
    max_waves: int | None = None,
    **options,
) -> StoredClone:
    """Copy every requested collection whose shards have a healthy source into a store, and check every core afterwards.

    A first run copies everything, a run after a stopped one the rest, and a later one what has changed. ``options`` are those of
    ``plan_clone``; ``src_status`` has a row per source collection and core. The check is ``post_copy_check`` on the source's status and that of the filled cores.
    """
    plan = plan_clone(src_inv, dst_inv, **options)
    requests = materialize(plan.requests, "clone-plan")
    plan = ClonePlan(plan.create, requests, plan.violations)
    by = [*scoped(contents, "collection"), "shard"]
    units = materialize(requests.where("ok").select(*by, "dest_collection").distinct(), "clone-shards")
    found = lookup(contents, units, by, "inner").withColumn("collection", F.col("dest_collection")).select(*contents.columns)
    done = refresh(found, store, key, partition_bytes, wave_bytes, max_waves)
    have = content_digest(read(contents.sparkSession, store).drop(BITS, PART))
    want = content_digest(found).withColumnsRenamed({"docs": "w_docs", "digest": "w_digest"})
    shards = want.join(have, by, "full")
    same = F.col("docs").eqNullSafe(F.col("w_docs")) & F.col("digest").eqNullSafe(F.col("w_digest"))
    shards = materialize(shards.select(*by, "docs", same.alias("same")), "stored-shards")
    return StoredClone(plan, done, post_copy_check(requests, src_status, copied_status(requests, src_status, shards)))
