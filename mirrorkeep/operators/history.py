"""What cores were over time, from successive snapshots of their cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rows of a task that sorts the snapshots of its cores; it holds about 0.7 kB for each.
SORTED_ROWS = 500_000


def core_history(inv: DataFrame) -> DataFrame:
    """Spans of time in which a core was in every snapshot with the same node and state.

    ``inv`` has ``snapshot_ts``, and ``cluster`` where there are several; a snapshot is a time at which its cluster has any row. Per collection,
    shard and core: node, state, valid_from (the first such snapshot), valid_to (the first later one in which the core
    has changed or gone; null while it is as in the last) and snapshots, their number. Of a core's rows in one snapshot the last counts.
    Rows without a time are in no snapshot.

    A window holds one row per snapshot of one core. Only the times of snapshots are numbered for a whole cluster.
    """
    cluster = [c for c in ("cluster",) if c in inv.columns]
    core = [*cluster, "collection", "shard", "core"]
    inv = inv.where("snapshot_ts is not null")
    times = inv.select(*cluster, "snapshot_ts").distinct()
    in_time = Window.partitionBy(*cluster).orderBy("snapshot_ts")
    times = times.select(
        *[F.col(c).alias(f"_{c}") for c in cluster],
        F.col("snapshot_ts").alias("_ts"),
        F.row_number().over(in_time).alias("_at"),
        F.lead("snapshot_ts").over(in_time).alias("_next"),
    )
    seen = inv.groupBy(*core, "snapshot_ts").agg(F.max(F.struct("rn", "node", "state")).alias("last"))
    here = F.col("snapshot_ts") == F.col("_ts")
    for c in cluster:
        here = here & F.col(c).eqNullSafe(F.col(f"_{c}"))
    seen = seen.join(times, here).select(*core, "snapshot_ts", "_at", "_next", "last.node", "last.state")
    parts = max(int(inv.sparkSession.conf.get("spark.sql.shuffle.partitions")), inv.count() // SORTED_ROWS + 1)
    seen = seen.repartition(parts, *cluster, "collection", "core")
    one = Window.partitionBy(*core).orderBy("_at")
    value = F.struct("node", "state")
    goes_on = (F.lag("_at").over(one) == F.col("_at") - 1) & F.lag(value).over(one).eqNullSafe(value)
    spans = seen.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_span", F.sum("_new").over(one))
    return (
        spans.groupBy(*core, "_span")
        .agg(
            F.first("node").alias("node"),
            F.first("state").alias("state"),
            F.min("snapshot_ts").alias("valid_from"),
            F.max_by("_next", "_at").alias("valid_to"),
            F.count(F.lit(1)).alias("snapshots"),
        )
        .drop("_span")
    )
