"""Alarms of requests that are not done in time, by timers in the state store.

A request has three values, and a deadline. Requests are dealt to a fixed number of groups by a hash of their name; a group's requests are
one state, and its timer is at the first time at which one of them is due. It goes off when the clock passes that time, whether or
not a sample of the group, or any sample, comes in that micro-batch. All requests of a group are followed in one call by columns, so
calls follow the groups, not the requests. A micro-batch reads and writes the groups that its samples and the timers due in it belong to.

This is the one job that runs Python in its tasks, as Spark's interface for state with timers asks for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..common import scoped, shared_dir
from ..operators.monitor import COPY_LIMIT
from .monitor import KEEP, LATENESS, _trigger

# The requests of a group: their keys, started, finished and alarmed as an Arrow stream.
STATE = "requests binary"
GROUPS = 2048
NEVER = np.iinfo(np.int64).max


def _micros(spark, interval: str) -> int:
    return spark.sql(f"select unix_micros(timestamp'1970-01-01 00:00:00+00:00' + interval {interval})").first()[0]


def overdue_timers(
    progress: DataFrame,
    timeout: str = COPY_LIMIT,
    lateness: str = LATENESS,
    keep: str = KEEP,
    clock: str = "event",
    groups: int = GROUPS,
) -> DataFrame:
    """req, started of each request that is not done ``timeout`` after its first sample: one row per request, as a stream.

    ``clock='event'`` goes by the latest time of any sample, less ``lateness``, at the end of the micro-batch before; samples older than that are left out.
    ``clock='wall'`` goes by the time of day, so an alarm goes off without any further sample. The state of a request is kept for
    ``keep`` after its first sample, and gives no second alarm in that time. Requests of different clusters or snapshots are different; samples without a time are left out.
    Requests are held in ``groups`` states; a checkpoint keeps the number it was begun with.
    """
    if clock not in ("event", "wall"):
        raise ValueError(f"unknown clock {clock!r}")
    spark = progress.sparkSession
    limit, kept = _micros(spark, timeout), max(_micros(spark, keep), _micros(spark, timeout))
    keys = scoped(progress, "req")
    fields = ", ".join(f"{k} {progress.schema[k].dataType.simpleString()}" for k in keys)
    by_events = clock == "event"

    # The helpers are local, so that tasks need not have this package.
    def packed(requests: pd.DataFrame) -> bytes:
        table = pa.Table.from_pandas(requests, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        return sink.getvalue().to_pybytes()

    def follow(_group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [pa.ipc.open_stream(state.get[0]).read_pandas()] if state.exists else []
        if not state.hasTimedOut:
            for frame in frames:
                finished = np.where(frame["done"], frame["at"], NEVER)
                held.append(frame[keys].assign(started=frame["at"], finished=finished, alarmed=False))
        every = pd.concat(held)
        if len(held) > 1 or not state.exists:
            by_request = every.groupby(keys, dropna=False, sort=False, as_index=False)
            every = by_request.agg({"started": "min", "finished": "min", "alarmed": "any"})
        now = state.getCurrentWatermarkMs() if by_events else state.getCurrentProcessingTimeMs()
        deadline, end = every["started"] + limit, every["started"] + kept
        passed = deadline // 1000 <= now
        fires = passed & ~every["alarmed"] & (every["finished"] > deadline)
        every["alarmed"] |= fires
        stays = ~(passed & (end // 1000 <= now))
        if stays.any():
            state.update((packed(every[stays]),))
            # A request that is done in time is due at its end only.
            due = end.where(passed | (every["finished"] <= deadline), deadline)
            following = int(due[stays].min()) // 1000
            if by_events:
                # A timer goes off when the clock is behind it, not at it.
                state.setTimeoutTimestamp(max(following - 1, now + 1))
            else:
                state.setTimeoutDuration(max(following - now, 1))
        else:
            state.remove()
        if fires.any():
            yield every.loc[fires, [*keys, "started"]]

    rows = progress.where(F.col("ts").isNotNull()).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    if by_events:
        rows = rows.withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", lateness)
    rows = rows.withColumn("done", F.coalesce(F.col("status") == "done", F.lit(False)))
    kind = GroupStateTimeout.EventTimeTimeout if by_events else GroupStateTimeout.ProcessingTimeTimeout
    rows = rows.withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(groups)))
    alarms = rows.groupBy("_group").applyInPandasWithState(follow, f"{fields}, started long", STATE, "append", kind)
    return alarms.withColumn("started", F.timestamp_micros("started").cast("timestamp_ntz"))


def run_overdue_timers(progress: DataFrame, out: str, state: str | None = None, every: str | None = None, **options) -> StreamingQuery:
    """Append the alarms of ``overdue_timers`` to the table ``out``, each once, also after a restart."""
    alarms = overdue_timers(progress, **options)
    to = state or shared_dir(progress.sparkSession, "stream-state")
    return alarms.writeStream.format("parquet").option("path", out).option("checkpointLocation", to).outputMode("append").trigger(**_trigger(every)).start()
