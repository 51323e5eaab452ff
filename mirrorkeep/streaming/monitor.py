"""Copy progress as Structured Streaming jobs.

What a request or core needs of its samples combines by minimum or maximum, so the streams keep no state and need
no watermark: each micro-batch is aggregated by itself and its partial rows are appended to a table. The reader combines
them and applies the same rule as the batch operator. A sample may come however late, and a micro-batch that is
written again after a failure replaces its own rows. Alarms are the exception: they depend on what time it is, and
their job carries a table of requests from one micro-batch to the next.

Tables may lead with ``cluster`` and ``snapshot_ts``; requests and cores are then kept apart by them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..common import exists, remove, scoped, shared_dir
from ..operators.monitor import COPY_LIMIT, MAX_FAILURES, completion_outcome, retry_gate

# The clock of the alarms stays this far behind the latest sample seen, so that a completion which comes a bit
# late still counts. Our choice: as long as a copy may take.
LATENESS = COPY_LIMIT

# How long a request is carried on after its last sample, so that it gives one alarm only.
KEEP = "30 days"


def _trigger(every: str | None) -> dict:
    """All input now available, then stop; or a micro-batch ``every`` so often, for good."""
    return {"processingTime": every} if every else {"availableNow": True}


def _each_batch(
    rows: DataFrame,
    write: Callable[[DataFrame, int], None],
    state: str | None,
    every: str | None,
) -> StreamingQuery:
    return (
        rows.writeStream.option("checkpointLocation", state or shared_dir(rows.sparkSession, "stream-state"))
        .foreachBatch(write)
        .trigger(**_trigger(every))
        .start()
    )


def _append(
    progress: DataFrame, part: Callable[[DataFrame], DataFrame], out: str, state: str | None, every: str | None
) -> StreamingQuery:
    """Append the partial rows of each micro-batch to ``out``."""

    def write(batch: DataFrame, number: int) -> None:
        part(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _each_batch(progress, write, state, every)


def completion_part(progress: DataFrame) -> DataFrame:
    """First sample and first completion of each request among some samples."""
    done = F.when(F.col("status") == "done", F.col("ts"))
    return progress.groupBy(*scoped(progress, "req")).agg(
        F.min("ts").alias("started"), F.min(done).alias("finished")
    )


def run_completion(
    progress: DataFrame, out: str, state: str | None = None, every: str | None = None
) -> StreamingQuery:
    """Append first sample and first completion of each request and micro-batch."""
    return _append(progress, completion_part, out, state, every)


def merge_completion(kept: DataFrame) -> DataFrame:
    """Partial rows made one per request."""
    return kept.groupBy(*scoped(kept, "req")).agg(
        F.min("started").alias("started"), F.min("finished").alias("finished")
    )


def read_completion(kept: DataFrame, timeout: str = COPY_LIMIT) -> DataFrame:
    """Outcome of each request out of the table ``run_completion`` wrote."""
    return merge_completion(kept).withColumn("outcome", completion_outcome(timeout))


def latest_part(progress: DataFrame) -> DataFrame:
    """Last sample of each core among some samples."""
    last = F.max(F.struct("ts", "event_id", "status")).alias("last")
    return progress.groupBy(*scoped(progress, "core")).agg(last)


def run_latest(
    progress: DataFrame, out: str, state: str | None = None, every: str | None = None
) -> StreamingQuery:
    """Append the last sample of each core and micro-batch."""
    return _append(progress, latest_part, out, state, every)


def read_latest(kept: DataFrame) -> DataFrame:
    """Most recent sample of each core out of the table ``run_latest`` wrote."""
    keys = scoped(kept, "core")
    merged = kept.groupBy(*keys).agg(F.max("last").alias("last"))
    return merged.select(*keys, "last.ts", "last.event_id", "last.status")


def run_samples(
    progress: DataFrame, out: str, state: str | None = None, every: str | None = None
) -> StreamingQuery:
    """Append the samples as they come."""

    def slim(batch: DataFrame) -> DataFrame:
        return batch.select(*scoped(batch, "core"), "event_id", "ts", "status")

    return _append(progress, slim, out, state, every)


def read_retry_gate(kept: DataFrame, max_failures: int = MAX_FAILURES) -> DataFrame:
    """Runs of failed samples out of the table ``run_samples`` wrote; a sample polled twice counts once."""
    keys = scoped(kept, "core")
    samples = kept.dropDuplicates([*keys, "event_id"]).select(*keys, "event_id", "ts", "status")
    return retry_gate(samples, max_failures)


def run_overdue(
    progress: DataFrame,
    out: str,
    timeout: str = COPY_LIMIT,
    lateness: str = LATENESS,
    keep: str = KEEP,
    state: str | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """An alarm for each request that is not done ``timeout`` after its first sample.

    The clock is the latest time of any sample, less ``lateness``. A micro-batch that takes the clock past a
    deadline writes the alarm to ``out``/alarms, whether it has samples of the request or not. The requests seen, with
    a mark on those that had their alarm, are written to ``out``/requests, a table per micro-batch of which two are
    kept. A request is carried on to the next micro-batch while its deadline is ahead of the clock, and ``keep`` after its
    last sample; then it goes to ``out``/forgotten, which is read only when a sample comes that is older than ``keep``, so
    that such a sample gives no second alarm. A newer sample of a forgotten request starts a request anew. Samples
    without a time are left out.
    """

    def clock(latest: dt.datetime | None) -> tuple[Column, Column]:
        """Of a request at a latest time: its deadline has passed; it is carried on."""
        now = F.lit(latest).cast("timestamp_ntz")
        passed = F.col("started") + F.expr(f"interval {timeout}") <= now - F.expr(f"interval {lateness}")
        return passed, ~passed | (F.col("seen") >= now - F.expr(f"interval {keep}"))

    def write(batch: DataFrame, number: int) -> None:
        spark, keys = batch.sparkSession, scoped(batch, "req")
        batch = batch.where(F.col("ts").isNotNull())
        part = completion_part(batch).join(batch.groupBy(*keys).agg(F.max("ts").alias("seen")), keys)
        known = part.withColumn("alarmed", F.lit(False))
        columns, latest, forgotten = known.columns, None, f"{out}/forgotten"
        before, now = (f"{out}/requests/batch={n}" for n in (number - 1, number))
        first, last = batch.agg(F.min("ts"), F.max("ts")).first()
        if exists(spark, before):
            carried = spark.read.parquet(before).select(*columns)
            latest, edge = carried.agg(F.max("seen"), F.max("seen") - F.expr(f"interval {keep}")).first()
            known = known.unionByName(carried.where(clock(latest)[1]))
            if edge is not None and first is not None and first < edge and exists(spark, forgotten):
                old = part.where(F.col("started") < F.lit(edge).cast("timestamp_ntz")).select(*keys)
                # Those of this number are of an attempt that failed.
                gone = spark.read.parquet(forgotten).where(F.col("batch") < number)
                known = known.unionByName(gone.join(old, keys, "left_semi").select(*columns))
        merged = known.groupBy(*keys).agg(
            F.min("started").alias("started"),
            F.min("finished").alias("finished"),
            F.max("seen").alias("seen"),
            F.bool_or("alarmed").alias("alarmed"),
        )
        latest = max((t for t in (latest, last) if t is not None), default=None)
        passed, stays = clock(latest)
        deadline = F.col("started") + F.expr(f"interval {timeout}")
        late = F.col("finished").isNull() | (F.col("finished") > deadline)
        fired = merged.withColumn("fires", ~F.col("alarmed") & late & passed)
        fired.withColumn("alarmed", F.col("alarmed") | F.col("fires")).write.mode("overwrite").parquet(now)
        requests = spark.read.parquet(now)
        alarms = requests.where("fires").select(*keys, "started")
        alarms.write.mode("overwrite").parquet(f"{out}/alarms/batch={number}")
        requests.where(~stays).select(*columns).write.mode("overwrite").parquet(f"{forgotten}/batch={number}")
        remove(spark, f"{out}/requests/batch={number - 2}")

    return _each_batch(progress, write, state, every)


def read_alarms(alarms: DataFrame) -> DataFrame:
    """One row per alarm out of the ``alarms`` table ``run_overdue`` wrote."""
    return alarms.select(*scoped(alarms, "req"), "started")
