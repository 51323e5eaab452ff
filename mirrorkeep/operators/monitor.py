"""Progress of running copies, from polled status samples.

A sample has core, req (one copy request), event_id, ts and status, one of
replicating, done and failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import scoped, shared_scope
from .skew import hot_keys, with_range

# Time limit of a copy, number of failed status loads in a row that
# ends the retries, and the pause between two polls.
COPY_LIMIT = "20 minutes"
MAX_FAILURES = 10
POLL_SECONDS = 2

def completion_outcome(timeout: str = COPY_LIMIT) -> Column:
    """Outcome of a request from its ``started`` and ``finished`` times."""
    return (
        F.when(F.col("finished").isNull(), "never")
        .when(F.col("finished") > F.col("started") + F.expr(f"interval {timeout}"), "timed out")
        .otherwise("done")
    )


def completion_monitor(progress: DataFrame, timeout: str = COPY_LIMIT) -> DataFrame:
    """First sample, first completion and outcome of each copy request."""
    done = F.when(F.col("status") == "done", F.col("ts"))
    return (
        progress.groupBy(*scoped(progress, "req"))
        .agg(F.min("ts").alias("started"), F.min(done).alias("finished"))
        .withColumn("outcome", completion_outcome(timeout))
    )


def completion_summary(monitored: DataFrame) -> DataFrame:
    """Requests per outcome: the verdict over all requests."""
    return monitored.groupBy(*scoped(monitored, "outcome")).agg(
        F.count(F.lit(1)).alias("requests")
    )


def latest_status(progress: DataFrame) -> DataFrame:
    """Most recent sample of each core."""
    last = F.max(F.struct("ts", "event_id", "status"))
    return (
        progress.groupBy(*scoped(progress, "core"))
        .agg(last.alias("last"))
        .select(*scoped(progress, "core"), "last.ts", "last.event_id", "last.status")
    )


def slice_runs(samples: DataFrame) -> DataFrame:
    """Runs of failed samples inside each ``slice`` of a core's samples.

    ``pos`` is the number of good samples before the run in its slice and ``good``
    their number in the whole slice: a run at 0 may continue one from an earlier
    slice, a run at ``good`` may go on in a later one. A position without failed
    samples has a row too (``failures`` = 0), as its good sample ends a run.
    """
    keys = [*scoped(samples, "core"), "slice"]
    ordered = Window.partitionBy(*keys).orderBy("ts", "event_id")
    whole = Window.partitionBy(*keys)
    failed = F.col("status") == "failed"
    good = F.when(failed, 0).otherwise(1)
    placed = samples.select(
        *keys,
        "ts",
        failed.alias("failed"),
        # A good sample opens the position after it.
        F.sum(good).over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("pos"),
        F.sum(good).over(whole).alias("good"),
    )
    return placed.groupBy(*keys, "pos", "good").agg(
        F.count_if("failed").alias("failures"),
        F.min(F.when(F.col("failed"), F.col("ts"))).alias("started"),
        F.max(F.when(F.col("failed"), F.col("ts"))).alias("ended"),
    )


def join_runs(runs: DataFrame) -> DataFrame:
    """Runs that go on from slice to slice made one.

    Only the first and last run of a slice can belong to a longer one, so the window
    over a core sees at most two rows per slice.
    """
    keys = scoped(runs, "core")
    cols = [*keys, "started", "ended", "failures"]
    inner = runs.where((F.col("pos") > 0) & (F.col("pos") < F.col("good"))).select(*cols)
    edge = runs.where((F.col("pos") == 0) | (F.col("pos") == F.col("good")))
    # A position after a good sample starts a new run; position 0 continues the last.
    chain = Window.partitionBy(*keys).orderBy("slice", "pos")
    joined = (
        edge.withColumn("run", F.count_if(F.col("pos") > 0).over(chain))
        .groupBy(*keys, "run")
        .agg(
            F.min("started").alias("started"),
            F.max("ended").alias("ended"),
            F.sum("failures").alias("failures"),
        )
        .select(*cols)
    )
    return inner.unionByName(joined)


def retry_gate(progress: DataFrame, max_failures: int = MAX_FAILURES) -> DataFrame:
    """Runs of consecutive failed samples that end the retries of a core.

    The samples of a hot core are cut into ranges of time, whose runs are found apart
    and then joined; any other core is one slice. A sample without a time has no place in the order and is left out.
    """
    keys = scoped(progress, "core")
    timed = progress.where(F.col("ts").isNotNull())
    hot = hot_keys(timed, keys)
    if hot:
        cut = with_range(timed, keys, ["ts", "event_id"], hot)
        runs = join_runs(slice_runs(cut.withColumn("slice", F.col("_range"))))
    else:
        runs = slice_runs(timed.withColumn("slice", F.lit(0)))
    return runs.select(*keys, "started", "ended", "failures").where(
        F.col("failures") >= max_failures
    )


def retry_verdict(gates: DataFrame, queryable: DataFrame) -> DataFrame:
    """What becomes of each core whose retries ended.

    A core that still answers queries (it is in ``queryable``) is kept as
    ``unverified``, as its data was not compared; any other one has failed.
    """
    on = shared_scope(gates, queryable, "core")
    answers = queryable.select(*on).distinct().withColumn("answers", F.lit(True))
    cores = gates.select(*on).distinct()
    return cores.join(answers, on, "left").select(
        *on, F.when(F.col("answers"), "unverified").otherwise("failed").alias("verdict")
    )
