"""Status checks of single rows: health gate, data match, label, replication state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..common import blank

# Message texts, time format and drift limit users of the original
# reports rely on.
SOURCE_NULL_ENTITY = "NULL"
SOURCE_NULL = "Replication Failed since source Core is NULL.."
SOURCE_UNAVAILABLE = "Replication Failed since source Core is not available.."
THIS_UNAVAILABLE = "DataMatch-Failed: this core not available: "
REPLICA_UNAVAILABLE = "DataMatch-Failed: replica core not available: "
VERSION_MISMATCH = "DataMatch-Failed: Version mismatch: this:"
VERSION_REPLICA = " replica:"
TIME_DRIFT = "  last index update time between source and replica are different more than 60 minutes: source: "
TIME_REPLICA = " replica: "
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
MAX_DRIFT_MS = 60 * 60 * 1000


def parse_time(text: Column) -> Column:
    """Status time as a timestamp; blank or unreadable text gives null."""
    return F.try_to_timestamp(text, F.lit(TIME_FORMAT)).cast("timestamp_ntz")


def format_time(ts: Column) -> Column:
    return F.date_format(ts, TIME_FORMAT)


def source_gate(core: Column, available: Column) -> tuple[Column, Column, Column]:
    """(ok, entity, reason) of a source core: it must exist and be available."""
    up = F.coalesce(available, F.lit(False))
    ok = core.isNotNull() & up
    entity = F.when(core.isNull(), SOURCE_NULL_ENTITY).otherwise(core)
    reason = F.when(core.isNull(), SOURCE_NULL).when(~up, SOURCE_UNAVAILABLE).otherwise("")
    return ok, entity, reason


def core_label(
    host: Column, name: Column, available: Column, num_docs: Column, version: Column
) -> Column:
    """``host/name [numDocs=… version=…]`` or ``host/name [Unavailable]``."""
    where = F.concat(F.coalesce(host, F.lit("null")), F.lit("/"), name)
    return F.when(
        F.coalesce(available, F.lit(False)),
        F.concat(
            where,
            F.lit(" [numDocs="),
            num_docs.cast("string"),
            F.lit(" version="),
            version.cast("string"),
            F.lit("]"),
        ),
    ).otherwise(F.concat(where, F.lit(" [Unavailable]")))


def data_match(source: str, replica: str) -> dict[str, Column]:
    """Compare a source core with its replica.

    ``source`` and ``replica`` are column name prefixes; behind each are host, core,
    available, num_docs, version and last_modified (a timestamp, null if unknown).
    A destination version may be ahead, never behind. The time check is skipped
    when either time is unknown. Returns the columns of the verdict: a later
    reason replaces an earlier one, and the time reason is added at the end.
    """

    def part(prefix: str, name: str) -> Column:
        return F.col(f"{prefix}{name}")

    def label(prefix: str) -> Column:
        names = ("host", "core", "available", "num_docs", "version")
        return core_label(*[part(prefix, n) for n in names])

    source_down = ~F.coalesce(part(source, "available"), F.lit(False))
    replica_down = ~F.coalesce(part(replica, "available"), F.lit(False))
    behind = F.coalesce(part(source, "version"), F.lit(0)) > F.coalesce(
        part(replica, "version"), F.lit(0)
    )
    gap = F.timestamp_diff(
        "MILLISECOND", part(source, "last_modified"), part(replica, "last_modified")
    )
    drift = F.coalesce(F.abs(gap) > MAX_DRIFT_MS, F.lit(False))
    reason = (
        F.when(
            behind,
            F.concat(
                F.lit(VERSION_MISMATCH),
                F.coalesce(part(source, "version"), F.lit(0)).cast("string"),
                F.lit(VERSION_REPLICA),
                F.coalesce(part(replica, "version"), F.lit(0)).cast("string"),
            ),
        )
        .when(replica_down, F.concat(F.lit(REPLICA_UNAVAILABLE), label(replica)))
        .when(source_down, F.concat(F.lit(THIS_UNAVAILABLE), label(source)))
        .otherwise("")
    )
    late = F.when(
        drift,
        F.concat(
            F.lit(TIME_DRIFT),
            format_time(part(source, "last_modified")),
            F.lit(TIME_REPLICA),
            format_time(part(replica, "last_modified")),
        ),
    ).otherwise("")
    return {
        "unavailable": source_down | replica_down,
        "behind": behind,
        "drift": drift,
        "ok": ~(source_down | replica_down | behind | drift),
        "reason": F.concat(reason, late),
    }


def is_replicating(current_date: Column, flag: Column) -> Column:
    """Is a copy still running: not started yet counts as running, no flag as finished."""
    return (
        F.when(blank(current_date), True)
        .when(blank(flag), False)
        .otherwise(F.lower(flag) != "false")
    )
