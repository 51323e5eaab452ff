"""Alarms by timers: equal to the batch rule after each file, and without any further sample."""

import datetime as dt
import time

import pytest

from mirrorkeep.streaming import timers
from tests.helpers import ordered, rows
from tests.test_monitor import files_one_by_one, overdue

FIELDS = "req string, started timestamp_ntz"


def alarms(spark, out, fields=FIELDS):
    return spark.read.schema(fields).parquet(out)


def runner(out, **options):
    return lambda stream, **o: timers.run_overdue_timers(stream, out, timeout="20 minutes", lateness="20 minutes", **options, **o)


def test_alarms_equal_the_batch_rule_after_each_file(spark, tmp_path):
    """One alarm per request, in the run that takes the clock past the deadline, whether it has a sample of the request or not."""
    files = [
        [("stuck", 60 * f, "replicating"), (f"new{f}", 60 * f + 1, "replicating"), (f"slow{f}", 60 * f, "replicating"), (f"slow{f}", 60 * f + 21, "done"),
         (f"edge{f}", 60 * f, "replicating"), (f"edge{f}", 60 * f + 20, "done"), (f"ok{f}", 60 * f, "replicating"), (f"ok{f}", 60 * f + 9, "done")]
        for f in range(4)
    ]
    out, counts = str(tmp_path / "out"), []
    for table in files_one_by_one(spark, tmp_path, files, runner(out)):
        got = alarms(spark, out)
        assert rows(got) == overdue(table, 20, 20)
        counts.append(got.count())
    assert counts == [0, 3, 5, 7] and got.count() == got.select("req").distinct().count()


def test_a_timer_goes_off_in_a_file_of_others(spark, tmp_path):
    """The later file has no sample of the request; earlier requests are neither read nor touched but by their timers."""
    files = [[("stuck", 0, "replicating"), ("ok", 0, "replicating"), ("ok", 5, "done")], [("other", 100, "done")], [("more", 200, "done")]]
    out = str(tmp_path / "out")
    seen = [rows(alarms(spark, out), "req") for _ in files_one_by_one(spark, tmp_path, files, runner(out))]
    assert seen == [[], [("stuck/r",)], [("stuck/r",)]]


def test_state_is_taken_away_by_a_timer(spark, tmp_path):
    day = 24 * 60
    files = [[("stuck", 0, "replicating")], [("other", day, "done")], [("third", 40 * day, "done")], [("stuck", 40 * day, "replicating"), ("x", 41 * day, "done")]]
    out = str(tmp_path / "out")
    counts = [alarms(spark, out).where("req = 'stuck/r'").count() for _ in files_one_by_one(spark, tmp_path, files, runner(out, keep="30 days"))]
    # After 30 days the name may stand for a new request.
    assert counts == [0, 1, 1, 2]


def test_requests_share_states(spark, tmp_path):
    """States, and so calls, are as many as groups; requests without a name or of other clusters stay apart in them."""
    t0 = dt.datetime(2024, 5, 1)
    later = t0 + dt.timedelta(days=1)
    names = [*(f"r{i}" for i in range(300)), None]
    cells = [(c, r, t0 + dt.timedelta(seconds=i), "replicating") for c in ("east", "west", None) for i, r in enumerate(names)]
    cells += [(c, r, t + dt.timedelta(minutes=5), "done") for i, (c, r, t, _) in enumerate(cells) if i % 3]
    table = spark.createDataFrame([*cells, ("east", "last", later, "replicating")], "cluster string, req string, ts timestamp_ntz, status string")
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    table.repartition(5).write.parquet(path)
    query = timers.run_overdue_timers(spark.readStream.schema(table.schema).parquet(path), out, timeout="20 minutes", groups=4)
    query.awaitTermination()
    wanted = [(c, r, t) for i, (c, r, t, _) in enumerate(cells[: 3 * len(names)]) if not i % 3]
    assert rows(alarms(spark, out, f"cluster string, {FIELDS}")) == ordered(wanted)
    assert 1 <= query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 4


def test_an_alarm_goes_off_without_further_samples(spark, tmp_path):
    """By the time of day: nothing comes after the first file."""
    now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    cells = [("stuck", now, "replicating"), ("ok", now, "replicating"), ("ok", now, "done")]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    table = spark.createDataFrame(cells, "req string, ts timestamp_ntz, status string")
    table.write.parquet(path)
    stream = spark.readStream.schema(table.schema).parquet(path)
    query = timers.run_overdue_timers(stream, out, every="1 second", timeout="10 seconds", clock="wall")
    try:
        found = []
        for _ in range(90):
            time.sleep(1)
            if query.exception() is not None:
                raise query.exception()
            if (tmp_path / "out" / "_spark_metadata").exists() and (found := rows(alarms(spark, out), "req")):
                break
        assert found == [("stuck",)]
    finally:
        query.stop()


def test_clusters_and_missing_times(spark, tmp_path):
    t0 = dt.datetime(2024, 5, 1)
    cells = [(c, "r", t0 + dt.timedelta(minutes=m), s) for c, m, s in (("east", 0, "replicating"), ("west", 0, "replicating"), ("west", 3, "done"), ("west", 300, None))]
    table = spark.createDataFrame([*cells, ("east", "none", None, "replicating")], "cluster string, req string, ts timestamp_ntz, status string")
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    table.write.parquet(path)
    timers.run_overdue_timers(spark.readStream.schema(table.schema).parquet(path), out, timeout="20 minutes").awaitTermination()
    assert rows(alarms(spark, out, f"cluster string, {FIELDS}")) == [("east", "r", t0)]
    with pytest.raises(ValueError, match="clock"):
        timers.overdue_timers(table, clock="moon")
