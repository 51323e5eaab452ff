import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mirrorkeep.operators import monitor
from mirrorkeep.operators.skew import hot_keys
from mirrorkeep.streaming import monitor as streaming
from tests.helpers import rows

T0 = dt.datetime(2024, 1, 1)
SAMPLE = "core string, req string, event_id long, ts timestamp_ntz, status string"


def samples(spark, data):
    """Data are (core, minutes, status) triples."""
    out = [
        (core, f"{core}/r", i, T0 + dt.timedelta(minutes=at), status)
        for i, (core, at, status) in enumerate(data)
    ]
    return spark.createDataFrame(out, SAMPLE)


def runs_by_hand(data, limit):
    out = []
    for core in {d[0] for d in data}:
        run = []
        mine = sorted((at, i, s) for i, (c, at, s) in enumerate(data) if c == core)
        for at, _, status in [*mine, (None, None, "done")]:
            if status == "failed":
                run.append(at)
            else:
                if len(run) >= limit:
                    ends = [T0 + dt.timedelta(minutes=m) for m in (run[0], run[-1])]
                    out.append((core, *ends, len(run)))
                run = []
    return sorted(out)


def random_samples(seed):
    rng = random.Random(seed)
    data = []
    for core in ("c1", "c2", "c3"):
        at = 0
        bad = rng.choice([0.3, 0.7, 0.95])
        for _ in range(rng.randint(1, 120)):
            # Repeated times, gaps of several slices, and slices full of samples.
            at += rng.choice([0, 1, 1, 7, 25, 200])
            data.append((core, at, "failed" if rng.random() < bad else "replicating"))
    rng.shuffle(data)
    return data


@pytest.mark.parametrize("seed", range(4))
def test_retry_gate_against_plain_python(spark, seed):
    data = random_samples(seed)
    got = monitor.retry_gate(samples(spark, data), max_failures=2)
    assert rows(got) == runs_by_hand(data, 2)


@pytest.mark.parametrize("seed", range(8))
def test_retry_gate_of_hot_cores(spark, seed, small_groups_hot):
    data = random_samples(seed)
    table = samples(spark, data)
    hot = hot_keys(table, ["core"])
    assert hot and max(k.pieces for k in hot) > 1
    assert rows(monitor.retry_gate(table, 1)) == runs_by_hand(data, 1)
    assert rows(monitor.retry_gate(table, 3)) == runs_by_hand(data, 3)


def test_retry_gate_default_limit(spark):
    data = [("c", m, "failed") for m in range(9)] + [("d", m * 61, "failed") for m in range(10)]
    got = monitor.retry_gate(samples(spark, data))
    assert rows(got, "core", "failures") == [("d", 10)]


def test_retry_verdict(spark):
    data = [(c, m, "failed") for c in ("c", "d") for m in range(3)]
    gates = monitor.retry_gate(samples(spark, data), max_failures=3)
    answers = spark.createDataFrame([("c",), ("c",), ("x",)], "core string")
    assert rows(monitor.retry_verdict(gates, answers)) == [("c", "unverified"), ("d", "failed")]


def test_completion(spark):
    data = [
        ("fast", 0, "replicating"), ("fast", 20, "done"), ("fast", 40, "done"),
        ("slow", 0, "replicating"), ("slow", 21, "done"),
        ("stuck", 0, "replicating"), ("stuck", 500, "failed"),
    ]
    got = monitor.completion_monitor(samples(spark, data))
    assert rows(got, "req", "outcome") == [
        ("fast/r", "done"), ("slow/r", "timed out"), ("stuck/r", "never"),
    ]
    assert rows(monitor.completion_summary(got)) == [("done", 1), ("never", 1), ("timed out", 1)]


def test_latest(spark):
    data = [("c", 5, "failed"), ("c", 9, "replicating"), ("c", 9, "done"), ("c", 1, "failed")]
    assert rows(monitor.latest_status(samples(spark, data)), "event_id", "status") == [(2, "done")]


@pytest.fixture
def folder(spark, tmp_path):
    """Samples as files that arrive one by one, in order of time but for a little lateness."""
    data = sorted(random_samples(11), key=lambda d: d[1])
    data += [(c, 3000 + m, "done" if m == 7 else "failed") for c in ("c1", "c4") for m in range(9)]
    table = samples(spark, data)
    path = str(tmp_path / "in")
    edges = [-1, 200, 1000, 3003, 10**6]
    for low, high in zip(edges, edges[1:]):
        minutes = F.timestamp_diff("MINUTE", F.lit(T0).cast("timestamp_ntz"), F.col("ts"))
        part = table.where((minutes > low) & (minutes <= high))
        part.coalesce(1).write.mode("append").parquet(path)
    stream = (
        spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)
    )
    return table, stream, data


def test_streams_equal_batch(spark, folder, tmp_path):
    table, stream, data = folder

    def run(job, name, **options):
        out = str(tmp_path / name)
        query = job(stream, out, **options)
        query.awaitTermination()
        assert len([p for p in query.recentProgress if p["numInputRows"]]) > 1
        return spark.read.parquet(out)

    done = streaming.read_completion(run(streaming.run_completion, "completion"), "20 minutes")
    assert rows(done) == rows(monitor.completion_monitor(table))
    last = streaming.read_latest(run(streaming.run_latest, "latest"))
    assert rows(last) == rows(monitor.latest_status(table))
    gate = streaming.read_retry_gate(run(streaming.run_samples, "samples"), 2)
    assert rows(gate) == rows(monitor.retry_gate(table, 2)) == runs_by_hand(data, 2)


def files_one_by_one(spark, tmp_path, files, run, **options):
    """Run a stream over files that arrive one after the other; what it has written after each."""
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    for data in files:
        table = samples(spark, data) if isinstance(data, list) else data
        table.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(table.schema).parquet(path)
        run(stream, state=state, **options).awaitTermination()
        yield spark.read.parquet(path)


def test_late_samples_count(spark, tmp_path):
    out = str(tmp_path / "out")
    files = [("c", 0, "replicating")], [("c", 3 * 1440, "failed")], [("c", 5, "done")]
    run = lambda stream, **o: streaming.run_completion(stream, out, **o)
    outcomes = []
    for _ in files_one_by_one(spark, tmp_path, files, run):
        got = streaming.read_completion(spark.read.parquet(out))
        outcomes += rows(got, "started", "outcome")
    assert outcomes == [(T0, "never"), (T0, "never"), (T0, "done")]


def overdue(table, timeout, lateness):
    """Requests that are past their deadline by the latest sample, less the lateness."""
    latest = table.agg(F.max("ts")).first()[0]
    late = monitor.completion_monitor(table, f"{timeout} minutes").where("outcome <> 'done'")
    keys = [c for c in ("cluster", "req", "started") if c in late.columns]
    deadline = F.col("started") + F.expr(f"interval {timeout} minutes")
    return rows(late.where(deadline <= F.lit(latest - dt.timedelta(minutes=lateness)).cast("timestamp_ntz")), *keys)


def test_alarms_after_each_file(spark, tmp_path):
    """One alarm per request, in the micro-batch that takes the clock past the deadline, also for one that is still polled."""
    files = [
        [("stuck", 60 * f, "replicating")] + [(f"new{f}", 60 * f + 1, "replicating")] + [(f"ok{f}", 60 * f, "replicating"), (f"ok{f}", 60 * f + 9, "done")]
        for f in range(6)
    ]
    out, counts = str(tmp_path / "out"), []
    run = lambda stream, **o: streaming.run_overdue(stream, out, timeout="20 minutes", lateness="20 minutes", **o)
    for table in files_one_by_one(spark, tmp_path, files, run):
        alarms = streaming.read_alarms(spark.read.parquet(f"{out}/alarms"))
        assert rows(alarms, "req", "started") == overdue(table, 20, 20)
        counts.append(alarms.count())
    assert counts == [0, 2, 3, 4, 5, 6]
    assert len(list((tmp_path / "out" / "requests").glob("batch=*"))) == 2


DAY = 24 * 60


@pytest.mark.parametrize(
    "files",
    [
        [[("stuck", 0, "replicating"), ("ok", 0, "replicating"), ("ok", 9, "done"), ("newer", 60 * DAY, "failed")]],
        [[("stuck", 0, "replicating"), ("ok", 0, "replicating"), ("ok", 9, "done")], [("newer", 40 * DAY, "failed")]],
    ],
    ids=["one file of 60 days", "gap of 40 days"],
)
def test_alarms_across_more_days_than_requests_are_kept(spark, tmp_path, files):
    out, run = str(tmp_path / "out"), lambda stream, **o: streaming.run_overdue(stream, out, timeout="20 minutes", lateness="20 minutes", **o)
    for table in files_one_by_one(spark, tmp_path, files, run):
        assert rows(streaming.read_alarms(spark.read.parquet(f"{out}/alarms")), "req", "started") == overdue(table, 20, 20)
    assert rows(spark.read.parquet(f"{out}/alarms"), "req") == [("stuck/r",)]


def test_samples_of_forgotten_requests_give_no_second_alarm(spark, tmp_path):
    files = [
        [("stuck", 0, "replicating"), ("ok", 0, "replicating"), ("ok", 9, "done")],
        [("newer", 40 * DAY, "replicating")],
        [("stuck", 1, "failed"), ("ok", 1, "replicating"), ("late", 2, "replicating")],
    ]
    out, counts = str(tmp_path / "out"), []
    run = lambda stream, **o: streaming.run_overdue(stream, out, timeout="20 minutes", lateness="20 minutes", **o)
    for table in files_one_by_one(spark, tmp_path, files, run):
        alarms = streaming.read_alarms(spark.read.parquet(f"{out}/alarms"))
        assert rows(alarms, "req", "started") == overdue(table, 20, 20)
        counts.append(alarms.count())
    assert counts == [0, 1, 2]


def test_requests_with_a_deadline_ahead_are_carried_on(spark, tmp_path):
    files = [("stuck", 0, "replicating")], [("newer", 40 * DAY, "replicating")], [("newer", 51 * DAY, "done")]
    out, counts = str(tmp_path / "out"), []
    run = lambda stream, **o: streaming.run_overdue(stream, out, timeout="50 days", lateness="20 minutes", **o)
    for _ in files_one_by_one(spark, tmp_path, [list(f) for f in files], run):
        counts.append(streaming.read_alarms(spark.read.parquet(f"{out}/alarms")).count())
    assert counts == [0, 0, 1]


def test_alarm_comes_once_and_restarts_do_no_harm(spark, folder, tmp_path):
    table, stream, _ = folder
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        streaming.run_overdue(stream, out, timeout="20 minutes", state=state).awaitTermination()
    alarms = streaming.read_alarms(spark.read.parquet(f"{out}/alarms"))
    assert rows(alarms, "req", "started") == overdue(table, 20, 20) != []


def test_streams_keep_clusters_apart(spark, tmp_path):
    east = samples(spark, [("c", 0, "replicating"), ("c", 90, "failed")]).withColumn("cluster", F.lit("east"))
    west = samples(spark, [("c", 30, "replicating"), ("c", 40, "done")]).withColumn("cluster", F.lit("west"))
    table = east.unionByName(west)
    jobs = {
        "completion": (streaming.run_completion, streaming.read_completion, monitor.completion_monitor),
        "latest": (streaming.run_latest, streaming.read_latest, monitor.latest_status),
        "samples": (streaming.run_samples, lambda t: streaming.read_retry_gate(t, 1), lambda t: monitor.retry_gate(t, 1)),
    }
    path = str(tmp_path / "in")
    table.write.parquet(path)
    for name, (run, read, batch) in jobs.items():
        run(spark.readStream.schema(table.schema).parquet(path), str(tmp_path / name)).awaitTermination()
        got = read(spark.read.parquet(str(tmp_path / name)))
        assert "cluster" in got.columns and rows(got, *batch(table).columns) == rows(batch(table))
    out = str(tmp_path / "alarms")
    streaming.run_overdue(spark.readStream.schema(table.schema).parquet(path), out, timeout="20 minutes").awaitTermination()
    assert rows(streaming.read_alarms(spark.read.parquet(f"{out}/alarms"))) == [("east", "c/r", T0)]


def test_restarted_stream_goes_on(spark, folder, tmp_path):
    table, stream, _ = folder
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        streaming.run_latest(stream, out, state=state).awaitTermination()
    assert rows(streaming.read_latest(spark.read.parquet(out))) == rows(monitor.latest_status(table))
