import random
from datetime import datetime

from pyspark.sql import functions as F

from mirrorkeep.operators import history
from mirrorkeep.operators.history import core_history
from tests.helpers import ordered, rows

SCHEMA = "cluster string, snapshot_ts timestamp_ntz, collection string, shard string, core string, rn int, node string, state string, note string"


def plain(inv):
    times, seen = {}, {}
    for cluster, ts, *core, rn, node, state, _ in inv:
        if ts is not None:
            times.setdefault(cluster, set()).add(ts)
            at = seen.setdefault((cluster, *core), {})
            value = (rn, node is not None, node or "", state)
            at[ts] = max(at.get(ts, value), value)
    out = []
    for key, at in seen.items():
        all_times, span = sorted(times[key[0]]), None
        for ts in [*all_times, None]:
            value = (at[ts][2] if at[ts][1] else None, at[ts][3]) if ts in at else None
            if span and (value is None or value != span[0]):
                out.append((*key, *span[0], span[1], ts, span[2]))
                span = None
            if value is not None:
                span = (value, span[1], span[2] + 1) if span else (value, ts, 1)
    return ordered(out)


def test_spans_of_cores(spark):
    dice = random.Random(3)
    inv = []
    for cluster, years in (("east", range(2001, 2009)), (None, range(2004, 2007))):
        for year in years:
            for core in range(14):
                for _ in range(dice.choice([0, 1, 1, 1, 2])):
                    where = dice.choice(["n1", "n1", "n1", "n2", None]), dice.choice(["active", "active", "down"])
                    inv.append((cluster, datetime(year, 1, 1), "c", "s1" if core else None, f"k{core}", dice.randint(1, 2), *where, "x"))
    inv += [("east", None, "c", "s1", "k1", 1, "n9", "down", "x")]
    got = rows(core_history(spark.createDataFrame(inv, SCHEMA)))
    assert got == plain(inv)
    assert any(r[-2] is None for r in got) and any(r[-1] > 1 for r in got)
    assert core_history(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tasks_are_bounded_by_rows(spark, monkeypatch):
    """Cores are dealt to more tasks than shuffle partitions where they have more rows, and each stays in one."""
    cells = [(datetime(2024, 1, 1 + d), f"c{c}", "s", f"c{c}_r", 1, "n", "up") for d in range(2) for c in range(50)]
    inv = spark.createDataFrame(cells, "snapshot_ts timestamp_ntz, collection string, shard string, core string, rn int, node string, state string")
    monkeypatch.setattr(history, "SORTED_ROWS", 5)
    got = core_history(inv.withColumn("shard", F.lit("s")))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ", 21), REPARTITION_BY_NUM" in plan and plan.index("REPARTITION_BY_NUM") > plan.rindex("Window [lag")
    assert got.count() == 50 and not got.where("snapshots <> 2 or valid_to is not null").count()
