import datetime as dt

import pytest
from pyspark.sql import functions as F

from mirrorkeep.functions.status import is_replicating, parse_time
from mirrorkeep.operators import inventory, verify
from mirrorkeep.sources import status
from mirrorkeep.sources.status import parse_core_status, parse_replication_status
from tests.helpers import rows

T0 = dt.datetime(2024, 5, 1, 12)
COLS = "host string, core string, available boolean, num_docs int, version long, last_modified timestamp_ntz"


def match(spark, src, dst):
    names = [c.split()[0] for c in COLS.split(", ")]
    schema = ", ".join(f"{p}{c}" for p in ("src_", "dst_") for c in COLS.split(", "))
    base = {"host": "h", "core": "c", "available": True, "num_docs": 1, "version": 5,
            "last_modified": T0}
    row = tuple({**base, **side}[n] for side in (src, dst) for n in names)
    r = verify.match_data(spark.createDataFrame([row], schema)).first()
    return r["ok"], r["reason"]


def test_equal_and_newer_replica_match(spark):
    assert match(spark, {}, {}) == (True, "")
    assert match(spark, {}, {"version": 6}) == (True, "")


def test_older_replica_fails(spark):
    assert match(spark, {}, {"version": 4}) == (
        False, "DataMatch-Failed: Version mismatch: this:5 replica:4",
    )


@pytest.mark.parametrize("sign", [1, -1])
def test_drift_limit_is_exclusive(spark, sign):
    hour = dt.timedelta(hours=1)
    assert match(spark, {}, {"last_modified": T0 + sign * hour}) == (True, "")
    ok, reason = match(
        spark, {}, {"last_modified": T0 + sign * (hour + dt.timedelta(milliseconds=1))}
    )
    assert not ok
    assert reason.startswith("  last index update time between source and replica are different")
    assert "source: 2024-05-01T12:00:00.000Z replica: " in reason


def test_unknown_time_skips_the_time_check(spark):
    assert match(spark, {"last_modified": None}, {}) == (True, "")
    assert match(spark, {}, {"last_modified": None}) == (True, "")


def test_later_reasons_replace_earlier_ones(spark):
    down = {"available": False}
    assert match(spark, down, {}) == (
        False, "DataMatch-Failed: this core not available: h/c [Unavailable]",
    )
    assert match(spark, down, {**down, "host": "r"}) == (
        False, "DataMatch-Failed: replica core not available: r/c [Unavailable]",
    )
    ok, reason = match(
        spark, down, {**down, "version": 1, "last_modified": T0 + dt.timedelta(hours=2)}
    )
    assert not ok
    assert reason == (
        "DataMatch-Failed: Version mismatch: this:5 replica:1"
        "  last index update time between source and replica are different more than 60 minutes: "
        "source: 2024-05-01T12:00:00.000Z replica: 2024-05-01T14:00:00.000Z"
    )


def test_times(spark):
    texts = ["2024-05-01T12:00:00.000Z", "junk", "", None, "2024-05-01"]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in table.select(parse_time(F.col("t"))).collect()]
    assert got == [T0, None, None, None, None]


def status_doc(core="c1", failure="", index=None):
    fields = index if index is not None else (
        '<int name="numDocs">12</int><int name="maxDoc">14</int><int name="deletedDocs">2</int>'
        '<long name="version">77</long><int name="segmentCount">3</int>'
        '<bool name="current">true</bool><date name="lastModified">2024-05-01T12:00:00.000Z</date>'
        '<long name="sizeInBytes">4096</long>'
    )
    return (
        '<?xml version="1.0"?><response><lst name="responseHeader"><int name="status">0</int></lst>'
        f'<lst name="initFailures">{failure}</lst><lst name="status"><lst name="{core}">'
        f'<str name="name">{core}</str><lst name="index">{fields}</lst></lst></lst></response>'
    )


def parse(spark, *docs):
    table = spark.createDataFrame([("c1", d) for d in docs], "core string, doc string")
    return [r.asDict() for r in parse_core_status(table).collect()]


def test_core_status(spark):
    (got,) = parse(spark, status_doc())
    assert got == {
        "core": "c1", "available": True, "num_docs": 12, "max_docs": 14, "deleted_docs": 2,
        "version": 77, "segment_count": 3, "size_in_bytes": 4096,
        "last_modified_text": "2024-05-01T12:00:00.000Z", "last_modified": T0, "current": True,
    }


def test_optional_fields_keep_their_defaults(spark):
    (got,) = parse(
        spark,
        status_doc(index='<int name="numDocs">1</int><int name="deletedDocs">0</int>'
                         '<long name="version">2</long><date name="lastModified">junk</date>'),
    )
    assert got["available"] and got["num_docs"] == 1 and got["version"] == 2
    assert got["max_docs"] == got["segment_count"] == got["size_in_bytes"] == 0
    assert got["last_modified_text"] == "junk" and got["last_modified"] is None
    assert got["current"] is False


def test_unreadable_status_is_unavailable(spark):
    no_version = '<int name="numDocs">1</int><int name="deletedDocs">0</int>'
    bad_number = no_version.replace(">1<", ">one<") + '<long name="version">2</long>'
    got = parse(
        spark,
        status_doc(failure='<lst name="c1">locked</lst>'),
        status_doc(index=no_version),
        status_doc(index=bad_number),
        status_doc(core="another"),
        "<response><lst",
        "",
        None,
    )
    assert [g["available"] for g in got] == [False] * 7
    assert {g["num_docs"] for g in got} == {0} and {g["version"] for g in got} == {0}
    # A start-up failure of another core does not count.
    (fine,) = parse(spark, status_doc(failure='<lst name="c2">locked</lst>'))
    assert fine["available"]


def test_core_health_without_status_is_unavailable(spark):
    inv = spark.createDataFrame(
        [("a", "c1", 1, "h"), ("a", "c2", 2, "h")],
        "collection string, core string, rn int, node string",
    )
    docs = spark.createDataFrame(
        [("a", "c1", status_doc())], "collection string, core string, doc string"
    )
    got = inventory.core_health(inv, parse_core_status(docs))
    assert rows(got, "core", "available") == [("c1", True), ("c2", False)]


@pytest.mark.parametrize(
    "date, flag, want",
    [
        (None, "false", True),
        (" ", "false", True),
        ("now", None, False),
        ("now", " ", False),
        ("now", "FALSE", False),
        ("now", "true", True),
        ("now", "maybe", True),
    ],
)
def test_is_replicating(spark, date, flag, want):
    table = spark.createDataFrame([(date, flag)], "d string, f string")
    assert table.select(is_replicating(F.col("d"), F.col("f"))).first()[0] is want


def test_replication_status(spark):
    doc = (
        '<response><lst name="details"><lst name="slave"><str name="currentDate">x</str>'
        '<str name="isReplicating">true</str><str name="totalPercent">42.0</str>'
        '<str name="timeElapsed">10s</str><str name="bytesDownloaded">7</str><str name="bytesToDownload">9 MB</str>'
        '<str name="timeRemaining"> </str></lst></lst></response>'
    )
    none = '<response><lst name="details"/></response>'
    table = spark.createDataFrame([(1, doc), (2, none), (3, "<oops")], "id int, doc string")
    assert rows(parse_replication_status(table)) == [
        (1, True, "42.0", "10s", None, None, "7", "9 MB"), (2, True, "", "", *[None] * 4), (3, True, "", "", *[None] * 4),
    ]


def test_post_copy_check(spark):
    plan = spark.createDataFrame(
        [("d", "d_r1", "s", "s_r1", True, ""), ("d", "d_r2", "s", "s_r1", True, ""),
         ("d", "d_r3", "s", "s_r1", True, ""), ("d", "d_r4", "s", None, False, "no source"),
         ("d", "d_r5", "s", "s_r1", True, "")],
        "dest_collection string, dest_core string, collection string, source_core string, ok boolean, reason string",
    )
    src = spark.createDataFrame([("h", "s_r1", True, 1, 5, T0)], COLS).withColumn("collection", F.lit("s"))
    dst = spark.createDataFrame(
        [("h", "d_r1", True, 1, 5, T0), ("h", "d_r2", True, 1, 4, T0),
         ("h", "d_r5", False, 1, 5, T0)],
        COLS,
    ).withColumn("collection", F.lit("d"))
    got = verify.post_copy_check(plan, src, dst)
    assert rows(got, "entity", "status") == [
        ("d_r1", "ok"), ("d_r2", "failed"), ("d_r3", "unverified"), ("d_r4", "failed"),
        ("d_r5", "failed"),
    ]
    reasons = dict(rows(got, "entity", "reason"))
    assert reasons["d_r4"] == "no source"
    assert reasons["d_r5"] == "Replication Failed since source Core is not available.."
    assert rows(verify.diagnostics_summary(got)) == [("failed", 3), ("ok", 1), ("unverified", 1)]


def test_junk_in_an_optional_number_makes_a_core_unavailable(spark):
    def doc(extra):
        return (
            '<response><lst name="status"><lst name="c"><lst name="index"><int name="numDocs">3</int>'
            f'<int name="deletedDocs">0</int><long name="version">7</long>{extra}</lst></lst></lst></response>'
        )

    extras = ["", '<int name="maxDoc">many</int>', '<int name="maxDoc"> </int>', '<long name="sizeInBytes">12</long>', '<int name="segmentCount">1.5</int>']
    table = spark.createDataFrame([(i, "c", doc(x)) for i, x in enumerate(extras)], "id int, core string, doc string")
    assert rows(parse_core_status(table), "id", "available", "num_docs") == [
        (0, True, 3), (1, False, 0), (2, True, 3), (3, True, 3), (4, False, 0),
    ]


LOCKED = '<lst name="c1">locked</lst>'
USER_DATA = '<lst name="userData"><str name="numDocs">9</str></lst>'
USUAL = [
    status_doc(),
    status_doc(core="c2"),
    status_doc(failure=LOCKED),
    status_doc(failure=LOCKED.replace("c1", "c2")),
    status_doc(index=f'{USER_DATA}<int name="deletedDocs">0</int>\n <long name="version">2</long>{USER_DATA}<int name="numDocs"> 1 </int>'),
    status_doc(index='<int name="numDocs"></int><int name="numDocs">1</int><int name="deletedDocs">0</int><long name="version">2</long>'),
    status_doc(index='<int name="numDocs">1</int><int name="deletedDocs">0</int><long name="version">2</long><int name="maxDoc">1.5</int>'),
    status_doc(index=f'{USER_DATA}<int name="deletedDocs">0</int><long name="version">2</long>'),
]
ODD = [
    status_doc(failure='<lst name="c1"> </lst>'),
    status_doc(failure='<lst name="c1">a &amp; b</lst>'),
    status_doc(failure='<lst name="status">locked</lst>'),
    status_doc(core="index"),
    status_doc(core="c1").replace("<int", "<!-- none --><int"),
    status_doc(core="c1").replace(">12<", "><![CDATA[12]]><"),
    status_doc(core="c1").replace(">12<", ">1]]>2<"),
    status_doc(core="c1").replace(">c1<", ">\u00fc<"),
    status_doc(core="c1").replace(">c1<", ">\x01<"),
    status_doc(core="c1").replace('"numDocs"', "'numDocs'"),
    status_doc(core="c1").replace('<lst name="index">', '<lst name="index"><lst name="x"><int name="numDocs">5</int></lst>'),
    status_doc().replace("</response>", ""),
    status_doc() + "<more/>",
]


def test_usual_documents_are_read_without_the_xml_reader_and_alike(spark, monkeypatch):
    table = spark.createDataFrame([(i, "c1", d) for i, d in enumerate(USUAL + ODD)], "id int, core string, doc string")
    usual = rows(table.where(F.col("doc").rlike(status.USUAL_CORE_STATUS)), "id")
    assert usual == [(i,) for i in range(len(USUAL))]
    got = [r.asDict() for r in parse_core_status(table).orderBy("id").collect()]
    assert [g["available"] for g in got[: len(USUAL)]] == [True, False, False, True, True, False, False, False]
    monkeypatch.setattr(status, "USUAL_CORE_STATUS", r"\A\z")
    assert got == [r.asDict() for r in parse_core_status(table).orderBy("id").collect()]
    # The reader is not called for usual documents: with one that cannot work they come out the same.
    monkeypatch.undo()
    monkeypatch.setattr(status, "_xml", lambda doc, schema: F.raise_error(F.lit("read")).cast(schema))
    assert got[: len(USUAL)] == [r.asDict() for r in parse_core_status(table.where(F.col("id") < len(USUAL))).orderBy("id").collect()]


def test_a_long_usual_document(spark):
    many = "".join(f'<int name="n{i}">{i}</int>' for i in range(50_000))
    doc = status_doc(index=f'{many}<int name="numDocs">1</int><int name="deletedDocs">0</int><long name="version">2</long>{many}')
    table = spark.createDataFrame([("c1", doc), ("c1", doc[:-1])], "core string, doc string")
    assert [r[0] for r in table.select(F.col("doc").rlike(status.USUAL_CORE_STATUS)).collect()] == [True, False]
    assert rows(parse_core_status(table), "available", "num_docs") == [(False, 0), (True, 1)]


def test_columns_of_the_documents_are_kept(spark):
    table = spark.createDataFrame([("c1", status_doc(), 7, 8)], "core string, doc string, text int, usual int")
    assert rows(parse_core_status(table), "num_docs", "text", "usual") == [(12, 7, 8)]
