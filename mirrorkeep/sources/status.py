"""Core status and replication status documents (XML).

Each document is parsed once into nested name/value lists; a document that is not
well-formed gives nulls instead of failing the job. Most of that time is Spark's making of
nested rows, so a core status written the usual way is read by expressions on its text instead.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import blank
from ..functions.status import is_replicating, parse_time

# Element and attribute names of the status documents, here and below.
_VALUES = "array<struct<_name:string,_VALUE:string>>"
_INDEX = (
    f"struct<_name:string,`int`:{_VALUES},`long`:{_VALUES},`date`:{_VALUES},`bool`:{_VALUES}>"
)
_CORE = f"struct<_name:string,_VALUE:string,lst:array<{_INDEX}>>"
CORE_STATUS = f"struct<lst:array<struct<_name:string,lst:array<{_CORE}>>>>"

_PART = f"struct<_name:string,str:{_VALUES}>"
REPLICATION_STATUS = f"struct<lst:array<struct<_name:string,lst:array<{_PART}>>>>"

# The usual way to write a core status, as one expression that takes the whole document: one core with its index, names and texts in
# printable ASCII without markup, no other attributes. Whatever it takes is well-formed XML and means what the reader below makes
# of it; all else is left to the reader. Loops over elements are possessive, so the match is linear and its depth does not grow with the document.
_GAP = r"[ \t\r\n]*+"
_TEXT = r"[ -%'-;=?-~]*"
_NAME = r"[!#-%'-;=?-~]+"
# These lists are found by name, so no other may be called like them.
_LIST = rf'<lst name="(?!(?:status|index|initFailures|responseHeader)"){_NAME}">'


def _leaves(*tags: str) -> str:
    return "(?:(?:" + "|".join(f'<{t} name="{_NAME}">{_TEXT}</{t}>' for t in tags) + f"){_GAP})*+"


_ANY = _leaves("str", "int", "long", "date", "bool", "float", "double")
_FAILURE = rf"{_LIST}(?! *+<){_TEXT}</lst>"
USUAL_CORE_STATUS = (
    rf'\A(?:<\?xml version="1\.0"(?: encoding="UTF-8")?+\?>)?+{_GAP}<response>{_GAP}'
    rf'(?:<lst name="responseHeader">{_GAP}{_ANY}</lst>{_GAP})?+'
    rf'(?:<lst name="initFailures"(?:/>|>{_GAP}(?:{_FAILURE}{_GAP})*+</lst>){_GAP})?+'
    rf'<lst name="status">{_GAP}{_LIST}{_GAP}{_ANY}(?:{_LIST}{_GAP}{_ANY}</lst>{_GAP}{_ANY})*+'
    rf'<lst name="index">{_GAP}{_ANY}(?:{_LIST}{_GAP}{_leaves("str")}</lst>{_GAP}{_ANY})*+</lst>{_GAP}'
    rf"</lst>{_GAP}</lst>{_GAP}</response>{_GAP}\z"
)


def _xml(doc: Column, schema: str) -> Column:
    return F.from_xml(doc, schema, {"mode": "PERMISSIVE", "ignoreSurroundingSpaces": "true"})


def _named(items: Column, name) -> Column:
    """First entry of a name/value list with this name, null if there is none."""
    return F.get(F.filter(items, lambda e: e["_name"] == name), F.lit(0))


def parse_core_status(docs: DataFrame) -> DataFrame:
    """Status fields of each core out of its status document.

    ``docs`` has core and doc. The core is available when it has no start-up failure, its document count, deleted
    count and version are readable, and every other number is blank or readable. An unavailable core keeps the
    defaults 0 and null.
    """
    keep = [c for c in docs.columns if c != "doc"]
    # Each step uses what the one before has made more than once, so Spark keeps them apart and no document is read twice.
    usual = docs.withColumn("_usual", F.coalesce(F.col("doc").rlike(USUAL_CORE_STATUS), F.lit(False)))
    parts = usual.select(
        *keep,
        "_usual",
        F.when(F.col("_usual"), F.substring_index("doc", '<lst name="status">', 1)).alias("_head"),
        F.when(
            F.col("_usual") & (F.regexp_extract("doc", rf'<lst name="status">{_GAP}<lst name="({_NAME})"', 1) == F.col("core")),
            F.substr("doc", F.instr("doc", '<lst name="index">')),
        ).alias("_text"),
        F.when(~F.col("_usual"), _xml(F.col("doc"), CORE_STATUS)).alias("_x"),
    )
    status = parts.select(
        *keep,
        "_usual",
        "_head",
        "_text",
        _named(F.col("_x.lst"), F.lit("status"))["lst"].alias("_cores"),
        _named(F.col("_x.lst"), F.lit("initFailures"))["lst"].alias("_failures"),
    ).select(
        *keep,
        "_usual",
        "_text",
        _named(_named(F.col("_cores"), F.col("core"))["lst"], F.lit("index")).alias("_i"),
        # A failure of a usual document has a text that is not blank.
        F.when(F.col("_usual"), F.coalesce(F.contains("_head", F.concat(F.lit('<lst name="'), "core", F.lit('">'))), F.lit(False)))
        .otherwise(~blank(_named(F.col("_failures"), F.col("core"))["_VALUE"]))
        .alias("_failed"),
    )

    names = {"numDocs": "int", "maxDoc": "int", "deletedDocs": "int", "version": "long", "segmentCount": "int",
             "lastModified": "date", "sizeInBytes": "long", "current": "bool"}

    def value(name: str, kind: str) -> Column:
        return F.trim(
            F.when(F.col("_usual"), F.regexp_extract("_text", f'<{kind} name="{name}">([^<]*)', 1))
            .otherwise(_named(F.col(f"_i.{kind}"), F.lit(name))["_VALUE"])
        )

    raw = status.select(*keep, "_failed", *[value(n, k).alias(f"_{n}") for n, k in names.items()])

    def field(name: str, dtype: str) -> Column:
        # To cast an empty text takes long.
        return F.nullif(F.col(f"_{name}"), F.lit("")).try_cast(dtype)

    def junk(name: str, dtype: str) -> Column:
        return ~blank(F.col(f"_{name}")) & field(name, dtype).isNull()

    optional = (("maxDoc", "int"), ("segmentCount", "int"), ("sizeInBytes", "long"))
    unreadable = reduce(or_, [junk(*o) for o in optional])

    fields = raw.select(
        *keep,
        "_failed",
        unreadable.alias("_unreadable"),
        field("numDocs", "int").alias("num_docs"),
        field("maxDoc", "int").alias("max_docs"),
        field("deletedDocs", "int").alias("deleted_docs"),
        field("version", "long").alias("version"),
        field("segmentCount", "int").alias("segment_count"),
        F.col("_lastModified").alias("last_modified_text"),
        field("sizeInBytes", "long").alias("size_in_bytes"),
        "_current",
    )
    required = ("num_docs", "deleted_docs", "version")
    up = ~F.col("_failed") & ~F.col("_unreadable")
    for name in required:
        up = up & F.col(name).isNotNull()
    zero = {"num_docs": "int", "max_docs": "int", "deleted_docs": "int", "version": "long",
            "segment_count": "int", "size_in_bytes": "long"}
    text = F.col("last_modified_text")
    return fields.withColumn("available", up).select(
        *keep,
        "available",
        *[
            F.when(F.col("available"), F.coalesce(n, F.lit(0).cast(t)))
            .otherwise(F.lit(0).cast(t))
            .alias(n)
            for n, t in zero.items()
        ],
        F.when(F.col("available") & ~blank(text), text).alias("last_modified_text"),
        F.when(F.col("available"), parse_time(text)).alias("last_modified"),
        (F.col("available") & (F.lower(F.coalesce("_current", F.lit(""))) == "true")).alias(
            "current"
        ),
    )


def parse_replication_status(docs: DataFrame) -> DataFrame:
    """Is the copy of each core still running, how far is it, and for how long; what is left of it, null where the document does not say."""
    keep = [c for c in docs.columns if c != "doc"]
    part = (
        docs.select(*keep, _xml(F.col("doc"), REPLICATION_STATUS).alias("x"))
        .select(*keep, _named(F.col("x.lst"), F.lit("details"))["lst"].alias("d"))
        .select(*keep, _named(F.col("d"), F.lit("slave"))["str"].alias("s"))
    )

    def field(name: str) -> Column:
        return F.coalesce(_named(F.col("s"), F.lit(name))["_VALUE"], F.lit(""))

    def transfer(name: str) -> Column:
        return F.when(~blank(field(name)), F.trim(field(name)))

    return part.select(
        *keep,
        is_replicating(field("currentDate"), field("isReplicating")).alias("replicating"),
        field("totalPercent").alias("percent_complete"),
        field("timeElapsed").alias("time_elapsed"),
        transfer("downloadSpeed").alias("download_speed"),
        transfer("timeRemaining").alias("time_remaining"),
        transfer("bytesDownloaded").alias("bytes_downloaded"),
        transfer("bytesToDownload").alias("bytes_to_download"),
    )
