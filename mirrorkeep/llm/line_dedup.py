"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of three lines decides after which lines a chunk ends, so the same passage is cut the
same way wherever it stands. A chunk of several lines that occurs more than once, compared byte by byte, is kept where
it comes first and removed everywhere else; chunks of one line stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorkeep.common import materialize
from mirrorkeep.llm.mixing import let

# A chunk ends after one line in so many, on average.
MEAN_LINES = 4
LINE_BITS = 28
FACTORS = (1, 31337, 271828)
MODULUS = (1 << 31) - 1


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, LINE_BITS // 4), 16, 10).cast("bigint")


def chunks(text: Column) -> Column:
    """The chunks of a text: array of (n_lines, lines). Null text: null."""

    def cut(s: Column) -> Column:
        def ends_here(h: Column, i: Column) -> Column:
            rolling = h * FACTORS[0]
            for back, factor in enumerate(FACTORS[1:], 1):
                rolling = rolling + F.when(i >= back, F.get(s.hashes, i - back)).otherwise(0) * factor
            return ((rolling % MODULUS) % MEAN_LINES == 0) | (i == F.size(s.lines) - 1)

        marks = F.transform(s.hashes, ends_here)
        ends = let(marks, lambda m: F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: F.get(m, i)))
        return let(ends, lambda e: F.transform(e, lambda end, k: let(
            F.when(k == 0, 0).otherwise(F.get(e, k - 1) + 1),
            lambda start: F.struct((end - start + 1).alias("n_lines"), F.array_join(F.slice(s.lines, start + 1, end - start + 1), "\n").alias("lines")),
        )))

    lines = F.split(text, "\n", -1)
    with_hashes = let(lines, lambda x: F.struct(x.alias("lines"), F.transform(x, line_hash).alias("hashes")))
    return F.when(text.isNotNull(), let(with_hashes, cut))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """id, mark, copies, removed, found: for each row (id and hash of its text) the numbers of the chunks to be removed.

    Of equal chunks, that of the smallest id stays, there the first; rows without an id come last, and of rows that share an
    id that with the smallest hash comes first. ``copies`` is how many rows have this id and text: ``removed`` is for one of
    them, ``found`` for the others.
    """
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"), "text")
    exploded = rows.select("id", "mark", F.posexplode(chunks(F.col("text"))).alias("k", "chunk")).where("chunk.n_lines > 1")
    found = exploded.select("id", "mark", "k", F.xxhash64("chunk.lines").alias("hash"))
    # Only hashes move until it is known which come again.
    again = found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    places = found.join(again, "hash", "left_semi").groupBy("id", "mark").agg(F.sort_array(F.collect_set("k")).alias("ks"), F.count("*").alias("n"))
    places = places.withColumnsRenamed({"id": "p_id", "mark": "p_mark"})
    held = rows.join(places, F.col("id").eqNullSafe(F.col("p_id")) & (F.col("mark") == F.col("p_mark")))
    lines = let(chunks(F.col("text")), lambda c: F.transform("ks", lambda k: F.struct(k.alias("k"), F.get(c, k).lines.alias("lines"))))
    copies = held.select("id", "mark", F.explode(lines).alias("c")).select("id", "mark", "c.k", "c.lines")
    # Equal lines, not equal hashes, from here on. A row's own repeats meet first, then those of all rows.
    inside = copies.groupBy("lines", "id", "mark").agg(F.sort_array(F.collect_set("k")).alias("ks"), F.count("*").alias("n"))
    this = F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")
    first = inside.groupBy("lines").agg(F.sum("n").alias("total"), F.min(this).alias("owner")).where("total > 1")
    own = F.slice("ks", F.lit(2), F.greatest(F.size("ks") - 1, F.lit(0)))
    removed = F.when(F.col("id").eqNullSafe(F.col("owner.id")) & (F.col("mark") == F.col("owner.mark")), own).otherwise(F.col("ks"))
    return inside.join(first, "lines").groupBy("id", "mark").agg(
        F.max(F.expr("n div size(ks)")).alias("copies"),
        F.flatten(F.collect_list(removed)).alias("removed"),
        F.flatten(F.collect_list("ks")).alias("found"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), text (what is left), n_lines, n_removed.

    Every row is a document, also where rows share an id, have none or are equal; which of equal rows is the first is open.
    A null text stays null and has no lines; an empty one is one empty line. Where every chunk of a text is removed, it becomes empty.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    repeated = materialize(repeated_chunks(docs).withColumnsRenamed({"id": "r_id", "mark": "r_mark"}), "repeated-chunks")
    same = F.col("row.doc_id").eqNullSafe(F.col("r_id")) & (F.xxhash64("row.text") == F.col("r_mark"))
    # Rows that share id and text, and of which one alone keeps something.
    shared = (F.col("copies") > 1) & (F.size("removed") < F.size("found"))
    # One plan for every size: what comes again grows with the table.
    held = row.join(repeated.withColumn("shared", shared).hint("merge"), same, "left")
    several = materialize(repeated.where(shared), "shared-chunks")
    if several.isEmpty():
        marked = held.select("row", "removed")
    else:
        copies = row.join(several, same).withColumn("number", F.monotonically_increasing_id())
        # The numbers are written, so they hold.
        copies = materialize(copies, "numbered-copies")
        heads = copies.groupBy("r_id", "r_mark").agg(F.min("number").alias("number")).select("number", F.lit(True).alias("is_first"))
        other = copies.join(heads, "number", "left").select("row", F.when(F.col("is_first"), F.col("removed")).otherwise(F.col("found")).alias("removed"))
        marked = held.where("shared is null or not shared").select("row", "removed").unionByName(other)
    cut = let(
        chunks(F.col("row.text")),
        lambda c: let(
            F.array_except(F.sequence(F.lit(0), F.size(c) - 1), F.coalesce("removed", F.array().cast("array<int>"))),
            lambda kept: F.struct(
                F.array_join(F.transform(kept, lambda k: F.get(c, k).lines), "\n").alias("text"),
                F.aggregate(c, F.lit(0), lambda n, x: n + x.n_lines).alias("n_lines"),
                F.aggregate(kept, F.lit(0), lambda n, k: n + F.get(c, k).n_lines).alias("n_kept"),
            ),
        ),
    )
    out = marked.select("row", F.when(F.col("row.text").isNotNull(), cut).alias("c"))
    n_lines = F.coalesce("c.n_lines", F.lit(0)).cast("bigint")
    return out.select("row", "c.text", n_lines.alias("n_lines"), (n_lines - F.coalesce("c.n_kept", F.lit(0))).alias("n_removed"))
