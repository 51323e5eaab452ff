"""Sharding by extendible hashing: shards are hash prefixes, and only an oversized one splits on another bit.

A shard is a string of bits, the prefix of the hashes of its rows; the directory lists all shards. Sizes are
summed once per fine prefix and rolled up, and a row's shard is its shortest prefix that fits the byte limit,
which is where splitting bit by bit ends. Prefixes that are still too large at the finest level are summed again,
finer. The hash is the one of the id; where all its bits are used up, rows share an id, and the bits go on with a
hash of the text, and for equal texts with one of a number given to each row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorkeep.common import materialize
from mirrorkeep.llm.common import md5_bits

HASH_BITS = 60
SHARD_BYTES = 1 << 20
# Bits beyond those that equal shards would need, and bits of a further round.
SPARE_BITS = 3
MORE_BITS = 4


def text_hash(col: Column) -> Column:
    return md5_bits(F.coalesce(col.cast("string"), F.lit("")), HASH_BITS)


def bits(prefix: Column, depth: Column) -> Column:
    """A prefix as a string of bits; depth 0 is the empty string."""
    return F.when(depth > 0, F.lpad(F.bin(prefix), depth.cast("int"), "0")).otherwise("")


def prefix_of(col: str, depth: int) -> Column:
    return F.shiftright(col, HASH_BITS - depth) if depth < HASH_BITS else F.col(col)


def fitting(cells: DataFrame, above: int, depth: int, limit: int) -> DataFrame:
    """path, cell, shard, shard_bytes, shard_rows: for each cell (prefix of ``depth`` bits) its shortest prefix of
    more than ``above`` bits that fits. A prefix fits within the limit, or with a single row."""
    levels = cells.withColumn("at", F.explode(F.sequence(F.lit(above + 1), F.lit(depth)))).withColumn(
        "prefix", F.expr(f"shiftright(cell, {depth} - at)")
    )
    sizes = levels.groupBy("path", "at", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
    fits = sizes.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
    shortest = levels.select("path", "cell", "at", "prefix").join(fits, ["path", "at", "prefix"]).groupBy("path", "cell")
    first = shortest.agg(F.min(F.struct("at", "prefix", "shard_bytes", "shard_rows")).alias("f"))
    shard_id = F.concat("path", bits(F.col("f.prefix"), F.col("f.at")))
    return first.select("path", "cell", shard_id.alias("shard"), "f.shard_bytes", "f.shard_rows")


def split(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows (row, path, size, hash) with their shard, and those that no prefix of the hash tells apart, if any.

    ``path`` is what a shard's name begins with; rows of different paths are never in one shard.
    """
    largest = rows.groupBy("path").agg(F.sum("size").alias("bytes")).agg(F.max("bytes")).first()[0] or 0
    above = -1
    depth = min(HASH_BITS, max(0, math.ceil(math.log2(max(largest, 1) / limit))) + SPARE_BITS)
    placed = None
    while True:
        rows = rows.withColumn("cell", prefix_of("hash", depth))
        cells = rows.groupBy("path", "cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        cells = materialize(cells, "shard-cells")
        shards = materialize(fitting(cells, above, depth, limit), "shards")
        done = rows.join(shards, ["path", "cell"]).select("row", F.col("size").alias("n_bytes"), "shard", "shard_bytes", "shard_rows")
        placed = done if placed is None else placed.unionByName(done)
        large = cells.where((F.col("bytes") > limit) & (F.col("rows") > 1))
        if large.isEmpty():
            return placed, None
        rows = rows.join(large.select("path", "cell"), ["path", "cell"], "left_semi").drop("cell")
        if depth == HASH_BITS:
            return placed, rows
        above, depth = depth, min(HASH_BITS, depth + MORE_BITS)


def shard(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """row (all columns of ``docs``), n_bytes, shard, shard_bytes, shard_rows.

    A null or empty text has no bytes; null ids share the hash of the empty text. Rows of one id stay together as
    long as they fit, and equal rows are parted only where they exceed the limit by themselves; a shard is over the
    limit only if it is a single row. An empty table has no shard. A shard's name is its bits; where a hash is used
    up, "-" and the bits of the next one follow.
    """
    # Row, id and text stay apart from any column names of docs.
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    size = F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("bigint")
    rows = row.select("row", F.lit("").alias("path"), size.alias("size"), text_hash(F.col("row.doc_id")).alias("hash"))
    out, rest = split(rows, limit)
    for by_text in (True, False):
        if rest is None:
            return out
        used = F.concat("path", bits(F.col("hash"), F.lit(HASH_BITS)), F.lit("-"))
        # Equal rows get numbers that are written down, so that every later reading has the same ones.
        further = text_hash(F.col("row.text") if by_text else F.monotonically_increasing_id())
        rest = materialize(rest.select("row", used.alias("path"), "size", further.alias("hash")), "same-hash")
        more, rest = split(rest, limit)
        out = out.unionByName(more)
    return out


def directory(shards: DataFrame) -> DataFrame:
    """shard, shard_bytes, shard_rows, depth: one row for each shard that shard() has named."""
    return shards.select("shard", "shard_bytes", "shard_rows", F.length(F.replace("shard", F.lit("-"))).alias("depth")).distinct()
