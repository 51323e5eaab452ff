"""Mixing sources to target weights by Pfair scheduling of blocks.

Each source's documents, in the order of a hash, are cut into blocks of equal size. Time is counted in slots, one
block each. In a round, every source that still has blocks gives as many as its weight (in its last round, those it
has left). With c of a round's h blocks, its block j (from 0) is released at slot floor(j h / c) and due by
slot ceil((j + 1) h / c); the released block that is due first goes next. Every block then runs between its release and its
deadline, which keeps each source within less than one block of its share at any time. Sources that have run out
leave their time to the others in proportion.

Rounds with the same sources look the same, and there are at most two kinds for each source that runs out, so the
timetable's size depends on the weights alone.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mirrorkeep.common import materialize
from mirrorkeep.llm.common import md5_bits

# Bytes of a block.
BLOCK_BYTES = 1 << 16
# Weight of all sources together that have none of their own.
REST_WEIGHT = 1
HASH_BITS = 60


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def streams(docs: DataFrame, weights: Mapping[str, int], rest_weight: int, pieces: int, carry: Sequence[str] | None) -> DataFrame:
    """row, stream, weight, size, order, id, tie, chunk of every row. ``chunk`` cuts a stream into ranges of its order."""
    # Kept apart from the columns worked with, whatever their names.
    kept = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    rows = docs.select(kept.alias("row"), F.struct("doc_id", "source", "text").alias("d"))
    names = sorted(weights)
    number, weight = F.lit(len(names)), F.lit(rest_weight)
    if names:
        source = F.col("d.source")
        number = F.coalesce(F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])[source], number)
        weight = F.coalesce(F.create_map(*[F.lit(x) for n in names for x in (n, weights[n])])[source], weight)
    identity = F.concat_ws("/", F.col("d.doc_id").cast("string"), F.col("d.source"))
    return rows.select(
        "row", number.alias("stream"), weight.alias("weight"),
        # A document takes up a place even if it has no text.
        (F.coalesce(F.octet_length("d.text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        md5_bits(identity, HASH_BITS).alias("order"), F.col("d.doc_id").alias("id"), F.xxhash64("d.text").alias("tie"),
    ).withColumn("chunk", F.shiftright(F.shiftright("order", HASH_BITS - 30) * pieces, 30))


def timetable(stats: DataFrame) -> DataFrame:
    """stream, place, first_round, end_round, slot, release, due, h, base: for each kind of round the slot of each block.

    ``stats`` has stream, weight and blocks, one row per stream; there are no more streams than weights.
    """
    loads = F.array_sort(F.collect_list(F.struct("stream", F.col("weight").cast("bigint").alias("w"), F.col("blocks").alias("n"))))
    one = stats.agg(loads.alias("loads"))
    changes = F.flatten(F.transform("loads", lambda s: F.array(F.floor(s.n / s.w), F.ceil(s.n / s.w))))
    starts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("bigint")), changes)))
    rounds = one.select("loads", starts.alias("starts")).select("loads", F.explode(F.transform(
        F.slice("starts", F.lit(1), F.size("starts") - 1), lambda a, i: F.struct(a.alias("a"), F.get("starts", i + 1).alias("b"))
    )).alias("r"))
    left = F.filter(
        F.transform("loads", lambda s: F.struct(s.stream.alias("stream"), F.greatest(F.lit(0), F.least(s.w, s.n - F.col("r.a") * s.w)).alias("c"))),
        lambda s: s.c > 0,
    )
    rounds = rounds.select("r.a", "r.b", left.alias("loads"))
    rounds = rounds.withColumn("h", F.aggregate("loads", F.lit(0).cast("bigint"), lambda x, s: x + s.c))
    # A few rows: two for each stream at most.
    rounds = rounds.withColumn("base", F.sum((F.col("b") - F.col("a")) * F.col("h")).over(W.orderBy("a")) - (F.col("b") - F.col("a")) * F.col("h"))

    # Written down so that the fold below reads the loads and doesn't work them out again at every step.
    rounds = materialize(rounds, "mix-rounds")

    def release(j: Column, c: Column) -> Column:
        return F.floor(j * F.col("h") / c)

    def due(j: Column, c: Column) -> Column:
        return F.ceil((j + 1) * F.col("h") / c)

    def next_slot(state: Column, t: Column) -> Column:
        open_blocks = F.transform("loads", lambda s, i: F.struct(
            due(F.get(state.done, i), s.c).alias("due"), i.alias("i"), ((F.get(state.done, i) < s.c) & (release(F.get(state.done, i), s.c) <= t)).alias("ready")
        ))
        earliest = F.array_min(F.filter(open_blocks, lambda b: b.ready))
        return let(earliest, lambda e: F.struct(
            F.transform(state.done, lambda d, i: d + F.when(i == e.i, 1).otherwise(0)).alias("done"),
            F.concat(state.slots, F.array(F.struct(t.alias("slot"), e.i.alias("i"), F.get(state.done, e.i).alias("place")))).alias("slots"),
        ))

    start = F.struct(
        F.transform("loads", lambda s: F.lit(0).cast("bigint")).alias("done"),
        F.array().cast("array<struct<slot:bigint,i:int,place:bigint>>").alias("slots"),
    )
    slots = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.col("h") - 1), start, next_slot, lambda s: s.slots)
    table = rounds.select("a", "b", "h", "base", "loads", F.explode(slots).alias("s"))
    c = F.get("loads", F.col("s.i")).c
    return table.select(
        F.get("loads", F.col("s.i")).stream.alias("stream"), "s.place", F.col("a").alias("first_round"), F.col("b").alias("end_round"),
        "s.slot", release(F.col("s.place"), c).alias("release"), due(F.col("s.place"), c).alias("due"), "h", "base",
    )


def mix(
    docs: DataFrame, weights: Mapping[str, int], rest_weight: int = REST_WEIGHT, block_bytes: int = BLOCK_BYTES, carry: Sequence[str] | None = None
) -> DataFrame:
    """row (the columns of ``docs`` to ``carry``, all if none are named), stream, block, slot, release, due, place: where each row goes in the mix.

    Sorted by slot and place, the rows are the mix; nothing is left out or repeated. Weights are positive whole
    numbers; sources without one, and null ones, share ``rest_weight`` as one stream. A block is
    ``block_bytes`` of a stream (a document belongs to the block it begins in, and counts its bytes and one more, so an
    empty or null text has a place). Repeated rows, and rows that agree in id and source, get places of their own
    in the order of a hash of their texts.
    """
    if not all(isinstance(w, int) and w > 0 for w in [*weights.values(), rest_weight]):
        raise ValueError("weights are positive whole numbers")
    pieces = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = streams(docs, weights, rest_weight, pieces, carry)
    # One row per stream and range of its order, however many documents a source has.
    totals = materialize(rows.groupBy("stream", "weight", "chunk").agg(F.sum("size").alias("size")), "mix-totals")
    before = totals.select("stream", "chunk", (F.sum("size").over(W.partitionBy("stream").orderBy("chunk")) - F.col("size")).alias("before"))
    stats = totals.groupBy("stream", "weight").agg(F.ceil(F.sum("size") / block_bytes).alias("blocks"))
    # Its size follows from the weights.
    slots = F.broadcast(timetable(stats))
    within = W.partitionBy("stream", "chunk").orderBy("order", "id", "tie").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(before, ["stream", "chunk"])
    placed = placed.withColumn("start", F.col("before") + F.col("inside"))
    placed = placed.withColumn("block", F.expr(f"start div {block_bytes}")).withColumn("at", F.col("start") % block_bytes)
    placed = placed.withColumn("round", F.expr("block div weight")).withColumn("place", F.col("block") % F.col("weight"))
    in_round = (F.col("round") >= F.col("first_round")) & (F.col("round") < F.col("end_round"))
    met = placed.alias("p").join(slots.alias("s"), (F.col("p.stream") == F.col("s.stream")) & (F.col("p.place") == F.col("s.place")) & in_round)
    begin = F.col("base") + (F.col("round") - F.col("first_round")) * F.col("h")
    times = [(begin + F.col(f"s.{c}")).alias(c) for c in ("slot", "release", "due")]
    return met.select("row", F.col("p.stream").alias("stream"), "block", *times, F.col("at").alias("place"))
