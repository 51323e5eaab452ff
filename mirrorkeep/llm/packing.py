"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

Each partition packs its own documents by best fit, largest first. Nearly full bins are final. What is left
goes up a tree: the underfull bins of several partitions meet as items, are packed by best fit again, and so
on until one group is left or merging no longer helps. A bin never comes apart, so a place in it only shifts.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mirrorkeep.common import materialize
from mirrorkeep.llm.common import sliced, worker_memory

CAPACITY = 2048
# Tokens that a bin may lack and still be final.
SLACK = 16
# Groups that meet on the next level, and items that one group may have.
FAN_IN = 8
MAX_ITEMS = 200_000
# A level that saves a smaller share of the bins is the last.
LEAST_GAIN = 0.002
# Words that a worker remembers, and new words that are encoded together.
REMEMBERED = 400_000
TOGETHER = 500

# How the tokenizer's tokens show a space, and the id that ends a document.
SPACE = "Ġ"
CLOSING = b"\0\0\0\0"
# White space, for a regular expression.
WHITE = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Marks that are parted from the word before them.
MARKS = ("\n", ".", ",")
# Texts that are not words with single spaces between them: a space at an end, or white space or a mark behind a space.
ODD = rf"^ | $| [{WHITE}.,]|<\|endoftext\|>"
# Texts whose marks stay where they are: a mark behind something else than a letter or digit, or white space beside a line end.
UNCLEAR = rf"^[.,\n]|[^\pL\pN][.,]|[{WHITE}]\n|\n[{WHITE}]|\n$"
# Bytes of text that are encoded together. A worker takes some 50 times as much, and most of that stays with it for later stages.
SLICE_BYTES = 4 << 20
PIECES = "piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of texts, with a memory of words that come again.

    The tokenizer cuts a text by a pattern before it merges. A space that follows something else and precedes something
    that is no white space always begins a part, and so do a full stop, a comma or a single line end behind a letter or
    digit. So a text is its first word and then words with a space or nothing before them. Texts with other runs of white space, or
    with the special token, go to the tokenizer as they are. New words go there many at a time: the tokens that begin with a
    space are where a word begins.
    """

    def __init__(self, path: str):
        # A task has one core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.once: set[str] = set()
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True

    def ids(self, texts: Iterable[str]) -> list[bytes]:
        many = self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in many]

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words with a space before them, but for those that begin with a mark."""
        marked = [w for w in words if w.startswith(MARKS)]
        if marked:
            ids = dict(zip(marked, self.ids(marked), strict=True))
            others = iter(self.word_ids([w for w in words if w not in ids]))
            return [ids[w] if w in ids else next(others) for w in words]
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        out: list[bytes] = []
        for group, ids in zip(groups, self.ids(" " + " ".join(g) for g in groups), strict=True):
            starts = 4 * np.flatnonzero(self.begins[np.frombuffer(ids, dtype="<u4")])
            if len(starts) == len(group):
                out += [ids[i:j] for i, j in pairwise([*starts.tolist(), len(ids)])]
            else:
                out += self.ids(" " + w for w in group)
        return out

    def remembered(self, words: list[str], counts: np.ndarray) -> list[bytes]:
        """Ids of different words; those that come again are kept, up to a number of words, and the others marked."""
        out = [self.known.get(w) for w in words]
        new = [i for i, ids in enumerate(out) if ids is None]
        found = self.word_ids([words[i] for i in new])
        again = {}
        for i, ids in zip(new, found, strict=True):
            out[i] = ids
            if counts[i] > 1 or words[i] in self.once:
                again[words[i]] = ids
        if len(self.known) + len(again) > REMEMBERED:
            self.known = {}
        if len(self.once) + len(new) > REMEMBERED:
            self.once = set()
        self.known.update(again)
        self.once.update(words[i] for i in new)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all the texts in a row, each followed by the closing id, and the texts' bounds."""
        odd = pc.match_substring_regex(texts, ODD)
        marked = texts
        for mark in MARKS:
            marked = pc.replace_substring(marked, mark, " " + mark)
        apart = pc.if_else(pc.match_substring_regex(texts, UNCLEAR), texts, marked)
        cut = pc.split_pattern(pc.if_else(odd, "", apart), " ")
        offsets, words = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
        unit, n = words.indices.to_numpy(), len(words.dictionary)
        counts = np.bincount(unit, minlength=n)
        # The first unit of a text is its first word, or all of an odd one; the last is the closing id.
        firsts = pc.if_else(odd, texts, cut.flatten().take(pa.array(offsets[:-1])))
        unit = unit.copy()
        unit[offsets[:-1]] = n + np.arange(len(texts))
        unit = np.insert(unit, offsets[1:], n + len(texts))
        ids = [*self.remembered(words.dictionary.to_pylist(), counts), *self.ids(firsts.to_pylist()), CLOSING]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        pool = np.frombuffer(b"".join(ids), dtype="<u4")
        lengths = sizes[unit]
        ends = np.cumsum(lengths)
        bounds = np.concatenate([[0], ends[offsets[1:] + np.arange(len(texts))]])
        place = np.arange(ends[-1] if len(ends) else 0)
        place += np.repeat((np.cumsum(sizes) - sizes)[unit] - ends + lengths, lengths)
        return pool[place], bounds


def pieces(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """Number, start, length and checksum of the pieces of a document; only the first of several may be shorter."""
    n = len(ids)
    first = n if n <= capacity else n % capacity or capacity
    for i, start in enumerate([0, *range(first, n, capacity)]):
        length = first if i == 0 else capacity
        yield i, start, length, zlib.crc32(ids[start : start + length])


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, largest first: bin and offset of each item, and how full each bin is.

    Equal sizes go in the order given; among bins with the same room, the latest is taken.
    """
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    filled: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if some bin has room for exactly r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        if fitting := rooms >> size:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(filled), capacity
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += size
        by_room[room - size].append(b)
        rooms |= 1 << (room - size)
    return bins, offsets, np.array(filled, dtype=np.int64)


def pack_locally(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """doc_id, the pieces, bin, bin_offset, part: the pieces of every partition in bins of its own."""
    fields = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECES}, bin long, bin_offset long, part long"
    names = ["piece", "start", "length", "ids_crc32"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder = TaskContext.get().partitionId(), worker_memory(f"encoder {path}", lambda: Encoder(path))
        ids, cut, owner, seen = [], [], [], 0
        for batch in batches:
            ids.append(batch.column(0))
            for start, texts in sliced(batch.column(1), SLICE_BYTES):
                tokens, bounds = encoder.encode(pa.array(texts, pa.binary()).cast(pa.string()))
                for i, (begin, end) in enumerate(pairwise(bounds.tolist()), seen + start):
                    found = list(pieces(tokens[begin:end], capacity))
                    cut += found
                    owner += [i] * len(found)
            seen += len(batch)
        if not cut:
            return
        columns = np.array(cut, dtype=np.int64).T
        bins, offsets, _ = best_fit(columns[2], capacity)
        doc_id = pa.chunked_array(ids).take(pa.array(owner)).combine_chunks()
        table = pa.table([doc_id, pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:]), pa.array(bins + (part << 33)), pa.array(offsets), pa.array(np.full(len(owner), part))], ["doc_id", *names, "bin", "bin_offset", "part"])
        yield from table.to_batches(max_chunksize=100_000)

    return docs.select("doc_id", "text").mapInArrow(pack, fields)


def merge(items: DataFrame, capacity: int) -> DataFrame:
    """bin, root, shift, filled, part: items of a group packed by best fit. A new bin is named by its first item."""

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("bin")
        names = table["bin"].to_numpy()
        bins, offsets, filled = best_fit(table["filled"].to_numpy(), capacity)
        root = np.zeros(len(filled), dtype=np.int64)
        root[bins[offsets == 0]] = names[offsets == 0]
        return pa.table({"bin": names, "root": root[bins], "shift": offsets, "filled": filled[bins], "part": table["part"]})

    return items.groupBy("part").applyInArrow(fit, "bin long, root long, shift long, filled long, part long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: where each piece of each row's tokens goes.

    A null text is an empty one: the document is its closing id alone. Repeated rows are packed as documents of
    their own, a null doc_id stays null, and further columns are not read. No group of items is larger than
    MAX_ITEMS: bins that can't be merged within that bound stay as they are.
    """
    placed = materialize(pack_locally(docs, path, capacity), "packed-pieces")
    bins = placed.groupBy("bin", "part").agg(F.sum("length").alias("filled"))
    items = materialize(bins.where(F.col("filled") < capacity - SLACK), "underfull-bins")
    moved = items.select("bin", F.col("bin").alias("root"), F.lit(0).cast("bigint").alias("shift"))
    while True:
        groups, n = items.agg(F.count_distinct("part"), F.count("*")).first()
        fan_in = min(FAN_IN, MAX_ITEMS * groups // max(n, 1))
        if groups < 2 or fan_in < 2:
            break
        level = materialize(merge(items.withColumn("part", F.floor(F.col("part") / fan_in)), capacity), "merged-bins")
        step = level.select(F.col("bin").alias("root"), F.col("root").alias("new_root"), F.col("shift").alias("more"))
        moved = materialize(
            moved.join(step, "root", "left").select("bin", F.coalesce("new_root", "root").alias("root"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")),
            "moved-bins",
        )
        bins = level.where("bin = root")
        items = bins.where(F.col("filled") < capacity - SLACK).select("bin", "part", "filled")
        if bins.count() > n * (1 - LEAST_GAIN):
            break
    return placed.join(moved, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("root", "bin").alias("sequence_id"), (F.col("bin_offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
