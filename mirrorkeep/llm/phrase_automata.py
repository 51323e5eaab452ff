"""Substring dedup by repeated-phrase automata.

A window is a run of 35 words. Its seed is the eight-word phrase in it with the smallest hash, so equal windows have
equal seeds. Only windows whose seed comes again are counted. Of each window that is found again by its hash, the first
place (by text, then position) is its home; neighbouring homes in a text are a passage. The seeds of the passages are
compiled into Aho-Corasick automata over words, one for each shard of passages, and the texts are streamed through the
automata of the shards that hold a home of theirs. From each seed that is met, the match is extended word by word
on both sides: a stretch of 35 words or more is an occurrence of its passage. Hashes only choose what to compare.

Everything works on different texts; how many copies a text has is a number that goes with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorkeep.common import materialize
from mirrorkeep.llm.common import read_all, sliced, tasks

WINDOW = 35
SEED = 8
# Texts that are streamed for one home text in a shard; a home with more is in several shards.
STREAMS = 256
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on."""
    n = len(h) - k + 1
    mixed = reduce(lambda total, i: total * FACTOR + h[i : n + i], range(1, k), h[:n].copy())
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xFF51AFD7ED558CCD)
    return mixed ^ (mixed >> np.uint64(29))


def seeds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the phrase at each place, and for each window the place of its seed (the first, if equal)."""
    phrases = run_hashes(h, SEED)
    width = WINDOW - SEED + 1
    at = np.arange(len(phrases) - width + 1) + np.lib.stride_tricks.sliding_window_view(phrases, width).argmin(axis=1)
    return phrases, at


def seed_rows(texts: DataFrame) -> DataFrame:
    """deal, mark, place, copies: where the seeds of every text are; equal texts of a batch are one row with a count.

    Rows are to be dealt by ``deal``. It is the seed, but a seed that a batch has twice or more recurs for sure: it goes on once,
    with all its copies, for others to meet, and the batch's further rows of it (copies 0) are dealt by their text, so
    that a seed found everywhere is not one task's work.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, first, counts = np.unique(batch.column(0).to_numpy(), return_index=True, return_counts=True)
            one = batch.take(pa.array(first))
            for start, some in sliced(one.column(1)):
                out: list[tuple] = []
                for i, text in enumerate(some, start):
                    words = text.split()
                    if len(words) < WINDOW:
                        continue
                    phrases, at = seeds(word_hashes(words))
                    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
                    out.append((phrases[at].view(np.int64), np.full(len(at), marks[i]), at, np.full(len(at), counts[i])))
                if out:
                    seed, mark, place, copies = (np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True))
                    _, first, group = np.unique(seed, return_index=True, return_inverse=True)
                    total = np.bincount(group, copies).astype(np.int64)[group]
                    further = np.ones(len(seed), dtype=bool)
                    further[first] = False
                    deal = np.where(further, mark, seed)
                    columns = [deal, mark, place, np.where(further, 0, total)]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["deal", "mark", "place", "copies"])

    return texts.mapInArrow(emit, "deal long, mark long, place long, copies long")


def recurring_seeds(rows: DataFrame) -> DataFrame:
    """mark, places: where a text has seeds that occur twice or more in all."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (table := read_all(batches)) is None:
            return
        copies = table["copies"].to_numpy()
        _, group = np.unique(table["deal"].to_numpy(), return_inverse=True)
        again = pa.array((np.bincount(group, copies)[group] > 1.5) | (copies == 0))
        yield from table.select(["mark", "place"]).filter(again).to_batches(max_chunksize=50_000)

    kept = rows.repartition(tasks(rows), "deal").mapInArrow(keep, "mark long, place long")
    # No more than a text has words.
    return kept.groupBy("mark").agg(F.collect_set("place").alias("places"))


def different_texts(texts: DataFrame) -> DataFrame:
    """mark, text: equal texts of a task but one left out."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = []
            for i, mark in enumerate(batch.column(0).to_pylist()):
                if mark not in seen:
                    seen.add(mark)
                    fresh.append(i)
            yield batch.take(pa.array(fresh, pa.int64()))

    return texts.mapInArrow(first, "mark long, text string")


def window_rows(candidates: DataFrame) -> DataFrame:
    """window, mark, start, copies: every window of ``candidates`` whose seed recurs."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mark, text, places, copies in zip(*(batch.column(c).to_pylist() for c in ("mark", "text", "places", "copies")), strict=True):
                h = word_hashes(text.encode().split())
                _, at = seeds(h)
                recurs = np.zeros(len(h), dtype=bool)
                recurs[places] = True
                start = np.flatnonzero(recurs[at])
                windows = run_hashes(h, WINDOW)[start].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(windows), pa.array(np.full(len(start), mark)), pa.array(start), pa.array(np.full(len(start), copies))], ["window", "mark", "start", "copies"]
                )

    return candidates.mapInArrow(emit, "window long, mark long, start long, copies long")


def homes(rows: DataFrame) -> DataFrame:
    """home, mark, start: the start of each recurring window at its home (mark is null), and which texts (mark) have a
    window at home in which text (start is null)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (table := read_all(batches)) is None:
            return
        window, mark, start, copies = (table[c].to_numpy() for c in ("window", "mark", "start", "copies"))
        order = np.lexsort([start, mark, window])
        window, mark, start, copies = window[order], mark[order], start[order], copies[order]
        first = np.concatenate([[True], window[1:] != window[:-1]])
        group = np.cumsum(first) - 1
        again = np.bincount(group, copies)[group] > 1.5
        at_home = first & again
        table = pa.table({"home": mark[at_home], "mark": pa.nulls(int(at_home.sum()), pa.int64()), "start": start[at_home]})
        yield from table.to_batches(max_chunksize=50_000)
        home = mark[first][group]
        guests = again & ~first
        pairs = np.unique(np.stack([home[guests], mark[guests]]), axis=1)
        table = pa.table({"home": pairs[0], "mark": pairs[1], "start": pa.nulls(pairs.shape[1], pa.int64())})
        yield from table.to_batches(max_chunksize=50_000)

    return rows.repartition(tasks(rows), "window").mapInArrow(find, "home long, mark long, start long")


def passages(found: DataFrame, candidates: DataFrame) -> DataFrame:
    """home, start, passage: the words of each run of neighbouring homes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for home, starts, text in zip(*(batch.column(c).to_pylist() for c in ("home", "starts", "text")), strict=True):
                words, starts = text.encode().split(), np.sort(starts)
                breaks = np.flatnonzero(np.diff(starts) > 1) + 1
                for run in np.split(starts, breaks):
                    out.append((home, int(run[0]), b" ".join(words[run[0] : run[-1] + WINDOW]).decode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["home", "start", "passage"])

    starts = found.where("mark is null").groupBy("home").agg(F.collect_list("start").alias("starts"))
    texts = candidates.select(F.col("mark").alias("home"), "text")
    return starts.join(texts, "home").select("home", "starts", "text").mapInArrow(cut, "home long, start long, passage string")


class Passages:
    """An automaton of the seeds of some passages."""

    def __init__(self, rows: list[tuple[int, int, bytes]]):
        self.rows = [(home, start, text.split()) for home, start, text in rows]
        self.ids: dict[bytes, int] = {}
        where: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for number, (_, _, words) in enumerate(self.rows):
            _, at = seeds(word_hashes(words))
            for place in sorted(set(at.tolist())):
                phrase = tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in words[place : place + SEED])
                where.setdefault(phrase, []).append((number, place))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for phrase, places in where.items():
            self.automaton.add_word(phrase, places)
        self.automaton.make_automaton()

    def occurrences(self, mark: int, words: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """Text, begin and end of the stretches of ``words`` that are in a passage, and of the passage's own."""
        done: dict[tuple[int, int], int] = {}
        stream = tuple(map(self.ids.get, words, [0] * len(words)))
        for last, places in self.automaton.iter(stream):
            at = last - SEED + 1
            for number, place in places:
                home, start, passage = self.rows[number]
                shift = at - place
                if done.get((number, shift), -1) > at or home == mark and shift == start:
                    continue
                left = common(words, passage, at, place, -1)
                right = common(words, passage, at + SEED, place + SEED, 1)
                done[number, shift] = at + SEED + right
                if left + SEED + right >= WINDOW:
                    begin, end = at - left, at + SEED + right
                    yield mark, begin, end, home
                    yield home, begin - shift + start, end - shift + start, mark


def common(a: list[bytes], b: list[bytes], i: int, j: int, way: int) -> int:
    """How many words agree from a[i] and b[j] on, or before them."""
    most = min(len(a) - i, len(b) - j) if way > 0 else min(i, j)

    def same(begin: int, end: int) -> bool:
        if way > 0:
            return a[i + begin : i + end] == b[j + begin : j + end]
        return a[i - end : i - begin] == b[j - end : j - begin]

    n, step = 0, 16
    while n < most:
        step = min(step, most - n)
        if same(n, n + step):
            n, step = n + step, 2 * step
        elif step == 1:
            break
        else:
            step //= 2
            most = min(most, n + 2 * step + 1)
    return n


def locate(passage_rows: DataFrame, routes: DataFrame, candidates: DataFrame, shards: int) -> DataFrame:
    """mark, begin, end: stretches of words of texts that occur elsewhere, found by streaming texts through automata."""
    loads = routes.groupBy("home").agg(F.ceil(F.count("*") / STREAMS).cast("int").alias("parts"))

    def shard(part: str) -> Column:
        return F.pmod(F.xxhash64("home", part), F.lit(shards)).alias("shard")

    compiled = passage_rows.join(loads, "home").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    compiled = compiled.select(shard("part"), "home", "start", "passage").distinct()
    streamed = routes.join(loads, "home").withColumn("part", F.pmod(F.xxhash64("mark"), F.col("parts")).cast("int"))
    # A text goes to a shard once, however many homes it has there.
    streamed = streamed.select(shard("part"), "mark").distinct().join(candidates.select("mark", "text"), "mark")

    def search(key, passage_table: pa.Table, text_table: pa.Table) -> pa.Table:
        rows = zip(*(passage_table[c].to_pylist() for c in ("home", "start")), (p.encode() for p in passage_table["passage"].to_pylist()), strict=True)
        held, out = Passages(list(rows)), set()
        for mark, text in zip(text_table["mark"].to_pylist(), text_table["text"].to_pylist(), strict=True):
            out.update(x[:3] for x in held.occurrences(mark, text.encode().split()))
        columns = list(zip(*sorted(out), strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("mark", "begin", "end"), columns, strict=True)})

    groups = compiled.groupBy("shard").cogroup(streamed.select("shard", "mark", "text").groupBy("shard"))
    return groups.applyInArrow(search, "mark long, begin long, end long")


def repeated_stretches(docs: DataFrame) -> DataFrame:
    """mark, text, copies, begins, ends: the different texts that have repeated windows, and which words these cover.

    ``mark`` is a hash of the text, and the stretches may overlap.
    """
    texts = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("mark"), "text")
    places = recurring_seeds(seed_rows(texts))
    counts = texts.groupBy("mark").agg(F.count("*").alias("copies"))
    candidates = different_texts(texts).join(places, "mark").dropDuplicates(["mark"]).join(counts, "mark")
    candidates = materialize(candidates.select("mark", "text", "places", "copies"), "candidate-texts")
    found = materialize(homes(window_rows(candidates)), "window-homes")
    routes = found.where("start is null").select("home", "mark").distinct()
    shards = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretches = locate(passages(found, candidates), routes, candidates, shards)
    # Every window of a text that has copies occurs elsewhere.
    whole = candidates.where("copies > 1").select("mark", F.lit(0).cast("bigint").alias("begin"), F.lit(1 << 62).alias("end"))
    lists = stretches.unionByName(whole).distinct().groupBy("mark").agg(F.collect_list(F.struct("begin", "end")).alias("s"))
    return candidates.select("mark", "text", "copies").join(lists, "mark").select("mark", "text", "copies", F.col("s.begin").alias("begins"), F.col("s.end").alias("ends"))


def without(words: list[bytes], begins: list[int], ends: list[int]) -> list[bytes]:
    """The words that no stretch covers."""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, np.minimum(begins, len(words)), 1)
    np.add.at(edge, np.minimum(ends, len(words)), -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def kept_words(docs: DataFrame) -> DataFrame:
    """mark, n_words, n_removed, kept: what is left of each different text that has repeated windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for mark, text, begins, ends in zip(*(batch.column(c).to_pylist() for c in ("mark", "text", "begins", "ends")), strict=True):
                words = text.encode().split()
                left = without(words, begins, ends)
                out.append((mark, len(words), len(words) - len(left), b" ".join(left).decode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["mark", "n_words", "n_removed", "kept"])

    stretches = repeated_stretches(docs).select("mark", "text", "begins", "ends")
    return stretches.mapInArrow(cut, "mark long, n_words long, n_removed long, kept string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row: the words that no repeated window covers.

    Words are runs without ASCII white space; the kept ones are joined by single spaces. A null text has no words.
    A row that repeats another one's text is another place of its windows; a null doc_id stays null. Further columns are not read.
    """
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in sliced(batch.column(2)):
                words = [t.split() for t in texts]
                whole = pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words])
                n = pa.array([len(w) for w in words], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, len(texts)) for c in (0, 1)), n, whole], ["doc_id", "mark", "n_words", "whole"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(digest, f"doc_id {doc_type}, mark long, n_words long, whole string")
    cut = kept_words(docs).select("mark", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
    return rows.join(cut, "mark", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("kept_sha256", "whole").alias("kept_sha256")
    )
