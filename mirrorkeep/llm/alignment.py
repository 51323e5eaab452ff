"""Alignment of two tokenizers' tokens by the bytes they cover, and how often their ids go together.

Both tokenizers cut before a space or line end that follows something else than white space (a byte-level pattern on one side; on the other no
piece of the vocabulary goes on past one, which is checked). So a text is a row of segments whose alignments do not depend on each
other, and each different segment of a batch is aligned once. That is done for all of them together: their tokens are two
frames of byte offsets keyed by segment, and ``merge_asof`` finds for each token's start the token of the other side that covers it, in both
directions. The union of the two are the overlaps; those that end alike close a group, and all tokens of a group are linked.

Links of a document are kept as different id pairs with their number of occurrences. Spark counts the documents of every pair, takes the highest of
each first id, and adds them up again by document.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mirrorkeep.common import materialize
from mirrorkeep.llm.common import sliced, worker_memory
from mirrorkeep.operators.skew import lookup

MARK = "▁"
# Segments whose alignment a worker remembers, those it remembers to have seen once, segments that are encoded together, and bytes
# of text whose segments are aligned together.
REMEMBERED = 120_000
SEEN_ONCE = 400_000
TOGETHER = 400
SLICE_BYTES = 2 << 20
# The counts of pairs are broadcast up to this size.
MAX_BROADCAST_BYTES = 64 << 20
PAIR_BYTES = 24

# White space behind white space, or at an end: such texts are cut by the pattern below, such segments encoded one by one.
UNEVEN = re.compile(r"\s\s|^\s|\s\Z")
OTHER_WHITE = re.compile(r"[^\S \n]")
BOUNDARY = re.compile(r"(?<=\S)(?=[ \n])")
COLUMNS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """The characters that a byte-level vocabulary writes bytes as: printable ones stand for themselves, the others follow from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Side:
    """One vocabulary: bytes and decimal number of each id, and the ids that begin with a space or line end."""

    raw: list[bytes]

    def __post_init__(self) -> None:
        self.sizes = np.array([len(b) for b in self.raw], dtype=np.int64)
        self.begins = np.array([b[:1] in (b" ", b"\n") for b in self.raw])
        self.digits = np.array([len(str(i)) for i in range(len(self.raw))], dtype=np.int64)

    def join(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids.tolist()))


@dataclass
class Segments:
    """Aligned segments: text of the groups, numbers (n_a, n_b, n_groups, n_links) and a cut of pairs and times for each.

    A segment without tokens is one whose bytes differ.
    """

    texts: list[str]
    numbers: np.ndarray
    pairs: np.ndarray
    times: np.ndarray
    cut: np.ndarray

    @staticmethod
    def none() -> Segments:
        empty = np.empty(0, dtype=np.int64)
        return Segments([], np.empty((0, 4), dtype=np.int64), empty, empty, np.zeros(1, dtype=np.int64))

    @staticmethod
    def of(rows: list[tuple]) -> Segments:
        if not rows:
            return Segments.none()
        texts, numbers, pairs, times = (list(c) for c in zip(*rows, strict=True))
        cut = np.concatenate([[0], np.cumsum([len(p) // 8 for p in pairs])])
        return Segments(texts, np.array(numbers, dtype=np.int64), *(np.frombuffer(b"".join(x), dtype=np.int64) for x in (pairs, times)), cut)

    def row(self, i: int) -> tuple:
        part = slice(self.cut[i], self.cut[i + 1])
        return self.texts[i], tuple(self.numbers[i].tolist()), self.pairs[part].tobytes(), self.times[part].tobytes()

    def __add__(self, other: Segments) -> Segments:
        cut = np.concatenate([self.cut, other.cut[1:] + self.cut[-1]])
        joined = (np.concatenate([x, y]) for x, y in ((self.numbers, other.numbers), (self.pairs, other.pairs), (self.times, other.times)))
        return Segments(self.texts + other.texts, *joined, cut)


class Aligner:
    """Aligned segments, with a memory of those that come again."""

    def __init__(self, path_a: str, path_b: str):
        # A task has one core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.first = Tokenizer.from_file(path_a)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        vocabulary = self.first.get_vocab()
        raw = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            raw[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.a = Side(raw)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError("a piece of this vocabulary goes across a space or line end, so segments can't be encoded apart")
        self.b = Side([bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)])
        self.space = self.second.piece_to_id(MARK)
        self.decimals = [str(i) + mark for side in (self.a, self.b) for i in range(len(side.raw)) for mark in ",|;"]
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.once: set[str] = set()

    def ids_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.first.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_b(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a space or a line end. The library puts a space before each text that is not empty."""
        found = self.second.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        return [([self.space] if t == " " else ids) if t[0] == " " else ids[1:] for t, ids in zip(texts, found, strict=True)]

    def encoded(self, segments: list[str], uneven: set[str]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """A new order of the segments, the ids of both sides one after the other, and how many belong to each segment (none if bytes differ).

        Segments with one space or line end, at their beginning, are encoded many at a time.
        """
        full = [s if s.startswith((" ", "\n")) else " " + s for s in segments]
        single = [i for i, s in enumerate(segments) if s in uneven or MARK in s]
        # A group begins with a space, which is what the second library puts there.
        even = sorted(set(range(len(segments))).difference(single), key=lambda i: full[i][0] != " ")
        order: list[int] = []
        ids: tuple[list, list] = ([], [])
        sizes: tuple[list, list] = ([], [])
        for start in range(0, len(even), TOGETHER):
            group = even[start : start + TOGETHER]
            text = "".join(map(full.__getitem__, group))
            raw = text.encode()
            both = [np.array(found[0], dtype=np.int64) for found in (self.ids_a([text]), self.ids_b([text]))]
            starts = [np.flatnonzero(side.begins[i]) for side, i in zip((self.a, self.b), both, strict=True)]
            if any(len(x) != len(group) or x[0] != 0 for x in starts) or any(side.join(i) != raw for side, i in zip((self.a, self.b), both, strict=True)):
                single += group
                continue
            order += group
            for k in (0, 1):
                ids[k].append(both[k])
                sizes[k].append(np.diff(np.append(starts[k], len(both[k]))))
        texts = [full[i] for i in single]
        for text, *both in zip(texts, self.ids_a(texts), self.ids_b(texts), strict=True):
            arrays = [np.array(x, dtype=np.int64) for x in both]
            raw = text.encode()
            if any(side.join(i) != raw for side, i in zip((self.a, self.b), arrays, strict=True)):
                arrays = [np.empty(0, dtype=np.int64)] * 2
            for k in (0, 1):
                ids[k].append(arrays[k])
                sizes[k].append([len(arrays[k])])
        return order + single, [np.concatenate(x) for x in ids], [np.concatenate(x).astype(np.int64) for x in sizes]

    def aligned(self, segments: list[str], uneven: set[str]) -> tuple[Segments, list[int]]:
        """The segments aligned, in another order, and that order."""
        if not segments:
            return Segments.none(), []
        order, ids, per = self.encoded(segments, uneven)
        number = [np.repeat(np.arange(len(order)), n) for n in per]
        ends = [np.cumsum(side.sizes[i]) for side, i in zip((self.a, self.b), ids, strict=True)]
        a, b = (
            pd.DataFrame({"segment": n, "start": e - side.sizes[i], "end": e})
            for side, i, e, n in zip((self.a, self.b), ids, ends, number, strict=True)
        )
        # The token of the other side that covers each token's start, in both directions.
        over = [pd.merge_asof(x, y, on="start", by="segment", suffixes=("", "_other")) for x, y in ((a, b), (b, a))]
        alike = [o["end"].to_numpy()[(o["end"] == o["end_other"]).to_numpy()] for o in over]
        cuts = np.union1d(*alike)
        groups = [np.searchsorted(cuts, e) for e in ends]
        counts = [np.bincount(g, minlength=len(cuts)) for g in groups]
        links = np.concatenate([[0], np.cumsum(counts[0] * counts[1])])
        # Groups of a segment lie together: where its first one is.
        first = np.searchsorted(number[0][np.searchsorted(groups[0], np.arange(len(cuts)))], np.arange(len(order) + 1))
        numbers = np.column_stack([per[0], per[1], np.diff(first), np.diff(links[first])])
        pairs, times, pair_group = self.pairs(ids, groups, len(cuts))
        return Segments(self.written(ids, groups, first), numbers, pairs, times, np.searchsorted(pair_group, first)), order

    def written(self, ids: list[np.ndarray], groups: list[np.ndarray], first: np.ndarray) -> list[str]:
        """``a1,a2|b1;a3|b2,b3;`` for each segment, closed by a semicolon."""
        every, side = np.concatenate(ids), np.repeat([0, 1], [len(i) for i in ids])
        group = np.concatenate(groups)
        order = np.lexsort([side, group])
        every, side, group = every[order], side[order], group[order]
        last = np.ones(len(every), dtype=bool)
        last[:-1] = (group[1:] != group[:-1]) | (side[1:] != side[:-1])
        marks = np.where(last, np.where(side == 0, 1, 2), 0)
        text = "".join(map(self.decimals.__getitem__, (3 * (every + side * len(self.a.raw)) + marks).tolist()))
        digits = np.where(side == 0, self.a.digits[np.minimum(every, len(self.a.raw) - 1)], self.b.digits[np.minimum(every, len(self.b.raw) - 1)]) + 1
        at = np.concatenate([[0], np.cumsum(digits)])[np.searchsorted(group, first)].tolist()
        return [text[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]

    def pairs(self, ids: list[np.ndarray], groups: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the different id pairs of each group, how often each occurs, and its group, in order of groups."""
        entries = []
        for i, g, size in zip(ids, groups, (len(self.a.raw), len(self.b.raw)), strict=True):
            code, count = np.unique(g * size + i, return_counts=True)
            entries.append((code // size, code % size, count))
        (ga, ia, ca), (gb, ib, cb) = entries
        first = np.searchsorted(gb, np.arange(n + 1))
        width = np.diff(first)[ga]
        left = np.repeat(np.arange(len(ga)), width)
        within = np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width)
        right = first[ga][left] + within
        return ia[left] * len(self.b.raw) + ib[right], ca[left] * cb[right], ga[left]

    def of_segments(self, segments: list[str], counts: list[int], uneven: set[str]) -> tuple[Segments, list[int]]:
        """``aligned`` of different segments, in another order, and the place of each in it; those that come again are kept, up to a number."""
        rows = [self.known.get(s) or self.older.get(s) for s in segments]
        old = [i for i, row in enumerate(rows) if row]
        new = [i for i, row in enumerate(rows) if not row]
        fresh, order = self.aligned([segments[i] for i in new], uneven)
        found = fresh + Segments.of([rows[i] for i in old])
        again = [k for k, i in enumerate(order) if (counts[new[i]] > 1 or segments[new[i]] in self.once) and len(segments[new[i]]) < 100]
        # What is asked for again goes from the older half of the memory to the newer one.
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        self.known.update((segments[i], rows[i]) for i in old)
        self.known.update((segments[new[order[k]]], fresh.row(k)) for k in again[: REMEMBERED // 2])
        if len(self.once) + len(new) > SEEN_ONCE:
            self.once = set()
        self.once.update(segments[i] for i in new[:SEEN_ONCE])
        return found, [new[i] for i in order] + old


def segments_of(text: str) -> tuple[list[str], bool]:
    """The segments of a space and the text, each without the space it begins with where no white space follows it, and whether none has more white space."""
    if OTHER_WHITE.search(text) and UNEVEN.search(text) or any(x in text for x in ("  ", " \n", "\n ", "\n\n")) or text[0] in " \n" or text[-1] in " \n":
        return [s[1:] if s[0] == " " and not s[1:2].isspace() else s for s in BOUNDARY.split(" " + text)], False
    return text.replace("\n", " \n").split(" "), True


def slice_rows(aligner: Aligner, texts: list[str]) -> tuple[list[tuple], list[np.ndarray], list[np.ndarray]]:
    """COLUMNS, pairs and times of each text."""
    index: dict[str, int] = {}
    places: list[int] = []
    bounds, uneven = [0], set()
    for text in texts:
        found, even = segments_of(text) if text else ([], True)
        if not even:
            uneven.update(s for s in found if not s.strip() or s[0] == " " or UNEVEN.search(s[s[0] == "\n" :]))
        places += [index.setdefault(s, len(index)) for s in found]
        bounds.append(len(places))
    counts = np.bincount(np.array(places, dtype=np.int64), minlength=len(index)).tolist()
    known, order = aligner.of_segments(list(index), counts, uneven)
    position = np.empty(len(index), dtype=np.int64)
    position[order] = np.arange(len(index))
    code, ends = position[np.array(places, dtype=np.int64)], np.array(bounds, dtype=np.int64)
    lengths = np.diff(ends)
    doc = np.repeat(np.arange(len(texts)), lengths)
    # A text with a segment whose bytes differ has no tokens.
    bad = np.zeros(len(texts), dtype=bool)
    bad[doc[(known.numbers[:, 0] == 0)[code]]] = True
    stands = ~bad[doc]
    code, doc = code[stands], doc[stands]
    ends = np.concatenate([[0], np.cumsum(np.where(bad, 0, lengths))])
    totals = np.zeros((len(code) + 1, 4), dtype=np.int64)
    np.cumsum(known.numbers[code], axis=0, out=totals[1:])
    totals = np.diff(totals[ends], axis=0).tolist()
    rows, codes = [], code.tolist()
    for i, n in enumerate(totals):
        groups = "".join(map(known.texts.__getitem__, codes[ends[i] : ends[i + 1]]))[:-1]
        rows.append((*n, hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    start, spread = known.cut[code], np.diff(known.cut)[code]
    where = np.repeat(start - (np.cumsum(spread) - spread), spread) + np.arange(int(spread.sum()))
    size = len(aligner.a.raw) * len(aligner.b.raw)
    key, weight = np.repeat(doc, spread) * size + known.pairs[where], known.times[where]
    if int(weight.sum()) <= 2 * len(weight):
        key = np.sort(np.repeat(key, weight))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, dtype=np.int64)
        weight, key = np.diff(np.append(first, len(key))), key[first]
    else:
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        weight, key = np.add.reduceat(weight, first), key[first]
    cut = np.searchsorted(key // size, np.arange(1, len(texts)))
    return rows, np.split(key % size, cut), np.split(weight, cut)


def aligned_documents(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, int]:
    """doc_id, COLUMNS, pairs and times (arrays) of every row, and the number of ids of the second side: a pair is a * ids + b."""
    probe = Aligner(path_a, path_b)
    ids = len(probe.b.raw)
    small = len(probe.a.raw) * ids < 1 << 31
    pair, arrow = ("int", pa.int32()) if small else ("long", pa.int64())
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    kinds = [pa.int64()] * 4 + [pa.string()]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
        flat = np.concatenate(values) if values else np.empty(0)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(kind.to_pandas_dtype())))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_memory("aligner", lambda: Aligner(path_a, path_b))
        for batch in batches:
            for start, texts in sliced(batch.column(1), SLICE_BYTES):
                rows, pairs, times = slice_rows(aligner, [t.decode() for t in texts])
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *columns, lists(pairs, arrow), lists(times, pa.int64())], names)

    out = docs.select("doc_id", "text").mapInArrow(align, f"doc_id {doc_type}, {COLUMNS}, pairs array<{pair}>, times array<long>")
    return out, ids


def pair_counts(stored: DataFrame, ids: int) -> DataFrame:
    """pair, held (documents that hold it), best (is that the highest of its first id)."""
    counts = stored.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("held")).withColumn("a", F.expr(f"pair div {ids}"))
    counts = materialize(counts, "pair-counts")
    highest = counts.groupBy("a").agg(F.max("held").alias("highest"))
    return lookup(counts, highest, ["a"], "inner").select("pair", "held", (F.col("held") == F.col("highest")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    A space and the text are encoded by the first tokenizer, the text by the second, which puts a space before it; special strings in texts are plain
    text. A text that is null or empty, or whose tokens' bytes are not the text's on both sides, has no tokens: zeros and an empty digest. A row
    is a document: rows may repeat, and each counts. A null doc_id stays null, an empty table gives no rows, and further columns are not read.
    The alignments are written down once; pair counts are broadcast if they are small, and else joined by ``lookup``.
    """
    found, ids = aligned_documents(docs, path_a, path_b)
    stored = materialize(found.withColumn("place", F.monotonically_increasing_id()), "aligned-documents")
    counts = materialize(pair_counts(stored, ids), "pair-counts")
    links = stored.select("place", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("place", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    if counts.count() * PAIR_BYTES <= broadcast_bytes:
        weighed = links.join(F.broadcast(counts), "pair")
    else:
        weighed = lookup(links, counts, ["pair"], "inner")
    sums = weighed.groupBy("place").agg(F.sum(F.col("held") * F.col("times")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    zero = F.lit(0).cast("long")
    return stored.drop("pairs", "times").join(sums, "place", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )
