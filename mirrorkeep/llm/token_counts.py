"""Token counts of whole texts, huge ones cut into overlapping chunks that are spliced again.

No piece of the vocabulary has the mark for a space after another character (checked when the model is
loaded), and the model merges pieces only into pieces of its vocabulary. So every place where a space
follows something else is a token boundary whatever surrounds it, and the tokens on one side do not depend
on the other side: a stable boundary. This lets a count be put together from words, which come again and
again, and lets two chunks be spliced at a stable boundary that both have found in their overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorkeep.common import materialize
from mirrorkeep.llm.common import sliced

MARK = "▁"
# Characters from which a text is cut, characters of a chunk, and of the first overlap.
HUGE = 32_768
CHUNK = 32_768
OVERLAP = 256
# Words whose counts a task remembers; beyond that it starts anew.
REMEMBERED = 400_000
LIMIT = 4096


class Counter:
    """Counts of tokens, with a memory of words."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of this vocabulary goes across a space, so words can't be counted apart")
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        words = [t.split(" ") for t in texts]
        # Runs of spaces, and the mark itself, make pieces of their own: such texts are counted as they are.
        odd = [MARK in t or "" in w for t, w in zip(texts, words, strict=True)]
        plain = {x for w, o in zip(words, odd, strict=True) if not o for x in w}
        new = list(plain.difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, list(plain)
        self.known.update(zip(new, map(len, self.model.encode(new, num_threads=1)), strict=True))
        size = self.known.__getitem__
        return [len(self.model.encode(t)) if o else sum(map(size, w)) for t, w, o in zip(texts, words, odd, strict=True)]

    def starts(self, text: str) -> list[int]:
        """Where each token of a text starts."""
        return [begin for begin, _ in self.model.encode(text, return_type="offset_mapping")["offsets"]]


def chunks(text: str, size: int, overlap: int) -> Iterator[tuple[int, int, int, str]]:
    """Number, overlap with the chunk before, overlap with the one behind, and text of each chunk."""
    for i, start in enumerate(range(0, max(len(text), 1), size)):
        end = start + size
        last = end >= len(text)
        yield i, overlap if i else 0, 0 if last else min(overlap, len(text) - end), text[start : end + (0 if last else overlap)]


def splice_place(text: str, starts: list[int], begin: int, end: int) -> int | None:
    """Number of the first token behind ``begin`` and before ``end`` that starts at a stable boundary.

    The place at ``begin`` has nothing before it in the chunk on its right, so neither chunk looks at it.
    """
    return next((n for n, s in enumerate(starts) if begin < s < end and text[s] == " " and text[s - 1] != " "), None)


def count_huge(docs: DataFrame, path: str, size: int, overlap: int) -> DataFrame:
    """doc_id, mark, n_bytes, copies, n_tokens, aligned: the texts of ``docs`` counted by chunks.

    ``mark`` is a hash of the text, ``copies`` how many equal rows there were. A text is aligned if its
    chunks, each from its first splice to its last, cover it exactly.
    """
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                one = batch.slice(row, 1)
                text = one.column(2)[0].as_py()
                for i, head, tail, part in chunks(text, size, overlap):
                    columns = [one.column(0), one.column(1), *(pa.array([x]) for x in (len(text), len(text.encode()), i, head, tail)), pa.array([part])]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "n_chars", "n_bytes", "chunk", "head", "tail", "part"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            out = []
            for head, tail, part in zip(*(batch.column(c).to_pylist() for c in ("head", "tail", "part")), strict=True):
                starts = counter.starts(part)
                first = splice_place(part, starts, 0, head) if head else 0
                last = splice_place(part, starts, len(part) - tail, len(part)) if tail else len(starts)
                if first is None or last is None:
                    out.append((0, 0))
                else:
                    begin, end = starts[first] if head else 0, starts[last] if tail else len(part)
                    out.append((last - first, end - begin))
            columns = [*(batch.column(c) for c in ("doc_id", "mark", "n_chars", "n_bytes", "chunk")), *map(pa.array, zip(*out, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "n_chars", "n_bytes", "chunk", "tokens", "covered"])

    key = f"doc_id {doc_type}, mark long, n_chars long, n_bytes long, chunk long"
    parts = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(cut, f"{key}, head long, tail long, part string")
    counted = parts.repartition("mark", "chunk").mapInArrow(count, f"{key}, tokens long, covered long")
    sums = counted.groupBy("doc_id", "mark", "n_chars", "n_bytes").agg(
        F.sum("tokens").alias("tokens"), F.sum("covered").alias("covered"), F.count_if(F.col("chunk") == 0).alias("copies")
    )
    return sums.select(
        "doc_id", "mark", "n_bytes", "copies", F.expr("tokens div copies").alias("n_tokens"),
        (F.col("covered") == F.col("n_chars") * F.col("copies")).alias("aligned"),
    )


def token_counts(docs: DataFrame, path: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; a null text counts as empty.

    Texts of up to ``huge`` characters are counted whole where they are read. Longer ones are cut, their chunks
    dealt out over all tasks, counted and spliced; where an overlap has no stable boundary, the text is cut again
    with an overlap eight times as wide, until it has one or is one chunk. Repeated rows give equal rows, a null
    doc_id stays null, and further columns are not read.
    """
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {doc_type}, n_bytes long, n_tokens long"
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            for start, texts in sliced(batch.column(1)):
                sizes = pa.array([len(t) for t in texts], pa.int64())
                n = pa.array(counter.count([t.decode() for t in texts]), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), sizes, n], ["doc_id", "n_bytes", "n_tokens"])

    out = rows.where(F.length("text") <= huge).mapInArrow(whole, fields)
    left, size = rows.where(F.length("text") > huge), chunk
    while True:
        counted = materialize(count_huge(left, path, size, overlap), "token-counts")
        done = counted.where("aligned").select("doc_id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        out = out.unionByName(done.drop("copy"))
        failed = counted.where("not aligned").select(F.col("doc_id").alias("f_id"), F.col("mark").alias("f_mark"))
        if failed.isEmpty():
            break
        same = F.col("f_id").eqNullSafe(F.col("doc_id")) & (F.col("f_mark") == F.xxhash64("text"))
        left = left.join(failed, same, "left_semi")
        overlap, size = overlap * 8, max(size, overlap * 8)
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
