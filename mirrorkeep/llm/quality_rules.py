"""Quality rules: how much likelier a text is under trusted texts than under the whole corpus.

Two multinomials over hashed byte n-grams are counted, one over the trusted texts and one over
every text. The score of a text is the mean log-likelihood ratio of its n-grams. The ratios are
rounded to integers once, so that a score is a sum of integers and does not depend on the order
in which anything is added up; every text is held against the same threshold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorkeep.llm.common import sliced

# Hash buckets of the n-grams: what is collected and sent to tasks is of this size, whatever the corpus.
BUCKETS_LOG2 = 16
# A ratio of 1 (natural logarithm) as an integer.
UNIT = 1 << 16
# Mean ratio from which a text is kept.
THRESHOLD = -0.5
# Rules on the text itself.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WORDS = 5

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def gram_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the 4 bytes that start at each byte of the texts put together, and the texts' bounds.

    The last three bytes of a text start no n-gram of it; their values are meaningless.
    """
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts) + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    n = int(bounds[-1])
    grams = data[:n] | data[1 : n + 1] << 8 | data[2 : n + 2] << 16 | data[3 : n + 3] << 24
    return (grams * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS_LOG2), bounds


def count_grams(docs: DataFrame) -> DataFrame:
    """bucket, n: the n-grams of every text by bucket. Nulls and texts of under four bytes have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKETS_LOG2, dtype=np.int64)
        for batch in batches:
            for _, texts in sliced(batch.column(0)):
                buckets, bounds = gram_buckets(texts)
                inside = np.ones(len(buckets), dtype=bool)
                for back in (1, 2, 3):
                    at = bounds[1:] - back
                    inside[at[at >= bounds[:-1]]] = False
                total += np.bincount(buckets[inside], minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    parts = docs.select("text").mapInArrow(count, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def ratios(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of each bucket, trusted texts against all, in units of 1 / UNIT.

    Counts get one added, so a bucket that neither has seen counts for what the two sizes say.
    Without any trusted text, or any text, every ratio is 0 and nothing is rejected on it.
    """

    def counts(df: DataFrame) -> np.ndarray:
        # At most 2 ** BUCKETS_LOG2 rows, whatever the corpus.
        rows = count_grams(df).toPandas()
        out = np.zeros(1 << BUCKETS_LOG2, dtype=np.int64)
        out[rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
        return out

    target, raw = counts(trusted), counts(docs)
    if not target.sum() or not raw.sum():
        return np.zeros(len(raw), dtype=np.int64)
    share = [np.log((c + 1) / (c.sum() + len(c))) for c in (target, raw)]
    return np.rint((share[0] - share[1]) * UNIT).astype(np.int64)


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The plain measures of each text. Words are runs without ASCII white space."""
    words = [t.split() for t in texts]
    n_words = np.array([len(w) for w in words], dtype=np.int64)
    out = {"n_words": n_words}
    bare = [len(t.translate(None, SPACE)) for t in texts]
    follow = [len(re.sub(rb"[^\x80-\xbf]+", b"", t)) if not t.isascii() else 0 for t in texts]
    out["word_chars"] = np.array(bare, dtype=np.int64) - np.array(follow, dtype=np.int64)
    out["n_symbols"] = np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], dtype=np.int64)
    lines = ([x for x in t.split(b"\n") if x.strip()] for t in texts)
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64)
    out["n_repeat_words"] = repeated_words(words, n_words)
    return out


def repeated_words(words: list[list[bytes]], n_words: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a five-word window found twice or more in that text."""
    out = np.zeros(len(words), dtype=np.int64)
    total = int(n_words.sum())
    k = REPEAT_WORDS
    if total < k + 1:
        return out
    flat = np.empty(total, dtype=object)
    flat[:] = [w for ws in words for w in ws]
    # Numbers for words, then for pairs, fours and fives: equal numbers mean equal words, without a hash.
    one = pd.factorize(flat)[0].astype(np.int64)
    two = pd.factorize(one[:-1] * total + one[1:])[0].astype(np.int64)
    four = pd.factorize(two[:-2] * total + two[2:])[0].astype(np.int64)
    doc = np.repeat(np.arange(len(words)), n_words)
    same = doc[: total - k + 1] == doc[k - 1 :]
    start = np.flatnonzero(same)
    if not len(start):
        return out
    five = pd.factorize(four[start] * total + one[start + k - 1])[0].astype(np.int64)
    group = pd.factorize(five * len(words) + doc[start])[0]
    again = start[np.bincount(group)[group] > 1]
    edge = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + k, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(words)).astype(np.int64)


def score_texts(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the ratios of each text's n-grams, and how many it has."""
    buckets, bounds = gram_buckets(texts)
    sums = np.concatenate([[0], np.cumsum(table[buckets])])
    n = np.maximum(bounds[1:] - bounds[:-1] - 3, 0)
    return sums[bounds[:-1] + n] - sums[bounds[:-1]], n


def judge(texts: list[bytes], table: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    """The measures, base_failed, kept and score (mean ratio) of each text."""
    m = measure(texts)
    total, n = score_texts(texts, table)
    m["base_failed"] = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    m["kept"] = ~m["base_failed"] & (total >= int(round(threshold * UNIT)) * n)
    m["score"] = total / np.maximum(n, 1) / UNIT
    return m


def apply_rules(docs: DataFrame, table: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the measures, base_failed, kept and score of every row, in one scan.

    A null or empty text has no words, so it fails; its score is 0. Repeated rows give equal rows,
    a null doc_id stays null, and further columns of ``docs`` are not read.
    """
    fields = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {MEASURES}, base_failed boolean, kept boolean, score double"

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in sliced(batch.column(1)):
                m = judge(texts, table, threshold)
                columns = [batch.column(0).slice(start, len(texts)), *map(pa.array, m.values())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *m])

    return docs.select("doc_id", "text").mapInArrow(verdicts, fields)


def keep_good(docs: DataFrame, table: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is kept."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in sliced(batch.column(batch.schema.get_field_index("text"))):
                yield batch.slice(start, len(texts)).filter(pa.array(judge(texts, table, threshold)["kept"]))

    return docs.mapInArrow(keep, docs.schema)


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The texts of documents that a label calls good. Labels for unknown documents, and null ones, count for nothing.

    Labels grow with the corpus, so the join is by sorting at every size, never by sending them to all tasks.
    """
    good = labels.where("quality = 1").select("doc_id").hint("merge")
    return docs.select("doc_id", "text").join(good, "doc_id", "left_semi")


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Count both multinomials over all of ``docs``, then judge every row."""
    return apply_rules(docs, ratios(docs, trusted_texts(docs, labels)), threshold)
