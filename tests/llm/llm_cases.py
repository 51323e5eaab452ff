"""Small tables for the text operators, and the plain definitions they are held against."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators might use inside.
CLASHING = ["score", "row", "hash", "node", "shard", "block", "slot", "place", "mark", "bucket", "kept", "bin", "removed", "path", "size"]


def words(text):
    return WORD.findall(text or "")


def corpus(seed: int, n: int = 60) -> list[tuple]:
    """Texts with exact and near copies, shared passages, repeated lines and odd white space."""
    dice = random.Random(seed)
    vocabulary = ["".join(dice.choices("abcdeé", k=dice.randint(1, 6))) for _ in range(400)]
    passages = [" ".join(dice.choices(vocabulary, k=dice.randint(20, 60))) for _ in range(4)]
    block = "\n".join(" ".join(dice.choices(vocabulary, k=8)) for _ in range(12))
    texts: list[str] = []
    for _ in range(n):
        kind = dice.random()
        if kind < 0.15 and texts:
            text = dice.choice(texts)
        elif kind < 0.4 and texts:
            parts = dice.choice(texts).split(" ")
            for _ in range(1 + len(parts) // 40):
                parts[dice.randrange(len(parts))] = dice.choice(vocabulary)
            text = " ".join(parts)
        else:
            lines = [" ".join(dice.choices(vocabulary, k=dice.randint(1, 25))) for _ in range(dice.randint(1, 12))]
            if dice.random() < 0.5:
                lines.insert(dice.randrange(len(lines) + 1), dice.choice(passages))
            if dice.random() < 0.3:
                lines.insert(dice.randrange(len(lines) + 1), block)
            text = dice.choice(["\n", "\n", " \t", "  "]).join(lines)
            if dice.random() < 0.2:
                text = text.upper()
        texts.append(text)
    return [(i, t, "en", f"src{min(i % 7, 3)}", len(t)) for i, t in enumerate(texts)]


def edge_rows() -> list[tuple]:
    """Nulls in any column, no words, very long texts, ties and repeated rows."""
    long_text = " ".join(f"w{i % 977} x{i}" for i in range(30_000))
    rows = [
        (1, None, "en", "src0", None),
        (2, "", None, None, 0),
        (3, " \n\t ", "en", "src1", 4),
        (4, "one two", "en", "src2", 7),
        (4, "one two", "en", "src2", 7),
        (4, "other text under the same id", "en", "src2", 28),
        (None, "one two", "en", "src1", 7),
        (None, None, None, None, None),
        (5, long_text, "en", "src0", len(long_text)),
        (6, long_text + " end", "en", "src0", len(long_text) + 4),
        (7, "x" * 200_000, "en", "src0", 200_000),
        (8, "same " * 300, "en", "nowhere", 1500),
        (9, "ünï  cödé <|endoftext|> ▁mark 　 \x00 end ", "xx", "src3", 40),
    ]
    return rows + [(10 + i, "a tie of texts that are all the same line\nand one more line\nand a third one\nand so on", "en", "src0", 80) for i in range(9)]


def frame(spark, rows, clashing=False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, FIELDS).repartition(3)
    return df.withColumns({c: F.lit(c) for c in CLASHING}) if clashing else df
