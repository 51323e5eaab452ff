"""Operators that judge or count row by row: quality rules, classifier, token counts."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from llm_cases import corpus, edge_rows, frame, words

from mirrorkeep.llm import quality_model, quality_rules, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def plain_measures(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def plain_buckets(text):
    data = (text or "").encode()
    grams = (int.from_bytes(data[i : i + 4], "little") for i in range(len(data) - 3))
    return [((g * 2654435761) & 0xFFFFFFFF) >> 16 for g in grams]


@pytest.mark.parametrize("rows", [corpus(1), edge_rows()], ids=["corpus", "edges"])
def test_quality_rules(spark, rows):
    docs = frame(spark, rows, clashing=True)
    good = [r[0] for r in rows if r[0] is not None and r[0] % 3 == 0]
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(None, 1, 0), (77777, 1, 1), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.quality_rules(docs, labels, threshold=0.0).collect()
    counts = [Counter(), Counter()]
    for r in rows:
        counts[1].update(plain_buckets(r[1]))
        counts[0].update(plain_buckets(r[1]) if r[0] in good else [])
    share = [{b: np.log((c[b] + 1) / (c.total() + 65536)) for b in counts[1]} for c in counts]
    ratio = {b: round((share[0][b] - share[1][b]) * 65536) for b in counts[1]}
    want = []
    for r in rows:
        m = plain_measures(r[1])
        failed = m[0] < 10 or 100 * m[4] > 20 * m[0]
        buckets = plain_buckets(r[1])
        total = sum(ratio[b] for b in buckets)
        want.append((str(r[0]), *m, failed, not failed and total >= 0, round(total / max(len(buckets), 1) / 65536, 9)))
    have = [(str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, round(r.score, 9)) for r in got]
    assert sorted(have) == sorted(want)
    table = quality_rules.ratios(docs, quality_rules.trusted_texts(docs, labels))
    kept = quality_rules.keep_good(docs, table, 0.0)
    assert kept.schema == docs.schema
    assert Counter(str(r.doc_id) for r in kept.collect()) == Counter(w[0] for w in want if w[7])


def test_quality_rules_without_rows_or_labels(spark):
    docs, labels = frame(spark, corpus(2, 20)), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score == 0 and r.kept != r.base_failed for r in quality_rules.quality_rules(docs, labels).collect())
    assert quality_rules.quality_rules(frame(spark, []), labels).count() == 0


def test_words_that_end_a_text_make_no_windows_with_the_next_one():
    texts = [b"a b c d e", b"a b c d e", b"a b c d e a b c d e"]
    assert quality_rules.measure(texts)["n_repeat_words"].tolist() == [0, 0, 10]


def test_token_counts_equal_the_library(spark):
    rows = corpus(3) + [(100 + i, *r[1:]) for i, r in enumerate(edge_rows())]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted((str(r[0]), len((r[1] or "").encode()), n := len(library.encode(r[1] or "")), n > 4096) for r in rows)
    # Chunks of 64 characters with an overlap of 4 have to be widened again and again.
    for sizes in ({}, {"huge": 50, "chunk": 64, "overlap": 4}):
        got = token_counts.token_counts(frame(spark, rows, clashing=True), MODEL, **sizes).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.token_counts(frame(spark, []), MODEL).count() == 0


def test_words_are_counted_as_in_the_text():
    dice, counter = random.Random(5), token_counts.Counter(MODEL)
    texts = ["".join(dice.choices(["a", "the", " ", " ", "\n", "é", "日本", "▁", "<s>", "\x00", "1"], k=dice.randint(0, 40))) for _ in range(400)]
    assert counter.count(texts) == [len(counter.model.encode(t)) for t in texts]


def test_a_splice_is_a_boundary_of_both_chunks():
    dice, counter = random.Random(6), token_counts.Counter(MODEL)
    text = " ".join("".join(dice.choices("abcdeé", k=dice.randint(1, 9))) for _ in range(300))
    whole = set(counter.starts(text))
    for i, head, _, part in token_counts.chunks(text, 200, 40):
        if head:
            starts = counter.starts(part)
            place = starts[token_counts.splice_place(part, starts, 0, head)]
            assert 200 * i + place in whole and {200 * i + s for s in starts if s >= place and s < 200} <= whole


def test_plain_texts_align_in_round_one():
    """Both chunks of every boundary find the same splice, also where the boundary is a space."""
    dice, counter = random.Random(8), token_counts.Counter(MODEL)
    for size, overlap in [(32_768, 256), (1000, 64)] * 4:
        text = " ".join("".join(dice.choices("abcdeé", k=dice.randint(1, 9))) for _ in range(25_000))[:100_000]
        covered, tokens = 0, 0
        for _, head, tail, part in token_counts.chunks(text, size, overlap):
            starts = counter.starts(part)
            first = token_counts.splice_place(part, starts, 0, head) if head else 0
            last = token_counts.splice_place(part, starts, len(part) - tail, len(part)) if tail else len(starts)
            covered += (starts[last] if tail else len(part)) - (starts[first] if head else 0)
            tokens += last - first
        assert covered == len(text) and tokens == len(counter.model.encode(text))


def labelled(n):
    dice = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        w = ["".join(dice.choices("abcdefgh", k=dice.randint(2, 7))) for _ in range(dice.randint(15, 60))]
        rows.append((i, " ".join(x + "$$" * bad * dice.randint(0, 1) for x in w), "en", "src0", 0))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_classifier_on_held_out_rows(spark):
    rows, labels = labelled(400)
    docs = frame(spark, [*rows, *((1000 + i, *r[1:]) for i, r in enumerate(edge_rows()))], clashing=True)
    truth = {i: q for i, q, _ in labels}
    known = spark.createDataFrame([*labels, (None, 1, 0), (5000, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_model.classify(docs, known).collect()
    assert len(got) == len(rows) + len(edge_rows())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    unseen = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(unseen) > 50 and sum(r.predicted == truth[r.doc_id] for r in unseen) >= 0.95 * len(unseen)
    # Labels of held-out rows change nothing.
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels], known.schema)
    again = {(r.doc_id, r.score) for r in quality_model.classify(docs, flipped).collect()}
    assert again == {(r.doc_id, r.score) for r in got}


def test_classifier_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_model.classify(frame(spark, edge_rows()), none).collect()} == {0.5}
    assert quality_model.classify(frame(spark, []), none).count() == 0


def test_labelled_rows_are_bounded_whatever_repeats(spark):
    rows, labels = labelled(40)
    docs = frame(spark, rows + [(1, f"text number {i} of one id", "en", "src0", 0) for i in range(300)] + [rows[3]] * 50)
    known = spark.createDataFrame(labels + labels[:3] + [(1, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    every = quality_model.training_rows(docs, known)
    open_ids = {i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    assert every.count() == len(open_ids) + (301 * 2 - 1) * (1 in open_ids)
    assert quality_model.training_rows(docs, known, 20).count() == 20
    models = [quality_model.train(d, known) for d in (docs, docs.unionByName(docs))]
    assert np.array_equal(models[0][0], models[1][0]) and models[0][1:] == models[1][1:]


def test_dual_coordinate_descent_reaches_the_optimum():
    """The value reached is that of a dense plain solver, whose primal and dual values meet; the margins are too."""
    dice = np.random.RandomState(3)
    rows = [np.unique(np.concatenate([dice.randint(0, 40, 6), [quality_model.SIZE - 1]])) for _ in range(60)]
    good = np.array([int(0 in r or 1 in r or 2 in r) for r in rows], dtype=bool)
    weights, slope, _ = quality_model.fit(rows, good)
    margins = np.array([weights[r].sum() / np.sqrt(len(r)) for r in rows])
    assert slope > 0 and ((margins > 0) == good).mean() > 0.95
    # The same problem, dense: ratio-scaled indicators of the columns in use.
    used = np.unique(np.concatenate(rows))
    counts = [np.ones(quality_model.SIZE), np.ones(quality_model.SIZE)]
    for r, g in zip(rows, good):
        counts[int(g)][r] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[quality_model.SIZE - 1] = 1.0
    x = np.array([np.isin(used, r) * ratio[used] / np.sqrt(len(r)) for r in rows])
    y = np.where(good, 1.0, -1.0)
    cost = quality_model.COST * len(y) / 2 / np.where(good, good.sum(), (~good).sum())
    alpha, gram = np.zeros(len(y)), (x @ x.T) * np.outer(y, y)
    for _ in range(4000):
        for i in range(len(y)):
            alpha[i] = min(max(alpha[i] + (1 - gram[i] @ alpha) / gram[i, i], 0.0), cost[i])
    best = (alpha * y) @ x

    def primal(w):
        return w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()

    dual = alpha.sum() - alpha @ gram @ alpha / 2
    assert abs(primal(best) - dual) <= 1e-6 * dual
    mine = np.where(ratio[used] == 0, 0, weights[used] / np.where(ratio[used] == 0, 1, ratio[used]))
    assert abs(primal(mine) - dual) <= 1e-3 * dual and np.abs(margins - x @ best).max() < 0.05
