"""Operators on groups of texts: phrase automata, Jaccard join, line chunks, components."""

import hashlib
import random
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from llm_cases import corpus, edge_rows, frame, words
from pyspark.sql import functions as F

from mirrorkeep.llm import common, components, jaccard_join, line_dedup, phrase_automata

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def smallest(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


def plain_groups(rows):
    sets = []
    for r in rows:
        w = words((r[1] or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i, r in enumerate(rows):
        members[find(i)].append(r[0])
    return Counter((r[0], len(s), smallest(members[find(i)])) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("rows", [corpus(11, 120), corpus(12, 120), edge_rows()], ids=["one", "two", "edges"])
def test_jaccard_groups(spark, rows):
    got = jaccard_join.similar_groups(frame(spark, rows, clashing=True)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_groups(rows)


@pytest.mark.parametrize("block, members", [(8, 1 << 19), (512, 1 << 19), (512, 700)])
def test_jaccard_in_homes_cut_into_blocks(spark, monkeypatch, block, members):
    """Copies of one text that are similar to it but mostly not to each other: only all pairs of the group tell its components."""
    monkeypatch.setattr(jaccard_join, "HOME_FROM", 4)
    monkeypatch.setattr(jaccard_join, "HOME_BLOCK", block)
    monkeypatch.setattr(jaccard_join, "HOME_MEMBERS", members)
    dice = random.Random(77)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(90)]
        texts = [" ".join(base)] * (g > 0)
        for _ in range(40):
            parts = list(base)
            for at in dice.sample(range(30, 90), dice.choice([1, 2, 3, 3, 4])):
                parts[at] = f"x{dice.randrange(10**6)}"
            texts.append(" ".join(parts))
        rows += texts
    dice.shuffle(rows)
    rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate(rows)]
    want = plain_groups(rows)
    assert 3 < len({c for _, _, c in want}) < len(rows)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(frame(spark, rows)).collect()) == want


def test_copies_without_the_largest_bucket_come_to_its_home(spark):
    buckets = {1: range(90), 2: range(10, 95), 3: range(94, 98), 4: range(200, 260), 5: [*range(255, 260), *range(300, 350)], 6: range(400, 403)}
    rows = [(bucket, node, 100 + node, node) for bucket, nodes in buckets.items() for node in nodes]
    rows += [(7, node, 50, 1) for node in range(500, 600)]
    found = jaccard_join.homes(spark.createDataFrame(rows, "bucket long, node long, n long, component long"), 4).collect()
    want = {node: (1, 95) for node in range(95)}
    # Most of bucket 3 is at home there, as most of bucket 5; buckets 6 and 7 are too small and one component.
    want |= {node: (3, 3) for node in range(95, 98)} | {node: (4, 60) for node in range(200, 260)} | {node: (5, 50) for node in range(300, 350)}
    assert len(found) == len(want) and {r.node: (r.home, r.size) for r in found} == want
    assert {r.home: r.most for r in found} == {1: 194, 3: 197, 4: 359, 5: 449}


def test_points_are_compared_some_at_a_time(monkeypatch):
    dice = np.random.RandomState(6)
    for length in (40, 300):
        base = np.repeat(dice.randint(1, 5, (5, jaccard_join.GROUPS)), length, axis=0)
        points = (base + dice.randint(0, 4, base.shape) * (dice.rand(*base.shape) < dice.rand(len(base), 1) / 3)).astype(np.uint8)
        size, bucket = points.sum(axis=1).astype(np.int64), np.repeat(np.arange(5), length)
        apart = np.arange(len(bucket))[:, None]
        want = {(a, b) for a in range(len(bucket)) for b in range(a // length * length, a // length * length + length) if a != b
                and 100 * min(size[a], size[b]) >= 75 * max(size[a], size[b])
                and jaccard_join.bound(points[[a]], points[[b]])[0] >= jaccard_join.needed(size[a], size[b])}
        asked, plain = [], jaccard_join.bound
        with monkeypatch.context() as m:
            m.setattr(jaccard_join, "COMPARED_TOGETHER", 64)
            m.setattr(jaccard_join, "SEARCHED_TOGETHER", 1000, raising=False)
            m.setattr(jaccard_join, "bound", lambda x, y: asked.append(len(x)) or plain(x, y))
            found = [set(zip(a.tolist(), b.tolist())) for a, b in jaccard_join.survivors(bucket, size, points, apart)]
        assert set().union(*found) == want and want
        assert max(asked) <= 64


def test_blocks_are_compared_by_postings():
    dice = np.random.RandomState(4)
    sets = [np.unique(dice.randint(0, 30, 45)).astype(np.uint64) for _ in range(60)]
    sizes = np.array(list(map(len, sets)))
    plain = {(i, j) for i in range(60) for j in range(i + 1, 60) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert plain and set(zip(*(x.tolist() for x in jaccard_join.linked(sets, sizes, 60)))) == plain
    assert set(zip(*(x.tolist() for x in jaccard_join.linked(sets, sizes, 25)))) == {p for p in plain if p[0] < 25}
    a, b = (np.array(x) for x in zip(*sorted(plain)))
    kept = jaccard_join.forest(a, b, 60)
    assert kept.sum() < len(a)
    few, every = ({frozenset(c) for c in parts(60, zip(x.tolist(), y.tolist()))} for x, y in ((a[kept], b[kept]), (a, b)))
    assert few == every


def parts(n, links):
    of = {i: {i} for i in range(n)}
    for x, y in links:
        if of[x] is not of[y]:
            of[x] |= of[y]
            for z in of[y]:
                of[z] = of[x]
    return of.values()


def test_jaccard_in_a_large_group_of_near_copies(spark):
    """A bucket that needs a tree, where the copies differ from each other by more than from the first."""
    dice = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for at in dice.sample(range(120), 2):
            w[at] = f"new{i}x{at}"
        rows.append((i, " ".join(w), "en", "src0", 0))
    rows += [(200 + i, " ".join(base[:60] + [f"v{i}x{j}" for j in range(60)]), "en", "src0", 0) for i in range(60)]
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(frame(spark, rows)).collect()) == plain_groups(rows)


def test_the_tree_leaves_no_pair_out():
    dice = np.random.RandomState(2)
    points = dice.poisson(3, (300, jaccard_join.GROUPS)).astype(np.uint8)
    points[100:200] = np.clip(points[0].astype(int) + dice.randint(-1, 2, (100, jaccard_join.GROUPS)), 0, 255)
    points[250] = 255
    sizes = points.sum(axis=1, dtype=np.int64)
    tree = jaccard_join.Tree(sizes, points)
    query, found = tree.near(sizes, points)
    want = set()
    for i in range(300):
        for j in range(300):
            small, large = sorted((sizes[i], sizes[j]))
            most = jaccard_join.bound(points[[i]], points[[j]])[0]
            if 100 * small >= 75 * large and most >= jaccard_join.needed(small, large):
                want.add((i, j))
    assert want <= set(zip(query.tolist(), found.tolist(), strict=True)) and len(query) < 300 * 300 / 2


def test_finer_points_bound_the_overlap():
    dice = np.random.RandomState(3)
    for _ in range(200):
        both = dice.randint(0, 1 << 62, dice.randint(1, 900)).astype(np.uint64)
        sets = [np.unique(np.concatenate([both, dice.randint(0, 1 << 62, dice.choice([1, 50, 3000])).astype(np.uint64)])) for _ in range(2)]
        points = [jaccard_join.point(m, jaccard_join.fine_groups(len(m))) for m in sets]
        shared = len(np.intersect1d(*sets))
        assert shared <= jaccard_join.fine_bound(*points) == jaccard_join.fine_bound(*points[::-1]) <= min(map(len, sets))


def test_finer_points_of_a_task_bound_the_overlap_of_any_two_rows():
    dice = np.random.RandomState(12)
    sets = [np.unique(dice.randint(0, 1 << 62, n, dtype=np.int64).astype(np.uint64)) for n in (1, 3, 90, 300, 700, 1500, 3000, 200_000)]
    sets += [np.unique(np.concatenate([m[dice.rand(len(m)) < 0.9], sets[3][:20]])) for m in sets]
    points = [jaccard_join.point(m, min(jaccard_join.fine_groups(len(m)), jaccard_join.SENT_GROUPS)) for m in sets]
    # A coordinate that is full bounds nothing.
    points[1] = bytes([jaccard_join.FULL]) + points[1][1:]
    a, b = np.divmod(np.arange(len(sets) ** 2), len(sets))
    most = jaccard_join.FinePoints(points).bound(a, b)
    for x, y, found in zip(a, b, most):
        assert found == jaccard_join.fine_bound(points[x], points[y])
        assert found >= len(np.intersect1d(sets[x], sets[y]))


def test_prefixes_of_similar_sets_meet():
    dice = np.random.RandomState(1)
    for _ in range(300):
        both = dice.randint(0, 1 << 62, dice.randint(1, 60)).astype(np.uint64)
        a = np.unique(np.concatenate([both, dice.randint(0, 1 << 62, dice.randint(0, 12)).astype(np.uint64)]))
        b = np.unique(np.concatenate([both, dice.randint(0, 1 << 62, dice.randint(0, 12)).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        frequent = np.unique(dice.choice(both, min(5, len(both))))
        if 100 * shared >= 75 * (len(a) + len(b) - shared):
            assert set(jaccard_join.prefix(a, frequent)) & set(jaccard_join.prefix(b, frequent))


def test_buckets_of_the_same_sets_are_one(spark):
    """Near copies share hundreds of first hashes: what holds the same sets is searched once."""
    held = {**{bucket: (1, 2) for bucket in range(50)}, 60: (1, 2, 3), 61: (3, 2, 1, 1), 70: (5,), 71: (5, 5), 80: (2, 3)}
    rows = [(bucket, node, 10 * node) for bucket, nodes in held.items() for node in nodes]
    got = jaccard_join.shared_buckets(spark.createDataFrame(rows, "bucket long, node long, n long").repartition(5)).collect()
    buckets = defaultdict(list)
    for r in got:
        assert r.n == 10 * r.node
        buckets[r.bucket].append(r.node)
    assert sorted(map(sorted, buckets.values())) == [[1, 2], [1, 2, 3], [2, 3]]
    none = spark.createDataFrame([(1, 1, 10), (2, 2, 20)], "bucket long, node long, n long")
    assert jaccard_join.shared_buckets(none).count() == 0


def shuffle_files(spark):
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
    return {name for name in held.split() if name.startswith("shuffle_")}


def test_staged_tables_and_their_shuffles_go(spark):
    """What the join leaves are narrow tables, that its result is read from; a staged table leaves no shuffle."""
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(root.iterdir())
    rows = corpus(3)
    out = jaccard_join.similar_groups(frame(spark, rows))
    assert {p.name.rsplit("-", 1)[0] for p in root.iterdir() if p not in before} == {"sets", "labelled-sets", "components"}
    assert out.count() == len(rows)
    scratch, files, set_before = common.Scratch(spark), shuffle_files(spark), spark.conf.get(common.FILES_GO)
    kept = scratch.keep(spark.range(1000).groupBy(F.col("id") % 100).count(), "counts")
    until = time.monotonic() + 20
    while shuffle_files(spark) - files and time.monotonic() < until:  # Spark deletes them in the background
        time.sleep(0.2)
    assert not shuffle_files(spark) - files and spark.conf.get(common.FILES_GO) == set_before
    assert kept.count() == 100
    scratch.drop("counts")
    assert not [p for p in root.iterdir() if p.name.startswith("counts")]


def test_driver_lets_go_of_ended_rounds(spark, monkeypatch):
    """What a round of components has broadcast is freed with it, not when the heap is full."""
    collected, drop = [], common.Scratch.drop

    def seen(self, *names):
        drop(self, *names)
        runtime = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        collected.append(sum(b.getCollectionCount() for b in runtime if "Old" in b.getName()))

    monkeypatch.setattr(common.Scratch, "drop", seen)
    links = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    for _ in range(2):
        assert components.components(links).where("component = 0").count() == 41
    assert len(collected) == 2 and collected[0] < collected[1]


def test_merged_components(spark):
    """Links by parts, between components of what came before, give the same as all at once."""
    dice = np.random.RandomState(5)
    links = [(int(a), int(b)) for a, b in dice.randint(0, 200, (170, 2))]
    label = spark.createDataFrame([(k, k) for k in range(200)], "node long, component long")
    for part in (links[:60], links[60:61], links[61:]):
        label = components.merged(label, spark.createDataFrame(part, "a long, b long"))
    want = {k: k for k in range(200)}
    want |= {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    got = label.collect()
    assert {r.node: r.component for r in got} == want and len(got) == 200


def test_components(spark):
    dice = random.Random(8)
    links = [(dice.randrange(300), dice.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)] + [(900, i) for i in range(901, 990)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    for node in near:
        reached, todo = {node}, [node]
        while todo:
            todo += [x for x in near[todo.pop()] - reached if not reached.add(x)]
        if len(reached) > 1:
            assert got[node] == min(reached)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_phrases(rows):
    windows = Counter()
    texts = [words(r[1]) for r in rows]
    for w in texts:
        windows.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    out = Counter()
    for r, w in zip(rows, texts, strict=True):
        gone = {j for i in range(len(w) - 34) if windows[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def repetitive(seed):
    """Texts over few words, so that phrases overlap themselves and each other."""
    dice = random.Random(seed)
    piece = " ".join(dice.choices("abc", k=70))
    texts = [" ".join(dice.choices("ab", k=dice.randint(1, 90))) for _ in range(20)]
    texts += [" ".join([piece[dice.randrange(30) * 2 :], "z", piece[: dice.randrange(40, 70) * 2]]) for _ in range(10)] + ["a " * 200, "a b " * 60, "b a " * 60]
    return [(i, t, "en", "src0", 0) for i, t in enumerate(texts)]


@pytest.mark.parametrize("rows", [corpus(21, 100), repetitive(22), edge_rows()], ids=["corpus", "repetitive", "edges"])
def test_phrases(spark, rows):
    got = phrase_automata.remove_repeats(frame(spark, rows, clashing=True)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_phrases(rows)


def test_phrases_of_a_text_with_many_copies_are_spread(spark, monkeypatch):
    monkeypatch.setattr(phrase_automata, "STREAMS", 5)
    dice = random.Random(1)
    passage = [f"p{i}" for i in range(50)]
    rows = [(i, " ".join([f"x{i}y{j}" for j in range(dice.randint(0, 30))] + passage[dice.randint(0, 10) :] + [f"e{i}"]), "en", "src0", 0) for i in range(60)]
    got = phrase_automata.remove_repeats(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_phrases(rows)


def test_common_words():
    dice = random.Random(3)
    for _ in range(2000):
        a, b = (dice.choices("ab", [9, 1], k=dice.randint(0, 80)) for _ in range(2))
        i, j = dice.randint(0, len(a)), dice.randint(0, len(b))
        ahead = next((n for n, (x, y) in enumerate(zip(a[i:], b[j:], strict=False)) if x != y), min(len(a) - i, len(b) - j))
        behind = next((n for n, (x, y) in enumerate(zip(a[:i][::-1], b[:j][::-1], strict=False)) if x != y), min(i, j))
        assert phrase_automata.common(a, b, i, j, 1) == ahead and phrase_automata.common(a, b, i, j, -1) == behind


def plain_lines(rows):
    def number(line):
        return int(hashlib.md5(line.encode()).hexdigest()[:7], 16)

    cut = []
    for r in rows:
        if r[1] is None:
            cut.append(None)
            continue
        lines, chunks, h = r[1].split("\n"), [[]], []
        for i, line in enumerate(lines):
            h.append(number(line))
            rolling = h[i] + 31337 * (h[i - 1] if i else 0) + 271828 * (h[i - 2] if i > 1 else 0)
            chunks[-1].append(line)
            if rolling % 2147483647 % line_dedup.MEAN_LINES == 0 and i < len(lines) - 1:
                chunks.append([])
        cut.append([tuple(c) for c in chunks])
    total, owner = Counter(), {}
    for r, chunks in zip(rows, cut, strict=True):
        for c in chunks or []:
            total[c] += 1
            owner[c] = smallest([owner.get(c), r[0]])
    out = Counter()
    for r, chunks in zip(rows, cut, strict=True):
        if chunks is None:
            out[r[0], None, 0, 0] += 1
            continue
        kept, seen = [], set()
        for c in chunks:
            if len(c) < 2 or total[c] < 2 or (owner[c] == r[0] and c not in seen):
                kept.append(c)
            seen.add(c)
        left = [line for c in kept for line in c]
        out[r[0], "\n".join(left), len(r[1].split("\n")), len(r[1].split("\n")) - len(left)] += 1
    return out


@pytest.mark.parametrize("rows", [corpus(31, 100), edge_rows()], ids=["corpus", "edges"])
def test_line_chunks(spark, rows):
    docs = frame(spark, rows, clashing=True)
    got = line_dedup.dedup_lines(docs)
    assert got.select("row.*").schema.names == docs.columns
    have = Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.select("row.doc_id", "text", "n_lines", "n_removed").collect())
    assert have == plain_lines(rows)


def test_line_chunks_stay_in_one_row_of_those_that_share_an_id(spark):
    block = [f"line {i} of the block" for i in range(20)]
    text = "\n".join(block)
    rows = [(i, t, "en", "src0", 0) for i in (None, 1) for t in (text, text, text + "\nand an end\nof its own")]
    # Ids of their own in the order that equal rows may come in, for the plain definition.
    marks = {t: m for t, m in spark.createDataFrame([(r[1],) for r in rows], "t string").selectExpr("t", "xxhash64(t)").collect()}
    ranked = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, marks[r[1]]))
    wanted = plain_lines([(n, *r[1:]) for n, r in enumerate(ranked)])
    got = line_dedup.dedup_lines(frame(spark, rows, clashing=True)).select("row.doc_id", "text", "n_lines", "n_removed").collect()
    have = Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got)
    assert have == Counter({k: sum(n for (i, *rest), n in wanted.items() if (ranked[i][0], *rest) == k) for k in {(ranked[i][0], *rest) for i, *rest in wanted}})
    assert sum(line in block for r in got for line in r.text.split("\n")) < 2 * len(block)


def test_one_row_of_each_group(spark):
    near = " ".join(f"w{i}" for i in range(100))
    other = " ".join(f"v{i}" for i in range(100))
    rows = [
        (1, near, "en", "src0", 0), (1, near, "en", "src0", 0), (1, near, "en", "src1", 0), (2, near + " end", "en", "src0", 0),
        (1, other, "en", "src0", 0), (None, other, "en", "src0", 0),
        (None, "no id at all here", "en", "src0", 0), (None, "no id at all here", "en", "src0", 0), (None, "no id at all here", "en", "src2", 0),
        (3, "alone with its five words", "en", "src0", 0), (4, None, "en", "src0", None), (4, "", "en", "src0", 0), (None, None, "en", "src0", None),
    ]
    docs = frame(spark, rows, clashing=True)
    out = jaccard_join.one_of_each_group(docs)
    assert out.schema.names == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got == Counter([(1, near), (1, other), (None, "no id at all here"), (3, rows[9][1]), (4, None), (4, ""), (None, None)])


def test_chunks_come_back_after_a_shift():
    dice = random.Random(2)
    lines = [f"line {dice.random()}" for _ in range(200)]
    rows = [(1, "\n".join(lines), "", "", 0), (2, "\n".join(["new first line", *lines]), "", "", 0)]
    removed = next(n for (i, _, _, n) in plain_lines(rows) if i == 2)
    assert removed > 100


def test_nothing_in_nothing_out(spark):
    none = frame(spark, [])
    assert jaccard_join.similar_groups(none).count() == 0
    assert phrase_automata.remove_repeats(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
