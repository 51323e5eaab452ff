import pytest

from mirrorkeep.functions.naming import parse_rules
from mirrorkeep.operators import metadata, verify
from mirrorkeep.plans import sync
from mirrorkeep.sources import tree
from tests.helpers import rows


def aliases(spark, **pairs):
    return spark.createDataFrame(list(pairs.items()), "alias string, target string")


def test_alias_operations(spark):
    src = aliases(spark, a="x", b="y", c="z")
    dst = aliases(spark, a="x2", b="other", d="kept")
    rules = parse_rules("default:2")
    diff = metadata.alias_diff(src, dst, rules)
    assert rows(diff, "alias", "op", "new_target") == [
        ("a", "skip", "x2"), ("b", "repoint", "y2"), ("c", "create", "z2"),
    ]
    assert rows(metadata.alias_verify(src, dst, rules)) == [
        ("a", "ok"), ("b", "wrong target"), ("c", "missing"),
    ]
    done = sync.clone_aliases(src, dst, rules)
    assert rows(done.diagnostics, "alias", "verdict") == [("a", "ok"), ("b", "ok"), ("c", "ok")]
    assert rows(spark.read.parquet(done.path)) == [
        ("a", "x2"), ("b", "y2"), ("c", "z2"), ("d", "kept"),
    ]


def test_nothing_is_written_when_aliases_agree(spark):
    same = aliases(spark, a="x")
    done = sync.clone_aliases(same, same)
    assert done.path is None
    assert rows(done.diagnostics) == [("a", "skip", "ok")]


def test_no_destination_aliases_at_all(spark):
    empty = spark.createDataFrame([], "alias string, target string")
    assert rows(metadata.alias_diff(aliases(spark, a="x"), empty), "op") == [("create",)]


def table(spark, **data):
    return spark.createDataFrame(
        [("/" + k.replace("_", "/"), v) for k, v in data.items()], "path string, data string"
    )


def test_tree_operations(spark):
    src = table(spark, a="1", a_b="2", a_c=None, e=None)
    dst = table(spark, a="1", a_b="old", a_c="x", z="only", e=None)
    assert rows(metadata.tree_diff(src, dst)) == [
        ("/a", "same"), ("/a/b", "set"), ("/a/c", "set"), ("/e", "same"),
    ]
    done = sync.clone_tree(src, dst)
    assert {r["verdict"] for r in done.diagnostics.collect()} == {"ok"}
    assert dict(rows(spark.read.parquet(done.path))) == {
        "/a": "1", "/a/b": "2", "/a/c": None, "/e": None, "/z": "only",
    }


def test_tree_paths(spark):
    got = tree.tree_paths(table(spark, a_b_c="12345", a_b="1", d=""))
    assert rows(got) == [
        ("/a", "/", "a", 1, None),
        ("/a/b", "/a", "b", 2, 1),
        ("/a/b/c", "/a/b", "c", 3, 5),
        ("/d", "/", "d", 1, 0),
    ]


def test_paths_from_edges(spark, small_groups_hot):
    # One parent holds most of the nodes.
    edges = [(1, None, "configs"), (2, 1, "cfg"), (3, 2, "a"), (4, 3, "b"), (5, 4, "deep")]
    edges += [(i, 2, f"n{i}") for i in range(10, 60)]
    frame = spark.createDataFrame(edges, "id int, parent_id int, label string")
    got = dict(rows(tree.paths_from_edges(frame)))
    assert len(got) == 55
    assert got[5] == "/configs/cfg/a/b/deep"
    assert got[59] == "/configs/cfg/n59"


def test_a_tree_of_any_depth(spark):
    chain = [(i, i - 1 if i else None, f"d{i}") for i in range(40)]
    got = dict(rows(tree.paths_from_edges(spark.createDataFrame(chain, "id int, parent_id int, label string"))))
    assert got[39] == "".join(f"/d{i}" for i in range(40))


def test_orphans_and_cycles(spark):
    edges = [("p", 1, None, "x"), ("p", 2, 1, "k"), ("p", 3, 9, "lost"), ("p", 4, 3, "below"), ("q", 1, None, "y"), ("q", 2, 1, "k")]
    frame = spark.createDataFrame(edges, "cluster string, id int, parent_id int, label string")
    assert rows(tree.paths_from_edges(frame)) == [("p", 1, "/x"), ("p", 2, "/x/k"), ("q", 1, "/y"), ("q", 2, "/y/k")]
    assert rows(tree.orphans(frame), "cluster", "id") == [("p", 3)]
    ring = spark.createDataFrame([(1, 2, "a"), (2, 1, "b"), (3, None, "c")], "id int, parent_id int, label string")
    with pytest.raises(ValueError, match="cycle"):
        tree.paths_from_edges(ring)


def test_read_tree_of_files(spark, tmp_path):
    root = tmp_path / "configs"
    (root / "cfg" / "lang").mkdir(parents=True)
    (root / "cfg" / "schema.xml").write_bytes(b"<schema/>")
    (root / "cfg" / "lang" / "stop.txt").write_bytes(b"the\n")
    got = tree.read_tree(spark, str(root))
    assert dict(rows(got)) == {
        "/cfg/schema.xml": bytearray(b"<schema/>"), "/cfg/lang/stop.txt": bytearray(b"the\n"),
    }


def test_size_parity(spark):
    src = aliases(spark, a="x", b="y", only_src="x")
    dst = aliases(spark, a="x", b="y", only_dst="gone")
    sizes = spark.createDataFrame([("x", 3), ("y", 4)], "collection string, docs long")
    less = spark.createDataFrame([("x", 3), ("y", 1)], "collection string, docs long")
    got = verify.size_parity(src, dst, sizes, less)
    assert rows(got, "alias", "source_docs", "dest_docs", "source_exists", "match") == [
        ("a", 3, 3, True, True), ("b", 4, 1, True, False), ("only_dst", 0, 0, False, True),
    ]
    both = verify.size_parity(src, dst, sizes, less, both_sides=True)
    assert ("only_src", 3, 0) in rows(both, "alias", "source_docs", "dest_docs")


def test_smoke_test(spark):
    src = aliases(spark, a="x")
    three = spark.createDataFrame([("x", 3)], "collection string, docs long")
    two = spark.createDataFrame([("x", 2)], "collection string, docs long")
    inv = spark.createDataFrame(
        [("c1", "h", True), ("c2", "h", False), ("c3", None, None)],
        "core string, node string, available boolean",
    )
    got = verify.smoke_test(verify.size_parity(src, src, three, two), inv)
    assert rows(got) == [
        ("health", "c2", "unavailable on h"),
        ("health", "c3", "unavailable on unknown node"),
        ("size", "a", "source 3, destination 2"),
    ]
