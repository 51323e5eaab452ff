"""The registered queries against their SQL, and the pipeline stage by stage against plain Python."""

from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from llm_cases import corpus, edge_rows, frame
from test_llm_groups import plain_groups, plain_lines, plain_phrases
from test_llm_layout import plain_pieces

import __spark_entry__
from mirrorkeep.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def test_every_operator_is_registered():
    registered = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
    assert set(QUERIES) <= set(registered) and "pipeline" in registered
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    df = QUERIES[name](spark, SMALL)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(result.fetchall())


def test_phrase_and_jaccard_queries_on_whole_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = QUERIES["op6_phrase_dedup"](spark, SMALL).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_phrases(rows)
    got = QUERIES["op7_jaccard_join"](spark, SMALL).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_groups(rows)


@pytest.mark.parametrize("rows", [corpus(51, 80), edge_rows()], ids=["corpus", "edges"])
def test_pipeline_stages(spark, tmp_path, rows):
    docs = frame(spark, rows, clashing=True)
    spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def run(name, df):
        out = stages[name](spark, df, str(tmp_path))
        if name != "best-fit packing":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(path := f"{tmp_path}/{name.replace(' ', '-')}")
        return spark.read.parquet(path)

    def table(df):
        return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]

    after = run("quality rules", docs)
    assert not Counter(table(after)) - Counter(rows)
    before, after = table(after), run("line dedup", after)
    assert Counter(r[:2] for r in table(after)) == Counter({(i, t): n for (i, t, *_), n in plain_lines(before).items()})
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in table(after))
    before, after = table(after), run("near duplicates", after)
    heads = {c for (_, _, c) in plain_groups(before)}
    assert Counter(table(after)) == Counter(r for r in before if r[0] in heads)
    before, after = table(after), run("weighted mix", after)
    assert Counter(table(after)) == Counter(before)
    got = run("best-fit packing", after).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == plain_pieces(before, 2048)


def test_pipeline_runs_on_the_smallest_tables(spark):
    got = corpus_pipeline.run(spark, SMALL).collect()
    filled = Counter()
    for r in got:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and len(filled) <= 1.2 * np.ceil(sum(filled.values()) / 2048) + 1
