"""One registered query per operator, and the SQL each is checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorkeep.llm import (
    alignment, jaccard_join, line_dedup, mixing, packing, phrase_automata, quality_model, quality_rules, sharding, token_counts, topk_search, warc, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# Blocks per round of each source in the mix: the one large source gets a fifth, the others equal parts.
MIX_WEIGHTS = {"src0": 5, **{f"src{i}": 1 for i in range(1, 20)}}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk_search.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(rows.where(F.col("id") % 20 == 0), rows, k=20)


ORACLES["op8_topk_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op1_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, carry=("doc_id", "source"))
    return mixed.select("row.doc_id", "row.source", "block", "slot", "release", "due", "place")


EARLIEST = """list_min(list_transform(range(1, len(cs) + 1), lambda i:
    CASE WHEN done[i] < cs[i] AND done[i] * h // cs[i] <= t THEN ((done[i] + 1) * h + cs[i] - 1) // cs[i] * 1000 + i END)) % 1000"""
ORACLES["op1_weighted_mix"] = f"""
WITH RECURSIVE w(source, stream, weight) AS (
  VALUES {", ".join(f"('{name}', {i}, {MIX_WEIGHTS[name]})" for i, name in enumerate(sorted(MIX_WEIGHTS)))}
), d AS (
  SELECT doc_id, source, text, coalesce(stream, {len(MIX_WEIGHTS)}) AS stream, coalesce(weight, {mixing.REST_WEIGHT}) AS weight,
         coalesce(strlen(text), 0) + 1 AS size, left(md5(concat_ws('/', doc_id::VARCHAR, source)), 15) AS hash
  FROM documents LEFT JOIN w USING (source)
), p AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY stream ORDER BY hash, doc_id, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d
), loads AS (SELECT stream, weight, ceil(sum(size) / {mixing.BLOCK_BYTES})::BIGINT AS n FROM d GROUP BY ALL),
starts AS (SELECT 0 AS a UNION SELECT n // weight FROM loads UNION SELECT (n + weight - 1) // weight FROM loads),
rounds AS (SELECT * FROM (SELECT a, lead(a) OVER (ORDER BY a) AS b FROM starts) WHERE b IS NOT NULL),
kinds AS (
  SELECT a, b, sum(c)::BIGINT AS h, list(stream ORDER BY stream) AS ss, list(c ORDER BY stream) AS cs
  FROM (SELECT a, b, stream, least(weight, n - a * weight) AS c FROM rounds, loads) WHERE c > 0 GROUP BY a, b
), based AS (SELECT *, (sum((b - a) * h) OVER (ORDER BY a) - (b - a) * h)::BIGINT AS base FROM kinds),
edf AS (
  SELECT *, {EARLIEST} AS pick FROM (SELECT *, 0 AS t, list_transform(cs, lambda c: 0::BIGINT) AS done FROM based)
  UNION ALL
  SELECT *, {EARLIEST} AS pick
  FROM (SELECT a, b, h, ss, cs, base, t + 1 AS t, list_transform(done, lambda x, i: x + (i = pick)::BIGINT) AS done FROM edf WHERE t + 1 < h)
), slots AS (SELECT a, b, h, base, t, ss[pick] AS stream, cs[pick] AS c, done[pick] AS j FROM edf),
placed AS (SELECT *, start // {mixing.BLOCK_BYTES} AS block, start % {mixing.BLOCK_BYTES} AS place FROM p)
SELECT doc_id, source, block, base + (block // weight - a) * h + t AS slot, base + (block // weight - a) * h + j * h // c AS release,
       base + (block // weight - a) * h + ((j + 1) * h + c - 1) // c AS due, place
FROM placed JOIN slots ON placed.stream = slots.stream AND block % weight = j AND block // weight >= a AND block // weight < b
"""


@query
def op3_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select("row.doc_id", "n_bytes", "shard", "shard_bytes", "shard_rows")


ORACLES["op3_extendible_shards"] = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         right(repeat('0', 60) || bin(('0x' || left(md5(coalesce(doc_id::VARCHAR, '')), 15))::BIGINT), 60) AS hash FROM documents
), node AS (
  SELECT depth, left(hash, depth) AS shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
  FROM d, range(61) r(depth) GROUP BY ALL HAVING sum(n_bytes) <= {sharding.SHARD_BYTES} OR count(*) = 1
)
SELECT doc_id, n_bytes, shard, shard_bytes, shard_rows
FROM (SELECT d.*, node.*, row_number() OVER (PARTITION BY doc_id ORDER BY node.depth) AS nth
      FROM d JOIN node ON left(d.hash, node.depth) = node.shard) WHERE nth = 1
"""


@query
def op9_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return left.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op9_line_chunks"] = f"""
WITH line AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i, len(l) AS n
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
), hashed AS (SELECT *, ('0x' || left(md5(line), 7))::BIGINT AS h FROM line),
cut AS (
  SELECT *, ((h + 31337 * coalesce(lag(h, 1) OVER w, 0) + 271828 * coalesce(lag(h, 2) OVER w, 0)) % 2147483647) % {line_dedup.MEAN_LINES} = 0 AS is_end
  FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(is_end::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM cut
), chunk AS (SELECT doc_id, k, string_agg(line, chr(10) ORDER BY i) AS lines, count(*) AS n_lines FROM numbered GROUP BY doc_id, k),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lines ORDER BY doc_id, k) AS nth FROM chunk),
kept AS (SELECT *, n_lines > 1 AND nth > 1 AS gone FROM ranked),
result AS (
  SELECT doc_id, sum(n_lines)::BIGINT AS n_lines, coalesce(sum(n_lines) FILTER (gone), 0)::BIGINT AS n_removed,
         sha256(coalesce(string_agg(lines, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
  FROM kept GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, kept_sha256
FROM documents LEFT JOIN result USING (doc_id)
"""


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"))


@query
def op6_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_automata.remove_repeats(table(spark, sf_dir, "documents"))


ORACLES["op6_phrase_dedup"] = f"""
WITH d AS (SELECT doc_id, string_split_regex(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), ' ') AS words, text FROM documents),
w AS (SELECT doc_id, CASE WHEN text IS NULL OR words = [''] THEN [] ELSE words END AS words FROM d),
word AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
win AS (SELECT doc_id, unnest(range(greatest(len(words) - {phrase_automata.WINDOW - 1}, 0))) AS i, words FROM w),
hashed AS (SELECT doc_id, i, md5(array_to_string(words[i + 1 : i + {phrase_automata.WINDOW}], ' ')) AS h FROM win),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM hashed) WHERE n > 1),
near AS (SELECT word.doc_id, word.i, word.word, max(again.i) OVER (PARTITION BY word.doc_id ORDER BY word.i ROWS BETWEEN {phrase_automata.WINDOW - 1} PRECEDING AND CURRENT ROW) AS a
         FROM word LEFT JOIN again ON word.doc_id = again.doc_id AND word.i = again.i),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(a) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (a IS NULL) AS kept FROM near GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLES["op13_warc_round_trip"] = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
ranked AS (
  SELECT *, payload_bytes >= {warc.REVISIT_FROM} AND row_number() OVER w > 1 AS again, first_value(page_id) OVER w AS head
  FROM p WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST)
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN head END AS refers_to FROM ranked
"""
