"""The registered queries of the corpus operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bytebpe, centroids, chat, decontaminate, jaccard, language, lmscore, pieces, quality, repeats, secrets, topk, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``."""

    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, len(words) AS k, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
q AS (SELECT doc_id, k, i, concat_ws(' ', word, lead(word, 1) OVER d, lead(word, 2) OVER d, lead(word, 3) OVER d, lead(word, 4) OVER d) AS gram
  FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT DISTINCT doc_id, gram FROM q WHERE i + 4 <= k OR i = 1),
n AS (SELECT w.doc_id, count(g.gram) AS n FROM w LEFT JOIN g USING (doc_id) GROUP BY w.doc_id),
m AS (SELECT doc_id, gram, count(*) OVER (PARTITION BY gram) AS c FROM g),
h AS (SELECT doc_id, gram FROM m WHERE c > 1),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM h a JOIN h b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.other) AS component_id FROM n JOIN reach r USING (doc_id) GROUP BY n.doc_id, n.n
"""


@query("op1_ngram_jaccard_join", NEAR_SQL)
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


# the contract's SQL of op1_ngram_jaccard_join has no column for the links, so they are a query of their own
@query("op1_ngram_jaccard_links", NEAR_SQL.replace(
    "SELECT n.doc_id, n.n AS n_shingles, min(r.other) AS component_id FROM",
    "SELECT n.doc_id, n.n AS n_shingles, min(r.other) AS component_id, "
    "(SELECT count(*) FROM links l WHERE l.a = n.doc_id) AS n_links FROM"))
def ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_counts(table(spark, sf_dir, "documents"))


TOP_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op4_exact_top_k_search", TOP_SQL)
def exact_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query("op8_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op6_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op9_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bytebpe.encoded_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query("op10_secret_scans")
def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(table(spark, sf_dir, "documents"))


@query("op5_benchmark_decontamination")
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


@query("op2_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades 0 (toxic), 1 (low quality), 2 (good), learned from labels of documents that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    rated = labels.filter(~language.held_out()).select("doc_id", grade.alias("grade"))
    model = quality.fit(rated, docs, "doc_id", "text", "grade", 3)
    return quality.graded(docs.select("doc_id", "text"), model).select(
        "doc_id", language.held_out().alias("held_out"), "expected_grade", "tail_prob", (F.col("tail_prob") >= 0.5).alias("keep"))


@query("op7_lm_scoring")
def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled good and not toxic."""
    target = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")
    return lmscore.cross_entropy_difference(table(spark, sf_dir, "documents"), target)


@query("op11_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def _cluster_sql(k: int = 40, rounds: int = 5) -> str:
    steps = [f"""v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS INTEGER) AS cluster, v AS c FROM v
  WHERE vec_id IS NOT NULL QUALIFY cluster < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min(ROW(d, cluster)) AS m FROM (
  SELECT rid, vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
  FROM v, c{i}) GROUP BY rid)""")
        if i < rounds:
            steps.append(f"""u{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM (
  SELECT cluster, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
    SELECT m[2] AS cluster, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY cluster, j) GROUP BY cluster),
c{i + 1} AS (SELECT cluster, coalesce(u{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN u{i} USING (cluster))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, m[2] AS cluster, m[1] AS distance, CAST(sum(m[1]) OVER (PARTITION BY m[2]) AS BIGINT) AS cluster_inertia,
  CAST(sum(m[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON m[2] = cluster"""


@query("op12_centroid_clustering", _cluster_sql())
def centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


CHAT_EXTRA = "</s>[INST] ok [/INST]"  # both turns of conversation -7, which the contract adds
CHAT_SQL = rf"""
WITH c AS (SELECT conv_id, turn, role, coalesce(role, '') AS r, coalesce(text, '') AS t FROM (
  SELECT conv_id, turn, role, text FROM conversations UNION ALL
  SELECT -7, 0, 'user', '{CHAT_EXTRA}' UNION ALL SELECT -7, 1, 'assistant', '{CHAT_EXTRA}')),
e AS (SELECT *, length(regexp_replace(r, '{chat.CONTROL}', '\1\3\\\2\4', 'g'))
  + length(regexp_replace(t, '{chat.CONTROL}', '\1\3\\\2\4', 'g')) + {len(chat.OPEN + chat.MIDDLE + chat.CLOSE)} AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op13_chat_formatting", CHAT_SQL)
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CHAT_EXTRA).alias("text"))
    return chat.digests(rows.union(extra))
