"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, centroids, chat, compression, decontam, lmscore, mixing, quality, simhash, substring, tokens, toxicity
from .common import staged
from .lines import drop_frequent_lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.rendered(chat.repaired(table(spark, sf_dir, "conversations")))
    return rows.select("conv_id", "turn", "seq", "action", "role", F.size("inserted").alias("n_inserted"), F.size("closing").alias("n_closing"), F.sha2(F.col("chunk").cast("binary"), 256).alias("chunk_sha256"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lmscore.scores(table(spark, sf_dir, "documents"), good)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_frequent_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, u.line, u.pos FROM (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
    LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS pos) u),
k AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
bad AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.doc_id, k.line, k.pos, bad.key IS NOT NULL AS dropped FROM k LEFT JOIN bad ON k.key = bad.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""



def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(table(spark, sf_dir, "documents"), weights=(3.0, 1.0, 2.0), share=1.5, most=2.0)
    return mix.select("doc_id", "size", "source_size", "target", "taken", "copies", "places")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = substring.repeated_passages(docs, least_words=50, similarity=0.8)
    return substring.passage_classes(docs, staged(found, "repeated-passages"), least_words=50, counted=False)


def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.scored(docs.select("doc_id", "text"), model)
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def vocabulary(name: str) -> str:
    """Where the installed public tokenizer file of this name is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=10)
    joined = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


WORDS_SQL = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS_SQL} AS ws FROM benchmark),
i AS (SELECT item, ws, least(len(ws), 10) AS n FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item, n, array_to_string(ws[k:k + n - 1], ' ') AS win FROM (SELECT item, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS k FROM i)),
p AS (SELECT r, n, k, array_to_string(ws[k:k + n - 1], ' ') AS win FROM (SELECT r, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM i) WHERE len(ws) >= n)),
h AS (SELECT r, k, p.n, item FROM p JOIN w ON p.win = w.win AND p.n = w.n),
c AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS spot FROM h) GROUP BY r),
t AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compression.compressed(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"), k=16, dims=64, rounds=3, scale=64, seed=1)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), least_words=50, most_repeats=50)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


WHOLE_VECTORS_SQL = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def rounds_sql(rounds: int) -> str:
    """CTEs a1, b1, a2, ... of k-means over p (key, part, x) from b0 (part, entry, x): a has each row's least distance and
    entry as one number, b the entries after it."""
    out = []
    for r in range(1, rounds + 2):
        out.append(f"a{r} AS MATERIALIZED (SELECT key, p.part, any_value(p.x) AS x, min(CAST(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 16 + entry) AS m FROM p JOIN b{r - 1} b ON p.part = b.part GROUP BY key, p.part)")
        if r <= rounds:
            out.append(f"""s{r} AS (SELECT part, m % 16 AS entry, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM a{r}),
n{r} AS (SELECT part, entry, list(c ORDER BY i) AS x FROM (SELECT part, entry, i, CAST(floor(CAST(sum(c) AS DOUBLE) / count(*)) AS BIGINT) AS c FROM s{r} GROUP BY ALL) GROUP BY part, entry),
b{r} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.x, b.x) AS x FROM b{r - 1} b LEFT JOIN n{r} n ON b.part = n.part AND b.entry = n.entry)""")
    return ",\n".join(out)


OP11_SQL = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS key, vec_id, label,
  list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {WHOLE_VECTORS_SQL}),
p AS MATERIALIZED (SELECT key, part, v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)] AS x FROM k, range(8) t(part)),
b0 AS (SELECT part, key - 1 AS entry, x FROM p WHERE key <= 16),
{rounds_sql(6)},
c AS (SELECT key, string_agg(printf('%02x', m % 16), '' ORDER BY part) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM a7 GROUP BY key),
f AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM b6))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM k JOIN c USING (key), f
"""

OP12_SQL = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) AS key, vec_id,
  list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {WHOLE_VECTORS_SQL} AND len(embedding) = 64),
p AS MATERIALIZED (SELECT key, 0 AS part, v AS x FROM k),
b0 AS (SELECT part, key - 1 AS entry, x FROM p WHERE key <= 16),
{rounds_sql(3)},
d AS (SELECT key, CAST(m % 16 AS INTEGER) AS cluster, CAST(m // 16 AS BIGINT) AS distance FROM a4)
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(b3.x, ',')) AS centroid_sha256
FROM k JOIN d USING (key) JOIN b3 ON b3.entry = d.cluster
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_substring_dedup, op3_nearest_vectors, op4_toxicity, op5_simhash, op6_token_ids, op7_decontamination, op8_chat_formatting, op9_lm_scoring, op10_line_dedup, op11_vector_codes, op12_centroid_clusters, op13_quality_rules)
}
ORACLE: dict[str, str] = {"op7_decontamination": OP7_SQL, "op10_line_dedup": OP10_SQL, "op11_vector_codes": OP11_SQL, "op12_centroid_clusters": OP12_SQL}
