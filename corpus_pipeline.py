"""Corpus preparation in five stages; each takes (spark, docs, sf_dir) and returns the documents that stay.

Decisions are made for rows, not for ids: a row is known by a 64-bit hash of its columns, so rows of one id, or of none,
that differ in anything are judged apart, and equal rows alike (near-dedup keeps one of them). Every stage returns the
columns it was given, whatever they are called. Null, empty and blank texts are never toxic or contaminated; they are
copies of one another. An empty table passes every stage empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalfold.llm import decontam, mixing, nearcopies, tokens, toxicity
from signalfold.llm.common import small_batches, staged
from signalfold.llm.queries import table, vocabulary

#: A document of this score or more is rejected as toxic.
TOXIC = 0.3


def fresh_name(docs: DataFrame, name: str) -> str:
    """name, with underscores until docs has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a hash of each row, and the hash's column. Maps have no hash and do not tell rows apart."""
    key = fresh_name(docs, "row_key")
    parts = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    # a column's name stands for its null, so that nulls of different columns differ
    nulls = [F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c, kind in docs.dtypes if "map<" not in kind]
    return docs.withColumn(key, F.xxhash64(*parts, F.array(*nulls))), key


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; the classifier learns from the labelled documents among them."""
    model, score = toxicity.fit(docs, table(spark, sf_dir, "labels")), fresh_name(docs, "toxicity")
    with small_batches(spark, 1024):  # whole texts; Python workers keep the memory that a batch took
        return staged(toxicity.scored(docs, model, score_col=score, kept=150_000).where(F.col(score) < TOXIC).drop(score), "clean")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the smallest id (null last), of each group of near copies (5-word shingles, Jaccard similarity 0.8), found
    by SimHash and, beyond its radius, by min-hash bands."""
    rows, key = keyed(docs)
    groups = nearcopies.near_copies(rows, similarity=0.8, id_col=key).distinct().select(F.col("doc_id").alias("key"), F.col("component_id").alias("group"))
    ids = rows.select(F.col(key).alias("key"), F.col("doc_id").alias("id")).groupBy("key", "id").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct("key", "n"), F.struct(F.col("id").isNull(), "id", "key"))
    kept = staged(groups.join(ids, "key").groupBy("group").agg(best.alias("row")).select("row.*"), "kept-copies")
    single = kept.where("n = 1").select(F.col("key").alias(key))
    one = rows.join(F.broadcast(single) if kept.count() <= 1_000_000 else single, key, "left_semi")  # of 16 bytes each
    several = kept.where("n > 1")
    if not several.isEmpty():
        one = one.unionByName(rows.join(several.select(F.col("key").alias(key)), key, "left_semi").dropDuplicates([key]))
    return one.select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    rows, key = keyed(docs)
    found = decontam.contaminated(rows, table(spark, sf_dir, "benchmark"), span=10, doc_id=key)
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias(key)).distinct()
    return rows.join(hit, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each output shard in its own partition and in its drawn order."""
    rows, key = keyed(docs)
    mixed = mixing.mixed(rows, id_col=key, shard_col=fresh_name(rows, "shard"), position_col=fresh_name(rows, "position"), weights=(3.0, 1.0, 2.0), share=1.5, most=2.0)
    return mixed.select(*(F.col(f"`{c}`") for c in docs.columns))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold of each document."""
    return tokens.token_table(docs, vocabulary("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: SQL has neither XXH64 nor trained models nor this tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
