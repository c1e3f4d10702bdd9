"""Line dedup: drop lines whose normalised form occurs in many documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, staged


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def key_hash(key: Column) -> Column:
    """128 bits, so that a rare line does not meet a frequent one by chance."""
    return F.unhex(F.md5(key.cast("binary")))


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept, n_lines, n_dropped) for each row of docs.

    A line's key is the line stripped of ASCII white space and lower-cased (A-Z). Keys of at least min_chars
    code points that occur in at least min_docs documents (distinct ids; null counts as one id) lose all their
    lines; the other lines stay in order, joined by a newline. A null or empty text is one empty line. If all
    lines go, kept is the empty string. Repeated rows are each answered. Other columns of docs are ignored.

    Each document deals every distinct key once; counting is map-side combined, so a line that most documents
    share does not gather in one task. Texts are shuffled once, by document, to meet their frequent keys.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = F.split("text", "\n", -1)
    keys = F.array_distinct(F.filter(F.transform(lines, line_key), lambda k: F.char_length(k) >= max(min_chars, 1)))
    if min_chars <= 0:
        keys = F.array_distinct(F.transform(lines, line_key))
    pairs = rows.select("doc_id", F.explode_outer(F.transform(keys, key_hash)).alias("h")).where("h IS NOT NULL").distinct()
    pairs = staged(pairs, "line-keys")
    frequent = pairs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("h")
    drops = pairs.join(frequent, "h", "left_semi").groupBy("doc_id").agg(F.collect_set("h").alias("drops"))
    met = rows.alias("r").join(drops.alias("d"), F.col("r.doc_id").eqNullSafe(F.col("d.doc_id")), "left").select("r.doc_id", "r.text", "drops")
    kept = F.when(F.col("drops").isNull(), lines).otherwise(
        F.filter(lines, lambda x: (F.char_length(line_key(x)) < min_chars) | ~F.array_contains(F.col("drops"), key_hash(line_key(x))))
    )
    return (
        met.withColumn("lines", lines)
        .withColumn("left", kept)
        .select("doc_id", F.array_join("left", "\n").alias("kept"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("left")).cast("long").alias("n_dropped"))
    )
