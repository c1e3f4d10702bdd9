"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window is `span` consecutive words of an item; an item with fewer words (but not none) is one window of all its
words. For a window of L words, k-grams of k = min(gram, L) words are hashed and the smallest of its L - k + 1 hashes
is the window's fingerprint. Equal windows have equal fingerprints, so the join of fingerprints misses no shared
window; every hit is then extended to the whole window and compared as text, so nothing else is reported.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, small_enough, staged

#: What stands between words: ASCII that is neither a digit nor a lower-case letter (the text is lower-cased first).
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS, -1), lambda w: w != "")


def _steps(n: Column) -> Column:
    """0 .. n-1, empty for n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def fingerprints(hashes: Column, size: Column, length: int, gram: int) -> tuple[Column, "callable"]:
    """(k-gram hashes from word hashes, function from them to the fingerprint of the window at each position)."""
    k = min(gram, length)
    grams = F.transform(_steps(size - (k - 1)), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))
    many = length - k + 1

    def minima(g: Column) -> Column:
        at = lambda i: [F.get(g, i + j) for j in range(many)]
        return F.transform(_steps(size - (length - 1)), lambda i: F.least(*at(i)) if many > 1 else at(i)[0])

    return grams, minima


def windows_at(texts: DataFrame, id_cols: list[str], length: int, gram: int) -> DataFrame:
    """texts (ids, words, hashes) with `minima`: the fingerprint of the window of `length` words at each position.

    Explode minima with an _outer generator: for the others Spark infers a filter on the array's size, and pushed below
    the projections that filter would compute each array again for every element.
    """
    n = F.size("words")
    grams, minima = fingerprints(F.col("hashes"), n, length, gram)
    return texts.withColumn("grams", grams).withColumn("minima", minima(F.col("grams"))).select(*id_cols, "words", "minima")


def contaminated(docs: DataFrame, items: DataFrame, span: int = 10, gram: int = 5, max_broadcast: int = 500_000, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, items) for each document; items is the sorted array of item ids as strings.

    n_hit counts the words inside any occurrence of any item window. Texts that are null or have no words are never
    hit and never hit others; items without words are ignored. A null item id counts as an item of its own, written
    as an empty string. Each row is answered by its own text, also rows of one doc_id or of none. Extra columns are
    ignored.

    Item windows are broadcast only when a count proves them few; beyond that, distinct fingerprints of each document
    are joined by shuffle first and only documents with a common fingerprint are extended.
    """
    item = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words_of(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    item = item.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("length", F.least(F.size("words"), F.lit(span)))
    lengths = sorted(r[0] for r in item.select("length").distinct().collect())  # no more than span values
    # a text's hash stands for the row: rows of one id are told apart, and equal rows have equal answers
    doc = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(doc_text).alias("print"), F.col(doc_text).alias("text"))
    counts = doc.select("doc_id", "print", F.coalesce(F.regexp_count(ascii_lower(F.col("text")), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    doc = doc.select("doc_id", "print", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    hits = [_hits(doc, item.where(F.col("length") == n), n, gram, max_broadcast) for n in lengths]
    if not hits:
        return counts.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    hit = staged(reduce(DataFrame.unionAll, hits), "window-hits")
    row = ["doc_id", "print"]
    covered = hit.select(*row, F.explode(F.sequence("at", F.col("at") + F.col("length") - 1)).alias("word")).distinct().groupBy(row).agg(F.count(F.lit(1)).alias("n_hit"))
    named = hit.select(*row, F.explode("items").alias("item")).distinct().groupBy(row).agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = covered.alias("c").join(named.alias("n"), _same("c", "n")).select("c.doc_id", "c.print", "n_hit", "items")
    return (
        counts.alias("c").join(found.alias("f"), _same("c", "f"), "left")
        .select("c.doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.print") == F.col(f"{b}.print"))


def _hits(doc: DataFrame, item: DataFrame, length: int, gram: int, max_broadcast: int) -> DataFrame:
    """(doc_id, print, at, length, items): where windows of `length` words of the items occur."""
    text = lambda: F.concat_ws(" ", F.slice("words", F.col("at") + 1, length))
    windows = windows_at(item, ["item"], length, gram).select("item", "words", F.posexplode_outer("minima").alias("at", "fp")).where("fp IS NOT NULL").select("item", "fp", text().alias("window"))
    windows = staged(windows.groupBy("window", "fp").agg(F.collect_set("item").alias("items")), "item-windows")
    prints = windows.select("fp").distinct()
    spread = windows_at(doc.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))), ["doc_id", "print"], length, gram)
    if small_enough(windows, max_broadcast):
        windows = F.broadcast(windows.drop("fp"))
        at = spread.select("doc_id", "print", "words", F.posexplode_outer("minima").alias("at", "fp")).join(F.broadcast(prints), "fp", "left_semi")
    else:
        # only ids and distinct fingerprints are shuffled; the few rows with a common one meet their words again
        windows = windows.drop("fp")
        some = spread.select("doc_id", "print", F.explode_outer(F.array_distinct("minima")).alias("fp")).join(prints, "fp", "left_semi")
        some = some.groupBy("doc_id", "print").agg(F.collect_set("fp").alias("fps"))
        met = spread.alias("s").join(some.alias("m"), _same("s", "m")).select("s.*", "fps")
        spots = F.filter(F.transform("minima", lambda fp, i: F.struct(i.alias("at"), fp.alias("fp"))), lambda x: F.array_contains(F.col("fps"), x["fp"]))
        at = met.select("doc_id", "print", "words", F.inline_outer(spots).alias("at", "fp"))
    return at.select("doc_id", "print", "at", text().alias("window")).join(windows, "window").select("doc_id", "print", "at", F.lit(length).alias("length"), "items")
