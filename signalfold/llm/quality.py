"""Quality rules: counts of each text, base rules on them, and an isolation forest over the rules' statistics.

Trees cut the space of the statistics at random places until a sample of good documents is parted or a depth is reached.
Cuts are drawn from the box that a node covers, not from the span of its rows, so that a statistic which is alike in all
good documents (no symbols, say) still tells those that differ. Few steps lead to where no good document is. The score is
2 ** (-mean path length / c(rows)), near 1 for anomalies. The threshold comes from the scores of all labelled rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?.,;:'\"()-"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the forest reads, each from 0 to 1: the mean length of words, as a logarithm, and square roots of shares.
STATISTICS = ("word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "marks", "digits")
#: Bins of the histogram of scores from which the threshold is taken.
BINS = 2000


def repeated_words(words: list[bytes], n: int = 3) -> int:
    """How many words lie in an n-word window that is found twice or more, overlapping ones too."""
    windows = list(zip(*(words[k:] for k in range(n)), strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    found = end = 0
    for at, window in enumerate(windows):
        if seen[window] > 1:
            found += at + n - max(at, end)
            end = at + n
    return found


def measured(text: str | None) -> tuple[list[int], list[float]]:
    """(COUNTS, STATISTICS) of a whole text; null is as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: at ASCII spaces only
    n, chars = len(words), len(text or "") - (len(data) - len(data.translate(None, SPACES)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    again = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    upper = sum(map(str.isupper, text or "")) if text and text != text.lower() else 0
    marks, digits = len(data) - len(data.translate(None, MARKS)), len(data) - len(data.translate(None, b"0123456789"))
    share = lambda x, of: math.sqrt(min(x / of, 1.0)) if of else 0.0
    length = min(math.log1p(chars / n) / math.log(64), 1.0) if n else 0.0
    return [n, chars, symbols, again, repeats], [length, share(symbols, chars), share(again, len(lines)), share(repeats, n), share(len(set(words)), n), share(upper, chars), share(marks, chars), share(digits, chars)]


def path_rest(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of a search tree over n rows: what a leaf of n rows still stands for."""
    n = np.asarray(n, float)
    some = np.maximum(n, 2)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(some - 1) + np.euler_gamma) - 2 * (some - 1) / some))


@dataclass
class Forest:
    """Trees as complete arrays of nodes: feature (-1 for a leaf), cut, and a leaf's path length. Node i has 2i+1, 2i+2."""

    feature: np.ndarray
    cut: np.ndarray
    length: np.ndarray
    whole: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1, higher the more anomalous; each row by itself, so that batches make no difference."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, length in zip(self.feature, self.cut, self.length, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(math.log2(len(feature) + 1)) - 1):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (x[rows, f] >= cut[node]))
            total += length[node]
        return 2.0 ** (-total / (len(self.feature) * self.whole)) if len(self.feature) else total


def grow(sample: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = 100, rows: int = 1024, seed: int = 7) -> Forest:
    """Trees on `rows` rows each, drawn without repetition, in the box from low to high, cut up to depth log2(rows)."""
    rng = np.random.default_rng(seed)
    rows = min(rows, len(sample))
    if rows < 2:
        none = np.zeros((0, 1))
        return Forest(none.astype(np.int64), none, none, 1.0)
    depth, wide = math.ceil(math.log2(rows)), np.flatnonzero(high > low)
    whole = (low, high)
    size = 2 ** (depth + 1) - 1
    feature, cut, length = np.full((trees, size), -1, np.int64), np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees):
        todo = [(0, 0, sample[rng.choice(len(sample), rows, replace=False)], *whole)]
        while todo:
            node, level, x, low, high = todo.pop()
            if level == depth or len(x) < 2 or not len(wide):
                length[t, node] = level + path_rest(len(x))
                continue
            f = rng.choice(wide)
            at = rng.uniform(low[f], high[f])
            feature[t, node], cut[t, node] = f, at
            right, edge = x[:, f] >= at, np.arange(len(low)) == f
            todo += [(2 * node + 1, level + 1, x[~right], low, np.where(edge, at, high)), (2 * node + 2, level + 1, x[right], np.where(edge, at, low), high)]
    return Forest(feature, cut, length, float(path_rest(rows)))


def threshold_of(histogram: dict[tuple[int, int], int], keep: float) -> float:
    """From {(label, bin of the score): rows}: the score from which rows go. Of those that keep the share `keep` of label
    1 it is the one with most of label 1 kept (three parts) and label 0 gone (one part). Without rows of both labels none
    goes."""
    good, bad = (np.array([histogram.get((label, b), 0) for b in range(BINS + 1)], float) for label in (1, 0))
    if not good.sum() or not bad.sum():
        return math.inf
    left, gone = np.cumsum(good) / good.sum(), 1 - np.cumsum(bad) / bad.sum()  # if bins up to b stay
    gain = np.where(left >= keep, 3 * left + gone, -1.0)
    return (int(np.argmax(gain)) + 1) / BINS


TABLE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, stats array<double>"


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, COUNTS, stats) of each row of docs, whole texts in one pass; null, empty and blank texts count 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [measured(t.as_py()) for t in b.column(1)]
            counts = [pa.array([f[0][k] for f in found], pa.int64()) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array([f[1] for f in found], pa.list_(pa.float64()))], ["doc_id", *COUNTS, "stats"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, TABLE)


def base_failed(least_words: int = 50, most_repeats: int = 50) -> Column:
    """Fewer than least_words words, or more than most_repeats percent of them in repeated windows."""
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))


def with_scores(rows: DataFrame, forest: Forest) -> DataFrame:
    """rows with `score`, read from their stats. The forest's size is fixed by its number of trees."""
    sent = rows.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(stats: pd.Series) -> pd.Series:
        return pd.Series(sent.value.scores(np.stack(stats.to_numpy())) if len(stats) else [], dtype="float64")

    return rows.withColumn("score", score("stats"))


def judged(docs: DataFrame, labels: DataFrame, sample_rows: int = 4096, keep: float = 0.99, least_words: int = 50, most_repeats: int = 50, trees: int = 100, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, COUNTS, base_failed, score, kept), a row for each row of docs, other columns left out.

    The forest grows on the sample_rows documents of lowest hashed id that are labelled 1 and pass the base rules, in the
    box that the statistics of all documents fill; all labelled rows that pass them give the threshold, through a histogram of BINS bins. A document labelled both 0 and 1
    counts as 0; null ids and null labels don't teach. With too few labelled rows of either kind nothing goes but what
    fails the base rules. Null, empty and blank texts have no words and fail. Repeated rows are judged each by itself and
    alike; texts of any length are read whole; an empty table gives no rows.
    """
    rows = staged(measures(docs, id_col, text_col).withColumn("base_failed", base_failed(least_words, most_repeats)), "measures")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = staged(rows.where(~F.col("base_failed")).join(known.groupBy("doc_id").agg(F.min("label").alias("label")), "doc_id"), "labelled")
    few = known.where("label = 1").orderBy(F.xxhash64(F.lit(13), "doc_id"), "doc_id", "stats").limit(sample_rows).select("stats").collect()
    ends = rows.agg(*(f(F.col("stats")[k]) for f in (F.min, F.max) for k in range(len(STATISTICS)))).first()
    low, high = np.array([x or 0.0 for x in ends]).reshape(2, len(STATISTICS))
    forest = grow(np.array([r["stats"] for r in few], float).reshape(len(few), len(STATISTICS)), low, high, trees)
    bin_ = F.floor(F.col("score") * BINS).cast("int")
    seen = with_scores(known, forest).groupBy("label", bin_.alias("bin")).count().collect()  # 2 * (BINS + 1) rows at most
    limit = threshold_of({(r["label"], r["bin"]): r["count"] for r in seen}, keep)
    found = with_scores(rows, forest).withColumn("kept", ~F.col("base_failed") & (F.col("score") < limit))
    return found.select("doc_id", *COUNTS, "base_failed", "score", "kept")
