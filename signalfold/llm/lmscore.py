"""LM scoring by cross-entropy difference.

Two bigram models share one vocabulary: the target model counts the documents of a target set, the background model
all documents, its counts scaled to the target's total, so that smoothing weighs alike. Both smooth towards their
unigrams: p(w|v) = (c(v,w) + mu p(w)) / (c(v) + mu). A document's score is the mean over its words of background loss
less target loss, in nats: above 0, it looks more like the target.

All words and all bigrams of all documents count, known by 56-bit hashes (of 10^12 different ones each meets another
with a chance of 10^-5). Documents are read in batches of about `batch_words` words. A batch counts its distinct words
and bigrams and asks for the corpus' counts of just these: it deals its keys, sorted, to ranges of the key space, a
range adds up what all batches say of its keys and answers each batch in the order of its keys. The batch, made again
from the same documents, then scores them from the answers. So each distinct key of a batch travels once each way, no
row pairs documents with parts of the table, and a frequent word is one key of each batch wherever it stands. Only
totals come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, from_planes, planes, small_enough, staged

START = np.uint64(0x8CB92BA72F3D8DD7)
ONE = np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (v ^ (v >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A batch's rows. KEYS: its keys of one range (as differences) and how often each occurs (a: in all, b: in target
#: documents, and of words as a document's last, c: in all, d: in target documents); the first of them also has the
#: batch's totals (words and documents with words; all, target). TEXTS: its words' keys, its documents' ids (a), which
#: of these are null (b), numbers of words (c) and at each place the number of the word (d).
KEYS, TEXTS = 0, 1
COLS = ["kind", "batch", "range", "n", "keys", "a", "b", "c", "d", "totals"]
SCHEMA = "kind int, batch long, range int, n int, keys binary, a binary, b binary, c binary, d binary, totals array<long>"
KEY_BITS = 56


def _record(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], COLS)


def word_keys(text: str | None) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) >> np.uint64(64 - KEY_BITS) | ONE


def steps(keys: np.ndarray, base: int) -> bytes:
    """Sorted keys as differences."""
    return planes(np.diff(keys.view(np.int64), prepend=np.int64(base)))


def from_steps(data: bytes, n: int, base: int) -> np.ndarray:
    return (np.cumsum(from_planes(data, n)) + base).view(np.uint64)


class Batch:
    """Distinct words and bigrams of the words w of documents with these numbers of words. Words have odd keys, bigrams even ones."""

    def __init__(self, words: np.ndarray, word_at: np.ndarray, sizes: np.ndarray):
        self.words, self.word_at, self.sizes = words, word_at, sizes
        self.full = np.flatnonzero(sizes)
        self.stops = np.cumsum(sizes)[self.full]
        w = words[word_at]
        before = np.empty_like(w)
        before[1:] = w[:-1]
        before[self.stops - sizes[self.full]] = START
        self.pairs, self.first, self.pair_at = np.unique(_pair(before, w) >> np.uint64(64 - KEY_BITS) & ~ONE, return_index=True, return_inverse=True)
        self.final = np.zeros(len(w), bool)
        self.final[self.stops - 1] = True
        keys = np.concatenate([words, self.pairs])
        order = np.argsort(keys)
        self.keys = keys[order]
        self.place = np.empty(len(keys), np.int64)  # of a word's or, after them, a bigram's key
        self.place[order] = np.arange(len(keys))

    def counts(self, target: np.ndarray) -> list[np.ndarray]:
        n, m = len(self.words), len(self.pairs)
        weight = np.repeat(target, self.sizes).astype(np.float64)

        def count(at: np.ndarray, size: int, weights=None) -> np.ndarray:
            return np.bincount(at, weights, size).astype(np.int64)

        none, last = np.zeros(m, np.int64), self.word_at[self.final]
        found = [
            [count(self.word_at, n), count(self.pair_at, m)],
            [count(self.word_at, n, weight), count(self.pair_at, m, weight)],
            [count(last, n), none],
            [count(last, n, weight[self.final]), none],
        ]
        out = []
        for parts in found:
            x = np.empty(len(self.place), np.int64)
            x[self.place] = np.concatenate(parts)
            out.append(x)
        return out


def range_starts(ranges: int) -> np.ndarray:
    """The least key of each range."""
    return np.array([i * 2**KEY_BITS // ranges for i in range(ranges)], np.uint64)


def rows_of(kind: int, ids: list, lists: list[np.ndarray], target: np.ndarray, starts: np.ndarray) -> list[tuple]:
    """The rows of one kind of a batch of documents; its number is a hash of its ids, sizes and words."""
    sizes = np.array([len(x) for x in lists], np.int64)
    words, word_at = np.unique(np.concatenate(lists), return_inverse=True)
    names, nulls = np.array([x or 0 for x in ids], "<i8").tobytes(), np.array([x is None for x in ids], np.uint8).tobytes()
    number = xxhash.xxh64_intdigest(b"".join([names, nulls, sizes.tobytes(), words.tobytes(), word_at.tobytes()]))
    number -= (number >> 63) << 64
    if kind == TEXTS:
        return [(TEXTS, number, len(words), len(ids), steps(words, 0), names, nulls, planes(sizes), planes(word_at), None)]
    if not len(words):
        return []
    batch = Batch(words, word_at, sizes)
    counts = batch.counts(target)
    totals = [len(word_at), int(sizes[target].sum()), len(batch.full), int(target[batch.full].sum())]
    cuts = np.searchsorted(batch.keys, starts)
    rows = []
    for r, (lo, hi) in enumerate(zip(cuts.tolist(), [*cuts[1:].tolist(), len(batch.keys)], strict=True)):
        if hi > lo:
            rows.append((KEYS, number, r, hi - lo, steps(batch.keys[lo:hi], int(starts[r])), *(planes(x[lo:hi]) for x in counts), None if rows else totals))
    return rows


def batches_of(docs: DataFrame, kind: int, ranges: int, batch_words: int) -> DataFrame:
    """The rows of one kind of all batches of docs (doc_id, text, target). A batch ends when it has batch_words words.

    Both kinds read the same partitions in the same order and so make the same batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = range_starts(ranges)
        ids: list = []
        lists: list[np.ndarray] = []
        target: list[bool] = []
        held = 0
        for b in batches:
            for doc, text, good in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                ids.append(doc)
                lists.append(word_keys(text.as_py()))
                target.append(good)
                held += len(lists[-1])
                if held >= batch_words or len(ids) >= batch_words:
                    if rows := rows_of(kind, ids, lists, np.array(target), starts):
                        yield _record(rows)
                    held, ids, lists, target = 0, [], [], []
        if ids and (rows := rows_of(kind, ids, lists, np.array(target), starts)):
            yield _record(rows)

    return docs.select("doc_id", "text", "target").mapInArrow(run, SCHEMA)


def answers_to(asked: DataFrame, ranges: int) -> DataFrame:
    """For the batches' rows of KEYS the same rows with the sums of all batches in place of their own counts. `totals`
    starts with the number of different words, which a range's first row has, and goes on with the batch's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = range_starts(ranges)

        def whole(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            sizes = [r[3] for r in rows]
            known, at = np.unique(np.concatenate([from_steps(r[4], r[3], int(starts[r[2]])) for r in rows]), return_inverse=True)
            ends = np.cumsum(sizes)
            # bincount adds doubles, which are exact up to 2^53
            sums = [np.bincount(at, np.concatenate([from_planes(r[c], r[3]) for r in rows]), len(known)).astype(np.int64) for c in range(5, 9)]
            words = int((known & ONE).sum())
            for i in range(0, len(rows), 256):
                some = zip(rows[i : i + 256], ends[i : i + 256] - sizes[i : i + 256], ends[i : i + 256], strict=True)
                yield _record([(KEYS, r[1], r[2], r[3], b"", *(planes(s[at[lo:hi]]) for s in sums), [0 if i + k else words, *(r[9] or [0] * 4)]) for k, (r, lo, hi) in enumerate(some)])

        held: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(10)), strict=True):
                if held and held[0][2] != row[2]:
                    yield from whole(held)
                    held = []
                held.append(row)
        if held:
            yield from whole(held)

    return asked.repartition("range").sortWithinPartitions("range").mapInArrow(run, SCHEMA)


def scores(docs: DataFrame, target_ids: DataFrame, mu: float = 20.0, alpha: float = 0.5, batch_words: int = 1 << 20, words_per_range: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, score) for each document id; target_ids (a column named id_col) names the target documents.

    Texts without words score 0. Rows of one id are scored as one document. An empty target leaves a uniform target
    model. A null id is an id of its own and never in the target. Repeats in target_ids change nothing. Other columns
    are ignored, also those named like the result's. No documents give no rows.
    """
    marks = target_ids.select(F.col(id_col).cast("long").alias("target_id")).where("target_id IS NOT NULL").distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # 1024 ranges hold up to a thousand million words; rows never outnumber the keys that batches ask for
    ranges = max(1024, math.ceil(size / 6 / words_per_range))
    few = small_enough(marks, 1_000_000)
    rows = rows.join(F.broadcast(marks) if few else marks, rows["doc_id"] == marks["target_id"], "left").select("doc_id", "text", F.col("target_id").isNotNull().alias("target"))
    rows = rows if few else staged(rows, "marked-texts")  # a shuffled join may give another order when it runs again
    answers = staged(answers_to(batches_of(rows, KEYS, ranges, batch_words), ranges), "word-counts")
    v, total, total_t, texts, texts_t = (x or 0 for x in answers.agg(*(F.sum(F.col("totals")[i]) for i in range(5))).first())
    matched = total_t / total if total_t else 1.0
    from_start = math.log(texts * matched + mu) - math.log(texts_t + mu)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, parts = None, {}
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
                if row[1] != batch:
                    batch, parts = row[1], {}
                if row[0] == KEYS:
                    parts[row[2]] = row  # batches of equal documents get equal answers
                else:
                    yield scored(row, list(parts.values()))

    def scored(row: tuple, parts: list[tuple]) -> pa.RecordBatch:
        _, _, words, k, keys, names, nulls, sizes, at = row
        sizes = from_planes(sizes, k)
        batch = Batch(from_steps(keys, words, 0), from_planes(at, int(sizes.sum())), sizes)
        sums = np.zeros(k)
        if sum(p[3] for p in parts) != len(batch.keys):
            raise RuntimeError("the answers of a batch are not those it asked for: its documents were read in another order")
        if len(batch.keys):
            n, t, e, f = (np.concatenate([from_planes(p[c], p[3]) for p in parts]) for c in range(5, 9))
            pair, word = batch.place[words:], batch.place[:words][batch.word_at[batch.first]]
            u_all = (n[word] * matched + alpha) / (total * matched + alpha * (v + 1))
            u_target = (t[word] + alpha) / (total_t + alpha * (v + 1))
            gain = np.log(t[pair] + mu * u_target) - np.log(n[pair] * matched + mu * u_all)
            # a word that another follows is that word's context
            context = np.log((n[word] - e[word]) * matched + mu) - np.log(t[word] - f[word] + mu)
            values = np.where(batch.final, gain[batch.pair_at], (gain + context)[batch.pair_at])
            sums[batch.full] = np.add.reduceat(values, batch.stops - sizes[batch.full]) + from_start
        ids = pa.array(np.frombuffer(names, "<i8"), mask=np.frombuffer(nulls, np.uint8) == 1)
        return pa.RecordBatch.from_arrays([ids, pa.array(sums), pa.array(sizes)], ["doc_id", "sum", "n"])

    met = answers.select(COLS[:9]).unionAll(batches_of(rows, TEXTS, ranges, batch_words).select(COLS[:9]))
    met = met.repartition("batch").sortWithinPartitions("batch", "kind", "range").mapInArrow(score, "doc_id long, sum double, n long")
    found = met.groupBy("doc_id").agg(F.sum("n").alias("n_words"), F.sum("sum").alias("sum"))
    return found.select("doc_id", "n_words", F.when(F.col("n_words") > 0, F.col("sum") / F.col("n_words")).otherwise(F.lit(0.0)).alias("score"))
