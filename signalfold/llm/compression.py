"""Compressing vectors to codes: an exact integer product quantiser whose nearest entries are found by annular norm pruning.

A codebook's entries are sorted by norm. By the triangle inequality an entry whose norm differs from a part's norm by more
than a distance that some entry has already is further away. So a first entry, the one nearest in norm, gives a distance,
binary search gives the annulus of norms that it allows, ends included, and only the entries in it are compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .vectors import check_range, floored, matrix, squared, whole_vectors


class Codebook:
    """Entries of one part, sorted by norm; the index of an entry is its number before sorting."""

    def __init__(self, entries: np.ndarray):
        norms = np.sqrt((entries.astype(float) ** 2).sum(1))
        self.order = np.lexsort((np.arange(len(entries)), norms))
        self.entries, self.norms = entries[self.order], norms[self.order]

    def annulus(self, norms: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries, from and up to, whose norms lie within reach of norms, ends included. Norms are rounded to 53 bits,
        so the annulus is wider by more than that."""
        slack = 1e-12 * (norms + reach + self.norms[-1])
        return np.searchsorted(self.norms, norms - reach - slack, "left"), np.searchsorted(self.norms, norms + reach + slack, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, squared distance) of each row's nearest entry, ties to the lower index, and how many were compared."""
        norms = np.sqrt((x.astype(float) ** 2).sum(1))
        at = np.searchsorted(self.norms, norms)
        left, right = np.maximum(at - 1, 0), np.minimum(at, len(self.norms) - 1)
        spot = np.where(norms - self.norms[left] <= self.norms[right] - norms, left, right)
        best, index = squared(x, self.entries[spot]), self.order[spot]
        lo, hi = self.annulus(norms, np.sqrt(best.astype(float)))
        compared = len(x)
        # outward from the first entry, one step to either side at a time, in the annulus that the best distance still allows
        for step in range(1, len(self.norms)):
            going = np.flatnonzero((spot - step >= lo) | (spot + step < hi))
            if not len(going):
                break
            for side in (-step, step):
                rows = going[(spot[going] + side >= lo[going]) & (spot[going] + side < hi[going])]
                if not len(rows):
                    continue
                entry = spot[rows] + side
                far = squared(x[rows], self.entries[entry])
                compared += len(rows)
                better = (far < best[rows]) | ((far == best[rows]) & (self.order[entry] < index[rows]))
                closer = rows[far < best[rows]]
                best[rows[better]], index[rows[better]] = far[better], self.order[entry[better]]
                if len(closer):
                    lo[closer], hi[closer] = self.annulus(norms[closer], np.sqrt(best[closer].astype(float)))
        return index, best, compared


def quantised(table: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """((id, label, codes array<int>, error) of each coded row, the codebooks: one matrix a part).

    Codebooks start as the parts of the `entries` rows of smallest id (then smallest vector, null ids last), fewer if
    there are fewer. Vectors that are null or hold null or non-finite components are left out; so are those of another
    length than the commonest (ties: the shorter) and of no length that `parts` divides. Repeated rows count as often as
    they occur. Each round reads the staged integers once and brings entries * parts sums to the driver, a bound that
    does not depend on the input. Components so large that a squared distance exceeds 64 bits raise an OverflowError.
    """
    v = floored(scale, vector_col)
    rows = table.where(whole_vectors(vector_col)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    rows = staged(rows, "integers")
    lengths = rows.groupBy(F.size("v").alias("d")).count().where((F.col("d") > 0) & (F.col("d") % parts == 0)).orderBy(F.desc("count"), "d").first()
    width = (lengths["d"] if lengths else parts) // parts
    rows = rows.where(F.size("v") == width * parts)
    first = rows.orderBy(F.col("id").isNull(), "id", "v").select("v").limit(entries).collect()
    start = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, width)
    check_range(start, width * parts)
    books = [start[:, p] for p in range(parts)]
    for _ in range(rounds if len(first) else 0):
        found = sums(rows, books).groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        books = [b.copy() for b in books]
        for r in found:
            books[r["part"]][r["entry"], r["pos"]] = int(r["total"]) // r["n"]
    return coded(rows, books), books


def split(b: pa.RecordBatch, column: int, parts: int) -> np.ndarray:
    x = matrix(b.column(column), b.num_rows)
    check_range(x, x.shape[1])
    return x.reshape(b.num_rows, parts, -1)


def sums(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(part, entry, pos, n, total): how many parts each entry is nearest to, and their sums, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, k, width = [Codebook(b) for b in books], len(books[0]), books[0].shape[1]
        n, total = np.zeros((len(books), k), np.int64), np.zeros((len(books), k, width), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = split(b, 0, len(books))
            for p, book in enumerate(made):
                index, _, _ = book.nearest(x[:, p])
                order = np.argsort(index, kind="stable")
                used, at = np.unique(index[order], return_index=True)
                n[p] += np.bincount(index, minlength=k)
                total[p, used] += np.add.reduceat(x[order, p], at, axis=0)
        part, entry, pos = np.nonzero(np.broadcast_to(n[:, :, None], total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(pos, pa.int32()), pa.array(n[part, entry]), pa.array(total[part, entry, pos])], ["part", "entry", "pos", "n", "total"])

    return rows.select("v").mapInArrow(run, "part int, entry int, pos int, n long, total long")


def coded(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(id, label, codes, error): each row's nearest entries and the sum of their squared distances."""
    label = rows.schema["label"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Codebook(b) for b in books]
        for b in batches:
            if not b.num_rows:
                continue
            x = split(b, 2, len(books))
            found = [book.nearest(x[:, p]) for p, book in enumerate(made)]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1], np.int32)), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, pa.array(sum(f[1] for f in found))], ["id", "label", "codes", "error"])

    return rows.select("id", "label", "v").mapInArrow(run, f"id long, label {label.simpleString()}, codes array<int>, error long")


def compressed(table: DataFrame, **options) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256): codes as two hex digits a part, from quantised().

    label_error is the error summed over rows of an equal label, nulls together. Labels are joined by broadcast if a
    count proves them few, else by shuffle with each label's sum dealt to 32 salted rows, as one may hold most rows.
    """
    rows, books = quantised(table, **options)
    rows = staged(rows, "codes")
    text = ",".join(str(x) for book in books for x in book.ravel().tolist())
    of_labels = rows.groupBy(F.col("label").alias("of_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    out = join_labels(rows, of_labels)
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    return out.select(F.col("id").alias("vec_id"), "label", code.alias("code"), "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def join_labels(rows: DataFrame, of_labels: DataFrame, most: int = 200_000, salts: int = 32) -> DataFrame:
    of_labels = staged(of_labels, "label-errors")
    same = F.col("label").eqNullSafe(F.col("of_label"))
    if of_labels.count() <= most:
        return rows.join(F.broadcast(of_labels), same, "left")
    dealt = of_labels.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "codes"), F.lit(salts)).cast("int"))
    return salted.join(dealt, same & (F.col("salt") == F.col("of_salt")), "left")
