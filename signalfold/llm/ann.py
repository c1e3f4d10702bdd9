"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes: the signs of vectors in orthogonal rotations, each fitted on a bounded sample (iterative quantisation). A code is
cut into substrings of 16 bits, and each substring has a table with a list of rows for each of its values. Probing all
values within `reach` bits in each of m tables retrieves, by the pigeonhole principle, every code within
m * (reach + 1) - 1 bits of the query's, and floats rerank what is retrieved. Neighbours in many dimensions lie further
apart than that, so the number of tables, and if need be the reach, is the least whose measured recall on the sample
meets `recall`. The index is dealt to shards by hash, so its memory is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Bits of a substring.
BITS = 16
VALUES = 1 << BITS
#: Masks of at most so many bits, fewest first, and how many have at most 0, 1, 2 ... bits.
MASKS = np.array([sum(1 << b for b in c) for n in range(5) for c in combinations(range(BITS), n)], np.uint32)
WITHIN = [sum(math.comb(BITS, j) for j in range(n + 1)) for n in range(5)]


def fit_rotations(sample: np.ndarray, tables: int, rounds: int = 10, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(mean, directions): bits are (x - mean) @ directions > 0, BITS of them for each table."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    mean = sample.mean(0)
    x = sample - mean
    out = []
    for _ in range(math.ceil(tables * BITS / d)):
        r, _ = np.linalg.qr(rng.normal(size=(d, d)))
        for _ in range(rounds):
            u, _, wt = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
            r = (u @ wt).T
        out.append(r)
    return mean, np.concatenate(out, axis=1)[:, : tables * BITS]


def codes(x: np.ndarray, mean: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The value of each substring for each vector."""
    bits = np.packbits((x - mean) @ directions > 0, axis=1)
    return bits.reshape(len(x), -1, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)


def fit_reach(sample: np.ndarray, code: np.ndarray, k: int, recall: float) -> tuple[int, int]:
    """(tables, reach): the fewest tables and, before that, the least reach that find `recall` of the sample's nearest."""
    n = len(sample)
    ask = np.arange(min(n, 256))
    s = sample[ask] @ sample.T
    s[ask, ask] = -np.inf
    near = np.argpartition(-s, min(k, n - 1) - 1, axis=1)[:, : min(k, n - 1)]
    away = np.bitwise_count(code[ask][:, None, :] ^ code[near])
    for reach in range(2, len(WITHIN)):
        found = np.maximum.accumulate(away <= reach, axis=2).mean(axis=(0, 1))
        if found[-1] >= recall:
            return int(np.argmax(found >= recall)) + 1, reach
    return code.shape[1], len(WITHIN) - 1


class MultiIndex:
    """The codes of one shard with a list of rows for each value of each substring; copies says how often a row counts."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, code: np.ndarray):
        self.ids, self.copies, self.vectors = ids, copies, vectors
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.order = np.argsort(code, axis=0, kind="stable").astype(np.int32)
        self.at = np.stack([np.searchsorted(code[self.order[:, j], j], np.arange(VALUES + 1)) for j in range(code.shape[1])]).astype(np.int32)

    def probed(self, q: np.ndarray, reach: int) -> np.ndarray:
        """Rows that share with q a substring up to `reach` bits."""
        values = q[:, None].astype(np.uint32) ^ MASKS[None, : WITHIN[reach]]
        table = np.arange(len(q))[:, None]
        lo, hi = self.at[table, values], self.at[table, values + 1]
        table, value = np.nonzero(hi > lo)
        lo, n = lo[table, value], (hi - lo)[table, value]
        spots = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        seen = np.zeros(len(self.ids), bool)
        seen[self.order[spots, np.repeat(table, n)]] = True
        return np.flatnonzero(seen)

    def nearest(self, qid: int, q: np.ndarray, q_code: np.ndarray, k: int, reach: int) -> tuple[list[tuple[int, float, int]], int]:
        """((id, score, copies) of the k nearest of those probed, how many were); the reach widens until k are found or
        every row is read. Of the rows equal to the query one is its own."""
        while True:
            rows = self.probed(q_code, reach) if reach < len(WITHIN) else np.arange(len(self.ids))
            read = len(rows)
            copies = self.copies[rows]
            own = np.flatnonzero(self.ids[rows] == qid)
            own = own[(self.vectors[rows[own]] == q).all(1)]
            copies[own] -= 1
            rows, copies = rows[copies > 0], copies[copies > 0]
            if copies.sum() >= k or reach >= len(WITHIN):
                break
            reach += 1
        norm = math.sqrt(float((q * q).sum()))
        rough = self.vectors[rows] @ q / self.norms[rows]
        if len(rows) > k:
            keep = rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9 * norm
            rows, copies = rows[keep], copies[keep]
        exact = (self.vectors[rows] * q).sum(1) / (self.norms[rows] * norm)  # by row, so equal vectors score the same
        best = np.lexsort((self.ids[rows], -exact))[:k]
        return [(int(self.ids[rows[b]]), float(exact[b]), int(copies[b])) for b in best], read


def usable(vector) -> "F.Column":
    """Neither null nor zero, and no null or non-finite component."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, copies) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    return rows.groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies"))


NAMES = ["q", "query_id", "vec_id", "score", "copies", "asked", "probed"]


def search(table: DataFrame, queries: DataFrame, k: int = 5, sample_rows: int = 4096, tables: int = 128, recall: float = 0.92, shard_rows: int = 20_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame | None:
    """nearest() before its shards are merged, with `probed`, the share of a shard's rows that a query read; None if no
    row takes part."""
    rows = staged(distinct_vectors(table, id_col, vector_col), "vectors")
    size = rows.groupBy(F.size("v").alias("d")).agg(F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("rows"), "d").first()
    if size is None:
        return None
    d = size["d"]
    rows, asked = rows.where(F.size("v") == d), distinct_vectors(queries, id_col, vector_col).where(F.size("v") == d)
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64(F.lit(9), "id"), "id", "v").limit(sample_rows).collect()], float)
    sample /= np.sqrt((sample * sample).sum(1))[:, None]
    mean, directions = fit_rotations(sample, tables)
    used, reach = fit_reach(sample, codes(sample, mean, directions), k, recall) if len(sample) > 1 else (1, 0)
    directions = directions[:, : used * BITS]
    shards = max(1, math.ceil(size["n"] / shard_rows))

    def coded(x: np.ndarray) -> np.ndarray:
        return codes(x / np.sqrt((x * x).sum(1))[:, None], mean, directions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, index = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            s, kind, ids, copies = (b.column(i).to_numpy() for i in range(4))
            vectors = b.column(4).flatten().to_numpy().reshape(-1, d)
            group = s.astype(np.int64) * 2 + kind
            cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            out: list[tuple] = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if s[lo] != shard:
                    shard, parts, index = s[lo], [], None
                if kind[lo] == 0:
                    parts.append((ids[lo:hi].copy(), copies[lo:hi].copy(), vectors[lo:hi].copy()))
                    continue
                if index is None and parts:
                    known = [np.concatenate(x) for x in zip(*parts, strict=True)]
                    index, parts = MultiIndex(*known, coded(known[2])), []
                if index is not None:
                    keys = b.column(5).to_numpy()[lo:hi].tolist()
                    for key, qid, n, q, c in zip(keys, ids[lo:hi].tolist(), copies[lo:hi].tolist(), vectors[lo:hi], coded(vectors[lo:hi]), strict=True):
                        found, read = index.nearest(qid, q, c, k, reach)
                        out += [(key, qid, *x, n, read / len(index.ids)) for x in found]
            if out:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], NAMES)

    q = F.xxhash64("id", "v").alias("q")
    stored = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "copies", "v", q)
    asking = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "copies", "v", q)
    dealt = stored.unionAll(asking).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(run, "q long, query_id long, vec_id long, score double, copies long, asked long, probed double")


def nearest(table: DataFrame, queries: DataFrame, k: int = 5, **options) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of table by cosine for each row of queries, itself left out.

    Nearest first, ties to the smaller id. Vectors that are null, zero or hold null or non-finite components take no
    part, nor do null ids and vectors of another length than the commonest. Every row is a candidate, also rows of one
    id and equal rows; of the rows that equal a query in id and vector one is its own. Equal query rows are each
    answered. The codes are fitted on the sample_rows vectors of lowest hashed id; every row is indexed. Each shard
    (about shard_rows rows, so bounded memory) reads its index once and then the queries as a stream, and returns k rows
    a query, which are merged. No usable rows give no rows; other columns are ignored.
    """
    found = search(table, queries, k, **options)
    if found is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("q", "query_id").orderBy(F.desc("score"), "vec_id")
    # k rows of each shard and query; a row that stands for equal ones counts as often
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k).cast("long")))))
    best = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("asked")))).select("query_id", "rank", "vec_id", "score")
