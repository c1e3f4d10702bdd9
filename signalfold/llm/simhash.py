"""SimHash near-dedup by segment popcounts.

A 64-bit fingerprint is cut into 32 segments of two bits and mapped to the vector of their bit counts (0, 1 or 2).
The Manhattan distance of two such vectors never exceeds the Hamming distance of the fingerprints. The vector's 32
coordinates form `bands`; vectors within Manhattan distance r agree in all but r bands, so each point is put into the
grid cells that fix bands - r bands, and two points in range share a cell. In a cell the Manhattan distance drops
pairs first and the Hamming distance decides.

Coordinates are written in unary (0: 00, 1: 01, 2: 11), so one XOR and popcount gives the Manhattan distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, join_checked, staged
from .links import components

SEED = 42
ODD = 0x5555555555555555
SEGMENTS = 32
#: Shingles hashed and counted at a time.
CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not words:
        return 0
    if len(words) < shingle:
        grams: list[bytes] = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(grams), CHUNK):
        part = grams[i : i + CHUNK]
        h = np.fromiter(map(digest, part), np.uint64, len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(grams), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def cell_masks(radius: int) -> list[int]:
    """Masks of the grid cells: every choice of `radius` out of 2 * radius bands to leave out, as signed longs."""
    bands = max(2 * radius, 1)
    edges = [round(i * SEGMENTS / bands) for i in range(bands + 1)]
    masks = [((1 << 2 * (b - a)) - 1) << (2 * a) for a, b in zip(edges, edges[1:], strict=False)]
    full = [sum(c) for c in combinations(masks, bands - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in full]


def popcount_vector(fp):
    """The unary popcount vector of a fingerprint column."""
    x, half = fp, F.shiftrightunsigned(fp, 1)
    return F.shiftleft(x.bitwiseAND(half).bitwiseAND(F.lit(ODD)), 1).bitwiseOR(x.bitwiseOR(half).bitwiseAND(F.lit(ODD)))


def links(prints: DataFrame, radius: int = 3, block: int = 4096) -> DataFrame:
    """(a, b) longs: links that connect exactly what all pairs of distinct fp within `radius` bits connect.

    Cells with more than `block` points are dealt as pairs of blocks to many tasks, so memory is bounded by two blocks.
    Each task searches its points breadth-first and returns a spanning forest of their links, so rows grow with the
    points and not with the pairs.
    """
    masks = cell_masks(radius)
    points = prints.select("fp").distinct().withColumn("v", popcount_vector(F.col("fp")))
    cells = points.select("fp", "v", F.posexplode(F.array(*[F.col("v").bitwiseAND(F.lit(m)) for m in masks])).alias("c", "key"))
    counts = cells.groupBy("c", "key").agg(F.count(F.lit(1)).alias("n"))
    large = staged(counts.where(F.col("n") > block), "large-cells")
    dealt = join_checked(cells, large, ["c", "key"], "left")
    k = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("fp"), k).cast("int")
    dealt = dealt.withColumn("k", k).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("c", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    task = F.xxhash64("c", "key", "i", "j").alias("task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task_fps in _runs(batches):
            found = _forest(task_fps)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    def _forest(fps: np.ndarray) -> np.ndarray:
        fps = np.unique(fps)
        x = fps.view(np.uint64)
        half = x >> np.uint64(1)
        v = ((x & half & np.uint64(ODD)) << np.uint64(1)) | ((x | half) & np.uint64(ODD))
        rest = np.arange(len(x))
        out: list[np.ndarray] = []
        queue: list[int] = []
        while len(rest):
            if not queue:
                at, rest = int(rest[0]), rest[1:]
            else:
                at = queue.pop()
            near = np.flatnonzero(np.bitwise_count(v[rest] ^ v[at]) <= radius)  # the lower bound
            near = near[np.bitwise_count(x[rest[near]] ^ x[at]) <= radius]
            if len(near):
                met = rest[near]
                out.append(np.column_stack([np.full(len(met), fps[at]), fps[met]]))
                queue.extend(met.tolist())
                rest = np.delete(rest, near)
        return np.concatenate(out) if out else np.empty((0, 2), np.int64)

    keyed = dealt.select(task, "fp")
    keyed = keyed.repartition("task").sortWithinPartitions("task")
    return keyed.mapInArrow(run, "a long, b long").distinct()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Second columns of runs of two rows or more with one value in the (sorted) first column."""
    task, held = None, []
    for b in batches:
        t, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(t):
            continue
        cuts = np.flatnonzero(t[1:] != t[:-1]) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(t)]])
        if task is not None:
            if t[0] == task:
                held.append(fp[: ends[0]])
                starts, ends = starts[1:], ends[1:]
                if not len(starts):
                    continue
            if sum(map(len, held)) > 1:
                yield np.concatenate(held)
        for i in np.flatnonzero(ends[:-1] - starts[:-1] > 1):
            yield fp[starts[i] : ends[i]]
        task, held = t[-1], [fp[starts[-1] :]]
    if task is not None and sum(map(len, held)) > 1:
        yield np.concatenate(held)


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs.

    Null, empty and blank texts have fingerprint 0 and link like any other. component_id is the smallest doc_id that
    is reachable over links of `radius` bits at most; null ids take part but are never the smallest unless a component
    has no other. Equal fingerprints are one point, so copies are never paired. An empty table gives no rows. Other
    columns are ignored.
    """
    prints = staged(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    points = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-groups")
    roots = components(links(points, radius))
    points = points.join(roots, points["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = points.groupBy("root").agg(F.min("least").alias("component_id"))
    points = points.join(ids, "root").select("fp", "component_id")
    return prints.join(points, "fp").select("doc_id", "fp", "component_id")
