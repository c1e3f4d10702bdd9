"""Near copies by exact Jaccard similarity of word shingles, with candidates by SimHash and by min-hash bands.

SimHash comes first: texts whose fingerprints (those of .simhash) differ in 3 bits or fewer are linked by the forests that
.simhash finds, and of these links those count whose texts are alike. As that radius reaches few pairs of just 0.8, min-hash
bands find the rest: two texts of similarity s share a band of `rows` min-hashes with probability s ** rows, so of pairs of 0.8 each pair
misses all 32 bands of 4 with probability 5e-8. Every text is compared with one text of each band that it is in, the
one whose bands hold the most texts; as that is the least edited of its family, most groups are whole then. What is left
of a band's texts of different groups meets in tasks: by their min-hashes, a byte of each, those that may be alike to a
text of another group are found (min-hashes that agree in too few for the similarity, by MARGIN standard deviations, are
not; 3e-6 of pairs just alike are). Only these bring their shingles, and all pairs of them are counted at once, as products
of matrices of the shingles that two or more have. So neither pairs nor texts of pairs travel, and of the links of a task
only those that join groups leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import LOWER_BYTES, discard, join_checked, small_batches, staged
from .links import components
from .substring import mixed, shingles

#: Shingles min-hashed at a time.
CHUNK = 1 << 11
#: Rows of whole texts that Python is handed at a time; of pairs a quarter.
BATCH = 256
#: Standard deviations by which the share of equal min-hashes may fall below the similarity.
MARGIN = 4.5
#: Pairs of min-hashes compared, and shingles counted, at a time.
PAIRS, WIDTH = 1 << 15, 1 << 10
#: Pairs of a text that is compared with very many, for one copy of it.
PARTNERS = 512


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of a text's 5-word shingles; a text of fewer words has itself, a blank one none."""
    found = shingles(text)
    if not len(found) and (words := (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()):
        found = np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    return np.unique(found)


def band_keys(tokens: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, bytes]:
    """(one key for each band, a byte of each min-hash) of a set that is not empty."""
    n = np.arange(1, bands * rows + 1, dtype=np.uint64)
    salt, factor = mixed(n * np.uint64(0xD6E8FEB86659FD93)), mixed(n * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    least = np.full(bands * rows, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(tokens), CHUNK):
        least = np.minimum(least, ((tokens[i : i + CHUNK, None] ^ salt) * factor).min(axis=0))
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) ^ least[k::rows])
    return key.view(np.int64), mixed(least).astype(np.uint8).tobytes()


def _sides(own: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a task that meet: all with all, or those of one part of a band with those of the other."""
    rows = np.arange(len(own))
    return (rows, rows) if same else (rows[own == own.min()], rows[own != own.min()])


def hopeful_rows(key: int, own: np.ndarray, same: bool, root: np.ndarray, sizes: np.ndarray, keys: np.ndarray, mins: np.ndarray, similarity: float, enough: float) -> np.ndarray:
    """Which texts of a band may be alike to one of another group. Two that share an earlier band count there."""
    left, right = _sides(own, same)
    found = np.zeros(len(own), bool)
    step = max(PAIRS // max(len(right), 1), 1)
    for at in range(0, len(left), step):
        rows = left[at : at + step, None]
        n, m = sizes[rows], sizes[right]
        i, j = np.nonzero((root[rows] != root[right]) & (np.minimum(n, m) >= similarity * np.maximum(n, m)) & ((rows < right) | (not same)))
        i, j = rows[i, 0], right[j]
        near = (mins[i] == mins[j]).sum(1) >= enough
        i, j = i[near], j[near]
        here = keys[i, (keys[i] == keys[j]).argmax(1)] == key
        found[i[here]] = found[j[here]] = True
    return found


def joining_links(own: np.ndarray, same: bool, root: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Rows (i, j) whose shingle sets are alike and that join groups: no more than one for each group that joins another."""
    left, right = _sides(own, same)
    sizes = np.array([len(x) for x in sets], np.int64)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    held = count[place] > 1
    owner, place = np.repeat(np.arange(len(sets)), sizes)[held], (np.cumsum(count > 1) - 1)[place[held]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    inner = np.zeros((len(left), len(right)), np.float32)  # exact for fewer than 2 ** 24 shingles
    many = int((count > 1).sum())
    for at in range(0, many, WIDTH):
        lo, hi = np.searchsorted(place, [at, at + WIDTH])
        has = np.zeros((len(sets), min(WIDTH, many - at)), np.float32)
        has[owner[lo:hi], place[lo:hi] - at] = 1
        inner += has[left] @ has[right].T
    group, out = root.copy(), []
    for k, i in enumerate(left.tolist()):
        both = inner[k].astype(np.float64)
        near = right[(both >= similarity * (sizes[i] + sizes[right] - both)) & (group[right] != group[i])]
        for g, at in zip(*np.unique(group[near], return_index=True), strict=True):
            out.append((i, int(near[at])))
            group[group == g] = group[i]
    return out


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each task, of rows in the order of `task`."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        task = b.column("task").to_numpy()
        cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                if held and held[0].column("task")[0].as_py() != task[i]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _dealt(posts: DataFrame, block: int) -> DataFrame:
    """Posts by tasks: one for a key, or for each pair of parts of a key of more than `block` posts."""
    large = staged(posts.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > block), "large-bands")
    k = F.ceil(F.coalesce("k", F.lit(1)) / F.lit(block)).cast("int")
    own = join_checked(posts, large, "key", "left").withColumn("k", k).withColumn("own", F.pmod(F.xxhash64("point"), F.col("k")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    own = own.withColumn("task", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).withColumn("same", F.col("own") == F.col("other"))
    return own.drop("k", "other").repartition("task").sortWithinPartitions("task")


def near_copies(docs: DataFrame, similarity: float = 0.8, bands: int = 32, rows: int = 4, max_broadcast: int = 1_000_000, block: int = 2048, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for each row of docs.

    component_id is the smallest doc_id reachable over pairs whose 5-word shingles have a Jaccard similarity of
    `similarity` or more. Null, empty and blank texts are copies of one another; null ids take part but are the smallest
    only of a group that has no other. Equal shingle sets are one point. Other columns are ignored. Hashes of the texts to
    compare are sent to all tasks only if a count proves them max_broadcast at most. A band of more than `block` texts
    that are left is compared in parts. radius: bits in which fingerprints that SimHash links may differ.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py()) for t in b.column(1)]
            prints = np.array([simhash.fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            points = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            keys = [band_keys(x, bands, rows) if len(x) else (np.empty(0, np.int64), b"") for x in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(points), pa.array([len(x) for x in sets], pa.int64()), pa.array([k for k, _ in keys], pa.list_(pa.int64())), pa.array([m for _, m in keys], pa.binary()), pa.array(prints)], ["doc_id", "text", "point", "n", "keys", "mins", "fp"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with small_batches(docs.sparkSession, BATCH):
        made = staged(texts.mapInArrow(sketch, "doc_id long, text string, point long, n long, keys array<long>, mins binary, fp long"), "sketches")
    points = staged(made.groupBy("point").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("mins").alias("mins")), "points")
    posts = points.select(F.explode("keys").alias("key"), "point", "n")
    counts = posts.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    posts = staged(posts.join(counts, "key"), "shared-bands")  # texts that share a band with another only
    met = posts.groupBy("point").agg(F.sum("k").alias("met"))
    heads = posts.join(met, "point").groupBy("key").agg(F.min_by(F.struct(F.col("point").alias("head"), F.col("n").alias("head_n")), F.struct(-F.col("met"), "point")).alias("head")).select("key", "head.*")
    first = posts.join(heads, "key").where("point <> head")
    first = first.where(F.least("n", "head_n") >= F.lit(similarity) * F.greatest("n", "head_n")).select(F.col("head").alias("a"), F.col("point").alias("b"))

    # of equal fingerprints one text leads; leads of linked fingerprints are compared
    prints = made.where("n > 0").select("fp", "point").distinct()
    leads = staged(prints.groupBy("fp").agg(F.min("point").alias("lead")), "fingerprint-leads")
    linked = simhash.links(leads, radius).join(leads.select(F.col("fp").alias("a"), F.col("lead").alias("x")), "a").join(leads.select(F.col("fp").alias("b"), F.col("lead").alias("y")), "b")
    near = prints.join(leads, "fp").select("lead", "point").unionAll(linked.select("x", "y")).where("lead <> point")
    first = first.unionAll(near.select(F.col("lead").alias("a"), F.col("point").alias("b"))).distinct()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, None
        for b in batches:
            out = []
            for a, c, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if a != last:
                    last, one = a, shingle_set(x.as_py())
                two = shingle_set(y.as_py())
                inner = len(np.intersect1d(one, two, assume_unique=True))
                if inner >= similarity * (len(one) + len(two) - inner):
                    out.append((a, c))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], ["a", "b"])

    hashes = bands * rows
    enough = similarity * hashes - MARGIN * (similarity * (1 - similarity) * hashes) ** 0.5

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(b.num_rows, hashes) for k in (2, 3))
                yield b.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= enough))

    def texts(wanted: DataFrame) -> DataFrame:
        """(point, text) of the points wanted."""
        wanted = staged(wanted.distinct(), "wanted-texts")
        few = wanted.count() <= max_broadcast
        return made.join(F.broadcast(wanted) if few else wanted, "point", "left_semi").groupBy("point").agg(F.first("text").alias("text"))

    def alike(pairs: DataFrame) -> DataFrame:
        mins = points.select("point", "mins")
        both = pairs.join(mins.select(F.col("point").alias("a"), F.col("mins").alias("x")), "a").join(mins.select(F.col("point").alias("b"), F.col("mins").alias("y")), "b")
        near = staged(both.select("a", "b", "x", "y").mapInArrow(hopeful, "a long, b long"), "hopeful-pairs")
        text = texts(near.select(F.col("a").alias("point")).unionAll(near.select(F.col("b").alias("point"))))
        # a head of very many partners is there as often as its pairs have parts
        copies = near.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(PARTNERS)).cast("int").alias("copies"))
        heads = text.join(copies, F.col("point") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part"), F.col("text").alias("one"))
        dealt = near.join(copies, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int")).drop("copies")
        both = dealt.join(text.select(F.col("point").alias("b"), F.col("text").alias("two")), "b").join(heads, ["a", "part"])
        with small_batches(docs.sparkSession, BATCH // 4):
            found = staged(both.select("a", "b", "one", "two").sortWithinPartitions("a").mapInArrow(compare, "a long, b long"), "links")
        for table in (near, pairs):
            discard(table)
        return found

    def column(t: pa.Table, name: str) -> np.ndarray:
        return t.column(name).to_numpy()

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tasks(batches):
            keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, bands)
            mins = np.frombuffer(b"".join(t.column("mins").to_pylist()), np.uint8).reshape(-1, hashes)
            own, key = column(t, "own"), column(t, "key")
            rows = hopeful_rows(int(key[0]), own, t.column("same")[0].as_py(), column(t, "root"), column(t, "n"), keys, mins, similarity, enough)
            if rows.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(column(t, "point")[rows]), pa.array(column(t, "root")[rows])], ["key", "point", "root"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tasks(batches):
            sets = [np.frombuffer(x, np.uint64) for x in t.column("tokens").to_pylist()]
            links = joining_links(column(t, "own"), t.column("same")[0].as_py(), column(t, "root"), sets, similarity)
            if links:
                point = column(t, "point")
                yield pa.RecordBatch.from_arrays([pa.array(point[list(v)]) for v in zip(*links, strict=True)], ["a", "b"])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(x.as_py()).tobytes() for x in b.column(1)], pa.binary())], ["point", "tokens"])

    one = alike(staged(first, "first-pairs"))
    roots = components(one)
    grouped = staged(posts.join(roots, posts["point"] == roots["node"], "left").select("key", "point", F.coalesce("root", "point").alias("root")), "grouped-bands")
    several = grouped.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    left = staged(grouped.join(several, "key", "left_semi"), "open-bands")
    with small_batches(docs.sparkSession, BATCH):
        marks = staged(_dealt(left.join(points.select("point", "n", "keys", "mins"), "point"), block).mapInArrow(marked, "key long, point long, root long").distinct(), "marked-texts")
        shingled = texts(marks.select("point")).mapInArrow(tokens, "point long, tokens binary")
        two = staged(_dealt(staged(marks.join(shingled, "point"), "shingled-texts"), block).mapInArrow(joined, "a long, b long"), "joining-links")
    roots = components(one.unionAll(two))
    placed = points.join(roots, points["point"] == roots["node"], "left").select("point", "least", F.coalesce("root", "point").alias("root"))
    placed = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("point", "component_id")
    found = staged(made.select("doc_id", "point").join(placed, "point").select("doc_id", "component_id"), "near-copies")
    for table in (made, points, posts, leads, grouped, left, marks, one, two):
        discard(table)
    return found
