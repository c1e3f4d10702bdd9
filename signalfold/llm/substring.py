"""Substring dedup by compact windows.

The tokens of a text are its 5-word shingles. For a hash function, every run of tokens has a token of least hash; the
runs whose least token is at c form one compact window (l, c, r): all runs that start in l..c and end in c..r. Windows
that hold a run of `least` tokens are the top of the Cartesian tree over the hashes. Functions work in bands of two: the
windows of both that hold a common run of `least` tokens meet in one window, and the two least tokens are its key, so a
text of n tokens has about 4 n / least windows a band. Two runs of Jaccard similarity s share a band's key with a
chance of s * s; equal runs share all.

Windows of one key are joined as intervals around their least tokens. First each text is compared with one text of
each key of the first band, and the classes that follow are found. Then all pairs of windows of one key, of all bands,
whose texts are of different classes meet, and those whose stretches share enough tokens are compared, so no link
between different classes is missed and no pair within a class is compared for nothing. Every comparison is of exact
shingles.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, from_planes, join_checked, planes, small_enough, staged
from .links import components, thinned

SHINGLE = 5


def shingles_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the 5-word shingles of all texts in order, number of shingles of each text)."""
    lists = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split() for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    h = np.fromiter((xxhash.xxh64_intdigest(w) for x in lists for w in x), np.uint64, int(sizes.sum()))
    n = len(h) - SHINGLE + 1
    counts = np.maximum(sizes - SHINGLE + 1, 0)
    if n < 1:
        return np.empty(0, np.uint64), counts
    out = h[:n].copy()
    for k in range(1, SHINGLE):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[k : n + k]
    inside = np.arange(len(h)) < np.repeat(np.cumsum(sizes) - SHINGLE + 1, sizes)  # a shingle ends in its text
    return mixed(out[inside[:n]]), counts


def shingles(text: str | None) -> np.ndarray:
    """Hashes of a text's 5-word shingles in order; a text of fewer words has none."""
    return shingles_of([text])[0]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def compact_windows(h: np.ndarray, least: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r, first) of the windows that hold a run of `least` tokens; of equal hashes the first counts as lower.
    first is the start of the first run of exactly `least` tokens whose least is at c. Several texts may lie end to end
    in h, beginning at starts.

    Their centres are the least tokens of all runs of exactly `least`, and the nearest lower tokens on both sides of a
    centre are centres or ends of the text, so a stack over the centres makes this part of the tree.
    """
    n = len(h)
    if n < least:
        return (np.empty(0, np.int64),) * 4
    starts = np.zeros(1, np.int64) if starts is None else starts
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    # the position stands in the low bits, so one minimum finds both (of hashes equal above them, the first is lower)
    bits = np.uint64(n.bit_length())
    packed = (h >> bits << bits) | np.arange(n, dtype=np.uint64)
    value, span = packed, 1
    while span < least:
        step = min(span, least - span)
        value = np.minimum(value[:-step], value[step:])
        span += step
    within = owner[: n - least + 1] == owner[least - 1 :]
    new = within.copy()
    new[1:] &= (value[1:] != value[:-1]) | ~within[:-1]
    first = np.flatnonzero(new)
    value = value[first]
    c = (value & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    who = owner[c]
    left, right_end = starts[who], np.append(starts[1:], n)[who] - 1
    stack: list[int] = []
    hs, cs, text = value.tolist(), c.tolist(), -1
    for i, (x, t) in enumerate(zip(hs, who.tolist(), strict=True)):
        if t != text:
            stack, text = [], t
        while stack and hs[stack[-1]] > x:
            right_end[stack.pop()] = cs[i] - 1
        if stack:
            left[i] = cs[stack[-1]] + 1
        stack.append(i)
    return left, c, right_end, first


def joint_windows(h: np.ndarray, g: np.ndarray, least: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, d, r) of the windows that hold a run of exactly `least` tokens whose least token is at c by h and at d by g."""
    l1, c1, r1, f1 = compact_windows(h, least, starts)
    l2, c2, r2, f2 = compact_windows(g, least, starts)
    runs = np.union1d(f1, f2)
    i, j = np.searchsorted(f1, runs, "right") - 1, np.searchsorted(f2, runs, "right") - 1
    return np.maximum(l1[i], l2[j]), c1[i], c2[j], np.minimum(r1[i], r2[j])


#: Windows of one range of keys, sorted by key: keys, the texts, which text each is of, and its positions.
WINDOWS = "range int, n int, keys binary, docs binary, of binary, l binary, c binary, r binary"
KEY_BITS = 56


def windows(texts: DataFrame, bands: int, least: int, ranges: int, flush: int = 1 << 20) -> DataFrame:
    """All joint windows of texts (doc, text); a key leaves its band by `bands`. A text that a task meets again is not
    read again."""
    factor = mixed(np.arange(1, 2 * bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    names = [c.split()[0] for c in WINDOWS.split(", ")]

    def out(parts: list[tuple]) -> pa.RecordBatch:
        key, doc, lo, c, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        key, doc, lo, c, hi = (x[order] for x in (key, doc, lo, c, hi))
        edges = np.searchsorted(key, np.array([i * 2**KEY_BITS // ranges for i in range(ranges + 1)], np.int64))
        rows = []
        for r, (i, j) in enumerate(zip(edges.tolist(), edges[1:].tolist(), strict=False)):
            if j > i:
                known, at = np.unique(doc[i:j], return_inverse=True)
                rows.append((r, j - i, planes(np.diff(key[i:j], prepend=np.int64(r * 2**KEY_BITS // ranges))), known.tobytes(), planes(at), planes(c[i:j] - lo[i:j]), planes(c[i:j]), planes(hi[i:j] - c[i:j])))
        types = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        parts: list[tuple] = []
        held = 0
        for b in batches:
            for i in range(0, b.num_rows, 256):
                few = b.slice(i, 256)
                fresh = {d: t for d, t in zip(few.column(0).to_pylist(), few.column(1), strict=True) if d not in met}
                met.update(fresh)
                tokens, counts = shingles_of([t.as_py() for t in fresh.values()])
                keep = counts >= least
                tokens, docs, counts = tokens[np.repeat(keep, counts)], np.array(list(fresh), np.int64)[keep], counts[keep]
                starts = np.cumsum(counts) - counts
                owner = np.repeat(np.arange(len(counts)), counts)
                for k in range(bands if len(tokens) else 0):
                    # the tokens are mixed already, so the high bits of their products are a hash
                    lo, c, d, hi = joint_windows(tokens * factor[2 * k], tokens * factor[2 * k + 1], least, starts)
                    key = mixed((tokens[c] ^ factor[2 * k]) * np.uint64(0x9E3779B97F4A7C15) + tokens[d]) >> np.uint64(64 - KEY_BITS)
                    key = (key - key % np.uint64(bands)).view(np.int64) + k
                    at = starts[owner[c]]
                    parts.append((key, docs[owner[c]], lo - at, c - at, hi - at))
                    held += len(c)
                if held >= flush:
                    yield out(parts)
                    parts, held = [], 0
        if held:
            yield out(parts)

    return texts.mapInArrow(run, WINDOWS)


#: Windows as columns of a matrix.
KEY, DOC, LEFT, CENTRE, RIGHT, ROOT = range(6)
#: Whole keys (part -1), or a part of one key that has too many windows; head is that key's first window.
CHUNK = "part int, key long, n int, keys binary, docs binary, l binary, c binary, r binary, roots binary, head binary"
CHUNK_NAMES = [c.split()[0] for c in CHUNK.split(", ")]


def _chunk(part: int, x: np.ndarray, head: np.ndarray) -> pa.RecordBatch:
    same = np.array_equal(x[:, ROOT], x[:, DOC])
    row = (part, int(x[0, KEY]), len(x), *(x[:, i].tobytes() for i in (KEY, DOC)), *(planes(x[:, i]) for i in (LEFT, CENTRE, RIGHT)), b"" if same else x[:, ROOT].tobytes(), head.tobytes())
    types = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 7]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], CHUNK_NAMES)


def _matrix(row: tuple) -> np.ndarray:
    _, _, n, keys, docs, lo, c, hi, roots, _ = row
    docs = np.frombuffer(docs, np.int64)
    return np.column_stack([np.frombuffer(keys, np.int64), docs, *(from_planes(x, n) for x in (lo, c, hi)), np.frombuffer(roots, np.int64) if roots else docs])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(b.column(k)[i].as_py() for k in range(b.num_columns))


def _bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group of equal keys starts and ends."""
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return start, np.append(start[1:], len(keys)).astype(np.int64)


def shared(wins: DataFrame, ranges: int, block: int) -> DataFrame:
    """The windows of keys that two texts or more have, as rows of CHUNK. Of a key of very many windows, parts of
    `block` leave memory as soon as they are full."""

    def whole(x: np.ndarray, hot: dict) -> Iterator[pa.RecordBatch]:
        x = x[np.lexsort((x[:, CENTRE], x[:, DOC], x[:, KEY]))]
        x = x[np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)])]  # equal texts of several tasks
        start, stop = _bounds(x[:, KEY])
        keys = x[start, KEY]
        parts = np.isin(keys, list(hot)) | (stop - start > block)
        many = (x[start, DOC] != x[stop - 1, DOC]) & ~parts
        if many.any():
            few = x[np.repeat(many, stop - start)]
            yield _chunk(-1, few, few[0])
        for i in np.flatnonzero(parts):
            yield from parted(x[start[i] : stop[i]], hot)

    def parted(x: np.ndarray, hot: dict) -> Iterator[pa.RecordBatch]:
        part, head = hot.get(int(x[0, KEY]), (0, x[0]))
        for i in range(0, len(x), block):
            yield _chunk(part, x[i : i + block], head)
            part += 1
        hot[int(x[0, KEY])] = part, head

    def full_parts(x: np.ndarray, hot: dict) -> Iterator[pa.RecordBatch | np.ndarray]:
        """Full parts of keys with many windows, and what stays."""
        x = x[np.argsort(x[:, KEY], kind="stable")]
        start, stop = _bounds(x[:, KEY])
        stay = np.ones(len(x), bool)
        for i in np.flatnonzero(stop - start >= 16 * block):
            full = start[i] + (stop[i] - start[i]) // block * block
            yield from parted(x[start[i] : full], hot)
            stay[start[i] : full] = False
        yield x[stay]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, n, hot = -1, [], 0, {}
        most = 1 << 22
        for r, size, keys, docs, of, lo, c, hi in _rows(batches):
            if r != at:
                if n:
                    yield from whole(np.concatenate(parts), hot)
                at, parts, n, hot, most = r, [], 0, {}, 1 << 22
            centre = from_planes(c, size)
            key = np.cumsum(from_planes(keys, size)) + r * 2**KEY_BITS // ranges
            doc = np.frombuffer(docs, np.int64)[from_planes(of, size)]
            parts.append(np.column_stack([key, doc, centre - from_planes(lo, size), centre, centre + from_planes(hi, size), doc]))
            n += size
            if n > most:
                *done, rest = full_parts(np.concatenate(parts), hot)
                yield from done
                parts, n = [rest], len(rest)
                most = max(most, 2 * n)
        if n:
            yield from whole(np.concatenate(parts), hot)

    return wins.repartition("range").sortWithinPartitions("range").mapInArrow(run, CHUNK)


PAIR = "a long, b long, a_from long, a_to long, b_from long, b_to long"
PAIR_NAMES = [c.split()[0] for c in PAIR.split(", ")]


def _meet(x: np.ndarray, y: np.ndarray, least: int, slack: int) -> np.ndarray:
    """PAIR of windows x and y, row by row, where both hold a run of about `least` tokens, one row for two texts."""
    swap = (x[:, DOC] > y[:, DOC])[:, None]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    shift = y[:, CENTRE] - x[:, CENTRE]
    lo, hi = np.maximum(x[:, LEFT], y[:, LEFT] - shift), np.minimum(x[:, RIGHT], y[:, RIGHT] - shift)
    ok = (x[:, DOC] != y[:, DOC]) & (hi - lo + 1 >= least - slack)
    a, b, lo, hi, shift = (v[ok] for v in (x[:, DOC], y[:, DOC], lo - slack, hi + slack, shift))
    return _joined(np.column_stack([a, b, lo, hi, lo + shift, hi + shift]))


def _joined(p: np.ndarray) -> np.ndarray:
    """One row for each pair of texts, with all that its rows cover."""
    if len(p) < 2:
        return p
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    at = np.flatnonzero(np.concatenate([[True], (p[1:, :2] != p[:-1, :2]).any(axis=1)]))
    lows, highs = np.minimum.reduceat(p, at), np.maximum.reduceat(p, at)
    return np.column_stack([lows[:, 0], lows[:, 1], lows[:, 2], highs[:, 3], lows[:, 4], highs[:, 5]])


def _collected(found: Iterator[np.ndarray], size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Rows of PAIR, joined as far as they meet in memory."""
    held, n = [], 0

    def out() -> pa.RecordBatch:
        p = _joined(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[:, i])) for i in range(6)], PAIR_NAMES)

    for p in found:
        held.append(p)
        n += len(p)
        if n >= size:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def first_pairs(chunks: DataFrame, bands: int, least: int, slack: int) -> DataFrame:
    """Each text with the first text of each of its keys of the first band."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for row in _rows(batches):
            x = _matrix(row)
            if row[0] >= 0:
                heads = np.repeat(np.frombuffer(row[9], np.int64)[None], len(x), axis=0)
            else:
                start, stop = _bounds(x[:, KEY])
                heads = x[np.repeat(start, stop - start)]
            mine = x[:, KEY] % bands == 0
            yield _meet(heads[mine], x[mine], least, slack)

    return chunks.mapInArrow(lambda batches: _collected(found(batches)), PAIR)


#: Windows of keys whose texts are of different classes. Where a text repeats itself, its windows of one key whose centres
#: follow within `least` tokens, from c to last, are one.
OPEN = "key long, doc long, l long, c long, last long, r long, root long"
OPEN_NAMES = [c.split()[0] for c in OPEN.split(", ")]


def _open_record(x: np.ndarray, least: int) -> pa.RecordBatch:
    x = x[np.lexsort((x[:, CENTRE], x[:, DOC], x[:, KEY]))]
    at = np.flatnonzero(np.concatenate([[True], (x[1:, :2] != x[:-1, :2]).any(axis=1) | (np.diff(x[:, CENTRE]) > least)]))
    last = x[np.append(at[1:], len(x)) - 1, CENTRE]
    columns = x[at, KEY], x[at, DOC], np.minimum.reduceat(x[:, LEFT], at), x[at, CENTRE], last, np.maximum.reduceat(x[:, RIGHT], at), x[at, ROOT]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v)) for v in columns], OPEN_NAMES)


def _class_of(docs: np.ndarray, nodes: np.ndarray, root: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(nodes, docs), len(nodes) - 1)
    return np.where(nodes[at] == docs, root[at], docs)


def open_windows(chunks: DataFrame, roots, least: int) -> DataFrame:
    """The windows of all keys whose texts are of different classes; roots is a broadcast (texts, classes), both sorted
    by text, or None where the chunks have the classes."""

    def classed(row: tuple) -> np.ndarray:
        x = _matrix(row)
        if roots is not None and len(roots.value[0]):
            x[:, ROOT] = _class_of(x[:, DOC], *roots.value)
        return x

    def of_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            x = classed(row)
            start, stop = _bounds(x[:, KEY])
            differ = np.minimum.reduceat(x[:, ROOT], start) != np.maximum.reduceat(x[:, ROOT], start)
            if differ.any():
                yield _open_record(x[np.repeat(differ, stop - start)], least)

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            x = classed(row)
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (row[1], int(x[:, ROOT].min()), int(x[:, ROOT].max()))], ["key", "low", "high"])

    def of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield _open_record(classed(row), least)

    found = chunks.where("part < 0").mapInArrow(of_keys, OPEN)
    wide = chunks.where("part >= 0")
    if wide.isEmpty():
        return found
    differ = wide.mapInArrow(span, "key long, low long, high long").groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("key")
    return found.unionAll(wide.join(differ, "key", "left_semi").select(CHUNK_NAMES).mapInArrow(of_parts, OPEN))


#: Pairs of windows compared at a time.
PAIRS = 1 << 15


def _may_be_alike(x: np.ndarray, y: np.ndarray, least: int, needed: int, fewest: int) -> bool:
    """Whether a stretch without repeats has a run with enough tokens of the other; both may lack one if both have some."""
    x, y = x[x != 0], y[y != 0]
    plain = len(np.unique(x)) == len(x), len(np.unique(y)) == len(y)
    if plain == (False, False):
        return True
    one, two = (x, y) if plain[0] else (y, x)
    return bool(_holds_run(np.isin(one, two)[None], least, needed if all(plain) else fewest)[0])


def _may_meet(task: np.ndarray, wide: np.ndarray, least: int, fewest: int, few: int = 8) -> np.ndarray:
    """Which windows hold a run with enough tokens that stand in another window of their task (or twice in their own): no
    other is alike any. Tasks of few windows are left as they are. So a line that very many texts share, in different
    surroundings, makes no pairs."""
    group, size = np.unique(task, return_inverse=True, return_counts=True)[1:]
    keep = size[group] <= few
    many = np.flatnonzero(~keep)
    for rows in np.split(many, np.flatnonzero(np.diff(group[many]) != 0)[PAIRS // 4 :: PAIRS // 4] + 1) if len(many) else ():
        value = (group[rows].astype(np.uint64) << np.uint64(32))[:, None] | wide[rows].astype(np.uint64)
        _, at, n = np.unique(value, return_inverse=True, return_counts=True)
        keep[rows] = _holds_run((n[at].reshape(value.shape) > 1) & (wide[rows] != 0), least, fewest)
    return keep


def _shifted_hits(x: np.ndarray, y: np.ndarray, slack: int) -> np.ndarray:
    """Which tokens of each row of x stand in the same row of y, at most slack places away."""
    hit = x == y
    for s in range(1, slack + 1):
        hit[:, s:] |= x[:, s:] == y[:, :-s]
        hit[:, :-s] |= x[:, :-s] == y[:, s:]
    return hit & (x != 0)


def _holds_run(hit: np.ndarray, least: int, needed: int) -> np.ndarray:
    """Which rows have a run of `least` tokens, or up to a shingle more, that starts and ends with a hit and has `needed`."""
    upto = np.cumsum(np.pad(hit, ((0, 0), (1, 0))), axis=1)
    found = np.zeros(len(hit), bool)
    for n in range(least, min(least + SHINGLE + 1, hit.shape[1] + 1)):
        stop = hit.shape[1] - n + 1
        found |= (hit[:, :stop] & hit[:, n - 1 :] & (upto[:, n:] - upto[:, :stop] >= needed)).any(1)
    return found


def _run_hashes(tokens: np.ndarray, least: int) -> np.ndarray:
    """Hashes of all runs of `least` tokens."""
    h, power = tokens.astype(np.uint64), 0x9E3779B97F4A7C15
    have, out, done = 1, None, 0
    while True:
        if least & have:
            out = h if out is None else out[: len(h) - done] * np.uint64(power) + h[done:]
            done += have
        if done == least:
            return mixed(out)
        h = h[:-have] * np.uint64(power) + h[have:]
        power, have = power * power % 2**64, 2 * have


class _Linked:
    """Classes, as the links that a task has given out join them."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def top(self, r: int) -> int:
        above = self.above
        while (up := above.get(r, r)) != r:
            above[r] = above.get(up, up)
            r = up
        return r

    def tops(self, roots: np.ndarray) -> np.ndarray:
        if not self.above:
            return roots
        known, at = np.unique(roots, return_inverse=True)
        return np.array([self.top(r) for r in known.tolist()], np.int64)[at]

    def join(self, r: int, s: int) -> bool:
        """Whether r and s were apart; they are one from now on."""
        r, s = self.top(r), self.top(s)
        if r != s:
            self.above[max(r, s)] = min(r, s)
        return r != s


def _common_spans(x: np.ndarray, y: np.ndarray, reach: int, slack: int) -> np.ndarray:
    """(x from, x to, y from, y to) of what is compared of windows x and y, row by row: what both hold around the key,
    and their stretches."""
    shift = y[:, CENTRE] - x[:, CENTRE]
    lo = np.minimum(np.maximum(x[:, LEFT], y[:, LEFT] - shift) - slack, x[:, CENTRE] - reach)
    hi = np.maximum(np.minimum(x[:, RIGHT], y[:, RIGHT] - shift) + slack, x[:, CENTRE] + reach)
    return np.column_stack([lo, hi, lo + shift, hi + shift])


def _may_link(x: np.ndarray, y: np.ndarray, least: int, similarity: float) -> np.ndarray:
    """Which rows of x and y, tokens as numbers from 1 with 0 for none, alike() may link. It cannot link rows without repeats
    whose common tokens stand in one order, if no run of those has the similarity by alike's g: what it takes beyond the
    first and last of them counts as misses, so they span similarity * least tokens on both sides."""
    k, width = x.shape
    gap = math.ceil(similarity * least - 1e-9) - 1
    row = np.arange(k, dtype=np.int64)[:, None] << 32
    order = np.argsort(y, axis=1, kind="stable")
    one, two = np.sort(x, axis=1), np.take_along_axis(y, order, 1)
    unsure = ((one[:, 1:] == one[:, :-1]) & (one[:, 1:] != 0) | (two[:, 1:] == two[:, :-1]) & (two[:, 1:] != 0)).any(1)
    wanted, there = (x + row).ravel(), (two + row).ravel()
    at = np.minimum(np.searchsorted(there, wanted), len(there) - 1)
    hit = (there[at] == wanted).reshape(k, width) & (x != 0)
    q = order.ravel()[at].reshape(k, width)
    unsure |= (hit[:, 1:] & (q[:, 1:] < np.maximum.accumulate(np.where(hit, q, -1), axis=1)[:, :-1])).any(1)
    upto = np.cumsum(hit, axis=1)
    g = (1 + similarity) * upto - similarity * (np.arange(width) + q)
    r, c = np.nonzero(hit)
    n, v, d = upto[r, c], g[r, c], q[r, c]
    lowest, met = np.full((k, width + 1), np.inf), np.zeros((k, width), np.int64)
    lowest[r, n], met[r, d] = v, 1
    lowest, met = np.minimum.accumulate(lowest, axis=1), np.cumsum(met, axis=1)
    before = np.minimum(np.where(c >= gap, upto[r, c - gap], 0), np.where(d >= gap, met[r, d - gap], 0))
    good = v - lowest[r, before] >= similarity - 1 - 1e-6
    unsure[r[good]] = True
    return unsure


def _of_repeats(x: np.ndarray, cuts: np.ndarray, least: int, slack: int, similarity: float, whole: list[np.ndarray] | None = None) -> np.ndarray:
    """PAIR of the windows of one task of which one at least is a text's repetition of itself; columns: task, same, own,
    then OPEN.

    Windows with an equal run of `least` tokens meet by its hash, which makes classes of the task. Windows of different
    ones are compared exactly if each has a run whose distinct tokens lack few enough in the other: every part of alike
    runs lacks (1 - similarity) / similarity of what both share at most. Once two classes are linked, no more of their
    windows are compared. Windows that are longer than their stretch are compared as a whole here, if their tokens are
    given, and else given out to be compared.
    """
    rows = []
    for cut in cuts:
        tokens = np.frombuffer(cut, np.uint32)
        inside = np.flatnonzero(tokens)  # the ends of a text are padded
        rows.append((tokens[inside[0] : inside[-1] + 1], int(inside[0])))
    reach = least - 1 + slack
    begin = x[:, 6] - reach + np.array([at for _, at in rows])
    sizes = np.array([len(t) for t, _ in rows])
    root, many = np.unique(x[:, 9], return_inverse=True)[1].tolist(), x[:, 6] < x[:, 7]
    above = list(range(max(root) + 1))

    def top(r: int) -> int:
        while above[r] != r:
            above[r] = above[above[r]]
            r = above[r]
        return r

    def pair(i: int, j: int, spans: tuple[int, int, int, int]) -> list[int]:
        row = [int(x[i, 4]), int(x[j, 4]), *spans]
        return row if row[0] < row[1] else [row[1], row[0], *spans[2:], *spans[:2]]

    out, runs = [], []
    for k, (tokens, _) in enumerate(rows):
        if len(tokens) >= least:
            h, at = np.unique(_run_hashes(tokens, least), return_index=True)
            runs.append(np.column_stack([h.view(np.int64), np.full(len(h), k), at]))
    if not runs:
        return np.empty((0, 6), np.int64)
    posts = np.concatenate(runs)
    posts = posts[np.lexsort((posts[:, 1], posts[:, 0]))]
    start, stop = _bounds(posts[:, 0])
    heads = posts[np.repeat(start, stop - start)]
    classes = np.array(root)
    apart = classes[heads[:, 1]] != classes[posts[:, 1]]
    heads, posts = heads[apart], posts[apart]
    first = np.unique(np.column_stack([classes[heads[:, 1]], classes[posts[:, 1]]]), axis=0, return_index=True)[1]
    for (_, i, p), (_, j, q) in zip(heads[first].tolist(), posts[first].tolist(), strict=True):
        r, s = top(root[i]), top(root[j])
        if r != s and x[i, 4] != x[j, 4]:
            above[max(r, s)] = min(r, s)
            p, q = int(begin[i]) + p, int(begin[j]) + q
            out.append(pair(i, j, (p, p + least - 1, q, q + least - 1)))
    classes = np.array([top(r) for r in root])
    if (classes != classes[0]).any():
        sets = [np.unique(t) for t, _ in rows]
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(t) for t in sets])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        most = (1 - similarity) / similarity
        beyond = np.column_stack([x[:, 5] < x[:, 6] - reach, x[:, 8] > x[:, 7] + reach])  # windows that are longer than their stretch
        open_to = lambda i: (classes != classes[i]) & (x[:, 3] == x[i, 3]) & (x[:, 4] != x[i, 4]) & ((x[:, 1] == 1) | (x[:, 2] != x[i, 2])) & (sizes >= least)

        def hopeful(i: int, others: np.ndarray) -> np.ndarray:
            """Which of others have enough of the tokens of a run in row i."""
            own, (t, _) = sets[i], rows[i]
            lo, hi = np.searchsorted(tokens, own), np.searchsorted(tokens, own, "right")
            n = hi - lo
            has = np.zeros((len(own), len(rows)), np.float32)
            has[np.repeat(np.arange(len(own)), n), owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]] = 1
            has = has[:, others]
            at = np.unique(_run_hashes(t, least), return_index=True)[1]
            holds = np.zeros((len(at), len(own)), np.float32)
            holds[np.repeat(np.arange(len(at)), least), np.searchsorted(own, t[at[:, None] + np.arange(least)]).ravel()] = 1
            enough = has.sum(axis=0)
            enough = most * enough + np.where(enough >= similarity * least, SHINGLE, 0) + 1e-6  # what is alike may go on beyond the stretch
            lacks = np.full(len(others), np.inf)
            for k in range(0, len(at), 1024):
                part = holds[k : k + 1024]
                lacks = np.minimum(lacks, (part.sum(axis=1)[:, None] - part @ has).min(axis=0))
            return lacks <= enough

        found: dict[int, list[int]] = {}
        for i in np.flatnonzero(many & (sizes >= least)).tolist():
            others = np.flatnonzero(open_to(i) & (~many | (np.arange(len(x)) > i)))
            if len(others):
                for j in others[hopeful(i, others)].tolist():
                    found.setdefault(j, []).append(i)
        for j, near in found.items():
            near = np.array(near)
            for i in near[hopeful(j, near)].tolist():
                r, s = top(root[i]), top(root[j])
                if r == s:
                    continue
                linked, longer = bool(alike(rows[i][0], rows[j][0], least, similarity)), beyond[[i, j]].all(axis=0).any()
                if whole is not None:
                    linked = (linked or longer) and bool(alike(whole[i], whole[j], least, similarity))
                if linked:
                    above[max(r, s)] = min(r, s)
                if linked or (longer and whole is None):
                    spans = [(min(x[k, 5] - slack, begin[k]), max(x[k, 8] + slack, begin[k] + sizes[k] - 1)) for k in (i, j)]
                    out.append(pair(i, j, tuple(int(v) for span in spans for v in span)))
    return np.array(out, np.int64).reshape(-1, 6)


def later_pairs(chunks: DataFrame, roots, texts: DataFrame, first_rows: DataFrame, least: int, slack: int, similarity: float, block: int, max_broadcast: int = 1_000_000) -> DataFrame:
    """Pairs of windows of one key whose texts are of different classes and alike around the key. Each window brings its
    tokens once and is compared exactly in the task, with those whose stretches around the key share as many tokens as
    alike runs must; a key of more than `block` windows (or very long ones) is dealt to many tasks as pairs of parts.
    Classes that a task has linked are one from then on, so it gives out fewer pairs than it has windows, however many
    of them are alike or nearly so."""
    opened = staged(open_windows(chunks, roots, least), "open-windows")
    parts = opened.groupBy("doc").agg(F.ceil(F.count(F.lit(1)) / F.lit(1000)).alias("parts"))
    spots = opened.join(parts, "doc").withColumn("part", F.pmod(F.xxhash64("key", "c"), F.col("parts")))
    spots = spots.groupBy("doc", "part").agg(F.collect_list(F.struct("key", "l", "c", "last", "r", "root")).alias("spots"))
    spots = staged(spots.join(first_rows, "doc"), "open-spots")
    reach = least - 1 + slack

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text, spots in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                tokens = np.pad(shingles(text.as_py()), reach)
                found = spots.as_py()
                cut = [tokens[min(x["l"] - slack, x["c"] - reach) + reach : max(x["r"] + slack, x["last"] + reach) + reach + 1].tobytes() for x in found]
                cols = [pa.array([x[k] for x in found], pa.int64()) for k in ("key", "l", "c", "last", "r", "root")]
                yield pa.RecordBatch.from_arrays([cols[0], pa.array([doc] * len(found), pa.int64()), *cols[1:], pa.array(cut, pa.binary())], [*OPEN_NAMES, "tokens"])

    few = small_enough(opened, max_broadcast)
    met = texts.join(F.broadcast(spots) if few else spots, ["doc", "id"]).select("doc", "text", "spots").mapInArrow(stretches, OPEN + ", tokens binary")
    length = F.col("r") - F.col("l") + F.lit(2 * reach)
    large = opened.groupBy("key").agg(F.greatest(F.count(F.lit(1)), F.ceil(F.sum(length) / F.lit(512))).alias("n")).where(F.col("n") > block)
    k = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(block)).cast("int")
    dealt = join_checked(met, staged(large, "large-keys"), "key", "left").withColumn("k", k).withColumn("own", F.pmod(F.xxhash64("doc"), k).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("task"), (F.col("own") == F.col("other")).alias("same"), "own", *OPEN_NAMES, "tokens")
    # tokens that alike runs of `least` share at least, if both or one of them has no token twice
    needed, fewest = math.ceil(similarity / (1 + similarity) * 2 * least - 1e-9), math.ceil(similarity * least - 1e-9)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n, size, linked = 0, 0, _Linked()
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(10)])
            held.append((x, np.array(b.column(10).to_pylist(), object)))
            n, size = n + len(x), size + b.column(10).nbytes
            if n >= 1 << 14 or size >= 1 << 26:
                x, cuts = (np.concatenate(v) for v in zip(*held, strict=True))
                last = int(np.flatnonzero(x[:, 0] == x[-1, 0])[0])
                if last:
                    yield from of_tasks(x[:last], cuts[:last], linked)
                held, n, size = [(x[last:], cuts[last:])], 0, 0
                if len(linked.above) > 1 << 20:
                    linked = _Linked()
        if held:
            yield from of_tasks(*(np.concatenate(v) for v in zip(*held, strict=True)), linked)

    def of_tasks(x: np.ndarray, cuts: np.ndarray, linked: _Linked) -> Iterator[np.ndarray]:
        """Of each task the pairs of one part, or of two parts those across; columns: task, same, own, then OPEN."""
        order = np.lexsort((x[:, 7], x[:, 6], x[:, 4], x[:, 3], x[:, 0]))
        x, cuts = x[order], cuts[order]
        same = [0, 3, 4, 6, 7]
        new = np.concatenate([[True], (x[1:, same] != x[:-1, same]).any(axis=1)])  # equal rows of one text
        x, cuts = x[new], cuts[new]
        starts = np.minimum(x[:, 5] - slack, x[:, 6] - reach)
        tokens = [np.frombuffer(cut, np.uint64) for cut in cuts]
        high = [(t[c - reach - at : last + reach + 1 - at] >> np.uint64(32)).astype(np.uint32) for t, at, c, last in zip(tokens, starts.tolist(), x[:, 6].tolist(), x[:, 7].tolist(), strict=True)]
        for i, j in zip(*_bounds(x[:, 0]), strict=True):
            if (x[i:j, 6] < x[i:j, 7]).any():
                y = x[i:j].copy()
                y[:, 9] = linked.tops(y[:, 9])
                pairs = _of_repeats(y, [t.tobytes() for t in high[i:j]], least, slack, similarity, [t[t != 0] for t in tokens[i:j]])
                root = dict(zip(y[:, 4].tolist(), y[:, 9].tolist(), strict=True))
                new = [linked.join(root[a], root[b]) for a, b in pairs[:, :2].tolist()]
                if any(new):
                    yield pairs[new]
        one = np.flatnonzero(x[:, 6] == x[:, 7])
        if len(one):
            x = np.column_stack([x[one][:, [0, 1, 2, 3, 4, 5, 6, 8, 9]], one, starts[one]])
            yield from of_singles(x, np.stack([high[i] for i in one.tolist()]), tokens, linked)

    def of_singles(x: np.ndarray, wide: np.ndarray, tokens: list[np.ndarray], linked: _Linked) -> Iterator[np.ndarray]:
        """Columns: task, same, own, a window's, row in tokens, where in its text they start."""
        keep = _may_meet(x[:, 0], wide, least, fewest)
        x, wide = x[keep], wide[keep]
        if not len(x):
            return
        tokens = [tokens[i] for i in x[:, 9].tolist()]
        x[:, 9] = np.cumsum([0, *map(len, tokens)])[:-1]
        tokens = np.append(np.concatenate(tokens), np.uint64(0))
        numbers = np.unique(tokens, return_inverse=True)[1]  # 0, which pads the ends of texts, is 0
        # alike runs have a row of equal tokens around the key, as one edit leaves half of what they share; so the key's
        # tokens on one side of it are equal, and only such windows are compared, once
        half = (needed - 1) // 4
        power = np.cumprod(np.full(half + 1, 0x9E3779B97F4A7C15, np.uint64))
        left, right = ((side.astype(np.uint64) * power).sum(axis=1, dtype=np.uint64) for side in (wide[:, reach - half : reach + 1], wide[:, reach : reach + half + 1]))
        yield from of_side(x, wide, left, None, tokens, numbers, linked)
        yield from of_side(x, wide, right, left, tokens, numbers, linked)

    def of_side(x: np.ndarray, wide: np.ndarray, side: np.ndarray, met: np.ndarray | None, tokens: np.ndarray, numbers: np.ndarray, linked: _Linked) -> Iterator[np.ndarray]:
        """Links of windows of a task whose sides are equal, but not of those that met by `met`."""
        x = x.copy()
        x[:, 8] = linked.tops(x[:, 8])
        order = np.lexsort((x[:, 8], side, x[:, 0]))
        x, wide, side = x[order], wide[order], side[order]
        met = None if met is None else met[order]
        new = np.concatenate([[True], (x[1:, 0] != x[:-1, 0]) | (side[1:] != side[:-1])])
        ends = [np.repeat(stop, np.diff(np.append(0, stop))) for stop in (np.append(np.flatnonzero(v)[1:], len(x)) for v in (new, new | np.append(True, x[1:, 8] != x[:-1, 8])))]
        n = ends[0] - ends[1]  # the windows of a class meet those of the classes behind it
        total = np.cumsum(n)
        at, root, step = 0, x[:, 8], PAIRS // 32
        while at < len(x):
            to = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + step, "right")), at + 1)
            m = n[at:to]
            i = np.repeat(np.arange(at, to), m)
            j = ends[1][i] + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
            at, step = to, min(2 * step, PAIRS)  # small steps first: what they link is compared no more
            ok = (root[i] != root[j]) & (x[i, 3] == x[j, 3]) & ((x[i, 1] == 1) | (x[i, 2] != x[j, 2]))
            if met is not None:
                ok &= met[i] != met[j]
            i, j = i[ok], j[ok]
            same = (wide[i] == wide[j]) & (wide[i] != 0)
            clean = np.cumprod(same[:, reach::-1], axis=1).sum(1) + np.cumprod(same[:, reach:], axis=1).sum(1) - 1
            near = clean >= (needed - 1) // 2
            i, j, same = i[near], j[near], same[near]
            # both windows hold a run of about `least` tokens
            shift = x[j, 6] - x[i, 6]
            held = (x[i, 4] != x[j, 4]) & (np.minimum(x[i, 7], x[j, 7] - shift) - np.maximum(x[i, 5], x[j, 5] - shift) + 1 >= least - slack)
            i, j, same = i[held], j[held], same[held]
            hope = _holds_run(same, least, needed)
            rest = np.flatnonzero(~hope)
            shifted = np.zeros(len(hope), bool)
            shifted[rest[_holds_run(_shifted_hits(wide[i[rest]], wide[j[rest]], slack), least, fewest)]] = True
            hope |= shifted
            i, j, shifted = i[hope], j[hope], shifted[hope]
            spans, out = _common_spans(x[i, 3:9], x[j, 3:9], reach, slack), []
            one, two = (x[w, 9] + lo - x[w, 10] for w, lo in ((i, spans[:, 0]), (j, spans[:, 2])))
            for k in may_link(one, two, spans[:, 1] - spans[:, 0] + 1, numbers).tolist():
                p, q, size = int(i[k]), int(j[k]), int(spans[k, 1] - spans[k, 0]) + 1
                r, t = int(x[p, 8]), int(x[q, 8])
                if linked.top(r) == linked.top(t) or (shifted[k] and not _may_be_alike(wide[p], wide[q], least, needed, fewest)):
                    continue
                if alike(*(v[v != 0] for v in (tokens[w : w + size] for w in (int(one[k]), int(two[k])))), least, similarity):
                    linked.join(r, t)
                    a, b = int(x[p, 4]), int(x[q, 4])
                    out.append((a, b, *spans[k]) if a < b else (b, a, *spans[k, 2:], *spans[k, :2]))
            if out:
                root = linked.tops(x[:, 8])
                yield np.array(out, np.int64)

    def may_link(one: np.ndarray, two: np.ndarray, size: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Which pairs of as many tokens, from one and from two on, alike() may link."""
        out, order, at = [], np.argsort(size, kind="stable")[::-1], 0
        while at < len(order):
            width = int(size[order[at]])
            k = order[at : at + max((1 << 19) // width, 1)]
            step = np.arange(width)
            inside = step < size[k][:, None]
            x, y = (numbers[np.where(inside, v[k][:, None] + step, len(numbers) - 1)] for v in (one, two))
            out.append(k[_may_link(x, y, least, similarity)])
            at += len(k)
        return np.sort(np.concatenate(out)) if out else order

    dealt = dealt.repartition("task").sortWithinPartitions("task")
    return dealt.mapInArrow(lambda batches: _collected(found(batches)), PAIR)


def _densest(hit: np.ndarray, similarity: float) -> tuple[int, int]:
    """The run with the most hits, where each miss takes back what keeps the share of hits at the similarity."""
    total = np.concatenate([[0.0], np.cumsum(np.where(hit, 1.0, -similarity / max(1 - similarity, 1e-6)))])
    gain = total[1:] - np.minimum.accumulate(total)[:-1]
    end = int(np.argmax(gain))
    start = int(np.argmin(total[: end + 1]))
    return start, end


def chained(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of equal tokens in x and y, both increasing: the longest such chain. The nth of equal tokens in x is
    matched with the nth in y."""
    both, number = np.unique(np.concatenate([x, y]), return_inverse=True)
    keys = []
    for part in (number[: len(x)], number[len(x) :]):
        order = np.argsort(part, kind="stable")
        start = np.searchsorted(part[order], np.arange(len(both)))
        nth = np.empty(len(part), np.int64)
        nth[order] = np.arange(len(part)) - start[part[order]]
        keys.append(nth * len(both) + part)
    _, p, q = np.intersect1d(*keys, assume_unique=True, return_indices=True)
    order = np.argsort(p)
    p, q = p[order], q[order]
    if (np.diff(q) > 0).all():
        return p, q
    ends: list[int] = []  # of the chains of each length the least end, and where it is
    at: list[int] = []
    before = []
    for i, v in enumerate(q.tolist()):
        k = bisect.bisect_left(ends, v)
        before.append(at[k - 1] if k else -1)
        if k == len(ends):
            ends.append(v)
            at.append(i)
        else:
            ends[k], at[k] = v, i
    chain, i = [], at[-1]
    while i >= 0:
        chain.append(i)
        i = before[i]
    return p[chain[::-1]], q[chain[::-1]]


def alike(x: np.ndarray, y: np.ndarray, least: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """(x from, x to, y from, y to, Jaccard similarity) of runs of `least` tokens or more, ends included; a run starts
    and ends with tokens that both have.

    From the a-th to the b-th of the tokens that both have in order, runs without repeats have a similarity of s or more
    if and only if g(b) >= g(a) - (1 - s), where g(i) = (1 + s) i - s (x's position + y's position). So the last such b
    of every a is found by one search in the maxima of g from behind, and no run is missed; those that lie in none
    before are compared exactly. Runs with repeated tokens or another order, if nothing else is alike, are sought by
    their density of hits.
    """
    p, q = chained(x, y)
    if len(p):
        g = (1 + similarity) * np.arange(len(p)) - similarity * (p + q)
        behind = np.maximum.accumulate(g[::-1])[::-1]
        last = np.searchsorted(-behind, -(g - (1 - similarity) - 1e-9), "right") - 1
        last[(p[last] - p + 1 < least) | (q[last] - q + 1 < least)] = -1
        reached = np.maximum.accumulate(np.concatenate([[-1], last[:-1]]))
        out = []
        for a in np.flatnonzero(last > reached).tolist():
            i, j, k, m = (int(v) for v in (p[a], p[last[a]], q[a], q[last[a]]))
            if (same := jaccard(x[i : j + 1], y[k : m + 1])) >= similarity:
                out.append((i, j, k, m, same))
        if out:
            return out
    return densely_alike(x, y, least, similarity) or equally_alike(x, y, least)


def equally_alike(x: np.ndarray, y: np.ndarray, least: int) -> list[tuple[int, int, int, int, float]]:
    """The first equal run of `least` tokens, as long as it goes on, of texts whose repeats hide it from a search by density."""
    if min(len(x), len(y)) < least:
        return []
    _, i, k = np.intersect1d(_run_hashes(x, least), _run_hashes(y, least), return_indices=True)
    if not len(i):
        return []
    i, k = int(i[np.argmin(i)]), int(k[np.argmin(i)])
    n = min(len(x) - i, len(y) - k)
    apart = np.flatnonzero(x[i : i + n] != y[k : k + n])
    n = int(apart[0]) if len(apart) else n
    return [(i, i + n - 1, k, k + n - 1, 1.0)] if n >= least else []


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    one, two = np.unique(x), np.unique(y)
    inner = len(np.intersect1d(one, two, assume_unique=True))
    return inner / (len(one) + len(two) - inner)


def densely_alike(x: np.ndarray, y: np.ndarray, least: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """alike() by the density of hits in any order: a run is first sought with as many misses as the similarity allows.
    Where its two sides together miss too many, it is sought again inside with a quarter of the misses, down to runs
    without any."""
    out, todo = [], [(0, len(x), 0)]
    shares = [1 - (1 - similarity) / 4**k for k in range(3)] + [1.0]
    while todo:
        lo, hi, level = todo.pop()
        if hi - lo < least or len(y) < least:
            continue
        share = shares[level]
        i, j = _densest(np.isin(x[lo:hi], y), share)
        i, j = lo + i, lo + j
        if j - i + 1 < least:
            continue
        k, m = _densest(np.isin(y, x[i : j + 1]), share)
        found = m - k + 1 >= least and (same := jaccard(x[i : j + 1], y[k : m + 1])) >= similarity
        if found:
            out.append((i, j, k, m, same))
        todo += [(lo, i, level), (j + 1, hi, level)]
        if not found and level + 1 < len(shares):
            todo.append((i, j + 1, level + 1))
    return out


def compared(texts: DataFrame, first_rows: DataFrame, pairs: DataFrame, least: int, similarity: float, max_broadcast: int = 1_000_000) -> DataFrame:
    """(a, a_from, a_to, b, b_from, b_to, similarity), in tokens: the runs that the pairs' stretches share.

    Stretches are cut out where texts are read if a count proves that they are max_broadcast at most; otherwise texts
    are shuffled to meet them.
    """
    joined = pairs.groupBy("a", "b").agg(F.min("a_from").alias("a_from"), F.max("a_to").alias("a_to"), F.min("b_from").alias("b_from"), F.max("b_to").alias("b_to"))
    some = staged(joined.withColumn("pair", F.xxhash64("a", "b")), "passages")
    sides = some.select("pair", F.col("a").alias("doc"), F.lit(0).alias("side"), F.col("a_from").alias("lo"), F.col("a_to").alias("hi")).unionAll(some.select("pair", F.col("b").alias("doc"), F.lit(1).alias("side"), F.col("b_from").alias("lo"), F.col("b_to").alias("hi")))
    # a text with very many partners is read in parts of about 1000
    parts = sides.groupBy("doc").agg(F.ceil(F.count(F.lit(1)) / F.lit(1000)).alias("parts"))
    sides = sides.join(parts, "doc").withColumn("part", F.pmod(F.xxhash64("pair"), F.col("parts")))
    spots = sides.select("doc", "part", F.struct("pair", "side", "lo", "hi").alias("spot")).groupBy("doc", "part").agg(F.collect_list("spot").alias("spots"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                tokens = shingles(b.column(0)[i].as_py())
                spots = b.column(1)[i].as_py()
                lists = [tokens[max(s["lo"], 0) : s["hi"] + 1].tobytes() for s in spots]
                yield pa.RecordBatch.from_arrays([pa.array([s["pair"] for s in spots]), pa.array([s["side"] for s in spots], pa.int32()), pa.array(lists, pa.binary())], ["pair", "side", "tokens"])

    spots = staged(spots.join(first_rows, "doc"), "spots")
    cuts = texts.join(F.broadcast(spots) if small_enough(sides, max_broadcast) else spots, ["doc", "id"]).select("text", "spots").mapInArrow(cut_out, "pair long, side int, tokens binary")
    side = lambda k: F.first(F.when(F.col("side") == k, F.col("tokens")), ignorenulls=True)
    both = some.join(cuts.groupBy("pair").agg(side(0).alias("one"), side(1).alias("two")), "pair")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            names = [b.column(c).to_pylist() for c in ("a", "b", "a_from", "b_from", "one", "two")]
            for one, two, a_at, b_at, x, y in zip(*names, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                for i, j, k, m, same in alike(x, y, least, similarity):
                    out.append((one, two, max(a_at, 0) + i, max(a_at, 0) + j, max(b_at, 0) + k, max(b_at, 0) + m, same))
            if out:
                *ids, same = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in ids), pa.array(same, pa.float64())], ["a", "b", "a_from", "a_to", "b_from", "b_to", "similarity"])

    found = both.mapInArrow(compare, "a long, b long, a_from long, a_to long, b_from long, b_to long, similarity double")
    return found.select("a", "a_from", "a_to", "b", "b_from", "b_to", "similarity")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, doc) for each row; doc is a text's 64-bit hash, so that equal texts are one point."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("doc", F.xxhash64("text", F.octet_length("text")))


def one_of_each(texts: DataFrame) -> DataFrame:
    """(doc, id) of one row of each text, of texts (doc, id, text)."""
    return staged(texts.groupBy("doc").agg(F.min("id").alias("id")), "one-of-each")


def repeated_passages(docs: DataFrame, least_words: int = 50, similarity: float = 0.8, bands: int = 4, slack: int = 8, block: int = 4096, known_classes: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, a_from, a_to, b, b_from, b_to, similarity): passages of two different texts, in words, ends included; a and b
    are texts_of's hashes of the texts.

    A passage starts and ends with a shingle that both texts have, has least_words words or more, and its shingles'
    Jaccard similarity, found exactly, is `similarity` or more. Runs of least_words equal words are all found up to classes: every two texts that share one are in one class
    of the links. Other runs are found if one of the bands agrees, of exactly 0.8 with a chance of 1 - 0.36 ** bands.
    Two texts of a class are compared only if one of them leads a key, so links are those that make the classes, not
    all pairs. Repeats within one text are not reported. Null, empty and short texts take no part. Other columns are
    ignored. Keys of more than `block` windows are compared in parts; classes are sent to the tasks only if a count
    proves them known_classes at most, and joined by shuffle otherwise.
    """
    least = least_words - SHINGLE + 1
    texts = texts_of(docs, id_col, text_col).select("doc", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))
    first_rows = one_of_each(texts)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(64, size // 6 * bands // 10 >> 20)  # about a million windows each
    chunks = staged(shared(windows(texts.select("doc", "text"), bands, least, ranges), ranges, block), "shared-windows")
    first = staged(compared(texts, first_rows, first_pairs(chunks, bands, least, slack), least, similarity), "first-passages")
    roots = staged(components(thinned(first.select("a", "b"))), "passage-classes")
    sent = None
    if small_enough(roots, known_classes):
        table = roots.toArrow()
        order = np.argsort(table.column("node").to_numpy())
        sent = docs.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy()[order] for c in ("node", "root")))
    else:
        chunks = staged(_joined_roots(chunks, roots), "classed-windows")
    later = compared(texts, first_rows, later_pairs(chunks, sent, texts, first_rows, least, slack, similarity, block), least, similarity)
    words = lambda c: (F.col(c) + SHINGLE - 1).alias(c)
    return first.unionAll(later).select("a", "a_from", words("a_to"), "b", "b_from", words("b_to"), "similarity")


def _joined_roots(chunks: DataFrame, roots: DataFrame) -> DataFrame:
    """The chunks with the classes of their texts, for more classes than every task can hold: each chunk's texts meet
    their classes by shuffle."""
    chunks = staged(chunks.withColumn("chunk", F.monotonically_increasing_id()), "numbered-windows")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, docs in _rows(batches):
            known = np.unique(np.frombuffer(docs, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(known), chunk)), pa.array(known)], ["chunk", "doc"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *row, known in _rows(batches):
            x = _matrix(tuple(row))
            if known:
                docs, found = np.array([(k["doc"], k["root"]) for k in known], np.int64).T
                order = np.argsort(docs)
                x[:, ROOT] = _class_of(x[:, DOC], docs[order], found[order])
            yield _chunk(row[0], x, np.frombuffer(row[9], np.int64))

    asked = chunks.select("chunk", "docs").mapInArrow(texts, "chunk long, doc long")
    known = asked.join(roots, asked["doc"] == roots["node"]).groupBy("chunk").agg(F.collect_list(F.struct("doc", "root")).alias("known"))
    return chunks.join(known, "chunk", "left").select(*CHUNK_NAMES, "known").mapInArrow(placed, CHUNK)


def passage_classes(docs: DataFrame, passages: DataFrame, least_words: int = 50, id_col: str = "doc_id", text_col: str = "text", counted: bool = True) -> DataFrame:
    """(doc_id, class_id, n_copies, n_texts) of each row of docs, and if counted n_links and n_words.

    class_id is the smallest doc_id reachable over shared passages or equal texts of least_words words or more (its own
    where it shares none; null ids take part and are the smallest only of a class that has no other). n_copies counts
    the rows of the same text, itself included; n_texts the different texts of the class. n_links and n_words count what
    stands in passages alone: the other texts that a text is linked with there, and how many of its words lie in its
    passages (all, if the text occurs again and is long enough). Of repeated_passages these are the links that make the
    classes, not all pairs of a class.
    """
    rows = texts_of(docs, id_col, text_col)
    size = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))
    points = staged(rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("least"), F.max(size).cast("long").alias("size")), "texts")
    both = passages.select(F.col("a").alias("doc"), F.col("b").alias("other"), F.col("a_from").alias("lo"), F.col("a_to").alias("hi"))
    both = both.unionAll(passages.select(F.col("b").alias("doc"), F.col("a").alias("other"), F.col("b_from").alias("lo"), F.col("b_to").alias("hi")))
    roots = components(thinned(passages.select("a", "b")))
    found = points.join(roots, points["doc"] == roots["node"], "left").drop("node")
    found = found.withColumn("root", F.coalesce("root", F.when((F.col("n_copies") > 1) & (F.col("size") >= least_words), F.col("doc"))))
    named = found.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("n_texts"))
    found = found.join(named, "root", "left").withColumn("n_texts", F.coalesce("n_texts", F.lit(1).cast("long")))
    own = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")
    if not counted:
        return rows.select("doc_id", "doc").join(found.select("doc", "root", "class_id", "n_copies", "n_texts"), "doc").select("doc_id", own, "n_copies", "n_texts")
    links = both.select("doc", "other").distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("n_links"))
    words = both.distinct().select("doc", F.explode(F.sequence("lo", "hi")).alias("word")).distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("n_words"))
    found = found.join(links, "doc", "left").join(words, "doc", "left")
    covered = F.when((F.col("n_copies") > 1) & (F.col("size") >= least_words), F.col("size")).otherwise(F.coalesce("n_words", F.lit(0).cast("long")))
    found = found.select("doc", "root", "class_id", "n_copies", "n_texts", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), covered.alias("n_words"))
    return rows.select("doc_id", "doc").join(found, "doc").select("doc_id", own, "n_copies", "n_texts", "n_links", "n_words")
