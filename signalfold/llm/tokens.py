"""Token-ID / binary output in Simple-8b words.

File: a run of blocks, each ended by one byte 0x0A (Spark's text writer puts it there). Numbers are little-endian.

    block  := b"S8B2" | part u32 | n_docs u32 | n_words u32 | n_ids u64 | start u64
              | doc ids (i64 x n_docs) | null flags (u8 x n_docs) | ids of each document (u32 x n_docs) | words (u64 x n_words)

`part` orders blocks, `start` is the block's offset: the ids of its part before it, so that a block is read without
those before it; a part's blocks may be spread over several files. A word's top four bits select how many ids share the other
60 bits (COUNTS); selector ESCAPE has no ids of its own, the next word holds one id of up to 64 bits as it is.
Each block starts a new word, and each document's number of ids gives its offset, so blocks decode alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, new_path, staged

#: Ids a word, by selector; 60 // count bits each.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
MAGIC = b"S8B2"
HEAD = np.dtype([("magic", "S4"), ("part", "<u4"), ("n_docs", "<u4"), ("n_words", "<u4"), ("n_ids", "<u8"), ("start", "<u8")])


def pack(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of ids (any unsigned 64-bit values), densest fitting selector first."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64)
    if int(ids.max()) >> 60:  # rare: pack what stands between the large ids
        out, last = [], 0
        for i in np.flatnonzero(ids >> np.uint64(60)):
            out += [pack(ids[last:i]), np.array([ESCAPE << 60, ids[i]], np.uint64)]
            last = i + 1
        return np.concatenate([*out, pack(ids[last:])])
    width = np.ones(n, np.uint8)
    width[ids > 1] = np.ceil(np.log2(ids[ids > 1].astype(np.float64) + 1)).astype(np.uint8)
    big = ids >= np.uint64(1 << 52)  # where doubles round
    width[big] = [int(x).bit_length() for x in ids[big]]
    take, choice = np.ones(n, np.int64), np.full(n, len(COUNTS) - 1, np.int8)
    span, widest = 1, width
    for s in range(len(COUNTS) - 2, -1, -1):  # two ids a word, then three, ...
        count = COUNTS[s]
        while span < count and len(widest) > 1:
            step = min(span, count - span)
            if len(widest) <= step:
                widest = widest[:0]
                break
            widest = np.maximum(widest[:-step], widest[step:])
            span += step
        if span < count or not len(widest):
            break
        fits = np.flatnonzero(widest <= 60 // count)
        take[fits], choice[fits] = count, s
    starts, at, jump = [], 0, take.tolist()
    while at < n:
        starts.append(at)
        at += jump[at]
    starts = np.array(starts)
    chosen = choice[starts]
    words = np.empty(len(starts), np.uint64)
    for s in np.unique(chosen).tolist():
        count = COUNTS[s]
        mine = np.flatnonzero(chosen == s)
        acc = np.full(len(mine), s << 60, np.uint64)
        for j in range(count):
            acc |= ids[starts[mine] + j] << np.uint64(j * (60 // count))
        words[mine] = acc
    return words


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of Simple-8b words."""
    words = np.ascontiguousarray(words, np.uint64)
    kind = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (kind == ESCAPE).any():  # a word after an escape is no word, whatever its top bits are
        i, escapes = 0, np.flatnonzero(kind == ESCAPE).tolist()
        for e in escapes:
            if e >= i:
                raw[e + 1], i = True, e + 2
    counts = np.array([*COUNTS, 0, 0], np.int64)[kind]
    counts[raw] = 1
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    starts = ends - counts
    out[starts[raw]] = words[raw]
    for s, count in enumerate(COUNTS):
        mine = np.flatnonzero((kind == s) & ~raw)
        bits = 60 // count
        low = np.uint64((1 << bits) - 1)
        for j in range(count if len(mine) else 0):
            out[starts[mine] + j] = (words[mine] >> np.uint64(j * bits)) & low
    return out


class WordEncoder:
    """Ids of texts; white space separates what this tokenizer encodes, so ids of white-space-free pieces are kept.

    The tokenizer lower-cases, so A-Z is lower-cased first unless the text may spell a special token. A comma or full
    stop after a letter that ends a piece is always a token of its own. At most `kept` pieces of at most 64 bytes each
    are kept.
    """

    def __init__(self, path: str, kept: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Kept(kept)
        names = self.tokenizer.get_vocab()
        self.last = np.zeros(max(names.values()) + 1, bool)
        self.last[[i for n, i in names.items() if n.endswith("</w>")]] = True

    def encoded(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian u32 ids of each of these pieces, which are all different."""
        keep = self.known
        stems = {p: p[:-1] if len(p) > 1 and p[-1:] in b".," and p[-2:-1].isalpha() else p for p in keep.missing(set(pieces))}
        young, long = keep.young, {}
        ends = {p[-1:] for p, s in stems.items() if s is not p}
        new = {*stems.values(), *ends}
        plain, other = [], []
        for w in new:
            if w in young:
                continue
            t = w.decode("utf-8", "replace")
            (plain if len(w) <= 64 and t.isalpha() else other).append((w, t))
        found: dict[bytes, bytes] = {}
        for i in range(0, len(plain), 2048):
            part = plain[i : i + 2048]
            # letters alone make one word, and the last token of a word is known by its id
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([t for _, t in part])], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.last[ids]) + 1
            if len(stops) != len(part):
                other += part
                continue
            data, at = ids.tobytes(), 0
            for (w, _), stop in zip(part, (4 * stops).tolist(), strict=True):
                found[w] = data[at:stop]
                at = stop
        for i in range(0, len(other), 4096):
            part = other[i : i + 4096]
            coded = self.tokenizer.encode_batch_fast([t for _, t in part], add_special_tokens=False)
            for (w, _), e in zip(part, coded, strict=True):
                found[w] = np.array(e.ids, "<u4").tobytes()
        young.update((w, ids) for w, ids in found.items() if len(w) <= 64)
        for w, stem in stems.items():
            ids = found[stem] if stem in found else young[stem]
            if stem is not w:
                mark = w[-1:]
                ids += found[mark] if mark in found else young[mark]
            (young if len(w) <= 64 else long)[w] = ids
        get = (young | long if long else young).__getitem__
        return list(map(get, pieces))

    def codes(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each followed by end_id, number of ids of each text); null is empty."""
        texts = pc.fill_null(texts, "")
        special = pc.match_substring(texts, "<|")
        if pc.any(special).as_py():  # rare: what may spell a special token keeps its capitals
            texts = pc.if_else(special, texts, pc.ascii_lower(texts))
        else:
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().cast(pa.binary()).dictionary_encode()
        coded = self.encoded(words.dictionary.to_pylist())
        coded.append(np.array([end_id], "<u4").tobytes())
        ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded))) // 4
        of_piece = pa.ListArray.from_arrays(pa.array(np.insert(ends, 0, 0).astype(np.int32)), pa.array(np.frombuffer(b"".join(coded), "<u4")))
        stops = np.cumsum(lists.value_lengths().to_numpy())
        of_word = of_piece.take(pa.array(np.insert(words.indices.to_numpy(), stops, len(coded) - 1)))
        return of_word.values.to_numpy(), np.diff(of_word.offsets.to_numpy()[stops + np.arange(len(stops)) + 1], prepend=0)


@cache
def encoder(path: str) -> WordEncoder:
    """One for all tasks of a Python worker."""
    return WordEncoder(path)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, block_ids: int = 1 << 18, slice_bytes: int = 1 << 22, file_blocks: int = 64, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text (null: empty), append end_id to each document and write files under path.

    Documents stand in ascending id order (null ids first, equal ids by text): files by range, rows within files.
    Blocks hold about block_ids ids and no more than those of slice_bytes of text or one text beyond, so memory is
    bounded by these and one text. Spark's committer writes the
    files: a lost executor's part is written again and no partial file stays. An empty table leaves no blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(tokenizer), TaskContext.get().partitionId()
        names: list[int | None] = []
        sizes: list[np.ndarray] = []
        codes: list[np.ndarray] = []
        held = start = 0

        def block() -> pa.RecordBatch:
            nonlocal start
            ids, lengths = np.concatenate(codes), np.concatenate(sizes).astype("<u4")
            words = pack(ids)
            head = np.array([(MAGIC, part, len(lengths), len(words), len(ids), start)], HEAD).tobytes()
            start += len(ids)
            nulls = np.array([x is None for x in names], np.uint8).tobytes()
            body = np.array([x or 0 for x in names], "<i8").tobytes() + nulls + lengths.tobytes() + words.astype("<u8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([head + body], pa.binary())], ["block"])

        for b in batches:
            texts = b.column(1)
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            i = 0
            while i < b.num_rows:  # about slice_bytes bytes of text at a time, one text at least
                j = max(int(np.searchsorted(size, (size[i - 1] if i else 0) + slice_bytes, "right")), i + 1)
                ids, lengths = coder.codes(texts.slice(i, j - i), end_id)
                names += b.column(0).slice(i, j - i).to_pylist()
                codes.append(ids)
                sizes.append(lengths)
                held += len(ids)
                if held >= block_ids:
                    yield block()
                    names, sizes, codes, held = [], [], [], 0
                i = j
        if names:
            yield block()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    blocks = rows.mapInArrow(run, "block binary")
    blocks.select(F.col("block").cast("string").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", file_blocks).text(path)


def blocks_of(content: bytes) -> Iterator[tuple[int, int, list[int | None], np.ndarray, np.ndarray]]:
    """(part, start, doc ids, number of ids of each document, all ids) of the blocks of a file."""
    at = 0
    while at < len(content):
        head = np.frombuffer(content, HEAD, 1, at)[0]
        if bytes(head["magic"]) != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += HEAD.itemsize
        n, w = int(head["n_docs"]), int(head["n_words"])
        names = np.frombuffer(content, "<i8", n, at)
        nulls = np.frombuffer(content, np.uint8, n, at + 8 * n)
        lengths = np.frombuffer(content, "<u4", n, at + 9 * n)
        words = np.frombuffer(content, "<u8", w, at + 13 * n)
        at += 13 * n + 8 * w + 1
        ids = unpack(words)
        if len(ids) != int(head["n_ids"]):
            raise ValueError(f"a block has {len(ids)} ids and should have {head['n_ids']}")
        yield int(head["part"]), int(head["start"]), [None if z else int(x) for x, z in zip(names, nulls, strict=True)], lengths.astype(np.int64), ids


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files under path.

    start counts the ids of all documents before it; totals of parts, one row each, are summed in their order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                for part, at, names, lengths, ids in blocks_of(content.as_py()):
                    data = ids.astype("<u4").tobytes()
                    ends = np.cumsum(lengths)
                    crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                    k = len(names)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.int64()), pa.array([part] * k, pa.int64()), pa.array(at + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                        ["doc_id", "part", "start", "n_tokens", "ids_crc32"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "doc_id long, part long, start long, n_tokens long, ids_crc32 long")


def with_starts(rows: DataFrame) -> DataFrame:
    """read()'s rows with starts counted over all files."""
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("part", F.coalesce(before, F.lit(0).cast("long")).alias("before"))
    return rows.join(F.broadcast(totals), "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None, **options) -> DataFrame:
    """write() to path (a new one in the shared folder if none is given), then read() with starts over all files."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-ids")
    write(docs, path, tokenizer, end_id, **options)
    return with_starts(staged(read(spark, path), "token-rows"))
