"""Toxicity: bags of subword embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of its character n-grams and of the whole word, so a misspelling shares
most of its vector with the word it hides. A passage of `passage` words is the mean of its words' vectors, and a
softmax over two classes reads it. A document scores as its most toxic passage, which keeps a few words of abuse
visible in a long text; training follows that: after a first pass over all passages, only the passages that decide a
document teach.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept

EDGES = ".,;:!?\"'()[]{}<>*-_…¡¿«»"


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def subwords(words: list[str], buckets: int, shortest: int = 3, longest: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(bucket numbers of the words' byte n-grams and of the whole words, where each word's numbers start, and the end).

    Words are stripped of marks at their ends and put between < and >. All words are hashed at once: polynomial hashes
    of every n bytes in a row, kept where they lie within one word.
    """
    data = [b"<" + w.strip(EDGES).encode("utf-8", "surrogatepass") + b">" for w in words]
    sizes = np.array([len(d) for d in data], np.int64)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(int(sizes.sum()))  # bytes up to the word's end
    raw = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(data)), sizes)
    base, found, owners = np.uint64(0x100000001B3), [], []
    run = raw.copy()
    for n in range(2, longest + 1):
        run = run[:-1] * base + raw[n - 1 :] if len(run) > 1 else run[:0]
        if n >= shortest:
            ok = np.flatnonzero(left[: len(run)] >= n)
            found.append(run[ok] + np.uint64(n))
            owners.append(owner[ok])
    found.append(np.array([zlib.crc32(d) for d in data], np.uint64))
    owners.append(np.arange(len(data)))
    h, who = np.concatenate(found), np.concatenate(owners)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(who, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(data)))]).astype(np.int64)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(buckets)).astype(np.int32)[order], starts


@dataclass
class Model:
    """Embeddings (buckets x dim) and softmax weights (dim x 2) with its bias; effect is their product."""

    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    passage: int
    prior: float
    effect: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.effect = (self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)

    @property
    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


class Scorer:
    """Scores texts with a model's effects. The softmax is linear in the mean, so each word needs one number.

    At most `kept` of them are kept. A text without words scores as the prior.
    """

    def __init__(self, effect: np.ndarray, offset: float, passage: int, prior: float, kept: int = 600_000):
        self.effect, self.offset, self.passage, self.prior, self.known = effect, offset, passage, prior, Kept(kept)

    def learn(self, words: list[str]) -> None:
        for i in range(0, len(words), 5000):
            part = words[i : i + 5000]
            sub, at = subwords(part, len(self.effect))
            mean = np.add.reduceat(self.effect[sub].astype(np.float64), at[:-1]) / np.diff(at)
            self.known.young.update(zip(part, mean.tolist(), strict=True))

    def scores(self, texts: list[str | None]) -> list[float]:
        out = []
        for i in range(0, len(texts), 64):
            lists = [words_of(t) for t in texts[i : i + 64]]
            self.learn(self.known.missing({w for x in lists for w in x}))
            get = self.known.young.__getitem__
            for words in lists:
                if not words:
                    out.append(self.prior)
                    continue
                most = float(passage_means(np.fromiter(map(get, words), np.float64, len(words)), self.passage).max())
                out.append(float(1 / (1 + np.exp(-np.clip(most + self.offset, -60, 60)))))
        return out


def passage_starts(n: int, passage: int) -> np.ndarray:
    """Starts of half-overlapping passages; a text of one passage or less has one."""
    last = max(n - passage, 0)
    starts = np.arange(0, last + 1, max(passage // 2, 1))
    return starts if starts[-1] == last else np.append(starts, last)


def passage_means(values: np.ndarray, passage: int) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    starts = passage_starts(len(values), passage)
    ends = np.minimum(starts + passage, len(values))
    return (total[ends] - total[starts]) / (ends - starts)


def train(texts: list[str], labels: list[int], buckets: int = 1 << 17, dim: int = 8, passage: int = 16, rounds: int = 20, steps: int = 600, rate: float = 0.3, batch: int = 256, prior: float | None = None, seed: int = 11) -> Model:
    """Fit embeddings and softmax jointly by Adagrad on the passages of the texts; prior is the share of label 1.

    It makes `rounds` passes or more, until `steps` batches have taught.
    """
    rng = np.random.default_rng(seed)
    ids: dict[str, int] = {}
    docs = [np.array([ids.setdefault(w, len(ids)) for w in words_of(t)], np.int32) for t in texts]
    keep = [i for i, d in enumerate(docs) if len(d)]
    docs, truth = [docs[i] for i in keep], np.array([labels[i] for i in keep], np.int64)
    emb = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    w = rng.normal(0, 0.1, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    prior = (float(truth.mean()) if len(truth) else 0.0) if prior is None else prior
    if not docs:
        return Model(emb, w, bias, passage, prior)
    names = list(ids)
    parts = [subwords(names[i : i + 5000], buckets) for i in range(0, len(names), 5000)]
    flat = np.concatenate([f for f, _ in parts])
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(a) for _, a in parts]))])
    del ids, names, parts
    starts = [passage_starts(len(d), passage) for d in docs]
    owner = np.repeat(np.arange(len(docs)), [len(s) for s in starts])
    first = np.concatenate(starts)
    g_emb, g_w, g_bias = np.full(buckets, 1e-9, np.float32), np.full(w.shape, 1e-9, np.float32), np.full(2, 1e-9, np.float32)
    share = truth.mean()
    weight = np.where(truth == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))

    def step(chosen: np.ndarray) -> None:
        lists = [docs[owner[i]][first[i] : first[i] + passage] for i in chosen]
        sizes = np.array([len(x) for x in lists])
        word, place = np.unique(np.concatenate(lists), return_inverse=True)
        counts = at[word + 1] - at[word]
        sub = flat[np.repeat(at[word] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())]
        begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
        vector = np.add.reduceat(emb[sub], begin, axis=0) / counts[:, None]
        x = np.add.reduceat(vector[place], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / sizes[:, None]
        z = x @ w + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        err = p
        err[np.arange(len(lists)), truth[owner[chosen]]] -= 1
        err *= (weight[owner[chosen]] / len(lists))[:, None]
        dw, db, dx = x.T @ err, err.sum(0), err @ w.T / sizes[:, None]
        each = np.repeat(dx, sizes, axis=0)
        dv = np.column_stack([np.bincount(place, each[:, k], len(word)) for k in range(dim)]) / counts[:, None]
        used, where = np.unique(sub, return_inverse=True)
        each = np.repeat(dv, counts, axis=0)
        de = np.column_stack([np.bincount(where, each[:, k], len(used)) for k in range(dim)])
        g_emb[used] += (de * de).mean(1)
        emb[used] -= (rate * de / np.sqrt(g_emb[used])[:, None]).astype(np.float32)
        for value, grad, past in ((w, dw, g_w), (bias, db, g_bias)):
            past += (grad * grad).astype(np.float32)
            value -= (0.3 * rate * grad / np.sqrt(past)).astype(np.float32)

    done = 0
    for r in range(rounds + steps):
        if r >= rounds and done >= steps:
            break
        if r == 0:  # a few passages of each document
            order, low = rng.permutation(len(first)), 8
        else:  # those that decide: the highest of a document and, in clean ones, all that look toxic
            effect = (emb @ (w[:, 1] - w[:, 0])).astype(np.float64)
            mean = np.add.reduceat(effect[flat], at[:-1]) / np.diff(at)
            logit = np.concatenate([passage_means(mean[d], passage) for d in docs]) + bias[1] - bias[0]
            order, low = np.argsort(-logit, kind="stable"), 1
        by_owner = order[np.argsort(owner[order], kind="stable")]
        rank = np.empty(len(first), np.int64)
        rank[by_owner] = np.arange(len(first)) - np.searchsorted(owner, owner[by_owner])
        chosen = rank < low
        if r:
            chosen |= (truth[owner] == 0) & ((logit > 0) | (rank < 2))
        chosen = np.flatnonzero(chosen)
        rng.shuffle(chosen)
        for i in range(0, len(chosen), batch):
            step(chosen[i : i + batch])
            done += 1
    return Model(emb, w, bias, passage, prior)


def held_out(doc_id):
    """Rows that never teach: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 1500, max_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text", **options) -> Model:
    """Train on at most max_rows labelled documents of each class (lowest hashed ids), none held out.

    Texts over max_chars and null texts don't teach; so the driver holds 2 * max_rows * max_chars characters at most.
    Null labels don't teach; a document with several labels counts as toxic if one says so, and of several texts of an id
    the least teaches.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = (F.xxhash64(F.lit(5), "doc_id"), "doc_id")
    few = [known.where(F.col("toxic") == t).orderBy(*order).limit(max_rows) for t in (0, 1)]
    few = F.broadcast(few[0].unionAll(few[1]))  # 2 * max_rows rows at most
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.char_length("text") <= max_chars)
    taught = texts.join(few, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # one text an id
    rows = sorted((r["doc_id"], r["toxic"], r["text"]) for r in taught.toLocalIterator())
    prior = counts.get(1, 0) / max(sum(counts.values()), 1)
    return train([t for _, _, t in rows], [y for _, y, _ in rows], prior=min(max(prior, 0.05), 0.95), **options)


_SCORERS: dict[str, Scorer] = {}


def _scorer(name: str, sent, kept: int) -> Scorer:
    """One for all tasks of a Python worker that use this model."""
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = Scorer(*sent.value, kept)
    return _SCORERS[name]


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", kept: int = 600_000) -> DataFrame:
    """docs with a score from 0 to 1 for each row; null, empty and blank texts get the prior share of label 1.

    Whole texts are read in one pass without a shuffle; the model's size is fixed by its number of buckets. Any other
    column of docs stays as it is. A Python worker holds the values of `kept` words at most, for as long as it lives; those
    of others are computed again.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.effect, model.offset, model.passage, model.prior))

    name = uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _scorer(name, sent, kept)
        for b in batches:
            yield pd.Series(scorer.scores(b.tolist()), dtype="float64")

    return docs.withColumn(score_col, score(F.col(text_col)))
