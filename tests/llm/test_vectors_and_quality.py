"""Vector codes, centroid clusters and quality rules against plain Python, and their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalfold.llm import centroids, compression, quality, queries, toxicity

NAN, INF = float("nan"), float("inf")


def vector_rows(r, n, d=64, spread=1.0):
    middles = [[r.gauss(0, 1) for _ in range(d)] for _ in range(5)]
    return [(i, [float(np.float32(m + spread * r.gauss(0, 0.3))) for m in r.choice(middles)], r.choice([None, 1, 2])) for i in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Ties, repeated rows, unusable vectors, null ids and labels, and columns with the operators' own names."""
    r = random.Random(3)
    rows = vector_rows(r, 120)
    rows += [(5, rows[5][1], 1), (5, rows[5][1], 1), (200, rows[7][1], None), (201, [0.0] * 64, 2), (202, [-0.0] * 64, None), (None, rows[9][1], 1)]
    bad = [(300, None, 1), (301, [NAN] + [0.0] * 63, 1), (302, [INF] + [0.0] * 63, 1), (303, [None] + [0.0] * 63, 2), (304, [1.0] * 63, 2), (305, [], 2), (306, [-INF] * 64, None)]
    schema = "vec_id long, embedding array<double>, label int"
    df = spark.createDataFrame(rows + bad, schema).selectExpr("*", "7 AS id", "'x' AS cluster", "1 AS v", "2 AS error", "3 AS codes", "4 AS distance", "5 AS part")
    return df.repartition(5).cache(), rows


def squares(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def plain_means(points, start, rounds):
    """(entries, their number for each point) by comparing all."""
    books = [list(s) for s in start]
    near = lambda x: min((squares(x, b), e) for e, b in enumerate(books))
    for _ in range(rounds):
        of = [near(x)[1] for x in points]
        new = []
        for e, b in enumerate(books):
            mine = [x for x, o in zip(points, of, strict=True) if o == e]
            new.append([sum(c) // len(mine) for c in zip(*mine, strict=True)] if mine else b)
        books = new
    return books, [near(x) for x in points]


def test_codes_equal_a_plain_quantiser(spark, odd):
    df, rows = odd
    kept = sorted([(r[0] is None, r[0] or 0, [math.floor(4096 * x) for x in r[1]], r[2]) for r in rows], key=lambda r: r[:3])
    books, found = [], [[] for _ in kept]
    for p in range(8):
        points = [r[2][p * 8 : p * 8 + 8] for r in kept]
        book, near = plain_means(points, points[:16], 6)
        books.append(book)
        for f, n in zip(found, near, strict=True):
            f.append(n)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    of_label = Counter()
    for r, e in zip(kept, errors, strict=True):
        of_label[r[3]] += e
    want = sorted((None if r[0] else r[1], "".join(f"{e:02x}" for _, e in f), x, of_label[r[3]], sha) for r, f, x in zip(kept, found, errors, strict=True) if not r[0])
    got = [tuple(r) for r in compression.compressed(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(g for g in got if g[0] is not None) == want
    assert len(got) == len(kept) and sum(g[0] is None for g in got) == 1


def test_codes_of_few_and_no_rows(spark, odd):
    df, _ = odd
    assert compression.compressed(df.limit(0)).collect() == []
    assert compression.compressed(df.where("vec_id >= 300")).where("length(code) <> 16").count() == 0
    three = [(1, [0.5] * 16, None), (2, [0.25] * 16, None), (3, [0.5] * 16, 4)]
    got = [tuple(r)[:5] for r in compression.compressed(spark.createDataFrame(three, "vec_id long, embedding array<float>, label int")).orderBy("vec_id").collect()]
    assert [g[2] for g in got] == ["00" * 8, "01" * 8, "00" * 8] and all(g[3] == 0 for g in got)
    with pytest.raises(OverflowError):
        compression.quantised(spark.createDataFrame([(1, [1e30] * 8, 1)], "vec_id long, embedding array<double>, label int"))


def test_label_errors_of_many_labels(spark, odd):
    df, _ = odd
    rows, _ = compression.quantised(df)
    sums = rows.groupBy("label").agg({"error": "sum"}).toDF("of_label", "label_error")
    ways = [sorted(map(repr, compression.join_labels(rows, sums, most).select("id", "label", "label_error").collect())) for most in (100, 0)]
    assert ways[0] == ways[1] and len(ways[0]) == rows.count()


def test_annulus_finds_the_nearest_and_skips_entries():
    rng = np.random.default_rng(2)
    for spread in (1, 30):
        book = rng.integers(-spread, spread + 1, (40, 8)) * np.arange(1, 41)[:, None]
        book[7] = book[30]  # equal entries: the lower index
        x = np.concatenate([rng.integers(-9 * spread, 9 * spread, (500, 8)), book, np.zeros((1, 8), np.int64)])
        index, best, compared = compression.Codebook(book).nearest(x)
        every = ((x[:, None, :] - book[None]) ** 2).sum(2)
        assert (index == every.argmin(1)).all() and (best == every.min(1)).all()
        assert compared < 0.7 * every.size


def test_clusters_equal_plain_means(spark, odd):
    df, rows = odd
    kept = [(r[0], [math.floor(64 * x) for x in r[1]]) for r in rows]
    mark = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    start = [r[1] for r in sorted(kept, key=mark)[:16]]
    books, near = plain_means([r[1] for r in kept], start, 3)
    inertia = Counter()
    for d, c in near:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, b)).encode()).hexdigest() for b in books]
    want = Counter((r[0], c, d, inertia[c], sum(inertia.values()), sha[c]) for r, (d, c) in zip(kept, near, strict=True))
    assert Counter(tuple(r) for r in centroids.clusters(df).collect()) == want


def test_clusters_of_few_and_no_rows(spark, odd):
    df, _ = odd
    assert centroids.clusters(df.limit(0)).collect() == []
    got = centroids.clusters(df.where("vec_id IN (201, 202, 304)")).collect()
    assert [(r["distance"], r["inertia"]) for r in got] == [(0, 0)] * 2 and len({r["cluster"] for r in got}) == 1


def test_sorted_scan_finds_the_nearest_and_skips_centroids():
    rng = np.random.default_rng(4)
    middles = rng.integers(-300, 300, (25, 12))
    middles[20] = middles[3]
    x = np.concatenate([np.repeat(middles, 20, axis=0) + rng.integers(-40, 40, (500, 12)), middles])
    every = ((x[:, None, :] - middles[None]) ** 2).sum(2)
    for last in (np.zeros(len(x), np.int64), every.argmin(1), rng.integers(0, 25, len(x)), np.full(len(x), 20)):
        index, best, compared = centroids.SortedCentroids(middles).nearest(x, last)
        assert (index == every.argmin(1)).all() and (best == every.min(1)).all()
    assert centroids.SortedCentroids(middles).nearest(x, every.argmin(1))[2] < 0.3 * every.size


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    spots = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(spots)


def good_text(r, n=120):
    return ". ".join(" ".join(r.choice("abcdefghijklmnop") + str(r.randint(1, 400)) for _ in range(10)) for _ in range(n // 10))


def junk_text(r, n=120):
    return " | ".join(r.choice("ABCDEFG") * r.randint(4, 9) + "###" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    rows = [(i, good_text(r)) for i in range(300)] + [(i, junk_text(r)) for i in range(300, 360)]
    odd = [None, "", " \n\t ", "a a a a", "x y z x y z", "one\n\none\none \n", " é   x\x1c y", "# * $ % & | < >", "w " * 60, "\n".join(["same line of it"] * 30), " ".join(f"t{i}" for i in range(49)), " ".join(f"t{i}" for i in range(50)), good_text(r, 200_000), "é" * 100_000]
    return rows + [(1000 + i, t) for i, t in enumerate(odd)] + [(0, rows[0][1]), (None, rows[1][1])]


@pytest.fixture(scope="module")
def documents(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS n_words", "'x' AS score", "3 AS stats", "4 AS label", "5 AS kept")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, 1) for i in range(0, 200)] + [(i, 0) for i in range(300, 340)] + [(3, None), (None, 1), (4, 1), (4, 7)]
    return spark.createDataFrame(rows, "doc_id long, quality int")


def test_rule_counts_and_base_rules(documents, labels, texts):
    got = Counter(tuple(r)[:7] for r in quality.judged(documents, labels).select("doc_id", *quality.COUNTS, "base_failed").collect())
    want = Counter()
    for i, t in texts:
        c = plain_counts(t)
        want[(i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert got == want


def test_forest_parts_junk_from_good(documents, labels):
    got = quality.judged(documents, labels).collect()
    assert not [r for r in got if r["base_failed"] and r["kept"]]
    unseen = {r["doc_id"]: r["kept"] for r in got if r["doc_id"] is not None}
    assert sum(unseen[i] for i in range(200, 300)) >= 97 and not any(unseen[i] for i in range(340, 360))
    again = quality.judged(documents.repartition(7), labels).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_too_few_labels_keep_what_passes_the_rules(documents, labels):
    for few in (labels.limit(0), labels.where("quality = 1"), labels.where("quality = 0")):
        assert quality.judged(documents, few).where("kept = base_failed").count() == 0
    assert quality.judged(documents.limit(0), labels).count() == 0


def test_scores_are_mean_path_lengths():
    rng = np.random.default_rng(6)
    x = rng.random((300, 3))
    forest = quality.grow(x, np.zeros(3), np.ones(3), trees=20, rows=64)

    def walk(t, row, node=0):
        f = forest.feature[t, node]
        return forest.length[t, node] if f < 0 else walk(t, row, 2 * node + 1 + int(row[f] >= forest.cut[t, node]))

    c = 2 * (math.log(63) + np.euler_gamma) - 2 * 63 / 64
    want = [2 ** (-sum(walk(t, row) for t in range(20)) / 20 / c) for row in x]
    assert np.allclose(forest.scores(x), want)
    assert forest.scores(np.array([[0.5, 0.5, 5.0]]))[0] > np.quantile(want, 0.9)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_verdicts_follow_the_labels_of_the_tables(spark, sf):
    docs, marks = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    train = marks.where("crc32(cast(doc_id AS string)) % 4 <> 2")
    got = quality.judged(docs, train).where("NOT base_failed").join(marks.where("crc32(cast(doc_id AS string)) % 4 = 2"), "doc_id")
    share = {r["quality"]: r["share"] for r in got.groupBy("quality").agg({"doc_id": "count"}).join(got.where("kept").groupBy("quality").count(), "quality", "left").selectExpr("quality", "coalesce(count, 0) / `count(doc_id)` AS share").collect()}
    assert share[1] >= 0.97 and share[0] <= 0.1


def test_toxicity_on_held_out_rows_of_a_table(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op4_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("toxic", "score", "predicted").toPandas()
    bad, good = got[got.toxic == 1], got[got.toxic == 0]
    above = (bad.score.to_numpy()[:, None] > good.score.to_numpy()[None]).mean()
    assert len(bad) > 80 and above >= 0.9, (len(bad), above, bad.predicted.mean(), good.predicted.mean())


def test_toxicity_teaches_one_text_of_an_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c"), (3, "d"), (4, None)] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 0), (4, 0), (None, 1)], "doc_id long, toxic int")
    seen = []
    whole, toxicity.train = toxicity.train, lambda texts, truth, **_: seen.append(sorted(zip(texts, truth, strict=True)))
    try:
        toxicity.fit(docs, labels)
    finally:
        toxicity.train = whole
    held = {r["doc_id"] for r in spark.createDataFrame([(1,), (3,)], "doc_id long").where(toxicity.held_out(F.col("doc_id"))).collect()}
    assert seen == [[x for x, i in ((("a", 1), 1), (("d", 0), 3)) if i not in held]]
