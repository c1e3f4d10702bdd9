"""Edge cases of the training-data operators and their agreement with brute force."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from signalfold.llm import ann, chat, common, decontam, links, lmscore, mixing, nearcopies, simhash, substring, tokens, toxicity
from signalfold.llm.lines import drop_frequent_lines
from signalfold.llm.queries import vocabulary

WORDS = [f"w{i}" for i in range(400)]
rng = random.Random(1)


def prose(n, r=rng):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    long = prose(3000)
    base = prose(120)
    near = base.split()
    near[60] = "other"
    return [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, long), (8, "One two"), (9, "one TWO"), (10, "É é É"), (11, prose(80)), (None, prose(90)), (12, f"{prose(60)} {base[:400]} {prose(40)}")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a" if (i or 0) % 3 else None, 7) for i, t in rows], "doc_id long, text string, lang string, source string, TEXT_LEN int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def test_lines(spark, docs, empty):
    many = [(i, f"  Shared LINE \nown {i}\n\nshared line") for i in range(12)] + [(50, None), (51, ""), (51, ""), (52, "shared line"), (None, "x\nshared line")]
    got = {(r["doc_id"], r["kept"], r["n_lines"], r["n_dropped"]) for r in drop_frequent_lines(spark.createDataFrame(many, "doc_id long, text string"), min_docs=10).collect()}
    assert got == {*((i, f"own {i}\n", 4, 2) for i in range(12)), (50, "", 1, 0), (51, "", 1, 0), (52, "", 1, 1), (None, "x", 2, 1)}
    assert drop_frequent_lines(empty).count() == 0


def brute_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_simhash(docs, rows, empty):
    got = [(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    prints = {i: brute_print(t) for i, t in rows}
    assert {i: f for i, f, _ in got} == prints
    for i, _, c in got:
        reach, todo = {i}, [i]
        while todo:
            x = todo.pop()
            new = {j for j in prints if (prints[j] ^ prints[x]).bit_count() <= 3} - reach
            reach |= new
            todo += new
        assert c == min((j for j in reach if j is not None), default=None)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_find_all_near_pairs_and_large_cells(spark):
    r = random.Random(5)
    points = [r.getrandbits(64) for _ in range(120)]
    for p in points[:40]:
        points.append(p ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 3))))
    signed = [(p - 2**64 if p >> 63 else p,) for p in points]
    for block in (4096, 4):
        found = links.components(simhash.links(spark.createDataFrame(signed, "fp long"), 3, block)).collect()
        root = {x["node"] % 2**64: x["root"] for x in found}
        for a, b in itertools.combinations(points, 2):
            if (a ^ b).bit_count() <= 3:
                assert root[a] == root[b]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in links.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_decontamination(spark, docs, rows, empty):
    items = [(1, " ".join((rows[0][1] or "").split()[5:25])), (2, "one two"), (3, None), (4, "  ")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for most in (500_000, 0):  # broadcast, and the shuffled way
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.contaminated(docs, bench, max_broadcast=most).collect()}
        for i, t in rows:
            w, hit, names = rx.findall(lower(t or "")), set(), set()
            for item, body in items:
                x = rx.findall(lower(body or ""))
                n = min(10, len(x))
                wins = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
                for k in range(len(w) - n + 1 if n else 0):
                    if tuple(w[k : k + n]) in wins:
                        hit |= set(range(k, k + n))
                        names.add(str(item))
            assert got[i] == (len(w), len(hit), sorted(names)), i
    same = spark.createDataFrame([(1, items[0][1], 0), (1, "clean words only here", 1), (None, items[0][1], 2), (None, None, 3), (None, "one two", 4)], "doc_id long, text string, words int")
    for most in (500_000, 0):
        got = sorted((r["n_words"], r["n_hit"]) for r in decontam.contaminated(same, bench, max_broadcast=most).collect())
        assert got == [(0, 0), (2, 2), (4, 0), (20, 20), (20, 20)]
    assert decontam.contaminated(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.contaminated(empty, bench.limit(1)).count() == 0


def test_mixing(spark, empty):
    r = random.Random(3)
    rows = [(i, prose(r.randint(0, 60), r), ["a", "b", "", None][0 if i % 3 == 0 else i % 4]) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, docs_per_block=4).collect()
    assert len(got) == 2000
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df, docs_per_block=4).collect()))
    size = {s: sum(x["size"] for x in got if x["source"] == s) for s in ("", "a", "b", None)}
    weight = dict(zip(["", "a", "b", None], [3, 1, 2, 3], strict=True))
    want, left = {}, 1.5 * sum(size.values())
    open_ = dict(weight)
    while True:
        level = left / sum(open_.values())
        full = [s for s in open_ if level * open_[s] > 2 * size[s]]
        if not full:
            break
        for s in full:
            want[s] = 2.0 * size[s]
            left -= want[s]
            del open_[s]
    want |= {s: level * w for s, w in open_.items()}
    for s in size:
        mine = [x for x in got if x["source"] == s]
        assert abs(mine[0]["target"] - want[s]) < 1e-6 * want[s]
        assert abs(sum(x["taken"] for x in mine) - want[s]) <= 30  # half of the longest text
        assert all(x["taken"] <= 2 * x["size"] and len(x["places"]) == x["copies"] for x in mine)
    assert mixing.mix(empty).count() == 0
    clash = df.withColumn("shard", F.lit(1)).withColumn("size", F.lit("x")).withColumn("taken", F.lit(2))
    out = mixing.mixed(clash, docs_per_block=4)
    assert out.columns == ["doc_id", "text", "source", "size", "taken", "shard", "position"]
    drawn = sorted((x["doc_id"], p["shard"], p["position"]) for x in got for p in x["places"])
    assert sorted((x["doc_id"], x["shard"], x["position"]) for x in out.collect()) == drawn
    blocks = sum(1 for x in got for p in x["places"] if p["shard"] == 3)
    assert 0.5 * len(drawn) / 16 < blocks < 1.5 * len(drawn) / 16
    tree = mixing.splitting_tree([10, 0, 7], 4, 1)
    assert tree.sum(0).tolist() == [10, 0, 7] and max(tree.sum(1)) - min(tree.sum(1)) <= 1


@pytest.mark.parametrize("ids", [[], [0], [1] * 200, list(range(500)), [2**60, 5, 2**64 - 1, 2**63, 1], [2**59] * 3, np.random.default_rng(0).integers(0, 49408, 5000).tolist()])
def test_simple8b_round_trip(ids):
    x = np.array(ids, np.uint64)
    assert (tokens.unpack(tokens.pack(x)) == x).all() and len(tokens.unpack(tokens.pack(x))) == len(x)


def test_tokens(docs, rows, empty):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    known = Tokenizer.from_file(path)
    more = [(20, "Don't <|endoftext|> <|ENDOFTEXT|> a.b, c.. d.\x1fe f İΣ ﬁ é."), (21, "x" * 5000), (22, "日本語 мир 1234,5.")]
    both = docs.select("doc_id", "text").unionAll(docs.sparkSession.createDataFrame(more, "doc_id long, text string"))
    got = [tuple(r) for r in tokens.token_table(both, path).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    start, want = 0, []
    for i, t in sorted([*rows, *more], key=lambda x: (x[0] is not None, x[0])):
        ids = np.array([*known.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert tokens.token_table(empty, path).count() == 0


def test_toxicity_learns_subwords():
    r = random.Random(2)
    bad = ["idiotic", "moronic", "wretched"]
    texts, labels = [], []
    for i in range(1600):
        w = prose(r.randint(30, 200), r).split()
        if i % 4 == 0:
            for k in range(r.randrange(30), len(w), 30):  # about as dense as in the labelled tables
                w[k] = r.choice(bad)
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    m = toxicity.train(texts[:1400], labels[:1400])
    scorer = toxicity.Scorer(m.effect, m.offset, m.passage, m.prior)
    p = np.array(scorer.scores(texts[1400:]))
    y = np.array(labels[1400:])
    assert ((p >= 0.3) == (y == 1)).mean() > 0.95
    seen, other = scorer.scores([f"{prose(20)} idiotik {prose(20)}", prose(40)])
    assert seen > other
    assert scorer.scores([None, "", " "]) == [m.prior] * 3
    assert toxicity.train([], []).effect.shape == (1 << 17,)


def test_toxicity_never_learns_held_out(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 12)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    flags = {r["doc_id"]: r["h"] for r in docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()}
    assert flags[1] == (zlib.crc32(b"1") % 4 == 2)
    assert toxicity.scored(empty, toxicity.fit(empty, labels)).count() == 0


def test_nearest(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=(600, 16))
    x[10:40] = x[10]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [None] * 16), (1200, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 50 = 0 or vec_id = 10"), k=5, shard_rows=200).collect()
    n = np.sqrt((x * x).sum(1))
    hit = 0
    for q in [*range(0, 600, 50), 10]:
        s = (x * x[q]).sum(1) / (n * n[q])
        s[q] = -9
        best = np.lexsort((np.arange(600), -s))[:5]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert len(mine) == 5 and all(abs(r["score"] - s[r["vec_id"]]) < 1e-12 for r in mine)
        hit += len({r["vec_id"] for r in mine} & set(best.tolist()))
        if q == 10:
            assert [r["vec_id"] for r in mine] == [11, 12, 13, 14, 15]
    assert hit >= 0.9 * 65 and {r["query_id"] for r in got} == {*range(0, 600, 50), 10}
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0


def test_nearest_of_repeated_rows(spark):
    rows = [(0, [1.0, 0.0], 9.0), (0, [1.0, 0.0], 8.0), (1, [1.0, 0.5], 7.0), (1, [1.0, 0.5], 7.0), (1, [0.0, 1.0], 6.0), (2, [1.0, 0.1], 5.0), (None, [1.0, 0.0], 4.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")
    got = sorted(tuple(r)[:3] for r in ann.nearest(df, df.where("vec_id = 0")).collect())
    assert got == sorted([(0, i, v) for i, v in enumerate([0, 2, 1, 1, 1], 1)] * 2)
    got = sorted(tuple(r)[1:3] for r in ann.nearest(df, df.where("vec_id = 2"), k=9).collect())
    assert got == list(enumerate([0, 0, 1, 1, 1], 1))


@pytest.mark.parametrize("rows", [2000, 6000])
def test_nearest_probes_few_rows(spark, rows):
    g = np.random.default_rng(6)
    x = g.normal(size=(rows, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    ask = df.where("vec_id % 50 = 0")
    found = ann.search(df, ask, shard_rows=3000).select("query_id", "probed").distinct()
    assert found.agg(F.avg("probed")).first()[0] < 0.23
    u = x / np.sqrt((x * x).sum(1))[:, None]
    s = u[::50] @ u.T
    s[np.arange(len(s)), np.arange(0, rows, 50)] = -9
    best = {(i * 50, int(v)) for i, row in enumerate(np.argsort(-s, axis=1)[:, :5]) for v in row}
    got = {(r["query_id"], r["vec_id"]) for r in ann.nearest(df, ask, shard_rows=3000).collect()}
    assert len(best & got) >= 0.9 * len(best)


def test_chat_repair_is_cheapest():
    r = random.Random(7)

    def cost(codes, plan, closing):
        return sum((chat.MERGE_COST if m else 0) + (0 if s == c else chat.RELABEL_COST if c else chat.UNKNOWN_COST) + chat.EMPTY_COST * len(e) for c, (s, e, m) in zip(codes, plan, strict=True)) + closing

    def brute(codes, state=chat.START):
        if not codes:
            return chat.CLOSING[state]
        return min(m[0] + brute(codes[1:], m[1]) for m in chat.MOVES[state, codes[0]])

    for _ in range(200):
        codes = [r.randint(0, 3) for _ in range(r.randint(1, 6))]
        plan = chat.repair(codes)
        assert cost(codes, plan, chat.CLOSING[plan[-1][0]]) == brute(codes)


def test_chat_in_pieces(spark):
    r = random.Random(8)
    rows = [(c, t, r.choice(["user", "Assistant", "system", None, "tool"]), None if t == 3 else f"t{t}") for c in (1, 2, None) for t in range(r.randint(5, 40))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    def total(piece):
        out = chat.repaired(df, piece=piece).collect()
        price = {"keep": 0, "merge": chat.MERGE_COST, "relabel": 0}
        assert len(out) == len(rows)
        said = {(a, b): chat.code_of(x) for a, b, x, _ in rows}
        return sum(price[o["action"]] + (0 if chat.ROLES.index(o["role"]) + 1 == (c := said[o["conv_id"], o["turn"]]) else 2 if c else 1) + 3 * (len(o["inserted"]) + len(o["closing"])) for o in out)

    assert total(3) == total(1000)
    assert chat.rendered(chat.repaired(df.limit(0))).count() == 0


def test_lm_scores(spark, docs, empty):
    target = spark.createDataFrame([(1,), (2,), (None,)], "doc_id long")
    got = {r["doc_id"]: (r["n_words"], r["score"]) for r in lmscore.scores(docs, target).collect()}
    assert len(got) == 13 and got[4] == (0, 0.0) and got[1] == got[2] and got[1][1] > got[11][1]
    assert lmscore.scores(empty, target).count() == 0


def test_lm_scores_count_all_words_and_bigrams(spark):
    r = random.Random(12)
    many = [(i, " ".join(r.choice(WORDS) if r.random() < 0.5 else f"rare{r.randrange(60_000)}" for _ in range(r.randint(0, 900)))) for i in range(300)]
    good = set(range(0, 300, 5))
    texts = {i: t.split() for i, t in many}
    uni, bi, ctx = ([{}, {}] for _ in range(3))
    for i, w in texts.items():
        for k in [0, 1] if i in good else [0]:
            for v, x in zip(["", *w], w, strict=False):
                uni[k][x] = uni[k].get(x, 0) + 1
                bi[k][v, x] = bi[k].get((v, x), 0) + 1
                ctx[k][v] = ctx[k].get(v, 0) + 1
    assert len(uni[0]) > 1 << 15
    total, v_size = [sum(u.values()) for u in uni], len(uni[0]) + 1
    scale = [total[1] / total[0], 1.0]

    def p(k, v, x):
        m = scale[k]
        word = (uni[k].get(x, 0) * m + 0.5) / (total[k] * m + 0.5 * v_size)
        return (bi[k].get((v, x), 0) * m + 20 * word) / (ctx[k].get(v, 0) * m + 20)

    got = {x["doc_id"]: (x["n_words"], x["score"]) for x in lmscore.scores(spark.createDataFrame(many, "doc_id long, text string"), spark.createDataFrame([(i,) for i in good], "doc_id long")).collect()}
    for i, w in texts.items():
        want = sum(np.log(p(1, v, x)) - np.log(p(0, v, x)) for v, x in zip(["", *w], w, strict=False)) / max(len(w), 1)
        assert got[i][0] == len(w) and abs(got[i][1] - want) < 1e-6, i


def test_lm_scores_do_not_depend_on_batches(spark):
    r = random.Random(13)
    many = [(i % 40 if i % 7 else None, prose(r.randint(0, 60), r) if i % 9 else None, i) for i in range(120)]
    df = spark.createDataFrame([(*m, *m[2:]) for m in many], "doc_id long, text string, score int, n_words int")
    good = spark.createDataFrame([(1,), (2,), (2,), (None,), (99,)], "doc_id long")
    whole, parts = ({x["doc_id"]: (x["n_words"], x["score"]) for x in lmscore.scores(df.repartition(k), good, batch_words=b).collect()} for k, b in ((1, 1 << 20), (5, 50)))
    assert whole.keys() == parts.keys() == {m[0] for m in many}
    assert all(whole[i][0] == parts[i][0] and abs(whole[i][1] - parts[i][1]) < 1e-9 for i in whole)
    same = spark.createDataFrame([(1, "a b a")] * 6 + [(2, "c")], "doc_id long, text string").repartition(7)
    assert {x["doc_id"]: x["n_words"] for x in lmscore.scores(same, good).collect()} == {1: 18, 2: 1}


@pytest.mark.parametrize("x", [[], [0], [0, 255, 256], [2**40, 1, 0], list(range(1000))])
def test_byte_planes_round_trip(x):
    assert common.from_planes(common.planes(np.array(x, np.int64)), len(x)).tolist() == x


def test_compact_windows_cover_every_run_once():
    h = np.random.default_rng(1).integers(0, 2**63, 60).astype(np.uint64)
    h[10] = h[30]
    for least in (1, 5, 20, 60, 61):
        wins = list(zip(*substring.compact_windows(h, least)[:3], strict=True))
        for i in range(60):
            for j in range(i + least - 1, 60):
                assert sum(a <= i <= c <= j <= b for a, c, b in wins) == 1


def classes_of(docs, **options):
    found = substring.repeated_passages(docs, **options)
    return substring.passage_classes(docs, found).collect()


def roots_of(names, links):
    """The least name reachable from each."""
    root = {n: n for n in names}
    for a, b in links:
        x, y = sorted((root[a], root[b]))
        root = {n: x if r == y else r for n, r in root.items()}
    return root


def test_repeated_passages(docs, rows, empty):
    got = classes_of(docs)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == {**{i: i for i, _ in rows}, 2: 1, 3: 1, 12: 1}
    assert {r["doc_id"]: (r["n_copies"], r["n_words"]) for r in got if r["doc_id"] in (1, 2, 4, 5, 8, 11)} == {1: (2, 120), 2: (2, 120), 4: (2, 0), 5: (2, 0), 8: (1, 0), 11: (1, 0)}
    assert classes_of(empty) == []


def test_joint_windows_cover_every_run_of_least():
    g = np.random.default_rng(2)
    for n in (9, 10, 60):
        h, k = (g.integers(0, 2**63, n).astype(np.uint64) for _ in range(2))
        wins = list(zip(*substring.joint_windows(h, k, 10), strict=True))
        for i in range(n - 9):
            c, d = i + int(np.argmin(h[i : i + 10])), i + int(np.argmin(k[i : i + 10]))
            assert sum((x, y) == (c, d) and lo <= i and i + 9 <= hi for lo, x, y, hi in wins) == 1


@pytest.mark.parametrize("options", [{}, {"block": 16}, {"block": 16, "known_classes": 0}])
def test_repeated_passages_of_overlapping_slices(spark, options):
    r = random.Random(9)
    text = [f"t{i}" for i in range(400)]  # no word twice
    spans = {}
    for i in r.sample(range(1000), 60):
        n = r.randint(50, 70)
        at = r.randrange(400 - n)
        spans[i] = (at, at + n)
    many = [(i, " ".join([*(f"o{i}x{k}" for k in range(30)), *text[lo:hi], *(f"e{i}x{k}" for k in range(30))]), "x", 1) for i, (lo, hi) in spans.items()]
    many += [(5000, many[0][1], "y", 2), (None, many[1][1], "z", 3)]
    got = classes_of(spark.createDataFrame(many, "doc_id long, text string, class_id string, doc int"), **options)
    want = roots_of(spans, [(a, b) for a, b in itertools.combinations(spans, 2) if min(spans[a][1], spans[b][1]) - max(spans[a][0], spans[b][0]) >= 50])
    want |= {5000: want[many[0][0]], None: want[many[1][0]]}
    assert {x["doc_id"]: x["class_id"] for x in got} == want and 3 < len(set(want.values())) < 40


def test_repeated_passages_of_near_copies(spark):
    r = random.Random(10)
    many, links, n = [], [], 0
    for family in range(40):
        base = [f"b{r.randrange(9000)}" for _ in range(120)]
        for _ in range(3):
            words = list(base)
            words[r.randrange(120)] = f"new{r.randrange(10**6)}"  # two words apart: 106 of 126 shingles are shared
            many.append((n, " ".join(words)))
            links += [(n, m) for m in range(n - n % 3, n)]
            n += 1
    got = {x["doc_id"]: x["class_id"] for x in classes_of(spark.createDataFrame(many, "doc_id long, text string"))}
    assert sum(got[a] == got[b] for a, b in links) >= 0.99 * len(links)
    assert all(a // 3 == b // 3 for a, b in got.items())


def test_pipeline_drops_near_copies_like_brute_force(spark):
    import corpus_pipeline

    r = random.Random(11)
    many = [(None, "blank or not"), (1, ""), (2, None), (3, "one two"), (4, "One  TWO")]
    for family in range(12):
        base = [f"v{r.randrange(5000)}" for _ in range(r.randint(60, 400))]
        for _ in range(8):
            words = list(base)
            for k in r.sample(range(len(words)), max(1, len(words) // r.choice([30, 45, 60, 90]))):
                words[k] = f"new{r.randrange(10**6)}"
            many.append((len(many) + 1, " ".join(words)))
    sets = [{tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if (w := lower(t or "").split()) else set() for _, t in many]
    root = list(range(len(many)))
    for a, b in itertools.combinations(range(len(many)), 2):
        if (not sets[a] and not sets[b]) or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0:
            x, y = sorted((root[a], root[b]))
            root = [x if v == y else v for v in root]
    want = sorted((many[i][0] for i in {*root}), key=str)
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(many, "doc_id long, text string"), "")
    assert sorted((x["doc_id"] for x in got.collect()), key=str) == want
    assert len(want) < len(many) - 20
    assert nearcopies.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shared_run_inside_texts_that_differ():
    rng = np.random.default_rng(5)
    x, other = (rng.integers(0, 1 << 60, 400).astype(np.uint64) for _ in range(2))
    y = x.copy()
    apart = [i for i in range(0, 400, 7) if not 100 <= i < 160]
    y[apart] = other[apart]
    found = substring.alike(x, y, 46, 0.8)
    assert any(i <= 100 and j >= 159 and i == k and j == m and same >= 0.8 for i, j, k, m, same in found)


def edited(words, r):
    at, words = r.randrange(len(words)), list(words)
    kind = r.randrange(3)
    words[at : at + (kind != 1)] = [f"new{r.randrange(10**6)}"] * (kind != 2)
    return words


def ends_shared(x, y):
    """x and y from the first to the last token that both have."""
    one, two = np.flatnonzero(np.isin(x, y)), np.flatnonzero(np.isin(y, x))
    return x[one[0] : one[-1] + 1], y[two[0] : two[-1] + 1]


def test_alike_finds_edits_at_every_place():
    r, seen = random.Random(12), 0
    for n in [*range(50, 70), 90, 130, 204]:
        for at in range(n):
            words = [f"b{r.randrange(10**7)}" for _ in range(n)]
            for other in ([*words[:at], "new", *words[at + 1 :]], [*words[:at], "new", *words[at:]], [*words[:at], *words[at + 1 :]], edited(edited(words, r), r)):
                x, y = ends_shared(*(substring.shingles(" ".join(w)) for w in (words, other)))
                if min(len(x), len(y)) >= 46 and substring.jaccard(x, y) >= 0.8:
                    around = [np.random.default_rng(at).integers(0, 1 << 60, 40).astype(np.uint64) for _ in range(4)]
                    seen += 1
                    assert substring.alike(np.concatenate([around[0], x, around[1]]), np.concatenate([around[2] + np.uint64(7), y, around[3] + np.uint64(7)]), 46, 0.8), (n, at)
    assert seen > 4000


def test_alike_of_repeats_and_other_orders():
    t = np.arange(1, 200, dtype=np.uint64)
    assert substring.alike(np.tile(t[:9], 12), np.tile(t[:9], 10), 46, 0.8)
    assert substring.alike(np.concatenate([t[:60], t[60:120]]), np.concatenate([t[60:120], t[:60]]), 46, 0.8)
    assert substring.alike(t[:100], t[100:], 46, 0.8) == substring.alike(t[:45], t[:45], 46, 0.8) == substring.alike(t[:0], t, 46, 0.8) == []


def test_edited_passages_are_found_end_to_end(spark):
    r, rows, pairs = random.Random(13), [], []
    while len(pairs) < 300:
        words = [f"b{r.randrange(10**7)}" for _ in range(r.choice([51, 54, 60, 80, 120, 204]))]
        other = edited(words, r) if len(words) < 90 else edited(edited(words, r), r)
        x, y = ends_shared(*(substring.shingles(" ".join(w)) for w in (words, other)))
        if min(len(x), len(y)) < 46 or substring.jaccard(x, y) < 0.8:
            continue
        ids = len(rows), len(rows) + 1
        rows += [(i, " ".join([*(f"p{i}x{k}" for k in range(r.randrange(60))), *w, *(f"q{i}x{k}" for k in range(r.randrange(60)))])) for i, w in zip(ids, (words, other), strict=True)]
        pairs.append(ids)
    got = {x["doc_id"]: x["class_id"] for x in classes_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.97 * len(pairs)
    assert all(c in (d, d - 1) for d, c in got.items())


def test_windows_around_a_shared_line_make_no_pairs():
    rng = np.random.default_rng(3)
    wide = rng.integers(1, 2**32, (3000, 107)).astype(np.uint32)
    wide[:, 40:70] = np.arange(30)  # a line that all share
    wide[5] = wide[900]
    task = np.repeat([1, 2, 3], 1000)
    task[2995:] = 4
    keep = substring._may_meet(task, wide, 46, 37)
    assert set(np.flatnonzero(keep)) == {5, 900, *range(2995, 3000)}
    assert substring._may_meet(task[:0], wide[:0], 46, 37).shape == (0,)


def test_a_text_that_repeats_itself_is_one_window_of_a_key(spark):
    r = random.Random(14)
    phrase = [[f"p{k}w{i}" for i in range(k + 1)] for k in range(3)]
    spans = [(k % 3, 40 if k < 6 else 70 + k) for k in range(30)]  # the first six are too short to be alike
    rows = []
    for i, (k, n) in enumerate(spans):
        around = [[f"{side}{i}x{r.randrange(10**6)}" for _ in range(60)] for side in "ab"]
        rows.append((i, " ".join([*around[0], *(phrase[k] * n)[:n], *around[1]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chunks = substring.shared(substring.windows(substring.texts_of(docs).select("doc", "text"), 4, 46, 8), 8, 4096)
    opened = [tuple(x) for x in substring.open_windows(chunks, None, 46).select("key", "doc").collect()]
    assert opened and len(opened) == len(set(opened))
    got = {x["doc_id"]: x["class_id"] for x in classes_of(docs)}
    assert got == {i: i if n == 40 else 6 + k for i, (k, n) in enumerate(spans)}


def test_repeated_windows_meet_across_classes_only():
    g = np.random.default_rng(7)
    lengths = [200, 150, 90, 60, 120]
    tokens = [np.concatenate([g.integers(100, 2**32, 53), np.full(n, 7), g.integers(100, 2**32, 53)]).astype(np.uint32) for n in lengths]
    tokens[3][53:113:2] = g.integers(100, 2**32, 30)  # no run of it is like the others
    x = np.array([[1, 1, 0, 5, doc, 0, 53, 52 + n, n + 105, root] for doc, (n, root) in enumerate(zip(lengths, [1, 1, 3, 4, 5], strict=True))], np.int64)
    x[3, 6:8] = 54, 112
    cuts = np.empty(5, object)
    cuts[:] = [t[max(c - 53, 0) : last + 54].tobytes() for t, c, last in zip(tokens, x[:, 6], x[:, 7], strict=True)]
    found = substring._of_repeats(x, cuts, 46, 8, 0.8)
    assert len(found) == 2 and {2, 4} <= set(found[:, :2].ravel().tolist()) and 3 not in found[:, :2]
    for a, b, a_from, a_to, b_from, b_to in found.tolist():
        assert substring.alike(tokens[a][a_from : a_to + 1], tokens[b][b_from : b_to + 1], 46, 0.8)
    assert len(substring._of_repeats(x[:2], cuts[:2], 46, 8, 0.8)) == 0


def test_equal_run_between_repeats_is_found():
    p, q = np.full(50, 3, np.uint64), np.full(60, 4, np.uint64)
    rest = np.arange(10, 14, dtype=np.uint64)
    assert any(j - i >= 45 and same == 1.0 for i, j, _, _, same in substring.alike(np.concatenate([p, rest, q]), np.concatenate([q, rest + 50, p]), 46, 0.8))


def test_a_family_of_near_misses_makes_no_table_of_pairs(spark, monkeypatch):
    r, made, write = random.Random(18), [], substring.staged
    base = [f"v{i}" for i in range(80)]
    texts = []
    for _ in range(120):
        at = set(r.sample(range(5, 75), r.choice([1, 3, 4, 5, 5, 5, 5, 5])))
        texts.append(" ".join(f"new{r.randrange(10**7)}" if i in at else w for i, w in enumerate(base)))

    def counted(df, label):
        out = write(df, label)
        if label == "passages":
            made.append(out.count())
        return out

    monkeypatch.setattr(substring, "staged", counted)
    got = {x["doc_id"]: x["class_id"] for x in classes_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))}
    tokens = [substring.shingles(t) for t in texts]
    want = roots_of(range(120), [(a, b) for a, b in itertools.combinations(range(120), 2) if substring.alike(tokens[a], tokens[b], 46, 0.8)])
    assert all(want[a] == want[b] for a, b in got.items()) and len(set(got.values())) <= len(set(want.values())) + 3
    assert 10 < len(set(want.values())) < 110
    assert len(made) == 2 and made[1] <= 120, made


def test_pairs_that_may_link_hold_all_that_alike_links():
    r, g, rows = random.Random(19), np.random.default_rng(19), []
    for _ in range(1200):
        n = r.randint(46, 110)
        x = g.integers(1, r.choice([40, 10**6, 10**6]), n).tolist()
        y = list(x)
        for _ in range(r.randint(0, 8)):
            at, m, kind = r.randrange(len(y)), r.randint(1, 6), r.randrange(4)
            y[at : at + m * (kind != 1)] = y[at : at + m][::-1] if kind == 3 else g.integers(1, 10**6, m * (kind != 2)).tolist()
        rows.append([np.pad(v[:n], (0, 120 - len(v[:n]))) for v in (x, y)])
    x, y = (np.array(v, np.int64) for v in zip(*rows, strict=True))
    may = substring._may_link(x, y, 46, 0.8)
    alike = np.array([bool(substring.alike(*(v[v != 0].astype(np.uint64) for v in row), 46, 0.8)) for row in zip(x, y, strict=True)])
    assert not (alike & ~may).any() and 30 < (~may).sum() and 100 < alike.sum()


def test_substring_query_counts_whole_classes(spark, tmp_path):
    from signalfold.llm import queries

    a, b, c = ([f"{s}{i}" for i in range(60)] for s in "abc")
    rows = [(3, " ".join(a + b)), (4, " ".join(b + c)), (5, " ".join(c + a)), (6, " ".join(c + a)), (7, "few words"), (8, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_substring_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "class_id", "n_copies", "n_texts"]  # no count of compared pairs alone
    assert sorted(map(tuple, got.collect())) == [(3, 3, 1, 3), (4, 3, 1, 3), (5, 3, 2, 3), (6, 3, 2, 3), (7, 7, 1, 1), (8, 8, 1, 1)]


def test_texts_to_compare_reach_python_in_small_batches(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    before, write = spark.conf.get(name), nearcopies.staged
    monkeypatch.setattr(nearcopies, "staged", lambda df, label: seen.setdefault(label, int(spark.conf.get(name))) and write(df, label))
    words = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, "else")], "doc_id long, text string")
    assert {tuple(r) for r in nearcopies.near_copies(docs).collect()} == {(1, 1), (2, 1), (3, 3)}
    assert seen["sketches"] <= 256 and seen["links"] <= 64 and spark.conf.get(name) == before

    def sizes(batches):
        yield from (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())}) for b in batches)

    with common.small_batches(spark, 64):
        assert max(r["n"] for r in spark.range(1000).mapInArrow(sizes, "n long").collect()) <= 64


def test_near_copies_of_a_large_family_make_no_table_of_pairs(spark, monkeypatch):
    r, made, write = random.Random(15), {}, nearcopies.staged
    base = [f"v{i}" for i in range(200)]
    texts = [" ".join(f"new{r.randrange(10**7)}" if i in at else w for i, w in enumerate(base)) for at in (set(r.sample(range(200), r.choice([1, 2, 3, 4, 8, 8, 8, 8]))) for _ in range(200))]

    def counted(df, label):
        out = write(df, label)
        made[label] = max(out.count(), made.get(label, 0))
        return out

    monkeypatch.setattr(nearcopies, "staged", counted)
    got = dict(nearcopies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=32).collect())
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    want = roots_of(range(200), [(a, b) for a, b in itertools.combinations(range(200), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert got == want and len(set(want.values())) > 50
    assert made and max(n for label, n in made.items() if label.endswith(("pairs", "links"))) <= 10 * len(texts)


def test_near_copies_take_what_simhash_links_and_is_alike(spark):
    r, many = random.Random(18), []
    for family in range(16):
        words = [f"v{r.randrange(5000)}" for _ in range(2000)]
        other = list(words)
        other[r.randrange(2000)] = "new"
        many += [" ".join(words), " ".join(other)]
    many += ["few words here", "", None]
    near = [f for f in range(16) if (simhash.fingerprint(many[2 * f]) ^ simhash.fingerprint(many[2 * f + 1])).bit_count() <= 3]
    # one band of 256 min-hashes misses most of these pairs
    got = dict(nearcopies.near_copies(spark.createDataFrame(list(enumerate(many)), "doc_id long, text string"), bands=1, rows=256).collect())
    assert len(near) >= 8 and all(got[2 * f + 1] == 2 * f for f in near)
    assert all(root in (doc, doc - doc % 2) for doc, root in got.items() if doc < 32) and [got[k] for k in (32, 33, 34)] == [32, 33, 33]


def test_texts_of_a_band_meet_like_brute_force():
    g = np.random.default_rng(16)
    sets = [np.unique(np.concatenate([np.arange(100)[g.random(100) < 0.93], g.integers(1000, 2**60, 5)])).astype(np.uint64) for _ in range(80)]
    root, own = np.array([i % 70 for i in range(80)]), np.arange(80) % 2
    for same in (True, False):
        want = [(i, j) for i, j in itertools.combinations(range(80), 2) if (same or own[i] != own[j]) and substring.jaccard(sets[i], sets[j]) >= 0.8]
        got = nearcopies.joining_links(own, same, root, sets, 0.8)
        chains = [(i, i + 70) for i in range(10)]
        assert {tuple(sorted(p)) for p in got} <= set(want) and len(got) < 80
        assert roots_of(range(80), want + chains) == roots_of(range(80), got + chains)


def test_needless_links_of_a_family_go_before_its_components(spark):
    r = random.Random(17)
    pairs = [tuple(r.sample(range(100 * f, 100 * f + 100), 2)) for f in range(3) for _ in range(4000)] + [(7, 7), (400, 401)]
    table = spark.createDataFrame(pairs, "a long, b long").repartition(4)
    kept = [tuple(x) for x in links.thinned(table).collect()]
    assert set(kept) <= set(pairs) and len(kept) <= 4 * 302
    nodes = {n for p in pairs for n in p}
    assert roots_of(nodes, kept) == roots_of(nodes, [(100 * f, n) for f in range(3) for n in range(100 * f, 100 * f + 100)] + [(400, 401)])
    assert links.thinned(table.limit(0)).count() == 0
