import datetime as dt

from pyspark.sql import functions as F

from signalfold.operators import fit, ranking, reports, resolve, scoring, signals, state


def test_merge_is_in_order(spark):
    rows = [(1, "a", None), (2, "a", "a.com"), (3, "a", "b.com"), (4, "c", "a.com"), (5, "c", None), (6, "d", None)]
    got = {r["seq"]: r["key"] for r in resolve.merge_companies(spark.createDataFrame(rows, "seq long, name string, domain string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 1, 6: 6}


def folded(rows):
    by_domain, by_name, domain_of, out = {}, {}, {}, {}
    for seq, name, domain in sorted(rows):
        at = by_domain.get(domain) if domain else None
        if at is None and name in by_name and (not domain or domain_of[by_name[name]] in (None, domain)):
            at = by_name[name]
        if at is None:
            at, domain_of[seq] = seq, domain
        domain_of[at] = domain_of[at] or domain
        if domain:
            by_domain.setdefault(domain, at)
        by_name.setdefault(name, at)
        out[seq] = at
    return out


def test_merge_over_long_chains_is_the_plain_fold(spark):
    short = [(1, "a", "d1"), (2, "b", "d1"), (3, "b", "d2"), (4, "c", "d2"), (5, "c", None)]
    assert folded(short)[5] == 3
    chain = [(100 + i, f"n{(i + 1) // 2:02d}", f"x{i // 2:02d}") for i in range(60)] + [(200 + i, f"n{i:02d}", None) for i in range(30)]
    like_query = [(1000 + k, f"name{k % 400}", f"e{k % 700}.com" if k % 3 else None) for k in range(1500)]
    rows = short + chain + like_query
    got = {r["seq"]: r["key"] for r in resolve.merge_companies(spark.createDataFrame(rows, "seq long, name string, domain string")).collect()}
    assert got == folded(rows)


def test_greedy_selection_counts_only_what_it_took(spark):
    rows = [("x", "A", "p", 1), ("x", "B", "p", 2), ("x", "B", "q", 3)]
    df = spark.createDataFrame(rows, "client string, company string, person string, pos long")
    got = {r["pos"] for r in ranking.select_greedy(df, "client", ["pos"], "company", ["person"], 10, df.schema).collect()}
    assert got == {1, 3}


def test_unknown_is_neither_pass_nor_fail(spark):
    df = spark.createDataFrame([(None,), (5,), (50,)], "n int")
    got = [r[0] for r in df.select(fit.size_fit(F.col("n"), 10, None)).collect()]
    assert got == [None, False, True]
    assert [r[0] for r in df.select(fit.reject_reason([(fit.size_fit(F.col("n"), 10, None), "size")])).collect()] == [None, "size", None]
    assert df.limit(1).select(scoring.fit_credit(fit.size_fit(F.lit(None).cast("int"), 1, 2))).first()[0] == 0.5


def test_total_rounds_half_to_even(spark):
    assert spark.range(1).select(scoring.total(F.lit(62.5))).first()[0] == 62


def test_observed_signals(spark):
    d = lambda n: dt.date(2024, 3, 1) + dt.timedelta(n)
    schema = "company_key string, fingerprint string, external_id string, posted_at date, first_seen date, reposted boolean, pos int"
    empty = spark.createDataFrame([], "company_key string, fingerprint string, external_id string, first_seen date, last_seen date")
    day = lambda n: F.lit(d(n)).cast("date")
    first = signals.observe(spark.createDataFrame([("a", "x", "1", d(0), None, False, 1), ("a", "x", "2", d(1), None, False, 2), ("a", "y", "", None, None, None, 3), ("b", "x", "1", d(9), None, False, 4)], schema), empty, day(2))
    got = {r["pos"]: (r["first_seen"], r["reposted"]) for r in first.collect()}
    assert got == {1: (d(0), False), 2: (d(1), False), 3: (d(2), False), 4: (d(2), False)}
    history = signals.history_after(first, empty, day(2))
    second = spark.createDataFrame([("a", "x", "1", d(6), None, False, 1), ("a", "x", "3", d(8), None, False, 2), ("a", "y", None, d(9), None, False, 3), ("b", "x", "1", d(9), None, False, 4), ("c", "x", "1", None, None, True, 5)], schema)
    got = {r["pos"]: (r["first_seen"], r["reposted"]) for r in signals.observe(second, history, day(10)).collect()}
    assert got == {1: (d(0), True), 2: (d(0), True), 3: (d(2), True), 4: (d(2), True), 5: (d(10), True)}
    later = {(r["company_key"], r["fingerprint"], r["external_id"]): (r["first_seen"], r["last_seen"]) for r in signals.history_after(signals.observe(second, history, day(10)), history, day(10)).collect()}
    assert later["a", "x", "1"] == (d(0), d(10)) and later["a", "x", "2"] == (d(1), d(2)) and later["a", "x", "3"] == (d(0), d(10))


def test_processed_signals_and_rejections(spark):
    d = lambda n: dt.date(2024, 3, 1) - dt.timedelta(n)
    columns = "company_key string, pos int, kind string, title string, description string, external_id string, url string, location string, posted_at date, first_seen date, reposted boolean"
    row = lambda c, i, kind, title, posted, desc=None, ext="": (c, i, kind, title, desc, ext, "u", "l", posted, None, False)
    rows = [row("a", 1, "Job ", "Night nurse", d(9)), row("a", 2, "job", "night NURSE", d(9)), row("a", 3, "job", "Cook", d(1), "with nurses"), row("a", 4, "news", "Opens", d(2)), row("b", 1, "job", "Cook", d(1)), row("b", 2, "job", "Nurse intern", d(1)), row("b", 3, "blog", "x", None), row("c", 1, "job", "Nurse", d(40)), row("c", 2, "job", "Nurse", None, ext="7")]
    history = spark.createDataFrame([], "company_key string, fingerprint string, external_id string, first_seen date, last_seen date")
    got = signals.process(spark.createDataFrame(rows, columns), history, F.lit(d(0)).cast("date"), ["job"], ["job", "news"], ["nurse"], ["intern"], max_age=30, keep_undated=False)
    assert {(r["company_key"], r["pos"]): (r["drop"], r["place"]) for r in got.collect()} == {("a", 1): (None, 2), ("a", 3): (None, 1), ("a", 4): (None, 3), ("b", 1): ("no match", None), ("b", 2): ("excluded", None), ("b", 3): ("type", None), ("c", 1): ("old", None), ("c", 2): ("undated", None)}
    why = signals.rejections(got, spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "company_key string"), ["job", "news"], ["nurse"], 30)
    assert {r["company_key"]: r["reason"] for r in why.collect()} == {
        "b": "no signal matching [nurse] in last 30 days (3 signals found: 1 of another type (blog); 1 excluded by keyword (intern); 1 not matching)",
        "c": "no signal matching [nurse] in last 30 days (2 signals found: 1 older than 30 days; 1 without a posting date)", "z": "no buying signal found",
    }


def test_upsert_and_stages(spark, tmp_path):
    table = state.StateTable(spark, f"file://{tmp_path}/leads", ["k"], "at")
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v string, at int")
    assert table.read() is None
    table.merge(rows(("a", "one", 1), ("b", "one", 1)))
    got = {r["k"]: r["v"] for r in table.merge(rows(("a", "two", 1), ("c", "two", 2))).collect()}
    assert got == {"a": "two", "b": "one", "c": "two"}
    events = spark.createDataFrame([("x", "exported", 1), ("x", "found", 2), ("y", "won", 1), ("y", "lost", 2)], "k string, s string, at int")
    assert {r["k"]: r["stage"] for r in state.forward_only(events, "k", "s", "at").collect()} == {"x": "exported", "y": "lost"}


def test_funnel_and_zeros(spark):
    got = reports.funnel(spark.createDataFrame([(0,), (1,), (1,)], "r int"), F.col("r"), ["a", "b", "c"]).collect()
    assert [(r["n"], r["rate"]) for r in got] == [(3, None), (2, 0.6667), (0, 0.0)]
    assert {r["s"]: r["n"] for r in reports.counts_with_zeros(spark.createDataFrame([("a",)], "s string"), "s", ["a", "b"]).collect()} == {"a": 1, "b": 0}
