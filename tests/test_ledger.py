"""The delivery ledger: keys, runs and what is left out."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from signalfold.operators import ledger

DAY = dt.date(2026, 9, 24)
LEAD = "id int, client string, name string, domain string, linkedin_url string, email_domain string, signals array<struct<type string, title string, url string, external_id string>>, contact struct<email string, linkedin_url string, full_name string>"
DELIVERIES = "client string, kind string, key string, run_id string, delivered_at date"
RUNS = "client string, run_id string, delivered_at date, items long"
LIST = "client string, kind string, value string"


def lead(i, name="Acme Inc", domain="acme.com", signals=(), contact=None, client="c", page=None, hint=None):
    return (i, client, name, domain, page, hint, list(signals), contact)


def job(title, ext=None, url=None, kind="job_posting"):
    return (kind, title, url, ext)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DELIVERIES), spark.createDataFrame([], RUNS), spark.createDataFrame([], LIST)


def test_items_of_leads(spark):
    rows = [
        lead(1, signals=[job("Cook", "7"), job("Nurse", url="https://www.x.org/a/?utm_source=q&b=2&a=1#top"), job("Night  Nurse!")], contact=("A@acme.com ", "https://uk.linkedin.com/in/ann/?x=1", "Ann Lee")),
        lead(2, domain=None, signals=[job("Cook")], contact=("", None, "Bob")), lead(3, name=None, domain=None), lead(4, name="", domain="b.com", contact=(None, None, None)), lead(1, signals=[job("Cook", "7")]),
    ]
    got = {}
    for r in ledger.lead_items(spark.createDataFrame(rows, LEAD)).collect():
        got.setdefault(r["id"], set()).add((r["kind"], r["key"]))
    assert got[1] == {("company", "acme.com"), ("company_by_name", "name:acme"), ("job", "acme.com|7"), ("job_by_name", "name:acme|7"), ("job", "x.org/a?a=1&b=2"), ("job", "acme.com|job_posting:night nurse"), ("job_by_name", "name:acme|job_posting:night nurse"), ("contact", "a@acme.com"), ("contact", "linkedin.com/in/ann"), ("contact", "ann lee|acme.com"), ("contact_by_name", "ann lee|name:acme")}
    assert got[2] == {("company", "name:acme"), ("job", "name:acme|job_posting:cook"), ("contact", "bob|name:acme")}
    assert got.get(3) is None and got[4] == {("company", "b.com")}


def test_a_repeated_run_changes_nothing(spark, empty):
    deliveries, runs, _ = empty
    items = ledger.lead_items(spark.createDataFrame([lead(1, signals=[job("Cook", "7")]), lead(2, name="Beta", domain="b.com"), lead(3, client="d")], LEAD))
    rows = lambda df: sorted(map(tuple, df.collect()))
    first = ledger.record(deliveries, runs, items, "r1", F.lit(DAY))
    again = ledger.record(*first, items, "r1", F.lit(DAY))
    assert rows(again[0]) == rows(first[0]) and rows(again[1]) == rows(first[1])
    assert rows(first[1]) == [("c", "r1", DAY, 3), ("d", "r1", DAY, 1)]
    later = ledger.record(*first, items.where("id = 2"), "r2", F.lit(DAY + dt.timedelta(9)))
    assert {(r["key"], r["run_id"]) for r in later[0].where("client = 'c' AND kind = 'company'").collect()} == {("acme.com", "r1"), ("b.com", "r2")}
    assert [tuple(r) for r in ledger.clients_with_history(later[1]).collect()] == [("c", 2, 4, DAY + dt.timedelta(9)), ("d", 1, 1, DAY)]


def test_what_was_delivered_is_left_out(spark, empty):
    deliveries, runs, nothing = empty
    day = F.lit(DAY)
    first = spark.createDataFrame([lead(1, signals=[job("Cook", "7")], contact=("a@acme.com", None, "Ann Lee")), lead(2, name="Beta", domain=None, signals=[job("Cook")])], LEAD)
    deliveries, _ = ledger.record(deliveries, runs, ledger.lead_items(first), "r1", day)
    second = spark.createDataFrame([lead(1), lead(2, name="ACME", domain=""), lead(3, name="Beta", domain="beta.com"), lead(4, name="Acme", domain="acme.org"), lead(5, client="d"), lead(6, name="New", domain="new.com")], LEAD)
    reasons = lambda df: {r["id"]: r["reason"] for r in df.collect()}
    said = f"already delivered to this client ({DAY})"
    assert reasons(ledger.filter_companies(second, deliveries, nothing, day)) == {1: said, 2: said, 3: said, 4: None, 5: None, 6: None}
    late = F.lit(DAY + dt.timedelta(10))
    assert set(reasons(ledger.filter_companies(second, deliveries, nothing, late, 10)).values()) == {None}
    assert reasons(ledger.filter_companies(second, deliveries, nothing, late, 11))[1] == said
    work = spark.createDataFrame([lead(1, signals=[job("Cook", "7"), job("Baker", "8")]), lead(2, signals=[job("Cook", "7"), job("News", kind="news")]), lead(3, name="Beta", domain="beta.com", signals=[job("COOK")]), lead(4, signals=[])], LEAD)
    got = {r["id"]: ([s["title"] for s in r["signals"]], r["reason"]) for r in ledger.filter_companies(work, deliveries, nothing, day, dedupe=("job",)).collect()}
    assert got == {1: (["Baker"], None), 2: (["News"], "all its jobs were already delivered"), 3: ([], "all its jobs were already delivered"), 4: ([], None)}
    people = spark.createDataFrame([lead(1, contact=("A@ACME.com", None, "x")), lead(2, contact=("new@acme.com", None, "Ann Lee")), lead(3, domain=None, contact=(None, None, "ann  lee")), lead(4, domain="other.com", contact=(None, None, "Ann Lee")), lead(5)], LEAD)
    assert reasons(ledger.filter_contacts(people, deliveries, nothing, day)) == {1: (p := "contact already delivered to this client"), 2: p, 3: p, 4: None, 5: None}
    assert ledger.filter_companies(second.limit(0), deliveries, nothing, day).count() == ledger.filter_contacts(people.limit(0), deliveries, nothing, day).count() == 0


def test_do_not_list(spark, empty):
    deliveries, _, nothing = empty
    listed = spark.createDataFrame([("c", "domain", "big.org"), ("c", "company", "gone"), ("c", "linkedin", "https://de.linkedin.com/company/zed/about"), ("c", "email", "x@y.com"), ("d", "domain", "fine.com")], LIST)
    on = "on this client's do-not-list"
    rows = [lead(1, "A", "eu.big.org"), lead(2, "Gone Ltd", "g.com"), lead(3, "Zed", "z.com", page="linkedin.com/company/zed"), lead(4, "A", None, contact=("q@big.org", None, None)), lead(5, "A", "a.com", contact=("q@big.org", None, None)), lead(6, "A", "a.com", hint="big.org"), lead(7, "F", "fine.com"), lead(8, None, None), lead(9, "A", "a.com", contact=("X@y.com", None, None))]
    df = spark.createDataFrame(rows, LEAD)
    got = {r["id"]: r["reason"] for r in ledger.filter_companies(df, deliveries, listed, F.lit(DAY)).collect()}
    assert got == {1: f"{on} (domain)", 2: f"{on} (company name)", 3: f"{on} (LinkedIn)", 4: f"{on} (domain)", 5: None, 6: f"{on} (domain)", 7: None, 8: None, 9: None}
    got = {r["id"]: r["reason"] for r in ledger.filter_contacts(df, deliveries, listed, F.lit(DAY)).collect()}
    assert {i for i, r in got.items() if r} == {4, 5, 9} and got[5] == f"{on} (contact)"
