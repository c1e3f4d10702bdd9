"""Companies and people merged in order, against plain folds."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from signalfold.operators import leads, resolve
from signalfold.sources import mapping


def folded(rows):
    by_domain, by_name, domain_of, out = {}, {}, {}, {}
    for seq, name, domain in sorted(rows, key=lambda r: r[0]):
        at = by_domain.get(domain) if domain else None
        if at is None and name and name in by_name and (not domain or domain_of[by_name[name]] in (None, domain)):
            at = by_name[name]
        if at is None:
            at, domain_of[seq] = seq, domain or None
        domain_of[at] = domain_of[at] or domain or None
        if domain:
            by_domain.setdefault(domain, at)
        if name:
            by_name.setdefault(name, at)
        out[seq] = at
    return out


def test_blank_names_link_nothing_and_hot_pairs_fold_once(spark):
    r = random.Random(4)
    rows = [(i, r.choice([None, "", " ", "hot", f"n{r.randrange(40)}"]), r.choice([None, "", "hot.com", f"d{r.randrange(40)}.com"])) for i in range(1200)]
    clean = [(i, (n or "").strip() or None, d) for i, n, d in rows]
    got = {x["seq"]: x["key"] for x in resolve.merge_companies(spark.createDataFrame(rows, "seq long, name string, domain string")).collect()}
    assert got == folded(clean)
    assert resolve.merge_companies(spark.createDataFrame([], "seq long, name string, domain string")).count() == 0


def plain_people(rows):
    """The fold by comparing with all in order."""
    norm = lambda u: (u or "").strip().rstrip("/").lower().replace("http://", "https://").replace("://www.", "://")
    ok = lambda p: p["email"] and p["email_status"] != "invalid" and p["email"].split("@")[0] not in ("info", "sales")

    def same(a, b):
        if a["email"] and a["email"] == b["email"]:
            return True
        if norm(a["linkedin_url"]) and norm(b["linkedin_url"]):
            return norm(a["linkedin_url"]) == norm(b["linkedin_url"])
        if a["email"] and b["email"]:
            return False
        return bool(a["full_name"]) and a["full_name"].lower() == b["full_name"].lower()

    people, seen = {}, set()
    for r in sorted(rows, key=lambda r: r["seq"]):
        content = repr([(k, v) for k, v in r.items() if k != "seq"])
        if content in seen:
            continue
        seen.add(content)
        c = {k: ("" if v is None and k not in ("confidence",) else v) for k, v in r.items()}
        c["email_candidates"], c["data"] = list(r["email_candidates"] or []), dict(r["data"] or {})
        known = people.setdefault(c["company"], [])
        e = next((p for p in known if same(p, c)), None)
        if e is None:
            known.append(c)
            continue
        if c["email"] and c["email"] != e["email"]:
            if not e["email"] or (not ok(e) and ok(c)):
                e["email"], e["email_status"] = c["email"], c["email_status"]
            elif ok(c) and c["email"].split("@")[1] == e["email"].split("@")[1] and c["email"] not in e["email_candidates"]:
                e["email_candidates"].append(c["email"])
        for k in resolve.PLAIN:
            e[k] = e[k] or c[k]
        e["confidence"] = c["confidence"] if e["confidence"] is None else e["confidence"]
        for m in c["email_candidates"]:
            if m and m != e["email"] and m not in e["email_candidates"]:
                e["email_candidates"].append(m)
        e["data"] = c["data"] | e["data"]
    return [p for known in people.values() for p in known]


@pytest.mark.parametrize("seed", [1, 2])
def test_people_are_the_plain_fold(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(900):
        name = r.choice(["", f"Ann {r.randrange(6)}", f"ANN {r.randrange(6)}"])
        mail = r.choice(["", "", f"{r.choice(['info', 'a', 'b', 'c'])}{''}@{r.choice(['x', 'y'])}.com", f"p{r.randrange(30)}@x.com"])
        page = r.choice(["", "", f"http{r.choice(['', 's'])}://{r.choice(['www.', ''])}linkedin.com/in/{r.randrange(12)}{r.choice(['', '/'])}"])
        row = {"company": r.choice(["one", "two", "three", ""]), "seq": i, "email": mail, "email_status": r.choice(["valid", "invalid", "unknown"]), **{c: r.choice([None, "", f"{c}{r.randrange(3)}"]) for c in resolve.PLAIN}, "confidence": r.choice([None, 0.5]), "email_candidates": r.choice([None, [], [f"q{r.randrange(4)}@x.com"]]), "data": r.choice([None, {}, {"k": str(i % 3)}, {"j": "1", "k": "9"}])}
        rows.append(row | {"full_name": name, "linkedin_url": page})
    rows += [dict(rows[7], seq=2000 + i) for i in range(50)]
    df = spark.createDataFrame([tuple(x.values()) for x in rows], ", ".join(f"{k} {'long' if k == 'seq' else 'double' if k == 'confidence' else 'array<string>' if k == 'email_candidates' else 'map<string,string>' if k == 'data' else 'string'}" for k in rows[0]))
    key = lambda p: repr(sorted((k, sorted(v.items()) if isinstance(v, dict) else v) for k, v in p.items()))
    got = sorted(key(x.asDict()) for x in resolve.merged_people(df.repartition(5)).collect())
    assert got == sorted(map(key, plain_people(rows)))
    assert resolve.merged_people(df.limit(0)).count() == 0


def test_records_become_companies_with_all_fields(spark):
    schema = "seq long, company string, domain string, city string, keywords string, `job title` string, `job id` string, employees string"
    rows = [(1, "Acme Inc", None, None, "a, b", "Cook", "1", None), (2, "ACME", "acme.com", "Rome", "b,c", "COOK", "1", "5"), (3, "Other", "acme.com", "Bonn", None, "Cook", "2", "9"), (4, "acme", "acme.org", None, None, None, None, None), (5, "", "", "x", None, None, None, None)]
    records = mapping.mapped(spark.createDataFrame(rows, schema), "csv", F.lit(dt.date(2026, 9, 24)), keep=["seq"])
    companies, signals, contacts = resolve.merged_companies(records)
    got = {x["key"]: x for x in companies.collect()}
    assert {k: (x["name"], x["domain"], x["location"], x["keywords"], x["employees"], x["data"]) for k, x in got.items()} == {1: ("Acme Inc", "acme.com", "Rome", ["a", "b", "c"], 5, {"city": "Rome"}), 4: ("acme", "acme.org", "", [], None, {})}
    assert sorted((x["key"], x["seq"], x["title"], x["external_id"]) for x in signals.collect()) == [(1, 1, "Cook", "1"), (1, 3, "Cook", "2")]
    assert contacts.count() == 0


def test_recent_contact_grows_with_rows(spark):
    day = dt.date(2024, 3, 1)
    many = [(i, "" if i % 3 == 0 else "Busy@x.com " if i % 3 == 1 else f"m{i}@x.com", day) for i in range(3000)]
    table = spark.createDataFrame(many, "id long, email string, exported_at date")
    got = leads.recently_contacted(table, table, 5, F.lit(day))
    assert {r["id"] for r in got.collect()} == {i for i in range(3000) if i % 3 == 1}
    one = spark.createDataFrame([(9, "m2@x.com"), (2, "m2@x.com"), (1, None), (4, "")], "id long, email string")
    assert [r["id"] for r in leads.recently_contacted(one, table, 5, F.lit(day)).collect()] == [9]
    assert leads.recently_contacted(one, table, 0, F.lit(day)).count() == 0


def test_last_loss_of_a_day_counts(spark):
    day = dt.date(2024, 3, 1)
    rows = [(1, "a", "lost", "bounce", day), (2, "a", "lost", "no interest", day), (3, "b", "lost", "no", day), (4, "b", "lost", "Bounced", day), (5, "c", "won", "bounce", day)]
    events = spark.createDataFrame(rows, "id long, lead_id string, stage string, note string, at date")
    assert [r[0] for r in leads.lost_by_bounce(events).collect()] == ["b"]
