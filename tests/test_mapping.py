"""Records become companies: headers, paths, templates and whole records, flat and nested."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from signalfold.functions import clean
from signalfold.functions.dates import parse_when
from signalfold.sources import headers, mapping

AS_OF = dt.date(2026, 9, 24)


def one(spark, column, *values):
    """column of each value."""
    rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, " + ", ".join(f"c{k} string" for k in range(len(values[0]) if isinstance(values[0], tuple) else 1)))
    return [r["x"] for r in rows.select("i", column.alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(("names", "mode", "fields"), [
    ("Company,Domain,Location,Job Title,Job URL,Date Posted", "jobs", {"name": "Company", "domain": "Domain", "location": "Location", "signal_title": "Job Title", "signal_url": "Job URL", "signal_date": "Date Posted", "signal_location": "Location"}),
    ("company_name,FIRST NAME,Last-Name,Title,Email,LinkedIn URL,Company City,City", "people", {"name": "company_name", "first_name": "FIRST NAME", "last_name": "Last-Name", "title": "Title", "email": "Email", "person_linkedin_url": "LinkedIn URL", "city": "Company City", "person_city": "City"}),
    ("Account Name,# Employees,Website,LinkedIn,About,Total Funding", "companies", {"name": "Account Name", "employees": "# Employees", "website": "Website", "linkedin_url": "LinkedIn", "description": "About", "funding_total": "Total Funding"}),
    ("title,totalScore,reviewsCount,city,url", "companies", {"name": "title", "city": "city", "website": "url"}),
    ("Company,Email,Title,Job Title", "people", {"name": "Company", "email": "Email", "title": "Title", "signal_title": "Job Title"}),
    ("", "companies", {}),
])
def test_headers_are_detected(names, mode, fields):
    found = headers.detected(names.split(","))
    assert (found.mode, {k: v[0] for k, v in found.mapping.items()}) == (mode, fields)
    assert found.signal_type == ("job_posting" if "signal_title" in fields else None)


def test_field_names_and_overrides():
    names = {"Company": "name", "org_linkedin": "linkedin_url", "contact-email": "email", "person city": "person_city", "data.Fax": "data.Fax", "funding_round": "funding_stage"}
    assert {k: headers.canonical(k) for k in names} == names
    assert headers.canonical("name", people=True) == "full_name"
    for wrong in ("nam", "person_domain", "company_email", "data."):
        with pytest.raises(ValueError, match="unknown field"):
            headers.canonical(wrong)
    assert headers.resolved({"company": "company name", "email": ["E-Mail", "a.b"], "title": None}, ["Company Name", "e mail"]) == {"name": ["Company Name"], "email": ["e mail", "a.b"], "title": []}
    assert headers.merged({"name": "a", "city": "b"}, {"company": None}) == {"name": [], "city": ["b"]}


def test_dates(spark):
    known = {"2026-09-01": (2026, 9, 1), "2026-9-1": (2026, 9, 1), "9/5/2026": (2026, 5, 9), "9/20/2026 14:03": (2026, 9, 20), "Posted on 20/9/2026": (2026, 9, 20), "Posted 3 days ago": (2026, 9, 21), "30+ days ago": (2026, 8, 25), "2w ago": (2026, 9, 10), "a month ago": (2026, 8, 25), "36 hours ago": (2026, 9, 23), "5 mins ago": (2026, 9, 24), "1 yr. ago": (2025, 9, 24), "Yesterday": (2026, 9, 23), "just posted": (2026, 9, 24), "1790000000": (2026, 9, 21), "1790000000000": (2026, 9, 21), "Sep 3, 2026": (2026, 9, 3), "3 September 2026": (2026, 9, 3), "Thu, 03 Sep 2026 10:00:00 +0000": (2026, 9, 3), "2026-09-03T10:00:00Z": (2026, 9, 3), "2026/09/03": (2026, 9, 3)}
    assert one(spark, parse_when(F.col("c0"), F.lit(AS_OF)), *known) == [dt.date(*d) for d in known.values()]
    assert one(spark, parse_when(F.col("c0"), F.lit(AS_OF), "mdy"), "9/5/2026", "20/9/2026") == [dt.date(2026, 9, 5), dt.date(2026, 9, 20)]
    assert one(spark, parse_when(F.col("c0"), F.lit(AS_OF)), "soon", "", " ", None, "31/31/2026", "ago") == [None] * 6


def test_cells(spark):
    check = lambda f, pairs: one(spark, f(F.col("c0")), *pairs) == list(pairs.values())
    assert check(clean.clean_text, {"<p>A&amp;B</p><b>c</b>d": "A&B cd", "&lt;p&gt;x&lt;/p&gt;": "x", " a \n b ": "a b", "<script>x</script>y": "y"})
    assert check(clean.clean_domain, {"https://www.Acme.com/about": "acme.com", "[acme.com]": "acme.com", "linkedin.com/company/x": "", "https://booksy.com/en-us/123_salon": "", "calendly.com": "calendly.com", "a@b.co.uk": "b.co.uk", "nohost": ""})
    assert check(clean.clean_email, {"mailto:A@b.com": "a@b.com", "x@example.com": "", "a@b": "", "email_not_unlocked@b.com": ""})
    assert check(clean.clean_url, {" http://a.b/c?x=1&amp;y=2 ": "http://a.b/c?x=1&y=2", "a b.c": "", "none": ""})
    assert check(clean.email_status, {"Verified": "valid", "not valid": "invalid", "Validation pending": "unknown", "catch-all": "risky", "hard bounce": "invalid", "un-verified": "unknown", "Really valid": "valid", "": "unknown", "maybe": "unknown"})
    assert check(clean.registrable_name, {"www.tripadvisor.co.uk": "tripadvisor", "booksy.com": "booksy", "x": "x", "": ""})
    names = {("acme-demo.com", "Acme Corp"): True, ("bluedoordental.co.uk", "Blue Door Dental"): True, ("ibm.com", "International Business Machines"): True, ("mueller.de", "Müller GmbH"): True, ("sbcglobal.net", "Bob's HVAC"): False, ("x.com", "株式会社"): True}
    assert one(spark, clean.domain_matches_name(F.col("c0"), F.col("c1")), *names) == list(names.values())
    whole = {"Dr. Jane Doe": ("Jane", "Doe"), "Doe, Jane": ("Jane", "Doe"), "Jane Doe, PhD": ("Jane", "Doe"), "van der Berg, Anna": ("Anna", "van der Berg"), "Dr Doe": ("", "Doe"), "Cher": ("Cher", ""), "Jane (JJ) Doe Jr": ("Jane", "Doe"), "": ("", ""), "PhD": ("PhD", "")}
    assert [tuple(x) for x in one(spark, clean.split_full_name(F.col("c0")), *whole)] == list(whole.values())
    parts = {("Lena", "", "Lena Vogel"): ("Lena", "Vogel"), ("", "Vogel", "Lena Vogel"): ("Lena", "Vogel"), ("Lena", "", "Dr Lena Vogel"): ("Lena", "Vogel"), ("", "", "Doe, Jane"): ("Jane", "Doe"), ("A", "B", "C D"): ("A", "B"), ("", "Vogel", "Vogel"): ("", "Vogel")}
    assert [tuple(x) for x in one(spark, clean.name_parts(*map(F.col, ("c0", "c1", "c2"))), *parts)] == list(parts.values())


FLAT = [
    ("Acme Corp", "https://www.acme.com/jobs", "Berlin", "51-200", "Data <b>Engineer</b>", "9/20/2026", "https://x.y/1", "Series_A", "$12M", "n/a", "j1"),
    ("Beta", "booksy.com/en/12", "", "", "", "", "", "", "", "", ""),
    ("", "linkedin.com/company/c", "Rome", "10k", "x", "9/5/2026", "", "", "", "", ""),
    ("Gamma & Co", "", None, None, "CTO", "2 days ago", "bad url", "ipo", "", "8/30/2026", None),
]
FLAT_COLUMNS = ["Company Name", "Website", "Headquarters", "# Employees", "Job Title", "Date Posted", "Job URL", "Latest Funding", "Funding Amount", "Funding Date", "Job ID"]


def test_flat_records(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(FLAT)], "id int, " + ", ".join(f"`{c}` string" for c in FLAT_COLUMNS)).withColumn("signals", F.lit("clash")).withColumn("_host", F.lit("clash"))
    got = {r["id"]: r for r in mapping.mapped(df, "csv", F.lit(AS_OF), keep=["id"], overrides={"company": "Company Name"}).collect()}
    assert sorted(got) == [0, 1, 3]
    a, b, g = got[0], got[1], got[3]
    assert (a["name"], a["domain"], a["website"], a["location"], a["employees"]) == ("Acme Corp", "acme.com", "https://www.acme.com/jobs", "Berlin", 51)
    assert [(s["type"], s["title"], s["posted_at"], s["url"], s["external_id"]) for s in a["signals"]] == [("job_posting", "Data Engineer", dt.date(2026, 9, 20), "https://x.y/1", "j1"), ("funding", "Raised Series A ($12M)", None, "", "")]
    assert a["signals"][1]["data"] == {"stage": "Series A", "amount": "12000000"}
    assert (b["domain"], b["website"], b["data"], b["signals"]) == ("", "", {"listing_url": "booksy.com/en/12"}, [])
    assert [(s["title"], s["posted_at"]) for s in g["signals"]] == [("CTO", dt.date(2026, 9, 22)), ("Went public (IPO)", dt.date(2026, 8, 30))]
    assert mapping.mapped(df.limit(0), "csv", F.lit(AS_OF)).collect() == []


NESTED = [
    {"org": {"name": "Acme", "display.name": "no", "tags": ["a", "B", "b", ""], "site": None}, "score": 4.5, "reviews": 12, "team": [{"name": "Jane Doe", "email": "Jane@acme.com", "status": "Verified"}, {"name": " "}, {"name": "JANE DOE"}, {"email": "jane@acme.com"}]},
    {"org": {"name": "Bobs HVAC", "tags": "x, y|X"}, "team": {"name": "Bob", "email": "bob@sbcglobal.net", "role": "Owner"}, "score": None},
    {"org": {}, "team": [{"email": "x@northwind.io"}], "score": 3.0, "flag": True},
    {"org": {"name": True}, "score": 1},
    {},
]
MAPPER = {"name": ["org.title", "org.name"], "website": "org.site", "keywords": "org.tags", "data.score": "score", "data.flag": "flag"}
OPTIONS = {"title": "Rated {score:.1f} by {reviews} people ({missing})", "requires": ["score"], "default_signal": {"type": "List Entry", "title": "{name} is listed"}, "people": {"path": "team", "mapping": {"email_status": "status"}}, "defaults": {"signal_type": "review", "country": "DE"}}


def expect_nested(rows):
    got = {r["id"]: r for r in rows}
    assert sorted(got) == [0, 1, 2]
    a, b, c = got[0], got[1], got[2]
    assert (a["name"], a["domain"], a["country"], a["keywords"], a["data"]["score"]) == ("Acme", "acme.com", "DE", ["a", "B"], "4.5")
    assert [(p["first_name"], p["last_name"], p["email"], p["email_status"], p["data"]) for p in a["contacts"]] == [("Jane", "Doe", "jane@acme.com", "valid", {"email_status_raw": "Verified"}), ("JANE", "DOE", "", "unknown", {})]
    assert [(s["type"], s["title"]) for s in a["signals"]] == [("review", "Rated 4.5 by 12 people")]
    assert (b["name"], b["domain"], b["keywords"], [p["title"] for p in b["contacts"]]) == ("Bobs HVAC", "", ["x", "y"], ["Owner"])
    assert [(s["type"], s["title"]) for s in b["signals"]] == [("list_entry", "Bobs HVAC is listed")]
    assert (c["name"], c["domain"], c["data"], c["signals"][0]["title"]) == ("northwind.io", "northwind.io", {"score": "3"}, "Rated 3.0 by people")


def test_nested_records_of_variants(spark):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(NESTED)], "id int, text string").withColumn("record", F.parse_json("text"))
    expect_nested(mapping.Mapper(MAPPER, "json", F.lit(AS_OF), **OPTIONS).companies(df, "record", ["id"]).collect())


def test_nested_records_of_structs(spark):
    rows = [json.dumps({"id": i, **r, "team": [r["team"]] if isinstance(r.get("team"), dict) else r.get("team"), "org": {**r.get("org", {}), "name": n if isinstance(n := r.get("org", {}).get("name"), str) else None, "tags": t.replace("|", ",").split(",") if isinstance(t := r.get("org", {}).get("tags"), str) else t}}) for i, r in enumerate(NESTED)]
    schema = "id int, org struct<name string, tags array<string>, site string>, score double, reviews int, flag boolean, team array<struct<name string, email string, status string, role string>>"
    df = spark.createDataFrame([(r,) for r in rows], "text string").select(F.from_json("text", schema).alias("r")).select("r.*")
    expect_nested(mapping.Mapper(MAPPER, "json", F.lit(AS_OF), **OPTIONS).companies(df, keep=["id"]).collect())


def test_templates(spark):
    df = spark.createDataFrame([("a", None, "3.14159"), ("", "", "")], "x string, y string, n string")
    for pattern, want in {"{x} and {y}": ["a and", ""], "plain": ["plain", "plain"], "{n:.2f} ({y}) !": ["3.14!", ""], "{x.q}": ["", ""]}.items():
        assert [r[0] for r in df.select(mapping.template(pattern, mapping.Record.of(df), {})).collect()] == want
    with pytest.raises(ValueError):
        mapping.template("{x", mapping.Record.of(df), {})


def test_mapping_reads_only_its_columns(spark, tmp_path):
    path = str(tmp_path / "records.parquet")
    spark.createDataFrame([("Acme", "acme.com", "unused")], "company string, domain string, extra string").write.parquet(path)
    plan = mapping.mapped(spark.read.parquet(path), "csv", F.lit(AS_OF))._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "extra" not in plan.split("ReadSchema")[-1]
