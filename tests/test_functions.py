import datetime as dt

import pytest
from pyspark.sql import functions as F

from signalfold.functions import dates, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.normalize_text, "  Ünïted—Société, S.A. ", "united societe s a"), (text.normalize_text, None, ""),
        (text.normalize_company_name, "The Blue Whale Co., Ltd.", "blue whale"), (text.normalize_company_name, "The Company", ""),
        (text.normalize_domain, "HTTPS://www.Firm.example:8080/a?b#c", "firm.example"), (text.normalize_domain, "x@mail.firm.example", "mail.firm.example"), (text.normalize_domain, "none", None),
        (text.domain_and_parents, "a.b.co", ["a.b.co", "b.co"]), (text.domain_and_parents, "local", []), (text.domain_and_parents, None, []),
        (text.to_int, "1,200", 1200), (text.to_int, "51-200", 51), (text.to_int, "10k", 10000), (text.to_int, "many", None),
        (text.is_valid_email, "a.b@c.example", True), (text.is_valid_email, "a@b", False), (text.is_valid_email, None, False),
        (text.is_generic_email, "hr2@firm.example", True), (text.is_generic_email, "sales.uk@firm.example", True), (text.is_generic_email, "ann@firm.example", False),
        (text.is_blank, " N/A ", True), (text.is_blank, None, True), (text.is_blank, "x", False),
        (text.strip_accents, "a\u0301 ﬁ Ǆ ½ x", "a fi DZ 1⁄2 x"), (text.is_personal_email, "x@yahoo.co.nz", True), (text.is_personal_email, "x@yahoo.fr", True), (text.is_personal_email, "x@yahoo.firm.example", False), (text.is_personal_email, "hotmail.com.br", True),
        (text.article, "HR lead", "an"), (text.article, "UX lead", "a"), (text.article, "hourly role", "an"), (text.article, "user", "a"), (text.article, ".NET team", "a"), (text.article, "engineer", "an"), (text.article, None, "a"),
        (text.pretty_stage, "pre_seed", "Pre-Seed"), (text.pretty_stage, "ipo", "IPO"), (text.pretty_stage, "Series c", "Series c"), (text.pretty_stage, "series_c", "Series C"),
        (text.strip_html, "&lt;p&gt;on&lt;b&gt;e&lt;/b&gt;&lt;/p&gt;two", "one two"), (text.word_count, "it's -- well-made, déjà vu", 4), (text.guess_kind, "a@b.example", "email"),
        (text.split_keywords, "A, b;a|C", ["A", "b", "C"]), (text.strip_html, "<p>a &amp; b</p><script>x</script>", "a & b"),
        (text.normalize_job_url, "http://www.X.example/jobs/1/?utm_source=q&b=2&a=1#top", "x.example/jobs/1?a=1&b=2"),
        (text.linkedin_key, "https://www.linkedin.com/in/Ann/?x=1", "linkedin.com/in/ann"), (text.guard_cell, "=1+1", "'=1+1"), (text.guard_cell, "a", "a"),
        (text.display_company_name, "Blue Whale, Inc.", "Blue Whale"), (text.mask_email, "ann@firm.example", "a**@firm.example"), (text.slugify, "A  b/C!", "a-b-c"),
        (text.normalize_email_status, "Not valid", "invalid"), (text.normalize_email_status, "catch-all", "risky"), (text.normalize_email_status, "Verified", "valid"), (text.normalize_email_status, None, "unknown"),
        (text.parse_amount, "$12M", 1.2e7), (text.parse_amount, "1.5 bn", 1.5e9), (text.parse_amount, "none", None), (text.group_reason, "old (3 of 5) 2024-01-02 job 7", "old job"),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


@pytest.mark.parametrize(("value", "want"), [(1.5e6, "$1.5M"), (2e9, "$2B"), (12000.0, "$12K"), (999.0, "$999")])
def test_money(spark, value, want):
    assert one(spark, value, text.format_money, "double") == want


@pytest.mark.parametrize(
    ("value", "order", "want"),
    [("2024-03-05", "dmy", dt.date(2024, 3, 5)), ("05/03/2024", "dmy", dt.date(2024, 3, 5)), ("05/03/2024", "mdy", dt.date(2024, 5, 3)), ("3 days ago", "dmy", dt.date(2024, 5, 29)), ("yesterday", "dmy", dt.date(2024, 5, 31)), ("1709596800", "dmy", dt.date(2024, 3, 5)), ("1709596800000", "dmy", dt.date(2024, 3, 5)), ("soon", "dmy", None), (None, "dmy", None)],
)
def test_dates(spark, value, order, want):
    assert one(spark, value, lambda c: dates.parse_when(c, F.lit("2024-06-01").cast("date"), order)) == want


@pytest.mark.parametrize(("value", "want"), [(12350.0, "$12.3K"), (12250.0, "$12.2K"), (12750.0, "$12.8K"), (999950.0, "$1000K"), (0.5, "$0.50")])
def test_money_rounds_the_exact_double(spark, value, want):
    assert one(spark, value, text.format_money, "double") == want


def test_age_stays_null(spark):
    assert one(spark, None, lambda c: dates.age_days(c, c, F.lit("2024-06-01").cast("date")), "date") is None


def test_lead_id_keeps_an_empty_contact_apart(spark):
    a, b = (one(spark, "f", lambda c, k=k: text.lead_id(F.lit("p"), c, F.lit(k).cast("string"))) for k in (None, "c"))
    assert a != b and len(a) == 16
