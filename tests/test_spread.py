"""Work that takes long for each row: it runs over all cores, once for each value, and not on whole texts in Python."""

import html
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from signalfold.functions import clean, matching, text
from signalfold.operators import contacts
from signalfold.sources import mapping

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["contact_candidates", "title_rank", "strip_html", "records_nested", "records_flat"])
def test_small_files_are_worked_on_by_all_cores(spark, name):
    assert entry.queries()[name](spark, SF).rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_rejections_are_worked_on_by_all_cores(spark):
    plan = entry.queries()["rejection_reasons"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {3 * spark.sparkContext.defaultParallelism}" in plan


def _times(df, mark):
    return df._jdf.queryExecution().optimizedPlan().toString().count(mark)


def test_values_are_computed_once(spark):
    names = spark.createDataFrame([("Ann", "Lee", "x.com")], "f string, n string, d string")
    assert _times(names.select(contacts.candidates(F.col("f"), F.col("n"), F.col("d"))), "[^)]*") <= 20  # strip_accents names its input five times
    titles = names.select(matching.title_rank(F.col("f"), ["Bolt, Large", "Widgets", "rod of blue"], ["gear"]))
    assert _times(titles, "possessive") <= 30


def test_mapping_computes_only_what_columns_give_and_a_website_once(spark):
    rows = spark.createDataFrame([("Acme", "https://acme.com/x", "Cook"), ("Other", "https://linkedin.com/company/o", "n/a")], "`Company Name` string, Website string, `Job Title` string")
    found = mapping.mapped(rows, "jobs", F.lit("2024-01-01").cast("date"))
    assert sorted((x["name"], x["domain"], x["website"], x["linkedin_url"], len(x["signals"]), x["contacts"]) for x in found.collect()) == [("Acme", "acme.com", "https://acme.com/x", "", 1, []), ("Other", "", "", "https://linkedin.com/company/o", 0, [])]
    assert _times(found, "unescapeHtml4") <= 6 and _times(found, "doctolib") <= 1


def test_cells_are_trimmed_of_all_white_space(spark):
    table = spark.createDataFrame([(i, chr(i)) for i in range(0x3100)], "i int, c string")
    assert {chr(x["i"]) for x in table.where(r"c rlike '(?U)\\s'").collect()} == set(clean.SPACES)
    cells = [None, "", " n/a\u2003", "\u3000Not Available\t", "\x85 not available x", "  x\n"]
    got = spark.createDataFrame(list(enumerate(cells)), "i int, c string").select("i", clean.as_text(F.col("c"), T.StringType()))
    assert dict(map(tuple, got.collect())) == {0: "", 1: "", 2: "", 3: "", 4: "not available x", 5: "x"}


def test_only_entities_pass_through_python(spark):
    r = random.Random(1)
    parts = ["&amp;", "&amp;lt;", "&lt", "&notit;", "&#39;", "&#x41", "&#0;", "&#x110000;", "&", "& ", "&&amp;", "&\U0001f600;", "&NewLine;", "\n", "&#10;", "x", " ", "é&eacute;", "&" + "ab" * 20 + ";", "&;", "&\r;"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(12)))) for i in range(400)] + [(900, ""), (901, None)]
    got = spark.createDataFrame(rows, "i int, t string").select("i", text.unescape(F.col("t")).alias("u"))
    assert dict(map(tuple, got.collect())) == {i: t and html.unescape(t) for i, t in rows}
    assert "regexp_extract_all" in next(x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "_unescaped" in x)
