import re
import unicodedata

import duckdb
import pytest

import __spark_entry__ as entry
from signalfold.plans import queries as base

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(base.ORACLE))
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(base.ORACLE[name])
    names = [d[0] for d in want.description]
    got = base.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    as_text = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert as_text(tuple(r) for r in got.select(names).collect()) == as_text(want.fetchall())


def test_strip_html_agrees_with_its_sql_on_damaged_pages(spark, tmp_path):
    pages = ["a = &quot Are", "&quota", "a &copy b", "&copya;", "&middotb", "&amp b", "&ampb", "a &am b", "&amp;quot b", "&quo;t", "&amp;&quot;&copy;&middot;", "<p>a&amp</p>&", "&amp", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert dict(map(tuple, base.QUERIES["strip_html"](spark, str(tmp_path)).collect())) == dict(con.execute(base.ORACLE["strip_html"]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_normalize_text_of_the_whole_table(spark):
    def plain(text):
        folded = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))
        return re.sub("[^a-z0-9]+", " ", folded.lower()).strip(" ")

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r["normal"] for r in base.QUERIES["normalize_text"](spark, SF).collect()}
    assert got == {d["doc_id"]: plain(d["text"]) for d in docs}
    assert "de" in {d["lang"] for d in docs}
