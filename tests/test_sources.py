import json

from pyspark.sql import functions as F

from signalfold.functions import matching
from signalfold.sources import boards, files, sinks


def ask(spark, column, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in rows.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_keywords(spark):
    words = ["CTO", "accountant", "IT", "e-commerce", "new", "Head of IT", "tax"]
    texts = ["director", "Senior Accountants wanted", "make it grow", "IT manager", "our ecommerce team", "e commerce", "news", "Éccomptant new", "rates and taxes", None, ""]
    assert ask(spark, lambda c: matching.keyword_match(c, words), texts) == [None, "accountant", None, "IT", "e-commerce", "e-commerce", None, "new", "tax", None, None]
    assert ask(spark, lambda c: matching.keyword_match(c, ["ecommerce"]), ["e com merce", "e c om merce", "ecommerces"]) == ["ecommerce", None, "ecommerce"]
    assert ask(spark, lambda c: matching.keyword_match(c, []), ["x"]) == [None]


def test_titles(spark):
    pairs = {
        ("VP of Finance", "Vice President, Finance"): True, ("Ex-CEO", "CEO"): False, ("Founder's Associate", "Founder"): False,
        ("Finance Director", "Director of Finance"): True, ("Deputy CFO", "CFO"): False, ("Chief of Staff to the CEO", "CEO"): False,
        ("Sr. Mgr Ops", "Operations Manager"): True, ("CEO Office Manager", "CEO"): False, ("Head of Sales at CEO Corp", "CEO"): False,
        ("Co-Founder", "cofounder"): True, ("Chief Executive", "CEO"): True,
    }
    for (title, wanted), hit in pairs.items():
        assert ask(spark, lambda c, w=wanted: matching.title_matches(c, w), [title]) == [hit], title
    rank = lambda c: matching.title_rank(c, ["CEO", "CFO"], ["intern"])
    assert ask(spark, rank, ["Chief Financial Officer", "CEO and CFO", "CEO intern", "Cook", "", None]) == [1, 0, None, None, None, None]


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('Name;Name;;"A;b"\n\n x ;"two\nlines";3\n;;;\ny,1;2;3;"say ""hi"""\n')
    got = files.read_csv(spark, str(p))
    assert got.columns == ["Name", "Name (2)", "column_3", "A;b"]
    assert sorted(map(tuple, got.collect())) == [("x", "two\nlines", "3", ""), ("y,1", "2", "3", 'say "hi"')]
    p.write_bytes("Stadt,Land\nKöln,5 €\n".encode("cp1252"))
    assert files.read_csv(spark, str(p)).collect()[0] == ("Köln", "5 €")
    p.write_text("made by hand\n\nName\tCity\nx\ty\n")
    assert [tuple(r) for r in files.read_csv(spark, str(p), skip_rows=1).collect()] == [("x", "y")]
    p.write_text("")
    assert files.read_csv(spark, str(p)).columns == []


def test_json(spark, tmp_path):
    read = lambda **kw: sorted(json.loads(r.record)["a"] for r in files.read_json(spark, str(p), **kw).collect())
    p = tmp_path / "a.json"
    for text in ('[{"a":1},{"a":2},3]', '{"items":[{"a":1},{"a":2}]}', '{"a":1}\n\n[{"a":2}]\n'):
        p.write_text(text)
        assert read() == [1, 2], text
    p.write_text('{"x":{"y":[{"a":1}]},"a":5}')
    assert read(records_path="x.y") == [1] and read() == [5]
    p = tmp_path / "a.jsonl"
    p.write_text('{"a":1}\n{"a": 2}\n'.replace(" ", ""))
    assert read() == [1, 2]
    p.write_text('{"a":1}\n{bad\n')
    try:
        read()
    except Exception as e:
        assert "not valid JSON" in str(e)
    else:
        raise AssertionError("a bad line passed")


def test_boards(spark):
    body = {
        "greenhouse": {"jobs": [{"id": 1, "title": "T", "absolute_url": "u", "updated_at": "2026-01-02", "location": {"name": "Oslo"}, "departments": [{"name": "A"}, {"name": "B"}, {}]}]},
        "lever": [{"id": "1", "text": "T", "applyUrl": "u", "createdAt": 1767312000000, "categories": {"allLocations": ["Oslo", "Rome"]}}],
        "ashby": {"jobs": [{"id": "1", "title": "T", "jobUrl": "u", "location": "", "address": {"postalAddress": {"addressLocality": "Oslo", "addressCountry": "NO"}}}, {"id": 2, "isListed": False}]},
    }
    places = {"greenhouse": ("Oslo", "A, B"), "lever": ("Oslo, Rome", None), "ashby": ("Oslo, NO", None)}
    for system, b in body.items():
        rows = spark.createDataFrame([("x", json.dumps(b)), ("y", None)], "board string, body string")
        (r,) = boards.jobs(rows, system).collect()
        assert (r.board, r.id, r.title, r.url) == ("x", "1", "T", "u") and (r.location, r.department) == places[system]
    assert boards.jobs(spark.createDataFrame([(json.dumps(body["lever"]),)], "body string"), "lever").first().date == "2026-01-02"
    found = spark.createDataFrame([("b", str(i), f"2026-01-0{i}", "t", "u") for i in (1, 2, 3, 3)], "board string, id string, date string, title string, url string")
    assert [r.id for r in boards.board_jobs(found, "board", 2).orderBy("place").collect()] == ["3", "2"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("=1+1", 1, "A@x.io"), ("b", 2, "a@x.io"), ("c", 3, "")], "t string, n int, email string")
    sinks.write_csv(rows, str(tmp_path / "out"), one_file=True)
    back = {r.n: r.t for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()}
    assert back["1"].startswith("'=") and back["2"] == "b"
    leads = rows.withColumn("messages", F.array(F.struct(F.lit("s").alias("subject"), F.lit("b").alias("body"))))
    (one,) = sinks.upload_rows(leads, 2, ["n"]).collect()
    assert (one.n, one.subject_1, one.body_2) == (1, "s", None)
