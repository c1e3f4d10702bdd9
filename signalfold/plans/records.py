"""Registered queries of record mapping, ordered merging, places and rejection reasons, each with its SQL.

Orders play the rows of a job list, customers those of a nested export.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.replies import clean_reply
from ..operators import fit, ledger, resolve
from ..operators.places import Gazetteer
from ..sources.mapping import Mapper, mapped
from .common import query, t

AS_OF = "2001-08-01"


def day():
    return F.lit(AS_OF).cast("date")


def job_list(spark: SparkSession, sf_dir: str, keep: str | None = "seq") -> DataFrame:
    """Orders as a job list with the headers of an export: month before day, tags in titles."""
    o = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
    host = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), F.lit(".com"))
    cells = {
        "seq": F.col("o_orderkey"), "Company Name": F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")),
        "Website": F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("https://www."), host, F.lit("/jobs?x=1"))).when(F.col("o_orderkey") % 3 == 1, F.lit("https://linkedin.com/company/x")).otherwise("n/a"),
        "Industry": F.when(F.col("o_orderkey") % 2 == 0, F.col("c_mktsegment")).otherwise("-"), "# Employees": F.when(F.col("c_acctbal") > 0, F.concat(F.floor("c_acctbal").cast("string"), F.lit("-99999"))),
        "Job Title": F.concat(F.lit("<b>"), F.col("o_orderpriority"), F.lit("</b> &amp; more")), "Date Posted": F.date_format("o_orderdate", "MM/dd/yyyy"),
        "Latest Funding": F.concat(F.lit("series_"), F.lower("o_orderstatus")), "Job Description": F.col("o_comment") if "o_comment" in o.columns else F.lit("none"),
    }
    return o.select(*(c.alias(n) for n, c in cells.items()))


def job_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(job_list(spark, sf_dir), "jobs", day(), keep=["seq"])


RECORDS_SQL = """r AS (SELECT o_orderkey AS seq, c_name AS name, CASE WHEN o_orderkey % 3 = 0 THEN lower(replace(c_name, '#', '')) || '.com' ELSE '' END AS domain,
  CASE WHEN o_orderkey % 3 = 1 THEN 'https://linkedin.com/company/x' ELSE '' END AS linkedin_url, CASE WHEN o_orderkey % 2 = 0 THEN c_mktsegment ELSE '' END AS industry,
  CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal) AS INTEGER) END AS employees, o_orderpriority || ' & more' AS title, CAST(o_orderdate AS DATE) AS posted_at, 'Raised Series ' || o_orderstatus AS round
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query(f"WITH {RECORDS_SQL} SELECT * FROM r")
def records_flat(spark, sf_dir):
    s = lambda i: F.get("signals", F.lit(i))
    found = job_records(spark, sf_dir)
    return found.select("seq", "name", "domain", "linkedin_url", "industry", "employees", s(0)["title"].alias("title"), s(0)["posted_at"].alias("posted_at"), s(1)["title"].alias("round"))


@query("""SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'site' || c_custkey || '.io' ELSE '' END AS domain, c_mktsegment || '|' || n_name AS keywords,
  CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 2 END AS n_people, 'ann' || c_custkey || '@gmail.com' AS email, 'valid' AS status,
  'Balance ' || CAST(c_nationkey AS VARCHAR) || ' of ' || n_name AS signal FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def records_nested(spark, sf_dir):
    c = t(spark, sf_dir, "customer").join(F.broadcast(t(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows by definition
    k = F.col("c_custkey").cast("string")
    ann = F.struct(F.concat(F.lit("Ann Lee"), k).alias("name"), F.concat(F.lit("ANN"), k, F.lit("@gmail.com")).alias("email"), F.lit("Verified").alias("email_status"))
    bob = F.struct(F.when(F.col("c_custkey") % 5 == 0, " ").otherwise("Bob").alias("name"), F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("email_status"))
    firm = F.struct(F.struct(F.col("c_name").alias("label")).alias("title"), F.array("c_mktsegment", "n_name", F.lower("n_name")).alias("tags"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("http://site"), k, F.lit(".io"))).alias("site"))
    text = F.to_json(F.struct(firm.alias("firm"), F.array(ann, bob).alias("team"), F.col("c_nationkey").alias("score"), F.struct("n_name").alias("at")))
    mapper = Mapper({"name": ["firm.name", "firm.title"], "website": "firm.site", "keywords": "firm.tags"}, "export", day(), title="Balance {score} of {at.n_name} ({at.none})", requires=["score"], people={"path": "team"})
    found = mapper.companies(c.select(F.col("c_custkey").alias("id"), F.parse_json(text).alias("record")), "record", ["id"])
    one = F.get("contacts", F.lit(0))
    return found.select("id", "name", "domain", F.array_join("keywords", "|").alias("keywords"), F.size("contacts").alias("n_people"), one["email"].alias("email"), one["email_status"].alias("status"), F.get("signals", F.lit(0))["title"].alias("signal"))


@query(f"""WITH {RECORDS_SQL}, s AS (SELECT name, 'job' AS kind, title AS what FROM r UNION SELECT name, 'funding', round FROM r)
SELECT min(seq) AS key, r.name, max(domain) AS domain, max(linkedin_url) AS linkedin_url, max(industry) AS industry, max(employees) AS employees, (SELECT count(*) FROM s WHERE s.name = r.name) AS n_signals FROM r GROUP BY r.name""")
def companies_merged(spark, sf_dir):
    companies, signals, _ = resolve.merged_companies(job_records(spark, sf_dir))
    n = signals.groupBy("key").agg(F.count(F.lit(1)).alias("n_signals"))
    return companies.join(n, "key", "left").select("key", "name", "domain", "linkedin_url", "industry", "employees", F.coalesce("n_signals", F.lit(0).cast("long")).alias("n_signals"))


@query("""WITH p AS (SELECT c_nationkey AS company, o_orderkey AS seq, lower(replace(c_name, '#', '')) || '@x.com' AS email, CASE WHEN o_orderkey % 4 = 0 THEN c_mktsegment ELSE '' END AS phone, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END AS title
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT min(seq) AS seq, CAST(company AS VARCHAR) AS company, email, coalesce(max(phone), '') AS phone, coalesce(arg_min(title, seq) FILTER (WHERE title <> ''), '') AS title FROM p GROUP BY company, email""")
def people_merged(spark, sf_dir):
    o = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    none = F.lit(None).cast("string")
    cells = {
        "company": F.col("c_nationkey").cast("string"), "seq": F.col("o_orderkey"), "email": F.concat(F.replace("c_name", F.lit("#"), F.lit("")), F.lit("@X.com")), "email_status": F.lit("valid"),
        **{c: none for c in resolve.PLAIN}, "phone": F.when(F.col("o_orderkey") % 4 == 0, F.col("c_mktsegment")), "title": F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")),
        "confidence": F.lit(None).cast("double"), "email_candidates": F.array().cast("array<string>"), "data": F.create_map().cast("map<string,string>"),
    }
    return resolve.merged_people(o.select(*(c.alias(n) for n, c in cells.items()))).select("seq", "company", "email", "phone", "title")


EUROPE = "('FRANCE', 'GERMANY', 'UNITED KINGDOM')"


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN n_name IN {EUROPE} THEN 'Europe' WHEN n_name = 'BRAZIL' THEN 'BR' WHEN n_name IN ('CANADA', 'UNITED STATES') THEN 'North America' WHEN n_name = 'KENYA' THEN 'kenya' END AS place,
  c_custkey % 7 = 0 AS placeless, CASE WHEN n_name IN ('FRANCE', 'GERMANY', 'UNITED KINGDOM', 'BRAZIL', 'CANADA', 'UNITED STATES', 'INDIA', 'JAPAN') THEN lower(n_name) ELSE '' END AS country FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def places_matched(spark, sf_dir):
    c = t(spark, sf_dir, "customer").join(F.broadcast(t(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows by definition
    g, text = Gazetteer.default(), F.when(F.col("c_custkey") % 7 == 0, "Remote / multiple locations").otherwise(F.concat(F.lit("Plant 4, "), F.initcap("n_name")))
    rows = c.select("c_custkey", "n_name", text.alias("text"))
    return rows.select("c_custkey", g.match(["Europe", "BR", "North America", "kenya"], F.col("text")).alias("place"), g.is_placeless(F.col("text")).alias("placeless"), g.country_of(F.col("n_name")).alias("country"))


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 700 < 20 THEN 'domain d' || c_custkey % 700 || '.com is on the suppression list' WHEN c_custkey % 50 = 3 THEN 'company ' || c_name || ' is on the suppression list'
  WHEN c_custkey % 11 = 5 THEN 'excluded domain eu.big.org (under big.org)' WHEN c_name LIKE '%77' THEN 'company name ''' || c_name || ''' matches excluded pattern ''77$''' WHEN c_custkey % 11 = 6 THEN 'no website/domain (icp.require_domain is on)'
  WHEN c_mktsegment = 'MACHINERY' THEN 'excluded keyword ''machinery'' in industry' WHEN c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE') AND c_acctbal < 2000 THEN 'no ICP keyword [building, automobile, rich] in name, industry, keywords, description or signals'
  WHEN n_name = 'GERMANY' THEN 'excluded location ''DACH'' (Germany)' WHEN n_name NOT IN {EUROPE} THEN 'location not in ICP [Europe] (got: ' || CASE WHEN n_name IN ('UNITED STATES') THEN 'United States' ELSE array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END || ')'
  WHEN c_acctbal < 0 THEN 'size unknown (icp.unknown_passes is off)' WHEN c_acctbal > 9000 THEN 'too large (' || CAST(floor(c_acctbal) AS BIGINT) || ' employees, max 9000)'
  WHEN c_mktsegment = 'HOUSEHOLD' THEN 'industry not in ICP [building, automobile, furniture] (got: HOUSEHOLD)' END AS reason FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE floor(c_acctbal) <> 9000""")
def rejection_reasons(spark, sf_dir):
    c = t(spark, sf_dir, "customer").join(F.broadcast(t(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).where("floor(c_acctbal) <> 9000")  # 25 rows by definition
    k, low = F.col("c_custkey"), F.col("c_acctbal") < 2000
    domain = F.when(k % 700 < 20, F.concat(F.lit("d"), k % 700, F.lit(".com"))).when(k % 11 == 5, "eu.big.org").when(k % 11 == 6, "").otherwise("fine.com")
    rows = c.select(
        k.alias("company_key"), F.col("c_name").alias("name"), domain.alias("domain"), F.initcap("n_name").alias("location"), F.lit(None).cast("string").alias("country"), F.array().cast("array<string>").alias("signal_places"),
        F.when(F.col("c_acctbal") >= 0, F.floor("c_acctbal")).alias("employees"), F.col("c_mktsegment").alias("industry"), F.array().cast("array<string>").alias("keywords"), F.lit(None).cast("string").alias("description"),
        F.when(low, F.array()).otherwise(F.array(F.lit("A rich one"))).cast("array<string>").alias("signal_titles"),
    )
    names = rows.where("company_key % 50 = 3").select(F.lit("company").alias("kind"), F.lower(F.replace("name", F.lit("#"), F.lit(" "))).alias("value"))
    listed = spark.range(20).select(F.lit("domain").alias("kind"), F.concat(F.lit("d"), "id", F.lit(".com")).alias("value")).unionByName(names)
    wanted = fit.Profile(locations=["Europe"], exclude_locations=["DACH"], most_employees=9000, industries=["building", "automobile", "furniture"], keywords=["building", "automobile", "rich"], exclude_keywords=["machinery"], exclude_domains=["big.org"], exclude_name_patterns=["77$"], require_domain=True, unknown_passes=False)
    return fit.rejections(rows, wanted, listed).select(F.col("company_key").alias("c_custkey"), "reason")


@query("SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS written FROM conversations")
def replies_cleaned(spark, sf_dir):
    quoted = F.concat(F.col("text"), F.lit("\n\nOn Mon, 3 May 2021 at 10:00, Ann <ann@x.com>\nwrote:\n> "), F.col("text"), F.lit("\n-- \nAnn"))
    signed = F.concat(F.lit("<div>"), F.col("text"), F.lit("</div><div class='gmail_quote'>old "), F.col("text"), F.lit("</div>"))
    mail = F.when(F.col("turn") % 3 == 0, quoted).when(F.col("turn") % 3 == 1, signed).otherwise(F.concat(F.col("text"), F.lit("\r\n\r\nKind regards,\r\nAnn Lee\r\nSent from my phone")))
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", clean_reply(F.coalesce(mail, F.lit(""))).alias("written"))


def delivered_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as leads of three clients: half of them with a domain, each with a job and a contact."""
    c, k = t(spark, sf_dir, "customer"), F.col("c_custkey").cast("string")
    job = F.struct(F.lit("job_posting").alias("type"), F.col("c_mktsegment").alias("title"), F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("https://www.jobs.com/j/"), k, F.lit("/?utm_source=a&id="), k)).alias("url"), F.when(F.col("c_custkey") % 3 == 0, k).alias("external_id"))
    contact = F.struct(F.when(F.col("c_custkey") % 4 > 0, F.concat(F.lit("P"), k, F.lit("@mail.com"))).alias("email"), F.lit(None).cast("string").alias("linkedin_url"), F.concat(F.lit("Ann Lée "), k).alias("full_name"))
    none = F.lit(None).cast("string")
    return c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("c"), F.col("c_nationkey") % 3).alias("client"), F.concat("c_name", F.lit(" GmbH")).alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("http://www.d"), k, F.lit(".com/x"))).alias("domain"), none.alias("linkedin_url"), none.alias("email_domain"), F.array(job).alias("signals"), contact.alias("contact"))


ITEMS_SQL = """l AS (SELECT c_custkey AS id, 'c' || c_nationkey % 3 AS client, 'name:' || lower(replace(c_name, '#', ' ')) AS named, CASE WHEN c_custkey % 2 = 0 THEN 'd' || c_custkey || '.com' END AS host, lower(c_mktsegment) AS title FROM customer),
w AS (SELECT *, coalesce(host, named) AS own, 'ann lee ' || id AS person, CASE id % 3 WHEN 0 THEN '|' || id WHEN 2 THEN '|job_posting:' || title END AS rest FROM l),
i AS (SELECT client, id, 'company' AS kind, own AS key FROM w UNION ALL SELECT client, id, 'company_by_name', named FROM w WHERE host IS NOT NULL
  UNION ALL SELECT client, id, 'job', coalesce(own || rest, 'jobs.com/j/' || id || '?id=' || id) FROM w UNION ALL SELECT client, id, 'job_by_name', named || rest FROM w WHERE host IS NOT NULL AND rest IS NOT NULL
  UNION ALL SELECT client, id, 'contact', 'p' || id || '@mail.com' FROM w WHERE id % 4 > 0 UNION ALL SELECT client, id, 'contact', person || '|' || own FROM w UNION ALL SELECT client, id, 'contact_by_name', person || '|' || named FROM w WHERE host IS NOT NULL)"""


@query(f"WITH {ITEMS_SQL} SELECT client, id, kind, key FROM i")
def ledger_items(spark, sf_dir):
    return ledger.lead_items(delivered_leads(spark, sf_dir))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 70 < 5 AND c_custkey % 2 = 0 THEN 'on this client''s do-not-list (domain)' WHEN c_custkey % 5 = 0 THEN 'already delivered to this client (2001-07-20)' END AS reason,
  CASE WHEN c_custkey % 5 = 0 THEN 'contact already delivered to this client' END AS contact_reason FROM customer""")
def ledger_left_out(spark, sf_dir):
    """A second run finds companies of the first without their domains, and people without their addresses."""
    leads, void = delivered_leads(spark, sf_dir), spark.createDataFrame([], "client string, run_id string, delivered_at date, items long")
    first = ledger.lead_items(leads.where("id % 5 = 0"))
    before = spark.createDataFrame([], "client string, kind string, key string, run_id string, delivered_at date")
    deliveries, _ = ledger.record(before, void, first, "r1", F.lit("2001-07-20").cast("date"))
    k = F.col("id").cast("string")
    again = leads.withColumns({"domain": F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("domain")), "contact": F.struct(F.when(F.col("id") % 2 == 0, F.col("contact.email")).alias("email"), F.col("contact.linkedin_url").alias("linkedin_url"), F.col("contact.full_name").alias("full_name")), "email_domain": F.when((F.col("id") % 70 < 5) & (F.col("id") % 2 == 0), F.concat(F.lit("x.d"), k, F.lit(".com")))})
    banned = leads.where("id % 70 < 5 AND id % 2 = 0").select("client", F.lit("domain").alias("kind"), F.concat(F.lit("d"), k, F.lit(".com")).alias("value"))
    companies = ledger.filter_companies(again, deliveries, banned, day(), 30).select("id", "reason")
    people = ledger.filter_contacts(again, deliveries, banned, day(), 30).select("id", F.col("reason").alias("contact_reason"))
    return companies.join(people, "id")
