"""Registered queries of the lead and contact operators, each with its SQL.

Customers play the leads, suppliers the contacts, events the follow-ups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contacts, leads, sequences, usage
from ..operators.components import spread
from .common import ORACLE, QUERIES, query, t  # noqa: F401

AS_OF, THEN = "2001-08-01", "2001-01-01"
STAGE_LIST = "[" + ", ".join(f"'{s}'" for s in (*leads.STAGES, leads.LOST)) + "]"
LEADS = f"""l AS (SELECT c_custkey AS id, 'p' || (c_custkey % 2) AS playbook, 'r' || (c_custkey % 5) AS run_id, 'k' || (c_custkey % 300) AS company_key,
  CASE WHEN c_custkey % 13 = 0 THEN '' ELSE 'u' || (c_custkey % 900) || '@d' || (c_custkey % 50) || '.example' END AS email, c_custkey * 37 % 101 AS score,
  CASE WHEN c_custkey * 37 % 101 >= 80 THEN 'hot' WHEN c_custkey * 37 % 101 >= 40 THEN 'normal' ELSE 'skip' END AS tier, {STAGE_LIST}[c_custkey * 7 % 11 + 1] AS stage,
  DATE '{THEN}' AS created_at, DATE '{THEN}' AS updated_at, CASE WHEN c_custkey % 4 = 0 THEN DATE '{AS_OF}' - CAST(c_custkey % 60 AS INT) END AS exported_at FROM customer)"""
LISTED = (("domain", "d7.example"), ("email", "u11@d11.example"), ("domain", "d9.example"))
LISTED_SQL = "s AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in LISTED) + ") v(kind, value))"
HIT = "EXISTS (SELECT 1 FROM s WHERE (kind = 'email' AND value = email) OR (kind = 'domain' AND value = regexp_extract(email, '@(.*)$', 1)))"
ENGAGED = """g AS (SELECT company_key, playbook, list_sort(list(DISTINCT CASE WHEN stage = 'lost' AND id % 2 = 0 THEN 'lost_bounce' ELSE stage END)) AS stages, max(exported_at) AS last_exported
  FROM l WHERE NOT (run_id = 'r3' AND exported_at IS NULL) GROUP BY 1, 2)"""
BLOCKED = f"""b AS (SELECT l.*, CASE WHEN email = '' THEN 'no deliverable email' WHEN list_has_any(coalesce(stages, []), ['replied', 'positive', 'booked', 'won', 'lost']) THEN 'company already engaged (replied / lost) - not re-contacted'
  WHEN {HIT} THEN 'suppressed' WHEN email LIKE '%@d3.example' THEN 'email at an excluded domain' WHEN exported_at IS NOT NULL THEN 'already handed over'
  WHEN EXISTS (SELECT 1 FROM l o WHERE o.email = l.email AND o.id <> l.id AND o.exported_at >= DATE '{AS_OF}' - 30) THEN 'contacted in the last 30 days'
  WHEN date_diff('day', last_exported, DATE '{AS_OF}') < 10 THEN 'company contacted ' || date_diff('day', last_exported, DATE '{AS_OF}') || 'd ago (cooldown 10d)' END AS blocked
  FROM l LEFT JOIN g USING (company_key, playbook))"""


def day(text: str):
    return F.lit(text).cast("date")


def lead_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    score = k * 37 % 101
    email = F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("u"), k % 900, F.lit("@d"), k % 50, F.lit(".example")))
    stage = F.get(F.array(*[F.lit(s) for s in (*leads.STAGES, leads.LOST)]), (k * 7 % 11).cast("int"))
    return t(spark, sf_dir, "customer").select(
        k.alias("id"), F.concat(F.lit("p"), k % 2).alias("playbook"), F.concat(F.lit("r"), k % 5).alias("run_id"), F.concat(F.lit("k"), k % 300).alias("company_key"), email.alias("email"), score.alias("score"),
        F.when(score >= 80, "hot").when(score >= 40, "normal").otherwise("skip").alias("tier"), stage.alias("stage"), day(THEN).alias("created_at"), day(THEN).alias("updated_at"),
        F.when(k % 4 == 0, F.date_sub(day(AS_OF), (k % 60).cast("int"))).alias("exported_at"),
    )


def loss_events(rows: DataFrame) -> DataFrame:
    note = F.when(F.col("id") % 2 == 0, "Hard Bounce").otherwise("said no")
    return rows.where("stage = 'lost'").select(F.col("id").alias("lead_id"), "stage", note.alias("note"), "updated_at").withColumnRenamed("updated_at", "at")


def listed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LISTED, "kind string, value string")


def blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lead_table(spark, sf_dir)
    asked = rows.withColumn("domain", F.lit(None).cast("string")).withColumn("email_ok", F.col("email") != "").withColumn("n_messages", F.col("id") % 6)
    return leads.block_reasons(asked, rows, loss_events(rows), listed(spark), day(AS_OF), "r3", 30, 10, F.col("email").endswith("@d3.example"))


RANKS = "list_position({0}, {1}) - 1"
NEW_STAGE = f"{STAGE_LIST}[id % 11 + 1]"


@query(f"""WITH {LEADS}, n AS (SELECT CASE WHEN id % 3 = 1 THEN id + 1000000 ELSE id END AS id, {NEW_STAGE} AS stage, score + 1 AS score FROM l WHERE id % 3 < 2),
  m AS (SELECT coalesce(n.id, l.id) AS id, coalesce(n.score, l.score) AS score, l.exported_at, l.stage AS old, coalesce(n.stage, l.stage) AS new, n.id IS NOT NULL AS saved, coalesce(l.created_at, DATE '{AS_OF}') AS created_at,
    CASE WHEN n.id IS NULL THEN l.updated_at ELSE DATE '{AS_OF}' END AS updated_at, list_position({STAGE_LIST}, l.stage) % 11 AS a, list_position({STAGE_LIST}, coalesce(n.stage, l.stage)) % 11 AS b FROM l FULL JOIN n ON l.id = n.id)
  SELECT id, score, CASE WHEN old IS NULL OR NOT saved THEN new WHEN old = 'lost' AND b < 7 THEN 'lost' WHEN a > b THEN old ELSE new END AS stage, created_at, updated_at, exported_at FROM m""")
def lead_saves(spark, sf_dir):
    rows = lead_table(spark, sf_dir)
    stage = F.get(F.array(*[F.lit(s) for s in (*leads.STAGES, leads.LOST)]), (F.col("id") % 11).cast("int"))
    new = rows.where("id % 3 < 2").withColumn("stage", stage).withColumn("score", F.col("score") + 1).withColumn("id", F.when(F.col("id") % 3 == 1, F.col("id") + 1000000).otherwise(F.col("id")))
    return leads.save_leads(rows, new.drop("created_at", "updated_at", "exported_at"), day(AS_OF))[0].select("id", "score", "stage", "created_at", "updated_at", "exported_at")


@query(f"WITH {LEADS}, {ENGAGED} SELECT company_key, playbook, array_to_string(stages, ',') AS stages, last_exported FROM g")
def lead_engagement(spark, sf_dir):
    rows = lead_table(spark, sf_dir)
    return leads.company_engagement(rows, loss_events(rows), "r3").withColumn("stages", F.array_join("stages", ","))


@query(f"WITH {LEADS}, {LISTED_SQL}, {ENGAGED}, {BLOCKED} SELECT id, blocked FROM b")
def lead_block_reasons(spark, sf_dir):
    return blocked(spark, sf_dir).select("id", "blocked")


@query(f"WITH {LEADS}, {LISTED_SQL}, {ENGAGED}, {BLOCKED} SELECT id, email, score FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY score DESC, id) AS k FROM b WHERE blocked IS NULL AND tier <> 'skip' AND id % 6 > 0) WHERE k = 1")
def lead_outbound(spark, sf_dir):
    return leads.outbound(blocked(spark, sf_dir)).select("id", "email", "score")


@query(f"WITH {LEADS}, {LISTED_SQL} SELECT id FROM l WHERE {HIT}")
def lead_suppressed(spark, sf_dir):
    none = F.lit(None).cast("string")
    return leads.suppressed(lead_table(spark, sf_dir).select("id", "email", none.alias("domain"), none.alias("company"), none.alias("linkedin")), listed(spark))


@query(f"""WITH {LEADS} SELECT id, stage, exported_at FROM (SELECT id, CASE WHEN id % 5 = 0 AND list_position({STAGE_LIST}, stage) % 11 < 6 THEN 'exported' ELSE stage END AS stage, CASE WHEN id % 5 = 0 THEN DATE '{AS_OF}' ELSE exported_at END AS exported_at FROM l)""")
def lead_exports(spark, sf_dir):
    rows = lead_table(spark, sf_dir)
    return leads.mark_exported(rows, rows.where("id % 5 = 0"), day(AS_OF)).select("id", "stage", "exported_at")


@query(f"WITH {LEADS} SELECT email, max(id) AS id FROM l WHERE email <> '' GROUP BY 1")
def lead_of_email(spark, sf_dir):
    rows = lead_table(spark, sf_dir)
    return leads.lead_of_email(rows, rows.where("email <> ''").select(F.upper("email").alias("email")))


@query(f"WITH {LEADS} SELECT id, company_key FROM l WHERE company_key = 'k7' OR email LIKE '%@d21.example'")
def leads_of_domain(spark, sf_dir):
    rows = lead_table(spark, sf_dir)
    wanted = spark.createDataFrame([("https://www.d21.example/jobs",), ("nobody@k7.example",)], "domain string")
    named = rows.withColumn("company_key", F.when(F.col("company_key") == "k7", "k7.example").otherwise(F.col("company_key")))
    return leads.leads_of_domain(named, wanted).select("id", F.regexp_replace("company_key", r"\.example$", "").alias("company_key"))


@query("""WITH f AS (SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'u' || user_id || '@d' || (user_id % 50) || '.example' END AS email, CAST(ts AS DATE) AS due, event_type = 'purchase' AS done FROM events),
  m AS (SELECT min(due) + CAST(date_diff('day', min(due), max(due)) // 2 AS INT) AS mid FROM f) SELECT id, due FROM f, m WHERE NOT done AND due <= mid AND email NOT LIKE '%@d7.example' AND email NOT LIKE '%@d9.example' AND email <> 'u11@d11.example'""")
def followups_due(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    email = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("u"), "user_id", F.lit("@d"), F.col("user_id") % 50, F.lit(".example")))
    rows = e.select(F.col("event_id").alias("id"), email.alias("email"), F.to_date("ts").alias("due"), (F.col("event_type") == "purchase").alias("done"))
    low, high = rows.agg(F.min("due"), F.max("due")).first()
    return leads.due_followups(rows, listed(spark), F.lit(low + (high - low) // 2)).select("id", "due")


@query("""WITH n AS (SELECT c_custkey, 'd' || (c_custkey % 50) || '.example' AS d, ['anna', 'jorg', '', 'ian', 'maryann'][c_custkey % 5 + 1] AS f, ['doe', 'grossmeyer', 'solo', '', 'delacruz'][c_custkey % 5 + 1] AS n FROM customer)
  SELECT c_custkey, CASE WHEN f = '' THEN '' WHEN n = '' THEN f || '@' || d ELSE array_to_string(list_transform([f || '.' || n, f, substr(f, 1, 1) || n, f || n, substr(f, 1, 1) || '.' || n, f || '_' || n, f || substr(n, 1, 1), n], lambda x: x || '@' || d), ' ') END AS emails FROM n""")
def contact_candidates(spark, sf_dir):
    k = F.col("c_custkey") % 5
    first = F.get(F.array(F.lit("Anna (she)"), F.lit("Dr. Jörg"), F.lit(None).cast("string"), F.lit("Ian"), F.lit("Mary Ann")), k.cast("int"))
    last = F.get(F.array(F.lit("Doe, CPA"), F.lit("Groß-Meyer PhD"), F.lit("Solo"), F.lit(""), F.lit("de la Cruz")), k.cast("int"))
    made = contacts.candidates(first, last, F.concat(F.lit("d"), F.col("c_custkey") % 50, F.lit(".example")))
    return spread(t(spark, sf_dir, "customer")).select("c_custkey", F.array_join(made, " ").alias("emails"))


@query("""WITH c AS (SELECT s_nationkey AS company_key, s_suppkey AS pos, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE s_name END AS full_name, CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 4 = 1 THEN '' ELSE 's' || s_suppkey || '@x.example' END AS email, s_suppkey % 5 > 0 AND s_suppkey % 4 = 1 AS generic,
    CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 6 END AS rank, s_suppkey % 4 AS k, s_acctbal FROM supplier WHERE s_suppkey % 11 > 0),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY company_key ORDER BY rank IS NULL, coalesce(rank, 0), email = '', CASE WHEN email = '' THEN 4 ELSE CASE k WHEN 0 THEN 0 WHEN 2 THEN 3 ELSE 1 END END, s_acctbal DESC, pos) AS INT) AS place FROM c WHERE (NOT generic OR full_name <> '') AND (email <> '' OR full_name <> ''))
  SELECT company_key, pos, place FROM r WHERE place <= 3""")
def contact_selection(spark, sf_dir):
    k = F.col("s_suppkey")
    email = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("s"), k, F.lit("@x.example")))
    status = F.when(k % 4 == 0, "valid").when(k % 4 == 2, "invalid").otherwise("risky")
    rows = t(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("company_key"), k.alias("pos"), F.when(k % 7 == 0, "").otherwise(F.col("s_name")).alias("full_name"), email.alias("email"), status.alias("email_status"), F.col("s_acctbal").alias("confidence"),
        F.lit("").alias("linkedin_url"), F.when(k % 3 > 0, (k % 6).cast("int")).alias("title_rank"), (k % 11 == 0).alias("excluded"), ((k % 5 > 0) & (k % 4 == 1)).alias("generic"),
    )
    return contacts.select_contacts(rows, 3).select("company_key", "pos", "place")


REQUESTS = """q AS (SELECT 'r' || (user_id % 40) AS run_id, event_id AS pos, event_type AS type, event_type IN ('purchase', 'signup', 'error') AS paid, CASE WHEN event_type = 'error' THEN event_id % 1000 ELSE 0 END AS tokens, event_id % 3 AS m FROM events),
  z AS (SELECT *, paid AND sum(CAST(paid AS INT)) OVER (PARTITION BY run_id ORDER BY pos) > 10 AS blocked FROM q)"""


def request_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    tokens = F.when(kind == "error", F.col("event_id") % 1000).otherwise(0)
    model = F.get(F.array(F.lit("small"), F.lit("small-2"), F.lit("other")), (F.col("event_id") % 3).cast("int"))
    rows = t(spark, sf_dir, "events").select(F.concat(F.lit("r"), F.col("user_id") % 40).alias("run_id"), F.col("event_id").alias("pos"), F.lit("finder").alias("kind"), kind.alias("type"), kind.isin("purchase", "signup", "error").alias("paid"), model.alias("model"), tokens.alias("input_tokens"), (tokens * 2).alias("output_tokens"))
    return usage.usage_rows(usage.metered(rows, 10), {"purchase": 0.03, "view": 1.0}, {"small": (1.0, 4.0)}, (3.0, 15.0))


@query(f"""WITH {REQUESTS} SELECT run_id, type, paid, count(*) FILTER (WHERE NOT blocked) AS calls, count(*) FILTER (WHERE blocked) AS blocked_by_budget, CAST(coalesce(sum(tokens) FILTER (WHERE NOT blocked), 0) AS BIGINT) AS input_tokens,
  CASE WHEN coalesce(sum(tokens) FILTER (WHERE NOT blocked), 0) > 0 THEN round(sum(tokens * CASE WHEN m = 2 THEN 33.0 ELSE 9.0 END / 1e6) FILTER (WHERE NOT blocked), 4) WHEN type = 'purchase' THEN round(count(*) FILTER (WHERE NOT blocked) * 0.03::DOUBLE, 4) END AS cost FROM z GROUP BY 1, 2, 3""")
def usage_meter(spark, sf_dir):
    return request_rows(spark, sf_dir).select("run_id", "type", "paid", "calls", "blocked_by_budget", "input_tokens", F.col("estimated_cost_usd").alias("cost"))


@query(f"WITH {REQUESTS} SELECT run_id, CAST(count(*) FILTER (WHERE paid AND NOT blocked) AS BIGINT) AS paid_lookups FROM z GROUP BY 1")
def paid_lookups(spark, sf_dir):
    return usage.run_costs(request_rows(spark, sf_dir)).select("run_id", "paid_lookups")


@query("""WITH o AS (SELECT l_orderkey AS lead_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(CASE WHEN l_linenumber % 4 > 0 THEN 8 - l_linenumber END, l_linenumber * 1000000 + l_partkey), l_linenumber * 1000000 + l_partkey, l_partkey) AS k, CASE WHEN l_linenumber % 3 = 0 THEN 'again' ELSE '' END AS subject, 'b' || l_partkey AS body FROM lineitem)
  SELECT lead_id, coalesce(max(CASE WHEN k = 1 THEN subject END), '') AS subject_1, coalesce(max(CASE WHEN k = 1 THEN body END), '') AS email_1, coalesce(max(CASE WHEN k = 2 THEN body END), '') AS email_2, coalesce(max(CASE WHEN k = 3 THEN subject END), '') AS subject_3, coalesce(max(CASE WHEN k = 3 THEN body END), '') AS email_3 FROM o GROUP BY 1""")
def sequence_fields(spark, sf_dir):
    n = F.col("l_linenumber")
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("lead_id"), (n * 1000000 + F.col("l_partkey")).alias("pos"), F.when(n % 4 > 0, 8 - n).alias("step"), F.when(n % 3 == 0, " again ").otherwise("").alias("subject"), F.concat(F.lit("b"), "l_partkey").alias("body"))
    return sequences.sequence_fields(sequences.ordered_messages(rows), 3, [3])


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'http://x.example/a' WHEN 1 THEN 'https://y.example' WHEN 2 THEN 'https://z.example' ELSE '' END AS site,
  CASE WHEN c_custkey % 3 = 0 THEN n_name || ' Town' WHEN c_custkey % 3 = 1 THEN n_name ELSE 'Old Town, ' || n_name END AS place FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def company_fields(spark, sf_dir):
    k = F.col("c_custkey")
    c = t(spark, sf_dir, "customer").join(F.broadcast(t(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows by definition
    site, host = F.when(k % 4 == 0, " http://x.example/a").when(k % 4 == 1, "//y.example"), F.when(k % 4 == 2, "z.example").when(k % 4 < 2, "w.example")
    place = F.when(k % 3 == 0, F.concat("n_name", F.lit(" Town"))).when(k % 3 == 2, "Old Town")
    return c.select("c_custkey", sequences.website_url(site, host).alias("site"), sequences.company_location(place, F.col("n_name")).alias("place"))


@query(f"""WITH {LEADS}, n AS (SELECT 'email' AS kind, email AS value, 'asked' AS reason, DATE '{AS_OF}' AS added_at FROM l WHERE id % 17 = 0 AND email <> '' UNION SELECT 'domain', 'd' || id % 50 || '.example', 'rule', DATE '{AS_OF}' FROM l WHERE id % 90 = 0
    UNION SELECT 'company', 'firm ' || id, 'rule', DATE '{AS_OF}' FROM l WHERE id % 400 = 1)
  SELECT kind, value, reason, added_at FROM n UNION ALL SELECT 'email', 'u1@d1.example', 'old', DATE '{THEN}' WHERE NOT EXISTS (SELECT 1 FROM n WHERE kind = 'email' AND value = 'u1@d1.example')""")
def suppression_added(spark, sf_dir):
    """Entries as people write them; an old entry that comes again is replaced."""
    rows, old = lead_table(spark, sf_dir), spark.sql(f"SELECT 'email' AS kind, 'u1@d1.example' AS value, 'old' AS reason, DATE '{THEN}' AS added_at")
    mail = rows.where("id % 17 = 0").select(F.lit("email").alias("kind"), F.concat(F.lit(" "), F.upper("email")).alias("value"), F.lit("asked").alias("reason"))
    host = rows.where("id % 90 = 0").select(F.lit("domain").alias("kind"), F.concat(F.lit("https://www.d"), F.col("id") % 50, F.lit(".example/x")).alias("value"), F.lit("rule").alias("reason"))
    firm = rows.where("id % 400 = 1").select(F.lit("company").alias("kind"), F.concat(F.lit("The FIRM, "), "id", F.lit(" Ltd.")).alias("value"), F.lit("rule").alias("reason"))
    return leads.suppress(old, mail.unionByName(host).unionByName(firm), day(AS_OF))


@query(f"WITH {LEADS}, s AS (SELECT DISTINCT email AS value FROM l WHERE email <> '') SELECT value FROM s WHERE value NOT IN (SELECT email FROM l WHERE id % 4 = 1)")
def suppression_removed(spark, sf_dir):
    rows = lead_table(spark, sf_dir)
    known = rows.where("email <> ''").select(F.lit("email").alias("kind"), F.col("email").alias("value")).distinct()
    gone = rows.where("id % 4 = 1").select(F.concat(F.upper("email"), F.lit(" ")).alias("value"), F.lit(None).cast("string").alias("kind"))
    return leads.unsuppress(known, gone).select("value")


@query("SELECT event_id AS id, event_id % 2 = 0 OR event_id % 3 = 0 AS done FROM events")
def followups_completed(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 2 == 0).alias("done"))
    ids = rows.where("id % 3 = 0").select("id")
    return leads.complete_followups(rows, ids.unionAll(ids))


@query(f"WITH {LEADS} SELECT id, score FROM l WHERE run_id = 'r2' AND id % 7 > 0")
def leads_of_a_run(spark, sf_dir):
    rows = lead_table(spark, sf_dir)
    runs = rows.where("id % 7 > 0").select(F.col("id").alias("lead_id"), "run_id")
    return leads.leads_of_run(rows, runs.unionAll(runs), "r2").select("id", "score")


@query("SELECT 'p' || o_custkey % 40 AS playbook, max_by(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS run_id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def latest_runs(spark, sf_dir):
    runs = t(spark, sf_dir, "orders").select(F.concat(F.lit("p"), F.col("o_custkey") % 40).alias("playbook"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("finished_at"))
    return leads.latest_run(runs)
