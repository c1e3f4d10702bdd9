"""What was delivered to each client: identity keys of companies, jobs and people, upserts by run, and what is left out.

Leads: id, client, name, domain, linkedin_url, email_domain, signals (type, title, url, external_id) and contact (email,
linkedin_url, full_name). Deliveries: client, kind, key, run_id, delivered_at, one row a key. Everything that a lead can
be known by is a row of (client, id, kind, key), so that every check is a join on keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import domain_and_parents, linkedin_key, normalize_company_name, normalize_domain, normalize_job_url, normalize_suppression, normalize_text

# fixed values: kinds of items, each with that of items known by the company's name while it has a domain
KINDS = {"company": "company_by_name", "job": "job_by_name", "contact": "contact_by_name"}
JOB = "job_posting"
# fixed values: reasons
ON_LIST = "on this client's do-not-list"


def full(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def known(leads: DataFrame) -> DataFrame:
    """leads with _name_key, the company's key while its domain is unknown, _key and _person."""
    name = F.concat(F.lit("name:"), full(normalize_company_name(F.col("name"))))
    domain = normalize_domain(F.col("domain"))
    return leads.withColumns({"_name_key": name, "_domain": domain, "_key": F.coalesce(domain, name), "_person": full(normalize_text(F.col("contact.full_name")))})


def job_key(company: Column, signal: Column) -> Column:
    """By the posting's number, else its address, else its type and title."""
    title = F.concat(signal["type"], F.lit(":"), normalize_text(signal["title"]))
    return F.coalesce(F.concat(company, F.lit("|"), full(signal["external_id"])), full(normalize_job_url(signal["url"])), F.concat(company, F.lit("|"), title))


def person_keys(company: Column) -> list[Column]:
    """A person's keys, best first: address, profile (also as older ledgers wrote it), name at the company."""
    c = F.col("contact")
    return [full(F.lower(c["email"])), full(linkedin_key(c["linkedin_url"])), full(normalize_suppression(c["linkedin_url"], F.lit("linkedin"))), F.concat(F.col("_person"), F.lit("|"), F.coalesce(company, F.lit("")))]


def spread(rows: DataFrame, items: list[tuple[Column, Column]], *keep: str) -> DataFrame:
    """One row for each (kind, key) that is not null, with the order of the pairs as `place`."""
    structs = [F.struct(F.lit(i).alias("place"), kind.alias("kind"), key.alias("key")) for i, (kind, key) in enumerate(items)]
    return rows.select(*keep, F.inline(F.filter(F.array(*structs), lambda x: x["kind"].isNotNull() & x["key"].isNotNull())))


def jobs(rows: DataFrame) -> DataFrame:
    """rows with each signal as `job` and its place as `n`."""
    return rows.select("*", F.posexplode("signals").alias("n", "job"))


def lead_items(leads: DataFrame) -> DataFrame:
    """(client, id, kind, key), distinct: all that delivered leads put in the ledger. A company with a domain is also put
    there by its name, so that it is known when it comes back without the domain."""
    rows = known(leads)
    named = F.when(F.col("_domain").isNotNull(), F.col("_name_key"))
    lit = F.lit
    company = spread(rows, [(lit("company"), F.col("_key")), (lit(KINDS["company"]), named)], "client", "id")
    people = spread(rows, [*((lit("contact"), k) for k in person_keys(F.col("_key"))), (lit(KINDS["contact"]), F.concat("_person", lit("|"), named))], "client", "id")
    own, other = job_key(F.col("_key"), F.col("job")), job_key(named, F.col("job"))
    work = spread(jobs(rows), [(lit("job"), own), (F.when(other != own, KINDS["job"]), F.when(named.isNotNull(), other))], "client", "id")
    return company.unionByName(people).unionByName(work).select("client", "id", "kind", "key").distinct()


def record(deliveries: DataFrame, runs: DataFrame, items: DataFrame, run_id: str, day: Column) -> tuple[DataFrame, DataFrame]:
    """(deliveries, runs) after items (client, kind, key) were delivered: a key that comes again moves to this run and day,
    so a repeated run changes nothing. runs (client, run_id, delivered_at, items) counts companies, jobs and people."""
    new = items.where("trim(key) <> ''").select("client", "kind", F.trim("key").alias("key")).distinct().withColumns({"run_id": F.lit(run_id), "delivered_at": day})
    kept = deliveries.join(new.select("client", "kind", "key"), ["client", "kind", "key"], "left_anti")
    counted = new.groupBy("client").agg(F.count_if(F.col("kind").isin(*KINDS)).alias("items")).select("client", F.lit(run_id).alias("run_id"), day.alias("delivered_at"), "items")
    both = runs.select("client", "run_id", "delivered_at", "items").unionByName(counted)
    ended = both.groupBy("client", "run_id").agg(F.max("delivered_at").alias("delivered_at"), F.max("items").alias("items"))
    return kept.select("client", "kind", "key", "run_id", "delivered_at").unionByName(new), ended


def met(lookups: DataFrame, deliveries: DataFrame, by: list[str], as_of: Column, days: int | None) -> DataFrame:
    """(by, delivered_at): of each group of lookups (client, place, kind, key) the first that was delivered in the last
    `days` days, ever without days."""
    recent = deliveries if days is None else deliveries.where(F.col("delivered_at") > F.date_sub(as_of, max(days, 0)))
    found = lookups.join(recent.select("client", "kind", "key", "delivered_at"), ["client", "kind", "key"])
    return found.groupBy(*by).agg(F.min_by("delivered_at", "place").alias("delivered_at"))


def both_keys(kind: str, key) -> list[tuple[Column, Column]]:
    """The keys under which an item may have been delivered: its own, then by name; key makes one of a company's key."""
    has = F.col("_domain").isNotNull()
    return [(F.lit(kind), key(F.col("_key"))), (F.when(has, F.lit(kind)).otherwise(KINDS[kind]), key(F.col("_name_key")))]


def listed(rows: DataFrame, suppression: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """(client, id, place): the first of checks (kind, array of values) that the client's list (client, kind, value) holds.
    Profiles are compared by their key, however the list writes them."""
    value = F.when(F.col("kind") == "linkedin", linkedin_key(F.col("value"))).otherwise(F.col("value"))
    entries = suppression.select("client", "kind", value.alias("value")).distinct()
    spots = rows.select("client", "id", F.inline(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(kind).alias("kind"), values.alias("many")) for i, (kind, values) in enumerate(checks)))))
    spots = spots.select("client", "id", "place", "kind", F.explode("many").alias("value"))
    return spots.join(entries, ["client", "kind", "value"], "left_semi").groupBy("client", "id").agg(F.min("place").alias("place"))


def hosts(c: Column) -> Column:
    return F.coalesce(domain_and_parents(normalize_domain(c)), F.array().cast("array<string>"))


def filter_companies(leads: DataFrame, deliveries: DataFrame, suppression: DataFrame, as_of: Column, days: int | None = None, dedupe: tuple[str, ...] = ("company", "job", "contact")) -> DataFrame:
    """leads with `signals` that were not delivered yet and `reason`: why a company is left out, null if it stays.

    In order: its domain, the one that its source hints at or, without a domain, that of its contact is on the client's
    list (also by a parent domain); its name is; its profile is; it was delivered before, by domain or by name; all of
    its jobs were. Null fields match nothing, repeated ids of a client are one lead.
    """
    rows, none = known(leads), F.array().cast("array<string>")
    hinted = F.concat(hosts(F.col("domain")), hosts(F.col("email_domain")), F.when(F.col("_domain").isNull(), hosts(F.col("contact.email"))).otherwise(none))
    names = F.filter(F.array(normalize_company_name(F.col("name"))), lambda x: x != "")
    pages = F.filter(F.array(linkedin_key(F.col("linkedin_url"))), lambda x: x != "")
    found = rows.join(listed(rows, suppression, [("domain", hinted), ("company", names), ("linkedin", pages)]), ["client", "id"], "left")
    reason = F.when(F.col("place") == 0, f"{ON_LIST} (domain)").when(F.col("place") == 1, f"{ON_LIST} (company name)").when(F.col("place") == 2, f"{ON_LIST} (LinkedIn)")
    if "company" in dedupe:
        found = found.join(met(spread(rows, both_keys("company", lambda k: k), "client", "id"), deliveries, ["client", "id"], as_of, days), ["client", "id"], "left")
        reason = reason.when(F.col("delivered_at").isNotNull(), F.concat(F.lit("already delivered to this client ("), F.col("delivered_at").cast("string"), F.lit(")")))
    signals = F.col("signals")
    if "job" in dedupe:
        lookups = spread(jobs(rows), both_keys("job", lambda k: job_key(k, F.col("job"))), "client", "id", "n")
        gone = met(lookups, deliveries, ["client", "id", "n"], as_of, days).groupBy("client", "id").agg(F.collect_set("n").alias("_gone"))
        found = found.join(gone, ["client", "id"], "left")
        left = F.filter("signals", lambda s, i: ~F.array_contains(F.coalesce("_gone", F.array().cast("array<int>")), i))
        signals, is_job = F.when(reason.isNull() & F.col("_gone").isNotNull(), left).otherwise(signals), lambda s: s["type"] == JOB
        empty = (F.size(left) == 0) | (F.exists("signals", is_job) & ~F.exists(left, is_job))
        reason = F.coalesce(reason, F.when(F.col("_gone").isNotNull() & empty, "all its jobs were already delivered"))
    return found.withColumns({"reason": reason, "signals": signals}).select(*leads.columns, "reason")


def filter_contacts(leads: DataFrame, deliveries: DataFrame, suppression: DataFrame, as_of: Column, days: int | None = None, dedupe: tuple[str, ...] = ("company", "job", "contact")) -> DataFrame:
    """leads with `reason`: why the contact is left out, null if they stay: the address, its domain (or a parent of it) or the
    profile is on the client's list, or they were delivered under any of their keys."""
    rows, mail = known(leads), F.col("contact.email")
    one = lambda c: F.filter(F.array(c), lambda x: x != "")
    checks = [("email", one(F.lower(F.trim(mail)))), ("domain", F.when(mail.contains("@"), hosts(mail)).otherwise(F.array().cast("array<string>"))), ("linkedin", one(linkedin_key(F.col("contact.linkedin_url"))))]
    found = rows.join(listed(rows, suppression, checks), ["client", "id"], "left")
    reason = F.when(F.col("place").isNotNull(), f"{ON_LIST} (contact)")
    if "contact" in dedupe:
        lookups = [*((F.lit("contact"), k) for k in person_keys(F.col("_key"))), *both_keys("contact", lambda k: F.concat(F.col("_person"), F.lit("|"), k))]
        found = found.join(met(spread(rows, lookups, "client", "id"), deliveries, ["client", "id"], as_of, days), ["client", "id"], "left")
        reason = reason.when(F.col("delivered_at").isNotNull(), "contact already delivered to this client")
    return found.withColumn("reason", reason).select(*leads.columns, "reason")


def clients_with_history(runs: DataFrame) -> DataFrame:
    """(client, n_runs, items, last_delivered) of each client, the latest first."""
    return runs.groupBy("client").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("items").alias("items"), F.max("delivered_at").alias("last_delivered")).orderBy(F.desc("last_delivered"), "client")
