"""The state of leads as DataFrame operations: saving, stages, engagement, suppression, follow-ups and handing over.

Tables: leads (id, playbook, run_id, company_key, email, score, tier, stage, created_at, updated_at, exported_at), events
(lead_id, stage, note, at), suppression (kind, value, reason, added_at), followups (id, playbook, lead_id, email, due,
reason, done). Every operation takes tables and gives tables or columns; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_company_name, normalize_domain, normalize_suppression

# fixed values: stages in order, and the one that a lead may leave by no later run
STAGES = ("sourced", "qualified", "enriched", "verified", "ready", "exported", "replied", "positive", "booked", "won")
LOST = "lost"
ENGAGED = ("replied", "positive", "booked", "won", LOST)


def rank(stage: Column) -> Column:
    """Place of a stage; -1 for lost and unknown ones."""
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage), F.lit(0)).cast("int") - 1


def kept_stage(old: Column, new: Column) -> Column:
    """The stage after a save: never further back, and lost stays lost until there is a reply."""
    ahead = F.when(rank(old) > rank(new), old).otherwise(new)
    return F.when(old.isNull(), new).when((old == LOST) & (rank(ahead) < STAGES.index("replied")), F.lit(LOST)).otherwise(ahead)


def save_leads(leads: DataFrame, new: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(leads after new ones are saved, events of the stages that changed). new has one row an id and no dates; what was
    created and exported before stays so."""
    old = leads.select("id", F.col("stage").alias("_stage"), F.col("created_at").alias("_created"), F.col("exported_at").alias("_exported"))
    met = new.join(old, "id", "left").withColumn("stage", kept_stage(F.col("_stage"), F.col("stage")))
    events = met.where(F.col("_stage").isNull() | (F.col("_stage") != F.col("stage"))).select(F.col("id").alias("lead_id"), "stage", F.lit("").alias("note"), now.alias("at"))
    saved = met.withColumn("created_at", F.coalesce("_created", now)).withColumn("updated_at", now).withColumn("exported_at", F.col("_exported"))
    rest = leads.join(new.select("id"), "id", "left_anti")
    return rest.select(*leads.columns).unionByName(saved.select(*leads.columns)), events


def set_stages(leads: DataFrame, moves: DataFrame, now: Column) -> DataFrame:
    """leads after moves (id, stage, force), one row an id: forward only, unless forced or to lost."""
    m = moves.select("id", F.col("stage").alias("_to"), "force")
    go = F.coalesce(F.col("force") | (F.col("_to") == LOST) | (rank(F.col("_to")) > rank(F.col("stage"))), F.lit(False)) & (F.col("_to") != F.col("stage"))
    met = leads.join(m, "id", "left")
    return met.withColumn("updated_at", F.when(go, now).otherwise(F.col("updated_at"))).withColumn("stage", F.when(go, F.col("_to")).otherwise(F.col("stage"))).select(*leads.columns)


def mark_exported(leads: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    hit = leads.join(ids.select("id").distinct(), "id", "left_semi").select("id", F.lit("exported").alias("stage"), F.lit(False).alias("force"))
    moved = set_stages(leads, hit, now).join(hit.select("id", F.lit(True).alias("_hit")), "id", "left")
    return moved.withColumn("exported_at", F.when(F.col("_hit"), now).otherwise(F.col("exported_at"))).select(*leads.columns)


def lead_of_email(leads: DataFrame, emails: DataFrame) -> DataFrame:
    """(email, id): of each address the lead that was changed last."""
    wanted = emails.select(F.lower(F.trim("email")).alias("email")).distinct()
    return leads.join(wanted, "email", "left_semi").groupBy("email").agg(F.max_by("id", F.struct("updated_at", "id")).alias("id"))


def leads_of_domain(leads: DataFrame, domains: DataFrame) -> DataFrame:
    """leads whose company's key or address is of one of the domains."""
    wanted = domains.select(normalize_domain(F.col("domain")).alias("_domain")).distinct()
    spots = leads.select("id", F.explode(F.array_distinct(F.array("company_key", F.regexp_extract(F.coalesce("email", F.lit("")), "@([^@]*)$", 1)))).alias("_domain"))
    return leads.join(spots.join(wanted, "_domain", "left_semi").select("id").distinct(), "id", "left_semi")


def leads_of_run(leads: DataFrame, lead_runs: DataFrame, run_id: str) -> DataFrame:
    """leads of a run, best score first."""
    ids = lead_runs.where(F.col("run_id") == run_id).select(F.col("lead_id").alias("id")).distinct()
    return leads.join(ids, "id", "left_semi").orderBy(F.desc("score"), "id")


def latest_run(runs: DataFrame) -> DataFrame:
    """(playbook, run_id): the finished run that started last."""
    return runs.where(F.col("finished_at").isNotNull()).groupBy("playbook").agg(F.max_by("id", F.struct("started_at", "id")).alias("run_id"))


def lost_by_bounce(events: DataFrame) -> DataFrame:
    """lead_id of those whose last loss was for an address that bounced. Of losses at one time the last counts, by the
    events' number `id` where they have one, else a bounce."""
    bounced = F.lower(F.coalesce("note", F.lit(""))).contains("bounce")
    number = F.col("id") if "id" in events.columns else F.lit(0)
    last = events.where(F.col("stage") == LOST).groupBy("lead_id").agg(F.max(F.struct("at", number.alias("number"), bounced.alias("bounced"))).alias("last"))
    return last.where("last.bounced").select("lead_id")


def company_engagement(leads: DataFrame, events: DataFrame, exclude_run: str = "") -> DataFrame:
    """(company_key, playbook, stages, last_exported) of what happened; leads that only belong to the run left out do
    not count. A lead lost for a dead address has stage lost_bounce."""
    dead = lost_by_bounce(events).select(F.col("lead_id").alias("id"), F.lit(True).alias("_dead"))
    counted = leads.where(~((F.lit(exclude_run) != "") & (F.col("run_id") == exclude_run) & F.col("exported_at").isNull()) | F.col("run_id").isNull())
    met = counted.join(dead, "id", "left").withColumn("stage", F.when((F.col("stage") == LOST) & F.col("_dead"), "lost_bounce").otherwise(F.col("stage")))
    return met.groupBy("company_key", "playbook").agg(F.array_sort(F.collect_set("stage")).alias("stages"), F.max(F.to_date("exported_at")).alias("last_exported"))


def recently_contacted(rows: DataFrame, leads: DataFrame, days: int, as_of: Column) -> DataFrame:
    """(id) of rows (id, email) whose address another lead was handed over with in the last `days` days. Blank addresses
    meet none. Of each address only the least and the greatest id count: one of them is another's if there is another."""
    email = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    sent = leads.where(F.col("exported_at") >= F.date_sub(as_of, days)).select(email("email").alias("_email"), "id").where("_email IS NOT NULL")
    ends = sent.groupBy("_email").agg(F.min("id").alias("_low"), F.max("id").alias("_high"))
    met = rows.select("id", email("email").alias("_email")).join(ends, "_email").where("id <> _low OR id <> _high")
    return met.select("id").distinct() if days > 0 else met.limit(0).select("id")


def suppress(suppression: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """suppression with new entries (value, kind, reason), which take the place of equal ones; empty values are no entries."""
    rows = new.select("kind", normalize_suppression(F.col("value"), F.col("kind")).alias("value"), "reason", now.alias("added_at")).where("value <> ''")
    rows = rows.groupBy("kind", "value").agg(F.max("reason").alias("reason"), F.max("added_at").alias("added_at"))
    return suppression.join(rows, ["kind", "value"], "left_anti").select("kind", "value", "reason", "added_at").unionByName(rows)


def unsuppress(suppression: DataFrame, gone: DataFrame) -> DataFrame:
    """suppression without entries (value, kind); no kind means email for a value with @, else domain."""
    kind = F.coalesce("kind", F.when(F.col("value").contains("@"), "email").otherwise("domain"))
    rows = gone.select(kind.alias("kind"), "value").select("kind", normalize_suppression(F.lower(F.trim("value")), F.col("kind")).alias("value"))
    return suppression.join(rows.distinct(), ["kind", "value"], "left_anti")


def suppressed(rows: DataFrame, suppression: DataFrame) -> DataFrame:
    """(id) of rows (id, email, domain, company, linkedin) that are listed by address, domain of either, name or profile."""
    c = {n: F.col(n) for n in ("email", "domain", "company", "linkedin")}
    checks = [("email", F.lower(F.trim(c["email"]))), ("domain", normalize_domain(c["email"])), ("domain", normalize_domain(c["domain"])), ("company", normalize_company_name(c["company"])), ("linkedin", normalize_suppression(c["linkedin"], F.lit("linkedin")))]
    spots = rows.select("id", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in checks]))).where("value <> ''")
    return spots.join(suppression.select("kind", "value").distinct(), ["kind", "value"], "left_semi").select("id").distinct()


def due_followups(followups: DataFrame, suppression: DataFrame, as_of: Column) -> DataFrame:
    """Follow-ups that are due and not done, but not those of someone suppressed since."""
    due = followups.where(~F.col("done") & (F.col("due") <= as_of))
    none = F.lit(None).cast("string")
    out = suppressed(due.where("email <> ''").select("id", "email", none.alias("domain"), none.alias("company"), none.alias("linkedin")), suppression)
    return due.join(out, "id", "left_anti")


def complete_followups(followups: DataFrame, ids: DataFrame) -> DataFrame:
    met = followups.join(ids.select("id", F.lit(True).alias("_done")).distinct(), "id", "left")
    return met.withColumn("done", F.col("done") | F.coalesce("_done", F.lit(False))).select(*followups.columns)


def block_reasons(rows: DataFrame, leads: DataFrame, events: DataFrame, suppression: DataFrame, as_of: Column, run_id: str = "", dedupe_days: int = 0, cooldown_days: int = 0, excluded: Column | None = None) -> DataFrame:
    """rows (id, company_key, playbook, email, domain, email_ok, ...) with `blocked`: why a lead must not be handed over.

    In order: no deliverable email; the company has replied or is lost; suppressed; at an excluded domain; handed over
    before; its address contacted in the last dedupe_days; its company contacted in the last cooldown_days.
    """
    engaged = company_engagement(leads, events, run_id).withColumnRenamed("last_exported", "_last")
    none = F.lit(None).cast("string")
    listed = suppressed(rows.select("id", "email", "domain", none.alias("company"), none.alias("linkedin")), suppression).withColumn("_listed", F.lit(True))
    sent = leads.where(F.col("exported_at").isNotNull()).select("id", F.lit(True).alias("_sent"))
    recent = recently_contacted(rows, leads, dedupe_days, as_of).withColumn("_recent", F.lit(True))
    met = rows.join(engaged, ["company_key", "playbook"], "left").join(listed, "id", "left").join(sent, "id", "left").join(recent, "id", "left")
    has, days = F.coalesce(F.col("email") != "", F.lit(False)), F.datediff(as_of, F.col("_last"))
    reason = F.when(~F.col("email_ok"), "no deliverable email").when(F.arrays_overlap("stages", F.array(*[F.lit(s) for s in ENGAGED])), "company already engaged (replied / lost) - not re-contacted")
    reason = reason.when(has & F.col("_listed"), "suppressed")
    if excluded is not None:
        reason = reason.when(has & excluded, "email at an excluded domain")
    reason = reason.when(has & F.col("_sent"), "already handed over").when(has & F.col("_recent"), f"contacted in the last {dedupe_days} days")
    if cooldown_days:
        reason = reason.when(days < cooldown_days, F.concat(F.lit("company contacted "), days.cast("string"), F.lit(f"d ago (cooldown {cooldown_days}d)")))
    return met.withColumn("blocked", reason).select(*rows.columns, "blocked")


def outbound(rows: DataFrame, tiers: tuple[str, ...] = ("hot", "normal")) -> DataFrame:
    """block_reasons' rows (with score, tier, n_messages) that may be handed over: of each address the best score."""
    good = rows.where(F.col("blocked").isNull() & F.col("tier").isin(*tiers) & (F.col("n_messages") > 0)).withColumn("_email", F.lower(F.trim("email")))
    order = Window.partitionBy("_email").orderBy(F.desc("score"), "id")
    first = good.where("_email <> ''").withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")
    return first.unionByName(good.where("_email IS NULL OR _email = ''")).drop("_email")
