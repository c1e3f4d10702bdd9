"""Message sequences of leads as flat columns, and the fields of an export's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text


def ordered_messages(messages: DataFrame) -> DataFrame:
    """messages (lead_id, pos, step, subject, body) with `k`, their place from 1: by step (none: pos), then pos."""
    order = Window.partitionBy("lead_id").orderBy(F.coalesce("step", "pos"), "pos")
    return messages.withColumn("k", F.row_number().over(order))


def max_steps(ordered: DataFrame) -> DataFrame:
    return ordered.agg(F.coalesce(F.max("k"), F.lit(0)).alias("steps"))


def followup_subject_steps(ordered: DataFrame) -> DataFrame:
    """(k) of the places after the first where some lead has a subject of its own."""
    return ordered.where((F.col("k") > 1) & (F.coalesce(F.trim("subject"), F.lit("")) != "")).select("k").distinct()


def sequence_keys(steps: int, subject_steps: list[int] = ()) -> list[str]:
    out = ["subject_1", "email_1"]
    for k in range(2, max(1, steps) + 1):
        out += [f"subject_{k}"] * (k in subject_steps) + [f"email_{k}"]
    return out


def sequence_fields(ordered: DataFrame, steps: int, subject_steps: list[int] = ()) -> DataFrame:
    """(lead_id, sequence_keys ...): each lead's messages as columns; what is missing is empty."""
    def cell(name: str) -> Column:
        what, k = name.split("_")
        value = F.trim("subject") if what == "subject" else F.col("body")
        return F.coalesce(F.max(F.when(F.col("k") == int(k), value)), F.lit("")).alias(name)

    return ordered.groupBy("lead_id").agg(*[cell(n) for n in sequence_keys(steps, subject_steps)])


def website_url(website: Column, domain: Column) -> Column:
    """An absolute address of the company's site; empty without one."""
    site, host = F.trim(F.coalesce(website, F.lit(""))), F.coalesce(domain, F.lit(""))
    given = F.when(site.contains("://"), site).otherwise(F.concat(F.lit("https://"), F.regexp_replace(site, "^/+", "")))
    return F.when(site != "", given).when(host != "", F.concat(F.lit("https://"), host)).otherwise("")


def company_location(location: Column, country: Column) -> Column:
    """The place with its country, which is added only if the place does not name it."""
    place, land = F.trim(F.coalesce(location, F.lit(""))), F.trim(F.coalesce(country, F.lit("")))
    known = normalize_text(place).contains(normalize_text(land))
    return F.when((land == "") | known, place).when(place == "", land).otherwise(F.concat(place, F.lit(", "), land))
