"""Three-valued fit tests, ordered rejection reasons, suppression and ledger joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import keyword_match
from ..functions.text import domain_and_parents, normalize_company_name, normalize_domain
from .components import spread
from .places import Gazetteer, location_fit, shown


def size_fit(employees: Column, least: int | None, most: int | None) -> Column:
    """Null if the size is unknown."""
    ok = F.lit(True)
    if least is not None:
        ok = ok & (employees >= least)
    if most is not None:
        ok = ok & (employees <= most)
    return F.when(employees.isNotNull(), ok)


def member_fit(value: Column, include: list[str], exclude: list[str] = ()) -> Column:
    """False if excluded; true if included or nothing is asked for; null if the value is unknown."""
    v = F.lower(value)
    out = F.when(value.isNull(), F.lit(None).cast("boolean"))
    if exclude:
        out = out.when(v.isin([x.lower() for x in exclude]), False)
    return out.otherwise(v.isin([x.lower() for x in include]) if include else F.lit(True))


def reject_reason(tests: list[tuple[Column, str]], unknown_passes: bool = True) -> Column:
    """The reason of the first test that fails; unknown fails only if asked to."""
    return F.coalesce(*[F.when(~F.coalesce(t, F.lit(unknown_passes)), why) for t, why in tests], F.lit(None).cast("string"))


def not_listed(rows: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(listed.select(*keys).distinct(), keys, "left_anti")


def under_domains(rows: DataFrame, domain: str, listed: DataFrame, labels: int = 1) -> DataFrame:
    """rows whose domain or one of its parents is in listed (domain)."""
    spread = rows.select(F.col(domain).alias("_domain")).distinct().withColumn("domain", F.explode(domain_and_parents(F.col("_domain"), labels)))
    hit = spread.join(listed.select("domain").distinct(), "domain", "left_semi").select("_domain").distinct()
    return rows.join(hit, rows[domain] == hit["_domain"], "left_semi")


def suppression_match(rows: DataFrame, key: str, idents: list[tuple[str, Column]], listed: DataFrame) -> DataFrame:
    """(key, kind): the first kind, in the order given, under which a row is listed (kind, value)."""
    spots = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(kind).alias("kind"), value.alias("value")) for i, (kind, value) in enumerate(idents)])
    spread = rows.select(key, F.inline(spots)).where("value IS NOT NULL")
    return spread.join(listed.select("kind", "value").distinct(), ["kind", "value"], "left_semi").groupBy(key).agg(F.min_by("kind", "priority").alias("kind"))


def delivered_since(rows: DataFrame, ledger: DataFrame, keys: list[str], as_of: Column, days: int | None) -> DataFrame:
    """rows that the ledger (keys, delivered_at) has after as_of - days; without days at any time."""
    recent = ledger if days is None else ledger.where(F.col("delivered_at") > F.date_sub(as_of, days))
    return rows.join(recent.select(*keys).distinct(), keys, "left_semi")


def first_keyword(texts: Sequence[Column | tuple[Column]], wanted: Sequence[str]) -> Column:
    """The first keyword that a text mentions, of the first text that mentions one; a tuple holds an array of texts."""

    def mention(k: str):
        return lambda x: keyword_match(x, [k]).isNotNull()

    found = []
    for text in texts:
        if isinstance(text, tuple):
            found += [F.when(F.exists(text[0], mention(k)), F.lit(k)) for k in wanted]
        else:
            found.append(keyword_match(text, list(wanted)))
    return F.coalesce(*found) if found and wanted else F.lit(None).cast("string")


@dataclass
class Profile:
    """Which companies are wanted; empty criteria ask for nothing."""

    locations: Sequence[str] = ()
    exclude_locations: Sequence[str] = ()
    least_employees: int | None = None
    most_employees: int | None = None
    industries: Sequence[str] = ()
    exclude_industries: Sequence[str] = ()
    keywords: Sequence[str] = ()
    exclude_keywords: Sequence[str] = ()
    exclude_domains: Sequence[str] = ()
    exclude_name_patterns: Sequence[str] = ()
    require_domain: bool = False
    unknown_passes: bool = True
    gazetteer: Gazetteer | None = None


def text_of(status: Column | bool | None, reason: Column | str) -> Column:
    return F.struct((status if isinstance(status, Column) else F.lit(status)).cast("boolean").alias("status"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))


def size_report(employees: Column, least: int | None, most: int | None) -> Column:
    """struct(status, reason) of size_fit."""
    if least is None and most is None:
        return text_of(True, "")
    n = employees.cast("string")
    out = F.when(employees.isNull(), text_of(None, "size unknown"))
    if least is not None:
        out = out.when(employees < least, text_of(False, F.concat(F.lit("too small ("), n, F.lit(f" employees, min {least})"))))
    if most is not None:
        out = out.when(employees > most, text_of(False, F.concat(F.lit("too large ("), n, F.lit(f" employees, max {most})"))))
    return out.otherwise(text_of(True, F.concat(F.lit("size match ("), n, F.lit(" employees)"))))


def industry_report(industry: Column, keywords: Column, description: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """struct(status, reason): industry and keywords may exclude a company, its description may also include it."""
    if not include and not exclude:
        return text_of(True, "")
    has = lambda c: F.coalesce(c != "", F.lit(False))
    few = F.array_join(F.slice(keywords, 1, 3), ", ")
    got = F.when(has(industry), industry).otherwise(few)
    out = F.when(~has(industry) & (F.coalesce(F.size(keywords), F.lit(0)) <= 0) & ~has(description), text_of(None, "industry unknown"))
    if exclude:
        bad = first_keyword([industry, (keywords,)], exclude)
        out = out.when(bad.isNotNull(), text_of(False, F.concat(F.lit("excluded industry '"), bad, F.lit("' ("), got, F.lit(")"))))
    if not include:
        return out.otherwise(text_of(True, "industry not excluded"))
    good = first_keyword([industry, (keywords,), description], include)
    out = out.when(good.isNotNull(), text_of(True, F.concat(F.lit("industry match ("), good, F.lit(")"))))
    return out.otherwise(text_of(False, F.concat(F.lit(f"industry not in ICP [{shown(include)}] (got: "), F.when(got != "", got).otherwise("description only"), F.lit(")"))))


def fit_reports(rows: DataFrame, profile: Profile) -> DataFrame:
    """rows (location, country, signal_places, employees, industry, keywords, description) with the structs location_fit,
    size_report and industry_report as fit_location, fit_size and fit_industry."""
    c = F.col
    return rows.withColumns({
        "fit_location": location_fit(c("location"), c("country"), c("signal_places"), profile.locations, profile.exclude_locations, profile.gazetteer),
        "fit_size": size_report(c("employees"), profile.least_employees, profile.most_employees),
        "fit_industry": industry_report(c("industry"), c("keywords"), c("description"), profile.industries, profile.exclude_industries),
    })


def rejections(rows: DataFrame, profile: Profile, suppression: DataFrame | None = None, key: str = "company_key") -> DataFrame:
    """rows with `reason`: why a company is not wanted, null if it is. The first of nine reasons counts.

    rows hold key, name, domain and what fit_reports reads, and signal_titles; suppression (kind, value) lists domains
    and company names. In order: domain or name suppressed; domain excluded (or under an excluded one); a pattern of names;
    no domain; an excluded keyword; no wanted keyword; location; size; industry. A fit that is unknown rejects only if
    unknown_passes is off. Texts that are null count as empty.
    """
    c = {n: F.coalesce(F.col(n), F.lit("")) for n in ("name", "domain", "industry", "description")}
    rows = spread(rows)
    met = fit_reports(rows, profile)
    reasons: list[Column] = []
    if suppression is not None:
        listed = suppression.select("kind", "value").distinct()
        spots = rows.select(key, F.inline(F.array(F.struct(F.lit("domain").alias("kind"), normalize_domain(c["domain"]).alias("value")), F.struct(F.lit("company").alias("kind"), normalize_company_name(c["name"]).alias("value"))))).where("value <> ''")
        found = spots.join(listed, ["kind", "value"], "left_semi").groupBy(key).agg(F.max("kind").alias("_listed"))  # a domain goes before
        met = met.join(found, key, "left")
        reasons += [F.when(F.col("_listed") == "domain", F.concat(F.lit("domain "), c["domain"], F.lit(" is on the suppression list"))).when(F.col("_listed") == "company", F.concat(F.lit("company "), c["name"], F.lit(" is on the suppression list")))]
    for raw in profile.exclude_domains:
        d = raw.strip().lower().split("://")[-1].split("/")[0].rpartition("@")[2].removeprefix("www.")
        reasons.append(F.when(c["domain"] == d, f"excluded domain {d}").when(F.endswith(c["domain"], F.lit(f".{d}")), F.concat(F.lit("excluded domain "), c["domain"], F.lit(f" (under {d})"))))
    for pattern in profile.exclude_name_patterns:
        reasons.append(F.when(c["name"].rlike(f"(?i){pattern}"), F.concat(F.lit("company name '"), c["name"], F.lit(f"' matches excluded pattern '{pattern}'"))))
    if profile.require_domain:
        reasons.append(F.when(c["domain"] == "", "no website/domain (icp.require_domain is on)"))
    for label, text in (("name", c["name"]), ("industry", c["industry"]), ("keywords", (F.col("keywords"),)), ("description", c["description"])):
        if profile.exclude_keywords:
            reasons.append(F.concat(F.lit("excluded keyword '"), first_keyword([text], profile.exclude_keywords), F.lit(f"' in {label}")))
    if profile.keywords:
        any_ = first_keyword([c["name"], c["industry"], (F.col("keywords"),), c["description"], (F.col("signal_titles"),)], profile.keywords)
        reasons.append(F.when(any_.isNull(), f"no ICP keyword [{shown(profile.keywords)}] in name, industry, keywords, description or signals"))
    for f in ("fit_location", "fit_size", "fit_industry"):
        bad = F.when(F.col(f)["status"] == False, F.col(f)["reason"])  # noqa: E712
        if not profile.unknown_passes:
            bad = bad.when(F.col(f)["status"].isNull(), F.concat(F.col(f)["reason"], F.lit(" (icp.unknown_passes is off)")))
        reasons.append(bad)
    return met.withColumn("reason", F.coalesce(*reasons)).drop("_listed")
