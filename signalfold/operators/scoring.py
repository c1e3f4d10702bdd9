"""Credits, scores and tiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS = (3, 7, 14, 30)
UNDATED = 0.25


def freshness_credit(age: Column, bands: tuple[int, ...] = BANDS) -> Column:
    """(n - i) / n in the i-th band, 0 past the last, a quarter without a date."""
    n = len(bands)
    out = F.when(age.isNull(), UNDATED)
    for i, b in enumerate(sorted(bands)):
        out = out.when(age <= b, (n - i) / n)
    return out.otherwise(0.0)


def volume_credit(volume: Column, full_at: float = 3) -> Column:
    if full_at <= 1:
        return F.when(volume >= 1, 1.0).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (volume - 1) / F.lit(float(full_at - 1))))


def fit_credit(*dimensions: Column, unknown: float = 0.5) -> Column:
    """Mean over dimensions that are true (1), false (0) or unknown."""
    return sum((F.coalesce(d.cast("double"), F.lit(unknown)) for d in dimensions), F.lit(0.0)) / len(dimensions)


#: Points of the parts of a score, and of the parts of intent.
WEIGHTS = {"intent": 40.0, "fit": 30.0, "reachability": 20.0, "extra": 10.0}
INTENT = {"fresh": 15.0, "volume": 10.0, "persistence": 10.0, "urgency": 5.0}


def intent_points(freshest: Column, volume: Column, persistent: Column, urgent: Column, bands=BANDS, full_at: float = 3, parts: dict | None = None, weight: float = WEIGHTS["intent"]) -> Column:
    """Points of the primary signals; none without one."""
    parts = parts or INTENT
    credits = {"fresh": freshness_credit(freshest, bands), "volume": volume_credit(volume, full_at), "persistence": persistent.cast("double"), "urgency": urgent.cast("double")}
    earned = sum((F.lit(float(parts[k])) * credits[k] for k in parts), F.lit(0.0))
    return F.when(volume > 0, earned / F.lit(sum(parts.values())) * F.lit(weight)).otherwise(0.0)


def intent_reasons(freshest: Column, volume: Column, persistent: Column, urgent: Column, reposted: Column, open_days: Column, stale_after: int = 21, bands=BANDS) -> Column:
    """Why a company has its points of intent."""
    credit, days = freshness_credit(freshest, bands), freshest.cast("string")
    fresh = F.when(freshest.isNull(), F.lit("signal date unknown")).when(credit >= 0.75, F.concat(F.lit("fresh signal ("), days, F.lit("d)")))
    fresh = fresh.when(credit > 0, F.concat(F.lit("signal "), days, F.lit("d old"))).otherwise(F.concat(F.lit("old signal ("), days, F.lit("d)")))
    least = F.when(reposted, min(7, stale_after)).otherwise(stale_after)
    why = F.concat_ws(" / ", F.when(reposted, F.lit("reposted")), F.when(open_days >= least, F.concat(F.lit("open "), open_days.cast("string"), F.lit("d"))))
    parts = [fresh, F.when(volume > 1, F.concat(volume.cast("string"), F.lit(" matching signals"))), F.when(persistent, F.when(why == "", "persistent need").otherwise(why)), F.when(urgent, F.lit("urgent language"))]
    return F.when(volume > 0, F.array_compact(F.array(*parts))).otherwise(F.array(F.lit("no primary signal")))


def person_credit(found: Column, title: Column, rank: Column, excluded: Column, any_title: bool = False) -> Column:
    """Share for the person: none without one or with an excluded title; any_title: no titles are asked for."""
    none = F.when(~found | F.coalesce(excluded & (title != ""), F.lit(False)), 0.0)
    return none.otherwise(0.8) if any_title else none.when(rank.isNull(), 0.3).when(rank == 0, 1.0).when(rank <= 2, 0.8).otherwise(0.6)


def email_credit(email: Column, status: Column) -> Column:
    """Share for the address: none without one, and that of unknown for a status of another name."""
    return F.when(F.coalesce(email, F.lit("")) == "", 0.0).when(status == "valid", 1.0).when(status == "risky", 0.5).when(status == "invalid", 0.0).otherwise(0.3)


def reachability_points(person: Column, email: Column, weight: float = WEIGHTS["reachability"]) -> Column:
    return (person * 0.5 + email * 0.5) * weight


def extra_credit(n_kinds: Column, each: float = 5.0, most: float = WEIGHTS["extra"]) -> Column:
    return F.least(F.lit(most), n_kinds * each)


def total(*parts: Column) -> Column:
    """Sum clamped to 0..100, rounded half to even."""
    s = sum(parts, F.lit(0.0))
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), s)), 0).cast("int")


def tier(score: Column, hot: int = 80, normal: int = 60) -> Column:
    return F.when(score >= hot, "hot").when(score >= normal, "normal").otherwise("skip")
