"""Column functions over dates; as_of is always given, so that runs can be repeated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("yyyy-M-d", "yyyy/M/d", "MMM d, yyyy", "d MMM yyyy", "MMMM d, yyyy", "d MMMM yyyy", "d.M.yyyy")
#: What may stand before a day.
SAID = r"(?i)^(?:posted|active|updated|published|reposted|listed|added)\s*:?\s*(?:on\s+)?"
#: Days of a unit, whose first letters may stand for it; hours count by whole days and less than that not at all.
UNITS = (("years?|yrs?|y", 365), ("months?|mos?", 30), ("weeks?|wks?|w", 7), ("days?|d", 1), ("hours?|hrs?|h", 1 / 24), ("minutes?|mins?|m|seconds?|secs?|s", 0))


def age_days(posted: Column, seen: Column, as_of: Column) -> Column:
    """Days since it was posted, else first seen; never below 0; null if neither is known."""
    day = F.coalesce(posted, seen)
    return F.when(day.isNotNull(), F.greatest(F.lit(0), F.datediff(as_of, day)))


def parse_when(c: Column, as_of: Column, order: str = "dmy") -> Column:
    """A day: ISO and written dates, seconds or milliseconds since 1970, "today", "3 days ago", "30+ d ago", "Posted 2w
    ago", and a/b/y as d/m/y or m/d/y by order, the other way if only that is a date; null for anything else."""
    text = F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")
    said = once_for(text, lambda x: once_for(F.regexp_replace(x, SAID, ""), lambda y: F.when(y == "", x).otherwise(y)))
    return once_for(F.lower(said), lambda t: _day_of(t, as_of, order))


def once_for(c: Column, f) -> Column:
    """f(c) with c computed once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _day_of(t: Column, as_of: Column, order: str) -> Column:
    near = F.when(t.isin("today", "just now", "just posted", "now", "new", "few seconds ago", "moments ago"), as_of).when(t == "yesterday", F.date_sub(as_of, 1))
    ago = r"^([0-9]{1,6}|an?|one) ?\+? ?(%s)\.? ?\+? ago$"
    for unit, days in UNITS:
        number = F.regexp_extract(t, ago % unit, 1)
        back = F.floor(F.coalesce(number.try_cast("int"), F.lit(1)) * F.lit(days)).cast("int")
        near = near.when(number != "", F.date_sub(as_of, back))
    number = F.when(t.rlike("^[0-9]{9,15}$"), t.try_cast("double"))
    epoch = F.to_date(F.timestamp_seconds(F.when(number > 1e12, number / 1000).otherwise(number)))
    as_day = lambda value, form: F.try_to_timestamp(value, F.lit(form)).cast("date")
    slash = r"(?i)^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})(?:[ t,]+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?:\.[0-9]+)?(?: ?[ap]\.?m\.?)?)?$"
    a, b, y = (F.regexp_extract(t, slash, k) for k in (1, 2, 3))
    turned = {"dmy": as_day(F.when(y != "", F.concat_ws("-", y, b, a)), "y-M-d"), "mdy": as_day(F.when(y != "", F.concat_ws("-", y, a, b)), "y-M-d")}
    slashed = [turned[order], turned["mdy" if order == "dmy" else "dmy"]]
    iso = as_day(F.nullif(F.regexp_extract(t, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("")), "yyyy-MM-dd")
    written = F.initcap(F.regexp_replace(F.regexp_replace(t, "^[a-z]{3}, ", ""), r" [0-9]{2}:[0-9]{2}:[0-9]{2}.*$", ""))
    # no text is of two of these kinds, and most are of the first
    return F.coalesce(iso, *slashed, near, epoch, *(as_day(written, f) for f in FORMATS))


def date_order(first: Column, second: Column) -> Column:
    """Aggregate: "mdy" or "dmy" by what most of a column's a/b/y dates allow; null without a majority."""
    mdy = F.sum(F.when((second > 12) & (first <= 12), 1).otherwise(0))
    dmy = F.sum(F.when((first > 12) & (second <= 12), 1).otherwise(0))
    return F.when(mdy > dmy, "mdy").when(dmy > mdy, "dmy")


def age_phrase(age: Column) -> Column:
    early = F.when(age.isNull(), "recently").when(age <= 0, "today").when(age == 1, "yesterday").when(age <= 6, "this week")
    return early.when(age <= 30, "recently").when(age <= 60, "a few weeks ago").otherwise("a while back")


def days_ago(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, " day ago").otherwise(" days ago"))


def posted_phrase(posted: Column, seen: Column, as_of: Column) -> Column:
    """When it was posted, else that the date is unknown and when it was first seen."""
    age, known = F.greatest(F.lit(0), F.datediff(as_of, posted)), F.greatest(F.lit(0), F.datediff(as_of, seen))
    first = F.concat(F.lit("date unknown (first seen "), F.when(known == 0, "today").otherwise(days_ago(known)), F.lit(")"))
    dated = F.when(age == 0, "posted today").otherwise(F.concat(F.lit("posted "), days_ago(age)))
    return F.when(posted.isNotNull(), dated).when(seen.isNotNull(), first).otherwise("date unknown")
