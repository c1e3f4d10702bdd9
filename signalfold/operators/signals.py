"""Signal stage: duplicates, types, ages, history, repeats and statistics by company."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import age_days
from ..functions.matching import keyword_match
from ..functions.text import normalize_text


def fingerprint(kind: Column, title: Column) -> Column:
    return F.concat(F.coalesce(kind, F.lit("")), F.lit(":"), normalize_text(title))


def drop_repeats(signals: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given total order."""
    ranked = signals.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def with_age(signals: DataFrame, as_of: Column) -> DataFrame:
    return signals.withColumn("age", age_days(F.col("posted_at"), F.col("first_seen"), as_of))


def is_urgent(title: Column, description: Column, words: list[str]) -> Column:
    hit = [keyword_match(c, words).isNotNull() for c in (title, description)] if words else [F.lit(False)]
    return F.coalesce(reduce(lambda x, y: x | y, hit), F.lit(False))


def signal_stats(signals: DataFrame, by: str = "company_key", stale_after: int | None = None) -> DataFrame:
    """Age of the freshest, count, whether any is a repost or stale_after days old, whether any is urgent, the distinct
    secondary types, and how many days the oldest has been visible; signals has age, reposted, urgent and is_primary."""
    main = F.col("is_primary")
    lasting = F.col("reposted") if stale_after is None else F.col("reposted") | F.coalesce(F.col("age") >= stale_after, F.lit(False))
    return signals.groupBy(by).agg(
        F.min(F.when(main, F.col("age"))).alias("freshest"), F.count_if(main).alias("volume"), F.coalesce(F.bool_or(lasting & main), F.lit(False)).alias("persistent"),
        F.coalesce(F.bool_or(F.col("urgent") & main), F.lit(False)).alias("urgent"), F.count_distinct(F.when(~main, F.col("kind"))).alias("n_secondary"),
        F.coalesce(F.bool_or(F.col("reposted") & main), F.lit(False)).alias("reposted"), F.coalesce(F.max(F.when(main, F.col("age"))), F.lit(0)).alias("open_days"),
    )


HISTORY = ["company_key", "fingerprint", "external_id", "first_seen", "last_seen"]


def observe(batch: DataFrame, history: DataFrame, as_of: Column, gap: int = 7) -> DataFrame:
    """batch (company_key, fingerprint, external_id, posted_at, first_seen, reposted, ...) with first_seen and reposted
    as the history (HISTORY) says.

    first_seen is the earliest day that the company had this title. It is reposted if the title was seen under another
    id that this batch no longer has, or was posted `gap` days or more after its own id (without an id: its title) was
    first seen. The batch does not count as history of itself. Null ids are empty ones.
    """
    keys = ["company_key", "fingerprint"]
    rows = batch.withColumn("external_id", F.coalesce("external_id", F.lit("")))
    past = history.where(F.col("first_seen").isNotNull()).groupBy(*keys).agg(F.min("first_seen").alias("_earliest"), F.collect_set(F.when(F.col("external_id") != "", F.col("external_id"))).alias("_ids"))
    live = rows.groupBy(*keys).agg(F.collect_set("external_id").alias("_live"))
    gone = past.join(live, keys).select(*keys, "_earliest", (F.size(F.array_except("_ids", "_live")) > 0).alias("_gone"))
    own = history.where("external_id <> ''").groupBy(*keys, "external_id").agg(F.min("first_seen").alias("_own"))
    met = rows.join(gone, keys, "left").join(own, [*keys, "external_id"], "left")
    seen = F.coalesce("_earliest", "first_seen", F.least("posted_at", as_of), as_of)
    met = met.withColumn("first_seen", seen)
    known = F.when(F.col("external_id") == "", F.col("first_seen")).otherwise(F.col("_own"))
    late = F.coalesce(F.datediff("posted_at", known) >= gap, F.lit(False))
    moved = (F.col("external_id") != "") & F.coalesce("_gone", F.lit(False))
    return met.withColumn("reposted", F.coalesce("reposted", F.lit(False)) | moved | late).select(*batch.columns)


def history_after(batch: DataFrame, history: DataFrame, as_of: Column) -> DataFrame:
    """The history with an observed batch: new ids come with their first day, ids met again only with a new last day."""
    new = batch.select("company_key", "fingerprint", F.coalesce("external_id", F.lit("")).alias("external_id"), F.least("first_seen", as_of).alias("first_seen"), as_of.alias("last_seen"), F.lit(1).alias("_new"))
    both = history.select(*HISTORY, F.lit(0).alias("_new")).unionByName(new)
    return both.groupBy(*HISTORY[:3]).agg(F.min_by("first_seen", F.struct("_new", "first_seen")).alias("first_seen"), F.max("last_seen").alias("last_seen"))


def drop_reason(kinds: list[str] | None, max_age: int | None, keep_undated: bool = True, keep_reposts: bool = True) -> Column:
    """Why a signal goes: its type, no date, an age over the limit or a repost; null if it stays."""
    tests = []
    if kinds:
        tests.append(F.when(~F.col("kind").isin(kinds), "type"))
    if not keep_undated:
        tests.append(F.when(F.col("is_primary") & F.col("posted_at").isNull(), "undated"))
    if max_age is not None:
        tests.append(F.when(F.col("age") > max_age, "old"))
    if not keep_reposts:
        tests.append(F.when(F.col("is_primary") & F.col("reposted"), "reposted"))
    return F.coalesce(*tests, F.lit(None).cast("string"))


IDENTITY = ["company_key", "fingerprint", "external_id", "url", "location", "posted_at"]


def marked(signals: DataFrame, primary: list[str], kinds: list[str] = (), match: list[str] = (), exclude: list[str] = (), match_description: bool = True) -> DataFrame:
    """One row of each IDENTITY (the one of least pos) with kind normalised, is_primary, and why it goes before it is
    observed: type, excluded (with the keyword) or no match; null if it stays."""
    rows = signals.withColumn("kind", F.lower(F.trim(F.coalesce("kind", F.lit(""))))).withColumn("fingerprint", fingerprint(F.col("kind"), F.col("title")))
    rows = drop_repeats(rows, IDENTITY, ["pos"]).withColumn("is_primary", F.col("kind").isin(*[p.strip().lower() for p in primary]))
    tests, hit = [], F.lit(None).cast("string")
    if kinds:
        tests.append(F.when(~F.col("kind").isin(*[k.strip().lower() for k in kinds]), "type"))
    if exclude:
        hit = keyword_match(F.col("title"), list(exclude))
        tests.append(F.when(hit.isNotNull(), "excluded"))
    if match:
        found = keyword_match(F.col("title"), list(match)).isNotNull()
        found = found | keyword_match(F.col("description"), list(match)).isNotNull() if match_description else found
        tests.append(F.when(F.col("is_primary") & ~F.coalesce(found, F.lit(False)), "no match"))
    return rows.withColumn("drop", F.coalesce(*tests, F.lit(None).cast("string"))).withColumn("drop_word", hit)


def process(signals: DataFrame, history: DataFrame, as_of: Column, primary: list[str], kinds: list[str] = (), match: list[str] = (), exclude: list[str] = (), match_description: bool = True, max_age: int | None = None, keep_undated: bool = True, keep_reposts: bool = True) -> DataFrame:
    """signals (company_key, pos, kind, title, description, external_id, url, location, posted_at, first_seen, reposted)
    without exact repeats, with age, is_primary, `drop` (why it goes, null if it stays) and `place` among the company's
    live signals: primary ones first, then the freshest, undated ones last.

    Several live signals of one title are openings beside each other: they are reposts only if the source says so.
    """
    rows = marked(signals, primary, kinds, match, exclude, match_description)
    stay = rows.where("drop IS NULL").withColumn("_said", F.coalesce("reposted", F.lit(False)))
    seen = observe(stay, history, as_of)
    alike = F.count(F.lit(1)).over(Window.partitionBy("company_key", "fingerprint"))
    seen = seen.withColumn("reposted", F.col("_said") | (F.col("reposted") & (alike == 1))).drop("_said")
    seen = with_age(seen, as_of).withColumn("drop", drop_reason(None, max_age, keep_undated, keep_reposts))
    order = Window.partitionBy("company_key").orderBy(F.col("drop").isNotNull(), ~F.col("is_primary"), F.col("age").asc_nulls_last(), "pos")
    live = seen.withColumn("place", F.when(F.col("drop").isNull(), F.row_number().over(order)))
    gone = rows.where("drop IS NOT NULL").withColumn("age", F.lit(None).cast("int")).withColumn("place", F.lit(None).cast("int"))
    return live.unionByName(gone)


def preview(words: Column, most: int = 5) -> Column:
    more = F.size(words) - most
    return F.concat(F.array_join(F.slice(words, 1, most), ", "), F.when(more > 0, F.concat(F.lit(", +"), more.cast("string"), F.lit(" more"))).otherwise(""))


def rejections(processed: DataFrame, companies: DataFrame, kinds: list[str] = (), match: list[str] = (), max_age: int | None = None) -> DataFrame:
    """(company_key, reason) of the companies without a live signal; processed is process()'s."""
    count = lambda why: F.count_if(F.col("drop") == why)
    words = lambda why, c: F.array_sort(F.collect_set(F.when(F.col("drop") == why, F.when(F.col(c) == "", "untyped").otherwise(F.col(c)))))
    sums = processed.groupBy("company_key").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("drop").isNull()).alias("live"), count("type").alias("n_type"), count("excluded").alias("n_excluded"), count("no match").alias("n_match"),
        count("old").alias("n_old"), count("reposted").alias("n_reposted"), count("undated").alias("n_undated"), words("type", "kind").alias("types"), words("excluded", "drop_word").alias("hits"),
    )
    met = companies.select("company_key").distinct().join(sums, "company_key", "left").where(F.coalesce("live", F.lit(0)) == 0)
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    only_type = F.col("n_type") == F.col("total")
    base = F.when(only_type & F.lit(bool(kinds)), F.concat(F.lit("no signal of an accepted type ["), preview(lits(kinds)) if kinds else F.lit(""), F.lit("]")))
    base = base.otherwise(F.concat(F.lit("no signal matching ["), preview(lits(match)), F.lit("]")) if match else F.lit("no qualifying signal"))
    if max_age is not None:
        base = F.concat(base, F.when(~only_type, f" in last {max_age} days").otherwise(""))

    def part(n: str, text: str, names: str | None = None) -> Column:
        tail = F.concat(F.lit(" ("), preview(F.col(names)), F.lit(")")) if names else F.lit("")
        return F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(f" {text}"), tail))

    parts = F.concat_ws("; ", part("n_type", "of another type", "types"), part("n_excluded", "excluded by keyword", "hits"), part("n_match", "not matching"), part("n_old", f"older than {max_age} days"), part("n_reposted", "re-posted (stale listing)"), part("n_undated", "without a posting date"))
    found = F.concat(F.col("total").cast("string"), F.when(F.col("total") == 1, " signal found: ").otherwise(" signals found: "))
    reason = F.when(F.coalesce("total", F.lit(0)) == 0, "no buying signal found").when(parts == "", base).otherwise(F.concat(base, F.lit(" ("), found, parts, F.lit(")")))
    return met.select("company_key", reason.alias("reason"))


def first_seen(history: DataFrame, keys: list[str], day: str) -> DataFrame:
    return history.groupBy(*keys).agg(F.min(day).alias("first_seen"), F.max(day).alias("last_seen"), F.count(F.lit(1)).alias("n"))
