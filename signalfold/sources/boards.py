"""Job boards: the JSON bodies of three applicant-tracking systems as one table of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: where each system keeps its jobs and a job's fields (the first with a value counts)
LISTS = {"greenhouse": "$.jobs", "lever": "$.data", "ashby": "$.jobs"}
FIELDS = {
    "greenhouse": {"id": ["id"], "title": ["title"], "url": ["absolute_url"], "date": ["first_published", "updated_at"], "location": ["location.name", "location"], "description": ["content"]},
    "lever": {"id": ["id"], "title": ["text"], "url": ["hostedUrl", "applyUrl"], "date": ["createdAt"], "location": ["categories.location"], "description": ["descriptionPlain", "description"], "department": ["categories.department"], "team": ["categories.team"], "commitment": ["categories.commitment"]},
    "ashby": {"id": ["id"], "title": ["title"], "url": ["jobUrl", "applyUrl"], "date": ["publishedAt", "publishedDate"], "location": ["location"], "description": ["descriptionPlain", "descriptionHtml"], "department": ["department"], "team": ["team"], "commitment": ["employmentType"]},
}
ADDRESS = ("addressLocality", "addressRegion", "addressCountry")
JOB = ("id", "title", "url", "date", "location", "description", "department", "team", "commitment")


def _listed(job: Column, path: str, field: str | None = None) -> Column:
    """The texts of a list in a job, or of one field of its objects, joined by commas."""
    items = F.from_json(F.get_json_object(job, f"$.{path}"), "array<string>")
    texts = F.transform(items, lambda i: F.get_json_object(i, f"$.{field}")) if field else items
    return F.array_join(F.filter(texts, lambda t: F.coalesce(F.trim(t), F.lit("")) != ""), ", ")


def jobs(bodies: DataFrame, system: str, body: str = "body") -> DataFrame:
    """One row of text columns for each job of each body; the other columns are kept.

    A body that is null or no JSON has no jobs; one that reports an error (ok: false) fails the query. Jobs that are not
    listed are left out. A date in epoch milliseconds is written as a date.
    """
    b = F.col(body)
    error = F.get_json_object(b, "$.ok") == "false"
    items = F.when(error, F.raise_error(F.coalesce(F.get_json_object(b, "$.error"), F.lit("ok=false"))))
    if system == "lever":
        items = items.when(F.trim(b).startswith("["), F.from_json(b, "array<string>"))
    items = items.otherwise(F.from_json(F.get_json_object(b, LISTS[system]), "array<string>"))
    rows = bodies.select(*[c for c in bodies.columns if c != body], F.explode(items).alias("_job")).where(F.trim("_job").startswith("{"))
    job = F.col("_job")
    if system == "ashby":
        rows = rows.where(F.coalesce(F.get_json_object(job, "$.isListed"), F.lit("")) != "false")
    some = lambda c: F.when(F.trim(c) != "", c)
    cols = {n: F.coalesce(*[some(F.get_json_object(job, f"$.{p}")) for p in FIELDS[system][n]]) if n in FIELDS[system] else F.lit(None).cast("string") for n in JOB}
    if system == "greenhouse":
        cols["department"] = _listed(job, "departments", "name")
    elif system == "lever":
        cols["location"] = F.coalesce(cols["location"], _listed(job, "categories.allLocations"))
        cols["date"] = F.coalesce(F.to_date(F.timestamp_millis(cols["date"].try_cast("bigint"))).cast("string"), cols["date"])
    else:
        cols["location"] = F.coalesce(cols["location"], some(F.concat_ws(", ", *[some(F.get_json_object(job, f"$.address.postalAddress.{a}")) for a in ADDRESS])))
    return rows.select(*[c for c in rows.columns if c != "_job"], *[c.alias(n) for n, c in cols.items()])


def board_jobs(found: DataFrame, board: str, most: int) -> DataFrame:
    """The newest `most` jobs of each board, each id once; undated ones come last."""
    one = found.withColumn("place", F.row_number().over(Window.partitionBy(board, "id").orderBy(F.col("date").desc_nulls_last(), "title", "url"))).where("place = 1")
    order = Window.partitionBy(board).orderBy(F.col("date").desc_nulls_last(), "id")
    return one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
