"""Files for people and for mail tools: cells that a spreadsheet would run as a formula are guarded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import guard_cell


def guarded(rows: DataFrame) -> DataFrame:
    return rows.select(*[guard_cell(F.col(f"`{n}`")).alias(n) if kind == "string" else F.col(f"`{n}`") for n, kind in rows.dtypes])


def write_csv(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header and guarded cells; one_file gathers the rows and is for lists that a person reads."""
    out = guarded(rows)
    (out.coalesce(1) if one_file else out).write.csv(path, header=True, escape='"')


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path, ignoreNullFields=False)


def upload_rows(leads: DataFrame, steps: int, order: list[str], messages: str = "messages") -> DataFrame:
    """One row for each address (the first by `order`), its messages (array of struct<subject, body>) in columns."""
    from ..operators.ranking import first_by

    keyed = leads.withColumn("_email", F.lower(F.trim("email"))).where("_email <> ''")
    one = first_by(keyed, "_email", order)
    parts = [F.get(F.col(messages), F.lit(i)).getField(f).alias(f"{f}_{i + 1}") for i in range(steps) for f in ("subject", "body")]
    return one.select(*[c for c in leads.columns if c != messages], *parts)
