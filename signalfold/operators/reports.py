"""Funnels, counts with zeros, top reasons and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def funnel(rows: DataFrame, rank: Column, stages: list[str]) -> DataFrame:
    """(stage_no, stage, n, rate): how many reached each stage or a later one, and the share of the stage before."""
    counts = rows.agg(*[F.count_if(rank >= i).alias(f"s{i}") for i in range(len(stages))])
    long = counts.select(F.inline(F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(s).alias("stage"), F.col(f"s{i}").alias("n")) for i, s in enumerate(stages)])))
    before = F.lag("n").over(Window.orderBy("stage_no"))  # one row a stage
    return long.withColumn("rate", F.round(F.try_divide(F.col("n").cast("double"), before.cast("double")), 4))


def counts_with_zeros(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    labels = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(column))
    found = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return labels.join(found, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def top_counts(rows: DataFrame, column: str, k: int) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)
