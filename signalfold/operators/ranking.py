"""Ranking, top rows, first rows and the greedy selection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_by(rows: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; order must be total. Spark keeps k rows a key before it shuffles."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def first_by(rows: DataFrame, key: str, order: list) -> DataFrame:
    """First row of each key; rows without a key all stay."""
    kept = top_by(rows.where(F.col(key).isNotNull()), [key], order, 1).drop("rank")
    return kept.unionByName(rows.where(F.col(key).isNull()))


def select_greedy(rows: DataFrame, client: str, order: list[str], company: str, persons: list[str], limit: int, schema) -> DataFrame:
    """Best rows of each client, one a company and one a person, `limit` at most; a rejected row blocks none.

    A client's rows pass through one task in order as a stream, and only the keys of accepted rows are held: `limit` of
    them at most. Rows of no client are a client of their own.
    """

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, n, companies, people = object(), 0, set(), set()
        for pdf in batches:
            keep = []
            for i, (who, firm, *ids) in enumerate(pdf[[client, company, *persons]].itertuples(index=False, name=None)):
                who = None if pd.isna(who) else who
                if who != at:
                    at, n, companies, people = who, 0, set(), set()
                if n >= limit or firm in companies:
                    continue
                keys = {(p, v) for p, v in zip(persons, ids, strict=True) if not pd.isna(v)}
                if keys & people:
                    continue
                keep.append(i)
                n += 1
                companies.add(firm)
                people |= keys
            if keep:
                yield pdf.iloc[keep]

    return rows.repartition(client).sortWithinPartitions(client, *order).mapInPandas(pick, schema)
