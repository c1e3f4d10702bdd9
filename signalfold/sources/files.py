"""CSV and JSON files as tables of text or of records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: delimiters that are looked for and their names, keys that may wrap a list of records
DELIMITERS = (",", ";", "\t", "|")
DELIMITER_NAMES = {"tab": "\t", "\\t": "\t", "comma": ",", "semicolon": ";", "pipe": "|"}
WRAPPERS = ("items", "data", "results", "records", "rows", "companies", "leads", "jobs", "organizations", "accounts", "people", "contacts")
#: The characters of bytes 80 to 9F in latin-1 and in windows-1252, of those that windows-1252 has.
_HIGH = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
C1 = ("".join(map(chr, _HIGH)), bytes(_HIGH).decode("cp1252"))


def sniff_delimiter(header: str) -> str:
    """The delimiter most frequent outside quotes in a header line; a comma if there is none."""
    bare = re.sub(r'"[^"]*"', "", header)
    return max(DELIMITERS, key=bare.count)


def unique_headers(cells: list[str]) -> list[str]:
    """Trimmed names; an empty one becomes column_N, a repeated one gets its number."""
    names, seen = [], {}
    for n, cell in enumerate(cells, 1):
        name = (cell or "").strip() or f"column_{n}"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name} ({seen[name]})")
    return names


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None, skip_rows: int = 0, multi_line: bool = True) -> DataFrame:
    """All columns as trimmed text, missing cells as "", rows without any text dropped.

    The header is the first line with text after skip_rows lines. Without an encoding, UTF-8 is taken unless the text
    has bytes that it cannot hold, then windows-1252 (what
    that leaves open is read as latin-1). Cells with line breaks need multi_line, which reads a file in one
    task; skip_rows reads line by line and does without such cells. An empty file gives a table without columns.
    """
    lines = spark.read.text(path)
    if encoding is None:
        encoding = "ISO-8859-1" if lines.where(~F.is_valid_utf8("value")).limit(1).count() else "UTF-8"
    windows = encoding == "ISO-8859-1"
    decoded = lambda c: F.translate(c, *C1) if windows else c
    raw = spark.read.option("encoding", encoding).option("sep", "\x00").option("quote", "").csv(path, schema="value string") if encoding != "UTF-8" else lines
    top = [(r.value or "").lstrip("﻿") for r in raw.select(decoded(F.col("value")).alias("value")).take(skip_rows + 100)]
    at = next((i for i in range(skip_rows, len(top)) if top[i].strip()), None)
    if at is None:
        return spark.createDataFrame([], "struct<>")
    sep = DELIMITER_NAMES.get((delimiter or "").lower(), delimiter) or sniff_delimiter(top[at])
    if len(sep) != 1:
        raise ValueError(f"delimiter must be a single character, got {delimiter!r}")
    options = {"sep": sep, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}
    plain = spark.read.options(**options, inferSchema="false").csv(spark.sparkContext.parallelize([top[at]], 1)) if not spark.conf.get("spark.remote", None) else None
    names = unique_headers(list(plain.first()))
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    if skip_rows:
        # ids of the first partition count its lines from 0, those of others are far larger
        numbered = raw.withColumn("n", F.monotonically_increasing_id()).where(F.col("n") > at)
        rows = numbered.select(F.from_csv("value", schema, options).alias("r")).select("r.*")
    else:
        rows = spark.read.options(**options, encoding=encoding, multiLine=str(multi_line).lower(), header="true", enforceSchema="true").csv(path, schema=schema)
    cells = [decoded(F.trim(F.coalesce(F.col(f"c{i}"), F.lit("")))).alias(n) for i, n in enumerate(names)]
    filled = F.lit(False)
    for i in range(len(names)):
        filled = filled | (F.trim(F.coalesce(F.col(f"c{i}"), F.lit(""))) != "")
    return rows.where(filled).select(*cells)


def records_of(document: Column, records_path: str | None = None) -> Column:
    """The records (array of JSON text) of one JSON document: a list, a wrapped list or a single object."""
    text = F.trim(document)
    as_list = lambda c: F.from_json(c, "array<string>")
    if records_path:
        inner = F.get_json_object(text, f"$.{records_path}")
        found = F.when(inner.startswith("["), as_list(inner)).when(inner.startswith("{"), F.array(inner)).otherwise(F.raise_error(F.lit(f"records path {records_path!r} does not point to a list")))
    else:
        wrapped = [F.get_json_object(text, f"$.{k}") for k in WRAPPERS]
        found = F.when(text.startswith("["), as_list(text)).otherwise(F.coalesce(*[F.when(w.startswith("["), as_list(w)) for w in wrapped], F.array(text)))
    return F.filter(found, lambda r: F.trim(r).startswith("{"))


def read_json(spark: SparkSession, path: str, records_path: str | None = None) -> DataFrame:
    """(record) JSON text of each record of a JSON or JSON Lines file; a line that is no JSON fails the query.

    Files named .jsonl or .ndjson are read line by line in splits; others are whole documents, one a task.
    """
    if path.endswith((".jsonl", ".ndjson")):
        return _lines(spark.read.option("lineSep", "\n").text(path))
    whole = spark.read.text(path, wholetext=True).where(F.trim("value") != "")
    # the parser stops after one value, so more text after a first line that is JSON by itself makes JSON Lines
    body = F.regexp_replace("value", r"^\s+|\s+$", "")
    by_line = F.try_parse_json("value").isNull() | (body.contains("\n") & F.try_parse_json(F.substring_index(body, "\n", 1)).isNotNull())
    parsed = whole.where(~by_line).select(F.explode(records_of(F.col("value"), records_path)).alias("record"))
    other = whole.where(by_line).select(F.explode(F.split("value", "\n")).alias("value"))
    return parsed.unionAll(_lines(other))


def _lines(lines: DataFrame) -> DataFrame:
    text = F.trim("value")
    good = F.when(F.try_parse_json(text).isNotNull(), text).otherwise(F.raise_error(F.concat(F.lit("not valid JSON: "), F.substring(text, 1, 60))))
    lists = lines.where(text != "").select(good.alias("line"))
    each = F.when(F.col("line").startswith("["), F.from_json("line", "array<string>")).otherwise(F.array("line"))
    return lists.select(F.explode(F.filter(each, lambda r: F.trim(r).startswith("{"))).alias("record"))


def values(record: Column, *paths: str) -> Column:
    """The first value with text at these dotted paths of JSON text."""
    from ..functions.text import first_value

    return first_value(*[F.get_json_object(record, f"$.{p}") for p in paths])
