"""Replies as a stream: each is taken once, and each lead keeps its latest follow-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import StateTable

REPLIES = "lead_id string, from_email string, category string, received_at timestamp, due date, body string"


def read_replies(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """JSON lines of REPLIES that arrive as files under path; fields that are missing are null."""
    return spark.readStream.schema(REPLIES).option("maxFilesPerTrigger", files_per_batch).json(path)


def once(replies: DataFrame, late: str = "7 days") -> DataFrame:
    """replies without those of an address and time that came before; the state forgets what is `late`."""
    rows = replies.withColumn("from_email", F.lower(F.trim("from_email"))).where("from_email <> '' AND received_at IS NOT NULL")
    return rows.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["from_email", "received_at"])


def category_counts(replies: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(day, category, n) of replies by time received."""
    rows = replies.withWatermark("received_at", late).groupBy(F.window("received_at", window).alias("w"), "category")
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "category", "n")


def keep_followups(replies: DataFrame, table: StateTable, checkpoint: str) -> StreamingQuery:
    """Merge the latest follow-up of each lead into table (key lead_id, order received_at) until no file is left.

    A batch that is repeated after a failure changes nothing: the merge takes the later row of each key.
    """

    def merge(batch: DataFrame, _: int) -> None:
        rows = batch.where("due IS NOT NULL AND lead_id IS NOT NULL").select("lead_id", "from_email", "category", "received_at", "due")
        if not rows.isEmpty():
            table.merge(rows)

    return replies.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
