"""State tables as Parquet snapshots with keyed rewrites, and the rules of stages, verdicts and follow-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STAGES = ("found", "qualified", "verified", "exported", "replied", "won")
LOST = "lost"


def stage_rank(c: Column) -> Column:
    out = F.when(c == LOST, F.lit(-2))
    for i, s in enumerate(STAGES):
        out = out.when(c == s, F.lit(i))
    return out.otherwise(F.lit(-1))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last row of each key by order; a tie goes to the new rows."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, "_new")).alias("_row")).select(*keys, "_row.*").select(*old.columns)


def forward_only(events: DataFrame, key: str, stage: str, at: str) -> DataFrame:
    """(key, stage): the furthest stage of each key; lost wins once it has come."""
    lost = F.bool_or(F.col(stage) == LOST)
    return events.groupBy(key).agg(F.when(lost, F.lit(LOST)).otherwise(F.max_by(stage, F.struct(stage_rank(F.col(stage)), at))).alias("stage"))


def fresh_verdicts(emails: DataFrame, cache: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """emails (email) with the cached status of at most `days` days; of several verdicts of an address the latest."""
    fresh = cache.where(F.datediff(as_of, F.col("checked_at")) <= days).groupBy("email").agg(F.max_by("status", F.struct("checked_at", "status")).alias("status"))
    return emails.join(fresh, "email", "left")


class StateTable:
    """A snapshot in a folder: each write goes to a new folder and a pointer file names the current one."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str):
        self.spark, self.path, self.keys, self.order = spark, path, keys, order

    def _versions(self) -> list[int]:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = fs_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return []
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(fs_path) if s.getPath().getName().startswith("v") and fs.exists(done(s.getPath(), "_SUCCESS")))

    def read(self) -> DataFrame | None:
        versions = self._versions()
        return self.spark.read.parquet(f"{self.path}/v{versions[-1]}") if versions else None

    def merge(self, new: DataFrame) -> DataFrame:
        old = self.read()
        rows = upsert(old, new, self.keys, self.order) if old is not None else upsert(new.limit(0), new, self.keys, self.order)
        rows.write.parquet(f"{self.path}/v{(self._versions() or [0])[-1] + 1}")
        return self.read()
