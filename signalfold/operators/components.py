"""Staged tables and connected components, in DataFrame operations only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, one under /tmp in local mode, and an error on a cluster, whose
    machines share no such folder."""
    sc = spark.sparkContext
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if (set_already := sc._jsc.sc().getCheckpointDir()).isDefined():
        return set_already.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir("/tmp/checkpoints")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage is cut and the plan below it runs once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, for work that takes long for each row: a small file is a single task otherwise. A table of more
    tasks stays as it is."""
    spark = df.sparkSession
    n = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that no later read needs."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration() if hasattr(df.sparkSession, "_jsc") else df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of links (a long, b long); root is the smallest node that it reaches.

    Alternates large-star and small-star rounds. Every round writes its edges to the shared folder, so a lost executor
    repeats one round at most; neither links nor labels come to the driver, only a count and a checksum.
    Self-links and repeated links change nothing; no links give no rows. If the edges still change after
    max_rounds (the number of rounds grows with the logarithm of the largest component), it raises.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _mark(edges)
    if before[0] == 0:
        return _stars(edges)
    for _ in range(max_rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        new = staged(small, "small-star")
        discard(large)
        discard(edges)
        edges, after = new, _mark(new)
        if after == before:
            return _stars(edges)
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _stars(edges: DataFrame) -> DataFrame:
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)
