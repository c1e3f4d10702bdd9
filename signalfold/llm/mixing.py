"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

Documents of a source fall into hashed blocks, blocks are permuted by hash, and a source that needs more than its
size is taken in whole passes plus a remainder: the permuted blocks up to the target, where the one block across the
target is cut between documents. The block quotas of all sources are then split among output shards: each node of a
binary tree draws, without replacement, how many of its blocks of each source go left. Shards get disjoint ranges of
the permuted blocks and order their documents locally by hash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Output shards, if no other number is asked for.
SHARDS = 16
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """totals (source, size, docs) with no, weight and target.

    Sources in code-point order (null last) take the weights in turn. Together they take share times all sizes; a
    target stops at most times its size and the excess is shared anew by weight among the others, which settles at
    one level: target = min(most * size, level * weight). One row a source: a list of sources is small.
    """
    every = Window.partitionBy()
    no = F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1
    t = totals.withColumn("no", no).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("no", F.lit(len(weights))) + 1))
    t = t.withColumn("cap", F.col("size") * F.lit(float(most))).withColumn("full_at", F.col("cap") / F.col("weight"))
    upto = Window.partitionBy().orderBy("full_at", "no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("capped", F.sum("cap").over(upto)).withColumn("left", F.sum("weight").over(every) - F.sum("weight").over(upto))
    t = t.withColumn("wanted", F.sum("size").over(every) * F.lit(float(share)))
    # the level if exactly the sources up to this row were full; the lowest that reaches its own row is right
    t = t.withColumn("level", F.when(F.col("left") > 0, (F.col("wanted") - F.col("capped")) / F.col("left")))
    first = (F.col("wanted") / F.sum("weight").over(every)).alias("first")
    t = t.withColumn("next_at", F.lead("full_at").over(Window.partitionBy().orderBy("full_at", "no"))).withColumn("first", first)
    t = t.withColumn("least_at", F.min("full_at").over(every))
    fits = F.when((F.col("level") >= F.col("full_at")) & (F.col("level") <= F.col("next_at")), F.col("level"))
    t = t.withColumn("settled", F.when(F.col("first") <= F.col("least_at"), F.col("first")).otherwise(F.min(fits).over(every)))
    target = F.when(F.col("settled").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("settled") * F.col("weight")))
    return t.select("source", "no", "size", "docs", "weight", target.alias("target"))


def splitting_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """quotas[shard, source]: each node splits its blocks by a multivariate hypergeometric draw, evenly by shards."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(have: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        take = int(have.sum()) * (mid - lo) // (hi - lo)
        left, rest = np.zeros_like(have), int(have.sum())
        for s, n in enumerate(have.tolist()):  # conditional univariate draws
            left[s] = rng.hypergeometric(n, rest - n, take - int(left.sum())) if n and take > left.sum() else 0
            rest -= n
        split(left, lo, mid)
        split(have - left, mid, hi)

    split(np.array(quotas, np.int64), 0, shards)
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, shards: int = SHARDS, blocks: int = 4096, docs_per_block: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, places) for each row of docs.

    size is the word count (null or empty: 0). places lists (shard, position) of each copy of the document that the
    shards draw; copies is their number, taken = copies * size. A source has at most `blocks` blocks of docs_per_block
    documents or more. The last block that a source's shards draw is cut between documents: in hashed order those that
    fit, then those that fit what is left, so the taken words miss the target by less than half of the smallest document
    left. Null is a source of its own. Equal rows are taken alike except where they are cut; a source of size 0 has
    target 0 and is not taken. Sums are kept per block before they meet, so a source with most rows does not gather in
    one task. No rows give no rows. Extra columns are ignored.
    """
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = staged(sized, "sizes")
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")), weights, share, most)
    goals = goals.withColumn("passes", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0).cast("long")))
    goals = goals.withColumn("rest", F.col("target") - F.col("passes") * F.col("size")).withColumn("n_blocks", F.greatest(F.lit(1), F.least(F.lit(blocks), F.ceil(F.col("docs") / docs_per_block))).cast("int"))
    goals = staged(goals.withColumnRenamed("size", "source_size"), "mix-targets")
    # one row a source
    known = F.broadcast(goals) if goals.count() <= 100_000 else goals
    chance = F.xxhash64(F.lit(seed), F.col("doc_id"))
    placed = sized.join(known, sized["source"].eqNullSafe(goals["source"])).select(sized["source"], "no", "doc_id", sized["size"].alias("size"), "source_size", "target", "passes", "rest", "n_blocks", chance.alias("chance"))
    placed = placed.withColumn("block", F.pmod("chance", F.col("n_blocks")).cast("int"))
    table = placed.groupBy("no", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    order = Window.partitionBy("no").orderBy(F.xxhash64(F.lit(seed + 1), F.col("no"), F.col("block")), "block")
    table = table.withColumn("rank", F.row_number().over(order) - 1).withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    table = table.withColumn("n_ranks", F.count(F.lit(1)).over(Window.partitionBy("no")))  # blocks without documents have no rank
    before = F.col("upto") - F.col("words")
    table = table.withColumn("state", F.when(F.col("upto") <= F.col("rest"), F.lit(1)).when(before >= F.col("rest"), F.lit(0)).otherwise(F.lit(2))).withColumn("room", F.col("rest") - before)
    table = staged(table.select("no", "block", "passes", "rank", "n_ranks", "state", "room"), "mix-blocks")
    shard_of = _shards(table, shards, seed)
    few = table.count() <= 500_000
    chosen = placed.join(F.broadcast(table.drop("passes")) if few else table.drop("passes"), ["no", "block"])
    whole = chosen.where("state <> 2").withColumn("more", F.col("state") == 1)
    cut = _fitted(chosen.where("state = 2"))
    drawn = whole.unionByName(cut)
    drawn = drawn.join(F.broadcast(shard_of) if shard_of.count() <= 100_000 else shard_of, "no")
    # copy i of a block stands i whole passes behind its rank; the shards' ranges say whether it is drawn and by which
    at = lambda copy: F.col("rank") + copy.cast("long") * F.col("n_ranks")
    shard = lambda copy: F.size(F.filter("ends", lambda e: e <= at(copy)))
    is_drawn = lambda copy: (at(copy) < F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0))) & (F.col("more") | (copy < F.col("passes")))
    copies = F.filter(F.sequence(F.lit(0), F.lit(math.ceil(most))), is_drawn)
    places = F.transform(copies, lambda i: F.struct(shard(i).alias("shard"), F.xxhash64(F.lit(seed + 2), F.col("doc_id"), i).alias("position")))
    drawn = drawn.withColumn("places", places).withColumn("copies", F.size("places"))
    return drawn.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "places")


def _fitted(cut: DataFrame) -> DataFrame:
    """The documents of the blocks that are cut, one block a source, with `more`: whether this pass takes them."""
    of_source = Window.partitionBy("no")
    left = F.col("room") - F.coalesce(F.sum(F.when(F.col("more"), F.col("size"))).over(of_source), F.lit(0))
    cut = cut.withColumn("more", F.lit(False))
    for _ in range(3):
        cut = cut.withColumn("left", left).withColumn("fits", ~F.col("more") & (F.col("size") <= F.col("left")))
        order = of_source.orderBy(F.desc("fits"), "chance", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cut = cut.withColumn("more", F.col("more") | (F.col("fits") & (F.sum("size").over(order) - F.coalesce(F.sum(F.when(~F.col("fits"), F.col("size"))).over(order), F.lit(0)) <= F.col("left"))))
    least = F.row_number().over(of_source.orderBy("more", "size", "chance", "doc_id")) == 1
    cut = cut.withColumn("left", left).withColumn("least", least)
    return cut.withColumn("more", F.col("more") | (F.col("least") & (F.col("size") < 2 * F.col("left")))).drop("left", "fits", "least")


def _shards(table: DataFrame, shards: int, seed: int) -> DataFrame:
    """(no, ends): for each source, the ends of the shards' ranges of permuted blocks, from the splitting tree."""
    quota = table.groupBy("no").agg((F.first("passes") * F.count(F.lit(1)) + F.count(F.when(F.col("state") > 0, 1))).alias("quota"))
    rows = [(r["no"], int(r["quota"])) for r in quota.orderBy("no").collect()]  # two integers a source
    spark = table.sparkSession
    if not rows:
        return spark.sql("SELECT CAST(0 AS INT) AS no, CAST(array() AS ARRAY<BIGINT>) AS ends").where("false")
    ends = np.cumsum(splitting_tree([q for _, q in rows], shards, seed), axis=0).T.tolist()
    values = ", ".join(f"({no}, array({', '.join(f'{e}L' for e in row)}))" for (no, _), row in zip(rows, ends, strict=True))
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(no, ends)")


def mixed(docs: DataFrame, id_col: str = "doc_id", shard_col: str = "shard", position_col: str = "position", **options) -> DataFrame:
    """The rows of docs as often as mix() takes them, each shard in one partition, ordered by its drawn positions.

    shard_col and position_col come last; a column of docs of that name is left out. Rows of one id are all taken as
    often as the one of them that is taken most, so ids should differ. Shuffles docs by id, and what is taken by shard.
    """
    plan = mix(docs, id_col=id_col, **options)
    plan = plan.where("copies > 0").groupBy("doc_id").agg(F.max_by("places", F.size("places")).alias("places"))
    met = docs.alias("d").join(plan.alias("p"), F.col(f"d.{id_col}").cast("long").eqNullSafe(F.col("p.doc_id")))
    kept = [F.col(f"d.`{c}`") for c in docs.columns if c not in (shard_col, position_col)]
    rows = met.select(*kept, F.inline("p.places").alias(shard_col, position_col))
    return rows.repartitionById(options.get("shards", SHARDS), F.col(shard_col)).sortWithinPartitions(position_col)
