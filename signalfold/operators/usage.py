"""What a run spends: budgets of paid requests, prices of models and the cost of each adapter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metered(requests: DataFrame, budget: int = 0) -> DataFrame:
    """requests (run_id, pos, kind, type, paid, ...) with `blocked`: paid requests of a run beyond its budget, which are
    not made; 0 is no budget."""
    if not budget:
        return requests.withColumn("blocked", F.lit(False))
    place = F.sum(F.col("paid").cast("int")).over(Window.partitionBy("run_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return requests.withColumn("blocked", F.col("paid") & (place > budget))


def price_for(model: Column, prices: dict[str, tuple[float, float]], fallback: tuple[float, float]) -> tuple[Column, Column]:
    """(input, output) price of a million tokens: that of the model, else of a known model that its name goes on from."""
    def price(side: int) -> Column:
        exact = [F.when(model == name, F.lit(float(p[side]))) for name, p in prices.items()]
        longer = [F.when(model.startswith(f"{name}-"), F.lit(float(p[side]))) for name, p in prices.items()]
        return F.coalesce(*exact, *longer, F.lit(float(fallback[side])))

    return price(0), price(1)


def llm_cost(model: Column, given: Column, made: Column, prices: dict[str, tuple[float, float]], fallback: tuple[float, float]) -> Column:
    of_given, of_made = price_for(model, prices, fallback)
    tokens = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(0)))
    return (tokens(given) * of_given + tokens(made) * of_made) / 1_000_000


def usage_rows(requests: DataFrame, cost_per_call: dict[str, float], prices: dict[str, tuple[float, float]], fallback: tuple[float, float]) -> DataFrame:
    """(run_id, kind, type, paid, calls, blocked_by_budget, input_tokens, output_tokens, estimated_cost_usd) of metered
    requests, which may have model, input_tokens and output_tokens. An adapter with tokens costs what its models do, a
    paid one with a price its calls; others have no estimate."""
    made = ~F.col("blocked")
    tokens = lambda c: F.coalesce(F.sum(F.when(made, F.greatest(F.lit(0), F.col(c)))), F.lit(0))
    cost = F.sum(F.when(made, llm_cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens"), prices, fallback)))
    rows = requests.groupBy("run_id", "kind", "type").agg(F.bool_or("paid").alias("paid"), F.count_if(made).alias("calls"), F.count_if("blocked").alias("blocked_by_budget"), tokens("input_tokens").alias("input_tokens"), tokens("output_tokens").alias("output_tokens"), cost.alias("_llm"))
    each = F.coalesce(*[F.when(F.col("type") == name, F.lit(float(c))) for name, c in cost_per_call.items()], F.lit(None).cast("double"))
    estimate = F.when(F.col("input_tokens") + F.col("output_tokens") > 0, F.round("_llm", 4)).when(F.col("paid"), F.round(F.col("calls") * each, 4))
    return rows.withColumn("estimated_cost_usd", estimate).drop("_llm")


def run_costs(rows: DataFrame) -> DataFrame:
    """(run_id, paid_lookups, estimated_cost_usd) of usage_rows; no estimate if nothing has a price."""
    return rows.groupBy("run_id").agg(F.coalesce(F.sum(F.when(F.col("paid"), F.col("calls"))), F.lit(0)).alias("paid_lookups"), F.round(F.sum("estimated_cost_usd"), 4).alias("estimated_cost_usd"))
