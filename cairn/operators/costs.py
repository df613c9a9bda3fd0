"""Size and cost of pending annotation work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.json_body import json_source, usage_tokens
from cairn.functions.text import strip
from cairn.rules import DEFAULT_RULES, CostModel, Rules

LENGTH_EDGES = (20, 40, 60, 80, 100, 150, 200, 300, 500, 1000)


def body_chars() -> Column:
    return F.length(strip(F.coalesce("content", F.lit(""))))


def length_bucket(chars: Column) -> Column:
    """Eleven labelled length classes, numbered so that they sort."""
    label = F.lit(f"{len(LENGTH_EDGES) + 1:02d}: >{LENGTH_EDGES[-1]}")
    lows = (None, *LENGTH_EDGES)
    for i in reversed(range(len(LENGTH_EDGES))):
        span = f"<={LENGTH_EDGES[i]}" if lows[i] is None else f"{lows[i] + 1}-{LENGTH_EDGES[i]}"
        label = F.when(chars <= LENGTH_EDGES[i], f"{i + 1:02d}: {span}").otherwise(label)
    return label


def length_histogram(pending: DataFrame) -> DataFrame:
    """Pending calls per length class with their mean length."""
    chars = body_chars()
    return pending.groupBy(length_bucket(chars).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(chars), 1).alias("avg_chars")
    ).orderBy("bucket")


def usage_range(sentiment: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Token totals of real calls only; reused rows carry zeros and are left out."""
    rows = sentiment.filter(
        (F.col("method") == rules.annotated_method) & (json_source(F.col("raw_json")) == rules.annotated_method)
    ).select(usage_tokens(F.col("raw_json")).alias("tokens")).filter(F.col("tokens").isNotNull())
    return rows.agg(
        F.count(F.lit(1)).alias("usage_rows"),
        *[F.coalesce(f("tokens"), F.lit(0)).alias(f"{n}_tokens") for n, f in
          (("min", F.min), ("max", F.max), ("sum", F.sum))],
    )


def tokens_per_call(chars: Column, cost: CostModel) -> Column:
    """Upper estimate of one call: fixed prompt, text, output."""
    return F.lit(cost.fixed_prompt_tokens) + F.rint(chars * cost.tokens_per_char) + F.lit(cost.output_tokens)


def _price(calls: Column, tokens: Column, cost: CostModel) -> Column:
    share = cost.input_share * cost.price_input + cost.output_share * cost.price_output
    return F.round(calls * tokens * (share / 1_000_000), 2)


def cost_projection(pending: DataFrame, pending_reports: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Calls, weighted tokens per call and price bounds, in one row.

    The weighted mean uses the length class means, as the estimate is defined on classes.
    """
    cost = rules.cost
    chars = body_chars()
    extremes = pending.groupBy(length_bucket(chars).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(chars), 1).alias("avg_chars"),
        F.max(chars).alias("max_chars"), F.count_if(chars > cost.sample_max_chars).alias("longer"),
    )
    # The class mean enters as a whole number of characters.
    per_class = tokens_per_call(F.floor("avg_chars"), cost)
    work = extremes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("comment_calls"),
        F.coalesce(F.sum(F.col("n") * per_class) / F.sum("n"), tokens_per_call(F.lit(0), cost)).alias("weighted_tokens"),
        F.coalesce(F.max("max_chars"), F.lit(0)).alias("max_body_chars"),
        F.coalesce(F.sum("longer"), F.lit(0)).alias("longer_than_sample"),
    )
    reports = pending_reports.agg(F.count(F.lit(1)).alias("report_calls"))
    # Two one-row tables side by side: join on a constant key, not a cross product of data.
    row = work.withColumn("k", F.lit(1)).join(reports.withColumn("k", F.lit(1)), "k").drop("k")
    calls = F.col("comment_calls")
    report_price = F.round(F.col("report_calls") * (
        (cost.report_input_tokens * cost.price_input + cost.report_output_tokens * cost.price_output) / 1_000_000), 2)
    priced = row.withColumns({
        "comment_cost_min": _price(calls, F.lit(cost.measured_min), cost),
        "comment_cost_max": _price(calls, F.lit(cost.observed_max), cost),
        "comment_cost_conservative": _price(calls, F.col("weighted_tokens"), cost),
        "report_cost": report_price,
    })
    return priced.withColumns({
        "weighted_tokens": F.round("weighted_tokens", 1),
        "total_calls": calls + F.col("report_calls"),
        **{f"total_cost_{n}": F.round(F.col(f"comment_cost_{n}") + F.col("report_cost"), 2)
           for n in ("min", "max", "conservative")},
    })
