"""Planning of model work: token estimates, budgets, tiers and page plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import first_of

#: Margin on estimates, tokens kept back, seconds per candidate, tolerated slowness, throttles.
MARGIN, RESERVE, LOCAL_SECONDS, RULE_SECONDS, TOLERANCE = 1.4, 30_000, 1.54, 0.3, 1.5
TOKENS_A_MINUTE, REQUESTS_A_MINUTE, SECONDS_A_REQUEST = 8000, 30, 1.8
BATCH, SAMPLES, TOKENS_OUT, CHARS_PER_TOKEN = 24, 12, 58, 3.4


def usage_today(ledger: DataFrame, day: str) -> DataFrame:
    """(provider, prompt_tokens, completion_tokens, requests, chars, last_remaining) of one UTC day."""
    own = ledger.where(F.to_date("at") == F.lit(day).cast("date"))
    is_usage = F.col("t") == "usage"
    total = lambda c: F.coalesce(F.sum(F.when(is_usage, F.col(c))), F.lit(0)).cast("bigint")
    last = F.max_by(F.when(~is_usage, F.col("req_remaining")), F.when(~is_usage, F.col("line")))
    return own.groupBy("provider").agg(
        total("pt").alias("prompt_tokens"), total("ct").alias("completion_tokens"), total("req").alias("requests"), total("chars").alias("chars"), last.alias("last_remaining")
    )


def headroom(usage: DataFrame, token_cap: int, request_cap: int) -> DataFrame:
    """usage with tokens and requests left; what a provider last stated goes before what was counted."""
    tokens = F.greatest(F.lit(0).cast("bigint"), F.lit(token_cap) - F.col("prompt_tokens") - F.col("completion_tokens"))
    requests = F.greatest(F.lit(0).cast("bigint"), F.coalesce("last_remaining", F.lit(request_cap) - F.col("requests")))
    return usage.withColumns({"tokens_left": tokens, "requests_left": requests})


def chars_per_token(chars: Column, prompt_tokens: Column) -> Column:
    """Measured, or null below 2,000 prompt tokens."""
    return F.when(prompt_tokens >= 2000, F.try_divide(chars, prompt_tokens))


def estimate_tokens(batched: DataFrame, overhead: int = 1200, per_token: float = CHARS_PER_TOKEN) -> DataFrame:
    """(document_id, candidates, requests, tokens) of candidates in batches(document_id, page, batch, tight).

    Input tokens come from at most twelve batches of a document, evenly spaced in reading order.
    """
    sizes = batched.groupBy("document_id", "page", "batch").agg(F.count("*").alias("n"), F.sum(F.length("tight")).alias("chars"))
    order = Window.partitionBy("document_id").orderBy("page", "batch")
    ranked = sizes.withColumns({"i": F.row_number().over(order) - 1, "k": F.count("*").over(Window.partitionBy("document_id"))})
    step = F.floor(F.col("i") * SAMPLES / F.col("k"))
    sampled = (F.col("k") <= SAMPLES) | (step != F.floor((F.col("i") - 1) * SAMPLES / F.col("k"))) | (F.col("i") == 0)
    out = ranked.groupBy("document_id").agg(
        F.sum("n").alias("candidates"), F.count("*").alias("requests"), F.avg(F.when(sampled, F.col("chars") + overhead)).alias("mean_chars")
    )
    tokens = F.ceil(F.col("requests") * F.col("mean_chars") / per_token + F.col("candidates") * TOKENS_OUT)
    return out.select("document_id", "candidates", "requests", tokens.cast("bigint").alias("tokens"))


def etas(tokens: Column, requests: Column, candidates: Column) -> tuple[Column, Column]:
    """Seconds in the cloud, under its throttles, and locally."""
    cloud = F.greatest(tokens / TOKENS_A_MINUTE * 60, requests / REQUESTS_A_MINUTE * 60, requests * F.lit(SECONDS_A_REQUEST))
    return cloud, candidates * F.lit(LOCAL_SECONDS)


def route(estimates: DataFrame, tokens_left: Column, requests_left: Column, cloud: bool = True, local: bool = True) -> DataFrame:
    """estimates(document_id, candidates, requests, tokens) with tier: cloud, local or rules."""
    e = F.col
    cloud_eta, local_eta = etas(e("tokens"), e("requests"), e("candidates"))
    spendable = F.greatest(F.lit(0), tokens_left - RESERVE)
    affordable = F.lit(cloud) & (F.ceil(e("tokens") * MARGIN) <= spendable) & (e("requests") <= requests_left)
    at_hand = F.lit(local)
    slow = cloud_eta > local_eta * TOLERANCE
    tier = first_of([(affordable & at_hand & slow, F.lit("local")), (affordable, F.lit("cloud")), (at_hand, F.lit("local"))], F.lit("rules"))
    return estimates.withColumns({"cloud_seconds": F.round(cloud_eta, 3), "local_seconds": F.round(local_eta, 3), "tier": tier})


def plan_pages(pages: DataFrame, budget_seconds: float, seconds: float = LOCAL_SECONDS) -> DataFrame:
    """pages(document_id, page, density) that fit the budget, densest first; the first is always kept."""
    order = Window.partitionBy("document_id").orderBy(F.desc("density"), "page")
    cost = F.sum(F.col("density") * seconds).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = pages.where("density > 0").withColumns({"rank": F.row_number().over(order), "spent": F.round(cost, 6)})
    return ranked.where((F.col("spent") <= budget_seconds) | (F.col("rank") == 1))
