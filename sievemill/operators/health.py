"""How usable the extractions of a family are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each share adds to a score of 100.
WEIGHTS = {"type": 30, "balance": 25, "party": 20, "reference": 12, "account": 8, "fees": 5}
COUNTS = ("members", "accepted", "type_valid", "amount_parsed", "balance_expected", "balance_captured", "balance_parsed", "counterparty", "ref_real", "ref_synth", "account_expected", "account_captured", "fees_expected", "fees_captured")


def merged(health: DataFrame, *keys: str) -> DataFrame:
    """Counts of several clusters together."""
    return health.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in COUNTS))


def rate(name: str) -> Column:
    return F.when(F.col("members") == 0, F.lit(0.0)).otherwise(F.col(name) / F.col("members"))


def score() -> Column:
    """0 to 100. Missing accounts and fees cost only where a pattern declares them; rejected messages cost everything."""
    good = lambda what: F.when(F.col("members") == 0, F.lit(0.0)).otherwise((F.col("members") - F.col(f"{what}_expected") + F.col(f"{what}_captured")) / F.col("members"))
    raw = WEIGHTS["type"] * rate("type_valid") + WEIGHTS["balance"] * rate("balance_parsed") + WEIGHTS["party"] * rate("counterparty") + WEIGHTS["reference"] * rate("ref_real") + WEIGHTS["account"] * good("account") + WEIGHTS["fees"] * good("fees")
    return F.round(F.round(rate("accepted") * raw, 9)).cast("int")


def with_rates(health: DataFrame) -> DataFrame:
    """health with rates of four decimals and the score."""
    return health.withColumns({f"{c}_rate": F.round(rate(c), 4) for c in COUNTS[1:]} | {"health_score": score(), "app_accepted": (F.col("members") > 0) & (F.col("accepted") == F.col("members"))})


def reconciliation(families: DataFrame) -> DataFrame:
    """One row over success families with their counts: weighted mean score, shares in percent, low accepted families."""
    f = families.withColumns({"_score": score(), "_all": (F.col("members") > 0) & (F.col("accepted") == F.col("members"))})
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    share = lambda c: F.when(total("members") == 0, F.lit(0.0)).otherwise(F.round(total(c) / total("members") * 100, 2))
    return f.agg(
        F.when(total("members") == 0, F.lit(0)).otherwise(F.round(total(F.col("_score") * F.col("members")) / total("members"))).cast("int").alias("mean_health_score"),
        share("type_valid").alias("type_valid_share"),
        share("balance_captured").alias("balance_captured_share"),
        share("counterparty").alias("counterparty_share"),
        share("accepted").alias("app_accepted_share"),
        F.count_if(F.col("_all") & (F.col("_score") < 50)).alias("low_health_families"),
    )


def best_first(families: DataFrame) -> DataFrame:
    return families.orderBy(F.col("health_score").desc(), F.col("members").desc(), "template")
