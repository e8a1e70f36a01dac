"""What may be shared: families with templates, counts, health and shapes, without any value or body."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.operators.health import with_rates

VERSION = 4
REASON = "normalization degraded — content withheld"


def _redacted(units: DataFrame) -> DataFrame:
    """Units of a degraded family keep their counts only."""
    hide = lambda c: F.when(~F.col("degraded"), F.col(c)).alias(c)
    return units.select(*(hide(c) if c in ("normalized_text", "verb", "direction", "shapes") else F.col(c) for c in units.columns))


def unmatched_units(families: DataFrame) -> DataFrame:
    """Units of the attributed and candidate streams; noise isn't shared."""
    f = families.where("stream in ('attributed', 'candidate')")
    extra = ["shapes"] if "shapes" in f.columns else []
    u = f.select("stream", F.col("template").alias("normalized_text"), "verb", "direction", F.col("total").alias("count"), F.col("bank_name").alias("bank"), F.lit(False).alias("matched"), "degraded", *extra)
    return _redacted(u)


def success_units(families: DataFrame) -> DataFrame:
    """Units of the success stream with their health; families hold the counts of health and pattern_desc."""
    f = with_rates(families)
    rates = [c for c in f.columns if c.endswith("_rate")]
    extra = ["shapes"] if "shapes" in f.columns else []
    u = f.select(F.col("template").alias("normalized_text"), "verb", "direction", F.col("members").alias("count"), F.col("bank_name").alias("bank"), F.lit(True).alias("matched"), "pattern_desc", "app_accepted", "health_score", *rates, "degraded", *extra)
    return _redacted(u)


def message_totals(overall: DataFrame) -> DataFrame:
    """The counts of messages in an export's metadata."""
    return overall.select(
        "total",
        F.col("matched").alias("regex_matched"),
        "app_accepted",
        (F.col("matched") - F.col("app_accepted")).alias("app_rejected"),
        (F.col("total") - F.col("matched")).alias("unparsed"),
        F.round("coverage_pct", 2).alias("parsed_percent"),
        "parse_errors",
    )


def shape_maps(shapes: DataFrame, *keys: str) -> DataFrame:
    """One map of field to (regex, samples) for each of the keys."""
    return shapes.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", F.struct("regex", "samples"))))).alias("shapes"))


def document(metadata: dict, unmatched: list[dict], success: list[dict]) -> dict:
    """The export document of collected units."""

    def unit(u: dict) -> dict:
        shapes = {f: {"regex": s["regex"], "samples": s["samples"]} for f, s in (u.get("shapes") or {}).items()}
        out = {"normalizedText": u["normalized_text"], "actionVerb": u["verb"], "direction": u["direction"], "shapeProfile": shapes, "count": u["count"], "bank": u["bank"], "matched": u["matched"]}
        if u["degraded"]:
            out = {"redacted": True, "reason": REASON, **out}
        if u["matched"]:
            r = lambda c: u[f"{c}_rate"]
            out |= {
                "patternDescription": u["pattern_desc"],
                "appAccepted": u["app_accepted"],
                "healthScore": u["health_score"],
                "health": {
                    "appAcceptedRate": r("accepted"),
                    "typeValidRate": r("type_valid"),
                    "amountRate": r("amount_parsed"),
                    "balance": {"expectedRate": r("balance_expected"), "capturedRate": r("balance_captured"), "parseRate": r("balance_parsed")},
                    "counterpartyRate": r("counterparty"),
                    "reference": {"realRate": r("ref_real"), "synthesizedRate": r("ref_synth")},
                    "accountCapturedRate": r("account_captured"),
                    "feesExpectedRate": r("fees_expected"),
                    "feesCapturedRate": r("fees_captured"),
                },
            }
        return out

    return {"metadata": {"version": VERSION, **metadata}, "unmatchedUnits": [unit(u) for u in unmatched], "successUnits": [unit(u) for u in success]}
