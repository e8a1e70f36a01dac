"""How much of a corpus a catalog covers: overall, by bank, by type, and what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions.heuristic import looks_like_transaction
from sievemill.functions.normalize import truncated
from sievemill.functions.regexes import trimmed


def percent(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole * 100)


def overall(rows: DataFrame) -> DataFrame:
    """One row of totals; an empty corpus is covered by 0 percent."""
    out = rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("matched").alias("matched"),
        F.count_if(F.coalesce(F.col("extraction.accepted"), F.lit(False))).alias("app_accepted"),
        F.count_if(~F.col("matched") & F.col("bank_id").isNull()).alias("unattributed"),
        F.count_if("parse_error").alias("parse_errors"),
    )
    return out.withColumn("coverage_pct", percent(F.col("matched"), F.col("total"), 0.0))


def by_bank(rows: DataFrame) -> DataFrame:
    """Totals of each bank that messages are attributed to."""
    named = rows.where("bank_id is not null").groupBy("bank_id", "bank_name").agg(F.max("seq").alias("last"), F.count(F.lit(1)).alias("total"), F.count_if("matched").alias("matched"))
    out = named.groupBy("bank_id").agg(F.max_by("bank_name", "last").alias("bank_name"), F.sum("total").alias("total"), F.sum("matched").alias("matched"))
    return out.withColumns({"unmatched": F.col("total") - F.col("matched"), "coverage_pct": percent(F.col("matched"), F.col("total"), 100.0)})


def worst_first(banks: DataFrame) -> DataFrame:
    return banks.orderBy("coverage_pct", F.col("unmatched").desc(), "bank_id")


def largest_missing(clusters: DataFrame) -> DataFrame:
    """The unmatched cluster of highest rank of each bank."""
    best = Window.partitionBy("bank_id").orderBy(F.col("priority_rank").desc(), F.col("occurrences").desc(), "template")
    found = clusters.where("not matched and bank_id is not null").withColumn("place", F.row_number().over(best)).where("place = 1")
    return found.select("bank_id", "template", "occurrences", "priority")


def with_stream(clusters: DataFrame) -> DataFrame:
    """clusters with what becomes of them: success, attributed, candidate or noise (by the first example)."""
    shown = F.coalesce(F.get("examples", F.lit(0)), F.col("template"))
    kind = F.when(F.col("matched"), "success").when(F.col("bank_id").isNotNull(), "attributed").when(looks_like_transaction(shown), "candidate").otherwise("noise")
    return clusters.withColumn("stream", kind)


def messages_by_bank(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("bank_name", F.lit("Unknown")).alias("bank_name")).agg(F.count(F.lit(1)).alias("messages"))


def messages_by_type(rows: DataFrame) -> DataFrame:
    return rows.where("matched").groupBy(F.coalesce("tx_type", F.lit("UNKNOWN")).alias("tx_type")).agg(F.count(F.lit(1)).alias("messages"))


COUNTERS = ("dataset_malformed", "parse_errors", "normalization_degraded", "normalization_truncated", "clustering_skipped", "units_redacted", "unit_errors", "field_shape_fallbacks")


def quality(records: DataFrame, rows: DataFrame, units: DataFrame | None = None, shapes: DataFrame | None = None, invalid_patterns: int = 0) -> DataFrame:
    """One row of anomaly counts, each a sum of flags, and whether all that matter are zero; dropped blank bodies and invalid patterns don't.

    records: what was loaded, with body and, where the loader says so, malformed. rows: the messages with template, degraded and, if
    parsed, parse_error. units: units of an export (normalized_text, degraded). shapes: shapes of fields."""
    flag = lambda df, c: F.count_if(c) if c in df.columns else F.lit(0).cast("long")
    none = lambda *names: records.sparkSession.range(1).select(*(F.lit(0).cast("long").alias(n) for n in names))
    malformed = F.coalesce(F.col("malformed"), F.lit(False)) if "malformed" in records.columns else F.lit(False)
    loaded = records.agg(F.count_if(malformed).alias("dataset_malformed"), F.count_if(~malformed & (trimmed(F.coalesce("body", F.lit(""))) == "")).alias("dataset_empty_bodies"))
    normal = rows.agg(
        F.count(F.lit(1)).alias("messages_loaded"),
        flag(rows, "parse_error").alias("parse_errors"),
        flag(rows, "degraded").alias("normalization_degraded"),
        F.count_if(truncated(F.col("body"))).alias("normalization_truncated"),
        F.count_if(F.col("template").isNull()).alias("clustering_skipped"),
    )
    gone = F.col("normalized_text").isNull() & ~F.col("degraded")
    out = units.agg(F.count_if(~gone & ~F.col("degraded")).alias("units_exported"), F.count_if("degraded").alias("units_redacted"), F.count_if(gone).alias("unit_errors")) if units is not None else none("units_exported", "units_redacted", "unit_errors")
    coarse = shapes.agg(F.count_if(F.col("regex").isNull()).alias("field_shape_fallbacks")) if shapes is not None else none("field_shape_fallbacks")
    one = loaded.crossJoin(normal).crossJoin(out).crossJoin(coarse)  # four tables of one row
    clean = F.lit(True)
    for c in COUNTERS:
        clean = clean & (F.col(c) == 0)
    return one.select("*", F.lit(invalid_patterns).cast("long").alias("invalid_patterns"), clean.alias("clean"))
