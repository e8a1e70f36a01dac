"""Clusters of messages with the same template, with what is known of each cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions.lexicon import annotation
from sievemill.functions.regexes import trimmed
from sievemill.operators.match import FLAG_COLUMNS

EXAMPLES, SPANS = 5, 500
#: Least occurrences of each priority, its name and its rank.
PRIORITIES = ((500, "Very High", 5), (100, "High", 4), (20, "Medium", 3), (5, "Low", 2))


def priority(count: Column) -> Column:
    out = F
    for least, name, _ in PRIORITIES:
        out = out.when(count >= least, name)
    return out.otherwise("Very Low")


def priority_rank(count: Column) -> Column:
    out = F
    for least, _, rank in PRIORITIES:
        out = out.when(count >= least, rank)
    return out.otherwise(1)


def readiness(template: Column) -> Column:
    """How well a pattern could be anchored in the template's fixed words."""
    anchors = F.regexp_count(F.regexp_replace(template, "<[A-Z]+>", " "), F.lit("(?<![A-Za-z0-9_])[A-Za-z]{2,}(?![A-Za-z0-9_])"))
    strong = F.contains(template, F.lit("<ACCOUNT>")) | F.contains(template, F.lit("<AMOUNT>")) | F.contains(template, F.lit("<REFERENCE>"))
    return F.when(strong & (anchors >= 6), "High").when((strong & (anchors >= 3)) | (anchors >= 8), "Medium").otherwise("Low")


def counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Occurrences of each template (within further keys)."""
    return rows.groupBy(*keys, "template").agg(F.count(F.lit(1)).alias("occurrences"))


def first_examples(rows: DataFrame, *keys: str, n: int = EXAMPLES) -> DataFrame:
    """The first n bodies of each template in input order, as an array; rank filters run before the shuffle."""
    by = [*keys, "template"]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("seq", "body"))).where(F.col("rank") <= n)
    return ranked.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", trimmed(F.col("body")).alias("body")))), lambda x: x["body"]).alias("examples"))


def mode_bank(rows: DataFrame, *keys: str) -> DataFrame:
    """The bank most messages of each template have; the one seen first of several. Messages without a bank don't vote."""
    by = [*keys, "template"]
    # names first, as a key: numbers alone are aggregated by hash, names would sort all messages
    named = rows.where("bank_id is not null").groupBy(*by, "bank_id", "bank_name").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high"))
    votes = named.groupBy(*by, "bank_id").agg(F.sum("n").alias("votes"), F.min("low").alias("first"), F.max_by("bank_name", "high").alias("bank_name"))
    return votes.groupBy(*by).agg(F.max_by(F.struct("bank_id", "bank_name"), F.struct("votes", -F.col("first"))).alias("b")).select(*by, "b.bank_id", "b.bank_name")


def health_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """How many messages of each template have each flag of the extraction."""
    flag = lambda c: F.count_if(F.col(f"extraction.{c}")).alias(c)
    return rows.where("matched").groupBy(*keys, "template").agg(F.count(F.lit(1)).alias("members"), flag("accepted"), *map(flag, FLAG_COLUMNS))


def top_description(rows: DataFrame, members: DataFrame, *by: str) -> DataFrame:
    """The pattern that most messages of each key of members (template and by) matched; the one seen first of several.

    Messages are counted by template and pattern before they meet the members."""
    found = rows.where("matched and pattern_desc <> ''").groupBy("template", "pattern_desc").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    found = found.join(members, "template").groupBy(*by, "pattern_desc").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return found.groupBy(*by).agg(F.max_by("pattern_desc", F.struct("n", -F.col("first"))).alias("pattern_desc"))


def clusters(rows: DataFrame) -> DataFrame:
    """Every cluster of parsed, normalized messages: matched, template, occurrences, examples, bank, priority, readiness, degraded (if one of its
    messages is). Messages without a template are in none."""
    keys = ("matched",)
    rows = rows.where("template is not null")
    bad = F.bool_or("degraded") if "degraded" in rows.columns else F.lit(False)
    size = rows.groupBy(*keys, "template").agg(F.count(F.lit(1)).alias("occurrences"), bad.alias("degraded"))
    out = size.join(first_examples(rows, *keys), ["matched", "template"]).join(mode_bank(rows, *keys), ["matched", "template"], "left")
    found = out.select("*", priority(F.col("occurrences")).alias("priority"), priority_rank(F.col("occurrences")).alias("priority_rank"), readiness(F.col("template")).alias("readiness"))
    return found.withColumn("_a", annotation(F.col("template"))).select("*", "_a.verb", "_a.direction").drop("_a")


def span_values(rows: DataFrame, *keys: str, most: int = SPANS) -> DataFrame:
    """The first `most` raw values of each field of each template, in order of message, rule and place."""
    by = [*keys, "template", "field"]
    long = rows.select(*keys, "template", "seq", F.explode("spans").alias("s")).select(*keys, "template", "seq", "s.rule", "s.field", F.posexplode("s.values").alias("pos", "value"))
    ranked = long.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("seq", "rule", "pos")))
    return ranked.where(F.col("rank") <= most).select(*by, "rank", "value")
