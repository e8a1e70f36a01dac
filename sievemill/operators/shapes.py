"""Shapes of captured values: a pattern that all values of a field have, without any of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_DISTINCT, MOST_ALTERNATIVES, MOST_CHARS = 3, 4, 512
_RUN = r"[0-9]+|[A-Za-z]+|([^0-9A-Za-z])\1*"
_OUTSIDE, _INSIDE = r"([\\^$.|?*+()\[\]{}/])", r"([\\^\]\-])"


def quantifier(low: Column, high: Column) -> Column:
    """'' for exactly one, {n} or {low,high}."""
    return F.when((low == 1) & (high == 1), "").when(low == high, F.concat(F.lit("{"), low.cast("string"), F.lit("}"))).otherwise(F.concat(F.lit("{"), low.cast("string"), F.lit(","), high.cast("string"), F.lit("}")))


def _kind(run: Column) -> Column:
    return F.when(run.rlike("^[0-9]"), "digit").when(run.rlike("^[A-Za-z]"), "letter").otherwise(F.concat(F.lit("L"), F.substring(run, 1, 1)))


def field_shapes(spans: DataFrame, *keys: str) -> DataFrame:
    """(keys, field, regex, samples) from one row per raw value.

    Few distinct values give one class of what occurs; values of one to four structures give each structure with the
    least and greatest length of each run; more give a class with the least and greatest length."""
    by = [*keys, "field"]
    v = spans.select(*by, F.substring("value", 1, MOST_CHARS).alias("value"))
    stats = v.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), F.countDistinct("value").alias("n_distinct"), F.min(F.length("value")).alias("low"), F.max(F.length("value")).alias("high"), F.bool_or(F.col("value").rlike("[0-9]")).alias("digit"), F.bool_or(F.col("value").rlike("[A-Za-z]")).alias("letter"))
    distinct = v.distinct()
    odd = distinct.select(*by, F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit("([^0-9A-Za-z])"), F.lit(1)))).alias("c")).distinct()
    literals = odd.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: F.regexp_replace(c, _INSIDE, r"\\$1")), "").alias("literals"))
    runs = distinct.withColumn("runs", F.regexp_extract_all("value", F.lit(_RUN), F.lit(0)))
    runs = runs.withColumn("signature", F.array_join(F.transform("runs", _kind), "|"))
    long = runs.select(*by, "signature", F.posexplode("runs").alias("pos", "run"))
    tokens = long.groupBy(*by, "signature", "pos").agg(F.min(F.length("run")).alias("low"), F.max(F.length("run")).alias("high"), F.any_value("run").alias("run"))
    base = F.when(F.col("run").rlike("^[0-9]"), r"\d").when(F.col("run").rlike("^[A-Za-z]"), "[A-Za-z]").otherwise(F.regexp_replace(F.substring("run", 1, 1), _OUTSIDE, r"\\$1"))
    tokens = tokens.withColumn("token", F.concat(base, quantifier(F.col("low"), F.col("high"))))
    one = tokens.groupBy(*by, "signature").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda t: t["token"]), "").alias("alternative"))
    alternatives = one.groupBy(*by).agg(F.count(F.lit(1)).alias("n_structures"), F.sort_array(F.collect_list("alternative")).alias("alternatives"))
    same = lambda left, right: left.join(right, by, "left")
    out = same(same(stats, literals), alternatives)
    chars = F.concat(F.lit("["), F.when(F.col("digit"), r"\d").otherwise(""), F.when(F.col("letter"), "A-Za-z").otherwise(""), F.coalesce("literals", F.lit("")), F.lit("]"))
    exact = F.when(F.col("n_structures") == 1, F.get("alternatives", F.lit(0))).otherwise(F.concat(F.lit("(?:"), F.array_join("alternatives", "|"), F.lit(")")))
    regex = F.when(F.col("n_distinct") < LEAST_DISTINCT, F.concat(chars, F.lit("+"))).when(F.col("n_structures") > MOST_ALTERNATIVES, F.concat(chars, quantifier(F.col("low"), F.col("high")))).otherwise(exact)
    return out.select(*by, regex.alias("regex"), "samples")
