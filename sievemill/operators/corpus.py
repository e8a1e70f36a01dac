"""Merging corpora and fingerprints that don't depend on order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash ranges of a fingerprint: each is hashed by itself, so no task holds the whole corpus.
RANGE_DIGITS = 2


def union(*sources: tuple[str, DataFrame]) -> DataFrame:
    """Messages of several sources with the source's name and place among them."""
    return reduce(DataFrame.unionByName, (df.withColumns({"source": F.lit(name), "source_ord": F.lit(i)}) for i, (name, df) in enumerate(sources)))


def deduplicated(messages: DataFrame) -> DataFrame:
    """The first message of each address and body, by source, then place. A null address is one of its own."""
    w = Window.partitionBy("address", "body").orderBy("source_ord", "seq")
    return messages.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def merge_counts(messages: DataFrame) -> DataFrame:
    """One row: total, unique and duplicates over all sources."""
    keys = messages.groupBy("address", "body").agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_input"), F.count(F.lit(1)).alias("unique_count")).withColumn("duplicates_removed", F.col("total_input") - F.col("unique_count"))


def source_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("source").agg(F.count(F.lit(1)).alias("messages"))


def fingerprint(keys: DataFrame, *columns: str) -> DataFrame:
    """(id): 16 hexadecimal digits of the distinct rows' contents, whatever their order.

    Each value is hashed with its length before it and null apart from every text, so no two rows look alike. Rows are hashed, hashes of a range
    are joined in order and hashed, then the ranges'."""
    parts = (F.col(c).cast("string") for c in columns)
    key: Column = F.sha2(F.concat(*(F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in parts)), 256)
    h = keys.select(key.alias("h")).distinct().withColumn("range", F.substring("h", 1, RANGE_DIGITS))
    ranges = h.groupBy("range").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    return ranges.agg(F.substring(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("range", "h"))), lambda s: s["h"]), ""), 256), 1, 16).alias("id"))
