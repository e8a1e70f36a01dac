"""Mixing sources to target weights: each source's documents in hash-random order, cut at its exact budget.

The order is that of a hash of id and text. Hash ranges split even a source that holds most rows; words are summed by range
first, so only a small table of ranges is accumulated per source, and each document's place is found within its
own range. Texts are read once; what is needed of them is written."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.llm.shared import HOT, own_columns, stored

#: About how many rows a hash range has; one of RANGE * EXCESS rows, and of one in HOT rows, is full of equal rows and is split among them.
RANGE, EXCESS = 4096, 16
WEIGHTS = (1, 2, 3)
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """Targets of sources (source, source_size): weights repeat over the sources by code point, null last.

    Targets share the total by weight, but none is above `most` times its source. In the order of
    most * size / weight, the first sources are at that bound and the others share the rest by weight."""
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    by_bound = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    up_to, rest, everything = by_bound.rowsBetween(Window.unboundedPreceding, Window.currentRow), by_bound.rowsBetween(Window.currentRow, Window.unboundedFollowing), Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(ranked) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("weight", weight.cast("double")).withColumn("ratio", most * F.col("source_size") / F.col("weight"))
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    # the level that this source and all after it would get, were all before it at their bound
    s = s.withColumn("level", (F.col("total") - most * (F.sum("source_size").over(up_to) - F.col("source_size"))) / F.sum("weight").over(rest))
    s = s.withColumn("open_level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(everything)["level"])
    return s.select("source", "source_size", F.least(most * F.col("source_size").cast("double"), F.coalesce(F.col("open_level") * F.col("weight"), most * F.col("source_size").cast("double"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: str = "mix", row_col: str | None = None) -> DataFrame:
    """How many words of each document a mix of the sources takes.

    Returns id_col, row_col (a key of the rows, if one is named), size (words of the text; null: 0), source_size, target (of its source) and
    taken: whole epochs of a source, then its documents by hash key until the budget, the target rounded, is used up; the document at
    the cut gives a part. So a source's taken words are exactly its rounded target, and none of its documents gives
    more than `most` times its size. Documents with a null source are a source of their own, the last; an empty source takes
    nothing. Null and repeated ids are told apart by their texts; rows equal in both follow each other and are interchangeable. Whole texts are
    counted, however long. Other columns are ignored, whatever their names. An empty table gives an empty one.

    Sources are ranked in one task: their number, not their size, must fit there."""
    rows = [row_col] * bool(row_col)
    d = own_columns(docs, id_col, source_col, text_col, *rows).toDF("id", "source", "text", *["row"] * bool(row_col))
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    d = stored(d.select("id", "source", *["row"] * bool(row_col), n_words(F.col("text")).alias("size"), key.alias("key"), F.spark_partition_id().alias("part")), "sizes")
    n = d.count()
    digits = max(1, math.ceil(math.log(max(n, 1) / RANGE, 16)))
    d = d.withColumn("bin", F.substring("key", 1, digits))
    # at most HOT ranges; equal rows in them are told apart by the task that read them
    full = d.groupBy("source", "bin").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(RANGE * EXCESS, n / HOT)).select(F.col("source").alias("s"), F.col("bin").alias("b"))
    d = d.join(F.broadcast(full), F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")), "left")
    d = d.withColumn("bin", F.when(F.col("b").isNull(), F.col("bin")).otherwise(F.concat("key", F.lpad(F.col("part").cast("string"), 9, "0")))).drop("s", "b", "part")
    bins = d.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("bin_start", F.coalesce(F.sum("bin_size").over(before), F.lit(0).cast("long")))
    sources = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, most)
    bins = bins.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "bin_size")
    within = Window.partitionBy("source", "bin").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0).cast("long")))
    d = d.join(bins.select(F.col("source").alias("s"), F.col("bin").alias("b"), "bin_start", "source_size", "target"), F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    left = budget - epochs * F.col("source_size") - F.col("bin_start") - F.col("start")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return d.select(F.col("id").alias(id_col), *(F.col("row").alias(c) for c in rows), "size", "source_size", "target", taken.cast("long").alias("taken"))
