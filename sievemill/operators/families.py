"""Families of clusters: by themselves, by verb, by edit distance."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions.lexicon import label
from sievemill.operators.cluster import priority, priority_rank

SIMILARITY = 0.9
FAMILY_EXAMPLES = 6


def similarity(a: Column, b: Column) -> Column:
    """1 less the share of the longer text that edits change; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def identity(clusters: DataFrame) -> DataFrame:
    """Every cluster a family of its own."""
    return clusters.withColumns({"family": F.sha2(F.concat_ws("\u0001", F.coalesce(F.col("bank_id").cast("string"), F.lit("")), "template"), 256), "label": F.lit(None).cast("string")})


def by_verb(clusters: DataFrame) -> DataFrame:
    """Clusters of one bank, verb and direction together; one without a verb stays alone."""
    key = F.when(F.col("verb").isNull(), F.concat(F.lit("t:"), "template")).otherwise(F.concat(F.lit("v:"), "verb", F.lit(":"), "direction"))
    bank = F.coalesce(F.col("bank_id").cast("string"), F.lit(""))
    return clusters.withColumns({"family": F.sha2(F.concat_ws("\u0001", bank, key), 256), "label": label(F.col("verb"), F.col("direction"))})


def edit_distance(a: str, b: str, most: int) -> int:
    """The edit distance, or some number above `most` if it is above. The table's columns are bits of one integer (Myers)."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    mask, high = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = mask, 0, len(a)
    for left, c in enumerate(b, 1 - len(b)):
        same = at.get(c, 0)
        x = same | down
        d = (((same & up) + up) ^ up | same) & mask
        more, less = down | mask & ~(d | up), up & d
        score += bool(more & high) - bool(less & high)
        if score + left > most:  # what is left of b takes at most one edit a character back
            return most + 1
        more, less = (more << 1 | 1) & mask, less << 1 & mask
        up, down = less | mask & ~(x | more), more & x
    return score


def allowed(longest: int, threshold: float) -> int:
    """Edits at which two texts, the longer of which has so many characters, are still similar."""
    return int((1 - threshold) * longest + 1e-9)


def greedy(templates: list[str], threshold: float) -> list[int]:
    """Each template's seed: the first earlier seed similar enough to it, or itself.

    Seeds whose counts of characters alone differ by too much aren't compared."""
    kinds = {c: i for i, c in enumerate(sorted(set().union(*templates)))} if templates else {}
    seeds: list[int] = []
    held = np.zeros((16, len(kinds)), np.int32)
    sizes = np.zeros(16, np.int64)
    out = []
    for i, t in enumerate(templates):
        own = np.bincount([kinds[c] for c in t], minlength=len(kinds)).astype(np.int32)
        n = len(seeds)
        longest = np.maximum(sizes[:n], len(t))
        extra = (held[:n] - own[None]).clip(0).sum(1)  # characters that only the seed has; edits are at least these, and those that only t has
        least = np.maximum(extra, extra - sizes[:n] + len(t))
        for k in np.flatnonzero(least <= (1 - threshold) * longest + 1e-9).tolist():
            if edit_distance(t, templates[seeds[k]], allowed(int(longest[k]), threshold)) <= allowed(int(longest[k]), threshold):
                out.append(seeds[k])
                break
        else:
            if n == len(held):
                held, sizes = np.concatenate([held, np.zeros_like(held)]), np.concatenate([sizes, np.zeros_like(sizes)])
            held[n], sizes[n] = own, len(t)
            seeds.append(i)
            out.append(i)
    return out


def _joined(*columns: Column) -> Column:
    """One text that only the same values have: each with its length before it, null as a dash."""
    return F.concat(*(F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns))


def by_distance(clusters: DataFrame, threshold: float = SIMILARITY, within_verbs: bool = False) -> DataFrame:
    """Clusters of one stream and bank whose template is near a family's first one, taken by falling occurrences, then template.

    The stream is that of the column, else whether the clusters are matched, if they say so. Greedy by nature, so a block is one task; blocks hold
    distinct templates, not messages. within_verbs refines the verbs' families, which keep their labels."""
    blocks = by_verb(clusters) if within_verbs else identity(clusters)
    kind = [c for c in ("stream", "matched") if c in clusters.columns]
    key = _joined(*map(F.col, kind), F.col("family") if within_verbs else F.col("bank_id"))
    blocks = blocks.withColumn("block", key)

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["occurrences", "template"], ascending=[False, True], ignore_index=True)
        seeds = greedy(pdf["template"].tolist(), threshold)
        return pd.DataFrame({"block": pdf["block"], "template": pdf["template"], "seed": pdf["template"].to_numpy()[seeds]})

    found = blocks.select("block", "template", "occurrences").groupBy("block").applyInPandas(group, "block string, template string, seed string")
    out = blocks.join(found, ["block", "template"]).withColumn("family", F.sha2(_joined(F.col("block"), F.col("seed")), 256))
    return out.drop("block", "seed")


def similar_pairs(clusters: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Pairs of templates of one bank at least `threshold` alike; a < b.

    Templates that k edits separate share one of the k + 1 pieces that a cut at equal places gives the longer one, so instead of
    all pairs only those are compared that agree in such a piece, at a place shifted by k at most, and are of near length. Where the threshold
    allows so many edits that pieces are single characters, nearly all pairs of a bank agree in one, so a low threshold is work for few templates."""
    t = clusters.select("bank_id", "template").distinct().withColumn("n", F.length("template"))
    edits = F.floor((1 - threshold) * F.col("n") + 1e-9).cast("int")  # of a pair whose longer text this is
    size = F.greatest(F.lit(1), F.floor(F.col("n") / (edits + 1)).cast("int"))
    long = t.select(F.col("bank_id").alias("bank"), F.col("template").alias("long"), F.col("n").alias("long_n"), edits.alias("k"), size.alias("size"))
    cut = long.select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i")).withColumn("at", F.col("i") * F.col("size") + 1)
    cut = cut.select("bank", "long", "long_n", "k", "size", "at", F.substring("long", F.col("at"), F.col("size")).alias("piece")).where("piece <> '' or long_n = 0")
    lengths = long.select(F.col("bank").alias("bank_of"), "size").distinct()
    short = t.select("bank_id", F.col("template").alias("short"), F.col("n").alias("short_n")).join(lengths, F.col("bank_id").eqNullSafe(F.col("bank_of")))
    short = short.select("bank_id", "short", "short_n", F.col("size").alias("short_size"), F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("short_n") - F.col("size") + 1))).alias("place"))
    short = short.withColumn("found", F.substring("short", F.col("place"), F.col("short_size")))
    same = F.col("bank").eqNullSafe(F.col("bank_id")) & (F.col("size") == F.col("short_size")) & (F.col("piece") == F.col("found"))
    near = F.col("short_n").between(F.col("long_n") - F.col("k"), F.col("long_n")) & (F.abs(F.col("at") - F.col("place")) <= F.col("k")) & (F.col("short") != F.col("long"))
    near = near & ((F.col("short_n") < F.col("long_n")) | (F.col("short") < F.col("long")))  # a pair of equal length once
    pairs = cut.join(short, same & near).select("bank_id", "long", "short", "long_n", "k").distinct()
    pairs = pairs.withColumn("d", F.expr("levenshtein(long, short, k)")).where("d >= 0")
    pairs = pairs.withColumn("similarity", 1 - F.col("d") / F.greatest("long_n", F.lit(1))).where(F.col("similarity") >= threshold)
    return pairs.select("bank_id", F.least("long", "short").alias("a"), F.greatest("long", "short").alias("b"), F.round("similarity", 6).alias("similarity"))


def families(members: DataFrame, *keys: str) -> DataFrame:
    """One row per family: its representative (most occurrences, then template), totals, variants and examples."""
    by = [*keys, "family"]
    place = Window.partitionBy(*by).orderBy(F.col("occurrences").desc(), "template")
    ranked = members.withColumn("place", F.row_number().over(place))
    first = lambda c: F.min_by(c, "place").alias(c)
    in_order = lambda c: F.transform(F.sort_array(F.collect_list(c)), lambda s: s["x"])
    # of each example the first member that has it
    shown = ranked.select(*by, "place", F.posexplode("examples").alias("pos", "x")).groupBy(*by, "x").agg(F.min(F.struct("place", "pos")).alias("at"))
    shown = shown.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("at"))).where(F.col("nth") <= FAMILY_EXAMPLES)
    shown = shown.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(in_order(F.struct("nth", "x")).alias("examples"))
    out = ranked.groupBy(*by).agg(
        *(first(c) for c in ("template", "bank_id", "bank_name", "verb", "direction", "label", "readiness")),
        F.count(F.lit(1)).alias("member_count"),
        F.sum("occurrences").alias("total"),
        in_order(F.when(F.col("place") > 1, F.struct("place", F.col("template").alias("x")))).alias("variants"),
        F.bool_or("degraded").alias("degraded"),
    )
    out = out.join(shown, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left").drop(*(f"_{c}" for c in by))
    out = out.withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))
    return out.withColumns({"priority": priority(F.col("total")), "priority_rank": priority_rank(F.col("total"))})


GROUPERS = {"identity": identity, "verb": by_verb, "semantic": by_verb, "levenshtein": by_distance, "lev": by_distance}
__all__ = ["GROUPERS", "by_distance", "by_verb", "edit_distance", "families", "greedy", "identity", "similar_pairs", "similarity"]
