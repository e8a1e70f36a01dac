"""From raw documents to a mixed training corpus, in five stages.

Each stage takes what its predecessor kept, as it was written and read again, and all but the last return
the columns of documents. What a stage decides holds for the row, not for its id, which may be null or repeated: a null id is
judged like any other, and of rows that share an id each is judged by its own text. A null text counts as empty. Texts are read whole,
however long. Columns beside those of documents pass through every stage. Empty tables give empty ones. SQL can't
express the stages' models and hashes; the tests hold each against brute force."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm.decontamination import leaks
from sievemill.llm.mixing import mix
from sievemill.llm.near_dedup import near_duplicates
from sievemill.llm.pii import redact
from sievemill.llm.quality_classifier import quality_scores
from sievemill.llm.shared import discard, joined, release, stored, written

ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Name of the rows' own key within a stage.
ROW = "__row"


#: What the stage before wrote on its way, by application.
_left: dict[str, set[str]] = {}


def _keyed(stage: Stage) -> Stage:
    """A stage whose docs have a key of each row, null and repeated ids included; written, so that the key stays the row's.

    Once they are written, nothing reads what the stage before wrote on its way, and it is deleted."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app, before = spark.sparkContext.applicationId, set(written(spark))
        docs = stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
        discard(spark, _left.pop(app, set()))
        out = stage(spark, docs, sf_dir)
        _left[app] = set(written(spark)) - before
        return out

    return run_stage


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The keyed docs but those rows, without the key. The rows to drop, which are fewer, are written first, so
    that the join knows their size and sends them to all tasks only if they are few."""
    gone = stored(rows.select(F.col(ROW).alias("__gone")).distinct(), "gone")
    return docs.join(gone, F.col(ROW) == F.col("__gone"), "left_anti").drop(ROW)


@_keyed
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier scores below 0.5. Equal texts have equal scores, so they go or stay together; without labels
    all scores are 0.5 and all stay."""
    scores = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), row_col=ROW)
    return _without(docs, scores.where("predicted = 0"))


@_keyed
def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents keep one row: that with the smallest id, of equal ids the first; a null id is last.

    Rows that repeat each other are a group, so are all texts without words."""
    groups = near_duplicates(docs, ROW, counted=False).join(docs.select(F.col(ROW).alias("r"), F.col("doc_id")), F.col(ROW) == F.col("r"))
    groups = stored(groups.select(ROW, "group_id", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW).alias("rank")), "groups")
    best = groups.groupBy("group_id").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return _without(docs, joined(groups, best, "group_id", "n", groups.count()).where(f"{ROW} <> best.{ROW}"))


@_keyed
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage, also one whose item has no id. An item without words is in no document."""
    return _without(docs, leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=ROW))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars follows the text. Null texts stay null, with a null n_chars."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))


@_keyed
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, with their texts, of which the mix takes words, and how many (taken; more than size where the mix repeats).

    Documents of which it takes none go, among them all without words. Rows with a null source are a source of their own. size,
    source_size, target and taken replace columns of these names."""
    found = ("size", "source_size", "target", "taken")
    taken = mix(docs, row_col=ROW).where("taken > 0").select(F.col(ROW).alias("__taken_row"), *found)
    return docs.drop(*found).join(taken, F.col(ROW) == F.col("__taken_row")).drop(ROW, "__taken_row")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("near duplicates", minhash_near_dedup),
    ("benchmark decontamination", decontamination),
    ("personal data", pii),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again.

    What a stage wrote on its way is deleted once its result is written; what the last wrote stays until release()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
