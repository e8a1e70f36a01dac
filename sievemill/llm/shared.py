"""Sizing and shared storage that the operators of this subpackage have in common."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parquet text takes about this many bytes in memory for each byte on disk.
UNPACKED = 2
#: A key with more than one in so many rows is joined without a shuffle.
HOT = 1000
#: Paths in the shared folder that this process has given out, each with its application.
_made: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, which every executor sees.

    Only a session without that setting (a local test) gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir() + "/sievemill-shared"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark.sparkContext.applicationId
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there. It stays until dropped or released."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete what stored() wrote for df; nothing may read it any more."""
    _delete(df.sparkSession, df.stored_at)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _made.pop(path, None)


def written(spark: SparkSession) -> list[str]:
    """Paths in the shared folder that the session's application has been given and that aren't deleted."""
    return [p for p, app in _made.items() if app == spark.sparkContext.applicationId]


def discard(spark: SparkSession, paths: set[str]) -> None:
    """Delete those of the paths that are still there."""
    for path in paths & set(written(spark)):
        _delete(spark, path)


def release(spark: SparkSession, *keep: DataFrame) -> None:
    """Delete all that this process's operators wrote to the shared folder for the session's application, but for the tables to keep.

    To be called once results are written: they are read from there until then."""
    left = {df.stored_at for df in keep}
    discard(spark, set(written(spark)) - left)


def joined(left: DataFrame, right: DataFrame, key: str, copies: str, total: int, how: str = "inner") -> DataFrame:
    """left joined to right, which has each key once and in `copies` how many of left's `total` rows hold it.

    Keys that hold more than one in HOT rows are at most HOT; those are sent to all tasks, so their rows stay where they
    are. Only the other rows are shuffled. left is read twice, so it should be stored or a scan. how: inner or left."""
    hot = F.col(copies) > total / HOT
    most, rest = F.broadcast(right.where(hot)), right.where(~hot)
    return left.join(most, key).unionByName(left.join(most.select(key), key, "left_anti").join(rest, key, how))


def text_bytes(df: DataFrame) -> int:
    """About how many bytes df's rows take in memory, from the planner's statistics."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > 1 << 58:  # unknown
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * (32 << 20)
    return UNPACKED * size


def pieces(size: float, target: int = 12 << 20, most: int = 256 << 20) -> int:
    """Into how many pieces to cut size bytes: of about target bytes, of more where pieces would outnumber what one sends to another.

    From 64 GB on pieces grow with the root of the size, up to `most`: n pieces send each other up to n * n messages, and these must stay large."""
    return max(4, math.ceil(size / min(most, target * max(1.0, size / (64 << 30)) ** 0.5)))


def own_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that no other column of the input can clash with ours.

    A name that the input holds twice (or in two spellings) means its first."""
    found: list[int] = []
    for name in names:
        at = [i for i, c in enumerate(docs.columns) if c == name] or [i for i, c in enumerate(docs.columns) if c.lower() == name.lower()]
        if not at:
            raise ValueError(f"no column {name} among {docs.columns}")
        found.append(at[0])
    if len({c.lower() for c in docs.columns}) < len(docs.columns):
        docs = docs.toDF(*(f"_c{i}" for i in range(len(docs.columns))))
        return docs.select(*(F.col(f"_c{i}").alias(n) for i, n in zip(found, names)))
    return docs.select(*(F.col(f"`{docs.columns[i]}`").alias(n) for i, n in zip(found, names)))
