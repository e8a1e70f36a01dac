"""A quality score from document statistics: random Fourier features, ridge regression, isotonic calibration.

Random Fourier features approximate a Gaussian kernel over the statistics. Each partition sums its own
normal equations, so the fit takes any number of labelled rows and only sums of a fixed size reach the
driver. The labelled rows fall into two halves; each half is scored by the other half's model, and
isotonic regression over a fixed grid of those scores turns scores into probabilities."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm.shared import own_columns, stored
from sievemill.llm.stats import STATISTICS, statistics
from sievemill.llm.text import slices, texts

#: Random features, ridge penalty per row, kernel width in standard deviations, grid of the calibration.
FEATURES, PENALTY, WIDTH, GRID = 256, 1e-3, 4.0, 2000
LOW, HIGH = -0.5, 1.5


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """id, row_col if there is one, and the statistics of each text, written to the shared folder; null counts as empty."""
    names = ["id", *[row_col] * bool(row_col)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part in slices(texts(batch.column("text"))):
                x = statistics(part)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i:j] for c in names), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], [*names, "x"])

    d = own_columns(docs, id_col, *names[1:], text_col).toDF(*names, "text")
    kinds = dict(d.dtypes)
    return stored(d.mapInArrow(rows, ", ".join(f"{c} {kinds[c]}" for c in names) + ", x array<float>"), "statistics")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


@dataclass
class Model:
    """What a score needs; all arrays are of a fixed size."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.Generator(np.random.PCG64(7))
        w = rng.normal(0, 1 / WIDTH, (x.shape[1], FEATURES))
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.column_stack([np.cos(z @ w + b) * np.sqrt(2 / FEATURES), z / len(STATISTICS), np.ones(len(z))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0.0, 1.0)


def summed(df: DataFrame, one: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], last: int = 16) -> np.ndarray | None:
    """Sum over all rows of one(x, y, half): by partition, then in groups as many as the root of the partitions, then in `last`, then here."""
    groups = max(last, math.isqrt(df.rdd.getNumPartitions()))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for b in batches:
            if b.num_rows:
                part = one(matrix(b.column("x")), b.column("y").to_numpy().astype(np.float64), b.column("half").to_numpy())
                total = part if total is None else total + part
        if total is not None:
            p = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([p % groups], pa.int32()), pa.array([p], pa.int32()), pa.array([total.astype(np.float64).tobytes()])], ["g", "p", "total"])

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("p")  # the same order of additions in every run
        total = sum(np.frombuffer(t, np.float64) for t in table["total"].to_pylist())
        return pa.table({"g": table["g"][:1], "total": pa.array([total.tobytes()])})

    rows = df.mapInArrow(partial, "g int, p int, total binary").groupBy("g").applyInArrow(add, "g int, total binary")
    if groups > last:
        rows = rows.select((F.col("g") % last).alias("g"), F.col("g").alias("p"), "total").groupBy("g").applyInArrow(add, "g int, total binary")
    found = rows.collect()
    return sum(np.frombuffer(r.total, np.float64) for r in sorted(found, key=lambda r: r.g)) if found else None


def isotonic(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Non-decreasing means of consecutive groups: pool adjacent violators."""
    blocks: list[list[float]] = []
    for w, t in zip(weight, total):
        blocks.append([w, t, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, t2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + t2, blocks[-1][2] + n2]
    return np.concatenate([np.full(n, t / w) for w, t, n in blocks])


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Fit to labels (id, y of 0 or 1, half of 0 or 1), each joined to its row of stats.

    Rows with a null label or id don't count. Without labels every score is 0.5. Statistics beyond five standard deviations count as
    five, raw scores outside LOW to HIGH as these: labels are 0 and 1, so a ridge's scores lie between them or little beside."""
    rows = stored(stats.join(labels.where("y is not null and id is not null"), "id").select("x", F.col("y").cast("double").alias("y"), F.col("half").cast("int").alias("half")), "labelled")
    k = len(STATISTICS)
    model = Model(np.zeros(k), np.ones(k), np.zeros(FEATURES + k + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    m = summed(rows, lambda x, y, half: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    if m is None:
        return model
    n, s, q = m[0], m[1 : k + 1], m[k + 1 :]
    model.mean = s / n
    model.scale = np.sqrt(np.maximum(q / n - model.mean**2, 1e-6))

    def equations(x: np.ndarray, y: np.ndarray, half: np.ndarray) -> np.ndarray:
        out = []
        for h in (0, 1):
            f = model.features(x[half == h])
            t = y[half == h]
            out += [(f.T @ f).ravel(), f.T @ t, [float(len(t))]]
        return np.concatenate(out)

    e = summed(rows, equations).reshape(2, -1)
    d = len(model.weights)

    def solve(part: np.ndarray) -> np.ndarray:
        a, b, size = part[: d * d].reshape(d, d), part[d * d : -1], part[-1]
        penalty = np.full(d, PENALTY * max(size, 1.0))
        penalty[-1] = 1e-9 * max(size, 1.0)
        return np.linalg.solve(a + np.diag(penalty + 1e-9), b)

    both = solve(e[0] + e[1])
    halves = [solve(e[1]) if e[1][-1] else both, solve(e[0]) if e[0][-1] else both]

    def binned(x: np.ndarray, y: np.ndarray, half: np.ndarray) -> np.ndarray:
        f = model.features(x)
        raw = np.where(half == 0, f @ halves[0], f @ halves[1])
        at = np.clip(((raw - LOW) / (HIGH - LOW) * GRID).astype(int), 0, GRID - 1)
        return np.concatenate([np.bincount(at, minlength=GRID), np.bincount(at, y, minlength=GRID)])

    w, t = summed(rows, binned).reshape(2, -1)
    full = np.flatnonzero(w)
    model.weights = both
    model.knots = LOW + (full + 0.5) / GRID * (HIGH - LOW)
    # a little of the overall rate keeps scores of few rows away from 0 and 1
    rate = t.sum() / w.sum()
    model.levels = isotonic(w[full], t[full])
    model.levels = 0.98 * model.levels + 0.02 * rate
    return model


def score(stats: DataFrame, model: Model, id_col: str = "doc_id", row_col: str | None = None) -> DataFrame:
    """id_col, row_col if there is one, and score, from 0 to 1, of each row of stats."""
    names = ["id", *[row_col] * bool(row_col)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(model.scores(matrix(b.column("x"))))], [*names, "score"])

    kinds = dict(stats.dtypes)
    return stats.mapInArrow(rows, ", ".join(f"{c} {kinds[c]}" for c in names) + ", score double").withColumnRenamed("id", id_col)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", row_col: str | None = None) -> DataFrame:
    """Score every document; learn from labels whose id has crc32(text of id) mod 3 other than 1.

    Returns id_col, row_col (a key of the rows, if one is named), held_out, score, predicted (1 if score >= 0.5). Only the text goes into a score. A null
    id is scored too (held_out is null); its label is not used. A null or empty text has the statistics of an
    empty one. Labels other than 0 and 1 and null ones don't count; a document with several labels counts once
    for each. Repeated ids are scored one by one; equal texts have equal scores. Texts are read whole, however long. Without usable labels every score
    is 0.5. Other columns are ignored, whatever their names; an empty table gives an empty one."""
    fold = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(3))
    stats = document_statistics(docs, id_col, text_col, row_col)
    y = own_columns(labels, id_col, label_col).toDF("id", "y").where("y in (0, 1)")
    model = fit(stats, y.where(fold("id") != 1).withColumn("half", (fold("id") / 2).cast("int")))
    out = score(stats, model, "id", row_col)
    return out.select(F.col("id").alias(id_col), *[row_col] * bool(row_col), (fold("id") == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
