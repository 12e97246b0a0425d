"""All expanding folds of a logistic model at once: a pass over the table an iteration, however many folds there are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunks import kept
from .learn import FIRST, STEP, expanding_folds, numbered

#: Weight of half the squared coefficients of standardised features, beside the mean loss.
RIDGE = 0.01
ITERATIONS, TOLERANCE = 30, 1e-10


def _summed(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], groups: int, width: int) -> np.ndarray:
    """The sum over all rows of part(x, y, block), an array of groups by width numbers, added up task by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((groups, width))
        for b in batches:
            if b.num_rows:
                total += part(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[2:]], 1), b.column(1).to_numpy(), b.column(0).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(range(groups), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["g", "s"])

    each = rows.mapInArrow(run, "g int, s array<double>").select("g", F.posexplode("s").alias("i", "v"))
    out = np.zeros((groups, width))
    for r in each.groupBy("g", "i").agg(F.sum("v").alias("v")).collect():  # so many numbers for each fold
        out[r["g"], r["i"]] = r["v"]
    return out


def _newton(grams: np.ndarray, means: np.ndarray, scales: np.ndarray, beta: np.ndarray, gradient: np.ndarray, n: np.ndarray, ridge: float) -> np.ndarray:
    """Next coefficients of each fold; grams and gradients are of raw features, beta of standardised ones, intercept first."""
    out = beta.copy()
    for f in range(len(beta)):
        a = np.eye(beta.shape[1])  # from raw to standardised features
        a[1:, 1:] = np.diag(1 / scales[f])
        a[1:, 0] = -means[f] / scales[f]
        penalty = n[f] * ridge * np.append(0, np.ones(len(scales[f])))
        h = a @ grams[f] @ a.T + np.diag(penalty)
        out[f] = beta[f] - np.linalg.solve(h, a @ gradient[f] + penalty * beta[f])
    return out


def walk_forward_logistic(df: DataFrame, features: list[str], label: str, first: int = FIRST, step: int = STEP, ridge: float = RIDGE, date: str = "date") -> DataFrame:
    """The test rows of every fold with fold int and probability_up double, from a logistic model of all rows before the fold.

    Folds as expanding_folds; features are standardised over each fold's training rows (a constant one counts nothing). Rows with a null
    feature or label are left out before they are numbered. Sums of each block of rows, added up over the blocks before a
    fold, give its means, deviations and first Newton step; each further step is one pass over the table, in which a row adds
    to every fold that trains on it. The driver receives the square of the features for each fold.
    """
    k = len(features)
    rows = numbered(df.dropna(subset=[*features, label]), date)
    rows = kept(expanding_folds(rows, first, step))
    folds = (rows.agg(F.max("fold")).first()[0] or 0) + 1 if not rows.where("fold IS NOT NULL").isEmpty() else 0
    if not folds:
        return rows.withColumn("probability_up", F.lit(None).cast("double")).limit(0)
    block = F.when(F.col("row_no") < first, 0).otherwise(F.floor((F.col("row_no") - first) / step) + 1)
    table = rows.select(block.cast("int").alias("block"), F.col(label).cast("double"), *[F.col(c).cast("double") for c in features]).where(F.col("block") < folds)

    def moments(x: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(x)), x, y])
        return np.stack([(z[b == f].T @ z[b == f]).ravel() for f in range(folds)])

    grams = _summed(table, moments, folds, (k + 2) ** 2).cumsum(0).reshape(folds, k + 2, k + 2)
    n, sums = grams[:, 0, 0], grams[:, 0, 1:-1]
    means = sums / n[:, None]
    spread = np.sqrt(np.maximum((np.diagonal(grams, axis1=1, axis2=2)[:, 1:-1] - n[:, None] * means**2) / np.maximum(n[:, None] - 1, 1), 0))
    scales = np.where(spread > 1e-12 * np.maximum(1, np.abs(means)), spread, np.inf)
    beta = _newton(grams[:, :-1, :-1] / 4, means, scales, np.zeros((folds, k + 1)), grams[:, :-1, 0] / 2 - grams[:, :-1, -1], n, ridge)

    def raw(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slopes = beta[:, 1:] / scales
        return slopes, beta[:, 0] - (slopes * means).sum(1)

    for _ in range(ITERATIONS):
        slopes, base = raw(beta)

        def steps(x: np.ndarray, y: np.ndarray, b: np.ndarray, slopes=slopes, base=base) -> np.ndarray:
            z = np.column_stack([np.ones(len(x)), x])
            trains = b[:, None] <= np.arange(folds)
            p = 1 / (1 + np.exp(-np.clip(x @ slopes.T + base, -500, 500)))
            miss, weight = np.where(trains, p - y[:, None], 0), np.where(trains, p * (1 - p), 0)
            return np.column_stack([miss.T @ z, np.stack([((z * weight[:, [f]]).T @ z).ravel() for f in range(folds)])])

        found = _summed(table, steps, folds, (k + 1) * (k + 2))
        new = _newton(found[:, k + 1 :].reshape(folds, k + 1, k + 1), means, scales, beta, found[:, : k + 1], n, ridge)
        moved, beta = np.abs(new - beta).max(), new
        if moved < TOLERANCE:
            break
    slopes, base = raw(beta)
    test = rows.where("fold IS NOT NULL")
    line = F.element_at(F.array(*[F.lit(float(v)) for v in base]), F.col("fold") + 1)
    for i, c in enumerate(features):
        line = line + F.col(c) * F.element_at(F.array(*[F.lit(float(v)) for v in slopes[:, i]]), F.col("fold") + 1)
    return test.withColumn("probability_up", 1 / (1 + F.exp(-line)))
