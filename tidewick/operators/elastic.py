"""Elastic nets from moments: one pass sums the products of all columns, for all folds at once; every candidate of a grid is
then solved from that small matrix, and one more pass scores all candidates on all folds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import errors

#: Sweeps over the coefficients at most, and the change, relative to the largest one, below which they end.
SWEEPS, CHANGE = 20_000, 1e-8


def _rows(df: DataFrame, columns: list[str], label: str, roles: list[Column]) -> DataFrame:
    d = df.select(F.col(label).cast("double").alias("y"), *(r.cast("int").alias(f"role_{i}") for i, r in enumerate(roles)), *(F.col(c).cast("double").alias(f"f_{i}") for i, c in enumerate(columns)))
    return d.na.drop()


def _arrays(batch: pa.RecordBatch, folds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
    return columns[0], np.stack(columns[1 : 1 + folds], 1), np.stack(columns[1 + folds :], 1)


def _added(found: DataFrame, shape: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Sums of arrays by fold; the partial sums of the partitions meet in one task a fold."""

    def add(key, table):
        total = sum(np.frombuffer(x) for x in table["body"].to_pylist())
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["fold", "body"])

    rows = found.groupBy("fold").applyInArrow(add, "fold int, body binary").collect()  # an array a fold
    return {r["fold"]: np.frombuffer(r["body"]).reshape(shape) for r in rows}


def moments(df: DataFrame, columns: list[str], label: str, roles: list[Column]) -> dict[int, np.ndarray]:
    """For each fold the sums of products of (1, columns, label) over its rows of role 1; rows with a null are left out."""
    k, width = len(roles), len(columns) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width, width))
        for batch in batches:
            y, role, x = _arrays(batch, k)
            z = np.concatenate((np.ones((len(y), 1)), x, y[:, None]), 1)
            for i in range(k):
                part = z[role[:, i] == 1]
                total[i] += part.T @ part
        yield pa.record_batch([pa.array(range(k), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], names=["fold", "body"])

    found = _rows(df, columns, label, roles).mapInArrow(run, "fold int, body binary")
    return _added(found, (width, width))


def solve_all(m: np.ndarray, alpha: np.ndarray, l1_ratio: np.ndarray) -> np.ndarray:
    """Rows (intercept, coefficients) that minimise |y - b - Xw|^2 / 2n + alpha (l1_ratio |w| + (1 - l1_ratio) |w|^2 / 2), for
    problems p with moments m[p]: coordinate descent, all problems at a time; zeros without rows."""
    n = np.maximum(m[:, 0, 0], 1.0)
    mean = m[:, 0] / n[:, None]
    c = m / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    gram, left = c[:, 1:-1, 1:-1], c[:, 1:-1, -1].copy()
    spread = np.einsum("pjj->pj", gram).copy()
    still = spread <= 1e-14 * np.maximum(1.0, mean[:, 1:-1] ** 2)
    soft, ridge = alpha * l1_ratio, np.where(still, 1.0, spread + (alpha * (1 - l1_ratio))[:, None])
    w, live = np.zeros_like(left), np.flatnonzero(m[:, 0, 0] > 0)
    for _ in range(SWEEPS):
        if not len(live):
            break
        g, s, x, r, before = gram[live], spread[live], w[live], left[live], w[live].copy()
        for j in range(x.shape[1]):
            z = r[:, j] + s[:, j] * x[:, j]
            new = np.where(still[live, j], 0.0, np.sign(z) * np.maximum(np.abs(z) - soft[live], 0.0) / ridge[live, j])
            r -= g[:, :, j] * (new - x[:, j])[:, None]
            x[:, j] = new
        w[live], left[live] = x, r
        root = np.sqrt(np.maximum(s, 0.0))
        moved = (np.abs(x - before) * root).max(1, initial=0.0)
        live = live[moved > CHANGE * (np.abs(x) * root).max(1, initial=1e-300)]
    return np.concatenate(((mean[:, -1] - (mean[:, 1:-1] * w).sum(1))[:, None], w), 1)


def solve(m: np.ndarray, alpha: float, l1_ratio: float) -> tuple[float, np.ndarray]:
    """(intercept, coefficients) of one problem."""
    found = solve_all(m[None], np.array([alpha]), np.array([l1_ratio]))[0]
    return float(found[0]), found[1:]


def grid_search(df: DataFrame, columns: list[str], label: str, roles: list[Column], candidates: list[tuple[float, float]]) -> list[tuple[tuple[float, float], float, float]]:
    """(candidate, mape, mae), means over the folds of the errors on the rows of role 2."""
    k, n = len(roles), len(candidates)
    found = moments(df, columns, label, roles)
    solved = solve_all(np.concatenate([np.repeat(found[i][None], n, 0) for i in range(k)]), *(np.array([c[x] for c in candidates] * k) for x in (0, 1))).reshape(k, n, -1) if found else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, n, 3))
        for batch in batches:
            y, role, x = _arrays(batch, k)
            for i in range(k):
                at = role[:, i] == 2
                pred = x[at] @ solved[i, :, 1:].T + solved[i, :, 0]
                total[i] += [errors(y[at], pred[:, c]) for c in range(n)]
        yield pa.record_batch([pa.array(range(k), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], names=["fold", "body"])

    found = _added(_rows(df, columns, label, roles).mapInArrow(run, "fold int, body binary"), (n, 3)) if found else {}
    used = [t for t in found.values() if t[0, 2] > 0]
    return [(c, float(np.mean([t[i, 0] / t[i, 2] for t in used])), float(np.mean([t[i, 1] / t[i, 2] for t in used]))) for i, c in enumerate(candidates)] if used else []
