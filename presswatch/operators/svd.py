"""Principal components of vectors of any width by block power iteration over distributed rows.

Rows are made unit length first (as the embedding pipeline does). The components are the leading eigenvectors
of the rows' covariance matrix, the definition of Spark's PCA, and rows are projected without centring, as its
transform does; but the width × width covariance is never formed. Each pass over the rows computes
``C·Q = (Σ x (xᵀQ) − n μ (μᵀQ)) / (n − 1)`` for a width × m block Q, m = max(k + ``OVERSAMPLE``, ``BLOCK``)
but at most the width (a block as wide as the vectors makes the first pass exact). Every task sums its rows,
and the partial sums meet in one aggregation by entry, so the driver receives width × m + width + 1 numbers
per pass whatever the row count. Q starts from a fixed seed and is orthonormalised after each pass; a
Rayleigh–Ritz step on the m × m matrix Qᵀ C Q gives the components, each signed so that its entry of largest
magnitude is positive. Passes go on until no entry of the components moves by more than ``TOLERANCE``;
``MAX_PASSES`` without that raises an error (eigenvalues too close to tell apart).

Defined cases: null vectors are skipped in the fit and project to null; vectors of different widths raise;
with fewer than two vectors there is no covariance and all components are zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OVERSAMPLE = 5
BLOCK = 256  # columns of Q: a wide block converges in few passes even where eigenvalues lie close
TOLERANCE = 1e-10
MAX_PASSES = 200
SEED = 7


def _unit_rows(series: pd.Series) -> np.ndarray:
    rows = [np.asarray(v, dtype=np.float64) for v in series if v is not None]
    if not rows:
        return np.zeros((0, 0))
    x = np.vstack(rows)
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def _pass(df: DataFrame, vector: str, width: int, q: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, Σx, Σ x xᵀQ) over all rows, summed in tasks and then by entry."""
    m = q.shape[1]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, product = 0, np.zeros(width), np.zeros((width, m))
        for batch in batches:
            x = _unit_rows(batch[vector])
            if len(x):
                n += len(x)
                total += x.sum(axis=0)
                product += x.T @ (x @ q)
        flat = np.concatenate([[float(n)], total, product.ravel()])
        yield pd.DataFrame({"idx": np.arange(len(flat), dtype=np.int64), "value": flat})

    sums = (df.select(vector).filter(F.col(vector).isNotNull())
            .mapInPandas(partial, "idx long, value double").groupBy("idx").agg(F.sum("value").alias("value"))
            .toPandas().sort_values("idx")["value"].to_numpy())
    if len(sums) == 0:
        return 0, np.zeros(width), np.zeros((width, m))
    return int(round(sums[0])), sums[1:1 + width], sums[1 + width:].reshape(width, m)


def principal_components(df: DataFrame, vector: str, k: int) -> np.ndarray:
    """The k leading components (k × width) of the unit rows' covariance; see the module text."""
    low, high, count = df.select(F.min(F.size(vector)), F.max(F.size(vector)), F.count(vector)).first()
    if not count:
        return np.zeros((0, 0))
    if low != high:
        raise ValueError(f"vectors of widths {low} to {high}; all must have one width")
    width, k = high, min(k, high)
    m = min(width, max(k + OVERSAMPLE, BLOCK))
    q, _ = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, m)))
    if count < 2:
        return np.zeros((k, width))
    before = None
    for _ in range(MAX_PASSES):
        n, total, product = _pass(df, vector, width, q)
        mean = total / n
        cq = (product - n * np.outer(mean, mean @ q)) / (n - 1)
        small = q.T @ cq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1][:k]
        components = _signed((q @ turn[:, order]).T)
        if before is not None and np.max(np.abs(components - before)) <= TOLERANCE:
            return components
        before = components
        q, _ = np.linalg.qr(cq)
    raise RuntimeError(f"components did not settle in {MAX_PASSES} passes")


def _signed(components: np.ndarray) -> np.ndarray:
    """Each row with its entry of largest magnitude positive."""
    largest = np.argmax(np.abs(components), axis=1)
    signs = np.sign(components[np.arange(len(components)), largest])
    return components * np.where(signs == 0, 1.0, signs)[:, None]
