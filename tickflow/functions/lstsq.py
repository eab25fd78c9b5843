"""Python side of the per-symbol least-squares fit (run inside tasks).

Only numpy and pandas are referenced, and the module is registered to be
pickled by value, so executors run these functions without the package being
installed there.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle


def partial_normal_equations(batches):
    """Per Arrow batch and symbol: Z'Z, Z'y (Z = [1, lags]) and the row count,
    flattened into one array so that a single sum adds all of them up."""
    for pdf in batches:
        for sym, g in pdf.groupby("symbol", sort=False):
            x = np.vstack(g["lags"].to_numpy())
            z = np.hstack([np.ones((x.shape[0], 1)), x])
            y = g["label"].to_numpy(dtype=float)
            stats = np.concatenate([(z.T @ z).ravel(), z.T @ y, [float(len(y))]])
            yield pd.DataFrame({"symbol": [sym], "stats": [stats.tolist()]})


def solve(pdf: pd.DataFrame) -> pd.DataFrame:
    """Solve the summed normal equations of one symbol (a few thousand numbers)."""
    v = pdf.sort_values("i")["v"].to_numpy(dtype=float)
    n, v = int(round(v[-1])), v[:-1]
    k = int(round((-1 + np.sqrt(1 + 4 * len(v))) / 2))  # k*k + k entries
    gram, rhs = v[:k * k].reshape(k, k), v[k * k:]
    beta, *_ = np.linalg.lstsq(gram, rhs, rcond=None)
    return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "intercept": [float(beta[0])],
                         "coef": [beta[1:].tolist()], "n_fit": [n]})


cloudpickle.register_pickle_by_value(sys.modules[__name__])
