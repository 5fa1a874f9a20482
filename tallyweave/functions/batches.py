"""Arrow batches of list columns as dense matrices, for use inside tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd


def stacked(series: pd.Series) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    return np.stack(series.to_numpy()).astype(float)


def scattered(places: pd.Series, width: int, values: pd.Series | None = None) -> np.ndarray:
    """Rows of ``width`` zeros with ones, or ``values``, at the listed places. A null list is a zero row."""
    dense = np.zeros((len(places), width))
    filled = [(i, at) for i, at in enumerate(places) if at is not None and len(at)]
    if filled:
        rows = np.repeat([i for i, _ in filled], [len(at) for _, at in filled])
        columns = np.concatenate([at for _, at in filled])
        dense[rows, columns] = 1.0 if values is None else np.concatenate([values.iloc[i] for i, _ in filled])
    return dense
