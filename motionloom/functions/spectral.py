"""Arrow functions for spectra and autocorrelation of window arrays.

Spark groups, orders and ships the windows; these small vectorised helpers only do the FFT.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kernels
from .kernels import partial_dft as partial_dft


def _batches(arrays: pd.Series):
    """Stack arrays of equal length; yields (positions, matrix)."""
    sizes = arrays.map(lambda a: -1 if a is None else len(a)).to_numpy()
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        if n > 0:
            yield at, np.stack(arrays.iloc[at].to_list()).astype(float)


def spectral(array: Column, fs: Column | float, low: float = 0.2, high: float = 15.0, floor: float = 1e-15,
             entropy_floor: float = 1.0, min_samples: int = 1) -> Column:
    """struct<dominant_hz, entropy> of the rfft power in [low, min(high, fs/2)].

    A window without power gives zeros, one below ``min_samples`` NULL.
    """

    @F.pandas_udf("struct<dominant_hz:double,entropy:double>")
    def run(arrays: pd.Series, rate: pd.Series) -> pd.DataFrame:
        out = np.full((len(arrays), 2), np.nan)
        hz = rate.to_numpy(dtype=float)
        for at, x in _batches(arrays):
            out[at, 0], out[at, 1] = kernels.spectral(x, hz[at], low, high, floor, entropy_floor, min_samples)
        return pd.DataFrame(out, columns=["dominant_hz", "entropy"])

    return run(array, fs if isinstance(fs, Column) else F.lit(float(fs)))


def autocorr_period(array: Column, fs: float) -> Column:
    """Lag in seconds of the highest autocorrelation between fs/4 and fs/0.3 samples."""

    @F.pandas_udf("double")
    def run(arrays: pd.Series) -> pd.Series:
        out = np.zeros(len(arrays))
        for at, x in _batches(arrays):
            out[at] = kernels.period(x, fs)
        return pd.Series(out)

    return run(array)


def mean_quaternion(products: Column) -> Column:
    """Largest eigenvector of the summed 4x4 outer product (10 upper entries, row by row)."""

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        upper = np.triu_indices(4)
        m = np.zeros((len(rows), 4, 4))
        m[:, upper[0], upper[1]] = np.stack(rows.to_list())
        m = m + np.triu(m, 1).transpose(0, 2, 1)
        v = np.linalg.eigh(m)[1][:, :, -1]
        v = np.where(v[:, :1] >= 0, v, -v)
        return pd.Series(list(v))

    return run(products)
