"""Hilbert curve indices: Skilling's transform, for NumPy arrays and as a Spark expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """(n, dims) cell numbers below 2**bits -> position on the curve; dims * bits <= 63."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def with_hilbert(df: DataFrame, cells: list[str], bits: int, out: str = "_curve") -> DataFrame:
    """``df`` with the curve index of integer columns ``cells`` (0 to 2**bits - 1), as a DataFrame expression.

    The index of every cell is a constant array, looked up by the cell's number: len(cells) * bits is at most 16.
    """
    dims = len(cells)
    if dims * bits > 16:
        raise ValueError("the constant array would be too large")
    every = np.indices([1 << bits] * dims).reshape(dims, -1).T
    index = F.split(F.lit(",".join(map(str, hilbert_index(every, bits)))), ",").cast("array<int>")
    number: Column = F.lit(0)
    for c in cells:
        number = number * (1 << bits) + F.col(c).cast("int")
    return df.withColumn(out, F.element_at(index, number + 1).cast("bigint"))
