"""Closed forms for symmetric 2 x 2 matrices [[a, b], [b, d]] as columns, and batched numpy for larger ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def eigenvalues_2x2(a: Column, b: Column, d: Column) -> tuple[Column, Column]:
    """Larger and smaller eigenvalue."""
    mean, half = (a + d) / 2, (a - d) / 2
    root = F.sqrt(half * half + b * b)
    return mean + root, mean - root


def inverse_2x2(a: Column, b: Column, d: Column) -> tuple[Column, Column, Column]:
    det = a * d - b * b
    return d / det, -b / det, a / det


def pseudo_inverse(h: np.ndarray, rank: int | None = None, tolerance: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Pseudo-inverses of stacked symmetric matrices by SVD, of the ``rank`` largest singular values, and these values.

    Singular values of zero (or up to ``tolerance`` times the largest) stay zero.
    """
    u, s, vt = np.linalg.svd(h)
    keep = s > tolerance * s[..., :1]
    keep &= s > 0
    if rank is not None:
        keep[..., rank:] = False
    inverse = np.where(keep, 1 / np.where(keep, s, 1), 0)
    return np.swapaxes(vt, -1, -2) * inverse[..., None, :] @ np.swapaxes(u, -1, -2), s
