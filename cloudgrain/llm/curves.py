"""Positions along a Hilbert curve, many points at a time."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve position of each row of (points, dims) cell numbers below 2**bits, dims * bits < 64 (Skilling's transposed form, 2004)."""
    axes = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    for b in range(bits - 1, 0, -1):
        bit = np.uint64(1 << b)
        low = bit - _ONE
        for i, axis in enumerate(axes):
            here = (axis & bit) != 0
            swap = np.where(here, np.uint64(0), (axes[0] ^ axis) & low)
            axes[i] = axis ^ swap
            axes[0] = np.where(here, axes[0] ^ low, axes[0] ^ swap)
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turned = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, 0, -1):
        turned = np.where((axes[-1] & np.uint64(1 << b)) != 0, turned ^ np.uint64((1 << b) - 1), turned)
    key = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << _ONE) | (((axis ^ turned) >> np.uint64(b)) & _ONE)
    return key.astype(np.int64)
