"""Union of pairs in arrays, for use inside tasks."""

from __future__ import annotations

import numpy as np


class Forest:
    """Labels of n rows that are merged pair by pair, all pairs of a call at once; the smallest row names its tree."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            keep = x != y
            if not keep.any():
                return
            a, b, x, y = a[keep], b[keep], x[keep], y[keep]
            parent = np.arange(len(self.label))
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while (parent[parent] != parent).any():
                parent = parent[parent]
            self.label = parent[self.label]
