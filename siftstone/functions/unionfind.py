"""Union-find over arrays of links."""

from __future__ import annotations

import numpy as np


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of all nodes but the roots; root is the least node of the tree.

    All links whose ends have different roots unite them at once, the greater
    root under the least partner; then every path is compressed. Both repeat
    until no link joins two trees.
    """
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    parent = np.arange(len(names))
    while len(x):
        rx, ry = parent[x], parent[y]
        apart = rx != ry
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(parent, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    child = parent != np.arange(len(names))
    return names[child], names[parent[child]]
