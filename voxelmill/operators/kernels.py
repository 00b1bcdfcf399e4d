"""NumPy kernels over many groups at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


#: Candidate pairs that are looked at together.
PAIRS = 1 << 22


def number(*columns: np.ndarray) -> np.ndarray:
    """A number from 0 for every distinct row of the columns, in their order."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        own = np.unique(c, return_inverse=True)[1]
        code = np.unique(code * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
    return code


def radius_pair_blocks(x: np.ndarray, group: np.ndarray, radius: float, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs i < j of one group within the radius, with squared distances, in blocks of at most ``most`` candidates.

    Points are sorted by cell; each occupied cell meets itself and 13 of the 26
    cells around it. Memory grows with the points, never with their pairs.
    """
    n, most = len(x), most or PAIRS
    if n < 2:
        return
    cell = np.floor(x / radius)
    cell = (cell - cell.min(0)).astype(np.int64) + 1
    span = [int(v) for v in cell.max(0) + 2]
    wide = float(span[0]) * span[1] * span[2] * (int(group.max()) + 1) > 2**62
    key = group.astype(object if wide else np.int64) * span[0] + cell[:, 0]
    key = (key * span[1] + cell[:, 1]) * span[2] + cell[:, 2]
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    ends = np.append(first[1:], n)
    around = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) >= (0, 0, 0)]
    for a, b, c in around:
        wanted = keys + ((a * span[1] + b) * span[2] + c)
        at = np.searchsorted(keys, wanted)
        hit = np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == wanted))
        at = at[hit]
        here, there = ends[hit] - first[hit], ends[at] - first[at]
        last = np.cumsum(here * there)
        total = int(last[-1]) if len(last) else 0
        for low in range(0, total, most):
            k = np.arange(low, min(low + most, total))
            which = np.searchsorted(last, k, "right")
            k -= last[which] - here[which] * there[which]
            i, j = first[hit[which]] + k // there[which], first[at[which]] + k % there[which]
            if (a, b, c) == (0, 0, 0):
                i, j = i[i < j], j[i < j]
            i, j = order[i], order[j]
            d = x[i] - x[j]
            d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
            near = d2 <= radius * radius
            i, j, d2 = i[near], j[near], d2[near]
            yield np.minimum(i, j), np.maximum(i, j), d2


def radius_pairs(x: np.ndarray, group: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of ``radius_pair_blocks``."""
    found = list(radius_pair_blocks(x, group, radius))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(v) for v in zip(*found))


def components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each node's connected component: least labels along edges, then shortcuts."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return label
        label = new


def hull_volume(p: np.ndarray) -> float | None:
    """Volume of the convex hull; null for fewer than four points or a flat set.

    Incremental: a point outside some faces replaces them by a fan from the
    horizon they leave.
    """
    p = np.unique(p, axis=0)
    if len(p) < 4:
        return None
    scale = float(np.ptp(p, axis=0).max()) or 1.0
    eps = 1e-10 * scale
    a = p[0]
    b = p[np.argmax(((p - a) ** 2).sum(1))]
    line = (b - a) / np.linalg.norm(b - a)
    off = p - a - ((p - a) @ line)[:, None] * line
    c = p[np.argmax((off**2).sum(1))]
    normal = np.cross(b - a, c - a)
    size = np.linalg.norm(normal)
    if size <= eps * scale:
        return None
    height = (p - a) @ (normal / size)
    d = p[np.argmax(np.abs(height))]
    if np.abs(height).max() <= eps * 10:
        return None
    points = [a, b, c, d]
    middle = (a + b + c + d) / 4

    def face(u: int, v: int, w: int) -> tuple:
        n = np.cross(points[v] - points[u], points[w] - points[u])
        if n @ (points[u] - middle) < 0:
            v, w, n = w, v, -n
        return u, v, w, n, float(n @ points[u])

    faces = [face(0, 1, 2), face(0, 1, 3), face(0, 2, 3), face(1, 2, 3)]
    for q in p:
        seen = [f for f in faces if f[3] @ q - f[4] > eps * np.linalg.norm(f[3])]
        if not seen:
            continue
        edges = [(f[k], f[(k + 1) % 3]) for f in seen for k in range(3)]
        rim = set(edges)
        points.append(q)
        gone = {id(f) for f in seen}
        faces = [f for f in faces if id(f) not in gone] + [face(u, v, len(points) - 1) for u, v in edges if (v, u) not in rim]
    return float(sum(f[4] - f[3] @ middle for f in faces) / 6)
