"""Density clustering of a series' rows: clusters that persist longest as the density threshold rises."""

from __future__ import annotations

import numpy as np

from tessera.operators.models import hmm


def _spanning_tree(x: np.ndarray, neighbours: int) -> np.ndarray:
    """(distance, i, j) of the least tree under mutual reachability; a row of distances at a time, never all of them."""
    n = len(x)
    core = np.array([np.partition(((x - row) ** 2).sum(1), min(neighbours, n - 1))[min(neighbours, n - 1)] for row in x]) ** 0.5
    best, link, free, at, edges = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool), 0, []
    for _ in range(n - 1):
        free[at] = False
        d = np.maximum(np.maximum(((x - x[at]) ** 2).sum(1) ** 0.5, core), core[at])
        closer = free & (d < best)
        best[closer], link[closer] = d[closer], at
        at = int(np.where(free, best, np.inf).argmin())
        edges.append((best[at], link[at], at))
    return np.array(sorted(edges)) if edges else np.zeros((0, 3))


def _dendrogram(edges: np.ndarray, n: int) -> list[tuple[int, int, float, int]]:
    """Merges (left, right, distance, size); nodes from n on are merges in their order."""
    up, size, out = list(range(2 * n)), [1] * n, []

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for d, i, j in edges:
        a, b = root(int(i)), root(int(j))
        up[a] = up[b] = n + len(out)
        size.append(size[a] + size[b])
        out.append((a, b, float(d), size[-1]))
    return out


def hdbscan(x: np.ndarray, least: int = 5, neighbours: int | None = None) -> np.ndarray:
    """Labels from 0 by the clusters' first rows; -1 is noise. ``least`` rows make a cluster."""
    n = len(x)
    if n < 2 * least:
        return np.full(n, -1)
    merges = _dendrogram(_spanning_tree(x, neighbours or least), n)
    size = lambda v: 1 if v < n else merges[v - n][3]
    # a cluster lives from the density at which it splits off until it splits itself; rows that fall off leave it on the way
    born, stability, children, members, work = {0: 0.0}, {0: 0.0}, {0: []}, {0: []}, [(n + len(merges) - 1, 0)]
    while work:
        node, c = work.pop()
        if node < n:
            members[c].append(node)
            continue
        a, b, d, _ = merges[node - n]
        density = 1 / max(d, 1e-12)
        if size(a) >= least and size(b) >= least:
            stability[c] += (size(a) + size(b)) * (density - born[c])
            for side in (a, b):
                k = len(born)
                born[k], stability[k], children[k], members[k] = density, 0.0, [], []
                children[c].append(k)
                work.append((side, k))
            continue
        for side in (a, b):
            if size(side) < least:
                stability[c] += size(side) * (density - born[c])
                stack = [side]
                while stack:
                    v = stack.pop()
                    if v < n:
                        members[c].append(v)
                    else:
                        stack += merges[v - n][:2]
            else:
                work.append((side, c))
    best, chosen = {}, {}
    for c in sorted(born, reverse=True):  # children have higher numbers
        inner = sum(best[k] for k in children[c])
        chosen[c] = bool(c) and (not children[c] or stability[c] >= inner)
        best[c] = stability[c] if chosen[c] else inner
    labels, stack = np.full(n, -1), [(0, -1)]
    while stack:
        c, mark = stack.pop()
        mark = c if mark < 0 and chosen[c] else mark
        labels[members[c]] = mark
        stack += [(k, mark) for k in children[c]]
    _, first = np.unique(labels[labels >= 0], return_index=True)
    order = labels[labels >= 0][np.sort(first)]
    return np.array([-1 if v < 0 else int(np.flatnonzero(order == v)[0]) for v in labels])


def density_states(x: np.ndarray, least: int = 5, k: int = 2, seed: int = 0) -> np.ndarray:
    """Noise takes the most common label; rows that are all noise are clustered by k-means instead."""
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1.0)
    labels = hdbscan(z, least)
    if (labels < 0).all():
        return hmm.kmeans(z, k, np.random.default_rng(seed))[0]
    return np.where(labels < 0, np.bincount(labels[labels >= 0]).argmax(), labels)
