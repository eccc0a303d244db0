"""Plain NumPy statement of the scoring definition, for comparison only."""

import numpy as np


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def z(x):
    std = np.std(x, ddof=1) if len(x) > 1 else np.nan
    return (x - np.mean(x)) / (std + 1e-6)


def whiten(raw, owner, projection):
    """raw: rows; owner: molecule number per row, 0..n-1 in library order."""
    if projection is None:
        return unit(raw)
    means = np.stack([raw[owner == m].mean(0) for m in range(owner.max() + 1)])
    return unit((raw - means.mean(0)) @ projection)


def knn(centers, k):
    sims = centers @ centers.T
    np.fill_diagonal(sims, -np.inf)
    n = len(centers)
    dst = np.argsort(-sims, axis=1, kind="stable")[:, : min(k, n - 1)]
    return dst, np.take_along_axis(sims, dst, 1)


def score(raw, owner, refs, p, projection=None):
    """Returns dict of arrays over non-reference molecules in library order."""
    white = whiten(raw, owner, projection)
    n = owner.max() + 1
    centers = unit(np.stack([white[owner == m].mean(0) for m in range(n)]))
    dst, sims = knn(centers, p.graph_neighbors)
    degree = np.bincount(dst.ravel(), minlength=n)
    w = np.exp(sims / p.graph_temperature) / degree[dst] ** p.graph_indegree_exponent
    w = w / np.maximum(w.sum(1, keepdims=True), 1e-12)
    seed = np.zeros(n)
    seed[refs] = 1 / len(refs)
    state = seed
    for _ in range(p.graph_propagation_steps):
        r = p.graph_restart_probability
        state = r * seed + (1 - r) * (w * state[dst]).sum(1)
    support = np.concatenate([white[np.flatnonzero(owner == r)[: p.max_reference_conformers]] for r in refs])
    query = np.setdiff1d(np.arange(n), refs)
    rows = np.isin(owner, query)
    s = white[rows] @ support.T
    k = min(p.support_similarity_topk, s.shape[1])
    pose = np.sort(s, axis=1)[:, ::-1][:, :k].mean(1)
    weighted = p.similarity_weight * z(pose)
    own = owner[rows]
    direct = z(np.array([weighted[own == m].max() for m in query]))
    similarity = np.array([pose[own == m].max() for m in query])
    graph = z(state[query])
    return dict(
        query=query, score=direct + p.graph_weight * graph, similarity=similarity, direct=direct, graph=graph
    )
