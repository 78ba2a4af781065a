"""Plain Python versions of the algorithms, for small graphs."""

from collections import defaultdict


def bfs(n, edges, sources):
    out, depth = defaultdict(list), [-1] * n
    for s, d, *_ in edges:
        out[s].append(d)
    frontier, i = [s for s in sources if s < n], 0
    for s in frontier:
        depth[s] = 0
    while frontier:
        i += 1
        found = {d for s in frontier for d in out[s] if depth[d] == -1}
        for d in found:
            depth[d] = i
        frontier = sorted(found)
    return depth


def sssp(n, edges, source, far=2147383647):
    dist = [far] * n
    dist[source] = 0
    for _ in range(n):
        for s, d, w in edges:
            if dist[s] != far:
                dist[d] = min(dist[d], dist[s] + w)
    return dist


def min_labels(n, edges):
    label, again = list(range(n)), True
    while again:
        again = False
        for s, d, *_ in edges:
            if label[s] < label[d]:
                label[d], again = label[s], True
    return label


def pagerank(n, edges, tol=0.01):
    """(ranks, frontier sizes), step by step with frozen inactive vertices."""
    degree, rank, active, sizes = [0] * n, [0.15] * n, set(range(n)), []
    for s, *_ in edges:
        degree[s] += 1
    while active:
        sizes.append(len(active))
        acc = defaultdict(float)
        for s, d, *_ in edges:
            if d in active:
                acc[d] += rank[s] / degree[s]
        new = {v: 0.15 + 0.85 * acc[v] for v in active}
        changed = {v for v in active if abs(new[v] - rank[v]) >= tol}
        for v, r in new.items():
            rank[v] = r
        active = {d for s, d, *_ in edges if s in changed}
    return rank, sizes
