"""Plain NumPy versions of the iterative operators, for small inputs only."""

import numpy as np


def distances(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=-1))


def dbscan(x, eps, min_points=5):
    """Scan in row order; label = first core row of the group, None for noise."""
    near = distances(x) <= eps
    core = near.sum(axis=1) >= min_points
    label = [None] * len(x)
    for i in range(len(x)):
        if not core[i] or label[i] is not None:
            continue
        label[i], todo = i, [i]
        while todo:
            p = todo.pop()
            if not core[p]:
                continue
            for q in np.flatnonzero(near[p]):
                if label[q] is None:
                    label[q] = i
                    todo.append(q)
    return label, core


def ward(x, k):
    """Merge the cheapest pair until k clusters are left; the partition as a set of sets."""
    groups = [([i], x[i].copy()) for i in range(len(x))]
    while len(groups) > k:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                (a, ca), (b, cb) = groups[i], groups[j]
                cost = len(a) * len(b) / (len(a) + len(b)) * ((ca - cb) ** 2).sum()
                if best is None or cost < best[0]:
                    best = (cost, i, j)
        _, i, j = best
        members = groups[i][0] + groups[j][0]
        groups = [g for n, g in enumerate(groups) if n not in (i, j)] + [(members, x[members].mean(axis=0))]
    return {frozenset(m) for m, _ in groups}


def merge_pass(sets, alpha):
    """Sequential merge of (n, s, q) states until nothing merges; members are lists of names."""
    def mean_var(n, s, q):
        return (q / n - (s / n) ** 2).mean()

    while True:
        gone, merged = set(), []
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                if i in gone or j in gone:
                    continue
                (na, sa, qa, ma), (nb, sb, qb, mb) = sets[i], sets[j]
                both = (na + nb, sa + sb, qa + qb, ma + mb)
                if mean_var(*both[:3]) < alpha * max(mean_var(na, sa, qa), mean_var(nb, sb, qb)):
                    merged.append(both)
                    gone |= {i, j}
        sets = [c for n, c in enumerate(sets) if n not in gone] + merged
        if not merged:
            return sets
