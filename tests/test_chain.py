"""Linkage by nearest-neighbour chains against merging the closest pair again and again."""

import time

import numpy as np
import pytest

from scorelake.operators.cluster import chain_merges


def _greedy(distance, linkage, cut):
    groups = [[i] for i in range(len(distance))]
    gap = (lambda g, h: distance[np.ix_(g, h)].max()) if linkage == "complete" else (lambda g, h: distance[np.ix_(g, h)].mean())
    while len(groups) > 1:
        best = min((gap(g, h), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
        if best[0] > cut:
            break
        joined = groups[best[1]] + groups[best[2]]
        groups = [g for i, g in enumerate(groups) if i not in best[1:]] + [joined]
    return sorted(sorted(g) for g in groups)


def _cut(merges, k, cut):
    root = np.arange(k)
    for height, i, j in merges:
        if height <= cut:
            root[root == root[j]] = root[i]
    return sorted(sorted(np.flatnonzero(root == r).tolist()) for r in set(root.tolist()))


@pytest.mark.parametrize("linkage", ["average", "complete"])
def test_chain_equals_greedy_merging(linkage):
    rng = np.random.default_rng(2)
    for k in (1, 2, 5, 12, 30):
        d = rng.random((k, k))
        d = (d + d.T) / 2
        merges = chain_merges(d, linkage)
        assert len(merges) == k - 1
        for cut in (0.2, 0.4, 0.6, 2.0):
            assert _cut(merges, k, cut) == _greedy(d, linkage, cut)


def test_two_thousand_variables_in_seconds():
    d = np.random.default_rng(3).random((2000, 2000))
    began = time.time()
    assert len(chain_merges((d + d.T) / 2, "average")) == 1999
    assert time.time() - began < 30
