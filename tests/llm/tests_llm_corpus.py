"""Comparison of all pairs for the pipeline's tests."""

import pyarrow as pa

from tablewright.llm.jaccard_join import THRESHOLD, shingle_sets


def brute_near(rows):
    """{key: least key of its class of near copies}."""
    sets = [set(s.tolist()) for s in shingle_sets(pa.array([t for _, t in rows], pa.large_string()))]
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= THRESHOLD * len(sets[i] | sets[j]):
                low, high = sorted((find(a), find(rows[j][0])))
                root[high] = low
    return {k: find(k) for k, _ in rows}
