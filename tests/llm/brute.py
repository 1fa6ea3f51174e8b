"""Plain versions of the operators, for small inputs."""

import re
from collections import defaultdict


def shingles(text, width):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def ngram_join(rows, width, num, den):
    """rows of (doc_id, text), in order, to (doc_id, n_shingles, component_id, n_links)."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and den * both >= num * (len(a) + len(b) - both):
                links[i] += 1
                links[j] += 1
                parent[max(top(i), top(j))] = min(top(i), top(j))
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[top(k)].append(i)
    return [(i, len(s), min(ids[top(k)], default=None), links[k]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]
