"""Plain programs for the pipeline's stages."""

import re
from collections import Counter, defaultdict

LOWER = {i: i + 32 for i in range(65, 91)}


def near_groups(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    holders, parent = defaultdict(list), {i: i for i in sets}
    for i in sets:
        for e in sets[i]:
            holders[e].append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        both = Counter(j for e in sets[i] for j in holders[e] if j < i)
        for j, n in both.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def leak_hits(texts, items):
    """Words and hit words of each text."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = set()
    for _, t in items:
        w = words(t)
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}
    out = {}
    for i, t in texts.items():
        w = words(t)
        hit = {p for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for p in range(k, k + n)}
        out[i] = (len(w), len(hit))
    return out
