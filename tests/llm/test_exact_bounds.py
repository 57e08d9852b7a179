"""Sums that 32-bit floats don't hold: links of very long texts, bounds of lopsided vectors."""

import numpy as np

from tidemark.llm import neardup, topk


def test_links_at_just_three_quarters_of_280000_shingles():
    rnd = np.random.default_rng(0)
    a, b = [], []
    for k in range(4):
        n = 240_000 + 7 * k
        shared = rnd.choice(1 << 40, 3 * n // 2, replace=False)  # 100 * both = 75 * all, where both = 6/7 of each
        both = shared[: n - n % 6]
        more = (1 << 41) + np.arange(len(both) // 6 * 2) + (k << 30)
        a.append((2 * k, 2 * k, np.concatenate([both, more[::2]])))
        b.append((2 * k + 1, 2 * k + 1, np.concatenate([both, more[1::2]])))
    x, y = [m[2] for m in a], [m[2] for m in b]
    sizes = neardup.intersections(x, y)
    assert sizes.dtype == np.int64
    for k in range(4):
        assert sizes[k, k] == len(np.intersect1d(x[k], y[k])) and 100 * sizes[k, k] == 75 * (len(x[k]) + len(y[k]) - sizes[k, k])
        assert len(neardup.joining(a[k : k + 1], b[k : k + 1], 75)) == 1
    a[0] = (0, 0, np.append(a[0][2], -1))  # one shingle more, and it is no link
    assert not neardup.joining(a[:1], b[:1], 75)


def test_bounds_hold_for_lopsided_vectors():
    rnd = np.random.default_rng(3)
    for seed in range(6):
        x = rnd.integers(-40, 41, (300, 16))
        x[:, seed] = rnd.integers(200_000, 260_000, 300)
        q = rnd.integers(-3, 4, (20, 16))
        q[:, seed] = rnd.integers(-1, 2, 20)
        lists, score = topk.Lists(x.astype(np.float32)), q @ x.T
        for depth in (1, 40, 150, 290):
            lower, upper = topk.bounds(q.astype(np.float32), lists, depth)
            slack = 1e-6 * np.abs(score).max()  # lower and upper add up in 32 bits
            assert (lower <= score + slack).all() and (score <= upper + slack).all()
