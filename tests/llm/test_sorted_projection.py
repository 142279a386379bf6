import math
import random

import numpy as np

from drainwatch.llm.sorted_projection import Passes, near_vectors, passes_for


def corpus(seed, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1):
        for size, noise in ((1, 0), (2, 0.1), (3, 0.2), (60, 0.02), (25, 0.09)) * 3:
            centre = rng.standard_normal(dim)
            rows += [(centre + noise * rng.standard_normal(dim), label) for _ in range(size)]
        rows += [(rng.standard_normal(dim), label) for _ in range(100)]
    rows += [(rows[5][0], 0)] * 3 + [(rows[5][0], 1), (rows[5][0] * 3, rows[5][1])]
    rows = [([float(np.float32(x)) for x in v], label) for v, label in rows]
    random.Random(seed).shuffle(rows)
    return [(i, v, label) for i, (v, label) in enumerate(rows)]


def brute(rows, least):
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= least) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    low, both = np.arange(len(rows)), near | np.eye(len(rows), dtype=bool)
    while True:
        new = np.array([low[b].min() for b in both])
        if (new == low).all():
            return {i: (int(near[i].sum()), int(low[i])) for i in range(len(rows))}
        low = new


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")


def test_links_and_components_equal_brute_force(spark):
    rows = corpus(3)
    want = brute(rows, 0.93)
    for how in (Passes(), Passes(window=8, block=8)):
        got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(frame(spark, rows), how).collect()}
        found = sum(got[i] == want[i] for i in want)
        assert found >= 0.99 * len(want) and all(got[i][0] <= want[i][0] for i in want)


def test_vectors_that_link_with_nothing(spark):
    v, nan, inf = [1.0, 2.0], float("nan"), float("inf")
    rows = [(0, v, 1), (1, v, 1), (1, v, 1), (2, v, None), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (8, [], 1), (None, v, 1), (9, [1.0, 2.0, 0.0], 1), (10, [1e-30, 2e-30], 1), (11, [-1.0, -2.0], 1)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(frame(spark, rows)).collect()), key=str)
    linked = [(0, 3, 0, True), (1, 3, 0, False), (1, 3, 0, False), (10, 3, 0, False)]
    alone = [(i, 0, i, True) for i in (2, 3, 4, 5, 6, 7, 8, 9, 11)] + [(None, 0, None, True)]
    assert got == sorted(linked + alone, key=str)
    assert near_vectors(frame(spark, rows).limit(0)).collect() == []


def test_passes_hold_the_recall_at_every_size():
    for n in (10, 1000, 10**6, 10**9):
        bits = max(0.0, math.log2(n / 128))
        p = (1 - math.acos(0.93) / math.pi) ** bits
        assert 1 - (1 - min(p, 0.99)) ** passes_for(n, Passes()) >= 0.999


def test_labels_of_a_common_direction_keep_their_pairs(spark):
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    n, pairs, dim = 3000, 500, 64
    # All vectors have a cosine of about 0.8, the pairs one of about 0.94.
    own = unit(rng.standard_normal((n, dim)))
    own[pairs : 2 * pairs] = unit(0.7 * own[:pairs] + math.sqrt(1 - 0.7**2) * unit(rng.standard_normal((pairs, dim))))
    shared = np.zeros(dim)
    shared[0] = 1.0
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(math.sqrt(0.8) * shared + math.sqrt(0.2) * own)]
    want = brute(rows, 0.93)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(frame(spark, rows), Passes(window=16)).collect()}
    linked = [i for i in want if want[i][0]]
    assert len(linked) > pairs and sum(got[i] == want[i] for i in linked) >= 0.998 * len(linked)
