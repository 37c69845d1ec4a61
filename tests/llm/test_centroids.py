"""Exact clusters against plain Python."""

import hashlib
import math

import numpy as np
import pytest

from runassay.llm import centroids


def plain(rows, k, rounds, width):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    means = [v for _, v in order[:k]]

    def own(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(means))

    for _ in range(rounds):
        parts = {}
        for _, v in kept:
            parts.setdefault(own(v)[1], []).append(v)
        means = [[sum(x) // len(parts[j]) for x in zip(*parts[j])] if j in parts else c for j, c in enumerate(means)]
    found = [(i, *own(v)) for i, v in kept]
    total = {}
    for _, d, j in found:
        total[j] = total.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in means]
    return sorted(((-1 if i is None else i), j, d, total[j], sum(total.values()), digest[j]) for i, d, j in found)


def test_equals_plain_python(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(120)] + [(5, rows[5][1]), (5, rows[6][1])]  # copies, repeats, ties
    rows += [(None, rows[7][1]), (2000, None), (2001, [1.0] * 5), (2002, [None] * 6), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6)]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance string")
    got = centroids.cluster(table.repartition(4), clusters=9, rounds=3, width=6).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == plain(rows, 9, 3, 6)
    assert centroids.cluster(table.limit(0), width=6).count() == 0
    assert centroids.cluster(table.where("vec_id >= 2000"), width=6).count() == 0
    few = table.where("vec_id < 4")
    assert sorted(tuple(r) for r in centroids.cluster(few, clusters=9, rounds=2, width=6).collect()) == plain(rows[:4], 9, 2, 6)


@pytest.mark.parametrize("spread", [3, 40, 100_000])
def test_threshold_walk_equals_all_distances_and_takes_fewer(spread):
    rng = np.random.default_rng(spread)
    c = rng.integers(-spread, spread, (50, 4))
    x = c[rng.integers(0, 50, 2000)] + rng.integers(-spread // 10, spread // 10 + 1, (2000, 4))
    own, best, taken = centroids.nearest_by_threshold(x, c)
    full = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (own == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
    if spread > 3:
        assert taken.mean() < 30


def test_distances_at_the_limit():
    x = np.full((1, 2), centroids.LIMIT)
    assert centroids.nearest_by_threshold(x, -x)[1][0] == 2 * (2 * centroids.LIMIT) ** 2


def test_beyond_the_limit(spark):
    table = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(table, width=2).count()
