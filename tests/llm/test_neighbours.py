"""Recall and scores against brute force."""

import numpy as np

from runassay.llm import neighbours


def exact(rows, top, step):
    """Nearest others by cosine, ties to the smaller id, with a vector per id."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for k in np.flatnonzero(ids % step == 0):
        sims = np.round(unit @ unit[k], 12)
        order = [j for j in np.lexsort((ids, -sims)) if ids[j] != ids[k]][:top]
        out[int(ids[k])] = [int(ids[j]) for j in order]
    return out, dict(zip(ids.tolist(), unit, strict=True))


def test_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    rows = [(i, row.astype(np.float32).tolist()) for i, row in enumerate(x)]
    rows += [(5000 + i, rows[0][1]) for i in range(400)]  # a hot vector
    table = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    want, unit = exact(rows, 5, 50)
    got = {}
    for r in sorted(neighbours.nearest(table).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert abs(unit[r["query_id"]] @ unit[r["vec_id"]] - r["score"]) < 1e-9
        assert r["rank"] == len(got[r["query_id"]])
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    assert got[0] == want[0] == [5000, 5001, 5002, 5003, 5004]


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (50, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]),
        (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (None, [1.0, 0.0]), (100, []), (8, [1.0]),
        (1, [2.0, 0.0]), (150, [0.0, 0.0]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r)[:3] for r in neighbours.nearest(table).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 50), (0, 3, 2), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert neighbours.nearest(table.limit(0)).count() == 0
    assert neighbours.nearest(table.where("vec_id = 3")).count() == 0


def test_graph_search_finds_the_nearest():
    rng = np.random.default_rng(1)
    centroids = neighbours.unit_rows(rng.normal(size=(700, 12)))
    graph = neighbours.CentroidGraph.of(centroids)
    x = neighbours.unit_rows(rng.normal(size=(200, 12)))
    found, sims = graph.search(x, 8)
    best = np.sort(x @ centroids.T, axis=1)[:, ::-1][:, :8]
    assert (np.diff(sims, axis=1) <= 0).all() and (np.abs(sims - best).max(axis=1) < 1e-9).mean() > 0.9
    assert all(len(set(r)) == 8 for r in found.tolist())


def test_parts_are_balanced():
    rng = np.random.default_rng(2)
    x = neighbours.unit_rows(np.concatenate([rng.normal(size=(200, 8)), 9 + rng.normal(size=(1800, 8))]))
    centroids = neighbours.balanced_centroids(x, 20)
    sizes = np.bincount((x @ centroids.T).argmax(axis=1), minlength=len(centroids))
    assert 20 <= len(centroids) <= 120 and sizes.max() <= 500
    assert len(neighbours.balanced_centroids(np.repeat(x[:1], 50, axis=0), 10)) >= 1


def test_recall_without_clusters_and_with_many_lists(spark, monkeypatch):
    """Lists so small that a fixed number of them would be a small part of the vectors."""
    monkeypatch.setattr(neighbours, "LIST_TARGET", 24)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(9000, 64)).astype(np.float32)
    rows = list(enumerate(x.tolist()))
    want, _ = exact(rows, 5, 50)
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len(got[q] & set(want[q])) for q in want) >= 0.9 * 5 * len(want)
