"""Components and links against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from runassay.llm import near_dups
from runassay.llm.graph import components


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)]
    edges += [(100 + i, 101 + i) for i in range(20)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == roots(nodes, [e for e in edges if e[0] != e[1]])


def plain_set(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def plain_components(rows, percent=85):
    sets = [(d, plain_set(t)) for d, t in rows if d is not None]
    edges = [
        (a, b)
        for i, (a, x) in enumerate(sets)
        for b, y in sets[:i]
        if x and y and 100 * len(x & y) >= percent * len(x | y)
    ]
    return roots({d for d, _ in sets}, edges)


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_sets_and_signatures():
    texts = ["A b c d e f", "a B c d e", "a b", "B a", "", "x " * 50_000, "É b c d e", "é b c d e"]
    sets = near_dups.shingle_sets(texts)
    assert [len(s) for s in sets] == [len(plain_set(t)) for t in texts]
    assert sets[1][0] in sets[0] and sets[2][0] != sets[3][0] and sets[6][0] != sets[7][0]
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    pair = near_dups.shingle_sets([" ".join(words), edited(words, rng, 6)])
    share = (lambda s: (s[0] == s[1]).mean())(near_dups.circulant_minhash(pair))
    true = len(set(pair[0]) & set(pair[1])) / len(set(pair[0]) | set(pair[1]))
    assert abs(share - true) < 0.1


def test_links_equal_brute_force(spark):
    rng = random.Random(7)
    rows, k = [], 0
    for size in (1, 2, 3, 40, 60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(size):
            rows.append((rng.randrange(10**9), edited(words, rng, rng.choice([0, 1, 2, 3, 4, 5]))))
    chain = [f"c{i}" for i in range(150)]
    for step in range(12):  # each like the next, the ends unlike
        rows.append((rng.randrange(10**9), " ".join(chain)))
        chain[step * 5 : step * 5 + 2] = [f"s{step}", f"t{step}"]
    rows += [(5, "short text"), (3, "Short Text"), (8, "text short"), (11, None), (12, ""), (13, " \n")]
    rows += [(20, "r e p e a t"), (20, "r e p e a t"), (None, "short text"), (None, "no copies at all"), (9, "z " * 30_000)]
    table = spark.createDataFrame([(d, t, k, k, True) for d, t in rows], "doc_id long, text string, hi int, component_id int, kept boolean")
    got = near_dups.near_duplicates(table).collect()
    assert len(got) == len(rows)
    want = plain_components(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    texts = dict(rows)
    assert all(r["n_shingles"] == len(plain_set(texts[r["doc_id"]])) for r in got if r["doc_id"] is not None)
    assert sorted((r["component_id"] or 0, r["kept"]) for r in got if r["doc_id"] is None) == [(0, True), (3, False)]
    left = near_dups.drop_near_duplicates(table)
    assert left.columns == table.columns
    assert sorted(x["doc_id"] for x in left.where("doc_id is not null").collect()) == sorted(
        d for d, _ in rows if d is not None and want[d] == d
    )
    assert near_dups.near_duplicates(table.limit(0)).count() == 0


def test_blocks_lose_no_link(spark, monkeypatch):
    """What the first comparison leaves apart is found by blocks, however small they are."""
    monkeypatch.setattr(near_dups, "LEFT_BLOCK", 2)
    monkeypatch.setattr(near_dups, "RIGHT_BLOCK", 3)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(150)]
    rows = [(i, edited(words, rng, rng.choice([0, 1, 2, 4, 9]))) for i in range(30)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    sets = near_dups.shingle_sets([t for _, t in rows])
    sketches = near_dups.circulant_minhash(sets)
    nodes = [(i, len(sets[i]), bytearray(sketches[i].tobytes())) for i in range(30)]
    table = spark.createDataFrame(nodes, "id long, n_shingles long, sketch binary")
    # Every shared band is a bucket, as in the operator, and no pair was compared before.
    members = [
        (b, b * 1000 + int.from_bytes(sketches[i][b * 6 : b * 6 + 2].tobytes(), "big"), i)
        for i in range(30)
        for b in range(near_dups.BANDS)
    ]
    members = spark.createDataFrame(members, "band int, key long, id long")
    found = spark.createDataFrame([(i, i % 4) for i in range(30)], "id long, component long")
    got = {(r["a"], r["b"]) for r in near_dups._remaining_links(members, found, table, texts).collect()}
    plain = [plain_set(t) for _, t in rows]
    want = {
        (i, j)
        for i in range(30)
        for j in range(i)
        if i % 4 != j % 4 and 100 * len(plain[i] & plain[j]) >= 85 * len(plain[i] | plain[j])
    }
    assert got == want and want


def test_the_pipeline_drops_pairs_from_80_percent_on(spark):
    import corpus_pipeline

    rng = random.Random(8)
    rows, shares = [], []
    for k, size in enumerate((118, 118, 118, 84)):
        words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        other = list(words)
        for at in (20, 60)[: 2 if size == 84 else 1]:
            other[at : at + 8 - 2 * k] = [f"n{rng.randrange(10**6)}" for _ in range(8 - 2 * k)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        a, b = plain_set(rows[-2][1]), plain_set(rows[-1][1])
        shares.append(len(a & b) / len(a | b))
    assert [80 <= 100 * x < 85 for x in shares] == [True, True, False, False] and shares[2] > 0.85 and shares[3] < 0.8
    table = spark.createDataFrame(rows, "doc_id long, text string")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(corpus_pipeline.one_of_each(spark, table, "")) == [0, 2, 4, 6, 7]
    assert ids(near_dups.drop_near_duplicates(table)) == [0, 1, 2, 3, 4, 6, 7]


def test_dropping_keeps_columns_of_any_name(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(2, words, "x", 1, None), (1, words, "y", 2, "r"), (3, None, "z", 3, "r"), (None, "", "z", 3, "r"), (3, None, "z", 3, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, id int, row string")
    kept = near_dups.drop_near_duplicates(docs, 80)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r["doc_id"] != 2)
