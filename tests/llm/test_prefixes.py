"""The trie against plain Python, over shards and levels small enough to matter."""

import hashlib
import random
import zlib

import pytest

from runassay.llm import prefixes


def plain_trie(rows):
    """Nodes by dictionaries of prefixes."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest[:32], role, text))
    for turns in own.values():
        turns.sort()
    members = {}
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 4
        whole = [t[3:] for t in own.get(conv - conv % 20, [])[:h] + own[conv][h:]]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append((conv, d == len(whole)))
    out = {}
    for path, m in members.items():
        children = [p for p in members if len(p) == len(path) + 1 and p[:-1] == path]
        out[path] = {"n": len(m), "children": len(children), "leaves": 0, "saved": 0, "first": min(c for c, _ in m)}
        ids = ",".join(str(c) for c in sorted(c for c, last in m if last))
        out[path]["ends"] = hashlib.sha256(ids.encode()).hexdigest()
    for path, node in out.items():
        words = len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", path[-1][1])]) if path else 0
        for d in range(len(path) + 1):
            up = out[path[:d]]
            up["leaves"] += node["children"] == 0
            up["saved"] += (node["n"] - 1) * words
    return sorted(
        (n["first"], len(p), out[p[:-1]]["first"] if p else -1, n["n"], n["children"], n["leaves"], n["saved"], n["ends"])
        for p, n in out.items()
    )


def nodes(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.select(*prefixes.RESULT).collect())


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("level,shard", [(512, 1 << 18), (3, 8), (4, 1), (5, 30)])
def test_equals_plain_python(spark, level, shard):
    rng = random.Random(level)
    rows = []
    for conv in range(0, 140):
        n = rng.choice([1, 1, 2, 3, 3, 5, 9, 17])
        for turn in range(n):
            text = rng.choice(["a b", "a b c", "", None, "dé e", "x"]) if rng.random() < 0.9 else f"own {conv}"
            rows.append((conv, turn, rng.choice(["user", "user", "assistant", None]), text))
    rows += [(c, t, "user", f"same {t}") for c in range(400, 460) for t in range(7)]  # a hot sequence
    rows += [(500 + c, t, "user", f"same {t}") for c in range(3) for t in range(4 + c)]
    rows += [(c, None, "user", "no number") for c in (3, 41, 41)] + [(7, 1, "user", "x")] * 2  # ties, repeats
    rows += [(600, t, "user", f"long {t % 3}") for t in range(40)] + [(None, 1, "user", "nobody")]
    table = spark.createDataFrame([(*r, "c") for r in rows], SCHEMA + ", level string").repartition(5)
    assert nodes(prefixes.prefix_trie(table, level, shard)) == plain_trie(rows)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefixes.prefix_trie(empty).count() == 0
    # One conversation whose only turn is replaced by turns that do not exist: a textless root alone.
    conv = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(conv, 0, "user", "gone")]
    assert nodes(prefixes.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain_trie(rows)
    rows = [(40, 0, None, None), (40, 1, "user", "word " * 50_000)]
    assert nodes(prefixes.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain_trie(rows)


def test_median_insertion_keeps_the_tree_low():
    tree = prefixes.TernaryTree()
    for i in prefixes.median_order(1000):
        tree.insert([i])
    depth = [0] * len(tree.turn)
    waiting, deepest = [(tree.down[0], 1)], 0
    while waiting:
        v, d = waiting.pop()
        depth[v], deepest = d, max(deepest, d)
        waiting += [(w, d + 1) for w in (tree.low[v], tree.high[v]) if w]
    assert deepest == 10 and sorted(prefixes.median_order(7)) == list(range(7))
