"""Raking against plain Python, and the drawn documents."""

import hashlib
import itertools
import random
import re

import pytest

from runassay.llm import mixing


def plain_topic(text):
    n = len(re.findall(mixing.WORD_RE, text))
    if 2 * len(re.findall(mixing.SYMBOL_RE, text)) > n:
        return "markup"
    return "contact" if "@" in text else "brief" if n < 150 else "article" if n < 1000 else "longform"


def plain_cells(rows):
    cells = {}
    for _, text, source, lang in rows:
        key = (source or "", lang or "", plain_topic(text or ""))
        cells[key] = cells.get(key, 0) + len(re.findall(mixing.WORD_RE, text or ""))
    goals = []
    for d, c in enumerate(mixing.DIMENSIONS):
        powered = {v: s ** mixing.TEMPER[c] for v, s in plain_margin(cells, d).items()}
        goals.append({v: p / sum(powered.values()) for v, p in powered.items()})
    return cells, goals, sum(cells.values())


def plain_rates(rows):
    cells, goals, total = plain_cells(rows)
    weight = {k: float(n) for k, n in cells.items()}
    for _, d in itertools.product(range(mixing.SWEEPS), range(3)):
        now = plain_margin(weight, d)
        weight = {k: w * goals[d][k[d]] * total / now[k[d]] if now[k[d]] else 0.0 for k, w in weight.items()}
    return {k: mixing.BUDGET * weight[k] / n if n else mixing.BUDGET for k, n in cells.items()}


def plain_draw(doc):
    return int(hashlib.md5(("" if doc is None else str(doc)).encode()).hexdigest()[:8], 16) / 2**32


def plain_sample_rates(rows):
    """Bounded raking: no weight above the cell's tokens, a lower budget until the margins fit."""
    cells, goals, total = plain_cells(rows)
    now = [plain_margin(cells, d) for d in range(3)]
    budget = min([1.0] + [now[d][v] / total / g for d in range(3) for v, g in goals[d].items() if g])
    for _ in range(mixing.LOWERINGS):
        weight = {k: float(n) for k, n in cells.items()}
        for _, d in itertools.product(range(mixing.SAMPLE_SWEEPS), range(3)):
            have = plain_margin(weight, d)
            weight = {
                k: min(cells[k], w * goals[d][k[d]] * total * budget / have[k[d]]) if have[k[d]] else 0.0 for k, w in weight.items()
            }
        met = [w / goals[d][v] / total / budget for d in range(3) for v, w in plain_margin(weight, d).items() if goals[d][v]]
        if max(1 - min(met), max(met) - 1) <= mixing.MOST_GAP:
            break
        budget *= min(max(min(met), mixing.LOWERED[0]), mixing.LOWERED[1])
    return {k: weight[k] / n if n else 1.0 for k, n in cells.items()}


def plain_margin(cells, d):
    out = {}
    for key, n in cells.items():
        out[key[d]] = out.get(key[d], 0) + n
    return out


def table(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        text = "word " * rng.choice([20, 200, 1500]) + rng.choice(["", "a@b.c", "#" * 900])
        rows.append((i, text, f"s{min(rng.randrange(6), 2)}", rng.choice(["en", "en", "de"])))
    rows += [(500, None, "s1", "en"), (501, "", None, None), (None, "word " * 30, None, "en"), (502, "w " * 40_000, "s0", "de")]
    rows += [(503, "w x y", "s0", "en")] * 2
    wide = [(*r, 7, "clash") for r in rows]
    return rows, spark.createDataFrame(wide, "doc_id long, text string, source string, lang string, n_tokens int, topic string")


def test_rates_and_copies(spark):
    rows, docs = table(spark)
    rates = plain_rates(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        rate = rates[r["source"], r["lang"], r["topic"]]
        assert r["rate"] == pytest.approx(rate, abs=2e-6)
        head = hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:8]
        assert r["copies"] == int(rate) + (int(head, 16) / 2**32 < rate - int(rate))
    drawn = mixing.sampled(docs)
    assert drawn.columns == docs.columns
    rates = plain_sample_rates(rows)
    assert max(rates.values()) <= 1
    want = [d for d, text, source, lang in rows if plain_draw(d) < rates[source or "", lang or "", plain_topic(text or "")]]
    assert sorted(map(str, want)) == sorted(str(r["doc_id"]) for r in drawn.collect())
    assert mixing.mix(docs.limit(0)).count() == 0 == mixing.sampled(docs.limit(0)).count()


def test_margins_meet_given_targets(spark):
    cells = spark.createDataFrame(
        [(s, t, "x", n) for s, t, n in [("a", "p", 10), ("a", "q", 90), ("b", "p", 50), ("b", "q", 50)]],
        "source string, lang string, topic string, n_tokens long",
    )
    targets = {
        "source": spark.createDataFrame([("a", 0.25), ("b", 0.75)], "source string, goal double"),
        "lang": spark.createDataFrame([("p", 0.6), ("q", 0.4)], "lang string, goal double"),
    }
    got = {(r["source"], r["lang"]): r["weight"] for r in mixing.rake(cells, targets, 30).collect()}
    assert got["a", "p"] + got["a", "q"] == pytest.approx(50) and got["a", "p"] + got["b", "p"] == pytest.approx(120)
    odds = got["a", "p"] * got["b", "q"] / got["a", "q"] / got["b", "p"]
    assert odds == pytest.approx(10 * 50 / 90 / 50)  # raking keeps the interaction


def test_plan_has_no_python(spark):
    _, docs = table(spark)
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_kept_tokens_have_the_target_shares(spark):
    """A hot source, a rare language and a rare topic; columns with the names of the join."""
    rng = random.Random(8)
    rows = []
    for i in range(6000):
        source = rng.choices(["hot", "b", "c"], (20, 3, 2))[0]
        text = "word " * rng.choices([60, 300], (2, 5))[0] + ("a@b.c" if rng.random() < 0.05 else "")
        rows.append((i, text, source, rng.choices(["en", "de"], (9, 1))[0], 1.0, "x", "y"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, _m_rate double, rate string, row string")
    kept = mixing.sampled(docs)
    assert kept.columns == docs.columns
    kept = [tuple(r)[:4] for r in kept.collect()]
    before, goals, total = plain_cells([r[:4] for r in rows])
    after = plain_cells(kept)[0]
    whole = sum(after.values())
    for d in range(3):
        was, now = plain_margin(before, d), plain_margin(after, d)
        for v, goal in goals[d].items():
            assert now[v] / whole == pytest.approx(goal, rel=0.1), (v, was[v] / total)
    assert whole > 0.3 * total


def test_plan_of_a_sweep_is_short(spark, monkeypatch):
    """Each step adds one sum to the plan; a join a step doubled it and filled the driver's memory."""
    _, docs = table(spark)
    cells = docs.select(*mixing.with_margins(docs)).groupBy(*mixing.DIMENSIONS).agg(mixing.F.sum("n_tokens").alias("n_tokens"))
    targets = mixing.tempered_targets(cells, mixing.TEMPER)
    plans, pin = [], mixing.pin

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return pin(df, name)

    monkeypatch.setattr(mixing, "pin", seen)
    mixing.rake(mixing.pin(cells, "cells"), targets, 2, most=1.0)
    first, second = plans[-2:]
    assert first.count("Join") == 3 and second.count("Join") == 0
    assert second.count("Exchange") == 3 == second.count("Window [")
