"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton."""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runassay.llm.common import crc_fold, mapped, pin, slices

#: Bound of the fit: about this many labelled documents are learnt from.
TRAIN_ROWS = 20_000
LEAST_WEIGHT = 2.0
#: Chance of one wrong pattern among all that are tried.
FALSE_PATTERN = 0.01
PREFIXES = range(4, 9)

# Letters of other scripts that look like a Latin one, and substituted signs.
LOOKALIKES = {
    pair[0]: pair[1]
    for pair in (
        "аa вb сc ԁd еe һh іi јj кk ӏl мm нh оo рp ԛq ѕs тt уy ѵv ԝw хx "
        "αa βb εe ηn ιi κk νv οo ρp τt υu χx γy ωw "
        "ɑa ɡg ıi łl øo đd ʟl ɴn ʀr"
    ).split()
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}

_TO_LATIN = str.maketrans(LOOKALIKES) | dict.fromkeys(range(0x300, 0x370))
_SWAPPED = str.maketrans(DIGITS | SIGNS)
#: A digit beside a letter, or a sign before one, stands for a letter.
_SUBSTITUTED = re.compile(r"(?<=[^\W\d_])[0-9]+|[0-9@$!|€]+(?=[^\W\d_])")
_APART = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """Lower-case words with plain letters, single blanks between them and at both ends."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_TO_LATIN)
    text = _SUBSTITUTED.sub(lambda m: m[0].translate(_SWAPPED), text)
    return f" {_APART.sub(' ', text).strip()} "


@dataclass(frozen=True)
class Lexicon:
    """Patterns with weights (`` word `` or a word's start `` wor``) and exception phrases."""

    weights: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = ()

    @functools.cached_property
    def automaton(self):
        import ahocorasick

        found: dict[str, tuple[int, float]] = {p: (len(p), w) for p, w in self.weights}
        found |= {e: (len(e), math.nan) for e in self.exceptions}
        if not found:
            return None
        automaton = ahocorasick.Automaton()
        for pattern, value in found.items():
            automaton.add_word(pattern, value)
        automaton.make_automaton()
        return automaton

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions}

    def hits(self, folded: str) -> dict[int, float]:
        """Weight by start of each hit word; the heaviest pattern counts, excused words don't."""
        if self.automaton is None:
            return {}
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if math.isnan(weight):
                excused.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if excused and best:
            best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in excused)}
        return best


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    bias: float
    by_density: float
    by_weight: float

    def features(self, text: str | None) -> tuple[float, float, int]:
        folded = fold(text or "")
        hits = self.lexicon.hits(folded)
        weight = sum(hits.values())
        words = max(folded.count(" ") - 1, 1)
        return math.log1p(100 * weight / words), math.log1p(weight), len(hits)

    def score(self, text: str | None) -> tuple[float, int]:
        density, weight, hits = self.features(text)
        z = self.bias + self.by_density * density + self.by_weight * weight
        return 1 / (1 + math.exp(-max(min(z, 40.0), -40.0))), hits


def _contexts(batches) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        seen = set()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = fold(text or "").split()
            seen.update(zip(words, ["", *words], [toxic] * len(words), strict=False))
        rows = list(zip(*seen, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_pydict(
            {
                "word": pa.array(rows[0], pa.string()),
                "before": pa.array(rows[1], pa.string()),
                "toxic": pa.array(rows[2], pa.int32()),
            }
        )


def learn_lexicon(train: DataFrame, exceptions: Sequence[str] = ()) -> Lexicon:
    """Patterns that toxic training texts hold far more often than others.

    A word counts once per preceding word and label, so that copies of a text add nothing.
    Patterns are whole words and word starts. One is taken if the likelihood ratio test is
    significant for all patterns tried together; its weight is the smoothed log odds ratio.
    Two-word phrases around a hit that only texts without the label hold become exceptions.
    All that are significant are kept: their number is bounded by the training sample alone.
    """
    contexts = pin(
        mapped(train, _contexts, "word string, before string, toxic int").distinct(), "contexts"
    )
    words = contexts.groupBy("word").agg(
        F.sum("toxic").alias("c1"), F.sum(1 - F.col("toxic")).alias("c0")
    )
    total = words.agg(F.sum("c1").alias("n1"), F.sum("c0").alias("n0")).first()
    n1, n0 = float(total["n1"] or 0), float(total["n0"] or 0)
    if not n1 or not n0:
        return Lexicon((), tuple(f" {' '.join(fold(e).split())} " for e in exceptions))
    starts = [
        F.when(F.length("word") >= k, F.concat(F.lit(" "), F.substring("word", 1, k))) for k in PREFIXES
    ]
    patterns = pin(
        words.select(
            F.explode(F.array_compact(F.array(F.concat(F.lit(" "), "word", F.lit(" ")), *starts))).alias("pattern"),
            "c1",
            "c0",
        )
        .groupBy("pattern")
        .agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0")),
        "patterns",
    )
    tried = max(patterns.count(), 1)
    share = n1 / (n1 + n0)
    both = F.col("c1") + F.col("c0")

    def part(c, p):
        return F.when(c > 0, c * F.log(c / (both * p))).otherwise(F.lit(0.0))

    surprise = 2 * (part(F.col("c1"), share) + part(F.col("c0"), 1 - share))
    weight = F.log((F.col("c1") + 0.5) / (n1 + 1)) - F.log((F.col("c0") + 0.5) / (n0 + 1))
    taken = (
        patterns.select("pattern", weight.alias("weight"), surprise.alias("surprise"))
        .where((F.col("weight") >= LEAST_WEIGHT) & (F.col("surprise") >= 2 * math.log(tried / FALSE_PATTERN)))
        .orderBy(F.desc("surprise"), "pattern")
        .collect()
    )
    lexicon = Lexicon(tuple((r["pattern"], r["weight"]) for r in taken))
    innocent = (
        mapped(contexts, _hit_contexts, contexts.schema.simpleString()[7:-1].replace(":", " "), lexicon)
        .groupBy("before", "word")
        .agg(F.max("toxic").alias("toxic"))
        .where((F.col("toxic") == 0) & (F.col("before") != ""))
        .select("before", "word")
        .collect()
    )
    phrases = [f" {r['before']} {r['word']} " for r in innocent]
    phrases += [f" {' '.join(fold(e).split())} " for e in exceptions]
    return Lexicon(lexicon.weights, tuple(sorted(set(phrases))))


def _hit_contexts(batches, lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit = [bool(lexicon.hits(f" {w} ")) for w in batch.column("word").to_pylist()]
        yield batch.filter(pa.array(hit, pa.bool_()))


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Coefficients, bias first, of rows with counts; a weak ridge keeps them finite."""
    design = np.column_stack([np.ones(len(x)), x])
    at = np.zeros(design.shape[1])
    ridge = np.eye(len(at)) * 0.05
    ridge[0, 0] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        slope = design.T @ (n * (y - p)) - ridge @ at
        curve = (design * (n * p * (1 - p) + 1e-9)[:, None]).T @ design + ridge
        step = np.linalg.solve(curve, slope)
        at += step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-9:
            break
    return at


def fit_toxicity(
    documents: DataFrame, labels: DataFrame, folds: int = 5, exceptions: Sequence[str] = ()
) -> ToxicityModel:
    """Fit lexicon and calibration on labelled documents outside fold 0.

    About ``TRAIN_ROWS`` of them are used, chosen by a hash of the id. The lexicon is learnt
    from three quarters and the calibration from the rest.
    """
    known = (
        labels.where((crc_fold(F.col("doc_id"), folds) != 0) & F.col("toxic").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    scale = 1 << 40
    want = min(scale, scale * TRAIN_ROWS // max(known.count(), 1))
    # About TRAIN_ROWS rows of twelve bytes, whatever the size of the labels.
    chosen = F.broadcast(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < want))
    train = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    first = F.pmod(F.xxhash64("text"), F.lit(4)) != 0
    lexicon = learn_lexicon(train.where(first | F.col("text").isNull()).select("text", "toxic"), exceptions)
    bare = ToxicityModel(lexicon, 0.0, 0.0, 0.0)
    cells = (
        mapped(train.where(~first).select("text", "toxic"), _cells, "density double, weight double, toxic int", bare)
        .groupBy("density", "weight", "toxic")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    # Rounded to tenths, there are a few thousand cells at most.
    if not cells or not lexicon.weights:
        n = sum(r["n"] for r in cells)
        ones = sum(r["n"] * r["toxic"] for r in cells)
        return ToxicityModel(lexicon, math.log((ones + 0.5) / (n - ones + 1)), 0.0, 0.0)
    x = np.array([(r["density"], r["weight"]) for r in cells])
    y, n = (np.array([r[c] for r in cells], float) for c in ("toxic", "n"))
    return ToxicityModel(lexicon, *map(float, fit_logistic(x, y, n)))


def _cells(batches, model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [model.features(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict(
            {
                "density": pa.array([round(f[0], 1) for f in found], pa.float64()),
                "weight": pa.array([round(f[1], 1) for f in found], pa.float64()),
                "toxic": batch.column("toxic"),
            }
        )


def score_toxicity(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` and ``n_hits`` of each whole text.

    Null and empty texts get the score of no hits; repeated rows are scored each; null ids
    stay null; other columns are ignored; an empty table gives no rows.
    """
    key = documents.schema["doc_id"].dataType.simpleString()
    narrow = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return mapped(narrow, _score, f"doc_id {key}, score double, predicted int, n_hits int", shared)


def _score(batches, shared) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [shared.value.score(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "score": pa.array([s for s, _ in found], pa.float64()),
                "predicted": pa.array([int(s >= 0.5) for s, _ in found], pa.int32()),
                "n_hits": pa.array([h for _, h in found], pa.int32()),
            }
        )
