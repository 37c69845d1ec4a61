"""Matching-block ratio of short texts, and a lossless index that finds near ones."""

from __future__ import annotations

import difflib
import functools
import itertools
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from runassay.scale import ship_package, spread

#: Sizes of the shorter text of a pair, and how many letters make a key of the index.
CLASSES = [(1, 1, 1), (2, 3, 2), (4, 6, 3), (7, 10, 4), (11, 16, 4), (17, 24, 3), (25, 48, 2), (49, 1 << 30, 1)]
SLACK = 1e-9


def ratio(a: str, b: str) -> float:
    """Share of letters in common blocks, 0 to 1."""
    return difflib.SequenceMatcher(a=a, b=b).ratio()


def _ratios(cutoff: float):
    """Ratios of pairs, 0 where common letters already rule the cutoff out.

    What is known of ``b`` serves all its neighbours in a row.
    """

    @F.pandas_udf(DoubleType())
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        matcher, out = difflib.SequenceMatcher(), []
        for x, y in zip(a, b, strict=True):
            if y != matcher.b:
                matcher.set_seq2(y)
            matcher.set_seq1(x)
            out.append(matcher.ratio() if matcher.quick_ratio() >= cutoff else 0.0)
        return pd.Series(out, dtype=float)

    return of


def _numbered_letters(text: Column) -> Column:
    """A text's letters as distinct marks: the second ``a`` differs from the first."""
    letters = F.array_sort(F.split(text, ""))
    return F.transform(
        letters, lambda c, i: F.concat(c, (i - F.array_position(letters, c)).cast("string"))
    )


def _rare_first(texts: DataFrame, by: DataFrame) -> DataFrame:
    """``text, marks``: numbered letters of each text, those first that few texts of ``by`` have."""
    marks = lambda df: df.select("text", F.explode(_numbered_letters(F.col("text"))).alias("mark"))
    counts = marks(by).groupBy(F.col("mark").alias("_mark")).agg(F.count(F.lit(1)).alias("texts"))
    ordered = F.array_sort(F.collect_list(F.struct("texts", "mark")))
    return (
        marks(texts).join(counts, F.col("mark") == F.col("_mark"), "left")
        .withColumn("texts", F.coalesce("texts", F.lit(0)))
        .groupBy("text").agg(F.transform(ordered, lambda m: m["mark"]).alias("marks"))
    )


def _rarest(size: int, cutoff: float, shorter: bool) -> Iterator[tuple[int, int, int]]:
    """Class, letters of a key and letters to take them from, for a text of ``size``.

    Two texts whose ratio reaches the cutoff share t letters at least, so of each one's
    rarest ``size - t + k`` letters they have k in common, and with them a combination of k.
    The size class of the shorter text fixes k; a longer text has keys for every class that
    it can meet.
    """
    for number, (low, high, letters) in enumerate(CLASSES):
        least = size if shorter else max(low, math.ceil(size * cutoff / (2 - cutoff) - SLACK))
        if low <= least <= high and (shorter or size >= low):
            k = max(1, min(letters, math.ceil(cutoff * low - SLACK)))
            common = max(k, math.ceil((size + least) * cutoff / 2 - SLACK))
            yield number, k, min(size, size - common + k)


def _keyed(cutoff: float, words: bool, batches) -> Iterator[pa.RecordBatch]:
    """Keys of each text as the shorter and as the longer one of a pair, word or name."""
    for batch in batches:
        for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True):
            keys = set()
            for shorter in (True, False):
                for number, k, rarest in _rarest(len(marks), cutoff, shorter):
                    head = f"{number}{shorter == words}"
                    for letters in itertools.combinations(marks[:rarest], k):
                        keys.add(xxhash.xxh3_64_intdigest(head + "".join(letters)) - (1 << 63))
            yield pa.RecordBatch.from_pydict(
                {"text": pa.array([text] * len(keys), pa.string()), "key": pa.array(sorted(keys), pa.int64())}
            )


def candidates(words: DataFrame, names: DataFrame, cutoff: float) -> DataFrame:
    """``word, name`` pairs among which all are whose ratio can reach ``cutoff``.

    In: distinct ``word`` and distinct ``name``. An inverted index of rare letter combinations
    joins by equality. A text too long or too short for every text of the other side makes no keys.
    """
    ship_package(words.sparkSession)
    reach = (2 - cutoff) / cutoff
    words, names = (df.where(F.char_length(c) > 0) for df, c in ((words, "word"), (names, "name")))
    lengths = [df.agg(F.min(F.char_length(c)), F.max(F.char_length(c))).first() for df, c in ((words, "word"), (names, "name"))]
    spans = [(math.ceil((a or 1) / reach - SLACK), math.floor((b or 0) * reach + SLACK)) for a, b in lengths]
    asked = words.where(F.char_length("word").between(*spans[1])).select(F.col("word").alias("text"))
    offered = names.where(F.char_length("name").between(*spans[0])).select(F.col("name").alias("text"))
    sides = []
    for texts, is_word, column in ((asked, True, "word"), (offered, False, "name")):
        marked = spread(_rare_first(texts, offered), "text")
        keyed = marked.mapInArrow(functools.partial(_keyed, cutoff, is_word), "text string, key bigint")
        sides.append(keyed.select(F.col("text").alias(column), F.col("key").alias("_key")))
    a, b = F.char_length("word"), F.char_length("name")
    near = (a <= b * reach + SLACK) & (b <= a * reach + SLACK)
    return sides[0].join(sides[1], "_key").where(near).select("word", "name").distinct()


def nearest(words: DataFrame, names: DataFrame, cutoff: float) -> DataFrame:
    """``word, ratio, name`` of the best ``name`` at or above ``cutoff``; ties to the greatest.

    In: distinct ``word`` and distinct ``name``. Only :func:`candidates` meet; they come
    sorted by word, over as many tasks as there are shuffle partitions.
    """
    pairs = spread(candidates(words, names, cutoff), "word", "name").sortWithinPartitions("word")
    scored = pairs.withColumn("ratio", _ratios(cutoff)("name", "word")).where(F.col("ratio") >= cutoff)
    return (
        scored.groupBy("word")
        .agg(F.max(F.struct("ratio", "name")).alias("_best"))
        .select("word", "_best.ratio", "_best.name")
    )
