"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard checks.

Exact copies (equal shingle sets) are one node. Nodes that agree in a band form a bucket.
A bucket's members are first compared with one of them only, the one that shares most
buckets with others; that joins nearly all that belong together. What is still apart in a bucket is then compared block by block, so
no link is lost and no bucket is expanded into all its pairs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runassay.llm.common import WORD, mapped, pin, slices
from runassay.llm.graph import components

SHINGLE = 5
PERCENT = 85
#: Parts that the members of a bucket are dealt to when they meet its size and centre.
KEY_SALTS = 8
COORDINATES = 192
#: Chance at most that a pair just at the threshold shares no band.
MISSED = 3e-7
#: Rows, and shingles, on either side of a block pair.
LEFT_BLOCK, RIGHT_BLOCK, SHINGLES_PER_BLOCK = 256, 4096, 1 << 20



@dataclass(frozen=True)
class Rule:
    """A threshold in percent with its bands of rows and the sketch bound before exact checks."""

    percent: int
    bands: int
    rows: int
    least_equal: float

    @classmethod
    def of(cls, percent: int) -> Rule:
        """The longest bands of which the coordinates hold enough for ``MISSED``.

        The bound on equal coordinates lies five standard deviations below the threshold.
        """
        t = percent / 100
        for rows in range(COORDINATES, 0, -1):
            agree = t**rows
            bands = math.ceil(math.log(MISSED) / math.log1p(-agree)) if 0 < agree < 1 else 1
            if bands * rows <= COORDINATES:
                break
        else:
            raise ValueError(f"no bands for a threshold of {percent} percent")
        return cls(percent, bands, rows, math.floor(100 * (t - 5 * math.sqrt(t * (1 - t) / COORDINATES))) / 100)


RULE = Rule.of(PERCENT)
BANDS, ROWS = RULE.bands, RULE.rows

_WORDS = re.compile(WORD)
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _permute(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle numbers of each text."""
    words: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        found = _WORDS.findall(text.translate(_FOLD) if not text.islower() else text)
        words += found
        counts[i] = len(found)
    if not words:
        return [np.zeros(0, np.uint64)] * len(texts)
    code, distinct = pd.factorize(np.array(words, dtype=object))
    number = _mix64(pd.util.hash_array(np.asarray(distinct, dtype=object), categorize=False))[code]
    window = np.zeros(len(words), np.uint64)
    reach = len(words) - SHINGLE + 1
    if reach > 0:
        for k in range(SHINGLE):
            window[:reach] = window[:reach] * _ODD + number[k : k + reach]
        window = _mix64(window)
    sets, begin = [], 0
    for n in counts.tolist():
        if n >= SHINGLE:
            sets.append(np.unique(window[begin : begin + n - SHINGLE + 1]))
        elif n:
            whole = np.uint64(n)
            with np.errstate(over="ignore"):
                for x in number[begin : begin + n]:
                    whole = whole * _ODD + x
            sets.append(_mix64(np.array([~whole], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
        begin += n
    return sets


def circulant_minhash(sets: list[np.ndarray]) -> np.ndarray:
    """Low bytes of the signatures, a row per set, none of which is empty.

    One permutation scatters the shingles over a circle of 2**32 places. Coordinate k is the
    least value of the second permutation after a shift of the circle by k.
    """
    out = np.zeros((len(sets), COORDINATES), np.uint8)
    sizes = np.array([len(s) for s in sets], np.int64)
    begin = 0
    while begin < len(sets):
        # About 64k shingles at a time stay in the processor's cache.
        end = max(begin + 1, int(np.searchsorted(np.cumsum(sizes[begin:]), 1 << 16)) + begin)
        joined = np.concatenate(sets[begin:end])
        starts = np.concatenate([[0], np.cumsum(sizes[begin:end])[:-1]])
        place = _permute((joined ^ (joined >> np.uint64(32))).astype(np.uint32))
        for k in range(COORDINATES):
            least = np.minimum.reduceat(_permute(place + np.uint32(k + 1)), starts)
            out[begin:end, k] = least & np.uint32(0xFF)
        begin = end
    return out


FEATURES = "n_shingles long, hi long, lo long, sketch binary"


def _features(batches) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = shingle_sets([t or "" for t in batch.column("text").to_pylist()])
        full = [i for i, s in enumerate(sets) if len(s)]
        sketch: list[bytes | None] = [None] * len(sets)
        for i, row in zip(full, circulant_minhash([sets[i] for i in full]), strict=True):
            sketch[i] = row.tobytes()
        digest = np.array([_digest(s) for s in sets], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "hi": pa.array(digest[:, 0]),
                "lo": pa.array(digest[:, 1]),
                "sketch": pa.array(sketch, pa.binary()),
            }
        )


def _digest(numbers: np.ndarray) -> list[int]:
    return np.frombuffer(xxhash.xxh3_128_digest(numbers.tobytes()), "<i8").tolist()


def _sets(batches) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = shingle_sets([t or "" for t in batch.column("text").to_pylist()])
        yield pa.RecordBatch.from_pydict(
            {"id": batch.column("doc_id"), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())}
        )


def _alike(batches, rule: Rule) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches and sizes allow the similarity."""
    for batch in batches:
        a, b = (_matrix(batch.column(c)) for c in ("sketch_a", "sketch_b"))
        n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
        keep = ((a == b).sum(axis=1) >= rule.least_equal * COORDINATES) & _sizes_fit(n, m, rule)
        yield batch.filter(pa.array(keep)).select(["a", "b"])


def _matrix(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def _sizes_fit(n, m, rule: Rule):
    return 100 * np.minimum(n, m) >= rule.percent * np.maximum(n, m)


def _linked(batches, rule: Rule) -> Iterator[pa.RecordBatch]:
    """Pairs that pass on the full sets."""
    for batch in slices(batches, "set_a"):
        keep = []
        for a, b in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= rule.percent * (len(x) + len(y) - both))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _sets_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """``(id, shingles)`` of the documents in ``ids (doc_id)`` only, written once."""
    needed = pin(ids.distinct(), "needed")
    return pin(
        mapped(texts.join(needed, "doc_id", "left_semi"), _sets, "id long, shingles binary").distinct(), "sets"
    )


def _star_links(stars: DataFrame, nodes: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Edges among the pairs ``(a, b)``: by sketch first, then by the full sets."""
    own = nodes.select("id", "n_shingles", "sketch")
    alike = mapped(
        stars.join(own.toDF("a", "n_a", "sketch_a"), "a").join(own.toDF("b", "n_b", "sketch_b"), "b"),
        _alike,
        "a long, b long",
        rule,
    )
    pairs = pin(alike.distinct(), "pairs")
    sets = _sets_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), texts)
    full = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    return pin(mapped(full, _linked, "a long, b long", rule).distinct(), "links")


def _block_pairs(batches, rule: Rule) -> Iterator[pa.RecordBatch]:
    """Compare left and right rows of each block pair; rows come sorted by block pair."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) < 8 << 20:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        blocks = _block_numbers(table)
        last = int(np.searchsorted(blocks, blocks[-1])) if len(blocks) else 0
        if last:
            yield from _compare(table.slice(0, last), blocks[:last], rule)
            held = table.slice(last).combine_chunks().to_batches()
        else:
            held = table.to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield from _compare(table, _block_numbers(table), rule)


def _block_numbers(table: pa.Table) -> np.ndarray:
    """Number of each row's block pair, counted from the start of the table."""
    new = np.zeros(table.num_rows, bool)
    for c in ("key", "left_block", "right_block"):
        x = table.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


def _compare(table: pa.Table, blocks: np.ndarray, rule: Rule) -> Iterator[pa.RecordBatch]:
    """Links between left and right rows of a block pair, checked on the full sets.

    A pair that shares several bands is compared in the first of them only.
    """
    if not table.num_rows:
        return
    ids, comps, sizes, bands = (
        table.column(c).to_numpy() for c in ("id", "component", "n_shingles", "band")
    )
    left = table.column("is_left").to_numpy(zero_copy_only=False)
    sketch = _matrix(table.column("sketch").combine_chunks())
    sets = table.column("shingles").combine_chunks()
    edges = np.flatnonzero(np.diff(blocks, prepend=-1, append=blocks[-1] + 1))
    links: set[tuple[int, int]] = set()
    for begin, end in zip(edges[:-1], edges[1:], strict=True):
        rows = np.arange(begin, end)
        right = rows[~left[begin:end]]
        for i in rows[left[begin:end]]:
            fit = right[(comps[right] != comps[i]) & _sizes_fit(sizes[right], sizes[i], rule)]
            same = sketch[fit] == sketch[i]
            near = same.sum(axis=1) >= rule.least_equal * COORDINATES
            banded = same[near][:, : rule.bands * rule.rows]
            first = banded.reshape(-1, rule.bands, rule.rows).all(axis=2).argmax(axis=1)
            x = np.frombuffer(sets[int(i)].as_py(), np.uint64) if near.any() else None
            for j in fit[near][first == bands[i]]:
                y = np.frombuffer(sets[int(j)].as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= rule.percent * (len(x) + len(y) - both):
                    links.add((int(max(ids[i], ids[j])), int(min(ids[i], ids[j]))))
    found = sorted(links)
    yield pa.RecordBatch.from_pydict(
        {"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())}
    )


def _remaining_links(
    members: DataFrame, found: DataFrame, nodes: DataFrame, texts: DataFrame, rule: Rule = RULE
) -> DataFrame:
    """Edges between members of a bucket that lie in different components so far.

    A bucket's most frequent component is compared with the members of all others, and
    those among each other, in blocks of bounded size. Rows carry their sets, so only links
    come out of a block, however many pairs it looks at.
    """
    placed = (
        members.select("band", "key", "id")
        .join(found, "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
    open_ = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    placed = pin(placed.join(open_.where("x <> y").select("key"), "key", "left_semi"), "open")
    sets = _sets_of(placed.select(F.col("id").alias("doc_id")), texts)
    own = nodes.select("id", "n_shingles", "sketch")
    sizes = (
        placed.join(own.select("id", "n_shingles"), "id")
        .groupBy("key", "component")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
        .groupBy("key")
        .agg(
            F.max_by("component", F.struct("n", "component")).alias("main"),
            F.sum("n").alias("n"), F.max("n").alias("n_main"), F.sum("s").alias("s"),
            (F.sum("s") - F.max_by("s", F.struct("n", "component"))).alias("s_left"),
        )
    )
    rows = placed.join(sizes, "key").join(own, "id").join(sets, "id")

    def blocks(n, s, rows_each: int, shingles_each: int):
        return F.greatest(F.ceil(n / rows_each), F.ceil(s / shingles_each)).cast("int")

    n_left = blocks(F.col("n") - F.col("n_main"), F.col("s_left"), LEFT_BLOCK, SHINGLES_PER_BLOCK)
    n_right = blocks(F.col("n"), F.col("s"), RIGHT_BLOCK, SHINGLES_PER_BLOCK)
    slot = F.xxhash64("id")
    columns = ["band", "key", "id", "component", "n_shingles", "sketch", "shingles"]
    left = rows.where(F.col("component") != F.col("main")).select(
        *columns, F.lit(True).alias("is_left"),
        F.pmod(slot, n_left).cast("int").alias("left_block"),
        F.explode(F.sequence(F.lit(0), n_right - 1)).alias("right_block"),
    )
    right = rows.select(
        *columns, F.lit(False).alias("is_left"),
        F.explode(F.sequence(F.lit(0), n_left - 1)).alias("left_block"),
        F.pmod(slot, n_right).cast("int").alias("right_block"),
    )
    block = ["key", "left_block", "right_block"]
    compared = mapped(
        left.unionByName(right).repartition(*block).sortWithinPartitions(*block), _block_pairs, "a long, b long", rule
    )
    return pin(compared.distinct(), "more-links")


def _by_key(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of ``id`` and ``key`` with the one row of facts on their key.

    The members of a key are dealt to ``KEY_SALTS`` parts, each of which meets a copy of the
    facts, so a bucket that holds a large part of all rows is no task of its own.
    """
    copies = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(KEY_SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(KEY_SALTS)).cast("int"))
    return salted.join(copies, ["key", "salt"]).drop("salt")


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of each document.

    Documents whose shingle sets share ``percent`` of their union are linked.

    Texts without a word have an empty set and are linked with nothing; null texts likewise.
    Repeated rows share a component. A row without an id belongs to its copies' component
    and is kept only if it has no copies with an id. Several rows of one id count as one
    document if that id is the least of their copies. Other columns are ignored; an empty
    table gives no rows.
    """
    rule = Rule.of(percent)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = pin(mapped(texts, _features, f"doc_id long, {FEATURES}"), "features")
    nodes = pin(
        rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("hi", "lo")
        .agg(
            F.min("doc_id").alias("id"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("sketch").alias("sketch"),
            F.count(F.lit(1)).alias("copies"),
        ),
        "nodes",
    )
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(rule.bands - 1)),
        lambda b: F.xxhash64(b, F.substring(F.col("sketch"), b * rule.rows + 1, F.lit(rule.rows))),
    )
    keyed = nodes.select("id", F.posexplode(bands).alias("band", "key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    placed = pin(_by_key(keyed, sizes), "placed")
    # The text that others were made from shares most bands with most of them.
    shared = placed.groupBy("id").agg(F.sum("n").alias("shared"))
    centres = placed.join(shared, "id").groupBy("key").agg(
        F.max_by("id", F.struct("shared", -F.col("id"))).alias("centre")
    )
    members = pin(_by_key(placed, centres).where("id <> centre"), "members")
    stars = members.select(
        F.greatest("id", "centre").alias("a"), F.least("id", "centre").alias("b")
    ).distinct()
    links = _star_links(stars, nodes, texts, rule)
    found = pin(components(links), "components")
    more = _remaining_links(members, found, nodes, texts, rule)
    found = components(links.unionByName(more))
    groups = (
        nodes.select("hi", "lo", "id", "copies")
        .join(found, "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
        .where("copies > 1 OR component <> id")
    )
    groups = pin(groups.select("hi", "lo", "component"), "groups")
    single = F.col("n_shingles") == 0
    alone = rows.where(single).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component"))
    joined = rows.where(~single).join(groups, ["hi", "lo"], "left").select("doc_id", "n_shingles", "component")
    component = F.coalesce("component", "doc_id")
    return joined.unionByName(alone).select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.when(component.isNull(), True).otherwise(F.coalesce(F.col("doc_id") == component, F.lit(False))).alias("kept"),
    )


def drop_near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents without those that a smaller id of their component stands for.

    Texts that are null, empty or without words are all kept; of repeated rows with one id all
    stay if that id does; a row without id stays unless a copy has one; a tie is a link from
    ``percent`` on; all columns are kept, whatever their names; an empty table stays empty.
    """
    verdicts = near_duplicates(documents, percent)
    drop = pin(verdicts.where(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct(), "dropped")
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(drop, "id", "left_anti").select("row.*")
