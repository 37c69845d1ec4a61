"""Language of a text by cross-parsing against suffix automata of labelled text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runassay.llm.common import crc_fold, mapped, pin, slices

#: Bounds of the labelled sample that a model is fitted on: about this many distinct texts
#: per language (all, if there are fewer) and about this many characters, to which each text
#: gives an equal share in EXCERPTS parts spread over it. A model does not grow with the corpus.
TEXTS_PER_LANGUAGE = 150
CHARS_PER_LANGUAGE = 40_000
EXCERPTS = 4
#: Languages that are learnt at most, those with the most texts first.
MOST_LANGUAGES = 512
UNKNOWN = "und"
#: Texts are parsed in blocks of this many characters side by side. A block is first parsed as
#: if it began a phrase and then put right from the state that the block before it leaves.
BLOCK = 1024
#: Moves of an automaton are a table of state by symbol up to this size, else a sorted list.
MOST_CELLS = 1 << 24


def _folded(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in a row and where each ends; runs of other characters are one gap."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = table[np.minimum(points, len(table) - 1)]
    ends = np.cumsum([len(t) for t in texts])
    first = np.zeros(len(symbols), bool)
    first[(ends - [len(t) for t in texts])[[len(t) > 0 for t in texts]]] = True
    keep = symbols != GAP
    keep[1:] |= (symbols[:-1] != GAP) & ~first[1:]
    return symbols[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


#: Symbols: 0 for letters that no labelled text holds, 1 for any run of non-letters.
UNSEEN, GAP, FIRST = 0, 1, 2


def symbol_table(texts: list[str]) -> tuple[np.ndarray, int]:
    """Symbol of each code point: letters of the texts, case folded; and how many there are."""
    letters = sorted({c for t in texts for c in t.lower() if c.isalpha()})
    number = {c: FIRST + i for i, c in enumerate(letters)}
    size = 0x20000  # letters beyond it share the last place
    table = np.zeros(size, np.int64)
    for point in range(size - 1):
        c = chr(point)
        if c.isalpha():
            table[point] = number.get(c.lower(), UNSEEN)
        else:
            table[point] = GAP
    return table, FIRST + len(letters)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the least automaton that reads exactly the substrings of ``symbols``."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in moves[at]:
            moves[at][c] = new
            at = link[at]
        if at >= 0:
            to = moves[at][c]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                copy = len(moves)
                moves.append(dict(moves[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                link[to] = link[new] = copy
                while at >= 0 and moves[at].get(c) == to:
                    moves[at][c] = copy
                    at = link[at]
        last = new
    return moves


class Automaton:
    """Moves of one language over its own symbols; a missing move ends the phrase.

    The next phrase then starts with the same symbol. A step is twice the next state, plus 1
    where a phrase ended. States by symbols are a table while that is small; an alphabet of
    thousands has few moves a state, which are found in a sorted list.
    """

    def __init__(self, symbols: np.ndarray, width: int, most_cells: int | None = None):
        moves = suffix_automaton(symbols.tolist())
        used = np.unique(symbols)
        self.own = np.zeros(width, np.int32)  # 0 for symbols that the language lacks
        self.own[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        begin = np.zeros(self.width, np.int64)
        begin[self.own[list(moves[0])]] = list(moves[0].values())
        self.begin = begin << 1 | 1
        state = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
        symbol = np.array([c for m in moves for c in m], np.int64)
        key = state * self.width + self.own[symbol]
        to = np.array([t for m in moves for t in m.values()], np.int64) << 1
        self.table = None
        if len(moves) * self.width <= (MOST_CELLS if most_cells is None else most_cells):
            self.table = np.tile(self.begin, len(moves))
            self.table[key] = to
            if self.table.max() < 1 << 31:
                self.table = self.table.astype(np.int32)
        else:
            order = np.argsort(key)
            self.keys, self.to = np.append(key[order], -1), np.append(to[order], 0)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Next step of each state for a symbol of ``own`` numbers."""
        if self.table is not None:
            return self.table[state * self.width + symbol]
        key = state.astype(np.int64) * self.width + symbol
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.to[at], self.begin[symbol])

    def phrases(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Phrases of each text between its start and end: whole texts, cut nowhere."""
        symbols = self.own[symbols]
        blocks = -(-(ends - starts) // BLOCK)
        doc = np.repeat(np.arange(len(starts)), blocks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = starts[doc] + nth * BLOCK
        size = np.minimum(BLOCK, ends[doc] - begin)
        count = np.zeros(len(doc), np.int64)
        last = np.zeros(len(doc), np.int64)
        order = np.argsort(-size, kind="stable")
        live = np.searchsorted(-size[order], -np.arange(1, BLOCK + 1), side="right")
        kind = np.int64 if self.table is None else self.table.dtype
        state, ended, at = np.zeros(len(doc), kind), np.zeros(len(doc), kind), begin[order]
        for k in range(int(size.max()) if len(size) else 0):
            n = live[k]
            step = self.step(state[:n], symbols[at[:n] + k])
            ended[:n] += step & 1
            state[:n] = step >> 1
        count[order], last[order] = ended, state
        # From block to block: both parses go on until they are in one state.
        lane = np.flatnonzero(nth > 0)
        old, new = np.zeros(len(lane), np.int64), last[lane - 1]  # states before a block
        while len(lane := lane[(apart := old != new)]):
            old, new = old[apart], new[apart]
            before, lanes, at = last[lane], lane, 0
            while len(lanes):
                symbol = symbols[begin[lanes] + at]
                a, b = self.step(old, symbol), self.step(new, symbol)
                count[lanes] += (b & 1).astype(np.int64) - (a & 1)
                old, new, at = (a >> 1).astype(np.int64), (b >> 1).astype(np.int64), at + 1
                over = (size[lanes] == at) & (old != new)
                last[lanes[over]] = new[over]
                go = (old != new) & ~over
                lanes, old, new = lanes[go], old[go], new[go]
            # A block that ends in another state than before gives the next one a new start.
            turned = (last[lane] != before) & np.isin(lane + 1, np.flatnonzero(nth > 0))
            old, new, lane = before[turned], last[lane[turned]], lane[turned] + 1
        total = np.zeros(len(starts), np.int64)
        np.add.at(total, doc, count)
        return total + (blocks > 0)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray
    automata: list[Automaton]
    bits: np.ndarray

    @classmethod
    def of(cls, samples: dict[str, list[str]], most_cells: int | None = None) -> LanguageModel:
        """Fit on all texts by language; ``bits`` make up for unequal amounts: a phrase costs
        the choice of a place in the model, and a spelt-out symbol at least."""
        table, width = symbol_table([t for ts in samples.values() for t in ts])
        names = sorted(samples)
        automata, bits = [], []
        for name in names:
            symbols, _ = _folded([t + " " for t in samples[name]], table)
            automata.append(Automaton(symbols, width, most_cells))
            bits.append(math.log2(max(len(symbols) + 1, 2 * width)))
        return cls(names, table, automata, np.array(bits))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that each language needs for each text, and the texts' folded lengths."""
        symbols, ends = _folded(texts, self.table)
        starts = np.concatenate([[0], ends[:-1]])
        total = [a.phrases(symbols, starts, ends) for a in self.automata]
        return np.stack(total, axis=1) if total else np.zeros((len(texts), 0), np.int64), ends - starts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language of the fewest normalised phrases (ties: first name) and its share of belief."""
        plain = [t or "" for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total, sizes = self.phrases(plain)
        entropy = total * self.bits[None, :] / np.maximum(sizes, 1)[:, None]
        best = np.argmin(entropy, axis=1)
        gap = (entropy - entropy.min(axis=1, keepdims=True)) * np.sqrt(np.maximum(sizes, 1))[:, None]
        score = 1 / np.exp(-np.minimum(gap, 50)).sum(axis=1)
        none = np.array([not any(map(str.isalpha, t)) for t in plain], bool)
        names = [UNKNOWN if x else self.languages[b] for x, b in zip(none, best, strict=True)]
        return names, np.where(none, 0.0, score)


def fit_languages(documents: DataFrame, learn: Column) -> LanguageModel:
    """Fit on a bounded sample of the rows with ``learn`` and a language and text.

    The share of each language's texts that is taken follows from the number of distinct
    ones; they are chosen by a hash, and a language of few gives all.
    """
    rows = documents.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # Distinct texts are counted by sketches, within about 2 percent.
    distinct = F.approx_count_distinct(F.xxhash64("text"), 0.02)
    sizes = rows.groupBy(F.col("lang").alias("name")).agg(distinct.alias("n")).orderBy(F.desc("n"), "name").limit(MOST_LANGUAGES)
    scale = 1 << 40
    want = F.least(F.lit(scale), F.floor(F.lit(scale * TEXTS_PER_LANGUAGE) / F.greatest("n", F.lit(1))))
    part = F.floor(F.lit(CHARS_PER_LANGUAGE // EXCERPTS) / F.greatest(F.least("n", F.lit(TEXTS_PER_LANGUAGE)), F.lit(1)))
    # At most MOST_LANGUAGES rows, so every task may have them all.
    shares = F.broadcast(pin(sizes.select("name", want.alias("want"), part.cast("int").alias("part")), "languages"))
    hashed = F.pmod(F.xxhash64("text"), F.lit(scale))
    chosen = (
        rows.join(shares, F.col("lang") == F.col("name")).where(hashed < F.col("want"))
        .select("lang", F.xxhash64("text").alias("h"), excerpts(F.col("text"), F.col("part")).alias("text"))
        .dropDuplicates(["lang", "h"])
    )
    samples: dict[str, list[str]] = {}
    for row in sorted(chosen.collect()):
        samples.setdefault(row["lang"], []).append(row["text"])
    samples = {k: v for k, v in samples.items() if any(map(str.isalpha, "".join(v)))}
    return LanguageModel.of(samples)


def excerpts(text: Column, size: Column) -> Column:
    """EXCERPTS parts of ``size`` characters from the text's start to its end; short texts whole."""
    room = F.length(text) - size
    parts = [text.substr((room * k / (EXCERPTS - 1)).cast("int") + 1, size) for k in range(EXCERPTS)]
    return F.when(F.length(text) <= EXCERPTS * size, text).otherwise(F.concat_ws(" ", *parts))


def identify(documents: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Language of each whole text, learnt from the rows outside the held-out fold.

    Null texts and texts without a letter are ``und`` with score 0; rows without a language
    are not learnt from; repeated texts are learnt once. A null ``doc_id`` is in no fold, is
    not held out and not learnt from. Without labelled rows every text is ``und``. Ties go to
    the first name in order. Other columns are ignored; an empty table gives no rows.
    """
    docs = documents.select(
        "doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
        (crc_fold(F.col("doc_id"), folds) == held).alias("held_out"),
    )
    model = fit_languages(docs, ~F.col("held_out"))
    key = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "text")
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return mapped(
        narrow, _identify, f"doc_id {key}, held_out boolean, lang_pred string, score double", shared
    )


def _identify(batches, shared) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        names, score = shared.value.predict(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "held_out": batch.column("held_out"),
                "lang_pred": pa.array(names, pa.string()),
                "score": pa.array(score, pa.float64()),
            }
        )
