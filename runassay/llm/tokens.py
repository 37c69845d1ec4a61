"""Token ids of whole texts with a public vocabulary file, a slice of texts at a time."""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept per worker; the store starts anew beyond that. It only saves time.
CACHED_WORDS = 250_000
CACHED_MARKS = 10_000
#: Words of Latin letters, digits and ASCII marks; the vocabulary's rules cut them into runs of
#: letters, single digits and runs of marks. An apostrophe may begin an ending, so it is left out.
KINDS = r"[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9]|[!-&(-/:-@\[-`{-~]+"
PLAIN, PARTS = re.compile(f"(?:{KINDS})+").fullmatch, re.compile(KINDS).findall


def default_vocabulary() -> str:
    """Path of the public word-level BPE file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_names() -> list[str]:
    """Printable stand-in of each byte, as byte-level vocabularies write it."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    names, extra = [], 256
    for byte in range(256):
        if byte in shown:
            names.append(chr(byte))
        else:
            names.append(chr(extra))
            extra += 1
    return names


def _apart(texts: pa.Array) -> pa.Array:
    """Texts in which more words are alike, with the same ids.

    The vocabulary lowers letters, drops white space and cuts a run of marks from the letters
    before it. Case matters only for special tokens, whose first two characters tell.
    """
    if not pc.any(pc.match_substring(texts, "<|")).as_py():
        texts = pc.ascii_lower(texts)
    return pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), r"([a-z])([.,:;!?#$%&*])", r"\1 \2")


class WordTokenizer:
    """Ids of texts, word by word, equal to the library's ids of the whole text.

    The vocabulary drops white space and never merges across it, so a text's ids are
    those of its words in order. Plain words meet the library's merge model directly; every
    other word, and with them special tokens, goes through its full chain. Texts are split
    and their words numbered in Arrow, so only distinct words become Python objects.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.names = _byte_names()
        self.marks: dict[str, list[int]] = {}
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.sizes = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.flat = np.zeros(1 << 20, np.uint32)
        self.end = 0

    def _pieces(self, word: str) -> list[int]:
        if word.isalpha() and max(word) <= "\xff":
            return self._part(word.lower())
        low = word.lower()
        if not PLAIN(low) or "<|" in word or max(word) > "\xff":
            return self.full.encode(word, add_special_tokens=False).ids if word else []
        ids = []
        for part in PARTS(low):
            if part.isalpha():
                ids += self._part(part)
                continue
            found = self.marks.get(part)
            if found is None:
                found = [t.id for t in self.model.tokenize(part)]
                if len(self.marks) < CACHED_MARKS:
                    self.marks[part] = found
            ids += found
        return ids

    def _part(self, letters: str) -> list[int]:
        if not letters.isascii():
            letters = "".join([self.names[b] for b in letters.encode()])
        return [t.id for t in self.model.tokenize(letters)]

    def _slots(self, words: list[str]) -> np.ndarray:
        """Where each word's ids are kept; words that are new are added."""
        known = self.known.get
        slots = np.array([known(w, -1) for w in words], np.int64)
        new = np.flatnonzero(slots < 0)
        if len(new):
            added = [words[i] for i in new.tolist()]
            ids = list(map(self._pieces, added))
            sizes = np.array(list(map(len, ids)), np.int32)
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum()))
            first, end = len(self.known), self.end + len(flat)
            while end > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
            while first + len(new) > len(self.starts):
                self.starts, self.sizes = (np.concatenate([x, np.zeros(len(x), np.int32)]) for x in (self.starts, self.sizes))
            self.flat[self.end : end] = flat
            self.starts[first : first + len(new)] = self.end + np.cumsum(sizes) - sizes
            self.sizes[first : first + len(new)] = sizes
            self.end = end
            slots[new] = np.arange(first, first + len(new))
            self.known.update(zip(added, range(first, first + len(new)), strict=True))
        return slots

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty) in a row, and where each text's ids end."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        words = pc.split_pattern(_apart(pc.fill_null(texts, "")), " ")
        bounds = words.offsets.to_numpy().astype(np.int64)
        numbered = words.flatten().dictionary_encode()
        if len(self.known) > CACHED_WORDS:
            self.reset()
        slots = self._slots(numbered.dictionary.to_pylist())[numbered.indices.to_numpy()]
        sizes = self.sizes[slots]
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        shift = (self.starts[slots] - ends[:-1]).astype(np.int32)
        ids = self.flat[np.repeat(shift, sizes) + np.arange(ends[-1], dtype=np.int32)]
        return ids, ends[bounds[1:] - bounds[0]]


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker process and file."""
    return WordTokenizer(path)
