"""Tokens, plans and packed rows against plain Python."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from runassay.llm import binary, packing
from runassay.llm.tokens import default_vocabulary, tokenizer

CAP = 64
SCHEMA = "doc_id long, text string, length string, part long, sequence_id string"
ROWS = [
    (1, "The quick, brown fox. It's 12 o'clock!", "x", 1, "a"),
    (2, None, None, None, None),
    (3, "", "x", 2, "b"),
    (4, "Déjà vu; naïve Straße İ ǆ   \x1c tab\tand\nline <|endoftext|> \U0001f600 é", "y", 3, "c"),
    (5, "very long words again " * 200, "z", 4, "d"),
    (5, "very long words again " * 200, "z", 4, "d"),
    (None, "no id here", None, None, None),
]


LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
SPECIAL = ["<|endoftext|>", "a<|endoftext|>b, <|startoftext|>", "x <|ENDOFTEXT|> \t<|endoftext|>\n", "<|endoftext|>" * 50, "<| endoftext |>"]


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def test_ids_equal_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts = [r["text"] for r in docs] + [r[1] for r in ROWS] + SPECIAL
    rng = random.Random(4)
    kinds = "abcXYZéÀßµªº÷×0129²¼.,;:!?#$%&*()<>|[]{}_-+=@'\"~`^/\\ \t\x1c\x85\xa0İ漢"
    texts += ["".join(rng.choice(kinds) for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    texts += ["it's I'm we'LL x'y 'tis", "a<|b", "<|>", "@@@###", "x" * 3000 + "#" * 3000]
    texts += ["", " ", "\n", "  a  b ", "\u3000wide\u00a0 blanks", "a\r\nb", "ÀÉ. ß, ǅ"]
    ids, ends = tokenizer(default_vocabulary()).encode(pa.array(texts, pa.string()))
    assert 49407 in ids and 49406 in ids
    begin = 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        assert ids[begin:end].tolist() == library_ids(text), (text or "")[:80]
        begin = end


def check_plan(plan, counts, capacity):
    bins = {}
    given = dict.fromkeys(counts, 0)
    for length, rank, n, sequence, offset in sorted(plan.rows, key=lambda r: (r[0], r[1])):
        assert rank == given[length]
        given[length] += n
        for k in range(n):
            bins.setdefault(sequence + k, []).append((offset, length))
    assert given == counts
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(bins) == list(range(plan.sequences))
    return bins


def fullest(lengths, room):
    """Largest sum of a subset that fits, by trying all."""
    sums = {0}
    for v in lengths:
        sums |= {s + v for s in sums if s + v <= room}
    return max(sums)


@pytest.mark.parametrize("seed", range(6))
def test_bin_slack_takes_the_fullest_combination(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, CAP) for _ in range(60)]
    counts = {v: lengths.count(v) for v in set(lengths)}
    plan = packing.bin_slack_plan(counts, CAP)
    bins = check_plan(plan, counts, CAP)
    left = list(lengths)
    for k in range(plan.sequences):
        own = [v for _, v in bins[k]]
        first = max(left)
        assert first in own
        left.remove(first)
        assert sum(own) == first + fullest(left, CAP - first)
        own.remove(first)
        for v in own:
            left.remove(v)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_decreasing_equals_one_by_one(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, CAP) for _ in range(200)]
    counts = {v: lengths.count(v) for v in set(lengths)}
    plan = binary.best_fit_plan(counts, CAP)
    bins = check_plan(plan, counts, CAP)
    rooms = []
    for v in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= v]
        if fit:
            i = min(fit, key=lambda i: rooms[i])
            rooms[i] -= v
        else:
            rooms.append(CAP - v)
    assert sorted(rooms) == sorted(CAP - sum(v for _, v in parts) for parts in bins.values())


def test_empty_plans():
    assert packing.bin_slack_plan({}).sequences == binary.best_fit_plan({}).sequences == 0


def test_pack_min_slack(spark, table):
    rows = packing.pack_min_slack(table, CAP).collect()
    expected = []
    for doc, text, *_ in ROWS:
        ids = [*library_ids(text), 0]
        for k, start in enumerate(range(0, len(ids), CAP)):
            cut = np.array(ids[start : start + CAP], "<u4")
            expected.append((doc, k, start, len(cut), zlib.crc32(cut.tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(expected, key=key)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= CAP
    assert packing.pack_min_slack(table.limit(0), CAP).count() == 0


def test_matrices_round_trip(spark, table, tmp_path):
    binary.write_matrices(binary.pack_matrices(table, CAP), str(tmp_path / "m"))
    rows = binary.read_matrices(spark, str(tmp_path / "m")).collect()
    parts = {}
    for r in rows:
        ids = np.frombuffer(bytes(r["input_ids"]), "<u2")
        assert len(ids) == CAP and not ids[r["n_tokens"] :].any()
        cu = r["cu_seqlens"]
        assert cu[0] == 0 and cu[-1] == r["n_tokens"] and r["position_resets"] == cu[:-1]
        places = binary.position_ids(r["position_resets"], r["n_tokens"])
        assert places.tolist() == [i for a, b in zip(cu, cu[1:]) for i in range(b - a)]
        for doc, start, a, b in zip(r["doc_ids"], r["starts"], cu, cu[1:], strict=False):
            parts.setdefault(doc, []).append((start, ids[a:b].tolist()))
    for doc, text, *_ in ROWS:
        whole = [x for _, ids in sorted(parts[doc]) for x in ids]
        if doc != 5:  # two equal rows share that id
            assert whole == [*library_ids(text), 0]
        else:
            assert len(whole) == 2 * (len(library_ids(text)) + 1)
    assert binary.pack_matrices(table.limit(0), CAP).count() == 0
