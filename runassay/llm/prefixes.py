"""Prefix trie of conversations: range shards of sorted turn sequences, a ternary tree each.

A turn is known by a digest of role and text. Conversations are cut into levels of at most
``LEVEL`` turns, equal sequences are one, and a level's sequences are range-partitioned, so a
shard holds a sorted run of them whatever they share. A shard encodes its turns by a
dictionary of its own, builds a ternary search tree by median insertion and sums members,
leaves and savings without recursion. Nodes on the way to a shard's first or last sequence
may go on in its neighbours; they are merged by the digest of their prefix. The levels are
worked on from the deepest, whose roots hand their sums to the ends of the one above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runassay.llm.common import WORD, mapped, pin
from runassay.scale import number_rows

#: Conversations are rebuilt from the first turns of the conversation ``id - id % FAMILY``,
#: as many as the id's checksum modulo ``HEADS`` says.
FAMILY, HEADS = 20, 4
#: Turns of a level, and turns that a shard's tree holds at most (one sequence at least).
LEVEL, SHARD_TURNS = 512, 1 << 18
#: Ids whose texts are put together before they are hashed.
ID_BLOCK = 1 << 16
#: Parts that the nodes below one boundary node are dealt to.
SALTS = 32
HEX = 32
TOP = "top"

NODE = (
    "conv_id long, depth long, parent_conv_id long, parent_key string, key string, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, words long, leaf int, path array<string>, boundary boolean"
)
NODE_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_key", pa.string()),
     ("key", pa.string()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
     ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("words", pa.int64()), ("leaf", pa.int32()),
     ("path", pa.list_(pa.string())), ("boundary", pa.bool_())]
)
NOBODY = hashlib.sha256(b"").hexdigest()
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


# ---- sequences ----


def borrowed(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its family."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % F.lit(HEADS)).cast("int")


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, turn`` with ``turn`` the digest and the words of a turn, from 0 on.

    Turns that share a number are ordered by digest, a turn without number comes first.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("no"),
        F.substring(F.sha2(whole, 256), 1, HEX).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("int").alias("words"),
    )
    return number_rows(pin(rows, "turns"), ["conv_id"], ["no", "digest"], name="pos", start=0).select(
        "conv_id", "pos", "digest", "words"
    )


def rebuilt(conversations: DataFrame, level: int = LEVEL) -> DataFrame:
    """``conv_id, level, digests, words, final``: rebuilt conversations in levels of turns.

    ``digests`` is one text, ``HEX`` characters a turn, so it sorts as the sequence does. Every
    conversation has a level 0, if only an empty one.
    """
    turns = pin(turns_of(conversations), "numbered")
    heads = turns.where(F.col("pos") < HEADS - 1).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "words"))).alias("_head")
    )
    ids = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("_own"))
    convs = ids.withColumns({"_base": F.col("conv_id") - F.col("conv_id") % FAMILY, "_h": borrowed(F.col("conv_id"))})
    heads = heads.select(F.col("conv_id").alias("_base"), "_head")
    none = F.array().cast("array<struct<pos:bigint,digest:string,words:int>>")
    lead = convs.join(heads, "_base", "left").select(
        "conv_id", "_h", F.slice(F.coalesce("_head", none), 1, "_h").alias("_head"), "_own"
    )
    taken = F.size("_head")
    lead = lead.select(
        "conv_id", "_h", "_head", taken.cast("long").alias("_taken"),
        (taken + F.greatest(F.col("_own") - F.col("_h"), F.lit(0))).alias("_length"),
    )
    lead = pin(lead, "leads")
    after = F.col("pos") - borrowed(F.col("conv_id"))
    cuts = (
        turns.where(after >= 0).groupBy("conv_id", F.floor(after / level).alias("_cut"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "words"))).alias("_turns"))
        .join(lead.select("conv_id", "_taken"), "conv_id")
    )
    # A cut begins behind the borrowed turns, so its last ones may belong to the next level.
    room = (F.lit(level) - F.col("_taken")).cast("int")
    here = F.struct(F.col("_cut").alias("level"), F.col("_taken").alias("off"), F.slice("_turns", F.lit(1), room).alias("turns"))
    there = F.struct(
        (F.col("_cut") + 1).alias("level"), F.lit(-1).cast("long").alias("off"),
        F.slice("_turns", room + 1, F.lit(level)).alias("turns"),
    )
    both = F.when(F.size("_turns") > room, F.array(here, there)).otherwise(F.array(here))
    own = cuts.select("conv_id", F.inline(both))
    first = lead.select("conv_id", F.lit(0).cast("long").alias("level"), F.lit(-1).cast("long").alias("off"), F.col("_head").alias("turns"))
    parts = own.unionByName(first).groupBy("conv_id", "level").agg(
        F.array_sort(F.collect_list(F.struct("off", "turns"))).alias("_parts")
    )
    turns_in = F.flatten(F.transform("_parts", lambda p: p.turns))
    rows = parts.select("conv_id", "level", turns_in.alias("_turns")).join(lead.select("conv_id", "_length"), "conv_id")
    return rows.select(
        "conv_id", "level",
        F.array_join(F.transform("_turns", lambda t: t.digest), "").alias("digests"),
        F.transform("_turns", lambda t: t.words).alias("words"),
        (F.col("_length") <= (F.col("level") + 1) * level).alias("final"),
    )


def _keys(batches) -> Iterator[pa.RecordBatch]:
    """The class of each level, which is the key of the one before; rows come in order."""
    last, key = None, ""
    for batch in batches:
        ids, levels = batch.column("conv_id").to_pylist(), batch.column("level").to_pylist()
        classes = []
        for conv_id, level, digests in zip(ids, levels, batch.column("digests").to_pylist(), strict=True):
            own = key if conv_id == last and level else TOP
            classes.append(own)
            last, key = conv_id, _key(own, digests)
        yield pa.RecordBatch.from_pydict(
            {"conv_id": pa.array(ids, pa.int64()), "level": pa.array(levels, pa.int64()), "class": pa.array(classes, pa.string())}
        )


def _key(own: str, digests: str) -> str:
    """Identity of the prefix ``digests`` below the class ``own``; the class itself, if empty."""
    return hashlib.sha256(f"{own}:{digests}".encode()).hexdigest()[:HEX] if digests else own


def _ends(batches) -> Iterator[pa.RecordBatch]:
    """sha256 of each key's ids; rows hold blocks of them in ascending order."""
    last, state, keys, values = None, None, [], []
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key != last:
                if state is not None:
                    keys.append(last)
                    values.append(state.hexdigest())
                last, state = key, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "ends": pa.array(values, pa.string())})
        keys, values = [], []
    if state is not None:
        yield pa.RecordBatch.from_pydict({"key": pa.array([last]), "ends": pa.array([state.hexdigest()])})


def sequences(conversations: DataFrame, level: int = LEVEL) -> DataFrame:
    """Distinct sequences of every level: class, key, members, and the hash of those that end.

    ``n_more`` counts the members that go on in the next level. Equal conversations, however
    many, are one row; their ids are sorted in blocks and hashed as a stream.
    """
    rows = pin(rebuilt(conversations, level), "levels")
    if rows.where("level > 0").isEmpty():
        rows = rows.withColumn("class", F.lit(TOP))
    else:
        ordered = rows.select("conv_id", "level", "digests").repartition("conv_id").sortWithinPartitions("conv_id", "level")
        rows = rows.join(mapped(ordered, _keys, "conv_id long, level long, class string"), ["conv_id", "level"])
    key = F.substring(F.sha2(F.concat("class", F.lit(":"), "digests").cast("binary"), 256), 1, HEX)
    rows = rows.withColumn("key", F.when(F.col("digests") == "", F.col("class")).otherwise(key))
    rows = pin(rows, "keyed")
    block = F.floor(F.col("conv_id") / ID_BLOCK)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = rows.where("final").groupBy("key", block.alias("block")).agg(ids.alias("ids"))
    blocks = blocks.repartition("key").sortWithinPartitions("key", "block")
    ends = mapped(blocks.select("key", "ids"), _ends, "key string, ends string")
    distinct = rows.groupBy("level", "class", "key", "digests", "words").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"), F.count_if(~F.col("final")).alias("n_more")
    )
    return distinct.join(ends, "key", "left")


# ---- shards ----


class TernaryTree:
    """Ternary search tree over numbered turns; every node is a prefix of some sequence."""

    def __init__(self):
        self.turn, self.low, self.high, self.down, self.up = [-1], [0], [0], [0], [0]

    def _node(self, turn: int, up: int) -> int:
        for column, value in ((self.turn, turn), (self.low, 0), (self.high, 0), (self.down, 0), (self.up, up)):
            column.append(value)
        return len(self.turn) - 1

    def insert(self, sequence: list[int]) -> int:
        """The node of the last turn; nodes of missing prefixes are made on the way."""
        at = 0
        for turn in sequence:
            up, link, place = at, self.down, at
            while (found := link[place]) and self.turn[found] != turn:
                link, place = (self.low if turn < self.turn[found] else self.high), found
            if not found:
                found = link[place] = self._node(turn, up)
            at = found
        return at


def median_order(n: int) -> Iterator[int]:
    """0 to n - 1, the middle first, then the middles of both halves, and so on."""
    waiting = [(0, n)]
    for begin, end in waiting:
        if begin < end:
            middle = (begin + end) // 2
            yield middle
            waiting += [(begin, middle), (middle + 1, end)]


def shard_nodes(own: str, base: int, rows: list[dict]) -> Iterator[dict]:
    """Nodes of the sorted sequences of one class; those on the outer paths are ``boundary``."""
    cut = [[r["digests"][k : k + HEX] for k in range(0, len(r["digests"]), HEX)] for r in rows]
    number = {d: i for i, d in enumerate(sorted({d for s in cut for d in s}))}
    coded = [[number[d] for d in s] for s in cut]
    tree = TernaryTree()
    ends = [0] * len(rows)
    for i in median_order(len(rows)):
        ends[i] = tree.insert(coded[i])
    size = len(tree.turn)
    depth, words, n, first = [0] * size, [0] * size, [0] * size, [None] * size
    children, leaves, saved, hashes = [0] * size, [0] * size, [0] * size, [None] * size
    digest_of, whole = list(number), [None] * size
    for v in range(1, size):  # a node is made after the one above it
        depth[v] = depth[tree.up[v]] + 1
        children[tree.up[v]] += 1
    for row, v in zip(rows, ends, strict=True):
        n[v] += row["n"]
        first[v] = row["first"]
        hashes[v] = row["ends"]
        children[v] += row["t_children"]
        leaves[v] += row["t_leaves"]
        saved[v] += row["t_saved"]
        whole[v] = row["key"] if row["n_more"] else None
        at = v
        for w in reversed(row["words"]):
            if words[at] or not at:
                break
            words[at], at = w, tree.up[at]
    boundary = [False] * size
    for v in (ends[0], ends[-1]):
        while not boundary[v]:
            boundary[v] = True
            v = tree.up[v]
        boundary[0] = True
    leaf = [0] * size
    for v in range(size - 1, -1, -1):
        if not children[v]:
            leaf[v] = 1
            leaves[v] += 1
        saved[v] += (n[v] - 1) * words[v]
        up = tree.up[v]
        if v:
            n[up] += n[v]
            leaves[up] += leaves[v]
            saved[up] += saved[v]
            if first[up] is None or first[v] < first[up]:
                first[up] = first[v]
    paths: dict[int, list[str]] = {0: [own]}
    prefix: dict[int, str] = {0: ""}
    for v in range(size):
        if boundary[v] and v:
            prefix[v] = prefix[tree.up[v]] + digest_of[tree.turn[v]]
            paths[v] = [*paths[tree.up[v]], _key(own, prefix[v])]
        up = tree.up[v]
        yield {
            "conv_id": first[v], "depth": base + depth[v],
            "parent_conv_id": None if not v or boundary[up] else first[up],
            "parent_key": paths[up][-1] if v and boundary[up] else None,
            "key": paths[v][-1] if boundary[v] else whole[v], "n_convs": n[v], "n_children": children[v],
            "n_leaves": leaves[v], "saved_tokens": saved[v], "ends_sha256": hashes[v], "words": words[v], "leaf": leaf[v],
            "path": paths[v] if boundary[v] else None, "boundary": boundary[v],
        }


def _shards(batches, base: int, most: int) -> Iterator[pa.RecordBatch]:
    """Nodes of every shard: sorted rows of one class with at most ``most`` turns."""
    held: list[dict] = []
    turns = 0

    def nodes() -> Iterator[pa.RecordBatch]:
        out = []
        for node in shard_nodes(held[0]["class"], base, held):
            out.append(node)
            if len(out) == 5000:
                yield pa.RecordBatch.from_pylist(out, NODE_SCHEMA)
                out = []
        yield pa.RecordBatch.from_pylist(out, NODE_SCHEMA)

    for batch in batches:
        for row in batch.to_pylist():
            more = len(row["words"])
            if held and (held[0]["class"] != row["class"] or turns + more > most):
                yield from nodes()
                held, turns = [], 0
            held.append(row)
            turns += more
    if held:
        yield from nodes()


def merged(boundary: DataFrame) -> DataFrame:
    """Boundary nodes with equal prefixes as one, and what their ancestors counted twice.

    Sums of shards add up but for three things: a shared turn saves once more per further
    shard, it is one child of the node above, and a node that ends a shard is no leaf if
    the next shard goes on below it. A node that needs one tells all nodes of its path; a
    shard has two paths, so these rows are few against its turns.
    """
    sums = pin(
        boundary.groupBy("key").agg(
            F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent_key").alias("parent_key"),
            F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
            F.sum("saved_tokens").alias("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"),
            F.max("words").alias("words"), F.sum("leaf").alias("_leaf"), F.min("path").alias("path"), F.count(F.lit(1)).alias("_shards"),
        ),
        "boundary",
    )
    again = F.col("_shards") - 1
    no_leaf = F.when(F.col("n_children") > 0, F.col("_leaf")).otherwise(0)
    wrong = sums.where((again > 0) | (no_leaf > 0)).select(
        F.posexplode("path").alias("_place", "key"), F.size("path").alias("_size"),
        (again * F.col("words")).alias("_saved"), no_leaf.alias("_no_leaf"), again.alias("_again"),
    )
    fix = wrong.groupBy("key").agg(
        F.sum("_saved").alias("_saved"), F.sum("_no_leaf").alias("_no_leaf"),
        F.sum(F.when(F.col("_place") == F.col("_size") - 2, F.col("_again")).otherwise(0)).alias("_children"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return sums.join(fix, "key", "left").select(
        "conv_id", "depth", "parent_key", "key", "n_convs", (F.col("n_children") - zero("_children")).alias("n_children"),
        (F.col("n_leaves") - zero("_no_leaf")).alias("n_leaves"), (F.col("saved_tokens") + zero("_saved")).alias("saved_tokens"),
        "ends_sha256",
    )


def prefix_trie(conversations: DataFrame, level: int = LEVEL, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, the textless root first in depth.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    A null role or text is empty; turns are ordered by number, those without first, equal ones
    by digest; repeated rows are turns each; rows without ``conv_id`` belong to no conversation
    and are left out; the remainder of a negative id has its sign; other columns are ignored;
    an empty table gives no rows. A conversation of any length is cut into levels.
    """
    if level < HEADS - 1:
        raise ValueError(f"a level has to hold the {HEADS - 1} turns that a conversation may borrow")
    distinct = pin(sequences(conversations, level), "sequences")
    deepest = distinct.agg(F.max("level")).first()[0]
    found: list[DataFrame] = []
    tails = None
    for k in range(deepest if deepest is not None else -1, -1, -1):
        rows = distinct.where(F.col("level") == k).drop("level")
        if tails is None:
            rows = rows.withColumns({c: F.lit(0).cast("long") for c in ("t_children", "t_leaves", "t_saved")})
        else:
            rows = rows.join(tails, "key", "left").withColumns(
                {c: F.coalesce(c, F.lit(0)) for c in ("t_children", "t_leaves", "t_saved")}
            )
        ordered = pin(rows, "level").repartitionByRange("class", "digests").sortWithinPartitions("class", "digests")
        nodes = pin(mapped(ordered, _shards, NODE, k * level, shard_turns), "nodes")
        outer = pin(merged(nodes.where("boundary")), "merged")
        inner = nodes.where("NOT boundary").select(*outer.columns, "parent_conv_id")
        found.append(outer.withColumn("parent_conv_id", F.lit(None).cast("long")).unionByName(inner))
        # The root of a class is the end of a sequence one level up, where it is counted.
        tails = outer.where(F.col("parent_key").isNull()).select(
            "key", F.col("n_children").alias("t_children"), F.col("n_leaves").alias("t_leaves"), F.col("saved_tokens").alias("t_saved")
        )
    if not found:
        return conversations.sparkSession.createDataFrame([], NODE).select(*RESULT)
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    # The root of a deeper level is the node that ends the level above, which is kept.
    nodes = nodes.where((F.col("depth") == 0) | F.col("parent_key").isNotNull() | F.col("parent_conv_id").isNotNull())
    # A node whose parent was merged, or lies a level up, finds its id by key.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    above = (
        nodes.where("key IS NOT NULL").groupBy("key").agg(F.min("conv_id").alias("_above"))
        .select(F.col("key").alias("_key"), "_above", salts)
    )
    met = (F.col("parent_key") == F.col("_key")) & (F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)) == F.col("_salt"))
    return nodes.join(above, met, "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "_above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256"),
    )


def prefix_trie_sql() -> str:
    """DuckDB SQL for :func:`prefix_trie`: prefixes as texts, sums over the ancestors of each."""
    byte = "list_reduce(CAST(range(8) AS UBIGINT[]), lambda s, i: xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END), xor(a, b))"
    codes = "list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))"
    return f"""WITH t AS (SELECT conv_id, words, digest, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos
  FROM (SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS words,
    substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, {HEX}) AS digest
    FROM conversations WHERE conv_id IS NOT NULL)),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base,
  xor(list_reduce({codes}, lambda a, b: {byte}, CAST(4294967295 AS UBIGINT)), 4294967295) % {HEADS} AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, t.pos, t.digest, t.words FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.digest, t.words FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h),
s AS (SELECT conv_id, row_number() OVER w AS d, string_agg(digest, '') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix, words
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos) UNION ALL SELECT conv_id, 0, '', 0 FROM c),
e AS (SELECT *, max(d) OVER (PARTITION BY conv_id) = d AS ends FROM s),
n AS MATERIALIZED (SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM e GROUP BY prefix, d),
k AS (SELECT substr(prefix, 1, {HEX} * (d - 1)) AS prefix, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
m AS MATERIALIZED (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (prefix, d)),
u AS (SELECT substr(prefix, 1, {HEX} * up) AS prefix, up AS d, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT prefix, unnest(range(d + 1)) AS up, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * words AS saved FROM m)
  GROUP BY 1, 2)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children,
  CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN u USING (prefix, d) LEFT JOIN n p ON p.d = m.d - 1 AND p.prefix = substr(m.prefix, 1, {HEX} * (m.d - 1))"""
