"""Approximate nearest neighbours by cosine over balanced posting lists.

Equal vectors are one entry with its least ids. A bounded sample gives centroids, whose number
grows with the entries; a neighbour graph held in each task searches them, for entries and for
queries. Entries near a border go to several lists, and lists of any length are cut into chunks.
A query reads the lists whose centroids are not farther than a ratio of the mean distance of its
nearest ones. The ratio is what some queries need whose neighbours are known from a scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runassay.llm.common import mapped, pin

TOP = 5
QUERY_STEP = 50
#: A list for so many entries; bounds of the fit: centroids, and vectors they are fitted on.
LIST_TARGET = 256
MOST_CENTROIDS = 16_384
SAMPLE, SAMPLE_PER_CENTROID = 20_000, 8
#: A vector goes to up to REPLICAS lists within this ratio of its least distance.
REPLICAS, REPLICA_RATIO = 4, 1.15
#: The ratio of a query is fitted on so many queries, for this share of their neighbours; a query
#: reads on until it has met PROBE_ROWS entries.
FIT_QUERIES, FIT_SHARE, PROBE_ROWS = 256, 0.94, 512
#: Distances to so many nearest centroids are what the ratio refers to. With one alone, vectors
#: without clusters need half as many lists more, as the least of many like distances is chance.
REFERENCE = 16
CHUNK, QUERY_CHUNK = 4096, 1024
LINKS, FAR_LINKS, BEAM = 16, 4, 64


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Cluster of each unit row; a cluster's size counts against it, so sizes stay close."""
    centres = x[rng.choice(len(x), k, replace=False)]
    load = np.zeros(k)
    for _ in range(rounds):
        near = x @ centres.T - 0.05 * load[None, :]
        own = near.argmax(axis=1)
        counts = np.bincount(own, minlength=k)
        load = counts * k / len(x)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centres)
    return own


def balanced_centroids(x: np.ndarray, want: int, seed: int = 7) -> np.ndarray:
    """About ``want`` centroids: parts are split until none is larger than its share."""
    rng = np.random.default_rng(seed)
    limit = max(1, -(-len(x) // max(want, 1)))
    open_, out = [np.arange(len(x))], []
    while open_:
        part = open_.pop()
        k = min(8, -(-len(part) // limit))
        own = _kmeans(x[part], k, rng) if k > 1 else np.zeros(len(part), int)
        if k <= 1 or len(set(own.tolist())) == 1:
            mean = x[part].mean(axis=0)
            size = np.linalg.norm(mean)
            out.append(mean / size if size > 1e-12 else x[part[0]])
        else:
            open_ += [part[own == j] for j in range(k) if (own == j).any()]
    return np.array(out)


@dataclass
class CentroidGraph:
    """Centroids with links to near ones and a few far ones, searched best first."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray, seed: int = 11) -> CentroidGraph:
        rng = np.random.default_rng(seed)
        n = len(centroids)
        near = min(LINKS, n - 1)
        links = np.zeros((n, near + min(FAR_LINKS, n)), np.int64)
        for i in range(0, n, 512):
            sims = centroids[i : i + 512] @ centroids.T
            rows = np.arange(len(sims))
            sims[rows, i + rows] = -9
            if near:
                links[i : i + 512, :near] = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        links[:, near:] = rng.integers(0, n, (n, links.shape[1] - near))
        return cls(centroids, links, rng.choice(n, min(n, 16), replace=False))

    def search(self, x: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of about the ``top`` nearest centroids, nearest first."""
        n, c = len(x), len(self.centroids)
        beam = min(max(BEAM, top), c)
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, c), bool)
        seen[:, self.entries] = True
        found = np.repeat(self.entries[None, :], n, axis=0)
        sims = x @ self.centroids[self.entries].T
        done = np.zeros(found.shape, bool)
        while True:
            waiting = np.where(done, -np.inf, sims)
            at = waiting.argmax(axis=1)
            live = np.flatnonzero(waiting[rows[:, 0], at] > -np.inf)
            if not len(live):
                break
            done[live, at[live]] = True
            step = self.links[found[live, at[live]]]
            fresh = ~seen[live[:, None], step]
            # A link that is listed twice counts once.
            order = np.sort(step, axis=1)
            if (order[:, 1:] == order[:, :-1]).any():
                for j in range(1, step.shape[1]):
                    fresh[:, j] &= ~(step[:, :j] == step[:, j : j + 1]).any(axis=1)
            seen[live[:, None], step] = True
            more = np.full((n, step.shape[1]), -np.inf)
            more[live] = np.where(fresh, np.einsum("nd,nkd->nk", x[live], self.centroids[step]), -np.inf)
            number = np.zeros((n, step.shape[1]), np.int64)
            number[live] = step
            found = np.concatenate([found, number], axis=1)
            sims = np.concatenate([sims, more], axis=1)
            done = np.concatenate([done, ~np.isfinite(more)], axis=1)
            if found.shape[1] > beam:
                keep = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
                found, sims, done = found[rows, keep], sims[rows, keep], done[rows, keep]
        order = np.argsort(-sims, axis=1, kind="stable")[:, : min(top, sims.shape[1])]
        return found[rows, order], sims[rows, order]

    def scan(self, x: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """The same without the graph and exact, for most of the centroids."""
        sims = x @ self.centroids.T
        order = np.argsort(-sims, axis=1, kind="stable")[:, :top]
        return order, np.take_along_axis(sims, order, axis=1)

    def within(self, x: np.ndarray, ratio: float, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and list of all centroids within ``ratio`` of each row's nearest ones.

        The beam of a row widens until it holds a centroid that is too far, so the ratio
        decides and no number. Lists go on until they hold ``PROBE_ROWS`` entries in all.
        """
        rows, lists = [], []
        live, beam, c = np.arange(len(x)), BEAM, len(self.centroids)
        while len(live):
            beam = min(beam, c)
            found, sims = (self.scan if 2 * beam >= c else self.search)(x[live], beam)
            far = _distance(sims)
            met = np.cumsum(sizes[found], axis=1) - sizes[found]
            take = (far <= ratio * far[:, :REFERENCE].mean(axis=1, keepdims=True) + 1e-12) | (met < PROBE_ROWS)
            done = ~take[:, -1] | (beam >= c)
            row, col = np.nonzero(take & done[:, None])
            rows.append(live[row])
            lists.append(found[row, col])
            live, beam = live[~done], beam * 4
        return np.concatenate(rows or [live]), np.concatenate(lists or [live])


def _distance(sims: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * sims, 0))


def _entries(batches, width: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows with a proper vector: id, digest and bytes."""
    for batch in batches:
        ids, digests, vectors = [], [], []
        for key, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
            if key is None or vector is None or len(vector) != width or None in vector:
                continue
            x = np.array(vector, kind)
            wide = x.astype(float)
            if np.isfinite(wide).all() and wide.any():
                data = (x + 0).tobytes()  # -0 and 0 alike
                ids.append(key)
                digests.append(xxhash.xxh3_128_digest(data))
                vectors.append(data)
        yield pa.RecordBatch.from_pydict(
            {"vec_id": pa.array(ids, pa.int64()), "digest": pa.array(digests, pa.binary()), "vector": pa.array(vectors, pa.binary())}
        )


def _matrix(vectors: pa.Array, kind: str) -> np.ndarray:
    rows = vectors.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(float)


def _assign(batches, shared, kind: str) -> Iterator[pa.RecordBatch]:
    """Lists of each entry: the nearest, and others as near that are not close to one taken."""
    graph: CentroidGraph = shared.value
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            part = batch.slice(k, 1024)
            found, sims = graph.search(unit_rows(_matrix(part.column("vector"), kind)), REPLICAS)
            far = _distance(sims)
            take = far <= REPLICA_RATIO * far[:, :1] + 1e-12
            for j in range(1, found.shape[1]):
                for i in range(j):
                    between = _distance((graph.centroids[found[:, j]] * graph.centroids[found[:, i]]).sum(axis=1))
                    take[:, j] &= ~take[:, i] | (between > far[:, j])
            row, col = np.nonzero(take)
            out = part.take(pa.array(row))
            yield out.append_column("list", pa.array(found[row, col].astype(np.int32)))


def _probe(batches, shared, kind: str, sizes: np.ndarray, ratio: float) -> Iterator[pa.RecordBatch]:
    """Lists of each query."""
    graph: CentroidGraph = shared.value
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            part = batch.slice(k, 1024)
            row, lists = graph.within(unit_rows(_matrix(part.column("vector"), kind)), ratio, sizes)
            out = part.take(pa.array(row))
            yield out.append_column("list", pa.array(lists.astype(np.int32)))


def _best_of(batches, queries: np.ndarray, kind: str, top: int) -> Iterator[pa.RecordBatch]:
    """The nearest entries of a task for each of a few queries, themselves left out."""
    best = np.full((len(queries), top), -np.inf)
    names = np.full((len(queries), top), b"", object)
    for batch in batches:
        for k in range(0, batch.num_rows, 4096):
            part = batch.slice(k, 4096)
            sims = queries @ unit_rows(_matrix(part.column("vector"), kind)).T
            digests = np.array(part.column("digest").to_pylist(), object)
            sims[sims > 1 - 1e-12] = -np.inf
            both = np.concatenate([best, sims], axis=1)
            at = np.argpartition(-both, min(top, both.shape[1]) - 1, axis=1)[:, :top]
            own = np.where(at < top, np.take_along_axis(names, np.minimum(at, top - 1), axis=1), digests[np.maximum(at - top, 0)])
            best, names = np.take_along_axis(both, at, axis=1), own
    row, col = np.nonzero(np.isfinite(best))
    yield pa.RecordBatch.from_pydict(
        {"query": pa.array(row, pa.int32()), "digest": pa.array(names[row, col].tolist(), pa.binary()), "sim": pa.array(best[row, col])}
    )


def fitted_ratio(vectors: DataFrame, lists: DataFrame, queries: DataFrame, graph: CentroidGraph, kind: str, top: int) -> float:
    """The ratio within which the wanted share of some queries' true neighbours have a list.

    ``FIT_QUERIES`` queries, chosen by a hash, meet all entries in one scan.
    """
    chosen = queries.select("digest", "vector").distinct().orderBy(F.xxhash64("digest"), "digest").limit(FIT_QUERIES).collect()
    if not chosen:
        return 1.0
    x = unit_rows(np.frombuffer(b"".join([r["vector"] for r in chosen]), kind).reshape(len(chosen), -1).astype(float))
    found = mapped(vectors.select("digest", "vector"), _best_of, "query int, digest binary, sim double", x, kind, top)
    place = Window.partitionBy("query").orderBy(F.desc("sim"), "digest")
    near = found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= top)
    rows = near.join(lists.select("digest", "list"), "digest").select("query", "digest", "list").collect()
    own = np.sort(_distance(x @ graph.centroids.T), axis=1)[:, :REFERENCE].mean(axis=1)
    need: dict[tuple, float] = {}
    for r in rows:
        k = (r["query"], bytes(r["digest"]))
        far = float(_distance(x[r["query"]] @ graph.centroids[r["list"]])) / max(float(own[r["query"]]), 1e-12)
        need[k] = min(far, need.get(k, np.inf))
    return float(np.quantile(sorted(need.values()), FIT_SHARE, method="higher")) if need else 1.0


def _scored(batches, kind: str, keep: int) -> Iterator[pa.RecordBatch]:
    """Best entries of each query within a block; rows come sorted by block, entries first."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows < 1 << 13:
            continue
        block = _block(held)
        last = int(np.searchsorted(block, block[-1]))
        if last:
            yield from _score(held.slice(0, last), block[:last], kind, keep)
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield from _score(held, _block(held), kind, keep)


def _block(table: pa.Table) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    for c in ("list", "chunk", "query_chunk"):
        x = table.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


def _score(table: pa.Table, block: np.ndarray, kind: str, keep: int) -> Iterator[pa.RecordBatch]:
    edges = np.flatnonzero(np.diff(block, prepend=-1, append=block[-1] + 1))
    for begin, end in zip(edges[:-1], edges[1:], strict=True):
        part = table.slice(begin, end - begin).combine_chunks()
        asks = part.column("is_query").to_numpy(zero_copy_only=False)
        n = int((~asks).sum())
        if not n or n == len(asks):
            continue
        x = _matrix(part.column("vector").combine_chunks(), kind)
        own, query = x[:n], x[n:]
        sims = unit_rows(query) @ unit_rows(own).T
        top = min(n, keep + 2)
        near = np.argpartition(-sims, top - 1, axis=1)[:, :top]
        # Entries that tie with the last one within rounding must not be left out.
        least = np.take_along_axis(sims, near, axis=1).min(axis=1) - 1e-12
        ids = part.column("ids").slice(0, n).to_pylist()
        keys = part.column("digest").slice(n).to_pylist()
        norm = np.sqrt((own * own).sum(axis=1))
        out: tuple[list, list, list] = ([], [], [])
        for i, key in enumerate(keys):
            at = near[i] if top == n else np.flatnonzero(sims[i] >= least[i])
            exact = (own[at] * query[i]).sum(axis=1) / (norm[at] * np.sqrt((query[i] * query[i]).sum()))
            rows = sorted((-s, v) for s, j in zip(exact.tolist(), at.tolist(), strict=True) for v in ids[j])[:keep]
            out[0].extend([key] * len(rows))
            out[1].extend([v for _, v in rows])
            out[2].extend([-s for s, _ in rows])
        yield pa.RecordBatch.from_pydict(
            {"digest": pa.array(out[0], pa.binary()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())}
        )


def nearest(embeddings: DataFrame, top: int = TOP, step: int = QUERY_STEP) -> DataFrame:
    """The ``top`` nearest others found of each row whose id is divisible by ``step``.

    ``query_id, rank, vec_id, score``: nearest first, ties to the smaller id. Vectors that are
    null, zero, hold null or non-finite components, have no id or another length than most
    take no part; an id repeated with one vector counts once. Other columns are ignored; an
    empty table gives no rows.
    """
    spark = embeddings.sparkSession
    kind = "<f4" if "float" in embeddings.schema["embedding"].dataType.simpleString() else "<f8"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    widths = rows.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("w")).count()
    common = widths.orderBy(F.desc("count"), "w").first()
    width = common["w"] if common else 0
    entries = pin(
        mapped(rows, _entries, "vec_id long, digest binary, vector binary", width, kind), "vectors"
    )
    keep = top + 1
    least = Window.partitionBy("digest").orderBy("vec_id")
    distinct = entries.dropDuplicates(["digest", "vec_id"]).withColumn("_n", F.row_number().over(least))
    vectors = pin(
        distinct.where(F.col("_n") <= keep)
        .groupBy("digest")
        .agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("vec_id")).alias("ids")),
        "entries",
    )
    n = vectors.count()
    scale = 1 << 40
    hashed = F.pmod(F.xxhash64("digest"), F.lit(scale))
    wanted = max(1, min(MOST_CENTROIDS, n // LIST_TARGET))
    size = max(SAMPLE, SAMPLE_PER_CENTROID * wanted)
    chosen = vectors.where(hashed < min(scale, scale * size // max(n, 1))).select("digest", "vector").orderBy("digest")
    sample = [r["vector"] for r in chosen.collect()]
    if not sample and n:
        sample = [vectors.first()["vector"]]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = unit_rows(np.frombuffer(b"".join(sample), kind).reshape(len(sample), -1).astype(float))
    graph = CentroidGraph.of(balanced_centroids(x, wanted))
    shared = spark.sparkContext.broadcast(graph)
    lists = pin(
        mapped(vectors, _assign, "digest binary, vector binary, ids array<long>, list int", shared, kind), "lists"
    )
    # A number per list; there are MOST_CENTROIDS lists at most, or some times that after splits.
    sizes = np.zeros(len(graph.centroids), np.int64)
    for r in lists.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    queries = pin(entries.where(F.col("vec_id") % step == 0).select("vec_id", "digest", "vector").distinct(), "queries")
    ratio = fitted_ratio(vectors, lists, queries, graph, kind, top)
    probes = pin(
        mapped(
            queries.dropDuplicates(["digest"]).select("digest", "vector"),
            _probe, "digest binary, vector binary, list int", shared, kind, sizes, ratio,
        ),
        "probes",
    )
    asked = probes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_CHUNK).cast("int").alias("query_chunks"))
    chunks = lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    cut = pin(asked.join(chunks, "list"), "chunks")
    slot = F.xxhash64("digest")
    held = lists.join(cut, "list").select(
        "list", F.pmod(slot, "chunks").cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.col("query_chunks") - 1)).alias("query_chunk"),
        F.lit(False).alias("is_query"), "digest", "vector", "ids",
    )
    asks = probes.join(cut, "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.pmod(slot, "query_chunks").cast("int").alias("query_chunk"),
        F.lit(True).alias("is_query"), "digest", "vector", F.lit(None).cast("array<long>").alias("ids"),
    )
    block = ["list", "chunk", "query_chunk"]
    both = held.unionByName(asks).repartition(*block).sortWithinPartitions(*block, "is_query")
    found = mapped(both, _scored, "digest binary, vec_id long, score double", kind, keep)
    best = Window.partitionBy("digest").orderBy(F.desc("score"), "vec_id")
    found = (
        found.groupBy("digest", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= keep).drop("_n")
    )
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        queries.select(F.col("vec_id").alias("query_id"), "digest")
        .join(pin(found, "found"), "digest")
        .where(F.col("query_id") != F.col("vec_id"))
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", "score")
    )
