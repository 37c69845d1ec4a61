"""Centroid clustering whose assignments come from sorted lists, one per dimension.

Vectors become whole numbers, so sums, means and distances are exact. A vector walks each
dimension's sorted centroid values outward from its own value; a centroid met in any list
gets its exact distance, and the walk ends when the squared gaps to the next unread entries
add up to more than the best distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runassay.llm.common import mapped, pin

WIDTH, SCALE = 64, 256
CLUSTERS, ROUNDS = 40, 5
#: Start of the text whose hash orders the vectors for the first centroids.
SEED = "2:"
#: Components stay below this, so that a squared distance fits a long.
LIMIT = 1 << 27
#: Vectors that walk the lists together.
ROWS = 512


def whole_vectors(embeddings: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """``vec_id, vector``: floor(scale * x) of vectors with ``width`` finite components."""
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def whole(x):
        value = F.lit(float(scale)) * x
        wide = F.raise_error(F.lit(f"a component times {scale} is beyond {LIMIT}: distances would not fit a long"))
        return F.when(F.abs(value) <= LIMIT, F.floor(value)).otherwise(wide.cast("long")).cast("int")

    return rows.where((F.size("embedding") == width) & finite).select(
        "vec_id", F.transform("embedding", whole).alias("vector")
    )


def nearest_by_threshold(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each row, its squared distance, and how many distances were taken.

    Ties go to the smaller number: the walk ends only when the frontier sum is strictly
    greater than the best distance, so a centroid as near is always met.
    """
    n, width = x.shape
    k = len(centroids)
    order = np.argsort(centroids, axis=0, kind="stable")
    values = np.take_along_axis(centroids, order, axis=0)
    # Entries 0 and k + 1 stand for the ends of a list.
    far = np.full((1, width), 4 * LIMIT, np.int64)
    values = np.concatenate([-far, values, far])
    dims = np.arange(width)
    right = np.stack([np.searchsorted(values[1:-1, d], x[:, d]) for d in dims], axis=1) + 1
    left = right - 1
    best = np.full(n, np.iinfo(np.int64).max)
    own = np.full(n, k)
    taken = np.zeros(n, np.int64)
    seen = np.zeros((n, k), bool)
    live = np.arange(n)
    while len(live):
        y, lo, hi = x[live], left[live], right[live]
        down, up = y - values[lo, dims], values[hi, dims] - y
        go_down = down <= up
        met = order[np.where(go_down, lo, hi) - 1, dims]
        lo, hi = lo - go_down, hi + ~go_down
        left[live], right[live] = lo, hi
        fresh = np.zeros((len(live), k), bool)
        fresh[np.arange(len(live))[:, None], met] = True
        fresh &= ~seen[live]
        seen[live] |= fresh
        row, col = np.nonzero(fresh)
        gap = y[row] - centroids[col]
        distance = np.full((len(live), k), np.iinfo(np.int64).max)
        distance[row, col] = np.einsum("ij,ij->i", gap, gap)
        taken[live] += fresh.sum(axis=1)
        number = distance.argmin(axis=1)
        least = distance[np.arange(len(live)), number]
        better = (least < best[live]) | ((least == best[live]) & (number < own[live]))
        best[live] = np.where(better, least, best[live])
        own[live] = np.where(better, number, own[live])
        # A list read to its ends has shown every centroid.
        read = ((lo < 1) & (hi > k)).any(axis=1) | seen[live].all(axis=1)
        frontier = np.minimum(y - values[lo, dims], values[hi, dims] - y)
        frontier = np.where(read[:, None], 0, frontier)
        live = live[~read & ((frontier * frontier).sum(axis=1) <= best[live])]
    return own, best, taken


def _matrices(batches, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            yield part, part.column("vector").flatten().to_numpy().reshape(-1, width).astype(np.int64)


def _sums(batches, centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts and component sums per centroid, one row per task and centroid that has any."""
    k, width = centroids.shape
    counts, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
    for _, x in _matrices(batches, width):
        own = nearest_by_threshold(x, centroids)[0]
        counts += np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict(
        {
            "cluster": pa.array(used, pa.int32()),
            "n": pa.array(counts[used]),
            "sums": pa.array(sums[used].tolist(), pa.list_(pa.int64())),
        }
    )


def _assigned(batches, centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part, x in _matrices(batches, centroids.shape[1]):
        own, best, _ = nearest_by_threshold(x, centroids)
        yield pa.RecordBatch.from_pydict(
            {"vec_id": part.column("vec_id"), "cluster": pa.array(own, pa.int32()), "distance": pa.array(best)}
        )


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of its vectors' exact mean; one without vectors stays.

    The driver gets one number per centroid and dimension, whatever the rows.
    """
    partial = mapped(vectors, _sums, "cluster int, n long, sums array<long>", centroids)
    wide = partial.select("cluster", "n", F.posexplode("sums").alias("dim", "part"))
    total = wide.groupBy("cluster", "dim").agg(
        F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")
    )
    out = centroids.copy()
    for r in total.collect():
        out[r["cluster"], r["dim"]] = int(r["total"]) // int(r["n"])
    return out


def cluster(
    embeddings: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    scale: int = SCALE,
    seed: str = SEED,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each kept vector.

    The first centroids are the vectors with the smallest sha256 of ``seed`` and the id, as
    many as there are if fewer than ``clusters``. Vectors that are null, of another length or
    hold null or non-finite components take no part; one without an id is no first centroid
    but is clustered; repeated rows count each, and of rows with one id the smaller vector
    comes first; other columns are ignored; an empty table gives no rows. A component beyond
    ``LIMIT`` stops the job, as distances would not fit a long.
    """
    spark = embeddings.sparkSession
    vectors = pin(whole_vectors(embeddings, width, scale), "vectors")
    named = vectors.where("vec_id IS NOT NULL").withColumn(
        "_hash", F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    )
    first = named.orderBy("_hash", "vector").limit(clusters).collect()
    if not first:
        return spark.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        )
    centroids = np.array([r["vector"] for r in first], np.int64)
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    found = pin(mapped(vectors, _assigned, "vec_id long, cluster int, distance long", centroids), "assigned")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # One row per centroid, so the sums and digests are small whatever the vectors.
    sums = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    whole = sum(sums.values())
    table = spark.createDataFrame(
        [(k, v, whole, digests[k]) for k, v in sums.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.join(F.broadcast(table), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def cluster_sql(
    clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: str = SEED
) -> str:
    """DuckDB SQL for :func:`cluster`, the rounds written out one after another."""
    ctes = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id,
  list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v FROM (
  SELECT sha256('{seed}' || vec_id) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {clusters}))""",
    ]
    for r in range(rounds + 1):
        ctes.append(
            f"""a{r} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min(best) AS best FROM (
  SELECT k.rid, k.vec_id, k.v, struct_pack(d := list_sum(list_transform(list_zip(k.v, c.v),
    lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c := c.cluster) AS best FROM kept k CROSS JOIN c{r} c) GROUP BY rid)"""
        )
        if r < rounds:
            ctes.append(
                f"""m{r} AS (SELECT cluster, list(x ORDER BY dim) AS v FROM (
  SELECT cluster, dim, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (
    SELECT cluster, dim, sum(val) AS s, count(*) AS n FROM (
      SELECT best.c AS cluster, generate_subscripts(v, 1) AS dim, unnest(v) AS val FROM a{r}) GROUP BY cluster, dim))
  GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.cluster = c.cluster)"""
            )
    return (
        "WITH " + ",\n".join(ctes) + f"""
SELECT a.vec_id, CAST(a.best.c AS INTEGER) AS cluster, CAST(a.best.d AS BIGINT) AS distance,
  CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.best.c"""
    )
