"""Centroid clustering of integer vectors by partial-distance search.

Squared differences are accumulated as integers over blocks of dimensions, those of high
variance first.  After every block the centroid that looks best is finished for each vector,
which gives its current best, and centroids that are strictly above it already are abandoned;
the survivors, ties among them, finish all dimensions, and the smallest distance, then the
smallest number, wins.

A round is one pass over the vectors where they lie: a task keeps sums of its own for each
centroid and dimension, and only these are shuffled, so neither a large cluster nor copies
gather anywhere.  The driver holds the centroids, whose number is a parameter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .vectors import largest, of_floats, scaled, whole

#: Dimensions of the first block; each further one doubles what is done.
FIRST = 8
#: Rows that are compared with all centroids at a time.
ROWS = 1024
#: The largest long.
MOST = 2**63 - 1


def narrowest(x: np.ndarray, centroids: np.ndarray, dims: int) -> type:
    """An integer type that holds every squared distance; Python's own integers where no other does."""
    most = (2 * max(largest(x), max((abs(int(c)) for c in centroids.ravel()), default=0))) ** 2 * dims
    return np.int32 if most < 2**31 else np.int64 if most < 2**63 else object


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest of ``centroids`` for each row of ``x``; ties go to the smaller number."""
    kind = narrowest(x, centroids, x.shape[1])
    c = centroids.astype(kind)[:, order]
    number, distance = np.empty(len(x), dtype=np.int32), np.empty(len(x), dtype=kind)
    for at in range(0, len(x), ROWS):
        some = slice(at, at + ROWS)
        number[some], distance[some] = searched(x[some].astype(kind)[:, order], c)
    return number, distance


def searched(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    def square(d: np.ndarray) -> np.ndarray:
        return (d * d).sum(axis=-1, dtype=d.dtype)

    def finished(rows: np.ndarray, j: np.ndarray) -> np.ndarray:
        return square(x[rows] - c[j])

    every, done = np.arange(len(x)), min(FIRST, x.shape[1])
    part = square(x[:, None, :done] - c[None, :, :done])
    best = finished(every, part.argmin(axis=1))
    i, j = np.nonzero(part <= best[:, None])
    part = part[i, j]
    while done < x.shape[1]:
        block = slice(done, 2 * done)
        part = part + square(x[i, block] - c[j, block])
        done = min(2 * done, x.shape[1])
        alive = part <= best[i]
        i, j, part = i[alive], j[alive], part[alive]
        if done < x.shape[1]:
            first, likely = likeliest(i, part)
            best[i[first]] = np.minimum(best[i[first]], finished(i[first], j[likely]))
            alive = part <= best[i]
            i, j, part = i[alive], j[alive], part[alive]
    _, likely = likeliest(i, part)
    return j[likely].astype(np.int32), part[likely]


def likeliest(i: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's run of pairs starts, and its first pair of the smallest part; every row has pairs, sorted by row and centroid."""
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    least = np.minimum.reduceat(part, starts)
    at = np.flatnonzero(part == np.repeat(least, np.diff(np.r_[starts, len(i)])))
    return starts, at[np.r_[True, i[at][1:] != i[at][:-1]]]


SUMS = "cluster int, dim int, s decimal(38,0), q double"


def summed(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, order: np.ndarray, scale: float) -> Iterator[pa.RecordBatch]:
    """A task's sums s and sums of squares q for each cluster and dimension; dimension -1 has the counts."""
    k, dims = centroids.shape
    sums, squares, counts = np.zeros((k, dims), dtype=object), np.zeros((k, dims)), np.zeros(k, dtype=np.int64)
    for batch in batches:
        for _, x in of_length(batch.column("v"), scale, dims):
            number, _ = nearest(x, centroids, order)
            by = np.argsort(number, kind="stable")
            there, starts = np.unique(number[by], return_index=True)
            held = x[by] if largest(x) * len(x) < 2**63 else x[by].astype(object)
            sums[there] += np.add.reduceat(held, starts, axis=0).astype(object)
            squares[there] += np.add.reduceat(held.astype(np.float64) ** 2, starts, axis=0)
            counts[there] += np.diff(np.r_[starts, len(by)])
    told = np.flatnonzero(counts)
    if len(told):
        cluster, dim = np.repeat(told, dims + 1), np.tile(np.r_[-1, np.arange(dims)], len(told))
        s = [Decimal(int(v)) for v in np.c_[counts[told].astype(object), sums[told]].ravel()]
        q = np.c_[np.zeros(len(told)), squares[told]].ravel()
        yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(dim.astype(np.int32)), pa.array(s, pa.decimal128(38, 0)), pa.array(q)], ["cluster", "dim", "s", "q"])


def of_length(column: pa.Array, scale: float, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    return ((rows, x) for rows, x in scaled(column, scale) if x.shape[1] == dims)


def assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, order: np.ndarray, scale: float) -> Iterator[pa.RecordBatch]:
    """(id, cluster, distance) of the vectors that are kept; a distance that isn't a long is null."""
    for batch in batches:
        for rows, x in of_length(batch.column("v"), scale, centroids.shape[1]):
            number, distance = nearest(x, centroids, order)
            told = [d if d <= MOST else None for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array(number), pa.array(told, pa.int64())], ["id", "cluster", "distance"])


def by_variance(n: int, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Dimensions from the largest variance down, of ``n`` vectors' sums and sums of squares."""
    with np.errstate(all="ignore"):
        spread = np.nan_to_num(q / max(n, 1) - (s / max(n, 1)) ** 2, nan=0.0)
    return np.argsort(-spread, kind="stable")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per kept vector: ``id_col``, cluster, distance, cluster_inertia, inertia and centroid_sha256.

    Kept are vectors of exactly ``dims`` components, none null or not finite; component x counts
    as the integer floor(scale * x), and a vector with one that isn't a long isn't kept either.
    Centroids start as the ``k`` kept vectors with the smallest lower-case hex sha256 of
    ``seed:id`` (a null id counts as empty text; rows of one id by their components), all kept ones if
    there are fewer.  Each round assigns every vector and moves every centroid that has vectors
    to their componentwise floor(sum / count), exactly; then vectors are assigned once more.

    Ties go to the smaller number.  Repeated rows count each.  A distance or sum of distances
    beyond a long is null.  No kept vectors give no rows.  Other columns aren't read.  The
    vectors are read once for each assignment and once for the start, so cut a long lineage
    before.
    """
    spark, rows = vectors.sparkSession, of_floats(vectors, id_col, vector_col)
    kept = rows.where((F.size("v") == dims) & whole(F.col("v"), scale))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = kept.select(key.alias("key"), F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("v")).orderBy("key", "v").limit(k).collect()
    at = [[int(x) for x in r["v"]] for r in start]
    if not at:
        return spark.createDataFrame([], f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    seen = np.array(at, dtype=np.float64)
    order = by_variance(len(seen), seen.sum(axis=0), (seen**2).sum(axis=0))
    for _ in range(rounds):
        centroids = np.array(at, dtype=object)
        told = rows.select("v").mapInArrow(lambda b, c=centroids, o=order: summed(b, c, o, scale), SUMS).groupBy("cluster", "dim").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
        sums = {(r["cluster"], r["dim"]): int(r["s"]) for r in told}
        total, squares = np.zeros(dims), np.zeros(dims)
        for r in told:
            if r["dim"] >= 0:
                total[r["dim"]] += float(r["s"])
                squares[r["dim"]] += r["q"]
        order = by_variance(sum(n for (_, d), n in sums.items() if d < 0), total, squares)
        at = [[sums[c, d] // sums[c, -1] for d in range(dims)] if (c, -1) in sums else at[c] for c in range(len(at))]
    centroids = np.array(at, dtype=object)
    id_type = vectors.schema[id_col].dataType.simpleString()
    out = checkpointed(rows.mapInArrow(lambda b: assigned(b, centroids, order, scale), f"id {id_type}, cluster int, distance long"))
    of = {r["cluster"]: int(r["s"]) if r["s"] is not None and r["n"] == r["known"] else None for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"), F.count("distance").alias("known")).collect()}
    total = sum(of.values()) if None not in of.values() else None
    as_long = lambda v: v if v is not None and v <= MOST else None
    facts = [(c, as_long(of.get(c, 0)), as_long(total), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(at)]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # a row for each centroid
    return out.join(F.broadcast(known), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
