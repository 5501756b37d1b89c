"""Exact top-k search by tiled matrix products, a partial selection in every tile, and a tree of merges.

All vectors are dealt evenly to shards of bounded size; the queries, which are few of them, go
to every shard.  A task holds one shard, sorted by id, and lets the queries pass in blocks: a
block times a tile of the shard is one matrix product in double precision, exact as all sums
stay below 2**53.  A tile's scores above a query's current k-th best are selected and merged
into its list.  The lists of a query from all shards are merged FAN_IN at a time, level by
level, so no task sees more than FAN_IN lists of a query.

Nothing is broadcast or collected.  With n vectors of b bytes in s shards, about n * b for the
vectors and n * b * s / 100 for one query in 100 are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import indexed
from .common import checkpointed, release_memory, shuffle_partitions
from .vectors import largest, of_floats, scaled

#: Bytes of a shard at four a component; a task holds one shard.
SHARD = 128 << 20
#: Rows of a tile, and queries of a block.
TILE, BLOCK = 4096, 512
#: Lists of a query that are merged at a time.
FAN_IN = 16
#: Doubles hold every integer up to here.
EXACT = 2**53
LEAST, MOST = -(2**63), 2**63 - 1


def packed(x: np.ndarray) -> pa.Array:
    """Each row as bytes: the size of an integer, then the integers, in the smallest of 2, 4 and 8 bytes that holds all of the row's."""
    most = np.abs(x).max(axis=1) if x.shape[1] else np.zeros(len(x), dtype=np.int64)
    size = np.where(most < 1 << 15, 2, np.where(most < 1 << 31, 4, 8))
    return pa.array([bytes([s]) + r.astype(f"<i{s}").tobytes() for s, r in zip(size.tolist(), x)], pa.binary())


def unpacked(forms: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for each length and size among ``forms``."""
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, f in enumerate(forms):
        kinds.setdefault((f[0], len(f)), []).append(i)
    for (size, _), at in kinds.items():
        yield np.array(at), np.frombuffer(b"".join(forms[i][1:] for i in at), dtype=f"<i{size}").reshape(len(at), -1) if len(forms[at[0]]) > 1 else np.zeros((len(at), 0), dtype="<i2")


def prepared(batches: Iterator[pa.RecordBatch], scale: float, own: bool) -> Iterator[pa.RecordBatch]:
    """(id, form), and with ``own`` the score of a vector with itself."""
    for batch in batches:
        for rows, x in scaled(batch.column("v"), scale):
            columns = [batch.column("id").take(pa.array(rows)), packed(x)]
            if own:
                columns.append(pa.array([limited(sum(v * v for v in r)) for r in x.tolist()], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "form", "own"][: len(columns)])


def limited(score: int) -> int:
    return min(max(score, LEAST), MOST)


class Shard:
    """Vectors by length, each with ids in rising order (unknown ones last)."""

    def __init__(self) -> None:
        self.held: dict[int, tuple[list[pa.Array], list[np.ndarray]]] = {}
        self.whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, ids: pa.Array, forms: list[bytes]) -> None:
        for at, x in unpacked(forms):
            held = self.held.setdefault(x.shape[1], ([], []))
            held[0].append(ids.take(pa.array(at)))
            held[1].append(x)

    def freeze(self) -> None:
        """One matrix for each length, in the order of the ids."""
        for d, (ids, xs) in self.held.items():
            known = pa.concat_arrays(ids)
            x = np.concatenate(xs)  # numpy takes the widest type
            unknown = known.is_null().to_numpy(zero_copy_only=False)
            order = np.lexsort((known.fill_null(0).to_numpy(zero_copy_only=False), unknown))
            self.whole[d] = (known.take(pa.array(order)), x[order])
        self.held = {}

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, pa.Array, list[int]] | None:
        """(query, id, score) of the k best for each query, or None where no vector has its length."""
        if queries.shape[1] not in self.whole:
            return None
        ids, x = self.whole[queries.shape[1]]
        bound = largest(queries) * largest(x) * queries.shape[1]
        tops = tiled(queries, x, k) if bound * TILE < EXACT else one_by_one(queries, x, k)
        q, place, score = tops
        return q, ids.take(pa.array(place)), score


def tiled(queries: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    queries = queries.astype(np.float64)
    best, place = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1)
    for a in range(0, len(x), TILE):
        score = queries @ x[a : a + TILE].astype(np.float64).T
        m = score.shape[1]
        # places rise with ids, so a later equal score never comes before an earlier one
        hit = score > best[:, -1:]
        crowded = np.flatnonzero(hit.sum(axis=1) > 4 * k)
        if len(crowded) and m > k:
            key = score[crowded] * m + np.arange(m - 1, -1, -1)
            top = np.argpartition(key, m - k, axis=1)[:, m - k :]
            chosen = np.zeros((len(crowded), m), dtype=bool)
            np.put_along_axis(chosen, top, True, axis=1)
            hit[crowded] &= chosen
        i, j = np.nonzero(hit)
        if not len(i):
            continue
        touched = np.unique(i)
        row = np.r_[np.repeat(touched, k), i]
        s = np.r_[best[touched].ravel(), score[i, j]]
        p = np.r_[place[touched].ravel(), j + a]
        order = np.lexsort((p, -s, row))
        start = np.searchsorted(row[order], touched)
        first = order[(start[:, None] + np.arange(k)).ravel()]
        best[touched], place[touched] = s[first].reshape(-1, k), p[first].reshape(-1, k)
    q, n = np.nonzero(place >= 0)
    return q, place[q, n], best[q, n].astype(np.int64).tolist()


def one_by_one(queries: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The same with Python's integers, for components whose products doubles don't hold; a score beyond a long counts as the nearest long."""
    q, place, score = [], [], []
    for i, row in enumerate(queries.astype(object)):
        top: list[tuple[int, int]] = []
        for a in range(0, len(x), TILE):
            products = (x[a : a + TILE].astype(object) * row).sum(axis=1)
            top = nsmallest(k, [*top, *((-limited(int(s)), a + n) for n, s in enumerate(products))])
        q += [i] * len(top)
        place += [p for _, p in top]
        score += [-s for s, _ in top]
    return np.array(q, dtype=np.int64), np.array(place, dtype=np.int64), score


FOUND = "q long, part int, id long, score long"


def compared(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Every query's best of each shard, from rows (shard, q, id, form) sorted by shard with the vectors (null q) before the queries."""
    now, shard = None, Shard()
    try:
        for batch in batches:
            number = batch.column("shard").to_numpy(zero_copy_only=False)
            asks = batch.column("q").is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (asks[1:] != asks[:-1]), True])
            for a, b in zip(edges, edges[1:]):
                if number[a] != now:
                    now, shard = number[a], Shard()
                part = batch.slice(a, b - a)
                if not asks[a]:
                    shard.add(part.column("id"), part.column("form").to_pylist())
                    continue
                if shard.held:
                    shard.freeze()
                for c in range(0, part.num_rows, BLOCK):
                    some = part.slice(c, BLOCK)
                    q = some.column("q").to_numpy()
                    for at, x in unpacked(some.column("form").to_pylist()):
                        found = shard.search(x, k)
                        if found is not None:
                            mine, ids, score = found
                            yield pa.RecordBatch.from_arrays([pa.array(q[at][mine]), pa.array(np.full(len(mine), now, dtype=np.int32)), ids, pa.array(score, pa.int64())], ["q", "part", "id", "score"])
    finally:
        release_memory()


def search(vectors: DataFrame, asked: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is ``asked`` (a condition on ``vectors``) the k other rows with the highest inner product.

    Component x counts as the integer floor(scale * x).  Vectors that are null, hold a null or a
    value that isn't finite, or a scaled one that isn't a long, take no part.  Only vectors of
    one length have a product; that of empty ones is 0.  Ties go to the smaller id, a null id
    last.  A row isn't found by itself, but by all others, copies of it and rows of its id too;
    a query row that is there m times has its answer m times.  A score beyond a long counts as
    the nearest long.  Without queries or other rows there are no rows.  Other columns aren't
    read by the search.
    """
    spark, n = vectors.sparkSession, shuffle_partitions(vectors.sparkSession)
    size = of_floats(vectors, id_col, vector_col).agg(F.count("*"), F.coalesce(F.sum(F.greatest(F.size("v"), F.lit(1))), F.lit(0))).first()
    made = of_floats(vectors.where(asked), id_col, vector_col, "long").mapInArrow(lambda b: prepared(b, scale, True), "id long, form binary, own long")
    queries = indexed(checkpointed(made.groupBy("id", "form", "own").agg(F.count("*").alias("copies"))), "q")
    n_queries = queries.count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards = max(1, -(-4 * size[1] // SHARD), min(n, max(16, size[0] // n_queries)))

    candidates = of_floats(vectors, id_col, vector_col, "long").mapInArrow(lambda b: prepared(b, scale, False), "id long, form binary")
    # rows are dealt by where they lie, so copies are spread as well
    dealt = candidates.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"), F.lit(None).cast("long").alias("q"), "id", "form")
    everywhere = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "q", "id", "form")
    cells = dealt.union(everywhere).repartition(shards, "shard").sortWithinPartitions("shard", F.asc_nulls_first("q"))
    # own row included, so one more
    lists = checkpointed(cells.mapInArrow(lambda b: compared(b, k + 1), FOUND))
    order = (F.desc("score"), F.asc_nulls_last("id"))
    parts = shards
    while parts > 1:
        parts = -(-parts // FAN_IN)
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        lists = lists.withColumn("place", F.row_number().over(Window.partitionBy("q", "part").orderBy(*order))).where(F.col("place") <= k + 1).drop("place")

    asking = queries.select("q", F.col("id").alias("query_id"), "own", "copies")
    mine = (F.col("id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    by_query = Window.partitionBy("q")
    placed = lists.join(asking, "q").withColumn("place", F.row_number().over(by_query.orderBy(*order)))
    # entries of one id and score are alike, so the first of them stands for the query's own row
    placed = placed.withColumn("self", F.min(F.when(mine, F.col("place"))).over(by_query)).where("self is null or place <> self")
    ranked = placed.withColumn("rank", (F.col("place") - F.coalesce((F.col("place") > F.col("self")).cast("int"), F.lit(0))).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
