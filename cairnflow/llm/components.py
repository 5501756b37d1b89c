"""Connected components of a graph of any size, by alternating large-star and small-star steps.

Each step is a group-by minimum, with partial aggregation, and a lookup of it, in which a hot
node's minimum is broadcast; edges are never gathered in one place.  The edges of each
partition are first contracted to stars there, so few rounds are left.  Every round ends in
the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, looked_up


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of ``n`` nodes reaches over edges between positions ``a`` and ``b``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)  # hook roots, not only the edge's ends
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            return label


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as stars: (node, smallest node) for all but the smallest nodes themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = roots(at[: len(a)], at[len(a) :], len(nodes))
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        held.append(stars(a, b))
        size += len(held[-1][0])
        if size > 2_000_000:  # bounded: what is contracted already goes out
            for x, y in held:
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])
            held, size = [], 0
    if held:
        x, y = stars(*(np.concatenate(c) for c in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """For every node of ``edges`` (long columns a and b) its root, the smallest node that it reaches: (node, root).

    Loops and repeated edges are ignored; edges with a null end are dropped; no edges give no rows.
    """
    rows = edges.where("a <> b").select("a", "b")
    now = checkpointed(rows.mapInArrow(contract, "a long, b long").distinct())
    said = None
    while True:
        signature = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if signature == said or signature[0] == 0:
            break
        said = signature
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = looked_up(both, low, "a", 2 * signature[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        rest = looked_up(large, low, "a", signature[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpointed(rest.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
