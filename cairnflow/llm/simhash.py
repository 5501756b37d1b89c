"""SimHash near-duplicates found by anchor points of a covering code.

Fingerprints of 64 bits link where at most four bits differ.  The bits are split into three
blocks; if four bits differ, the first or the second block has at most one of them, or the
third has none.  In a block the anchors are the codewords of the binary Golay code (23, 12),
whose covering radius is 3: each block value has one home anchor within 3.  A fingerprint is
replicated to every anchor within the covering radius plus the block's threshold (one, one,
none), so it comes to the home anchor of every fingerprint within the threshold of it.

The bits outside of the block are cut into five parts, and the code that covers block and
part is the product of Golay's code and all values of the part, which cover it with radius
zero: as the other differing bits, four at most, leave a part alone, two near fingerprints
meet at one of the product's anchors.  Away from home one differing bit is used up, and four
of the parts are enough.  So there are some 2**21 anchors for each block and part; a
fingerprint comes to about 50, and comparisons for N of them are some N**2 / 33,000.

Only distinct fingerprints take part; copies join them again at the end.  An anchor with
many fingerprints is split into pairs of parts, each a task's share of bounded size, so a
hot anchor neither fills a task nor loses a pair.  From each share goes out a spanning
forest of its links (at most one edge for each fingerprint), not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, key_runs, looked_up, map_slices, shuffle_partitions, strings
from .components import components, stars

#: First bit, width and threshold of each block.
BLOCKS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
#: Widths of the parts of the bits outside of a block; the last has what is left.
PARTS = (9, 9, 9, 8, 8)
#: Fingerprints of one share of an anchor, and of a tile of a comparison; pairs that are compared at once.
PART, TILE, PAIRS = 1 << 14, 1024, 1 << 21
#: Anchors that are split are broadcast up to this many, and joined beyond.
MOST_BROADCAST = 100_000
#: What a fingerprint is at an anchor: at home, to be compared with those at home, or both.
HOME, GUEST = 1, 2


def fingerprints(texts: list[str], words: int = 4, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text: A-Z lower-cased, shingles of ``words`` words between ASCII white space, XXH64."""
    from xxhash import xxh64_intdigest

    counts, parts = [], []
    for text in texts:
        found = text.encode("utf-8", "surrogatepass").lower().split()
        n = len(found)
        if n <= words:
            counts.append(min(n, 1))
            if n:
                parts.append([xxh64_intdigest(b" ".join(found), seed)])
            continue
        flat = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=n) + 1)
        starts = [0, *ends[: n - words].tolist()]
        counts.append(n - words + 1)
        parts.append([xxh64_intdigest(flat[a:z], seed) for a, z in zip(starts, (ends[words - 1 :] - 1).tolist())])
    out = np.zeros(len(texts), dtype=np.uint64)
    count = np.array(counts, dtype=np.int64)
    some = np.flatnonzero(count)
    if len(some):
        h = np.concatenate([np.array(p, dtype="<u8") for p in parts])
        first = np.cumsum(count[some]) - count[some]
        for k in range(64):
            ones = np.add.reduceat((h >> np.uint64(k) & np.uint64(1)).astype(np.int64), first)
            out[some] |= (2 * ones > count[some]).astype(np.uint64) << np.uint64(k)
    return out


# -- the covering code --------------------------------------------------------------------


def golay_syndromes() -> np.ndarray:
    """Syndrome of each single-bit error of the cyclic Golay code: x^i modulo its generator polynomial."""
    generator = 0b110001110101  # fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
    out, r = [], 1
    for _ in range(23):
        out.append(r)
        r <<= 1
        if r >> 11:
            r ^= generator
    return np.array(out, dtype=np.int64)


def error_table(reach: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2048 syndromes the errors of at most ``reach`` bits that have it (padded with -1), and which is of at most 3."""
    single = golay_syndromes()
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(reach + 1):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= int(single[b])
            found[s].append(sum(1 << b for b in bits))
    width = max(map(len, found))
    return np.array([f + [-1] * (width - len(f)) for f in found], dtype=np.int64), np.array([bin(f[0]).count("1") for f in found])


def anchors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codewords within 4 of each 23-bit value, padded with -1; the first is the home anchor, within 3)."""
    errors, _ = _table()
    single = golay_syndromes()
    s = np.zeros(len(values), dtype=np.int64)
    for b in range(23):
        s ^= np.where(values >> b & 1, single[b], 0)
    e = errors[s]
    return np.where(e < 0, -1, values[:, None] ^ e)


_held: list = []


def _table():
    if not _held:
        _held.append(error_table())
    return _held[0]


def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, print, home): each fingerprint at each of its anchors; those at home are there once, for both sides."""
    for batch in batches:
        signed = batch.column(0).to_numpy(zero_copy_only=False)
        value = signed.astype(np.int64).view(np.uint64)
        for k, (first, width, threshold) in enumerate(BLOCKS):
            block = (value >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64)
            rest = value & np.uint64((1 << first) - 1) | value >> np.uint64(first + width) << np.uint64(first) if first + width < 64 else value & np.uint64((1 << first) - 1)
            at = anchors(block)
            away, column = np.nonzero(at[:, 1:] >= 0)
            for p, bits in enumerate(PARTS):
                part = (rest >> np.uint64(sum(PARTS[:p])) & np.uint64((1 << bits) - 1)).astype(np.int64)
                name = np.int64((k * len(PARTS) + p) << 32)
                rows, places = [np.arange(len(value))], [at[:, 0]]
                if threshold and p < len(PARTS) - 1:
                    rows.append(away)
                    places.append(at[away, column + 1])
                row, place = np.concatenate(rows), np.concatenate(places)
                home = np.arange(len(row)) < len(value)
                yield pa.RecordBatch.from_arrays([pa.array(name | place << 9 | part[row]), pa.array(signed[row]), pa.array(home)], ["bucket", "print", "home"])


def near_pairs(value: np.ndarray, side: np.ndarray, group: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ends of the links between those at home and the others of each group; ``group`` ascends from 0."""
    homes, others = np.flatnonzero(side & HOME), np.flatnonzero(side & GUEST)
    n = int(group[-1]) + 1
    n_home, n_other = np.bincount(group[homes], minlength=n), np.bincount(group[others], minlength=n)
    pairs = n_home * n_other
    pairs[np.bincount(group) < 2] = 0
    first_other, first_home = np.cumsum(n_other) - n_other, np.cumsum(n_home) - n_home
    for g in np.flatnonzero(pairs > PAIRS).tolist():
        x_all, y_all = value[homes[first_home[g] : first_home[g] + n_home[g]]], value[others[first_other[g] : first_other[g] + n_other[g]]]
        for p in range(0, len(x_all), TILE):
            for q in range(0, len(y_all), TILE):
                x, y = x_all[p : p + TILE], y_all[q : q + TILE]
                r, c = np.nonzero((np.bitwise_count(x[:, None] ^ y[None, :]) <= bits) & (x[:, None] != y[None, :]))
                if len(r):
                    yield x[r], y[c]
    small = homes[(pairs[group[homes]] > 0) & (pairs[group[homes]] <= PAIRS)]
    each = n_other[group[small]]
    share = np.cumsum(each) // PAIRS
    edges = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(small)]
    for a, z in zip(edges, edges[1:]):
        own, count = small[a:z], each[a:z]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        x, y = np.repeat(value[own], count), value[others[np.repeat(first_other[group[own]], count) + step]]
        near = (np.bitwise_count(x ^ y) <= bits) & (x != y)
        if near.any():
            yield x[near], y[near]


def compare(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Edges of a spanning forest of the links in each (bucket, i, j)."""
    for table in key_runs(batches, ["bucket", "i", "j"]):
        bucket, i, j, value, side = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("bucket", "i", "j", "print", "side"))
        new = np.concatenate([[0], (np.diff(bucket) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)])
        found, size = [], 0
        for x, y in near_pairs(value.view(np.uint64), side, np.cumsum(new), bits):
            found.append(stars(x.view(np.int64), y.view(np.int64)))
            size += len(found[-1][0])
            if size > 1 << 20:
                found, size = [stars(*map(np.concatenate, zip(*found)))], 0
        if found:
            a, b = stars(*map(np.concatenate, zip(*found)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links(prints: DataFrame, bits: int = 4) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, column ``print`` (long), whose components are those of all pairs within ``bits`` (at most 4)."""
    if not 0 <= bits <= 4:
        raise ValueError("the covering holds for 0 to 4 differing bits")
    n = shuffle_partitions(prints.sparkSession)
    # dealt to all tasks, as each print becomes some 50 rows; by another hash, as Spark leaves out what deals alike
    at = prints.select("print").repartition(n, F.xxhash64("print")).mapInArrow(spread, "bucket long, print long, home boolean")
    parts = checkpointed(at.groupBy("bucket").count().select("bucket", F.ceil(F.col("count") / PART).cast("int").alias("parts")).where("parts > 1"))
    split = at.join(F.broadcast(parts) if parts.count() <= MOST_BROADCAST else parts, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    split = split.withColumn("mine", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
    # those at home in part i meet the others in part j; a row that is on both sides of a share is there once
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    as_guest = F.transform(every, lambda k: F.struct(k.alias("i"), F.col("mine").alias("j"), F.when(F.col("home") & (k == F.col("mine")), HOME | GUEST).otherwise(GUEST).alias("side")))
    at_home = F.transform(F.filter(every, lambda k: k != F.col("mine")), lambda k: F.struct(F.col("mine").alias("i"), k.alias("j"), F.lit(HOME).alias("side")))
    shares = F.when(F.col("home"), F.concat(as_guest, at_home)).otherwise(as_guest)
    rows = split.select("bucket", "print", F.explode(shares).alias("s")).select("bucket", "s.i", "s.j", "print", "s.side")
    rows = rows.repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return rows.mapInArrow(lambda b: compare(b, bits), "a long, b long")


def printed(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, key, other_key, print) of each row, written down; the keys are a hash of id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fingerprints(strings(b.column(3)), words).view(np.int64))], ["id", "key", "other_key", "print"])

        yield from map_slices(batches, "text", work)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), *(k.alias(name) for k, name in zip(row_keys(docs[id_col], docs[text_col]), ("key", "other_key"))), docs[text_col].alias("text"))
    return checkpointed(rows.mapInArrow(run, f"id {kind}, key long, other_key long, print long"))


def row_keys(id_: Column, text: Column) -> tuple[Column, Column]:
    """Two hashes that together tell what is alike in id and text."""
    return F.xxhash64(id_.isNull(), id_, text.isNull(), text), F.xxhash64(F.lit(1), text, text.isNull(), id_, id_.isNull())


def grouped(prints: DataFrame, first: Column, bits: int, total: int) -> tuple[DataFrame, DataFrame]:
    """((print, first, n), (root, first, n)): the least ``first`` of each fingerprint's component, and of each component; n are rows, and fingerprints."""
    nodes = prints.groupBy("print").agg(F.min(first).alias("own"), F.count("*").alias("n"))
    roots = components(links(nodes, bits)).withColumnRenamed("node", "print")
    rooted = nodes.join(roots, "print", "left").select("print", "own", F.col("n").alias("rows"), F.coalesce("root", "print").alias("root"))
    named = rooted.groupBy("root").agg(F.min("own").alias("first"), F.count("*").alias("n"))
    return looked_up(rooted, named, "root", total).select("print", "first", F.col("rows").alias("n")), named


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """One row per input row: ``id_col``, fingerprint (16 lowercase hex digits) and component_id.

    component_id is the smallest id reachable over links, the row's own included.  A null or
    empty text, or one of white space, has fingerprint zero, which links like any other; a
    text of fewer than ``words`` words is one shingle.  A bit that exactly half of the hashes have
    is 0.  Repeated rows share a component; a
    row with a null id links like others but never names a component, unless no other is
    there (then null).  Other columns aren't read; an empty table gives an empty result.  A very
    long text is hashed whole, in time in proportion to its length.
    """
    prints = printed(docs, id_col, text_col, words)
    total = prints.count()
    classes, _ = grouped(prints, F.col("id"), bits, total)
    out = looked_up(prints.select("id", "print"), classes, "print", total)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """One row of ``docs``, with all its columns, for each component: that with the smallest id.

    Among rows that share this id but not the text, and among rows without an id where a
    component has no others, one is chosen by a hash of the text.  Rows alike in id and text
    are one document and stay once.  Nulls, white space, short and long texts are as in
    :func:`near_duplicates`; columns may have any names.
    """
    prints = printed(docs, id_col, text_col, words)
    own = F.struct(F.col("id").isNull().alias("nameless"), "id", "key", "other_key")
    _, named = grouped(prints, own, bits, prints.count())
    chosen = named.select(F.col("first.key").alias("__key"), F.col("first.other_key").alias("__other_key"))
    key, other = row_keys(docs[id_col], docs[text_col])
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(*(docs[c].alias(n) for c, n in names.items()), key.alias("__key"), other.alias("__other_key"))
    kept = rows.join(chosen, ["__key", "__other_key"], "left_semi").dropDuplicates(["__key", "__other_key"])
    return kept.select(*(F.col(n).alias(c) for c, n in names.items()))
