"""Near-duplicate embeddings by cross-polytope hashing, with multiprobe buckets and verified pairs.

Every vector is normalised, padded to a power of two and turned by three rounds of random
sign flips and a fast Hadamard transform.  A hash is the axis, with its sign, of the largest
coordinate; ``hashes`` of them name a vector's bucket in a table.  Each vector is at home in
one bucket of a table and also probes the next likely ones, where one hash takes a smaller
coordinate.  Two vectors meet where one is at home and the other is at home or probes.

1. *Dealing.*  Few tables with few hashes deal the vectors to buckets; how many hashes follows
   from the count of distinct vectors, so that a bucket stays a share that a task can hold.
   What is dealt is small: a byte a coordinate, the scale, the length of the error, and the
   vector's buckets.
2. *Candidates.*  In a bucket LOCAL further tables of two hashes, again with probes, tell the
   candidates among those that met; they depend on the vector alone, so a pair is a candidate
   in each bucket where it meets, or in none.  64 signs of turned coordinates sort out most
   of those that are far.
3. *Verification.*  The errors' lengths bound how far a cosine of rounded vectors can be off.
   Beyond the bound it decides; what lies within it is verified in double precision with the
   vectors themselves, joined to these pairs alone.

Copies of one vector take part once, with their count.  A pair is counted in the first
bucket in which it meets, so counts need no pairs to be kept: a bucket's share gives sums for
each vector and a spanning forest of links.  A bucket with many vectors is split into pairs of
parts of bounded size; no pair is lost and no task holds a whole bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, key_runs, looked_up, shuffle_partitions
from .components import components, stars

#: Rows of one part of a bucket, of a tile of a comparison, and pairs that are looked at together.
PART, TILE, PAIRS = 1 << 17, 512, 1 << 20
#: Buckets that are split are broadcast up to this many, and joined beyond.
MOST_BROADCAST = 100_000
#: Hashes of vectors to be verified are broadcast up to this many (8 bytes each), and joined beyond.
MOST_ENDS = 1_000_000
#: (tables, probes) of the dealing by its hashes, and (tables, hashes, probes) in a bucket.
DEALING = {1: (2, 2), 2: (4, 4), 3: (8, 6)}
LOCAL = (6, 2, 4)
#: Coordinates up to which a rotation is kept as a matrix.
DENSE = 256
#: What a vector is in a bucket's share: at home, to be compared with those at home, or both.
HOME, GUEST = 1, 2


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width, h = len(x), x.shape[1], 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x


def signs(seed: int, turn: int, width: int) -> np.ndarray:
    return np.random.default_rng([seed, turn, width]).choice([-1.0, 1.0], size=(3, width))


_rotations: dict[tuple[int, int, int], np.ndarray] = {}


def turned(x: np.ndarray, turn: int, seed: int) -> np.ndarray:
    """Rows after one of the rotations: three rounds of sign flips and Hadamard transforms.

    Up to DENSE coordinates the rounds are done once, on the unit vectors, and rows take the
    matrix.  Values are rounded far above the arithmetic's noise, so that equal rows and ties
    turn out alike in whatever batch they come.
    """
    width = x.shape[1]
    if width <= DENSE:
        if (seed, turn, width) not in _rotations:
            _rotations[seed, turn, width] = rounds(np.eye(width), signs(seed, turn, width))
        return np.round(x @ _rotations[seed, turn, width], 9)
    return np.round(rounds(x, signs(seed, turn, width)), 9)


def rounds(x: np.ndarray, flips: np.ndarray) -> np.ndarray:
    for flip in flips:
        x = hadamard(x * flip) / np.sqrt(x.shape[1])
    return x


def signatures(unit: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """(vectors, tables, 1 + probes) bucket numbers: home first, then the probes, likeliest first."""
    n, dim = unit.shape
    width = max(2, 1 << (dim - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :dim] = unit
    ranks = 1 + -(-probes // hashes)
    options = [(k, r) for r in range(1, ranks) for k in range(hashes)]
    out = np.empty((n, tables, 1 + probes), dtype=np.int64)
    rows = np.arange(n)
    for t in range(tables):
        choice, loss = [], []
        for k in range(hashes):
            x = turned(padded, t * hashes + k, seed)
            size = np.abs(x)
            best, top = np.empty((n, ranks), dtype=np.int64), np.empty((n, ranks))
            for r in range(ranks):
                at = size.argmax(axis=1)
                best[:, r], top[:, r] = 2 * at + (x[rows, at] < 0), size[rows, at]
                size[rows, at] = -1
            choice.append(best)
            loss.append(top[:, :1] - top)
        code = lambda ranks_of: sum(c[:, r] * (2 * width) ** (hashes - 1 - j) for j, (c, r) in enumerate(zip(choice, ranks_of)))  # noqa: B023,E731
        out[:, t, 0] = code([0] * hashes)
        if probes:
            other = np.stack([code([r if j == k else 0 for j in range(hashes)]) for k, r in options], axis=1)
            cost = np.stack([loss[k][:, r] for k, r in options], axis=1)
            order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            out[:, t, 1:] = other[rows[:, None], order]
    return out


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, float64 matrix) for each dimension among the vectors that can link: whole, finite, not zero."""
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    offsets = column.offsets.to_numpy()
    size = np.diff(offsets)
    known = column.is_valid().to_numpy(zero_copy_only=False)
    for d in np.unique(size[known & (size > 0)]).tolist():
        rows = np.flatnonzero(known & (size == d))
        x = values[offsets[rows][:, None] + np.arange(d)]
        ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if ok.any():
            yield rows[ok], x[ok]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, scale, error) of unit rows: x is bytes times scale but for a rest of at most this length."""
    scale = np.nextafter((np.abs(x).max(axis=1) / 127).astype(np.float32), np.float32(1))
    q = np.rint(x / scale[:, None].astype(np.float64)).astype(np.int8)
    rest = np.sqrt(((x - q * scale[:, None].astype(np.float64)) ** 2).sum(axis=1))
    return q, scale, np.nextafter(rest.astype(np.float32), np.float32(1))


def buckets(codes: np.ndarray, dim: int) -> np.ndarray:
    """Dimension, table and bucket number in one long, of (vectors, tables, 1 + probes) numbers."""
    return (np.int64(dim & 0x7FF) << np.int64(51)) | (np.arange(codes.shape[1], dtype=np.int64)[None, :, None] << np.int64(45)) | (codes & ((1 << 45) - 1))


def dealt(batches: Iterator[pa.RecordBatch], how: tuple[int, int, int, int], number: str, bare: bool) -> Iterator[pa.RecordBatch]:
    """From (h, v) a row for each bucket that a distinct vector of a batch is in: (bucket, home), and
    unless ``bare`` h, its count and its form: the rounded vector and its bucket numbers, of type ``number``.
    """
    for batch in batches:
        for rows, x in matrices(batch.column(1)):
            h, first, count = np.unique(batch.column(0).to_numpy()[rows], return_index=True, return_counts=True)
            for p in range(0, len(h), 4096):
                part = slice(p, p + 4096)
                y = unit(x[first[part]])
                n, d = y.shape
                codes = buckets(signatures(y, *how), d)
                each = codes.shape[1] * codes.shape[2]
                # with few axes probes come again; a vector is in a bucket once
                new = np.stack([(codes[:, :, :k] != codes[:, :, k : k + 1]).all(axis=2) for k in range(codes.shape[2])], axis=2).ravel()
                flat, home = pa.array(codes.ravel()[new]), pa.array(np.tile(np.arange(codes.shape[2]) == 0, n * codes.shape[1])[new])
                if bare:
                    yield pa.RecordBatch.from_arrays([flat, home], ["bucket", "home"])
                    continue
                q, scale, error = rounded(y)
                numbers = (codes & ((1 << 45) - 1)).reshape(n, -1).astype(number)
                packed = np.concatenate([q.view(np.uint8), scale[:, None].view(np.uint8), error[:, None].view(np.uint8), numbers.view(np.uint8)], axis=1)
                again = pa.array(np.repeat(np.arange(n), each)[new])
                form = pa.array([z.tobytes() for z in packed], pa.binary()).take(again)
                yield pa.RecordBatch.from_arrays([flat, home, pa.array(h[part]).take(again), pa.array(count[part]).take(again), form], ["bucket", "home", "h", "count", "form"])


def met_before(x: np.ndarray, y: np.ndarray, table: int, prober: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether pairs, by their buckets, met in an earlier table, or in this one where they are counted elsewhere.

    ``prober`` marks the pairs whose x only probes here; if y probes at x's home too, the
    pair counts where the smaller (``first``: x is) probes.
    """
    out = np.zeros(len(x), dtype=bool)
    for t in range(table):
        out |= (x[:, t, :] == y[:, t, :1]).any(axis=1) | (y[:, t, 1:] == x[:, t, :1]).any(axis=1)
    crossed = (y[:, table, 1:] == x[:, table, :1]).any(axis=1)
    return out | (prober & crossed & ~first)


class Share:
    """The distinct vectors of a share (bucket, i, j), and what tells its links."""

    def __init__(self, table: int, home: int, h: np.ndarray, count: np.ndarray, side: np.ndarray, form: np.ndarray, how: tuple[int, int, int, int], number: str, least: float):
        self.h, first, at = np.unique(h, return_index=True, return_inverse=True)
        self.count = np.bincount(at, weights=count).astype(np.int64)
        self.side, form = side[first], form[first]
        tables, _, probes, seed = how
        numbers = np.dtype(number).itemsize * tables * (1 + probes)
        d = form.shape[1] - 8 - numbers
        scale, self.error, self.codes = (np.ascontiguousarray(form[:, d + i : d + j]).view(k) for i, j, k in ((0, 4, "<f4"), (4, 8, "<f4"), (8, 8 + numbers, number)))
        self.error, self.codes = self.error[:, 0].astype(np.float64), self.codes.reshape(len(form), tables, 1 + probes)
        self.x = np.ascontiguousarray(form[:, :d]).view(np.int8).astype(np.float32) * scale
        self.table, self.least = table, least
        self.homes, self.guests = np.flatnonzero(self.side & HOME), np.flatnonzero(self.side & GUEST)
        self.home_here = self.codes[:, table, 0] == home
        self.local = np.concatenate([signatures(self.x[p : p + 512], *LOCAL, seed + 1) for p in range(0, len(form), 512)]).astype(np.int32)
        self.cells = (2 * max(2, 1 << (d - 1).bit_length())) ** LOCAL[1]
        self.sketch = sketches(self.x, seed + 1)
        share = acos(least) / pi
        self.most_bits = int(64 * share + 5.6 * sqrt(64 * share * (1 - share)))

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of rows those that count here by their order and whose sketches are near."""
        ordered = np.where(self.home_here[b], self.h[a] < self.h[b], self.h[a] != self.h[b])
        return ordered & (np.bitwise_count(self.sketch[a] ^ self.sketch[b]) <= self.most_bits)

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct pairs (at home, guest) that meet in a local table, and are near by their sketches; each comes where it meets first."""
        ranges = list(self.ranges())
        if sum(int((hi - lo).sum()) for *_, lo, hi in ranges) > len(self.homes) * len(self.guests) // 8:
            yield from self.dense()
            return
        for k, swapped, rows, order, lo, hi in ranges:
            for own, other in expanded(rows, order, lo, hi):
                a, b = (own, other) if swapped else (other, own)
                keep = self.near(a, b)
                a, b = a[keep], b[keep]
                new = ~self.meet(a, b, k)
                if swapped:  # met already where the guest is, or probes, at its home
                    new &= (self.local[a, k, :1] != self.local[b, k]).all(axis=1)
                yield a[new], b[new]

    def meet(self, a: np.ndarray, b: np.ndarray, tables: int) -> np.ndarray:
        """Whether pairs meet in one of the first local tables."""
        x, y = self.local[a, :tables], self.local[b, :tables]
        return ((x[:, :, :1] == y).any(axis=2) | (x == y[:, :, :1]).any(axis=2)).any(axis=1)

    def ranges(self) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(table, rows are those at home, rows, others by their home cell, from, to): the others in each cell that rows are in or probe."""
        for k in range(self.local.shape[1]):
            for swapped, rows, others in ((False, self.guests, self.homes), (True, self.homes, self.guests)):
                cell = self.local[others, k, 0]
                order = np.argsort(cell, kind="stable")
                cell, order = cell[order], others[order]
                starts = np.searchsorted(cell, np.arange(self.cells + 1)).astype(np.int32) if self.cells <= PAIRS else None
                for p in range(1 if swapped else 0, self.local.shape[2]):
                    own = self.local[rows, k, p]
                    lo, hi = (starts[own], starts[own + 1]) if starts is not None else (np.searchsorted(cell, own, x).astype(np.int32) for x in ("left", "right"))
                    # with few axes a probe comes again
                    new = (self.local[rows, k, :p] != own[:, None]).all(axis=1)
                    yield k, swapped, rows, order, lo, np.where(new, hi, lo)

    def dense(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same pairs, but for some that are far, by all cosines in tiles: cheaper where most meet."""
        slack = 2.1 * float(self.error.max()) + 1e-4
        for p in range(0, len(self.homes), TILE):
            for q in range(0, len(self.guests), TILE):
                own, other = self.homes[p : p + TILE], self.guests[q : q + TILE]
                r, c = np.nonzero(self.x[own] @ self.x[other].T >= self.least - slack)
                a, b = own[r], other[c]
                keep = self.near(a, b)
                a, b = a[keep], b[keep]
                met = self.meet(a, b, self.local.shape[1])
                yield a[met], b[met]

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, sure) of pairs that link, or may, and didn't meet before."""
        for a, b in ((x[p : p + PAIRS // 8], y[p : p + PAIRS // 8]) for x, y in self.candidates() for p in range(0, len(x), PAIRS // 8)):
            cosine = np.einsum("ij,ij->i", self.x[a], self.x[b]).astype(np.float64)
            bound = self.error[a] + self.error[b] * (1 + self.error[a]) + 1e-5
            some = cosine >= self.least - bound
            a, b, sure = a[some], b[some], (cosine >= self.least + bound)[some]
            new = ~met_before(self.codes[b], self.codes[a], self.table, ~self.home_here[b], self.h[b] < self.h[a])
            yield a[new], b[new], sure[new]


def sketches(x: np.ndarray, seed: int) -> np.ndarray:
    """64 signs of turned coordinates."""
    width = max(2, 1 << (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    bits = np.concatenate([turned(padded, 1000 + k, seed)[:, :64] < 0 for k in range(-(-64 // width))], axis=1)[:, :64]
    return np.packbits(bits, axis=1).view(">u8")[:, 0].astype(np.uint64)


def expanded(rows: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, other) for each of the others in each row's range, some PAIRS at a time."""
    count = (hi - lo).astype(np.int64)
    some = np.flatnonzero(count)
    share = np.cumsum(count[some]) // PAIRS
    edges = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(some)]
    for a, z in zip(edges, edges[1:]):
        own = some[a:z]
        n = count[own]
        if len(own):
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(rows[own], n), order[np.repeat(lo[own], n) + step]


FOUND = "a long, b long, more_a long, more_b long"


def compare(batches: Iterator[pa.RecordBatch], how: tuple[int, int, int, int], number: str, least: float) -> Iterator[pa.RecordBatch]:
    """(a, b, more_a, more_b) from shares (bucket, i, j): what to add to a's links (b null), edges of
    spanning forests (more_a null), and pairs to be verified, with what each adds to the other.
    """
    for table in key_runs(batches, ["bucket", "i", "j"]):
        bucket, i, j, side, h, count = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("bucket", "i", "j", "side", "h", "count"))
        forms = table.column("form").to_pylist()
        size = np.fromiter(map(len, forms), dtype=np.int64, count=len(forms))
        cut = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        # bucket names hold but the last bits of a length, so lengths are told apart once more
        for part in (p[size[p] == k] for p in np.split(np.arange(len(bucket)), cut) for k in np.unique(size[p])):
            if len(part) < 2 or not (side[part] & HOME).any():
                continue
            form = np.frombuffer(b"".join([forms[r] for r in part]), dtype=np.uint8).reshape(len(part), -1)
            name = int(bucket[part[0]])
            share = Share(name >> 45 & 63, name & ((1 << 45) - 1), h[part], count[part], side[part], form, how, number, least)
            sums = np.zeros(len(share.h), dtype=np.int64)
            ea, eb = [], []
            for a, b, sure in share.links():
                doubt = ~sure
                if doubt.any():
                    yield pa.RecordBatch.from_arrays([pa.array(share.h[a[doubt]]), pa.array(share.h[b[doubt]]), pa.array(share.count[b[doubt]]), pa.array(share.count[a[doubt]])], ["a", "b", "more_a", "more_b"])
                a, b = a[sure], b[sure]
                if len(a):
                    np.add.at(sums, a, share.count[b])
                    np.add.at(sums, b, share.count[a])
                    x, y = stars(a, b)
                    ea.append(x)
                    eb.append(y)
                    if sum(map(len, ea)) > PAIRS:
                        x, y = stars(np.concatenate(ea), np.concatenate(eb))
                        ea, eb = [x], [y]
            some = np.flatnonzero(sums)
            if len(some):
                none = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(share.h[some]), none, pa.array(sums[some]), none], ["a", "b", "more_a", "more_b"])
                x, y = stars(np.concatenate(ea), np.concatenate(eb))
                none = pa.nulls(len(x), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(share.h[x]), pa.array(share.h[y]), none, none], ["a", "b", "more_a", "more_b"])


def verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """The rows (a, b, more_a, more_b, x, y) whose vectors have a cosine of at least ``least`` in double precision."""
    for batch in batches:
        x, y = (batch.column(c) for c in (4, 5))
        keep = np.zeros(batch.num_rows, dtype=bool)
        for rows, p in matrices(x):
            q = next(iter(matrices(y.take(pa.array(rows)))))[1]
            keep[rows] = (unit(p) * unit(q)).sum(axis=1) >= least
        yield batch.select(["a", "b", "more_a", "more_b"]).filter(pa.array(keep))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, hashes: int | None = None, seed: int = 7) -> DataFrame:
    """One row per input row: ``id_col`` (long), n_links, component_id and kept.

    n_links counts the other rows that link directly, with cosine of at least ``least`` in
    double precision; component_id is the smallest id reachable, the row's own included;
    kept is whether that is the row's own.  A vector that is null, empty, zero, or holds a
    null or a value that isn't finite links with nothing, and so does a row without an id
    (component_id null, kept false).  Vectors of different lengths don't link.  Copies link
    with each other; rows that share an id but not the vector are nodes of their own.  Other
    columns aren't read; an empty table gives an empty result.  Vectors of any length are
    compared whole; beyond DENSE components their turns take n log n steps.  ``hashes`` follows from the count of distinct vectors.
    The recall of hashing is measured in the tests; what it finds is exact.
    """
    spark = vectors.sparkSession
    n = shuffle_partitions(spark)
    zero = F.lit(0.0)  # minus zero becomes zero
    same = F.transform(vectors[vector_col], lambda x: x + zero.cast(vectors.schema[vector_col].dataType.elementType))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), same.alias("v"))
    whole = F.col("id").isNotNull() & F.coalesce(F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("h", F.when(whole, F.xxhash64("v")))
    known = rows.where("h is not null")
    classes = checkpointed(known.groupBy("h").agg(F.min("id").alias("own"), F.count("*").alias("n")))
    size = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    width = known.select(F.size("v").alias("d")).agg(F.max("d")).first()[0] or 1
    axes = 2 * max(2, 1 << (width - 1).bit_length())
    if hashes is None:
        hashes = next((k for k in (1, 2) if size[0] * (1 + DEALING[k][1]) <= PART * axes**k), 3)
    how = (DEALING[hashes][0], hashes, DEALING[hashes][1], seed)
    number = "<u2" if axes**hashes <= 1 << 16 else "<u4" if axes**hashes <= 1 << 32 else "<u8"

    bare = known.select("h", "v").mapInArrow(lambda b: dealt(b, how, number, True), "bucket long, home boolean")
    large = checkpointed(bare.groupBy("bucket").count().select("bucket", F.ceil(F.col("count") / PART).cast("int").alias("parts")).where("parts > 1"))
    at = known.select("h", "v").mapInArrow(lambda b: dealt(b, how, number, False), "bucket long, home boolean, h long, count long, form binary")
    split = at.join(F.broadcast(large) if large.count() <= MOST_BROADCAST else large, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    split = split.withColumn("mine", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int"))
    # those at home in part i meet the others in part j; a row that is on both sides of a share is there once
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    as_guest = F.transform(every, lambda k: F.struct(k.alias("i"), F.col("mine").alias("j"), F.when(F.col("home") & (k == F.col("mine")), HOME | GUEST).otherwise(GUEST).alias("side")))
    at_home = F.transform(F.filter(every, lambda k: k != F.col("mine")), lambda k: F.struct(F.col("mine").alias("i"), k.alias("j"), F.lit(HOME).alias("side")))
    shares = split.withColumn("s", F.explode(F.when(F.col("home"), F.concat(as_guest, at_home)).otherwise(as_guest)))
    shares = shares.select("bucket", "s.i", "s.j", "s.side", "h", "count", "form").repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = checkpointed(shares.mapInArrow(lambda b: compare(b, how, number, least), FOUND))

    doubt = found.where("b is not null and more_a is not null")
    ends = checkpointed(doubt.select(F.col("a").alias("h")).union(doubt.select("b")).distinct())
    # so only these vectors are dealt
    one = known.join(F.broadcast(ends) if ends.count() <= MOST_ENDS else ends, "h", "left_semi").dropDuplicates(["h"])
    pairs = doubt.join(one.select(F.col("h").alias("a"), F.col("v").alias("x")), "a").join(one.select(F.col("h").alias("b"), F.col("v").alias("y")), "b")
    exact = checkpointed(pairs.select("a", "b", "more_a", "more_b", "x", "y").mapInArrow(lambda b: verified(b, least), FOUND))

    sums = found.where("b is null").select("a", "more_a").union(exact.select("a", "more_a")).union(exact.select("b", "more_b"))
    links = sums.groupBy("a").agg(F.sum("more_a").alias("links")).withColumnRenamed("a", "h")
    roots = components(found.where("b is not null and more_a is null").select("a", "b").union(exact.select("a", "b"))).withColumnRenamed("node", "h")
    linked = classes.join(roots, "h").join(links, "h").select("h", "own", "links", "root")
    named = linked.groupBy("root").agg(F.min("own").alias("component_id"), F.count("*").alias("n"))
    named = looked_up(linked, named, "root", size[0]).select("h", "links", "component_id")
    told = classes.join(named, "h", "left").select("h", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "own").alias("component_id"), "n")
    # rows without a vector that can link have no hash; they are dealt by their ids
    out = looked_up(rows.select("id", F.coalesce("h", F.xxhash64("id")).alias("key"), F.col("h").isNotNull().alias("can")), told, "h", size[1], "key")
    component = F.coalesce(F.when(F.col("can"), F.col("component_id")), F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce(F.when(F.col("can"), F.col("n_links")), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
